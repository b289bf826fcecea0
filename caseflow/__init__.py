"""Case-ledger analytics, reconciliation and document jobs as Spark DataFrame functions."""
