"""Registered queries: each one is a Spark plan and, where SQL can say it, its oracle."""

from importlib import import_module

MODULES = [
    "ledger_queries", "dimension_queries", "column_queries", "merge_queries", "text_queries", "html_queries",
    "token_queries", "dataset_queries", "stream_queries",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"caseflow.plans.{name}")
