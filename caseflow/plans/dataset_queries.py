"""Dataset tooling and source/sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators import dataset
from caseflow.plans.registry import query
from caseflow.session import shared_folder
from caseflow.sources import tables
from caseflow.sources.tables import TABLES

RULES = [("proof", "Ti.*the"), ("title", "On|Die"), ("tax", "que la"), ("other", "e")]


@query("b15_file_category", """
  SELECT doc_id AS id, CASE WHEN regexp_matches(text, 'Ti.*the') THEN 'proof' WHEN regexp_matches(text, 'On|Die') THEN 'title'
    WHEN regexp_matches(text, 'que la') THEN 'tax' WHEN regexp_matches(text, 'e') THEN 'other' END AS category FROM documents""")
def _(t):
    return t.documents.select(F.col("doc_id").alias("id"), dataset.file_category("text", RULES).alias("category"))


def _manifest(t):
    return t.documents.select(
        F.col("lang").alias("category"), F.col("doc_id").alias("place"), F.col("source").alias("folder"),
        F.when(F.col("n_chars") > 10, F.sha2("text", 256)).alias("digest"),
    )


OUTCOMES = """
  m AS (SELECT lang AS category, doc_id AS place, CASE WHEN n_chars > 10 THEN sha256(text) END AS digest FROM documents),
  o AS (
    SELECT *, CASE WHEN category = 'de' THEN 'excluded_categories' WHEN digest IS NULL THEN 'unreadable_files'
      WHEN row_number() OVER (PARTITION BY category, digest ORDER BY place) = 1 THEN 'kept' ELSE 'duplicates' END AS outcome FROM m)"""


@query("e4_keep_first", f"WITH {OUTCOMES} SELECT category, place, digest, outcome FROM o")
def _(t):
    marked = dataset.mark_duplicates(_manifest(t), "category", "digest", "place", ["de"])
    return marked.select("category", "place", "digest", "outcome")


@query("d7_outcome_counts", f"WITH {OUTCOMES} SELECT outcome, category, count(*) AS record_count FROM o GROUP BY outcome, category")
def _(t):
    return dataset.outcome_counts(dataset.mark_duplicates(_manifest(t), "category", "digest", "place", ["de"]), "category")


@query("e10_cap_per_category", """
  WITH held AS (SELECT lang, count(*) AS n FROM documents WHERE source = 'src1' GROUP BY lang),
  r AS (SELECT lang AS category, doc_id AS place, source AS folder,
    row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS rn FROM documents WHERE source <> 'src1')
  SELECT category, place, folder FROM r LEFT JOIN held ON held.lang = r.category WHERE rn + coalesce(n, 0) <= 50""")
def _(t):
    records = _manifest(t).select("category", "place", "folder")
    existing = records.filter("folder = 'src1'")
    return dataset.cap_per_category(
        records.filter("folder <> 'src1'"), "category", [F.col("folder"), F.col("place")], 50, existing
    )


@query("e11_folder_slice", """
  WITH f AS (SELECT DISTINCT source FROM documents WHERE starts_with(source, 'src1')),
  s AS (SELECT source FROM f ORDER BY source LIMIT 4 OFFSET 2)
  SELECT doc_id AS place, source AS folder FROM documents WHERE source IN (SELECT source FROM s)""")
def _(t):
    return dataset.slice_folders(_manifest(t).select("place", "folder"), "folder", ["src1"], 2, 4)


@query("e12_unique_names", """
  WITH n AS (SELECT event_id AS place, event_type || '-' || user_id || '.v1.pdf' AS name FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place) AS rn FROM n)
  SELECT place, name, CASE WHEN rn = 1 THEN name ELSE substr(name, 1, length(name) - 4) || '_' || rn || '.pdf' END AS unique_name FROM r""")
def _(t):
    entries = t.events.select(
        F.col("event_id").alias("place"), F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit(".v1.pdf")).alias("name")
    )
    return dataset.unique_names(entries, "name", "place")


@query("g4_exclude_present", """
  SELECT doc_id, source FROM documents WHERE lang NOT IN ('de') AND source NOT IN (SELECT source FROM documents WHERE n_chars > 8000)""")
def _(t):
    present = t.documents.filter("n_chars > 8000").select("source").distinct()
    return t.documents.filter(~F.col("lang").isin("de")).select("doc_id", "source").join(present, "source", "left_anti").select("doc_id", "source")


@query("d9_policy_report", """
  WITH runs AS (
    SELECT l_returnflag AS policy, l_linestatus AS category, round_even((l_discount + 0.5) * 10000, 0)::BIGINT AS area, l_quantity::BIGINT AS tokens,
      l_partkey % 900 AS ms, (l_linenumber % 3)::BIGINT AS base, CASE WHEN l_tax < 0.05 THEN l_linenumber % 3 ELSE 0 END::BIGINT AS matched FROM lineitem),
  totals AS (SELECT sum(tokens + 20) AS t, sum(ms + 500) AS d FROM runs)
  SELECT policy, coalesce(category, 'all') AS category, count(*) AS pages, round(sum(matched)::DOUBLE / greatest(sum(base), 1), 4) AS field_agreement,
    round(sum(area)::DOUBLE / count(*) / 10000, 4) AS mean_area_ratio, round(sum(tokens)::DOUBLE / any_value(t), 4) AS token_ratio,
    round(sum(ms)::DOUBLE / any_value(d), 4) AS duration_ratio
  FROM runs, totals GROUP BY GROUPING SETS ((policy), (policy, category))""")
def _(t):
    base = F.col("l_linenumber") % 3
    runs = t.lineitem.select(
        F.col("l_returnflag").alias("policy"), F.col("l_linestatus").alias("category"),
        F.bround((F.col("l_discount") + 0.5) * 10000).cast("long").alias("area_basis_points"), F.col("l_quantity").cast("long").alias("tokens"),
        (F.col("l_partkey") % 900).alias("duration_ms"), base.cast("long").alias("baseline_fields"),
        F.when(F.col("l_tax") < 0.05, base).otherwise(0).cast("long").alias("matched_fields"),
    )
    full = runs.select((F.col("tokens") + 20).alias("tokens"), (F.col("duration_ms") + 500).alias("duration_ms"))
    return dataset.policy_report(runs, full)


@query("d8_label_agreement", """
  WITH j AS (SELECT d.lang AS category, l.quality = 1 AND l.toxic = 0 AS expected, d.n_chars > 300 AS predicted FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
  SELECT coalesce(category, 'all') AS category, count(*) FILTER (expected) AS baseline_fields, count(*) FILTER (expected AND predicted) AS matched_fields,
    round(count(*) FILTER (expected AND predicted)::DOUBLE / greatest(count(*) FILTER (expected), 1), 4) AS field_agreement FROM j GROUP BY ROLLUP (category)""")
def _(t):
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    rows = joined.select(F.col("lang").alias("category"), (F.col("n_chars") > 300).alias("matched"), F.expr("quality = 1 AND toxic = 0").alias("expected"))
    return dataset.agreement_report(rows, expected="expected")


PROPS = T.StructType([T.StructField("k", T.LongType())])


@query("a2_json_records", """
  SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE regexp_extract(props, '([0-9]+)', 1)::BIGINT END AS k, event_type = 'error' AS is_bad
  FROM events WHERE event_type <> 'view'""")
def _(t):
    line = F.when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    parsed = tables.parse_json_lines(t.events.select("event_id", line.alias("line")), "line", PROPS)
    return parsed.select("event_id", "record.k", "is_bad")


@query("a3_file_inventory")
def _(t):
    return tables.file_inventory(t.spark, t.folder, [".parquet"])


@query("a4_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", tables.content_digest("text").alias("digest"))


@query("a5_json_sink", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    rows = t.documents.select("doc_id", "lang", "source", "n_chars")
    path = f"{shared_folder(t.spark)}/manifest-{uuid.uuid4().hex}"
    tables.write_new_version(rows, path, "json")
    good, _ = tables.read_json_lines(t.spark, path, rows.schema)
    return good


@query("a6_append_new", "SELECT doc_id, source, n_chars FROM documents")
def _(t):
    rows = t.documents.select("doc_id", "source", "n_chars")
    path = f"{shared_folder(t.spark)}/collected-{uuid.uuid4().hex}"
    tables.append_new(rows.filter("n_chars > 500"), path, ["doc_id"], None)
    tables.append_new(rows, path, ["doc_id"], t.spark.read.parquet(path))
    return t.spark.read.parquet(path)


@query("a8_snapshot_counts", " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in TABLES))
def _(t):
    root = f"{shared_folder(t.spark)}/backup-{uuid.uuid4().hex}"
    tables.write_snapshot({name: getattr(t, name) for name in TABLES}, root, "20011231T000000")
    copies = {name: t.spark.read.parquet(f"{root}/snapshot=20011231T000000/{name}") for name in TABLES}
    return tables.snapshot_counts(copies)
