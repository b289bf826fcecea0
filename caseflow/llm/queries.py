"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import bm25, classifier, dualtree, hilbert, packing, pieces, pii, quality, repair, simhash, tokencounts, warc, whitening
from caseflow.llm.registry import documents, query
from caseflow.llm.store import landed, new_path
from caseflow.llm.textstats import stop_forms
from caseflow.llm.tokens import vocabulary

OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
places AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
ends AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM twice),
reps AS (SELECT doc_id, sum(n) AS n FROM ends GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop_words
      FROM w LEFT JOIN reps USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.25
       AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.4 AS kept
FROM v
""".replace("{stop}", ", ".join(f"'{w}'" for w in stop_forms()))


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judged(documents(spark, folder).select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept"
    )


@query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    forest = classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    held = classifier.held_out(F.col("doc_id")).alias("held_out")
    return classifier.scored(docs, forest).select("doc_id", held, "score", "predicted")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(simhash.fingerprints(documents(spark, folder)))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


@query("op3_hilbert_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, folder).select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = hilbert.shards(docs, ["source", "lang", "n_chars", "doc_id"], ["doc_id", "text_crc32"])
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none, "place")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    items = packing.pieces(documents(spark, folder), vocabulary(), with_ids=False)
    return packing.packed(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_repair_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    repair.write(documents(spark, folder), path, vocabulary())
    return repair.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op5_pii_weak_supervision")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = pii.with_spans(docs, pii.train(pii.histogram(docs)))
    base = F.filter("spans", lambda c: c["base"])

    def count(kind: int):
        return F.size(F.filter(base, lambda c: c["k"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    counts = [count(kind) for kind in (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)]
    return found.select("doc_id", *counts, F.sha2(pii.said(base), 256).alias("base_sha256"), pii.said(F.col("spans")).alias("spans"))


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.counts(documents(spark, folder), vocabulary("piece_bpe_32k.model"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(documents(spark, folder), model), model)
    # Giant documents come in several rows; their key is the row number, others have a row of their own.
    per_row = rows.select(
        "doc_id", "row", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, k: a + k).alias("s"),
        F.length("text").cast("long").alias("c"), (F.col("text") == F.col("decoded")).alias("same"),
    )
    per_row = landed(per_row, "piece-counts")  # narrow; both readers below would else encode every text
    whole = per_row.filter("row IS NULL").select("doc_id", F.col("n").alias("n_pieces"), F.col("s").alias("id_sum"), F.col("c").alias("n_chars"), F.col("same").alias("round_trip"))
    giant = per_row.filter("row IS NOT NULL").groupBy("row", "doc_id").agg(
        F.sum("n").alias("n_pieces"), F.sum("s").alias("id_sum"), F.sum("c").alias("n_chars"), F.bool_and("same").alias("round_trip")
    )
    return whole.unionByName(giant.drop("row"))


OP6_SQL = """
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D!-/:-@\\[-`{-~]+'), lambda x: x <> '')) AS term
           FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY ALL),
s AS (SELECT count(*) AS n, (SELECT count(*) FROM w) / count(*) AS mean FROM documents),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM p WHERE doc_id % 50 = 0),
x AS (SELECT query_id, p.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
      FROM q JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc_id = p.doc_id CROSS JOIN s GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM x QUALIFY rank <= 10
"""


@query("op6_bm25_top_k", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return bm25.search(docs, docs.filter("doc_id % 50 = 0"), k=10)


@query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS terms
           FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM l),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term
            FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY ALL),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (r) CROSS JOIN s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_ranked_lexical_search", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    return dualtree.search(documents(spark, folder).select("doc_id", "text"), items, k=10)


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h,
             max(page_id) OVER (PARTITION BY payload) AS stored FROM p)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(8), lambda g: list_reduce(list_transform(range(4), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * k)) & 31), 1)),
           lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM d
"""


@query("op13_warc_archives", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_path(spark, "archives")
    lines = warc.write(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"), archives)
    return warc.read(spark, archives, lines).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
