import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm import bm25, hilbert, load_all, pii, simhash



@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    places = hilbert.hilbert_places(cells, bits)
    assert sorted(places) == list(range(len(places)))
    assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_runs_of_the_curve(spark, docs, no_docs, texts):
    for ranges in (1, 7):
        rows = hilbert.shards(docs.drop("text"), ["source", "lang", "n_chars"], ["doc_id"], ranges=ranges).collect()
        sizes = Counter(r["shard"] for r in rows)
        assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
        for shard, n in sizes.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
        order = [r["place"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
        assert order == sorted(order)
    assert hilbert.shards(no_docs.drop("text"), ["n_chars"], ["doc_id"]).count() == 0
    assert hilbert.shards(docs.limit(3).drop("text"), ["n_chars"], ["doc_id"]).count() == 3


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    hilbert.write_shards(docs, path, ["source", "n_chars"], ["doc_id"])
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def personal_texts():
    import random

    chance = random.Random(5)
    letters = list("ab1.@+-_ ()0123456789é🙂,") + [".com", "4111111111111111", "1.2.3.4", "+1 (017) 555-7713", "\n"]
    many = ["".join(chance.choices(letters, k=chance.randint(0, 60))) for _ in range(600)]
    many += ["a@b.c_d@e.f", "a@b@c.d", "x" * 3000 + "@a.b", "a@" + "b.c" * 9000, "1" * 20000, "0001.002.3.004 256.1.1.1", None, ""]
    many += [f"api token = \"{'0123456789abcdef' * 2}{k:08x}\" here" for k in range(40)] + ["call tel. (555) 123-4567 now"] * 5
    return many + [" ".join(["a@b.co +49 171 2345678"] * 300)]


def test_spans_and_redaction(spark):
    many = personal_texts()
    df = spark.createDataFrame(list(enumerate(many)), "doc_id int, text string").repartition(4)
    found = pii.with_spans(df, pii.train(pii.histogram(df)))
    rows = found.select("doc_id", "text", "spans", pii.said(F.col("spans")).alias("said"), pii.redacted(F.col("text"), F.col("spans")).alias("red")).collect()
    assert len(rows) == len(many)
    added = 0
    for r in rows:
        text, spans = r["text"] or "", [(s["start"], s["k"], s["end"]) for s in r["spans"]]
        assert [s for s, own in zip(spans, r["spans"]) if own["base"]] == base_spans(text)
        assert spans == sorted(spans)
        assert r["said"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        out, at = "", 0
        for start, kind, end in spans:
            if end > at:
                out, at = out + text[at : max(start, at)] + f"[{pii.KINDS[kind].upper()}]", end
        assert (r["red"] or "") == out + text[at:] and (r["red"] is None) == (r["text"] is None)
        added += sum(not s["base"] for s in r["spans"])
    assert added >= 40
    assert pii.with_spans(df.limit(0), {}).count() == 0 and pii.train({}) == {}


def test_expectation_maximisation_tells_good_labelers():
    truth = {(1, 0, 1, 1, 1): 900, (-1, 0, 0, -1, -1): 900, (1, 0, -1, 1, 1): 50, (-1, 0, 1, -1, 1): 50}
    share, chances = pii.reliabilities({(0, votes): n for votes, n in truth.items()})
    assert 0.4 < share < 0.6 and chances[0][1][0] > 0.9 > 0.1 > chances[0][1][1]
    assert pii.reliabilities({(1, (0, 0, 0, 0, 0)): 5, (-1, (0, 0, 0, 0, 0)): 5})[0] == pytest.approx(0.5)


def test_registered_query_counts(spark):
    rows = load_all()[0]["op5_pii_weak_supervision"](spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    for r in rows:
        spans = base_spans(texts[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def brute_top(texts, query_ids, k):
    bags = [(i, Counter(re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower().strip())) if t else Counter()) for i, t in texts]
    for _, b in bags:
        b.pop("", None)
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    asked = defaultdict(Counter)
    for i, b in bags:
        if i in query_ids:
            asked[i].update(b)
    out = {}
    for q, words in asked.items():
        scores = []
        for i, b in bags:
            length = sum(b.values())
            s = sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w, f in words.items() if w in b)
            if s > 0:
                scores.append((-round(s, 5), -1 if i is None else i))
        out[q] = sorted(scores)[:k]
    return out


def test_top_k_equals_brute_force(docs, no_docs, texts):
    ids = {0, 5, 12, 103, 104, 107, 112}
    for postings in (bm25.SHARD_POSTINGS, 300):
        rows = bm25.search(docs, docs.filter(F.col("doc_id").isin(*ids)), k=5, shard_postings=postings).collect()
        expected = brute_top(texts, ids, 5)
        for q in ids:
            own = sorted((r["rank"], r["score"]) for r in rows if r["query_id"] == q)
            assert [round(-s, 5) for _, s in own] == pytest.approx([s for s, _ in expected.get(q, [])], abs=2e-5)
            assert [k for k, _ in own] == list(range(1, len(own) + 1))
    assert bm25.search(no_docs, no_docs, k=5).count() == 0
    assert bm25.search(docs, no_docs, k=5).count() == 0


def test_query_blocks_pass_by_the_drivers_python(docs, texts, monkeypatch):
    def refused(*_):
        raise AssertionError("the driver's Python holds a block")

    monkeypatch.setattr(bm25, "QUERY_TERMS", 40)  # several blocks
    monkeypatch.setattr(type(docs), "toPandas", refused)
    monkeypatch.setattr(type(docs), "toArrow", refused)
    ids = {0, 5, 12, 103, 104, 107, 112}
    found = bm25.search(docs, docs.filter(F.col("doc_id").isin(*ids)), k=5)
    own = defaultdict(list)
    for r in found.collect():
        own[r["query_id"]].append((r["rank"], round(-r["score"], 5)))
    expected = {q: [s for s, _ in rows] for q, rows in brute_top(texts, ids, 5).items() if rows}
    assert {q: [s for _, s in sorted(rows)] for q, rows in own.items()} == {q: pytest.approx(rows, abs=2e-5) for q, rows in expected.items()}


@pytest.mark.parametrize("wide", [0, 3, 256])
def test_queries_scored_together_equal_single_sums(monkeypatch, wide):
    monkeypatch.setattr(bm25, "WIDE", wide)
    monkeypatch.setattr(bm25, "TOGETHER", 5)
    chance = random.Random(wide)
    texts = ["" if n % 50 == 7 else " ".join(f"w{int(chance.paretovariate(0.6)) % 400}" for _ in range(chance.randint(1, 60))) for n in range(700)]
    bags = [bm25.bag(t) for t in texts]
    shard = bm25.Shard(bm25._shard(list(range(700)), bags).to_pylist()[0], 30.0)
    held = np.zeros((len(shard.terms), len(shard.wide)))
    held[np.repeat(np.arange(len(shard.terms)), shard.sizes), shard.docs] = shard.part
    asked = [(np.sort(t), 1.0 + np.arange(len(t)) % 3) for t, _, _ in bags[:23]] + [(np.array([5]), np.ones(1)), (shard.terms[:1], np.ones(1))]
    for (terms, weights), (at, scores) in zip(asked, shard.best(asked, 10), strict=True):
        own = np.isin(shard.terms, terms)
        sums = (np.array([dict(zip(terms.tolist(), weights))[t] for t in shard.terms[own].tolist()])[:, None] * held[own]).sum(axis=0)
        least = max(np.sort(sums)[-10], 1e-9)
        assert set(np.flatnonzero(sums >= least)) <= set(at.tolist())
        assert scores == pytest.approx(sums[at])
    assert list(bm25.Shard(bm25._shard([None], [bm25.bag("")]).to_pylist()[0], 1.0).best(asked[:1], 10))[0][0].size == 0
    left, right = np.arange(700.0).reshape(100, 7), np.arange(280.0).reshape(7, 40)
    assert (bm25._product(left, right) == left @ right).all()


def test_a_task_of_many_shards_gets_the_block_once_and_gives_one_list(spark, docs, texts):
    shards = bm25.index(docs, shard_postings=300).coalesce(1)
    assert shards.count() > 10
    held = shards.select(F.sum(F.octet_length("docs")).alias("docs"), F.sum(F.octet_length("tfs")).alias("tfs")).first()
    postings = sum(len(bm25.bag(t)[0]) for _, t in texts)
    assert held["docs"] == 2 * postings and held["tfs"] <= 2 * postings
    n, words = bm25.totals(shards)
    asked = bm25.query_terms(docs.filter("doc_id IN (0, 5, 12)")).join(bm25.frequencies(shards), "term")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = asked.select(F.lit(0).alias("block"), "query_id", "term", "tf", idf.alias("idf"))
    block = rows.groupBy("block").applyInArrow(bm25._pack, bm25.PACKED)
    found = defaultdict(list)
    for r in bm25._search_block(shards, block, words / n, 5).collect():
        found[r["query_id"]].append(round(-r["score"], 5))
    assert {q: sorted(s) for q, s in found.items()} == {q: pytest.approx([s for s, _ in best], abs=2e-5) for q, best in brute_top(texts, {0, 5, 12}, 5).items()}


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.landed(stage(spark, docs, folder), name)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        seen.append((name, before, after))
    rules, model, copies, personal = seen
    assert [i for i in rules[1] if labels.get(i) == 1 and i not in rules[2] and len(rules[1][i].split()) >= 20] == []
    assert all(labels.get(i) != 0 for i in model[2])
    prints = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in copies[1].items()}
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 4 for j in prints if j < i) for i in set(copies[1]) - set(copies[2]))
    kept = sorted(copies[2])
    assert all((prints[i] ^ prints[j]).bit_count() > 4 for n, i in enumerate(kept) for j in kept[:n])
    assert set(personal[1]) == set(personal[2]) and not any(base_spans(t) for t in personal[2].values())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == set(personal[2])


def test_pipeline_is_registered_and_takes_awkward_rows(spark, docs, no_docs, tmp_path):
    folder = str(tmp_path)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, table in (("some", plain), ("none", plain.limit(0))):
        table.write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{folder}/{name}").collect()
        assert bool(rows) == (name == "some")


def test_a_megabyte_of_spans_takes_seconds(spark):
    import time

    chance = random.Random(8)
    kinds = ["mail me at user{0}@host{0}.example.com", "1.2.{1}.{1}", "999.{0}.3.4.5", "call 555-010-{2:04d}", "key=Ab{0:09d}xYz{0:09d}qW"]
    parts = [chance.choice(kinds).format(n, n % 256, n % 10000) for n in range(50_000)]
    long = spark.createDataFrame([(1, " ".join(parts))], "doc_id int, text string")
    short = spark.createDataFrame([(1, " ".join(parts[:200]))], "doc_id int, text string")
    weights = pii.train(pii.histogram(short))
    started = time.time()
    rows = pii.with_spans(long, weights).select("text", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("red")).collect()
    assert time.time() - started < 60
    text, spans = rows[0]["text"], [(s["start"], s["k"], s["end"]) for s in rows[0]["spans"]]
    assert len(text) > 1_000_000 and len(spans) > 20_000
    assert [s for s, own in zip(spans, rows[0]["spans"]) if own["base"]] == base_spans(text)
    out, at = [], 0
    for start, kind, end in spans:
        if end > at:
            out += [text[at : max(start, at)], f"[{pii.KINDS[kind].upper()}]"]
            at = end
    assert rows[0]["red"] == "".join([*out, text[at:]])
