import base64
import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import dualtree, jacobi, load_all, warc, whitening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dim", [1, 2, 5, 13, 64, 200])
def test_leading_pairs_equal_a_dense_solver(dim):
    a = np.random.default_rng(dim).standard_normal((dim, 3 * dim))
    matrix = a @ a.T / dim
    values, vectors = jacobi.leading(lambda x: matrix @ x, dim, 8)
    exact, dense = np.linalg.eigh(matrix)
    exact, dense = exact[::-1][:8], dense[:, ::-1][:, :8]
    assert np.allclose(values, exact, rtol=1e-13)
    assert np.abs(np.abs((dense * vectors).sum(axis=0)) - 1).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-13 * exact[0]


@pytest.mark.parametrize("spectrum", [np.zeros(20), np.ones(30), np.r_[5.0, 5, 5, 4, 4, 3, np.ones(50)], np.r_[9.0, 1e-9, np.zeros(30)]])
def test_leading_pairs_of_repeated_and_missing_eigenvalues(spectrum):
    turn, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum),) * 2))
    matrix = turn @ np.diag(spectrum) @ turn.T
    values, vectors = jacobi.leading(lambda x: matrix @ x, len(spectrum), 8)
    assert np.allclose(values, np.sort(spectrum)[::-1][:8], atol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-13)


def test_products_with_rounding_noise_still_end():
    noise = np.random.default_rng(5)
    matrix = np.diag(np.linspace(1, 2, 80))
    values, _ = jacobi.leading(lambda x: (matrix @ x) * (1 + 2e-15 * noise.standard_normal(x.shape)), 80, 8)
    assert np.allclose(values, np.linspace(2, 1, 80)[:8], rtol=1e-12)


def dense_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], x.shape[1]))
    values, turn = values[::-1], turn[:, ::-1]
    return ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ turn / np.sqrt(values), values / values.sum()


def compare_whitening(rows, vectors, ids):
    deviation, white, share = dense_whitening(vectors)
    k = min(8, len(vectors[0]))
    assert len(rows) == len(ids) * k and {r["component"] for r in rows} == set(range(1, k + 1))
    assert {r["n"] for r in rows} == {len(ids)} and max(r["identity_error"] for r in rows) < 1e-10
    place = {i: at for at, i in enumerate(ids)}
    for c in range(k):
        own = {r["vec_id"]: r for r in rows if r["component"] == c + 1}
        got = np.array([own[i]["whitened"] for i in ids])
        sign = np.sign(got @ white[:, c])
        assert np.abs(got * sign - white[:, c]).max() < 1e-9
        assert all(abs(r["explained"] / share[c] - 1) < 1e-9 and r["deviation"] == deviation[place[i]] for i, r in own.items())


def test_whitening_query_equals_a_dense_decomposition(spark):
    rows = load_all()[0]["op11_embedding_whitening"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare_whitening(rows, [r["embedding"] for r in table], [r["vec_id"] for r in table])


def test_whitening_drops_unusable_vectors(spark):
    chance = np.random.default_rng(1)
    good = [[float(v) for v in chance.normal(size=3)] for _ in range(40)]
    inf, nan = float("inf"), float("nan")
    bad = [None, [1.0, None, 2.0], [nan, 1.0, 2.0], [1.0, inf, 2.0], [-inf, 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(i, v, i, "x") for i, v in enumerate(good)] + [(100 + i, v, 0, None) for i, v in enumerate(bad)]
    schema = "vec_id long, embedding array<double>, whitened long, n string"
    table = spark.createDataFrame(rows, schema).repartition(3)
    compare_whitening(whitening.whiten(table).collect(), good, list(range(40)))
    assert whitening.whiten(table.filter("vec_id >= 100 AND vec_id < 106")).collect() == []
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.filter("vec_id = 0")).collect() == []  # one vector has no variance
    same = spark.createDataFrame([(None, [1.0, 2.0])] * 5, "vec_id long, embedding array<float>")
    assert whitening.whiten(same).collect() == []
    twice = spark.createDataFrame([(1, v) for v in good[:6]] + [(None, v) for v in good[:6]], "vec_id long, embedding array<double>")
    found = whitening.whiten(twice).collect()
    assert len(found) == 36 and Counter(r["vec_id"] for r in found) == {1: 18, None: 18}
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(huge).collect() if r["vec_id"] < 2} == {None}
    many = whitening.Fit(whitening.fit_blocks(table.unionByName(table)))
    assert many.n == 80 and many.dim == 3


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, words, df = len(bags), sum(b.total() for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, b in bags:
            m = 100 - 75 + (75 * b.total() * n) // words
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t, q in own.items() if t in b)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(texts):
    cut = [(n, t and t[20:400]) for n, (_, t) in enumerate(texts)]
    return [*cut, (500, ""), (501, None), (None, "word"), (502, "WORD word"), (502, "the OF"), (503, "zzz qqq"), (504, "é É\x00the_of"), (505, "the " * 3000)]


@pytest.mark.parametrize("shard_docs,block_terms", [(1 << 14, 1 << 20), (3, 1 << 20), (40, 150)])
def test_dual_tree_ranks_as_a_full_scan_does(spark, docs, texts, items, shard_docs, block_terms):
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    found = dualtree.search(docs, asked, k=10, shard_docs=shard_docs, block_terms=block_terms)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == ranked(texts, items, 10)


def test_dual_tree_of_empty_tables(spark, docs, no_docs):
    asked = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    for left, right in ((no_docs, asked), (docs, asked.limit(0)), (docs.filter("doc_id = 104"), asked), (docs, asked.withColumn("text", F.lit("..")))):
        assert dualtree.search(left, right).collect() == []


def test_dual_tree_skips_most_pairs_and_loses_none():
    chance = random.Random(2)
    words = [[f"{lang}{k}" for k in range(300)] for lang in "abcd"]
    texts = [[chance.choice(words[n % 4][: 3 + n % 290]) for _ in range(60)] for n in range(2000)]
    vocabulary = sorted({w for own in words for w in own})
    code = {w: k for k, w in enumerate(vocabulary)}
    row = dualtree._shard(list(range(2000)), np.full(2000, 60), np.array([code[w] for t in texts for w in t]), len(code)).to_pylist()[0]
    tree = dualtree.DocTree(row, 2000, 120000)
    df = np.bincount([code[w] for t in texts for w in set(t)], minlength=len(code))
    weight = dualtree.weights(df, 2000)
    asked = [np.unique([code[w] for w in texts[7 * n]]) for n in range(100)]
    tree_of_items = dualtree.ItemTree(np.arange(100), asked, [weight[t] for t in asked], weight)
    search = dualtree.Search(tree_of_items, tree, np.zeros(100, np.int64), 10, len(code))
    search.run()
    assert search.pairs < 0.5 * 100 * tree.sizes[1]
    part = np.zeros((2000, len(code)), dtype=np.int64)
    part[tree.levels[0][0], tree.codes[0]] = tree.levels[0][1]
    for item, (docs, scores) in enumerate(search.found):
        all_scores = part[:, asked[tree_of_items.ids[item]]] @ weight[asked[tree_of_items.ids[item]]]
        assert sorted(scores.tolist())[-10:] == np.sort(all_scores)[-10:].tolist() and (all_scores[docs] == scores).all()


def expected_records(pages, least=0):
    stored = {}
    for i, _, html in pages:
        p = (html or "").encode()
        stored[p] = max(stored.get(p, (-math.inf, None)), (-math.inf if i is None else i, i), key=lambda x: x[0])
    out, seen = [], set()
    for i, _, html in pages:
        p = (html or "").encode()
        kept = stored[p][1]
        response = len(p) < least or (i == kept and p not in seen)
        seen |= {p} if i == kept else set()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "response" if response else "revisit", None if response else kept))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    chance = random.Random(4)
    bodies = [f"<html><body><h1>Page {n}</h1>" + "<p>some common markup</p>" * chance.randint(1, 40) + "é</body></html>" for n in range(60)]
    rows = [(n, f"http://host/{n}", bodies[n % 40]) for n in range(90)]
    rows += [(1000 + n, "http://copies/", "one payload of many pages") for n in range(200)]
    return rows + [(500, None, None), (501, "", ""), (502, "a b\r\nX-Page-ID: 9", "x\r\n\r\ny"), (503, "u", "z" * 300_000), (None, "n", "null id"), (None, "n", "null id"), (7, "again", bodies[7]), (87, "again", bodies[7]), (87, "again", bodies[7])]


@pytest.mark.parametrize("least,archive_bytes", [(0, 1 << 28), (30, 3000)])
def test_archives_give_back_every_page(spark, pages, tmp_path, monkeypatch, least, archive_bytes):
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, rows int").repartition(4)
    lines = warc.write(table, str(tmp_path / "w"), least_bytes=least, archive_bytes=archive_bytes, date="2020-01-01T00:00:00Z")
    found = warc.read(spark, str(tmp_path / "w"), lines, payloads=True).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], key=str) == expected_records(pages, least)
    bodies = Counter((r["page_id"], bytes(r["payload"])) for r in found if r["record_type"] == "response")
    assert bodies.keys() <= {(i, (h or "").encode()) for i, _, h in pages} and len(bodies) >= 40
    assert {r["url"] for r in found if r["page_id"] in (500, 502)} == {"urn:page:500", "a%20b%0D%0AX-Page-ID:%209"}
    # One record from its place alone, and the ids that revisits name.
    names, told = {}, set()
    for line in lines.collect():
        record = warc.fetch(str(tmp_path / "w"), line["archive"], line["offset"])
        fields, _, _ = warc.parsed(record)
        assert fields["WARC-Type"] == line["record_type"] and fields.get("X-Page-ID") == (None if line["page_id"] is None else str(line["page_id"]))
        names[fields["WARC-Record-ID"]] = line["record_type"]
        told |= {fields["WARC-Refers-To"]} if "WARC-Refers-To" in fields else set()
    assert len(names) == len(pages) and all(names[t] == "response" for t in told)


def test_archive_is_a_dictionary_frame_and_one_frame_per_record(spark, pages, tmp_path):
    import zstandard

    table = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    lines = warc.write(table, str(tmp_path / "w"))
    for archive in {r["archive"] for r in lines.collect()}:
        blob = (tmp_path / "w" / archive).read_bytes()
        assert blob[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(blob[4:8], "little")
        content = zstandard.ZstdDecompressor().decompress(blob[8 : 8 + size])
        own = lines.filter(F.col("archive") == archive).orderBy("offset").collect()
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        for line in own:
            assert reader.decompress(blob[line["offset"] : line["offset"] + line["length"]]).startswith(b"WARC/1.1\r\n")
        assert own[-1]["offset"] + own[-1]["length"] == len(blob)
        with pytest.raises(ValueError):
            list(warc._frames(io.BytesIO(blob[:-3])))


def test_lost_and_foreign_records_are_noticed(spark, pages, tmp_path):
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    lines = warc.write(table, str(tmp_path / "w"))
    with pytest.raises(Exception, match="records, not"):
        warc.read(spark, str(tmp_path / "w"), lines.filter("page_id <> 3")).collect()
    none = warc.write(table.limit(0), str(tmp_path / "none"))
    assert none.collect() == [] and warc.read(spark, str(tmp_path / "none"), none).collect() == []


def test_archive_query_gives_every_page(spark):
    found = load_all()[0]["op13_warc_archives"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, found), key=str) == expected_records(list(map(tuple, rows)))
