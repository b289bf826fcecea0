import random

import numpy as np
import xxhash

from caseflow.llm import graph, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    """Brute force: (id, print) pairs to the smallest id of each one's component."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (own, _) in enumerate(prints):
        least[find(k)] = min([x for x in (own, least.get(find(k))) if x is not None], default=None)
    return [least[find(k)] for k in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(docs):
    for r in simhash.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["fp"] == signed(plain_fingerprint(r["text"]))


def planted(n, seed):
    chance = random.Random(seed)
    centres = [chance.getrandbits(64) for _ in range(n)]
    prints = [(k, c) for k, c in enumerate(centres)]
    for k in range(n):  # chains and clusters around some centres
        x = centres[k % 7]
        for b in chance.sample(range(64), chance.randint(0, 5)):
            x ^= 1 << b
        prints.append((n + k, x))
    return prints + [(None, centres[0]), (None, chance.getrandbits(64)), (5000, 0), (4000, 0), (4001, 1), (4001, 1)]


def test_components_equal_brute_force_whatever_the_tile_size(spark):
    prints = planted(150, 3)
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints], "doc_id long, fp long")
    expected = sorted((str(i), signed(x), str(c)) for (i, x), c in zip(prints, classes(prints, 4)))
    for tile in (4096, 8):
        rows = simhash.near_duplicates(df, tile_rows=tile).collect()
        assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in rows) == expected


def test_a_crowded_band_value_makes_few_rows_and_no_parts_with_distant_counts(spark):
    """100,000 fingerprints with one band in common, of which many share a second one."""
    chance = np.random.default_rng(5)
    fps = chance.integers(0, 1 << 52, 100_000).astype(np.uint64) << np.uint64(12)
    fps[:40_000] = (fps[:40_000] >> np.uint64(36) << np.uint64(36)) | np.uint64(0x5A5A5) << np.uint64(12)
    fps = np.unique(fps)
    groups = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    tiles = simhash._tiles(groups, 4, 4096).toPandas()
    assert len(tiles) < 30 * len(fps)  # by hash, all 25 parts of the band value would meet: 25 rows each in that band alone
    tiles["ones"] = np.bitwise_count(tiles["fp"].to_numpy().view(np.uint64))
    cut = tiles[(tiles["low"] > 0) | (tiles["high"] > 0)]
    assert len(cut)
    sizes = tiles.groupby([*simhash.TILE, "low", "high"]).size()
    assert sizes.max() < 3 * 4096
    pairs = cut[cut["low"] < cut["high"]][[*simhash.TILE, "low", "high"]].drop_duplicates()
    ones = {t: np.sort(g["ones"].to_numpy()) for t, g in tiles[tiles["sub"] >= 0].drop_duplicates([*simhash.TILE, "fp"]).groupby(simhash.TILE)}
    for *tile, low, high in pairs.itertuples(index=False):
        counts = ones[tuple(tile)]  # in ascending order, part k has the places from 4096 k on
        assert counts[4096 * high] - counts[4096 * low + 4095] <= 4


def test_tiles_lose_no_link_where_band_values_are_crowded(spark):
    chance = random.Random(11)
    centres = [chance.getrandbits(13) << 51 for _ in range(3)]
    prints = [(k, centres[k % 3] | sum(1 << b for b in chance.sample(range(51), chance.randint(0, 6)))) for k in range(300)]
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints], "doc_id long, fp long")
    expected = sorted((i, c) for (i, _), c in zip(prints, classes(prints, 4)))
    for tile in (2, 20, 100):
        assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df, tile_rows=tile).collect()) == expected


def test_a_large_cluster_in_blocks():
    chance = np.random.default_rng(2)
    fps = np.unique((chance.integers(0, 1 << 9, 400) << 20).astype(np.uint64))
    fps = np.concatenate([fps, chance.integers(0, 1 << 62, 1500).astype(np.uint64)])
    roots = simhash.linked(fps, 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    expected = np.arange(len(fps))
    while True:
        lower = np.array([expected[n].min() for n in near])
        if (lower == expected).all():
            break
        expected = lower
    assert len(set(zip(roots.tolist(), expected.tolist()))) == len(set(roots.tolist())) == len(set(expected.tolist()))


def test_one_of_each(docs, no_docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 100 not in ids and 101 not in ids and ids.count(112) == 1
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_of_each_component_where_ids_repeat_or_lack(spark, texts):
    a, b, c = (" ".join(f"{letter}{k}" for k in range(60)) for letter in "abc")
    rows = [(3, a), (5, a), (5, b), (9, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, a), (5, b), (9, c)]
    rows = [(None, a), (None, b), (0, b), (None, c), (None, c), (7, None), (7, a), (8, ""), (7, a)] + [(i, t) for i, t in texts if i is not None] * 2
    kept = simhash.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    group = dict(zip(prints, classes([(k, x) for k, x in enumerate(prints)], 4)))
    assert sorted(group[plain_fingerprint(r["text"])] for r in kept) == sorted(set(group.values()))
    least = {}
    for i, t in rows:
        g = group[plain_fingerprint(t)]
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert all(least[group[plain_fingerprint(r["text"])]] == (r["doc_id"] is None, r["doc_id"] or 0) for r in kept)
    assert {r["text"]: r["doc_id"] for r in kept if r["text"] in (b, c)} == {b: 0, c: None}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (140, 100), (100, 140), (None, 3)]
    rows = graph.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert sorted(map(tuple, rows)) == [(k, 0) for k in range(1, 31)] + [(k, 100) for k in range(101, 141)]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
