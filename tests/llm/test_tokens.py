import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm import packing, pieces, repair, store, tokencounts, tokens, unigram

MODEL = tokens.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tokens.Encoder(tokens.vocabulary())


def ids_of(library, text):
    ids = library.library.encode(text or "", add_special_tokens=False).ids + [0]
    return np.array(ids, dtype="<u4").tobytes()


def test_cached_ids_are_the_library_s(library, texts):
    chance = random.Random(1)
    letters = list("ab '\n\t,.é日s1_-") + [" the", "\r\n", "　", "<|endoftext|>", "n't", "𝒳", "̈"]
    many = [t for _, t in texts] + ["".join(chance.choices(letters, k=chance.randint(0, 25))) for _ in range(2000)]
    for text, ids in zip(many, library.encode(many)):
        assert ids + tokens.END == ids_of(library, text)


def test_a_full_table_changes_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 10)
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 3)
    small = tokens.Encoder(tokens.vocabulary())
    many = [t for _, t in texts] * 2
    assert list(small.encode(many)) == list(library.encode(many)) and len(small.words) == 10


def check_places(rows, capacity):
    """(sequence, offset, length) rows fill each sequence without a gap."""
    ends = defaultdict(int)
    for sequence, offset, length in sorted(rows):
        assert offset == ends[sequence] and offset + length <= capacity
        ends[sequence] += length
    return len(ends)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    chance = random.Random(seed)
    capacity = chance.choice([10, 50, 2048])
    counts = {n: chance.choice([1, 2, 3, 40, 500]) for n in chance.sample(range(1, capacity + 1), min(capacity, 30))}
    plan = packing.Plan(counts, capacity)
    lengths = np.repeat(list(counts), list(counts.values()))
    numbers = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = plan.place(lengths, numbers)
    assert check_places(zip(sequence.tolist(), offset.tolist(), lengths.tolist()), capacity) == plan.bins
    large = Counter(sequence[3 * lengths > capacity].tolist())
    assert max(large.values(), default=0) <= 2
    assert plan.bins <= 11 / 9 * lengths.sum() / capacity + len(large) + 1


def test_packing_of_documents(library, docs, no_docs, texts):
    rows = packing.packed(packing.pieces(docs, tokens.vocabulary())).collect()
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    own = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        own[r["doc_id"]].append((r["start"], r["piece"], bytes(r["ids"])))
    for doc_id, text in texts:
        if doc_id is not None and doc_id != 112:
            assert b"".join(ids for _, _, ids in sorted(own[doc_id])) == ids_of(library, text)
            assert [p for _, p, _ in sorted(own[doc_id])] == list(range(len(own[doc_id])))
            assert all(len(ids) == 4 * 2048 for _, p, ids in own[doc_id] if p)
    assert packing.packed(packing.pieces(no_docs, tokens.vocabulary())).count() == 0


def test_written_sequences_hold_the_ids(docs):
    rows = packing.packed(packing.pieces(docs, tokens.vocabulary()))
    found = packing.sequences(rows).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048 for r in found)
    assert sum(r["n_tokens"] for r in found) == sum(r["length"] for r in rows.collect())


@pytest.mark.parametrize("seed", range(10))
def test_grammar_round_trip_and_random_access(seed):
    chance = np.random.default_rng(seed)
    ids = chance.integers(0, [2, 3, 5, 200][seed % 4], int(chance.integers(0, 3000)))
    grammar = repair.compress(ids, rounds=8, rules_a_round=60, least_places=2)
    grammar = repair.Grammar.load(grammar.dump())
    assert grammar.expand(grammar.stream).tolist() == ids.tolist()
    assert not (grammar.rules == 0).any()
    assert [len(grammar.expand(np.array([grammar.first + k]))) for k in range(len(grammar.rules))] == grammar.lengths.tolist()
    for _ in range(20):
        i, j = sorted(chance.integers(0, len(ids) + 1, 2))
        assert grammar.tokens(0, len(grammar.stream), i, j).tolist() == ids[i:j].tolist()


def test_shards_written_and_read(spark, library, docs, no_docs, texts):
    path = store.new_path(spark, "shards")
    repair.write(docs, path, tokens.vocabulary(), shard_tokens=3000, parts=3)
    rows = sorted(repair.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in texts), key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    by_id = dict(texts)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["ids_crc32"] == zlib.crc32(ids_of(library, by_id[r["doc_id"]]))
    whole = np.frombuffer(ids_of(library, by_id[108]), dtype="<u4")
    assert repair.document(spark, path, 108).tolist() == whole.tolist()
    assert repair.document(spark, path, 108, 50, 70).tolist() == whole[50:70].tolist()
    with pytest.raises(KeyError):
        repair.document(spark, path, 999)
    empty = store.new_path(spark, "shards")
    repair.write(no_docs, empty, tokens.vocabulary())
    assert repair.read(spark, empty).count() == 0


def best_sum(words, text):
    best = [0]
    for end in range(1, len(text) + 1):
        ways = [best[s] + words.piece_scores[text[s:end]] for s in range(max(0, end - words.longest), end) if text[s:end] in words.piece_scores]
        if text[end - 1] not in words.piece_scores:
            ways.append(best[end - 1] + words.byte_score * len(text[end - 1].encode()))
        best.append(max(ways))
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_chunked_words_reach_the_best_sum(seed):
    words, chance = unigram.vocabulary(MODEL), random.Random(seed)
    text = " " + "".join(chance.choices(["a=", "ab c", " the in er", "é日a ", "=- "][seed % 5], k=400))
    parts = pieces.chunks(text, 33, words.longest)
    assert "".join(own for own, _, _ in parts) == text
    matrices = [pieces.transfer(words, own, ahead, k > 0 and parts[k - 1][2]) for k, (own, ahead, _) in enumerate(parts)]
    left = pieces.product(pieces.product(matrices[0], matrices[1]), matrices[2])
    assert (left == pieces.product(matrices[0], pieces.product(matrices[1], matrices[2]))).all()
    states = pieces.walk(matrices, 0, 0)
    ids = [words.encode((own + ahead[:e])[s:]) for (own, ahead, _), s, e in zip(parts, states, states[1:])]
    assert sum(int(words.scores[i].sum()) for i in ids) == best_sum(words, text) == int(words.scores[words.segment(text)].sum())
    assert "".join(map(words.decode, ids)) == text
    strings = {text[i:j] for i in range(0, 60, 7) for j in range(i + 1, 80, 3)}
    assert tokencounts.terminal_counts(words, strings) == {t: len(words.segment(t)) for t in strings}


def test_encoding_decodes_to_the_text_and_counts_agree(docs, no_docs, texts):
    for chunk in (pieces.CHUNK, 500):
        rows = pieces.decode(pieces.encode(docs, MODEL, chunk=chunk), MODEL).collect()
        own = defaultdict(list)
        for r in rows:
            assert r["decoded"] == r["text"]
            own[r["doc_id"], r["row"]].append((r["chunk"] or 0, r["text"], len(r["ids"])))
        strings = Counter((i, "".join(t for _, t, _ in sorted(v))[1:]) for (i, row), v in own.items() if row is not None)
        strings.update((i, t[1:]) for (i, row), v in own.items() if row is None for _, t, _ in v)
        assert strings == Counter((i, t or "") for i, t in texts)
        pieces_of = Counter({i: sum(n for _, _, n in v) for (i, row), v in own.items() if i not in (None, 112)})
        counted = {r["doc_id"]: r["n_tokens"] for r in tokencounts.counts(docs, MODEL).collect()}
        assert all(counted[i] == n for i, n in pieces_of.items())
    assert pieces.decode(pieces.encode(no_docs, MODEL), MODEL).count() == 0 and tokencounts.counts(no_docs, MODEL).count() == 0


def test_new_units_are_found_without_a_walk_over_the_table():
    class Unwalked(unigram._Known):
        def __iter__(self):
            raise AssertionError("the whole table is read for a few units")

    words = unigram.Vocabulary(MODEL)
    words.known = Unwalked({" known": np.array(words.segment(" known"), dtype="<u4").tobytes()})
    assert words.encode(" known unit").tolist() == words.segment(" known unit")


def test_words_are_broken_at_foreign_characters(monkeypatch):
    words, chance = unigram.Vocabulary(MODEL), random.Random(11)
    foreign = [c for c in "\n\x00\t\U0001f600ᚠ\u3000" if words.foreign.fullmatch(c)]
    letters = sorted(c for c in words.letters if c.isprintable() and c != " ")
    mixed = {" " + "".join(chance.choices(foreign + some, k=chance.randint(1, 20))) for some in (letters[:50], list("etaoinsh")) for _ in range(400)}
    alone = {w: words.segment(w) for w in mixed}
    assert len(foreign) > 2
    monkeypatch.setattr(words, "_ids", lambda *_: pytest.fail("the word is walked a character at a time"))
    assert {w: np.frombuffer(b, "<u4").tolist() for w, b in words.learn(mixed).items()} == alone
    assert pieces._lists([]).to_pylist() == []
    assert pieces._lists([np.array([], "<u4"), np.array([3, 1], "<u4")]).to_pylist() == [[], [3, 1]]


def test_lists_are_decoded_and_batches_sliced_as_rows_are(monkeypatch):
    words = unigram.Vocabulary(MODEL)
    texts = [" été 日本", "", " a\nb", " the end"]
    ids = pieces._lists(list(words.encode_all(texts)))
    assert words.decode_lists(ids).to_pylist() == texts and words.decode_lists(ids[2:]).to_pylist() == texts[2:]
    assert words.decode_lists(ids[:0]).to_pylist() == []
    broken = pieces._lists([np.array([words.byte_ids[0xC3]], "<u4"), np.array([], "<u4")])
    assert words.decode_lists(broken).to_pylist() == ["\ufffd", ""]
    monkeypatch.setattr(pieces, "CHARS_AT_ONCE", 6)
    batch = pa.record_batch({"t": ["", "abcd", "efgh", "", "x" * 40, "y"]})
    parts = [p.column(0).to_pylist() for p in pieces._slices(batch, 0)]
    assert sum(parts, []) == batch.column(0).to_pylist() and len(parts) > 2 and all(parts)
    assert list(pieces._slices(batch.slice(0, 0), 0)) == []


def test_words_of_known_letters_are_searched_by_the_library(monkeypatch):
    words = unigram.Vocabulary(MODEL)
    chance = random.Random(7)
    letters = sorted(c for c in words.letters if c.isprintable() and c != " ")
    mixed = {" " + "".join(chance.choices(some, k=chance.randint(1, 30))) for some in (letters, "etaoinsh", "a=-") for _ in range(500)}
    odd = {" line\nline", " é日▁", "   ", "\x00"} - {w for w in mixed}
    alone = {w: words.segment(w) for w in mixed | odd}
    assert {w: np.frombuffer(b, "<u4").tolist() for w, b in words.learn(mixed | odd).items()} == alone
    # A full table, and texts that are read in turns.
    monkeypatch.setattr(unigram, "MOST_WORDS", 0)
    small = unigram.Vocabulary(MODEL)
    left, right = (small.encode_all([w, w]) for w in sorted(mixed)[:2])
    assert [next(left).tolist(), next(right).tolist(), next(left).tolist()] == [alone[sorted(mixed)[k]] for k in (0, 1, 0)]
    walked = []
    monkeypatch.setattr(small, "paths", lambda some: walked.extend(some) or iter(()))
    small.learn(mixed)
    assert not walked
