import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from caseflow.llm import classifier, load_all, quality, trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_counts_are_those_of_plain_python(docs, texts):
    rows = quality.judged(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == expected(r["text"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_passing_keeps_the_columns_and_the_kept_rows(docs):
    kept = quality.judged(docs).filter("kept").select(*docs.columns)
    passing = quality.passing(docs)
    assert passing.columns == docs.columns
    assert sorted(map(str, passing.collect())) == sorted(map(str, kept.collect()))


def test_a_rule_bound_decides(spark):
    df = spark.createDataFrame([(1, "the word " * 5 + "and more of it " + "x y z w v u " * 2), (2, "the $$$ " * 30)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in quality.judged(df, rules=[quality.RULES[2]]).collect()}
    assert rows[1]["ok_symbols"] and not rows[2]["ok_symbols"]


def test_empty_table(no_docs):
    assert quality.judged(no_docs).count() == 0 and quality.passing(no_docs).count() == 0


def test_trees_learn_a_rule_and_flat_walk_equals_a_recursive_one():
    chance = np.random.default_rng(1)
    rows = chance.random((3000, 4))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 2] > 0.3)).astype(float)
    forest = trees.fit(rows[:2000], labels[:2000])
    assert ((forest.score(rows[2000:]) >= 0.5) == labels[2000:]).mean() > 0.97

    def walk(node, row):
        if forest.left[node] == node:
            return forest.value[node]
        return walk(forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node], row)

    for row in rows[:20]:
        margin = forest.base + sum(walk(root, row) for root in forest.roots)
        assert abs(1 / (1 + np.exp(-margin)) - forest.score(row[None, :])[0]) < 1e-9


def test_trees_without_rows_or_with_one_class():
    assert trees.fit(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (trees.fit(np.zeros((50, 3)), np.ones(50)).score(np.zeros((2, 3))) > 0.9).all()


def test_classifier_scores_every_row(spark, docs, no_docs, texts):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (2, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    forest = classifier.train(docs, labels)
    rows = classifier.scored(docs, forest).select("doc_id", "score", "predicted").collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert classifier.scored(no_docs, forest).count() == 0
    unfitted = classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in classifier.scored(docs, unfitted).select("score").collect()} == {0.5}


def test_held_out_labels_are_not_learnt_from(spark, docs):
    ids = [r[0] for r in spark.range(40).filter(classifier.held_out(F.col("id"))).collect()]
    assert ids
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    assert len(classifier.train(docs, labels).roots) == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = load_all()[0]["op10_quality_classifier"](spark, folder).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
