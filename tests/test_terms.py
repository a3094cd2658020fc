"""Terms that are counted in Arrow against the relational ones, and the most frequent of them with ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import lexical, scorers, terms

WORDS = ["ab", "cde", "Été", "x", "straße", "longer_word", "9z", "don't", "ab", "e\u0301a", "x²y", "½a", "ⅷb", "ⓐb", "a\u200db", "😀ab😀", "นี่", "a‿b", "ﬁn", "İx"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    made = [(i, " ".join(rng.choice(WORDS + [f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(120)]
    made += [(200, None), (201, ""), (202, " \t\n "), (203, made[0][1]), (204, "ab\x0bcd  ab\tcd")]
    return spark.createDataFrame(made, "k int, text string").repartition(3)


def relational(texts, characters):
    found = lexical.char_terms(texts, "k", "text") if characters else lexical.terms(texts, "k", "text", bigrams=True, words=scorers.WORD)
    return {r["term"]: (r["df"], r["tf"]) for r in found.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).collect()}


@pytest.mark.parametrize("characters", [False, True])
@pytest.mark.parametrize("most", [None, 1, 7, 30, 45, 400])
def test_vocabulary_equals_the_relational_one(monkeypatch, texts, characters, most):
    monkeypatch.setattr(terms, "PART", 16)
    monkeypatch.setattr(terms, "SLICE_BYTES", 300)
    every = relational(texts, characters)
    chosen = sorted(every, key=lambda t: (-every[t][1], t))[:most]
    made = terms.Vocabulary(texts.select("text"), None if characters else scorers.WORD, most)
    assert {r["term"]: (r["df"], r["tf"]) for r in made.table.collect()} == {t: every[t] for t in chosen}
    assert made.total == 125 and made.size == len(chosen)
    assert all(r["idf"] == pytest.approx(math.log(126 / (1 + r["df"])) + 1) for r in made.table.collect())


@pytest.mark.parametrize("characters", [False, True])
def test_cosines_equal_the_relational_ones(spark, texts, characters):
    """Of a vocabulary as a whole and in parts."""
    space = scorers.Space(characters, 60).fit(texts.select("text"))
    items = spark.createDataFrame([("a", "ab cde w1"), ("b", "Été straße"), ("c", "nothing"), ("d", "ab ab cd")], "candidate string, text string")
    vectors = space.vectors(items, "candidate", "text")
    expected = {(r["k"], r["candidate"]): r["score"] for r in lexical.similarity(space.vectors(texts, "k", "text"), vectors, "k", "candidate").collect()}
    for most in (None, 9):
        got = {(r["k"], r["candidate"]): r["score"] for r in terms.scores(texts, "k", vectors, "candidate", space.vocabulary, most).collect()}
        assert got == pytest.approx(expected, abs=1e-12) and expected
    weights = terms.Weights.of(space.weights, space.words)
    held, named = texts.orderBy("k").select("k", terms.source(F.col("text")).alias("s")).toArrow(), items.select("candidate", terms.source(F.col("text")).alias("s")).toArrow()
    pairs = [(i, j) for i in range(held.num_rows) for j in range(named.num_rows)]
    import numpy as np

    text, candidate = (np.array(x) for x in zip(*pairs))
    made = terms.pair_cosines(weights, held.column("s").combine_chunks(), named.column("s").combine_chunks(), text, candidate)
    ids, names = held.column("k").to_pylist(), named.column("candidate").to_pylist()
    assert {(ids[i], names[j]): x for (i, j), x in zip(pairs, made) if x} == pytest.approx(expected, abs=1e-12)


def test_features_shuffle_no_texts(spark):
    """A row of a manifest was shuffled, with its text, for each cosine."""
    rows = spark.createDataFrame([(i, f"app number w{i % 7}", "app", "a", "positive", i % 2, f"c{i}") for i in range(40)], "k int, text string, candidate_text string, candidate_aspect string, candidate_sentiment string, target int, `odd.name` string")
    made = scorers.PairScorer().spaces(rows).features(rows)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["odd.name"] for r in made.collect()) == sorted(f"c{i}" for i in range(40))


def test_sparse_vectors_shuffle_no_terms(texts):
    """Each pass of latent() shuffled all terms of all texts again."""
    made = lexical.sparse_tfidf(texts, "k", "text", 25)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert not any(x in made._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Aggregate"))
    found = lexical.terms(texts, "k", "text", bigrams=True)
    every = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    chosen = sorted(every, key=lambda t: (-every[t], t))[:25]
    expected = {(r["k"], chosen.index(r["term"])): r["w"] for r in lexical.tfidf(found, lexical.idf(found, "k").where(F.col("term").isin(chosen)), "k").collect()}
    assert {(r["k"], i): v for r in made.collect() for i, v in zip(r["i"], r["v"])} == pytest.approx(expected, abs=1e-12)
