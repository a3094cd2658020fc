import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from larkspur.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(pieces, word, p):
    """The sum over all segmentations, by recursion."""
    known = {x: i for i, x in enumerate(pieces.pieces)}

    def rest(at):
        if at == len(word):
            return 1.0
        total = 0.0
        for end in range(at + 1, min(len(word), at + pieces.longest) + 1):
            i = known.get(word[at:end], -1 if end == at + 1 else None)
            if i is not None:
                total += p[i, 0] * rest(end)
        return total

    return rest(0)


def test_forward_equals_all_segmentations():
    pieces = langid.Pieces.of(PATH)
    p = np.random.default_rng(0).uniform(0.01, 1, (len(pieces.pieces) + 1, 1))
    words = ["a", "the", "nation", "über", "streets", "xylophone", "ßü", "漢字", "q" * 12, "thequicknation"]
    got = langid.word_scores(pieces, words, p)[:, 0]
    assert np.allclose(got, [np.log(brute(pieces, langid.MARK + w, p)) for w in words])


def test_expected_counts_sum_to_the_words():
    pieces = langid.Pieces.of(PATH)
    p = np.random.default_rng(0).uniform(0.01, 1, (len(pieces.pieces) + 1, 1))
    words, n = ["nation", "the"], np.array([2.0, 3.0])
    out = langid.expected(pieces, words, n, p)
    letters = sum(len(x) * c for x, c in zip(pieces.pieces, out)) + out[-1]
    assert np.isclose(letters, 2 * len("▁nation") + 3 * len("▁the"))  # each segmentation covers its word


def test_words_are_whole():
    offsets, words, codes = langid.words_of(pa.array(["Ab, cd!Ab", "", "x" * 70, "12 34"]))
    assert offsets.tolist() == [0, 3, 3, 4, 4]
    assert [words[c] for c in codes] == ["ab", "cd", "ab", "x" * 70]


def test_long_words_by_logarithms(monkeypatch):
    """Where products don't vanish yet, logarithms give the same sums and expected counts; where they do, sums are finite."""
    pieces = langid.Pieces.of(PATH)
    p = np.random.default_rng(0).uniform(0.01, 1, (len(pieces.pieces) + 1, 1))
    words, n = ["nation", "streets", "xylophone", "漢字q"], np.array([2.0, 3.0, 1.0, 1.0])
    plain = langid.word_scores(pieces, words, p), langid.expected(pieces, words, n, p)
    monkeypatch.setattr(langid, "LONGEST", 2)
    assert np.allclose(langid.word_scores(pieces, words, p), plain[0]) and np.allclose(langid.expected(pieces, words, n, p), plain[1])
    two = np.stack([np.full(len(p), 1e-5), np.full(len(p), 2e-5)], axis=1)
    found = langid.word_scores(pieces, ["nation" * 400], two)[0]
    assert np.isfinite(found).all() and found[1] > found[0]


def test_predictions_equal_brute_force(spark):
    """Expectation, maximisation, segmentations and posteriors, all by recursion over every way to cut a word."""
    texts = {"aa": ["the cat sat", "a cat, the hat", "ten hats at tea"], "bb": ["der hut ist da", "das ist der tee", "die katze der tee"]}
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    rows = [(learnt[3 * k + j], t, lang) for k, (lang, own) in enumerate(texts.items()) for j, t in enumerate(own)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 0][:4]
    rows += list(zip(held, ["the hut", "der cat", "tee tea", "a"], ["bb", "aa", "aa", "bb"]))
    pieces = langid.Pieces.of(PATH)
    known = {x: i for i, x in enumerate(pieces.pieces)}

    def cuts(word):
        """Every segmentation, as piece numbers (-1: a letter without a piece)."""
        if not word:
            yield ()
        for end in range(1, min(len(word), pieces.longest) + 1):
            i = known.get(word[:end], -1 if end == 1 else None)
            if i is not None:
                for rest in cuts(word[end:]):
                    yield (i, *rest)

    words = {lang: Counter(w for t in own for w in re.findall(r"[a-z]+", t)) for lang, own in texts.items()}
    every = {w: list(cuts(langid.MARK + w)) for _, t, _ in rows for w in re.findall(r"[a-z]+", t)}
    model = {}
    for lang in texts:
        p = np.full(len(known) + 1, 1 / len(known))
        p[-1] = langid.FLOOR
        for _ in range(langid.ROUNDS):
            out = np.zeros(len(known) + 1)
            for w, n in words[lang].items():
                share = np.array([np.prod(p[list(c)]) for c in every[w]])
                for c, x in zip(every[w], share / share.sum()):
                    for i in c:
                        out[i] += n * x
            p = out + langid.ADDED
            p[-1] = 0
            p = p / p.sum()
            p[-1] = langid.FLOOR
        model[lang] = p
    expected = {}
    for i, t, _ in rows:
        total = {lang: sum(np.log(sum(np.prod(p[list(c)]) for c in every[w])) for w in re.findall(r"[a-z]+", t)) for lang, p in model.items()}
        best = max(total, key=total.get)
        expected[i] = (best, 1 / sum(np.exp(x - total[best]) for x in total.values()))
    made = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()
    for r in made:
        assert r["lang_pred"] == expected[r["doc_id"]][0] and np.isclose(r["score"], expected[r["doc_id"]][1], atol=1e-9) and r["held_out"] == (r["doc_id"] in held)


def test_samples(spark):
    """Distinct ids of rows with texts, those with the least hashes, however often a row is repeated; clashing columns; a long text."""
    rows = [(i, f"text {i}" if i % 3 else None, "en") for i in range(600)] + [(7, "text 7", "en")] * 2000 + [(i, "x", "de") for i in range(1000, 1010)] + [(None, "y", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(frame, 50).collect()
    hashes = {r[0]: r[1] for r in spark.range(600).selectExpr("id", "shiftrightunsigned(xxhash64(id), 11) / 9007199254740992D").collect()}
    least = sorted((i for i in range(600) if i % 3), key=lambda i: hashes[i])[:50]
    assert {r["text"] for r in got if r["lang"] == "en"} == {f"text {i}" for i in least} and sum(r["lang"] == "de" for r in got) == 10
    odd = spark.createDataFrame([(1, "the thing of that " * 200_000, "en", 1.0, "z"), (2, "the thing", "en", 2.0, "z")], "doc_id long, text string, lang string, score double, Held_Out string")
    made = langid.identify(odd, PATH).collect()
    assert {r["lang_pred"] for r in made} == {"en"} and set(made[0].asDict()) == {"doc_id", "text", "lang", "held_out", "lang_pred", "score"}


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(100000, None, "en"), (100001, "", "en"), (100002, "123 !?", None), (None, "the thing of that", "en"), (100003, "the thing of that", None), (100003, "the thing of that", None)], "doc_id long, text string, lang string")
    made = langid.identify(docs.select("doc_id", "text", "lang").unionByName(odd), PATH).toPandas()
    assert len(made) == docs.count() + odd.count()
    known = made[(made["doc_id"] < 100000) & made["held_out"]]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.99
    by = made[made["doc_id"] >= 100000].set_index("doc_id")
    assert by.loc[100000, "lang_pred"] == by.loc[100001, "lang_pred"] == by.loc[100002, "lang_pred"] == "und" and by.loc[100000, "score"] == 0
    assert set(by.loc[100003, "lang_pred"]) == {"en"} and made[made["doc_id"].isna()]["held_out"].all()
    assert made["score"].between(0, 1).all()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, PATH).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0), PATH).count() == 0
