import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import labels as L
from larkspur.functions import scores as S
from larkspur.functions import text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_label_lists(spark):
    rows = spark.createDataFrame([('[["a","positive"],["b","negative"]]', "['x', 'y']"), (None, None), ("junk", "junk")], "j string, c string")
    got = rows.select(L.parse_labels_json(F.col("j")).alias("l"), L.parse_label_codes(F.col("c")).alias("c")).collect()
    assert [[tuple(x) for x in r["l"]] for r in got] == [[("a", "positive"), ("b", "negative")], [], []]
    assert [r["c"] for r in got] == [["x", "y"], [], []]


def test_pairs(spark):
    rows = spark.createDataFrame([("a | b | positive",), ("plain",)], "p string")
    a, s = L.split_first(F.col("p"))
    b, t = L.split_last(F.col("p"))
    assert [tuple(r) for r in rows.select(a, s, b, t).collect()] == [("a", "b | positive", "a | b", "positive"), ("plain", None, None, None)]
    with pytest.raises(Exception, match="malformed pair label"):
        rows.select(L.split_strict(F.col("p"))[0]).collect()


def test_names(spark):
    c = F.lit("Online experience: App website")
    assert (one(spark, L.parent_of(c)), one(spark, L.leaf_of(c)), one(spark, L.slug(c))) == ("Online experience", "App website", "online_experience_app_website")
    assert one(spark, L.row_key(F.lit(""), F.lit("train"), F.lit(7))) == "train:7" and one(spark, L.row_key(F.lit("u"), F.lit("train"), F.lit(7))) == "u"


@pytest.mark.parametrize(
    ("mode", "expected"),
    [("replace", ["b", "c"]), ("nonempty_else_local", ["b", "c"]), ("union", ["a", "b", "c"]), ("intersection", ["b"]), ("agreement_or_other", ["b"]), ("agreement_or_local", ["b"])],
)
def test_modes(spark, mode, expected):
    arrays = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, L.combine(arrays("b", "a"), arrays("c", "b"), F.lit(mode))) == expected
    empty = {"replace": [], "nonempty_else_local": ["a"], "union": ["a"], "intersection": [], "agreement_or_other": [], "agreement_or_local": ["a"]}
    assert one(spark, L.combine(arrays("a"), arrays(), F.lit(mode))) == empty[mode]
    with pytest.raises(Exception, match="unknown mode"):
        one(spark, L.combine(arrays("a"), arrays(), F.lit("other mode")))


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_alignment_keeps_decisions(spark, threshold):
    values = [0.0, 0.1, 0.2, 0.49, 0.5, 0.8, 0.9, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.aligned(F.col("x"), F.lit(threshold)).alias("y")).collect()
    assert all((r["y"] >= 0.5) == (r["x"] >= threshold) and 0 <= r["y"] <= 1 for r in rows)
    assert [r["y"] for r in rows] == sorted(r["y"] for r in rows)


def test_scalars(spark):
    assert one(spark, S.clamp_unit(F.lit(1.5))) == 1 and one(spark, S.ratio(F.lit(1), F.lit(0), 1.0)) == 1.0
    assert one(spark, S.sigmoid(F.lit(-800.0))) == 0 and one(spark, S.sigmoid(F.lit(800.0))) == 1
    assert one(spark, S.next_up(F.lit(0.5))) == math.nextafter(0.5, 2)
    assert math.isclose(one(spark, S.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))), math.log(2))
    assert math.isclose(one(spark, S.fused(F.lit(0.2), F.lit(0.8), F.lit(0.5))), 0.5)
    for bad in ("nan", "inf", None):
        with pytest.raises(Exception, match="finite"):
            one(spark, S.finite(F.lit(bad).cast("double")))


def test_tokens_and_overlaps(spark):
    words = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, T.token_sequence(F.lit("A b-1 É b"))) == ["a", "b", "1", "b"]
    assert one(spark, T.jaccard(words(), words())) == 1.0 and one(spark, T.coverage(words("a"), words())) == 0.0
    assert one(spark, T.density(words("a", "a", "b"), words("a"))) == pytest.approx(2 / 3)
    assert one(spark, T.nfkc(F.lit(" Ａ\tß  x "))) == "a ss x" and one(spark, T.normalised(F.lit(" SAME\tText "))) == "same text"


def test_nfkc_equals_python(spark):
    import random
    import unicodedata

    rng = random.Random(2)
    parts = ["A", "b", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\u00a0", "\u2003", "ß", "Ａ", "é", "e\u0301", "ﬁ", "İ", "Σ", "0"]
    texts = ["".join(rng.choice(parts if i % 2 else parts[:11]) for _ in range(rng.randrange(12))) for i in range(400)] + [None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.nfkc("t").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split()) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("raw", "text", "strict"),
    [
        ("```json\n[1]\n```", "[1]", True), ("```JSON [1]```", "[1]", True), ("[1]", "[1]", True), (' {"a": [1, {"b": "]"}]} ', '{"a": [1, {"b": "]"}]}', True), ("3", "3", True), ("null", "null", True),
        ('so {"a":1} it', '{"a":1}', False), ("so [1] and {2}", "[1]", False), ("[1] and more", "[1]", False), ('{"a":1} [2]', '{"a":1}', False),
        ("nothing", None, False), ("[1] [2]", None, False), ("[1],[2]", None, False), ("1],[2", None, False), ('1,"end":1} {', None, False), ('1,"x":2', None, False), ("[1", None, False), ("", None, False),
    ],
)
def test_json_recovery(spark, raw, text, strict):
    found = one(spark, T.json_body(F.lit(raw)))
    assert (found["text"], found["strict"]) == (text, strict)


def test_registered_texts(spark):
    a, s = F.lit("Offer: PROMO"), F.lit("positive")
    assert one(spark, T.statement(a, s, "control")) == "Aspect: Offer: PROMO. Candidate sentiment: positive."
    assert one(spark, T.statement(a, s, "enhanced")) == (
        "Aspect: Offer: PROMO. Definition: Sold under a promotion. Lexical cues: promo, offer, discount. Boundary: Not parts by grade. Candidate sentiment: positive. Sentiment definition: Returned and refunded."
    )
    rich = "Definition: Sold under a promotion. Aliases: promo; offer; discount. Inclusion boundary: Parts on offer."
    claims = {
        "name_only": "Aspect: Offer: PROMO. Candidate sentiment: positive.", "minimal": "Aspect: Offer: PROMO. Definition: Sold under a promotion. Candidate sentiment: positive.",
        "rich": f"Aspect: Offer: PROMO. {rich} Contrastive boundary: Not parts by grade. Candidate sentiment: positive.",
    }
    for v, text in claims.items():
        assert one(spark, T.claim(a, s, F.lit(v))) == text
    stages = {
        "name_only": "Aspect: Offer: PROMO.", "name_and_description": "Aspect: Offer: PROMO. Definition: Sold under a promotion.", "description_only": "Aspect definition: Sold under a promotion.",
        "rich_positive": f"Aspect: Offer: PROMO. {rich}", "rich": f"Aspect: Offer: PROMO. {rich} Contrastive boundary: Not parts by grade.",
    }
    for v, text in stages.items():
        assert one(spark, T.aspect_candidate(a, F.lit(v))) == text
        assert one(spark, T.sentiment_candidate(a, s, F.lit(v))) == f"{text} Candidate sentiment: positive."
    for bad in (T.claim(a, s, F.lit("other")), T.aspect_candidate(a, F.lit("name_and_aliases"))):
        with pytest.raises(Exception, match="unknown representation"):
            one(spark, bad)
    with pytest.raises(ValueError, match="unknown variant"):
        T.statement(a, s, "rich")
