"""Scalar functions over text: tokens, overlaps, rendering and JSON of model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.labels import leaf_of
from larkspur.plans.taxonomy import DEFINITIONS, SENTIMENT_DEFINITIONS


def token_sequence(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(token_sequence(text))


def content_tokens(tokens: Column, stops: Column) -> Column:
    return F.array_except(tokens, stops)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(rows: Column, candidate: Column) -> Column:
    """Share of the candidate's tokens that the row has; 0 for a candidate without tokens."""
    return F.when(F.size(candidate) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(rows, candidate)) / F.size(candidate))


def density(sequence: Column, cues: Column) -> Column:
    """Share of the tokens, repeats included, that are cues; 0 without tokens."""
    return F.when(F.size(sequence) == 0, F.lit(0.0)).otherwise(F.size(F.filter(sequence, lambda t: F.array_contains(cues, t))) / F.size(sequence))


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed: exact on ASCII; see nfkc for the rest."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


@F.arrow_udf(T.StringType())
def nfkc(text):
    """NFKC, case folding, white space collapsed: Spark has no such function. Texts of ASCII are done as one array."""
    import unicodedata

    import pyarrow as pa
    import pyarrow.compute as pc

    held = pc.fill_null(text, "")
    plain = pc.replace_substring_regex(pc.ascii_lower(held), "[\t-\r\x1c- ]+", " ")
    made = pc.ascii_trim(plain, " ")
    other = pc.match_substring_regex(held, "[^\x00-\x7f]")
    if not pc.any(other).as_py():
        return made
    slow = pa.array([" ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in held.filter(other).to_pylist()], pa.string())
    return pc.replace_with_mask(made.cast(pa.string()), other, slow)


def _by_aspect(aspect: Column, values: dict[str, str]) -> Column:
    made = F.lit(None).cast("string")
    for a, v in values.items():
        made = F.when(aspect == a, v).otherwise(made)
    return made


def definition(aspect: Column) -> Column:
    return _by_aspect(aspect, {a: d[0] for a, d in DEFINITIONS.items()})


def aliases(aspect: Column, between: str = "; ") -> Column:
    return _by_aspect(aspect, {a: between.join(d[1]) for a, d in DEFINITIONS.items()})


def boundary(aspect: Column, which: int) -> Column:
    return _by_aspect(aspect, {a: d[2 + which] for a, d in DEFINITIONS.items()})


def query_text(aspect: Column) -> Column:
    return F.lower(leaf_of(aspect))


def statement(aspect: Column, sentiment: Column, variant: str) -> Column:
    """A candidate as a statement: control, or enhanced by definition, cues and boundary."""
    if variant not in ("control", "enhanced"):
        raise ValueError(f"unknown variant of a statement: {variant}")
    # fixed values: the registered texts
    name, last = F.concat(F.lit("Aspect: "), aspect, F.lit(". ")), F.concat(F.lit("Candidate sentiment: "), sentiment, F.lit("."))
    if variant == "control":
        return F.concat(name, last)
    meant = _by_aspect(sentiment, SENTIMENT_DEFINITIONS)
    return F.concat(name, F.lit("Definition: "), definition(aspect), F.lit(" Lexical cues: "), aliases(aspect, ", "), F.lit(". Boundary: "), boundary(aspect, 1), F.lit(" "), last, F.lit(" Sentiment definition: "), meant)


def _described(aspect: Column, contrast: bool) -> Column:
    """Definition, aliases and boundaries of a rich candidate."""
    made = [F.lit("Definition: "), definition(aspect), F.lit(" Aliases: "), aliases(aspect), F.lit(". Inclusion boundary: "), boundary(aspect, 0)]
    return F.concat(*made, *([F.lit(" Contrastive boundary: "), boundary(aspect, 1)] if contrast else []))


def claim(aspect: Column, sentiment: Column, variant: Column) -> Column:
    """name_only, minimal (with definition) or rich (with aliases and both boundaries)."""
    head, last = F.concat(F.lit("Aspect: "), aspect, F.lit(". ")), F.concat(F.lit("Candidate sentiment: "), sentiment, F.lit("."))
    made = F.when(variant == "name_only", F.concat(head, last)).when(variant == "minimal", F.concat(head, F.lit("Definition: "), definition(aspect), F.lit(" "), last))
    return made.when(variant == "rich", F.concat(head, _described(aspect, True), F.lit(" "), last)).otherwise(_unknown(variant))


def aspect_candidate(aspect: Column, variant: Column) -> Column:
    """The five variants of a first-stage candidate."""
    head = F.concat(F.lit("Aspect: "), aspect, F.lit("."))
    return (
        F.when(variant == "name_only", head)
        .when(variant == "name_and_description", F.concat(head, F.lit(" Definition: "), definition(aspect)))
        .when(variant == "description_only", F.concat(F.lit("Aspect definition: "), definition(aspect)))
        .when(variant == "rich_positive", F.concat(head, F.lit(" "), _described(aspect, False)))
        .when(variant == "rich", F.concat(head, F.lit(" "), _described(aspect, True)))
        .otherwise(_unknown(variant))
    )


def sentiment_candidate(aspect: Column, sentiment: Column, variant: Column) -> Column:
    return F.concat(aspect_candidate(aspect, variant), F.lit(" Candidate sentiment: "), sentiment, F.lit("."))


def _unknown(variant: Column) -> Column:
    return F.raise_error(F.concat(F.lit("unknown representation: "), variant)).cast("string")


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value. Spark's parsers stop after the first value, so it is parsed inside of others."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    last = F.concat(F.lit('{"value":'), text, F.lit(',"end":1}'))
    keys = F.json_object_keys(last)
    return F.coalesce(alone & (F.size(keys) == 2) & (F.get(keys, 1) == "end") & F.call_function("try_parse_json", text).isNotNull(), F.lit(False))


def json_body(raw: Column) -> Column:
    """The JSON in a model's answer, as a struct: text (null if there is none) and strict (nothing but code fences around it).

    Otherwise it is the first array or object, up to the last bracket of its kind.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    whole = strip(raw)
    opened = strip(F.regexp_replace(whole, r"(?i)^```(?:json)?", ""))
    bare = F.when(whole.startswith("```"), strip(F.regexp_replace(opened, r"```$", ""))).otherwise(whole)
    array, object_ = F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    first = F.when((array != "") & ((object_ == "") | (F.instr(bare, "[") < F.instr(bare, "{"))), array).otherwise(object_)
    strict = is_json(bare)
    return F.struct(F.when(strict, bare).when(is_json(first), first).alias("text"), strict.alias("strict"))
