"""Scalar functions over pair labels: text `aspect | sentiment`, or structs (aspect, sentiment)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.plans.taxonomy import SENTIMENTS, SEPARATOR, strings

_PAIR = r"^(?s)(.*) \| (.*)$"


def parse_labels_json(c: Column) -> Column:
    """`[["aspect", "sentiment"], ...]` as an array of structs; null or malformed text is empty."""
    parsed = F.from_json(c, "array<array<string>>")
    made = F.transform(parsed, lambda x: F.struct(F.element_at(x, 1).alias("aspect"), F.element_at(x, 2).alias("sentiment")))
    return F.coalesce(made, F.array().cast("array<struct<aspect:string,sentiment:string>>"))


def parse_label_codes(c: Column) -> Column:
    """`['a', 'b']` as an array of strings; null or malformed text is empty."""
    return F.coalesce(F.from_json(c, "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def format_pair(aspect: Column, sentiment: Column) -> Column:
    return F.concat(aspect, F.lit(SEPARATOR), sentiment)


def pairs(labels: Column) -> Column:
    return F.transform(labels, lambda x: format_pair(x.aspect, x.sentiment))


def aspects(labels: Column) -> Column:
    """Sorted distinct aspects of an array of structs."""
    return F.array_sort(F.array_distinct(F.transform(labels, lambda x: x.aspect)))


def split_first(pair: Column) -> tuple[Column, Column]:
    """(aspect, sentiment) at the first separator; no separator: all is aspect, and the sentiment is null."""
    parts = F.split(pair, r" \| ", 2)
    return parts[0], F.get(parts, F.lit(1))


def split_last(pair: Column) -> tuple[Column, Column]:
    """(aspect, sentiment) at the last separator; null without one."""
    some = F.instr(pair, SEPARATOR) > 0
    return F.when(some, F.regexp_extract(pair, _PAIR, 1)), F.when(some, F.regexp_extract(pair, _PAIR, 2))


def split_strict(pair: Column) -> tuple[Column, Column]:
    """As split_last, but a label without a separator, or with an unknown sentiment, is an error."""
    aspect, sentiment = split_last(pair)
    good = sentiment.isin(*SENTIMENTS)
    fail = F.raise_error(F.concat(F.lit("malformed pair label: "), F.coalesce(pair, F.lit("null")))).cast("string")
    return F.when(good, aspect).otherwise(fail), F.when(good, sentiment).otherwise(fail)


def pair_aspects(labels: Column) -> Column:
    """Sorted distinct aspects of an array of pair texts."""
    return F.array_sort(F.array_distinct(F.transform(labels, lambda p: split_first(p)[0])))


def pair_sentiments(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(labels, lambda p: split_first(p)[1])))


def sentiments_of(labels: Column, aspect: Column) -> Column:
    """Sorted sentiments that an array of structs has for an aspect."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(labels, lambda x: x.aspect == aspect), lambda x: x.sentiment)))


def multi_hot(labels: Column, classes) -> Column:
    return F.transform(strings(classes), lambda c: F.array_contains(labels, c).cast("int"))


def parent_of(aspect: Column) -> Column:
    return F.trim(F.split(aspect, ":", 2)[0])


def leaf_of(aspect: Column) -> Column:
    return F.trim(F.element_at(F.split(aspect, ":"), -1))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def has_any_aspect(labels: Column, held) -> Column:
    return F.exists(labels, lambda x: x.aspect.isin(*held))


def keep_aspects(labels: Column, kept) -> Column:
    return F.filter(labels, lambda x: x.aspect.isin(*kept))


def row_key(uid: Column, split: Column, row_id: Column) -> Column:
    """uid, or `split:id` where it is null or empty."""
    return F.coalesce(F.nullif(uid, F.lit("")), F.concat_ws(":", F.coalesce(split, F.lit("")), F.coalesce(row_id.cast("string"), F.lit(""))))


def combine(local: Column, other: Column, mode: Column) -> Column:
    """Two prediction sets by mode: replace, nonempty_else_local, union, intersection, agreement_or_other, agreement_or_local."""
    both = F.array_intersect(local, other)
    chosen = (
        F.when(mode == "replace", other)
        .when(mode == "nonempty_else_local", F.when(F.size(other) > 0, other).otherwise(local))
        .when(mode == "union", F.array_union(local, other))
        .when(mode == "intersection", both)
        .when(mode == "agreement_or_other", F.when(F.size(both) > 0, both).otherwise(other))
        .when(mode == "agreement_or_local", F.when(F.size(both) > 0, both).otherwise(local))
        .otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), mode)).cast("array<string>"))
    )
    return F.array_sort(F.array_distinct(chosen))
