"""The label taxonomy: aspects `Parent: Child`, three sentiments in canonical order, and folds over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " | "
#: Canonical order; ties between sentiments go to the earlier one.
SENTIMENTS = ("negative", "neutral", "positive")
#: The closed taxonomy of the test tables: part types under three parents, in order.
ASPECTS = ("Grade: ECONOMY", "Grade: STANDARD", "Offer: PROMO", "Size: LARGE", "Size: MEDIUM", "Size: SMALL")
#: By aspect: definition, aliases (which are its cues), inclusion boundary, contrastive boundary.
DEFINITIONS = {
    "Grade: ECONOMY": ("Low price over finish.", ("economy", "budget", "cheap"), "Price led parts.", "Not parts of standard grade."),
    "Grade: STANDARD": ("Usual grade and finish.", ("standard", "regular"), "Parts of usual grade.", "Not parts of economy grade."),
    "Offer: PROMO": ("Sold under a promotion.", ("promo", "offer", "discount"), "Parts on offer.", "Not parts by grade."),
    "Size: LARGE": ("Large size of the part.", ("large", "big"), "Parts by size.", "Not parts of medium size."),
    "Size: MEDIUM": ("Medium size of the part.", ("medium", "mid"), "Parts by size.", "Not parts of large size."),
    "Size: SMALL": ("Small size of the part.", ("small", "little"), "Parts by size.", "Not parts of medium size."),
}
SENTIMENT_DEFINITIONS = {"negative": "Returned with a fault.", "neutral": "Neither returned nor refunded.", "positive": "Returned and refunded."}


def parent(aspect: str) -> str:
    return aspect.split(":", 1)[0].strip()


@dataclass(frozen=True)
class Fold:
    """A held-out part of the taxonomy; everything else is seen."""

    fold_id: str
    level: str
    heldout: tuple[str, ...]
    seen: tuple[str, ...]


def folds(aspects: tuple[str, ...] = ASPECTS) -> list[Fold]:
    """L1 and L2 hold out one aspect each, L3 an aspect and the next one in order (cyclic), L4 all of a parent."""
    rest = lambda held: tuple(a for a in aspects if a not in held)
    made = [Fold(f"{level}-{i + 1:02d}", level, (a,), rest((a,))) for level in ("L1", "L2") for i, a in enumerate(aspects)]
    pairs = [(a, aspects[(i + 1) % len(aspects)]) for i, a in enumerate(aspects)]
    made += [Fold(f"L3-{i + 1:02d}", "L3", p, rest(p)) for i, p in enumerate(pairs)]
    groups = [tuple(a for a in aspects if parent(a) == p) for p in dict.fromkeys(map(parent, aspects))]
    return made + [Fold(f"L4-{i + 1:02d}", "L4", g, rest(g)) for i, g in enumerate(groups)]


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def candidates(aspects: tuple[str, ...] = ASPECTS, sentiments: tuple[str, ...] = SENTIMENTS) -> Column:
    """All candidate pairs as one array of (aspect, sentiment, ord), to explode beside each review."""
    return F.array(*(F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sentiment"), F.lit(SENTIMENTS.index(s)).alias("ord")) for a in aspects for s in sentiments))


def ordinal(sentiment: Column) -> Column:
    return F.array_position(strings(SENTIMENTS), sentiment).cast("int") - 1
