"""Cascades, routers and fusion of two systems under a budget of calls.

A row has the sets of a local and of another, costlier system, and the local score's signed distance to its threshold.
Policies are rows of a dimension, so all policies are evaluated in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.labels import combine
from larkspur.functions.scores import aligned
from larkspur.sources.shared import remove, shared_path

_C = F.col
FIXED = ("local_only", "other_only", "local_nonempty_else_other", "other_nonempty_else_local", "pair_agreement", "aspect_agreement_local_sentiment", "aspect_agreement_other_sentiment", "union_pairs")
SYMMETRIC = ("score_abs_replace", "score_abs_other_nonempty_else_local", "score_abs_agreement_other_sentiment", "score_below_rescue", "score_above_confirm")
ASYMMETRIC = ("confirm", "veto")
MARGIN = ("sentiment_margin_replace", "sentiment_margin_confirm")
# The registered bands of score distances and of sentiment margins.
BANDS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3)
MARGIN_BANDS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
#: What a policy may choose: one of the sets, none, or both of them met or joined.
OPTIONS = ("local", "other", "none", "both", "any")


def policy_grid(scores: bool = True, margins: bool = True, bands: tuple[float, ...] = BANDS, margin_bands: tuple[float, ...] = MARGIN_BANDS) -> list[tuple[str, str, float | None, float | None]]:
    """All policies that the available features allow, in order: (name, kind, band, upper band); 229 with both."""
    made: list[tuple[str, str, float | None, float | None]] = [(p, p, None, None) for p in FIXED]
    if scores:
        made += [(f"{k}_le_{b:.2f}", k, b, None) for b in bands for k in SYMMETRIC]
        made += [(f"score_asym_rescue_le_{b:.2f}_{m}_le_{a:.2f}", f"asym_{m}", b, a) for b in bands for a in bands for m in ASYMMETRIC]
    if margins:
        made += [(f"{k}_le_{b:.2f}", k, b, None) for b in margin_bands for k in MARGIN]
    return made


def family(kind: Column) -> Column:
    made = F.when(kind.isin("local_only", "other_only"), kind).when(kind.isin(*FIXED), "prediction_combination").when(kind.like("score_abs%"), "symmetric_score_distance")
    return made.when(kind == "score_below_rescue", "below_threshold_rescue_only").when(kind == "score_above_confirm", "above_threshold_confirm_only").when(kind == "asym_confirm", "asymmetric_rescue_confirm").when(kind == "asym_veto", "asymmetric_rescue_veto").when(kind.like("sentiment_margin%"), "sentiment_margin").otherwise("other")


def _conditions() -> dict[str, Column]:
    """What policies ask of a row (has, got, distance, margin, band, above)."""
    d, band, has = _C("distance"), _C("band"), _C("has")
    return {
        "near": F.abs(d) <= band, "below": (d >= -band) & (d < 0), "above": has & (d >= 0) & (d <= band),
        "upper": has & (d >= 0) & (d <= _C("above")), "close": has & (_C("margin") <= band),
    }


def option() -> Column:
    """Which of the OPTIONS a policy (kind, band, above) chooses for a row (has, got, distance, margin)."""
    k, has, got, c = _C("kind"), _C("has"), _C("got"), _conditions()
    pick = lambda on, a, b: F.when(on, F.lit(a)).otherwise(F.lit(b))
    local, other = F.lit("local"), F.lit("other")
    rescue = F.when(c["below"], pick(got, "other", "local"))
    return (
        F.when(k == "local_only", local).when(k == "other_only", other)
        .when(k == "local_nonempty_else_other", pick(has, "local", "other")).when(k == "other_nonempty_else_local", pick(got, "other", "local"))
        .when(k == "pair_agreement", F.lit("both")).when(k == "aspect_agreement_local_sentiment", pick(has & got, "local", "none"))
        .when(k == "aspect_agreement_other_sentiment", pick(has & got, "other", "none")).when(k == "union_pairs", F.lit("any"))
        .when(k == "score_abs_replace", pick(c["near"], "other", "local")).when(k == "score_abs_other_nonempty_else_local", pick(c["near"] & got, "other", "local"))
        .when(k == "score_abs_agreement_other_sentiment", pick(c["near"] & has, "other", "local")).when(k == "score_below_rescue", pick(~has & c["below"], "other", "local"))
        .when(k == "score_above_confirm", pick(c["above"], "other", "local"))
        .when(k == "asym_confirm", rescue.when(c["upper"], other).otherwise(local)).when(k == "asym_veto", rescue.when(c["upper"], pick(got, "local", "none")).otherwise(local))
        .when(k == "sentiment_margin_replace", pick(c["close"] & got, "other", "local")).when(k == "sentiment_margin_confirm", pick(c["close"], "other", "local"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown policy: "), k)).cast("string"))
    )


def called() -> Column:
    """1 if the policy asks the other system for the row."""
    k, has, c = _C("kind"), _C("has"), _conditions()
    made = (
        F.when(k == "local_only", F.lit(False)).when(k.isin("other_only", "other_nonempty_else_local", "union_pairs"), F.lit(True))
        .when(k == "local_nonempty_else_other", ~has).when(k.isin("pair_agreement", "aspect_agreement_local_sentiment", "aspect_agreement_other_sentiment"), has)
        .when(k.isin("score_abs_replace", "score_abs_other_nonempty_else_local"), c["near"]).when(k == "score_abs_agreement_other_sentiment", has & c["near"])
        .when(k == "score_below_rescue", ~has & c["below"]).when(k == "score_above_confirm", c["above"]).when(k.isin("asym_confirm", "asym_veto"), c["below"] | c["upper"]).otherwise(c["close"])
    )
    return F.coalesce(made, F.lit(False)).cast("int")


def _sets() -> dict[str, Column]:
    local, other = _C("local"), _C("other")
    return {"local": local, "other": other, "none": F.array().cast("array<string>"), "both": F.array_intersect(local, other), "any": F.array_union(local, other)}


def choose(rows: DataFrame) -> DataFrame:
    """rows (local, other, distance, margin, kind, band, above) with chosen and called.

    distance is the local score minus its threshold. A policy asks the other system for a row (called) or keeps what is local.
    """
    held = rows.withColumns({"has": F.size("local") > 0, "got": F.size("other") > 0}).withColumns({"__o": option(), "called": called()})
    chosen = F.array_sort(F.array_distinct(_picked(_sets())))
    return held.withColumn("chosen", chosen).drop("has", "got", "__o")


def _picked(by_option: dict[str, Column]) -> Column:
    made = F.when(_C("__o") == OPTIONS[0], by_option[OPTIONS[0]])
    for o in OPTIONS[1:]:
        made = made.when(_C("__o") == o, by_option[o])
    return made


#: Of a row's chosen set against its gold set; all of them are sums.
_PARTS = ("tp", "predicted", "samples", "exact", "false_positive_rows", "false_negative_rows")


def signatures(rows: DataFrame, *by: str, bands: tuple[float, ...] = BANDS, margin_bands: tuple[float, ...] = MARGIN_BANDS) -> DataFrame:
    """rows (gold, local, other, distance, margin) summed by all that policies ask: a table that the bands bound.

    Policies see a distance's sign and the least band that it is within, a margin's least band, and which sets are empty;
    rows alike in these are treated alike by each policy, so what each option would give is summed once for all policies.
    """
    far = 1 + max(*bands, *margin_bands)
    least = lambda x, known: F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, sorted(known))), lambda b: x <= b)), F.when(x.isNotNull(), F.lit(far)))
    d = _C("distance")
    made = rows.withColumns({"has": F.size("local") > 0, "got": F.size("other") > 0, "__d": F.when(d < 0, -least(F.abs(d), bands)).otherwise(least(F.abs(d), bands)), "__m": least(_C("margin"), margin_bands)})
    # set sizes first, so that the sums are over numbers
    sizes = {f"{o}_{n}": c for o, chosen in _sets().items() for n, c in (("t", F.size(F.array_intersect("gold", chosen))), ("p", F.size(F.array_distinct(chosen))))}
    made = made.select(*by, "has", "got", _C("__d").alias("distance"), _C("__m").alias("margin"), F.size("gold").alias("gold"), *(c.alias(n) for n, c in sizes.items()))
    g, parts = _C("gold"), []
    for o in OPTIONS:
        tp, p = _C(f"{o}_t"), _C(f"{o}_p")
        each = (tp, p, F.when(g + p == 0, F.lit(0.0)).otherwise(2.0 * tp / (g + p)), ((tp == g) & (tp == p)).cast("long"), ((g == 0) & (p > 0)).cast("long"), ((g > 0) & (p == 0)).cast("long"))
        parts += [F.sum(c).alias(f"{o}_{n}") for n, c in zip(_PARTS, each)]
    return made.groupBy(*by, "has", "got", "distance", "margin").agg(F.count("*").alias("rows"), F.sum(g).alias("gold"), *parts)


def evaluate(rows: DataFrame, policies: list[tuple], *by: str) -> DataFrame:
    """(policy, kind, place[, by], rows, calls, call_rate, f1, precision, recall, ...) of every policy, from one pass over the rows."""
    bands = tuple(sorted({x for p in policies for x in p[2:] if x is not None and not p[1].startswith("sentiment_margin")})) or (0.0,)
    margins = tuple(sorted({p[2] for p in policies if p[1].startswith("sentiment_margin")})) or (0.0,)
    made = with_policies(signatures(rows, *by, bands=bands, margin_bands=margins), policies).withColumns({"__o": option(), "called": called()})
    sums = [F.sum(_picked({o: _C(f"{o}_{n}") for o in OPTIONS})).alias(n) for n in _PARTS]
    total = made.groupBy("policy", "kind", "place", *by).agg(F.sum("rows").alias("rows"), F.sum("gold").alias("gold"), F.sum(_C("called") * _C("rows")).alias("calls"), *sums)
    share = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    tp, p, g, n = _C("tp"), _C("predicted"), _C("gold"), _C("rows")
    return total.select(
        "policy", "kind", "place", *by, "rows", "calls", share(_C("calls"), n).alias("call_rate"), share(2 * tp, p + g).alias("f1"), share(tp, p).alias("precision"), share(tp, g).alias("recall"),
        share(_C("samples"), n).alias("samples_f1"), share(_C("exact"), n).alias("exact"), share(100 * _C("false_positive_rows"), n).alias("false_positive_rows_per_100"),
        share(100 * _C("false_negative_rows"), n).alias("false_negative_rows_per_100"), share(p, n).alias("predicted_per_row"),
    )


def rounded_metrics(evaluated: DataFrame, places: int = 12) -> DataFrame:
    """Metrics to so many places, so that equal ones compare as equal however they were summed."""
    return evaluated.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in evaluated.dtypes))


def best_policies(evaluated: DataFrame, *by: str) -> DataFrame:
    """The best policy of each group: by F1, precision, fewer false positive rows, fewer calls; then the first in the grid."""
    order = [F.desc("f1"), F.desc("precision"), "false_positive_rows_per_100", "call_rate", "place"]
    n = F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order))  # as many rows as there are policies
    return evaluated.withColumn("__n", n).where("__n = 1").drop("__n")


def mean_over(evaluated: DataFrame, *by: str) -> DataFrame:
    """Policies with their metrics averaged over whatever isn't in by (held-out aspects)."""
    names = ("f1", "precision", "recall", "samples_f1", "exact", "false_positive_rows_per_100", "false_negative_rows_per_100", "call_rate", "predicted_per_row")
    return evaluated.groupBy("policy", "kind", "place", *by).agg(*(F.avg(n).alias(n) for n in names))


def with_policies(rows: DataFrame, policies: list[tuple]) -> DataFrame:
    """Every row with every policy and its place in the grid, as an explode of literals."""
    value = lambda x: F.lit(None).cast("double") if x is None else F.lit(float(x))
    cells = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(k).alias("kind"), value(b).alias("band"), value(a).alias("above"), F.lit(i).alias("place")) for i, (p, k, b, a) in enumerate(policies)))
    return rows.withColumn("__p", F.explode(cells)).select("*", "__p.*").drop("__p")


def min_max(rows: DataFrame, feature: str, name: str, *by: str) -> DataFrame:
    """rows with the feature scaled to [0, 1] over all rows of a group; 0 where it is flat. The ends are a row for each group."""
    ends = rows.groupBy(*by).agg(F.min(feature).alias("__low"), F.max(feature).alias("__high"))
    held = rows.join(ends, list(by)) if by else rows.crossJoin(F.broadcast(ends))  # one row
    return held.withColumn(name, F.when(_C("__high") == _C("__low"), F.lit(0.0)).otherwise((_C(feature) - _C("__low")) / (_C("__high") - _C("__low")))).drop("__low", "__high")


def escalate(rows: DataFrame, score: str, rate: float | Column, *by: str) -> DataFrame:
    """With escalated: the round(rate * n) rows (half to even) with the highest score; ties by descending row_uid.

    rate may be a column of `by`.
    """
    rate = F.lit(rate) if isinstance(rate, float) else rate
    at = rows.groupBy(*by, _C(score).alias("__s")).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"__c": F.sum("__n").over(upto), "__k": F.bround(rate * F.sum("__n").over(Window.partitionBy(*by)))})
    # distinct scores say how many rows of each score are in; rows are ranked only where a score is in by part
    quota = F.greatest(F.lit(0), F.least(_C("__n"), _C("__k") - (_C("__c") - _C("__n"))))
    held = rows.withColumn("__s", _C(score)).join(at.select(*by, "__s", "__n", quota.alias("__q")), [*by, "__s"])
    part = (_C("__q") > 0) & (_C("__q") < _C("__n"))
    rank = F.row_number().over(Window.partitionBy(*by, "__s").orderBy(F.desc("row_uid")))
    edge = held.where(part).withColumn("escalated", (rank <= _C("__q")).cast("int"))
    return held.where(~part).withColumn("escalated", (_C("__q") > 0).cast("int")).unionByName(edge).drop("__s", "__n", "__q")


def triggered(rows: DataFrame, features: list[str], every: bool) -> DataFrame:
    marks = [F.coalesce(F.col(f), F.lit(0.0)) > 0 for f in features]
    made = marks[0]
    for m in marks[1:]:
        made = (made & m) if every else (made | m)
    return rows.withColumn("escalated", made.cast("int"))


def cutoff(rows: DataFrame, present: int, fraction: float, *by: str) -> DataFrame:
    """(cutoff[, by]): the ceil(fraction * n)-th least distance among rows that are locally present, or absent.

    Rows are counted by distance, and distances by ranges of 1 / 4096, so that only the range with the cutoff is put in order.
    """
    at = rows.where(_C("local_present") == present).groupBy(*by, "distance").agg(F.count("*").alias("__n"))
    lower = F.floor(_C("distance") * 4096)
    coarse = at.groupBy(*by, lower.alias("__b")).agg(F.sum("__n").alias("__m"))
    w = Window.partitionBy(*by)
    upto = F.sum("__m").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    held = coarse.withColumns({"__c": upto - _C("__m"), "__k": F.ceil(F.lit(fraction) * F.sum("__m").over(w))}).where((_C("__k") > _C("__c")) & (_C("__k") <= _C("__c") + _C("__m")))
    fine = at.withColumn("__b", lower).join(held.select(*by, "__b", "__c", "__k"), [*by, "__b"])
    within = F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)) + _C("__c")
    return fine.withColumn("__u", within).where((_C("__u") >= _C("__k")) & (_C("__u") - _C("__n") < _C("__k"))).select(*by, _C("distance").alias("cutoff"))


def distance_route(rows: DataFrame, rescue: DataFrame, confirm: DataFrame, *by: str) -> DataFrame:
    """With called and chosen: rows within the cutoff for their side (ties included) take the other system's set."""
    cuts = rescue.withColumnRenamed("cutoff", "rescue").join(confirm.withColumnRenamed("cutoff", "confirm"), list(by), "full") if by else rescue.withColumnRenamed("cutoff", "rescue").crossJoin(confirm.withColumnRenamed("cutoff", "confirm"))
    held = rows.join(cuts, list(by), "left") if by else rows.crossJoin(F.broadcast(cuts))  # one row
    called = F.coalesce(_C("distance") <= F.when(_C("local_present") == 1, _C("confirm")).otherwise(_C("rescue")), F.lit(False))
    return held.withColumn("called", called.cast("int")).withColumn("chosen", F.when(called, _C("other")).otherwise(_C("local")))


def band_route(both: DataFrame, rescue: float, confirm: float) -> DataFrame:
    """Aligned rows of two systems (aspect_score, threshold, p, other_p) with routed and p_routed, by bands around 0.5."""
    s = aligned(_C("aspect_score"), _C("threshold"))
    far, present = F.abs(s - 0.5), s >= 0.5
    routed = (~present & F.lit(rescue >= 0) & (far <= rescue + 1e-15)) | (present & F.lit(confirm >= 0) & (far <= confirm + 1e-15))
    return both.withColumn("routed", routed.cast("int")).withColumn("p_routed", F.when(routed, _C("other_p")).otherwise(_C("p")))


def pareto(rows: DataFrame, quality: str, cost: str, *by: str) -> DataFrame:
    """With efficient: no other row is as good and as cheap, and better in one; equal rows are efficient together."""
    cheaper = Window.partitionBy(*by).orderBy(cost).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*by, cost)
    if dict(rows.dtypes)[cost] in ("double", "float"):
        # a range frame needs exact steps: ranks of distinct costs
        rows = rows.withColumn("__c", F.dense_rank().over(Window.partitionBy(*by).orderBy(cost)))
        cheaper = Window.partitionBy(*by).orderBy("__c").rangeBetween(Window.unboundedPreceding, -1)
    best = F.max(quality).over(cheaper)
    made = rows.withColumn("efficient", ((best.isNull() | (best < _C(quality))) & (F.max(quality).over(same) == _C(quality))).cast("int"))
    return made.drop("__c")


def best_under(rows: DataFrame, quality: str, cost: str, budgets: list[float], *by: str) -> DataFrame:
    """For each budget the best row that it allows: highest quality, then least cost, then policy name."""
    held = rows.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where(_C(cost) <= _C("budget"))
    n = F.row_number().over(Window.partitionBy("budget", *by).orderBy(F.desc(quality), cost, "policy"))
    return held.withColumn("__n", n).where("__n = 1").drop("__n")


def uncertainty(rows: DataFrame, pair: DataFrame, aspect: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Features of a row's predictions from the reliabilities (label, precision, f1) of its pairs, aspects and sentiments."""
    out = rows.select("row_uid", "pred")
    from larkspur.functions.labels import pair_aspects, pair_sentiments

    made = out.select("row_uid", F.size("pred").cast("long").alias("pred_count"), F.size(pair_aspects(_C("pred"))).cast("long").alias("aspect_count"), F.size(pair_sentiments(_C("pred"))).cast("long").alias("sentiment_count"), *(F.array_contains(pair_sentiments(_C("pred")), s).cast("int").alias(f"has_{s}") for s in ("negative", "neutral", "positive")))
    for name, get, stats in (("pair", lambda c: c, pair), ("aspect", pair_aspects, aspect), ("sentiment", pair_sentiments, sentiment)):
        low = stats.select("label", _C("precision").alias("__p"), _C("f1").alias("__f"))
        per = out.select("row_uid", F.explode(get(_C("pred"))).alias("label")).join(low, "label").groupBy("row_uid")
        per = per.agg((1 - F.min("__p")).alias(f"low_min_{name}_precision"), (1 - F.avg("__p")).alias(f"low_mean_{name}_precision"), (1 - F.min("__f")).alias(f"low_min_{name}_f1"), (1 - F.avg("__f")).alias(f"low_mean_{name}_f1"))
        made = made.join(per, "row_uid", "left").fillna(1.0, [c for c in per.columns if c != "row_uid"])
    return made


def cascade(rows: DataFrame, mode: str | Column) -> DataFrame:
    """Escalated rows combine both sets by mode; the others keep the local one."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return rows.withColumn("chosen", F.when(_C("escalated") == 1, combine(_C("local"), _C("other"), mode)).otherwise(F.array_sort("local")))


def _falling(value: Column, by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)


def _range_of(v: Column) -> Column:
    """A number that never falls as v rises, of some 140,000 at most, so that ranges of values are counted first; nulls are last."""
    near = F.signum(v) * F.floor(100 * F.log1p(F.abs(v) * (1 << 20)))
    return F.when(v.isNull(), F.lit(-1e30)).when(F.isnan(v), F.lit(1e30)).otherwise(near)


#: Rows of equal value whose row_uids are put in order at once; more are counted by ranges of row_uids first.
TIED = 10_000


def _reached(counts: DataFrame, by: str, cuts: dict[int, dict], *carry: str) -> dict[int, dict]:
    """counts (cell, by, n[, carry]): for each cell the row in which the running count, by falling `by`, comes to its `left`.

    With left, what is left of it for that row. cuts: {cell: {left, ...}}.
    """
    if not cuts:
        return {}
    left = F.element_at(F.create_map(*(F.lit(x) for i, c in cuts.items() for x in (i, c["left"]))), _C("cell"))
    held = counts.withColumns({"__c": F.sum("n").over(_falling(_C(by), ["cell"])), "left": left})
    held = held.where((_C("left") > _C("__c") - _C("n")) & (_C("left") <= _C("__c")))
    found = held.select("cell", _C(by).alias("at"), "n", (_C("left") - (_C("__c") - _C("n"))).alias("left"), *carry).collect()
    if len(found) < len(cuts):
        raise RuntimeError("counts don't add up: row_uids must be text, and rows the same when read again")
    return {r["cell"]: cuts[r["cell"]] | r.asDict() for r in found}


def _where(rows: DataFrame, on: dict[int, tuple[Column, Column]]) -> DataFrame:
    """(cell, at, row_uid): the rows of each cell's condition, with its value; on: {cell: (condition, value)}."""
    marks = F.array(*(F.when(c, F.struct(F.lit(i).alias("cell"), v.alias("at"))) for i, (c, v) in on.items()))
    return rows.select("row_uid", F.explode(F.array_compact(marks)).alias("m")).select("m.*", "row_uid")


def rank_cuts(rows: DataFrame, features: list[str], rates: list[float]) -> dict[int, dict]:
    """Where the round(rate * n) rows (half to even) of highest value end, ties by descending row_uid: {cell: cut}, one row each.

    A cell is a feature with a rate, by number. Its cut has the last value that is in (at), the row_uid down to which rows of that
    value are (uid; null: all), and how many rows of that row_uid (left; it is 1 unless row_uids repeat). Nothing in: no cut.
    Only counts are shuffled: by ranges of values, by the values of one range, by ranges of the row_uids of one value.
    """
    listed = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), _range_of(_C(f)).alias("b")) for f in features)))
    per = rows.select(listed.alias("x")).groupBy("x.feature", "x.b").agg(F.count("*").alias("n"))
    cells = [(f, r) for f in features for r in rates]
    total = {r["feature"]: r["n"] for r in per.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    # Python rounds halves to even too
    wanted = {i: min(total[f], max(0, round(r * total[f]))) for i, (f, r) in enumerate(cells) if f in total}
    cuts = {i: {"left": k} for i, k in wanted.items() if k}
    known = F.explode(F.array(*(F.struct(F.lit(i).alias("cell"), F.lit(f).alias("feature")) for i, (f, _) in enumerate(cells)))).alias("c")
    cuts = _reached(per.select("*", known).where("feature = c.feature").select("c.cell", "b", "n"), "b", cuts)
    if not cuts:
        return {}
    value = {i: _C(cells[i][0]) for i in cuts}
    ends = (F.count("*").alias("n"), F.min("row_uid").alias("low"), F.max("row_uid").alias("high"))
    cuts = _reached(_where(rows, {i: (_range_of(value[i]) == c["at"], value[i]) for i, c in cuts.items()}).groupBy("cell", "at").agg(*ends), "at", cuts, "low", "high")
    done = {i: c | {"uid": None} for i, c in cuts.items() if c["left"] == c["n"]}
    tied = {i: c | {"value": c["at"]} for i, c in cuts.items() if i not in done}
    within = lambda i, c: value[i].eqNullSafe(F.lit(c["value"]).cast("double")) & _C("row_uid").between(c["low"], c["high"])
    while many := {i: c for i, c in tied.items() if c["n"] > TIED and c["low"] != c["high"]}:
        # two bytes after what all of its row_uids begin with
        shared = {i: next((k for k, (x, y) in enumerate(zip(c["low"].encode(), c["high"].encode())) if x != y), len(c["low"].encode())) for i, c in many.items()}
        at = {i: (within(i, c), F.substring(_C("row_uid").cast("binary"), shared[i] + 1, 2)) for i, c in many.items()}
        tied |= _reached(_where(rows, at).groupBy("cell", "at").agg(*ends), "at", many, "low", "high")
    named = _where(rows, {i: (within(i, c), _C("row_uid")) for i, c in tied.items()}).groupBy("cell", "at").agg(F.count("*").alias("n")) if tied else None
    return done | {i: {"at": c["value"], "uid": c["at"], "left": c["left"]} for i, c in _reached(named, "at", tied).items()}


def cascade_grid(rows: DataFrame, features: dict[str, Column], rates: list[float], modes: list[str]) -> DataFrame:
    """(feature, rate, mode, rows, calls, tp, predicted, gold, samples, exact): every rank policy over all rows.

    Sets become their sizes, which are written once, without the sets. Where each policy's rows end comes from counts; then rows
    alike in their sizes and in which policies they are in are counted, and the policies are expanded over these counts.
    The result, a row for each policy, is at once made and small.
    """
    spark, rates, modes = rows.sparkSession, list(dict.fromkeys(map(float, rates))), list(dict.fromkeys(modes))
    sets = [F.array_sort("local"), *(combine(_C("local"), _C("other"), F.lit(m)) for m in modes)]
    counts = ["g", *(f"{n}{o}" for o in range(len(sets)) for n in "tp")]
    sizes = [F.size("gold"), *(x for c in sets for x in (F.size(F.array_intersect("gold", c)), F.size(c)))]
    values = [f"v{i}" for i in range(len(features))]
    path = shared_path(spark, "policies")
    try:
        # null row_uids are last, as the empty one is
        made = rows.select(F.coalesce("row_uid", F.lit("")).alias("row_uid"), *(c.cast("double").alias(v) for v, c in zip(values, features.values())), *(c.alias(n) for n, c in zip(counts, sizes)))
        made.write.option("compression", "zstd").parquet(path)
        found = _policy_sums(spark.read.schema(made.schema).parquet(path), dict(zip(features, values)), rates, counts)
    finally:
        remove(spark, path)
    whole = ("rows", "calls", "tp", "predicted", "gold", "samples", "exact")
    out = [(r["feature"], r["rate"], m, r["rows"], r["calls"], r[f"tp{o}"], r[f"predicted{o}"], r["gold"], r[f"samples{o}"], r[f"exact{o}"]) for r in found for o, m in enumerate(modes, 1)]
    return spark.createDataFrame(out, "feature string, rate double, mode string, " + ", ".join(f"{n} {'double' if n == 'samples' else 'long'}" for n in whole))


def _policy_sums(rows: DataFrame, features: dict[str, str], rates: list[float], counts: list[str]) -> list:
    """Rows (feature, rate, rows, calls, gold, and sums by number of mode); rows: row_uid, the features' columns and counts."""
    cuts = rank_cuts(rows, list(features.values()), rates)
    cells = [(f, v, r) for f, v in features.items() for r in rates]

    def state(i: int, v: Column) -> Column:
        """1: in, 0: not, 2: of the last row_uid that is in."""
        if i not in cuts:
            return F.lit("0")
        at, uid = F.lit(cuts[i]["at"]).cast("double"), cuts[i]["uid"]
        above = v.isNotNull() if cuts[i]["at"] is None else F.coalesce(v > at, F.lit(False))
        level = F.lit("1") if uid is None else F.when(_C("row_uid") > uid, "1").when(_C("row_uid") == uid, "2").otherwise("0")
        return F.when(above, "1").when(v.eqNullSafe(at), level).otherwise("0")

    alike = rows.groupBy(F.concat(*(state(i, _C(v)) for i, (_, v, _) in enumerate(cells))).alias("states"), *counts).agg(F.count("*").alias("n"))
    left = lambda i: F.lit(cuts[i]["left"] if i in cuts else 0).cast("long")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("cell"), F.substring("states", i + 1, 1).alias("state"), left(i).alias("left")) for i in range(len(cells))))).alias("c")
    at = alike.select(*counts, "n", each).select(*counts, "n", "c.*")
    before = F.sum("n").over(Window.partitionBy("cell").orderBy(*counts).rowsBetween(Window.unboundedPreceding, 0)) - _C("n")
    last = at.where("state = '2'").withColumn("taken", F.greatest(F.lit(0), F.least(_C("n"), _C("left") - before)))
    held = at.where("state <> '2'").withColumn("taken", F.when(_C("state") == "1", _C("n")).otherwise(0)).unionByName(last)
    g = _C("g")

    def parts(o: int) -> dict[str, Column]:
        t, p = _C(f"t{o}"), _C(f"p{o}")
        return {"tp": t, "predicted": p, "samples": F.when(g + p == 0, F.lit(0.0)).otherwise(2.0 * t / (g + p)), "exact": ((t == g) & (t == p)).cast("long")}

    n, taken, kept = _C("n"), _C("taken"), parts(0)
    sums = [F.sum(taken * c + (n - taken) * kept[k]).alias(f"{k}{o}") for o in range(1, len(counts) // 2) for k, c in parts(o).items()]
    found = held.groupBy("cell").agg(F.sum("n").alias("rows"), F.sum("taken").alias("calls"), F.sum(n * g).alias("gold"), *sums).collect()
    return [r.asDict() | {"feature": cells[r["cell"]][0], "rate": cells[r["cell"]][2]} for r in found]


def band_crossfit(both: DataFrame, bands: list[float], part: str) -> DataFrame:
    """(part, rescue, confirm, f1_chosen, tp, n, gold): for each part the bands with the best F1 on the others, and its own counts.

    Counts by part and policy are summed once; what is chosen for a part comes from the sums of the other parts.
    """
    s = aligned(_C("aspect_score"), _C("threshold"))
    far, present = F.abs(s - 0.5), s >= 0.5
    cells = F.array(*(F.struct(F.lit(r).alias("rescue"), F.lit(c).alias("confirm")) for r in bands for c in bands))
    at = both.withColumns({"far": far, "present": present, "b": F.explode(cells)})
    routed = F.when(_C("present"), (_C("b.confirm") >= 0) & (_C("far") <= _C("b.confirm") + 1e-15)).otherwise((_C("b.rescue") >= 0) & (_C("far") <= _C("b.rescue") + 1e-15))
    p = F.when(routed, _C("other_p")).otherwise(_C("p"))
    counts = at.groupBy(part, _C("b.rescue").alias("rescue"), _C("b.confirm").alias("confirm")).agg(F.sum(p * _C("target")).alias("tp"), F.sum(p).alias("n"), F.sum("target").alias("gold"))
    policy = Window.partitionBy("rescue", "confirm")
    others = {c: F.sum(c).over(policy) - _C(c) for c in ("tp", "n", "gold")}
    scored = counts.withColumn("f1_chosen", 2 * others["tp"] / (others["n"] + others["gold"]))
    best = F.row_number().over(Window.partitionBy(part).orderBy(F.desc("f1_chosen"), "rescue", "confirm"))
    return scored.withColumn("__r", best).where("__r = 1").drop("__r")


def distinct_policies(policies: list[dict]) -> list[dict]:
    """The policies without repeats, in order; equal means equal in every field."""
    import json

    return list({json.dumps(p, sort_keys=True): p for p in reversed(policies)}.values())[::-1]
