"""Splits, masking, leakage checks and summaries of review frames (row_uid, split, labels, and facts where named)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.labels import format_pair, has_any_aspect, keep_aspects, pairs
from larkspur.plans.adapter import hash_bucket
from larkspur.plans.taxonomy import ASPECTS, Fold

_C = F.col


def org_split(rows: DataFrame, validation: list[int], test: list[int]) -> DataFrame:
    """Rows by organisation: held-out ones are validation or test, all others train."""
    return rows.withColumn("split", F.when(_C("org").isin(validation), "validation").when(_C("org").isin(test), "test").otherwise("train"))


def label_masked(rows: DataFrame, seen, drop_empty: bool = True) -> DataFrame:
    """Labels of seen aspects only; rows without labels left are dropped, unless drop_empty is off."""
    made = rows.withColumn("labels", keep_aspects(_C("labels"), seen))
    return made.where(F.size("labels") > 0) if drop_empty else made


def example_filtered(rows: DataFrame, heldout) -> DataFrame:
    """Rows that have labels, none of them of a held-out aspect."""
    return rows.where((F.size("labels") > 0) & ~has_any_aspect(_C("labels"), heldout))


def evaluation(rows: DataFrame, heldout, containing: bool, full: bool) -> DataFrame:
    """Evaluation rows: those that contain a held-out aspect, or all; with held-out labels only, or all labels."""
    made = rows.where(has_any_aspect(_C("labels"), heldout)) if containing else rows
    return made if full else made.withColumn("labels", keep_aspects(_C("labels"), heldout))


def hash_rank(rows: DataFrame, seed: int, n: int, salt: str = "size_matched") -> DataFrame:
    """The n rows with the least SHA-256 of `seed|salt|row_uid`; ties by row_uid.

    No global sort: rows are counted by the first four hex digits, buckets below the n-th row's are whole, and only that
    one bucket is ranked. The counts (65,536 at most) are what comes to the driver.
    """
    keyed = rows.withColumn("__k", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), "row_uid"), 256))
    bucket = F.substring("__k", 1, 4)
    counts = {r["b"]: r["n"] for r in keyed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    left, last = n, None
    for b in sorted(counts):
        if counts[b] >= left:
            last = b
            break
        left -= counts[b]
    if last is None:
        return keyed.drop("__k")
    edge = keyed.where(bucket == last).withColumn("__r", F.row_number().over(Window.orderBy("__k", "row_uid"))).where(_C("__r") <= left).drop("__r")  # one bucket of many
    return keyed.where(bucket < last).unionByName(edge).drop("__k")


def size_matched(rows: DataFrame, fold: Fold, seed: int) -> DataFrame:
    """Masked rows, as many as filtering leaves, by hash order; the seeds are registered."""
    if seed not in (13, 29, 47):
        raise ValueError(f"seed {seed} isn't registered")
    n = example_filtered(rows, fold.heldout).count()
    return hash_rank(label_masked(rows, fold.seen, drop_empty=False), seed, n)


def training_rows(rows: DataFrame, fold: Fold, policy: str, seed: int = 13) -> DataFrame:
    train = rows.where("split = 'train'").select("row_uid", "split", "labels")
    if policy == "review_filtered":
        return train.where(~has_any_aspect(_C("labels"), fold.heldout))
    if policy == "label_masked_all_reviews":
        return label_masked(train, fold.seen, drop_empty=False)
    if policy == "size_matched_label_masked":
        n = train.where(~has_any_aspect(_C("labels"), fold.heldout)).count()
        return hash_rank(label_masked(train, fold.seen, drop_empty=False), seed, n)
    raise ValueError(f"unknown policy: {policy}")


def fold_splits(rows: DataFrame, folds: list[Fold]) -> DataFrame:
    """(fold_id, split, rows, kept, leaked): per fold, rows, rows that filtering keeps, and kept train rows with a held-out label (0)."""
    cells = [F.struct(F.lit(f.fold_id).alias("fold_id"), has_any_aspect(_C("labels"), f.heldout).alias("hit")) for f in folds]
    made = rows.select("split", F.size("labels").alias("n"), F.explode(F.array(*cells)).alias("f")).select("split", "n", "f.*")
    kept = (_C("split") != "train") | ((_C("n") > 0) & ~_C("hit"))
    return made.groupBy("fold_id", "split").agg(F.count("*").alias("rows"), F.sum(kept.cast("long")).alias("kept"), F.sum((kept & _C("hit") & (_C("split") == "train")).cast("long")).alias("leaked"))


def audit(rows: DataFrame, folds: list[Fold], aspects) -> DataFrame:
    """(fold_id, name, bad): named checks of all folds, with the number of rows that break each; 0 means passed."""
    labels = _C("labels")
    train = _C("split") == "train"

    def checks(f: Fold) -> dict[str, Column]:
        hit = has_any_aspect(labels, f.heldout)
        kept = train & (F.size(labels) > 0) & ~hit
        masked = keep_aspects(labels, f.seen)
        return {
            "known_split": ~F.coalesce(_C("split").isin("train", "validation", "test"), F.lit(False)),
            "labels_in_taxonomy": F.exists(labels, lambda x: ~x.aspect.isin(*aspects)),
            "no_heldout_in_filtered_train": kept & hit,
            "no_heldout_in_masked_train": train & has_any_aspect(masked, f.heldout),
            "masking_keeps_seen": train & (F.size(masked) + F.size(keep_aspects(labels, f.heldout)) != F.size(labels)),
            "evaluation_rows_whole": ~train & (F.size(labels) != F.size(F.array_distinct(labels))),
            "seen_and_heldout_apart": F.lit(bool(set(f.seen) & set(f.heldout))),
            "taxonomy_covered": F.lit(set(f.seen) | set(f.heldout) != set(aspects)),
        }

    cells = [F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(n).alias("name"), F.sum(c.cast("long")).alias("bad")) for f in folds for n, c in checks(f).items()]
    once = rows.groupBy("row_uid").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(_C("n") - 1), F.lit(0)).alias("bad")).select(F.lit("all").alias("fold_id"), F.lit("rows_once").alias("name"), "bad")
    return rows.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*").unionByName(once)


def leakage(rows: DataFrame) -> DataFrame:
    """(kind, left_split, right_split, shared): distinct rows, organisations, aspects and pairs that two splits share."""
    tag = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("value")))
    every = F.concat(tag(F.array("row_uid"), "row"), tag(F.array("org"), "org"), tag(F.transform("labels", lambda x: x.aspect), "aspect"), tag(pairs(_C("labels")), "pair"))
    seen = rows.select("split", F.explode(every).alias("v")).select("split", "v.*").where("value is not null")
    # one row for each value with the splits that have it: no self join
    sides = seen.groupBy("kind", "value").agg(F.array_sort(F.collect_set("split")).alias("s"))
    order = ["test", "train", "validation"]
    combos = F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for i, a in enumerate(order) for b in order[i + 1 :]))
    return sides.withColumn("c", F.explode(combos)).groupBy("kind", _C("c.l").alias("left_split"), _C("c.r").alias("right_split")).agg(F.sum((F.array_contains("s", _C("c.l")) & F.array_contains("s", _C("c.r"))).cast("long")).alias("shared"))


def duplicates_of_training(train: DataFrame, rows: DataFrame, text: str = "normal") -> DataFrame:
    """rows with the training multiplicity of their normalised text; empty text is never a duplicate."""
    counts = train.where(F.col(text) != "").groupBy(text).agg(F.count("*").alias("train_copies"))
    return rows.join(counts, text, "left").withColumn("train_copies", F.coalesce("train_copies", F.lit(0).cast("long"))).withColumn("is_duplicate", _C("train_copies") > 0)


def split_summary(rows: DataFrame) -> DataFrame:
    exploded = rows.select("split", "row_uid", "org", F.explode_outer("labels").alias("l"))
    labels = exploded.groupBy("split").agg(F.count_distinct("l.aspect").alias("aspects"), F.count_distinct(F.concat("l.aspect", F.lit(" | "), "l.sentiment")).alias("pairs"))
    facts = rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("org").alias("orgs"), F.sum(F.size("labels")).alias("labels"), F.sum((F.size("labels") == 0).cast("long")).alias("empty_rows"))
    return facts.join(labels, "split")


def org_summary(rows: DataFrame) -> DataFrame:
    facts = rows.groupBy("org").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("industry")), "; ").alias("industries"), F.array_join(F.array_sort(F.collect_set("data_source")), "; ").alias("sources"))
    labels = rows.select("org", F.explode("labels").alias("l")).groupBy("org").agg(F.count_distinct("l.aspect").alias("aspects"), F.count("*").alias("labels"))
    return facts.join(labels, "org", "left")


def aspect_summary(rows: DataFrame) -> DataFrame:
    made = rows.select("row_uid", "org", F.explode("labels").alias("l")).select("row_uid", "org", "l.*")
    on = lambda s: F.sum((_C("sentiment") == s).cast("long")).alias(s)
    return made.groupBy("aspect").agg(F.count_distinct("row_uid").alias("rows"), F.count_distinct("org").alias("orgs"), F.count("*").alias("labels"), on("negative"), on("neutral"), on("positive"))


def org_split_search(rows: DataFrame, least: int, top: int) -> DataFrame:
    """Pairs of eligible organisations to hold out for test, ranked by how many aspects they cover, then by fewest rows."""
    org = rows.where("org is not null").groupBy("org").agg(F.count("*").alias("rows"), F.array_distinct(F.flatten(F.collect_set(F.transform("labels", lambda x: x.aspect)))).alias("aspects")).where(_C("rows") >= least)
    left = org.select(_C("org").alias("a"), _C("rows").alias("ra"), _C("aspects").alias("xa"))
    right = org.select(_C("org").alias("b"), _C("rows").alias("rb"), _C("aspects").alias("xb"))
    made = left.join(right, _C("a") < _C("b"))  # organisations, not rows
    return made.select("a", "b", (_C("ra") + _C("rb")).alias("rows"), F.size(F.array_union("xa", "xb")).alias("aspects")).orderBy(F.desc("aspects"), "rows", "a", "b").limit(top)


def aspect_combinations(rows: DataFrame, size: int = 3, top: int = 10) -> DataFrame:
    """Combinations of aspects by how many reviews have any of them; combinations are literals, so one pass suffices."""
    from itertools import combinations

    cells = F.array(*(F.struct(F.lit(" + ".join(c)).alias("combo"), F.array(*map(F.lit, c)).alias("xs")) for c in combinations(ASPECTS, size)))
    held = rows.select(F.array_distinct(F.transform("labels", lambda x: x.aspect)).alias("has"), F.explode(cells).alias("c"))
    return held.groupBy(_C("c.combo").alias("combo")).agg(F.sum(F.arrays_overlap("has", "c.xs").cast("long")).alias("rows"), F.sum(F.size(F.array_intersect("has", "c.xs"))).alias("labels")).orderBy(F.desc("rows"), "combo").limit(top)


def label_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", F.size("labels").cast("long").alias("labels_per_row")).agg(F.count("*").alias("rows"))


def top_pairs(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.select(F.explode("labels").alias("l")).groupBy(format_pair(_C("l.aspect"), _C("l.sentiment")).alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(n)


def partition_of(uid: Column, n: int) -> Column:
    """Cross-fit fold, shard or review block: the review's hash bucket, so that a review is never split."""
    return hash_bucket(uid, n)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (k * count) of each class, and its square root."""
    at = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return at.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * _C("n"))).withColumn("sqrt_weight", F.sqrt("weight"))  # one row for each class


def manifest(rows: DataFrame) -> DataFrame:
    """(split, rows, uids_sha256, shared_rows): what a split holds, whatever the order of its rows, and how many rows splits share.

    The digest is over a split's sorted uids, which are gathered: a manifest lists them. For larger splits take contracts.fingerprint.
    """
    shared = rows.groupBy("row_uid").agg(F.count_distinct("split").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("shared_rows"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("row_uid")), "\n"), 256)
    return rows.groupBy("split").agg(F.count("*").alias("rows"), digest.alias("uids_sha256")).crossJoin(F.broadcast(shared))  # one row
