"""Sources and sinks (SC, SK): what is written in each format is read back, checked, and summed up in a few rows."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from larkspur.plans.adapter import grid, reviews, table, with_views
from larkspur.plans.taxonomy import ASPECTS
from larkspur.queries.registry import query
from larkspur.sources import bundles, readers
from larkspur.sources.shared import remove, shared_path

#: Review texts with what CSV must quote.
_TEXT = 'says "so", and\nmore'


@contextmanager
def _folder(spark, name):
    path = shared_path(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def _few(spark, frame):
    """The rows of a summary, so that the files it was made from can go."""
    return spark.createDataFrame(frame.collect(), frame.schema)


@query(with_views("review", "gold") + f"""SELECT split AS original_split, count(DISTINCT r.row_uid) AS rows, count(g.aspect) AS labels, count(DISTINCT g.aspect) AS aspects, {len(_TEXT)}::BIGINT AS text_length,
  split || ':' || min(r.row_uid) AS first_uid FROM review r LEFT JOIN gold g USING (row_uid) GROUP BY split""")
def csv_splits(spark, sf_dir):
    """SC1-SC5: splits as CSV with quotes and line ends in texts, read by name, with labels parsed from their JSON."""
    rows = reviews(spark, sf_dir)
    label = F.concat_ws(",", F.transform("labels", lambda x: F.concat(F.lit('["'), x.aspect, F.lit('", "'), x.sentiment, F.lit('"]'))))
    raw = rows.select("split", F.col("row_uid").alias("id"), *(F.lit(None).cast(k).alias(n) for n, k in (("org_index", "int"), ("data_source", "string"), ("industry", "string"))), F.lit(_TEXT).alias("text"), F.concat(F.lit("["), label, F.lit("]")).alias("labels_json"), F.lit("[]").alias("label_codes"))
    with _folder(spark, "splits") as path:
        for name in readers.SPLITS:
            raw.where(F.col("split") == name).drop("split").write.option("header", True).option("escape", '"').csv(f"{path}/{name}.csv")
        made = readers.load_splits(spark, readers.SPLITS, path)
        aspects = F.size(F.array_distinct(F.flatten(F.collect_set("aspect_labels")))).cast("long")
        return _few(spark, made.groupBy("original_split").agg(F.count("*").alias("rows"), F.sum(F.size("labels")).cast("long").alias("labels"), aspects.alias("aspects"), F.max(F.length("text")).cast("long").alias("text_length"), F.min("row_uid").alias("first_uid")))


@query("SELECT count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders")
def json_lines(spark, sf_dir):
    """SC6: JSON lines with empty lines between them."""
    with _folder(spark, "lines") as path:
        table(spark, sf_dir, "orders").select(F.concat(F.to_json(F.struct("o_orderkey")), F.lit("\n"))).write.text(path)
        return _few(spark, readers.read_jsonl(spark, path, "o_orderkey long").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys")))


@query("SELECT 2::BIGINT AS folds, 'L2' AS level")
def json_config(spark, sf_dir):
    """SC7, SK1: a JSON object, written whole or not at all, and read with a check of its kind."""
    import json

    with _folder(spark, "config") as path:
        bundles.write_text(spark, f"{path}/config.json", json.dumps({"folds": 2, "level": "L2"}))
        found = readers.object_of(bundles.read_text(spark, f"{path}/config.json"), path)
        return spark.createDataFrame([(found["folds"], found["level"])], "folds long, level string")


@query("SELECT n_name AS unit, round(avg(c_acctbal), 9) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def aggregate_csv(spark, sf_dir):
    """SC8: numbers in CSV, whose header and finiteness are checked, come back as they were."""
    made = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("unit")).agg(F.avg("c_acctbal").alias("value"))  # 25 nations
    with _folder(spark, "aggregates") as path:
        made.write.option("header", True).csv(path)
        return _few(spark, readers.read_aggregates(spark, path, "unit string, value double"))


_SCORES = with_views("grid_a") + "SELECT aspect, count(*) AS rows, round(sum(score), 6) AS total FROM grid_a WHERE split = 'validation' GROUP BY aspect"


@query(_SCORES)
def score_files(spark, sf_dir):
    """SC9: score files in gzip, whose numbers round-trip; broken ones would be an error."""
    with _folder(spark, "scores") as path:
        grid(spark, sf_dir, split="validation").select("row_uid", "aspect", "sentiment", "score").write.option("header", True).option("compression", "gzip").csv(path)
        made = readers.read_scores(spark, path, "row_uid string, aspect string, sentiment string, score double")
        return _few(spark, made.groupBy("aspect").agg(F.count("*").alias("rows"), F.round(F.sum("score"), 6).alias("total")))


@query(_SCORES)
def evidence_files(spark, sf_dir):
    """SC10: a glob of files, one for each unit, checked against the units and row counts that are expected."""
    rows = grid(spark, sf_dir, split="validation").select("aspect", "row_uid", "sentiment", "score")
    expected = rows.groupBy("aspect").agg(F.count("*").alias("rows"))
    with _folder(spark, "evidence") as path:
        for i, a in enumerate(ASPECTS):
            rows.where(F.col("aspect") == a).coalesce(1).write.option("header", True).csv(f"{path}/unit{i}")
        made = readers.read_evidence(spark, f"{path}/unit*", "aspect string, row_uid string, sentiment string, score double", ["aspect"], expected)
        return _few(spark, made.groupBy("aspect").agg(F.count("*").alias("rows"), F.round(F.sum("score"), 6).alias("total")))


@query(with_views("grid_a") + """SELECT (('0x' || substr(sha256(row_uid), 1, 16))::UBIGINT % 8)::INT AS shard, 'complete' AS state, count(*) AS rows FROM grid_a WHERE split = 'validation' GROUP BY 1""")
def sharded_scores(spark, sf_dir):
    """SK2-SK4: scores by hash shard with a manifest, the state of each shard, and the merged rows."""
    rows = grid(spark, sf_dir, split="validation").select("row_uid", "aspect", "sentiment", "score")
    key = ["row_uid", "aspect", "sentiment"]
    with _folder(spark, "shards") as path:
        bundles.write_shards(rows, path, {"study": "s"}, 8, key, ["score"])
        merged = bundles.merge_shards(spark, path, {"study": "s"}, rows).groupBy("shard").agg(F.count("*").alias("rows"))
        return _few(spark, bundles.shard_states(spark, path, {"study": "s"}, rows).join(merged, "shard", "left"))


@query(with_views("grid_a") + "SELECT count(*) AS rows, 1::BIGINT AS bundles, TRUE AS sealed, TRUE AS receipt FROM grid_a WHERE split = 'validation'")
def sealed_bundle(spark, sf_dir):
    """SK5, SK6: a bundle with its manifest, a seal over all bundles, and a receipt of its files, all checked when read."""
    rows, contract = grid(spark, sf_dir, split="validation").select("row_uid", "aspect", "sentiment", "score"), {"study": "s"}
    with _folder(spark, "bundle") as path:
        bundles.write_bundle(rows, f"{path}/one", contract, ["row_uid", "aspect", "sentiment"], ["score"])
        bundles.seal(spark, f"{path}/seal.json", [f"{path}/one"], contract, 1)
        found = bundles.check_seal(spark, f"{path}/seal.json", contract, 1)
        bundles.write_receipt(spark, f"{path}/one", contract)
        receipt = bundles.check_receipt(spark, f"{path}/one", contract)["status"] == "complete"
        held = bundles.read_bundle(spark, f"{path}/one", contract, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), rows)
        return _few(spark, held.agg(F.count("*").alias("rows")).select("rows", F.lit(found["bundles"]).cast("long").alias("bundles"), F.lit(not found["outcomes_revealed"]).alias("sealed"), F.lit(receipt).alias("receipt")))


@query(with_views("pred_a") + """, r AS (SELECT aspect, row_uid, max(target) AS g, max(p) AS q FROM pred_a WHERE split = 'validation' GROUP BY ALL)
SELECT aspect, sum(g * q)::BIGINT AS presence_tp_rows, sum((1 - g) * q)::BIGINT AS presence_fp_rows, sum(g * (1 - q))::BIGINT AS presence_fn_rows, round(coalesce(2.0::DOUBLE * sum(g * q) / nullif(sum(g + q), 0), 0), 9) AS presence_f1 FROM r GROUP BY aspect""")
def presence_from_files(spark, sf_dir):
    """AG31: presence metrics computed anew from a file of predictions for each held-out aspect."""
    from larkspur.operators import metrics as M
    from larkspur.queries.metrics import decoded

    rows = decoded(spark, sf_dir).where("split = 'validation'")
    on = lambda c: F.collect_list(F.when(F.col(c) == 1, F.col("sentiment")))
    sets = rows.groupBy("aspect", "row_uid").agg(on("target").alias("gold"), on("p").alias("pred"))
    with _folder(spark, "predictions") as path:
        sets.write.partitionBy("aspect").json(path)
        made = readers.read_jsonl(spark, path, "row_uid string, gold array<string>, pred array<string>, aspect string")
        return _few(spark, M.presence(made, ("aspect",)).select("aspect", "presence_tp_rows", "presence_fp_rows", "presence_fn_rows", "presence_f1"))


@query("SELECT TRUE AS equal_scores, TRUE AS receipt_checked")
def model_checkpoint(spark, sf_dir):
    """SK9: a fitted model is written with a receipt, checked, read again, and scores as before."""
    from pyspark.ml.classification import LogisticRegressionModel

    from larkspur.operators.lexical import logistic
    from larkspur.sources import checkpoints

    rows = grid(spark, sf_dir, split="validation").select("target", "score", "aspect_score")
    model, score = logistic(rows, ["score", "aspect_score"], "target")
    with _folder(spark, "checkpoint") as path:
        receipt = checkpoints.save(spark, model, path, {"study": "s"})
        again = checkpoints.load(spark, LogisticRegressionModel, path, {"study": "s"})
        same = again.coefficients == model.coefficients and again.intercept == model.intercept
    return spark.createDataFrame([(bool(same), receipt["status"] == "complete")], "equal_scores boolean, receipt_checked boolean")
