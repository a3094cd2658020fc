"""Language-model records and reports (PR32-PR36, AG22, AG32, AG49, SK8, OR8)."""

from pyspark.sql import functions as F

from larkspur.functions.text import json_body
from larkspur.operators import records as R
from larkspur.plans.adapter import reviews, table, with_views
from larkspur.plans.taxonomy import ASPECTS
from larkspur.queries.registry import query

#: Answers of several shapes, by order number: clean, wrapped, repeats, broken, empty, not an object, text after JSON, two values.
_RAW = """CASE o_orderkey % 8 WHEN 0 THEN '[{"aspect_id":"A' || (o_orderkey % 7 + 1) || '","sentiment":"positive"}]' WHEN 1 THEN '{"labels":[{"aspect":"Size: LARGE","sentiment":"' || lower(o_orderstatus) || '"}]}'
  WHEN 2 THEN '[{"aspect_id":"2","sentiment":"Neutral"},{"aspect_id":"A2","sentiment":"neutral"},{"aspect_id":"A2","sentiment":"negative"}]' WHEN 3 THEN '[{"aspect_id":' WHEN 4 THEN '[]' WHEN 5 THEN '["x",{"aspect_id":"A3: promo","sentiment":"negative"}]'
  WHEN 6 THEN '[{"aspect_id":"A1","sentiment":"positive"}] as asked' ELSE '[{"aspect_id":"A1","sentiment":"positive"}] [2]' END"""


def answers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RAW).alias("raw"), (F.col("o_orderkey") % 10 / 10).alias("seconds"), (F.col("o_orderkey") % 100).alias("input_tokens"), (F.col("o_orderkey") % 30).alias("output_tokens"), (F.col("o_totalprice") * 0).alias("cost"))


_P = f"""WITH a AS (SELECT o_orderkey, o_orderkey % 8 AS m, o_orderkey % 7 + 1 AS i, lower(o_orderstatus) AS st FROM orders), names AS (SELECT ['{"','".join(ASPECTS)}'] AS n),
p AS (SELECT o_orderkey, m, CASE m WHEN 0 THEN CASE WHEN i <= 6 THEN n[i] || ' | positive' ELSE '' END WHEN 1 THEN '' WHEN 2 THEN n[2] || ' | neutral; ' || n[2] || ' | negative' WHEN 5 THEN n[3] || ' | negative' WHEN 6 THEN n[1] || ' | positive' ELSE '' END AS labels, i FROM a, names)"""


@query(_P + """ SELECT o_orderkey, m NOT IN (3, 7) AS valid_json, m = 6 AS extracted_json, CASE WHEN m IN (3, 7) THEN NULL WHEN m = 1 THEN 'dict' ELSE 'list' END AS top_level_type, labels, (CASE m WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END)::INT AS item_count, (m = 5)::INT AS non_object_count, (m = 0 AND i > 6)::INT AS invalid_candidate_count, (m = 1)::INT AS invalid_sentiment_count,
  (m = 2)::INT AS duplicate_count, (m = 2)::INT AS conflict_count, (m = 1)::INT AS aspect_name_count, (m = 2)::INT AS numeric_id_count, (m = 5)::INT AS prefixed_id_count, (m = 4 OR (m = 0 AND i <= 6)) AS schema_valid FROM p""")
def parse_llm_json(spark, sf_dir):
    """PR32, PR33."""
    made = R.parse(answers(spark, sf_dir), "raw", ASPECTS)
    return made.select("o_orderkey", "valid_json", "extracted_json", "top_level_type", F.array_join("labels", "; ").alias("labels"), "item_count", "non_object_count", "invalid_candidate_count", "invalid_sentiment_count", "duplicate_count", "conflict_count", "aspect_name_count", "numeric_id_count", "prefixed_id_count", "schema_valid")


@query(_P + """, o AS (SELECT *, o_orderkey % 10 / 10 AS seconds FROM p) SELECT round(avg((m NOT IN (3, 7))::INT), 9) AS valid_json_rate, round(avg((m = 4 OR (m = 0 AND i <= 6))::INT), 9) AS schema_valid_rate, sum((m IN (3, 7))::INT)::BIGINT AS parse_failure_count, sum((labels = '')::INT)::BIGINT AS empty_prediction_count,
  sum((m = 0 AND i > 6)::INT)::BIGINT AS invalid_candidate_count, sum((m = 1)::INT)::BIGINT AS invalid_sentiment_count, sum((m = 2)::INT)::BIGINT AS duplicate_count, sum((m = 2)::INT)::BIGINT AS conflict_count, sum((m = 5)::INT)::BIGINT AS non_object_count, sum((m = 1)::INT)::BIGINT AS aspect_name_count,
  sum((m = 2)::INT)::BIGINT AS numeric_id_count, sum((m = 5)::INT)::BIGINT AS prefixed_id_count, sum(o_orderkey % 100)::BIGINT AS input_tokens, sum(o_orderkey % 30)::BIGINT AS output_tokens, round(avg(o_orderkey % 10 / 10.0), 9) AS mean_latency_seconds, round(quantile_cont((o_orderkey % 10 / 10.0)::DOUBLE, 0.5), 9) AS median_latency_seconds, 0.0::DOUBLE AS estimated_cost FROM p""")
def llm_diagnostics(spark, sf_dir):
    """AG22."""
    return R.diagnostics(R.parse(answers(spark, sf_dir), "raw", ASPECTS))


@query("""SELECT conv_id, turn, length(coalesce("text", '')) AS n_chars, '{"role":"' || role || '"}' AS payload FROM conversations WHERE role IS NOT NULL""")
def prompt_payload(spark, sf_dir):
    """PR35, PR36: a message's JSON."""
    made = table(spark, sf_dir, "conversations").where("role is not null")
    return made.select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.to_json(F.struct("role")).alias("payload"))


_GOLD = with_views("gold") + """SELECT row_uid, '[' || array_to_string(list_sort(list('{"aspect":"' || aspect || '","sentiment":"' || sentiment || '"}')), ',') || ']' AS gold_json FROM gold GROUP BY row_uid"""


@query(_GOLD)
def gold_json(spark, sf_dir):
    """PR35: gold answers as JSON."""
    return reviews(spark, sf_dir).where(F.size("labels") > 0).select("row_uid", R.gold_json(F.col("labels")).alias("gold_json"))


@query()
def chat_requests(spark, sf_dir):
    """PR35, PR36: whole chats with an example turn."""
    made = table(spark, sf_dir, "conversations")
    chat = R.messages("Label the review.", R.payload(F.coalesce("text", F.lit("")), ASPECTS), [("big", "[]")])
    return made.select("conv_id", "turn", F.size(chat).alias("turns"), F.xxhash64(F.to_json(chat)).alias("digest"))


@query("""WITH u AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id, k AS input_tokens, (event_id % 5)::INT AS output_tokens, (k + event_id % 5)::INT AS total_tokens, round(k * 0.15 / 1000000 + (event_id % 5) * 0.6 / 1000000, 9) AS cost FROM u""")
def token_cost(spark, sf_dir):
    """PR34: usage by several field names, and its price."""
    raw = F.when(F.col("event_id") % 2 == 0, F.format_string('{"usage":{"prompt_tokens":%s,"completion_tokens":%d}}', F.get_json_object("props", "$.k"), F.col("event_id") % 5)).otherwise(F.format_string('{"usageMetadata":{"promptTokenCount":%s,"candidatesTokenCount":%d}}', F.get_json_object("props", "$.k"), F.col("event_id") % 5))
    u = table(spark, sf_dir, "events").select("event_id", R.usage(raw).alias("u"))
    return u.select("event_id", "u.input_tokens", "u.output_tokens", "u.total_tokens", R.cost(F.col("u.input_tokens"), F.col("u.output_tokens"), 0.15, 0.6).alias("cost"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[' || conv_id || ']' WHEN turn % 3 = 1 THEN '{"a":' || conv_id || '}' END AS body FROM conversations""")
def json_recovery(spark, sf_dir):
    """PR32: JSON in fences and in prose."""
    fence = F.concat(F.lit("```json\n["), F.col("conv_id").cast("string"), F.lit("]\n```"))
    prose = F.concat(F.lit('so {"a":'), F.col("conv_id").cast("string"), F.lit("} it is"))
    raw = F.when(F.col("turn") % 3 == 0, fence).when(F.col("turn") % 3 == 1, prose).otherwise("none")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", json_body(raw)["text"].alias("body"))


@query("""WITH t AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), u AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM (SELECT k FROM t INTERSECT SELECT k FROM u)) AS kept, (SELECT count(*) FROM (SELECT k FROM t EXCEPT SELECT k FROM u)) AS dropped, (SELECT count(*) FROM (SELECT k FROM u EXCEPT SELECT k FROM t)) AS added""")
def manifest_change(spark, sf_dir):
    """AG32, ST1: what two manifests share, lose and gain."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("b"))
    on = lambda c: F.sum(c.cast("long"))
    a, b = F.col("a") == 1, F.col("b") == 1
    return l.agg(on(a & b).alias("kept"), on(a & ~b).alias("dropped"), on(~a & b).alias("added"))


_REPORT = with_views("pred_a") + """, f AS (SELECT aspect, coalesce(sum(target * p)::DOUBLE / nullif(sum(p), 0), 0) AS precision, coalesce(sum(target * p)::DOUBLE / nullif(sum(target), 0), 0) AS recall, coalesce(2.0::DOUBLE * sum(target * p) / nullif(sum(target + p), 0), 0) AS f1 FROM pred_a GROUP BY aspect)"""


@query(_REPORT + """ SELECT aspect, '| ' || aspect || ' | ' || printf('%.3f', round(precision, 9)) || ' | ' || printf('%.3f', round(recall, 9)) || ' | ' || printf('%.3f', round(f1, 9)) || ' |' AS line FROM f""")
def report_lines(spark, sf_dir):
    """SK8: a report's numbers as the lines of a Markdown table."""
    from larkspur.operators import metrics as M
    from larkspur.queries.metrics import decoded

    made = M.pooled(decoded(spark, sf_dir), "aspect")
    show = lambda c: F.format_string("%.3f", F.round(c, 9))
    return made.select("aspect", F.concat(F.lit("| "), "aspect", F.lit(" | "), show("precision"), F.lit(" | "), show("recall"), F.lit(" | "), show("f1"), F.lit(" |")).alias("line"))


@query(_REPORT + """, r AS (SELECT row_number() OVER (ORDER BY aspect) AS place, aspect AS method_id, f1 + CASE WHEN aspect = 'Offer: PROMO' THEN 1e-6 ELSE 0 END AS value, CASE WHEN aspect LIKE 'Grade%' THEN 'Independent heads' ELSE 'conditioned' END AS formulation FROM f)
SELECT method_id, unnest(list_filter([CASE WHEN method_id = 'Size: SMALL' THEN 'retired' END, CASE WHEN contains(lower(formulation), 'independent') THEN 'retired formulation' END, CASE WHEN method_id = 'Offer: PROMO' THEN 'disagrees with its source' END], lambda x: x IS NOT NULL)) AS problem FROM r
UNION ALL SELECT 'Size: TINY', 'missing'""")
def registry_check(spark, sf_dir):
    """AG49: a registry of results against its order, what is retired, and the export it comes from; here with planted faults."""
    from larkspur.operators import metrics as M
    from larkspur.operators.contracts import registry_problems
    from larkspur.plans.taxonomy import ASPECTS
    from larkspur.queries.metrics import decoded

    source = M.pooled(decoded(spark, sf_dir), "aspect").select(F.col("aspect").alias("method_id"), F.col("f1").alias("value"))
    off = F.when(F.col("method_id") == "Offer: PROMO", 1e-6).otherwise(0.0)
    at = F.array_position(F.array(*map(F.lit, sorted(ASPECTS))), F.col("method_id"))
    registry = source.select(at.alias("place"), "method_id", (F.col("value") + off).alias("value"), F.when(F.col("method_id").startswith("Grade"), "Independent heads").otherwise("conditioned").alias("formulation"))
    return registry_problems(registry, source, [*sorted(ASPECTS), "Size: TINY"], retired=["Size: SMALL"], terms=["independent"], values=[2.0])


_FORECAST = with_views("review", "aspect_dim", "sentiment_dim") + """SELECT split, count(*) * 18 AS items, round(count(*) * 18 / 26.5 / 3600, 9) AS hours, round(count(*) * 18 / 26.5 / 3600 * 1.25, 9) AS hours_with_margin, round(count(*) * 18 / 26.5 / 3600 * 1.25 * 0.4, 9) AS cost FROM review GROUP BY split"""


@query(_FORECAST)
def runtime_forecast(spark, sf_dir):
    """OR8: how long scoring every candidate of every review takes at a measured rate, with a margin and a price."""
    from larkspur.plans.taxonomy import SENTIMENTS

    counted = reviews(spark, sf_dir).groupBy("split").agg((F.count("*") * len(ASPECTS) * len(SENTIMENTS)).alias("items"))
    return R.forecast(counted, "items", per_second=26.5, margin=1.25, price=0.4)
