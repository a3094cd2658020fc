"""Scans, label parsing and formatting, text scalars (SC, PR, ST)."""

from pyspark.sql import functions as F

from larkspur.functions import labels as L
from larkspur.functions import scores as S
from larkspur.functions import text as T
from larkspur.plans.adapter import reviews, table, with_views
from larkspur.plans.taxonomy import ASPECTS, DEFINITIONS, SENTIMENT_DEFINITIONS
from larkspur.queries.registry import query


@query(with_views("review", "gold") + """
SELECT r.row_uid, split, org, industry, data_source, coalesce(array_to_string(list_sort(list(aspect || ' | ' || sentiment) FILTER (WHERE aspect IS NOT NULL)), '; '), '') AS pairs,
  coalesce(array_to_string(list_sort(list(DISTINCT aspect) FILTER (WHERE aspect IS NOT NULL)), '; '), '') AS aspects
FROM review r LEFT JOIN gold g USING (row_uid) GROUP BY r.row_uid, split, org, industry, data_source""")
def review_view(spark, sf_dir):
    """SC1-SC4, PR3: reviews with their pairs and aspects."""
    made = reviews(spark, sf_dir, facts=True)
    return made.select("row_uid", "split", "org", "industry", "data_source", F.array_join(L.pairs(F.col("labels")), "; ").alias("pairs"), F.array_join(L.aspects(F.col("labels")), "; ").alias("aspects"))


@query("""WITH j AS (SELECT o_orderkey, '[["' || o_orderpriority || '","' || o_orderstatus || '"],["x","y"]]' AS c FROM orders)
SELECT o_orderkey, len(json_extract(c, '$[*]'))::BIGINT AS n, json_extract_string(c, '$[0][0]') AS aspect, json_extract_string(c, '$[0][1]') AS sentiment FROM j""")
def labels_from_json(spark, sf_dir):
    """PR1: label lists in JSON."""
    c = F.concat(F.lit('[["'), "o_orderpriority", F.lit('","'), "o_orderstatus", F.lit('"],["x","y"]]'))
    made = table(spark, sf_dir, "orders").select("o_orderkey", L.parse_labels_json(c).alias("l"))
    return made.select("o_orderkey", F.size("l").cast("long").alias("n"), F.col("l")[0].aspect.alias("aspect"), F.col("l")[0].sentiment.alias("sentiment"))


@query("SELECT o_orderkey, 2::BIGINT AS n, o_orderstatus AS first FROM orders")
def label_codes(spark, sf_dir):
    """PR2: lists with single quotes."""
    c = F.concat(F.lit("['"), "o_orderstatus", F.lit("', 'b']"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", L.parse_label_codes(c).alias("l"))
    return made.select("o_orderkey", F.size("l").cast("long").alias("n"), F.col("l")[0].alias("first"))


_PAIR = "(p_type || ' | ' || p_brand || ' | ' || p_size)"


@query(f"SELECT p_partkey, split_part({_PAIR}, ' | ', 1) AS aspect, substr({_PAIR}, strpos({_PAIR}, ' | ') + 3) AS sentiment FROM part")
def pair_split_first(spark, sf_dir):
    """PR4."""
    pair = F.concat_ws(" | ", "p_type", "p_brand", F.col("p_size").cast("string"))
    a, s = L.split_first(pair)
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("aspect"), s.alias("sentiment"))


@query(rf"SELECT p_partkey, regexp_extract({_PAIR}, '^(.*) \| (.*)$', 1) AS aspect, regexp_extract({_PAIR}, '^(.*) \| (.*)$', 2) AS sentiment FROM part")
def pair_split_last(spark, sf_dir):
    """PR5."""
    pair = F.concat_ws(" | ", "p_type", "p_brand", F.col("p_size").cast("string"))
    a, s = L.split_last(pair)
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("aspect"), s.alias("sentiment"))


@query(with_views("gold") + "SELECT row_uid, array_to_string(list_sort(list_distinct(list(aspect))), '|') AS aspects FROM gold GROUP BY row_uid")
def pair_to_aspect_sets(spark, sf_dir):
    """PR6."""
    return reviews(spark, sf_dir).where(F.size("labels") > 0).select("row_uid", F.array_join(L.pair_aspects(L.pairs(F.col("labels"))), "|").alias("aspects"))


@query(with_views("gold") + "SELECT row_uid, aspect, array_to_string(list_sort(list(sentiment)), '|') AS sentiments, count(*) AS n FROM gold GROUP BY row_uid, aspect")
def aspect_sentiment_map(spark, sf_dir):
    """PR7."""
    made = reviews(spark, sf_dir).select("row_uid", "labels", F.explode(L.aspects(F.col("labels"))).alias("aspect"))
    s = L.sentiments_of(F.col("labels"), F.col("aspect"))
    return made.select("row_uid", "aspect", F.array_join(s, "|").alias("sentiments"), F.size(s).cast("long").alias("n"))


@query(with_views("review", "gold", "aspect_dim") + """
SELECT r.row_uid, array_to_string(list(CASE WHEN g.aspect IS NULL THEN 0 ELSE 1 END ORDER BY a_ord), '') AS hot
FROM review r CROSS JOIN aspect_dim d LEFT JOIN (SELECT DISTINCT row_uid, aspect FROM gold) g ON g.row_uid = r.row_uid AND g.aspect = d.aspect GROUP BY r.row_uid""")
def multi_hot(spark, sf_dir):
    """PR8."""
    hot = L.multi_hot(L.aspects(F.col("labels")), ASPECTS)
    return reviews(spark, sf_dir).select("row_uid", F.array_join(F.transform(hot, lambda x: x.cast("string")), "").alias("hot"))


@query(with_views("gold") + r"""SELECT trim(split_part(aspect, ':', 1)) AS parent, lower(trim(split_part(aspect, ':', 2))) AS leaf,
  trim(regexp_replace(lower(aspect), '[^a-z0-9]+', '_', 'g'), '_') AS slug, count(*) AS n FROM gold GROUP BY ALL""")
def parent_category(spark, sf_dir):
    """PR9, PR10, PR18."""
    a = F.col("l.aspect")
    made = reviews(spark, sf_dir).select(F.explode("labels").alias("l")).select(L.parent_of(a).alias("parent"), T.query_text(a).alias("leaf"), L.slug(a).alias("slug"))
    return made.groupBy("parent", "leaf", "slug").agg(F.count("*").alias("n"))


_TOKENS = "regexp_extract_all(lower(\"text\"), '[a-z0-9]+')"


@query(f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, len(list_distinct({_TOKENS}))::BIGINT AS n_types, array_to_string(list_sort(list_distinct({_TOKENS})), ' ') AS types FROM documents")
def token_sets(spark, sf_dir):
    """PR11."""
    seq = T.token_sequence(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(seq).cast("long").alias("n_tokens"), F.size(F.array_distinct(seq)).cast("long").alias("n_types"), F.array_join(F.array_sort(F.array_distinct(seq)), " ").alias("types"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct({_TOKENS}) AS s, {_TOKENS} AS seq FROM documents), c AS (SELECT item_id, list_distinct({_TOKENS}) AS b FROM benchmark), st AS (SELECT ['the','of','and'] AS stops)
SELECT doc_id, item_id, round(len(list_intersect(s, b))::DOUBLE / len(list_distinct(list_concat(s, b))), 9) AS jaccard, round(len(list_intersect(s, b))::DOUBLE / len(b), 9) AS coverage,
  round(coalesce(len(list_filter(list_intersect(s, b), lambda x: NOT list_contains(stops, x)))::DOUBLE / nullif(len(list_filter(b, lambda x: NOT list_contains(stops, x))), 0), 0), 9) AS content_coverage,
  round(len(list_filter(seq, lambda x: list_contains(stops, x)))::DOUBLE / len(seq), 9) AS cue_density
FROM t, c, st WHERE len(list_intersect(s, b)) > 0""")
def overlap_features(spark, sf_dir):
    """PR12-PR15, ML3: overlaps of documents and candidates that share a token, by a join on tokens."""
    from larkspur.operators.lexical import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", ["the", "of", "and"])


@query(r"""SELECT regexp_replace(trim(regexp_replace(lower(industry), '\s+', ' ', 'g')), 'x', 'x') AS normal, count(*) AS n
FROM (SELECT '  ' || replace(c_mktsegment, 'U', 'u  ') AS industry FROM customer) GROUP BY ALL""")
def normalised_text(spark, sf_dir):
    """PR17 on ASCII."""
    c = F.concat(F.lit("  "), F.replace(F.col("c_mktsegment"), F.lit("U"), F.lit("u  ")))
    return table(spark, sf_dir, "customer").select(T.normalised(c).alias("normal")).groupBy("normal").agg(F.count("*").alias("n"))


@query()
def nfkc_text(spark, sf_dir):
    """PR17 with NFKC and case folding."""
    return table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(T.nfkc("text")).alias("digest"))


_TEXTS = ", ".join(f"('{a}', '{d}', ['{"', '".join(al)}'], '{i}', '{c}')" for a, (d, al, i, c) in DEFINITIONS.items())
_MEANT = ", ".join(f"('{s}', '{d}')" for s, d in SENTIMENT_DEFINITIONS.items())


@query(f"""WITH a AS (SELECT * FROM (VALUES {_TEXTS}) v(aspect, d, al, incl, contr)), s AS (SELECT * FROM (VALUES {_MEANT}) v(sentiment, meant)),
r AS (SELECT *, 'Definition: ' || d || ' Aliases: ' || array_to_string(al, '; ') || '. Inclusion boundary: ' || incl AS pos FROM a)
SELECT kind, aspect, sentiment, CASE kind WHEN 'control' THEN 'Aspect: ' || aspect || '. Candidate sentiment: ' || sentiment || '.'
  WHEN 'enhanced' THEN 'Aspect: ' || aspect || '. Definition: ' || d || ' Lexical cues: ' || array_to_string(al, ', ') || '. Boundary: ' || contr || ' Candidate sentiment: ' || sentiment || '. Sentiment definition: ' || meant
  WHEN 'name_only' THEN 'Aspect: ' || aspect || '. Candidate sentiment: ' || sentiment || '.' WHEN 'minimal' THEN 'Aspect: ' || aspect || '. Definition: ' || d || ' Candidate sentiment: ' || sentiment || '.'
  WHEN 'rich' THEN 'Aspect: ' || aspect || '. ' || pos || ' Contrastive boundary: ' || contr || ' Candidate sentiment: ' || sentiment || '.'
  WHEN 'stage name_only' THEN 'Aspect: ' || aspect || '. Candidate sentiment: ' || sentiment || '.' WHEN 'stage name_and_description' THEN 'Aspect: ' || aspect || '. Definition: ' || d || ' Candidate sentiment: ' || sentiment || '.'
  WHEN 'stage description_only' THEN 'Aspect definition: ' || d || ' Candidate sentiment: ' || sentiment || '.' WHEN 'stage rich_positive' THEN 'Aspect: ' || aspect || '. ' || pos || ' Candidate sentiment: ' || sentiment || '.'
  ELSE 'Aspect: ' || aspect || '. ' || pos || ' Contrastive boundary: ' || contr || ' Candidate sentiment: ' || sentiment || '.' END AS text
FROM r, s, (SELECT unnest(['control', 'enhanced', 'name_only', 'minimal', 'rich', 'stage name_only', 'stage name_and_description', 'stage description_only', 'stage rich_positive', 'stage rich']) AS kind)""")
def rendered_candidates(spark, sf_dir):
    """PR19-PR21 over the candidate dimension: statements, claims and second-stage candidates, in all variants."""
    from larkspur.plans.taxonomy import candidates

    made = spark.range(1).select(F.explode(candidates()).alias("c")).select("c.aspect", "c.sentiment")
    a, s = F.col("aspect"), F.col("sentiment")
    texts = {v: T.statement(a, s, v) for v in ("control", "enhanced")} | {v: T.claim(a, s, F.lit(v)) for v in ("name_only", "minimal", "rich")}
    texts |= {f"stage {v}": T.sentiment_candidate(a, s, F.lit(v)) for v in ("name_only", "name_and_description", "description_only", "rich_positive", "rich")}
    return made.select("aspect", "sentiment", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in texts.items()))).alias("x")).select("aspect", "sentiment", "x.*")


@query(with_views("aspect_dim") + """SELECT aspect, h.aspect_h AS heldout, CASE WHEN aspect = aspect_h THEN 'rich' ELSE 'minimal' END AS variant FROM aspect_dim, (SELECT aspect AS aspect_h FROM aspect_dim) h""")
def representation_map(spark, sf_dir):
    """PR22: the held-out aspect has another representation."""
    from larkspur.plans.taxonomy import strings

    made = spark.range(1).select(F.explode(strings(ASPECTS)).alias("aspect")).select("aspect", F.explode(strings(ASPECTS)).alias("heldout"))
    return made.withColumn("variant", F.when(F.col("aspect") == F.col("heldout"), "rich").otherwise("minimal"))


@query(f"""WITH a AS (SELECT * FROM (VALUES {_TEXTS}) v(aspect, d, al, incl, contr))
SELECT aspect, field, CASE field WHEN 'name' THEN aspect WHEN 'definition' THEN d WHEN 'aliases' THEN array_to_string(al, '; ') WHEN 'inclusion' THEN incl WHEN 'exclusion' THEN contr
  ELSE 'Aspect: ' || aspect || '. Definition: ' || d || ' Aliases: ' || array_to_string(al, '; ') || '. Inclusion boundary: ' || incl || ' Contrastive boundary: ' || contr END AS text
FROM a, (SELECT unnest(['name', 'definition', 'aliases', 'inclusion', 'exclusion', 'all']) AS field)""")
def rich_fields(spark, sf_dir):
    """PR23: the fields of rich candidates, one row each."""
    from larkspur.plans.taxonomy import strings

    a = F.col("aspect")
    fields = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("text")) for n, v in (("name", a), ("definition", T.definition(a)), ("aliases", T.aliases(a)), ("inclusion", T.boundary(a, 0)), ("exclusion", T.boundary(a, 1)), ("all", T.aspect_candidate(a, F.lit("rich"))))))
    return spark.range(1).select(F.explode(strings(ASPECTS)).alias("aspect")).select("aspect", F.explode(fields).alias("f")).select("aspect", "f.*")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x, l_tax * 10 AS t, l_quantity / 50 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, x - 0.2)), 9) AS clamped,
  round(CASE WHEN t <= 0 THEN 0.5 + 0.5 * x WHEN t >= 1 THEN CASE WHEN x >= t THEN 1.0 ELSE 0.5 * x END WHEN x < t THEN 0.5 * x / t ELSE 0.5 + 0.5 * (x - t) / (1 - t) END, 9) AS aligned,
  round(ln(greatest(1e-6, least(1 - 1e-6, y)) / (1 - greatest(1e-6, least(1 - 1e-6, y)))), 9) AS logit, round(1 / (1 + exp(-y)), 9) AS sigmoid, round((greatest(-1, least(1, x - y)) + 1) / 2, 9) AS unit FROM s""")
def score_scalars(spark, sf_dir):
    """PR24, PR28-PR31."""
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("t"), (F.col("l_quantity") / 50).alias("y"))
    x, t, y = F.col("x"), F.col("t"), F.col("y")
    return made.select("l_orderkey", "l_linenumber", S.clamp_unit(x - 0.2).alias("clamped"), S.aligned(x, t).alias("aligned"), S.logit(y).alias("logit"), S.sigmoid(y).alias("sigmoid"), S.cosine_to_unit(x - y).alias("unit"))


@query("""WITH s AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS top FROM events)
SELECT event_id, round(top, 9) AS aspect_top_score, round(1 - greatest(0, least(1, top)), 9) AS low_aspect_top_score FROM s""")
def margin_features(spark, sf_dir):
    """PR25: features of a map whose values may not be numbers."""
    value = F.from_json("props", "map<string,string>")["k"].try_cast("double") / 100
    return table(spark, sf_dir, "events").select("event_id", value.alias("aspect_top_score")).withColumn("low_aspect_top_score", 1 - S.clamp_unit(F.col("aspect_top_score")))


@query(with_views("grid_a") + """, t AS (SELECT row_uid, aspect, list_sort(list(sentiment_score), 'DESC') AS s, list(sentiment_score) AS p, sum(sentiment_score) AS z FROM grid_a GROUP BY row_uid, aspect)
SELECT row_uid, aspect, s[1] AS top_score, s[2] AS second_score, round(s[1] - s[2], 9) AS margin, round(list_min(list_transform(s, lambda x: abs(x - 0.5))), 9) AS nearest,
  len(list_filter(s, lambda x: x >= 0.5))::BIGINT AS above, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -(x / z) * ln(x / z) ELSE 0 END)), 9) AS entropy FROM t""")
def candidate_features(spark, sf_dir):
    """PR26, PR27: features of each review and aspect's scores."""
    from larkspur.plans.adapter import grid

    s = grid(spark, sf_dir).groupBy("row_uid", "aspect").agg(F.collect_list("sentiment_score").alias("p")).withColumn("s", S.sorted_desc(F.col("p")))
    z = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    top, second = F.col("s")[0], F.col("s")[1]
    return s.select("row_uid", "aspect", top.alias("top_score"), second.alias("second_score"), (top - second).alias("margin"), F.array_min(F.transform("s", lambda x: F.abs(x - 0.5))).alias("nearest"), F.size(F.filter("s", lambda x: x >= 0.5)).cast("long").alias("above"), S.entropy(F.transform("p", lambda x: x / z)).alias("entropy"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus || o_orderkey ELSE o_orderpriority || ':' || o_orderkey END AS key FROM orders")
def row_keys(spark, sf_dir):
    """PR38: a key, or `split:id` where it is empty."""
    uid = F.when(F.col("o_orderstatus") == "F", F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", L.row_key(uid, F.col("o_orderpriority"), F.col("o_orderkey")).alias("key"))


@query("""WITH d AS (SELECT sha256(o_orderkey::VARCHAR || chr(31) || o_orderstatus) AS h FROM orders)
SELECT count(*) AS rows, concat_ws('-', (sum(('0x' || substr(h, 1, 8))::UBIGINT) % 4294967296)::BIGINT, (sum(('0x' || substr(h, 9, 8))::UBIGINT) % 4294967296)::BIGINT,
  (sum(('0x' || substr(h, 17, 8))::UBIGINT) % 4294967296)::BIGINT, (sum(('0x' || substr(h, 25, 8))::UBIGINT) % 4294967296)::BIGINT) AS digest FROM d""")
def frame_fingerprint(spark, sf_dir):
    """PR39: a digest that doesn't depend on the order of rows."""
    from larkspur.operators.contracts import fingerprint

    return fingerprint(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")


@query("""WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT quality, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight, round(sqrt(sum(n) OVER () / (count(*) OVER () * n)), 9) AS sqrt_weight FROM c""")
def class_weights(spark, sf_dir):
    """PR40."""
    from larkspur.operators.splits import class_weights as make

    return make(table(spark, sf_dir, "labels"), "quality")


_MODES = ("replace", "nonempty_else_local", "union", "intersection", "agreement_or_other", "agreement_or_local")


@query(with_views("pred_a", "pred_b") + """, a AS (SELECT row_uid, coalesce(list(aspect || ' | ' || sentiment) FILTER (WHERE p = 1), []) AS l FROM pred_a GROUP BY row_uid),
b AS (SELECT row_uid, coalesce(list(aspect || ' | ' || sentiment) FILTER (WHERE p = 1), []) AS o FROM pred_b GROUP BY row_uid),
m AS (SELECT unnest(['replace','nonempty_else_local','union','intersection','agreement_or_other','agreement_or_local']) AS mode),
c AS (SELECT row_uid, mode, CASE mode WHEN 'replace' THEN o WHEN 'nonempty_else_local' THEN CASE WHEN len(o) > 0 THEN o ELSE l END WHEN 'union' THEN list_distinct(list_concat(l, o)) WHEN 'intersection' THEN list_intersect(l, o)
  WHEN 'agreement_or_other' THEN CASE WHEN len(list_intersect(l, o)) > 0 THEN list_intersect(l, o) ELSE o END ELSE CASE WHEN len(list_intersect(l, o)) > 0 THEN list_intersect(l, o) ELSE l END END AS x FROM a JOIN b USING (row_uid), m)
SELECT row_uid, mode, array_to_string(list_sort(x), '; ') AS combined FROM c""")
def combine_modes(spark, sf_dir):
    """ST1, ST2: two prediction sets in six modes."""
    from larkspur.queries.metrics import predictions

    a, b = predictions(spark, sf_dir, "a").select("row_uid", F.col("pred").alias("l")), predictions(spark, sf_dir, "b").select("row_uid", F.col("pred").alias("o"))
    made = a.join(b, "row_uid").withColumn("mode", F.explode(F.array(*map(F.lit, _MODES))))
    return made.select("row_uid", "mode", F.array_join(L.combine(F.col("l"), F.col("o"), F.col("mode")), "; ").alias("combined"))
