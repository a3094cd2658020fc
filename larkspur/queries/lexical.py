"""Lexical scoring, similarity, vectors (ML, JN18, PR16, SM11)."""

from pyspark.sql import functions as F

from larkspur.functions.scores import cosine
from larkspur.operators import lexical as X
from larkspur.operators.contracts import few
from larkspur.plans.adapter import table, with_views
from larkspur.queries.registry import query
from larkspur.sources.shared import shared_path

_DOC = """WITH d0 AS (SELECT doc_id, regexp_extract_all(lower("text"), '[a-z0-9]{2,}') AS w FROM documents), c0 AS (SELECT item_id, regexp_extract_all(lower("text"), '[a-z0-9]{2,}') AS w FROM benchmark),
dt AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM d0) GROUP BY ALL), ct AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(w) AS term FROM c0) GROUP BY ALL)"""


def _docs(spark, sf_dir):
    """Terms of all documents and of all candidates."""
    return X.terms(table(spark, sf_dir, "documents"), "doc_id", "text"), X.terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(_DOC + """, t AS (SELECT count(DISTINCT doc_id) AS total FROM dt), i AS (SELECT term, ln((1 + total)::DOUBLE / (1 + count(*))) + 1 AS idf FROM dt, t GROUP BY term, total),
dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term, (1 + ln(n)) * idf AS w FROM dt JOIN i USING (term))),
cw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM (SELECT item_id, term, (1 + ln(n)) * idf AS w FROM ct JOIN i USING (term)))
SELECT doc_id, item_id, round(sum(dw.w * cw.w), 9) AS score FROM dw JOIN cw USING (term) GROUP BY ALL""")
def tfidf_word_cosine(spark, sf_dir):
    """ML2, JN18, PR16: sublinear TF-IDF, smooth IDF, rows of length 1."""
    d, c = _docs(spark, sf_dir)
    w = X.idf(d, "doc_id").drop("df")
    return X.similarity(X.tfidf(d, w, "doc_id"), X.tfidf(c, w, "item_id"), "doc_id", "item_id")


@query(_DOC + """, dw AS (SELECT doc_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::DOUBLE) AS w FROM dt), cw AS (SELECT item_id, term, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)::DOUBLE) AS w FROM ct)
SELECT doc_id, item_id, round(sum(dw.w * cw.w), 9) AS score FROM dw JOIN cw USING (term) GROUP BY ALL""")
def count_bow_cosine(spark, sf_dir):
    """ML1, ML9."""
    d, c = _docs(spark, sf_dir)
    return X.count_cosine(d, c, "doc_id", "item_id")


@query(_DOC + """, dw AS (SELECT doc_id, term, 1 / sqrt(count(*) OVER (PARTITION BY doc_id)::DOUBLE) AS w FROM dt), cw AS (SELECT item_id, term, 1 / sqrt(count(*) OVER (PARTITION BY item_id)::DOUBLE) AS w FROM ct)
SELECT doc_id, item_id, round(sum(dw.w * cw.w), 9) AS score FROM dw JOIN cw USING (term) GROUP BY ALL""")
def binary_bow_cosine(spark, sf_dir):
    """ML1, ML9."""
    d, c = _docs(spark, sf_dir)
    return X.count_cosine(d, c, "doc_id", "item_id", binary=True)


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower("text"), '[a-z0-9]{2,}')) AS t, generate_subscripts(regexp_extract_all(lower("text"), '[a-z0-9]{2,}'), 1) AS i FROM benchmark)
SELECT item_id, term, count(*) AS n FROM (SELECT item_id, t AS term FROM w UNION ALL SELECT a.item_id, a.t || ' ' || b.t FROM w a JOIN w b ON a.item_id = b.item_id AND b.i = a.i + 1) GROUP BY ALL""")
def word_bigram_terms(spark, sf_dir):
    """ML1, ML2: words and pairs of neighbours."""
    return X.terms(table(spark, sf_dir, "benchmark"), "item_id", "text", bigrams=True)


@query("""WITH w AS (SELECT item_id, ' ' || unnest(list_filter(regexp_split_to_array(lower("text"), '\\s+'), lambda x: x <> '')) || ' ' AS t FROM benchmark), g AS (SELECT item_id, substr(t, i::INT, k::INT) AS term FROM w, range(1, 200) r(i), range(3, 6) s(k) WHERE i <= greatest(length(t) - k + 1, 1) AND (k = 3 OR length(t) >= k))
SELECT item_id, term, count(*) AS n FROM g GROUP BY ALL""")
def char_ngram_terms(spark, sf_dir):
    """ML2: character n-grams within padded words, three to five."""
    return X.char_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS item, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings e ON q."label" = e."label" AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INT AS rank FROM s) SELECT query, item, score, rank FROM r WHERE rank <= 5""")
def cosine_knn(spark, sf_dir):
    """SM11, ML10: neighbours of every vector whose id is divisible by 100, against all of its label."""
    e = table(spark, sf_dir, "embeddings")
    return X.nearest(e.where("vec_id % 100 = 0"), e, 5, "vec_id", "vec_id", ["label"])


_PROTO = """WITH p AS (SELECT "label", i, avg(x) AS x FROM (SELECT "label", unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT "label" AS prototype, list(x ORDER BY i) AS centre FROM p GROUP BY 1),
s AS (SELECT vec_id, prototype, list_cosine_similarity(embedding::DOUBLE[], centre) AS score FROM embeddings, c)"""


@query(_PROTO + ", t AS (SELECT vec_id, list_sort(list(score), 'DESC') AS s FROM s GROUP BY vec_id) SELECT vec_id, round(s[1], 9) AS max_score, round((s[1] + s[2]) / 2, 9) AS top2_mean FROM t")
def prototype_top2(spark, sf_dir):
    """ML11: each vector against the ten labels' mean vectors."""
    e = table(spark, sf_dir, "embeddings")
    c = X.prototypes(e, "label").withColumnRenamed("label", "prototype")
    scored = e.select("vec_id", "embedding").crossJoin(few(c)).select("vec_id", cosine(F.col("embedding"), F.col("centre")).alias("score"))  # one row for each label
    return X.interfaces(scored, "vec_id")


def _seen(spark, sf_dir):
    c = X.prototypes(table(spark, sf_dir, "embeddings"), "label")
    return c.select(F.col("label").cast("string").alias("aspect"), "label", F.slice("centre", 1, 16).alias("descriptor"), F.slice("centre", 17, 4).alias("weight"))


_WT = _PROTO.split(",\ns AS")[0] + """, v AS (SELECT prototype::VARCHAR AS aspect, prototype, centre[1:16] AS d, centre[17:20] AS w FROM c), t AS (SELECT d FROM v WHERE prototype = 0), k AS (SELECT aspect, w, list_cosine_similarity(v.d, t.d) AS sim FROM v, t WHERE prototype <> 0)"""


def _target(spark, sf_dir):
    return F.array(*(F.lit(x) for x in _seen(spark, sf_dir).where("label = 0").first()["descriptor"]))


@query(_WT + " SELECT round(w[1], 9) AS w1, round(w[2], 9) AS w2 FROM k ORDER BY sim DESC, aspect LIMIT 1")
def nearest_weight(spark, sf_dir):
    """ML12."""
    made = X.weight_transfer(_seen(spark, sf_dir).where("label <> 0"), _target(spark, sf_dir), "nearest")
    return made.select(F.col("weight")[0].alias("w1"), F.col("weight")[1].alias("w2"))


@query(_WT + " SELECT round(sum(exp(sim / 0.1) * w[1]) / sum(exp(sim / 0.1)), 9) AS w1, round(sum(exp(sim / 0.1) * w[2]) / sum(exp(sim / 0.1)), 9) AS w2 FROM k")
def barycentric_weight(spark, sf_dir):
    """ML12."""
    made = X.weight_transfer(_seen(spark, sf_dir).where("label <> 0"), _target(spark, sf_dir), "barycentre")
    return made.select(F.col("weight")[0].alias("w1"), F.col("weight")[1].alias("w2"))


@query(_WT + " SELECT round(avg(w[1]), 9) AS w1, round(avg(w[2]), 9) AS w2 FROM k")
def mean_weight(spark, sf_dir):
    """ML12."""
    made = X.weight_transfer(_seen(spark, sf_dir).where("label <> 0"), _target(spark, sf_dir), "mean")
    return made.select(F.col("weight")[0].alias("w1"), F.col("weight")[1].alias("w2"))


@query()
def kernel_ridge_weight(spark, sf_dir):
    """ML12: each label's weight from the others, and how well its direction is met; ten labels."""
    import numpy as np

    rows = _seen(spark, sf_dir).orderBy("label").collect()
    d, w = np.array([r["descriptor"] for r in rows]), np.array([r["weight"] for r in rows])
    out = []
    for i, r in enumerate(rows):
        got = X.kernel_ridge(np.delete(d, i, 0), np.delete(w, i, 0), d[i], 0.1)
        out.append((r["label"], float(got @ w[i] / (np.linalg.norm(got) * np.linalg.norm(w[i])))))
    return spark.createDataFrame(out, "label int, direction_cosine double")


@query()
def diverse_retrieval(spark, sf_dir):
    """SM11, W11: from shortlists of ten, three neighbours of rows (ids modulo 97) and aspects (ids modulo 7) that differ."""
    e = table(spark, sf_dir, "embeddings")
    short = X.nearest(e.where("vec_id % 100 = 0"), e, 10, "vec_id", "vec_id", ["label"]).withColumns({"row": F.col("item") % 97, "aspect": F.col("item") % 7})
    return X.diverse(short, "query", 3, "row", "aspect")


@query()
def retrieved_demonstrations(spark, sf_dir):
    """SM11: two neighbours of a vector's own label and two of the next one, in order, as examples."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0")
    pick = lambda shift: X.diverse(X.nearest(queries.withColumn("label", (F.col("label") + shift) % 10), e, 10, "vec_id", "vec_id", ["label"]).withColumns({"row": F.col("item"), "aspect": F.col("item") % 7}), "query", 2, "row", "aspect").drop("row", "aspect", "score")
    return X.demonstrations(pick(0), pick(1), "query")


def _languages(spark, sf_dir):
    from larkspur.plans.adapter import hash_bucket

    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "text", F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")).cast("double").alias("y"))
    held = X.vocabulary_tfidf(docs.withColumn("y", F.col("y") - 1).where("y >= 0"), "text")
    return held.select("doc_id", "y", "__x", (hash_bucket(F.col("doc_id").cast("string"), 5) == 0).alias("held"))


@query()
def one_versus_rest(spark, sf_dir):
    """ML6: linear models over TF-IDF for four classes, on held-out documents."""
    rows = _languages(spark, sf_dir).persist()  # each iteration reads them
    try:
        out = [X.one_versus_rest(rows.where("not held"), "y", svm).transform(rows.where("held")).groupBy("y").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("y")).cast("int")).alias("accuracy")).withColumn("model", F.lit(n)) for n, svm in (("logistic", False), ("svm", True))]
        done = out[0].unionByName(out[1]).collect()  # a row for each model and class
    finally:
        rows.unpersist()
    return spark.createDataFrame(done, out[0].schema)


@query()
def latent_neighbours(spark, sf_dir):
    """ML7: documents on eight latent dimensions, and how alike those of a language are to its mean."""
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    made, path = X.sparse_tfidf(docs, "doc_id", "text"), shared_path(spark, "latent")
    made.write.parquet(path)  # each pass over the rows reads them
    z = X.latent(spark.read.schema(made.schema).parquet(path), "doc_id", 8).join(docs.select("doc_id", "lang"), "doc_id")
    centre = z.select("lang", F.posexplode("z").alias("i", "x")).groupBy("lang", "i").agg(F.avg("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("c"))
    return z.join(F.broadcast(centre), "lang").groupBy("lang").agg(F.count("*").alias("n"), F.avg(cosine(F.col("z"), F.col("c"))).alias("mean_cosine"))  # one row for each language


def _manifest(spark, sf_dir):
    """Documents with the languages as candidates, one of them its own: text, candidate_text, candidate_aspect, candidate_sentiment, target, held."""
    from larkspur.plans.adapter import hash_bucket

    names = {"de": "der die und", "en": "the and of", "es": "el la de", "fr": "le la et"}
    cells = F.array(*(F.struct(F.lit(a).alias("candidate_aspect"), F.lit(t).alias("candidate_text")) for a, t in names.items()))
    docs = table(spark, sf_dir, "documents").where("lang is not null and text is not null").select("doc_id", "lang", "text", F.explode(cells).alias("c"))
    held = hash_bucket(F.col("doc_id").cast("string"), 5) == 0
    return docs.select("doc_id", "text", "c.*", F.lit("positive").alias("candidate_sentiment"), (F.col("lang") == F.col("c.candidate_aspect")).cast("int").alias("target"), held.alias("held"))


def _scored(scorer, rows):
    made = scorer.fit(rows.where("not held")).score(rows.where("held"))
    return made.groupBy("target").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"))


@query()
def pair_scorer(spark, sf_dir):
    """ML3: six features and both ablations, on held-out documents."""
    from larkspur.operators.scorers import PairScorer

    rows = _manifest(spark, sf_dir)
    full = PairScorer().spaces(rows.where("not held"))
    made = full.features(rows).select(*PairScorer.ALL, "target", "held").persist()  # three regressions read the same features
    try:
        out = []
        for name in PairScorer.ABLATIONS:
            scored = PairScorer(name).learn(made.where("not held")).scored(made.where("held"))
            out.append(scored.groupBy("target").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability")).withColumn("features", F.lit(name)))
        whole = out[0].unionByName(out[1]).unionByName(out[2])
        done = whole.collect()  # two rows for each set of features
    finally:
        made.unpersist()
    return spark.createDataFrame(done, whole.schema)


@query()
def presence_scorer(spark, sf_dir):
    """ML4: four features of a text and an aspect."""
    from larkspur.operators.scorers import PresenceScorer

    return _scored(PresenceScorer(), _manifest(spark, sf_dir))


@query()
def two_stage_scorer(spark, sf_dir):
    """ML5: presence and sentiment models together."""
    from larkspur.operators.scorers import TwoStage

    rows = _manifest(spark, sf_dir)
    train, held = rows.where("not held"), rows.where("held")
    made = TwoStage().fit(train, train).score(held, held, "doc_id", "candidate_aspect")
    return made.groupBy("target").agg(F.count("*").alias("n"), F.avg("aspect_score").alias("mean_aspect_score"), F.avg("sentiment_score").alias("mean_sentiment_score"))


@query()
def registered_similarity(spark, sf_dir):
    """ML9: the registered sparse scorers, fitted on training documents only, with what is known of each candidate's vector."""
    from larkspur.operators.scorers import Similarity, similarity_names
    from larkspur.plans.adapter import hash_bucket

    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text", (hash_bucket(F.col("doc_id").cast("string"), 5) == 0).alias("held"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("candidate"), "text")
    out = []
    for name in similarity_names():
        model = Similarity(name).fit(docs.where("not held").select("text"))
        best = model.score(docs.where("held"), items).groupBy("candidate").agg(F.max("score").alias("best"), F.count("*").alias("documents"))
        out.append(model.diagnostics(items).join(best, "candidate", "left").withColumn("scorer", F.lit(name)))
    return out[0].unionByName(out[1])


@query()
def lexical_baseline(spark, sf_dir):
    """ML8: a linear model over TF-IDF, and the constant that stands for it where training has one label only."""
    from larkspur.operators.scorers import ConstantFallback

    rows = _languages(spark, sf_dir)

    def fit(train):
        model = X.one_versus_rest(train, "y")
        return lambda frame: model.transform(frame)

    out = []
    for name, part in (("all", rows), ("one", rows.where("y = 1"))):
        made = ConstantFallback("text", "y", fit).fit(part.where("not held")).predict(part.where("held"))
        out.append(made.groupBy("y").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("y")).cast("int")).alias("accuracy")).withColumn("trained_on", F.lit(name)))
    return out[0].unionByName(out[1])


@query()
def lexical_logistic(spark, sf_dir):
    """ML6: logistic regression on three statistics of texts, scored on held-out documents."""
    from larkspur.functions.text import token_sequence
    from larkspur.plans.adapter import hash_bucket

    seq = token_sequence(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.size(seq)).alias("n"), (F.size(F.array_distinct(seq)) / F.greatest(F.size(seq), F.lit(1))).alias("distinct"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("upper"))
    rows = docs.join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id").withColumn("held", hash_bucket(F.col("doc_id").cast("string"), 5) == 0)
    _, score = X.logistic(rows.where("not held"), ["n", "distinct", "upper"], "quality")
    return score(rows.where("held")).groupBy("quality").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"))


@query(with_views("grid_a", "grid_b") + "SELECT a.row_uid, a.aspect, a.sentiment, round(greatest(0, a.score - 0.5 * b.score), 9) AS score FROM grid_a a JOIN grid_b b USING (row_uid, aspect, sentiment)")
def contrastive_scores(spark, sf_dir):
    """ML11: a penalty from the contrasting prototype."""
    from larkspur.plans.adapter import grid

    b = grid(spark, sf_dir, "b").select("row_uid", "aspect", "sentiment", F.col("score").alias("y"))
    return grid(spark, sf_dir, "a").join(b, ["row_uid", "aspect", "sentiment"]).select("row_uid", "aspect", "sentiment", X.contrastive(F.col("score"), F.col("y"), 0.5).alias("score"))


@query(with_views("grid_a") + "SELECT row_uid, aspect, sentiment, score FROM grid_a")
def checked_scores(spark, sf_dir):
    """ML15: a scorer's probabilities, asserted in the plan."""
    from larkspur.operators.contracts import ColumnScorer
    from larkspur.plans.adapter import grid

    g = grid(spark, sf_dir).withColumnRenamed("score", "raw")
    return ColumnScorer(lambda frame: F.col("raw")).checked(g).select("row_uid", "aspect", "sentiment", "score")
