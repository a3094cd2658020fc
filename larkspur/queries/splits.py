"""Splits, masks, leakage and summaries (FL, AG7-AG10, DK19-DK20, SM13)."""

from pyspark.sql import functions as F

from larkspur.functions.labels import pairs
from larkspur.operators import splits as P
from larkspur.plans.adapter import hash_bucket, reviews, table, with_views
from larkspur.plans.taxonomy import folds
from larkspur.queries.registry import query

HELD = "Size: LARGE"
FOLD = next(f for f in folds() if f.level == "L2" and f.heldout == (HELD,))
_TEXT = lambda frame: frame.select("row_uid", F.array_join(pairs(F.col("labels")), "; ").alias("pairs"))
_G = with_views("review", "gold") + """, l AS (SELECT r.row_uid, split, list_sort(list(aspect || ' | ' || sentiment) FILTER (WHERE aspect IS NOT NULL)) AS ls,
  list_sort(list(aspect || ' | ' || sentiment) FILTER (WHERE aspect <> 'Size: LARGE')) AS seen, max(CASE WHEN aspect = 'Size: LARGE' THEN 1 ELSE 0 END) AS hit
  FROM review r LEFT JOIN gold g USING (row_uid) GROUP BY r.row_uid, split)"""


@query("""SELECT o_orderkey, (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 16))::UBIGINT % 10)::INT AS b10, (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 16))::UBIGINT % 5)::INT AS b5 FROM orders""")
def hash_partition(spark, sf_dir):
    """FL8."""
    uid = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", hash_bucket(uid, 10).alias("b10"), hash_bucket(uid, 5).alias("b5"))


@query(_G + "SELECT row_uid, array_to_string(seen, '; ') AS pairs FROM l WHERE split = 'train' AND len(seen) > 0")
def split_label_masked(spark, sf_dir):
    """FL1, FL2, FL4."""
    return _TEXT(P.label_masked(reviews(spark, sf_dir).where("split = 'train'"), FOLD.seen))


@query(_G + "SELECT row_uid, array_to_string(ls, '; ') AS pairs FROM l WHERE split = 'train' AND len(ls) > 0 AND hit = 0")
def split_example_filtered(spark, sf_dir):
    """FL4."""
    return _TEXT(P.example_filtered(reviews(spark, sf_dir).where("split = 'train'"), FOLD.heldout))


@query(with_views("review", "gold") + """SELECT split, scope, count(*) AS rows, sum(n)::BIGINT AS labels FROM (
  SELECT split, 'heldout_containing' AS scope, sum(CASE WHEN aspect = 'Size: LARGE' THEN 1 ELSE 0 END) AS n, r.row_uid FROM review r JOIN gold USING (row_uid) GROUP BY r.row_uid, split HAVING n > 0
  UNION ALL SELECT split, 'full_all', count(aspect), r.row_uid FROM review r LEFT JOIN gold USING (row_uid) GROUP BY r.row_uid, split) WHERE split <> 'train' GROUP BY ALL""")
def split_evaluation_scopes(spark, sf_dir):
    """FL4: evaluation scopes."""
    rows = reviews(spark, sf_dir).where("split <> 'train'")
    one = P.evaluation(rows, FOLD.heldout, True, False).withColumn("scope", F.lit("heldout_containing"))
    return one.unionByName(P.evaluation(rows, FOLD.heldout, False, True).withColumn("scope", F.lit("full_all"))).groupBy("split", "scope").agg(F.count("*").alias("rows"), F.sum(F.size("labels")).alias("labels"))


@query(_G + "SELECT row_uid, coalesce(array_to_string(ls, '; '), '') AS pairs FROM l WHERE split = 'train' AND hit = 0")
def policy_filtered(spark, sf_dir):
    """FL5."""
    return _TEXT(P.training_rows(reviews(spark, sf_dir), FOLD, "review_filtered"))


@query(_G + "SELECT row_uid, coalesce(array_to_string(seen, '; '), '') AS pairs FROM l WHERE split = 'train'")
def policy_masked(spark, sf_dir):
    """FL5."""
    return _TEXT(P.training_rows(reviews(spark, sf_dir), FOLD, "label_masked_all_reviews"))


@query(_G + """, n AS (SELECT count(*) AS n FROM l WHERE split = 'train' AND hit = 0), k AS (SELECT row_uid, coalesce(array_to_string(seen, '; '), '') AS pairs,
  row_number() OVER (ORDER BY sha256('13|size_matched|' || row_uid), row_uid) AS r FROM l WHERE split = 'train') SELECT row_uid, pairs FROM k, n WHERE r <= n""")
def policy_size_matched(spark, sf_dir):
    """FL5, FL10, SM12."""
    return _TEXT(P.training_rows(reviews(spark, sf_dir), FOLD, "size_matched_label_masked", 13))


@query(with_views("review") + "SELECT row_uid, CASE WHEN org IN (1, 2) THEN 'validation' WHEN org IN (3, 4, 5) THEN 'test' ELSE 'train' END AS split FROM review")
def org_split(spark, sf_dir):
    """FL3."""
    return P.org_split(reviews(spark, sf_dir, facts=True), [1, 2], [3, 4, 5]).select("row_uid", "split")


@query(with_views("aspect_dim", "review", "gold") + """, f AS (SELECT 'L1-' || printf('%02d', a_ord + 1) AS fold_id, [aspect] AS held FROM aspect_dim UNION ALL SELECT 'L2-' || printf('%02d', a_ord + 1), [aspect] FROM aspect_dim
  UNION ALL SELECT 'L3-' || printf('%02d', a.a_ord + 1), [a.aspect, b.aspect] FROM aspect_dim a JOIN aspect_dim b ON b.a_ord = (a.a_ord + 1) % 6
  UNION ALL SELECT 'L4-0' || o, held FROM (SELECT row_number() OVER (ORDER BY min(a_ord)) AS o, list(aspect) AS held FROM aspect_dim GROUP BY split_part(aspect, ':', 1))),
l AS (SELECT r.row_uid, split, coalesce(list(aspect) FILTER (WHERE aspect IS NOT NULL), []) AS a FROM review r LEFT JOIN gold USING (row_uid) GROUP BY r.row_uid, split),
x AS (SELECT fold_id, split, split <> 'train' OR (len(a) > 0 AND NOT list_has_any(a, held)) AS kept, list_has_any(a, held) AS hit FROM l, f)
SELECT fold_id, split, count(*) AS rows, sum(kept::INT)::BIGINT AS kept, sum((kept AND hit AND split = 'train')::INT)::BIGINT AS leaked FROM x GROUP BY ALL""")
def fold_registry(spark, sf_dir):
    """SM13, SM14, FL6: all folds in one job, with leakage counts."""
    return P.fold_splits(reviews(spark, sf_dir), folds())


@query(with_views("aspect_dim", "review", "gold") + """, f AS (SELECT 'L2-' || printf('%02d', a_ord + 1) AS fold_id, aspect AS held FROM aspect_dim), n AS (SELECT unnest(['known_split', 'labels_in_taxonomy', 'no_heldout_in_filtered_train', 'no_heldout_in_masked_train', 'masking_keeps_seen', 'evaluation_rows_whole', 'seen_and_heldout_apart', 'taxonomy_covered']) AS name)
SELECT fold_id, name, CASE name WHEN 'labels_in_taxonomy' THEN (SELECT count(*) FROM gold WHERE aspect NOT IN (SELECT aspect FROM aspect_dim)) ELSE 0 END::BIGINT AS bad FROM f, n UNION ALL SELECT 'all', 'rows_once', (count(*) - count(DISTINCT row_uid))::BIGINT FROM review""")
def fold_audit(spark, sf_dir):
    """OR6: named checks of all folds in one pass."""
    from larkspur.plans.taxonomy import ASPECTS

    return P.audit(reviews(spark, sf_dir), [f for f in folds() if f.level == "L2"], ASPECTS)


@query(with_views("review", "gold") + """, v AS (SELECT DISTINCT split, 'row' AS kind, row_uid AS value FROM review UNION SELECT split, 'org', org::VARCHAR FROM review WHERE org IS NOT NULL
  UNION SELECT split, 'aspect', aspect FROM review JOIN gold USING (row_uid) UNION SELECT split, 'pair', aspect || ' | ' || sentiment FROM review JOIN gold USING (row_uid)),
c AS (SELECT * FROM (VALUES ('test', 'train'), ('test', 'validation'), ('train', 'validation')) t(left_split, right_split)), k AS (SELECT DISTINCT kind FROM v)
SELECT k.kind, left_split, right_split, count(r.value)::BIGINT AS shared FROM k CROSS JOIN c LEFT JOIN v l ON l.split = left_split AND l.kind = k.kind LEFT JOIN v r ON r.kind = l.kind AND r.value = l.value AND r.split = right_split GROUP BY ALL""")
def leakage_checks(spark, sf_dir):
    """FL12, OR6."""
    return P.leakage(reviews(spark, sf_dir, facts=True))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower("text"), '[ \t\n\r\f\v]+', ' ', 'g')) AS normal, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 10 <= 6 AS train FROM documents),
c AS (SELECT normal, count(*) AS n FROM d WHERE train AND normal <> '' GROUP BY normal)
SELECT doc_id, coalesce(n, 0)::BIGINT AS train_copies, coalesce(n, 0) > 0 AS is_duplicate FROM d LEFT JOIN c USING (normal) WHERE NOT train""")
def exact_duplicate_text(spark, sf_dir):
    """FL9: duplicates of training texts, with their multiplicities."""
    from larkspur.functions.text import normalised

    docs = table(spark, sf_dir, "documents").select("doc_id", normalised(F.col("text")).alias("normal"), (hash_bucket(F.col("doc_id").cast("string"), 10) <= 6).alias("train"))
    return P.duplicates_of_training(docs.where("train"), docs.where("not train")).select("doc_id", "train_copies", "is_duplicate")


@query(with_views("review", "gold") + """, f AS (SELECT split, count(*) AS rows, count(DISTINCT org) AS orgs FROM review GROUP BY split), g AS (SELECT split, count(*) AS labels, count(DISTINCT aspect) AS aspects, count(DISTINCT aspect || sentiment) AS pairs,
  count(DISTINCT row_uid) AS n FROM review JOIN gold USING (row_uid) GROUP BY split) SELECT split, rows, orgs, labels, rows - n AS empty_rows, aspects, pairs FROM f JOIN g USING (split)""")
def split_summary(spark, sf_dir):
    """AG7."""
    return P.split_summary(reviews(spark, sf_dir, facts=True))


@query(with_views("review", "gold") + "SELECT split, labels_per_row, count(*) AS rows FROM (SELECT split, r.row_uid, count(aspect) AS labels_per_row FROM review r LEFT JOIN gold USING (row_uid) GROUP BY ALL) GROUP BY ALL")
def labels_per_row_hist(spark, sf_dir):
    """AG7."""
    return P.label_histogram(reviews(spark, sf_dir))


@query(with_views("gold") + "SELECT aspect || ' | ' || sentiment AS pair, count(*) AS n FROM gold GROUP BY 1 ORDER BY n DESC, pair LIMIT 20")
def top_pairs(spark, sf_dir):
    """AG7, DK21."""
    return P.top_pairs(reviews(spark, sf_dir))


@query(with_views("review", "gold") + """, f AS (SELECT org, count(*) AS rows, array_to_string(list_sort(list_distinct(list(industry))), '; ') AS industries, array_to_string(list_sort(list_distinct(list(data_source))), '; ') AS sources FROM review GROUP BY org),
g AS (SELECT org, count(DISTINCT aspect) AS aspects, count(*) AS labels FROM review JOIN gold USING (row_uid) GROUP BY org) SELECT org, rows, industries, sources, aspects, labels FROM f LEFT JOIN g USING (org)""")
def org_summary(spark, sf_dir):
    """AG8."""
    return P.org_summary(reviews(spark, sf_dir, facts=True))


@query(with_views("review", "gold") + """SELECT aspect, count(DISTINCT row_uid) AS rows, count(DISTINCT org) AS orgs, count(*) AS labels, sum((sentiment = 'negative')::INT)::BIGINT AS negative,
  sum((sentiment = 'neutral')::INT)::BIGINT AS neutral, sum((sentiment = 'positive')::INT)::BIGINT AS positive FROM review JOIN gold USING (row_uid) GROUP BY aspect""")
def aspect_summary(spark, sf_dir):
    """AG9."""
    return P.aspect_summary(reviews(spark, sf_dir, facts=True))


@query(with_views("gold") + "SELECT DISTINCT aspect, sentiment FROM gold")
def unique_labels(spark, sf_dir):
    """AG10."""
    return reviews(spark, sf_dir).select(F.explode("labels").alias("l")).select("l.*").distinct()


@query(with_views("review", "gold") + """, o AS (SELECT org, count(*) AS rows FROM review WHERE org IS NOT NULL GROUP BY org HAVING count(*) >= 5), x AS (SELECT org, list_distinct(list(aspect)) AS a FROM review JOIN gold USING (row_uid) GROUP BY org)
SELECT l.org AS a, r.org AS b, l.rows + r.rows AS rows, len(list_distinct(list_concat(coalesce(xl.a, []), coalesce(xr.a, []))))::INT AS aspects FROM o l JOIN o r ON l.org < r.org LEFT JOIN x xl ON xl.org = l.org LEFT JOIN x xr ON xr.org = r.org
ORDER BY aspects DESC, rows, l.org, r.org LIMIT 20""")
def org_split_search(spark, sf_dir):
    """DK19: a top-k report."""
    return P.org_split_search(reviews(spark, sf_dir, facts=True), 5, 20)


@query(with_views("aspect_dim", "gold") + """, c AS (SELECT a.aspect AS a, b.aspect AS b, c.aspect AS c FROM aspect_dim a, aspect_dim b, aspect_dim c WHERE a.a_ord < b.a_ord AND b.a_ord < c.a_ord), g AS (SELECT DISTINCT row_uid, aspect FROM gold)
SELECT a || ' + ' || b || ' + ' || c AS combo, count(DISTINCT row_uid) AS rows, count(*) AS labels FROM c JOIN g ON g.aspect IN (a, b, c) GROUP BY 1 ORDER BY rows DESC, combo LIMIT 10""")
def aspect_combo_rank(spark, sf_dir):
    """DK20: a top-k report."""
    return P.aspect_combinations(reviews(spark, sf_dir))
