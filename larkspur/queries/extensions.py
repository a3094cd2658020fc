"""Extensions, not part of the inventory: windows over events, in batch here and on streams in larkspur.streaming."""

from pyspark.sql import functions as F

from larkspur.plans.adapter import table
from larkspur.queries.registry import query
from larkspur.streaming.events import sessions, windowed


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("""WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE AS gap, event_id FROM events), s AS (SELECT *, sum(coalesce(gap, TRUE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def session_events(spark, sf_dir):
    made = sessions(table(spark, sf_dir, "events"))
    return made.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
