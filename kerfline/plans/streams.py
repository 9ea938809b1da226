"""Event-time queries: the stream's own operators, here over all rows at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerfline.operators import history
from kerfline.plans import views
from kerfline.plans.catalog import query
from kerfline.streaming import pipeline


def _events(spark, sf_dir):
    return views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("tumbling_windows", """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
""")
def tumbling_windows(spark, sf_dir):
    out = pipeline.tumbling(_events(spark, sf_dir), "6 hours", "1 hour", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("sliding_windows", """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * k AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k))
SELECT start, event_type, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM w GROUP BY 1, 2
""")
def sliding_windows(spark, sf_dir):
    out = pipeline.sliding(_events(spark, sf_dir), "12 hours", "6 hours", "1 hour", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("rms", 6).alias("rms"), "n")


@query("session_windows", """
WITH n AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM n)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS stop, count(*) AS n, max(value) AS peak FROM s GROUP BY user_id, s
""")
def session_windows(spark, sf_dir):
    out = pipeline.sessions(_events(spark, sf_dir), "3 hours", "1 hour", "user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n", "peak")


@query("run_history", """
WITH r AS (SELECT user_id AS run_id, event_id AS seq, event_type AS status, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value, ts FROM events)
SELECT run_id, arg_max(status, seq) AS status, arg_max(k, seq) AS k, round(arg_max(value, seq), 4) AS value, count(*) AS n_events FROM r GROUP BY run_id
""")
def run_history(spark, sf_dir):
    """The last event of each user as the state of a run, its report read out of the semi-structured column."""
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.expr("try_parse_json(props)").alias("body"), "value")
    log = history.fields(e, {"k": ("$.k", "int"), "absent": ("$.report.mae", "double")}, "run_id", "seq", "status", "value")
    out = history.states(log, "status", "k", "value", "absent")
    return out.where("absent IS NULL").select("run_id", "status", "k", F.round("value", 4).alias("value"), "n_events")
