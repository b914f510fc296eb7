"""Stateful and windowed queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest, training
from .base import query, table


@query(
    "loss_spike",
    """WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS k FROM events),
 f AS (SELECT run, k, step, loss, CASE WHEN loss IS NULL OR isnan(loss) OR isinf(loss) THEN 'nan_or_inf' END AS reason, CASE WHEN loss IS NULL OR isnan(loss) OR isinf(loss) THEN []::DOUBLE[] ELSE [loss] END AS kept FROM e WHERE k = 1
 UNION ALL SELECT run, k, step, loss, reason, CASE WHEN reason IS NULL THEN list_append(kept, loss)[-50:] ELSE kept END
   FROM (SELECT e.run, e.k, e.step, e.loss, f.kept, CASE WHEN e.loss IS NULL OR isnan(e.loss) OR isinf(e.loss) THEN 'nan_or_inf' WHEN len(f.kept) >= 10 AND list_avg(f.kept) > 0 AND e.loss > 5 * list_avg(f.kept) THEN 'loss_spike' END AS reason
         FROM f JOIN e ON e.run = f.run AND e.k = f.k + 1))
 SELECT run, step, loss, reason FROM f WHERE reason IS NOT NULL""",
)
def loss_spike(spark, sf_dir):
    """Event values as losses, with a run for each user."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return training.spikes(log, "user_id", "event_id", "value")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return ingest.windowed(table(spark, sf_dir, "events"))


@query("event_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"))


@query("event_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS decile, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark, sf_dir):
    k = F.floor(F.get_json_object("props", "$.k").cast("long") / 10)
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("decile")).agg(F.count("*").alias("n"))
