"""Queries of the streaming extension in batch form, where all windows are closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import tracks as K
from ..streaming import windows as W
from .registry import query
from .timelines import _E, frames


def _text(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark, sf_dir):
    w = W.tumbling(W.as_instant(table(spark, sf_dir, "events")), "ts", "1 day", ["event_type"])
    return _text(w).withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT ts, event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, strftime(w + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    w = W.tumbling(W.as_instant(table(spark, sf_dir, "events")), "ts", "12 hours", ["event_type"], slide="6 hours")
    return _text(w).withColumn("total", F.round("total", 4))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return _text(W.sessions(W.as_instant(table(spark, sf_dir, "events")), "ts", "6 hours", ["user_id"]))


@query(f"""WITH {_E}, m AS (SELECT user_id, frame, CASE WHEN event_type <> 'error' THEN event_type END AS label FROM e),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, label ORDER BY frame) AS g FROM m), k AS (SELECT *, lag(label) OVER w AS before, lag(frame) OVER w AS f FROM m WHERE label IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, 'run' AS kind, label, min(frame) AS start, max(frame) AS "end", count(*) AS rows FROM g GROUP BY user_id, label, g UNION ALL SELECT user_id, 'switch', label, f, frame, 1 FROM k WHERE before <> label""")
def track_runs(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("label", F.when(F.col("event_type") != "error", F.col("event_type")))
    return K.track_runs(f, ["user_id"], "frame", "label")
