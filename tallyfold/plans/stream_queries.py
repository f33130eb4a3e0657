"""Queries of mergeable sketches and of streams that run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import aggregate as A
from tallyfold.operators import sketches as K
from tallyfold.plans.catalogue import Tables, register, rounded
from tallyfold.streaming import runs
from tallyfold.streaming import windows as W


def _rollup(s, d) -> DataFrame:
    """Sketches of days and types, merged to types: whether the estimates keep their error bounds against all rows."""
    events = Tables(s, d).events
    daily = K.sketched(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], ["user_id", "event_id"], ["value"])
    types = K.estimated(K.merged(daily, ["event_type"]), [0.5, 0.95])
    both = events.join(F.broadcast(types), "event_type")  # a row for each type
    below = lambda q: (F.avg((F.col("value") < F.col(f"value_q{q}")).cast("double")), F.avg((F.col("value") <= F.col(f"value_q{q}")).cast("double")))
    room, ranks = 3 * K.rank_error(), {"50": 0.5, "95": 0.95}
    near = lambda c: (F.abs(F.first(f"{c}_distinct") / F.count_distinct(c) - 1) < 5 * K.distinct_error()).alias(f"{c}_near")
    held = [((below(q)[0] <= share + room) & (below(q)[1] >= share - room)).alias(f"q{q}_near") for q, share in ranks.items()]
    return both.groupBy("event_type").agg(F.first("rows").alias("rows"), near("user_id"), near("event_id"), *held)


register("sketch_rollup", _rollup, "SELECT event_type, count(*) AS rows, TRUE AS user_id_near, TRUE AS event_id_near, TRUE AS q50_near, TRUE AS q95_near FROM events GROUP BY 1")
register("approx_aggregates", lambda s, d: A.group_by(Tables(s, d).orders, ["o_orderstatus"], [("o_orderpriority", "approx_nunique", "kinds"), ("o_totalprice", "count", "n")]),
    "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS kinds, count(o_totalprice) AS n FROM orders GROUP BY 1")

# a stream writes the windows that its watermark has passed

_FINAL = '"end" <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE'
_SUMS = "count(*) AS n, round(sum(value), 8) AS total, round(avg(value), 8) AS mean"
_path = lambda d: f"{d}/events.parquet"
register("stream_tumbling", lambda s, d: rounded(runs.over(s, _path(d), "ts", lambda r: W.tumbling(r, "ts", "1 hour", "10 minutes", ["event_type"], "value")), 8),
    f"""SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, {_SUMS} FROM (SELECT *, date_trunc('hour', ts) AS start FROM events) GROUP BY ALL HAVING {_FINAL}""")
register("stream_sliding", lambda s, d: rounded(runs.over(s, _path(d), "ts", lambda r: W.tumbling(r, "ts", "2 hours", "10 minutes", ["event_type"], "value", "1 hour")), 8),
    f"""SELECT start, start + INTERVAL 2 HOUR AS "end", event_type, {_SUMS} FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL HAVING {_FINAL}""")
register("stream_sessions", lambda s, d: runs.over(s, _path(d), "ts", lambda r: W.sessions(r, "ts", "3 hours", "10 minutes", ["user_id"])),
    f"""SELECT min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT ts, user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run HAVING {_FINAL}""")
