"""Queries of live counters, limits and sessions over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import labels as L
from ..streaming import checkpoints as K
from ..streaming import counters as S
from .registry import Tables, query

_LIVES = """g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS begins FROM events),
n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM g),
l AS (SELECT user_id, life, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS value, min(ts) AS first, max(ts) AS last, max_by(event_type, (ts, event_id)) AS state FROM n GROUP BY 1, 2),
c AS (SELECT user_id, events, errors, value, first, last, state FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC) = 1)"""
_AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"


@query("str01_session_counters", f"WITH {_LIVES} SELECT * FROM c")
def _(t: Tables) -> DataFrame:
    return S.counters(t("events"))


@query("str01_session_lives", f"WITH {_LIVES} SELECT user_id, events, errors, value, first, last, state FROM l")
def _(t: Tables) -> DataFrame:
    return S.lives(t("events"))


@query("agg29_fleet_counters", f"WITH {_LIVES} SELECT count(*) AS sessions, sum(events)::BIGINT AS events, sum(errors)::BIGINT AS errors, round(sum(value), 2) AS value FROM c")
def _(t: Tables) -> DataFrame:
    return S.fleet(S.counters(t("events")))


@query("str02_completed_sessions", f"WITH {_LIVES} SELECT user_id, last FROM c WHERE state = 'purchase' ORDER BY last DESC, user_id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return S.completed(S.counters(t("events"))).select("user_id", "last")


@query("str03_active_sessions", f"WITH {_LIVES} SELECT user_id FROM c WHERE state <> 'purchase' AND last + INTERVAL 24 HOUR > {_AS_OF}")
def _(t: Tables) -> DataFrame:
    """What is left of the active set after those that ended or expired are pruned."""
    return S.active(S.counters(t("events")), F.expr(_AS_OF)).select("user_id")


@query("hlp40_running_and_errors", f"WITH {_LIVES} SELECT count(*) FILTER (state <> 'purchase' AND last + INTERVAL 24 HOUR > {_AS_OF}) AS running, sum(errors)::BIGINT AS errors FROM c")
def _(t: Tables) -> DataFrame:
    c = S.counters(t("events"))
    running = ~F.col("state").isin(*S.FINISHED) & (F.col("last") + F.expr("INTERVAL 24 HOURS") > F.expr(_AS_OF))
    return c.agg(F.count_if(running).alias("running"), F.sum("errors").alias("errors"))


@query("srt05_live_order", f"WITH {_LIVES} SELECT user_id, row_number() OVER (ORDER BY CASE WHEN state = 'view' THEN 0 WHEN state = 'purchase' THEN 1 ELSE 2 END, last, user_id) AS place FROM c ORDER BY place LIMIT 100")
def _(t: Tables) -> DataFrame:
    """Running sessions, then finished ones, each from the longest unchanged on; the first hundred."""
    rank = F.when(F.col("state") == "view", 0).when(F.col("state").isin(*S.FINISHED), 1).otherwise(2)
    top = S.counters(t("events")).orderBy(rank, "last", "user_id").limit(100)
    return top.select("user_id", F.row_number().over(W.orderBy(rank, "last", "user_id")).cast("long").alias("place"))


@query("agg30_live_rollup", f"WITH {_LIVES}, x AS (SELECT sum(events)::BIGINT AS controls, sum(value) AS latency, sum(errors)::BIGINT AS errors FROM c) SELECT controls, errors, round(latency, 1) AS latency, floor(round(latency / greatest(controls, 1), 3) / 60)::BIGINT || 'm ' || round(round(latency / greatest(controls, 1), 3) - 60 * floor(round(latency / greatest(controls, 1), 3) / 60), 1)::DECIMAL(12,1) || 's' AS per_control FROM x")
def _(t: Tables) -> DataFrame:
    x = S.counters(t("events")).agg(F.sum("events").alias("controls"), F.sum("value").alias("total"), F.sum("errors").alias("errors"))
    return x.select("controls", "errors", F.round("total", 1).alias("latency"), L.latency(F.round(F.col("total") / F.greatest("controls", F.lit(1)), 3)).alias("per_control"))


@query("set05_live_or_stored", f"WITH {_LIVES}, v AS (SELECT user_id AS id, events, false AS is_estimated FROM c WHERE last + INTERVAL 24 HOUR > {_AS_OF}), o AS (SELECT o_custkey AS id, 350 * count(*) AS events, true AS is_estimated FROM orders WHERE o_custkey NOT IN (SELECT id FROM v) GROUP BY 1) SELECT * FROM (SELECT * FROM v UNION ALL SELECT * FROM o) ORDER BY is_estimated, id LIMIT 200")
def _(t: Tables) -> DataFrame:
    """Live sessions, then stored ones with estimated counts where there is no live one, up to a limit."""
    live = S.counters(t("events")).filter(F.col("last") + F.expr("INTERVAL 24 HOURS") > F.expr(_AS_OF)).select(F.col("user_id").alias("id"), "events", F.lit(False).alias("is_estimated"))
    stored = t("orders").groupBy(F.col("o_custkey").alias("id")).agg((350 * F.count("*")).alias("events")).join(live.select("id"), "id", "left_anti")
    return live.unionByName(stored.withColumn("is_estimated", F.lit(True))).orderBy("is_estimated", "id").limit(200)


@query("str04_resume", "SELECT user_id, count(*) AS left_over FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'error' AND d.value > 50) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t("events")
    done = e.filter("event_type = 'error' AND value > 50").select("user_id").distinct()
    return e.filter("event_type = 'view'").join(done, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("left_over"))


@query("win07_limited_attempts", """WITH a AS (SELECT user_id, list([epoch_us(ts)] ORDER BY ts) AS xs, count(*) AS tried FROM events GROUP BY 1)
  SELECT user_id, tried, len(list_reduce(xs, lambda kept, x: CASE WHEN len(list_filter(kept, lambda p: x[1] - p < 86400000000)) >= 2 THEN kept ELSE kept || x END)) AS allowed FROM a""")
def _(t: Tables) -> DataFrame:
    """Two attempts a day for each user; those that are refused don't count."""
    return S.limited(t("events"), "user_id", "ts", most=2, seconds=86_400.0).groupBy("user_id").agg(F.count("*").alias("tried"), F.count_if("allowed").alias("allowed"))


@query("win10_newest_sessions", "SELECT id, origin, ts FROM (SELECT o_custkey AS id, 'report' AS origin, max(o_orderdate) AS ts FROM orders GROUP BY 1 UNION ALL SELECT user_id, 'chat', max(ts) FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders) GROUP BY 1) ORDER BY ts DESC, id LIMIT 12")
def _(t: Tables) -> DataFrame:
    """The newest sessions of reports and chats; a session with a report is one."""
    reports = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("ts"))
    chats = t("events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("ts")).join(reports.select("id"), "id", "left_anti")
    both = reports.withColumn("origin", F.lit("report")).unionByName(chats.withColumn("origin", F.lit("chat")))
    return both.orderBy(F.desc("ts"), "id").limit(12).select("id", "origin", "ts")


# Progress: events are reports of a session (user) on a control (kind of event and a number), orders say what was to be done.
_PROGRESS = """r AS (SELECT user_id AS session, event_type || (event_id % 4) AS control, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN value > 20 THEN 'COMPLETED' ELSE 'RUNNING' END AS status, ts AS at FROM events WHERE user_id IS NOT NULL),
p AS (SELECT session, control, arg_max(status, [epoch_us(at)::VARCHAR, status]) AS status, max(at) AS at, count(*) AS reports FROM r GROUP BY 1, 2), w AS (SELECT DISTINCT user_id AS session, event_type || n AS control FROM events, (SELECT unnest([0, 1, 2]) AS n) WHERE user_id IS NOT NULL)"""


def _reports(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("value") > 20, "COMPLETED").otherwise("RUNNING")
    return t("events").select(F.col("user_id").alias("session"), F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("control"), status.alias("status"), F.col("ts").alias("at"))


def _work(t: Tables) -> DataFrame:
    e = t("events").filter("user_id IS NOT NULL")
    return e.select(F.col("user_id").alias("session"), F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda n: F.concat("event_type", n.cast("string")))).alias("control"))


@query("hlp38_checkpoints", f'WITH {_PROGRESS} SELECT session, control, status, "at", reports FROM p'.replace(" AS at ", ' AS "at" ').replace("epoch_us(at)", 'epoch_us("at")').replace("max(at)", 'max("at")'))
def _(t: Tables) -> DataFrame:
    """The newest report of each control of each session."""
    return K.newest(_reports(t))


@query("hlp38_remaining", f"WITH {_PROGRESS} SELECT session, control FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session = w.session AND p.control = w.control AND status IN ('COMPLETED', 'FAILED'))".replace(" AS at ", ' AS "at" ').replace("epoch_us(at)", 'epoch_us("at")').replace("max(at)", 'max("at")'))
def _(t: Tables) -> DataFrame:
    """What a run that begins again has to do."""
    return K.remaining(_work(t), K.newest(_reports(t)))


@query("hlp38_sessions", f"""WITH {_PROGRESS}, j AS (SELECT w.session, p.status, p.at FROM w LEFT JOIN p ON p.session = w.session AND p.control = w.control AND p.status IN ('COMPLETED', 'FAILED'))
SELECT session, count(*) AS total, count(status) AS done, count(*) FILTER (status = 'FAILED') AS failed, CASE WHEN count(status) = count(*) THEN 'COMPLETED' WHEN count(status) > 0 THEN 'STARTED' ELSE 'WAITING' END AS state, max(at) AS at FROM j GROUP BY 1""".replace(" AS at ", ' AS "at" ').replace("epoch_us(at)", 'epoch_us("at")').replace("max(at)", 'max("at")').replace("p.at FROM", 'p."at" FROM'))  # fmt: skip
def _(t: Tables) -> DataFrame:
    """How far each session is."""
    return K.sessions(_work(t), K.newest(_reports(t)))
