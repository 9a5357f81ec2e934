"""Relational queries over findings (lineitem), reports (orders) and users (customer).

The driver's tables stand in for compliance data: a line item is a finding whose score is its discount in percent, its
order is the report it belongs to, the customer of the order is the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import severity as S
from ..operators import relational as R
from ..sources import stores
from .registry import Tables, query

_F = """f AS (SELECT l_orderkey AS report_id, l_linenumber AS pos, l_partkey AS plugin_id, l_suppkey AS host, round(l_discount * 100, 1) AS score,
  CASE WHEN round(l_discount * 100, 1) >= 9 THEN 'CRITICAL' WHEN round(l_discount * 100, 1) >= 7 THEN 'HIGH' WHEN round(l_discount * 100, 1) >= 4 THEN 'MEDIUM' WHEN round(l_discount * 100, 1) > 0 THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE WHEN round(l_discount * 100, 1) >= 9 THEN 4 WHEN round(l_discount * 100, 1) >= 7 THEN 3 WHEN round(l_discount * 100, 1) >= 4 THEN 2 WHEN round(l_discount * 100, 1) > 0 THEN 1 ELSE 0 END AS sev,
  l_returnflag AS tool, l_linestatus AS status, l_shipdate AS seen, l_quantity AS quantity FROM lineitem)"""
WITH_F = f"WITH {_F} "


def findings(t: Tables) -> DataFrame:
    score = F.round(F.col("l_discount") * 100, 1)
    return t("lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("plugin_id"), F.col("l_suppkey").alias("host"),
        score.alias("score"), S.band(score).alias("severity"), S.rank(S.band(score)).alias("sev"), F.col("l_returnflag").alias("tool"),
        F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("seen"), F.col("l_quantity").alias("quantity"),
    )


# Filters and projections


@query("flt01_first_match", "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = 7")
def _(t: Tables) -> DataFrame:
    return t("orders").filter("o_custkey = 7").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("flt02_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')")
def _(t: Tables) -> DataFrame:
    return t("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query("flt03_contains_any_case", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Part 1%' OR p_type ILIKE '%eco%'")
def _(t: Tables) -> DataFrame:
    return t("part").filter(F.col("p_name").ilike("%Part 1%") | F.col("p_type").ilike("%eco%")).select("p_partkey", "p_name")


@query("flt04_drop_informational", WITH_F + "SELECT report_id, pos, severity FROM f WHERE severity NOT ILIKE '%info%' AND tool NOT ILIKE '%n%'")
def _(t: Tables) -> DataFrame:
    return findings(t).filter(~F.col("severity").ilike("%info%") & ~F.col("tool").ilike("%n%")).select("report_id", "pos", "severity")


@query("flt05_saved_or_verified", WITH_F + "SELECT report_id, pos FROM f WHERE status = 'F' OR tool = 'R'")
def _(t: Tables) -> DataFrame:
    return findings(t).filter("status = 'F' OR tool = 'R'").select("report_id", "pos")


@query("flt06_null_or_other", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NULL OR event_type <> 'click'")
def _(t: Tables) -> DataFrame:
    return t("events").filter((F.get_json_object("props", "$.k").isNull()) | (F.col("event_type") != "click")).select("event_id")


@query("flt07_time_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def _(t: Tables) -> DataFrame:
    return t("orders").filter("o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'").select("o_orderkey")


@query("flt08_optional_predicates", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'view' AND user_id >= 10")
def _(t: Tables) -> DataFrame:
    df = t("events").select("event_id", "event_type", "user_id", "ts")
    for condition in (F.col("event_type") == "view", None, F.col("user_id") >= 10):  # what wasn't asked for is left out
        df = df if condition is None else df.filter(condition)
    return df.drop("ts")


@query("flt09_scope_fails_open", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR NOT EXISTS (SELECT 1 FROM part WHERE p_brand LIKE 'Brand#1%')")
def _(t: Tables) -> DataFrame:
    return R.fail_open(t("part").select("p_partkey", "p_brand"), F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("flt10_report_exclusion", WITH_F + "SELECT count(*) AS n FROM f WHERE upper(trim(status)) NOT IN ('F', 'CLOSED', 'FALSE_POSITIVE')")
def _(t: Tables) -> DataFrame:
    return findings(t).filter(~S.status(F.col("status")).isin("F", "CLOSED", "FALSE_POSITIVE")).agg(F.count("*").alias("n"))


@query("flt11_informational_split", WITH_F + "SELECT sev = 0 AS is_informational, count(*) AS n FROM f GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return findings(t).groupBy((F.col("sev") == 0).alias("is_informational")).agg(F.count("*").alias("n"))


@query("flt13_feedback_eligible", "SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0")
def _(t: Tables) -> DataFrame:
    return t("labels").filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


@query("flt14_entitled", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t: Tables) -> DataFrame:
    return t("orders").join(t("customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("flt16_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true ELSE false END AS is_deleted FROM orders")
def _(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", True).otherwise(False).alias("is_deleted"))


@query("prj02_first_long_enough", "SELECT p_partkey, coalesce(CASE WHEN length(trim(p_brand)) > 8 THEN p_brand END, CASE WHEN length(trim(p_type)) > 5 THEN p_type END, p_name) AS label FROM part")
def _(t: Tables) -> DataFrame:
    long = lambda c, n: F.when(F.length(F.trim(c)) > n, F.col(c))
    return t("part").select("p_partkey", F.coalesce(long("p_brand", 8), long("p_type", 5), F.col("p_name")).alias("label"))


@query("prj04_sizes", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN round(n_chars / 1024.0, 1)::DECIMAL(12,1) || ' KB' ELSE round(n_chars / 1048576.0, 1)::DECIMAL(12,1) || ' MB' END AS size FROM documents")
def _(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    unit = lambda d, u: F.concat(F.round(n / d, 1).cast("decimal(12,1)").cast("string"), F.lit(u))
    return t("documents").select("doc_id", F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, unit(1024.0, " KB")).otherwise(unit(1048576.0, " MB")).alias("size"))


# Joins


@query("jon01_findings_of_reports", WITH_F + "SELECT severity, o_orderstatus, count(*) AS n, round(sum(score), 1) AS score FROM f JOIN orders ON report_id = o_orderkey GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    f = findings(t).join(t("orders"), F.col("report_id") == F.col("o_orderkey"))
    return f.groupBy("severity", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("score"), 1).alias("score"))


@query("jon04_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3) OR o_custkey = 11")
def _(t: Tables) -> DataFrame:
    who = t("customer").filter("c_nationkey = 3").agg(F.min("c_custkey").alias("who"))  # one row
    return t("orders").crossJoin(F.broadcast(who)).filter("o_custkey = who OR o_custkey = 11").select("o_orderkey")


@query("jon05_user_or_unknown", "SELECT o_orderkey, coalesce(nullif(c_name, ''), 'Unknown') AS username FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    users = t("customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return t("orders").join(users, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(F.nullif("c_name", F.lit("")), F.lit("Unknown")).alias("username"))


@query("jon06_counts_per_report", WITH_F + "SELECT o_orderkey, coalesce(n, 0) AS findings, coalesce(bad, 0) AS non_compliant FROM orders LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (sev >= 3) AS bad FROM f WHERE status = 'O' GROUP BY 1) ON report_id = o_orderkey")
def _(t: Tables) -> DataFrame:
    counts = findings(t).filter("status = 'O'").groupBy("report_id").agg(F.count("*").alias("n"), F.count_if(F.col("sev") >= 3).alias("bad"))
    return t("orders").join(counts, F.col("report_id") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("findings"), F.coalesce("bad", F.lit(0)).alias("non_compliant"))


@query("jon09_skip_saved_keys", WITH_F + "SELECT report_id, pos FROM f WHERE tool = 'N' AND NOT EXISTS (SELECT 1 FROM f g WHERE g.tool = 'R' AND g.plugin_id = f.plugin_id AND g.host = f.host)")
def _(t: Tables) -> DataFrame:
    f = findings(t)
    saved = f.filter("tool = 'R'").select("plugin_id", "host")
    return f.filter("tool = 'N'").join(saved, ["plugin_id", "host"], "left_anti").select("report_id", "pos")


# Aggregations


@query("agg01_count_by_report", WITH_F + "SELECT report_id, count(*) AS n FROM f GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return findings(t).groupBy("report_id").agg(F.count("*").alias("n"))


@query("agg02_filtered_count", WITH_F + "SELECT report_id, count(*) FILTER (status = 'O' AND sev >= 3) AS n FROM f GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return findings(t).groupBy("report_id").agg(F.count_if((F.col("status") == "O") & (F.col("sev") >= 3)).alias("n"))


@query("agg03_total", "SELECT count(*) AS n, ceil(count(*) / 50.0)::BIGINT AS pages FROM events WHERE event_type = 'click'")
def _(t: Tables) -> DataFrame:
    return t("events").filter("event_type = 'click'").agg(F.count("*").alias("n"), F.ceil(F.count("*") / 50.0).alias("pages"))


@query("agg04_distinct_sources", "SELECT DISTINCT source FROM documents")
def _(t: Tables) -> DataFrame:
    return t("documents").select("source").distinct()


@query("agg05_severity_histogram", WITH_F + "SELECT s.severity, count(f.severity) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN f ON f.severity = s.severity AND f.quantity < 10 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    # one row of counts, then one row for each severity, so that those without findings are there
    counts = findings(t).filter("quantity < 10").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in S.RANKS])
    return counts.unpivot([], list(S.RANKS), "severity", "n")


@query("agg06_sorted_sets", WITH_F + "SELECT report_id, list_sort(list(DISTINCT host))::VARCHAR[] AS hosts, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools FROM f WHERE sev = 4 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    f = findings(t).filter("sev = 4").groupBy("report_id")
    return f.agg(F.array_sort(F.collect_set("host")).cast("array<string>").alias("hosts"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))


@query("agg08_first_titles", WITH_F + "SELECT report_id, array_to_string(list(plugin_id ORDER BY pos, plugin_id)[1:3], ',') AS titles FROM f GROUP BY 1")
def _(t: Tables) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("pos", "plugin_id")))
    return findings(t).groupBy("report_id").agg(F.array_join(F.transform(F.slice(items, 1, 3), lambda s: s["plugin_id"].cast("string")), ",").alias("titles"))


@query("agg09_open_severity_counts", WITH_F + "SELECT count(*) FILTER (sev = 4) AS critical, count(*) FILTER (sev = 3) AS high, count(*) FILTER (sev = 2) AS medium, count(*) FILTER (sev = 1) AS low, count(*) FILTER (sev = 0) AS info FROM f WHERE status = 'O'")
def _(t: Tables) -> DataFrame:
    return findings(t).filter("status = 'O'").agg(*[F.count_if(F.col("sev") == v).alias(k.lower()) for k, v in S.RANKS.items()])


@query("agg13_scan_dates", WITH_F + "SELECT report_id, strftime(min(seen), '%Y-%m-%d') || ' to ' || strftime(max(seen), '%Y-%m-%d') AS dates FROM f GROUP BY 1")
def _(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return findings(t).groupBy("report_id").agg(F.concat_ws(" to ", day(F.min("seen")), day(F.max("seen"))).alias("dates"))


@query("agg14_session_sums", "SELECT user_id, count(*) AS events, round(sum(value), 2) AS value, max(value) AS most, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"), F.max("value").alias("most"), F.countDistinct("event_type").alias("kinds"))


@query("agg15_map_merge", "SELECT user_id, array_to_string(list(event_type || '=' || n ORDER BY event_type), ';') AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string")))), ";").alias("kinds"))


@query("agg17_truncated_percent", WITH_F + "SELECT report_id, floor(count(*) FILTER (status = 'F') / greatest(count(*), 1) * 100)::INT AS percent FROM f GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return findings(t).groupBy("report_id").agg(S.percent(F.count_if(F.col("status") == "F"), F.count("*")).alias("percent"))


@query("agg18_rates", "SELECT user_id, round(sum(value) / greatest(count(*), 1), 2) AS avg_value, round(count(*) / greatest(sum(value), 0.1), 2) AS per_value FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    n, v = F.count("*"), F.sum("value")
    return t("events").groupBy("user_id").agg(F.round(v / F.greatest(n, F.lit(1)), 2).alias("avg_value"), F.round(n / F.greatest(v, F.lit(0.1)), 2).alias("per_value"))


@query("agg21_confusion", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels), h AS (SELECT count(*) FILTER (n_chars >= 300) / greatest(count(*), 1) AS hit FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND lang IS NOT NULL)
SELECT tp, fp, fn, tn, round(hit, 4) AS retrieval_recall, round((tp + tn) / greatest(tp + fp + fn + tn, 1), 4) AS accuracy, round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 4) AS f1 FROM c, h""")
def _(t: Tables) -> DataFrame:
    said, true = F.col("quality") == 1, F.col("toxic") == 0
    c = t("labels").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    ratio = lambda a, b: F.round(F.expr(a) / F.greatest(F.expr(b), F.lit(1)), 4)
    # of the rows for which a chunk had to be found, those where it was; here long documents stand for those
    found = t("labels").filter(said).join(t("documents").filter("lang IS NOT NULL").select("doc_id", "n_chars"), "doc_id")
    hit = found.agg(F.round(F.count_if(F.col("n_chars") >= 300) / F.greatest(F.count("*"), F.lit(1)), 4).alias("retrieval_recall"))
    return c.crossJoin(F.broadcast(hit)).select("tp", "fp", "fn", "tn", "retrieval_recall", ratio("tp + tn", "tp + fp + fn + tn").alias("accuracy"), ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"), ratio("2 * tp", "2 * tp + fp + fn").alias("f1"))


@query("agg22_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 5")
def _(t: Tables) -> DataFrame:
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t("orders").withColumn("n", n).filter("n > 5").select("o_orderkey")


@query("agg24_row_collapse", WITH_F + "SELECT plugin_id, host, min(score) AS low, max(score) AS high, count(*) AS n, array_to_string(list_sort(list(DISTINCT tool)), ',') AS refs FROM f GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return findings(t).groupBy("plugin_id", "host").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("refs"))


@query("agg26_dominant_type", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    """Of equally frequent kinds the one that is met first."""
    n = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return R.first_of(n, ["source"], [-F.col("n"), F.col("first")]).select("source", "lang")


@query("agg27_set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    o = t("orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey").subtract(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("agg28_top_risks", WITH_F + "SELECT report_id, pos, score FROM f ORDER BY (tool = 'R') DESC, score DESC, report_id, pos LIMIT 5")
def _(t: Tables) -> DataFrame:
    return findings(t).orderBy((F.col("tool") == "R").desc(), F.desc("score"), "report_id", "pos").limit(5).select("report_id", "pos", "score")


# Windows, order, sets


@query("win01_most_severe_per_key", WITH_F + "SELECT report_id, plugin_id, pos, sev FROM (SELECT *, row_number() OVER (PARTITION BY report_id, plugin_id ORDER BY sev DESC, pos) AS r FROM f) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return R.first_of(findings(t).select("report_id", "plugin_id", "pos", "sev"), ["report_id", "plugin_id"], [-F.col("sev"), F.col("pos")])


@query("win02_first_across_files", WITH_F + "SELECT plugin_id, host, report_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY plugin_id, host ORDER BY report_id, pos) AS r FROM f) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return R.first_of(findings(t).select("plugin_id", "host", "report_id", "pos"), ["plugin_id", "host"], [F.col("report_id"), F.col("pos")])


@query("win03_latest_checkpoint", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win05_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events")
def _(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t("events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("section"))


@query("win09_row_chunks", """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
c AS (SELECT r.*, unnest(range(greatest(0, ceil((i - 4) / 4.0)::BIGINT), i // 4 + 1)) AS chunk FROM r)
SELECT conv_id, chunk::INT AS chunk, min(i)::INT AS first, count(*) AS n, array_to_string(list(turn ORDER BY i), ',') AS values FROM c GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return R.chunks(t("conversations").select("conv_id", "turn"), "turn", 5, 1, "turn", ["conv_id"])


@query("win11_share_of_best", WITH_F + "SELECT report_id, pos, round(score / nullif(max(score) OVER (PARTITION BY report_id), 0), 4) AS share FROM f")
def _(t: Tables) -> DataFrame:
    top = F.nullif(F.max("score").over(W.partitionBy("report_id")), F.lit(0.0))
    return findings(t).select("report_id", "pos", F.round(F.col("score") / top, 4).alias("share"))


@query("srt01_newest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(t: Tables) -> DataFrame:
    return t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@query("srt02_page", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def _(t: Tables) -> DataFrame:
    return R.page(t("events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 3, 20).select("event_id")


@query("srt09_newest_per_role", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations) WHERE r <= 50")
def _(t: Tables) -> DataFrame:
    return R.newest_per(t("conversations"), ["role"], [F.desc("conv_id"), F.desc("turn")], 50).select("conv_id", "turn")


@query("set01_union_of_logs", """SELECT * FROM ((SELECT 'order' AS kind, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)
UNION ALL (SELECT 'event', event_id FROM events ORDER BY ts DESC, event_id LIMIT 50) UNION ALL (SELECT 'chat', conv_id FROM conversations ORDER BY conv_id DESC, turn LIMIT 50))""")
def _(t: Tables) -> DataFrame:
    top = lambda df, kind, col, *order: df.orderBy(*order).limit(50).select(F.lit(kind).alias("kind"), F.col(col).alias("id"))
    o = top(t("orders"), "order", "o_orderkey", F.desc("o_orderdate"), "o_orderkey")
    return o.unionByName(top(t("events"), "event", "event_id", F.desc("ts"), "event_id")).unionByName(top(t("conversations"), "chat", "conv_id", F.desc("conv_id"), "turn"))


@query("set02_left_biased_union", "SELECT c_custkey AS id, 'customer' AS origin FROM customer UNION ALL SELECT DISTINCT user_id, 'event' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def _(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("id"))
    e = t("events").select(F.col("user_id").alias("id")).filter("id IS NOT NULL").distinct().join(c, "id", "left_anti")
    return c.withColumn("origin", F.lit("customer")).unionByName(e.withColumn("origin", F.lit("event")))


@query("set06_equal_sets", "WITH s AS (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber <= 3)) AS a, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber > 3)) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, coalesce(a, []) = coalesce(b, []) AS same FROM s")
def _(t: Tables) -> DataFrame:
    """Whether two selections of one owner hold the same values, in any order and however often."""
    chosen = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("l_returnflag"))))
    early = F.col("l_linenumber") <= 3
    return t("lineitem").groupBy("l_suppkey").agg((chosen(early) == chosen(~early)).alias("same"))


# Scalar rules


@query("scl01_severity_words", "SELECT o_orderkey, CASE WHEN upper(o_orderpriority) LIKE '%CRIT%' THEN 'CRITICAL' WHEN upper(o_orderpriority) LIKE '%HIGH%' THEN 'HIGH' WHEN upper(o_orderpriority) LIKE '%MED%' THEN 'MEDIUM' WHEN upper(o_orderpriority) LIKE '%LOW%' THEN 'LOW' ELSE 'INFO' END AS severity FROM orders")
def _(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", S.normalised(F.col("o_orderpriority")).alias("severity"))


@query("scl15_risk_score", "SELECT p_partkey, (4 * (p_size % 5 + 1 + p_size % 3 + 1 + p_size % 4 + 1 + 3 + 2))::INT AS risk, CASE WHEN 4 * (p_size % 5 + p_size % 3 + p_size % 4 + 8) >= 80 THEN 'CRITICAL' WHEN 4 * (p_size % 5 + p_size % 3 + p_size % 4 + 8) >= 60 THEN 'HIGH' WHEN 4 * (p_size % 5 + p_size % 3 + p_size % 4 + 8) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM part")
def _(t: Tables) -> DataFrame:
    part = lambda n: F.col("p_size") % n + 1
    risk = S.risk_score(part(5), part(3), part(4), F.lit(3), F.lit(2))
    return t("part").select("p_partkey", risk.alias("risk"), S.risk_band(risk).alias("band"))


@query("snk10_retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _(t: Tables) -> DataFrame:
    e = t("events").select("event_id", "ts")
    last = e.agg(F.max("ts").alias("last"))  # one row; stands for the clock
    return e.crossJoin(F.broadcast(last)).filter("ts >= last - INTERVAL 1 DAY").select("event_id")


@query("snk03_upsert_latest", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, (vec_id % 3 = 0)::INT AS version FROM embeddings UNION ALL SELECT -vec_id - 1, label, 1 FROM embeddings WHERE vec_id % 50 = 0")
def _(t: Tables) -> DataFrame:
    """Vectors by their keys: new ones take the place of old ones, others stay or come in."""
    e = t("embeddings").select("vec_id", "label", F.lit(0).alias("version"))
    again = e.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    fresh = e.filter("vec_id % 50 = 0").withColumn("vec_id", -F.col("vec_id") - 1)
    return stores.merged(e, again.unionByName(fresh).withColumn("version", F.lit(1)), ["vec_id"], ["version"])
