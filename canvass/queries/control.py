"""Control plane over orders and customers: an order is an analysis request, a customer its docket."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.functions import scores
from canvass.operators import joins
from canvass.operators.export import first_by, newest
from canvass.queries.registry import query
from canvass.sources.testdata import table


def requests(spark, d):
    return table(spark, d, "orders")


@query("J12_without_active", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')")
def without_active(spark, d):
    orders = requests(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    return joins.without_active(table(spark, d, "customer"), orders, "c_custkey", F.col("o_orderstatus") == "O").select("c_custkey")


_LATEST = "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1"


@query("N12_latest_request", _LATEST)
def latest_request(spark, d):
    done = requests(spark, d).where("o_orderstatus = 'F'")
    return first_by(done, "o_custkey", F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("J13_lateral_latest", f"SELECT c.c_custkey, c.c_name, l.o_orderkey FROM customer c JOIN ({_LATEST}) l ON l.o_custkey = c.c_custkey")
def lateral_latest(spark, d):
    return table(spark, d, "customer").join(latest_request(spark, d), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("J16_requests_top_finding", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1) t ON t.o_custkey = c.c_custkey")
def requests_top_finding(spark, d):
    top = first_by(requests(spark, d), "o_custkey", F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("N6_one_per_docket", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def one_per_docket(spark, d):
    return first_by(requests(spark, d), "o_custkey", F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("N7_featured", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_totalprice >= 1000) WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def featured(spark, d):
    rows = requests(spark, d).where("o_totalprice >= 1000")
    first = first_by(rows, "o_custkey", (F.col("o_orderpriority") == "1-URGENT").desc(), F.desc("o_totalprice"), "o_orderkey")
    return first.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_custkey", "o_orderkey")


@query("N9_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    return first_by(requests(spark, d), "o_custkey", F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("J14_scope_fallback", "SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderstatus = 'F' OR NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F')")
def scope_fallback(spark, d):
    """Rows of the preferred kind; all rows of a docket that has none."""
    return joins.scope_or_fallback(requests(spark, d), "o_custkey", "o_orderstatus", "F").select("o_custkey", "o_orderkey")


@query("J17_watchlist", """
WITH w(kind, value) AS (VALUES ('segment', 'building'), ('nation', '7'), ('keyword', '#00000001'))
SELECT c_custkey, max(CASE WHEN w.kind = 'segment' AND lower(c_mktsegment) = w.value THEN 1 WHEN w.kind = 'nation' AND c_nationkey::VARCHAR = w.value THEN 1 WHEN w.kind = 'keyword' AND contains(lower(c_name), w.value) THEN 1 ELSE 0 END) = 1 AS watched
FROM customer, w GROUP BY c_custkey""")
def watchlist(spark, d):
    """The watchlist is a short configured list."""
    w = spark.createDataFrame([("segment", "building"), ("nation", "7"), ("keyword", "#00000001")], "kind string, value string")
    hit = F.when(F.col("kind") == "segment", F.lower("c_mktsegment") == F.col("value")).when(F.col("kind") == "nation", F.col("c_nationkey").cast("string") == F.col("value")).when(
        F.col("kind") == "keyword", F.contains(F.lower("c_name"), F.col("value"))
    ).otherwise(False)
    customers = table(spark, d, "customer")
    found = joins.watched(customers, w, hit).select("c_custkey", F.lit(True).alias("watched"))
    return customers.join(found, "c_custkey", "left").select("c_custkey", F.coalesce("watched", F.lit(False)).alias("watched"))


@query("J18_prior_catalog", "SELECT p_partkey, coalesce(CASE WHEN s.n > 0 THEN 'monitoring' END, 'discovered') AS status, coalesce(s.n, 0)::BIGINT AS requests FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON s.l_partkey = p_partkey")
def prior_catalog(spark, d):
    prior = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("requests"))
    prior = prior.withColumn("status", F.lit("monitoring"))
    found = table(spark, d, "part").select("p_partkey", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("requests"))
    return joins.with_prior(found, prior, "p_partkey", ("status", "requests")).fillna({"status": "discovered", "requests": 0})


@query("S14_catalog_discovery", "SELECT DISTINCT n_name AS agency, k AS keyword FROM nation, (VALUES ('rule'), ('notice')) t(k) WHERE n_regionkey IN (0, 1)")
def catalog_discovery(spark, d):
    """Every agency with every keyword, from configured lists."""
    return table(spark, d, "nation").where("n_regionkey in (0, 1)").select(F.col("n_name").alias("agency"), F.explode(F.array(F.lit("rule"), F.lit("notice"))).alias("keyword")).distinct()


@query("S16_validation_status", "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unreachable' WHEN o_totalprice < 1000 THEN 'empty' WHEN o_totalprice < 100000 THEN 'valid' ELSE 'large' END AS status FROM orders")
def validation_status(spark, d):
    p = F.col("o_totalprice")
    return requests(spark, d).select("o_orderkey", F.when(p.isNull(), "unreachable").when(p < 1000, "empty").when(p < 100000, "valid").otherwise("large").alias("status"))


@query("F9_priority_targets", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND (o_totalprice >= 60000 OR o_orderkey % 10 > 7)")
def priority_targets(spark, d):
    return requests(spark, d).where(F.col("o_orderstatus").isin("O", "P") & ((F.col("o_totalprice") >= 60000) | (F.col("o_orderkey") % 10 > 7))).select("o_orderkey")


_AGENCY = "CASE o_orderkey % 4 WHEN 0 THEN 'FCC' WHEN 1 THEN 'FDA' ELSE 'X' END"


def _agency():
    key = F.col("o_orderkey") % 4
    return F.when(key == 0, "FCC").when(key == 1, "FDA").otherwise("X")


@query("M15_priority", f"""
SELECT o_orderkey, round(least(100, greatest(0, 25.0 * least(1, o_totalprice / 50000.0)
  + CASE WHEN o_orderkey % 9 = 0 THEN 10 ELSE 25.0 * exp(-greatest(0, floor((epoch(TIMESTAMP '2024-01-01') - epoch(o_orderdate)) / 86400)) / 30.0) END
  + 30.0 * least(1, (o_orderkey % 13) / 10.0) + CASE WHEN o_orderstatus = 'O' THEN 15 ELSE 0 END + CASE WHEN {_AGENCY} IN ('FCC', 'EPA', 'CFPB', 'FTC') THEN 5 ELSE 0 END)), 2)::DOUBLE AS priority FROM orders""")
def priority(spark, d):
    date = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    score = scores.priority(F.col("o_totalprice"), date, F.col("o_orderkey") % 13, F.col("o_orderstatus") == "O", _agency(), F.lit("2024-01-01").cast("timestamp"))
    return requests(spark, d).select("o_orderkey", score.alias("priority"))


@query("M16_priority_on_request", f"""
SELECT o_orderkey, least(100, floor(25 * least(1, o_totalprice / 50000.0) + 30 * least(1, (o_orderkey % 13) / 10.0) + 30 + CASE WHEN {_AGENCY} IN ('FCC', 'EPA', 'CFPB', 'FTC') THEN 5 ELSE 0 END + 0.5))::DOUBLE AS priority FROM orders""")
def priority_on_request(spark, d):
    return requests(spark, d).select("o_orderkey", scores.priority_on_request(F.col("o_totalprice"), F.col("o_orderkey") % 13, _agency()).alias("priority"))


@query("M17_runtime", """
WITH s AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS ecfs, greatest(1, floor(o_totalprice / 10)) AS n FROM orders),
m AS (SELECT o_orderkey, floor(n / CASE WHEN ecfs THEN 220 ELSE 250 END * 10 + 0.5) / 10 AS i, floor(n / CASE WHEN ecfs THEN 4000 ELSE 17 END * 10 + 0.5) / 10 AS p, floor(n / 1200 * 10 + 0.5) / 10 AS e FROM s)
SELECT o_orderkey, floor(4 + i + p + e + 4 + 2 + 0.5)::BIGINT AS minutes,
  CASE greatest(4.0, i, p, e) WHEN 4.0 THEN 'setup' WHEN i THEN 'ingestion' WHEN p THEN 'parsing' ELSE 'embedding' END AS bottleneck FROM m""")
def runtime(spark, d):
    source = F.when(F.col("o_orderkey") % 2 == 0, "ecfs").otherwise("regulations_gov")
    stages = scores.stage_minutes(source, F.col("o_totalprice") / 10)
    return requests(spark, d).select("o_orderkey", scores.total_minutes(stages).alias("minutes"), scores.bottleneck(stages).alias("bottleneck"))


@query("M18_projection", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax < 0.05 OR l_quantity < 0.5 THEN 60.0 ELSE greatest(l_quantity, 60.0 * (1 - least(1, greatest(0, (l_tax - 0.05) / 0.35))) + l_quantity / l_tax * least(1, greatest(0, (l_tax - 0.05) / 0.35))) END, 6)::DOUBLE AS projected,
  CASE WHEN l_tax < 0.05 OR l_quantity < 0.5 THEN 'low' WHEN l_tax >= 0.4 THEN 'high' WHEN l_tax >= 0.15 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem""")
def projection(spark, d):
    q, t = F.col("l_quantity"), F.col("l_tax")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scores.projected_minutes(q, t, F.lit(60.0)), 6).alias("projected"), scores.projection_confidence(q, t).alias("confidence")
    )


@query("M19_progress", """
SELECT l_orderkey, round(avg((least(1, n / 5.0) + least(1, q / 100.0) + least(1, q / 200.0) + CASE WHEN n > 3 THEN 1 ELSE 0 END + least(1, n / 7.0)) / 5), 6)::DOUBLE AS progress
FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) GROUP BY l_orderkey""")
def progress(spark, d):
    n, q, f = F.col("n"), F.col("q"), scores.fraction
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    parts = [f(n, F.lit(5.0)), f(q, F.lit(100.0)), f(q, F.lit(200.0)), f(F.when(n > 3, 5).otherwise(0), F.lit(5.0)), f(n, F.lit(7.0))]
    return rows.select("l_orderkey", F.round(sum(parts, F.lit(0.0)) / 5, 6).alias("progress"))


@query("M24_watch_coverage", "SELECT o_orderkey, CASE CASE o_orderkey % 4 WHEN 0 THEN 'analyzed' WHEN 1 THEN 'baseline_only' WHEN 2 THEN 'queued' END WHEN 'analyzed' THEN 'Analyzed' WHEN 'baseline_only' THEN 'Baseline Only' WHEN 'queued' THEN 'Monitoring Active' ELSE 'No coverage' END AS coverage FROM orders")
def watch_coverage(spark, d):
    key = F.col("o_orderkey") % 4
    status = F.when(key == 0, "analyzed").when(key == 1, "baseline_only").when(key == 2, "queued")
    return requests(spark, d).select("o_orderkey", scores.watch_coverage(status).alias("coverage"))


@query("A24_per_topic", "SELECT c_mktsegment AS topic, count(*) AS n FROM customer GROUP BY 1")
def per_topic(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("A26_topic_totals", "SELECT r_name AS topic, n_name AS agency, count(*) AS dockets, round(sum(c_acctbal), 2)::DOUBLE AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def topic_totals(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("r_name").alias("topic"), F.col("n_name").alias("agency")).agg(F.count(F.lit(1)).alias("dockets"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("A27_by_status", "SELECT l_linestatus AS status, count(*) AS n, sum(l_quantity)::DOUBLE AS total FROM lineitem GROUP BY 1")
def by_status(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("total"))


@query("T3_max_clusters", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def max_clusters(spark, d):
    return requests(spark, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("T2_max_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def max_rows(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(50).select("doc_id")


@query("T8_labelled_counts", "SELECT 'nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def labelled_counts(spark, d):
    out = None
    for name in ("nation", "region", "supplier"):
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("T9_topic_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def topic_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("T10_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("T11_keep_first", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 1")
def keep_first(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))


@query("T12_suggestions", "SELECT lower(c_mktsegment) AS href, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def suggestions(spark, d):
    """The first of each address without regard to case."""
    return table(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("href")).agg(F.min("c_custkey").alias("c_custkey"))


@query("T13_search", """
SELECT kind, name FROM (SELECT 0 AS o, 'topic' AS kind, r_name AS name FROM region WHERE r_name ILIKE '%a%' UNION ALL SELECT 1, 'docket', n_name FROM nation WHERE n_name ILIKE '%a%') ORDER BY o, name LIMIT 12""")
def search(spark, d):
    """Topics before dockets, twelve in all."""
    topics = table(spark, d, "region").where(F.col("r_name").ilike("%a%")).select(F.lit(0).alias("o"), F.lit("topic").alias("kind"), F.col("r_name").alias("name"))
    dockets = table(spark, d, "nation").where(F.col("n_name").ilike("%a%")).select(F.lit(1).alias("o"), F.lit("docket").alias("kind"), F.col("n_name").alias("name"))
    return topics.union(dockets).orderBy("o", "name").limit(12).select("kind", "name")


@query("T6_catalog_by_priority", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 50")
def catalog_by_priority(spark, d):
    """The 50 first of the catalog, by priority."""
    rows = newest(requests(spark, d), 50, F.desc("o_totalprice"), "o_orderkey")
    return rows.select("o_orderkey", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("T6_newest_requests", "SELECT o_orderkey FROM orders WHERE o_custkey = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_requests(spark, d):
    """A user's 20 latest requests."""
    return newest(requests(spark, d).where("o_custkey = 1"), 20, F.desc("o_orderdate"), "o_orderkey").select("o_orderkey")
