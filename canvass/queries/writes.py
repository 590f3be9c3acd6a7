"""Write semantics as table-to-table operators, over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.queries.registry import query
from canvass.sources import tables
from canvass.sources.testdata import table


def _sides(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = c.where("c_custkey % 3 <> 0")
    source = c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit(" new")))
    return target, source


@query("W1_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' new' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def merge(spark, d):
    return tables.merged(*_sides(spark, d), ("c_custkey",))


@query("W1_merge_counts", "SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS inserted, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS updated FROM customer WHERE c_custkey % 2 = 0")
def merge_counts(spark, d):
    return tables.merge_counts(*_sides(spark, d), ("c_custkey",))


@query("W4_compound_merge", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END::DOUBLE AS l_quantity FROM lineitem")
def compound_merge(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    return tables.merged(rows, rows.where("l_linenumber = 1").withColumn("l_quantity", F.lit(0.0)), ("l_orderkey", "l_linenumber"))


@query("W5_scope_replace", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 2 = 0")
def scope_replace(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    fresh = rows.where("o_orderstatus = 'O' and o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("new"))
    return tables.scope_replaced(rows, fresh, F.col("o_orderstatus") == "O")


@query("W6_scoped_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0))")
def scoped_delete(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    gone = rows.where("o_orderkey % 5 = 0").select("o_orderkey")
    return tables.scoped_delete(rows, gone, F.col("o_orderstatus") == "F").select("o_orderkey")


@query("W7_evolved", "SELECT n_nationkey, n_name, NULL::BIGINT AS added FROM nation")
def evolved(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    return tables.evolve(rows, T.StructType([*rows.schema.fields, T.StructField("added", T.LongType())]))


@query("W15_coerced", "SELECT n_nationkey::VARCHAR AS n_nationkey, NULL::DOUBLE AS missing, try_cast(n_name AS INTEGER) AS n_name FROM nation")
def coerced(spark, d):
    return tables.coerce(table(spark, d, "nation"), T.StructType.fromDDL("n_nationkey string, missing double, n_name int"))


@query("W17_conditional_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND NOT (c_custkey % 3 <> 0 AND c_acctbal < 0) THEN c_name || ' new' ELSE c_name END AS c_name, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN FALSE ELSE c_acctbal < 0 END AS edited FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def conditional_upsert(spark, d):
    target, source = _sides(spark, d)
    return tables.merged_keeping(target.withColumn("edited", F.col("c_acctbal") < 0), source.withColumn("edited", F.lit(False)), ("c_custkey",), "edited", ("c_name",))


@query("W19_backfill", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN source END, 'regulations_gov') AS source FROM documents")
def backfill(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"))
    return tables.backfill(rows, "source", "regulations_gov")
