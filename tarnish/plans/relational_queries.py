"""Queries on the joins, windows and scalar functions that the analysis relies on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.functions.hashing import fingerprint
from tarnish.functions.joins import attach
from tarnish.functions.numeric import g6, safe_ratio
from tarnish.operators import noise, results
from tarnish.plans import sql
from tarnish.plans.conflict_queries import DIRTY
from tarnish.plans.inputs import corrupted
from tarnish.plans.registry import query, rounded
from tarnish.sources import views


@query("J1_align_clean_and_dirty", f"WITH {DIRTY} SELECT d.row_id, o.lane_distance AS before, d.lane_distance AS after, "
       "o.lane_distance IS DISTINCT FROM d.lane_distance AS dirty FROM ship o JOIN dirty d ON o.row_id = d.row_id")
def align(spark, sf):
    clean = views.shipments(spark, sf).select("row_id", F.col("lane_distance").alias("before"))
    dirty = corrupted(spark, sf).select("row_id", F.col("lane_distance").alias("after"))
    return dirty.join(clean, "row_id").select(
        "row_id", "before", "after", (~F.col("before").eqNullSafe(F.col("after"))).alias("dirty"))


@query("J3_lookup_of_group_values", "SELECT l_orderkey, l_linenumber, l_partkey, n, top FROM lineitem JOIN (SELECT l_partkey, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1) USING (l_partkey)")
def lookup(spark, sf):
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    groups = rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return attach(rows, groups, ["l_partkey"], ["n", "top"], "n", total).drop("l_quantity")


@query("J8_grid_cells", f"WITH {sql.EXPERIMENT}, c AS (SELECT config, level FROM (SELECT DISTINCT config FROM res), (SELECT DISTINCT level FROM res)) "
       "SELECT c.config, c.level, count(replica) AS n FROM c LEFT JOIN res r ON r.config = c.config AND r.level = c.level GROUP BY 1, 2")
def grid_cells(spark, sf):
    cells = results.grid(spark, config=("C1", "C2", "C3"), level=(0, 8, 16, 24, 32, 40))
    rows = views.experiment(spark, sf).groupBy("config", "level").agg(F.count("replica").alias("n"))
    return cells.join(rows, ["config", "level"], "left").select("config", "level", F.coalesce("n", F.lit(0)).alias("n"))


@query("W2_top_value_per_group", "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY 1, 2) WHERE rn = 1")
def top_value(spark, sf):
    counts = views.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("rank"), "p_type")).alias("b"))
    return best.select("p_brand", "b.p_type", (-F.col("b.rank")).alias("n"))


@query("W3_first_row_per_key", f"WITH {sql.EXPERIMENT} SELECT config, level, min(replica) AS replica, arg_min(im, replica * 100 + ascii(model)) AS im FROM res GROUP BY 1, 2")
def first_per_key(spark, sf):
    rows = views.experiment(spark, sf).withColumn("at", F.col("replica") * 100 + F.ascii("model"))
    return rows.groupBy("config", "level").agg(F.min("replica").alias("replica"), F.min_by("im", "at").alias("im"))


@query("W5_ranked_report", f"WITH {sql.EXPERIMENT} SELECT model, round(avg(f1_clean), 6) AS score FROM res GROUP BY 1 ORDER BY score DESC, model LIMIT 3")
def ranked_report(spark, sf):
    scores = views.experiment(spark, sf).groupBy("model").agg(F.round(F.avg("f1_clean"), 6).alias("score"))
    return scores.orderBy(F.desc("score"), "model").limit(3)


@query("W9_row_set_difference", f"WITH {DIRTY} SELECT row_id FROM ship EXCEPT SELECT row_id FROM dirty WHERE hit")
def row_set_difference(spark, sf):
    hits = corrupted(spark, sf).filter("hit").select("row_id")
    return views.shipments(spark, sf).select("row_id").join(hits, "row_id", "left_anti")


@query("X5_row_fingerprints", "SELECT o_orderkey, md5(concat_ws('|', coalesce('=' || o_orderpriority, '~'), coalesce('=' || nullif(o_orderstatus, 'F'), '~'))) AS fp FROM orders")
def row_fingerprints(spark, sf):
    rows = views.table(spark, sf, "orders").withColumn("s", F.expr("nullif(o_orderstatus, 'F')"))
    return rows.select("o_orderkey", fingerprint("o_orderpriority", "s").alias("fp"))


@query("X6_safe_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / nullif(l_tax, 0), 6) AS ratio FROM lineitem")
def ratio(spark, sf):
    rows = views.table(spark, sf, "lineitem")
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", safe_ratio(F.col("l_quantity"), F.col("l_tax")).alias("ratio")))


@query("X8_number_formats", f"SELECT o_orderkey, {sql.g6('o_totalprice')} AS short, format('{{:,}}', CAST(round(o_totalprice) AS BIGINT)) AS thousands FROM orders")
def number_formats(spark, sf):
    rows = views.table(spark, sf, "orders")
    return rows.select("o_orderkey", g6("o_totalprice").alias("short"),
                       F.format_number(F.round("o_totalprice").cast("bigint"), 0).alias("thousands"))


@query("X10_coerce_numbers", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '#(.*)$', 1) AS DOUBLE) AS brand_no, TRY_CAST(p_name AS DOUBLE) AS name_no FROM part")
def coerce_numbers(spark, sf):
    rows = views.table(spark, sf, "part")
    return rows.select("p_partkey", F.regexp_extract("p_brand", "#(.*)$", 1).try_cast("double").alias("brand_no"),
                       F.col("p_name").try_cast("double").alias("name_no"))


@query("N9_dirty_rows_by_source", f"WITH {DIRTY} SELECT o.s_region, count(*) AS n, count(*) FILTER (WHERE d.lane_group IS DISTINCT FROM o.lane_group) AS dirty FROM ship o JOIN dirty d ON o.row_id = d.row_id GROUP BY 1")
def dirty_rows_by_source(spark, sf):
    clean = views.shipments(spark, sf)
    marked = noise.changed_rows(clean, corrupted(spark, sf), ["lane_group"])
    return clean.select("row_id", "s_region").join(marked, "row_id").groupBy("s_region").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("dirty").alias("dirty"))
