"""Queries on sources, sinks and preparation."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tarnish.operators import prep, profile
from tarnish.plans import sql
from tarnish.plans.registry import query, rounded
from tarnish.session import staging_dir
from tarnish.sources import tables, views

FEATURES = ("s_nation", "c_region", "p_brand", "ship_month", "lane_group", "l_quantity", "l_discount")
SEED = 42


def _fresh(spark) -> str:
    return os.path.join(staging_dir(spark), f"out-{uuid.uuid4().hex}")


@query("S1_load_typed", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
 strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def load_typed(spark, sf):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    return tables.load(spark, f"{sf}/orders.parquet", schema).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


_ORDER_LINE = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, {price}, o_orderpriority)"


@query("S1_load_delimited", f"""SELECT o_orderkey, o_custkey, o_totalprice, CAST(NULL AS VARCHAR) AS record FROM orders WHERE o_orderkey % 97 <> 5 AND o_orderkey % 89 <> 7
 UNION ALL SELECT NULL, NULL, NULL, CASE WHEN o_orderkey % 97 = 5 THEN {_ORDER_LINE.format(price="'n/a'")}
 ELSE concat_ws(',', o_orderkey, o_custkey, o_orderstatus) END FROM orders WHERE o_orderkey % 97 = 5 OR o_orderkey % 89 = 7""")
def load_delimited(spark, sf):
    orders, path = views.table(spark, sf, "orders"), _fresh(spark)
    line = F.when(F.expr("o_orderkey % 97 = 5"), F.expr(_ORDER_LINE.format(price="'n/a'")))
    line = line.when(F.expr("o_orderkey % 89 = 7"), F.expr("concat_ws(',', o_orderkey, o_custkey, o_orderstatus)"))
    line = line.otherwise(F.expr(_ORDER_LINE.format(price="o_totalprice")))
    header = "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderpriority"
    orders.select(line.alias(header)).write.csv(path, header=True, sep="\x01")  # whole lines, so that some can be malformed
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    rows, bad = tables.load_delimited(spark, path, schema, keep=["o_orderkey", "o_custkey", "o_totalprice"])
    return rows.unionByName(bad, allowMissingColumns=True)


@query("S2_pruned_scan", "SELECT l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem")
def pruned_scan(spark, sf):
    rows = views.table(spark, sf, "lineitem")
    return tables.prune(rows, blacklist=("l_linestatus", "l_tax", "l_shipdate"), id_token="key", allowed_ids=("l_suppkey",))


@query("S3_row_ids", f"WITH {sql.LINES} SELECT row_id, l_orderkey, l_linenumber FROM lines")
def row_ids(spark, sf):
    return views.lines(spark, sf).select("row_id", "l_orderkey", "l_linenumber")


@query("S3_duplicate_ids", f"WITH {sql.LINES} SELECT row_id, count(*) AS n FROM lines GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return tables.duplicate_ids(views.lines(spark, sf))


@query("S4_materialised_dataset", f"WITH {sql.SHIP} SELECT duration_bucket, ship_month, count(*) AS n FROM ship GROUP BY 1, 2")
def materialised_dataset(spark, sf):
    path = _fresh(spark)
    first = tables.materialise(views.build_shipments(spark, sf), path)
    again = tables.materialise(first, path)
    return again.groupBy("duration_bucket", "ship_month").agg(F.count(F.lit(1)).alias("n"))


@query("S5_append_results", f"WITH {sql.EXPERIMENT} SELECT config, level, replica, model, im, ip, ih FROM res")
def append_results(spark, sf):
    path = _fresh(spark)
    res = views.experiment(spark, sf).select("config", "level", "replica", "model", "im", "ip", "ih")
    tables.append_results(res.filter("level = 0"), path)
    tables.append_results(res.filter("level > 0"), path)
    return spark.read.schema(res.schema).parquet(path).select(*res.columns)


@query("S6_derived_table_sink", f"WITH {sql.EXPERIMENT} SELECT config, level, count(*) AS n, CAST(sum(im) AS BIGINT) AS im FROM res GROUP BY 1, 2")
def derived_table(spark, sf):
    path = _fresh(spark)
    out = views.experiment(spark, sf).groupBy("config", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("im").alias("im"))
    tables.write_table(out, path, "csv")
    return spark.read.csv(path, schema=out.schema, header=True)


_G = sql.g6("m")


@query("S7_markdown_table", f"""WITH {sql.EXPERIMENT}
SELECT '| ' || concat_ws(' | ', config, {sql.g6('level')}, {_G}, {sql.g6('im')}) || ' |' AS line
FROM (SELECT config, level, round(avg(f1_clean), 4) AS m, CAST(sum(im) AS BIGINT) AS im FROM res GROUP BY 1, 2)""")
def markdown_table(spark, sf):
    report = views.experiment(spark, sf).groupBy("config", "level").agg(
        F.round(F.avg("f1_clean"), 4).alias("m"), F.sum("im").alias("im")
    )
    return tables.markdown_rows(report)


@query("P1_bucketize_right", f"""WITH {sql.SHIP} SELECT duration_bucket, count(*) AS n, min(duration) AS low, max(duration) AS high
FROM ship GROUP BY 1""")
def bucketize(spark, sf):
    binned = views.shipments(spark, sf).withColumn(
        "duration_bucket", prep.bucketize_right(F.col("duration"), views.DURATION_EDGES, views.DURATION_LABELS)
    )
    return binned.groupBy("duration_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("duration").alias("low"), F.max("duration").alias("high")
    )


@query("P2_quantile_bins", """WITH e AS (SELECT quantile_cont(l_extendedprice, 1/3e0) AS a, quantile_cont(l_extendedprice, 2/3e0) AS b FROM lineitem)
SELECT CAST(CASE WHEN l_extendedprice <= a THEN 0 WHEN l_extendedprice <= b THEN 1 ELSE 2 END AS INTEGER) AS bin,
 count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem, e GROUP BY 1""")
def quantile_bins(spark, sf):
    binned = prep.quantile_bins(views.table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", 3, "bin")
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )


@query("P3_drop_missing_target", """SELECT nullif(l_linenumber, 7) AS target, count(*) AS n FROM lineitem
WHERE nullif(l_linenumber, 7) IS NOT NULL GROUP BY 1""")
def drop_missing_target(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.expr("nullif(l_linenumber, 7)").alias("target"))
    return rows.dropna(subset=["target"]).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("P4_feature_blacklist", "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def feature_blacklist(spark, sf):
    return tables.prune(views.table(spark, sf, "orders"), blacklist=("o_orderdate", "o_totalprice"), id_token="key",
                        allowed_ids=("o_custkey",), keep=("o_totalprice",))


@query("P5_drop_empty_columns", "SELECT o_orderkey, o_orderstatus, nullif(o_orderstatus, 'F') AS partly FROM orders")
def drop_empty_columns(spark, sf):
    rows = views.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.expr("nullif(o_orderkey, o_orderkey)").alias("empty"),
        F.expr("nullif(o_orderstatus, 'F')").alias("partly"),
    )
    return prep.drop_empty_columns(rows)


@query("P6_binarise_target", "SELECT CAST(CASE WHEN l_quantity > 15 THEN 1 ELSE 0 END AS INTEGER) AS l_quantity, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def binarise_target(spark, sf):
    rows = prep.binarise_target(views.table(spark, sf, "lineitem").select("l_quantity", "l_returnflag"), "l_quantity")
    return rows.groupBy("l_quantity", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("P7_encode_labels", """SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders""")
def encode_labels(spark, sf):
    return prep.encode_labels(views.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("P8_sample_rows", f"WITH {sql.SHIP} SELECT row_id, duration FROM ({sql.ranked_choice('ship', SEED, None, '1800')})")
def sample_rows(spark, sf):
    return prep.sample_rows(views.shipments(spark, sf).select("row_id", "duration"), 1800, SEED)


@query("P9_stratified_sample", f"""WITH {sql.SHIP} SELECT row_id, duration_bucket FROM (
{sql.ranked_choice('ship', SEED, 'duration_bucket', '(n * 90 + 100) // 200')})""")
def stratified_sample(spark, sf):
    return prep.stratified_sample(views.shipments(spark, sf).select("row_id", "duration_bucket"), "duration_bucket", 45, SEED)


_SMALLEST = "(SELECT min(c) FROM (SELECT count(*) AS c FROM ship GROUP BY duration_bucket))"


@query("P10_balance_classes", f"WITH {sql.SHIP} SELECT row_id, duration_bucket FROM ({sql.ranked_choice('ship', SEED, 'duration_bucket', _SMALLEST)})")
def balance_classes(spark, sf):
    return prep.balance(views.shipments(spark, sf).select("row_id", "duration_bucket"), "duration_bucket", SEED)


@query("P11_balance_capped", f"""WITH {sql.SHIP} SELECT row_id, duration_bucket FROM (
{sql.ranked_choice('ship', SEED, 'duration_bucket', f'least({_SMALLEST}, 1500)')})""")
def balance_capped(spark, sf):
    return prep.balance(views.shipments(spark, sf).select("row_id", "duration_bucket"), "duration_bucket", SEED, cap=1500)


def folds_sql(k: int, name: str = "folded") -> str:
    return f"""{name} AS (SELECT *, CAST((row_number() OVER (PARTITION BY duration_bucket
      ORDER BY {sql.draw(sql.lit(SEED), 'row_id')}, row_id) - 1) % {k} AS INTEGER) AS fold FROM ship)"""


def folded(spark, sf, k: int):
    return prep.assign_folds(views.shipments(spark, sf), "duration_bucket", k, SEED)


@query("P13_stratified_folds", f"WITH {sql.SHIP}, {folds_sql(5)} SELECT row_id, duration_bucket, fold FROM folded")
def stratified_folds(spark, sf):
    return folded(spark, sf, 5).select("row_id", "duration_bucket", "fold")


@query("P14_fold_split", f"""WITH {sql.SHIP}, {folds_sql(3)}
SELECT CASE WHEN fold = 1 THEN 'test' ELSE 'train' END AS side, duration_bucket, count(*) AS n FROM folded GROUP BY 1, 2""")
def fold_split(spark, sf):
    train, test = prep.split_fold(folded(spark, sf, 3), 1)
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side", "duration_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("P15_partition_check", f"""WITH {sql.SHIP}, {folds_sql(3)}
SELECT (SELECT count(*) FROM (SELECT row_id FROM folded WHERE fold <> 1 INTERSECT SELECT row_id FROM folded WHERE fold = 1)) AS shared,
 (SELECT count(*) FROM folded WHERE fold <> 1) + (SELECT count(*) FROM folded WHERE fold = 1) = (SELECT count(*) FROM ship) AS complete""")
def partition_check(spark, sf):
    whole = folded(spark, sf, 3)
    return prep.partition_check(*prep.split_fold(whole, 1), views.shipments(spark, sf))


_GAPS = """gaps AS (SELECT row_id, fold, nullif(l_quantity, 7) AS q, nullif(c_region, 'ASIA') AS r,
 nullif(l_discount, 0.05) AS d FROM folded)"""


def _gaps(spark, sf):
    return folded(spark, sf, 3).select(
        "row_id", "fold", F.expr("nullif(l_quantity, 7)").alias("q"), F.expr("nullif(c_region, 'ASIA')").alias("r"),
        F.expr("nullif(l_discount, 0.05e0)").alias("d"),
    )


@query("P16_impute_mean", f"""WITH {sql.SHIP}, {folds_sql(3)}, {_GAPS}
SELECT row_id, round(coalesce(q, (SELECT avg(q) FROM gaps WHERE fold <> 0)), 6) AS q FROM gaps""")
def impute_mean(spark, sf):
    rows = _gaps(spark, sf)
    train, _ = prep.split_fold(rows, 0)
    means = {c: m for c, (m, _) in prep.fit_means(train, ["q"]).items()}
    return rounded(prep.impute(rows, means).select("row_id", "q"))


@query("P17_impute_mode", f"""WITH {sql.SHIP}, {folds_sql(3)}, {_GAPS}
SELECT row_id, coalesce(r, (SELECT r FROM gaps WHERE fold <> 0 AND r IS NOT NULL GROUP BY r ORDER BY count(*) DESC, r LIMIT 1)) AS r FROM gaps""")
def impute_mode(spark, sf):
    rows = _gaps(spark, sf)
    train, _ = prep.split_fold(rows, 0)
    return prep.impute(rows, prep.fit_modes(train, ["r"])).select("row_id", "r")


@query("P18_impute_median", f"""WITH {sql.SHIP}, {folds_sql(3)}, {_GAPS}
SELECT row_id, round(coalesce(d, (SELECT quantile_cont(d, 0.5) FROM gaps WHERE fold <> 0)), 6) AS d FROM gaps""")
def impute_median(spark, sf):
    rows = _gaps(spark, sf)
    train, _ = prep.split_fold(rows, 0)
    return rounded(prep.impute(rows, prep.fit_medians(train, ["d"])).select("row_id", "d"))


@query("P19_standardise", f"""WITH {sql.SHIP}, {folds_sql(3)}, {_GAPS},
filled AS (SELECT row_id, fold, coalesce(q, (SELECT avg(q) FROM gaps WHERE fold <> 0)) AS q FROM gaps)
SELECT row_id, round((q - (SELECT avg(q) FROM filled WHERE fold <> 0)) / (SELECT stddev_pop(q) FROM filled WHERE fold <> 0), 6) AS q FROM filled""")
def standardise(spark, sf):
    rows = _gaps(spark, sf)
    train, _ = prep.split_fold(rows, 0)
    return rounded(prep.standardise(rows, prep.fit_means(train, ["q"])).select("row_id", "q"))


@query("P21_feature_roles", f"""WITH {sql.SHIP} SELECT 'l_quantity' AS "column", 'numeric' AS role, count(DISTINCT l_quantity) AS n_distinct FROM ship
UNION ALL SELECT 'lane_group', 'numeric', count(DISTINCT lane_group) FROM ship
UNION ALL SELECT 'p_brand', 'categorical', count(DISTINCT p_brand) FROM ship
UNION ALL SELECT 's_nation', 'categorical', count(DISTINCT s_nation) FROM ship""")
def feature_roles(spark, sf):
    rows = views.shipments(spark, sf).select("row_id", "l_quantity", "lane_group", "p_brand", "s_nation")
    numeric, categorical = prep.feature_roles(rows, ["row_id"])
    counts = profile.distinct_counts(rows, [*numeric, *categorical])
    return counts.select("column", F.when(F.col("column").isin(*numeric), "numeric").otherwise("categorical").alias("role"), "n_distinct")


@query("P22_missing_counts", """SELECT count(*) - count(nullif(l_quantity, 7)) AS q, count(*) - count(nullif(l_returnflag, 'A')) AS f,
count(*) - count(l_tax) AS l_tax FROM lineitem""")
def missing_counts(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.expr("nullif(l_quantity, 7)").alias("q"), F.expr("nullif(l_returnflag, 'A')").alias("f"), "l_tax"
    )
    return prep.missing_counts(rows, ["q", "f", "l_tax"])
