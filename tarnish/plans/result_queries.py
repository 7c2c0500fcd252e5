"""Queries on experiment results: aggregation, tests, regression, claims."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.functions.numeric import safe_ratio, t_two_sided
from tarnish.operators import claims, results, stats
from tarnish.plans import sql
from tarnish.plans.registry import query, rounded
from tarnish.sources import views

R = f"WITH {sql.EXPERIMENT}"
MODELS = ("click", "error", "purchase", "signup", "view")
CONFIGS = ("C1", "C2", "C3")
LEVELS = (0, 8, 16, 24, 32, 40)


def res(spark, sf) -> DataFrame:
    return views.experiment(spark, sf)


def r6(column: str, name: str, places: int = 6) -> str:
    return f"round({column}, {places}) AS {name}"


# ---- aggregation ---------------------------------------------------------------------------------


@query("G1_mean_and_deviation", f"{R} SELECT config, model, level, {r6('avg(f1_clean)', 'f1_clean_mean')}, {r6('avg(im)', 'im_mean')}, "
       f"{r6('stddev_samp(f1_clean)', 'f1_clean_sd')}, {r6('stddev_samp(im)', 'im_sd')} FROM res GROUP BY ALL")
def mean_and_deviation(spark, sf):
    return rounded(results.summarise(res(spark, sf), ["config", "model", "level"], ["f1_clean", "im"]))


@query("G2_distinct_points", f"{R} SELECT config, model, level, replica, im FROM res WHERE level <> 0 OR config = 'C1'")
def distinct_points(spark, sf):
    return results.distinct_points(res(spark, sf), "config", "C1").select("config", "model", "level", "replica", "im")


@query("G3_pivot", f"{R} SELECT config, level, " + ", ".join(r6(f"avg(f1_clean) FILTER (WHERE model = '{m}')", m) for m in MODELS) + " FROM res GROUP BY 1, 2")
def pivot(spark, sf):
    return rounded(results.pivot_mean(res(spark, sf), ["config", "level"], "model", MODELS, "f1_clean"))


_CURVE = "curve AS (SELECT config, level, avg(f1_clean) AS clean, avg(f1_dirty) AS dirty FROM res GROUP BY 1, 2), b AS (SELECT config, clean AS base FROM curve WHERE level = 0)"


@query("G4_loss_decomposition", f"""{R}, {_CURVE} SELECT config, level, {r6('clean', 'clean')}, {r6('dirty', 'dirty')}, {r6('base - clean', 'learning_loss')},
{r6('clean - dirty', 'input_loss')}, {r6('base - dirty', 'total_loss')},
{r6('CASE WHEN base - dirty > 0 THEN 100 * (base - clean) / (base - dirty) END', 'learning_percent')} FROM curve JOIN b USING (config)""")
def loss_decomposition(spark, sf):
    return rounded(results.decompose_loss(res(spark, sf), ["config"]))


@query("G4_loss_decomposition_pooled", f"""{R}, curve AS (SELECT level, avg(f1_clean) AS clean, avg(f1_dirty) AS dirty FROM res GROUP BY 1), b AS (SELECT clean AS base FROM curve WHERE level = 0)
SELECT level, {r6('clean', 'clean')}, {r6('dirty', 'dirty')}, {r6('base - clean', 'learning_loss')}, {r6('clean - dirty', 'input_loss')}, {r6('base - dirty', 'total_loss')},
{r6('CASE WHEN base - dirty > 0 THEN 100 * (base - clean) / (base - dirty) END', 'learning_percent')} FROM curve, b""")
def loss_decomposition_pooled(spark, sf):
    return rounded(results.decompose_loss(res(spark, sf)))


_DROPS = "c AS (SELECT config, level, model, avg(f1_clean) AS m FROM res GROUP BY ALL), d AS (SELECT c.*, b.m - c.m AS d FROM c JOIN c b ON b.config = c.config AND b.model = c.model AND b.level = 0)"


@query("G5_drop_from_baseline", f"{R}, {_DROPS} SELECT config, level, " + ", ".join(r6(f"avg(d) FILTER (WHERE model = '{m}')", m) for m in MODELS)
       + f", {r6('avg(d)', 'mean')} FROM d GROUP BY 1, 2")
def drop_from_baseline(spark, sf):
    return rounded(results.drop_from_baseline(res(spark, sf), ["config"], "model", MODELS, "f1_clean"))


@query("G6_tolerance_threshold", f"""{R}, u AS (SELECT config, model, level, f1_clean FROM res UNION ALL SELECT config, 'all models', level, f1_clean FROM res),
c AS (SELECT config, model, level, avg(f1_clean) AS m FROM u GROUP BY ALL),
d AS (SELECT c.config, c.model, c.level, b.m - c.m AS d FROM c JOIN c b ON b.config = c.config AND b.model = c.model AND b.level = 0)
SELECT config, model, max(level) FILTER (WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.config = d.config AND x.model = d.model AND x.level <= d.level AND x.level > 0 AND x.d >= 0.05e0)) AS threshold,
{r6('arg_max(d, level)', 'drop_at_top')} FROM d GROUP BY 1, 2""")
def tolerance_threshold(spark, sf):
    rows = res(spark, sf)
    single = rows.select("config", "model", "level", "f1_clean")
    pooled = rows.select("config", F.lit("all models").alias("model"), "level", "f1_clean")
    return rounded(results.tolerance_threshold(single.unionByName(pooled), ["config", "model"], "f1_clean", limit=0.05))


@query("G7_completeness", f"{R} SELECT count(*) AS n_rows, CAST(450 AS INTEGER) AS expected, count(*) * 2 - count(f1_clean) - count(nullif(ih, 3)) AS missing, count(*) = 450 AS complete FROM res")
def completeness(spark, sf):
    rows = res(spark, sf).withColumn("ih", F.expr("nullif(ih, 3)"))
    return results.completeness(rows, len(MODELS) * len(CONFIGS) * len(LEVELS) * 5, ["f1_clean", "ih"])


@query("G8_monotonicity", f"""{R}, c AS (SELECT config, level, avg(share) AS v FROM res GROUP BY 1, 2),
s AS (SELECT *, v >= lag(v) OVER (PARTITION BY config ORDER BY level) AS up FROM c) SELECT config, bool_and(coalesce(up, true)) AS monotone, count(*) AS n_levels FROM s GROUP BY 1""")
def monotonicity(spark, sf):
    return results.monotone(res(spark, sf), ["config"], "level", "share")


@query("G8_baseline_varies", f"{R} SELECT config, model, {r6('stddev_samp(f1_clean)', 'sd')}, stddev_samp(f1_clean) > 0 AS varies FROM res WHERE level = 0 GROUP BY 1, 2")
def baseline_varies(spark, sf):
    return rounded(results.baseline_varies(res(spark, sf), ["config", "model"], "f1_clean"))


@query("G10_summary_table", f"{R}, c AS (SELECT config, level, avg(f1_clean) AS f1_clean, avg(im) AS im, avg(ip) AS ip FROM res GROUP BY 1, 2), "
       "d AS (SELECT c.*, b.f1_clean - c.f1_clean AS d FROM c JOIN c b ON b.config = c.config AND b.level = 0) SELECT level, "
       + ", ".join(r6(f"max({x}) FILTER (WHERE config = '{c}')", f"{c}_{'drop' if x == 'd' else x}") for c in CONFIGS for x in ("f1_clean", "d", "im", "ip")) + " FROM d GROUP BY 1")
def summary_table(spark, sf):
    return rounded(results.summary_table(res(spark, sf), "config", CONFIGS, ["im", "ip"], "f1_clean"))


@query("G11_ratio_range", f"{R} SELECT count(im / nullif(ip, 0)) AS n, {r6('min(im / nullif(ip, 0))', 'ratio_min')}, {r6('max(im / nullif(ip, 0))', 'ratio_max')} FROM res")
def ratio_range(spark, sf):
    return rounded(results.ratio_range(res(spark, sf), "im", "ip"))


@query("G12_curve_bands", f"{R} SELECT model, level, {r6('avg(im)', 'mean')}, {r6('avg(im) - stddev_samp(im)', 'low')}, {r6('avg(im) + stddev_samp(im)', 'high')} FROM res GROUP BY 1, 2 HAVING avg(im) > 0")
def curve_bands(spark, sf):
    return rounded(results.curve_band(res(spark, sf), ["model"], "im", positive_only=True))


@query("G13_compare_experiments", f"""{R}, u AS (SELECT 'first' AS source, level, f1_clean FROM res WHERE config = 'C1' UNION ALL SELECT 'second', level, f1_clean FROM res WHERE config = 'C3'),
c AS (SELECT source, level, avg(f1_clean) AS m FROM u GROUP BY 1, 2)
SELECT c.source, c.level, {r6('c.m', 'mean')}, round(b.m - c.m, 6) AS "drop" FROM c JOIN c b ON b.source = c.source AND b.level = 0""")
def compare_experiments(spark, sf):
    rows = res(spark, sf)
    return rounded(results.compare_experiments(rows.filter("config = 'C1'"), rows.filter("config = 'C3'"), ("first", "second"), "f1_clean"))


_NEXT = "n AS (SELECT * FROM (VALUES ('C1', 'C2'), ('C2', 'C3')) AS t(lo, hi)), p AS (SELECT a.level, a.model, a.replica, lo || ' -> ' || hi AS comparison, a.f1_clean AS x, b.f1_clean AS y FROM n JOIN res a ON a.config = lo JOIN res b ON b.config = hi AND b.level = a.level AND b.model = a.model AND b.replica = a.replica)"


@query("G14_wins_and_losses", f"{R}, {_NEXT} SELECT comparison, count(*) AS pairs, count(*) FILTER (WHERE y > x) AS better, count(*) FILTER (WHERE y < x) AS worse FROM p GROUP BY 1")
def wins_and_losses(spark, sf):
    return results.wins(res(spark, sf), ["level", "model", "replica"], "f1_clean", "config", CONFIGS)


# ---- tests ---------------------------------------------------------------------------------------

_WELCH = f"""m AS (SELECT config, model, level, count(f1_clean) AS n, avg(f1_clean) AS mean, var_samp(f1_clean) AS v FROM res GROUP BY ALL),
w0 AS (SELECT a.*, b.n AS n0, b.mean AS mean0, b.v AS v0, a.v / a.n + b.v / b.n AS se2 FROM m a JOIN m b ON a.config = b.config AND a.model = b.model AND b.level = 0 WHERE a.level <> 0),
w1 AS (SELECT *, (mean - mean0) / nullif(sqrt(se2), 0) AS t, se2 * se2 / nullif(pow(v / n, 2) / (n - 1) + pow(v0 / n0, 2) / (n0 - 1), 0) AS df FROM w0),
w AS (SELECT *, {sql.t_tail('t', 'df')} AS p FROM w1)"""
_WELCH_COLUMNS = f"""config, model, level, {r6('mean0', 'baseline_mean')}, {r6('sqrt(v0)', 'baseline_sd')}, {r6('mean', 'mean')}, {r6('sqrt(v)', 'sd')},
round(mean0 - mean, 6) AS "drop", {r6('t', 't')}, {r6('p', 'p_value')}, coalesce(p < 0.05, false) AS significant"""


@query("A1_welch_test", f"{R}, {_WELCH} SELECT {_WELCH_COLUMNS} FROM w")
def welch(spark, sf):
    return rounded(stats.welch(res(spark, sf), ["config", "model"], "f1_clean"))


@query("G9_significant_counts", f"{R}, {_WELCH} SELECT config, count(*) AS comparisons, count(*) FILTER (WHERE p < 0.05) AS n_significant FROM w GROUP BY 1")
def significant_counts(spark, sf):
    return results.significant_counts(stats.welch(res(spark, sf), ["config", "model"], "f1_clean"), ["config"])


@query("M11_relevance_synthesis", f"{R}, {_WELCH} SELECT config, {r6('avg(mean0 - mean)', 'drop_mean')}, {r6('min(mean0 - mean)', 'drop_min')}, {r6('max(mean0 - mean)', 'drop_max')}, "
       "count(*) FILTER (WHERE p < 0.05) AS n_significant FROM w WHERE level = 40 GROUP BY 1")
def relevance_synthesis(spark, sf):
    tests = stats.welch(res(spark, sf), ["config", "model"], "f1_clean").filter("level = 40")
    return rounded(results.relevance(tests))


def _paired_sql(keys: str) -> str:
    group = f"{keys}, comparison"
    return f"""g AS (SELECT {group}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(y - x) AS d, var_samp(y - x) AS v FROM p GROUP BY {group}),
h AS (SELECT *, CASE WHEN v > 0 THEN d / sqrt(v / n) END AS t FROM g), k AS (SELECT *, {sql.t_tail('t', '(n - 1e0)')} AS p FROM h)
SELECT {group}, n, {r6('mx', 'mean_fewer')}, {r6('my', 'mean_more')}, {r6('d', 'delta')}, {r6('t', 't')}, {r6('p', 'p_value')}, coalesce(p < 0.05, false) AS significant FROM k"""


@query("A2_paired_test", f"{R}, {_NEXT}, {_paired_sql('level, model')}")
def paired(spark, sf):
    return rounded(stats.paired(res(spark, sf), ["level", "model"], ["replica"], "f1_clean", "config", CONFIGS))


@query("A3_paired_test_pooled", f"{R}, {_NEXT}, {_paired_sql('level')}")
def paired_pooled(spark, sf):
    return rounded(stats.paired(res(spark, sf), ["level"], ["model", "replica"], "f1_clean", "config", CONFIGS))


@query("A4_one_sample_test", f"""{R}, b AS (SELECT config, model, avg(f1_clean) AS base FROM res WHERE level = 0 GROUP BY 1, 2),
m AS (SELECT config, model, level, count(*) AS n, avg(f1_clean) AS m, var_samp(f1_clean) AS v FROM res WHERE level <> 0 GROUP BY ALL),
h AS (SELECT m.*, base, CASE WHEN v > 0 THEN (m - base) / sqrt(v / n) END AS t FROM m JOIN b USING (config, model)), k AS (SELECT *, {sql.t_tail('t', '(n - 1e0)')} AS p FROM h)
SELECT config, model, level, {r6('base', 'baseline')}, {r6('m', 'mean')}, round(base - m, 6) AS "drop", {r6('t', 't')}, {r6('p', 'p_value')}, coalesce(p < 0.05, false) AS significant FROM k""")
def one_sample(spark, sf):
    return rounded(stats.one_sample(res(spark, sf), ["config", "model"], "f1_clean"))


def _rank(value: str, keys: str) -> str:
    return (f"(rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2e0)")


def _corr_p(r: str) -> str:
    t = f"({r} * sqrt((n - 2e0) / (1e0 - {r} * {r})))"
    return f"CASE WHEN n < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0 ELSE {sql.t_tail(f'(CASE WHEN abs({r}) >= 1 THEN NULL ELSE {t} END)', '(n - 2e0)')} END"


_SCOPES = """scoped AS (SELECT model, config, level, im, ip, ih, f1_clean, 'all' AS scope FROM res WHERE level <> 0 OR config = 'C1'
 UNION ALL SELECT model, config, level, im, ip, ih, f1_clean, config FROM res),
long AS (SELECT model, scope, f1_clean AS y, 'im' AS measure, CAST(im AS DOUBLE) AS x FROM scoped UNION ALL SELECT model, scope, f1_clean, 'ip', ip FROM scoped UNION ALL SELECT model, scope, f1_clean, 'ih', ih FROM scoped)"""


@query("A5_A6_correlations", f"""{R}, {_SCOPES}, ranked AS (SELECT *, {_rank('x', 'model, scope, measure')} AS rx, {_rank('y', 'model, scope, measure')} AS ry FROM long),
g AS (SELECT model, scope, measure, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho FROM ranked GROUP BY ALL HAVING count(DISTINCT x) > 1)
SELECT model, scope, measure, n AS n_points, {r6('r', 'pearson_r')}, {r6(_corr_p('r'), 'pearson_p')}, {r6('rho', 'spearman_rho')}, {r6(_corr_p('rho'), 'spearman_p')} FROM g""")
def correlations(spark, sf):
    rows = res(spark, sf)
    found = stats.correlations_by_scope(rows, "model", "config", ["im", "ip", "ih"], "f1_clean", results.distinct_points(rows, "config", "C1"))
    return rounded(found)


@query("A7_t_tail", f"{R}, d AS (SELECT model, config, level, avg(f1_clean) / nullif(stddev_samp(f1_clean), 0) / 10 AS t, count(*) - 0.5e0 AS df FROM res GROUP BY ALL) "
       f"SELECT model, config, level, {r6('t', 't')}, {r6(sql.t_tail('t', 'df'), 'p')} FROM d")
def t_tail(spark, sf):
    grouped = res(spark, sf).groupBy("model", "config", "level").agg(
        (safe_ratio(F.avg("f1_clean"), F.stddev_samp("f1_clean")) / 10).alias("t"), (F.count(F.lit(1)) - F.lit(0.5)).alias("df")
    )
    return rounded(grouped.withColumn("p", t_two_sided("t", "df")).drop("df"))


_LIMIT = "(SELECT min(top) + 0.01e0 FROM (SELECT max(share) AS top FROM pts GROUP BY n_fd))"


@query("A9_common_share_limit", f"{R}, pts AS (SELECT * FROM res WHERE level <> 0 OR config = 'C1' ) SELECT {r6(_LIMIT, 'limit')}")
def common_share_limit(spark, sf):
    points = results.distinct_points(res(spark, sf), "config", "C1")
    return rounded(stats.common_share_limit(points))


def _ols_sql() -> str:
    """Least squares with three regressors from covariances, solved by cofactors."""
    cov = ", ".join(
        f"covar_pop({a}, {b}) * count(*) AS {n}"
        for n, a, b in (("s11", "q", "q"), ("s12", "q", "q2"), ("s13", "q", "k"), ("s22", "q2", "q2"), ("s23", "q2", "k"), ("s33", "k", "k"),
                        ("y1", "q", "y"), ("y2", "q2", "y"), ("y3", "k", "y"), ("yy", "y", "y"))
    )
    return f"""pts AS (SELECT * FROM res WHERE level <> 0 OR config = 'C1'),
d AS (SELECT model, 'all' AS scope, share AS q, share * share AS q2, CAST(n_fd AS DOUBLE) AS k, f1_clean AS y FROM pts
 UNION ALL SELECT model, 'common', share, share * share, n_fd, f1_clean FROM pts WHERE share <= {_LIMIT}),
s AS (SELECT model, scope, count(*) AS n, avg(q) AS m1, avg(q2) AS m2, avg(k) AS m3, avg(y) AS my, {cov} FROM d GROUP BY 1, 2),
c AS (SELECT *, s22 * s33 - s23 * s23 AS a11, s13 * s23 - s12 * s33 AS a12, s12 * s23 - s13 * s22 AS a13,
  s11 * s33 - s13 * s13 AS a22, s12 * s13 - s11 * s23 AS a23, s11 * s22 - s12 * s12 AS a33 FROM s),
i AS (SELECT *, s11 * a11 + s12 * a12 + s13 * a13 AS det FROM c),
b AS (SELECT *, (a11 * y1 + a12 * y2 + a13 * y3) / det AS b1, (a12 * y1 + a22 * y2 + a23 * y3) / det AS b2, (a13 * y1 + a23 * y2 + a33 * y3) / det AS b3 FROM i),
e AS (SELECT *, yy - b1 * y1 - b2 * y2 - b3 * y3 AS rss FROM b),
l AS (SELECT model, scope, n, 1 - rss / yy AS r2, unnest(['intercept', 'share', 'share2', 'n_fd']) AS term,
  unnest([my - b1 * m1 - b2 * m2 - b3 * m3, b1, b2, b3]) AS coef,
  unnest([sqrt(rss / (n - 4) * (1e0 / n + (m1 * m1 * a11 + m2 * m2 * a22 + m3 * m3 * a33 + 2 * (m1 * m2 * a12 + m1 * m3 * a13 + m2 * m3 * a23)) / det)),
   sqrt(rss / (n - 4) * a11 / det), sqrt(rss / (n - 4) * a22 / det), sqrt(rss / (n - 4) * a33 / det)]) AS se FROM e),
t AS (SELECT *, coef / nullif(se, 0) AS t FROM l), p AS (SELECT *, {sql.t_tail('t', '(n - 4e0)')} AS p FROM t)"""


@query("A8_share_regression", f"{R}, {_ols_sql()} SELECT model, scope, term, n AS n_points, {r6('coef', 'coef', 5)}, {r6('se', 'se', 5)}, {r6('r2', 'r2', 5)}, "
       f"{r6('t', 't', 4)}, {r6('p', 'p_value', 5)}, coalesce(p < 0.05, false) AS significant FROM p")
def share_regression(spark, sf):
    fitted = stats.share_regression(results.distinct_points(res(spark, sf), "config", "C1"), "model", "f1_clean")
    places = {"coef": 5, "se": 5, "r2": 5, "t": 4, "p_value": 5}
    return fitted.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in fitted.columns])


@query("A10_comparable_points", f"""{R}, pt AS (SELECT n_fd, level, avg(share) AS q, avg(f1_clean) AS s FROM res WHERE level > 0 GROUP BY 1, 2),
pm AS (SELECT n_fd, level, model, avg(f1_clean) AS m FROM res WHERE level > 0 GROUP BY ALL)
SELECT a.n_fd AS n_fewer, a.level AS level_fewer, b.n_fd AS n_more, b.level AS level_more, {r6('a.q', 'share_fewer')}, {r6('b.q', 'share_more')},
 {r6('a.s', 'score_fewer')}, {r6('b.s', 'score_more')}, {r6('b.q - a.q', 'delta_share')}, {r6('b.s - a.s', 'delta_score')},
 (SELECT count(*) FROM pm x JOIN pm y ON x.model = y.model WHERE x.n_fd = a.n_fd AND x.level = a.level AND y.n_fd = b.n_fd AND y.level = b.level AND y.m > x.m) AS models_better,
 (SELECT count(*) FROM pm x JOIN pm y ON x.model = y.model WHERE x.n_fd = a.n_fd AND x.level = a.level AND y.n_fd = b.n_fd AND y.level = b.level) AS models
FROM pt a JOIN pt b ON b.n_fd > a.n_fd AND abs(b.q - a.q) <= 0.035e0""")
def comparable_points(spark, sf):
    return rounded(stats.comparable_points(res(spark, sf), "f1_clean"))


# ---- grids ---------------------------------------------------------------------------------------


@query("M12_pending_cells", f"""{R}, cells AS (SELECT config, level, replica FROM (SELECT DISTINCT config FROM res), (SELECT DISTINCT level FROM res), (SELECT DISTINCT replica FROM res))
SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM (SELECT config, level, replica FROM res WHERE ih <> 12 GROUP BY ALL HAVING count(*) = 5) d
 WHERE d.config = c.config AND d.level = c.level AND d.replica = c.replica)""")
def pending_cells(spark, sf):
    cells = results.grid(spark, config=CONFIGS, level=LEVELS, replica=range(5))
    finished = res(spark, sf).filter("ih <> 12")
    return results.pending(cells, finished, ["config", "level", "replica"], rows_per_cell=len(MODELS))


@query("M13_shared_baseline", f"""{R} SELECT config, model, level, replica, im, false AS shared FROM res WHERE level <> 0
UNION ALL SELECT c.config, model, level, replica, im, true FROM res, (SELECT DISTINCT config FROM res) c WHERE res.config = 'C1' AND level = 0""")
def shared_baseline(spark, sf):
    once = results.distinct_points(res(spark, sf), "config", "C1").select("config", "model", "level", "replica", "im")
    return results.share_baseline(once, "config", CONFIGS)


@query("M14_configuration_alias", f"{R} SELECT config, model, level, replica, im FROM res UNION ALL SELECT 'concept', model, level, replica, im FROM res WHERE config = 'C2'")
def configuration_alias(spark, sf):
    return results.alias_configuration(res(spark, sf).select("config", "model", "level", "replica", "im"), "config", "C2", "concept")


@query("M15_baseline_gates", f"""{R}, b AS (SELECT * FROM res WHERE level = 0), g AS (SELECT (SELECT min(m) FROM (SELECT avg(f1_clean) AS m FROM b GROUP BY model)) AS lowest_mean,
 max(abs(f1_clean - f1_dirty)) AS gap, max(share) AS dirty_share FROM b)
SELECT {r6('lowest_mean', 'lowest_mean')}, {r6('gap', 'gap')}, {r6('dirty_share', 'dirty_share')}, lowest_mean >= 0.5 AND gap <= 1e-9 AND dirty_share = 0 AS passed FROM g""")
def baseline_gates(spark, sf):
    return rounded(results.baseline_gates(res(spark, sf), "f1_clean", "f1_dirty", "share"))


# ---- claims --------------------------------------------------------------------------------------

_CLAIM_TEXT = """notes AS (SELECT l_orderkey AS doc_id, 'Order ' || l_orderkey || ' holds ' || n || ' lines, total ' || replace(format('{:,}', cents // 100), ',', '.') || ','
  || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' and mean discount 0,' || lpad(CAST(discounts * 100 // n AS VARCHAR), 4, '0') || '; see lines 3, 4' || chr(10) || 'and rate 0 , 05.' AS text
 FROM (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discounts, count(*) AS n
       FROM lineitem GROUP BY 1))"""


def _claims_sql(src: str, decimal: str, thousands: str) -> str:
    """CTE claims (doc_id, i, value, run, runs, gaps): the runs of digits and signs that are numbers."""
    d, t = f"[{decimal}]", f"[{thousands}]"
    blank = f"'([0-9])\\s?{d}\\s?([0-9])', '\\1{decimal}\\2', 'g'"
    signs = f"'[0-9{decimal}{thousands}]+'"
    number = f"len(h) = 2 AND regexp_full_match(h[2], '[0-9]{{1,4}}') AND (regexp_full_match(h[1], '[0-9]+') OR regexp_full_match(h[1], '[0-9]{{1,3}}(?:{t}[0-9]{{3}})+'))"
    return f"""tidy AS (SELECT doc_id, regexp_replace(regexp_replace(text, {blank}), {blank}) AS text FROM {src}),
cut AS (SELECT doc_id, text, regexp_extract_all(text, {signs}) AS runs, regexp_split_to_array(text, {signs}) AS gaps FROM tidy),
each_run AS (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM cut),
halved AS (SELECT *, runs[i] AS run, string_split(regexp_replace(trim(runs[i], '{thousands}'), '{d}$', ''), '{decimal}') AS h FROM each_run),
claims AS (SELECT doc_id, text, i, run, runs, gaps, CAST(replace(h[1], '{thousands}', '') || '.' || h[2] AS DOUBLE) AS value FROM halved WHERE {number})"""


_CONTEXT = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS claim_no, value,
 trim(regexp_replace(substr(text, greatest(0, start - 90) + 1, least(start, 90) + len(run) + 90), '\\s+', ' ', 'g')) AS context
FROM (SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(runs[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start FROM claims)"""


@query("T1_extract_claims", f"WITH {_CLAIM_TEXT}, {_claims_sql('notes', ',', '.')} SELECT doc_id, value, count(*) AS n FROM claims GROUP BY 1, 2")
def extract_claims(spark, sf):
    found = claims.extract_claims(views.statements(spark, sf))
    return found.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("T1_extract_claims_from_documents", f"WITH {_claims_sql('documents', '.', ',')} SELECT doc_id, value, count(*) AS n FROM claims GROUP BY 1, 2")
def extract_from_documents(spark, sf):
    found = claims.extract_claims(views.table(spark, sf, "documents"), decimal=".", thousands=",")
    return found.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("T1_claims_with_context", f"WITH {_CLAIM_TEXT}, {_claims_sql('notes', ',', '.')} {_CONTEXT}")
def claims_with_context(spark, sf):
    return claims.extract_claims(views.statements(spark, sf))


def _published(spark, sf):
    orders = views.table(spark, sf, "orders")
    per_priority = orders.groupBy("o_orderpriority").agg(
        F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / F.count(F.lit(1)) / 100, 2).alias("mean_price"),
        F.count(F.lit(1)).alias("orders"),
    )
    per_line = views.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")).distinct()
    return claims.publish({"priorities": per_priority, "lines": per_line})


_PUBLISHED = """pub AS (SELECT round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100, 2) AS value, 'priorities:mean_price' AS source FROM orders GROUP BY o_orderpriority
 UNION SELECT CAST(count(*) AS DOUBLE), 'priorities:orders' FROM orders GROUP BY o_orderpriority UNION SELECT l_extendedprice, 'lines:price' FROM lineitem UNION SELECT l_discount, 'lines:discount' FROM lineitem),
forms AS (SELECT round(value, 4) AS value, source FROM pub UNION SELECT round(value * 100, 4), source FROM pub UNION SELECT round(value, 1), source FROM pub UNION SELECT round(value, 2), source FROM pub)"""
_SUPPORTED = "EXISTS (SELECT 1 FROM forms f WHERE f.value BETWEEN c.value - greatest(0.0002e0, abs(c.value) * 0.0001e0) AND c.value + greatest(0.0002e0, abs(c.value) * 0.0001e0) AND abs(f.value - c.value) <= greatest(0.0002e0, abs(c.value) * 0.0001e0))"


@query("T2_reconcile_values", f"WITH {_CLAIM_TEXT}, {_claims_sql('notes', ',', '.')}, {_PUBLISHED} SELECT value, {_SUPPORTED} AS supported FROM (SELECT DISTINCT value FROM claims) c")
def reconcile_values(spark, sf):
    return claims.reconcile_values(claims.extract_claims(views.statements(spark, sf)), _published(spark, sf))


@query("T2_unsupported_claims", f"WITH {_CLAIM_TEXT}, {_claims_sql('notes', ',', '.')}, {_PUBLISHED}, u AS (SELECT value FROM (SELECT DISTINCT value FROM claims) c WHERE NOT {_SUPPORTED}) "
       f"SELECT doc_id, value, count(*) AS n FROM claims WHERE value IN (SELECT value FROM u) GROUP BY 1, 2")
def unsupported_claims(spark, sf):
    found = claims.unsupported_claims(claims.extract_claims(views.statements(spark, sf)), _published(spark, sf))
    return found.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("T2_unsupported_in_documents", f"WITH {_claims_sql('documents', '.', ',')}, {_PUBLISHED}, u AS (SELECT value FROM (SELECT DISTINCT value FROM claims) c WHERE NOT {_SUPPORTED}) "
       f"SELECT doc_id, value, count(*) AS n FROM claims WHERE value IN (SELECT value FROM u) GROUP BY 1, 2")
def unsupported_in_documents(spark, sf):
    claimed = claims.extract_claims(views.table(spark, sf, "documents"), decimal=".", thousands=",")
    return claims.unsupported_claims(claimed, _published(spark, sf)).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("T3_provenance_index", f"WITH {_PUBLISHED} SELECT value, string_agg(source, ', ' ORDER BY source) AS sources FROM forms GROUP BY 1")
def provenance(spark, sf):
    return claims.provenance(_published(spark, sf))
