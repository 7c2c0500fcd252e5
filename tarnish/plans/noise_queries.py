"""Queries on controlled corruption."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.functions.hashing import draw
from tarnish.functions.ranking import flag_smallest
from tarnish.model import corrupted_columns
from tarnish.operators import incons, noise, prep, profile
from tarnish.plans import sql
from tarnish.plans.conflict_queries import DIRTY, LEVELS, dirty_sql
from tarnish.plans.inputs import CONFIGS, LEVEL, SEED, corrupted
from tarnish.plans.prepare_queries import folds_sql
from tarnish.plans.registry import exact_text, query, rounded
from tarnish.session import stage
from tarnish.sources import views

POOL = list(views.POOL)
COLUMNS = corrupted_columns(POOL)
SHOWN = ["row_id", *COLUMNS]


@query("N1_choose_rows", f"WITH {sql.SHIP} SELECT row_id FROM ({sql.ranked_choice('ship', 7, None, 'n * 15 // 100')})")
def choose_rows(spark, sf):
    rows = views.shipments(spark, sf).select("row_id").withColumn("_o", draw(7, F.col("row_id")))
    return flag_smallest(rows, [], "_o", "row_id", noise.percent_of(15)).filter("selected").select("row_id")


@query("N2_column_domains", f"WITH {sql.SHIP} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY {sql.draw(c)}, {c}) - 1 AS at, CAST({c} AS VARCHAR) AS value FROM (SELECT DISTINCT {c} FROM ship)"
    for c in ("lane_distance", "ship_month", "c_nation")))
def column_domains(spark, sf):
    columns = ["lane_distance", "ship_month", "c_nation"]
    domains = noise.Domains(views.shipments(spark, sf), columns)
    parts = [
        domains.arrays.select(F.lit(c).alias("column"), F.posexplode(c).alias("at", "e")).select(
            "column", F.col("at").cast("bigint").alias("at"), F.col("e.v").cast("string").alias("value"))
        for c in columns
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("N3_replace_cells_large_domain", f"""WITH {sql.SHIP}, {sql.shared('ship', 'dirty', ['l_partkey', 'o_custkey'], LEVEL, '11')}
SELECT row_id, l_partkey, o_custkey, hit FROM dirty""")
def replace_cells_large(spark, sf):
    rows = views.shipments(spark, sf).select("row_id", "l_partkey", "o_custkey")
    columns = ["l_partkey", "o_custkey"]
    return noise.inject_shared(rows, columns, LEVEL, 11, domains=noise.Domains(rows, columns, small=100))


@query("N4_independent_rows", f"WITH {sql.SHIP}, {sql.independent('ship', 'dirty', POOL, LEVEL, '5')} SELECT {', '.join(SHOWN)} FROM dirty")
def independent_rows(spark, sf):
    return noise.inject_independent(views.shipments(spark, sf).select(*SHOWN), POOL, LEVEL, 5)


@query("N5_right_side_only", f"WITH {sql.SHIP}, {sql.independent('ship', 'dirty', POOL[:2], 20, '5', False)} "
       "SELECT row_id, s_nationkey, c_nationkey, lane_distance, lane_group FROM dirty")
def right_side_only(spark, sf):
    rows = views.shipments(spark, sf).select(*SHOWN)
    out = noise.inject_independent(rows, POOL[:2], 20, 5, corrupt_lhs=False)
    return out.select("row_id", "s_nationkey", "c_nationkey", "lane_distance", "lane_group")


@query("N6_shared_rows", f"WITH {DIRTY} SELECT {', '.join(SHOWN)}, hit FROM dirty")
def shared_rows(spark, sf):
    return corrupted(spark, sf).select(*SHOWN, "hit")


@query("N7_columns_per_configuration", f"WITH {DIRTY}, old AS (SELECT * FROM ship) " + " UNION ALL ".join(
    f"SELECT '{c}' AS config, CAST({n} AS INTEGER) AS \"position\", '{col}' AS \"column\", count(*) AS changed FROM dirty d JOIN old o ON d.row_id = o.row_id "
    f"WHERE d.{col} IS DISTINCT FROM o.{col}"
    for c, fds in CONFIGS.items() for n, col in enumerate(corrupted_columns(fds), 1)))
def columns_per_configuration(spark, sf):
    clean = views.shipments(spark, sf).select(*SHOWN)
    dirty = corrupted(spark, sf).select("row_id", *[F.col(c).alias(f"d_{c}") for c in COLUMNS])
    both = clean.join(dirty, "row_id")
    changed = both.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"d_{c}"))).alias(c) for c in COLUMNS])
    cells = [
        F.struct(F.lit(name).alias("config"), F.lit(n).alias("position"), F.lit(c).alias("column"), F.col(c).alias("changed"))
        for name, fds in CONFIGS.items() for n, c in enumerate(corrupted_columns(fds), 1)
    ]
    return changed.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


@query("N8_level_zero_is_identity", f"WITH {sql.SHIP} SELECT {', '.join(SHOWN)} FROM ship")
def level_zero(spark, sf):
    rows = views.shipments(spark, sf).select(*SHOWN)
    return noise.inject_independent(noise.inject_shared(rows, COLUMNS, 0, SEED).drop("hit"), POOL, 0, SEED)


_DIFFERS = " OR ".join(f"d.{c} IS DISTINCT FROM o.{c}" for c in COLUMNS)


@query("N9_dirty_share", f"""WITH {sql.SHIP}, {sql.independent('ship', 'dirty', POOL, LEVEL, '5')}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_DIFFERS}) AS dirty_rows, round(count(*) FILTER (WHERE {_DIFFERS}) / count(*), 6) AS dirty_share
FROM dirty d JOIN ship o ON d.row_id = o.row_id""")
def dirty_share(spark, sf):
    clean = views.shipments(spark, sf).select(*SHOWN)
    return rounded(noise.dirty_share(clean, noise.inject_independent(clean, POOL, LEVEL, 5), COLUMNS))


@query("N10_modified_rows", f"""WITH {DIRTY} SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_DIFFERS}) AS modified
FROM dirty d JOIN ship o ON d.row_id = o.row_id""")
def modified_rows(spark, sf):
    return noise.modified_rows(views.shipments(spark, sf), corrupted(spark, sf), [c for c in SHOWN if c != "row_id"])


@query("N11_corruption_guarantees", f"""WITH {sql.SHIP}, {folds_sql(3)}, train AS (SELECT * FROM folded WHERE fold <> 0), test AS (SELECT * FROM folded WHERE fold = 0),
{sql.shared('train', 'dirty', COLUMNS, 20, '1020')}
SELECT 'expected_modified_train' AS measure, count(*) * 20 // 100 AS value FROM train
UNION ALL SELECT 'modified_train', count(*) FILTER (WHERE {_DIFFERS}) FROM dirty d JOIN ship o ON d.row_id = o.row_id
UNION ALL SELECT 'modified_test', count(*) FILTER (WHERE {_DIFFERS}) FROM test d JOIN ship o ON d.row_id = o.row_id
UNION ALL SELECT 'violations_test', {' + '.join(f"(SELECT count(*) FROM (SELECT 1 FROM test GROUP BY {', '.join(fd.lhs)} HAVING count(DISTINCT {fd.rhs}) > 1))" for fd in POOL)}""")
def corruption_guarantees(spark, sf):
    clean = views.shipments(spark, sf)
    folded = stage(prep.assign_folds(clean.select(*SHOWN, "duration_bucket"), "duration_bucket", 3, 42))  # read many times
    train, test = prep.split_fold(folded, 0)
    dirty = noise.inject_shared(train, COLUMNS, 20, 1020)
    report = stage(noise.guarantees(train, dirty, clean, test, 20, COLUMNS, POOL))
    noise.require_guarantees(report)
    return report


@query("N12_nested_configurations", f"WITH {dirty_sql('C3', name='small')}, {sql.shared('ship', 'large', COLUMNS, LEVEL, str(SEED))} "
       f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {' OR '.join(f's.{c} IS DISTINCT FROM l.{c}' for c in corrupted_columns(CONFIGS['C3']))}) AS different "
       "FROM small s JOIN large l ON s.row_id = l.row_id")
def nested_configurations(spark, sf):
    return noise.nested_check(corrupted(spark, sf, "C3"), corrupted(spark, sf, "C4"), corrupted_columns(CONFIGS["C3"]))


def _share_rows() -> str:
    selects = []
    for n in (1, 2, 4):
        for level in (5, 10):
            columns = corrupted_columns(POOL[:n])
            differs = " OR ".join(f"d.{c} IS DISTINCT FROM o.{c}" for c in columns)
            selects.append(f"SELECT CAST({n} AS INTEGER) AS n_fd, CAST({level} AS INTEGER) AS level, count(*) FILTER (WHERE {differs}) / count(*) AS share "
                           f"FROM d_{n}_{level} d JOIN ship o ON d.row_id = o.row_id")
    return " UNION ALL ".join(selects)


_SHARE_CTES = ",\n".join(
    sql.independent("ship", f"d_{n}_{level}", POOL[:n], level, "5") for n in (1, 2, 4) for level in (5, 10)
)


@query("N13_expected_dirty_share", f"""WITH {sql.SHIP}, {_SHARE_CTES}, m AS ({_share_rows()})
SELECT n_fd, level, round(share, 6) AS share, round(1 - pow(1 - level / 100e0, n_fd), 6) AS expected,
 round(abs(share - (1 - pow(1 - level / 100e0, n_fd))), 6) AS deviation, abs(share - (1 - pow(1 - level / 100e0, n_fd))) <= 0.01 AS within FROM m""")
def expected_dirty_share(spark, sf):
    clean = views.shipments(spark, sf).select(*SHOWN)
    versions = [(POOL[:n], level) for n in (1, 2, 4) for level in (5, 10)]
    return rounded(noise.expected_share_check(noise.independent_shares(clean, versions, 5)))


@query("N14_single_column_check", f"WITH {DIRTY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE d.{c} IS DISTINCT FROM o.{c}) AS changed, count(*) * {LEVEL} // 100 AS expected, "
    f"abs(count(*) FILTER (WHERE d.{c} IS DISTINCT FROM o.{c}) / count(*) - {LEVEL} / 100e0) <= 0.02 AS as_expected FROM dirty d JOIN ship o ON d.row_id = o.row_id"
    for c in ("lane_group", "s_region", "l_suppkey")))
def single_column_check(spark, sf):
    return noise.column_check(views.shipments(spark, sf), corrupted(spark, sf), ["lane_group", "s_region", "l_suppkey"], LEVEL)


GRID_COLUMNS = corrupted_columns(POOL[:2])
GRID = [(r, level) for r in (0, 1) for level in (0, 5, 20)]


def _grid_sql() -> str:
    made = ",\n".join(sql.shared("ship", f"g_{r}_{level}", GRID_COLUMNS, level, str(100 + r)) for r, level in GRID)
    union = " UNION ALL ".join(
        f"SELECT *, CAST({level} AS INTEGER) AS level, CAST({r} AS INTEGER) AS replica FROM g_{r}_{level}" for r, level in GRID)
    return f"{sql.SHIP},\n{made},\ngrid AS ({union})"


@query("N15_grid_of_dirty_versions", f"WITH {_grid_sql()} SELECT row_id, {', '.join(GRID_COLUMNS)}, level, replica, hit FROM grid")
def grid_of_versions(spark, sf):
    rows = views.shipments(spark, sf).select("row_id", *GRID_COLUMNS)
    return noise.inject_grid(rows, GRID_COLUMNS, [0, 5, 20], [0, 1])


@query("N15_grid_indices", f"""WITH {_grid_sql()}, {sql.conflict_pairs('grid', 'pairs', POOL[:2], ['level', 'replica'])}
SELECT g.level, g.replica, CAST(count(x) AS VARCHAR) AS im FROM (SELECT DISTINCT level, replica FROM grid) g
LEFT JOIN pairs p ON p.level = g.level AND p.replica = g.replica GROUP BY 1, 2""")
def grid_indices(spark, sf):
    rows = views.shipments(spark, sf).select("row_id", *GRID_COLUMNS)
    return exact_text(incons.im(noise.inject_grid(rows, GRID_COLUMNS, [0, 5, 20], [0, 1]), POOL[:2], ["level", "replica"]))


def _per_fold_sql() -> str:
    parts, selects = [], []
    for fold in range(3):
        parts.append(f"train_{fold} AS (SELECT * FROM folded WHERE fold <> {fold})")
        for level in (0, 20):
            parts.append(sql.shared(f"train_{fold}", f"t_{fold}_{level}", GRID_COLUMNS, level, str(1000 + 100 * fold + level)))
            selects.append(f"SELECT row_id, CAST({fold} AS INTEGER) AS train_fold, CAST({level} AS INTEGER) AS level, hit FROM t_{fold}_{level}")
    return f"{sql.SHIP}, {folds_sql(3)},\n" + ",\n".join(parts) + ",\nversions AS (" + " UNION ALL ".join(selects) + ")"


@query("N15_hits_per_fold", f"WITH {_per_fold_sql()} SELECT row_id, train_fold, level, hit FROM versions")
def hits_per_fold(spark, sf):
    rows = prep.assign_folds(views.shipments(spark, sf), "duration_bucket", 3, 42)
    return noise.inject_per_fold(rows, GRID_COLUMNS, [0, 20], 3).select("row_id", "train_fold", "level", "hit")


@query("N_violations_grow_with_level", "WITH " + ",\n".join([sql.SHIP, *[sql.shared("ship", f"dirty_{level}", COLUMNS, level, str(SEED)) for level in LEVELS]]) + " "
       + " UNION ALL ".join(
           f"SELECT CAST({level} AS INTEGER) AS level, " + " + ".join(
               f"(SELECT count(*) FROM (SELECT 1 FROM dirty_{level} GROUP BY {', '.join(fd.lhs)} HAVING count(DISTINCT {fd.rhs}) > 1))" for fd in POOL)
           + " AS violations" for level in LEVELS))
def violations_by_level(spark, sf):
    parts = None
    for level in LEVELS:
        counted = profile.violating_groups(corrupted(spark, sf, "C4", level), POOL)
        row = counted.agg(F.lit(level).alias("level"), F.sum("violations").alias("violations"))
        parts = row if parts is None else parts.unionByName(row)
    return parts
