"""Queries on dependencies, inconsistency indices and repairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.model import FD, corrupted_columns, redundancy_dependencies
from tarnish.operators import cover, discovery, edges, incons, prep, profile
from tarnish.plans import sql
from tarnish.plans.inputs import BROKEN, CONFIGS, LEVEL, SEED, corrupted, line_repairs
from tarnish.plans.prepare_queries import folded, folds_sql
from tarnish.plans.registry import exact_text, query, rounded
from tarnish.sources import views

POOL = list(views.POOL)
ALL = [*POOL, *redundancy_dependencies(POOL)]
GAPPY = [FD(("a",), "y"), FD(("a", "b"), "y")]


def dirty_sql(config: str = "C4", level: int = LEVEL, seed=SEED, name: str = "dirty") -> str:
    return f"{sql.SHIP},\n{sql.shared('ship', name, corrupted_columns(CONFIGS[config]), level, str(seed))}"


DIRTY = dirty_sql()

# ---- dependencies --------------------------------------------------------------------------------


def _violations_sql(src: str, fds) -> str:
    parts = []
    for i, fd in enumerate(fds, 1):
        known = " AND ".join(f"{c} IS NOT NULL" for c in fd.lhs)
        parts.append(f"SELECT CAST({i} AS INTEGER) AS fd_no, '{fd.name}' AS fd, count(*) AS violations FROM (SELECT 1 FROM {src} "
                     f"WHERE {known} GROUP BY {', '.join(fd.lhs)} HAVING count(DISTINCT {fd.rhs}) > 1)")
    return " UNION ALL ".join(parts)


@query("F1_violating_groups", f"WITH {DIRTY} {_violations_sql('dirty', ALL)}")
def violating_groups(spark, sf):
    return profile.violating_groups(corrupted(spark, sf), ALL)


@query("F1_violating_groups_raw", f"WITH {sql.LINES} {_violations_sql('lines', BROKEN)}")
def violating_groups_raw(spark, sf):
    return profile.violating_groups(views.lines(spark, sf), BROKEN)


_GAPPY = """gappy AS (SELECT nullif(l_suppkey % 10, 3) AS a, l_linenumber AS b,
 CASE WHEN l_suppkey % 10 = 5 THEN NULL ELSE nullif(l_suppkey % 10 + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END, 4) END AS y FROM lineitem)"""


@query("F1_violations_with_missing_values", f"WITH {_GAPPY} {_violations_sql('gappy', GAPPY)}")
def violations_with_gaps(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.expr("nullif(l_suppkey % 10, 3)").alias("a"), F.col("l_linenumber").alias("b"),
        F.expr("case when l_suppkey % 10 = 5 then null else nullif(l_suppkey % 10 + case when l_quantity > 40 then 1 else 0 end, 4) end").alias("y"),
    )
    return profile.violating_groups(rows, GAPPY)


def _certify_sql(src: str, fds) -> str:
    parts = []
    for i, fd in enumerate(fds, 1):
        k = ", ".join(fd.lhs)
        bad = " + ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN 1 ELSE 0 END" for c in (fd.rhs, *fd.redundant))
        gaps = " + ".join(f"count(*) - count({c})" for c in (*fd.lhs, fd.rhs, *fd.redundant))
        parts.append(f"SELECT CAST({i} AS INTEGER) AS fd_no, '{fd.name}' AS fd, count(*) AS n_groups, '{', '.join(fd.redundant)}' AS redundant, "
                     f"CAST(sum(bad) AS BIGINT) AS violations, CAST(sum(gaps) AS BIGINT) AS missing, {str('s_region' not in (*fd.lhs, fd.rhs, *fd.redundant)).lower()} AS usable "
                     f"FROM (SELECT {k}, {bad} AS bad, {gaps} AS gaps FROM {src} GROUP BY {k})")
    return " UNION ALL ".join(parts)


@query("F2_certification_report", f"WITH {sql.SHIP} {_certify_sql('ship', POOL)}")
def certification(spark, sf):
    return profile.certify(views.shipments(spark, sf), POOL, blacklist=("s_region",))


_PAIR = ", ".join(f"f.{c} AS {c}_full, p.{c} AS {c}_prepared" for c in ("n_groups", "violations", "missing"))


@query("F3_certification_full_and_prepared", f"""WITH {sql.SHIP}, prepared AS (
{sql.ranked_choice('ship', 42, 'duration_bucket', '(SELECT min(c) FROM (SELECT count(*) AS c FROM ship GROUP BY duration_bucket))')}),
f AS ({_certify_sql('ship', POOL)}), p AS ({_certify_sql('prepared', POOL)})
SELECT f.fd_no, f.fd, {_PAIR} FROM f JOIN p USING (fd_no)""")
def certification_pair(spark, sf):
    ship = views.shipments(spark, sf)
    return profile.certify_pair(ship, prep.balance(ship, "duration_bucket", 42), POOL)


CANDIDATES = ["l_orderkey", "l_suppkey", "s_nationkey", "s_nation", "s_regionkey", "s_region", "o_custkey", "c_nationkey", "c_nation", "c_regionkey",
              "c_region", "l_partkey", "p_brand", "lane_distance", "lane_group", "ship_day", "ship_month", "l_quantity", "l_discount", "duration",
              "duration_bucket"]


@query("F4_candidate_columns", f"""WITH {sql.SHIP}, counts AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_distinct FROM ship" for c in [*CANDIDATES, 'row_id'])})
SELECT name AS "column", n_distinct, n_distinct > 1 AND n_distinct < (SELECT count(*) FROM ship) AS candidate FROM counts""")
def candidate_columns(spark, sf):
    rows = views.shipments(spark, sf)
    kept = discovery.candidate_columns(rows)
    return profile.distinct_counts(rows).withColumn("candidate", F.col("column").isin(kept))


def _discovery_tables() -> str:
    """For every left side whether any group has two values of each other column, then the columns where none has.

    Columns are numbered by value first, so that grouping and comparing are on integers.
    """
    numbered = ", ".join(f"dense_rank() OVER (ORDER BY {c}) AS {c}" for c in CANDIDATES)
    ctes, picks = [], []
    for size in (1, 2):
        for lhs in combinations(CANDIDATES, size):
            rest = [c for c in CANDIDATES if c not in lhs]
            counts = ", ".join(f"min({c}) = max({c}) AS {c}" for c in rest)
            holds = ", ".join(f"bool_and({c}) AS {c}" for c in rest)
            name = "g_" + "_".join(str(CANDIDATES.index(c)) for c in lhs)
            ctes.append(f"{name} AS (SELECT {holds} FROM (SELECT {counts} FROM coded GROUP BY {', '.join(lhs)}))")
            picks.append(f"SELECT '{' + '.join(lhs)}' AS lhs, rhs, '{size} -> 1' AS kind FROM (UNPIVOT {name} ON {', '.join(rest)} INTO NAME rhs VALUE holds) WHERE holds")
    ship = sql.SHIP.replace("ship AS (", "ship AS MATERIALIZED (")
    return f"WITH {ship},\ncoded AS MATERIALIZED (SELECT {numbered} FROM ship),\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(picks)


@query("F5_discover_dependencies", _discovery_tables())
def discover(spark, sf):
    return discovery.discover(views.shipments(spark, sf), max_lhs=2)


@query("F6_group_statistics", f"WITH {DIRTY} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS fd_no, '{fd.name}' AS fd, count(*) AS n_groups, round(sum(n) / count(*), 6) AS mean_size, max(n) AS max_size "
    f"FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(fd.lhs)})" for i, fd in enumerate(POOL, 1)))
def group_statistics(spark, sf):
    return rounded(profile.group_statistics(corrupted(spark, sf), POOL))


@query("F7_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_tax")))
def distinct_counts(spark, sf):
    rows = views.table(spark, sf, "lineitem")
    return profile.distinct_counts(rows, ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_tax"])


@query("F9_preflight_gate", f"WITH {sql.SHIP}, v AS ({_violations_sql('ship', ALL)}), {sql.conflict_pairs('ship', 'pairs', [views.AREA])}\n"
       "SELECT CAST((SELECT sum(violations) FROM v) AS BIGINT) AS violations, CAST((SELECT count(*) FROM pairs) AS VARCHAR) AS im")
def preflight(spark, sf):
    ship = views.shipments(spark, sf)
    incons.require_clean(ship, POOL)
    profile.require_certified(profile.certify(ship, POOL))
    im = incons.im(ship, POOL).scalar()
    counted = profile.violating_groups(ship, ALL).agg(F.sum("violations").alias("violations"))
    return exact_text(counted.withColumn("im", im))


# ---- indices -------------------------------------------------------------------------------------


def _pairs(src: str, columns) -> str:
    return f"(SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM {src} GROUP BY {', '.join(columns)}))"


@query("I1_equal_pairs", f"WITH {DIRTY} SELECT CAST({_pairs('dirty', ('s_nationkey', 'lane_distance'))} AS VARCHAR) AS equal_pairs")
def equal_pairs(spark, sf):
    return exact_text(incons.equal_pairs(corrupted(spark, sf), ["s_nationkey", "lane_distance"]))


@query("I2_im_single_dependency", f"WITH {DIRTY}, {sql.conflict_pairs('dirty', 'pairs', [views.LANE])}\nSELECT CAST(count(*) AS VARCHAR) AS im FROM pairs")
def im_single(spark, sf):
    return exact_text(incons.im_single(corrupted(spark, sf), views.LANE))


@query("I3_im_several_dependencies", f"WITH {DIRTY}, {sql.conflict_pairs('dirty', 'pairs', POOL)}\nSELECT CAST(count(*) AS VARCHAR) AS im FROM pairs")
def im_several(spark, sf):
    return exact_text(incons.im(corrupted(spark, sf), POOL))


@query("I3_im_raw_lines", f"WITH {sql.LINES}, {sql.conflict_pairs('lines', 'pairs', BROKEN)}\nSELECT CAST(count(*) AS VARCHAR) AS im FROM pairs")
def im_raw(spark, sf):
    return exact_text(incons.im(views.lines(spark, sf), BROKEN))


@query("I4_rows_in_conflict", f"WITH {DIRTY}, {sql.covers('dirty', 'marked', [views.LANE])}\nSELECT row_id, conflict_1 AS in_conflict FROM marked")
def rows_in_conflict(spark, sf):
    return incons.conflict_mask(corrupted(spark, sf), [views.LANE]).select("row_id", "in_conflict")


@query("I5_ip_several_dependencies", f"WITH {sql.LINES}, {sql.covers('lines', 'marked', BROKEN)}\nSELECT count(*) FILTER (WHERE {sql.any_of('conflict', 2)}) AS ip FROM marked")
def ip_several(spark, sf):
    return incons.ip(views.lines(spark, sf), BROKEN)


@query("I6_ih_single_exact", f"WITH {DIRTY}, {sql.covers('dirty', 'marked', [views.BAND])}\nSELECT count(*) FILTER (WHERE cover_1) AS ih FROM marked")
def ih_single(spark, sf):
    return incons.ih_single(corrupted(spark, sf), views.BAND)


@query("I7_cover_mask_single", f"WITH {DIRTY}, {sql.covers('dirty', 'marked', [views.BAND])}\nSELECT row_id, cover_1 AS in_cover FROM marked")
def cover_single(spark, sf):
    return incons.cover_mask(corrupted(spark, sf), [views.BAND]).select("row_id", "in_cover")


def _blocks_sql(src: str, fds) -> str:
    parts = []
    for i, fd in enumerate(fds, 1):
        k = ", ".join(fd.lhs)
        key = "concat_ws('|', " + k + ")"
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS fd_no, {key} AS group_key, CAST({fd.rhs} AS VARCHAR) AS value, n,
  CAST(sum(n) OVER (PARTITION BY {k} ORDER BY {sql.draw("'=' || CAST(" + fd.rhs + " AS VARCHAR)")}, CAST({fd.rhs} AS VARCHAR)
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS BIGINT) AS later, CAST(sum(n) OVER (PARTITION BY {k}) - n AS BIGINT) AS others,
  count(*) OVER (PARTITION BY {k}) AS classes
  FROM (SELECT {k}, {fd.rhs}, count(*) AS n FROM {src} GROUP BY {k}, {fd.rhs})""")
    return ("SELECT fd_no, group_key, value, n, coalesce(later, 0) AS later, others FROM ("
            + " UNION ALL ".join(parts) + ") WHERE classes > 1")


@query("I8_conflict_blocks", f"WITH {DIRTY} {_blocks_sql('dirty', POOL)}")
def conflict_blocks(spark, sf):
    return incons.conflict_blocks(corrupted(spark, sf), POOL)


@query("I8_conflict_edges_from_blocks", f"WITH {DIRTY}, " + ", ".join(sql.conflict_pairs("dirty", f"p{i}", [fd]) for i, fd in enumerate(POOL, 1)) + "\n"
       + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS fd_no, CAST(count(*) AS VARCHAR) AS edges FROM p{i}" for i in range(1, len(POOL) + 1)))
def edges_from_blocks(spark, sf):
    blocks = incons.conflict_blocks(corrupted(spark, sf), POOL)
    found = F.sum(F.col("n").cast("decimal(19,0)") * F.col("later")).cast("decimal(38,0)")
    return exact_text(blocks.groupBy("fd_no").agg(found.alias("edges")))


SAMPLED, SAMPLE_SEED = 500, 11


def _sampled_sql(i: int, fd: FD) -> str:
    """All pairs in the order of their numbers, of which the drawn ones are shown."""
    g = "md5(concat_ws('|', " + ", ".join(f"'=' || CAST({c} AS VARCHAR)" for c in fd.lhs) + "))"
    drawn = [sql.draw(f"'{SAMPLE_SEED}'", "'edge'", f"'{part}'", "range") for part in (0, 1)]
    return f"""r{i} AS (SELECT row_id, {g} AS g, '=' || CAST({fd.rhs} AS VARCHAR) AS c FROM dirty),
s{i} AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {sql.draw('c')}, c, {sql.draw('row_id')}, row_id) AS place FROM r{i}),
e{i} AS (SELECT row_number() OVER (ORDER BY a.g, a.place, b.place) - 1 AS k, a.row_id AS row_u, b.row_id AS row_v
  FROM s{i} a JOIN s{i} b ON a.g = b.g AND a.c <> b.c AND a.place < b.place),
d{i} AS (SELECT DISTINCT ({drawn[0]}::HUGEINT * 1000000000000000000 + {drawn[1]}) % (SELECT count(*) FROM e{i}) AS k FROM range({SAMPLED}))"""


@query("I8_sampled_edges", f"WITH {DIRTY}, " + ", ".join(_sampled_sql(i, fd) for i, fd in enumerate(POOL, 1)) + "\n"
       + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS fd_no, CAST(k AS VARCHAR) AS k, row_u, row_v FROM e{i} JOIN d{i} USING (k)" for i in range(1, len(POOL) + 1)))
def sampled_edges(spark, sf):
    dirty = corrupted(spark, sf)
    parts = [edges.sample_edges(dirty, fd, SAMPLED, SAMPLE_SEED).withColumn("fd_no", F.lit(i)) for i, fd in enumerate(POOL, 1)]
    return exact_text(reduce(DataFrame.unionByName, parts))


@query("I9_cover_several_dependencies", f"WITH {DIRTY}, {sql.covers('dirty', 'marked', POOL)}\nSELECT row_id, {sql.any_of('cover', 4)} AS in_cover FROM marked")
def cover_several(spark, sf):
    return incons.cover_mask(corrupted(spark, sf), POOL).select("row_id", "in_cover")


_COVER_COUNTS = ", ".join(f"count(*) FILTER (WHERE cover_{i})" for i in (1, 2, 3, 4))


@query("I10_repair_bounds", f"WITH {DIRTY}, {sql.covers('dirty', 'marked', POOL)}\n"
       f"SELECT greatest({_COVER_COUNTS}) AS ih_min, count(*) FILTER (WHERE {sql.any_of('cover', 4)}) AS ih FROM marked")
def repair_bounds(spark, sf):
    return incons.ih_bounds(corrupted(spark, sf), POOL)


def _matching_sql(src: str, fds) -> str:
    """The passes of the matching with explicit places per group, the definition of the operator."""
    parts, free = [], f"(SELECT row_id, {', '.join(dict.fromkeys(c for f in fds for c in f.columns))} FROM {src})"
    for i, fd in enumerate(fds, 1):
        k = ", ".join(fd.lhs)
        parts.append(f"free_{i} AS (SELECT * FROM {free})")
        parts.append(f"""classes_{i} AS (SELECT {k}, {fd.rhs}, count(*) AS n FROM free_{i} GROUP BY {k}, {fd.rhs})""")
        parts.append(f"""sized_{i} AS (SELECT *, sum(n) OVER (PARTITION BY {k}) AS g_n, max(n) OVER (PARTITION BY {k}) AS g_max,
          row_number() OVER (PARTITION BY {k} ORDER BY n DESC, {fd.rhs}) = 1 AS leads FROM classes_{i})""")
        parts.append(f"""placed_{i} AS (SELECT f.row_id, g_n, g_max, row_number() OVER (PARTITION BY {', '.join('f.' + c for c in fd.lhs)}
          ORDER BY leads DESC, {sql.draw(f"'=' || CAST(f.{fd.rhs} AS VARCHAR)")}, CAST(f.{fd.rhs} AS VARCHAR), {sql.draw('f.row_id')}, f.row_id) - 1 AS place
          FROM free_{i} f JOIN sized_{i} s ON {' AND '.join(f'f.{c} = s.{c}' for c in fd.columns)})""")
        parts.append(f"""matched_{i} AS (SELECT row_id, CAST({i} AS INTEGER) AS matched_by FROM placed_{i}
          WHERE place < least(g_n // 2, g_n - g_max)
             OR (place >= greatest(g_max, g_n // 2) AND place < greatest(g_max, g_n // 2) + least(g_n // 2, g_n - g_max)))""")
        free = f"free_{i} WHERE row_id NOT IN (SELECT row_id FROM matched_{i})"
    union = " UNION ALL ".join(f"SELECT * FROM matched_{i}" for i in range(1, len(fds) + 1))
    parts.append(f"matched AS ({union})")
    return ",\n".join(parts)


@query("I11_matched_rows", f"WITH {DIRTY}, {_matching_sql('dirty', POOL)}\nSELECT d.row_id, matched_by FROM dirty d LEFT JOIN matched m ON d.row_id = m.row_id")
def matched_rows(spark, sf):
    return cover.matched_rows(corrupted(spark, sf), POOL)


@query("I11_matching_cover", f"WITH {sql.LINES}, {_matching_sql('lines', BROKEN)}\n"
       "SELECT (SELECT count(*) FROM lines) AS n_rows, count(*) // 2 AS ih_lower, count(*) AS ih_approx FROM matched")
def matching_cover(spark, sf):
    return cover.matching_cover(views.lines(spark, sf), BROKEN)


def _component_sql(src: str, fds) -> str:
    """CTE repairs: components by reachability over shared violating groups, with counts and bounds."""
    columns = list(dict.fromkeys(c for f in fds for c in f.columns))
    flags = ", ".join(f"any_value(conflict_{i}) AS conflict_{i}, any_value(cover_{i}) AS cover_{i}" for i in range(1, len(fds) + 1))

    def text(names):
        return ", ".join(f"'=' || CAST({c} AS VARCHAR)" for c in names)

    groups = " UNION ALL ".join(
        f"SELECT vertex, concat_ws('|', '{i}', {text(fd.lhs)}) AS grp FROM vertices WHERE conflict_{i}" for i, fd in enumerate(fds, 1)
    )
    single = ", ".join(f"coalesce(sum(n) FILTER (WHERE cover_{i}), 0)" for i in range(1, len(fds) + 1))
    return f"""vertices AS (SELECT md5(concat_ws('|', {text(columns)})) AS vertex, {', '.join(columns)}, count(*) AS n, count(m.row_id) AS matched, {flags}
 FROM marked s LEFT JOIN matched m ON s.row_id = m.row_id WHERE {sql.any_of('conflict', len(fds))} GROUP BY {', '.join(columns)}),
shared AS ({groups}),
reach(vertex, root) AS (SELECT vertex, vertex FROM vertices UNION SELECT b.vertex, r.root FROM reach r JOIN shared a ON r.vertex = a.vertex JOIN shared b ON a.grp = b.grp),
bounds AS (SELECT component, count(*) AS vertices, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(matched) AS BIGINT) AS ih_approx,
 CAST(greatest(sum(matched) // 2, {single}) AS BIGINT) AS lower, CAST(least(sum(matched), sum(n) FILTER (WHERE {sql.any_of('cover', len(fds))})) AS BIGINT) AS upper
 FROM vertices JOIN (SELECT vertex, min(root) AS component FROM reach GROUP BY 1) USING (vertex) GROUP BY component),
repairs AS (SELECT *, CASE WHEN lower = upper THEN lower END AS ih_exact, lower = upper AS solved FROM bounds)"""


_COMPONENTS = f"WITH RECURSIVE {sql.LINES}, {sql.covers('lines', 'marked', BROKEN)}, {_matching_sql('lines', BROKEN)}, {_component_sql('lines', BROKEN)}"


@query("I12_exact_repair_components", f"{_COMPONENTS} SELECT * FROM repairs")
def component_repairs(spark, sf):
    return line_repairs(spark, sf)


@query("I12_exact_repair_total", f"""{_COMPONENTS} SELECT count(*) AS components, count(*) FILTER (WHERE solved) AS solved,
 CAST(coalesce(sum(lower), 0) AS BIGINT) AS ih_lower, CAST(coalesce(sum(upper), 0) AS BIGINT) AS ih_upper,
 CASE WHEN coalesce(bool_and(solved), true) THEN CAST(coalesce(sum(lower), 0) AS BIGINT) END AS ih_exact FROM repairs""")
def exact_repair_total(spark, sf):
    return cover.exact_total(line_repairs(spark, sf))


def _im_each(src: str, fds) -> str:
    return ", ".join(f"CAST({_pairs(src, fd.lhs)} - {_pairs(src, fd.columns)} AS VARCHAR) AS im_{i}" for i, fd in enumerate(fds, 1))


@query("I13_all_indices", f"""WITH {DIRTY}, {sql.conflict_pairs('dirty', 'pairs', POOL)}, {sql.covers('dirty', 'marked', POOL)}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE {sql.any_of('conflict', 4)}) AS ip, count(*) FILTER (WHERE {sql.any_of('cover', 4)}) AS ih,
 greatest({_COVER_COUNTS}) AS ih_min, (SELECT CAST(count(*) AS VARCHAR) FROM pairs) AS im, {_im_each('dirty', POOL)} FROM marked""")
def all_indices(spark, sf):
    return exact_text(incons.indices(corrupted(spark, sf), POOL))


_FOLD_FDS = list(POOL)


@query("I14_indices_by_fold", f"""WITH {DIRTY}, {folds_sql(3).replace('FROM ship', 'FROM dirty')},
trained AS (SELECT folded.*, t.f AS train_fold FROM folded JOIN (SELECT unnest(range(0, 3)) AS f) t ON fold <> t.f),
{sql.conflict_pairs('trained', 'pairs', _FOLD_FDS, ['train_fold'])}, {sql.covers('trained', 'marked', _FOLD_FDS, ['train_fold'])},
a AS (SELECT train_fold, count(*) AS im FROM pairs GROUP BY 1),
b AS (SELECT train_fold, count(*) AS n_rows, count(*) FILTER (WHERE {sql.any_of('conflict', 4)}) AS ip, count(*) FILTER (WHERE {sql.any_of('cover', 4)}) AS ih,
  greatest({_COVER_COUNTS}) AS ih_min FROM marked GROUP BY 1)
SELECT CAST(floor(avg(n_rows)) AS BIGINT) AS n_rows, {', '.join(f'round(avg({m}), 4) AS {m}_mean, round(stddev_samp({m}), 4) AS {m}_sd' for m in ('im', 'ip', 'ih', 'ih_min'))}
FROM a JOIN b USING (train_fold)""")
def indices_by_fold(spark, sf):
    rows = prep.assign_folds(corrupted(spark, sf), "duration_bucket", 3, 42)
    return rounded(incons.indices_by_fold(rows, _FOLD_FDS, 3), 4)


@query("I15_cover_removes_violations", f"""WITH {DIRTY}, {sql.covers('dirty', 'marked', POOL)},
kept AS (SELECT * FROM marked WHERE NOT {sql.any_of('cover', 4)}) {_violations_sql('kept', POOL)}""")
def cover_removes_violations(spark, sf):
    return profile.violating_groups(incons.remove_cover(corrupted(spark, sf), POOL), POOL)


LEVELS = (5, 10, 20)


def _levels(spark, sf, config: str):
    versions = [corrupted(spark, sf, config, level).withColumn("level", F.lit(level)) for level in LEVELS]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


def _levels_sql(config: str) -> str:
    columns = corrupted_columns(CONFIGS[config])
    made = ",\n".join(sql.shared("ship", f"dirty_{level}", columns, level, str(SEED)) for level in LEVELS)
    union = " UNION ALL ".join(f"SELECT *, CAST({level} AS INTEGER) AS level FROM dirty_{level}" for level in LEVELS)
    return f"{sql.SHIP},\n{made},\nversions AS ({union})"


def _mechanism_sql(src: str, fds) -> str:
    parts = []
    for i, fd in enumerate(fds, 1):
        k = ", ".join(["level", *fd.lhs])
        parts.append(f"""SELECT level, CAST({i} AS INTEGER) AS fd_no, '{fd.name}' AS fd, count(*) AS n_groups, round(sum(n) / count(*), 6) AS mean_size,
 CAST(max(n) AS BIGINT) AS max_size, CAST(sum(n * (n - 1) // 2) AS VARCHAR) AS same_lhs_pairs, CAST(sum(n * (n - 1) // 2 - same) AS VARCHAR) AS conflicts,
 round(coalesce(sum(n * (n - 1) // 2 - same) / nullif(sum(n * (n - 1) // 2), 0), 0), 6) AS conflict_share,
 CAST(coalesce(sum(CASE WHEN classes > 1 THEN n END), 0) AS BIGINT) AS rows_involved
 FROM (SELECT {k}, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS same, count(*) AS classes
       FROM (SELECT {k}, {fd.rhs}, count(*) AS c FROM {src} GROUP BY {k}, {fd.rhs}) GROUP BY {k}) GROUP BY level""")
    return " UNION ALL ".join(parts)


@query("I16_mechanism", f"WITH {_levels_sql('C4')} {_mechanism_sql('versions', POOL)}")
def mechanism(spark, sf):
    return rounded(exact_text(incons.mechanism(_levels(spark, sf, "C4"), POOL, ["level"])))


@query("I17_mechanism_fidelity", f"""WITH {_levels_sql('C1')}, {sql.conflict_pairs('versions', 'pairs', CONFIGS['C1'], ['level'])}
SELECT level, CAST(count(*) AS VARCHAR) AS conflicts, CAST(count(*) AS VARCHAR) AS im, true AS faithful FROM pairs GROUP BY level""")
def mechanism_fidelity(spark, sf):
    rows = _levels(spark, sf, "C1")
    table = incons.mechanism(rows, CONFIGS["C1"], ["level"])
    return exact_text(incons.mechanism_faithful(table, incons.im(rows, CONFIGS["C1"], ["level"]), ["level"]))


def _repairs(spark, sf):
    """One row per level: matching cover against the exact repair of one dependency."""
    parts = None
    for level in LEVELS:
        rows = corrupted(spark, sf, "C2", level)
        approx = cover.matching_cover(rows, [views.BAND])
        exact = incons.ih_single(rows, views.BAND)
        row = approx.select(F.lit(level).alias("level"), "ih_approx", F.lit(True).alias("solved")).withColumn("ih_exact", exact.scalar())
        parts = row if parts is None else parts.unionByName(row)
    return parts


def _repairs_sql() -> str:
    parts = [f"{_levels_sql('C2')}"]
    selects = []
    for level in LEVELS:
        body = _matching_sql(f"dirty_{level}", [views.BAND])
        for name in ("free_1", "classes_1", "sized_1", "placed_1", "matched_1", "matched AS"):
            body = body.replace(name, f"{name.split(' ')[0]}_l{level}" + (" AS" if name.endswith(" AS") else ""))
        parts.append(body)
        parts.append(sql.covers(f"dirty_{level}", f"marked_l{level}", [views.BAND]))
        selects.append(f"SELECT CAST({level} AS INTEGER) AS level, (SELECT count(*) FROM matched_l{level}) AS ih_approx, "
                       f"(SELECT count(*) FILTER (WHERE cover_1) FROM marked_l{level}) AS ih_exact, true AS solved")
    return ",\n".join(parts) + f",\nrepairs AS ({' UNION ALL '.join(selects)})"


@query("I18_approximate_and_exact_repairs", f"""WITH {_repairs_sql()}
SELECT level, ih_approx, ih_exact, solved, ih_approx - ih_exact AS gap, round(ih_approx / nullif(ih_exact, 0), 6) AS ratio FROM repairs""")
def compare_repairs(spark, sf):
    return rounded(cover.compare_repairs(_repairs(spark, sf)))


@query("I18_component_comparison", f"""{_COMPONENTS} SELECT vertices, count(*) AS instances, count(*) FILTER (WHERE solved) AS n_solved,
 round(avg(ih_approx) FILTER (WHERE solved), 6) AS approx_mean, round(avg(ih_exact), 6) AS exact_mean, min(ih_approx - ih_exact) AS gap_min, max(ih_approx - ih_exact) AS gap_max,
 round(min(ih_approx / ih_exact), 6) AS ratio_min, round(max(ih_approx / ih_exact), 6) AS ratio_max FROM repairs GROUP BY 1""")
def component_comparison(spark, sf):
    return rounded(cover.comparison_summary(cover.compare_repairs(line_repairs(spark, sf)), ["vertices"]))


@query("I19_complete_levels", f"""WITH {sql.EXPERIMENT}, solved AS (SELECT *, ih < 20 AS ok FROM res)
SELECT config, level, replica, model, ih FROM solved s
WHERE NOT EXISTS (SELECT 1 FROM solved t WHERE t.config = s.config AND t.level = s.level AND NOT t.ok)""")
def complete_levels(spark, sf):
    res = views.experiment(spark, sf).withColumn("solved", F.col("ih") < 20)
    return cover.complete_levels(res, ["config", "level"]).select("config", "level", "replica", "model", "ih")
