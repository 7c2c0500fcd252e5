"""The same views, draws and corruptions as plain SQL, to check every registered query independently."""

from __future__ import annotations

from collections.abc import Sequence

from tarnish.model import FD, corrupted_columns
from tarnish.sources.views import DURATION_EDGES, DURATION_LABELS


def draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def lit(value) -> str:
    return f"'{value}'"


LINES = """lines AS (
  SELECT *, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                CAST(round(l_extendedprice * 100) AS BIGINT))) AS row_id
  FROM lineitem)"""

_BANDS = " ".join(
    f"WHEN duration > {low}" + (f" AND duration <= {high}" if high else "") + f" THEN '{name}'"
    for low, high, name in zip(DURATION_EDGES, DURATION_EDGES[1:], DURATION_LABELS, strict=False)
)
SHIP = f"""{LINES},
ship AS (
  SELECT row_id, l_orderkey, l_suppkey, s_nationkey, sn.n_name AS s_nation, sn.n_regionkey AS s_regionkey,
         sr.r_name AS s_region, o_custkey, c_nationkey, cn.n_name AS c_nation, cn.n_regionkey AS c_regionkey,
         cr.r_name AS c_region, l_partkey, p_brand, lane_distance, lane_distance // 250 + 1 AS lane_group,
         strftime(l_shipdate, '%Y-%m-%d') AS ship_day, strftime(l_shipdate, '%Y-%m') AS ship_month,
         l_quantity, l_discount, duration,
         CASE {_BANDS} END AS duration_bucket
  FROM (SELECT *, lane_distance // 8 + 30 + CAST(l_quantity AS INTEGER) % 10 AS duration
        FROM (SELECT *, CAST((s_nationkey * 37 + c_nationkey * 91) % 60 * 50 + 50 AS INTEGER) AS lane_distance
              FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
              JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey))
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey)"""

EXPERIMENT = """res AS (
  SELECT 'C' || (c + 1) AS config, CAST(CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS INTEGER) AS n_fd,
         CAST(step * 8 AS INTEGER) AS level, replica, model,
         1e0 - cents / (n * 20011e0) - step * 0.02e0 AS f1_clean,
         1e0 - cents / (n * 20011e0) - step * 0.02e0 - half / (n * 40009e0) AS f1_dirty,
         step * (c + 2) / 25e0 + (n % 7) / 1000e0 AS share,
         CAST(CASE WHEN step = 0 THEN 0 ELSE cents * step // 100 END AS BIGINT) AS im,
         CAST(CASE WHEN step = 0 THEN 0 ELSE n * step END AS BIGINT) AS ip,
         CAST(CASE WHEN step = 0 THEN 0 ELSE half // 5000 END AS BIGINT) AS ih
  FROM (SELECT CAST(event_id // 5 % 3 AS INTEGER) AS c, user_id % 6 AS step, CAST(event_id % 5 AS INTEGER) AS replica,
               event_type AS model, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents,
               CAST(sum(CASE WHEN event_id % 2 = 0 THEN cents ELSE 0 END) AS BIGINT) AS half
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
        GROUP BY 1, 2, 3, 4))"""


def hit_rows(src: str, name: str, level: int, seed: str) -> str:
    return f"""{name} AS (SELECT row_id FROM (
      SELECT row_id, row_number() OVER (ORDER BY {draw(lit(seed), 'row_id')}, row_id) AS rn, count(*) OVER () AS n FROM {src})
      WHERE rn <= n * {level} // 100)"""


def value_lists(src: str, name: str, columns: Sequence[str]) -> str:
    lists = ", ".join(
        f"(SELECT list({c} ORDER BY {draw(c)}, {c}) FROM (SELECT DISTINCT {c} FROM {src} WHERE {c} IS NOT NULL)) AS {c}"
        for c in columns
    )
    return f"{name} AS (SELECT {lists})"


def replaced(values: str, column: str, seed: str, row: str = "s") -> str:
    """The value that takes the place of a hit cell."""
    drawn = f"v.{column}[1 + {draw(lit(seed), lit(column), row + '.row_id')} % (len(v.{column}) - 1)]"
    return f"CASE WHEN {drawn} IS NOT DISTINCT FROM {row}.{column} THEN v.{column}[len(v.{column})] ELSE {drawn} END"


def shared(src: str, out: str, columns: Sequence[str], level: int, seed: str) -> str:
    """CTEs that corrupt the same rows of `src` in all columns; `out` has an extra column hit."""
    new = ", ".join(
        f"CASE WHEN h.row_id IS NULL THEN s.{c} ELSE {replaced('v', c, seed)} END AS {c}" for c in columns
    )
    return f"""{hit_rows(src, out + '_hits', level, seed)},
{value_lists(src, out + '_values', columns)},
{out} AS (SELECT s.* REPLACE ({new}), h.row_id IS NOT NULL AS hit
  FROM {src} s CROSS JOIN {out}_values v LEFT JOIN {out}_hits h ON s.row_id = h.row_id)"""


def independent(src: str, out: str, fds: Sequence[FD], level: int, seed: str, corrupt_lhs: bool = True) -> str:
    """CTEs that corrupt rows chosen anew for each dependency, one after the other."""
    parts = [value_lists(src, f"{out}_values", corrupted_columns(fds, corrupt_lhs))]
    current = src
    for i, fd in enumerate(fds, 1):
        mark, columns = f"{seed}|{i}", corrupted_columns([fd], corrupt_lhs)
        new = ", ".join(
            f"CASE WHEN h.row_id IS NULL THEN s.{c} ELSE {replaced('v', c, mark)} END AS {c}" for c in columns
        )
        target = out if i == len(fds) else f"{out}_{i}"
        parts.append(hit_rows(src, f"{out}_hits_{i}", level, mark))
        parts.append(f"""{target} AS (SELECT s.* REPLACE ({new})
  FROM {current} s CROSS JOIN {out}_values v LEFT JOIN {out}_hits_{i} h ON s.row_id = h.row_id)""")
        current = target
    return ",\n".join(parts)


def conflict_pairs(src: str, out: str, fds: Sequence[FD], by: Sequence[str] = ()) -> str:
    """CTEs that list every conflicting pair by definition: equal on the left, different on the right."""
    selects = []
    for fd in fds:
        equal = " AND ".join(f"a.{c} = b.{c}" for c in [*by, *fd.lhs])
        keys = "".join(f"a.{c}, " for c in by)
        selects.append(f"SELECT {keys}a.no AS x, b.no AS y FROM {out}_rows a JOIN {out}_rows b ON {equal} "
                       f"AND a.{fd.rhs} <> b.{fd.rhs} AND a.no < b.no")
    return f"""{out}_rows AS (SELECT *, row_number() OVER () AS no FROM {src}),
{out} AS ({' UNION '.join(selects)})"""


def group_flags(src: str, fds: Sequence[FD], by: Sequence[str] = ()) -> str:
    """Window expressions conflict_k and cover_k over `src`, the definition of both per row."""
    out = []
    for i, fd in enumerate(fds, 1):
        part = ", ".join([*by, *fd.lhs])
        out.append(f"(min({fd.rhs}) OVER (PARTITION BY {part}) <> max({fd.rhs}) OVER (PARTITION BY {part})) AS conflict_{i}")
    return ", ".join(out)


def covers(src: str, out: str, fds: Sequence[FD], by: Sequence[str] = ()) -> str:
    """CTEs giving `out`: the rows of src with conflict_k and cover_k per dependency."""
    parts, joins, flags = [], [], []
    for i, fd in enumerate(fds, 1):
        keys = [*by, *fd.lhs]
        k = ", ".join(keys)
        parts.append(f"""{out}_kept_{i} AS (SELECT {k}, kept, classes FROM (
          SELECT {k}, {fd.rhs} AS kept, count(*) OVER (PARTITION BY {k}) AS classes,
                 row_number() OVER (PARTITION BY {k} ORDER BY n DESC, {fd.rhs}) AS rn
          FROM (SELECT {k}, {fd.rhs}, count(*) AS n FROM {src} GROUP BY {k}, {fd.rhs})) WHERE rn = 1)""")
        on = " AND ".join(f"s.{c} = k{i}.{c}" for c in keys)
        joins.append(f"JOIN {out}_kept_{i} k{i} ON {on}")
        flags.append(f"k{i}.classes > 1 AS conflict_{i}, s.{fd.rhs} <> k{i}.kept AS cover_{i}")
    parts.append(f"{out} AS (SELECT s.*, {', '.join(flags)} FROM {src} s {' '.join(joins)})")
    return ",\n".join(parts)


def any_of(prefix: str, count: int) -> str:
    return "(" + " OR ".join(f"{prefix}_{i}" for i in range(1, count + 1)) + ")"


def ranked_choice(src: str, seed, stratum: str | None, quota: str) -> str:
    """SELECT of the rows of src within a quota of the smallest draws; the quota may use n (and smallest)."""
    part = f"PARTITION BY {stratum} " if stratum else ""
    return f"""SELECT * EXCLUDE (rn, n) FROM (
      SELECT *, row_number() OVER ({part}ORDER BY {draw(lit(seed), 'row_id')}, row_id) AS rn,
             count(*) OVER ({part}) AS n FROM {src}) WHERE rn <= {quota}"""


def t_tail(t: str, df: str, terms: int = 300) -> str:
    """Two-sided tail of Student's t as a regularised incomplete beta function, by its continued fraction.

    P(|T| > |t|) = I_x(df/2, 1/2) with x = df / (df + t^2). The fraction is worked out from its last term
    backwards; on the other side of the distribution's bulk the symmetric form converges faster.
    """
    x = f"({df} / ({df} + ({t}) * ({t})))"

    def beta(x: str, a: str, b: str) -> str:
        half, even = "(k // 2)", "k % 2 = 0"
        step = (f"CASE WHEN {even} THEN {half} * ({b} - {half}) * {x} / (({a} + k - 1) * ({a} + k)) "
                f"ELSE -({a} + {half}) * ({a} + {b} + {half}) * {x} / (({a} + k - 1) * ({a} + k)) END")
        fraction = f"list_reduce(list_prepend(1e0, list_transform(range({terms}, 0, -1), lambda k: {step})), lambda acc, d: 1e0 + d / acc)"
        log_front = f"{a} * ln({x}) + {b} * ln(1e0 - {x}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})"
        return f"(exp({log_front}) / {a} / {fraction})"

    a = f"(({df}) / 2e0)"
    near = f"{x} < ({a} + 1e0) / ({a} + 2.5e0)"
    return (f"(CASE WHEN ({t}) IS NULL OR ({df}) IS NULL OR ({df}) <= 0 THEN NULL WHEN ({t}) = 0 THEN 1e0 WHEN {near} THEN {beta(x, a, '0.5e0')} "
            f"ELSE 1e0 - {beta(f'(1e0 - {x})', '0.5e0', a)} END)")


def g6(v: str) -> str:
    """%g text of a number, NULL as the empty text, by the engine's own formatting."""
    return f"coalesce(printf('%g', CAST({v} AS DOUBLE)), '')"
