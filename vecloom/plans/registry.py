"""Queries by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The points as every SQL text sees them.
POINTS = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def sq(a: str, b: str) -> str:
    """SQL for the sum of squared differences of two lists."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def first_centroids(k: int) -> str:
    return f"c0 AS (SELECT id AS k, x AS u FROM p WHERE id < {k})"


def assigned(name: str, centroids: str, source: str = "p") -> str:
    """A CTE (id, x, k, d): each point with its nearest centroid, the lowest k of ties."""
    return (
        f"{name} AS (SELECT id, x, k, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM "
        f"(SELECT s.id, s.x, c.k, {sq('s.x', 'c.u')} AS d FROM {source} s, {centroids} c)) WHERE r = 1)"
    )


def averaged(name: str, members: str) -> str:
    """A CTE (k, u) of the members' means."""
    return (
        f"{name} AS (SELECT k, list(m ORDER BY i) AS u FROM (SELECT k, i, avg(v) AS m FROM "
        f"(SELECT k, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM {members}) GROUP BY k, i) GROUP BY k)"
    )


def lloyd(k: int, n: int) -> str:
    """CTEs p, c0, a0, c1, a1, ... of n passes; empty clusters vanish (none occur from these starts)."""
    parts = [POINTS, first_centroids(k)]
    for i in range(n):
        parts += [assigned(f"a{i}", f"c{i}"), averaged(f"c{i + 1}", f"a{i}")]
    return "WITH " + ",\n".join(parts)


COORDINATES = "SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS pos, round(v, 6) + 0.0 AS value FROM (SELECT k, unnest(u) AS v, unnest(range(0, len(u))) AS i FROM {})"


def uniform(*parts: str) -> str:
    """SQL for ``lloyd.uniform``: parts are SQL of texts."""
    text = " || ':' || ".join(parts)
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def gaussian(*parts: str) -> str:
    """SQL for ``lloyd.gaussian_value``."""
    return f"(sqrt(ln({uniform(*parts, chr(39) + '1' + chr(39))}) * -2.0) * cos({uniform(*parts, chr(39) + '2' + chr(39))} * 6.283185307179586))"


def text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def plus_plus(k: int, seed: int) -> str:
    """CTEs p, x1, ..., xk: (n, x) of the first n centroids of ``lloyd.plus_plus``."""
    parts = [POINTS, f"x1 AS (SELECT 0 AS n, x FROM p ORDER BY {uniform(repr(str(seed)), text('id'))}, id LIMIT 1)"]
    for n in range(1, k):
        drawn = f"SELECT p.id, p.x, min({sq('p.x', 'c.x')}) AS d FROM p, x{n} c GROUP BY p.id, p.x"
        u = uniform(repr(str(seed)), repr(str(n)), text("id"))
        parts.append(f"x{n + 1} AS (SELECT n, x FROM x{n} UNION ALL SELECT {n}, x FROM (SELECT x FROM ({drawn}) WHERE d > 0 ORDER BY -ln({u}) / d, id LIMIT 1))")
    return "WITH " + ",\n".join(parts)


def projected(name: str, rows: str, radius: float) -> str:
    """CTEs ending in ``name`` (k, u): the rows (k, u) projected onto the L1 ball."""
    return (
        f"{name}o AS (SELECT k, m, sum(m) OVER w AS cum, row_number() OVER w AS r FROM (SELECT k, abs(unnest(u)) AS m FROM {rows}) WINDOW w AS (PARTITION BY k ORDER BY m DESC ROWS UNBOUNDED PRECEDING)),\n"
        f"{name}t AS (SELECT k, greatest(max((cum - {radius}) / r), 0) AS t FROM {name}o GROUP BY k),\n"
        f"{name} AS (SELECT s.k, CASE WHEN list_sum(list_transform(u, lambda v: abs(v))) <= {radius} THEN u ELSE list_transform(u, lambda v: sign(v) * greatest(abs(v) - t, 0)) END AS u FROM {rows} s JOIN {name}t t ON s.k = t.k)"
    )
