"""SQL twins of the vector operators: k-means with its rounds written out."""

from __future__ import annotations

#: floor(sum / count) of integers, where // cuts towards zero
_MEAN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _components(keep: str, scale: int) -> str:
    return f"""
    kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, label,
            list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
        FROM embeddings
        WHERE {keep} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    xs AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS p FROM kept)"""


def cluster_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    steps = [
        _components(f"len(embedding) = {dims}", scale),
        f"""
    seeds AS MATERIALIZED (
        SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), vec_id, v) - 1 AS c
        FROM kept QUALIFY c < {k}),
    points0 AS MATERIALIZED (SELECT c, p, x FROM seeds JOIN xs USING (r))""",
    ]
    for t in range(rounds + 1):
        steps.append(f"""
    near{t} AS MATERIALIZED (
        SELECT r, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d
        FROM (SELECT xs.r, q.c, CAST(sum((xs.x - q.x) * (xs.x - q.x)) AS BIGINT) AS d
              FROM xs JOIN points{t} q USING (p) GROUP BY ALL)
        GROUP BY r)""")
        if t < rounds:
            steps.append(f"""
    points{t + 1} AS MATERIALIZED (
        SELECT c, p, {_MEAN} AS x
        FROM (SELECT c, p, sum(x) AS s, count(*) AS n FROM near{t} JOIN xs USING (r) GROUP BY ALL)
        UNION ALL
        SELECT c, p, x FROM points{t} WHERE c NOT IN (SELECT c FROM near{t}))""")
    return f"""
    WITH {",".join(steps)},
    named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS h FROM points{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
        CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        h AS centroid_sha256
    FROM near{rounds} JOIN kept USING (r) JOIN named USING (c)
    """


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64, scale: int = 256) -> str:
    width = dims // parts
    steps = [
        _components(f"len(embedding) = {dims}", scale),
        f"""
    ys AS MATERIALIZED (SELECT r, p // {width} AS part, p % {width} AS p, x FROM xs),
    seeds AS MATERIALIZED (
        SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS c FROM kept QUALIFY c < {entries}),
    points0 AS MATERIALIZED (SELECT part, c, p, x FROM seeds JOIN ys USING (r))""",
    ]
    for t in range(rounds + 1):
        steps.append(f"""
    near{t} AS MATERIALIZED (
        SELECT r, part, min(d * {entries} + c) % {entries} AS c, min(d * {entries} + c) // {entries} AS d
        FROM (SELECT ys.r, part, q.c, CAST(sum((ys.x - q.x) * (ys.x - q.x)) AS BIGINT) AS d
              FROM ys JOIN points{t} q USING (part, p) GROUP BY ALL)
        GROUP BY r, part)""")
        if t < rounds:
            steps.append(f"""
    points{t + 1} AS MATERIALIZED (
        SELECT part, c, p, {_MEAN} AS x
        FROM (SELECT part, c, p, sum(x) AS s, count(*) AS n FROM near{t} JOIN ys USING (r, part) GROUP BY ALL)
        UNION ALL
        SELECT part, c, p, x FROM points{t} WHERE (part, c) NOT IN (SELECT (part, c) FROM near{t}))""")
    return f"""
    WITH {",".join(steps)},
    coded AS (
        SELECT r, string_agg(printf('%02x', c), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
        FROM near{rounds} GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, c, p)) FROM points{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (r)
    """
