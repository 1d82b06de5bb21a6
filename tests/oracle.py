"""Runs a query and its SQL over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "asDict"):
        x = list(x.asDict().values())
    if isinstance(x, dict):
        x = list(x.values())
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else x


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(str([plain(r[c]) for c in columns]) for r in df.collect())


def duck_rows(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.sql(sql)
    columns = sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    return columns, sorted(str([plain(r[i]) for i in at]) for r in got.fetchall())


def plain_outline(points, tolerance):
    """Thinning by the definition, recursively; a closed ring is then split at its farthest points until it has four."""

    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def farthest(a, b):
        return max(((far(points[i], points[a], points[b]), -i) for i in range(a + 1, b)), default=(0, 0))

    def thin(a, b):
        d, i = farthest(a, b)
        return thin(a, -i) | thin(-i, b) if d > tolerance else {a, b}

    stays = thin(0, len(points) - 1)
    while points[0] == points[-1] and len(stays) < min(4, len(points)):
        s = sorted(stays)
        _, i, a, b = max((*farthest(a, b), a, b) for a, b in zip(s, s[1:], strict=False) if b - a > 1)
        stays |= thin(a, -i) | thin(-i, b)
    return [points[i] for i in sorted(stays)]
