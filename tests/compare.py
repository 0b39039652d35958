"""Run a registered query and its oracle and compare the rows as multisets."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def check(spark, con, name, entry, sf_dir):
    """Return (rows, problem or None, spark column types, oracle column types)."""
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if entry.sql is None:
        return len(got), None if got else "no rows"
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    for c, t in df.dtypes:
        k = kinds[c].upper()
        if "HUGEINT" in k or "DECIMAL" in k or (t in ("int", "bigint") and "INT" not in k and "NUMBER" not in k) or (
                t == "double" and "DOUBLE" not in k and "NUMBER" not in k):
            return len(got), f"type of {c}: {t} vs {k}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        extra, missing = a - b, b - a
        show = lambda c: [x for x in sorted(c.elements(), key=str)[:3]]
        return len(got), f"{len(got)} vs {len(want)} rows, {sum(extra.values())} differ; got {show(extra)} want {show(missing)} cols {sorted(names)}"
    return len(got), None if got else "no rows"
