"""Compare a registered query with its SQL check on the same parquet folder."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(v) -> str:
    return type(v).__name__


def _key(v):
    if v is None:
        return ("0", "")
    if isinstance(v, float):
        return ("1", "nan") if math.isnan(v) else ("1", f"{v:+.5e}")
    return ("1", str(v))


def compare(spark_df, con, sql: str, tol: float = 1e-9):
    """None when equal, else a short description of the first difference."""
    cols = sorted(spark_df.columns)
    got = [tuple(r[c] for c in cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)}\n spark {got[:3]}\n sql   {want[:3]}"
    got.sort(key=lambda r: tuple(map(_key, r)))
    want.sort(key=lambda r: tuple(map(_key, r)))
    for a, b in zip(got, want):
        for c, x, y in zip(cols, a, b):
            if _kind(x) != _kind(y):
                return f"type of {c}: spark {x!r} sql {y!r}\n spark {a}\n sql   {b}"
            if isinstance(x, float):
                if not (x == y or math.isclose(x, y, rel_tol=tol, abs_tol=tol) or (math.isnan(x) and math.isnan(y))):
                    return f"value of {c}: spark {x!r} sql {y!r}\n spark {a}\n sql   {b}"
            elif x != y:
                return f"value of {c}: spark {x!r} sql {y!r}\n spark {a}\n sql   {b}"
    return None
