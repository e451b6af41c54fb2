"""Compare registered queries with their SQL on the same parquet files (DuckDB, imported only here)."""

from __future__ import annotations

import glob
import math
import os
import time

from .registry import ORACLES, QUERIES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return _norm(v.tolist())
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-5)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark, sf_dir: str, name: str, con=None) -> tuple[bool, str, float]:
    import duckdb
    con = con or duckdb.connect()
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - t0
    if name not in ORACLES:
        return True, f"rows-only {len(rows)}", took
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        t = os.path.splitext(os.path.basename(f))[0]
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{f}'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", took
    order = sorted(names)
    a = sorted((tuple(_norm(r[c]) for c in order) for r in rows), key=repr)
    ix = [names.index(c) for c in order]
    b = sorted((tuple(_norm(r[i]) for i in ix) for r in want), key=repr)
    if len(a) != len(b):
        return False, f"{len(a)} rows vs {len(b)}; {a[:2]} / {b[:2]}", took
    exact = a == b
    bad = [(x, y) for x, y in zip(a, b) if not all(_same(p, q) for p, q in zip(x, y))]
    kinds = lambda rs: [next((type(r[i]).__name__ for r in rs if r[i] is not None), None) for i in range(len(order))]
    if kinds(a) != kinds(b):
        return False, f"types {list(zip(order, kinds(a), kinds(b)))}", took
    if bad:
        return False, f"{len(bad)} of {len(a)} differ: {order} {bad[0]}", took
    return exact, f"{len(a)} rows{'' if exact else ' (close, not equal)'}", took
