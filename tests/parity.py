"""Compare every registered query with its SQL in DuckDB: rows, columns, values. Usage: python tests/parity.py [sf] [key...]"""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return norm(float(v)) if hasattr(v, "as_tuple") else str(v)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, sf: str, item) -> str:
    """Empty if equal."""
    df = item.run(spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(item.oracle)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        return f"rows {sum(got.values())} and {sum(want.values())}; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
    return "" if got else "empty"


def main() -> None:
    from studyloom.catalog import catalog
    from studyloom.session import local

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    spark, con, bad = local(), duck(sf), 0
    for key, item in catalog().items():
        if item.oracle and (len(sys.argv) < 3 or key in sys.argv[2:]):
            try:
                said = compare(spark, con, sf, item)
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__} {str(e)[:300]}"
            if said:
                bad += 1
                print(key, "->", said, flush=True)
    print("differ:", bad, "of", len(catalog()))


if __name__ == "__main__":
    main()
