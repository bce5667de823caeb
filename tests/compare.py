"""Compare registered queries with their SQL: python tests/compare.py SF_DIR [PREFIX...]"""

import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        glob = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{glob}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def compare(df, con, sql: str) -> str:
    """'' if equal as multisets of rows with columns sorted by name, else what differs."""
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in res.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"


def main() -> int:
    import __spark_entry__ as entry
    from lexloom.session import local_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    spark, con, bad = local_session(), connect(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, f in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            if name in sqls:
                said = compare(f(spark, sf_dir), con, sqls[name]) or "equal"
            else:
                said = f"no SQL, {f(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1500]}"
        bad += not said.startswith(("equal", "no SQL"))
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
