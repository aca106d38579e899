"""Compare registered queries with their SQL on DuckDB.

    python tests/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

from quireflow.catalog import ORACLES, QUERIES
from quireflow.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""
    cols = sorted(frame.columns)

    def cell(v):
        if v is None or pd.isna(v):
            return "∅"
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return f"{type(v).__name__[:3]}:{v}" if isinstance(v, bool) else str(v)

    rows = [tuple(cell(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False)]
    return sorted(rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows (no SQL)"
    want = con.execute(ORACLES[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        kinds = {
            c: (got[c].dtype.name, want[c].dtype.name)
            for c in got.columns
            if got[c].dtype.name != want[c].dtype.name
        }
        return True, f"{len(a)} rows {kinds or ''}"
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return False, f"{len(a)} vs {len(b)} rows\n   spark {only_a}\n   sql   {only_b}\n   {sorted(got.columns)}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in QUERIES:
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report every query, then fail
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {note}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
