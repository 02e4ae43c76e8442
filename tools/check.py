"""Compare registered queries with their SQL counterparts: ``python tools/check.py [-s SF] [pattern ...]``."""
from __future__ import annotations

import argparse
import fnmatch
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"f{v + 0.0!r}"
    return f"{type(v).__name__[:4]}:{v}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("-q", action="store_true")
    ap.add_argument("-m", default="glasstrail.registry")
    ap.add_argument("patterns", nargs="*", default=["*"])
    a = ap.parse_args()
    import importlib
    importlib.import_module(a.m)
    from glasstrail.registry.core import QUERIES, oracle_texts
    ORACLES = oracle_texts()
    from glasstrail.session import build_session
    root = f"/root/testdata/sf{a.s}"
    spark = build_session("check", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    bad = []
    for key in QUERIES:
        if not any(fnmatch.fnmatch(key, p) for p in a.patterns):
            continue
        t0 = time.time()
        try:
            df = QUERIES[key](spark, root)
            cols = sorted(df.columns)
            got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
        except Exception as e:  # noqa: BLE001
            bad.append(key)
            print(f"ERR   {key}: {str(e)[:500]}", flush=True)
            if a.q:
                traceback.print_exc()
            continue
        t1 = time.time()
        if key not in ORACLES:
            print(f"rows  {key}: {len(got)} rows {t1 - t0:.2f}s", flush=True)
            continue
        try:
            cur = con.execute(ORACLES[key])
            names = [d[0] for d in cur.description]
            rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append(key)
            print(f"SQLERR {key}: {str(e)[:500]}", flush=True)
            continue
        ocols = sorted(names)
        idx = [names.index(c) for c in ocols]
        want = sorted(tuple(canon(r[i]) for i in idx) for r in rows)
        ok = ocols == cols and got == want
        nested = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "decimal")]
        flag = "ok   " if ok else "DIFF "
        print(f"{flag} {key}: {len(got)} rows spark {t1 - t0:.2f}s duck {time.time() - t1:.2f}s {nested or ''}", flush=True)
        if not got:
            print("   EMPTY")
        if not ok:
            bad.append(key)
            print("   cols", cols, ocols, len(got), len(want))
            gs, ws = set(got), set(want)
            for label, items in (("spark only", sorted(gs - ws)[:3]), ("sql only", sorted(ws - gs)[:3])):
                for i in items:
                    print("   ", label, str(i)[:400])
    print("BAD", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
