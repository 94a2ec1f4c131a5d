"""Compare a registered query with its SQL; also a command: oracle_check.py SF [name...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/sf{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return repr(v)


def bag(table):
    names = sorted(table.column_names)
    cols = [[norm(v) for v in table.column(n).to_pylist()] for n in names]
    return names, Counter(zip(*cols)) if cols else Counter()


def type_name(t) -> str:
    s = str(t).replace("large_", "").replace("string_view", "string")
    return s.replace("[us, tz=UTC]", "[us]")


def compare(spark_table, duck_table) -> list[str]:
    problems = []
    a_names, a = bag(spark_table)
    b_names, b = bag(duck_table)
    if a_names != b_names:
        return [f"columns {a_names} != {b_names}"]
    for n in a_names:
        ta, tb = type_name(spark_table.schema.field(n).type), type_name(duck_table.schema.field(n).type)
        if ta != tb:
            problems.append(f"type of {n}: {ta} != {tb}")
    if a != b:
        only_a, only_b = list((a - b).items())[:2], list((b - a).items())[:2]
        problems.append(f"rows {sum(a.values())} vs {sum(b.values())}; differing {sum((a - b).values())}; spark {only_a}; sql {only_b}")
    return problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = make_session()
    con = connect(sf)
    qs, sql = queries(), oracle_sql()
    bad = 0
    for name in names or qs:
        t0 = time.time()
        try:
            got = qs[name](spark, f"{DATA}/sf{sf}").toArrow()
            t1 = time.time()
            if name in sql:
                want = con.execute(sql[name]).to_arrow_table()
                problems = compare(got, want)
            else:
                problems = []
            state = "ok" if not problems else "BAD"
            print(f"{state:4} {name:24} rows={got.num_rows:6} spark={t1 - t0:6.2f}s {'' if name in sql else 'rows-only'} {problems or ''}", flush=True)
            bad += bool(problems)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name:24} {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
