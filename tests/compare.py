"""Run named queries and their SQL side by side: `python tests/compare.py SF [name...]`."""

from __future__ import annotations

import math
import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool):
            return ("b", v)
        if v is None:
            return ("n",)
        if isinstance(v, float):
            if math.isnan(v):
                return ("nan",)
            return ("f", float(f"{v:.9g}"))
        if isinstance(v, int):
            return ("f", float(v))
        if isinstance(v, (list, tuple)):
            return ("l", tuple(cell(x) for x in v))
        return ("s", str(v))

    return ([columns[i] for i in order],
            sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows))


def compare(spark, con, name, fn, sql, sf_dir):
    """None when both sides agree, otherwise what differs."""
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not want[1]:
        return "the SQL returns no rows"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lack = [r for r in want[1] if r not in set(got[1])][:2]
        return f"{len(got[1])} vs {len(want[1])} rows; only spark {extra}; only sql {lack}"
    return None


def overtime(*_):
    raise TimeoutError("query took too long")


def main(argv):
    signal.signal(signal.SIGALRM, overtime)
    from minim.session import build_session
    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = [n for n in entry.queries() if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "90")))
        try:
            problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        signal.alarm(0)
        bad += problem is not None
        kind = "S" if name in entry.oracle_sql() else "R"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
