"""Run named queries and their SQL twins side by side.

    python tests/compare.py FOLDER [NAME ...]
"""

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, registry, name, folder):
    """None if both sides agree, else what differs."""
    df = registry.QUERIES[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    if name not in registry.ORACLES:
        return None
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    spark_types = dict(df.dtypes)
    for n, t in zip(names, types):
        if ("HUGEINT" in t) or ("BIGINT" in t and spark_types[n] != "bigint") or ("INTEGER" in t and spark_types[n] != "int"):
            return f"type of {n}: {spark_types[n]} and {t}"
    if got[1] != want[1]:
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        return f"{len(got[1])} rows, {len(want[1])} wanted; missing {missing}; extra {extra}"
    if not got[1]:
        return "no rows"
    return None


def main():
    from leakscan.plans import all_queries
    from leakscan.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8", "compare")
    con, registry, bad = duck(folder), all_queries(), 0
    for name in registry.QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, registry, name, folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {'' if name in registry.ORACLES else '(rows only) '}{time.time() - start:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    print("bad:", bad)


if __name__ == "__main__":
    main()
