"""Run registered queries next to their SQL: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from checks.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def main(argv: list[str]) -> int:
    from checks.all_queries import ORACLES, QUERIES

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    wanted = argv[1:] or list(QUERIES)
    spark, db = local_session(), connect(folder)
    bad = []
    for name in [q for q in QUERIES if any(q.startswith(w) for w in wanted)]:
        start = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            got = _rows(frame.columns, frame.collect())
            seconds = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows, {seconds:.1f}s", flush=True)
                continue
            result = db.execute(ORACLES[name])
            names = [d[0] for d in result.description]
            want = _rows(names, result.fetchall())
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
            continue
        if sorted(names) == sorted(frame.columns) and got == want:
            print(f"ok    {name}: {len(got)} rows, {seconds:.1f}s", flush=True)
            continue
        bad.append(name)
        print(f"DIFF  {name}: {len(got)} / {len(want)} rows; columns "
              f"{sorted(set(names) ^ set(frame.columns))}", flush=True)
        different = [(a, b) for a, b in zip(got, want) if a != b]
        for a, b in different[:3]:
            print("      spark ", a, "\n      duckdb", b)
    print(f"{len(bad)} bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
