"""Row numbers and running totals with one key holding most rows."""

import datetime
import random

from pyspark.sql import functions as F

from gavel.operators import ordering
from gavel.operators.planning import batch_requests


def hot_rows(spark, count=2000):
    draw = random.Random(5)
    data = [("hot" if draw.random() < 0.5 else f"k{draw.randrange(40)}", i, draw.randrange(100)) for i in range(count)]
    draw.shuffle(data)
    return data, spark.createDataFrame(data, "key string, seq long, n long").repartition(7)


def test_row_numbers_follow_the_order(spark):
    data, df = hot_rows(spark)
    got = {r.seq: r.number for r in ordering.row_numbers(df, ["key", "seq"], "number", start=11).collect()}
    assert got == {seq: at for at, (_, seq, _) in enumerate(sorted(data), 11)}


def test_running_totals_per_key_and_overall(spark):
    data, df = hot_rows(spark)
    per_key = ordering.running_totals(df, ["seq"], {"total": F.col("n")}, keys=["key"], inclusive=True)
    overall = ordering.running_totals(df, ["key", "seq"], {"before": F.col("n")})
    want_key, want_all, sums, running = {}, {}, {}, 0
    for key, seq, n in sorted(data):
        sums[key] = sums.get(key, 0) + n
        want_key[seq] = sums[key]
        want_all[seq] = running
        running += n
    assert {r.seq: r.total for r in per_key.collect()} == want_key
    assert {r.seq: r.before for r in overall.collect()} == want_all


def test_running_totals_keep_null_keys_apart(rows):
    df = rows("key string, seq int, n int", (None, 1, 5), (None, 2, 6), ("a", 3, 7))
    got = ordering.running_totals(df, ["seq"], {"t": F.col("n")}, keys=["key"], inclusive=True)
    assert {r.seq: r.t for r in got.collect()} == {1: 5, 2: 11, 3: 7}


def test_keep_first_and_last(spark):
    data, df = hot_rows(spark)
    first, last = {}, {}
    for key, seq, _ in data:
        first[key] = min(seq, first.get(key, seq))
        last[key] = max(seq, last.get(key, seq))
    for salts in (0, 4):
        assert {r.key: r.seq for r in ordering.keep_first(df, ["key"], ["seq"], salts=salts).collect()} == first
    assert {r.key: r.seq for r in ordering.keep_first(df, ["key"], ["seq"], last=True).collect()} == last


def test_keep_first_reduces_before_the_shuffle(spark):
    _, df = hot_rows(spark)
    plan = ordering.keep_first(df, ["key"], ["seq"])._jdf.queryExecution().toString()
    assert "row_number(), 1, Partial" in plan


def test_neighbours_across_partitions(spark):
    """Each row's nearest values before and after it, one key far larger than a partition."""
    draw = random.Random(4)
    data = [("hot" if n % 2 else f"k{n % 5}", n, draw.choice([None, n * 10])) for n in range(400)] + [(None, 1, 7), (None, 2, None)]
    df = spark.createDataFrame(data, "k string, n int, v int").repartition(4)
    found = ordering.neighbours(df, ["k"], ["n"], before={"b": F.col("v")}, after={"a": F.col("v"), "next_n": F.col("n")})
    by = {}
    for k, n, v in sorted(data, key=lambda r: r[1]):
        by.setdefault(k, []).append((n, v))
    for r in found.collect():
        rows = by[r.k]
        at = [n for n, _ in rows].index(r.n)
        earlier = [v for _, v in rows[:at] if v is not None]
        later = [v for _, v in rows[at + 1 :] if v is not None]
        assert r.b == (earlier[-1] if earlier else None) and r.a == (later[0] if later else None)
        assert r.next_n == (rows[at + 1][0] if at + 1 < len(rows) else None)


def test_chains_are_followed(spark):
    pointers = [(n, n + 3) for n in range(0, 300, 3)] + [(1, 4), (4, 300), (500, None), (600, 601)]
    df = spark.createDataFrame(pointers, "node long, next long")
    starts = spark.createDataFrame([(0,), (1,), (500,), (700,), (0,)], "node long")
    got = sorted(r.node for r in ordering.followed(df, starts).collect())
    assert got == sorted({*range(0, 303, 3), 1, 4, 500, 700})
    assert ordering.followed(df, starts.limit(0)).count() == 0


def test_batches_close_by_size_or_delay(spark):
    draw, start = random.Random(6), datetime.datetime(2024, 1, 1)
    seconds = sorted(draw.choice([draw.randrange(2000), 500 + draw.randrange(20)]) for _ in range(300))
    data = [(start + datetime.timedelta(seconds=s), n) for n, s in enumerate(seconds)] + [(None, -1)]
    df = spark.createDataFrame(data, "ts timestamp, n int").repartition(3)
    want, opened, batch, pos = {-1: (0, 0)}, None, 0, 0
    for ts, n in data[:-1]:
        if opened is None or pos == 8 or ts >= opened + datetime.timedelta(seconds=30):
            opened, batch, pos = ts, batch + 1, 0
        want[n] = (batch, pos)
        pos += 1
    got = {r.n: (r.batch, r.batch_pos) for r in batch_requests(df, ["ts", "n"], 8, 30).collect()}
    assert got == want
