import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from papyra.operators.skew import heavy_keys, key_statistics, salted_left_join

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "k string, p string, t timestamp, n long, __n long"


def brute(rows):
    groups = defaultdict(list)
    for k, p, t, *_ in rows:
        groups[k].append((p, t))
    out = {}
    for k, xs in groups.items():
        ts = [t for _, t in xs if t is not None]
        out[k] = (len(xs), len({p for p, _ in xs if p is not None}), min(ts, default=None), max(ts, default=None))
    return out


def stats(spark, rows, **kw):
    got = key_statistics(spark.createDataFrame(rows, SCHEMA), ["k"], "p", "t", **kw).collect()
    return {r.k: (r.n_rows, r.n_distinct, r.first_at, r.last_at) for r in got}


def test_statistics_match_brute_force_with_hot_and_null_keys(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        k = rng.choice(["hot"] * 6 + [None] * 3 + [f"k{rng.randrange(200)}"])
        rows.append((k, rng.choice([None, f"p{rng.randrange(80)}"]), rng.choice([None, T0 + dt.timedelta(hours=rng.randrange(999))]), i, 7))
    rows += rows[:50]  # repeated rows count
    assert stats(spark, rows) == brute(rows)


def test_salting_does_not_change_the_result(spark):
    rows = [("a" if i % 3 else "b", f"p{i % 17}", T0 + dt.timedelta(minutes=i), i, 0) for i in range(500)]
    assert stats(spark, rows, share=2.0) == stats(spark, rows, share=1e-9, salts=3) == brute(rows)


def test_empty_table_has_no_keys(spark):
    assert stats(spark, []) == {}


def test_heavy_keys_are_bounded_by_the_share(spark):
    df = spark.createDataFrame([("x",)] * 90 + [(f"y{i}",) for i in range(10)], "k string")
    assert [r.k for r in heavy_keys(df, ["k"], 0.5).collect()] == ["x"]
    assert heavy_keys(df, ["k"], 0.01).count() <= 100


def test_salted_join_equals_left_join(spark):
    a = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2), ("none", 3)], "k string, i int")
    b = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("cold", "z"), (None, "w")], "k string, v string")
    want = sorted(map(str, a.join(b, "k", "left").collect()))
    assert sorted(map(str, salted_left_join(a, b, ["k"], F.col("i"), share=0.1).select("k", "i", "v").collect())) == want


def test_salted_join_takes_known_heavy_keys(spark):
    a = spark.createDataFrame([("h", i) for i in range(9)], "k string, i int")
    counts = spark.createDataFrame([("h", 9)], "k string, n long")
    b = spark.createDataFrame([("h", 1)], "k string, v int")
    assert salted_left_join(a, b, ["k"], F.col("i"), heavy=heavy_keys(counts, ["k"], counted="n")).where("v = 1").count() == 9
