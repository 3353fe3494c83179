"""Fills, ids and medians against brute force, with one group that holds a third of all rows."""

import random
import statistics
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import aggregate, fill, joins, medians
from tidemill.operators.ordering import dense_ids, with_range_bucket
from tidemill.operators.rows import page, set_operation


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.34 else (None if rng.random() < 0.05 else f"g{rng.randrange(40)}")
        value = None if rng.random() < 0.6 else rng.randrange(50)
        stamp = rng.randrange(200)
        rows.append((group, stamp, i, value, None if rng.random() < 0.7 else f"v{i}"))
    pdf = pd.DataFrame(rows, columns=["g", "t", "i", "v", "s"])
    df = spark.createDataFrame(rows, "g string, t int, i int, v int, s string").repartition(7)
    return df, pdf


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("size", [None, 1, 50, 10_000])
def test_fill_carried(frame, direction, keys, size):
    df, pdf = frame
    out = fill.fill_carried(df, ["v", "s"], ["t", "i"], keys, direction, buckets=size)
    got = {r["i"]: (r["v"], r["s"]) for r in out.collect()}
    ordered = pdf.sort_values(["t", "i"]).copy()
    source = ordered.groupby(keys, dropna=False)[["v", "s"]] if keys else ordered[["v", "s"]]
    filled = source.ffill() if direction == "forward" else source.bfill()
    want = {
        i: (None if pd.isna(v) else int(v), None if pd.isna(s) else s)
        for i, v, s in zip(ordered["i"], filled["v"], filled["s"], strict=True)
    }
    assert got == want


def test_fill_needs_order(frame):
    with pytest.raises(ValueError, match="order_by"):
        fill.fill_carried(frame[0], ["v"], [])


def test_buckets_follow_order_and_stay_small(frame):
    df, _ = frame
    sized = with_range_bucket(df, ["t", "i"], "b", 30).groupBy("b").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "i")).alias("lo"), F.max(F.struct("t", "i")).alias("hi")
    ).orderBy("b").collect()
    assert len(sized) == 30 and max(r["n"] for r in sized) < 400
    assert all(a["hi"] < b["lo"] for a, b in zip(sized, sized[1:], strict=False))
    other = {(r["i"], r["b"]) for r in with_range_bucket(df.repartition(3, "v"), ["t", "i"], "b", 30).collect()}
    assert other == {(r["i"], r["b"]) for r in with_range_bucket(df, ["t", "i"], "b", 30).collect()}


def test_no_job_runs_while_the_plan_is_built(frame, spark):
    df, _ = frame
    spark.sparkContext.setJobGroup("plans", "plans")
    fill.fill_carried(df, ["v", "s"], ["t", "i"], ["g"])
    fill.fill_median(df, "v")
    aggregate.aggregate(df, ["g"], [{"column": "v", "function": "median"}])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    spark.sparkContext.setJobGroup("tests", "tests")


def test_cut_points_of_times_and_nulls(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 10 != 0, F.timestamp_seconds(F.col("id") * 37)).cast("timestamp_ntz").alias("t"), "id"
    )
    out = fill.fill_carried(df.withColumn("v", F.when(F.col("id") % 4 == 0, F.col("id"))), ["v"], ["t", "id"], buckets=20)
    # null times come first in order
    ordered = sorted(range(1000), key=lambda i: (i % 10 != 0, i * 37 if i % 10 else 0, i))
    last, want = None, {}
    for i in ordered:
        last = i if i % 4 == 0 else last
        want[i] = last
    assert {r["id"]: r["v"] for r in out.collect()} == want


def test_dense_ids(frame):
    df, pdf = frame
    got = [(r["id"], r["i"]) for r in dense_ids(df, ["t", "i"]).orderBy("id").collect()]
    assert got == list(enumerate(pdf.sort_values(["t", "i"])["i"], start=1))


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("size", [None, 1, 60, 5000])
def test_exact_median(frame, keys, size):
    df, pdf = frame
    got = medians.exact_median(df, keys, "v", "m", size).collect()
    if not keys:
        assert got[0]["m"] == pdf["v"].median()
        return
    want = pdf.dropna(subset=["v"]).groupby("g", dropna=False)["v"].median()
    assert {r["g"]: r["m"] for r in got} == {None if pd.isna(k) else k: v for k, v in want.items()}


def test_aggregate_with_medians(frame):
    df, pdf = frame
    spec = [{"column": c, "function": f} for f in ("median", "count") for c in ("v", "t")]
    got = {r["g"]: (r["v_median"], r["t_median"], r["v_count"]) for r in aggregate.aggregate(df, ["g"], spec).collect()}
    want = {k: (x["v"].median(), x["t"].median(), x["v"].count()) for k, x in pdf.dropna(subset=["g"]).groupby("g")}
    assert {k: v for k, v in got.items() if v[2]} == {k: v for k, v in want.items() if v[2]} and set(got) == set(want)
    assert aggregate.aggregate(df, [], spec[:1]).first()[0] == pdf["v"].median()
    none = aggregate.aggregate(df.filter("false"), [], spec[:1]).collect()
    assert len(none) == 1 and none[0][0] is None


def test_median_of_extreme_values(spark):
    inf = float("inf")
    for values, want in (([1.7e308, 1.7e308], 1.7e308), ([-1.7e308, 1.7e308], 0.0), ([-inf, 5.0, inf], 5.0), ([5e-324, 5e-324, -1.0], 5e-324)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for buckets in (1, 7, None):
            assert medians.exact_median(df, [], "v", "m", buckets).first()["m"] == want


def test_fill_statistics(frame):
    df, pdf = frame
    present = [int(v) for v in pdf["v"].dropna()]
    want = {"fill_median": statistics.median(present), "fill_mode": min(statistics.multimode(present))}
    for name, value in want.items():
        out = getattr(fill, name)(df, "v")
        filled = {r["i"]: r["v"] for r in out.collect()}
        holes = pdf[pdf["v"].isna()]["i"]
        assert {filled[i] for i in holes} == {value}, name
    assert fill.fill_mean(df, "s").schema == df.schema
    by_rank = fill.fill_median(df, "v", 60)
    assert {r["v"] for r in by_rank.join(df.filter("v is null").select("i"), "i").collect()} == {want["fill_median"]}


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (None,)], "v int")
    assert [r[0] for r in fill.fill_mode(df, "v").collect()].count(1) == 3


def test_only_range_edges_meet_in_one_task(frame):
    df, _ = frame
    plan = fill.fill_carried(df, ["v"], ["t", "i"], buckets=100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__bucket" in plan
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("kind", ["intersect", "except"])
@pytest.mark.parametrize("per_task", [3, 10**6])
def test_set_operations_keep_every_copy(spark, kind, per_task):
    a = spark.createDataFrame([("hot", 1)] * 50 + [("x", None)] * 3 + [("y", 2)], "k string, v int")
    b = spark.createDataFrame([("hot", 1)] * 20 + [("x", None), ("z", 3)], "k string, v int")
    native = {"intersect": (a.intersectAll, a.intersect), "except": (a.exceptAll, a.subtract)}[kind]
    for all_rows, builtin in ((True, native[0]), (False, native[1])):
        got = sorted(map(tuple, set_operation([a, b], kind, all_rows, per_task).collect()), key=repr)
        assert got == sorted(map(tuple, builtin(b).collect()), key=repr)


@pytest.mark.parametrize("order", [["t", "i"], ["-t", "-i"], ["g", "t"], ["-v"], ["s"]])
def test_deep_page_equals_shallow_page(frame, order):
    df, _ = frame
    df = df.unionAll(df.filter("i < 40"))  # rows that repeat
    for number in (1, 2, 57, 101, 200):
        deep = page(df, order, page=number, page_size=30, shallow=0, with_total=True)
        assert deep.collect() == page(df, order, page=number, page_size=30, with_total=True).collect()
    plan = page(df, order, page=57, page_size=30, shallow=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Offset" not in plan


def test_pages_by_expressions(frame):
    df, pdf = frame
    got = [r["i"] for r in page(df, [F.col("t").desc(), F.col("i").asc()], page=3, page_size=20, shallow=0).collect()]
    assert got == pdf.sort_values(["t", "i"], ascending=[False, True])["i"].tolist()[40:60]


def joined_plainly(left, right, how, null_safe):
    def same(a, b):
        return a == b if a is not None and b is not None else null_safe and a is b

    pairs = [(a, b) for a in left for b in right if same(a[0], b[0])]
    out = [(a[0], a[1], b[1]) for a, b in pairs]
    if how in ("left", "full"):
        out += [(a[0], a[1], None) for a in left if not any(same(a[0], b[0]) for b in right)]
    if how in ("right", "full"):
        out += [(b[0], None, b[1]) for b in right if not any(same(a[0], b[0]) for a in left)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("types", [("bigint", "bigint"), ("int", "double"), ("string", "string"), ("double", "double")])
def test_outer_joins_with_frequent_keys(spark, how, null_safe, types):
    rng = random.Random(9)
    keys = {"string": ["x", "", None, "y", "é"], "double": [0.0, -0.0, None, 1.5, 2.0]}.get(types[0], [0, 1, None, 7, 2])
    left = [(rng.choice([*keys, keys[0], keys[2]]), i) for i in range(60)]
    right = [(None if (k := rng.choice([*keys[1:], keys[1], keys[2]])) is None else float(k) if types[1] == "double" else k, i) for i in range(50)]
    sides = [spark.createDataFrame(rows, f"k {kind}, {v} int").repartition(3) for rows, kind, v in ((left, types[0], "a"), (right, types[1], "b"))]
    spark.sparkContext.setJobGroup("joins", "joins")
    out = joins.join(*sides, "k", how, null_safe, hot_key_rows=0, salts=4)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("joins")
    spark.sparkContext.setJobGroup("tests", "tests")

    def plain(found):
        return sorted(((k if k is None or isinstance(k, str) else float(k) + 0.0, a, b) for k, a, b in found), key=repr)

    assert plain(map(tuple, out.collect())) == plain(joined_plainly(left, right, how, null_safe))


def test_outer_joins_scan_each_side_once_and_once_for_its_keys(spark, tmp_path):
    for name in "ab":
        spark.range(100).select(F.col("id").alias("k"), F.lit(name).alias(name)).write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = joins.join(a, b, "k", "full")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) >= 2 and "array_contains" in plan.lower()
    assert joins.join(a, b, "k", "full").count() == 100


def test_frequent_keys_are_few_and_exact(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    assert joins.frequent_keys(df, 100).first()["items"] == ["hot"]
    assert joins.frequent_keys(df, 4000).first()["items"] == []
    assert joins.frequent_keys(df.filter("false"), 0).first()["items"] == []


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_keys_of_many_pairs_fall_into_many_tasks(spark, how, null_safe):
    left = [(None if i % 2 else i, i) for i in range(80)]
    right = [(None if i % 3 else i + 50, i) for i in range(60)]
    sides = [spark.createDataFrame(rows, f"k bigint, {v} int").repartition(3) for rows, v in ((left, "a"), (right, "b"))]
    out = joins.join(*sides, "k", how, null_safe, hot_key_pairs=100, split_pairs=True)
    found = [(tuple(r[:3]), r[3]) for r in out.select("k", "a", "b", F.spark_partition_id()).collect()]
    assert sorted((r for r, _ in found), key=repr) == joined_plainly(left, right, how, null_safe)
    pairs = Counter(p for (k, a, b), p in found if k is None and None not in (a, b))
    assert sum(pairs.values()) == 1600 * null_safe
    assert not null_safe or (len(pairs) > 4 and max(pairs.values()) < 1000)
