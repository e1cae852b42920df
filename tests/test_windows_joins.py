"""Rolling sums, running totals, percentiles and joins against plain windows and brute force, with hot keys."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feathergrid.operators import joins as J
from feathergrid.operators import ordered as O
from feathergrid.operators import rolling as RO
from feathergrid.operators import rows as R
from feathergrid.operators import series as S


@pytest.fixture(scope="module")
def flights(spark):
    """One key holds most rows; several rows share a key and second; some flags are null."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        rows.append((i, key, rng.randrange(0, 40 * RO.DAY, 1800), rng.choice([0, 1, 1, None])))
    return spark.createDataFrame(rows, "id int, key string, t long, flag int").cache()


@pytest.mark.parametrize("frame", [RO.leaky_frame(2 * RO.HOUR), RO.safe_frame(30 * RO.DAY), RO.leaky_frame(30 * RO.DAY)])
def test_rolling_sums_equal_plain_window(flights, frame):
    got = RO.with_rolling(flights, ["key"], "t", {"hits": F.col("flag"), "n": F.lit(1)}, {"w": frame}, RO.DAY)
    w = W.partitionBy("key").orderBy("t").rangeBetween(*frame)
    both = got.withColumn("hits", F.coalesce(F.sum("flag").over(w), F.lit(0))).withColumn("n", F.count(F.lit(1)).over(w))
    assert both.where("hits <> hits_w or n <> n_w").count() == 0
    assert both.count() == flights.count()


def test_rolling_sums_of_far_and_following_frames_equal_plain_windows(flights):
    frames = {"far": (-9 * RO.DAY, -8 * RO.DAY), "own": (0, 0), "next": (RO.HOUR, 30 * RO.HOUR), "upto": RO.leaky_frame(2 * RO.DAY)}
    got = RO.with_rolling(flights, ["key"], "t", {"hits": F.col("flag"), "n": F.lit(1)}, frames, RO.HOUR)
    wrong = F.lit(False)
    for name, frame in frames.items():
        w = W.partitionBy("key").orderBy("t").rangeBetween(*frame)
        got = got.withColumn(f"h_{name}", F.coalesce(F.sum("flag").over(w), F.lit(0))).withColumn(f"m_{name}", F.count(F.lit(1)).over(w))
        wrong = wrong | (F.col(f"h_{name}") != F.col(f"hits_{name}")) | (F.col(f"m_{name}") != F.col(f"n_{name}"))
    assert got.where(wrong).count() == 0
    assert got.count() == flights.count()


def test_rolling_sums_copy_only_rows_that_count_in_another_block(spark):
    """1000 rows, each with four frames, half of them 0: the others reach the next day at most."""
    rows = spark.range(1000).selectExpr("id", "id % 5 as key", "id * 1800 as t", "cast(id % 2 as int) as flag")
    frames = {f"w{h}": RO.safe_frame(h * RO.HOUR) for h in (2, 4, 8, 12)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = RO.with_rolling(rows, ["key"], "t", {"hits": F.col("flag")}, frames)
        got.collect()
        plan, made = [got._jdf.queryExecution().executedPlan()], []
        while plan:
            node = plan.pop()
            if node.nodeName() == "Generate":
                made.append(node.metrics().apply("numOutputRows").value())
            plan += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(made) == 1 and 1000 < made[0] <= 1500


def test_safe_frame_does_not_see_own_label(flights):
    frames = {"w": RO.safe_frame(12 * RO.HOUR)}
    target = flights.where("flag is not null and key = 'hot'").agg(F.max("id")).first()[0]
    flipped = flights.withColumn("flag", F.when(F.col("id") == target, 1 - F.col("flag")).otherwise(F.col("flag")))
    a, b = (
        RO.with_rolling(df, ["key"], "t", {"hits": F.col("flag")}, frames).where(F.col("id") == target).first()["hits_w"]
        for df in (flights, flipped)
    )
    assert a == b


def test_row_numbers_and_running_totals_equal_plain_window(flights):
    blocked = flights.withColumn("b", F.floor(F.col("t") / RO.DAY))
    got = O.numbered(blocked, ["key"], ["t", "id"], "b")
    want = F.row_number().over(W.partitionBy("key").orderBy("t", "id"))
    assert got.withColumn("want", want).where("row_number <> want").count() == 0


def test_percentiles_equal_builtin(flights):
    got = {r["key"]: (r["a"], r["b"]) for r in O.exact_percentiles(flights, ["key"], "t", {"a": 0.1, "b": 0.5}).collect()}
    want = flights.groupBy("key").agg(F.percentile("t", [0.1, 0.5]).alias("q")).collect()
    for r in want:
        assert got[r["key"]] == pytest.approx(tuple(r["q"]))


def test_percentile_of_one_value_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, None)], "k int, v double")
    assert [tuple(r) for r in O.exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()] == [(1, 5.0)]


@pytest.fixture(scope="module")
def two_sides(spark):
    rng = random.Random(5)
    key = lambda: "hot" if rng.random() < 0.5 else f"s{rng.randrange(8)}"
    left = [(i, key(), rng.randrange(0, 500_000)) for i in range(600)]
    right = [(i, key(), rng.randrange(0, 500_000, 600), float(i)) for i in range(900)]
    right += [(10_000 + i, k, t, v) for i, k, t, v in right[:60]]
    a = spark.createDataFrame(left, "id int, k string, t long").cache()
    b = spark.createDataFrame(right, "rid int, k string, rt long, v double").cache()
    return left, right, a, b


@pytest.mark.parametrize(("lo", "hi"), [(7200, 14400), (0, 3600), (100, 90_000)])
def test_interval_and_asof_joins_equal_brute_force(two_sides, lo, hi):
    left, right, a, b = two_sides
    pairs = [(i, r) for i, k, t in left for r, rk, rt, _ in right if k == rk and lo <= t - rt <= hi]
    got = J.interval_join(a, b, ["k"], "t", "rt", lo, hi).select("id", "rid").collect()
    assert sorted(map(tuple, got)) == sorted(pairs)

    best, ties = {}, {}
    for i, k, t in left:
        fits = [(rt, r) for r, rk, rt, _ in right if rk == k and lo <= t - rt <= hi]
        best[i] = max(fits)[1] if fits else None
        ties[i] = sorted(r for rt, r in fits if rt == max(fits)[0])
    once = J.asof_join(a, b, ["k"], "t", "rt", "rid", lo, hi).select("id", "match.rid").collect()
    assert dict(map(tuple, once)) == best
    assert len(once) == len(left)
    every = J.asof_join_all_ties(a, b, ["k"], "t", "rt", "rid", lo, hi).select("id", "match.rid").collect()
    assert sorted(map(tuple, every)) == sorted((i, r) for i, rs in ties.items() for r in rs)


def test_nearest_point_equals_brute_force(spark):
    rng = random.Random(9)
    places = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(200)]
    # a dense cluster, the poles, both sides of the date line and two equal places
    places += [(300 + i, 40 + rng.random() / 50, -74 + rng.random() / 50) for i in range(80)]
    places += [(400, 90.0, 0.0), (401, -90.0, 0.0), (402, 10.0, 179.99), (403, 40.0, -74.0), (404, 40.0, -74.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    points += [(500, 10.0, -179.99), (501, 89.9, 120.0), (502, 40.0, -74.0), (503, 40.01, -73.99)]

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2
        h += math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    left = spark.createDataFrame(points, "city int, lat double, lon double")
    right = spark.createDataFrame(places, "station int, lat double, lon double")
    got = {r["city"]: (r["station"], r["distance_km"]) for r in J.nearest_point(left, "city", right, "station").collect()}
    assert len(got) == len(points)
    for i, la, lo in points:
        d, s = min((km(la, lo, a, b), s) for s, a, b in places)
        assert got[i][1] == pytest.approx(d, abs=1e-6)
        assert got[i][0] == s


def test_calendar_fill(spark):
    days = spark.sql("select explode(sequence(date'2020-01-01', date'2020-01-20')) as d").where("dayofweek(d) not in (1, 7)")
    series = spark.createDataFrame([("b", "2020-01-04", 1.0), ("b", "2020-01-10", 2.0)], "k string, d string, v double")
    out = J.calendar_asof_fill(days, series.withColumn("d", F.to_date("d")), ["k"], "d", "v")
    got = {str(r["d"]): r["v"] for r in out.collect()}
    assert got["2020-01-06"] == 1.0 and got["2020-01-09"] == 1.0 and got["2020-01-10"] == 2.0 and got["2020-01-20"] == 2.0
    assert "2020-01-03" not in got and "2020-01-04" not in got


def test_fill_chain_leaves_no_null(spark):
    rows = [(1, 1, None), (1, 2, 5000.0), (1, 3, None), (2, 1, None), (2, 2, None), (3, 1, -2000.0)]
    df = spark.createDataFrame(rows, "cusip int, day int, sale_nwc double")
    out = {(r["cusip"], r["day"]): r["sale_nwc"] for r in S.fill_chain(df, ["cusip"], "day").collect()}
    assert out == {(1, 1): 1000.0, (1, 2): 1000.0, (1, 3): 1000.0, (2, 1): 0.0, (2, 2): 0.0, (3, 1): -1000.0}
    assert len(S.RATIO_BOUNDS) == 55


def test_lag_change_edges(spark):
    rows = [(1, 1, 0.0), (1, 2, 3.0), (1, 3, -3.0), (1, 4, -3.0), (1, 5, 100.0)]
    df = spark.createDataFrame(rows, "id int, d int, v double")
    w = S.along(["id"], ["d"])
    out = [r["c"] for r in df.select("d", S.lag_change_clamped("v", 1, w).alias("c")).orderBy("d").collect()]
    assert out == [0.0, 5.0, -2.0, 0.0, 5.0]


def test_volatility_is_null_until_21_returns(spark):
    rows = [(1, i, 100.0 + (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, d int, p double")
    out = [r["volatility"] for r in S.annualized_volatility(df, ["id"], "d", "p").orderBy("d").collect()]
    assert out[:21] == [None] * 21 and out[21] is not None and max(v for v in out if v is not None) <= 1


def test_dedup_top_k_cap(spark):
    rows = [("m", "a", 0.9, 1), ("m", "a", 0.7, 2), ("m", "b", 0.8, 3), ("m", "c", 0.1, 4), ("n", "c", 0.5, 5)]
    df = spark.createDataFrame(rows, "month string, tic string, p double, id int")
    top = R.top_k_per_group(df, ["month"], "tic", "p", 2)
    assert sorted((r["month"], r["tic"], r["pick"]) for r in top.collect()) == [("m", "a", 1), ("m", "b", 2), ("n", "c", 1)]
    assert {r["tic"]: r["id"] for r in R.dedup_keep_last(df, ["tic"], ["id"]).collect()} == {"a": 2, "b": 3, "c": 5}
    assert R.cap_per_group(df, ["month"], ["id"], 3).count() == 4


def test_hub_label_shares_rank_on_ties(spark):
    df = spark.createDataFrame([(i, 10 if i < 14 else 5) for i in range(30)], "k int, n int")
    out = {r["k"]: r["hub_status"] for r in R.rank_global_label(df, "k", "n").collect()}
    # rank 15 is shared by all the rest
    assert set(out.values()) == {"hub"}
    df = spark.createDataFrame([(i, 100 - i) for i in range(30)], "k int, n int")
    out = {r["k"]: r["hub_status"] for r in R.rank_global_label(df, "k", "n").collect()}
    assert sum(v == "hub" for v in out.values()) == 15


def test_sort_within_entity_order(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1000).alias("d"))
    rows = [(r["k"], r["d"]) for r in R.sort_within_entity(df, ["k"], ["d"]).collect()]
    assert rows == sorted(rows)


def test_dense_row_id_with_one_hot_value(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("day"), "id")
    got = R.dense_row_id(df, ["day", "id"], parts=6)
    assert got.where(F.col("day") == 7).select(F.spark_partition_id()).count() > 1300
    want = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("day", "id"))
    assert got.withColumn("want", want).where("row_id <> want").count() == 0
    assert got.count() == 2000


def test_cap_with_blocks_equals_cap_without(flights):
    a = R.cap_per_group(flights, ["key"], ["t", "id"], 37)
    b = R.cap_per_group(flights, ["key"], ["t", "id"], 37, block=F.floor(F.col("t") / RO.DAY))
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())


def test_null_is_a_group_like_any_other(spark):
    df = spark.createDataFrame([(None, 10, 1), (None, 20, 1), ("a", 10, 0)], "key string, t long, flag int")
    out = O.numbered(df.withColumn("b", F.lit(0)), ["key"], ["t"], "b")
    assert sorted(r["row_number"] for r in out.collect()) == [1, 1, 2]
    rolled = RO.with_rolling(df, ["key"], "t", {"h": F.col("flag")}, {"w": RO.leaky_frame(60)})
    assert sorted((r["key"] or "", r["t"], r["h_w"]) for r in rolled.collect()) == [("", 10, 1), ("", 20, 2), ("a", 10, 0)]
    assert O.exact_percentiles(df, ["key"], "t", {"m": 0.5}).where("key is null").first()["m"] == 15.0
    assert R.cap_per_group(df, ["key"], ["t"], 1, block=F.col("t")).count() == 2


def test_nearest_point_in_a_crowded_city(spark):
    """Thousands of stations within three kilometres, one place held by many, and a few far away."""
    rng = random.Random(11)
    stations = [(i, 40.7 + rng.random() * 0.03, -74.0 + rng.random() * 0.03) for i in range(20_000)]
    stations += [(30_000 + i, 40.71, -73.99) for i in range(500)] + [(40_000, -33.0, 151.0), (40_001, 89.9, 10.0), (40_002, None, 1.0)]
    cities = [(i, 40.7 + rng.random() * 0.03, -74.0 + rng.random() * 0.03) for i in range(60)]
    cities += [(100, 40.71, -73.99), (101, -34.0, 150.0), (102, 90.0, 0.0), (103, 41.5, -75.0), (104, None, None)]
    left = spark.createDataFrame(cities, "city int, lat double, lon double")
    right = spark.createDataFrame(stations, "station int, lat double, lon double").repartition(4)

    def km(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    for r in J.nearest_point(left, "city", right, "station").collect():
        _, lat, lon = next(c for c in cities if c[0] == r["city"])
        if lat is None:
            assert r["station"] is None
            continue
        best = min((km(lat, lon, s[1], s[2]), s[0]) for s in stations if s[1] is not None)
        assert r["distance_km"] == pytest.approx(best[0], rel=2e-3, abs=1e-6)
        assert r["station"] == best[1]
    places = right.where("lat is not null").groupBy("lat", "lon").agg(F.min("station").alias("_rid"))
    tree = J._CubeTree(J._on_sphere(places, "lat", "lon", "_rid"), 32)
    held = [leaves.groupBy("cx", "cy", "cz").count().agg(F.max("count")).first()[0] or 0 for leaves in tree.leaves]
    assert max(held) <= 32 and sum(leaves.count() for leaves in tree.leaves) == places.count() and len(held) > 6
    nothing = J.nearest_point(left, "city", right.limit(0), "station").collect()
    assert len(nothing) == len(cities) and all(r["station"] is None for r in nothing)
