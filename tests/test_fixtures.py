"""Hand-written cases: small inputs with their expected results."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import binning, datetimes, scalar
from rowloom.functions.types import common_type, upcast
from rowloom.operators import aggregates, cumulative, ema, grouping, interp, joins, ordered, rolling, sorting
from rowloom.operators.timewindow import time_window
from rowloom.sources import io

NAN = float("nan")


def frame(spark, values, schema="row_id long, x double"):
    return spark.createDataFrame([(i, v) if not isinstance(v, tuple) else (i, *v) for i, v in enumerate(values)], schema)


def column(df, name, by="row_id"):
    return [r[name] for r in df.orderBy(by).select(name).collect()]


@pytest.mark.parametrize("values,strict,skip", [([1.0, 1.0, 1.0], 3.0, 3.0), ([0.0, None, 1.0], None, 1.0), ([0.0, NAN, 1.0], None, 1.0), ([None, NAN], None, 0.0)])
def test_sums(spark, values, strict, skip):
    r = frame(spark, values).agg(aggregates.aggregate("sum", F.col("x")).alias("s"), aggregates.aggregate("sum", F.col("x"), True).alias("n")).first()
    assert (r.s, r.n) == (strict, skip)


def test_reductions(spark):
    r = aggregates.reduce_all(frame(spark, [None, NAN]), "x").first()
    assert r.nanmean == 0.0 and r["mean"] is None and r.nanmin is None
    r = aggregates.reduce_all(frame(spark, [1.0, 4.0]), "x", ddof=2).first()
    assert r["var"] is None
    e = aggregates.arg_extremes(frame(spark, [3.0, NAN, 1.0, 1.0, 7.0]), "x", "row_id").first()
    assert (e.argmin, e.argmax, e.nanargmin, e.nanargmax) == (1, 1, 2, 4)


def test_midpoint_quantile_and_mode(spark):
    df = spark.createDataFrame([(1, v) for v in [10.0, 2.0, 1.0, 3.0, NAN, 2.0, 3.0]] + [(2, None)], "g int, x double")
    got = {r.g: r.quantile for r in aggregates.quantile_midpoint_distributed(df, ["g"], "x", 0.4).collect()}
    assert got == {1: 2.0, 2: None}
    four = spark.createDataFrame([(1, v) for v in [1.0, 2.0, 3.0, 10.0]], "g int, x double")
    assert aggregates.quantile_midpoint_distributed(four, ["g"], "x", 0.4).first().quantile == 2.5
    assert four.agg(aggregates.quantile_midpoint(F.col("x"), 0.4).alias("q")).first().q == 2.5
    assert df.filter("g = 1").agg(aggregates.mode(F.col("x")).alias("m")).first().m == 2.0


def test_trim_rule():
    limits = aggregates.trim_limits(50_000)
    for n in (1, 39, 40, 41, 922, 923, 3117, 49_999):
        assert sum(v < n for v in limits) == aggregates.trim_count(n)


def test_trimmed_mean(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 5.0), ("b", None), ("c", None)], "g string, x double")
    got = {r.g: r.trimmed for r in aggregates.trimmed_mean(df, ["g"], "x").collect()}
    assert got == {"a": 50.5, "b": 5.0, "c": None}


def test_ranks_of_groups_that_ranges_cut(spark):
    values = {"a": [float(i * 37 % 2501) for i in range(25_000)], None: [float(i % 7) for i in range(900)], "b": [2.0, None, NAN, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, x double").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    try:
        trimmed = {r.g: r.trimmed for r in aggregates.trimmed_mean(df, ["g"], "x").collect()}
        low = {r.g: r.quantile for r in aggregates.quantile_midpoint_distributed(df, ["g"], "x", 0.2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, vs in values.items():
        v = sorted(x for x in vs if x is not None and x == x)
        k, at = aggregates.trim_count(len(v)), (len(v) - 1) * 0.2
        kept = [x for x in v if v[k] <= x <= v[-k - 1]]
        assert trimmed[g] == pytest.approx(sum(kept) / len(kept), rel=1e-12)
        assert low[g] == (v[math.floor(at)] + v[math.ceil(at)]) / 2


def test_nth(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(4)] + [(2, 0, None)], "g int, i int, x double")
    assert {r.g: r.nth for r in aggregates.nth(df, ["g"], "x", ["i"], 2).collect()} == {1: 4.0, 2: None}
    assert {r.g: r.nth for r in aggregates.nth(df, ["g"], "x", ["i"], -1).collect()} == {1: 9.0, 2: None}


def test_group_ids(spark):
    df = spark.createDataFrame([(0, 0, True), (1, 1, True), (2, 2, False), (3, 3, True), (4, 4, False)], "row_id long, k int, keep boolean")
    assert column(grouping.group_ids(df, ["k"], "row_id", F.col("keep")), "group_id") == [1, 2, 0, 3, 0]
    same = df.withColumn("k", F.lit(3)).withColumn("keep", F.col("row_id").isin(0, 1, 3))
    assert column(grouping.group_ids(same, ["k"], "row_id", F.col("keep")), "group_id") == [1, 1, 0, 1, 0]
    nulls = spark.createDataFrame([(0, None), (1, 5), (2, None)], "row_id long, k int")
    assert column(grouping.group_ids(nulls, ["k"], "row_id"), "group_id") == [1, 2, 1]


def test_cumulative(spark):
    run = lambda values, kind: column(
        cumulative.running(frame(spark, values).withColumn("g", F.lit(1)), ["g"], ["row_id"], {"r": (kind, "x")}), "r")
    assert run([1.0, 1.0, 1.0], "cumsum") == [1.0, 2.0, 3.0]
    assert run([1.0, 0.0, 1.0], "cummin") == [1.0, 0.0, 0.0]
    assert run([0.0, 1.0, 1.0], "cummax") == [0.0, 1.0, 1.0]
    assert run([0.0, None, 1.0], "cummin") == [0.0, None, None]
    assert run([0.0, NAN, 1.0], "cumnanmin") == [0.0, 0.0, 0.0]
    assert run([0.0, None, 1.0], "cumnanmax") == [0.0, 0.0, 1.0]


def _ema_loop(rows, rate, kind):
    out, state = {}, {}
    for g, i, t, x in rows:
        e, last = state.get(g, (0.0, None))
        w = math.exp(-rate * (t - last)) if last is not None else 0.0
        e = x + e * w if kind == "decay" else x if last is None else x * (1 - w) + e * w
        state[g], out[i] = (e, t), e
    return out


@pytest.mark.parametrize("kind", ["decay", "normal"])
def test_ema_equals_the_loop_over_long_horizons(spark, kind):
    rng = np.random.default_rng(0)
    times = np.cumsum(rng.choice([0.0, 0.5, 3.0, 2000.0], 400, p=[0.2, 0.5, 0.28, 0.02]))
    rows = [(i % 2, i, float(t), float(rng.normal())) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "g int, i int, t double, x double").repartition(3)
    made = (ema.ema_decay if kind == "decay" else ema.ema_normal)(df, ["g"], ["i"], "x", "t", 0.7)
    want = _ema_loop(rows, 0.7, kind)
    for r in made.collect():
        assert r.ema == pytest.approx(want[r.i], rel=1e-9, abs=1e-9)


def test_ema_decay_filter(spark):
    keep = [True] * 5 + [False] * 4 + [True]
    rows = [(g, t, 1.0, keep[t]) for g in "ab" for t in range(10)]
    df = spark.createDataFrame(rows, "c string, t long, x double, f boolean")
    got = {(r.c, r.t): r.ema for r in ema.ema_decay(df, ["c"], ["t"], "x", "t", 0.693, F.col("f")).collect()}
    assert got["a", 4] > 1.0 and got["a", 5] < 1.0
    masked = {(r.c, r.t): r.ema for r in ema.ema_masked(df, ["c"], ["t"], "x", "t", 0.693, "f", None, "decay").collect()}
    assert all(masked[k] == pytest.approx(v) for k, v in got.items())


def test_ema_reset(spark):
    df = spark.createDataFrame([(1, i, float(i), float(v), m, r) for i, (v, m, r) in enumerate([(5, True, False), (7, False, True), (9, True, True), (4, False, False)])],
                               "g int, i int, t double, x double, m boolean, r boolean")
    got = column(ema.ema_masked(df, ["g"], ["i"], "x", "t", 0.1, "m", "r"), "ema", "i")
    first = 5 * (1 - math.exp(0.0))
    assert got == pytest.approx([first, first, 9 * (1 - math.exp(-0.2)), 9 * (1 - math.exp(-0.2))])


@pytest.mark.parametrize("forward,match", [(True, 0), (False, 2)])
def test_asof_ties(spark, forward, match):
    left = spark.createDataFrame([(1, 1.0, i) for i in range(3)] + [(1, None, 9)], "k int, v double, lid long")
    right = spark.createDataFrame([(1, 1.0, i) for i in range(3)] + [(1, None, 7)], "k int, v double, rid long")
    got = {r.lid: r.match for r in joins.asof(left, right, ["k"], "v", "v", "lid", "rid", forward).collect()}
    assert got == {0: match, 1: match, 2: match, 9: None}


def test_lexsort(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([1, 2, 3, 4, 5, 6], [2, 2, 1, 1, 3, 3]))], "row_id long, a int, b int")
    order = lambda up: [r.row_id for r in sorting.lexsort(df, ["a", "b"], up, "row_id").orderBy("rank").collect()]
    assert order([True, True]) == [2, 3, 0, 1, 4, 5]
    assert order([False, False]) == [5, 4, 1, 0, 3, 2]
    assert order([True, False]) == [4, 5, 0, 1, 2, 3]


def test_bins(spark):
    edges = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    df = frame(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    made = lambda c: column(df.withColumn("b", c), "b")
    x = F.col("x")
    assert made(binning.searchsorted(x, edges)) == [0, 1, 2, 3, 4, 5]
    assert made(binning.searchsorted(x, edges, right=True)) == [1, 2, 3, 4, 5, 6]
    assert made(binning.searchsorted(x, [2.0, 3.0])) == [0, 0, 0, 1, 2, 2]
    twice = sorted(edges * 2)
    assert made(binning.searchsorted(x, twice)) == [0, 2, 4, 6, 8, 10]
    assert made(binning.searchsorted(x, twice, right=True)) == [2, 4, 6, 8, 10, 12]
    assert column(frame(spark, [0.0, 1.0, 2.0, 3.0, 4.0]).withColumn("b", binning.qcut_labels(x, edges[:5])), "b") == [2, 2, 3, 4, 5]
    odd = frame(spark, [NAN, None, float("inf"), 9.0])
    assert column(odd.withColumn("b", binning.qcut_labels(x, edges)), "b") == [0, 0, 0, 1]
    assert column(odd.withColumn("b", binning.searchsorted(x, edges)), "b") == [6, 6, 6, 6]


def test_gather_and_membership(spark):
    values = frame(spark, [5.0, None, 7.0], "pos long, x double")
    index = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 2, 3, -1, -4])], "row_id long, i long")
    assert column(joins.gather(index, values, "i", "pos", "x", 3, F.lit(-1.0)), "value") == [5.0, None, 7.0, -1.0, 7.0, -1.0]
    needles = frame(spark, [1.0, 2.0, 3.0, NAN])
    hay = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, NAN)], "pos long, k double")
    got = joins.is_member(needles, hay, ["x"], ["k"], "pos")
    assert column(got, "found") == [True, True, False, False] and column(got, "position") == [0, 1, None, None]


@pytest.mark.parametrize("text,nanos", [
    ("12:30", 45_000_000_000_000), ("1:02:03", 3_723_000_000_000), ("01:02:03.5", 3_723_500_000_000), ("24:00:00", 0), ("12", 0), ("", 0), ("xx:10", 0)])
def test_times(spark, text, nanos):
    assert spark.range(1).select(datetimes.time_nanos(F.lit(text)).alias("t")).first().t == nanos


def test_dates(spark):
    day = 86_400_000_000_000
    cases = {"19700102": day, "1970-01-02": day, "1969-12-31": 0, "2100-01-01": 0, "1970-13-01": 0, "1970-02-31": 61 * day, "x": 0, "": 0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", datetimes.date_nanos(F.col("s")).alias("n")).collect()} == cases
    both = {"1970-01-02 01:00": day + 3_600_000_000_000, "1970-01-02T00:00:01.000000001": day + 1_000_000_001, "1970-01-02 99:00": day, "bad 01:00": 0}
    df = spark.createDataFrame([(k,) for k in both], "s string")
    assert {r.s: r.n for r in df.select("s", datetimes.datetime_nanos(F.col("s")).alias("n")).collect()} == both
    assert spark.range(1).select(datetimes.strptime_nanos(F.lit("02/01/1970 00:00:01.25"), "%d/%m/%Y %H:%M:%S").alias("n")).first().n == day + 1_250_000_000


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (3.0, 2.0), (None, 1.0)], "x double, y double")
    got = [r.d for r in df.select(scalar.divide(F.col("x"), F.col("y")).alias("d")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [-math.inf, 1.5, None]
    ints = spark.createDataFrame([(-7, 3), (7, -3), (7, 0), (-6, 3)], "x int, y int")
    r = ints.select(scalar.floor_divide(F.col("x"), F.col("y")).alias("q"), scalar.modulo(F.col("x"), F.col("y")).alias("m")).collect()
    assert [(x.q, x.m) for x in r] == [(-3, -1), (-3, 1), (0, None), (-2, 0)]
    m = spark.createDataFrame([(NAN, 1.0), (2.0, 1.0)], "x double, y double").select(scalar.minimum(F.col("x"), F.col("y")).alias("m"), scalar.equal(F.col("x"), F.col("x")).alias("e")).collect()
    assert math.isnan(m[0].m) and m[1].m == 1.0 and [x.e for x in m] == [False, True]
    assert spark.range(1).select(scalar.crc64(F.lit(b"123456789").cast("binary")).alias("c")).first().c % (1 << 64) == 0x995DC9BBDF1939FA


def test_types():
    assert upcast(T.ByteType(), T.LongType()) == T.LongType()
    assert upcast(T.FloatType(), T.ShortType()) == T.FloatType()
    assert upcast(T.FloatType(), T.IntegerType()) == T.DoubleType()
    assert common_type([T.BooleanType(), T.IntegerType(), T.StringType()]) == T.StringType()


def test_files(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2, 0.5)], "k long, v double")
    for i, df in enumerate((a, b)):
        io.save(df, f"{tmp_path}/{i}")
    assert io.stackable(io.load_many(spark, [f"{tmp_path}/0", f"{tmp_path}/1"]))
    both = io.stack_or_many(spark, [f"{tmp_path}/0", f"{tmp_path}/1"]).orderBy("k").collect()
    assert [tuple(r) for r in both] == [(1, "x", None), (2, None, 0.5)]
    io.concatenate(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], f"{tmp_path}/all")
    assert io.load(spark, f"{tmp_path}/all", ["k"], sections=[1]).first().k == 2
    assert [r.name for r in io.info(spark, f"{tmp_path}/0").collect()] == ["k", "s"]
    assert not io.stackable([a, a.withColumn("s", F.lit(1))])


def test_time_window_ties(spark):
    df = spark.createDataFrame([(1, i, t, float(v)) for i, (t, v) in enumerate([(0, 7), (0, 7), (5, 1), (5, -2), (11, 0), (12, 3)])], "g int, i int, t long, x double")
    assert column(time_window(df, ["g"], "t", "i", "x", 5), "window", "i") == [7, 14, 15, 13, 0, 3]
    assert column(time_window(df, ["g"], "t", "i", "x", 7, "prod"), "window", "i") == pytest.approx([7, 49, 49, -98, 0, 0])


def test_interpolation(spark):
    x = F.col("x")
    df = frame(spark, [-1.0, 0.0, 0.5, 2.0, 5.0, NAN])
    assert column(df.withColumn("y", interp.interpolate(x, [0.0, 1.0, 3.0], [0.0, 10.0, 20.0])), "y") == [-10.0, 0.0, 5.0, 15.0, 30.0, None]
    assert column(df.withColumn("y", interp.interpolate(x, [0.0, 1.0, 3.0], [0.0, 10.0, 20.0], clip=True)), "y") == [0.0, 0.0, 5.0, 15.0, 20.0, None]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_operators_do_not_depend_on_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr(ordered, "BLOCK", 16)
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 9, 150)]
    df = frame(spark, values).repartition(parts)
    made = rolling.ungrouped(df, ["row_id"], {"r": ("nansum", "x", 5), "d": ("diff", "x", 3), "a": ("shift", "x", -2)})
    assert column(made, "r") == [sum(values[max(0, i - 4) : i + 1]) for i in range(150)]
    assert column(made, "d") == [None if i < 3 else values[i] - values[i - 3] for i in range(150)]
    assert column(made, "a") == [*values[2:], None, None]
    assert column(ordered.with_position(df, ["row_id"]), "position") == list(range(150))
    assert column(rolling.shift_rows(df, ["row_id"], ["x"], -1), "x") == [None, *values[:-1]]
    assert not rolling.is_sorted(df, ["row_id"], "x").first().is_sorted
    assert rolling.is_sorted(df, ["x", "row_id"], "x").first().is_sorted


def test_rolling_forms(spark):
    df = frame(spark, [1.0, NAN, 3.0, 4.0]).withColumn("g", F.lit(1))
    w = Window.partitionBy("g").orderBy("row_id")
    made = lambda kind, *a: column(df.withColumn("r", rolling.rolling(kind, F.col("x"), w, *a)), "r")
    assert made("sum", 2) == [1.0, None, None, 7.0]
    assert made("nansum", 2) == [1.0, 1.0, 3.0, 7.0]
    assert made("nanmean", 1) == [1.0, None, 3.0, 4.0]
    assert made("quantile", 3, 0.5) == [1.0, 1.0, 2.0, 3.5]
    with pytest.raises(ValueError):
        rolling.rolling("sum", F.col("x"), w, 0)


def test_special_values(spark):
    from rowloom.functions import datetimes, scalar
    from rowloom.operators import aggregates, ema, joins, rolling, timewindow

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, nan), (1, inf), (2, -inf), (3, 1e300), (4, -2.5), (5, None)], "i int, x double")
    got = [r.t for r in df.orderBy("i").select(scalar.truncate(F.col("x")).alias("t")).collect()]
    assert got[0] != got[0] and got[1:] == [inf, -inf, 1e300, -2.0, None]
    half = df.orderBy("i").select(scalar.floor_divide(F.col("x"), F.lit(2.0), floating=True).alias("q")).collect()
    assert half[0].q != half[0].q and [r.q for r in half[1:]] == [inf, -inf, 5e299, -2.0, None]
    sides = [spark.createDataFrame([(1, v, i) for i, v in enumerate(vs)], "k int, v double, i int") for vs in ((nan, 2.0), (1.0, nan))]
    for forward, want in ((False, {0: None, 1: 0}), (True, {0: None, 1: None})):
        made = joins.asof(*sides, ["k"], "v", "v", "i", "i", forward).collect()
        assert {r.i: r.match for r in made} == want
    for values, want in (([5, None, 1], False), ([1, 5, None], True), ([None, None], True), ([], True)):
        assert rolling.is_sorted(spark.createDataFrame(list(enumerate(values)), "i int, x int"), ["i"], "x").first()[0] is want
    rows = spark.createDataFrame([("a", 0, 1, 3.0), ("a", 0, 2, nan), ("a", 1, 3, 7.0)], "g string, t long, r int, x double")
    assert timewindow.time_window(rows, ["g"], "t", "r", "x", 0).orderBy("r").first().window == 3.0
    rows = spark.createDataFrame([("a", t, t, v) for t, v in enumerate([3.0, 7.0, 11.0])], "g string, t long, r long, x double")
    assert [r.window for r in timewindow.time_window(rows, ["g"], "t", "r", "x", 5, "prod").orderBy("r").collect()] == [3.0, 21.0, 231.0]
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, nan), (1, None)], "k int, x double")
    assert {r.k: r["quantile"] for r in aggregates.quantile_midpoint_distributed(rows, ["k"], "x", 0.5).collect()} == {None: 2.0, 1: None}
    assert {r.k: r.trimmed for r in aggregates.trimmed_mean(rows, ["k"], "x").collect()} == {None: 2.0, 1: None}
    text = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "s string")
    assert text.agg(aggregates.mode(F.col("s"), floating=False)).first()[0] == "b"
    back = spark.createDataFrame([("a", 0, 5.0, 1.0), ("a", 1, 3.0, 2.0)], "g string, i int, t double, x double")
    assert [r.ema for r in ema.ema_normal(back, ["g"], ["i"], "x", "t", 1.0).orderBy("i").collect()] == [1.0, 2.0]
    assert spark.createDataFrame([("12:30\n",)], "s string").select(datetimes.time_nanos(F.col("s"))).first()[0] == 0


def test_combine_filter(spark):
    from rowloom.operators import grouping

    def new(keys, keep):
        df = spark.createDataFrame(list(zip(range(len(keys)), keys, keep)), "row int, k int, keep boolean")
        rows, bins = grouping.combine_filter(df, "k", "row", F.col("keep"))
        return [r.bin for r in rows.orderBy("row").collect()], {r.bin: (r.first_row, r["count"]) for r in bins.collect()}

    assert new([0, 1, 2, 3, 4], [True, True, False, True, False]) == ([0, 1, 0, 2, 0], {1: (1, 1), 2: (3, 1)})
    assert new([3] * 5, [True, True, False, True, False]) == ([1, 1, 0, 1, 0], {1: (0, 3)})


def test_zeros_keep_their_sign(spark):
    values = [-0.99, -0.01, -0.0, 0.0, 0.4, -1e-300]
    made = {"floor": scalar.floor, "ceil": scalar.ceil, "truncate": scalar.truncate, "rounded": lambda x: scalar.rounded(x, 1)}
    rows = frame(spark, values).select("row_id", *[f(F.col("x")).alias(k) for k, f in made.items()]).orderBy("row_id").collect()
    text = {k: [str(r[k]) for r in rows] for k in made}
    assert text["floor"] == ["-1.0", "-1.0", "-0.0", "0.0", "0.0", "-1.0"]
    assert text["ceil"] == ["-0.0", "-0.0", "-0.0", "0.0", "1.0", "-0.0"]
    assert text["truncate"] == ["-0.0", "-0.0", "-0.0", "0.0", "0.0", "-0.0"]
    assert text["rounded"] == ["-1.0", "-0.0", "-0.0", "0.0", "0.4", "-0.0"]


def test_codes_of_stacked_parts_are_merged_by_first_occurrence(spark):
    listed = spark.createDataFrame([(0, 1, "b"), (0, 2, "a"), (1, 1, "c"), (1, 2, "a"), (2, 1, None), (2, 2, "b")], "part int, code int, label string")
    rows = spark.createDataFrame(
        [(0, 0, 2), (1, 1, 1), (2, 1, 2), (3, 2, 2), (4, 2, 1), (5, 0, 0), (6, 0, 3), (7, 1, -1), (8, 3, 1), (9, 0, None)], "row_id long, part int, code int")
    assert column(grouping.merge_codes(rows, listed, "part", "code", "label"), "merged") == [2, 3, 2, 1, 4, 0, 0, 0, 0, 0]
    assert grouping.merge_codes(rows.limit(0), listed, "part", "code", "label").count() == 0
    assert column(grouping.merge_codes(rows, listed.limit(0), "part", "code", "label"), "merged") == [0] * 10


def test_groups_start_again_in_each_part(spark):
    rows = [("y", 1), ("x", 1), ("y", 1), ("x", 2), (None, 2), ("y", 2), ("x", 2)]
    got = grouping.group_ids(frame(spark, rows, "row_id long, k string, part int"), ["k"], "row_id", parts=["part"])
    assert column(got, "group_id") == [1, 2, 1, 1, 2, 3, 1]
    assert column(got, "first_row") == [0, 1, 0, 3, 4, 5, 3]


def test_sorted_ids_with_filter_and_start(spark):
    df = frame(spark, [2.0, 1.0, 3.0, 1.0, None])
    got = grouping.sorted_group_ids(df, ["x"], keep=F.col("row_id") != 2, start=0)
    assert column(got, "group_id") == [2, 1, 0, 1, 0]
    assert column(grouping.sorted_group_ids(df, ["x"]), "group_id") == [3, 2, 4, 2, 1]


def test_bins_are_counted_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(grouping, "BLOCK", 3)
    got = grouping.bin_count(frame(spark, [(k,) for k in [0, 1, 1, 4, 7, 7, 7, 9]], "row_id long, k int"), "k", 8).orderBy("bin").collect()
    assert [r.n for r in got] == [1, 2, 0, 0, 1, 0, 0, 3, 0]
    assert [r.first for r in got] == [0, 1, 3, 3, 3, 4, 4, 4, 7]


def test_interpolation_with_a_table_in_each_row(spark):
    rows = [
        (0.5, [0.0, 1.0], [0.0, 10.0]), (-1.0, [0.0, 1.0], [0.0, 10.0]), (5.0, [0.0, 1.0, 2.0], [0.0, 1.0, 5.0]), (1.0, [0.0, 1.0, 2.0], [0.0, 1.0, 5.0]),
        (NAN, [0.0, 1.0], [0.0, 10.0]), (None, [0.0, 1.0], [0.0, 1.0]), (1.0, None, [1.0]), (1.0, [1.0], [1.0]), (1.0, [0.0, 1.0], [1.0]), (1.0, [], []),
    ]
    df = frame(spark, rows, "row_id long, x double, xs array<double>, ys array<double>")
    line, ends = (df.withColumn("y", interp.interpolate_rows(F.col("x"), F.col("xs"), F.col("ys"), clip)) for clip in (False, True))
    assert column(line, "y") == [5.0, -10.0, 17.0, 1.0, *[None] * 6]
    assert column(ends, "y") == [5.0, 0.0, 5.0, 1.0, *[None] * 6]


def test_mode_and_median_by_counts(spark):
    rows = [("a", 2.0, "q"), ("a", 1.0, "p"), ("a", 2.0, "p"), ("a", 1.0, None), ("a", NAN, None), ("b", None, None), (None, 3.0, "z")]
    df = frame(spark, rows, "row_id long, k string, x double, s string")
    assert {r.k: r.mode for r in aggregates.mode_distributed(df, ["k"], "x").collect()} == {"a": 1.0, "b": None, None: 3.0}
    assert {r.k: r.mode for r in aggregates.mode_distributed(df, ["k"], "s", floating=False).collect()} == {"a": "p", "b": None, None: "z"}
    assert {r.k: r.median for r in aggregates.median_distributed(df, ["k"], "x").collect()} == {"a": 1.5, "b": None, None: 3.0}


@pytest.mark.parametrize("text,pattern,seconds", [
    ("2001-02-03 04:05:06", "%F %T", 981173106), ("3 Feb 2001 04:05 PM", "%e %b %Y %I:%M %p", 981216300), ("02/03/01 04:05", "%D %R", 981173100), ("100% 2001", "100%% %Y", 978307200),
])
def test_more_strptime_directives(spark, text, pattern, seconds):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(datetimes.strptime_nanos(F.col("t"), pattern).alias("n")).first().n == seconds * 10**9


def test_unknown_strptime_directive_raises(spark):
    with pytest.raises(ValueError):
        datetimes.strptime_nanos(F.lit("x"), "%Q")


def test_rolling_state(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["b", "a", "b", None, "a", "c", None])], "row long, k string")
    got = [(r.bin, r.running, r.uniques) for r in grouping.rolling_state(df, ["k"], "row").orderBy("row").collect()]
    assert got == [(0, 1, 1), (1, 1, 2), (0, 2, 2), (2, 1, 3), (1, 2, 3), (3, 1, 4), (2, 2, 4)]
    assert grouping.rolling_state(df.limit(0), ["k"], "row").count() == 0


def test_folders(spark, tmp_path):
    path = str(tmp_path / "f")
    io.save(spark.createDataFrame([(1, 2, "x")], "`a/k` int, `ab/k` int, plain string"), path)
    assert io.load(spark, path, folders=["a"]).columns == ["a/k"]
    assert io.load(spark, path, folders=["a/", "ab"]).columns == ["a/k", "ab/k"]
    assert io.load(spark, path, include=["ab/k", "plain"], folders=["ab"]).columns == ["ab/k"]


def test_streamed_time_window(spark, tmp_path):
    from rowloom.streaming import running

    made = [(i, i % 3, i // 2, float(i * i % 11)) for i in range(60)]
    for part in range(3):  # a micro-batch for each file
        spark.createDataFrame(made[part * 20 : part * 20 + 20], "row long, k long, t long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("row long, k long, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.drain(running.running_time_window(rows, "k", "t", "row", "x", 4), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.row: r.total for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for i, k, t, _ in made:
        assert got[i] == sum(x for j, kk, tt, x in made if kk == k and j <= i and t - tt <= 4), i
    assert len(got) == len(made)


@pytest.mark.parametrize("size", [1, 40, 700, 10_000])
@pytest.mark.parametrize("dealt", ["random", "rising", "falling"])
def test_rows_of_a_stream_are_sorted_in_bounded_runs(size, dealt):
    import pandas as pd

    from rowloom.streaming import running

    n = 60 if size == 1 else 3000
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"t": rng.integers(0, n // 3, n), "row": rng.permutation(n), "name": [f"r{i}" for i in range(n)]})
    if dealt != "random":
        rows = rows.sort_values(["t", "row"], ascending=dealt == "rising")
    made = list(running.in_order((rows.iloc[at : at + 90] for at in range(0, n, 90)), ["t", "row"], size))
    assert max(map(len, made)) <= max(2 * size, 16)
    assert pd.concat(made, ignore_index=True).equals(rows.sort_values(["t", "row"], ignore_index=True))
    assert list(running.in_order(iter([]), ["t"], size)) == []


def test_streams_take_a_large_batch_of_a_key_in_runs(spark, tmp_path, monkeypatch):
    from rowloom.streaming import running

    monkeypatch.setattr(running, "RUN", 50)
    made = [(i, "ab"[i % 2], i // 3, float(i * i % 13)) for i in range(1200)]
    for part in range(2):  # a micro-batch for each file, its rows in no order
        rows = spark.createDataFrame(made[part * 600 : part * 600 + 600], "row long, k string, t long, x double")
        rows.orderBy(F.xxhash64("row")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("row long, k string, t long, x double").option("maxFilesPerTrigger", 1)
    forms = {
        "window": lambda rows: running.running_time_window(rows, "k", "t", "row", "x", 4),
        "ema": lambda rows: running.running_ema(rows, "k", "t", "row", "x", 0.5), "counts": lambda rows: running.running_counts(rows, "k", "row")}
    got = {}
    for name, form in forms.items():
        running.drain(form(source.parquet(str(tmp_path / "in"))), str(tmp_path / name), str(tmp_path / f"{name}-state"))
        got[name] = {r.row: r for r in spark.read.parquet(str(tmp_path / name)).collect()}
        assert len(got[name]) == len(made)
    average, last, seen = dict.fromkeys("ab", 0.0), dict.fromkeys("ab", 0), dict.fromkeys("ab", 0)
    for i, k, t, x in made:
        assert got["window"][i].total == sum(y for _, kk, tt, y in made[max(0, i - 20) : i + 1] if kk == k and t - tt <= 4)
        average[k], last[k] = x + average[k] * math.exp(-0.5 * (t - last[k])), t
        assert got["ema"][i].ema == pytest.approx(average[k], rel=1e-12)
        assert got["counts"][i].seen == seen[k]
        seen[k] += 1
