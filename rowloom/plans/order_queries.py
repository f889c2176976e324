"""Order-dependent operators over events, lineitem, orders and part."""

from __future__ import annotations

from math import exp

from pyspark.sql import functions as F

from rowloom.functions.datetimes import wall_micros
from rowloom.operators import cumulative, ema, interp, joins, rolling, sorting
from rowloom.operators.timewindow import time_window
from rowloom.plans.group_queries import GAPS, _gaps
from rowloom.plans.registry import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _roll(spark, sf, *spec):
    rows = rolling.grouped(_gaps(spark, sf), ["user_id"], ["event_id"], {"r": spec})
    return rows.select("event_id", F.round("r", 7).alias("r"))


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, CASE WHEN count(v) OVER f = count(*) OVER f THEN round(sum(v) OVER f, 7) END AS r FROM {GAPS} {_W.format(4)}")
def rolling_sum(spark, sf):
    return _roll(spark, sf, "sum", "v", 5)


@query(f"SELECT event_id, round(coalesce(sum(v) OVER f, 0), 7) AS r FROM {GAPS} {_W.format(2)}")
def rolling_nansum(spark, sf):
    return _roll(spark, sf, "nansum", "v", 3)


@query(f"SELECT event_id, CASE WHEN count(v) OVER f = count(*) OVER f THEN round(avg(v) OVER f, 7) END AS r FROM {GAPS} {_W.format(3)}")
def rolling_mean(spark, sf):
    return _roll(spark, sf, "mean", "v", 4)


@query(f"SELECT event_id, round(avg(v) OVER f, 7) AS r FROM {GAPS} {_W.format(9)}")
def rolling_nanmean(spark, sf):
    return _roll(spark, sf, "nanmean", "v", 10)


@query("SELECT event_id, round(value - lag(value, 3) OVER w, 7) AS r, round(value - lead(value, 2) OVER w, 7) AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def rolling_diff(spark, sf):
    rows = rolling.grouped(table(spark, sf, "events"), ["user_id"], ["event_id"], {"r": ("diff", "value", 3), "ahead": ("diff", "value", -2)})
    return rows.select("event_id", F.round("r", 7).alias("r"), F.round("ahead", 7).alias("ahead"))


@query("SELECT event_id, lag(event_type, 2) OVER w AS back, lead(value, 1) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def rolling_shift(spark, sf):
    return rolling.grouped(table(spark, sf, "events"), ["user_id"], ["event_id"], {"back": ("shift", "event_type", 2), "ahead": ("shift", "value", -1)}).select("event_id", "back", "ahead")


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS up, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS down FROM events
""")
def rolling_count(spark, sf):
    rows = rolling.grouped(table(spark, sf, "events"), ["user_id"], ["event_id"], {"up": ("count", "value", 1), "down": ("count", "value", -1)})
    return rows.select("event_id", F.col("up").cast("long").alias("up"), F.col("down").cast("long").alias("down"))


@query(f"""
WITH l AS (SELECT event_id, list_sort(list_filter(list(v) OVER f, lambda x: x IS NOT NULL)) AS h FROM {GAPS} {_W.format(6)})
SELECT event_id, round((h[floor((len(h) - 1) * 0.3)::INT + 1] + h[ceil((len(h) - 1) * 0.3)::INT + 1]) / 2, 7) AS r FROM l
""")
def rolling_quantile(spark, sf):
    return _roll(spark, sf, "quantile", "v", 7, 0.3)


@query(f"""
SELECT event_id, round(CASE WHEN row_number() OVER w > 5 THEN var_pop(value) OVER f ELSE var_samp(value) OVER f END, 6) AS var FROM events {_W.format(4)}
""")
def rolling_var(spark, sf):
    rows = rolling.grouped(table(spark, sf, "events"), ["user_id"], ["event_id"], {"var": ("var", "value", 5)})
    return rows.select("event_id", F.round("var", 6).alias("var"))


@query("""
SELECT event_id, round(sum(value) OVER f, 7) AS s, round(avg(value) OVER f, 7) AS m, round(value - lag(value, 4) OVER (ORDER BY event_id), 7) AS d
FROM events WINDOW f AS (ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")
def rolling_ungrouped(spark, sf):
    rows = rolling.ungrouped(table(spark, sf, "events"), ["event_id"], {"s": ("nansum", "value", 7), "m": ("nanmean", "value", 7), "d": ("diff", "value", 4)})
    return rows.select("event_id", *[F.round(c, 7).alias(c) for c in "smd"])


@query("""
SELECT event_id, round(CASE WHEN row_number() OVER (ORDER BY event_id) > 6 THEN var_pop(value) OVER f ELSE var_samp(value) OVER f END, 6) AS var
FROM events WINDOW f AS (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
""")
def rolling_ungrouped_var(spark, sf):
    rows = rolling.ungrouped_spread(table(spark, sf, "events"), ["event_id"], "value", 6)
    return rows.select("event_id", F.round("var", 6).alias("var"))


@query("SELECT event_id, lead(value, 2) OVER (ORDER BY event_id) AS value, lead(user_id, 2) OVER (ORDER BY event_id) AS user_id FROM events")
def shift_rows(spark, sf):
    return rolling.shift_rows(table(spark, sf, "events"), ["event_id"], ["value", "user_id"], 2).select("event_id", "value", "user_id")


_SEG = "(SELECT *, sum(CASE WHEN event_type = 'error' AND user_id % 3 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM " + GAPS + ")"
_RUN = "WINDOW r AS (PARTITION BY user_id, seg ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


def _run(spark, sf, made, e=None):
    rows = cumulative.running(_gaps(spark, sf) if e is None else e, ["user_id"], ["event_id"], made, F.col("user_id") % 3 > 0, F.col("event_type") == "error")
    return rows.select("event_id", *[F.round(c, 4).alias(c) if c != "nth" else F.col(c).cast("long").alias(c) for c in made])


@query(f"SELECT event_id, round(coalesce(sum(CASE WHEN user_id % 3 > 0 THEN v END) OVER r, 0), 4) AS s FROM {_SEG} {_RUN}")
def cumsum_mask_reset(spark, sf):
    return _run(spark, sf, {"s": ("cumsum", "v")})


@query("""
SELECT event_id, round(coalesce(product(CASE WHEN user_id % 3 > 0 THEN 0.98 + (event_id % 5) / 100.0 END) OVER r, 1), 4) AS p
FROM (SELECT *, sum(CASE WHEN event_type = 'error' AND user_id % 3 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM events) """ + _RUN)
def cumprod(spark, sf):
    e = table(spark, sf, "events").withColumn("x", 0.98 + (F.col("event_id") % 5) / 100.0)
    return _run(spark, sf, {"p": ("cumprod", "x")}, e)


@query(f"""
SELECT event_id, CASE WHEN count(*) FILTER (v IS NULL AND user_id % 3 > 0) OVER r = 0 THEN round(max(CASE WHEN user_id % 3 > 0 THEN v END) OVER r, 4) END AS hi,
       CASE WHEN count(*) FILTER (v IS NULL AND user_id % 3 > 0) OVER r = 0 THEN round(min(CASE WHEN user_id % 3 > 0 THEN v END) OVER r, 4) END AS lo FROM {_SEG} {_RUN}
""")
def cummax_strict(spark, sf):
    return _run(spark, sf, {"hi": ("cummax", "v"), "lo": ("cummin", "v")})


@query(f"SELECT event_id, round(min(CASE WHEN user_id % 3 > 0 THEN v END) OVER r, 4) AS lo, round(max(CASE WHEN user_id % 3 > 0 THEN v END) OVER r, 4) AS hi FROM {_SEG} {_RUN}")
def cumnanmin(spark, sf):
    return _run(spark, sf, {"lo": ("cumnanmin", "v"), "hi": ("cumnanmax", "v")})


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) ELSE 0 END::BIGINT AS nth FROM events
""")
def find_nth(spark, sf):
    rows = cumulative.running(table(spark, sf, "events"), ["user_id"], ["event_id"], {"nth": ("findnth", "value")}, F.col("event_type") == "click")
    return rows.select("event_id", F.col("nth").cast("long").alias("nth"))


def _timed(spark, sf):
    """Hours since 2024 began as the time."""
    return table(spark, sf, "events").withColumn("t", (wall_micros(F.col("ts")) - 1_704_067_200_000_000) / 3_600_000_000.0)


_TIMED = "(SELECT *, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS t FROM events)"


@query(f"""
WITH e AS (SELECT *, t - first_value(t) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM {_TIMED})
SELECT event_id, round(exp(-0.02 * d) * sum(value * exp(0.02 * d)) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS ema FROM e
""")
def ema_decay(spark, sf):
    return ema.ema_decay(_timed(spark, sf), ["user_id"], ["event_id"], "value", "t", 0.02).select("event_id", F.round("ema", 6).alias("ema"))


@query(f"""
WITH e AS (SELECT *, t - first_value(t) OVER w AS d, exp(-0.02 * (t - lag(t) OVER w)) AS s, row_number() OVER w AS i FROM {_TIMED} WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(exp(-0.02 * d) * sum((CASE WHEN i = 1 THEN value ELSE value * (1 - s) END) * exp(0.02 * d)) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS ema FROM e
""")
def ema_normal(spark, sf):
    return ema.ema_normal(_timed(spark, sf), ["user_id"], ["event_id"], "value", "t", 0.02).select("event_id", F.round("ema", 6).alias("ema"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, round(sum((CASE WHEN i = 0 THEN value ELSE value * (1 - exp(-0.05)) END) * exp(0.05 * i)) OVER (PARTITION BY user_id ORDER BY event_id) * exp(-0.05 * i), 6) AS ema FROM e
""")
def ema_weighted(spark, sf):
    return ema.ema_weighted(table(spark, sf, "events"), ["user_id"], ["event_id"], "value", exp(-0.05)).select("event_id", F.round("ema", 6).alias("ema"))


@query()
def ema_masked(spark, sf):
    """Include and reset masks: a recurrence, so no SQL; tests compare it with a plain loop."""
    e = _timed(spark, sf).withColumns({"m": F.col("event_type") != "view", "r": F.col("event_type") == "error"}).select("event_id", "user_id", "t", "value", "m", "r")
    return ema.ema_masked(e, ["user_id"], ["event_id"], "value", "t", 0.02, "m", "r").select("event_id", F.round("ema", 6).alias("ema"))


def _ties(spark, sf):
    return table(spark, sf, "events").withColumn("m", F.floor(wall_micros(F.col("ts")) / 7_200_000_000))


_TIES = "(SELECT *, epoch_us(ts) // 7200000000 AS m FROM events)"


@query(f"""
SELECT a.event_id, round(sum(b.value), 3) AS s FROM {_TIES} a JOIN {_TIES} b
  ON a.event_type = b.event_type AND b.event_id <= a.event_id AND b.m >= a.m - 6 AND b.m <= a.m GROUP BY 1
""")
def time_window_sum(spark, sf):
    return time_window(_ties(spark, sf), ["event_type"], "m", "event_id", "value", 6, name="s").select("event_id", F.round("s", 3).alias("s"))


@query(f"""
SELECT a.event_id, round(product(1 + (b.event_id % 7 - 3) / 100.0), 6) AS p FROM {_TIES} a JOIN {_TIES} b
  ON a.event_type = b.event_type AND b.event_id <= a.event_id AND b.m >= a.m - 4 AND b.m <= a.m GROUP BY 1
""")
def time_window_prod(spark, sf):
    e = _ties(spark, sf).withColumn("x", 1 + (F.col("event_id") % 7 - 3) / 100.0)
    return time_window(e, ["event_type"], "m", "event_id", "x", 4, "prod", "p").select("event_id", F.round("p", 6).alias("p"))


@query("""
WITH h AS (SELECT o_custkey % 700 AS k, min(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, p IS NOT NULL AS found, p AS position FROM customer LEFT JOIN h ON c_custkey = k
""")
def is_member(spark, sf):
    hay = table(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumn("k", F.col("o_custkey") % 700)
    return joins.is_member(table(spark, sf, "customer"), hay, ["c_custkey"], ["k"], "o_orderkey").select("c_custkey", "found", "position")


@query("""
WITH h AS (SELECT o_orderpriority AS a, o_orderstatus AS b, min(o_orderkey) AS p FROM orders WHERE o_totalprice > 300000 GROUP BY 1, 2)
SELECT o_orderkey, p IS NOT NULL AS found, p AS position FROM orders LEFT JOIN h ON a = o_orderpriority AND b = o_orderstatus
""")
def is_member_multikey(spark, sf):
    o = table(spark, sf, "orders")
    k = ["o_orderpriority", "o_orderstatus"]
    return joins.is_member(o, o.filter("o_totalprice > 300000"), k, k, "o_orderkey", null_safe=True).select("o_orderkey", "found", "position")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, sf):
    rich = table(spark, sf, "orders").filter("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return joins.semi(table(spark, sf, "customer"), rich, ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join(spark, sf):
    rich = table(spark, sf, "orders").filter("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return joins.anti(table(spark, sf, "customer"), rich, ["c_custkey"]).select("c_custkey")


@query("""
SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def lookup_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return table(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_name", "c_mktsegment")


def _sides(spark, sf):
    """Left: other events on a coarse clock, some without a time; right: clicks on it."""
    e = _ties(spark, sf)
    left = e.filter("event_type <> 'click'").withColumn("m", F.when(F.col("event_id") % 11 > 0, F.col("m")))
    return left, e.filter("event_type = 'click'").select("user_id", "m", F.col("event_id").alias("rid"))


def _asof_sql(op: str, pick: str, order: str) -> str:
    return f"""
WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 11 > 0 THEN m END AS m FROM {_TIES} WHERE event_type <> 'click'),
     r AS (SELECT user_id, m, event_id AS rid FROM {_TIES} WHERE event_type = 'click'),
     j AS (SELECT l.event_id, rid, row_number() OVER (PARTITION BY l.event_id ORDER BY r.m {order}, rid {order}) AS i FROM l JOIN r ON l.user_id = r.user_id AND r.m {op} l.m)
SELECT l.event_id, j.rid AS match FROM l LEFT JOIN j ON l.event_id = j.event_id AND i = 1
"""


def _asof(spark, sf, forward, exact):
    left, right = _sides(spark, sf)
    return joins.asof(left, right, ["user_id"], "m", "m", "event_id", "rid", forward, exact).select("event_id", "match")


@query(_asof_sql("<=", "last", "DESC"))
def asof_backward(spark, sf):
    return _asof(spark, sf, False, True)


@query(_asof_sql("<", "last", "DESC"))
def asof_backward_strict(spark, sf):
    return _asof(spark, sf, False, False)


@query(_asof_sql(">=", "first", "ASC"))
def asof_forward(spark, sf):
    return _asof(spark, sf, True, True)


@query(_asof_sql(">", "first", "ASC"))
def asof_forward_strict(spark, sf):
    return _asof(spark, sf, True, False)


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_brand ASC NULLS LAST, p_partkey) - 1 AS rank FROM part
""")
def lexsort(spark, sf):
    return sorting.lexsort(table(spark, sf, "part"), ["p_brand", "p_size"], [True, False], "p_partkey").select("p_partkey", "rank")


@query(f"SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) - 1 AS rank FROM {GAPS}")
def lexsort_nan_last(spark, sf):
    return sorting.lexsort(_gaps(spark, sf), ["v"], [False], "event_id").select("event_id", "rank")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) - 1 AS rank FROM events")
def partition_sort(spark, sf):
    rows = sorting.partition_sort(table(spark, sf, "events"), ["user_id"], ["value"], [False], "event_id")
    return rows.select("event_id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT 'ts' AS what, bool_and(ok) AS is_sorted FROM (SELECT coalesce(ts >= lag(ts) OVER (ORDER BY event_id), true) AS ok FROM events)
UNION ALL SELECT 'value', bool_and(ok) FROM (SELECT coalesce(value >= lag(value) OVER (ORDER BY event_id), true) AS ok FROM events)
""")
def is_sorted(spark, sf):
    e = table(spark, sf, "events")
    made = [rolling.is_sorted(e, ["event_id"], c).select(F.lit(c).alias("what"), "is_sorted") for c in ("ts", "value")]
    return made[0].unionByName(made[1])


@query("SELECT (p_partkey * 7) % 2003 AS pos, p_partkey AS value FROM part")
def reverse_permutation(spark, sf):
    p = table(spark, sf, "part").withColumn("i", F.col("p_partkey") * 7 % 2003)
    return sorting.reverse_permutation(p, "i", "p_partkey")


@query("""
WITH v AS (SELECT n_nationkey AS pos, n_name AS value FROM nation), i AS (SELECT s_suppkey, (s_suppkey % 61 - 30) AS idx FROM supplier)
SELECT s_suppkey, coalesce(value, 'none') AS value FROM i LEFT JOIN v ON pos = CASE WHEN idx < 0 THEN idx + 25 ELSE idx END
""")
def gather_default(spark, sf):
    i = table(spark, sf, "supplier").withColumn("idx", F.col("s_suppkey") % 61 - 30)
    return joins.gather(i, table(spark, sf, "nation"), "idx", "n_nationkey", "n_name", 25, F.lit("none")).select("s_suppkey", "value")


_XS, _YS = [950.0, 1100.0, 1400.0, 1800.0], [1.0, 3.0, 2.0, 8.0]


def _line_sql(clip: bool) -> str:
    line = lambda j: f"{_YS[j]} + (x - {_XS[j]}) * {(_YS[j + 1] - _YS[j]) / (_XS[j + 1] - _XS[j])!r}"
    ends = f"WHEN x <= {_XS[0]} THEN {_YS[0]} WHEN x >= {_XS[-1]} THEN {_YS[-1]}" if clip else ""
    return f"SELECT p_partkey, round(CASE {ends} WHEN x <= {_XS[1]} THEN {line(0)} WHEN x <= {_XS[2]} THEN {line(1)} ELSE {line(2)} END, 6) AS y FROM (SELECT p_partkey, p_retailprice AS x FROM part)"


@query(_line_sql(True))
def interp_clip(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(interp.interpolate(F.col("p_retailprice"), _XS, _YS, True), 6).alias("y"))


@query("""
WITH k AS (SELECT p_partkey, p_retailprice AS x, 900.0 + p_size AS x0, 1100.0 + p_size AS x1, 1500.0 + p_size AS x2, p_size * 1.0 AS y0, 2.0 AS y1, p_size * 3.0 AS y2 FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN
  round(CASE WHEN x <= x1 THEN y0 + (x - x0) * (y1 - y0) / 200.0 ELSE y1 + (x - x1) * (y2 - y1) / 400.0 END, 6) END AS y,
  CASE WHEN p_partkey % 11 <> 0 THEN
  round(CASE WHEN x <= x0 THEN y0 WHEN x >= x2 THEN y2 WHEN x <= x1 THEN y0 + (x - x0) * (y1 - y0) / 200.0 ELSE y1 + (x - x1) * (y2 - y1) / 400.0 END, 6) END AS y_clip
FROM k
""")
def interp_row_tables(spark, sf):
    size = F.col("p_size").cast("double")
    xs = F.when(F.col("p_partkey") % 11 != 0, F.array(size + 900, size + 1100, size + 1500))
    ys, x = F.array(size, F.lit(2.0), size * 3), F.col("p_retailprice")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(interp.interpolate_rows(x, xs, ys), 6).alias("y"), F.round(interp.interpolate_rows(x, xs, ys, True), 6).alias("y_clip"))


@query(_line_sql(False))
def interp_extrap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(interp.interpolate(F.col("p_retailprice"), _XS, _YS), 6).alias("y"))
