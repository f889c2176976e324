"""Grouping and aggregation over lineitem, events and orders.

Invalid values are planted alike in the query and its SQL: every 7th event has a NULL value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import aggregates as agg
from rowloom.operators import grouping
from rowloom.plans.registry import table

QUERIES, SQL = {}, {}
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _gaps(spark, sf):
    """events with NULL, and one NaN, in ``value``."""
    e = table(spark, sf, "events")
    return e.withColumn("v", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 1001 == 5, float("nan")).otherwise(F.col("value")))


#: The same rows in SQL, NaN already NULL.
GAPS = "(SELECT *, CASE WHEN event_id % 7 = 0 OR event_id % 1001 = 5 THEN NULL ELSE value END AS v FROM events)"


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_quantity), 6) AS mean_qty,
       min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, round(var_samp(l_quantity), 6) AS var_qty,
       round(stddev_samp(l_quantity), 6) AS std_qty, median(l_quantity) AS median_qty, count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
def group_agg_strict(spark, sf):
    q = F.col("l_quantity")
    a = lambda k: agg.aggregate(k, q)
    return agg.group_aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "sum_qty": a("sum"), "mean_qty": F.round(a("mean"), 6), "min_qty": a("min"), "max_qty": a("max"),
        "var_qty": F.round(a("var"), 6), "std_qty": F.round(a("std"), 6), "median_qty": agg.median(q), "n": F.count(F.lit(1))})


@query(f"""
SELECT user_id, CASE WHEN count(v) = count(*) THEN round(sum(v), 4) END AS s, CASE WHEN count(v) = count(*) THEN max(v) END AS hi,
       CASE WHEN count(v) = count(*) THEN round(var_samp(v), 4) END AS var
FROM (SELECT user_id, CASE WHEN event_id % 7 = 0 AND user_id % 2 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1
""")
def group_agg_strict_gaps(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.expr("CASE WHEN event_id % 7 = 0 AND user_id % 2 = 0 THEN NULL ELSE value END"))
    v = F.col("v")
    return agg.group_aggregate(e, ["user_id"], {"s": F.round(agg.aggregate("sum", v), 4), "hi": agg.aggregate("max", v), "var": F.round(agg.aggregate("var", v), 4)})


@query(f"""
SELECT event_type, round(coalesce(sum(v), 0), 3) AS nansum, round(avg(v), 6) AS nanmean, min(v) AS nanmin, max(v) AS nanmax,
       round(var_samp(v), 4) AS nanvar, round(stddev_samp(v), 5) AS nanstd FROM {GAPS} GROUP BY 1
""")
def group_agg_skipnan(spark, sf):
    v = F.col("v")
    a = lambda k: agg.aggregate(k, v, skip=True)
    return agg.group_aggregate(_gaps(spark, sf), ["event_type"], {
        "nansum": F.round(a("sum"), 3), "nanmean": F.round(a("mean"), 6), "nanmin": a("min"), "nanmax": a("max"),
        "nanvar": F.round(a("var"), 4), "nanstd": F.round(a("std"), 5)})


@query("""
WITH r AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS j FROM events)
SELECT user_id, max(value) FILTER (i = 1) AS first_value, max(value) FILTER (j = 1) AS last_value,
       max(event_type) FILTER (i = 1) AS first_type, max(value) FILTER (i = 6) AS nth5, max(value) FILTER (j = 2) AS nth_last2
FROM r GROUP BY 1
""")
def group_first_last_nth(spark, sf):
    e = table(spark, sf, "events")
    order = F.col("event_id")
    ends = agg.group_aggregate(e, ["user_id"], {
        "first_value": agg.first(F.col("value"), order), "last_value": agg.last(F.col("value"), order), "first_type": agg.first(F.col("event_type"), order)})
    return ends.join(agg.nth(e, ["user_id"], "value", ["event_id"], 5, "nth5"), "user_id").join(
        agg.nth(e, ["user_id"], "value", ["event_id"], -2, "nth_last2"), "user_id")


@query(f"SELECT event_type, median(v) AS med FROM {GAPS} GROUP BY 1")
def group_median(spark, sf):
    return agg.median_distributed(_gaps(spark, sf), ["event_type"], "v", "med")


@query("""
SELECT l_shipdate::DATE AS ship, (SELECT 1) AS one, q AS mode_qty FROM (
  SELECT l_shipdate, l_quantity AS q, row_number() OVER (PARTITION BY l_shipdate ORDER BY count(*) DESC, l_quantity) AS i
  FROM lineitem GROUP BY 1, 2) WHERE i = 1
""")
def group_mode(spark, sf):
    made = agg.mode_distributed(table(spark, sf, "lineitem"), ["l_shipdate"], "l_quantity", "mode_qty")
    return made.select(F.col("l_shipdate").cast("date").alias("ship"), F.lit(1).alias("one"), "mode_qty")


@query(f"""
WITH s AS (SELECT user_id, list_sort(list(v)) AS l, count(v) AS n FROM {GAPS} WHERE v IS NOT NULL GROUP BY 1)
SELECT user_id, (l[floor((n - 1) * 0.2)::INT + 1] + l[ceil((n - 1) * 0.2)::INT + 1]) / 2 AS q20 FROM s
""")
def group_quantile_midpoint(spark, sf):
    return agg.quantile_midpoint_distributed(_gaps(spark, sf), ["user_id"], "v", 0.2, "q20")


@query("""
WITH RECURSIVE n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
tail AS (
  SELECT l_returnflag, n, 0 AS k, exp(-n * 1e-4) AS term, exp(-n * 1e-4) AS total FROM n
  UNION ALL SELECT l_returnflag, n, k + 1, term * n * 1e-4 / (k + 1), total + term * n * 1e-4 / (k + 1) FROM tail WHERE total < 0.996
), k AS (SELECT l_returnflag, n, max(k) AS k FROM tail GROUP BY 1, 2),
r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i FROM lineitem),
b AS (SELECT r.l_returnflag, max(x) FILTER (i = k) AS lo, max(x) FILTER (i = n - k + 1) AS hi, max(x) FILTER (i = k + 1) AS lo1, max(x) FILTER (i = n - k) AS hi1
      FROM r JOIN k USING (l_returnflag) GROUP BY 1)
SELECT r.l_returnflag, round(avg(x), 4) AS trimmed FROM r JOIN b USING (l_returnflag) WHERE x >= lo1 AND x <= hi1 GROUP BY 1
""")
def group_trimmed_mean(spark, sf):
    made = agg.trimmed_mean(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return made.withColumn("trimmed", F.round("trimmed", 4))


@query(f"""
SELECT round(sum(value), 3) AS sum_plain, CASE WHEN count(v) = count(*) THEN 0 END AS sum_strict, round(coalesce(sum(v), 0), 3) AS nansum,
       round(coalesce(avg(v), 0), 6) AS nanmean, round(var_samp(v), 4) AS nanvar, round(var_pop(v), 4) AS nanvar0, min(v) AS nanmin, max(v) AS nanmax,
       round(stddev_samp(v), 5) AS nanstd FROM {GAPS}
""")
def reduce_all(spark, sf):
    e = _gaps(spark, sf)
    r, r0 = agg.reduce_all(e, "v"), agg.reduce_all(e, "v", 0).select(F.round("nanvar", 4).alias("nanvar0"))
    plain = agg.reduce_all(e, "value").select(F.round("sum", 3).alias("sum_plain"))
    one = F.lit(1)
    made = r.select(one.alias("i"), F.col("sum").cast("int").alias("sum_strict"), F.round("nansum", 3).alias("nansum"), F.round("nanmean", 6).alias("nanmean"),
                    F.round("nanvar", 4).alias("nanvar"), "nanmin", "nanmax", F.round("nanstd", 5).alias("nanstd"))
    return made.join(r0.withColumn("i", one), "i").join(plain.withColumn("i", one), "i").drop("i")


@query(f"""
SELECT (SELECT min(event_id) FROM {GAPS} WHERE v IS NULL) AS argmin, (SELECT min(event_id) FROM {GAPS} WHERE v IS NULL) AS argmax,
       (SELECT event_id FROM {GAPS} WHERE v IS NOT NULL ORDER BY v, event_id LIMIT 1) AS nanargmin,
       (SELECT event_id FROM {GAPS} WHERE v IS NOT NULL ORDER BY v DESC, event_id LIMIT 1) AS nanargmax
""")
def argmin_argmax(spark, sf):
    return agg.arg_extremes(_gaps(spark, sf), "v", "event_id")


@query("""
WITH f AS (SELECT event_type, user_id % 10 AS u, min(event_id) AS first_row FROM events GROUP BY 1, 2),
     n AS (SELECT *, row_number() OVER (ORDER BY first_row) AS group_id FROM f)
SELECT event_id, first_row, group_id FROM events e JOIN n ON n.event_type = e.event_type AND n.u = e.user_id % 10
""")
def group_ids_first_occurrence(spark, sf):
    e = table(spark, sf, "events").withColumn("u", F.col("user_id") % 10)
    return grouping.group_ids(e, ["event_type", "u"], "event_id").select("event_id", "first_row", "group_id")


@query("""
WITH f AS (SELECT user_id, min(event_id) AS first_row FROM events WHERE value > 50 GROUP BY 1),
     n AS (SELECT user_id, row_number() OVER (ORDER BY first_row) AS group_id FROM f)
SELECT event_id, CASE WHEN value > 50 THEN group_id ELSE 0 END AS group_id FROM events LEFT JOIN n USING (user_id)
""")
def group_ids_filtered(spark, sf):
    e = table(spark, sf, "events")
    return grouping.group_ids(e, ["user_id"], "event_id", F.col("value") > 50).select("event_id", "group_id")


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type, user_id) AS group_id FROM events")
def group_ids_sorted(spark, sf):
    return grouping.sorted_group_ids(table(spark, sf, "events"), ["event_type", "user_id"]).select("event_id", "group_id")


@query("SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS first_row FROM orders GROUP BY 1, 2")
def unique_first_rows(spark, sf):
    return grouping.unique_rows(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("""
SELECT event_id, lead(event_id) OVER w AS next_row, lag(event_id) OVER w AS prev_row FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def next_prev_row(spark, sf):
    return grouping.neighbours(table(spark, sf, "events"), ["user_id"], "event_id").select("event_id", "next_row", "prev_row")


@query("""
WITH c AS (SELECT b AS bin, (SELECT count(*) FROM events WHERE user_id % 40 = b AND user_id % 40 <> 3) AS n FROM (SELECT unnest(range(46)) AS b))
SELECT bin, n, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c
""")
def bin_count_pack(spark, sf):
    e = table(spark, sf, "events").withColumn("b", F.col("user_id") % 40).filter("b <> 3")
    return grouping.bin_count(e, "b", 45)


@query("""
WITH f AS (SELECT event_id % 5 AS part, user_id, min(event_id) AS first_row FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY first_row) AS group_id FROM f)
SELECT event_id, group_id, first_row FROM events JOIN n ON part = event_id % 5 AND n.user_id = events.user_id
""")
def group_ids_in_parts(spark, sf):
    e = table(spark, sf, "events").withColumn("part", F.col("event_id") % 5)
    return grouping.group_ids(e, ["user_id"], "event_id", parts=["part"]).select("event_id", "group_id", "first_row")


@query("""
WITH c AS (SELECT part, label, row_number() OVER (PARTITION BY part ORDER BY CASE WHEN part = 0 THEN label END, label DESC) AS code
           FROM (SELECT DISTINCT event_id % 3 AS part, event_type AS label FROM events WHERE event_id % 3 > 0 OR event_type > 'c')),
n AS (SELECT label, row_number() OVER (ORDER BY min((part, code))) AS merged FROM c GROUP BY 1)
SELECT event_id, coalesce(merged, 0) AS merged FROM events LEFT JOIN n
  ON label = event_type AND event_id % 50 <> 0 AND (event_id % 3 > 0 OR event_type > 'c')
""")
def stacked_codes_merged(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("part"))
    listed = e.filter("part > 0 OR event_type > 'c'").select("part", F.col("event_type").alias("label")).distinct()
    code = F.expr("row_number() OVER (PARTITION BY part ORDER BY CASE WHEN part = 0 THEN label END, label DESC)")
    listed = listed.withColumn("code", code)
    own = e.join(listed.select(F.col("part").alias("p"), "label", "code"), (F.col("part") == F.col("p")) & (F.col("event_type") == F.col("label")), "left")
    rows = own.select("event_id", "part", F.when(F.col("event_id") % 50 != 0, F.col("code")).alias("code"))  # others are in no list
    return grouping.merge_codes(rows, listed, "part", "code", "label").select("event_id", "merged")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events")
def group_pack(spark, sf):
    return grouping.pack(table(spark, sf, "events"), ["user_id"], "event_id").select("event_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT user_id % 20 AS bin, min(event_id) AS first_row, max(event_id) AS last_row FROM events WHERE value > 20 AND user_id % 20 <> 0 GROUP BY 1
""")
def bin_first_last(spark, sf):
    e = table(spark, sf, "events").withColumn("bin", F.col("user_id") % 20)
    return grouping.first_last_rows(e, "bin", "event_id", F.col("value") > 20)


@query("""
SELECT event_id, CASE WHEN value > 10 AND user_id % 5 > 0 AND user_id % 7 > 0 AND (user_id % 7) * 5 + user_id % 5 <= 31
       THEN (user_id % 7) * 5 + user_id % 5 ELSE 0 END AS bin FROM events
""")
def combine_two_bins(spark, sf):
    made = grouping.combine_bins(F.col("user_id") % 5, F.col("user_id") % 7, 5, 31, F.col("value") > 10)
    return table(spark, sf, "events").select("event_id", made.cast("long").alias("bin"))


@query("""
WITH m AS (SELECT * FROM (VALUES (0, 10), (1, 20), (2, 20), (4, 30)) t(code, new))
SELECT n_nationkey, coalesce(new, 0) AS region FROM nation LEFT JOIN m ON n_regionkey = code
""")
def regroup_mapping(spark, sf):
    mapping = spark.createDataFrame([(0, 10), (1, 20), (2, 20), (4, 30)], "code int, new int")
    return grouping.remap(table(spark, sf, "nation"), "n_regionkey", mapping, "region").select("n_nationkey", "region")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS running FROM events")
def running_group_count(spark, sf):
    packed = grouping.pack(table(spark, sf, "events"), ["user_id"], "event_id")
    return packed.select("event_id", F.col("place").cast("long").alias("running"))


@query("""
WITH f AS (SELECT event_type, user_id % 50 AS u, min(event_id) AS first_row FROM events GROUP BY 1, 2),
     n AS (SELECT *, row_number() OVER (ORDER BY first_row) - 1 AS bin FROM f)
SELECT event_id, bin, count(*) OVER (PARTITION BY bin ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running,
       max(bin) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1 AS uniques
FROM events e JOIN n ON n.event_type = e.event_type AND n.u = e.user_id % 50
""")
def rolling_key_state(spark, sf):
    e = table(spark, sf, "events").withColumn("u", F.col("user_id") % 50)
    return grouping.rolling_state(e, ["event_type", "u"], "event_id").select("event_id", "bin", "running", "uniques")


@query("""
WITH e AS (SELECT event_id, user_id % 20 AS b, value > 40 AND user_id % 20 > 0 AS alive FROM events),
n AS (SELECT b, min(event_id) AS first_row, count(*) AS count, row_number() OVER (ORDER BY min(event_id)) AS bin FROM e WHERE alive GROUP BY b)
SELECT event_id, CASE WHEN alive THEN bin ELSE 0 END AS bin, CASE WHEN alive THEN first_row END AS first_row, CASE WHEN alive THEN count END AS count
FROM e LEFT JOIN n USING (b)
""")
def combine_filter(spark, sf):
    e = table(spark, sf, "events").withColumn("b", F.col("user_id") % 20)
    rows, bins = grouping.combine_filter(e, "b", "event_id", F.col("value") > 40)
    return rows.join(bins, "bin", "left").select("event_id", "bin", "first_row", "count")


@query("""
WITH e AS (SELECT user_id % 9 AS g, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v FROM events),
r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(v) OVER (PARTITION BY g) AS n FROM e WHERE v IS NOT NULL)
SELECT g, q FROM (SELECT DISTINCT g FROM e) a LEFT JOIN (
  SELECT g, (max(v) FILTER (i = floor((n - 1) * 0.3)) + max(v) FILTER (i = ceil((n - 1) * 0.3))) / 2 AS q FROM r GROUP BY 1) b USING (g)
""")
def group_quantile_empty_groups(spark, sf):
    e = table(spark, sf, "events").withColumn("g", F.col("user_id") % 9).withColumn("v", F.when(F.col("user_id") % 3 != 0, F.col("value")))
    return agg.quantile_midpoint_distributed(e, ["g"], "v", 0.3, "q")
