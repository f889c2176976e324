"""Element-wise functions, dates, bins, files and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from rowloom.functions import binning, datetimes, scalar
from rowloom.functions.nulls import invalid
from rowloom.operators import joins
from rowloom.plans.group_queries import GAPS, _gaps
from rowloom.plans.registry import table
from rowloom.sources import io
from rowloom.streaming import running

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice + l_tax AS added, l_extendedprice - l_discount AS less,
       round(l_extendedprice * l_discount, 6) AS times, round(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / (l_linenumber - 3) END, 6) AS over,
       CASE WHEN l_linenumber = 3 THEN l_quantity > 0 END AS over_zero_is_inf,
       floor((l_partkey - 1000) / 7.0)::BIGINT AS floordiv, (l_partkey - 1000) % 7 AS mod, (l_partkey - 1000) - 7 * floor((l_partkey - 1000) / 7.0)::BIGINT AS remainder,
       round(l_quantity ** 2, 4) AS power, least(l_quantity, l_linenumber::DOUBLE) AS lo, greatest(l_quantity, l_linenumber::DOUBLE) AS hi
FROM lineitem
""")
def elementwise_math(spark, sf):
    q, p, d, n = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_linenumber")
    k = F.col("l_partkey") - 1000
    over = scalar.divide(q, n - 3)
    return table(spark, sf, "lineitem").select(
        *_LINE, (p + F.col("l_tax")).alias("added"), (p - d).alias("less"), F.round(p * d, 6).alias("times"),
        F.round(F.when(~scalar.is_infinite(over), over), 6).alias("over"), F.when(n == 3, over == float("inf")).alias("over_zero_is_inf"),
        scalar.floor_divide(k, F.lit(7)).alias("floordiv"), scalar.modulo(k, F.lit(7)).alias("mod"), scalar.remainder(k, F.lit(7)).cast("long").alias("remainder"),
        F.round(F.pow(q, F.lit(2)), 4).alias("power"), scalar.minimum(q, n.cast("double")).alias("lo"), scalar.maximum(q, n.cast("double")).alias("hi"))


@query("""
SELECT c_custkey, abs(c_acctbal) AS a, -c_acctbal AS neg, sign(c_acctbal)::DOUBLE AS sgn, floor(c_acctbal) AS fl, ceil(c_acctbal) AS ce, trunc(c_acctbal) AS tr,
       round_even(c_acctbal, 0) AS ri, round(sqrt(abs(c_acctbal)), 6) AS sq, round(cbrt(c_acctbal), 6) AS cb,
       CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS ln, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS l10,
       CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 6) END AS l2, c_acctbal <= 0 AS ln_is_not_finite,
       round(exp(c_acctbal / 10000), 8) AS ex, round(2 ** (c_acctbal / 10000), 8) AS ex2, round(sin(c_acctbal), 6) AS si, c_acctbal < 0 AS sb
FROM customer
""")
def elementwise_unary(spark, sf):
    x = F.col("c_acctbal")
    finite = lambda c: scalar.rounded(F.when(scalar.is_finite(c), c), 6)
    return table(spark, sf, "customer").select(
        "c_custkey", F.abs(x).alias("a"), (-x).alias("neg"), F.signum(x).alias("sgn"), scalar.floor(x).alias("fl"), scalar.ceil(x).alias("ce"),
        scalar.truncate(x).alias("tr"), F.rint(x).alias("ri"), F.round(F.sqrt(F.abs(x)), 6).alias("sq"), scalar.rounded(F.cbrt(x), 6).alias("cb"),
        finite(scalar.log(x)).alias("ln"), finite(scalar.log(x, "10")).alias("l10"), finite(scalar.log(x, "2")).alias("l2"), (~scalar.is_finite(scalar.log(x))).alias("ln_is_not_finite"),
        F.round(F.exp(x / 10000), 8).alias("ex"), F.round(F.pow(F.lit(2.0), x / 10000), 8).alias("ex2"), scalar.rounded(F.sin(x), 6).alias("si"), scalar.sign_bit(x).alias("sb"))


@query(f"""
SELECT event_id, v IS NULL AS isnan, v IS NOT NULL AS isnotnan, v IS NULL OR v = 0 AS isnanorzero, v IS NOT NULL AND v <= 50 AS le, v IS NOT NULL AND v < 50 AS lt,
       v IS NOT NULL AND v = value AS eq,
       v IS NULL OR v <> value AS ne, v IS NOT NULL AND v > 50 AS gt, v IS NOT NULL AND v >= 50 AS ge, v IS NOT NULL AS finite FROM {GAPS}
""")
def compare_with_nan(spark, sf):
    v, fifty = F.coalesce(F.col("v"), F.lit(float("nan"))), F.lit(50.0)
    return _gaps(spark, sf).select(
        "event_id", invalid(v).alias("isnan"), (~invalid(v)).alias("isnotnan"), (invalid(v) | (v == 0)).alias("isnanorzero"),
        scalar.less_equal(v, fifty).alias("le"), scalar.less(v, fifty).alias("lt"), scalar.equal(v, F.col("value")).alias("eq"), scalar.not_equal(v, F.col("value")).alias("ne"),
        scalar.less(fifty, v).alias("gt"), scalar.less_equal(fifty, v).alias("ge"), scalar.is_finite(v).alias("finite"))


@query("""
SELECT o_orderkey, (o_orderkey & 12) AS band, (o_orderkey | 5) AS bor, xor(o_orderkey, 9) AS bxor, o_orderkey & ~6 AS andnot, ~o_orderkey AS inv,
       o_orderkey << 2 AS lsh, o_orderkey >> 1 AS rsh, bit_count(o_orderkey)::INTEGER AS bits,
       (o_orderkey % 2 = 0) AND o_orderstatus = 'F' AS land, (o_orderkey % 2 = 0) OR o_orderstatus = 'F' AS lor, (o_orderkey % 2 = 0) <> (o_orderstatus = 'F') AS lxor
FROM orders
""")
def bitwise_logical(spark, sf):
    k, even, f = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        "o_orderkey", k.bitwiseAND(12).alias("band"), k.bitwiseOR(5).alias("bor"), k.bitwiseXOR(9).alias("bxor"), k.bitwiseAND(~6).alias("andnot"), F.bitwise_not(k).alias("inv"),
        F.shiftleft(k, 2).alias("lsh"), F.shiftright(k, 1).alias("rsh"), F.bit_count(k).alias("bits"), (even & f).alias("land"), (even | f).alias("lor"), (even != f).alias("lxor"))


@query("""
SELECT event_id, CASE WHEN value > 50 THEN value ELSE -1.0 END AS w, CASE WHEN event_type = 'click' THEN 0.0 ELSE value END AS masked,
       CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS combined FROM events
""")
def where_putmask(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.when(v > 50, v).otherwise(-1.0).alias("w"), F.when(F.col("event_type") == "click", 0.0).otherwise(v).alias("masked"),
        F.when(F.col("event_type") != "error", F.col("user_id")).otherwise(0).alias("combined"))


@query("SELECT event_id, value FROM events WHERE value > 90 AND event_type = 'click'")
def boolean_filter(spark, sf):
    return table(spark, sf, "events").filter((F.col("value") > 90) & (F.col("event_type") == "click")).select("event_id", "value")


@query("""
SELECT count(*) FILTER (value > 50) AS trues, (SELECT count(*) FROM (SELECT * FROM """ + GAPS + """ WHERE v IS NULL)) AS invalids FROM events
""")
def boolean_sum(spark, sf):
    return _gaps(spark, sf).agg(F.count_if(F.col("value") > 50).alias("trues"), F.count_if(invalid(F.col("v"))).alias("invalids"))


@query("""
SELECT count(*) FILTER (event_id % 1001 = 5) AS nans, count(*) FILTER (event_id % 101 = 3 AND event_id % 1001 <> 5) AS infs,
       count(*) FILTER (event_id % 103 = 4 AND event_id % 101 <> 3 AND event_id % 1001 <> 5) AS minus_infs FROM events
""")
def nan_inf_count(spark, sf):
    i, inf = F.col("event_id"), float("inf")
    x = F.when(i % 1001 == 5, float("nan")).when(i % 101 == 3, inf).when(i % 103 == 4, -inf).otherwise(F.col("value"))
    e = table(spark, sf, "events").select(x.alias("x"))
    return e.agg(F.count_if(F.isnan("x")).alias("nans"), F.count_if(F.col("x") == inf).alias("infs"), F.count_if(F.col("x") == -inf).alias("minus_infs"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 4 AND p_partkey <= 1500 THEN -p_partkey::DOUBLE ELSE p_retailprice END AS price FROM part
""")
def set_item_by_index(spark, sf):
    p = table(spark, sf, "part")
    items = p.filter("p_partkey % 9 = 4 AND p_partkey <= 1500").select("p_partkey", (-F.col("p_partkey")).cast("double").alias("new"), F.lit(0).alias("order"))
    return joins.set_items(p, "p_partkey", "p_retailprice", items, "price").select("p_partkey", "price")


@query("SELECT user_id, max(value) - min(value) AS spread, count(*) AS n FROM events GROUP BY 1")
def group_apply(spark, sf):
    def spread(rows):
        import pandas as pd

        return pd.DataFrame({"user_id": [rows.user_id.iloc[0]], "spread": [rows.value.max() - rows.value.min()], "n": [len(rows)]})

    return joins.apply_groups(table(spark, sf, "events").select("user_id", "value"), ["user_id"], spread, "user_id long, spread double, n long")


@query("""
WITH c AS (SELECT n_name AS label, min(n_nationkey) AS position FROM nation WHERE n_regionkey IN (1, 3) GROUP BY 1)
SELECT s_suppkey, position, position IS NOT NULL AS found FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN c ON label = n_name
""")
def is_member_categorical(spark, sf):
    n = table(spark, sf, "nation")
    codes = n.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    hay = n.filter("n_regionkey IN (1, 3)").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("position"))
    return joins.is_member_categorical(table(spark, sf, "supplier"), codes, hay, "s_nationkey").select("s_suppkey", "position", "found")


@query("""
WITH p AS (SELECT p_size, p_retailprice, max(p_partkey) AS last FROM part GROUP BY 1, 2)
SELECT o_orderkey, last AS match FROM (SELECT o_orderkey, o_orderkey % 50 AS bin, o_totalprice / 100 AS v FROM orders) o
ASOF LEFT JOIN p ON o.bin = p.p_size AND o.v >= p.p_retailprice
""")
def merge_binned_sorted(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 50).cast("int").alias("bin"), (F.col("o_totalprice") / 100).alias("v"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("bin"), F.col("p_retailprice").alias("v"))
    return joins.asof(o, p, ["bin"], "v", "v", "o_orderkey", "p_partkey").select("o_orderkey", "match")


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment < 'BUILDING' OR c_mktsegment > 'HOUSEHOLD' THEN 0
       ELSE greatest(1, (CASE WHEN 'BUILDING' < c_mktsegment THEN 1 ELSE 0 END) + (CASE WHEN 'FURNITURE' < c_mktsegment THEN 1 ELSE 0 END) + (CASE WHEN 'HOUSEHOLD' < c_mktsegment THEN 1 ELSE 0 END))
       END::INTEGER AS bin FROM customer
""")
def cut_strings(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", binning.cut_strings(F.col("c_mktsegment"), ["BUILDING", "FURNITURE", "HOUSEHOLD"]).alias("bin"))


@query("SELECT event_id, value > 50 AS hit, row_number() OVER (ORDER BY (value > 50) DESC, event_id) - 1 AS place FROM events")
def boolean_to_positions(spark, sf):
    from rowloom.operators.ordered import with_position

    e = table(spark, sf, "events").withColumn("hit", F.col("value") > 50).withColumn("miss", ~F.col("hit"))
    return with_position(e, ["miss", "event_id"], "place").select("event_id", "hit", "place")


@query("SELECT c_custkey, c_name || ':' || c_mktsegment AS joined, rtrim(c_mktsegment || '  ') AS stripped FROM customer")
def string_concat(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(":"), "c_mktsegment").alias("joined"), scalar.strip_right(F.concat("c_mktsegment", F.lit("  "))).alias("stripped"))


@query("""
SELECT event_id, try_cast(user_id AS INTEGER) AS i, value::INTEGER IS NOT NULL AS ok, user_id::DOUBLE AS d, user_id::VARCHAR AS s FROM events
""")
def convert_types(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").try_cast("int").alias("i"), F.col("value").try_cast("int").isNotNull().alias("ok"), F.col("user_id").cast("double").alias("d"), F.col("user_id").cast("string").alias("s"))


@query()
def crc64_text(spark, sf):
    """64-bit ECMA checksums; tests hold them against a known value."""
    return table(spark, sf, "nation").select("n_nationkey", scalar.crc64(F.col("n_name").cast("binary")).alias("crc"))


@query()
def compress_round_trip(spark, sf):
    """zstd in memory and back."""
    made = table(spark, sf, "nation").select("n_nationkey", "n_name", io.compress(F.col("n_name").cast("binary")).alias("z"))
    return made.select("n_nationkey", (io.decompress(F.col("z")).cast("string") == F.col("n_name")).alias("same"))


@query("""
SELECT event_id, ((hour(ts) * 60 + minute(ts)) * 60 + second(ts)) * 1000000000 + 250000000 AS t, hour(ts) * 3600000000000 + minute(ts) * 60000000000 AS hm, 0::BIGINT AS bad FROM events
""")
def parse_time(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.hour("ts"), F.minute("ts"), F.second("ts")
    return table(spark, sf, "events").select(
        "event_id", datetimes.time_nanos(F.concat_ws(":", two(h), two(m), F.concat(two(s), F.lit(".25")))).alias("t"),
        datetimes.time_nanos(F.concat_ws(":", h.cast("string"), two(m))).alias("hm"), datetimes.time_nanos(F.concat(F.lit("25:"), two(m))).alias("bad"))


@query("SELECT o_orderkey, epoch(o_orderdate::DATE)::BIGINT * 1000000000 AS a, epoch(o_orderdate::DATE)::BIGINT * 1000000000 AS b, 0::BIGINT AS bad FROM orders")
def parse_date(spark, sf):
    day = F.col("o_orderdate").cast("date").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey", datetimes.date_nanos(day).alias("a"), datetimes.date_nanos(F.replace(day, F.lit("-"), F.lit(""))).alias("b"), datetimes.date_nanos(F.concat(F.lit("2150"), F.substring(day, 5, 6))).alias("bad"))


@query("""
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT * 1000000000 + 123000000 AS a, epoch(ts::DATE)::BIGINT * 1000000000 AS date_only,
       epoch(date_trunc('second', ts))::BIGINT * 1000000000 AS p FROM events
""")
def parse_datetime(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id", datetimes.datetime_nanos(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit(".123"))).alias("a"),
        datetimes.datetime_nanos(F.concat(F.substring(text, 1, 10), F.lit(" bad"))).alias("date_only"), datetimes.datetime_nanos(text).alias("p"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT * 1000000000 + 500000000 AS p FROM events")
def parse_strptime(spark, sf):
    text = F.concat(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), F.lit(".5"))
    return table(spark, sf, "events").select("event_id", datetimes.strptime_nanos(text, "%d/%m/%Y %H:%M:%S").alias("p"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN NULL ELSE ((1 + event_id) * 1000000000 - 1000000000 * event_id - 1)::DOUBLE END AS d,
       coalesce(date_diff('day', DATE '2024-01-01', ts::DATE), 0)::INTEGER AS days FROM events
""")
def subtract_times(spark, sf):
    i = F.col("event_id")
    a = F.when(i % 5 == 0, 0).otherwise((i + 1) * 1_000_000_000)
    b = F.when(i % 3 == 0, 0).otherwise(i * 1_000_000_000 + 1)
    return table(spark, sf, "events").select(
        "event_id", scalar.subtract_times(a, b).alias("d"), scalar.subtract_dates(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("days"))


_EDGES = [920.0, 1000.0, 1200.0, 1500.0, 1700.0]
_COUNT = " + ".join("(CASE WHEN {e} {op} x THEN 1 ELSE 0 END)".replace("{e}", str(e)) for e in _EDGES)
_PRICE = "(SELECT p_partkey, p_retailprice AS x FROM part)"


def _bins(spark, sf, f):
    return table(spark, sf, "part").select("p_partkey", f(F.col("p_retailprice")).alias("bin"))


@query(f"SELECT p_partkey, CASE WHEN x < 920 OR x > 1700 THEN 0 ELSE greatest(1, {_COUNT.replace('{op}', '<')}) END::INTEGER AS bin FROM {_PRICE}")
def cut(spark, sf):
    return _bins(spark, sf, lambda x: binning.cut(x, _EDGES))


@query(f"SELECT p_partkey, ({_COUNT.replace('{op}', '<')})::INTEGER AS bin FROM {_PRICE}")
def searchsorted_left(spark, sf):
    return _bins(spark, sf, lambda x: binning.searchsorted(x, _EDGES))


@query(f"SELECT p_partkey, ({_COUNT.replace('{op}', '<=')})::INTEGER AS bin FROM {_PRICE}")
def searchsorted_right(spark, sf):
    return _bins(spark, sf, lambda x: binning.searchsorted(x, _EDGES, right=True))


@query(f"SELECT p_partkey, CASE WHEN x < 920 OR x > 1700 THEN 1 ELSE greatest(1, {_COUNT.replace('{op}', '<')}) + 1 END::INTEGER AS bin FROM {_PRICE}")
def qcut_labels(spark, sf):
    return _bins(spark, sf, lambda x: binning.qcut_labels(x, _EDGES))


@query("""
SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::DOUBLE AS v, 0 AS part FROM nation
UNION ALL SELECT r_regionkey, r_name, NULL, 1 FROM region UNION ALL SELECT s_suppkey, NULL, s_acctbal, 2 FROM supplier
""")
def stack_upcast(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("v"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return io.stack([n, r, s], "part")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def read_columns_filtered(spark, sf):
    return io.load(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_quantity") > 45)


@query("SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(name, type)")
def file_info(spark, sf):
    return io.info(spark, f"{sf}/region.parquet").select("name", "type")


@query("SELECT n_nationkey, n_name FROM nation")
def unpack_records(spark, sf):
    return io.unpack_records(table(spark, sf, "nation").select(F.struct("n_nationkey", "n_name").alias("rec")), "rec")


def _shared(spark, name: str) -> str:
    """A folder that all executors see: under the checkpoint or warehouse folder of the session."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None) or tempfile.gettempdir()
    return f"{root}/rowloom-{name}-{uuid.uuid4().hex}"


@query('SELECT n_nationkey AS "geo/key", n_regionkey AS "geo/region" FROM nation')
def read_folder(spark, sf):
    path = _shared(spark, "folders")
    n = table(spark, sf, "nation")
    io.save(n.select(F.col("n_nationkey").alias("geo/key"), F.col("n_regionkey").alias("geo/region"), F.col("n_name").alias("text/name")), path)
    return io.load(spark, path, folders=["geo"])


@query("SELECT 'a' AS section, n_nationkey, n_name FROM nation UNION ALL SELECT 'b', r_regionkey, r_name FROM region")
def sections_append(spark, sf):
    path = _shared(spark, "sections")
    io.save(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, section="a")
    io.save(table(spark, sf, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), path, section="b", append=True)
    return io.load(spark, path, ["section", "n_nationkey", "n_name"], sections=["a", "b"])


@query("SELECT event_type AS key, event_id AS row, count(*) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seen FROM events")
def stream_running_counts(spark, sf):
    """The stateful stream drained over the whole table."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*").select("event_type", "event_id")
    path = _shared(spark, "stream")
    running.drain(running.running_counts(events, "event_type", "event_id"), path, path + "-state")
    return spark.read.parquet(path)


@query("""
WITH e AS (SELECT *, (event_id - min(event_id) OVER (PARTITION BY event_type)) / 100.0 AS d FROM events)
SELECT event_type AS key, event_id AS row, round(exp(-0.2 * d) * sum(value * exp(0.2 * d)) OVER (PARTITION BY event_type ORDER BY event_id), 5) AS ema FROM e
""")
def stream_running_ema(spark, sf):
    """The decaying average with its state kept across micro-batches; the clock is the event id."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    events = events.select("event_type", "event_id", (F.col("event_id") / 100.0).alias("t"), "value")
    path = _shared(spark, "stream")
    running.drain(running.running_ema(events, "event_type", "t", "event_id", "value", 0.2), path, path + "-state")
    return spark.read.parquet(path).withColumn("ema", F.round("ema", 5))


@query("""
SELECT event_type AS key, event_id AS row, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW), 4) AS total FROM events
""")
def stream_time_window(spark, sf):
    """The window over the last 500 time units with its state kept across micro-batches; the clock is the event id."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    events = events.select("event_type", "event_id", F.col("event_id").alias("t"), "value")
    path = _shared(spark, "stream")
    running.drain(running.running_time_window(events, "event_type", "t", "event_id", "value", 500), path, path + "-state")
    return spark.read.parquet(path).withColumn("total", F.round("total", 4))


@query("""
SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def batch_windowed_sums(spark, sf):
    """The windows of the streaming form over a table, where a watermark does nothing."""
    e = table(spark, sf, "events")
    return running.windowed_sums(e, "ts", "value", ["event_type"], "6 hours", "1 hour").withColumn("total", F.round("total", 4))


_SPECIAL = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN -1e300 WHEN 3 THEN NULL ELSE value - 50.5 END AS x,
       CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN -2.5 ELSE 4.0 END AS y FROM events"""
_KIND = "CASE WHEN {0} IS NULL THEN 'null' WHEN isnan({0}) THEN 'nan' WHEN abs({0}) = 'Infinity'::DOUBLE THEN 'inf' WHEN abs({0}) > 1e15 THEN 'large' ELSE 'plain' END AS {0}_kind"


@query(f"""
WITH s AS ({_SPECIAL}), d AS (SELECT event_id, floor(x) AS fl, ceil(x) AS ce, trunc(x) AS tr,
  CASE WHEN x IS NULL THEN NULL WHEN y <> 0 THEN floor(x / y) WHEN isnan(x) OR x = 0 THEN 'NaN'::DOUBLE WHEN x > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS fd FROM s)
SELECT event_id, {_KIND.format("fl")}, {_KIND.format("ce")}, {_KIND.format("tr")}, {_KIND.format("fd")},
  CASE WHEN abs(fl) < 1e15 THEN fl END AS fl, CASE WHEN abs(ce) < 1e15 THEN ce + 0.0 END AS ce, CASE WHEN abs(tr) < 1e15 THEN tr + 0.0 END AS tr, CASE WHEN abs(fd) < 1e15 THEN fd END AS fd FROM d
""")
def rounding_of_special_values(spark, sf):
    e = table(spark, sf, "events")
    x = F.expr("CASE event_id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN -1e300 WHEN 3 THEN NULL ELSE value - 50.5 END")
    y = F.expr("CASE event_id % 5 WHEN 0 THEN double(0) WHEN 1 THEN double(-2.5) ELSE double(4) END")
    d = e.select("event_id", x.alias("x"), y.alias("y"))
    d = d.select("event_id", scalar.floor(F.col("x")).alias("fl"), scalar.ceil(F.col("x")).alias("ce"), scalar.truncate(F.col("x")).alias("tr"),
                 scalar.floor_divide(F.col("x"), F.col("y"), floating=True).alias("fd"))

    def kind(c):
        v = F.col(c)
        return F.when(v.isNull(), "null").when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), "inf").when(F.abs(v) > 1e15, "large").otherwise("plain").alias(f"{c}_kind")

    plain = [F.when(F.abs(c) < 1e15, F.col(c) + 0.0).alias(c) for c in ("fl", "ce", "tr", "fd")]
    return d.select("event_id", *[kind(c) for c in ("fl", "ce", "tr", "fd")], *plain)


@query("""
WITH l AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events WHERE event_type <> 'click'),
r AS (SELECT user_id, value AS v, max(event_id) AS rid FROM events WHERE event_type = 'click' AND event_id % 4 <> 0 GROUP BY 1, 2)
SELECT event_id, rid AS match FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.v >= r.v
""")
def asof_invalid_values(spark, sf):
    """NaN on the left matches nothing, NaN on the right is left out."""
    e = table(spark, sf, "events")
    nan = F.lit(float("nan"))
    left = e.filter("event_type <> 'click'").withColumn("v", F.when(F.col("event_id") % 5 == 0, nan).otherwise(F.col("value")))
    right = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("rid"), F.when(F.col("event_id") % 4 == 0, nan).otherwise(F.col("value")).alias("v"))
    return joins.asof(left, right, ["user_id"], "v", "v", "event_id", "rid").select("event_id", "match")
