"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

1. The terms of all benchmark items are counted over the training documents.
2. Every window (``n`` consecutive item words) names its rarest distinct terms as anchors.
3. The index stores the postings of the anchor terms: term, document, position, and for the rarest
   term of a window the words around it, at most ``2 n - 1`` of them.
4. The posting lists of a window's anchors are offset-adjusted, so each posting names the document
   position at which the window would start, and are intersected from the rarest term on.
5. What survives is compared word by word with the words around the posting: equal words are a phrase
   match; all words of the window within the stored span, in another order or spread, are a proximity
   match.

Documents never shuffle; what moves are term counts (combined on the map side), postings of rare terms
and matches.  Benchmark-sized tables are broadcast only below ``BROADCAST_ROWS`` rows, counted first;
larger ones are joined by the plan's own choice.

Defined cases: a null or wordless text has no words and no match; an item of fewer than ``n`` words is
one window; duplicate items and repeated document rows each get their own result; rows that share an id
but not the text are told apart; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.bloom import without_rows
from rowloom.llm.common import cut_lineage, lower_ascii, table

#: ASCII characters that are no letters or digits; all other characters make up words.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a benchmark-sized table is broadcast (a window row has under 1 KB).
BROADCAST_ROWS = 20_000


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), _GAPS), lambda w: w != "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """item, wid, offset of the window, its words; equal windows of several items share ``wid``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    split = items.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = split.select("item", F.explode(starts).alias("at"), "w")
    return cut.select("item", F.slice("w", F.col("at") + 1, n).alias("win"))


def find_matches(docs: DataFrame, items: DataFrame, n: int = 10, anchors: int = 2, keep_proximity: bool = True) -> DataFrame:
    """Matches of item windows in documents: doc, key, item, start, length, kind.

    ``key`` is a hash of the document's text; ``kind`` is ``phrase`` or ``proximity``.  ``start`` is where the window would
    begin if its rarest term kept its place, so it may lie before the text for a proximity match.
    """
    windows = cut_lineage(item_windows(items, n).distinct().withColumn("wid", F.xxhash64("win")))
    n_windows = windows.count()
    vocabulary = windows.select(F.explode("win").alias("term")).distinct()
    docs_w = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), words(F.col("text")).alias("dw")
    )
    tokens = docs_w.select(F.explode("dw").alias("term"))
    found = tokens.join(_small(vocabulary, n_windows), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # A window that holds a term of no document can't occur anywhere.
    spread = windows.select("wid", "win").distinct().select("wid", "win", F.posexplode("win").alias("off", "term"))
    known = spread.join(_small(found, n_windows), "term", "left")
    complete = Window.partitionBy("wid")
    ranked = (
        known.withColumn("__missing", F.sum(F.col("df").isNull().cast("int")).over(complete))
        .filter("__missing = 0")
        .withColumn("rank", F.dense_rank().over(Window.partitionBy("wid").orderBy("df", "term")))
        .withColumn("__nth", F.row_number().over(Window.partitionBy("wid", "term").orderBy("off")))
        .filter((F.col("rank") <= anchors) & (F.col("__nth") == 1))
        .withColumn("need", F.max("rank").over(complete))
    )
    anchor = cut_lineage(ranked.select("term", "wid", "off", "rank", "need", "win"))
    terms = anchor.groupBy("term").agg((F.min("rank") == 1).alias("lead"))
    around = F.when(F.col("lead"), F.slice("dw", F.greatest(F.col("pos") - (n - 2), F.lit(1)), F.least(F.col("pos"), F.lit(n - 1)) + n))
    postings = cut_lineage(
        docs_w.select("doc", "key", "dw", F.posexplode("dw").alias("pos", "term"))
        .join(_small(terms, n_windows), "term")
        .select("term", "doc", "key", "pos", around.alias("near"))
    )
    adjusted = (
        postings.join(_small(anchor, n_windows), "term")
        .withColumn("start", F.col("pos") - F.col("off"))
        .filter(F.lit(True) if keep_proximity else F.col("start") >= 0)
        .withColumn("list", F.expr("shiftleft(1, rank - 1)"))
    )
    # The word at ``start`` within ``near``, which begins n - 1 words before the posting or at word 0.
    first = F.col("start") - F.greatest(F.col("pos") - (n - 1), F.lit(0))
    phrase = (F.col("start") >= 0) & (F.slice("near", F.greatest(first, F.lit(0)) + 1, F.size("win")) == F.col("win"))
    together = F.size(F.array_except("win", "near")) == 0
    lead = adjusted.filter("rank = 1").withColumn(
        "kind", F.when(phrase, "phrase").when(together, "proximity") if keep_proximity else F.when(phrase, "phrase")
    )
    rest = adjusted.filter("rank > 1")
    # Intersection: a phrase needs every list to name the same start.
    hits = lead.filter("kind IS NOT NULL").select("doc", "key", "wid", "start", "need", "kind", F.size("win").alias("length"), "list")
    other = rest.select("doc", "key", "wid", "start", "need", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("length"), "list")
    met = hits.unionByName(other).groupBy("doc", "key", "wid", "start").agg(
        F.bit_or("list").alias("lists"), F.max("need").alias("need"), F.max("kind").alias("kind"), F.max("length").alias("length"))
    kept = met.filter("kind = 'proximity' OR (kind = 'phrase' AND lists = shiftleft(1, need) - 1)")
    return kept.join(_small(windows.select("wid", "item"), n_windows), "wid").select("doc", "key", "item", "start", "length", "kind")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted) and contaminated for every row of ``docs``."""
    matches = find_matches(docs, items, n, keep_proximity=False)
    covered = F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    per_doc = matches.groupBy("doc", "key").agg(
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
        F.count_distinct("item").alias("n_items"),
    )
    every = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = every.join(per_doc, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("__key") == F.col("key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs."""
    matches = find_matches(docs, items, n, keep_proximity=False)
    gone = cut_lineage(matches.select(F.col("doc").alias("__id"), F.col("key").alias("__hash")).distinct())
    return without_rows(docs, gone, "doc_id", "text")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    told = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return told.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), it AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS ws
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM it WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM low),
hit AS (
  SELECT doc_id, s, win.n, item_id
  FROM (SELECT doc_id, s, lens.n, array_to_string(w[s:s + lens.n - 1], ' ') AS ws FROM pos, lens WHERE s + lens.n - 1 <= len(w)) g
  JOIN win ON win.n = g.n AND win.ws = g.ws
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1
)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
