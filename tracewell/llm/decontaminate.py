"""Benchmark decontamination: documents against the word windows of test items.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. Every ten consecutive words of an item
are a window; an item of fewer words is one window. All windows form a broadcast hash set, reached by the
hash of their longest word: each word of a document is hashed once and probed inside the scan, and only
where a window's longest word occurs is the document's window around it compared, hash first, then word
for word. Longest words are rare, so few words of a document go further than one probe.

The set is broadcast only while it has at most ``BROADCAST_WINDOWS`` windows, counted first; beyond that
the same join is left to Spark. Nothing else depends on that size. Only hits leave a task: texts are
neither shuffled nor sorted. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import UPPER, documents, query, table, whole, written

WINDOW = 10
BROADCAST_WINDOWS = 2_000_000
#: What lies between words, before and after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The lower-cased words; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAP), "")


def word_count(text: Column) -> Column:
    # Only the first and last part can be empty; lower-casing does not move a gap.
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def windows(items: DataFrame) -> DataFrame:
    """The distinct windows of each item: item_id, window (its words), size, hash, and at which offset its longest word is.

    Items without words have none.
    """
    listed = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    listed = listed.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    begins = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))
    cut = listed.withColumn("at", begins).select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("window"))
    longest = F.array_max(F.transform("window", lambda w, i: F.struct(F.length(w).alias("n"), F.xxhash64(w).alias("word"), (-i).alias("i"))))
    cut = cut.distinct().withColumn("longest", longest)
    return cut.select(
        "item_id", "window", "size", F.xxhash64("window").alias("hash"), F.col("longest.word").alias("word"), (-F.col("longest.i")).alias("offset")
    )


def hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, at, size, item_id): every place (from 0) where a window of ``found`` begins among the words of a (key, text)."""
    place = F.posexplode("w").alias("pos", "word_text")
    probed = docs.select("key", words(F.col("text")).alias("w")).select("key", "w", place)
    probed = probed.select("key", "w", "pos", F.xxhash64("word_text").alias("word"))
    few = found.count() <= BROADCAST_WINDOWS
    met = probed.join(F.broadcast(found) if few else found, "word")
    at = F.col("pos") - F.col("offset")
    own = F.slice("w", at + 1, F.col("size"))
    met = met.filter((at >= 0) & (at + F.col("size") <= F.size("w")))
    met = met.filter(F.when(at >= 0, F.xxhash64(own) == F.col("hash")) & F.when(at >= 0, own == F.col("window")))
    return met.select("key", at.alias("at"), "size", "item_id")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with key: doc_id and what tells texts apart. Rows alike in both share their hits."""
    key = F.struct(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.xxhash64(whole()).alias("hash"),
        F.length(whole()).alias("length"),
    )
    return docs.withColumn("key", key)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings) and spans (first hit word from 0, number of words).

    A word inside any occurrence of any window is hit. Null, empty and wordless texts have no words and no
    hits; items without words match nothing; items that share an item_id count once and those without one
    hit words but are not listed. Repeated rows and null doc_ids get a row each. No documents give no rows,
    no items no hits. Columns other than doc_id, item_id and text are not read.
    """
    found = written(windows(items.select("item_id", "text")), "windows")
    docs = keyed(docs.select("doc_id", "text"))
    met = written(hits(docs, found), "hits")

    places = met.groupBy("key", "at").agg(F.max("size").alias("size"))
    order = W.partitionBy("key").orderBy("at")
    reach = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1))
    places = places.withColumn("reach", F.coalesce(reach, F.lit(-1)))
    places = places.withColumn("span", F.sum((F.col("at") > F.col("reach")).cast("int")).over(order))
    spans = places.groupBy("key", "span").agg(
        F.min("at").alias("first"), (F.max(F.col("at") + F.col("size")) - F.min("at")).alias("count")
    )
    spans = spans.groupBy("key").agg(
        F.sum("count").alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "count"))).alias("spans")
    )
    named = met.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = docs.select("key", "doc_id", word_count(F.col("text")).alias("n_words"))
    rows = rows.join(spans.join(named, "key"), "key", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,count:int>>")).alias("spans"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    own = "decontaminate_key"
    while own in docs.columns:
        own += "_"
    found = written(windows(items.select("item_id", "text")), "windows")
    plain = keyed(docs.select("doc_id", "text"))
    leaks = written(hits(plain, found).select(F.col("key").alias(own)).distinct(), "leaks")
    key = keyed(docs.select(F.struct("*").alias("doc"), "doc_id", "text"))
    kept = key.withColumnRenamed("key", own).join(leaks, own, "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


_WORDS_SQL = f"""list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), {WINDOW})::BIGINT AS size FROM b WHERE len(w) > 0),
i AS (
  SELECT DISTINCT item_id, size, list_slice(w, pos, pos + size - 1) AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM n)
),
s AS (
  SELECT doc_id, size, pos, list_slice(w, pos, pos + size - 1) AS win FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
    FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)
),
m AS (SELECT doc_id, pos, s.size, item_id FROM s JOIN i ON s.win = i.win AND s.size = i.size),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op3_decontaminate(spark, sf_dir):
    found = report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
