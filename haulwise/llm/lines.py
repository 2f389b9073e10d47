"""Line dedup: repeated windows of three consecutive lines lose their later occurrences.

Lines that hold a word are hashed; every three in a row make a window. A window that
stands anywhere else earlier (smaller doc_id, then smaller place) is a repetition, and
the lines it covers go; overlapping windows merge into one removed range. Only
DataFrame functions are used.

Defined results: null text stays null; texts of fewer than three such lines, and blank
lines, stay as they are; rows with the same doc_id and text count once and get the same
result; a null doc_id comes first. A run of one repeated line keeps its first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WINDOW = 3
SOLID = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(keyed: DataFrame, size: int) -> DataFrame:
    """A row per window: its document, first and last line, and two hashes of its lines."""
    solid = F.filter(
        F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), x.rlike(SOLID).alias("ok"))),
        lambda s: s["ok"])
    rows = keyed.select("doc_id", "th", solid.alias("s")).filter(F.size("s") >= size)
    window = F.transform(F.sequence(F.lit(0), F.size("s") - size), lambda i: F.struct(
        F.get(F.col("s"), i)["at"].alias("a"), F.get(F.col("s"), i + (size - 1))["at"].alias("b"),
        F.xxhash64(*[F.get(F.col("s"), i + k)["h"] for k in range(size)]).alias("h"),
        F.hash(*[F.get(F.col("s"), i + k)["g"] for k in range(size)]).alias("g")))
    return rows.select("doc_id", "th", F.explode(window).alias("w")).select("doc_id", "th", "w.a", "w.b", "w.h", "w.g")


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document (doc_id, hash of its text) the merged ranges of lines to remove, as ``gone``."""
    windows = _windows(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), size)
    place = F.struct("doc_id", "th", "a")
    repeated = (windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .filter("first < last").select("h", "g", "first"))
    later = windows.join(repeated, ["h", "g"]).filter(place > F.col("first")).select("doc_id", "th", "a", "b").distinct()
    order = W.partitionBy("doc_id", "th").orderBy("a")
    apart = F.col("a") > F.coalesce(F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(-1))
    runs = later.withColumn("run", F.sum(apart.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "th", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``row`` (the input row), ``text`` without repetitions, ``n_lines`` with a word, ``n_removed`` of them."""
    gone = covered(docs, size).select(F.col("doc_id").alias("_id"), "th", "gone")
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("th"))
    joined = left.join(gone, left["_id"].eqNullSafe(gone["_id"]) & (left["th"] == gone["th"]), "left").select("row", "gone")
    text = F.col("row.text")
    marked = F.transform(_lines(text), lambda x, i: F.struct(
        x.alias("x"), x.rlike(SOLID).alias("ok"),
        F.exists(F.col("gone"), lambda r: (i >= r["a"]) & (i <= r["b"])).alias("out")))
    stays = F.filter("m", lambda s: ~(s["ok"] & s["out"]))
    return (joined.withColumn("m", F.when(F.col("gone").isNotNull(), marked))
            .select("row",
                    F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stays, lambda s: s["x"]), "\n")).alias("text"),
                    F.coalesce(F.size(F.filter(_lines(text), lambda x: x.rlike(SOLID))), F.lit(0)).cast("long").alias("n_lines"),
                    F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("m") - F.size(stays)).cast("long").alias("n_removed")))


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, i, string_split(text, chr(10))[i] AS x
      FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.text, a.k, a.x || chr(10) || b.x || chr(10) || c.x AS h
      FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.text = a.text AND b.k = a.k + 1
               JOIN s c ON c.doc_id = a.doc_id AND c.text = a.text AND c.k = a.k + 2),
o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS nth FROM w),
gone AS (SELECT DISTINCT s.doc_id, s.text, s.i FROM o JOIN s ON s.doc_id = o.doc_id AND s.text = o.text AND s.k BETWEEN o.k AND o.k + 2
         WHERE o.nth > 1),
kept AS (SELECT l.doc_id, l.text, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS new_text,
                count(*) FILTER (regexp_matches(l.x, '[^\x20\x09-\x0D]')) AS n_lines, count(g.i) AS n_removed
         FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.text = l.text AND g.i = l.i GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.new_text, '') END AS text,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id AND k.text = d.text
"""
