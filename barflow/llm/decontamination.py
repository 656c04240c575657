"""Benchmark decontamination: which documents contain item-sized windows of benchmark items.

A prefix-filtered set join: the shingles of a window are ordered by how often the documents hold them. A document that
contains the window contains all its shingles, so looking for the rarest one is enough; a window with a shingle that no
document holds is dropped. Where the rarest shingle occurs, positional and length bounds place the window, and its words
are compared one by one. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.session import cut_lineage

#: Up to so many benchmark shingles travel inside the expression; beyond, they are joined.
INLINE = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Windows:
    """``size`` item words are one window; a shorter item is one window. ``k``: words of a shingle (fewer in a shorter window)."""

    size: int = 10
    k: int = 3


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null has none."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shingle(of: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(of, at + j) for j in range(k)))


def _shingles(of: str, k: int) -> Column:
    """Hashes of all runs of k entries of an array with at least k."""
    return F.transform(F.sequence(F.lit(0), F.size(of) - k), lambda i: _shingle(F.col(of), i, k))


def item_windows(benchmark: DataFrame, p: Windows) -> DataFrame:
    """item_id, w (words), k (shingle length), shingles (hash, offset); items without words or id have none."""
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    last = F.greatest(F.size("all") - p.size, F.lit(0))
    cut = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("all", i + 1, F.lit(p.size)))).alias("w")).distinct()
    k = F.least(F.size("w"), F.lit(p.k))
    out = None
    for n in range(1, p.k + 1):
        own = cut.filter(k == n).withColumn("k", F.lit(n)).withColumn(
            "shingles", F.transform(_shingles("w", n), lambda h, i: F.struct(h.alias("h"), i.alias("off")))
        )
        out = own if out is None else out.unionByName(own)
    return out


def row_key() -> Column:
    """A hash of doc_id and text: equal rows are judged once."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), row_key().alias("key"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))


def _context(at: Column, p: Windows) -> Column:
    """The words around position ``at`` that a window over it can hold, and where they begin."""
    low = F.greatest(at - (p.size - 1), F.lit(0))
    return F.struct(at.alias("pos"), low.alias("low"), F.slice("w", low + 1, at + p.size - low).alias("near"))


def _found_inline(docs: DataFrame, lengths: list[int], hashes: list[int], p: Windows) -> DataFrame:
    hits = []
    for k in lengths:
        at = F.filter(F.transform(_shingles("w", k), lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isin(hashes))
        some = F.transform(at, lambda x: F.struct(x["h"].alias("h"), _context(x["i"], p).alias("c")))
        hits.append(F.when(F.col("n") >= k, some).otherwise(F.array().cast("array<struct<h:bigint,c:struct<pos:int,low:int,near:array<string>>>>")))
    return _base(docs).select("doc_id", "key", "n", F.concat(*hits).alias("hits"))


def _found_joined(docs: DataFrame, lengths: list[int], shingles: DataFrame, p: Windows) -> DataFrame:
    base = _base(docs)
    rows = None
    for k in lengths:
        own = base.filter(F.col("n") >= k).select("doc_id", "key", F.posexplode(_shingles("w", k)).alias("pos", "h"))
        rows = own if rows is None else rows.unionByName(own)
    kept = rows.join(shingles.select("h").distinct(), "h", "left_semi").distinct()
    lists = kept.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "pos")).alias("at"))
    both = base.alias("b").join(lists.alias("l"), F.expr("b.doc_id <=> l.doc_id AND b.key = l.key"), "left").select("b.*", "l.at")
    hits = F.transform("at", lambda x: F.struct(x["h"].alias("h"), _context(x["pos"], p).alias("c")))
    return both.select("doc_id", "key", "n", F.coalesce(hits, F.array().cast("array<struct<h:bigint,c:struct<pos:int,low:int,near:array<string>>>>")).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Windows = Windows(), inline: int = INLINE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside a window's occurrence), n_items, item_ids, contaminated.

    ``item_ids`` are the ids of items with occurring windows as sorted strings. Null or empty texts have no words and are
    clean, as is everything where the benchmark is empty. Equal windows of several items count for each of them. Rows that
    repeat a doc_id are judged by their own texts. Other columns are not looked at.
    """
    return _judged(docs, benchmark, p, inline).drop("key")


def _judged(docs: DataFrame, benchmark: DataFrame, p: Windows, inline: int) -> DataFrame:
    """What ``decontaminate`` returns, and key (see ``row_key``)."""
    windows = cut_lineage(item_windows(benchmark, p))
    shingles = windows.select("k", F.explode("shingles").alias("s")).select("k", "s.h").distinct()
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most p.k
    few = shingles.select("h").distinct().limit(inline + 1).collect()
    if len(few) <= inline:
        found = _found_inline(docs, lengths, [r.h for r in few], p) if few else _base(docs).select("doc_id", "key", "n", F.expr("CAST(array() AS array<struct<h:bigint,c:struct<pos:int,low:int,near:array<string>>>>)").alias("hits"))
    else:
        found = _found_joined(docs, lengths, shingles, p)
    found = cut_lineage(found)
    hits = found.filter(F.size("hits") > 0).select("doc_id", "key", "n", F.explode("hits").alias("hit")).select("doc_id", "key", "n", "hit.h", "hit.c.*")
    rarity = hits.groupBy("h").agg(F.count("*").alias("df"))
    parts = windows.select("item_id", "w", F.size("shingles").alias("m"), F.explode("shingles").alias("s")).select("item_id", "w", "m", "s.h", "s.off").join(rarity, "h")
    # the prefix of a window is its rarest shingle; windows that miss a shingle are nowhere
    prefix = parts.groupBy("item_id", "w", "m").agg(F.count("*").alias("have"), F.min(F.struct("df", "h", "off")).alias("rare")).filter("have = m")
    prefix = prefix.groupBy("w", F.col("rare.h").alias("h"), F.col("rare.off").alias("off")).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    start = F.col("pos") - F.col("off")
    met = hits.join(prefix, "h").filter((start >= 0) & (start + F.size("w") <= F.col("n")))
    same = met.filter(F.slice("near", start - F.col("low") + 1, F.size("w")) == F.col("w"))
    spans = same.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct(start.alias("a"), (start + F.size("w")).alias("b")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["reach"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], x["b"]).alias("reach")),
        lambda acc: acc["n"],
    )
    told = spans.select("doc_id", "key", covered.alias("n_hit"), "item_ids")
    out = found.select("doc_id", "key", "n").alias("d").join(told.alias("t"), F.expr("d.doc_id <=> t.doc_id AND d.key = t.key"), "left")
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(F.col("d.doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"), F.col("d.key").alias("key"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Windows = Windows()) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item. Each row is judged by its own text, with or without doc_id."""
    bad = _judged(docs, benchmark, p, INLINE).filter("contaminated").select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", row_key()).join(bad, "_key", "left_anti").select(docs.columns)
