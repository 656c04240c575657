"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters, each pair verified once.

A document is its set of word shingles. Shingles are ordered by how many sets hold them, rarest first. Two sets of a high
Jaccard similarity share a shingle among the first few of both, so only these prefixes are joined; a set whose prefix is
all its own has no partner and is dismissed before any join.

Frequencies of all shingles are counted on packed blocks (``screens``). Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.components import components
from barflow.llm.groups import keep_one
from barflow.llm.hot_keys import hot_parts, join_parts
from barflow.llm.screens import shared_tokens
from barflow.llm.words import LOWER, NOT_SPACE, inner, mix, runs, signed, slices, spread, split_words, utf8
from barflow.session import cut_lineage

U64 = np.uint64


@dataclass(frozen=True)
class Likeness:
    """Link when 100 * intersection >= percent * union over sets of ``k``-word shingles."""

    k: int = 4
    percent: int = 85

    def prefix(self, n):
        """Entries that have to be looked at: n - ceil(percent / 100 * n) + 1 (numbers or arrays)."""
        return n - (self.percent * n + 99) // 100 + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, by text and hash; a text of fewer words is one shingle."""
    words = split_words(data, offsets, NOT_SPACE, LOWER)
    h, counts = words.hashes(), words.counts
    at = inner(words.first, k)
    grams, doc = runs(h, k)[at], np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    for short in range(1, k):
        some = np.flatnonzero(counts == short)
        grams = np.concatenate((grams, runs(h, short)[words.first[:-1][some]]))
        doc = np.concatenate((doc, some))
    order = np.argsort(grams)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(counts) < 65536 else doc[order], kind="stable")]
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], grams[new]


def _digests(doc: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit fingerprint) of each text's set."""
    bounds = np.searchsorted(doc, np.arange(n + 1))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(grams ^ U64(0xA5A5F00D12345678)), dtype=U64)))
    size = np.diff(bounds)
    return size, mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def _printed(rows: DataFrame, k: int, keep: list[str], schema: str) -> DataFrame:
    """Columns ``keep`` of ``rows``, n_shingles and ``set`` (fingerprint of the shingle set of ``_text``) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            doc, grams = shingle_sets(*utf8(part.column("_text")), k)
            size, digest = _digests(doc, grams, len(part))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(size.astype(np.int64)), signed(digest)], [*keep, "n_shingles", "set"])

    return rows.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and ``set`` (fingerprint of the shingle set) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    return _printed(rows, k, ["doc_id"], "doc_id long, n_shingles long, set long")


def _set_tokens(k: int):
    def run(part: pa.RecordBatch):
        doc, grams = shingle_sets(*utf8(part.column("text")), k)
        size, digest = _digests(doc, grams, len(part))
        return digest.view(np.int64), size, doc, grams

    return run


def shared_shingles(docs: DataFrame, like: Likeness) -> DataFrame:
    """set, n, tokens, own: of the sets that may have a partner, the shingles that other sets hold too, rarest first.

    ``own``: how many shingles no other set holds. Equal sets count once.
    """
    told = shared_tokens(docs.select(F.col("text").cast("string").alias("text")), _set_tokens(like.k), once=True)
    # a set with enough shingles of its own has a prefix that nobody shares
    own = F.col("n") - F.size("tokens")
    p = F.col("n") - F.floor((F.lit(like.percent) * F.col("n") + 99) / 100) + 1
    return told.filter(own < p).select(F.col("owner").alias("set"), "n", "tokens", own.alias("own"))


def _prefixes(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("tokens")
            bounds, tokens = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            n, own, ids = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "own", "set"))
            row = np.repeat(np.arange(len(batch)), np.diff(bounds))
            parts = np.zeros((len(batch), 8), np.int64)
            np.add.at(parts, (row, tokens[bounds[0] : bounds[-1]] & 7), 1)
            sketch = np.minimum(parts, 255).astype(np.uint8).view(np.int64).ravel()
            counts = np.minimum(like.prefix(n) - own, np.diff(bounds))
            at = spread(bounds[:-1], counts)
            row = np.repeat(np.arange(len(batch)), counts)
            pos = at - bounds[:-1][row] + own[row] + 1
            rank = pos - own[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[at]), pa.array(ids[row]), *(pa.array(x.astype(np.int32)) for x in (n[row], pos, rank)), pa.array(sketch[row])], ["token", "set", "n", "pos", "rank", "sketch"]
            )

    return run


def _filters(like: Likeness) -> str:
    """Length, positional and suffix filter for a pair that shares a prefix token.

    Up to the token, only the shingles that other sets hold too can be common: their number is the token's ``rank``. Behind
    it, the shorter rest bounds the overlap. The suffix filter parts both sets by the same eight classes of tokens; the smaller counts bound the overlap. A class
    that holds 255 or more is unbounded here.
    """
    need = f"{like.percent} * (a_n + b_n)"  # overlap >= need / (100 + percent)
    parts = " + ".join(
        f"least(if(((a_sketch >> {8 * i}) & 255) = 255, 1000000000, (a_sketch >> {8 * i}) & 255), if(((b_sketch >> {8 * i}) & 255) = 255, 1000000000, (b_sketch >> {8 * i}) & 255))" for i in range(8)
    )
    full = 100 + like.percent
    return (
        f"100 * least(a_n, b_n) >= {like.percent} * greatest(a_n, b_n)"
        f" AND {full} * (least(a_rank, b_rank) + least(a_n - a_pos, b_n - b_pos)) >= {need}"
        f" AND {full} * ({parts}) >= {need}"
    )


_POSTING = ("set", "n", "pos", "rank", "sketch", "comp")


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(f"{name}_{c}") for c in _POSTING))


def verify(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Of pairs (a, b) of sets those that link. Shingles of one set only cannot be common, so shared ones suffice."""
    a = sets.select(F.col("set").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    b = sets.select(F.col("set").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return pairs.join(a, "a").join(b, "b").filter(common * (100 + like.percent) >= like.percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def link_sets(sets: DataFrame, like: Likeness, stars: int = 3, tries: int = 3) -> DataFrame:
    """(node, component) over the sets that link; sets without a link are left out.

    In a star round every posting list has a lead, and each set is compared with the few leads it meets most often; this
    ties most groups of near copies together at a fixed number of comparisons per set. In the end all pairs of a list that
    are not tied yet and pass the filters are compared. Pairs inside a component cannot change it, so no link between
    components is lost.
    """
    postings = cut_lineage(sets.mapInArrow(_prefixes(like), "token long, set long, n int, pos int, rank int, sketch long"))
    links, comps = None, None
    for turn in range(stars + 1):
        rows = postings.withColumn("comp", F.col("set")) if comps is None else (
            postings.join(comps.withColumnRenamed("node", "set"), "set", "left").withColumn("comp", F.coalesce("component", "set")).drop("component")
        )
        # leads are central: most of their shingles are shared; later rounds ask other components first
        central = F.struct(F.xxhash64("comp", F.lit(turn)) if turn else F.lit(0), (F.col("pos") - F.col("rank")) / F.col("n"), F.xxhash64("set"))
        lists = rows.groupBy("token").agg(F.min_by(F.struct(*_POSTING), central).alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        if turn < stars:
            lead = lists.select("token", *(F.col(f"lead.{c}").alias(f"a_{c}") for c in _POSTING))
            met = _side(rows, "b").join(lead, "token").filter("a_comp <> b_comp").filter(_filters(like)).groupBy("a_set", "b_set").agg(F.count("*").alias("times"))
            best = F.row_number().over(Window.partitionBy("b_set").orderBy(F.desc("times"), "a_set"))
            met = met.withColumn("best", best).filter(F.col("best") <= tries)
        else:
            rows = cut_lineage(rows.join(lists.select("token"), "token", "left_semi"))
            met = _side(rows, "b").join(_side(rows, "a"), "token").filter("a_comp < b_comp").filter(_filters(like))
        pairs = met.select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b")).distinct()
        found = cut_lineage(verify(pairs, sets, like))
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        links = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
    return comps if comps is not None else postings.sparkSession.createDataFrame([], "node long, component long")


def ngram_join(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A text with fewer than k words is one shingle;
    null or empty texts have no shingle and link with nothing. Equal sets link. Rows are judged one by one, also where
    doc_ids repeat; a null doc_id stays null. Sets are told apart by 64-bit fingerprints, shingles by at least 48 bits.
    Other columns are not looked at.
    """
    named = _classes(docs, like)
    # classes of one row name themselves
    least = named.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).filter("m > 1")
    out = join_parts(named, least.select("class", "first"), ["class"], hot_parts(least, ["class"], "m"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))


def _classes(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n_shingles, set and class of each row; a set without shingles has no class."""
    rows = cut_lineage(fingerprints(docs, like.k))
    sets = cut_lineage(shared_shingles(docs, like))
    tied = link_sets(sets, like).withColumnRenamed("node", "set")
    counts = rows.groupBy("set").agg(F.count("*").alias("m"))
    named = join_parts(rows, tied, ["set"], hot_parts(counts, ["set"], "m"), "left")
    return cut_lineage(named.select("doc_id", "n_shingles", "set", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set")).alias("class")))


def drop_near_copies(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that with the smallest doc_id.

    A row without doc_id only stays where no row of its group has one; of rows with the same doc_id in a group one stays.
    Texts without words are linked with nothing and stay, null texts too.
    """
    named = _classes(docs, like).filter("class IS NOT NULL")
    several = named.groupBy("class").agg(F.min("doc_id").alias("_best"), F.count("*").alias("n")).filter("n > 1")
    sets = named.groupBy("set", "class").agg(F.count("*").alias("m"))
    groups = sets.join(several, "class").select(F.col("set").alias("_key"), F.col("class").alias("_group"), "_best", "m")
    plain = docs.withColumn("_text", F.col("text").cast("string"))
    printed = _printed(plain, like.k, docs.columns, plain.drop("_text").withColumns({"n_shingles": F.lit(0).cast("long"), "set": F.lit(0).cast("long")}).schema)
    return keep_one(printed.withColumnRenamed("set", "_key").drop("n_shingles"), None, cut_lineage(groups))
