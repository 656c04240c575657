"""Substring duplicates: passages of at least ``window`` words that occur more than once, by prefix-partitioned suffix trees.

Only suffixes that begin at anchors are planted: the anchor of a window is its smallest ``gram``-word run, so equal windows
have their anchors at the same place. A suffix is dealt by a prefix: the anchor's words, and for frequent anchors a longer
one: the whole window, at which only identical windows meet. Those are counted by hash in the tasks that read them, so a
window crosses at most once per task. Other suffixes take along the words on either side that windows over the anchor can
hold. Prefixes that occur once have no repeat and are dropped before any words are shuffled. The suffixes of a group are sorted by their first ``window`` words by
doubling ranks; internal nodes at that depth with several leaves are the repeats, and runs of them the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.screens import buckets_of, shared_tokens, token_ids
from barflow.llm.words import Words, inner, mix, runs, slices, split_words, spread, utf8

U64 = np.uint64


@dataclass(frozen=True)
class Repeats:
    """``window``: words of the shortest repeat. ``gram``: words of the shortest prefix. ``group``: occurrences of a prefix
    above which whole windows deal its suffixes. ``batch``: words of which one tree is built at a time, whole groups.
    ``held``: anchors or windows that a task counts at a time."""

    window: int = 35
    gram: int = 8
    group: int = 20_000
    batch: int = 1_000_000
    held: int = 1_000_000


@dataclass
class Segments:
    """Runs of windows with the same anchor: text, first word (in the slice), windows, anchor (word), hash of the anchor's words."""

    doc: np.ndarray
    first: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray


def segments(words: Words, hashes: np.ndarray, p: Repeats) -> Segments:
    grams = runs(hashes, p.gram)
    at = inner(words.first, p.window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, np.zeros(0, U64))
    width = p.window - p.gram + 1
    place = U64(len(grams).bit_length())
    least = grams >> place << place | np.arange(len(grams), dtype=U64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least[at] & ((U64(1) << place) - U64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    first = at[starts]
    n = np.diff(np.append(starts, len(at)))
    return Segments(np.searchsorted(words.first, first, "right") - 1, first, n, anchor[starts], grams[anchor[starts]])


def _within(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which are among the sorted ``hot`` ones."""
    if not len(hot):
        return np.zeros(len(grams), bool)
    return hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams


def _cold(s: Segments, hot: np.ndarray) -> Segments:
    kept = ~_within(s.gram, hot)
    return Segments(s.doc[kept], s.first[kept], s.n[kept], s.anchor[kept], s.gram[kept])


def _counted(p: Repeats):
    """How often anchors occur, by task, as far as more than once."""

    def settle(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in slices(batches):
            words = split_words(*utf8(part.column("text")))
            held.append(segments(words, words.hashes(), p).gram)
            if sum(map(len, held)) >= p.held:
                yield settle(held)
                held = []
        if held:
            yield settle(held)

    return run


def hot_anchors(rows: DataFrame, p: Repeats) -> np.ndarray:
    """Anchors that occur more than ``group`` times, sorted; at most one in ``group`` of all, so the driver holds them.

    Anchors that occur once in a task are not counted there, which leaves at most one more occurrence per task to the others.
    """
    counted = rows.mapInArrow(_counted(p), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > p.group)
    return np.sort(np.array([r.gram for r in counted.select("gram").collect()], np.int64).view(U64))


_WINDOW = ["one", "two", "owner", "first", "mask"]


def _windows(p: Repeats, hot: np.ndarray):
    """Windows over hot anchors by two hashes. Those that a task has several times are settled (``mask``) and one row without
    a place (``first`` -1) tells others; only those that it has once go by their hashes."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        one, two, owner, first, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        edge = np.append(np.flatnonzero(new), len(order))
        n = np.empty(len(order), np.int64)
        n[order] = np.repeat(np.diff(edge), np.diff(edge))
        told = order[edge[:-1]][np.diff(edge) > 1]
        alone, many = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
        # settled windows of one segment are one row
        cuts = np.flatnonzero(np.append(True, (owner[many][1:] != owner[many][:-1]) | (start[many][1:] != start[many][:-1]) | (first[many][1:] <= first[many][:-1]))) if len(many) else many
        masks = np.bitwise_or.reduceat(U64(1) << (first - start)[many].astype(U64), cuts) if len(many) else np.zeros(0, U64)
        known = many[cuts]
        place = np.arange(len(known), dtype=U64)
        columns = [
            np.concatenate((one[alone], one[told], mix(owner[known].view(U64) + place))).view(np.int64),
            np.concatenate((two[alone], two[told], place)).view(np.int64),
            np.concatenate((owner[alone], np.zeros(len(told), np.int64), owner[known])),
            np.concatenate((first[alone], np.full(len(told), -1), start[known])).astype(np.int32),
            np.concatenate((np.zeros(len(alone) + len(told), U64), masks)).view(np.int64),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in slices(batches):
            words = split_words(*utf8(part.column("text")))
            hashes = words.hashes()
            s = segments(words, hashes, p)
            some = np.flatnonzero(_within(s.gram, hot))
            if not len(some):
                continue
            n = s.n[some]
            at = spread(s.first[some], n)
            doc = np.repeat(s.doc[some], n)
            base = words.first[doc]
            owner = part.column("owner").to_numpy()[doc]
            held.append((runs(hashes, p.window)[at], runs(mix(~hashes), p.window)[at], owner, at - base, np.repeat(s.first[some], n) - base))
            if sum(len(x[0]) for x in held) >= p.held:
                yield settle(held)
                held = []
        if held:
            yield settle(held)

    return run


def _anchors(p: Repeats, hot: np.ndarray):
    def run(part: pa.RecordBatch):
        words = split_words(*utf8(part.column("text")))
        s = _cold(segments(words, words.hashes(), p), hot)
        order = np.argsort(s.doc, kind="stable")
        return part.column("owner").to_numpy(), words.counts, s.doc[order], s.gram[order]

    return run


_PIECE = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("owners", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32()))])


def _plant(p: Repeats, buckets: int, hot: np.ndarray):
    """Rows of one prefix and the words around it; equal ones of a slice are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split_words(*utf8(part.column("text")))
            s = _cold(segments(words, words.hashes(), p), hot)
            known = np.unique(part.column("tokens").flatten().to_numpy())
            if not len(known) or not len(s.n):
                continue
            ids = token_ids(s.gram, buckets)
            spot = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            kept = known[spot] == ids
            doc, first, n, key = s.doc[kept], s.first[kept], s.n[kept], mix(s.gram[kept])
            owners, local = part.column("owner").to_numpy()[doc], first - words.first[doc]
            low, high = words.starts[first], words.ends[first + n + p.window - 2]
            raw = words.data.tobytes()
            found: dict[tuple[int, bytes], tuple[list, list]] = {}
            for k, a, b, owner, at_word in zip(key.view(np.int64).tolist(), low.tolist(), high.tolist(), owners.tolist(), local.tolist(), strict=True):
                held = found.setdefault((k, raw[a:b]), ([], []))
                held[0].append(owner)
                held[1].append(at_word)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int64()), pa.array([w for _, w in found], pa.binary()), *(pa.array([v[i] for v in found.values()], f.type) for i, f in enumerate(list(_PIECE)[2:]))],
                    schema=_PIECE,
                )

    return run


def deep_nodes(words: Words, weights: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix start, repeated) for all suffixes of at least ``depth`` words of the given texts.

    Ranks of prefixes of 1, 2, 4, .. words sort the suffixes; those with one rank at ``depth`` lie below one node of the
    suffix tree. It is a repeat if it has several leaves. ``weights``: how often each text occurs.
    """
    at = inner(words.first, depth)
    if not len(at):
        return at, np.zeros(0, bool)
    rank = np.unique(words.hashes(), return_inverse=True)[1].astype(U64)
    reach = 1
    while 2 * reach <= depth:
        pairs = rank[:-reach] << U64(32) | rank[reach:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(U64)
        reach *= 2
    name = rank[at]
    if reach < depth:
        name = np.unique(name << U64(32) | rank[at + (depth - reach)], return_inverse=True)[1]
    leaves = np.bincount(name.astype(np.int64), weights[np.searchsorted(words.first, at, "right") - 1])
    return at, leaves[name.astype(np.int64)] > 1


def _trees(p: Repeats):
    """Rows come by key and words: equal words are one text of the tree, whatever the number of rows."""

    def grow(texts: list[bytes], members: list[list[tuple[list, list]]]) -> Iterator[pa.RecordBatch]:
        words = split_words(*utf8(pa.array(texts, pa.binary()).cast(pa.large_binary()).view(pa.large_string())))
        weights = np.array([min(2, sum(len(o) for o, _ in m)) for m in members])
        at, repeated = deep_nodes(words, weights, p.window)
        text = np.searchsorted(words.first, at, "right") - 1
        masks = np.zeros(len(texts), U64)
        np.bitwise_or.at(masks, text[repeated], U64(1) << (at - words.first[text])[repeated].astype(U64))
        some = np.flatnonzero(masks)
        owners = [o for i in some for own, _ in members[i] for o in own]
        firsts = [f for i in some for _, fs in members[i] for f in fs]
        counts = [sum(len(own) for own, _ in members[i]) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(firsts, pa.int32()), pa.array(np.repeat(masks[some], counts).view(np.int64))], ["owner", "first", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        members: list[list[tuple[list, list]]] = []
        size, key = 0, None
        for batch in batches:
            for k, w, owners, firsts in zip(*(batch.column(c).to_pylist() for c in _PIECE.names), strict=True):
                if k != key:
                    if size >= p.batch * 7:
                        yield from grow(texts, members)
                        texts, members, size = [], [], 0
                    key = k
                elif w == texts[-1]:
                    members[-1].append((owners, firsts))
                    continue
                texts.append(w)
                members.append([(owners, firsts)])
                size += len(w)
        if texts:
            yield from grow(texts, members)

    return run


def _clean(p: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split_words(*utf8(part.column("text")))
            cut = np.zeros(len(words.starts), bool)
            lists = part.column("found")
            bounds = lists.offsets.to_numpy()
            entries = lists.flatten()
            rows = np.repeat(np.arange(len(part)), np.diff(bounds)) if len(entries) else np.zeros(0, np.int64)
            if len(entries):
                mask, first = entries.field("mask").to_numpy().view(U64), entries.field("first").to_numpy().astype(np.int64)
                for bit in range(p.window - p.gram + 1):
                    some = np.flatnonzero(mask >> U64(bit) & U64(1))
                    starts = words.first[rows[some]] + first[some] + bit
                    step = np.zeros(len(cut) + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + p.window, -1)
                    cut |= np.cumsum(step)[:-1] > 0
            removed = np.add.reduceat(np.append(cut, False).astype(np.int64), words.first[:-1]) if len(part) else np.zeros(0, np.int64)
            removed[words.counts == 0] = 0
            kept = []
            for d, text in enumerate(part.column("text").to_pylist()):
                own = (text or "").encode().split()
                if removed[d]:
                    own = compress(own, ~cut[words.first[d] : words.first[d + 1]])
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def planted(rows: DataFrame, p: Repeats, hot: np.ndarray) -> DataFrame:
    """key, words, owners, firsts: segments of the anchors that occur several times but are not hot."""
    lists = shared_tokens(rows, _anchors(p, hot), once=False).select("owner", "tokens")
    buckets = buckets_of(rows.sparkSession)
    return rows.join(lists, "owner").mapInArrow(_plant(p, buckets, hot), "key long, words binary, owners array<long>, firsts array<int>")


def hot_repeats(rows: DataFrame, p: Repeats, hot: np.ndarray) -> DataFrame:
    """owner, first, mask: repeated windows over hot anchors."""
    windows = rows.mapInArrow(_windows(p, hot), "one long, two long, owner long, first int, mask long")
    n = F.sum(F.when(F.col("first") < 0, 2).otherwise(1)).over(Window.partitionBy("one", "two"))
    found = windows.withColumn("n", n).filter("first >= 0 AND (mask <> 0 OR n > 1)")
    return found.select("owner", "first", F.when(F.col("mask") != 0, F.col("mask")).otherwise(F.lit(1)).alias("mask"))


def repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """owner, first, mask: windows that occur more than once; bit i of a mask is the window that starts at word first + i.

    Rows that repeat a doc_id and its text say the same twice.

    ``owner`` is ``xxhash64(doc_id, text)``.
    """
    rows = _named(docs).select("owner", "text")
    hot = hot_anchors(rows, p)
    found = planted(rows, p, hot).repartition("key").sortWithinPartitions("key", "words").mapInArrow(_trees(p), "owner long, first int, mask long")
    return found.unionByName(hot_repeats(rows, p, hot)) if len(hot) else found


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("owner", F.xxhash64("doc_id", "text"))


def substring_dedup(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space).

    Words are runs of characters other than ASCII white space. A word goes if a window over it occurs anywhere else, in the
    same text too. Texts shorter than a window lose nothing; null counts as empty. Rows that repeat a doc_id and its text
    are copies of each other, so they lose all windows. Other columns are not looked at.
    """
    lists = repeats(docs, p).groupBy("owner").agg(F.collect_set(F.struct("first", "mask")).alias("found"))
    rows = _named(docs).join(lists, "owner", "left").select("doc_id", "text", F.coalesce("found", F.expr("CAST(array() AS array<struct<first:int,mask:bigint>>)")).alias("found"))
    return rows.mapInArrow(_clean(p), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
