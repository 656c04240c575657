"""Exact duplicates: owners of texts in compressed radix tries.

Texts are dealt by length and content hash. Tries compare whole byte strings, so equal hashes never make texts equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.groups import keep_one

#: Bytes that the tries of a task hold before they give their largest subtrees away.
TRIE_BYTES = 64_000_000
#: Bytes that a trie takes besides its edge labels.
EMPTY_TRIE = 800


class Trie:
    """A Patricia trie: edges carry byte strings, terminal nodes carry [owner, members].

    A node is ``[label, children by first byte or None, terminal or None]``.
    """

    def __init__(self, largest: bool):
        self.pick = max if largest else min
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, text: bytes, owner: int, members: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if at == len(text):
                held = node[2]
                node[2] = [owner if held is None else self.pick(owner, held[0]), members + (held[1] if held else 0)]
                return
            below = node[1].get(text[at]) if node[1] else None
            if below is None:
                if node[1] is None:
                    node[1] = {}
                node[1][text[at]] = [text[at:], None, [owner, members]]
                self.bytes += len(text) - at
                return
            label = below[0]
            if not text.startswith(label, at):
                shared = _common(label, text[at : at + len(label)])
                upper = [label[:shared], {label[shared]: below}, None]
                below[0] = label[shared:]
                node[1][text[at]] = below = upper
            node, at = below, at + len(below[0])

    def drain(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        """(text, owner, members) of all terminals below a node, in byte order; no recursion, as chains may be long."""
        stack = [(node or self.root, prefix)]
        while stack:
            at, path = stack.pop()
            path += at[0]
            if at[2] is not None:
                yield path, *at[2]
            stack += [(at[1][b], path) for b in sorted(at[1] or (), reverse=True)]

    def spill(self) -> Iterator[tuple[bytes, int, int]]:
        """Take away the largest subtree below the root (edge bytes below it), and then further ones down to half of the bytes."""
        sizes = {b: _size(x) for b, x in self.root[1].items()}
        goal = self.bytes // 2
        for b in sorted(sizes, key=lambda b: (-sizes[b], b)):
            if self.bytes <= goal:
                return
            below = self.root[1].pop(b)
            self.bytes -= sizes[b]
            yield from self.drain(below)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings that differ within the shorter one or end there."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _size(node: list) -> int:
    total, stack = 0, [node]
    while stack:
        at = stack.pop()
        total += len(at[0])
        stack += (at[1] or {}).values()
    return total


_OUT = pa.schema([("len", pa.int32()), ("hash", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("members", pa.int64())])
_SPEC = "len int, hash long, text binary, owner long, members long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def _in_batches(rows: Iterator[tuple], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 40
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _gather(largest: bool, limit: int):
    """One row for each text that a task sees (more after a spill): hot texts shrink before they are shuffled.

    A spill takes half of what is held, the largest tries first, so that they are sought once for many texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            tries: dict[tuple[int, int], Trie] = {}
            size = 0
            for batch in batches:
                for n, h, text, owner, members in zip(*(batch.column(c).to_pylist() for c in _OUT.names), strict=True):
                    trie = tries.get((n, h))
                    if trie is None:
                        trie = tries[(n, h)] = Trie(largest)
                        size += EMPTY_TRIE
                    before = trie.bytes
                    trie.insert(text, owner, members)
                    size += trie.bytes - before
                    while size > limit:
                        for key in sorted(tries, key=lambda k: -tries[k].bytes):
                            if size <= limit // 2:
                                break
                            below = tries[key]
                            before = below.bytes
                            yield from ((*key, *x) for x in below.spill())
                            size -= before - below.bytes
                            if not below.root[1]:
                                yield from ((*key, *x) for x in below.drain())  # the empty text
                                del tries[key]
                                size -= EMPTY_TRIE
            for key, trie in tries.items():
                yield from ((*key, *x) for x in trie.drain())

        yield from _in_batches(rows())

    return run


def _merge(largest: bool, limit: int):
    """One row for each text: rows come by length and hash, so one trie at a time is held.

    A trie holds texts of one length and hash; that is one text unless hashes collide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, trie = None, Trie(largest)
            for batch in batches:
                for n, h, text, owner, members in zip(*(batch.column(c).to_pylist() for c in _OUT.names), strict=True):
                    if (n, h) != key:
                        if key:
                            yield from ((*key, *x) for x in trie.drain())
                        key, trie = (n, h), Trie(largest)
                    trie.insert(text, owner, members)
            if key:
                yield from ((*key, *x) for x in trie.drain())

        yield from _in_batches(rows())

    return run


def owners(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: len, hash, text (bytes), owner (smallest or largest doc_id), members.

    Null counts as the empty text. Rows with a null doc_id are left out.
    """
    largest = keep == "largest"
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.filter("doc_id IS NOT NULL").select(
        F.octet_length(raw).alias("len"), F.xxhash64(raw).alias("hash"), raw.alias("text"), F.col("doc_id").cast("long").alias("owner"), F.lit(1).cast("long").alias("members")
    )
    local = rows.mapInArrow(_gather(largest, trie_bytes), _SPEC)
    return local.repartition("len", "hash").sortWithinPartitions("len", "hash").mapInArrow(_merge(largest, trie_bytes), _SPEC)


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text; empty texts are equal. ``keep_id`` is the smallest (or largest) doc_id with the same bytes.
    Rows that repeat a doc_id and its text are members of one group, each is ``kept`` if its id is the group's. A null
    doc_id is given back with null keep_id, size 0 and kept. Other columns are not looked at.
    """
    named = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    # singletons own themselves: only texts with several members have to find their rows
    groups = owners(docs, keep).filter("members > 1").select(F.sha2("text", 256).alias("text_sha256"), F.col("owner"), "members")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("text_sha256")).join(groups, "text_sha256", "left")
    missing = F.col("doc_id").isNull()
    owner = F.when(~missing, F.coalesce("owner", "doc_id"))
    return out.select(
        "doc_id",
        owner.alias("keep_id"),
        F.when(missing, F.lit(0)).otherwise(F.coalesce("members", F.lit(1))).cast("long").alias("group_size"),
        F.coalesce(owner == F.col("doc_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each distinct text: that with the largest (or smallest) doc_id.

    Null counts as the empty text. A row without doc_id only stays where no equal text has one. Of rows that share text and
    doc_id one stays, whatever their other columns; a doc_id that stands for several texts keeps each of them.
    """
    none = F.lit(-(1 << 63) if keep == "largest" else (1 << 63) - 1)
    ranked = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), "text")
    best = F.when(F.col("owner") != none, F.col("owner"))
    groups = owners(ranked, keep).filter("members > 1").select(F.sha2("text", 256).alias("_key"), best.alias("_best"), F.col("members").alias("m")).withColumn("_group", F.col("_key"))
    return keep_one(docs, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), groups)
