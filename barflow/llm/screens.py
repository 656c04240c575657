"""How often hashed tokens occur over all texts, counted on packed blocks.

A row per token would dwarf its eight bytes. Here a task sends one row of bytes for each bucket of tokens, and gets told, by
owner, which of them occur more than once. A bucket is a range of hashes; the number of buckets follows
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.words import give_back, slices, spread

U64 = np.uint64
_LOW = U64((1 << 48) - 1)

#: A slice of rows to (owner, size) of its owners and (owner's index, hash) of their tokens, by owner.
Tokens = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def buckets_of(spark: SparkSession) -> int:
    return min(32767, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def token_ids(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low 48 bits of each hash as one integer: 48 bits and those of the bucket tell tokens apart."""
    bucket = (hashes >> U64(32)) * U64(buckets) >> U64(32)
    return (bucket << U64(48) | hashes & _LOW).view(np.int64)


def _pack(tokens: Tokens, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owners, sizes, own, hashes = tokens(part)
            if not len(hashes):
                continue
            ids = token_ids(hashes, buckets)
            bucket = (ids >> 48).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            own, raw = own[order], _six(ids[order])
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                low, high = ends[b], ends[b + 1]
                if low < high:
                    some, counts = np.unique(own[low:high], return_counts=True)
                    narrow = np.uint16 if counts.max() < 1 << 16 else np.uint32
                    out.append((b, owners[some].tobytes(), sizes[some].astype(np.int32).tobytes(), counts.astype(narrow).tobytes(), raw[low:high].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "owners", "sizes", "counts", "tokens"])

    return run


def _counts(row: dict) -> np.ndarray:
    return np.frombuffer(row["counts"], np.uint16 if 4 * len(row["counts"]) == len(row["owners"]) else np.uint32).astype(np.int64)


_REPLY = ["dest", "bucket", "owners", "sizes", "lengths", "tokens", "counts"]
_PACKED = "bucket int, owners binary, sizes binary, counts binary, tokens binary"
_ANSWER = "dest int, bucket int, owners binary, sizes binary, lengths binary, tokens binary, counts binary"


def _six(ids: np.ndarray) -> np.ndarray:
    """The low six bytes of each integer."""
    return np.ascontiguousarray(ids[:, None].view(np.uint8)[:, :6])


def _wide(blobs: list[bytes]) -> np.ndarray:
    """Integers from their low six bytes."""
    wide = np.zeros((sum(map(len, blobs)) // 6, 8), np.uint8)
    at = 0
    for blob in blobs:
        raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
        wide[at : at + len(raw), :6] = raw
        at += len(raw)
    return wide.view(np.int64).ravel()


def _told(bucket: int, rows: list[dict], once: bool, buckets: int) -> pa.RecordBatch:
    """One row per destination: the tokens of this bucket that several owners hold, by owner."""
    owners = np.concatenate([np.frombuffer(r["owners"], np.int64) for r in rows])
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows])
    counts = np.concatenate([_counts(r) for r in rows])
    tokens = _wide([r.pop("tokens") for r in rows])
    if once:
        starts = np.cumsum(counts) - counts
        owners, first = np.unique(owners, return_index=True)
        sizes, counts = sizes[first], counts[first]
        tokens = tokens[spread(starts[first], counts)]
    order = np.argsort(tokens)
    ranked = tokens[order]
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    many = np.empty(len(tokens), np.int32)
    many[order] = np.repeat(np.diff(edge), np.diff(edge))
    shared = many > 1
    held = np.concatenate(([0], np.cumsum(shared)))
    bounds = held[np.concatenate(([0], np.cumsum(counts)))]
    tokens, many = tokens[shared], many[shared]
    some = np.flatnonzero(np.diff(bounds))
    dest = (owners[some].view(U64) % U64(buckets)).astype(np.int64)
    some, dest = some[np.argsort(dest, kind="stable")], np.sort(dest)
    out = []
    for d in np.unique(dest):
        own = some[np.searchsorted(dest, d) : np.searchsorted(dest, d, "right")]
        lengths = np.diff(bounds)[own]
        at = spread(bounds[own], lengths)
        out.append((int(d), bucket, owners[own].tobytes(), sizes[own].tobytes(), lengths.astype(np.int32).tobytes(), _six(tokens[at]).tobytes(), many[at].tobytes()))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], _REPLY)


def _gathered(rows: list[dict]) -> pa.RecordBatch:
    """One row per owner, its shared tokens from rare to frequent."""
    owners = np.concatenate([np.frombuffer(r["owners"], np.int64) for r in rows])
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows])
    lengths = np.concatenate([np.frombuffer(r["lengths"], np.int32) for r in rows]).astype(np.int64)
    per_row = [len(r["tokens"]) // 6 for r in rows]
    tokens = _wide([r.pop("tokens") for r in rows]) | np.repeat(np.array([r["bucket"] for r in rows], np.int64) << 48, per_row)
    counts = np.concatenate([np.frombuffer(r.pop("counts"), np.int32) for r in rows])
    names, first, which = np.unique(owners, return_index=True, return_inverse=True)
    which = np.repeat(which, lengths)
    order = np.lexsort((tokens, counts, which))
    offsets = pa.array(np.searchsorted(which[order], np.arange(len(names) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array(sizes[first]), pa.ListArray.from_arrays(offsets, pa.array(tokens[order])), pa.ListArray.from_arrays(offsets, pa.array(counts[order]))],
        ["owner", "n", "tokens", "counts"],
    )


def _grouped(column: str, fold: Callable[[list[dict]], pa.RecordBatch]):
    """Rows come by ``column``; those of one value are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for i in range(len(batch)):  # a row at a time: blobs of a batch are not all copied at once
                row = batch.slice(i, 1).to_pylist()[0]
                if held and row[column] != held[0][column]:
                    yield fold(held)
                    held = []
                held.append(row)
        if held:
            yield fold(held)
        held = []
        give_back()

    return run


def shared_tokens(rows: DataFrame, tokens: Tokens, once: bool) -> DataFrame:
    """owner, n, tokens, counts: per owner the tokens that occur more than once over all rows, rare ones first.

    ``rows`` has a column text, next to what ``tokens`` reads. ``once``: owners of the same name hold the same tokens and
    count as one; else every occurrence counts, and an owner that comes in several slices is told its tokens as often.
    Answers travel packed too, by hash of the owner.
    """
    buckets = buckets_of(rows.sparkSession)
    packed = rows.mapInArrow(_pack(tokens, buckets), _PACKED)
    by_bucket = packed.repartition(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    told = by_bucket.mapInArrow(_grouped("bucket", lambda held: _told(held[0]["bucket"], held, once, buckets)), _ANSWER)
    by_owner = told.repartition(buckets, F.col("dest")).sortWithinPartitions("dest")
    return by_owner.mapInArrow(_grouped("dest", _gathered), "owner long, n int, tokens array<long>, counts array<int>")
