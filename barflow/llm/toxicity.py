"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Per-coordinate rates and the L1 term leave a sparse weight vector, which is small enough to send to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.words import ALNUM, LOWER, mix, runs, slices, split_words, utf8

U64 = np.uint64


@dataclass(frozen=True)
class Ftrl:
    """``bits``: log2 of the number of coordinates. ``sample``: most labelled rows that a model is fitted on."""

    bits: int = 20
    sample: int = 20_000
    shards: int = 1
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, text) of every word, pair of neighbours and pair around one word."""
    words = split_words(data, offsets, ALNUM, LOWER)
    h, doc = words.hashes(), words.docs()
    found, docs = [h], [doc]
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        found.append(runs(h, 2)[same])
        docs.append(doc[1:][same])
    if len(h) > 2:
        same = doc[2:] == doc[:-2]
        found.append(mix(h[:-2] * U64(0x2545F4914F6CDD1D) + mix(h[2:]))[same])
        docs.append(doc[2:][same])
    return (np.concatenate(found) >> U64(64 - bits)).astype(np.int64), np.concatenate(docs)


def _packed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, doc = features(*utf8(part.column("text")), bits)
            both = np.unique(doc << bits | at)
            bounds = np.searchsorted(both, np.arange(len(part) + 1, dtype=np.int64) << bits)
            own = (both & ((1 << bits) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("shard"), part.column("rank"), part.column("y"), pa.array([own[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                ["shard", "rank", "y", "at"],
            )

    return run


def ftrl(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> np.ndarray:
    """Weights after ``epochs`` passes over (coordinates, label); the last coordinate is the intercept."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(p.epochs):
        for at, y in rows:
            at = np.append(at, np.int32(size - 1))
            zi, ni = z[at], n[at]
            shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(at == size - 1, 0.0, p.l1), 0.0)
            w = -shrunk / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
            gap = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = ni + gap * gap
            z[at] = zi + gap - (np.sqrt(grown) - np.sqrt(ni)) / p.alpha * w
            n[at] = grown
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0.0)
    shrunk[-1] = z[-1]
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> dict[int, float]:
    """Sparse weights from the labelled rows that are not held out.

    ``labels`` has doc_id and a 0/1 label ``toxic``; rows with null are no examples, of rows with one doc_id the largest
    label counts. At most ``p.sample`` rows are used, chosen by a hash of doc_id. They are dealt to ``p.shards`` tasks;
    each fits its own model, and the weights are averaged. Without examples there is an intercept of -1 only, which calls nothing toxic.
    """
    chosen = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
        .withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(p.sample)
        .withColumn("shard", F.pmod("rank", F.lit(p.shards)).cast("int"))
    )
    # the sample has at most p.sample rows of 24 bytes
    examples = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("shard", "rank", "y", "text")
    packed = examples.mapInArrow(_packed(p.bits), "shard int, rank long, y int, at binary")

    def one(key, rows):
        import pandas as pd

        rows = rows.sort_values(["rank", "at"])
        w = ftrl([(np.frombuffer(a, np.int32), y) for a, y in zip(rows["at"], rows["y"], strict=True)], p)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at], "shard": key[0]})

    fitted = packed.groupBy("shard").applyInPandas(one, "at long, w double, shard int")
    rows = fitted.collect()  # at most shards * coordinates that the L1 term left
    if not rows:
        return {1 << p.bits: -1.0}
    shards = len({r.shard for r in rows})
    total: dict[int, float] = {}
    for r in sorted(rows, key=lambda r: (r.at, r.shard)):
        total[r.at] = total.get(r.at, 0.0) + r.w / shards
    return total


def held_out(doc_id) -> F.Column:
    """Every fifth row by the checksum of its id is kept for tests."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, weights: dict[int, float], p: Ftrl = Ftrl()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; only the text is looked at. A null or empty text gets the intercept's score.

    Columns of those names in ``docs`` are replaced.
    """
    dense = np.zeros((1 << p.bits) + 1, np.float32)
    if weights:
        dense[list(weights)] = list(weights.values())
    shared = docs.sparkSession.sparkContext.broadcast(dense)  # 4 bytes for each of 2**bits coordinates
    kept = docs.drop("score", "predicted")
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in slices(batches):
            at, doc = features(*utf8(part.column("text")), p.bits)
            told = np.flatnonzero(w[at])
            both = np.unique(doc[told] << p.bits | at[told])
            total = np.bincount(both >> p.bits, w[both & ((1 << p.bits) - 1)].astype(float), len(part)) + float(w[-1])
            values = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], [*part.schema.names, "score"])

    out = kept.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """All documents with ``score`` and ``predicted`` of a model fitted on ``labels``."""
    return score(docs, fit(docs, labels, p), p)
