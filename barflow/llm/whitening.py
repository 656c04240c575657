"""Embedding whitening over distinct vectors.

Entries become integers, so identical vectors can be grouped. The fit takes each distinct vector once (or as often as it
occurs), multiplies centred blocks in the tasks and adds their d x d products. Each distinct vector is whitened once and
joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.hot_keys import hot_parts, join_parts
from barflow.session import cut_lineage

#: Fixed values of the quantisation: x = floor(STEPS * c) + SHIFT.
STEPS = 64
SHIFT = 1_000_000
#: |STEPS * c| beyond this is taken as this, so that integers stay exact in double precision.
EDGE = 1 << 52


# ----------------------------------------------------------------------------------- vectors as bytes
def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, x): entries as floor(STEPS * c) in the fewest bytes that hold the vector, behind that number of bytes."""
    for batch in batches:
        lists = batch.column(1)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        c = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        broken = np.concatenate(([0], np.cumsum(~np.isfinite(c))))
        good = np.flatnonzero((broken[bounds[1:]] == broken[bounds[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False))
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.clip(np.floor(c * STEPS), -EDGE, EDGE)
        y = np.where(np.isfinite(y), y, 0).astype(np.int64)
        packed = []
        for i in good:
            own = y[bounds[i] : bounds[i + 1]]
            low, high = (int(own.min()), int(own.max())) if len(own) else (0, 0)
            width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
            packed.append(bytes([width]) + own.astype(f"<i{width}").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(lengths[good].astype(np.int32)), pa.array(packed, pa.binary())], ["id", "dim", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of 64-bit integers (without SHIFT, which no covariance sees)."""
    return np.array([np.frombuffer(raw[1:], f"<i{raw[0]}") for raw in column.to_pylist()], np.int64)


# ----------------------------------------------------------------------------------- sums in tasks
def _totals(rows: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(pos, high, low): exact column sums of weighted integers, high * 2**26 + low, one row per task and column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in batches:
            if len(batch):
                x, w = read(batch)
                w = w.astype(object) if w.max() > 1 else w
                h, l = ((x >> 26) * w[:, None]).sum(axis=0), ((x & (1 << 26) - 1) * w[:, None]).sum(axis=0)
                high, low = (h, l) if high is None else (high + h, low + l)
        if high is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high), dtype=np.int32)), pa.array([int(v) for v in high], pa.int64()), pa.array([int(v) for v in low], pa.int64())], ["pos", "high", "low"])

    return rows.mapInArrow(run, "pos int, high long, low long")


def _product(rows: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], middle: np.ndarray) -> np.ndarray:
    """Sum of w * (x - middle) (x - middle)^T. Tasks send d rows of d numbers; a row's sum is formed where it is gathered.

    Only the d x d result reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x, w = read(batch)
                away = x - middle
                part = (away * w[:, None]).T @ away
                total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), task, np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["pos", "task", "row"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for pos, raw in zip(batch.column("pos").to_pylist(), batch.column("row").to_pylist(), strict=True):
                row = np.frombuffer(raw)
                sums[pos] = sums[pos] + row if pos in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["pos", "row"])

    parts = rows.mapInArrow(run, "pos int, task int, row binary")
    out = parts.repartition("pos").sortWithinPartitions("pos", "task").mapInArrow(add, "pos int, row binary").collect()
    return np.array([np.frombuffer(r.row) for r in sorted(out, key=lambda r: r.pos)])


# ----------------------------------------------------------------------------------- fit
@dataclass(frozen=True)
class Whitening:
    """``basis``: one column per component, already divided by the root of its variance. Vectors of other lengths than ``dim`` have no component."""

    dim: int
    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.variances]


def _weight(weights: str) -> Column:
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    return F.lit(1).cast("long") if weights == "one" else F.col("m")


def _read_x(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(batch.column("x")), batch.column("w").to_numpy()


def fit(distinct: DataFrame, components: int = 16, weights: str = "one") -> Whitening | None:
    """Principal components of the distinct vectors (dim, x, m); None for an empty table.

    Only vectors of the commonest length (by rows; of equally common ones the longest) are fitted. A component without
    variance (below the rounding of the largest) is left out.
    """
    lengths = distinct.groupBy("dim").agg(F.sum("m").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0].dim
    rows = distinct.filter(F.col("dim") == dim).select("x", _weight(weights).alias("w"))
    n = rows.agg(F.sum("w")).first()[0]
    if not dim:
        return Whitening(0, n, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = {r.pos: (int(r.high) << 26) + int(r.low) for r in _totals(rows, _read_x).groupBy("pos").agg(wide("high").alias("high"), wide("low").alias("low")).collect()}
    total = tuple(sums[i] for i in range(dim))
    v = _product(rows, _read_x, np.array([s / n for s in total])) / n
    e, u = np.linalg.eigh((v + v.T) / 2)  # d x d
    order = np.argsort(-e)[:components]
    order = order[e[order] > max(e.max(), 0.0) * dim * np.finfo(float).eps]
    e, u = e[order], u[:, order]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0)
    return Whitening(dim, n, total, u / np.sqrt(e), e, float(np.trace(v)))


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n x - S)^2 for each row, exact; None beyond 64 bits."""
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums, strict=True))
    fits = most < 1 << 63 and max(map(abs, sums), default=0) < 1 << 62
    kind = np.int64 if fits else object
    gap = n * x.astype(kind) - np.array(sums, kind)
    return [v if v < 1 << 63 else None for v in map(int, (gap * gap).sum(axis=1))]


def _project(model: Whitening):
    mean, basis, sums, n = model.mean, model.basis, model.sums, model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"))
            z = (x - mean) @ basis
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * basis.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("m"), pa.array(_deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["x", "m", "deviation", "z"]
            )

    return run


def _read_z(size: int):
    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, size), batch.column("w").to_numpy()

    return read


def _identity_error(whitened: DataFrame, model: Whitening, weights: str) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on what was written."""
    size = model.basis.shape[1]
    if not size:
        return 0.0
    rows = whitened.select("z", _weight(weights).alias("w"))
    means = rows.select("w", F.posexplode("z").alias("pos", "z")).groupBy("pos").agg((F.sum(F.col("z") * F.col("w")) / model.n).alias("mean")).collect()
    middle = np.array([r["mean"] for r in sorted(means, key=lambda r: r.pos)])
    return float(np.abs(_product(rows, _read_z(size), middle) / model.n - np.eye(size)).max())


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16, weights: str = "one") -> DataFrame:
    """One row per row of ``vectors`` and component: ``id``, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped. ``weights``: a distinct vector counts
    ``one`` time or its ``count`` of rows. A vector of another length than the commonest, and every vector where none
    differ, has no component: its row comes once with null component. ``deviation`` is null beyond 64 bits. Null and
    repeated ids stay row by row; other columns are not looked at; an empty table gives an empty result.

    Vectors with many rows are joined in parts (``hot_keys``).
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = plain.mapInArrow(_encode, f"id {kind}, dim int, x binary")
    out = f"{id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = cut_lineage(rows.groupBy("dim", "x").agg(F.count("*").alias("m")))
    model = fit(distinct, components, weights)
    if model is None:
        return spark.createDataFrame([], out)
    own = distinct.filter(F.col("dim") == model.dim).select("x", "m")
    whitened = cut_lineage(own.mapInArrow(_project(model), "x binary, m long, deviation long, z array<double>"))
    error = _identity_error(whitened, model, weights)
    joined = join_parts(rows.select("id", "x"), whitened.select("x", "deviation", "z"), ["x"], hot_parts(whitened, ["x"]), "left")
    spread = joined.select("id", "deviation", F.posexplode_outer("z").alias("pos", "whitened"))
    explained = F.array(*[F.lit(v) for v in model.explained]) if model.explained else F.array().cast("array<double>")
    has = F.col("pos").isNotNull()
    return spread.select(
        F.col("id").alias(id),
        (F.col("pos") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.when(has, F.get(explained, F.col("pos"))).alias("explained"),
        F.when(has, F.lit(error)).alias("identity_error"),
    )
