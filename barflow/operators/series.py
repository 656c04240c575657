"""Ordered series on Spark without a window that holds a whole symbol.

Three building blocks carry every time-series operator of the package:

* ``index_bars``   dense position per symbol, from per-bucket counts
* ``apply_local``  bounded look-back / look-ahead windows over fixed-size chunks
* ``running``      unbounded prefix aggregates: chunk-local window + scanned chunk totals

A chunk has at most ``chunk_bars`` rows (plus the halo), so one symbol that owns a third of
all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barflow.config import LAYOUT, Layout
from barflow.session import kept

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


# --------------------------------------------------------------------------- prefix scans
@dataclass(frozen=True)
class Measure:
    """One prefix aggregate: ``kind`` is sum, max, product or last (last non-null struct)."""

    name: str
    kind: str
    value: Column | None = None


def _total(m: Measure, value: Column, order: Column) -> Column:
    if m.kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "product": F.product}[m.kind](value)


def _over(m: Measure, value: Column, w: WindowSpec) -> Column:
    if m.kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "product": F.product}[m.kind](value).over(w)


def _merge(m: Measure, before: Column, now: Column) -> Column:
    if m.kind == "sum":
        return F.coalesce(before, now * 0) + F.coalesce(now, before * 0)
    if m.kind == "product":
        return F.coalesce(before, F.lit(1.0)) * F.coalesce(now, F.lit(1.0))
    if m.kind == "max":
        return F.greatest(before, now)
    return F.coalesce(now, before)


def exclusive_scan(
    totals: DataFrame,
    keys: Sequence[str],
    pos: str,
    measures: Sequence[Measure],
    layout: Layout = LAYOUT,
    levels: int | None = None,
    reverse: bool = False,
) -> DataFrame:
    """``(keys, pos, c_<name>)``: aggregate of all totals strictly before ``pos``.

    ``totals`` holds one row per (keys, pos) with a column per measure name. With
    ``levels > 1`` the totals are summed per block of ``fanout`` positions first and the
    blocks are scanned recursively, so no task sees all positions of a hot key.
    """
    levels = layout.levels if levels is None else levels
    keys = list(keys)
    order = F.col(pos).desc() if reverse else F.col(pos)
    edge = -F.col(pos) if reverse else F.col(pos)

    if levels <= 1:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, pos, *[_over(m, F.col(m.name), w).alias(f"c_{m.name}") for m in measures])

    block = F.floor(F.col(pos) / layout.fanout).cast("bigint")
    blocked = totals.withColumn("_block", block)
    upper = blocked.groupBy(*keys, "_block").agg(
        *[_total(m, F.col(m.name), edge).alias(m.name) for m in measures]
    )
    upper = exclusive_scan(upper, keys, "_block", measures, layout, levels - 1, reverse)
    upper = upper.select(*keys, "_block", *[F.col(f"c_{m.name}").alias(f"u_{m.name}") for m in measures])
    w = (
        Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocked.select(
        *keys, pos, "_block", *[_over(m, F.col(m.name), w).alias(f"l_{m.name}") for m in measures]
    )
    return local.join(upper, [*keys, "_block"], "left").select(
        *keys,
        pos,
        *[_merge(m, F.col(f"u_{m.name}"), F.col(f"l_{m.name}")).alias(f"c_{m.name}") for m in measures],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    measures: Sequence[Measure],
    layout: Layout = LAYOUT,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add inclusive prefix aggregates over the full series of each key.

    ``chunk`` must be a non-decreasing function of ``order``. With ``reverse`` the prefix runs
    from the end; an ``exclusive`` one leaves the row itself out.
    """
    keys = list(keys)
    sort = [F.col(c).desc() if reverse else F.col(c) for c in order]
    if reverse and len(order) > 1:
        raise ValueError("a reversed scan takes one order column")
    edge = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    if reverse:
        edge = -edge
    totals = df.groupBy(*keys, chunk).agg(*[_total(m, m.value, edge).alias(m.name) for m in measures])
    carry = exclusive_scan(totals, keys, chunk, measures, layout, reverse=reverse)
    w = Window.partitionBy(*keys, chunk).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = df.withColumns({f"l_{m.name}": _over(m, m.value, w) for m in measures})
    joined = local.join(carry, [*keys, chunk], "left")
    return joined.withColumns(
        {m.name: _merge(m, F.col(f"c_{m.name}"), F.col(f"l_{m.name}")) for m in measures}
    ).drop(*[f"{p}_{m.name}" for m in measures for p in "lc"])


def running_whole(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[Measure], exclusive: bool = False) -> DataFrame:
    """``running`` for keys that are known to be small enough for one task each."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumns({m.name: _over(m, m.value, w) for m in measures})


def depth_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None, layout: Layout = LAYOUT) -> DataFrame:
    """``df`` with ``_chunk``, a number that does not fall along (keys, order) and names at most ``rows`` rows, whatever their times.

    Spark samples the bounds of ranges, a range is sorted and cut by counting. The result is written once, as ranges are
    drawn anew whenever they are computed.
    """
    rows = rows or layout.chunk_rows
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).sortWithinPartitions(*keys, *order)
    # a row's number: range in the upper bits, place in the range in the lower 33
    number = F.monotonically_increasing_id()
    place = number.bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.shiftleft(F.shiftright(number, 33), 20) + F.floor(place / rows).cast("bigint")
    return kept(ranged.withColumn("_chunk", chunk), "chunks")


# --------------------------------------------------------------------------- dense position
def index_bars(
    bars: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    timeframe_us: int = DAY_US,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Add ``bar_idx``: 0-based position of each bar in its series, without a per-symbol window.

    Rows are numbered inside time buckets of ``chunk_bars`` intervals and shifted by the number
    of rows in earlier buckets. (keys, ts) is unique, so a bucket holds at most ``chunk_bars``
    bars of one symbol.
    """
    keys = list(keys)
    width = timeframe_us * layout.chunk_bars
    bucketed = bars.withColumn("_bucket", F.floor(F.unix_micros(ts) / width).cast("bigint"))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = exclusive_scan(counts, keys, "_bucket", [Measure("n", "sum")], layout)
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    return (
        bucketed.withColumn("_rn", F.row_number().over(w))
        .join(before, [*keys, "_bucket"], "left")
        .withColumn("bar_idx", (F.coalesce("c_n", F.lit(0)) + F.col("_rn") - 1).cast("bigint"))
        .drop("_rn", "c_n", "_bucket")
    )


SALTS = 64


def join_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread_by: Column | str = "bar_idx", how: str = "inner") -> DataFrame:
    """Join ``per_key`` (one row per key) to the rows of ``df`` without bringing a key's rows together.

    A key's rows are dealt over ``SALTS`` parts by ``spread_by`` and its one row is copied to each of them.
    """
    by = F.col(spread_by) if isinstance(spread_by, str) else spread_by
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def with_length(indexed: DataFrame, keys: Sequence[str] = ("symbol",), name: str = "n_bars") -> DataFrame:
    """Attach the series length; one pre-aggregated row per key joins back."""
    lengths = indexed.groupBy(*keys).agg((F.max("bar_idx") + 1).alias(name))
    return join_per_key(indexed, lengths, list(keys))


# --------------------------------------------------------------------------- chunks with halo
@dataclass(frozen=True)
class State:
    """A recursion y_t = decay * y_{t-1} + term over the whole series; ``term(w)`` is the term of a bar in its frame."""

    name: str
    decay: float
    term: Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class LocalOp:
    """Columns that need at most ``back`` earlier and ``ahead`` later bars of the same series.

    ``apply(df, w)`` adds columns to the chunked frame; ``w`` is the chunk window ordered by
    ``bar_idx``. Ops passed together to ``apply_local`` share one shuffle and one sort. An op reads
    what its ``states`` were before the frame from ``_carry_<name>``.
    """

    back: int
    ahead: int
    apply: Callable[[DataFrame, WindowSpec], DataFrame]
    states: tuple[State, ...] = ()


def spread_halo(
    df: DataFrame, back: int, ahead: int, chunk_bars: int, idx: str = "bar_idx", chunk: str = "_chunk"
) -> DataFrame:
    """Copy each row to every chunk whose core or halo contains it."""
    first = F.greatest(F.floor((F.col(idx) - ahead) / chunk_bars), F.lit(0)).cast("bigint")
    last = F.floor((F.col(idx) + back) / chunk_bars).cast("bigint")
    return df.withColumn(chunk, F.explode(F.sequence(first, last)))


def _carries(framed: DataFrame, states: Sequence[State], keys: list[str], back: int, size: int, layout: Layout) -> DataFrame:
    """``(keys, _chunk, _carry_<name>)``: each state at the first bar of a frame that does not begin the series.

    A chunk is a pair (decay, total): the state it reaches from zero is the sum of its terms, each scaled by the decay since
    then, and what lies ``j`` chunks back is scaled by decay^(j * size). No op is run for it. Chunks whose scale is zero in
    double precision are outside the sum, so a task sees a block of chunks and a few before it.
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy("bar_idx")
    following = (F.col("_chunk") + 1) * size - back
    terms = framed.select(*keys, "_chunk", "bar_idx", *[s.term(w).alias(s.name) for s in states])
    totals = terms.where((F.col("bar_idx") <= following) & (following > 0)).groupBy(*keys, "_chunk").agg(
        *[F.sum(F.col(s.name) * F.pow(F.lit(s.decay), following - F.col("bar_idx"))).alias(s.name) for s in states]
    )
    scales = {s.name: math.pow(s.decay, size) for s in states}
    # 1e-330 times the largest double is zero
    reach = max(math.ceil(1470 / (-math.log(s.decay) * size)) if s.decay else 1 for s in states)
    blocks = spread_halo(totals, reach, 0, layout.fanout, idx="_chunk", chunk="_block")
    before = Window.partitionBy(*keys, "_block").orderBy("_chunk").rowsBetween(-reach, 0)
    own = F.floor(F.col("_chunk") / layout.fanout) == F.col("_block")
    for name, scale in scales.items():
        blocks = blocks.withColumn(f"_carry_{name}", F.aggregate(F.collect_list(name).over(before), F.lit(0.0), _decayed_sum(scale)))
    return blocks.where(own).select(*keys, (F.col("_chunk") + 1).alias("_chunk"), *[f"_carry_{s.name}" for s in states])


def _decayed_sum(scale: float) -> Callable[[Column, Column], Column]:
    return lambda total, x: total * scale + x


def apply_local(
    indexed: DataFrame,
    *ops: LocalOp,
    keys: Sequence[str] = ("symbol",),
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Run ops over chunks of ``chunk_bars`` rows plus a halo and keep the core rows.

    Recursions are exact: the state before a frame is carried in, one row per chunk.
    """
    keys = list(keys)
    states = [s for op in ops for s in op.states]
    back = sum(op.back for op in ops)
    ahead = sum(op.ahead for op in ops)
    size = layout.chunk_bars
    for s in states:
        # terms are rescaled within a frame by powers of the decay, which must stay finite
        if s.decay:
            size = min(size, int(690 / -math.log(s.decay)) - back - ahead)
    if size < 1:
        raise ValueError("the ops look too far around a bar for this smoothing factor")
    framed = spread_halo(indexed, back, ahead, size)
    framed = framed.withColumn("_from", F.col("_chunk") * size - back).withColumn("_pos", F.col("bar_idx") - F.col("_from"))
    if states:
        framed = framed.join(_carries(framed, states, keys, back, size, layout), [*keys, "_chunk"], "left")
    w = Window.partitionBy(*keys, "_chunk").orderBy("bar_idx")
    for op in ops:
        framed = op.apply(framed, w)
    core = F.floor(F.col("bar_idx") / size).cast("bigint") == F.col("_chunk")
    return framed.where(core).drop("_chunk", "_pos", "_from", *[f"_carry_{s.name}" for s in states])


def chunk_of(layout: Layout = LAYOUT, idx: str = "bar_idx") -> Column:
    return F.floor(F.col(idx) / layout.chunk_bars).cast("bigint")


def chunk_running(
    indexed: DataFrame,
    measures: Sequence[Measure],
    keys: Sequence[str] = ("symbol",),
    layout: Layout = LAYOUT,
    reverse: bool = False,
) -> DataFrame:
    """``running`` over dense chunks of ``bar_idx``."""
    framed = indexed.withColumn("_chunk", chunk_of(layout))
    return running(framed, keys, "_chunk", ["bar_idx"], measures, layout, reverse).drop("_chunk")
