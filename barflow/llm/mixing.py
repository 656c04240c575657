"""Mixing sources to target weights by balanced sampling with the cube method.

A document of a source that is to be taken r times on average is taken floor(r) times for certain and once more with
probability r - floor(r). The cube method draws these extra takes so that document and word totals of a source hold: it
moves the probabilities along directions that change neither total until nearly all are 0 or 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.session import cut_lineage

#: Documents of one flight; each leaves at most as many open ones as there are constraints.
BLOCK = 4096
#: An open probability this near to 0 or 1 is settled.
TINY = 1e-9


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source. Sources are ordered by code point, null last, and weigh ``weights`` in turn.

    ``share`` of all words is dealt by weight; no source gets more than ``most`` times its own, the excess goes to the others.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    limit = {s: most * n for s, n in ordered}
    left, open_ = share * sum(n for _, n in ordered), [s for s, _ in ordered]
    target: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: float(limit[s]) for s in over}
        left -= sum(limit[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def flight(p: np.ndarray, x: np.ndarray, dice: np.ndarray) -> np.ndarray:
    """Move probabilities p until at most two are open, keeping sum(p) and sum(p * x).

    Three open units at a time: the direction u with u1 + u2 + u3 = 0 and x1 u1 + x2 u2 + x3 u3 = 0 is their cross product.
    ``dice`` has a uniform number for each step.
    """
    p = p.tolist()
    x = x.tolist()
    dice = dice.tolist()
    held: list[int] = []
    for i in range(len(p)):
        if TINY < p[i] < 1 - TINY:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / d if d > 0 else -p[k] / d for k, d in zip(held, u, strict=True) if d)
        down = min(p[k] / d if d > 0 else (p[k] - 1) / d for k, d in zip(held, u, strict=True) if d)
        step = up if dice[i] * (up + down) < down else -down
        for k, d in zip(held, u, strict=True):
            q = p[k] + step * d
            p[k] = 0.0 if q <= TINY else 1.0 if q >= 1 - TINY else q
        held = [k for k in held if 0 < p[k] < 1]
    return np.array(p)


_COLUMNS = ["src", "doc_id", "named", "size", "order", "whole", "p"]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    from barflow.llm.words import mix

    return (mix(mix(keys.astype(np.int64).view(np.uint64)) + np.uint64(salt)) >> np.uint64(11)).astype(float) / float(1 << 53)


def _fly(salt: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id"])
        x = rows["size"].to_numpy(float)
        rows = rows[_COLUMNS]
        rows = rows.assign(p=flight(rows["p"].to_numpy(float), x / max(x.max(), 1.0), _uniform(rows["order"].to_numpy(), salt)))
        return rows

    return run


def _land(rows: pd.DataFrame) -> pd.DataFrame:
    """Settle the few units that are still open: of all 0/1 choices the one with the nearest word total."""
    rows = rows.sort_values(["order", "doc_id"])
    p, x = rows["p"].to_numpy(float), rows["size"].to_numpy(float)
    at = np.flatnonzero((p > 0) & (p < 1))
    goal = float(p[at] @ x[at])
    best = min(range(1 << len(at)), key=lambda m: (abs(sum(x[k] for j, k in enumerate(at) if m >> j & 1) - goal), m))
    for j, k in enumerate(at):
        p[k] = best >> j & 1
    rows["p"] = p
    return rows


#: ``named``: whether the row has a doc_id; without one it is 0, as frames of pandas hold no missing integers.
_UNIT = "src int, doc_id long, named boolean, size long, order long, whole long, p double"


def _open_counts(units: DataFrame) -> dict[int, int]:
    """Open units by source: one row per source."""
    return {r.src: r.n for r in units.filter("p > 0 AND p < 1").groupBy("src").agg(F.count("*").alias("n")).collect()}


def cube(units: DataFrame, salt: int = 0, block: int = BLOCK) -> DataFrame:
    """``units`` (src, doc_id, named, size, order, whole, p) with p drawn to 0 or 1.

    Flights in blocks of about ``block`` units of a source, then over what they leave open, then landing. A level turns a
    block into two open units, so the number of levels is the logarithm of the units, and no task holds a whole source.
    """
    spark = units.sparkSession
    done = [units.filter("p = 0 OR p = 1")]
    left = units.filter("p > 0 AND p < 1")
    counts = _open_counts(left)
    level = 0
    while max(counts.values(), default=0) > 2:
        blocks = spark.createDataFrame([(s, -(-n // block)) for s, n in counts.items()], "src int, blocks int")
        dealt = left.join(F.broadcast(blocks), "src").withColumn("block", F.expr(f"pmod(xxhash64(order, {level}), blocks)")).drop("blocks")
        flown = cut_lineage(dealt.groupBy("src", "block").applyInPandas(_fly(salt + level), _UNIT))
        done.append(flown.filter("p = 0 OR p = 1"))
        left = flown.filter("p > 0 AND p < 1")
        counts = _open_counts(left)
        level += 1
    out = left.groupBy("src").applyInPandas(_land, _UNIT)  # at most two units of a source
    for part in done:
        out = out.unionByName(part)
    return out


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, salt: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Size is the number of words (null text: 0). A null source is a source of its own. Texts without words are taken 0 or more
    times, which changes no word total. Rows that share a doc_id or have none are drawn one by one. Draws depend on doc_id, source and
    size only, so that reruns agree. Other columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    )
    # one row per source; its weight depends on the order of all sources
    totals = [(r.source, r.total) for r in sized.groupBy("source").agg(F.sum("size").alias("total")).collect()]
    target = source_targets(totals, weights, share, most)
    listed = [(i, s, int(n), float(target[s]), target[s] / n if n else 0.0) for i, (s, n) in enumerate(sorted(totals, key=lambda x: (x[0] is None, x[0] or "")))]
    table = spark.createDataFrame(listed, "src int, source string, source_size long, target double, rate double")
    whole = F.floor(F.col("rate") + TINY)
    part = F.col("rate") - whole
    units = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["source"])).select(
        "src", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "size", F.xxhash64("doc_id", "size", F.lit(salt)).alias("order"), whole.alias("whole"), F.when((part > TINY) & (F.col("size") > 0), part).otherwise(0.0).alias("p")
    )
    copies = (F.col("whole") + F.col("p")).cast("int")
    return (
        cube(units, salt)
        .join(F.broadcast(table), "src")
        .select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
    )
