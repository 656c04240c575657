"""Phrases whose words occur together more often than apart, by Rabin-Karp fingerprints.

Prefix polynomials give every run of one to four words a fingerprint. A first pass counts fingerprints on packed blocks and
leaves a bitmap of those that may be frequent. A second pass writes out the runs that the bitmap lets through, with a pointer
to an occurrence, and counts them by their text: fingerprints that collide cannot mix phrases, and only runs that may be
frequent ever become strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.hot_keys import hot_parts, join_parts
from barflow.llm.words import LOWER, NOT_SPACE, Words, mix, runs, slices, split_words, utf8
from barflow.session import cut_lineage

U64 = np.uint64

#: Bytes that end a piece, and bytes that are part of a word.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
LETTERS = NOT_SPACE & ~BREAK

#: Fingerprints and counts that a task holds before it sends them.
HELD = 2_000_000
#: Bytes of text that the second pass looks at at once, as it makes an object of each word.
SLICE = 1_000_000
#: Phrases that a task holds before it sends them.
HELD_PHRASES = 100_000


@dataclass(frozen=True)
class Rule:
    """Candidates have 2 to ``longest`` words and ``least`` occurrences; a longer one with ``cover`` percent of them hides a part of it.

    ``bits``: log2 of the bitmap's size. It bounds what is broadcast, not what is found: a fuller bitmap lets more rare runs
    through to the second count.
    """

    longest: int = 4
    least: int = 30
    cover: int = 80
    top: int = 2000
    scale: int = 2_000_000
    bits: int = 27


# ----------------------------------------------------------------------------------- fingerprints
def _grams(part: pa.RecordBatch, longest: int) -> tuple[Words, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, their texts, and for 1, 2 .. words the first positions of the runs inside a piece and their fingerprints."""
    words = split_words(*utf8(part.column("text")), LETTERS, LOWER)
    h, doc = words.hashes(), words.docs()
    seed = part.column("seed").to_numpy().view(U64)[doc]
    breaks = np.cumsum(BREAK[words.data], dtype=np.int64)[words.starts]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
    piece = np.cumsum(new)
    out = []
    for k in range(1, longest + 1):
        n = max(len(h) - k + 1, 0)
        at = np.flatnonzero(piece[:n] == piece[k - 1 :][:n])
        out.append((at, mix(runs(h, k)[at] ^ seed[at])))
    return words, doc, out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _five(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys[:, None].view(np.uint8)[:, :5])


def _send(rule: Rule, depth: int):
    """Rows (bucket, tokens, counts). The bucket is the first ``depth`` bits of the fingerprints, a token the 40 bits behind."""
    small = np.uint8 if rule.least < 256 else np.uint32

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        tokens, counts = _five(keys >> U64(24 - depth)), np.minimum(counts, rule.least).astype(small)
        ends = np.searchsorted(keys >> U64(64 - depth), np.arange((1 << depth) + 1, dtype=U64))
        some = np.flatnonzero(np.diff(ends))
        blobs = lambda x: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), blobs(tokens), blobs(counts)], ["bucket", "tokens", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in slices(batches):
            for _, prints in _grams(part, rule.longest)[2]:
                held.append(_summed(prints, np.ones(len(prints), np.int64)))
                size += len(held[-1][0])
            if size > HELD:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if size:
            yield rows(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _mark(rule: Rule, depth: int):
    """(bucket, bitmap): the bucket's stretch of the bitmap, a bit for each token that may be frequent. One bucket is held at a time."""
    small = np.uint8 if rule.least < 256 else np.uint32

    def bitmap(bucket: int, tokens: list[bytes], counts: list[bytes]) -> tuple[int, bytes]:
        raw = np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        keys, total = _summed(wide.view(U64).ravel(), np.frombuffer(b"".join(counts), small).astype(np.int64))
        bits = np.zeros(1 << (rule.bits - depth), bool)
        bits[(keys[total >= rule.least] >> U64(40 - (rule.bits - depth))).astype(np.int64)] = True
        return bucket, np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tokens, counts, out = None, [], [], []
        for batch in batches:
            for bucket, t, c in zip(*(batch.column(n).to_pylist() for n in ("bucket", "tokens", "counts")), strict=True):
                if bucket != at and tokens:
                    out.append(bitmap(at, tokens, counts))
                    tokens, counts = [], []
                at = bucket
                tokens.append(t)
                counts.append(c)
        if tokens:
            out.append(bitmap(at, tokens, counts))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "bitmap"])

    return run


def screen(rows: DataFrame, rule: Rule) -> np.ndarray:
    """Packed bitmap over the first ``bits`` bits of a fingerprint: every run that occurs ``least`` times has its bit set.

    The bitmap has the same size whatever the input; it is all that the driver sees.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = min(rule.bits - 3, 16, max(3, (8 * parts).bit_length()))
    sent = rows.mapInArrow(_send(rule, depth), "bucket int, tokens binary, counts binary")
    marked = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_mark(rule, depth), "bucket int, bitmap binary")
    bits = np.zeros(1 << rule.bits - 3, np.uint8)
    width = 1 << rule.bits - depth - 3
    for r in marked.toLocalIterator():
        bits[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.bitmap, np.uint8)
    return bits


# ----------------------------------------------------------------------------------- phrases
def _phrases(rule: Rule, shared):
    """(lang, words, phrase, n, doc_id): runs of which every part passes the bitmap, counted by text within a task."""

    def passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
        place = (prints >> U64(64 - rule.bits)).astype(np.int64)
        return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)

    def found(part: pa.RecordBatch, bits: np.ndarray, held: dict) -> None:
        # in order of doc_id, so that the first occurrence has the smallest
        part = part.take(pc.sort_indices(part.column("doc_id")))
        words, doc, grams = _grams(part, rule.longest)
        if not len(doc):
            return
        raw = words.data.tobytes()
        texts = [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]
        known: dict[bytes, int] = {}
        word = np.array([known.setdefault(t, len(known)) for t in texts], np.int64)
        langs = part.column("lang").to_pylist()
        names: dict[str, int] = {}
        lang = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)[doc]
        ids = part.column("doc_id").to_pylist()
        for name, i in names.items():
            key = (name, 0, None)
            held[key] = (held.get(key, (0,))[0] + int((lang == i).sum()), None)
        # exact numbers of runs: that of the run without its last word, and the last word
        number = np.full(len(doc), -1, np.int64)
        for k, (at, prints) in enumerate(grams, 1):
            at = at[passes(bits, prints)]
            if k > 1:
                at = at[(number[at] >= 0) & (number[at + 1] >= 0)]
            key = (lang[at] if k == 1 else number[at]) * len(known) + word[at + k - 1]
            _, first, which, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            number = np.full(len(doc), -1, np.int64)
            number[at] = which
            for i, n in zip(at[first].tolist(), many.tolist(), strict=True):
                d = doc[i]
                key = (langs[d], k, b" ".join(texts[i : i + k]))
                total, pointer = held.get(key, (0, None))
                own = ids[d]
                held[key] = (n + total, own if pointer is None or own is not None and own < pointer else pointer)

    def rows(held: dict) -> pa.RecordBatch:
        keys, values = zip(*held, strict=True), zip(*held.values(), strict=True)
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        out = [pa.array(x, t) for x, t in zip((*keys, *values), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([out[0], out[1], out[2].cast(pa.string()), *out[3:]], ["lang", "words", "phrase", "n", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for part in slices(batches, most=SLICE):
            found(part, shared.value, held)
            if len(held) > HELD_PHRASES:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


def frequent(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """lang, words, phrase, a, doc_id: runs of 1 to ``longest`` words that occur at least ``least`` times, and where.

    A row with 0 words has the number of words of the language. ``doc_id`` points to an occurrence: the smallest doc_id
    whose text holds the phrase, null if those have none.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.col("text").cast("string").alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(screen(rows, rule))  # 2**(bits - 3) bytes
    told = rows.mapInArrow(_phrases(rule, bits), "lang string, words int, phrase string, n long, doc_id long")
    counted = told.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("a"), F.min("doc_id").alias("doc_id"))
    return counted.filter((F.col("a") >= rule.least) | (F.col("words") == 0))


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, doc_id.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and at blanks and tabs into words; phrases do
    not cross pieces. ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the
    language; score = floor(scale * a / (l + r)). Null languages are ``und``, null texts are empty. Equal rows, repeated and
    null doc_ids count like any row; other columns are not looked at; an empty table gives no phrase. Order: score and a
    falling, phrase by its bytes.
    """
    counted = cut_lineage(frequent(docs, rule))
    runs_ = counted.filter("words > 0")
    split = F.split("phrase", " ")
    candidates = runs_.filter("words > 1").select("lang", "phrase", "words", "a", "doc_id", split.alias("w"))

    # cuts: both parts are runs of their own and at least as frequent
    cut = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    join = lambda start, size: F.concat_ws(" ", F.slice("w", start, size))
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        own = runs_.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cut = join_parts(cut, own, ["lang", side], hot_parts(cut.groupBy("lang", side).agg(F.count("*").alias("m")), ["lang", side]))
    ratio = F.expr(f"CAST({rule.scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    worst = cut.withColumn("score", ratio).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # parts of longer candidates
    spans = [(i, n) for n in range(2, rule.longest) for i in range(rule.longest - n + 1)]
    inside = F.filter(
        F.array(*[F.when(F.size("w") >= max(i + n, n + 1), F.concat_ws(" ", F.slice("w", i + 1, n))) for i, n in spans]).cast("array<string>"), lambda x: x.isNotNull()
    )
    longer = candidates.filter("words > 2").select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    hidden = F.coalesce(_wide("longest") * 100 >= _wide("a") * rule.cover, F.lit(False))
    left = candidates.join(longer, ["lang", "phrase"], "left").filter(~hidden).join(worst, ["lang", "phrase"])
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "doc_id")

    # the best of a language: first within parts of it, so that no task orders a whole language
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= rule.top)
    totals = counted.filter("words = 0").select("lang", F.col("a").alias("n"))
    return left.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "doc_id")
