"""Packing by power-of-two decomposition: no sequence holds parts of two documents and nothing is padded.

A document of n tokens becomes n // 2048 full pieces and the pieces that the binary digits of the rest name, longest first.
Each piece is a sequence of its own; sequences of one length form a bucket, from which training draws its batches.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.words import slices

#: The longest sequence and the id that ends a document.
LONGEST = 2048
END_ID = 1
#: Bits of a sequence_id below the bucket's exponent.
BUCKET_SHIFT = 59


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as full pieces of ``longest`` (a power of two) and the powers of two of the rest, falling."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts by the byte-level BPE in a ``tokenizers`` file.

    A plain text goes through a ranked table of the same vocabulary, which is several times faster and gives the same ids
    (``tests/llm/test_packing.py``); a text that holds the name of an added token goes through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        at = _byte_of_char()
        ranks = {bytes(at[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        #: Fixed value: how byte-level BPE parts a text before merging.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(name in text for name in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(made.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                start = 0
                for length in piece_lengths(len(ids), longest):
                    rows.append((doc, start, length, len(ids), ids[start : start + length].tobytes()))
                    start += length
            kinds = [part.column("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def pack(docs: DataFrame, path: str, longest: int = LONGEST) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset.

    ``path`` is a byte-level ``tokenizers`` file, the same on every machine. A document is the ids of its text (no special
    tokens added; a special token's name in the text is that token) and id 1; a null or empty text is id 1 alone.
    ``ids`` holds unsigned 32-bit ids, little-endian. Each piece is a sequence, so ``offset`` is 0; its length is a power of
    two and needs no padding. ``sequence_id`` is unique; those of a bucket (log2 of the length) are one range. Rows that
    repeat a doc_id, equal rows and null doc_ids are packed row by row. Other columns are not looked at; an empty table has
    no pieces. Nothing is shuffled: a document is cut where it is read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(_pieces(path, longest), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    return (
        pieces.withColumn("bucket", F.log2("length").cast("int"))
        .withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), BUCKET_SHIFT) + F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """The sequences as Parquet, one folder ``bucket=<log2 of the length>`` for each length, so that a batch reads one length."""
    pieces.select("doc_id", "start", "length", "sequence_id", "ids", "bucket").write.partitionBy("bucket").parquet(folder)
