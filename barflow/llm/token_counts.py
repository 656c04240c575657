"""Token counts per source, language and tokenizer version, kept up to date by signed changes.

A batch of inserts, deletes and revised counts becomes signed rows against the state before it; their sums are added to the
totals. A batch is three writes under its own id: signed rows, their sums, and last a commit mark. Readers see marked
batches only, and a batch that is marked is not applied again, so batches may be replayed after any failure.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm.words import slices
from barflow.session import cut_lineage

#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEY = ["source", "lang", "version"]

_SIGNED = "doc_id long, source string, lang string, version string, tokens long, sign int"
_TOTAL = "source string, lang string, version string, docs long, tokens long"


@lru_cache(maxsize=4)
def encoding(ranks_path: str):
    """A byte-level BPE from a file of tokens and ranks, which every worker can read. Loaded once a worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding(ranks_path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``docs`` (doc_id, source, lang, text) with ``tokens`` instead of the text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path)
        for part in slices(batches):
            counts = [len(enc.encode_ordinary(x)) if x else 0 for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")


class Rollup:
    """Totals in a shared ``folder`` (signed rows, their sums and commit marks by batch id).

    A document counts once per tokenizer version. Source and language may be null, null is a value of its own.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch_id string").parquet(f"{self.folder}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch_id string")

    def _committed(self, kind: str, schema: str) -> DataFrame:
        return self._read(kind, schema).join(self._read("commits", "rows long").select("batch_id").distinct(), "batch_id", "left_semi")

    def state(self) -> DataFrame:
        """Documents as they count now: doc_id, source, lang, version, tokens."""
        rows = self._committed("signed", _SIGNED)
        return rows.groupBy("doc_id", *KEY, "tokens").agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; groups whose documents are all gone are left out."""
        rows = self._committed("sums", _TOTAL)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of (op, doc_id, version and, but for deletes, source, lang, tokens); false if it was applied before.

        ``op`` is insert, revise or delete; insert and revise both set a document's count under a version. Of several
        changes to one document and version the one with the largest ``seq`` (if there is such a column), then tokens,
        source, lang, op holds. Deletes of what is not there, other ops and null doc_ids do nothing; null tokens are 0. A batch
        must give the same rows when it is replayed.
        """
        if not self._read("commits", "rows long").filter(F.col("batch_id") == batch_id).isEmpty():
            return False
        for name, kind in (("seq", "long"), ("source", "string"), ("lang", "string"), ("tokens", "long")):
            if name not in changes.columns:
                changes = changes.withColumn(name, F.lit(None).cast(kind))
        rank = F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), "tokens", "source", "lang", "op")
        rows = changes.filter("op IN ('insert', 'revise', 'delete') AND doc_id IS NOT NULL").select("op", F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("version", F.lit("")).alias("version"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "seq")
        # written once: counting tokens is the work here, and both signs need the changes
        last = cut_lineage(rows.groupBy("doc_id", "version").agg(F.max(rank).alias("x")).select("doc_id", "version", "x.op", "x.source", "x.lang", "x.tokens"))
        old = self.state().join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        minus = old.select("doc_id", *KEY, "tokens", F.lit(-1).alias("sign"))
        plus = last.filter("op <> 'delete'").select("doc_id", *KEY, "tokens", F.lit(1).alias("sign"))
        minus.unionByName(plus).write.mode("overwrite").parquet(f"{self.folder}/signed/batch_id={batch_id}")
        signed = self.spark.read.schema(_SIGNED).parquet(f"{self.folder}/signed/batch_id={batch_id}")
        sums = signed.groupBy(*KEY).agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/batch_id={batch_id}")
        mark = self.spark.createDataFrame([(0,)], "rows long").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.folder}/commits/batch_id={batch_id}")
        return True
