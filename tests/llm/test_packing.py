"""Packing: every token comes back, by the tokenizer's own ids."""

import os
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from barflow.llm.packing import END_ID, Encoder, pack, piece_lengths, write_buckets  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_piece_lengths():
    assert piece_lengths(1) == [1] and piece_lengths(2048) == [2048] and piece_lengths(4096 + 7) == [2048, 2048, 4, 2, 1]
    for n in range(1, 9000, 37):
        own = piece_lengths(n)
        assert sum(own) == n and own == sorted(own, reverse=True) and all(x & (x - 1) == 0 for x in own)
        assert len(own) == n // 2048 + bin(n % 2048).count("1")


def test_encoder_equals_the_tokenizer(plain):
    made = Encoder(PATH)
    texts = ["", " ", "\n\n  x", "it's  we'll\t é", "<|endoftext|> a<|endoftext|>", "中文 и русский 123,456", "a\x00b", "ẞ́ \U0001f600"]
    texts += [" ".join(f"a{chr(c)}{chr(c)} 1{chr(c)} !{chr(c)}  {chr(c)}" for c in range(a, a + 64) if not 0xD800 <= c <= 0xDFFF) for a in range(0, 0x30000, 1024)]
    for t in texts:
        assert made.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_round_trip(spark, plain):
    long = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
    rows = [(1, "A short text."), (2, None), (3, ""), (4, long), (1, "A short text."), (None, "no id"), (5, "x <|endoftext|> y")]
    docs = spark.createDataFrame([(*r, "s", 7, 0) for r in rows], "doc_id long, text string, ids string, length int, offset int")
    got = pack(docs, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by = {}
    for r in got:
        assert r.offset == 0 and r.length == 1 << r.bucket and r.length <= 2048 and r.sequence_id >> 59 == r.bucket
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, END_ID]
        own = sorted(by[doc], key=lambda r: r.start)
        copies = 2 if doc == 1 else 1
        assert len(own) == copies * len(piece_lengths(len(ids))) and {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
        assert sum(r.length for r in own) == copies * len(ids)


def test_empty_table_and_other_lengths(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert pack(empty, PATH).count() == 0
    docs = spark.createDataFrame([("a", "one two three four five")], "doc_id string, text string")
    assert [r.length for r in pack(docs, PATH, longest=4).orderBy("start").collect()] == [4, 2]
    with pytest.raises(ValueError):
        pack(docs, PATH, longest=3)


def test_buckets_are_written_apart(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    pieces = pack(docs, PATH)
    write_buckets(pieces, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "bucket=3"))
    assert back.count() == pieces.filter("bucket = 3").count() and all(len(r.ids) == 32 for r in back.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query(spark, plain):
    from barflow.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op13_packing"](spark, "/root/testdata/sf0.001").collect()
    total = dict.fromkeys(docs, 0)
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, END_ID] for d, t in docs.items()}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        total[r.doc_id] += r.length
    assert total == {d: len(x) for d, x in ids.items()}
