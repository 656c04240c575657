"""Balanced mixing and delta-maintained token counts."""

import os
import random

import numpy as np
import pytest

from barflow.llm import mixing, token_counts

DOCS = "doc_id long, text string, lang string, source string, size long, target double"


def test_targets_fill_up():
    got = mixing.source_targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    # a, b, c, null weigh 5, 2, 1, 5 and share 1665; a, b and c stop at twice their size
    assert got == {"a": 20.0, "b": 200.0, "c": 0.0, None: 1445.0}
    assert mixing.source_targets([]) == {}


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, x = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    q = mixing.flight(p, x, rng.random(500))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ x - p @ x) < 1e-3
    same = mixing.flight(np.full(9, 0.5), np.ones(9), rng.random(9))
    assert abs(same.sum() - 4.5) < 1e-9


def test_flight_keeps_probabilities():
    x = np.array([3.0, 5.0, 8.0, 1.0, 9.0])
    rng = np.random.default_rng(2)
    drawn = np.mean([mixing.flight(np.full(5, 0.4), x, rng.random(5)) for _ in range(4000)], axis=0)
    assert np.abs(drawn - 0.4).max() < 0.03


def test_mix(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        source = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 80))), "en", source, 1, 1.0))
    rows += [(3000, None, None, "s1", 1, 1.0), (3001, "only one source", None, "z", 1, 1.0), (None, "x", None, "z", 1, 1.0), (5, "a b c", None, "s2", 1, 1.0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    assert len(got) == len(rows) and [r.source for r in got if r.doc_id is None] == ["z"]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    target = mixing.source_targets(list(sizes.items()))
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= 160
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_rollup(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path))
    cols = "op string, doc_id long, source string, lang string, version string, tokens long, seq long"
    change = lambda *rows: spark.createDataFrame(rows, cols)
    assert rollup.totals().count() == 0
    first = change(("insert", 1, "a", "en", "v1", 10, 0), ("insert", 2, "a", None, "v1", 5, 0), ("insert", 2, "a", None, "v2", 6, 0), ("insert", 3, None, "en", "v1", None, 0), ("insert", None, "a", "en", "v1", 9, 0), ("what", 9, "a", "en", "v1", 9, 0))
    assert rollup.apply("0", first) and not rollup.apply("0", first)
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v1", 1, 10), ("a", None, "v1", 1, 5), ("a", None, "v2", 1, 6), (None, "en", "v1", 1, 0)}
    second = change(("revise", 1, "b", "en", "v1", 12, 1), ("revise", 1, "b", "en", "v1", 11, 2), ("delete", 2, None, None, "v1", None, 0), ("delete", 77, None, None, "v1", None, 0), ("revise", 3, None, "en", "v1", 4, 0))
    assert rollup.apply("1", second)
    assert {tuple(r) for r in rollup.totals().collect()} == {("b", "en", "v1", 1, 11), ("a", None, "v2", 1, 6), (None, "en", "v1", 1, 4)}
    # a batch that broke off before its mark is not seen, and can be applied again
    os.rename(tmp_path / "commits/batch_id=1", tmp_path / "lost")
    assert {r.tokens for r in rollup.totals().collect()} == {10, 5, 6, 0}
    assert rollup.apply("1", second)
    assert {r.tokens for r in rollup.totals().collect()} == {11, 6, 4}
    assert rollup.state().count() == 3


def test_token_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    texts = [None, "", "Hello world, it's 42.", "é" * 50, " "]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.0) for i, t in enumerate(texts)], DOCS)
    enc = token_counts.encoding(path)
    got = [r.tokens for r in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()]
    assert got == [len(enc.encode_ordinary(t or "")) for t in texts] and got[2] > 3
