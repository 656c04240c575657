"""The pipeline against a brute-force version of its stages, and the registered queries."""

import os

import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

from test_filters import brute_hits  # noqa: E402
from test_words_and_sets import brute_join  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
import corpus_pipeline  # noqa: E402
from barflow.llm import mixing, toxicity  # noqa: E402


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    told = toxicity.toxicity(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    left = {r.doc_id: r.text for r in told if not r.predicted}
    owner = {}
    for d, t in left.items():
        owner[t or ""] = max(d, owner.get(t or "", d))
    left = {d: t for d, t in left.items() if owner[t or ""] == d}
    left = {d: left[d] for d, _, first in brute_join(list(left.items())) if d == first}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    left = {d: left[d] for d, *_, bad in brute_hits(list(left.items()), items) if not bad}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(left)
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = {}
    for d, t in left.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len((t or "").encode().split())
    target = mixing.source_targets(list(sizes.items()))
    for r in got:
        assert r.size == len((left[r.doc_id] or "").encode().split()) and r.taken == r.copies * r.size <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert 0.9 * sum(target.values()) <= sum(r.taken for r in got) <= 1.1 * sum(target.values())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    """Repeated ids and rows, null ids, texts and sources, copies, near copies, benchmark passages under all of them."""
    import random

    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["lake", "stone", "green", "river", "walks", "paper", "quiet", "morning", "window", "train", "sings", "cloud"]) + str(rng.randrange(400)) for _ in range(n))
    ((item,),) = duckdb.sql(f"SELECT text FROM read_parquet('{SF_DIR}/benchmark.parquet') ORDER BY len(text) DESC LIMIT 1").fetchall()
    base = [prose(60) for _ in range(6)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in base]
    leaked = f"{prose(20)} {item} {prose(20)}"
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(base)]
    rows += [(i + 10, t, None, "b", 2) for i, t in enumerate(base[:3])] + [(10, base[0], "de", "c", 3)]  # copies, one id and text twice
    rows += [(i + 20, t, "en", None, None) for i, t in enumerate(near[:4])] + [(None, near[4], "en", "a", 4), (None, base[5], "en", "a", 5)]
    rows += [(30, leaked, "en", "a", 6), (30, prose(40), "en", "a", 6), (None, leaked + " end", "en", "b", 7), (None, prose(30), "fr", "b", 8)]
    rows += [(31, "same row of few words", "en", "a", 9)] * 3 + [(None, "no id twice", "en", None, 9)] * 2 + [(None, "no id twice", "fr", None, 9)]
    rows += [(32, None, "en", "a", 0), (33, "", None, "a", 0), (None, None, None, None, None), (32, "another text of id 32", "en", "a", 1), (34, " \t ", "en", "b", 2)]
    return rows, item


def _one_of(rows, got, group_of, better):
    """Each group keeps one of its rows with the best doc_id; nothing else is lost or made."""
    groups = {}
    for r in rows:
        groups.setdefault(group_of(r), []).append(r)
    left = [tuple(r) for r in got]
    assert len(left) == len(groups)
    for own in groups.values():
        ids = [r[0] for r in own if r[0] is not None]
        best = better(ids) if ids else None
        mine = [r for r in left if r in own]
        assert len({r for r in mine}) == 1 and mine[0][0] == best


def test_exact_stage_decides_by_row(spark):
    rows, _ = _rows()
    got = corpus_pipeline.drop_exact_copies(spark, spark.createDataFrame(rows, COLUMNS), SF_DIR).collect()
    _one_of(rows, got, lambda r: r[1] or "", max)


def test_near_stage_decides_by_row(spark):
    rows, _ = _rows()
    tagged = brute_join([(i, r[1]) for i, r in enumerate(rows)])
    group = {i: first for i, _, first in tagged}
    for i, r in enumerate(rows):  # texts without words are alone
        if not (r[1] or "").split():
            group[i] = ("alone", i)
    numbered = [(*r, i) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(numbered, COLUMNS + ", row int")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()
    _one_of(numbered, got, lambda r: group[r[5]], min)
    plain = corpus_pipeline.drop_near_copies(spark, docs.drop("row"), SF_DIR)
    assert plain.count() == len(got) and plain.columns == docs.columns[:-1]


def test_contaminated_rows_go_whatever_their_id(spark):
    rows, item = _rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    got = corpus_pipeline.drop_contaminated(spark, docs, SF_DIR).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    verdicts = [v[-1] for v in brute_hits([(i, r[1]) for i, r in enumerate(rows)], items)]
    want = [r for r, gone in zip(rows, verdicts, strict=True) if not gone]
    assert len(want) < len(rows) and any(r[0] == 30 for r in want)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rows_without_id_or_source_are_mixed(spark):
    rows, _ = _rows()
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, COLUMNS), SF_DIR).collect()
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(r[0]), str(r[3]), len((r[1] or "").encode().split())) for r in rows)


def test_toxic_stage_and_columns(spark):
    rows, _ = _rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = [tuple(r) for r in corpus_pipeline.reject_toxic(spark, docs, SF_DIR).collect()]
    assert all(r in rows for r in kept) and len(kept) >= len(rows) - 3
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF_DIR)
    left = out.collect()
    assert len([r for r in left if r.doc_id == 31]) == 1 and len([r for r in left if r.doc_id == 30]) == 1 and any(r.doc_id is None for r in left)


def test_each_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in entry_points.oracle_sql() if n.startswith("op")))
def test_query_matches_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(entry_points.__file__), "scripts"))
    from compare import connect, rows_of

    df = entry_points.queries()[name](spark, SF_DIR)
    cursor = connect(SF_DIR).execute(entry_points.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
