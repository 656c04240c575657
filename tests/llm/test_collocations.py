"""Phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from barflow.llm import collocations as co
from barflow.llm.collocations import Rule, collocations, frequent


def brute(rows, rule):
    """Rows of ``collocations`` without the pointers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, rule.longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    cand = {key: a for key, a in f.items() if a >= rule.least and len(key[1]) > 1}
    for (lang, w), a in cand.items():
        hidden = any(
            other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= rule.cover * a
            for (other, v), b in cand.items()
        )
        if not hidden:
            cuts = [(rule.scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    done, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= rule.top:
            done.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return done


def made(seed=5, size=400):
    rng = random.Random(seed)
    words = ["new", "York", "city", "the", "of", "état", "ß", "a", "b", "中文", "x'y", "\x00z"]
    rows = []
    for i in range(size):
        text = " ".join(rng.choice(["new york city", "New  York", "the state of", "of the", *words]) + rng.choice(["", "", "", ".", ",", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(0, 25)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("en", " ... "), ("fr", "once only")] + [("en", "copy of a copy of a copy")] * 40


def table(spark, rows):
    return spark.createDataFrame([(i % 97 if i % 5 else None, lang, text, 1.0, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n double, phrase string")


def got(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("rule", [Rule(least=8), Rule(least=8, bits=6), Rule(least=3, top=5, bits=12), Rule(least=60, longest=3, cover=30), Rule(least=12, longest=2)])
def test_phrases_equal_counting(spark, rule):
    rows = made()
    want = sorted(brute(rows, rule))
    assert want and got(collocations(table(spark, rows), rule)) == want


def test_small_blocks_change_nothing(monkeypatch):
    rows, rule = made(9, 200), Rule(least=6)
    for name in ("HELD", "HELD_PHRASES"):
        monkeypatch.setattr(co, name, 50)
    sent = co._send(rule, 4)
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"text": [t for _, t in rows], "seed": pa.array([7] * len(rows), pa.int64())})
    rows_out = [r for b in sent(iter([part])) for r in b.to_pylist()]
    prints = np.concatenate([p for _, p in co._grams(part, 4)[2]])
    assert len({r["bucket"] for r in rows_out}) > 1 and sum(len(r["tokens"]) for r in rows_out) == 5 * len(np.unique(prints))


def test_equal_fingerprints_do_not_mix_phrases(monkeypatch):
    """With every fingerprint the same, only the texts tell phrases apart."""
    rows, rule = made(3, 150), Rule(least=5)
    plain = co._grams

    def same(part, longest):
        words, doc, grams = plain(part, longest)
        return words, doc, [(at, np.zeros(len(at), np.uint64)) for at, _ in grams]

    import pyarrow as pa

    monkeypatch.setattr(co, "_grams", same)

    class Shared:
        value = np.full(1 << rule.bits - 3, 255, np.uint8)

    part = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(rows)), pa.int64()), "lang": [x or "und" for x, _ in rows], "seed": pa.array([1] * len(rows), pa.int64()), "text": [t for _, t in rows]})
    found = {(r["lang"], r["phrase"]): r["n"] for b in co._phrases(rule, Shared)(iter([part])) for r in b.to_pylist() if r["words"]}
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            want.update((lang or "und", " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert found == want


def test_pointers_lead_to_the_phrase(spark):
    rows = [(9, "en", "red fox. red fox"), (4, "en", "a b. the Red fox"), (7, "en", "red fox red fox"), (None, "en", "red fox")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    (r,) = frequent(df, Rule(least=6)).filter("words = 2").collect()
    assert (r.phrase, r.a, r.doc_id) == ("red fox", 6, 4)


def test_hot_words_and_long_texts(spark):
    """One word is a part of two thirds of all candidates; one text has 200,000 words."""
    rows = [("en", " ".join(f"hot w{i}" for i in range(1500)))] * 3 + [("de", "ab cd " * 100_000)]
    rule = Rule(least=3, top=50, longest=2)
    assert got(collocations(table(spark, rows), rule)) == sorted(brute(rows, rule))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations(empty).collect() == []
    assert collocations(table(spark, [("en", None), (None, "")])).collect() == []
