"""Words, exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barflow.llm import exact_dedup, ngram_join, substring_dedup
from barflow.llm.components import components
from barflow.llm.words import ALNUM, LOWER, runs, split_words, utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
ODD = [None, "", " \n\t ", "one", "two words", "é ü x", "a a a a a a a a a a a a a a a a"]


def frame(spark, texts, first=0):
    """Texts as documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, "en", "s", 0, 0.5, "k") for i, t in enumerate(texts)], SCHEMA)


def fold(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def near_copies(rng, groups, size, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_words_and_hashes():
    texts = ["Ab, cé d9-x", None, "", "  tail ", "x" * 40 + " y"]
    data, offsets = utf8(pa.array(texts))
    plain = split_words(data, offsets)
    assert [plain.data[a:b].tobytes().decode() for a, b in zip(plain.starts, plain.ends, strict=True)] == [w for t in texts for w in (t or "").split()]
    words = split_words(data, offsets, ALNUM, LOWER)
    got = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for t in texts for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))]
    assert words.counts.tolist() == [4, 0, 0, 1, 2]
    h = split_words(*utf8(pa.array(["a b a b", "b a b"]))).hashes()
    assert len(set(h.tolist())) == 2 and h[0] == h[2] == h[5]
    two = runs(h, 2)
    assert two[0] == two[2] == two[5] and two[1] == two[4] != two[0]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("trie_bytes", [10, 10_000])
def test_exact_dedup(spark, keep, trie_bytes):
    texts = [*ODD, *ODD, "ab", "abc", "abd", "b", "abc", "two words "] * 2
    docs = frame(spark, texts).union(frame(spark, ["abc"], 3))  # a doc_id twice
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    pick = max if keep == "largest" else min
    exact_dedup_owners = {r.text.decode(): (r.owner, r.members) for r in exact_dedup.owners(docs, keep, trie_bytes).collect()}
    want = {t: (pick(d for d, x in rows if x == t), sum(x == t for _, x in rows)) for _, t in rows}
    assert exact_dedup_owners == want
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, keep).collect())
    assert got == sorted((d, *want[t], d == want[t][0], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    lost = spark.createDataFrame([(None, "abc", "en", "s", 0, 0.5, "k")], SCHEMA)
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(lost).collect()] == [(None, None, 0, True)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_spills_many_texts_at_once(monkeypatch):
    """What a task holds is looked through once for many texts that it gives away, not once for each."""
    looked = []

    class Counted(exact_dedup.Trie):
        @property
        def bytes(self):
            looked.append(1)
            return self.held

        @bytes.setter
        def bytes(self, value):
            self.held = value

    monkeypatch.setattr(exact_dedup, "Trie", Counted)
    texts = [b"", *(b"%0100d" % (i % 3900) for i in range(4000))]
    rows = [(len(t), hash(t) >> 1, t, i, 1) for i, t in enumerate(texts)]
    given = [r for batch in exact_dedup._gather(True, 200_000)([exact_dedup._batch(rows)]) for r in batch.to_pylist()]
    assert len(looked) < 40 * len(texts)
    found = {}
    for r in given:
        owner, members = found.get(r["text"], (-1, 0))
        found[r["text"]] = max(owner, r["owner"]), members + r["members"]
    assert found == {t: (max(i for i in (k, k + 3900) if i < len(texts) and texts[i] == t), texts.count(t)) for k, t in enumerate(texts[:3901])}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (7, 10), *((100 + i, 101 + i) for i in range(40))]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, **{100 + i: 100 for i in range(41)}}


def brute_join(rows, k=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[root(i)] = min(d, first.get(root(i), d))
    return sorted((d, len(sets[i]), first[root(i)]) for i, (d, _) in enumerate(rows))


def test_ngram_join(spark):
    rng = random.Random(5)
    texts = near_copies(rng, 12, 9) + near_copies(rng, 1, 40, 200) + ODD * 2 + ["one two three four", "ONE two three Four", "one two three four five"]
    rng.shuffle(texts)
    docs = frame(spark, texts).union(frame(spark, ["another text of five words", "one"], 3))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs).collect())
    assert got == brute_join(rows)
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    lost = spark.createDataFrame([(None, "a b c d e", "en", "s", 0, 0.5, "k")], SCHEMA)
    assert [tuple(r) for r in ngram_join.ngram_join(lost).collect()] == [(None, 2, None)]


def test_ngram_join_without_star_rounds(spark):
    docs = frame(spark, near_copies(random.Random(6), 6, 8))
    like = ngram_join.Likeness()
    sets = ngram_join.shared_shingles(docs, like).cache()
    with_stars, without = ({r.node: r.component for r in ngram_join.link_sets(sets, like, stars=n).collect()} for n in (3, 0))
    assert with_stars == without and without


def brute_repeats(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        cut = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cut[i : i + window] = True
        kept = b" ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((d, len(w), int(cut.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


@pytest.mark.parametrize("group", [3, 20_000])
def test_substring_dedup(spark, group):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 30))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w for part in parts for w in part))
    texts += [*ODD, "x " * 50, "p q " * 30, texts[0], texts[1]]
    docs = frame(spark, texts).union(frame(spark, [texts[2]], 2))  # a whole row twice
    p = substring_dedup.Repeats(window=10, gram=3, group=group)
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(docs, p).collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 10)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_a_long_text_and_a_default_window(spark):
    words = [f"u{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(["x", *words[100:135], "y"]), " ".join(words[200:234])]
    got = [r.n_removed for r in substring_dedup.substring_dedup(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [35, 35, 0]


@pytest.mark.parametrize("held", [50, 1_000_000])
def test_a_passage_in_many_texts_makes_no_large_group(spark, held):
    rng = random.Random(17)
    passage = [f"c{i}" for i in range(50)]
    texts = []
    for i in range(300):
        low, high = rng.randint(0, 15), rng.randint(35, 50)
        texts.append(" ".join([*(f"a{i}.{j}" for j in range(rng.randint(0, 30)) ), *passage[low:high], *(f"z{i}.{j}" for j in range(rng.randint(0, 30)))]))
    docs = frame(spark, texts + texts[:3]).repartition(4)
    p = substring_dedup.Repeats(window=25, gram=5, group=20, held=held)
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(docs, p).collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 25)
    if held > 50:
        rows = substring_dedup._named(docs).select("owner", "text")
        hot = substring_dedup.hot_anchors(rows, p)
        members = Counter()
        for r in substring_dedup.planted(rows, p, hot).collect():
            members[r.key] += len(r.owners)
        assert len(hot) and max(members.values(), default=0) <= 20 + 4
