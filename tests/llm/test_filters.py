"""Decontamination, URL rules, personal data, toxicity and page text."""

import hashlib
import itertools
import random
import re

import pytest

from barflow.llm import decontamination, html_extract, pii, toxicity, url_filter

DOCS = "doc_id long, text string, key string, n long, hits string, score double"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1, "h", 0.1) for i, t in enumerate(texts)], DOCS)


def words_of(text):
    folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)


def brute_hits(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= names
        out.append((d, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("inline", [0, 20_000])
def test_decontamination(spark, inline):
    rng = random.Random(3)
    w = [f"b{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(w) for _ in range(rng.choice([1, 2, 3, 5, 12, 25])))) for i in range(20)] + [(20, None), (21, "--"), (3, "B1, b2; b3"), (22, items_text := "q r s t u v w x y z a b")]
    texts = [None, "", "!!", "b1", items_text.upper(), "q r s t u v w x y"]
    for _ in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.3 else " ".join(rng.choice(w) for _ in range(rng.randint(1, 30))) for _ in range(4)]
        texts.append(" . ".join(parts))
    docs = docs_of(spark, texts)
    docs = docs.union(docs.filter("doc_id = 7"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.decontaminate(docs, benchmark, inline=inline).collect())
    assert got == brute_hits([(r.doc_id, r.text) for r in docs.collect()], items)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(docs_of(spark, ["a b", None]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False), (0, 0, False)]
    assert decontamination.decontaminate(docs_of(spark, []), none).count() == 0


PAGES = "page_id long, url string, html string, rule string, host string"


def test_url_rules(spark):
    urls = {
        1: ("http://A.Example.COM/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        2: ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("http://x.com", "x.com", "", None, "allow"),
        4: ("http://x.com/a#b", "x.com", "/a", "com/", "allow"),
        5: ("http://m.net/es/1://y/z", "m.net", "/es/1://y/z", "net/es/", "block"),
        6: ("http://mnet/es/", "mnet", "/es/", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme/en/", "", "", None, "allow"),
        9: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], None, "r", "h") for i, u in urls.items()], PAGES)
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages).collect()}
    assert got == {i: u[1:] for i, u in urls.items()}
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_distrust_runs_against_links_and_trust_along(spark):
    def page(i, url, *to):
        return (i, url, "".join(f"<p><A class=x HREF='{t}'>t</a>" for t in to), "r", "h")

    pages = spark.createDataFrame(
        [
            page(1, "http://bad.net/es/", "/own"),
            page(2, "http://farm.org/", "http://bad.net/es/", "//bad.net/x"),
            page(3, "http://ring.org/", "http://farm.org/"),
            page(4, "http://good.com/", "http://liked.org/"),
            page(5, "http://liked.org/", "http://bad.net/", "http://good.com/", "http://good.com/2"),
            page(6, "http://alone.org/", "relative", "#x"),
        ],
        PAGES,
    )
    got = {r.host: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert got == {"bad.net": "block", "farm.org": "block", "ring.org": "block", "good.com": "allow", "liked.org": "allow", "alone.org": "allow"}


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(odd)) % 10 == 0


def base_spans(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base_spans(spark):
    rng = random.Random(11)
    bits = ["a.b@c.de", "x@y", "@z.com", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.4.5", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 010-2030", "+12", "é", "\U0001f600", " ", ".", "-", "+49 30 1234567", "5", "word"]
    texts = [None, ""] + ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 15))) for _ in range(200)] + ["9" * 5000, "a" * 5000 + "@b.co"]
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans if x.base] for r in pii.personal_data(docs_of(spark, texts)).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_pii_zero_octets(spark):
    rng = random.Random(12)
    named = ["10.0.0.1", "127.0.0.1", "192.168.0.1", "0.0.0.0", "1.2.3.000", "000.00.0.0", "0255.0.0.1", "0256.0.0.1", "00000.1.1.256", "8.8.8.8"]
    octet = ["0", "00", "000", "1", "010", "0255", "256", "99"]
    texts = named + [f"at {x}, or {x}.5" for x in named] + [" ".join(".".join(rng.choice(octet) for _ in range(rng.randint(3, 9))) for _ in range(4)) for _ in range(80)]
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans if x.base] for r in pii.personal_data(docs_of(spark, texts)).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert [bool(got[i]) for i in range(len(named))] == [True] * 7 + [False, False, True]


def test_pii_checksums_and_context(spark):
    texts = ["pay to DE89 3704 0044 0532 0130 00 now", "DE88 3704 0044 0532 0130 00", "my ssn 123-45-6789", "code 123-45-6789", "mail me: a@b.cd"]
    got = [[(x.kind, x.value, round(x.score, 1)) for x in r.spans] for r in pii.personal_data(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[("iban", "DE89 3704 0044 0532 0130 00", 0.7)], [], [("ssn", "123-45-6789", 0.6)], [], [("email", "a@b.cd", 1.0)]]


def test_pii_ibans_and_what_follows(spark):
    known = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "XX46 3704 0044 0532 0130 00"]
    after = ["", " Now pay", " Please", " 12 May", ", ok", " now", "\n5"]
    texts = [f"pay {k}{a}" for k in known for a in after] + [f"pay {k}{a}" for k in known[:6] for a in (" BIC COBADEFFXXX", " 2024", " AND MORE CAPITALS 77", f" {known[0]}")]
    texts += [f"pay {known[6]} {known[0]}", "pay ZZ42 " + known[0]]
    more = ["DE89 3704 0044 0532 0130 001", "DE89 3704 0044 0532 0130 0", "DE88 3704 0044 0532 0130 00 Now", "xDE89370400440532013000", "DE89370400440532013000x"]
    rows = pii.personal_data(docs_of(spark, texts + more)).orderBy("doc_id").collect()
    got = [[(x.value, x.start) for x in r.spans if x.kind == "iban"] for r in rows]
    assert [g[0] if g else None for g in got[: len(texts) - 2]] == [(k, 4) for k in known for _ in after] + [(k, 4) for k in known[:6] for _ in range(4)]
    assert [g[-1][0] for g in got[len(texts) - 2 : len(texts)]] == [known[0]] * 2 and len(got[len(texts) - 2]) == 2
    assert got[len(texts) :] == [[]] * 5


def test_toxicity_learns_and_keeps_held_out_rows_apart(spark):
    rng = random.Random(2)
    plain = [f"n{i}" for i in range(300)]
    bad = ["foul", "nasty", "vile"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            words += rng.sample(bad, 2)
        rng.shuffle(words)
        rows.append(" ".join(words))
        labels.append((i, int(i % 5 == 0)))
    rows += [None, "", "n1 " * 20000]
    marked = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    got = toxicity.toxicity(docs, marked).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    tested = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held and r.doc_id < 900]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in got) and got[-1].predicted == 0
    flipped = marked.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit(docs, flipped) == toxicity.fit(docs, marked)
    none = toxicity.toxicity(docs_of(spark, ["a", None]), marked.limit(0)).collect()
    assert [r.predicted for r in none] == [0, 0]


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [rng.choice([-3, -1, -0.5, 0.7, 1.2, 4]) * rng.random() for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.6]

        def cost(side):
            return sum(-s if not x and s > 0 else 0 for s, x in zip(scores, side, strict=True)) * -1 + sum(-s for s, x in zip(scores, side, strict=True) if x and s < 0) + sum(w for i, j, w in edges if side[i] != side[j])

        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert abs(cost(html_extract.cut(scores, edges)) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="home">
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies. Please agree.</div>
<main><article><h1>Head &amp; title</h1><p>First <b>bold</b>text,&nbsp;and
 more of it.<p>Second &lt;p&gt; paragraph<br>goes on.</p><div class="advert">Buy now, buy here, it is cheap.</div><ul><li>Item one is here.</li><li>Item two is there.</li></ul>
<aside>Related: <a href="x">other story</a></aside><p>Last words.</p></article>
<section id="comments"><p>Nice article, I liked it a lot, thank you for it.</p></section></main>
<form><label>Mail</label><input name=a><button>Send</button></form><footer>&copy; all rights reserved</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<article><p>Cut off in the mid"), (5, "x", "<nav><a href=1>only</a></nav>"), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id, r.text) for r in html_extract.extract(pages).collect())
    want = "Head & title\nFirst boldtext, and more of it.\nSecond <p> paragraph goes on.\nItem one is here.\nItem two is there.\nLast words."
    assert got == [(1, want), (1, want), (2, ""), (3, ""), (4, "Cut off in the mid"), (5, "")]


LONG = " ".join(f"word{i}" for i in range(40)) + "."


@pytest.mark.parametrize("opened", ['<div class="layout no-sidebar">', '<div class="article-body share-enabled">', '<div id="social-page">', "<div class=widget>", "<form id=aspnet>", '<div class="sidebar-left"><div role=navigation>'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", '<main class="has-sidebar"><div class="content-sidebar"><article class="post share-enabled">{}</article></div></main>'])
def test_wrappers_do_not_silence_the_article(opened, inner):
    text = f"<p>Short one here.</p><p>{LONG}</p>"
    assert html_extract.main_text(f"<html><body>{opened}{inner.format(text)}<p>© 2020</p>") == f"Short one here.\n{LONG}"


@pytest.mark.parametrize("page", ["<article>{}<div class='share-box'>{}</div></article>", "<main>{}<section id=comments><article>{}</article></section></main>", "<main>{}</main><aside><article>{}</article></aside>", "<article>{}</article><article class=comment>{}</article>"])
def test_noise_found_inside_stays(page):
    assert html_extract.main_text(page.format("<p>The story.</p>", "<p>Not a part of it.</p>")) == "The story."


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>Head</h1><p>Sources used here.</p><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li><li><a href=c>Third</a></li></ul></article>", "Head\nSources used here.\nFirst source\nSecond source\nThird"),
        ("<main><p>Read on.</p><ol><li><a href=a>Part</a></ol></main>", "Read on.\nPart"),
        ("<article><p class='social-contract'>One text.</p><div class='related-work'>Two texts.</div><div class='related-posts'>Not this.</div><p>Three.</p></article>", "One text.\nTwo texts.\nThree."),
        ("<article><p>Text.</p><div class='ad-300x250'>Buy.</div><div class='comments-list'>Hm.</div><div id='share_buttons_2'>Tell</div></article>", "Text."),
        ("<div>One</div><div>Two words</div>", "One\nTwo words"),
        ("<div class=header>Site</div><ul><li><a href=/>Home</a></ul><div>One</div><div>Two words</div><div class='site-footer'>All rights.</div>", "One\nTwo words"),
        ("<header><h1>Site</h1></header><h1>Title of it</h1><article><p>The story.</p></article>", "Title of it\nThe story."),
        ("<div><h1>Site name</h1></div><div><article><h1>Title</h1><p>The story.</p></article></div>", "Title\nThe story."),
        ("<article><p>The story.</p></article><div class='thread'><p>Not so, as I see it, and neither does anybody else.</p></div>", "The story."),
        ("<article><p>The story.</p><div class='thread'><article><p>Not so.</p></article></div></article>", "The story."),
    ],
)
def test_article_text_is_whole(page, want):
    assert html_extract.main_text(page) == want


def test_page_cut_against_enumeration():
    """Whole pages: the labels are those of the cheapest of all labellings."""
    rng, costs = random.Random(9), html_extract.Costs()
    pieces = ["<p>Some words.</p>", "<ul><li><a href=x>Link</a><li>Item</ul>", "<nav><p>Menu</p></nav>", "<h1>Head</h1>", "<div class=ad>Buy it now.</div>", "<article><p>A story.</p><p>More</p></article>"]
    for _ in range(80):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
        found = html_extract.blocks(page)
        odds = html_extract.scores(found, costs)
        pairs = list(itertools.combinations(range(len(found)), 2))

        def weight(i, j):
            same = found[i].parent == found[j].parent
            if j == i + 1:
                return costs.next_same if same else costs.next_other
            return costs.same_parent * (same and all(b.parent != found[i].parent for b in found[i + 1 : j]))

        def cost(side):
            return sum(-s if x else s for s, x in zip(odds, side, strict=True)) / 2 + sum(weight(i, j) for i, j in pairs if side[i] != side[j])

        taken = set(html_extract.main_text(page).split("\n")) - {""}
        best = min(itertools.product([False, True], repeat=len(found)), key=cost)
        assert taken == {b.text for b, x in zip(found, best, strict=True) if x}, page


def test_empty_table_of_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, lang string")
    assert html_extract.extract(pages).collect() == []


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "noscript", "template", "iframe"])
def test_unclosed_elements_do_not_swallow_the_page(tag):
    for rest in ("", f"<{tag}>x</{tag}>", f"<!-- </{tag}> -->"):
        assert html_extract.main_text(f"<article><p>One here.</p><{tag} class=x>Label<p>Two here.</p>{rest}<p>Three.</p></article>") == "One here.\nTwo here.\nThree."
    assert html_extract.main_text(f"<article><p>One <{tag}><b>x</b><{tag}>y</{tag}><p>z</p></{tag}>more.</p><{tag} a='b'/><p>Two.</p><{tag}-x><p>Three.</p>").replace("One\nmore", "One more") == "One more.\nTwo.\nThree."
    assert html_extract.main_text(f"<article><p>One.</p><script><{tag}></script><style>x</article>") == "One."
    assert html_extract.main_text("<article>" + f"<{tag}>x<p>Some.</p>" * 4000).count("\n") == 3999


def test_long_pages_stay_linear():
    page = "<article>" + "<p>Some words stand here.</p><nav>x</nav>" * 4000 + "</article>"
    assert html_extract.main_text(page).count("\n") == 3999
    assert hashlib.sha256(html_extract.main_text("<" * 20000).encode()).hexdigest()
