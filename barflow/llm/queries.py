"""Registered queries of the operators in this folder, with SQL where SQL can state the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import exact_dedup as exact
from barflow.llm import collocations, decontamination, html_extract, mixing, packing, pii, substring_dedup, token_counts, toxicity, url_filter, whitening
from barflow.llm import ngram_join as ngram
from barflow.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op5_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g ON d.t = g.t
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_ngram_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.ngram_join(table(spark, sf_dir, "documents"))


_OP1_SQL = r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    b AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
    starts AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS t FROM starts),
    lens AS (SELECT DISTINCT k FROM win),
    dat AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k),
    occ AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM dat),
    m AS (SELECT doc_id, occ.i, occ.k, item_id FROM occ JOIN win ON occ.k = win.k AND occ.t = win.t),
    pos AS (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM pos GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@query("op1_decontamination", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    named = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    of_kind = lambda k: F.filter("spans", lambda x: x["base"] & (x["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


@query(
    "op9_html_extraction",
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS t FROM pages),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(h1|p)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(t, '&amp([^;]|$)', '&\1', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, url, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM c)
    SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars FROM d
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _op2_sql(rules: tuple[url_filter.Rule, ...], p: url_filter.Walk) -> str:
    listed = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    d = p.damping
    walks = [f"r0 AS (SELECT host, {1 - d} * t0 AS t, {1 - d} * d0 AS d FROM seed)"]
    for i in range(p.passes):
        walks.append(f"g{i + 1} AS (SELECT s.dst AS host, {d} * sum(s.t * r.t) AS t, {d} * sum(s.d * r.d) AS d FROM step s JOIN r{i} r ON s.src = r.host GROUP BY s.dst)")
        walks.append(f"r{i + 1} AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT * FROM g{i + 1} UNION ALL SELECT * FROM r0) GROUP BY host)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH rules(verdict, rhost, rpath) AS (VALUES {listed}),
    p AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    fit AS (SELECT host, path, arg_max(verdict, length(rhost || rpath)) AS ruled, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
            FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
    j AS (SELECT p.*, rule, ruled FROM p LEFT JOIN fit USING (host, path)),
    ref AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) AS ref FROM p),
    link AS (SELECT src, translate(regexp_extract(regexp_replace(ref, '^//', 'any://'), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS dst
             FROM ref WHERE regexp_matches(ref, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//')),
    e AS (SELECT src, dst, count(*) AS w FROM link WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
    step AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS t, 0.0 AS d FROM e UNION ALL SELECT dst, src, 0.0, w / sum(w) OVER (PARTITION BY dst) FROM e),
    c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM j WHERE host <> '' AND ruled IS NOT NULL GROUP BY host),
    seed AS (SELECT host, coalesce(good / nullif(sum(good) OVER (), 0), 0) AS t0, coalesce(bad / nullif(sum(bad) OVER (), 0), 0) AS d0 FROM c),
    {", ".join(walks)}
    SELECT j.page_id, j.host, path, rule, coalesce(ruled, CASE WHEN g.d > 0 AND g.d / (g.t + g.d) > {p.threshold} THEN 'block' END, 'allow') AS verdict
    FROM j LEFT JOIN g{p.passes} g ON j.host = g.host
    """


@query("op2_url_filter", _op2_sql(url_filter.RULES, url_filter.Walk()))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


#: Vocabulary files, the same on every machine.
TOKENIZERS = "/opt/tokenizers"


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Three batches: all documents; other languages than English again by a tokenizer for many languages; toxic ones out."""
    docs = table(spark, sf_dir, "documents")
    one, many = "byte_bpe_50k", "byte_bpe_multi_50k"
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    first = token_counts.count_tokens(docs, f"{folder}/{one}.tiktoken").select(F.lit("insert").alias("op"), "*", F.lit(one).alias("version"))
    rollup.apply("0", first)
    other = docs.filter("lang <> 'en'")
    counted = token_counts.count_tokens(other, f"{folder}/{many}.tiktoken").select(F.lit("insert").alias("op"), "*", F.lit(many).alias("version"))
    moved = other.select(F.lit("delete").alias("op"), F.col("doc_id"), F.lit(one).alias("version"))
    rollup.apply("1", counted.unionByName(moved, allowMissingColumns=True))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    gone = toxic.select(F.lit("delete").alias("op"), "doc_id", F.explode(F.array(F.lit(one), F.lit(many))).alias("version"))
    rollup.apply("2", gone)
    rollup.apply("2", gone)  # replayed: changes nothing
    return rollup.totals()


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_OP12_SQL = r"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?
-
]')), '[^ 	]+') AS w FROM t),
    tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
    ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
    occ AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, ks WHERE len(w) >= k),
    f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM occ GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    cut AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS j FROM c),
    parts AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y FROM cut),
    sc AS (SELECT q.lang, q.phrase, q.a, j, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * q.a) // (CAST(l.a AS HUGEINT) + r.a) AS score
           FROM parts q JOIN f l ON q.lang = l.lang AND q.x = l.phrase JOIN f r ON q.lang = r.lang AND q.y = r.phrase),
    low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    spans AS (SELECT b AS beg, e AS fin FROM (SELECT unnest([1, 2, 3]) AS b), (SELECT unnest([2, 3, 4]) AS e) WHERE e > b),
    sub AS (SELECT lang, array_to_string(w[beg : fin], ' ') AS phrase, max(a) AS longest FROM c, spans WHERE fin <= k AND fin - beg + 1 < k GROUP BY ALL),
    kept AS (SELECT low.* FROM low LEFT JOIN sub ON low.lang = sub.lang AND low.phrase = sub.phrase WHERE NOT coalesce(CAST(100 AS HUGEINT) * longest >= CAST(80 AS HUGEINT) * a, false)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("doc_id")


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
