"""The registered queries of the dealt operators and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import (bag_search, hnsw, html_text, lm_score, nbsvm, packing, quality_rules, secrets, simhash, suffix_dedup, url_filters, word_bpe,
                         word_runs)
from pelagia.llm.common import cut_lineage, doc_text, table, words
from pelagia.llm.quality_rules import let
from pelagia.llm.quality_sql import checking_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


@query("op3_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, three-word shingles, three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.withColumnRenamed("id", "doc_id")


@query("op8_quality_rules", checking_sql())
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the weighed rules keep it."""
    counted = quality_rules.rule_stats(table(spark, sf_dir, "documents")).select("doc_id", "stats")
    counted = cut_lineage(counted)
    judged = quality_rules.judge(counted, quality_rules.learn(counted))
    return judged.select("doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines",
                         "stats.n_repeat_words", "base_failed", "kept", "posterior")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the decoded text."""
    path = vocabulary("word_bpe_49k.json")
    done = word_bpe.decode(word_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return done.select(F.col("id").alias("doc_id"), F.floor(F.length("ids") / 4).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048."""
    packed = packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def fold(parts: int) -> Column:
    """crc32 of the document id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op2_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model learnt from six sevenths of them."""
    found = lm_score.scores(table(spark, sf_dir, "documents"), fold(7) == 2)
    return found.withColumnRenamed("id", "doc_id")


@query("op4_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from two thirds of the labelled ones."""
    found = nbsvm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) == 1)
    return found.withColumnRenamed("id", "doc_id")


@query("op1_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in all documents that the forest takes for a secret."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs.select("doc_id", "text"), secrets.learn(docs))
    return found.select("doc_id", F.explode("secrets").alias("s")).select(
        "doc_id", F.col("s.k").alias("finding"), F.col("s.candidate").alias("candidate"), F.length("s.candidate").cast("long").alias("length"),
        F.col("s.share").alias("share"))


@query("op10_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
w(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
k AS (SELECT a, min(b) AS b FROM w GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(k.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(k.b, vec_id)) AS kept
FROM v LEFT JOIN k ON k.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.93 or more within its label."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


@query("op9_suffix_array_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(length(h) // 2)) AS pos, unnest(string_split_regex(regexp_replace(h, '(..)', '\\1 ', 'g'), ' ')[1:length(h) // 2]) AS b, unnest(list_transform(range(length(h) // 2), lambda i: CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END)) AS w FROM d),
g AS (SELECT *, w IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY w) AS gone FROM p),
c AS (SELECT doc_id, pos, b, coalesce(bool_or(gone) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS cut FROM g),
r AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM c)
SELECT d.doc_id, CAST(length(any_value(h)) // 2 AS BIGINT) AS n_bytes, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE cut AND NOT before) AS n_spans,
       sha256(unhex(coalesce(string_agg(b, '' ORDER BY pos) FILTER (WHERE NOT cut), ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of earlier documents."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def with_period(text: Column) -> Column:
    """The text, of one row in ten with its words from some place on repeated with some period (both from the id's crc32)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(
            F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))

    return F.when(h % 10 == 0, let(words(doc_text("text")), of)).otherwise(text)


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of them made periodic first, and what is left without the repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_period(F.col("text")).alias("text"))
    found = word_runs.word_runs(docs)
    longer = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)  # noqa: E731  ties: the first
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("kept", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


#: Address rules of the URL query (fixed by the task).
URL_RULES = [url_filters.Rule("block", "net/"), url_filters.Rule("allow", "example.net/en/"), url_filters.Rule("block", "example.com/de/"), url_filters.Rule("allow", "org/fr/")]


@query("op12_url_filters")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL; trees learnt from the URLs that host words or rules label."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filters.train(pages.select("url", url_filters.topic_label(F.col("url"), URL_RULES).alias("label")))
    return url_filters.judge(pages, URL_RULES, model).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


@query("op13_ranked_search", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
k AS (SELECT row_number() OVER () AS r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
a AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM k),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
f AS (SELECT r, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM k) SEMI JOIN q USING (t) GROUP BY r, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a GROUP BY t),
p AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) AS s FROM f JOIN w USING (t), a),
s AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN p USING (t) GROUP BY item_id, r, doc_id HAVING sum(s) > 0),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT * FROM o WHERE rank <= 20""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    found = bag_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
