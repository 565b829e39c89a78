"""Periodic runs, URL filters and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import bag_search, queries, url_filters, word_runs
from tests.llm.data import clashing, docs, empty, prose, rows

SPACE = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 5)):
            w = []
            while r.random() < 0.85 and len(w) < 120:
                w += ([r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(1, 7))] * r.randint(1, 9))[:r.randint(1, 60)]
            texts.append(w * r.randint(1, 3))
        texts.append(list(texts[0]))
        word, cuts = np.array([x for t in texts for x in t], dtype=np.int64), np.cumsum([0, *map(len, texts)]).tolist()
        s, e, p = word_runs.runs(word, np.repeat(np.arange(len(texts)), np.diff(cuts)))
        assert list(zip(s.tolist(), (e - s).tolist(), p.tolist())) == [(a + c, n, q) for t, c in zip(texts, cuts) for a, n, q in brute_runs(t)]


def test_long_runs_are_quick():
    for word in (np.zeros(300_000, dtype=np.int64), np.arange(300_000) % 11):
        s, e, p = word_runs.runs(word, np.zeros(len(word), dtype=np.int64))
        assert (s.tolist(), e.tolist(), p.tolist()) == ([0], [300_000], [int(word.max()) + 1])


def test_a_lying_hash_is_noticed(monkeypatch):
    honest = word_runs.Hashes.same
    monkeypatch.setattr(word_runs.Hashes, "same", lambda self, i, q, n: honest(self, i, q, n) | self.lies)
    monkeypatch.setattr(word_runs.Hashes, "__init__", (lambda init: lambda self, word, seed: (init(self, word, seed), setattr(self, "lies", seed == 0))[0])(word_runs.Hashes.__init__))
    w = [5, 1, 2, 1, 2, 1, 2, 1, 2, 9, 4, 1, 1, 1, 1, 1, 1, 7]
    s, e, p = word_runs.runs(np.array(w), np.zeros(len(w), dtype=np.int64))
    assert list(zip(s.tolist(), (e - s).tolist(), p.tolist())) == brute_runs(w)


def test_runs_of_awkward_rows(spark):
    got = word_runs.word_runs(docs(spark)).collect()
    want = []
    for doc_id, text, *_ in rows():
        w = SPACE.findall(text or "")
        found = brute_runs(w[:700]) if len(w) < 700 else []
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((doc_id, len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(repr, want)) == sorted(repr((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"])) for r in got)
    assert word_runs.word_runs(clashing(spark)).count() == len(rows())
    assert word_runs.word_runs(empty(spark)).count() == 0


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_run_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    table = [(i, " ".join(r.choices("a b c d e f g h".split(), k=r.randint(0, 90))), None, None, None) for i in range(150)] + [(200, None, None, None, None), (201, "", None, None, None)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text, *_ in table:
        w = planted(doc_id, SPACE.findall(text or ""))
        found = brute_runs(w)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else None
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(x[1] > 0 for x in want) >= 8


RULES = queries.URL_RULES


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.text.split("/")[0] or host.endswith("." + r.text.split("/")[0])) and path.startswith("/" + r.text.split("/", 1)[1])]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


ODD = [None, "", "example.net/en/", "http://", "http://NET", "http://net/", "HTTP://A.NET/x?y://z", "http://example.net/en", "http://example.net/en/?a", "http://x.Example.Net/en/1",
       "http://xexample.net/en/1", "http://example.net.org/fr/1", "http://org/fr/", "http://a.org/fr#/", "https://example.com/de/a?b=1&c=2#d", "http://example.com#/de/", "a://b://c.net/d",
       "http://net:80/", "http://ÄÖ.net/ü", "http://a\n.net/\nb", "http://" + "a" * 5000 + ".net/" + "b/" * 5000]


def test_rules_against_brute_force(spark):
    frame = spark.createDataFrame([(i, u, "x", 1, 2) for i, u in enumerate(ODD + ODD[:3])], "page_id int, url string, at string, row int, slot1 int")
    got = url_filters.judge(frame, RULES, url_filters.UrlTrees((), (), 0.0, None)).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        host, path, rule, verdict = brute_url(r["url"])
        assert (r["judged"]["host"], r["judged"]["path"], r["judged"]["rule"], r["judged"]["verdict"]) == (host, path, rule, verdict or "allow"), r["url"]
        assert (r["at"], r["row"], r["slot1"]) == ("x", 1, 2)


def urls(seed=1, n=600):
    r = random.Random(seed)
    hosts = [f"{''.join(r.choices('aeiouthrn', k=r.randint(5, 9)))}.{r.choice(['com', 'org', 'net'])}" for _ in range(40)]
    bad = [f"{w}-{x}{r.randint(1, 99)}.{r.choice(['com', 'org'])}" for w in ("casino", "pills", "adult") for x in ("win", "now", "best", "top")]
    return [(i, f"https://{r.choice(bad if i % 5 == 0 else hosts)}/en/{i}") for i in range(n)]


def test_unseen_words_are_caught_by_form(spark):
    table = spark.createDataFrame([*urls(), (None, None)], "page_id int, url string")
    words = ("casino", "adult")  # the third word is never labelled
    labelled = table.filter(~F.coalesce(F.col("url"), F.lit("")).contains("pills")).select("url", url_filters.topic_label(F.col("url"), [], words).alias("label"))
    model = url_filters.train(labelled)
    got = url_filters.judge(table.withColumn("judged", F.lit(1)), [], model).filter("url is not null")
    share = {r["bad"]: r["share"] for r in got.groupBy(F.col("url").contains("-").alias("bad")).agg(F.avg((F.col("judged.verdict") == "block").cast("int")).alias("share")).collect()}
    assert share[True] > 0.95 and share[False] < 0.05
    pills = got.filter(F.col("url").contains("pills")).agg(F.avg((F.col("judged.verdict") == "block").cast("int"))).first()[0]
    assert pills > 0.9
    assert url_filters.judge(table.limit(0), RULES, model).count() == 0
    plan = url_filters.judge(table, RULES, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_urls_of_one_class_or_none(spark):
    table = spark.createDataFrame([(1, "http://a.com/b"), (2, None)], "page_id int, url string")
    for labels in (table.select("url", F.lit(1).alias("label")), table.select("url", F.lit(None).cast("int").alias("label")), table.limit(0).select("url", F.lit(1).alias("label"))):
        got = url_filters.judge(table, RULES, url_filters.train(labels)).collect()
        assert [r["judged"]["verdict"] for r in got] == ["allow", "allow"]


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def brute_search(documents, items, top):
    cut = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, cut(t)) for i, t in documents]
    bags = [(i, len(t), Counter(t)) for i, t in bags if t]
    n, total = len(bags), sum(b[1] for b in bags)
    df = Counter(t for _, _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, size, bag in bags:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in cut(text) if bag[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_search_against_brute_force(spark, block):
    given = [(r[0], r[1]) for r in rows()] + [(1000 + i, prose(7, 40)) for i in range(30)] + [(900 - i, prose(50 + i % 9, 30) + " Reef" * (i % 4)) for i in range(60)]
    items = [(1, "tide and the Reef, reef!"), (2, None), (3, ""), (4, "none of zzz"), (5, prose(99, 300)), (5, "日本語 Ünïcode"), (6, "wind"), (None, "crew net crew"), (8, "K ſ")]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in given], "doc_id long, text string, item string, m int")
    asked = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, score string")
    got = [tuple(r) for r in bag_search.ranked(frame, asked, top=7, block=block).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_search(given, items, 7)))
    if block == 3:
        assert bag_search.ranked(frame.limit(0), asked).count() == 0
        assert bag_search.ranked(frame, asked.limit(0)).count() == 0


def test_many_products_are_cut(spark, monkeypatch):
    monkeypatch.setattr(bag_search, "PRODUCTS", 5)
    items = bag_search.Items([(k, {0: 1, 1: k + 1}) for k in range(4)], 3, np.array([3, 2, 1]))
    owner, term, tf = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 0]), np.array([1, 2, 3, 4, 5])
    m = np.array([75, 80, 90])
    part = lambda t, k: 1_000_000_000 * t // (1000 * t + 12 * m[k])
    want = [[3 * part(1, 0) + 2 * (k + 1) * part(2, 0) for k in range(4)], [2 * (k + 1) * part(3, 1) for k in range(4)], [3 * part(5, 2)] * 4]
    assert items.scores(m, owner, term, tf).tolist() == want
