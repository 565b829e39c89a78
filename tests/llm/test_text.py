"""Operators over documents against plain Python on awkward rows."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pelagia.llm import lm_score, nbsvm, packing, quality_rules, secrets, simhash, suffix_dedup, word_bpe
from pelagia.llm.queries import vocabulary
from tests.llm.data import clashing, docs, empty, prose, rows


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def low(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def fingerprint(text):
    w = low(text)
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(values, ids, linked):
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                root[top(i)] = top(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return [least.get(top(i)) for i in range(len(values))]


@pytest.mark.parametrize("table", [docs, clashing])
def test_simhash_components(spark, table):
    given = rows()
    fps = [fingerprint(r[1]) for r in given]
    want = groups(fps, [r[0] for r in given], lambda a, b: bin(a ^ b).count("1") <= 3)
    got = simhash.near_duplicates(table(spark)).collect()
    assert same([(r["id"], r["fingerprint"], r["component_id"]) for r in got],
                [(r[0], f"{f:016x}", w) for r, f, w in zip(given, fps, want)])


def test_simhash_dense_bucket_in_chunks(spark):
    random = np.random.default_rng(5)
    centre = random.integers(0, 2 ** 63, 4, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in random.choice(64, random.integers(0, 5), replace=False)) for c in centre for _ in range(60)}
    signed = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = groups(signed, signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    for bucket in (4096, 7):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, 3, bucket)).collect()}
        assert [found.get(f, f) for f in signed] == want


def test_simhash_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.similar_texts(empty(spark)).count() == 0


def test_similar_texts_verifies(spark):
    base = prose(1, 200)
    words = base.split()
    words[50], words[120] = "changed", "words"
    table = spark.createDataFrame([(4, base), (7, " ".join(words)), (9, prose(2, 200)), (11, base), (12, None), (15, "")], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_texts(table).collect()}
    assert got == {4: 4, 7: 4, 9: 9, 11: 4, 12: 12, 15: 12}


def run_set(text):
    w = low(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Isolated near copies of all lengths, most of them near the limit, a family and a passage in many texts."""
    random = np.random.default_rng(8)
    passage, out = prose(400, 40), []
    for k in range(60):
        words = prose(1000 + k, int(random.integers(12, 260))).split()
        out.append(" ".join(words))
        for _ in range(int(random.integers(0, 5 if k % 10 else 40))):
            copy = list(words)
            for at in random.choice(len(words), max(1, len(words) // int(random.integers(40, 70))), replace=False):
                copy[at] = f"new{random.integers(1 << 30)}"
            out.append(" ".join(copy))
    out += [f"{passage} {prose(3000 + k, 9 + k % 4)}" for k in range(40)]
    return out


def test_similar_texts_computes_parts_again_only_after_new_links(spark, monkeypatch):
    calls, parts = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda *a: calls.append(1) or parts(*a))
    base = prose(7, 80)
    table = spark.createDataFrame([(1, base), (2, base + " and more"), (3, prose(8, 80))], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_texts(table).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and len(calls) == 1


def test_similar_texts_finds_all_pairs(spark, monkeypatch):
    texts = planted()
    want = groups([run_set(t) for t in texts], list(range(len(texts))), lambda a, b: jaccard(a, b) >= 0.8)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bucket, few in ((1024, 500_000), (7, 0)):
        monkeypatch.setattr(simhash, "FEW", few)
        got = {r["id"]: r["component_id"] for r in simhash.similar_texts(table, bucket=bucket, reach=512 if few else 1).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_similar_texts_in_a_family_of_templates(spark):
    random = np.random.default_rng(11)
    base, texts = prose(700, 160).split(), []
    for k in range(60):  # most pairs are not similar, some are
        words = list(base)
        for at in random.choice(len(base), int(random.integers(1, 7)), replace=False):
            words[at] = f"w{k}x{at}"
        texts.append(" ".join(words))
    want = groups([run_set(t) for t in texts], list(range(len(texts))), lambda a, b: jaccard(a, b) >= 0.8)
    assert len(set(want)) > 1
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_texts(table, bucket=9).collect()}
    assert [got[i] for i in range(len(texts))] == want


def counts(text):
    text = text or ""
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    tri = Counter(zip(ws, ws[1:], ws[2:]))
    cover = {i + k for i in range(len(ws) - 2) if tri[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("table", [docs, clashing])
def test_rule_counts(spark, table):
    source = table(spark).drop("stats") if table is clashing else table(spark)
    judged = quality_rules.rule_stats(source)
    got = quality_rules.judge(judged, quality_rules.learn(judged)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(r[0], *counts(r[1])) for r in rows()]
    assert same([(r["doc_id"], *(r["stats"][n] for n in names)) for r in got], want)
    for r in got:
        n, again = r["stats"]["n_words"], r["stats"]["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_votes_find_the_poor(spark):
    good = [(i, prose(i, 150), 1) for i in range(60)]
    poor = [(100 + i, " ".join(w + "###" for w in prose(i, 150).split()), 0) for i in range(12)]
    judged = quality_rules.rule_stats(spark.createDataFrame(good + poor, "doc_id long, text string, truth int"))
    got = quality_rules.judge(judged, quality_rules.learn(judged)).collect()
    assert all(r["kept"] == (r["truth"] == 1) for r in got)
    nothing = quality_rules.rule_stats(empty(spark))
    assert quality_rules.judge(nothing, quality_rules.learn(nothing)).count() == 0


def test_votes_model_by_hand():
    model = quality_rules.fit_votes([((-1, 1), 10), ((0, 1), 90)], ("a", "word_length"), rounds=200)
    assert model.weights[0] > 0 and model.prior > 0
    assert quality_rules.fit_votes([], ("a",)).weights == (2.0,)


def repeats(given, width):
    key = lambda d: math.inf if d is None else d
    first = {}
    for d, t in given:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            k = b[i:i + width]
            first[k] = min(first.get(k, math.inf), key(d))
    out = []
    for d, t in given:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] < key(d):
                gone[i:i + width] = b"\1" * width
        starts = [i for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])]
        out.append((d, len(b), starts, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("chunk_bytes", [10_000_000, 3_000])
def test_repeated_passages(spark, chunk_bytes):
    given = [(r[0], r[1]) for r in rows()]
    got = suffix_dedup.remove_repeats(clashing(spark), 50, chunk_bytes=chunk_bytes, range_bytes=5_000).collect()
    assert same([(r["id"], r["n_bytes"], r["starts"], bytes(r["kept"])) for r in got], repeats(given, 50))


@pytest.mark.parametrize("chunk_bytes", [10_000_000, 900, 100])
def test_repeated_ids_with_other_texts(spark, chunk_bytes):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    given = [(1, a), (2, a), (2, b), (2, b), (2, c + a[:90]), (3, c), (4, b + a), (None, c), (None, prose(5, 40)), (None, prose(5, 40))] + [(6, prose(20 + k, 30)) for k in range(12)]
    given += [(7, prose(25, 30)), (8, prose(31, 90))]
    table = spark.createDataFrame(given, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(table, 50, chunk_bytes=chunk_bytes, range_bytes=2_000).collect()
    assert same([(r["id"], r["n_bytes"], r["starts"], bytes(r["kept"])) for r in got], repeats(given, 50))


@pytest.mark.parametrize("length", [25, 50])
def test_every_place_counts_in_a_rank(length):
    """Ranks are sums over places before spreading; no place's factor may lose many of the 64 bits."""
    def summed(byte_ranks):
        now, size, step = byte_ranks, 1, 0
        while 2 * size <= length:
            now, size, step = suffix_dedup._pair(now[:-size], now[size:], step), 2 * size, step + 1
        return suffix_dedup._pair(now[:-(length - size)], now[length - size:], 7)[0]

    factors = []
    for k in range(length):
        one = np.zeros(length, dtype=np.uint64)
        one[k] = 1
        factors.append(int(summed(one)))
    assert len(set(factors)) == length
    low = lambda x: (x & -x).bit_length() - 1
    assert all(f and low(f) <= 8 for f in factors)
    assert all(low(abs(a - b)) <= 12 for i, a in enumerate(factors) for b in factors[:i])


def peak(run) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", [1, 2])
def test_answers_hold_few_bytes_a_rank(kind, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 250_000)
    r = np.random.default_rng(3)
    lists = [np.unique(r.integers(0, 1 << 20, 200_000).astype(np.uint64) << np.uint64(40)) for _ in range(6)]
    orders = [0, 1, 1, 2, 4, 9]
    frame = pd.DataFrame({"chunk": range(6), "order": orders, "range": 0, "data": [lm_score.planes(np.diff(x, prepend=np.uint64(0))) for x in lists]})
    got, most = peak(lambda: suffix_dedup._answer(frame, kind))
    first, times = {}, Counter()
    for x, order in zip(lists, orders):
        times.update(x.tolist())
        for v in x.tolist():
            first.setdefault(v, order)
    for x, order, data in zip(lists, orders, got.sort_values("chunk")["data"]):
        told = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=len(x))
        assert told.tolist() == [times[v] > 1 if kind == 1 else first[v] < order for v in x.tolist()]
    assert most < 30 * sum(map(len, lists))


def test_a_chunk_of_near_copies_holds_few_bytes_a_place():
    r = np.random.default_rng(4)
    passage = r.integers(32, 127, 2_000).astype(np.uint8).tobytes()
    texts = [passage + r.integers(32, 127, 2_000).astype(np.uint8).tobytes() for _ in range(400)]
    frame = pd.DataFrame({"id": range(400), "text": texts, "none": False, "also": None, "digest": [str(k) for k in range(400)]})

    def run():
        chunk = suffix_dedup.Chunk(frame, set(), 50)
        runs = chunk.marks()
        known = np.sort(np.concatenate([v for v, _ in runs]))
        starts, every = chunk.candidates(np.ones(len(known), dtype=bool), known, runs)
        windows = suffix_dedup._sort_out(every.copy())
        return suffix_dedup._remaining(chunk, starts, every, windows, np.zeros(len(windows), dtype=bool))

    out, most = peak(run)
    assert out["kept"].iloc[0] == texts[0] and all(t[2_000:].endswith(k) and len(k) > 1_990 for k, t in zip(out["kept"].iloc[1:], texts[1:]))
    assert most < 40 * sum(map(len, texts))


def test_repeated_passages_as_text(spark):
    got = suffix_dedup.remove_repeats(docs(spark), carry=("lang", "n_chars"), as_text=True).collect()
    by = Counter((r["lang"], r["kept"] is None) for r in got)
    assert by[("en", True)] == 1 and by[(None, True)] == 1 and len(got) == len(rows())
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk_chars", [10_000_000, 4_000])
def test_language_model(spark, chunk_chars):
    given = rows()
    held = [r[0] is not None and r[0] % 4 == 2 for r in given]
    tokens = [low(r[1]) + [None] for r in given]
    one, two, starts = Counter(), Counter(), 0
    for t, h in zip(tokens, held):
        if not h:
            one.update(t)
            two.update(zip(["<s>", *t], t))
            starts += 1
    n, v = sum(one.values()), len(one)
    d = (sum(c == 1 for c in one.values()) + 0.5) / (v + 1)
    values = np.array(list(one.values()), dtype=float)
    m = lm_score.mass_given_away(values, np.ones(len(values)), sum(c == 1 for c in two.values()))
    p1 = lambda w: (one[w] - d) / n if one[w] else d * v / n
    assert sum(p1(w) for w in one) + p1("never") == pytest.approx(1.0)
    want = []
    for r, t, h in zip(given, tokens, held):
        score, before = 0.0, "<s>"
        for w in t:
            c = starts if before == "<s>" else one[before]
            score += math.log10((two[before, w] + m * p1(w)) / (c + m) if c else p1(w))
            before = w
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        want.append((r[0], h, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    found = lm_score.scores(clashing(spark), F.col("doc_id") % 4 == 2, chunk_chars=chunk_chars, range_tokens=500).collect()
    assert same([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in found], want)


def test_language_model_without_training(spark):
    assert {r["score"] for r in lm_score.scores(docs(spark), F.lit(True)).collect()} == {0.0}
    assert lm_score.scores(empty(spark), F.lit(False)).count() == 0


def test_classifier(spark):
    texts = [(i, prose(i, 80) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(240)]
    table = spark.createDataFrame([*texts, (None, "x"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 5) for i, _ in texts] + [(900, None, 5), (None, 1, 5)], "doc_id long, quality int, text int")
    got = nbsvm.quality_scores(table, labels, F.col("doc_id") % 2 == 1).collect()
    assert len(got) == 243 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == int(r["id"] % 3 > 0) for r in got if r["id"] is not None and r["id"] < 240 and r["id"] % 2]
    assert np.mean(right) > 0.95
    assert len({r["score"] for r in got if r["id"] in (900, 901)}) == 1
    one_class = nbsvm.quality_scores(table, labels.filter("quality = 1"), F.lit(False)).collect()
    assert all(r["predicted"] == 1 for r in one_class)
    assert nbsvm.quality_scores(empty(spark), labels, F.lit(False)).count() == 0


@pytest.mark.parametrize("table", [docs, clashing])
def test_packing(spark, table):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    reader = Tokenizer.from_file(path)
    got = packing.best_fit_packing(table(spark), path, size=64).collect()
    want = []
    for r in rows():
        ids = np.array([*reader.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at, size, k = 0, len(ids) % 64 or 64, 0
        while at < len(ids):
            want.append((r[0], k, at, size, zlib.crc32(ids[at:at + size].tobytes())))
            at, size, k = at + size, 64, k + 1
    assert same([tuple(r)[:5] for r in got], want)
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(placed) <= math.ceil(sum(w[3] for w in want) / 64) + 2
    assert packing.best_fit_packing(empty(spark), path).count() == 0


def test_best_fit_finds_the_tightest():
    lengths = np.random.default_rng(3).integers(1, 100, 400)
    where, offset = packing.best_fit(lengths, 100)
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(100 - lengths[i])
    assert sorted(100 - np.bincount(where, weights=lengths)) == sorted(room) and len(want) == 0


def test_special_tokens_and_white_space_in_byte_bpe():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    reader, mine = Tokenizer.from_file(path), packing.ByteBpe(path)
    texts = ["a<|endoftext|>b", "two  blanks", " lead", "trail ", "a\n\nb", "it's we'll", "x\xa0y", "\n", "", "a\x1cb c", "é ñ\n日本 🙂", "word\nnext 'tis"]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_batch(texts)] == [reader.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_bpe(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    reader = Tokenizer.from_file(path)
    got = word_bpe.decode(word_bpe.encode(clashing(spark), path), path).collect()
    want = []
    for r in rows():
        ids = reader.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], ids, reader.decode(ids, skip_special_tokens=False)))
    assert same([(r["id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["text"]) for r in got], want)
    assert word_bpe.encode(empty(spark), path).count() == 0


def test_word_bpe_guesses_are_checked():
    """Whatever the guess, compatible neighbours are what merging gives; failing words are repaired."""
    bpe = word_bpe.load(vocabulary("word_bpe_49k.json"))
    words = sorted({w.strip(".,\n") for i in range(40) for w in prose(i, 50).split()} | {"thththth", "ererer", "aaaaaaa", "x", "strengths"})
    assert bpe.encode_words(words) == [bpe.exact(w) for w in words]
    special = ["a<|endoftext|>b", "<|startoftext|>", "ΣΑΣ İ", "a\x1cb", "it's 42 we'll!!", "\x85x"]
    from tokenizers import Tokenizer
    reader = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(special)] == [reader.encode(t, add_special_tokens=False).ids for t in special]


def test_word_bpe_of_very_long_words():
    import time

    bpe, random = word_bpe.load(vocabulary("word_bpe_49k.json")), np.random.default_rng(6)

    def plain(word):
        ids = [bpe.vocab[c] for c in word[:-1]] + [bpe.vocab[word[-1] + bpe.end]]
        while True:
            ranks = [bpe.ranks.get(x * len(bpe.names) + y, 1 << 40) for x, y in zip(ids, ids[1:])]
            least = min(ranks, default=1 << 40)
            if least == 1 << 40:
                return ids
            i = ranks.index(least)
            ids[i:i + 2] = [bpe.made[least]]

    for size in (1, 2, 3, 40, 400):
        for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(random.choice(list(letters), size))
            assert bpe.exact(word) == plain(word)
    start = time.time()
    word = "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 200_000))
    assert len(bpe.exact(word)) < 200_000 and len(bpe.exact("a" * 200_000)) < 200_000
    assert time.time() - start < 20


def test_secrets(spark):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [f"{prose(i, 30)} token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" {prose(i + 50, 20)}" for i in range(40)]
    texts += [f"{prose(i, 30)} " + "".join(prose(i + 7, 4).replace(".", "").replace(",", "").split()) + f" {1000200030004000 + i} {prose(i, 5)}" for i in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, f"password={key} end")], "doc_id long, text string")
    forest = secrets.learn(table)
    got = {(r["doc_id"], s["candidate"]) for r in secrets.scan(table, forest).collect() for s in r["secrets"]}
    assert got == {(i, hashlib.sha1(bytes([i])).hexdigest()) for i in range(40)} | {(None, key)}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(table, forest).collect()}
    assert clean[900] is None and clean[901] == "" and clean[None] == "password=[SECRET] end"
    assert clean[3] == texts[3].replace(hashlib.sha1(bytes([3])).hexdigest(), secrets.REPLACEMENT) and clean[45] == texts[45]
    untaught = secrets.learn(empty(spark))
    assert all(not r["secrets"] for r in secrets.scan(table, untaught).collect())
    assert secrets.scan(clashing(spark), forest).count() == len(rows())
    assert secrets.scan(empty(spark), forest).count() == 0 and secrets.redact(empty(spark), forest).count() == 0


def test_near_dedup_keeps_every_text_of_a_repeated_id(spark):
    import corpus_pipeline

    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    table = spark.createDataFrame([(1, a), (5, a), (5, c), (7, b), (7, b), (8, c), (None, c), (9, None), (9, "")], "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(1 AS BIGINT) AS n_chars")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, table, "").select("doc_id", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, a), (5, c), (7, b), (None, c), (9, None)])) or (9, "") in got and len(got) == 5


def test_turns_of_all_rounds_cover_all_pairs():
    r = np.random.default_rng(4)
    n = 90
    texts = {"node": r.integers(-2**62, 2**62, n), "n": r.integers(90, 110, n), "pos": np.zeros(n, np.int64), "root": np.arange(n) % 30, "side": np.arange(n) % 2}
    runs = [r.integers(0, 2**63, size=k).astype(np.uint64) for k in texts["n"]]
    for k in range(0, n, 3):
        runs[k] = np.concatenate([runs[0][:80], runs[k][80:]])
    sketches = [simhash.parity(np.unique(x), simhash.SLOTS * (1 + i % 2)) for i, x in enumerate(runs)]
    for two in (False, True):
        got, low, high, more = [], 0, 4, True
        while more:
            x, y, more = simhash.near_pairs(texts, sketches, two, n, 0.8, low, high)
            got += list(zip(x.tolist(), y.tolist()))
            low, high = high, 4 * high
        whole = simhash.near_pairs(texts, sketches, two, n, 0.8, 0, n)
        assert sorted(got) == sorted(zip(whole[0].tolist(), whole[1].tolist())) and len(set(got)) == len(got)
        node = {int(v): k for k, v in enumerate(texts["node"])}
        found = {tuple(sorted((node[a], node[b]))) for a, b in got}
        for i in range(n):
            for j in range(i):
                shared = len(np.intersect1d(runs[i], runs[j]))
                if shared >= 0.8 * (len(runs[i]) + len(runs[j]) - shared) and texts["root"][i] != texts["root"][j] and not (two and texts["side"][i] == texts["side"][j]):
                    assert (j, i) in found
