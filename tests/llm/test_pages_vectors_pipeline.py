"""Pages, vectors, components and the pipeline."""

import os

import numpy as np
import pytest

from pelagia.llm import boosting, graph, hnsw, html_text
from tests.llm.data import docs, empty, prose, rows


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("edges", "rounds"), [([(100, 100 + i) for i in range(1, 30)], 1), ([(9, 3), (9, 5), (4, 2)], 1), ([(1, 2), (2, 3), (3, 4), (4, 5)], 2)])
def test_components_end_without_a_round_that_changes_nothing(spark, monkeypatch, edges, rounds):
    steps, step = [], graph._toward_least
    monkeypatch.setattr(graph, "_toward_least", lambda now, both: steps.append(both) or step(now, both))
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {n for e in edges for n in e} and all(got[a] == got[b] <= min(a, b) for a, b in edges)
    assert steps.count(True) <= rounds


def vectors():
    random = np.random.default_rng(2)
    centre = random.normal(size=(6, 16))
    out = []
    for i in range(300):
        c = centre[i % 6]
        out.append([float(x) for x in np.float32(c + random.normal(size=16) * random.choice([0.05, 0.2, 0.6]))])
    table = [(i, v, i % 6 // 3) for i, v in enumerate(out)]
    table += [(400 + i, out[5], 1) for i in range(40)]  # exact copies
    table += [(500, None, 1), (501, out[0], None), (502, [0.0] * 16, 0), (503, [float("nan")] * 16, 0), (504, [None] * 16, 0), (505, [], 0), (506, out[0][:4], 0)]
    table += [(3, out[3], 1), (None, out[0], 0)]
    return table


def test_vectors_against_all_pairs(spark):
    table = vectors()
    good = [k for k, (i, v, lab) in enumerate(table) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = dict.fromkeys(range(len(table)), 0)
    root = {k: k for k in range(len(table))}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and table[a][2] == table[b][2] and len(table[a][1]) == len(table[b][1]):
                x, y = np.array(table[a][1]), np.array(table[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    root[top(a)] = top(b)
    least = {}
    for k in good:
        least[top(k)] = min(least.get(top(k), table[k][0]), table[k][0])
    want = sorted(repr((r[0], links[k], least.get(top(k), r[0]), r[0] is None or r[0] == least.get(top(k), r[0]))) for k, r in enumerate(table))
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], "vec_id long, embedding array<float>, label int, node string, shard int")
    assert sorted(repr(tuple(r)) for r in hnsw.near_duplicates(frame).collect()) == want
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_over_many_shards_and_blocks(spark, monkeypatch):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, hnsw.near_duplicates(frame).filter("vec_id is not null").collect()))
    monkeypatch.setattr(hnsw, "SHARD", 60)
    monkeypatch.setattr(hnsw, "BLOCK", 45)
    assert sorted(map(tuple, hnsw.near_duplicates(frame).filter("vec_id is not null").collect())) == want


def test_graph_recall_and_audit():
    random = np.random.default_rng(4)
    x = random.normal(size=(1500, 24))
    x[500:] = x[random.integers(0, 500, 1000)] + 0.12 * random.normal(size=(1000, 24))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    found = hnsw.search(hnsw.Graph(x), x, np.arange(len(x)), 0.93)
    truth = x @ x.T >= 0.93
    assert sum(map(len, found)) >= 0.97 * truth.sum()
    assert all(truth[i][hits].all() for i, hits in enumerate(found))


def test_audit_weighs_lone_pairs_like_a_dense_group():
    random = np.random.default_rng(9)
    x = random.normal(size=(2600, 16))
    x[:800] = x[0] + 0.05 * random.normal(size=(800, 16))
    x[801:2600:2] = x[800:2599:2] + 0.04 * random.normal(size=(900, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    some = np.concatenate([np.arange(800, 2600), np.arange(0, 800, 8)])
    found = hnsw.search(hnsw.Graph(x), x[some], some, 0.93)
    share = [len(hits) / t for hits, t in zip(found, (x[some] @ x.T >= 0.93).sum(axis=1))]
    assert np.mean(share[:1800]) >= 0.95
    lone = hnsw.search(hnsw.Graph(x[800:2600:2]), x[800:2600:2], np.arange(900), 0.93)
    assert [len(h) for h in lone] == [1] * 900


def test_boosting_learns_a_rule():
    random = np.random.default_rng(1)
    x = random.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = boosting.boost(x[:1500], y[:1500])
    assert ((model.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    assert (boosting.boost(x, np.ones(2000)).log_odds(x) > 0).all()


@pytest.fixture(scope="module")
def trees(spark):
    folder = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no pages here")
    return html_text.learn(spark.read.parquet(folder))


MAIN = ["First paragraph of the article, with commas and a full stop.", "Second one & more < text.", "A list item", "Third paragraph, again longer than the others are."]


@pytest.mark.parametrize("frame", [
    "<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{}</article><footer>&copy; me</footer></body>",
    "<div class='site-header'><a href=/>Logo</a></div><div id=content><h1>Title</h1>{}</div><div class='sidebar'><h3>More</h3><ul><li><a href=/a>one</a></ul></div>",
    "<main><h1>Title</h1>{}<section class=comments><h3>Comments</h3><p>I liked this a lot, thank you.</p></section></main><aside>ads here</aside>",
    "<div class=cookie-notice>We use cookies.</div><article><h1>Title</h1>{}<div class=ad>Buy it now.</div></article><form>Mail <input><button>Go</button></form>",
])
def test_pages_in_frames(trees, frame):
    inside = f"<p>{MAIN[0]}</p><p>Second   one &amp; more\n &lt; text.<br><ul><li>{MAIN[2]}</ul><script>x('</p>')</script><!-- <p>no</p> --><p>{MAIN[3]}"
    got = html_text.main_text(f"<!doctype html><html><head><title>t</title><style>p{{}}</style></head>{frame.format(inside)}</html>", trees)
    assert got.split("\n") == ["Title", *MAIN]


def test_decoding_never_contradicts_ancestors():
    page = html_text.Page("<div><div><p>a</p><p>b</p></div><div><p>c</p><div><p>d</p></div></div></div>")
    random = np.random.default_rng(0)
    for _ in range(200):
        odds = random.normal(size=len(page.tag)) * 3
        keep = page.decode(odds)
        best, choice = -np.inf, None
        n = len(page.tag)
        for code in range(3 ** (n - 1)):  # every labelling: 0 above, 1 main, 2 cut
            state, c, score = [0] * n, code, 0.0
            for i in range(1, n):
                state[i] = c % 3
                c //= 3
                up = state[page.parent[i]]
                if (up == 2 and state[i] != 2) or (up == 1 and state[i] == 0):
                    score = -np.inf
                    break
                score += -np.logaddexp(0, -odds[i]) if state[i] == 1 else -np.logaddexp(0, odds[i])
                score -= html_text.TURN if (up, state[i]) in ((0, 1), (1, 2)) else 0
            if score > best + 1e-9:
                best, choice = score, [s == 1 for s in state]
        assert keep.tolist() == choice


def test_deep_pages_close_their_own_nodes():
    """Text after nested blocks belongs to the block it stands in, however deep."""
    for depth in (50, 222, 5000):
        page = html_text.Page("<div>" * depth + "in" + "</div>" * (depth - 3) + "out" + "</div></div></div>")
        where = {text.strip(): node for node, text in page.events if text.strip()}
        assert where["in"] == depth and where["out"] == 3


def test_awkward_pages(spark, trees):
    odd = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "no tags at all"), (5, "u", "<" * 500), (6, "u", "<div>" * 3000 + "deep"),
           (7, "u", "<a href=\"x>" * 50), (7, "u", "<article>" + "<p>w x y.</p>" * 20_000), (8, "u", "</div></p><table><tr><td>a<td>b</table>")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in odd], "page_id long, url string, html string, text string, id string")
    got = html_text.extract(frame, trees).collect()
    assert sorted((str(r["page_id"]), str(r["url"])) for r in got) == sorted((str(a), str(b)) for a, b, _ in odd)
    assert all(r["text"] is not None for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert html_text.extract(frame.limit(0), html_text.learn(frame.limit(0))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    secret = "token = \"" + "0a1b2c3d4e" * 4 + "\""
    given = [(1000 + i, prose(i, 120 + i), "en", "s", 1) for i in range(40)]
    given += [(2000, given[3][1], "en", "s", 1), (2001, prose(77, 100) + " " + secret, "en", "s", 1), (2002, "### " * 100, "en", "s", 1),
              (2003, given[5][1] + " " + prose(500, 200), "en", "s", 1)]
    now = spark.createDataFrame(given + [r for r in rows() if r[0] is None], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != "best-fit packing":
            assert now.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda name: {r["doc_id"] for r in seen[name].collect()}
    clean = {1000 + i for i in range(40)} | {2001, 2003}
    assert ids("quality rules") - {None} == clean | {2000}
    assert ids("SimHash near-dedup") - {None} == clean
    text = {r["doc_id"]: r["text"] for r in seen["suffix-array dedup"].collect()}
    assert text[2003].strip() == prose(500, 200) and text[1005] == given[5][1]
    final = {r["doc_id"]: r["text"] for r in seen["secret scans"].collect()}
    assert "0a1b2c3d4e" not in final[2001] or final[2001] == text[2001]
    assert ids("best-fit packing") - {None} == clean


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    now = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.count() == 0 and docs(spark).count() > 0
