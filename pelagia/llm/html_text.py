"""Main text of web pages: boosted trees over DOM nodes and a decoding that keeps the tree consistent.

Every block element of a page gets features: its tag and its ancestors' tags, the words in its class, id and role, how
dense text, links and sentences are in its subtree, its depth, and how it compares with its siblings. Boosted trees give
the probability that the node lies in the main text. Node decisions alone may contradict each other, so the page is
decoded as a whole: going down the tree a node is above the main text, in it, or cut off, a cut node has only cut
descendants, a main node has main or cut children, and the most probable consistent choice is taken by dynamic
programming. Text in main nodes is returned block by block.

The trees learn from pages whose truth is known by construction: the texts of a bounded sample of the given pages are
laid out anew in varied page frames (menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
under many names), so what is learnt does not depend on the one frame the sample came in.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.boosting import Boosted, boost
from pelagia.llm.common import arrow_stage

#: Pages that the trees learn from, and the characters of the longest page among them.
SAMPLE, SAMPLE_CHARS = 240, 60_000

#: Log odds it takes to begin a main part, or to cut something out of one.
TURN = 1.0

#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr picture source track map area".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text.
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select button textarea datalist title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: An open element of the key ends where one of the values starts.
ENDS = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                       "menu nav ol p pre section table ul".split()),
        "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
        "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"])}
SCOPE = frozenset("html body table td th ul ol dl div section article aside main nav header footer form".split())

TAGS = ["article", "main", "section", "div", "p", "h", "list", "li", "table", "nav", "header", "footer", "aside", "form", "figure", "quote", "body"]
_TAG = {t: t for t in TAGS} | {f"h{i}": "h" for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), "list") | dict.fromkeys(
    ("dt", "dd"), "li") | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), "table") | {"blockquote": "quote", "pre": "quote",
                                                                                                "figcaption": "figure", "html": "body"}
#: Words of class, id and role attributes by what they usually name.
WORDS = {
    "text": "article content post entry story body main text blog news hentry page prose copy",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs pagination pager toc sitemap skip",
    "head": "header masthead banner topbar top logo branding brand hero",
    "foot": "footer copyright legal colophon bottom imprint credits",
    "side": "sidebar side aside rail widget widgets related recommended more popular trending complementary secondary",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall message toast disclaimer warning",
    "form": "form search searchbox login register contact input field",
    "comment": "comment comments commentlist respond response responses reply replies discussion disqus thread reviews feedback reader",
    "share": "share sharing social follow facebook twitter tags meta byline author",
}
_WORD: dict[str, list[int]] = {}
for _i, _names in enumerate(WORDS.values()):
    for _w in _names.split():
        _WORD.setdefault(_w, []).append(_i)

_MARK = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WIDTH = 2 * (len(TAGS) + len(WORDS)) + 10


class Page:
    """A page's block elements and its text in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.named = ["body"], [-1], [0], [0]
        self.events: list[tuple[int, str]] = []  # (node, text); node -1 ends a block
        self.linked: list[int] = []
        stack, hidden, links, at = [(0, "#top")], 0, 0, 0
        hide: list[str] = []
        end = len(source)
        while at < end:
            m = _MARK.search(source, at)
            stop = m.start() if m else end
            if stop > at and not hide:
                self.events.append((stack[-1][0], html.unescape(source[at:stop])))
                self.linked.append(links)
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if hide:
                    if name == hide[-1]:
                        hide.pop()
                    continue
                if name == "a":
                    links = max(0, links - 1)
                if name in INLINE:
                    continue
                self._close(stack, name)
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                after = source.find(">", close.end()) if close else -1
                at = after + 1 if after >= 0 else end
                continue
            if name in VOID:
                if name == "br" and not hide:
                    self.events.append((stack[-1][0], " "))
                    self.linked.append(links)
                elif name == "hr" and not hide:
                    self._break()
                continue
            if hide or name in HIDDEN:
                if (m[3] or m[6] or "").rstrip().endswith("/"):
                    continue
                if name in HIDDEN and (not hide or name == hide[-1]):
                    hide.append(name)
                elif hide and hide[-1] == "head" and name == "body":
                    hide.clear()
                if hide:
                    continue
            if name == "a":
                links += 1
            if name in INLINE or name in ("html", "body"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if name in ENDS.get(stack[i][1], ()):
                    del stack[i:]
                    links = 0
                    break
                if stack[i][1] in SCOPE:
                    break
            self._break()
            self.tag.append(_TAG.get(name, "other"))
            self.parent.append(stack[-1][0])
            self.depth.append(len(stack))
            self.named.append(self._names(m[3] or m[6] or ""))
            stack.append((len(self.tag) - 1, name))
        self._break()

    def _break(self) -> None:
        self.events.append((-1, ""))
        self.linked.append(0)

    def _close(self, stack: list, name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] == name:
                del stack[i:]
                break
        self._break()

    @staticmethod
    def _names(attributes: str) -> int:
        if "=" not in attributes:
            return 0
        bits = 0
        for m in _ATTR.finditer(attributes):
            for word in _CAMEL.findall(m[2] or m[3] or m[4] or ""):
                for i in _WORD.get(word.lower(), ()):
                    bits |= 1 << i
        return bits

    def features(self) -> np.ndarray:
        """One row per node; node 0 stands for the page."""
        n = len(self.tag)
        sums = np.zeros((n, 6))  # characters, linked characters, sentence marks, blocks of text, nodes, paragraphs
        last = -1
        for (node, text), linked in zip(self.events, self.linked):
            if node < 0:
                last = -1
                continue
            size = len(text) - text.count(" ") - text.count("\n")
            if not size:
                continue
            row = sums[node]
            row[0] += size
            row[1] += size if linked else 0
            row[2] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
            row[3] += node != last
            last = node
        parent = np.array(self.parent)
        kids, place = np.zeros(n), np.zeros(n)
        for i in range(n):
            if i:
                place[i] = kids[parent[i]]
                kids[parent[i]] += 1
        sums[:, 4] = 1
        sums[:, 5] = [t == "p" for t in self.tag]
        for i in range(n - 1, 0, -1):
            sums[parent[i]] += sums[i]
        total = max(sums[0, 0], 1.0)
        up = np.maximum(parent, 0)
        out = np.zeros((n, WIDTH), dtype=np.float32)
        t, w = len(TAGS), len(WORDS)
        number = {name: k for k, name in enumerate(TAGS)}
        for i in range(n):
            k = number.get(self.tag[i])
            if k is not None:
                out[i, k] = 1
            bits = self.named[i]
            b = 0
            while bits:
                if bits & 1:
                    out[i, t + b] = 1
                bits >>= 1
                b += 1
            if i:
                p = parent[i]
                out[i, t + w:2 * (t + w)] = np.maximum(out[p, :t + w], out[p, t + w:2 * (t + w)])
        text = sums[:, 0]
        rest = out[:, 2 * (t + w):]
        rest[:, 0] = np.log1p(text)
        rest[:, 1] = sums[:, 1] / np.maximum(text, 1)
        rest[:, 2] = sums[:, 2] / np.maximum(text, 1)
        rest[:, 3] = text / np.maximum(sums[:, 4], 1)
        rest[:, 4] = np.log1p(sums[:, 5])
        rest[:, 5] = self.depth
        rest[:, 6] = place / np.maximum(kids[up], 1)
        rest[:, 7] = text / np.maximum(text[up], 1)
        rest[:, 8] = text / total
        rest[:, 9] = text * np.maximum(kids[up], 1) / np.maximum(text[up], 1)
        return out

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Whether each node is main, by the most probable consistent labelling of the tree."""
        n = len(self.tag)
        inside = -np.logaddexp(0, -odds)
        outside = -np.logaddexp(0, odds)
        above, main, cut = outside.copy(), inside.copy(), outside.copy()
        above[0], main[0], cut[0] = 0.0, -np.inf, 0.0
        choice = np.zeros((n, 2), dtype=np.int8)
        for i in range(n - 1, 0, -1):
            options = (above[i], main[i] - TURN, cut[i])
            best = max(range(3), key=lambda k: options[k])
            within = 1 if main[i] >= cut[i] - TURN else 2
            choice[i] = best, within
            p = self.parent[i]
            above[p] += options[best]
            main[p] += main[i] if within == 1 else cut[i] - TURN
            cut[p] += cut[i]
        state = np.zeros(n, dtype=np.int8)
        for i in range(1, n):
            s = state[self.parent[i]]
            state[i] = 2 if s == 2 else choice[i, 1] if s == 1 else choice[i, 0]
        return state == 1

    def text(self, keep: np.ndarray) -> str:
        """Kept text: white space in a block as one space, blocks on lines of their own, empty ones left out."""
        blocks, now = [], []
        for node, text in self.events:
            if node < 0:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif keep[node]:
                now.append(text)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


def _frames(paragraphs: list[str], seed: int) -> tuple[str, str]:
    """A page around ``paragraphs`` in a random frame, main parts between \\x02 and \\x03 in the second form."""
    r = random.Random(seed)
    words = " ".join(paragraphs).split() or ["text"]
    paragraphs = r.sample(paragraphs, r.choice([1, 2, 3, 5, 8, 13, 20, 40]) % (len(paragraphs) + 1) or len(paragraphs))
    some = lambda a, b: " ".join(r.choices(words, k=r.randint(a, b)))
    pick = lambda group: r.choice(WORDS[group].split())
    attr = lambda group: r.choice([f' class="{pick(group)}"', f' id="{pick(group)}"', f' class="{pick(group)}-{r.choice(["box", "wrap", "inner", "area", "1"])}"'])
    links = lambda a, b: "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(r.randint(a, b)))
    esc = html.escape

    def block(tags: list[str], group: str, inner: str) -> str:
        tag = r.choice(tags)
        bare = tag in ("nav", "header", "footer", "aside") and r.random() < 0.5
        return f"<{tag}{'' if bare else attr(group)}>{inner}</{tag}>"

    def extra(kind: str) -> str:
        prose = f"<p>{esc(some(4, 60))}.</p>"
        if kind == "menu":
            return block(["nav", "div"], "menu", f"<ul>{links(3, 10)}</ul>")
        if kind == "head":
            return block(["header", "div"], "head", r.choice([f"<h1>{some(1, 4)}</h1>", f"<a href='/'>{some(1, 3)}</a>", ""]) + r.choice([f"<p>{some(2, 8)}</p>", ""]))
        if kind == "foot":
            return block(["footer", "div"], "foot", r.choice([f"&copy; {some(2, 20)}", prose, f"<ul>{links(2, 6)}</ul>{some(1, 8)}"]))
        if kind == "side":
            return block(["aside", "div", "section"], "side", f"<h3>{some(1, 4)}</h3>" + r.choice([f"<ul>{links(3, 8)}</ul>", prose, prose + prose]))
        if kind == "advert":
            return block(["div", "div", "section", "aside"], "advert", r.choice([esc(some(2, 25)), prose, f"<a href='/x'>{some(2, 8)}</a>"]))
        if kind == "notice":
            return block(["div", "section"], "notice", r.choice([esc(some(4, 40)), prose]) + r.choice(["", "<button>OK</button>", "<a href='/c'>x</a>"]))
        if kind == "form":
            return f"<form{r.choice(['', attr('form')])}><label>{some(1, 4)}</label><input name=q>{r.choice(['', prose, f'<p>{some(2, 12)}</p>'])}<button>{some(1, 2)}</button></form>"
        if kind == "comment":
            one = lambda: f"<{(t := r.choice(['div', 'div', 'li', 'li', 'p', 'article']))}{attr('comment') if t == 'article' or r.random() < 0.5 else ''}>{r.choice(['', f'<b>{some(1, 2)}</b>'])}{esc(some(5, 80))}.</{t}>"
            return block(["section", "div", "div", "ol"], "comment", r.choice(["", f"<h3>{some(1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6))))
        return block(["div"], "share", f"<ul>{links(2, 4)}</ul>")

    title = esc(some(3, 10))
    main = [f"<h1>{title}</h1>"] if r.random() < 0.8 else []
    if r.random() < 0.3 and main:
        main = [f"<header>{main[0]}</header>"]
    for p in paragraphs:
        kind = r.random() * (0.8 if seed % 3 == 0 else 1.0)
        body = esc(p if r.random() < 0.8 else some(1, 6))
        if kind < 0.7:
            main.append(f"<p>{body}</p>")
        elif kind < 0.76:
            main.append(f"<p><b>{body}<br>")
        elif kind < 0.81:
            main.append(f"<h2>{esc(some(2, 7))}</h2><p>{body}</p>")
        elif kind < 0.86:
            main.append(f"<ul><li>{body}</li><li>{esc(some(4, 20))}</li></ul>")
        elif kind < 0.9:
            main.append(f"<blockquote>{body}</blockquote>")
        elif kind < 0.94:
            main.append(f"<div>{body}</div>")
        elif kind < 0.97:
            main.append(f"<table><tr><td>{body}</td><td>{some(1, 4)}</td></tr></table>")
        else:
            main.append(f"<section><h3>{some(1, 5)}</h3><p>{body} <a href='/l'>{some(1, 4)}</a></p></section>")
    for kind in ("advert", "share", "notice", "side", "form"):
        if r.random() < 0.12:
            main.insert(r.randint(1, len(main)), "\x03" + extra(kind) + "\x02")
    if r.random() < 0.35:
        main.append("\x03" + extra("comment") + "\x02")
    inner = "".join(main)
    tag = r.choice(["article", "article", "main", "div", "div", "section"])
    named = attr("text") if tag in ("div", "section") or r.random() < 0.4 else ""
    whole = f"<{tag}{named}>\x02{inner}\x03</{tag}>"
    for _ in range(r.randint(0, 2)):
        whole = f"<div{r.choice(['', ' class=wrapper', ' id=container', ' class=row'])}>{extra('side') if r.random() < 0.25 else ''}{whole}{extra('comment') if r.random() < 0.25 else ''}</div>"
    lead = [extra(k) for k in r.sample(["head", "menu", "notice", "advert", "form"], r.randint(1, 4))]
    tail = [extra(k) for k in r.sample(["comment", "side", "advert", "menu", "form", "notice"], r.randint(0, 3))]
    if r.random() < 0.9:
        tail.append(extra("foot"))
    page = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(lead)}{whole}{''.join(tail)}</body></html>"
    return page.replace("\x02", "").replace("\x03", ""), page


def taught_rows(source: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of one framed page made from the text of ``source``."""
    blocks = [b for b in Page(source).text(np.ones(10 ** 6, dtype=bool)).split("\n") if b][:40] or ["text text text."]
    plain, marked = _frames([b.replace("\x02", "").replace("\x03", "") for b in blocks], seed)
    page, told = Page(plain), Page(marked)
    # walk the marked page's text: the first mark opens the main part, and a node below it is main unless its text begins outside
    inside, root, begins = False, -1, [None] * len(page.tag)
    for node, text in told.events:
        for part in re.split("([\x02\x03])", text) if node >= 0 else ():
            if part in ("\x02", "\x03"):
                inside = part == "\x02"
                root = node if root < 0 else root
            if part and begins[node] is None and (part == "\x02" or part not in "\x03"):
                begins[node] = inside
    labels, own = np.zeros(len(page.tag), dtype=bool), {i for i, b in enumerate(begins) if b is not None}
    for i in range(len(page.tag) - 1, 0, -1):  # what has no text of its own begins with its first child
        if begins[i] is not None and page.parent[i] not in own:
            begins[page.parent[i]] = begins[i]
    for i in range(1, len(page.tag)):
        labels[i] = i == root or bool(begins[i]) and labels[page.parent[i]]
    return page.features()[1:], labels[1:].astype(float)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, frames: int = 3) -> Boosted:
    """Trees from ``frames`` framings of each of ``sample`` pages; features are made by the executors."""
    some = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).filter(
        F.length("html").between(1, SAMPLE_CHARS)).orderBy(F.xxhash64("id"), "id", F.xxhash64("html")).limit(sample)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, labels = [], []
        for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k in range(frames):
                rows, of = taught_rows(source, (key or 0) * frames + k)
                out.append(rows.tobytes())
                labels.append(of.astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(labels, pa.binary())], ["rows", "labels"])

    found = arrow_stage(some, step, "rows binary, labels binary").orderBy(F.xxhash64("rows"), F.xxhash64("labels")).collect()
    rows = np.concatenate([np.frombuffer(x["rows"], dtype=np.float32).reshape(-1, WIDTH) for x in found] or [np.zeros((0, WIDTH), np.float32)])
    labels = np.concatenate([np.frombuffer(x["labels"], dtype=np.uint8) for x in found] or [np.zeros(0, np.uint8)]).astype(float)
    return boost(rows, labels)


def main_text(source: str | None, trees: Boosted) -> str:
    page = Page(source or "")
    return page.text(page.decode(trees.log_odds(page.features())))


def extract(pages: DataFrame, trees: Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` per row of ``pages``: the main text of the whole html, empty where there is none.

    Null html is empty. Repeated rows each come back; null ids and urls stay null; extra columns are ignored.
    """

    def step(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            parsed = [Page(x or "") for x in part.column(2).to_pylist()]
            rows = [p.features() for p in parsed]
            odds = np.split(trees.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
            texts = [p.text(p.decode(o)) for p, o in zip(parsed, odds)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return arrow_stage(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")), step,
                       "page_id long, url string, text string")
