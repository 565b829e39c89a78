"""Small awkward tables: nulls, empty and long texts, repeats, ties, columns with clashing names."""

from __future__ import annotations

import random

WORDS = "the of and stream river boat harbour tide reef shoal coral wind swell calm storm rain light deep salt wave net crew".split()

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as a user's own.
CLASH = "chunk string, id string, stats string, key string, piece string, label string, fp string, node string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        out.extend(r.choices(WORDS, k=r.randint(4, 12)))
        out[-1] += r.choice([".", ".\n", ","])
    return " ".join(out[:n])


def rows() -> list[tuple]:
    texts = [prose(i, 60 + 7 * i) for i in range(12)]
    texts += [texts[3], texts[3], texts[4].replace("tide", "ebb", 1), texts[5] + " extra words at the end of it."]
    texts += [None, "", " \n\t ", "one", "two words", "a " * 300, "### $$$ | | | x " * 40, prose(99, 6000)]
    texts += ["Ünïcode é ñ 日本語 🙂 text İstanbul ΣΑΣ " * 3, "tab\tand\x0bvertical\x0cfeed\rreturn", "nbsp\xa0between words"]
    docs = [(i * 3, t, "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs.append((9, texts[3], "en", "src0", len(texts[3])))  # an id again, with the text of another row
    docs.append((None, texts[2], None, None, None))
    docs.append((None, None, None, None, None))
    return docs


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def clashing(spark):
    extra = ", ".join(DOCS.split(", ")) + ", " + CLASH
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows()], extra)


def empty(spark):
    return spark.createDataFrame([], DOCS)
