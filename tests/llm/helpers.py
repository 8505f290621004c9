"""Small tables with every awkward case, and plain versions of the contracts' definitions."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars int, size string, id string, fp string, kept string, batch string, target string, key string, word_chars string, __source string, __copies int"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def prose(rng, n, alphabet="the of and thing ension rather house green stone river walk table under".split()):
    out = []
    for k in range(n):
        out.append(rng.choice(alphabet) + rng.choice("aeiou") * (k % 3))
        if k % 11 == 10:
            out[-1] += "."
    return " ".join(out) + "."


def texts(seed=1):
    """Nulls, empty and blank texts, one to three words, near copies, copies, a very long text, odd characters."""
    rng = random.Random(seed)
    base = prose(rng, 400)
    near = base.replace("river", "lake", 1)
    long = prose(rng, 30_000)
    return [
        None, "", "  \n\t ", "one", "one two", "one two three", base, base, near, long, prose(rng, 80), prose(rng, 60) + " mail a.b@c.de or 10.0.0.1 now", "\x00éß 中文 \U0001f600 ́",
        "Home | About | Contact | Login\nClick here to subscribe.\n" * 4, "spam " * 200, "###" * 50, prose(rng, 55) + "\n" + "card 4111 1111 1111 1111.",
    ]


def rows(seed=1):
    """Documents with repeated rows, null ids, null sources and columns whose names clash with those the operators use."""
    out = []
    for k, t in enumerate(texts(seed)):
        source = [None, "b", "a", "a"][k % 4]
        out.append((k, t, ["en", "de", None][k % 3], source, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x", "x", "x", 7))
    return [*out, out[6], (None, *out[10][1:]), (None, *out[0][1:])]


def documents(spark, seed=1):
    return spark.createDataFrame(rows(seed), DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)
