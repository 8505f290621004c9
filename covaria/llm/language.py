"""Language identification by hierarchical discrimination.

A first set of linear support vector machines, one against the rest, predicts the language family; inside a family of several
languages one-versus-one linear machines, one for each pair of close relatives, vote.  Features are hashed byte trigrams
of the whole lower-cased text, square roots of their shares (so that a text has unit length).

Training takes a bounded sample: about TRAIN_DOCS labelled documents in all (by distinct id and label), the same number from each language, by a hash of
their id, each as a whole and as short excerpts from all over it (so that short texts are known too).  Only text and label
are learned from; ``lang`` of the rows to predict is never looked at.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was
learned; a null id is never held out and never trained on; repeated rows are predicted alike; very long texts are read
whole; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.llm.common import scan

#: Bound on the documents that are learned from.
TRAIN_DOCS = 3000
#: Bound on the labels; machines inside a family grow with the square of its languages.
MOST_LABELS = 512
EXCERPTS = 2
DIM = 2048
UNKNOWN = "und"
# Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "indo-aryan": "as bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "romance": "ca es fr gl it la oc pt ro",
    "semitic": "am ar he mt",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr uz",
    "uralic": "et fi hu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
BLOCK = 1 << 20


def family_of(lang: str) -> str:
    return _FAMILY.get(re.split("[-_]", lang.lower())[0], lang)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams."""
    data = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", np.uint8)
    counts = np.zeros(DIM)
    for at in range(0, max(len(data) - 2, 1), BLOCK):
        b = data[at : at + BLOCK + 2].astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 11)
            counts += np.bincount(h, minlength=DIM)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def excerpts(text: str, seed: str) -> list[str]:
    """A few runs of 2 to 16 words from places anywhere in the text."""
    words = text.split()
    out = []
    for k in range(EXCERPTS):
        draw = zlib.crc32(f"{seed}|{k}".encode())
        n = 2 + draw % 15
        if len(words) > n:
            at = (draw >> 8) % (len(words) - n + 1)
            out.append(" ".join(words[at : at + n]))
    return out


def train_svms(x: np.ndarray, signs: np.ndarray, strength: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Linear machines with squared hinge loss, one for each column of ``signs`` (0: the row is left out), by accelerated descent."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(np.float32)
    used = np.maximum((signs != 0).sum(axis=0), 1).astype(np.float32)  # else every product would be made in double precision
    y = signs.astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    ahead, t = w.copy(), 1.0
    rate = np.float32(1 / (2 * 2.0 * strength + 1 / 100))  # rows have norm sqrt 2
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ ahead)) * (y != 0)
        new = ahead - rate * (ahead / np.float32(100) - np.float32(2 * strength) * (x.T @ (y * short)) / used)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + np.float32((before - 1) / t) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[list[str]]
    by_family: np.ndarray
    pairs: dict[int, tuple[list[tuple[int, int]], np.ndarray]]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = np.append(features(text), 1.0)
        margins = x @ self.by_family
        k = int(np.argmax(margins))
        e = np.exp(4 * (margins - margins[k]))
        score = float(e[k] / e.sum())
        if k not in self.pairs:
            return self.families[k][0], score
        duels, w = self.pairs[k]
        margin = x @ w
        votes, backing = np.zeros(len(self.families[k])), np.zeros(len(self.families[k]))
        for (i, j), m in zip(duels, margin.tolist(), strict=True):
            votes[i if m >= 0 else j] += 1
            backing[i] += m
            backing[j] -= m
        best = max(range(len(votes)), key=lambda i: (votes[i], backing[i]))
        sides = [m if i == best else -m for (i, j), m in zip(duels, margin.tolist(), strict=True) if best in (i, j)]
        return self.families[k][best], score / (1 + float(np.exp(-4 * min(sides))))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """The two levels of machines, from feature rows and their labels."""
    by: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by.setdefault(family_of(lang), []).append(lang)
    families = [by[f] for f in sorted(by)]
    label = np.array(langs)
    inside = np.array([np.isin(label, f) for f in families]).T.reshape(len(langs), len(families))
    by_family = train_svms(x, np.where(inside, 1, -1))
    pairs = {}
    for k, members in enumerate(families):
        duels = [(i, j) for i in range(len(members)) for j in range(i + 1, len(members))]
        if duels:
            rows = inside[:, k]
            signs = np.array([np.where(label[rows] == members[i], 1, np.where(label[rows] == members[j], -1, 0)) for i, j in duels]).T
            pairs[k] = (duels, train_svms(x[rows], signs))
    return Model(families, by_family, pairs)


def held_out(id_) -> F.Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit a model on a sample of the rows that are not held out; about ``train_docs`` rows reach the driver, and more than MOST_LABELS labels are refused."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("id").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return Model([], np.zeros((DIM + 1, 0)), {})
    each = train_docs / len(counts)
    chance = F.lit(0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, int(min(1.0, each / n) * (1 << 30))).otherwise(chance)
    # rows that repeat an id and label are one example
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < chance).groupBy("id", "lang").agg(F.min("text").alias("text"))

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"draw": [], "lang": [], "x": []}
        for r in batch.to_pylist():
            for k, piece in enumerate([r["text"], *excerpts(r["text"], str(r["id"]))]):
                if _LETTER.search(piece):
                    out["draw"].append(f"{r['id']}|{k}")
                    out["lang"].append(r["lang"])
                    out["x"].append(features(piece).astype("<f4").tobytes())
        return out

    got = scan(drawn, kernel, "draw string, lang string, x binary").toArrow().sort_by("draw")
    if not got.num_rows:
        return Model([], np.zeros((DIM + 1, 0)), {})
    return fit(np.frombuffer(b"".join(got.column("x").to_pylist()), "<f4").reshape(-1, DIM), got.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, lang_pred, score."""

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        made = [model.predict(t) for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    return scan(docs.select(id_col, text_col), kernel, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
