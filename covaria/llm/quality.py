"""Quality rules, line first.

Each line of a document is judged on its own by three rules: punctuation, navigation and boilerplate.  Lines that
fail are removed; a document that loses more than ``MAX_LOST`` of its words that way is rejected, and so is one that
fails the base rules (fewer than ``MIN_WORDS`` words, or over half of them in repeated three-word windows).

Defined results: a null or empty text has no words and is rejected as too short; repeated rows are judged alike, each
for itself; very long texts are read whole; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from covaria.llm.common import extend, scan

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST = 0.5
#: A line of fewer words than this must end like a sentence.
FRAGMENT_WORDS = 5
#: Largest share of a line's visible characters that may be neither letters (with their combining marks) nor digits.
MAX_MARKS = 0.2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"

# Full stops, question and exclamation marks of other scripts: full-width, Arabic, Devanagari, Armenian, Ethiopic, Khmer, Burmese, Tibetan.
_SENTENCE_END = re.compile(r"[.!?…:;。．！？｡؟۔।॥։።፧፨។៕။།༎][\"'”’»)\]」』]*$")
# Python's \w leaves out combining marks (category M) and the two joiners, which are parts of letters.
_COMBINING = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M") + "\u200c\u200d"
_MARK = re.compile(r"[^\w\s]|_")
_MARK_NOT_COMBINING = re.compile(rf"[^\w\s{_COMBINING}]|_")
_NAVIGATION = re.compile(r"\s(?:[|»›>•·]|::|->)\s")
# Phrases of page furniture in English, French, German and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "licensed under",
    "log in to",
    "powered by",
    "privacy policy",
    "released under",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
    "use of cookies",
    "accepter les cookies",
    "mentions légales",
    "politique de confidentialité",
    "tous droits réservés",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "aceptar cookies",
    "aviso legal",
    "política de privacidad",
    "todos los derechos reservados",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)) + "|(?:©|\\(c\\)|copyright) *[12][0-9]{3}")
#: A boilerplate phrase condemns only lines up to this length; in a long paragraph it is ordinary prose.
BOILERPLATE_WORDS = 30

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bad_punctuation long, n_navigation long, n_boilerplate long, kept_words long, base_failed boolean, kept boolean, cleaned string"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    pairs = ids[:-1] * v + ids[1:]
    if v < 2_000_000:
        windows = pairs[:-1] * v + ids[2:]
    else:  # three numbers would not fit one integer: number the pairs first
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def line_verdict(line: str, n_words: int) -> str:
    """The rule that a line with words fails, or an empty string."""
    if n_words <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if len(_NAVIGATION.findall(line)) >= 2 or line.rstrip().endswith(("|", "»")):
        return "navigation"
    if n_words < FRAGMENT_WORDS and not _SENTENCE_END.search(line.rstrip()):
        return "punctuation"
    visible = len(line) - sum(line.count(c) for c in SPACES)
    # the second pattern is slow and finds no more than the first
    if len(_MARK.findall(line)) > MAX_MARKS * visible and len(_MARK_NOT_COMBINING.findall(line)) > MAX_MARKS * visible:
        return "punctuation"
    return ""


def judge(text: str | None) -> dict:
    """All measures and the verdict for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    failed = {"": 0, "punctuation": 0, "navigation": 0, "boilerplate": 0}
    earlier: set[str] = set()
    good, kept_words, duplicates = [], 0, 0
    for line in text.split("\n"):
        k = len(line.encode("utf-8", "surrogatepass").split())
        if not k:
            good.append(line)
            continue
        if line in earlier:
            duplicates += 1
            verdict = "boilerplate"
        else:
            earlier.add(line)
            verdict = line_verdict(line, k)
        failed[verdict] += 1
        if not verdict:
            kept_words += k
            good.append(line)
    repeats = repeated_words(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(text.count(c) for c in SPACES),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "n_bad_punctuation": failed["punctuation"],
        "n_navigation": failed["navigation"],
        "n_boilerplate": failed["boilerplate"],
        "kept_words": kept_words,
        "base_failed": base,
        "kept": not base and kept_words >= (1 - MAX_LOST) * n,
        "cleaned": "\n".join(good),
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, the measures of COLUMNS and the verdict; the cleaned text on request."""
    columns = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + (COLUMNS if cleaned else COLUMNS.removesuffix(", cleaned string"))

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [judge(t) for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0)} | {k: [r[k] for r in rows] for k in judge(None)}

    return scan(docs.select(id_col, text_col), kernel, columns)


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without the rejected rows; texts without the lines that failed; the length column, if any, follows."""
    chars = [f for f in docs.schema.fields if f.name == chars_col]

    def kernel(batch: pa.RecordBatch) -> tuple[list[bool], dict[str, list]]:
        rows = [judge(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        return [r["kept"] for r in rows], {text_col: [r["cleaned"] for r in rows], chars_col: [len(r["cleaned"]) for r in rows]}

    return extend(docs, kernel, f"{text_col} string" + "".join(f", {chars_col} {f.dataType.simpleString()}" for f in chars))
