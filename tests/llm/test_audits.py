"""The filter audit, the dataset manifest and the exact search."""

import math
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.llm import audit, merkle, queries, topk
from tests.llm.helpers import documents, empty, prose, rows, words


def plain_audit(docs, labels):
    """Every order run document by document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = {}
    for i, text, part in docs:
        t, w = text or "", words(text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        parts.setdefault(part or "", []).append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, own in enumerate(order, 1):
                gone = [m for m in left if own in m[1]]
                left = [m for m in left if own not in m[1]]
                shapley[own] += len(gone)
                failing = sum(own in m[1] for m in members)
                unique = sum(m[1] == {own} for m in members)
                lost = [sum(m[0] in s for m in gone if m[0] is not None) for s in (good, toxic)]
                out[part, order, step] = [len(left), len(gone), failing - len(gone), unique, *lost]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(spark, docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(got) == len(found)
    return got


def test_audit_against_every_order(spark):
    import random

    rng = random.Random(1)
    long = "The Green House # " * 40
    docs = [(k, prose(rng, rng.randint(60, 160)) if k % 5 else long if k % 2 else "SAME", [None, "", "en", "de"][k % 4]) for k in range(90)]
    docs += [(200 + k, "COPY of one text", "en") for k in range(60)] + [(None, "SAME", "de"), (None, None, "de"), (3, docs[3][1], "fr")]
    labels = [(k, k % 2, (k % 3 == 0) + 0) for k in range(0, 250, 2)] + [(4, 1, None), (None, 1, 1), (9999, 1, 1), (10, 0, 1)]
    got = audited(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels)
    assert got == plain_audit(docs, labels)


def test_audit_awkward_rows(spark):
    data = [(i, t, lang) for i, t, lang, *_ in rows()]
    assert audited(spark, documents(spark), [(0, 1, 1), (1, None, None)]) == plain_audit(data, [(0, 1, 1), (1, None, None)])
    assert audited(spark, documents(spark), []) == plain_audit(data, [])
    assert audited(spark, empty(spark), [(0, 1, 1)]) == {}


@pytest.mark.parametrize("k", [1, 3, 6])
def test_survivors_against_counting(k):
    counts = np.random.default_rng(k).integers(0, 9, (2, 1 << k))
    got = audit.survivors(counts)
    for s in range(1 << k):
        assert (got[:, s] == sum(counts[:, m] for m in range(1 << k) if m & s == 0)).all()
    shapley = audit.shapley_sums(got.T)
    want = np.zeros((k, 2), int)
    for order in permutations(range(k)):
        s = 0
        for i in order:
            want[i] += got[:, s] - got[:, s | 1 << i]
            s |= 1 << i
    assert (shapley == want).all()


def digest(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def plain_manifest(data):
    """(doc_id, source, lang, n_chars, text) -> sorted rows of the manifest, each proof gathered from whole levels."""

    def leaf(row):
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def walk(tree, k):
        for level in tree[:-1]:
            first = k // 8 * 8
            yield level[first:k], level[k + 1 : first + 8]
            k //= 8

    langs = sorted({r[2] for r in data}, key=lambda x: (x is not None, (x or "").encode()))
    by = {lang: sorted((r for r in data if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    trees = {lang: levels([leaf(r) for r in members]) for lang, members in by.items()}
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for k, row in enumerate(by[lang]):
            steps = [*walk(trees[lang], k), *walk(top, g)]
            low = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            h = leaf((*row[:4], low)) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else leaf(row)
            for before, after in steps:
                h = digest(*before, h, *after)
            proof = digest(*[s for before, after in steps for s in (*before, *after)])
            out.append((row[0], leaf(row), trees[lang][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(map(repr, out))


def manifested(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("level, parts", [(1, 3), (2, 12), (4, 1)])
def test_manifest_against_whole_levels(spark, tmp_path, monkeypatch, level, parts):
    monkeypatch.setattr(merkle, "LEAST_LEVEL", level)
    langs = ["en", None, "", "é", *[f"l{k}" for k in range(parts)]]
    data = [(k * 7 % 1201, f"s{k % 3}", "en" if k % 2 else langs[k % len(langs)], k, f"Text {k} Ü" if k % 5 else None) for k in range(1201)]
    data += [(5, "hot", "en", 1, "Repeated")] * 300 + [(None, None, "en", None, "X"), (9, "a", "en", 2, "Other text of one id")]
    got = manifested(spark, spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars int, text string"), tmp_path)
    assert got == plain_manifest(data)


def test_manifest_awkward_rows(spark, tmp_path):
    data = [(i, source, lang, n, t) for i, t, lang, source, n, *_ in rows()]
    assert manifested(spark, documents(spark), tmp_path / "a") == plain_manifest(data)
    assert manifested(spark, documents(spark).where("doc_id = 3"), tmp_path / "b") == plain_manifest([r for r in data if r[0] == 3])
    assert manifested(spark, empty(spark), tmp_path / "c") == []


def test_manifest_proofs_verify_alone(spark, monkeypatch):
    """The siblings that are put out lead from a leaf to the root without any table."""
    monkeypatch.setattr(merkle, "LEAST_LEVEL", 1)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    for r in merkle.manifest(spark, docs, siblings=True).collect():
        index, n, h, rest = r.doc_id, 200, r.leaf, list(r.proof)
        while n > 1:
            run = min(8, n - index // 8 * 8) - 1
            run, rest = rest[:run], rest[run:]
            h, index, n = digest(*run[: index % 8], h, *run[index % 8 :]), index // 8, -(-n // 8)
        assert h == r.root == r.folded_root and not rest and r.verified and digest(*r.proof) == r.proof_sha256


def test_forests_merge_in_any_order():
    sizes = np.array([1, 8, 75, 600])
    leaves = [(g, k, digest(f"{g}:{k}").encode()) for g, n in enumerate(sizes.tolist()) for k in range(n)]
    whole = merkle.Forest(sizes, 1)
    for g, k, d in leaves:
        whole.add(g, 0, k, d)
    rng = np.random.default_rng(1)
    pieces = []
    for some in np.array_split(rng.permutation(len(leaves)), 9):
        piece = merkle.Forest(sizes, 1)
        for i in some:
            piece.add(leaves[i][0], 0, leaves[i][1], leaves[i][2])
        pieces.append(piece)
    while len(pieces) > 1:
        a, b = pieces.pop(rng.integers(len(pieces))), pieces.pop(rng.integers(len(pieces)))
        pieces.append(a.merge(b))
    assert pieces[0].kept == whole.kept and not whole.open and not pieces[0].open


def plain_top_k(data, top=5, every=50):
    """All products in Python's whole numbers."""
    sound = [(i, tuple(min(max(math.floor(256 * float(x)), -(2**63)), 2**63 - 1) for x in v)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % every == 0}):
        found = {}
        for j, c in set(sound):
            for i, v in set(sound):
                if i == q and j != q and len(v) == len(c):
                    score = min(max(sum(a * b for a, b in zip(v, c, strict=True)), -(2**63)), 2**63 - 1)
                    found[j] = max(found.get(j, score), score)
        out += [(q, k + 1, j, s) for k, (j, s) in enumerate(sorted(found.items(), key=lambda t: (-t[1], t[0]))[:top])]
    return out


def searched(spark, data, **options):
    df = spark.createDataFrame([(*d, "x", "x", 1) for d in data], "vec_id long, embedding array<double>, score string, shard string, floor int")
    return sorted(map(tuple, topk.exact_top_k(spark, df, **options).collect()))


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e9])
def test_top_k_against_all(spark, monkeypatch, scale):
    """Small blocks and shards, a vector that a third of all rows share, repeated rows, several lengths, every odd value."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "LEAST_SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "PORTION_QUERIES", 4)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(450, 6)) + 4 * rng.normal(size=(9, 6))[rng.integers(9, size=450)]
    x[:150] = x[0]
    data = [(k, (scale * v).tolist()) for k, v in enumerate(x)]
    data += [data[10], data[50], (50, (scale * x[400]).tolist()), (7, (scale * x[300]).tolist()), (500, None), (550, [None] * 6), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (None, [1.0] * 6)]
    data += [(700 + k, [float(k), 1.0]) for k in range(60)] + [(800, []), (801, []), (850, [0.0] * 6), (900, [scale] * 7)]
    assert searched(spark, data) == plain_top_k(data)


def test_top_k_beyond_a_long(spark):
    data = [(k, [s * 1e300, 2.0**40, float(k)]) for k, s in enumerate([1, -1, 0, 1, -1])] + [(50, [1.0, 3e15, -2.0]), (100, [-1e20, 0.5, 1.0])]
    assert searched(spark, data) == plain_top_k(data)


def test_top_k_small_tables(spark):
    assert searched(spark, []) == [] == searched(spark, [(0, [1.0])])
    assert searched(spark, [(0, [1.0]), (3, [2.0]), (2, [2.0])]) == [(0, 1, 2, 131072), (0, 2, 3, 131072)]
    assert len(searched(spark, [(k, [float(k % 7), 1.0]) for k in range(300)], top=20, query_every=100)) == 60


def test_blocks_are_pruned():
    """Near neighbours in the order: a search scores few blocks, and finds what scoring all finds."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 8)) * 300
    x = np.floor(np.repeat(centres, 64, axis=0) + 10 * rng.normal(size=(3840, 8))).astype(np.int64)
    ids, blocks = [np.arange(k, k + 64) for k in range(0, 3840, 64)], [x[k : k + 64] for k in range(0, 3840, 64)]
    high, low = np.stack([b.max(axis=0) for b in blocks]), np.stack([b.min(axis=0) for b in blocks])
    q = x[::97]
    row, found, score, scored = topk.search_shard(q, np.full(len(q), -(2**63)), ids, blocks, high, low, np.float64, 5)
    want = [sorted(zip((-(x @ v)).tolist(), range(3840), strict=True))[:5] for v in q]
    assert [(r, i, s) for r, i, s in zip(row.tolist(), found.tolist(), score.tolist(), strict=True)] == [(k, i, -s) for k, w in enumerate(want) for s, i in w]
    assert scored < 0.15 * len(q) * len(blocks)
