"""Toxicity, the Merkle manifest and centroid clustering on small fixtures against plain definitions."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutaspark.llm import clustering, merkle, toxicity
from mutaspark.llm.shared import Scratch

H = lambda x: hashlib.sha256(x.encode()).hexdigest()

# Merkle manifest.


def tree(nodes, fan=8):
    """(root, each leaf's siblings by level) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, node in enumerate(at):
            run = nodes[node // fan * fan : node // fan * fan + fan]
            paths[leaf].append(("".join(run[: node % fan]), "".join(run[node % fan + 1 :])))
        nodes, at = [H("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)], [a // fan for a in at]
    return nodes[0], paths


def rows_of_documents():
    r = random.Random(4)
    langs = [None, "", "de", "en", "é", "en", "en"]
    rows = [(i, "".join(r.choice("aBcÉ \n") for _ in range(r.choice([0, 1, 9, 30]))), langs[i % 7], r.choice([None, "s", "ü"]), r.choice([None, 3, -1])) for i in range(330)]
    return rows + [(None, None, None, None, None), (None, "X", "only", None, 1), (5, None, "en", "s", None), rows[10], rows[10], (7, "A" * 300_000, "en", "s", 1)]


def expected_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: H("".join(map(field, (i, s, lang, n, t))))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order, out = sorted(groups, key=lambda g: (g is not None, (g or "").encode())), []
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, leaf(*x)))
        trees[g] = tree([leaf(*x) for x in groups[g]])
    root, upper = tree([trees[g][0] for g in order]) if order else ("", [])
    for k, g in enumerate(order):
        for x, own in zip(groups[g], trees[g][1], strict=True):
            proof = own + upper[k]
            tampered = x[0] is not None and zlib.crc32(str(x[0]).encode()) % 3 == 0 and x[1] is not None
            reached = leaf(x[0], lower(x[1]), *x[2:]) if tampered else leaf(*x)
            for left, right in proof:
                reached = H(left + reached + right)
            out.append((x[0], leaf(*x), trees[g][0], root, H("".join(left + right for left, right in proof)), reached, reached == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [0, 1, 8, 9, 64, 65, 336])
def test_manifest(spark, tmp_path, size):
    rows = rows_of_documents()[-size:] if size else []
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string, leaf int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_manifest(rows)


def test_manifest_of_equal_rows_and_one_group(spark):
    """A third of all rows are equal, all in one group; parts hold few rows, so that most parents are made across parts."""
    rows = [(k if k % 3 else -1, H(str(k if k % 3 else -1))) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, leaf string").select(F.lit("g").alias("grp"), "leaf", F.struct("k").alias("row"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    try:
        got = merkle.manifest(df, ["k"], Scratch(spark, "t"), fan=3).select("place", "leaf", "root", merkle.folded(F.col("leaf"), F.col("proof")).alias("folded"), "proof").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = [x for _, x in sorted(rows)]
    root, paths = tree(ordered, 3)
    assert [(r.place, r.leaf, r.root, r.folded, [tuple(s) for s in r.proof]) for r in sorted(got, key=lambda r: r.place)] == [(k, x, root, root, p) for k, (x, p) in enumerate(zip(ordered, paths, strict=True))]


def test_nodes_are_complete_or_ragged():
    """Every cut of a tree in two: what is complete on either side, and the ragged ends, cover each level once."""
    leaves = [H(str(k)) for k in range(70)]
    for n, cut in itertools.product([1, 2, 7, 8, 9, 63, 64, 65, 70], [0, 1, 7, 8, 9, 33, 64, 70]):
        sides = [merkle.complete(0, leaves[: min(cut, n)], n)[1] if cut else [], merkle.complete(cut, leaves[cut:n], n)[1] if cut < n else []]
        spans = sorted((i * 8**level, min((i + 1) * 8**level, n)) for side in sides for level, i, _ in side)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in itertools.pairwise(spans))


# Centroid clustering.


def vectors():
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (9, 64))
    rows = [(int(i), (centers[i % 9] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # equal vectors
    rows += [rows[7], (None, rows[9][1]), (2001, None), (2002, rows[1][1][:63]), (2003, rows[1][1] + [0.0]), (2004, [math.nan] + [0.0] * 63), (2005, [math.inf] + [0.0] * 63), (2006, [None] + [0.0] * 63), (2007, []), (2008, [0.0] * 64), (2009, [3e30] + [0.0] * 63)]
    return rows


def expected_clusters(rows, k=16, rounds=3):
    fit = lambda v: v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**21 for x in v)
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if fit(v)]
    order = sorted(kept, key=lambda x: (x[0] is None, H(f"1:{x[0]}"), x[1]))
    centroids = [v for _, v in order[:k]]
    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        groups = {}
        for (_, j), (_, v) in zip(assign(), kept, strict=True):
            groups.setdefault(j, []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = assign()
    inertia = {j: sum(d for d, other in found if other == j) for _, j in found}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), H(",".join(map(str, centroids[j])))) for (d, j), (i, _) in zip(found, kept, strict=True)), key=str)


@pytest.mark.parametrize("count", [0, 5, 16, 560])
def test_clusters(spark, tmp_path, count):
    rows = vectors()[-count:] if count else []
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clustering.op13_centroids(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == (expected_clusters(rows) if rows else [])


def test_nearest_is_exact_in_any_order():
    rng = np.random.default_rng(1)
    for spread in (2, 40, 1 << 26):  # few values give many ties
        v, c = rng.integers(-spread, spread, (500, 64)), rng.integers(-spread, spread, (16, 64))
        c[5] = c[2]
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        for _ in range(3):
            number, best = clustering.nearest(v, c, rng.permutation(64))
            assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


# Toxicity.


def insulting(n=900, seed=2):
    """(doc_id, text, toxic): prose of made words; toxic texts hold two or more of six insults or of words of two stems."""
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(900)]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.choice([20, 60, 200]))]
        toxic = int(i % 6 == 0)
        for _ in range(r.randint(2, 4) * toxic):
            words.insert(r.randrange(len(words)), r.choice(["zonk", "zarf", "zilch", "zoot", "zany", "zit", "quorv" + r.choice(plain), "xelph" + r.choice(plain)]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity(spark):
    rows = insulting()
    extra = [(5000, None), (5001, ""), (5002, " .,;"), (5003, "word " * 200_000 + "zonk zarf zoot"), (5004, "word " * 200_000), (None, "zonk zarf zoot"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t, _ in rows] + [(i, t, "k", 1) for i, t in extra], "doc_id long, text string, kind string, votes int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5001, None)], "doc_id long, toxic int")
    net, model = toxicity.learn(docs, labels, Scratch(spark, "t"))
    got = toxicity.with_scores(docs, net).collect()
    assert len(got) == len(rows) + len(extra)
    score = {r.doc_id: r.score for r in got}
    held = [(score[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95 and np.mean([s >= 0.3 for s, y in held if y]) > 0.9
    assert score[5000] == score[5001] == score[5002] < 0.3 and score[5003] > 0.3 > score[5004] and score[None] > 0.3
    assert 0.1 < model.share < 0.25


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 0), (3, 0)], 0.001)):
        net, model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), Scratch(spark, "t"))
        assert model is None and [round(r.score, 4) for r in toxicity.with_scores(docs, net).collect()] == [want, want]
    assert toxicity.with_scores(docs.limit(0), net).count() == 0


def test_label_model_finds_accuracies_and_copies():
    """Votes drawn from known rates, one voter a copy of another: rates are found, and the copy isn't counted twice."""
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.1, 0.8]])
    votes = (rng.random((len(y), 4)) < rates[:, y.astype(int)].T).astype(int)
    votes = np.concatenate([votes, votes[:, [1]]], 1)
    few = slice(0, 200)
    model = toxicity.model_of(np.stack([toxicity.pair_counts(votes[few], 1.0 * (y[few] == k)) for k in (0, 1)]), 0.2)
    for _ in range(20):
        toxic = model.posterior(votes)
        model = toxicity.model_of(np.stack([toxicity.pair_counts(votes, w) for w in (1 - toxic, toxic)]), 0.2)
    assert model.parents[4] == 1 or model.parents[1] == 4
    toxic = model.posterior(votes)
    found = np.array([[(w * votes[:, j]).sum() / w.sum() for w in (1 - toxic, toxic)] for j in range(4)])
    assert np.abs(found - rates).max() < 0.06
    alone = np.array([[0, 1, 0, 0, 1]])
    by_bayes = 0.2 * np.prod(np.where([0, 1, 0, 0], rates[:, 1], 1 - rates[:, 1]))
    none = 0.8 * np.prod(np.where([0, 1, 0, 0], rates[:, 0], 1 - rates[:, 0]))
    assert abs(model.posterior(alone)[0] - by_bayes / (by_bayes + none)) < 0.15
