"""Toxicity by weak supervision: voters, a generative model of their votes, and a linear classifier learned from its posteriors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out, sigmoid
from .shared import Scratch, map_arrow, table

#: Labelled rows of each class that lexicons and classifier are fitted on, at most: the bound of the sample.
SAMPLE = 1500
#: What is seen of a word: all of it, its first letters, its last ones.
KINDS = ("word", "head4", "head5", "tail5")
#: Lexicons that the entries of each kind are dealt to; each is a voter.
LISTS = 4
#: How much the labels must speak for an entry (log-likelihood ratio), how many times as frequent it must be in toxic texts, in how many texts it stands at least, and entries of all lexicons at most.
EVIDENCE, TIMES, LEAST_TEXTS, ENTRIES = 15.0, 8, 3, 4096
#: Features that the classifier may weigh: those of the sample that stand in LEAST_TEXTS of its texts, by evidence.
FEATURES = 8192
CUT = 0.3

WORD_OF = re.compile(r"\w+")
#: Patterns that vote whatever the language; what each is worth is left to the label model.
PATTERNS = {
    "shouted": re.compile(r"(?:\b[A-Z]{3,}\b\W+){2}\b[A-Z]{3,}\b"),
    "insisted": re.compile(r"[!?]{3,}"),
    "masked": re.compile(r"\b\w+[*#@$]{2,}\w*"),
    "addressed": re.compile(r"\b(?:you|u)(?:'re| are| r)? (?:an? |such |all )?\w+[.!]", re.IGNORECASE),
}
#: Beside them: entries of how many lexicons must be found for "many" to vote.
MANY = 3


def seen(word: str) -> Iterator[tuple[int, str]]:
    """(kind, feature) of a word in lower case."""
    yield 0, word
    if len(word) >= 4:
        yield 1, word[:4]
    if len(word) >= 5:
        yield 2, word[:5]
        yield 3, word[-5:]


def words_of(text: str | None) -> set[str]:
    return set(WORD_OF.findall((text or "").lower()))


@dataclass
class Voters:
    """Lexicons by kind, dealt to lists by a checksum of the entry, and patterns. A vote is a bit: fired or not."""

    entries: dict[tuple[int, str], int] = field(default_factory=dict)  # feature -> its voter

    @staticmethod
    def of(entries: list[tuple[int, str]]) -> Voters:
        return Voters({(k, f): k * LISTS + zlib.crc32(f.encode()) % LISTS for k, f in entries})

    @property
    def count(self) -> int:
        return len(KINDS) * LISTS + len(PATTERNS) + 1

    def votes(self, text: str | None, words: set[str]) -> int:
        """The bits of all voters for one whole text."""
        hit = {self.entries[x] for w in words for x in seen(w) if x in self.entries}
        bits = sum(1 << v for v in hit)
        first = len(KINDS) * LISTS
        for j, pattern in enumerate(PATTERNS.values()):
            bits |= (pattern.search(text or "") is not None) << (first + j)
        return bits | (len(hit) >= MANY) << (first + len(PATTERNS))


@dataclass
class LabelModel:
    """P(toxic), and for each class a tree of voters: how often each fires given its class and its parent's vote.

    A voter's accuracy is read off its own rates, its correlation with another off the tree's edge between them; the
    tree is the maximum spanning tree of conditional mutual information, so the strongest correlations are kept and
    agreeing copies of one voter count once.
    """

    share: float
    parents: list[int]
    fires: np.ndarray  # (voter, class, parent's vote)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) given rows of votes (n x voters)."""
        logs = np.log([1 - self.share, self.share])[None, :].repeat(len(votes), 0)
        for j, parent in enumerate(self.parents):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            p = self.fires[j][:, given].T
            logs += np.log(np.where(votes[:, [j]] == 1, p, 1 - p))
        return sigmoid(logs[:, 1] - logs[:, 0])


def pair_counts(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(voter, voter, vote, vote): how much weight has each pair of votes."""
    one = votes.astype(float)
    both = np.stack([1 - one, one])
    return np.einsum("anj,n,bnk->jkab", both, weight, both)


def model_of(counts: np.ndarray, share: float) -> LabelModel:
    """The model of greatest likelihood for expected counts (class, voter, voter, vote, vote) and a known share of toxic texts."""
    voters = counts.shape[1]
    weight = counts[:, 0, 0].sum((1, 2))
    smooth = counts + 0.25
    joint = smooth / smooth.sum((3, 4), keepdims=True)
    single = joint.sum(4)  # of the first voter of a pair
    independent = single[..., :, None] * joint.sum(3)[..., None, :]
    shares = weight / max(weight.sum(), 1e-9)
    told = (shares[:, None, None] * (joint * np.log(joint / independent)).sum((3, 4))).sum(0)
    parents, near = [-1] * voters, {j: (told[j, 0], 0) for j in range(1, voters)}
    while near:  # Prim's algorithm
        j = max(near, key=lambda x: (near[x][0], -x))
        parents[j] = near.pop(j)[1]
        for x in near:
            near[x] = max(near[x], (told[x, j], j))
    fires = np.empty((voters, 2, 2))
    for j, parent in enumerate(parents):
        for y in range(2):
            if parent < 0:
                fires[j, y] = single[y, j, j, 1]
            else:
                fires[j, y] = joint[y, parent, j, :, 1] / joint[y, parent, j].sum(1)
    return LabelModel(float(np.clip(share, 1e-4, 1 - 1e-4)), parents, np.clip(fires, 1e-4, 1 - 1e-4))


def bits_of(votes, voters: int) -> np.ndarray:
    return (np.asarray(votes, np.int64)[:, None] >> np.arange(voters)) & 1


def label_model(patterns: DataFrame, voters: int, share: float, known: np.ndarray, rounds: int = 12) -> LabelModel:
    """Expectation maximisation over vote patterns (votes long, n long) of all texts, labels unseen.

    known: pair counts by class of the few texts whose labels are known. They are the first estimate, and after it a
    prior as heavy as the texts themselves in either class, so that the hidden class stays what labels call toxic and
    doesn't become, say, the length of texts. A round is a job: tasks add up pair counts under the model at hand, and
    2 * voters² * 4 sums come back.
    """
    weight = lambda counts: np.maximum(counts[:, 0, 0].sum((1, 2)), 1e-9)[:, None, None, None, None]
    model = model_of(known / weight(known) * np.array([1 - share, share])[:, None, None, None, None] * weight(known).sum(), share)
    for _ in range(rounds):

        def expect(batches, model=model):
            total = np.zeros((2, voters, voters, 2, 2))
            for batch in batches:
                raw, n = batch.column("votes").to_numpy(), batch.column("n").to_numpy().astype(float)
                v = bits_of(raw, voters)
                toxic = model.posterior(v)
                total += np.stack([pair_counts(v, n * (1 - toxic)), pair_counts(v, n * toxic)])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int32()), "x": total.ravel()})

        sums = patterns.mapInArrow(expect, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(2 * voters * voters * 4)
        for r in sums:
            counts[r.at] = r.x
        counts = counts.reshape(2, voters, voters, 2, 2)
        now = model_of(counts + known / weight(known) * weight(counts), share)
        done = now.parents == model.parents and np.abs(now.fires - model.fires).max() < 1e-3
        model = now
        if done:
            break
    return model


@dataclass
class Linear:
    """A logistic model over the features that a text has."""

    weights: dict[tuple[int, str], float]
    bias: float

    def scores(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """P(toxic) of whole texts. known: what words seen before weigh; the caller keeps it from growing."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            total = self.bias
            for w in words_of(text):
                weight = known.get(w)
                if weight is None:
                    weight = known[w] = sum(self.weights.get(x, 0.0) for x in seen(w))
                total += weight
            out[i] = total
        return sigmoid(out)


def fit(indices: list[np.ndarray], target: np.ndarray, features: int, penalty: float = 5e-4, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of least log loss against soft labels plus `penalty` times the weights' absolute sum, by accelerated proximal steps."""
    lengths = np.array([len(x) for x in indices])
    flat, owner = np.concatenate([*indices, np.zeros(0, int)]).astype(int), np.repeat(np.arange(len(indices)), lengths)
    weights, bias, ahead, ahead_bias, t = np.zeros(features), 0.0, np.zeros(features), 0.0, 1.0
    # The loss is a quarter as steep as the features' Gram matrix: a bound of its largest eigenvalue by power iteration.
    v = np.ones(features)
    for _ in range(12):
        u = np.bincount(owner, v[flat], len(indices))
        v = np.bincount(flat, u[owner], features)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    rate = len(indices) / (0.3 * (norm + len(indices)))
    for _ in range(steps):
        wrong = (sigmoid(np.bincount(owner, ahead[flat], len(indices)) + ahead_bias) - target) / len(indices)
        moved = ahead - rate * np.bincount(flat, wrong[owner], features)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new_bias = ahead_bias - rate * wrong.sum()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / later * (new - weights), new_bias + (t - 1) / later * (new_bias - bias)
        weights, bias, t = new, new_bias, later
    return weights, bias


def evidence(toxic, clean, all_toxic: int, all_clean: int):
    """Log-likelihood ratio of a feature's counts against equal rates in both classes; negative where clean texts have it more often."""
    n, share = toxic + clean, all_toxic / (all_toxic + all_clean)
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    one_way = term(toxic, n * share) + term(clean, n * (1 - share))
    none = term(all_toxic - toxic, (all_toxic + all_clean - n) * share) + term(all_clean - clean, (all_toxic + all_clean - n) * (1 - share))
    return 2 * (one_way + none) * F.when(toxic > n * share, 1).otherwise(-1)


def outline(text: str | None, sizes: int = 4) -> list[int]:
    """Smallest hashes of a text's runs of three words under a few hash functions: copies with few changes share one."""
    w = WORD_OF.findall((text or "").lower())
    runs = np.array([zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 2))], np.uint64)
    return [int(((runs * np.uint64(2 * k + 0x9E3779B1) + np.uint64(k * 0x85EBCA6B)) % np.uint64((1 << 31) - 1)).min()) for k in range(sizes)]


def sampled(docs: DataFrame, labels: DataFrame, per_class: int, scratch: Scratch) -> DataFrame:
    """(doc_id, toxic, text) of at most `per_class` labelled rows of each class that aren't held out, picked by a hash of doc_id; of near copies among them one stays, as copies would lend their words the weight of many texts.

    The bounded lists of ids are broadcast to the texts.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    some = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class) for k in (0, 1)]
    drawn = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1]).dropDuplicates(["doc_id"])), "doc_id").select("doc_id", "toxic", "text")
    drawn = scratch.keep(drawn, "drawn")

    def outlined(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "outline": [outline(t) for t in batch.column("text").to_pylist()]}

    seen_before, ids = set(), []
    for r in sorted(map_arrow(drawn, outlined, "doc_id long, toxic int, outline array<long>").collect()):
        own = {(r.toxic, k, x) for k, x in enumerate(r.outline)}
        if not own & seen_before:
            ids.append((r.doc_id,))
        seen_before |= own
    return drawn.join(F.broadcast(scratch.spark.createDataFrame(ids, "doc_id long").distinct()), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, per_class: int = SAMPLE) -> tuple[Linear, LabelModel | None]:
    """A classifier, and the label model that taught it.

    Labels choose the lexicons and give the label model its first estimate, on a bounded sample. The model then sees
    the votes on all texts that aren't held out. The classifier learns the posteriors of the sample's texts, not their labels; Bayes' rule
    moves its log odds from the sample's proportions to the labels'. Without labels of both classes there is no
    model, and every text scores the labels' share of 1, or 0.5 without any label.
    """
    counts = {r.toxic: r.n for r in labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    clip = lambda p: float(np.clip(p, 1e-3, 1 - 1e-3))
    odds = lambda p: float(np.log(clip(p) / (1 - clip(p))))
    sample = scratch.keep(sampled(docs, labels, per_class, scratch), "sample")
    of_class = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(of_class) < 2:
        return Linear({}, odds(share) if counts else 0.0), None

    def features(batch: pa.RecordBatch):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = list({x for w in words_of(text) for x in seen(w)})
            yield {"kind": [k for k, _ in own], "feature": [f for _, f in own], "toxic": [toxic] * len(own)}

    each = map_arrow(sample, features, "kind int, feature string, toxic int")
    table_of = each.groupBy("kind", "feature").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    told = table_of.withColumn("told", evidence(F.col("toxic"), F.col("n") - F.col("toxic"), of_class[1], of_class[0]))
    top = told.orderBy(F.abs("told").desc(), "kind", "feature").limit(FEATURES).collect()
    often = lambda r: (r.toxic + 0.5) / of_class[1] >= TIMES * (r.n - r.toxic + 0.5) / of_class[0]
    voters = Voters.of([(r.kind, r.feature) for r in top if r.told >= EVIDENCE and often(r)][:ENTRIES])

    def vote(batch: pa.RecordBatch):
        yield {"votes": [voters.votes(t, words_of(t)) for t in batch.column("text").to_pylist()]}

    place = {(r.kind, r.feature): i for i, r in enumerate(top)}

    def taught(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        own = [words_of(t) for t in texts]
        at = [sorted({place[x] for w in ws for x in seen(w) if x in place}) for ws in own]
        yield {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "votes": [voters.votes(t, w) for t, w in zip(texts, own, strict=True)], "at": at}

    rows = sorted(map_arrow(sample, taught, "doc_id long, toxic int, votes long, at array<int>").collect())  # per_class * 2 rows of FEATURES numbers at most, repeated rows aside
    votes, toxic = bits_of([r.votes for r in rows], voters.count), np.array([r.toxic for r in rows])
    seen_texts = docs.where(~held_out(F.col("doc_id"))).select("text")
    patterns = scratch.keep(map_arrow(seen_texts, vote, "votes long").groupBy("votes").agg(F.count("*").alias("n")), "votes")
    model = label_model(patterns, voters.count, share, np.stack([pair_counts(votes, 1.0 * (toxic == y)) for y in range(2)]))
    target = model.posterior(votes)
    weights, bias = fit([np.array(r.at, int) for r in rows], target, len(top))
    # What posteriors say of all texts, with the labels' share as their common ground, against what they say of the sample.
    bias += odds(share) - odds(of_class[1] / sum(of_class.values()))
    scratch.drop("votes", "sample", "drawn")
    return Linear({(r.kind, r.feature): float(w) for r, w in zip(top, weights, strict=True) if w}, bias), model


def with_scores(docs: DataFrame, net: Linear) -> DataFrame:
    """doc_id and score of each document's whole text, in one pass without a shuffle.

    Null and empty texts, and texts without words, score the classifier's bias; repeated rows each have a row; an
    empty table gives none; other columns are ignored. The weights (FEATURES of them at most) go with the tasks.
    """
    known: dict[str, float] = {}

    def scored(batch: pa.RecordBatch):
        if len(known) > 200_000:  # so that a task's memory doesn't follow the vocabulary
            known.clear()
        yield {"doc_id": batch.column("doc_id"), "score": net.scores(batch.column("text").to_pylist(), known)}

    return map_arrow(docs.select("doc_id", "text"), scored, "doc_id long, score double")


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, taught by voters whose lexicons come from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    net, _ = learn(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))
    return with_scores(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
