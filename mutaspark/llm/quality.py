"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, table

#: A chunk's bytes, and how many of them it shares with the next one.
CHUNK, OVERLAP = 512, 32
#: Learned filters, and the bytes each spans.
FILTERS, WIDTH = 24, 6
#: Labelled rows of each class that the network learns from, at most: the bound of the sample.
SAMPLE = 1500
#: Chunks of one training document that take part in one step at least; over the epochs all of its whole text do.
STEP_CHUNKS = 6
EPOCHS = 14
CUT = 0.7


@dataclass
class Network:
    """Byte embedding -> convolution -> max-pooling by chunk -> a hidden layer by chunk -> the chunks' mean -> one probability."""

    table: np.ndarray  # (WIDTH, 257, FILTERS): what byte b at place j of a filter's span adds to the filter; 256 is padding
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: float
    prior: float = 0.5  # for empty texts

    @staticmethod
    def fresh(seed: int = 7, hidden: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        # Bytes of one class start with like weights, so that a filter sees character classes before single letters.
        code = rng.normal(0, 1, (10, 8))
        kind = np.array([0 if b < 32 else 1 if b == 32 else 2 if 48 <= b < 58 else 3 if 65 <= b < 91 else 4 if 97 <= b < 123 else 5 if b >= 128 else 6 + b % 3 for b in range(256)])
        embed = np.concatenate([code[kind] + rng.normal(0, 0.5, (256, 8)), np.zeros((1, 8))])
        weights = rng.normal(0, 0.25, (WIDTH, 8, FILTERS))
        return Network(
            np.einsum("be,wef->wbf", embed, weights).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.4, (FILTERS, hidden)).astype(np.float32),
            np.zeros(hidden, np.float32), rng.normal(0, 0.3, hidden).astype(np.float32), 0.0,
        )

    def pairs(self) -> list[np.ndarray]:
        """For scoring: the sums of two neighbouring places for each pair of bytes, so that a span takes half as many look-ups."""
        return [(self.table[j][:, None, :] + self.table[j + 1][None, :, :]).reshape(257 * 257, FILTERS) for j in range(0, WIDTH, 2)]


def chunk_count(size: int) -> int:
    return max(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP))) if size else 0


def chunks(data: bytes) -> np.ndarray:
    """(n, CHUNK) overlapping chunks that cover the whole text, padded with 256. Empty texts have none."""
    if not data:
        return np.zeros((0, CHUNK), np.int32)
    step = CHUNK - OVERLAP
    padded = np.full((chunk_count(len(data)) - 1) * step + CHUNK, 256, np.int32)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def drawn(data: bytes, epoch: int, epochs: int, seed: int) -> np.ndarray:
    """The chunks of a text that take part in an epoch: all of a short one; of a long one the next of a shuffled row of all, as many as it takes to have used each by the last epoch."""
    n, step = chunk_count(len(data)), CHUNK - OVERLAP
    if n <= STEP_CHUNKS:
        return chunks(data)
    most = max(STEP_CHUNKS, -(-n // epochs))
    turn = np.random.default_rng([seed, len(data)]).permutation(n)
    picks = turn[(epoch * most + np.arange(min(most, n))) % n]
    out = np.full((len(picks), CHUNK), 256, np.int32)
    for row, k in zip(out, picks, strict=True):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - k * step), k * step)
        row[: len(part)] = part
    return out


def convolve(net: Network, pairs: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pooled, where): each filter's greatest response in each chunk, and its place."""
    places = CHUNK - WIDTH + 1
    two = block[:, :-1] * 257 + block[:, 1:]
    response = pairs[0][two[:, :places]]
    for k in range(1, len(pairs)):
        response += pairs[k][two[:, 2 * k : 2 * k + places]]
    where = response.argmax(axis=1)
    return np.take_along_axis(response, where[:, None, :], 1)[:, 0] + net.bias, where


def pooled_max(net: Network, pairs: list[np.ndarray], block: np.ndarray) -> np.ndarray:
    places = CHUNK - WIDTH + 1
    two = block[:, :-1] * 257 + block[:, 1:]
    response = pairs[0].take(two[:, :places], axis=0)
    for k in range(1, len(pairs)):
        response += pairs[k].take(two[:, 2 * k : 2 * k + places], axis=0)
    return response.max(axis=1) + net.bias


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def head(net: Network, pooled: np.ndarray) -> np.ndarray:
    """A logit for each chunk."""
    return np.tanh(np.maximum(pooled, 0) @ net.hidden + net.hidden_bias) @ net.out


def score(net: Network, pairs: list[np.ndarray], texts: list[str | None], most: int = 32) -> np.ndarray:
    """The probability of label 1 for each whole text; `most` chunks are held at once."""
    out = np.full(len(texts), net.prior)
    queue: list[np.ndarray] = []
    owner: list[int] = []
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))

    def flush():
        if queue:
            logits = head(net, pooled_max(net, pairs, np.stack(queue)))
            np.add.at(sums, owner, logits)
            np.add.at(counts, owner, 1)
            queue.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for chunk in chunks((text or "").encode("utf-8", "replace")):
            queue.append(chunk)
            owner.append(i)
            if len(queue) == most:
                flush()
    flush()
    some = counts > 0
    out[some] = sigmoid(sums[some] / counts[some] + net.out_bias)
    return out


def train(docs: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network from whole texts, by Adam on the log loss. Each step takes chunks of each of 64 documents; over all epochs every chunk takes part. Labels of one class alone, or none, give a network that scores their share whatever the text."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(seed)
    keep = [i for i, d in enumerate(docs) if len(d)]
    labels = np.asarray(labels, np.float32)
    net.prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    if not keep or labels.min() == labels.max():
        net.out[:], net.out_bias = 0, float(np.log(net.prior / (1 - net.prior)))
        return net
    params = [net.table, net.bias, net.hidden, net.hidden_bias, net.out, np.zeros(1, np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(keep)
        for start in range(0, len(order), 64):
            batch = order[start : start + 64]
            picks = [drawn(docs[i], epoch, epochs, seed) for i in batch]
            block, owner = np.concatenate(picks), np.repeat(np.arange(len(batch)), [len(p) for p in picks])
            share = (1 / np.bincount(owner))[owner][:, None].astype(np.float32)
            pooled, where = convolve_plain(net, block)
            active = np.maximum(pooled, 0)
            hid = np.tanh(active @ net.hidden + net.hidden_bias)
            logit = np.bincount(owner, (hid @ net.out) * share[:, 0], len(batch)) + params[5][0]
            wrong = ((sigmoid(logit) - labels[batch]) / len(batch)).astype(np.float32)
            by_chunk = wrong[owner][:, None] * share
            d_hid = by_chunk * net.out * (1 - hid**2)
            d_pool = (d_hid @ net.hidden.T) * (pooled > 0)
            d_table = np.zeros_like(net.table)
            rows = np.arange(len(block))[:, None]
            cols = np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                np.add.at(d_table[j], (block[rows, where + j], cols), d_pool)
            d_table[:, 256] = 0
            grads = [d_table + 1e-5 * net.table, d_pool.sum(0), active.T @ d_hid, d_hid.sum(0), (by_chunk * hid).sum(0), np.array([wrong.sum()], np.float32)]
            t += 1
            for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)
    net.out_bias = float(params[5][0])
    return net


def convolve_plain(net: Network, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As convolve, without tables of pairs, which change with every step of training; a few chunks at a time."""
    places, pooled, where = CHUNK - WIDTH + 1, [], []
    for part in np.array_split(block, max(1, len(block) // 48)):
        response = net.table[0].take(part[:, :places], axis=0)
        for j in range(1, WIDTH):
            response += net.table[j].take(part[:, j : j + places], axis=0)
        at = response.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0] + net.bias)
    return np.concatenate(pooled), np.concatenate(where)


def held_out(doc_id) -> F.Column:
    """Rows that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Network:
    """A network from at most `per_class` labelled rows of each class that aren't held out, picked by a hash of doc_id.

    The sample is drawn from labels, whose rows are small, and its bounded list of doc_ids is broadcast to the texts,
    of which the sample's go to the driver whole.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    some = [rows.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(per_class) for k in (0, 1)]
    picked = some[0].union(some[1]).dropDuplicates(["doc_id"])

    def raw(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "raw": [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]}

    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    sample = map_arrow(chosen, raw, "doc_id long, quality int, raw binary").toPandas().sort_values(["doc_id", "raw"])
    share = rows.agg(F.avg("quality")).first()[0]
    net = train([bytes(x) for x in sample["raw"]], sample["quality"].to_numpy())
    if share is not None and len(sample):
        # The sample holds the classes in other proportions than the labels do; Bayes' rule moves the log odds by as much.
        clip = lambda p: float(np.clip(p, 0.01, 0.99))
        odds = lambda p: np.log(clip(p) / (1 - clip(p)))
        net.out_bias += odds(share) - odds(sample["quality"].mean())
        net.prior = clip(share)
    return net


def with_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of each document's whole text, in one pass without a shuffle.

    Null and empty texts have the labels' share of 1 as their score, 0.5 where there are no labels; repeated rows
    each have a row; an empty table gives none; other columns are ignored. The network (200 KB) goes with the tasks.
    """

    state: dict = {}

    def scored(batch: pa.RecordBatch):
        if not state:
            state["pairs"] = net.pairs()
        yield {"doc_id": batch.column("doc_id"), "score": score(net, state["pairs"], batch.column("text").to_pylist())}

    return map_arrow(docs.select("doc_id", "text"), scored, "doc_id long, score double")


def accepted(docs: DataFrame, net: Network, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose whole text scores `cut` or more. One pass; rows aren't moved."""
    state: dict = {}

    def good(batches):
        if not state:
            state["pairs"] = net.pairs()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                yield batch.filter(pa.array(score(net, state["pairs"], batch.column("text").to_pylist()) >= cut))

    return docs.mapInArrow(good, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    net = learn(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
