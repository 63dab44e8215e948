"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, arrow_schema, table

#: Tokens of a sequence, and sequences of a window.
SEQUENCE, WINDOW = 2048, 128
#: The id that ends a document.
END = 1
#: Queues that each task knows at most. With more sources the places of their runs are a table that is joined; the pieces are the same.
QUEUES = 4096
#: Texts are tokenized in parts of so many characters, cut only where the tokenizer cuts in any case.
PART = 1 << 20
PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, window long, ids binary"


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable sign: printable Latin-1 as itself, the others, in order, as the signs from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens:
    """Ids of a byte-level BPE by its vocabulary file, the same as the tokenizers library gives without special tokens, five times as fast.

    That needs a vocabulary whose ids follow the order of its merges, so that an id is a merge's rank; others are refused.
    """

    def __init__(self, name: str):
        self.name, self.encoding = name, None

    def __getstate__(self):
        return {"name": self.name, "encoding": None}

    def _load(self):
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(self.name), encoding="utf-8") as file:
            parts = json.load(file)
        model, before = parts["model"], parts["pre_tokenizer"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if model["type"] != "BPE" or parts["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError(f"{self.name} isn't a byte-level BPE whose ids follow its merges")
        sign = byte_of_sign()
        added = {x["content"]: x["id"] for x in parts["added_tokens"]}
        ranks = {bytes(sign[c] for c in token): rank for token, rank in model["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding(self.name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def width(self) -> str:
        """The number type of an id."""
        if self.encoding is None:
            self._load()
        return "<u2" if self.encoding.max_token_value < 1 << 16 else "<u4"

    def ids(self, text: str) -> np.ndarray:
        if self.encoding is None:
            self._load()
        return np.asarray([*self._parts(text), END], "<u4")

    def _parts(self, text: str) -> Iterator[int]:
        """A long text is cut before a space that follows a letter: every pattern starts a new piece there."""
        at = 0
        while len(text) - at > PART:
            cut = at + PART
            while cut > at + 1 and not (text[cut] == " " and text[cut - 1].isalpha()):
                cut -= 1
            if cut <= at + 1:  # no such place
                break
            yield from self.encoding.encode(text[at:cut], allowed_special="all")
            at = cut
        yield from self.encoding.encode(text[at:], allowed_special="all")


def tokenized(docs: DataFrame, tokens: Tokens, scratch: Scratch) -> DataFrame:
    """doc_id, source, doc_tokens, ids (little-endian, as many bytes each as the vocabulary takes), and the document's place: part (the task) and start_in_part (tokens of its source before it there)."""
    schema = "doc_id long, source string, part int, start_in_part long, doc_tokens long, ids binary"
    kinds, width = arrow_schema(schema), tokens.width()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), {}
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                batch = whole.slice(first, 128)
                sources, starts, counts, ids = batch.column("source").to_pylist(), [], [], []
                for source, text in zip(sources, batch.column("text").to_pylist(), strict=True):
                    own = tokens.ids(text or "")
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + len(own)
                    counts.append(len(own))
                    ids.append(own.astype(width).tobytes())
                columns = [batch.column("doc_id").cast(pa.int64()), pa.array(sources, pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return scratch.keep(docs.select("doc_id", "source", "text").mapInArrow(run, schema), "tokens", compression="snappy")


class Schedule:
    """Where each token of each queue goes, by deficit round-robin with quanta in proportion to the queues' weights.

    In a round (one window) a queue earns its weight's share of the window; it sends its whole deficit counter and
    carries the fraction of a token that is left. As long as queues 1 to n have tokens, queue s so has sent
    floor(w_s * v) tokens once w_1 * v + ... + w_n * v have gone out in all. A queue that runs dry leaves its share
    to the others, by weight, so v rises faster then: a phase for each queue that ends. Deficits need no running
    state, every task computes them for its own tokens. Weights that are the queues' tokens, the default, make one
    phase: all queues end together. A window holds its queues' runs one after the other; windows follow each other
    without a gap.
    """

    def __init__(self, totals: list[int], window: int, sequence: int, weights: list[int] | None = None):
        self.totals, self.window, self.sequence, self.total = totals, window, sequence, sum(totals)
        self.weights = weights or totals
        self.rounds = -(-self.total // window)
        self.known: dict[int, tuple[list[int], int]] = {}
        tail = self.total % sequence
        self.tail_at, self.tail = self.total - tail, [1 << b for b in range(sequence.bit_length(), -1, -1) if tail >> b & 1]
        # Of each phase: v and all tokens sent at its end, tokens of the queues that ended before, weights of those that go on.
        self.ends_v, self.ends, self.ended, self.open = [], [], [], []
        done, going = 0, sum(self.weights)
        order = sorted((Fraction(n, w), n, w) for n, w in zip(totals, self.weights, strict=True) if n)
        for k, (v, n, w) in enumerate(order):
            if not self.ends_v or v > self.ends_v[-1]:
                self.ends_v.append(v)
                self.ended.append(done)
                self.open.append(going)
                self.ends.append(int(done + going * v))
            done, going = done + n, going - w

    def sent(self, queue: int, rounds: int) -> int:
        """Tokens that a queue has sent after so many rounds."""
        return self.share(self.totals[queue], rounds, self.weights[queue])

    def share(self, tokens: int, rounds: int, weight: int | None = None) -> int:
        """What a queue of so many tokens has sent after so many rounds. Its weight is its tokens unless given."""
        out = min(rounds * self.window, self.total)
        k = min(bisect_left(self.ends, out), len(self.ends) - 1)
        return min(tokens, (weight or tokens) * (out - self.ended[k]) // self.open[k])

    def runs(self, tokens: int, first: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(window, place, length): the places from `first` to `first + count` of a queue of so many tokens, whose weight they are, by the windows that send them."""
        at = first
        while at < first + count:
            reach = -(-(at + 1) * self.total // tokens)  # sent of all when the token at `at` goes out
            k = -(-reach // self.window) - 1
            end = min(self.share(tokens, k + 1), first + count)
            yield k, at, end - at
            at = end

    def starts(self, k: int) -> tuple[list[int], int]:
        """Window k: where each queue's run starts, in the order of all tokens, and the window's end."""
        if k not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            before, after = ([self.sent(s, r) for s in range(len(self.totals))] for r in (k, k + 1))
            at, starts = sum(before), []
            for a, b in zip(before, after, strict=True):
                starts.append(at)
                at += b - a
            self.known[k] = (starts, at)
        return self.known[k]

    def pieces(self, queue: int, first: int, count: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(start, length, sequence, offset, window) of the pieces of `count` tokens from place `first` of the queue."""
        done, k = 0, self.window_of(queue, first)
        while done < count:
            while self.sent(queue, k + 1) <= first + done:
                k += 1
            begin = self.sent(queue, k)
            at = self.starts(k)[0][queue] + first + done - begin
            left = min(count - done, self.sent(queue, k + 1) - first - done)
            while left:
                sequence, offset, room = self.place(at)
                n = min(left, room)
                yield done, n, sequence, offset, k
                done, at, left = done + n, at + n, left - n

    def window_of(self, queue: int, place: int) -> int:
        """The window that sends the queue's token at `place`, or one just before it."""
        v = Fraction(place, self.weights[queue])
        k = min(bisect_left(self.ends_v, v), len(self.ends_v) - 1)
        return max(0, int(self.ended[k] + self.open[k] * v) // self.window - 1)

    def place(self, at: int) -> tuple[int, int, int]:
        """(sequence, offset, room): the sequence of the token at `at` of all. What doesn't fill a sequence ends in shorter ones, each a power of two, so nothing is padded."""
        if at < self.tail_at:
            return at // self.sequence, at % self.sequence, self.sequence - at % self.sequence
        number, rest = self.tail_at // self.sequence, at - self.tail_at
        for size in self.tail:
            if rest < size:
                return number, rest, size - rest
            number, rest = number + 1, rest - size
        raise AssertionError("beyond the last token")


def pack(docs: DataFrame, tokens: Tokens, scratch: Scratch, sequence: int = SEQUENCE, window: int = WINDOW, targets: dict[str | None, int] | None = None) -> DataFrame:
    """Packs documents into sequences of `sequence` tokens: one row a piece with doc_id, source, start, length, doc_tokens, sequence_id, offset, window and ids (little-endian, 4 bytes each).

    Each source is a queue in the order in which its documents lie in the table; every window of `window`
    sequences holds all queues in their target proportions, to within one token each. `targets` gives sources whole
    numbers as weights, 1 to those it leaves out; without it the proportions are those of the sources' tokens, so
    that they hold to the end. A source that runs dry before leaves its share to the others, by weight. A
    document may be cut anywhere and its pieces lie in order. Sequences are full; the rest of the tokens, fewer
    than one sequence, goes into sequences whose lengths are powers of two, so no id is padding.

    Tokens are written once, where they were made. A source's tokens in each part (one number for a source and
    task) give every document its place in its queue; from there each task cuts its own documents. Nothing is
    ordered or moved by source, so one that holds most rows is no heavier than others. Beyond QUEUES sources the
    tokens move once, by source and window, to where the run's place in the whole is known; `targets` are for
    fewer sources.

    Null texts are empty: their document is the end id alone. Null sources are one source. Repeated rows are
    packed as often as they occur; an empty table gives no pieces. Other columns are ignored.
    """
    spark = scratch.spark
    rows = tokenized(docs, tokens, scratch)
    parts = rows.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n"))
    parts = parts.selectExpr("source", "part", "coalesce(sum(n) over (partition by source order by part rows between unbounded preceding and 1 preceding), 0) as before", "n")
    parts = scratch.keep(parts, "parts")
    names = parts.groupBy("source").agg(F.sum("n").alias("n"))
    sources = names.count()
    width = tokens.width()
    if sources > QUEUES:
        if targets:
            raise ValueError(f"targets are for {QUEUES} sources at most")
        return _pack_by_joins(rows, parts, names, sources, scratch, sequence, window * sequence, width)
    queues = names.orderBy(F.col("source").asc_nulls_last()).collect()  # QUEUES rows at most
    schedule = Schedule([r.n for r in queues], window * sequence, sequence, [targets.get(r.source, 1) for r in queues] if targets else None)
    numbers = spark.createDataFrame([(k, r.source) for k, r in enumerate(queues)], "number int, name string")
    parts = scratch.keep(parts.join(numbers, F.expr("source <=> name")).select(F.col("source").alias("of"), F.col("part").alias("at_part"), "number", "before"), "places")
    placed = rows.join(parts, F.expr("part = at_part and source <=> of")).select("doc_id", "source", "number", (F.col("before") + F.col("start_in_part")).alias("first"), "doc_tokens", "ids")
    kinds = arrow_schema(PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                out: list[tuple] = []
                for r in whole.slice(begin, 128).to_pylist():
                    ids = np.frombuffer(r["ids"], width).astype("<u4")
                    for start, n, seq, offset, k in schedule.pieces(r["number"], r["first"], r["doc_tokens"]):
                        out.append((r["doc_id"], r["source"], start, n, r["doc_tokens"], seq, offset, k, ids[start : start + n].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return placed.mapInArrow(cut, PIECES)


def _pack_by_joins(rows: DataFrame, parts: DataFrame, names: DataFrame, sources: int, scratch: Scratch, sequence: int, window: int, width: str) -> DataFrame:
    """The pieces of `pack` for any number of sources, each a queue of its own.

    A run is what a source sends in a window; only runs that hold a token are rows, so they are no more than the
    pieces. Where a run starts is a sum over windows, over blocks of neighbouring sources in its window, and over
    the sources before it in its block: no task holds all sources.
    """
    schedule = Schedule([names.agg(F.sum("n")).first()[0]], window, sequence)
    blocks = names.repartitionByRange(-(-sources // QUEUES), F.col("source").asc_nulls_last()).select("source", "n", F.spark_partition_id().alias("block"))
    blocks = scratch.keep(blocks, "blocks")
    run_schema = "name string, block int, run_window long, n long"
    run_kinds = arrow_schema(run_schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((r["source"], r["block"], k, n) for batch in batches for r in batch.to_pylist() for k, _, n in schedule.runs(r["n"], 0, r["n"]))
        while some := list(islice(made, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some, strict=True), run_kinds, strict=True)], schema=run_kinds)

    runs = scratch.keep(blocks.mapInArrow(spread, run_schema), "runs")
    cells = runs.groupBy("run_window", "block").agg(F.sum("n").alias("n"))
    before = "rows between unbounded preceding and 1 preceding"
    sizes = cells.groupBy("run_window").agg(F.sum("n").alias("n")).selectExpr("run_window", f"coalesce(sum(n) over (order by run_window {before}), 0) as ahead")  # one row a window
    cells = cells.selectExpr("run_window", "block", f"coalesce(sum(n) over (partition by run_window order by block {before}), 0) as within").join(sizes, "run_window").selectExpr("run_window", "block", "ahead + within as ahead")
    begins = runs.selectExpr("name", "block", "run_window", f"coalesce(sum(n) over (partition by run_window, block order by name nulls last {before}), 0) as within")
    begins = begins.join(cells, ["run_window", "block"]).selectExpr("name", "run_window", "ahead + within as begin")

    totals = parts.join(names.selectExpr("source as name", "n as queue_tokens"), F.expr("source <=> name")).selectExpr("source as of", "part as at_part", "before", "queue_tokens")
    placed = rows.join(totals, F.expr("part = at_part and source <=> of")).selectExpr("doc_id", "source", "before + start_in_part as first", "queue_tokens", "doc_tokens", "ids")
    slice_schema = "doc_id long, source string, start long, length long, doc_tokens long, window long, into long, ids binary"
    slice_kinds, kinds, size = arrow_schema(slice_schema), arrow_schema(PIECES), np.dtype(width).itemsize

    def slices(r: dict) -> Iterator[tuple]:
        for k, at, n in schedule.runs(r["queue_tokens"], r["first"], r["doc_tokens"]):
            start = at - r["first"]
            yield r["doc_id"], r["source"], start, n, r["doc_tokens"], k, at - schedule.share(r["queue_tokens"], k), r["ids"][size * start : size * (start + n)]

    def pieces(r: dict) -> Iterator[tuple]:
        ids, done, at = np.frombuffer(r["ids"], width).astype("<u4"), 0, r["begin"] + r["into"]
        while done < r["length"]:
            number, offset, room = schedule.place(at + done)
            n = min(r["length"] - done, room)
            yield r["doc_id"], r["source"], r["start"] + done, n, r["doc_tokens"], number, offset, r["window"], ids[done : done + n].tobytes()
            done += n

    def each(made, kinds):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for first in range(0, whole.num_rows, 128):
                    out = [x for r in whole.slice(first, 128).to_pylist() for x in made(r)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        return run

    cut = placed.mapInArrow(each(slices, slice_kinds), slice_schema)
    joined = cut.join(begins, F.expr("window = run_window and source <=> name")).select(*slice_kinds.names, "begin")
    return joined.mapInArrow(each(pieces, kinds), PIECES)


def op8_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    pieces = pack(table(spark, sf_dir, "documents"), Tokens("byte_bpe_50k.json"), Scratch(spark, "pack"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
