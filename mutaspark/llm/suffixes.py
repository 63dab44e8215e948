"""Removal of passages that occur more than once: sampled suffixes, range-partitioned by their leading bytes and sorted in each bucket by multikey quicksort."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import each_group, repeated
from .near_dedup import BYTE, STEP, mix
from .shared import Scratch, map_arrow, table

#: Bytes of a passage, and of the gram that a suffix's leading bytes are grouped by.
PASSAGE, GRAM = 400, 24
#: Bytes handled at once; longer texts go in overlapping pieces.
PIECE = 1 << 18
#: Suffixes of one gram that are sorted in one task, some 4 MB; the passages of grams with more are cut finer.
GROUP = 4096
#: How many neighbouring passages a frequent gram's suffixes are cut into, again and again.
LEVELS = (64, 8, 1)
#: Sorted neighbours up to so many are compared with each other one by one.
FEW = 12
SPANS = "array<struct<from: long, to: long>>"
PLACE = np.uint64((1 << 24) - 1)
BASE = STEP | np.uint64(1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the rolling hash's base and of its inverse modulo 2**64, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            full = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]))
            cls.up, cls.down = full(BASE), full(INVERSE)
        return cls.up[:n], cls.down[:n]


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each place."""
    up, down = Powers.to(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * up, dtype=np.uint64)])
    return mix((total[width:] - total[:-width]) * down[: len(data) - width + 1])


def sampled_suffixes(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, key, anchor, first, last) of the sampled suffixes of texts that lie end to end in data; places count from each text's start.

    A passage of 400 bytes is represented by the gram in it that hashes lowest, the leftmost of equals: equal
    passages have it at the same place, so all places where a passage starts meet under one gram. A suffix is
    sampled if it starts with some passage's gram; first and last are the starts of the passages it stands for.
    """
    n, wide = len(data), PASSAGE - GRAM + 1
    if n < PASSAGE:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    raw = np.frombuffer(data, np.uint8)
    h = grams(raw, GRAM)
    value = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.concatenate([value, np.full(-len(value) % wide, ~np.uint64(0))]).reshape(-1, wide)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - PASSAGE + 1
    anchor = (np.minimum(after[:starts], before[wide - 1 : wide - 1 + starts]) & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = np.flatnonzero(text[:starts] == text[PASSAGE - 1 :])
    if not len(valid):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    a, t = anchor[valid], text[valid]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
    last = np.concatenate([new[1:], [len(a)]]) - 1
    base = bounds[t[new]]
    return t[new], h[a[new]].view(np.int64), a[new] - base, valid[new] - base, valid[last] - base


def batches_of(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """(numbers, offsets, data, bounds): texts end to end, PIECE bytes at once; a longer text in pieces that share all but one start of a passage."""
    held: list[int] = []
    size = 0

    def flush():
        return held, [0] * len(held), b"".join(texts[i] for i in held), np.concatenate([[0], np.cumsum([len(texts[i]) for i in held])])

    for i, text in enumerate(texts):
        if len(text) < PASSAGE:
            continue
        if len(text) > PIECE:
            for at in range(0, len(text) - PASSAGE + 1, PIECE - PASSAGE + 1):
                part = text[at : at + PIECE]
                yield [i], [at], part, np.array([0, len(part)])
            continue
        if size + len(text) > PIECE:
            yield flush()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        yield flush()


#: A sampled suffix in a text's list: its gram's key, its place, and the starts it stands for.
SUFFIX = np.dtype([("key", "<i8"), ("anchor", "<u4"), ("first", "<u4"), ("last", "<u4")])


def listed(texts: list[bytes]) -> list[bytes]:
    """Each text's sampled suffixes, packed."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for numbers, offsets, data, bounds in batches_of(texts):
        t, key, anchor, first, last = sampled_suffixes(data, bounds)
        cuts = np.searchsorted(t, np.arange(len(numbers) + 1))
        for k, (i, at) in enumerate(zip(numbers, offsets, strict=True)):
            s = slice(cuts[k], cuts[k + 1])
            rows = np.empty(s.stop - s.start, SUFFIX)
            rows["key"], rows["anchor"], rows["first"], rows["last"] = key[s], anchor[s] + at, first[s] + at, last[s] + at
            out[i].append(rows)
    return [np.concatenate(x).tobytes() if x else b"" for x in out]


def multikey_quicksort(strings: list[bytes]) -> list[int]:
    """Order of strings by multikey quicksort (Bentley and Sedgewick, 1997), eight bytes a key, small parts by a plain sort."""
    most = max(map(len, strings), default=0)
    words = -(-max(most, 1) // 8)
    matrix = np.frombuffer(b"".join(s.ljust(words * 8, b"\0") for s in strings), ">u8").reshape(len(strings), words).astype(np.uint64)
    out: list[int] = []
    todo = [(np.arange(len(strings)), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) <= 24 or depth == words:
            out += sorted(part.tolist(), key=lambda i: (strings[i], i))
            continue
        column = matrix[part, depth]
        pivot = column[len(column) // 2]
        less, more = column < pivot, column > pivot
        todo += [(x, d) for x, d in ((part[more], depth), (part[~less & ~more], depth + 1), (part[less], depth)) if len(x)]
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def repeated_starts(contexts: list[bytes], offsets: list[int]) -> list[list[tuple[int, int]]]:
    """Of each context, the ranges (first, last) of starts whose passage also starts in another context.

    A context is the bytes of all passages that a sampled suffix stands for; the suffix starts at its offset. Two
    contexts that agree in L bytes left of their suffixes and R bytes of the suffixes share the passages that
    start d bytes before them, for d from 400 - R to L.

    The suffixes are sorted; what one shares with any other, it shares with a neighbour. Neighbours that share less
    than a gram end a run, and a run's members are compared with each other only.
    """
    raw = [np.frombuffer(c, np.uint8) for c in contexts]
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    order = multikey_quicksort([c[o:] for c, o in zip(contexts, offsets, strict=True)])
    shared = [common(raw[i][offsets[i] :], raw[j][offsets[j] :]) for i, j in zip(order, order[1:], strict=False)]
    begin = 0
    for end in range(1, len(order) + 1):
        if end < len(order) and shared[end - 1] >= GRAM:
            continue
        run, reach = order[begin:end], shared[begin : end - 1]
        begin = end
        if len(run) > FEW:
            _by_class(run, reach, raw, offsets, found)
            continue
        for i, one in enumerate(run):
            right = PASSAGE
            for j in range(i + 1, len(run)):
                two, right = run[j], min(right, reach[j - 1])
                if right < PASSAGE - offsets[one]:  # and no later one shares more
                    break
                left = common(raw[one][: offsets[one]][::-1], raw[two][: offsets[two]][::-1])
                if PASSAGE - right <= left:
                    for k in (one, two):
                        found[k].append((offsets[k] - left, offsets[k] - (PASSAGE - right)))
    return found


def _by_class(run: list[int], reach: list[int], raw: list[np.ndarray], offsets: list[int], found: list[list[tuple[int, int]]]) -> None:
    """The ranges of a longer run of sorted suffixes, added to `found`: starts at one distance whose passages hash alike are classes, and each member's bytes are compared with those of its class's first."""
    ends = np.array([0, *reach, 0])
    most = np.maximum(ends[:-1], ends[1:])  # the longest prefix that a suffix shares with any other
    owner, start, digest = [], [], []
    some = [(i, int(r)) for i, r in zip(run, most, strict=True) if offsets[i] >= PASSAGE - r]
    for at in range(0, len(some), 2048):
        part = some[at : at + 2048]
        bounds = np.concatenate([[0], np.cumsum([len(raw[i]) for i, _ in part])])
        hashes = grams(np.concatenate([raw[i] for i, _ in part]), PASSAGE)
        for k, (i, r) in enumerate(part):
            stop = min(len(raw[i]) - PASSAGE, offsets[i] - max(0, PASSAGE - r))  # starts nearer to the suffix need more of it than is shared
            own = np.arange(stop + 1)
            owner.append(np.full(len(own), i))
            start.append(own)
            digest.append(mix(hashes[bounds[k] + own] + (offsets[i] - own).astype(np.uint64) * STEP))
    if not owner:
        return
    owner, start = np.concatenate(owner), np.concatenate(start)
    strings = lambda: np.array([b"%d:" % (offsets[i] - p) + raw[i][p : p + PASSAGE].tobytes() for i, p in zip(owner, start, strict=True)], object)
    if not _classes(np.concatenate(digest), owner, start, raw, found):
        _classes(np.unique(strings(), return_inverse=True)[1], owner, start, raw, found)


def _classes(digest: np.ndarray, owner: np.ndarray, start: np.ndarray, raw: list[np.ndarray], found: list[list[tuple[int, int]]]) -> bool:
    """Adds the starts whose digest occurs more than once to `found`, in ranges; False, and nothing added, if bytes differ under one digest."""
    _, first, back, count = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[back] > 1)
    if not len(hit):
        return True
    o, s, lead = owner[hit], start[hit], first[back[hit]]
    breaks = (np.diff(o) != 0) | (np.diff(s) != 1) | (np.diff(owner[lead]) != 0) | (np.diff(start[lead]) != 1)
    ranges = []
    for piece in np.split(np.arange(len(hit)), np.flatnonzero(breaks) + 1):
        k, a, b = int(o[piece[0]]), int(s[piece[0]]), int(s[piece[-1]])
        of, at = int(owner[lead[piece[0]]]), int(start[lead[piece[0]]])
        if not np.array_equal(raw[k][a : b + PASSAGE], raw[of][at : at + b - a + PASSAGE]):
            return False
        ranges.append((k, a, b))
    for k, a, b in ranges:
        found[k].append((a, b))
    return True


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def repeated_passages(docs: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (half-open byte ranges to remove).

    A byte goes if a 400-byte string over it also starts elsewhere in the same or another document, judged on the
    input. Equal texts are handled once: with 400 bytes or more, all of them goes. Of other texts about one suffix
    in 190 bytes is sampled (see sampled_suffixes), suffixes whose gram occurs once are dropped, and the rest is
    brought together with the bytes around it: Spark samples splitters and range-partitions by the suffixes'
    leading bytes, so that a gram lies in one bucket and no run crosses a boundary; buckets sort each gram's
    suffixes and compare neighbours, byte by byte. A gram with more suffixes than `group` would make its bucket too
    large: its passages are cut finer (see _of_frequent), with the same result.

    Null texts count as empty; texts under 400 bytes lose nothing; rows repeated, even with one doc_id, are copies
    of each other; doc_id may be null. An empty table gives no rows. Other columns are ignored.
    """

    def first(batch: pa.RecordBatch):
        texts = utf8(batch.column("text").to_pylist())
        digests = [hashlib.sha256(t) for t in texts]
        yield {"doc_id": batch.column("doc_id"), "text_id": [d.digest()[:16] for d in digests], "n_bytes": [len(t) for t in texts], "sha256": [d.hexdigest() for d in digests], "suffixes": listed(texts)}

    rows = map_arrow(docs.select("doc_id", "text"), first, "doc_id long, text_id binary, n_bytes long, sha256 string, suffixes binary", rows=512)
    rows = scratch.keep(rows, "rows", compression="snappy")
    long = rows.where(f"n_bytes >= {PASSAGE}")
    texts = long.groupBy("text_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("suffixes").alias("suffixes"))
    texts = scratch.keep(texts, "texts", compression="snappy")

    def unpacked(batch: pa.RecordBatch):
        lists = [np.frombuffer(s, SUFFIX) for s in batch.column("suffixes").to_pylist()]
        every = np.concatenate(lists) if lists else np.zeros(0, SUFFIX)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        yield {"text_id": batch.column("text_id").take(pa.array(owner)), **{c: every[c].astype(np.int64) for c in ("key", "anchor", "first", "last")}}

    suffixes = map_arrow(texts.select("text_id", "suffixes"), unpacked, "text_id binary, key long, anchor long, first long, last long", rows=1024)
    met = repeated(suffixes, "key", scratch, "keys")
    by_text = met.groupBy("text_id").agg(F.collect_list(F.struct("key", "anchor", "first", "last", "n_key")).alias("met"))
    by_text = scratch.keep(by_text, "met", compression="snappy")

    def packed(batch: pa.RecordBatch):
        found = utf8(batch.column("text").to_pylist())
        yield {"doc": batch.column("doc_id"), "id": [hashlib.sha256(t).digest()[:16] for t in found], "packed": [pa.compress(t, codec="zstd", asbytes=True) for t in found], "size": [len(t) for t in found]}

    whole = map_arrow(docs.where(F.octet_length("text") >= PASSAGE).select("doc_id", "text"), packed, "doc long, id binary, packed binary, size long")
    wanted = by_text.join(texts.select("text_id", "rep"), "text_id")
    held = whole.join(wanted, (whole.id == wanted.text_id) & whole.doc.eqNullSafe(wanted.rep)).select("text_id", "packed", "size", "met").dropDuplicates(["text_id"])
    held = scratch.keep(held, "held", compression="snappy")

    def contexts(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("lead", "key", "text_id", "first", "offset", "context")}
        for r in batch.to_pylist():
            text = None
            for m in r["met"]:
                if m["n_key"] <= group:
                    text = text if text is not None else pa.decompress(r["packed"], r["size"], codec="zstd", asbytes=True)
                    a = m["anchor"]
                    row = (text[a : a + GRAM], m["key"], r["text_id"], m["first"], a - m["first"], text[m["first"] : m["last"] + PASSAGE])
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
        yield out

    contexts = map_arrow(held, contexts, "lead binary, key long, text_id binary, first long, offset long, context binary", rows=32)

    def compared(g: pa.Table):
        first, offset, ids = g.column("first").to_pylist(), g.column("offset").to_pylist(), g.column("text_id").to_pylist()
        ranges = repeated_starts(g.column("context").to_pylist(), offset)
        out = [(ids[i], first[i] + a, first[i] + b + PASSAGE) for i, own in enumerate(ranges) for a, b in own]
        if out:
            yield dict(zip(("text_id", "from", "to"), map(list, zip(*out, strict=True)), strict=True))

    spans = each_group(contexts, ["lead", "key"], compared, "text_id binary, from long, to long", ranged=True)
    spans = spans.groupBy("text_id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    frequent = held.where(F.exists("met", lambda m: m["n_key"] > group))
    if not frequent.isEmpty():
        spans = spans.union(_of_frequent(frequent, group, scratch)).groupBy("text_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = scratch.keep(spans, "spans", compression="snappy")

    schema = "id binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"

    def cut_out(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("id", "n_removed", "n_spans", "kept_sha256", "spans")}
        for r in batch.to_pylist():
            text = pa.decompress(r["packed"], r["size"], codec="zstd", asbytes=True)
            gone = merged([(s["from"], s["to"]) for s in r["spans"]])
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            row = (r["text_id"], sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"start": a, "end": b} for a, b in gone])
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        yield out

    done = map_arrow(held.select("text_id", "packed", "size").join(spans, "text_id"), cut_out, schema, rows=64)
    done = scratch.keep(done, "done", compression="snappy")
    known = texts.select("text_id", "copies").join(done, F.col("text_id") == F.col("id"), "left").drop("id").withColumnRenamed("text_id", "id")
    out = rows.select("doc_id", "text_id", "n_bytes", "sha256").join(known, F.col("text_id") == F.col("id"), "left")
    all_of_it = "coalesce(copies, 1) > 1"
    out = out.selectExpr(
        "doc_id", "n_bytes", f"case when {all_of_it} then n_bytes else coalesce(n_removed, 0L) end as n_removed", f"case when {all_of_it} then 1L else coalesce(n_spans, 0L) end as n_spans",
        f"case when {all_of_it} then sha2('', 256) else coalesce(kept_sha256, sha256) end as kept_sha256",
        f"case when {all_of_it} then array(named_struct('start', 0L, 'end', n_bytes)) else coalesce(spans, array()) end as spans",
    )
    out = scratch.keep(out, "cut")
    scratch.drop("rows", "keys", "texts", "met", "held", *(f"level{n}{x}" for n in LEVELS for x in ("", "-counts", "-cores")), "spans", "done")
    return out


def _of_frequent(held: DataFrame, group: int, scratch: Scratch) -> DataFrame:
    """text_id, spans: the same for grams with more than `group` suffixes.

    Their passages are cut finer, into strings of neighbouring passages on a grid that hangs on the gram, of fewer
    and fewer passages. A string that occurs twice settles all of its passages; of strings that are equal one goes
    on. The bytes that all passages of its cell of the grid share are its core: unless those occur in another
    string too, none of its passages does, and it is done. What is left has an edge of a repeated passage inside, and is cut
    again. Strings and cores are told apart by cryptographic digests of their bytes and their place, counted in
    each task before they move; no task holds all of a gram's suffixes.
    """

    def runs(r: dict):
        for m in r["met"]:
            if m["n_key"] > group:
                near, far = m["anchor"] - m["last"], m["anchor"] - m["first"]  # distances of the starts from the gram
                for k in range(near // LEVELS[0], far // LEVELS[0] + 1):
                    low, high = max(near, k * LEVELS[0]), min(far, (k + 1) * LEVELS[0] - 1)
                    yield m["anchor"] - high, high - low + 1, high

    texts = held.select(F.col("text_id").alias("held_id"), "packed", "size")
    strings, spans = _digested(held.select("text_id", "packed", "size", "met"), runs, LEVELS[0]), []
    for level, finer in zip(LEVELS, (*LEVELS[1:], 0), strict=True):
        found, left = _settled(strings, scratch, f"level{level}", bool(finer))
        spans += found
        if finer:
            left = left.groupBy("text_id").agg(F.collect_list(F.struct("begin", "n", "before")).alias("rest")).join(texts, F.col("text_id") == F.col("held_id")).drop("held_id")
            strings = _digested(left, lambda r, finer=finer: (x for s in r["rest"] for x in _pieces(s["begin"], s["n"], s["before"], finer)), finer)
    return functools.reduce(DataFrame.union, spans)


def _pieces(begin: int, n: int, before: int, size: int) -> Iterator[tuple[int, int, int]]:
    """A string's passages in strings of `size` at most, cut where distances from the gram are multiples of it."""
    while n:
        own = min(n, before % size + 1)
        yield begin, own, before
        begin, n, before = begin + own, n - own, before - own


def _digested(rows: DataFrame, strings: Callable[[dict], Iterable[tuple[int, int, int]]], size: int) -> DataFrame:
    """The distinct strings of each text: text_id, begin, n, before (n passages start from `begin` on, the first `before` bytes ahead of its gram), digests of the string and its core, times it occurs in the text, and spans. size: of the grid's cells, in passages."""

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("text_id", "begin", "n", "before", "digest", "core", "times", "spans")}
        for r in batch.to_pylist():
            text = pa.decompress(r["packed"], r["size"], codec="zstd", asbytes=True)
            own: dict[bytes, list] = {}
            for begin, n, before in strings(r):
                digest = hashlib.blake2b(text[begin : begin + n - 1 + PASSAGE], digest_size=16, salt=b"%d,%d" % (before, n)).digest()
                own.setdefault(digest, []).append((begin, n, before))
            for digest, places in own.items():
                begin, n, before = places[0]
                cell = before // size
                core = begin + before - cell * size
                shared = hashlib.blake2b(text[core : core - size + 1 + PASSAGE], digest_size=16, salt=b"%d" % cell)
                spans = [{"from": a, "to": b} for a, b in merged([(a, a + n - 1 + PASSAGE) for a, _, _ in places])]
                for c, v in zip(out, (r["text_id"], begin, n, before, digest, shared.digest(), len(places), spans), strict=True):
                    out[c].append(v)
            if len(out["n"]) > 20_000:
                yield out
                out = {c: [] for c in out}
        yield out

    return map_arrow(rows, run, f"text_id binary, begin long, n int, before int, digest binary, core binary, times long, spans {SPANS}", rows=32)


def _settled(strings: DataFrame, scratch: Scratch, name: str, more: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Spans of the strings that occur more than once, in one text or in several; and, if more is asked for, one of each string whose core another one has too. Both sides of the joins are tables, so that a frequent digest is split over tasks."""
    strings = scratch.keep(strings, name)
    counts = strings.groupBy("digest").agg(F.sum("times").alias("times"), F.min(F.struct("text_id", "begin", "n", "before", "core")).alias("one"))
    counts = scratch.keep(counts if more else counts.where("times > 1").select("digest", "times"), f"{name}-counts")
    twice = counts.where("times > 1").select(F.col("digest").alias("of"))
    spans = [strings.where("times > 1").select("text_id", "spans"), strings.where("times = 1").join(twice, F.col("digest") == F.col("of"), "left_semi").select("text_id", "spans")]
    if not more:
        return spans, None
    ones = counts.select("one.*")
    cores = scratch.keep(ones.groupBy("core").agg(F.count("*").alias("times")).where("times > 1").select(F.col("core").alias("of")), f"{name}-cores")
    return spans, ones.join(cores, F.col("core") == F.col("of"), "left_semi")


def op7_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that occur more than once; and where those are."""
    cut = repeated_passages(table(spark, sf_dir, "documents"), Scratch(spark, "suffix"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeated"), "spans")
