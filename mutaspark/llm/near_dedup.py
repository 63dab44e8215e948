"""Near-duplicate detection with HyperMinHash registers (Yu and Weber, 2017)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import each_group, repeated
from .shared import Scratch, components, fresh, map_arrow, table

#: Registers, and the bits of each that follow its leading one.
REGISTERS, MANTISSA = 128, 10
#: Bands of registers that make two documents candidates.
BANDS, BAND = 25, 5
#: Candidates are verified unless their estimate lies so many standard deviations below the threshold.
DEVIATIONS = 5.0
#: Buckets of so many rows or fewer are emitted as pairs; larger ones are verified in place, in blocks of so many rows.
SMALL, BLOCK = 32, 256
#: Bytes of text that are hashed at once.
PIECE = 1 << 21

_rng = np.random.default_rng(20170317)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BAND_MIX = _rng.integers(1, 1 << 63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each starts."""
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):  # not inside a word
            space = SPACE[np.frombuffer(data, np.uint8, end - at, at)]
            last = space.nonzero()[0]
            if len(last):
                end = at + int(last[-1]) + 1
            else:
                while end < len(data) and not SPACE[data[end]]:
                    end += 1
        block = LOWER[np.frombuffer(data, np.uint8, end - at, at)]
        inside = np.concatenate([[False], ~SPACE[block], [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        if len(starts):
            lengths = ends - starts
            first = np.cumsum(lengths) - lengths
            place = np.arange(lengths.sum()) - np.repeat(first, lengths)
            power = np.empty(int(lengths.max()), np.uint64)
            power[0] = 1
            power[1:] = STEP
            power = np.multiply.accumulate(power)
            parts = BYTE[block[inside[1:-1]]] * power[place]
            hashes.append(mix(np.add.reduceat(parts, first) + lengths.astype(np.uint64) * STEP))
            places.append(starts + at)
        at = end
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (empty, np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its `width`-word shingles; with fewer words, of all its words as one; none without words."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    words, places = word_hashes(b" ".join(raw))
    bounds = np.concatenate([[0], np.searchsorted(places, ends)])
    out = []
    n = len(words)
    if n >= width:
        joined = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            joined = mix(joined * STEP + words[k : n - width + 1 + k])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = mix(x * STEP + words[k : k + 1])
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: by the first 7 bits, the least of the rest as its leading zeros (6 bits) and the 10 bits after its leading one; 0 is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        value = (hashes[first] >> np.uint64(5)) & np.uint64((1 << 52) - 1)  # 52 bits: exact as a double
        length = np.frexp(value.astype(np.float64))[1]
        zeros = 52 - length
        after = (value << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 52) - 1)
        out[bucket[first]] = (zeros << MANTISSA) + (after >> np.uint64(52 - MANTISSA)).astype(np.int64) + 1
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x bands) keys of bands of registers, and which bands have a register that isn't empty."""
    bands = regs[:, : BANDS * BAND].reshape(len(regs), BANDS, BAND)
    keys = mix((bands.astype(np.uint64) * BAND_MIX).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * STEP)
    return keys.view(np.int64), bands.any(axis=2)


def estimates(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one set against many, corrected for registers that agree by chance, and the registers that count."""
    used = np.maximum(((one > 0) | (many > 0)).sum(axis=1), 1)
    same = ((one == many) & (one > 0)).sum(axis=1)
    ratio = n_one / n_many
    chance = 0.169919487159739093975315012348 * 4 * ratio / (1 + ratio) ** 2 * used * 2.0**-MANTISSA
    return np.maximum(same - chance, 0) / used, used


def likely(regs: np.ndarray, n: np.ndarray, i: int, js: np.ndarray, threshold: float, band: int | None = None) -> np.ndarray:
    """Those of js worth verifying against i; with a band, those alone that it is the first to bring together with i."""
    js = js[np.minimum(n[js], n[i]) >= threshold * np.maximum(n[js], n[i])]
    if not len(js):
        return js
    estimate, used = estimates(regs[i], regs[js], int(n[i]), n[js])
    js = js[estimate >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / used)]
    if band is None:
        return js
    bands = regs[:, : BANDS * BAND].reshape(-1, BANDS, BAND)
    agree = (bands[js] == bands[i]).all(axis=2) & bands[i].any(axis=1)
    return js[agree.argmax(axis=1) == band]


def candidates(group: pa.Table, threshold: float):
    """Pairs to verify of a small bucket."""
    group = group.sort_by("rep")
    rep, n, band = group.column("rep").to_numpy(), group.column("n").to_numpy(), group.column("band")[0].as_py()
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
    found = [(i, j) for i in range(1, len(rep)) for j in likely(regs, n, i, np.arange(i), threshold, band)]
    if found:
        one, two = np.array(found).T
        yield {"a": rep[one], "b": rep[two]}


def verified_here(group: pa.Table, threshold: float):
    """Of a block of a large bucket, whose rows bring their full sets: edges that span what is linked. Rows of one label are linked already. Visitors are compared with residents, or where there are none, all rows with each other."""
    group = group.sort_by([("visitor", "ascending"), ("rep", "ascending")])
    rep, n, label = group.column("rep").to_numpy(), group.column("n").to_numpy(), group.column("label").to_numpy()
    visitors = int(group.column("visitor").to_numpy(zero_copy_only=False).sum())
    residents = len(rep) - visitors
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
    sets = [np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()]
    root = np.unique(label, return_inverse=True)[1].astype(np.int64)
    a, b = [], []
    for i in range(residents if visitors else 1, len(rep)):
        js = likely(regs, n, i, np.flatnonzero(root[: residents if visitors else i] != root[i]), threshold)
        for at in range(0, len(js), 256):
            some = js[at : at + 256]
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            every = np.concatenate([sets[j] for j in some])
            place = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(n[some])[:-1]]))
            for j in some[similar(common, n[i], n[some], threshold)]:
                if root[i] != root[j]:
                    a.append(i)
                    b.append(j)
                    low, high = min(root[i], root[j]), max(root[i], root[j])
                    root[root == high] = low
    if a:
        yield {"a": rep[a], "b": rep[b]}


def similar(common, n_a, n_b, threshold: float):
    """Whether sets are as similar as asked, in whole numbers."""
    return 10000 * common >= round(threshold * 10000) * (n_a + n_b - common)


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Links documents whose sets of shingles have a Jaccard similarity of `threshold` or more: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable by links, itself included; kept marks that one. Documents of
    equal sets are one class, and only a class's smallest doc_id goes on. Bands of registers bring classes
    together, estimates from registers drop pairs far below the threshold, and the rest is verified on full
    sets: pairs of small buckets after a join with both sets, larger buckets in place. These are dealt into blocks,
    in each bucket anew, whose rows bring their sets; each emits edges that span what it has linked, never its
    pairs. Most families are one component after that, however large. Only buckets that still hold several
    components go on: all rows but those of the largest one visit every block (see _across).

    Null and empty texts have empty sets and are linked with nothing. Rows repeated with one doc_id are one
    document; rows without doc_id are alone, with a null component_id. An empty table gives no rows. Other
    columns are ignored.
    """

    def sets(batch: pa.RecordBatch):
        found = shingle_sets(batch.column("text").to_pylist(), width)
        with np.errstate(over="ignore"):
            one = [int((np.bitwise_xor.reduce(mix(x)) + np.uint64(len(x))).view(np.int64)) if len(x) else None for x in found]
            two = [int(mix(x + STEP).sum(dtype=np.uint64).view(np.int64)) if len(x) else None for x in found]
        yield {
            "doc_id": batch.column("doc_id"), "n": [len(x) for x in found], "sig1": one, "sig2": two,
            "regs": [registers(x).astype("<u2").tobytes() if len(x) else None for x in found],
        }

    rows = map_arrow(docs.select("doc_id", "text"), sets, "doc_id long, n long, sig1 long, sig2 long, regs binary", rows=64)
    rows = scratch.keep(rows, "sets", compression="snappy")
    some = rows.where("n > 0 and doc_id is not null")
    reps = some.groupBy("sig1", "sig2").agg(F.min(F.struct("doc_id", "n", "regs")).alias("x")).select(F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.regs").alias("regs"), "sig1", "sig2")
    reps = scratch.keep(reps, "reps")

    def banded(batch: pa.RecordBatch):
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
        keys, used = band_keys(regs)
        r, c = np.nonzero(used)
        yield {"key": keys[r, c], "band": c.astype(np.int32), "rep": batch.column("rep").to_numpy()[r]}

    bands = map_arrow(reps.select("rep", "regs"), banded, "key long, band int, rep long", rows=2048)
    buckets = scratch.keep(repeated(bands, "key", scratch, "keys"), "buckets")
    members = scratch.keep(reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "regs"), "members")
    few = buckets.where(F.col("n_key") <= SMALL).join(members, "rep")
    pairs = scratch.keep(each_group(few, ["key"], lambda g: candidates(g, threshold), "a long, b long"), "pairs")
    many = buckets.where(F.col("n_key") > SMALL)
    need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(many.select("rep")).distinct()
    whole = _whole_sets(docs, need, width, scratch)
    with scratch.small_batches():
        links = scratch.keep(_verified(pairs, whole, threshold), "links")
        dealt = many.withColumn("block", F.expr(f"pmod(xxhash64(rep, key), ceil(n_key / {BLOCK}))"))
        full = members.join(whole.withColumnRenamed("doc_id", "rep"), "rep")
        met = dealt.withColumns({"label": F.col("rep"), "visitor": F.lit(False)}).join(full, "rep")
        inside = scratch.keep(each_group(met, ["key", "block"], lambda g: verified_here(g, threshold), "a long, b long"), "inside")
        labels = components(links.union(inside), scratch)
        across = _across(dealt.where(F.col("n_key") > BLOCK), labels, full, threshold, scratch)
        if not across.isEmpty():
            labels = components(links.union(inside).union(across), scratch, "cc2")
    classes = reps.select("sig1", "sig2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select(F.col("sig1").alias("s1"), F.col("sig2").alias("s2"), F.coalesce("label", "rep").alias("component"))
    out = rows.select("doc_id", "n", "sig1", "sig2").join(classes, (F.col("sig1") == F.col("s1")) & (F.col("sig2") == F.col("s2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = scratch.keep(out, "components")
    scratch.drop("sets", "reps", "keys", "buckets", "members", "pairs", "whole", "links", "inside", "labelled", "open", "across", "cc-found", "cc2-found")
    return out


def _across(dealt: DataFrame, labels: DataFrame, full: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Edges between blocks of one bucket. Its rows of the label that most of them have are linked already, so of any two rows that aren't yet, one has another label: these rows, in parts of BLOCK, visit all blocks."""
    rows = dealt.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "key", "band", "n_key", "block", F.coalesce("label", "rep").alias("label"))
    rows = scratch.keep(rows, "labelled")
    each = rows.groupBy("key", "label").agg(F.count("*").alias("size"))
    opened = each.groupBy("key").agg(F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("total")).where("total > most.size")
    opened = opened.select(F.col("key").alias("of_key"), F.col("most.label").alias("common"), (F.col("total") - F.col("most.size")).alias("others"))
    opened = scratch.keep(opened, "open")
    rows = rows.join(opened, F.col("key") == F.col("of_key")).drop("of_key").withColumn("parts", F.expr(f"ceil(others / {BLOCK})"))
    residents = rows.withColumn("visitor", F.lit(False)).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    visitors = rows.where("label <> common").withColumn("visitor", F.lit(True)).withColumn("part", F.expr("pmod(xxhash64(rep, key, 1), parts)")).withColumn("block", F.explode(F.expr(f"sequence(0L, ceil(n_key / {BLOCK}) - 1)")))
    columns = ["rep", "key", "band", "block", "part", "label", "visitor"]
    met = residents.select(columns).unionByName(visitors.select(columns)).join(full, "rep")
    return scratch.keep(each_group(met, ["key", "block", "part"], lambda g: verified_here(g, threshold), "a long, b long"), "across")


def _whole_sets(docs: DataFrame, need: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """doc_id and full set of the documents in `need` (id). Texts move compressed, and sets are made anew rather than kept for all documents."""

    def packed(batch: pa.RecordBatch):
        raw = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "size": [len(t) for t in raw], "packed": [pa.compress(t, codec="zstd", asbytes=True) for t in raw]}

    def sets(batch: pa.RecordBatch):
        raw = [pa.decompress(p.as_buffer(), n, codec="zstd", asbytes=True).decode("utf-8") for p, n in zip(batch.column("packed"), batch.column("size").to_pylist(), strict=True)]
        yield {"doc_id": batch.column("doc_id"), "hashes": [x.astype("<u8").tobytes() for x in shingle_sets(raw, width)]}

    texts = map_arrow(docs.where("doc_id is not null").select("doc_id", "text"), packed, "doc_id long, size long, packed binary")
    found = texts.join(need, texts.doc_id == need.id, "left_semi").dropDuplicates(["doc_id"])
    return scratch.keep(map_arrow(found, sets, "doc_id long, hashes binary", rows=64), "whole", compression="uncompressed")


def _verified(pairs: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    both = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("hashes").alias("set_a")), "a")
    both = both.join(whole.select(F.col("doc_id").alias("b"), F.col("hashes").alias("set_b")), "b")

    def check(batch: pa.RecordBatch):
        a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            one, two = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            if len(one) > len(two):
                one, two = two, one
            place = np.searchsorted(two, one)
            common = int((two[np.minimum(place, len(two) - 1)] == one).sum())
            if similar(common, len(one), len(two), threshold):
                keep.append(i)
        yield {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    return map_arrow(both, check, "a long, b long", rows=256)


def without_near_copies(docs: DataFrame, scratch: Scratch, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that stay: the smallest doc_id of each component, and rows without doc_id."""
    (name,) = fresh(docs, "kept_id")
    kept = near_duplicates(docs, scratch, width, threshold).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents by shingles of three words and a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "near"), width=3, threshold=0.85)
