"""Near-duplicate embeddings by Euclidean p-stable hashing (Datar et al., 2004) and exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import each_group, paired_blocks, repeated
from .shared import Scratch, components, map_arrow, table

#: Width of a quantised projection, for vectors of length 1.
CELL = 2.0
#: A pair at the threshold is missed by all tables with this probability at most.
MISS = 0.002
#: Vectors of unlike direction that share a bucket with a given one, on average and over all rows of a table.
STRAY = 0.03
BLOCK = 1024


def collision(distance: float, cell: float = CELL) -> float:
    """The probability that one quantised Gaussian projection agrees for two vectors at this Euclidean distance."""
    r = cell / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(projections a table, tables) for n vectors: as many projections as keep strays rare, as many tables as the miss probability takes."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * threshold))
    width = max(4, math.ceil(math.log(max(n, 2) / STRAY) / -math.log(far)))
    return width, math.ceil(math.log(MISS) / math.log1p(-(near**width)))


class Hashing:
    """Tables of p-stable hashes; every task draws the same projections from the seed."""

    def __init__(self, dims: int, width: int, tables: int, seed: int = 20040608):
        self.dims, self.width, self.tables, self.seed, self.drawn = dims, width, tables, seed, None

    def __getstate__(self):
        return self.__dict__ | {"drawn": None}

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(n, tables) int64 keys of vectors of length 1."""
        if self.drawn is None:
            rng = np.random.default_rng(self.seed)
            count = self.width * self.tables
            self.drawn = rng.normal(0, 1, (self.dims, count)), rng.uniform(0, CELL, count), rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        lines, shift, odd = self.drawn
        cells = np.floor((vectors @ lines + shift) / CELL).astype(np.int64).view(np.uint64)
        mixed = (cells * odd).reshape(len(vectors), self.tables, self.width).sum(axis=2, dtype=np.uint64)
        mixed += np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def unit(column: pa.Array) -> np.ndarray:
    """Vectors stored as little-endian doubles, scaled to length 1."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small values overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def joined(group: pa.Table, hashing: Hashing, threshold: float):
    """Of one pair of blocks of a bucket: for each class the vectors that it is linked with by a pair that this table is the first to bring together, and edges that span what is linked."""
    group = group.sort_by("rep")
    rep, size = group.column("rep").to_numpy(), group.column("size").to_numpy()
    block, slot = group.column("block").to_numpy(), group.column("slot")[0].as_py()
    across = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
    x = unit(group.column("vector").combine_chunks())
    keys = hashing.keys(x)
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for start in range(0, len(rep), 256):
        near = x[start : start + 256] @ x.T >= threshold
        for i, row in enumerate(near, start):
            js = np.flatnonzero(row[:i])
            if across:
                js = js[block[js] != block[i]]
            if not len(js):
                continue
            first = (keys[js] == keys[i]).argmax(axis=1) == slot
            mine = js[first]
            links[i] += size[mine].sum()
            links[mine] += size[i]
            for j in mine:  # union by the smaller root
                a, b = int(j), i
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                root[max(a, b)] = min(a, b)
    some = np.flatnonzero(links)
    if len(some):
        for i in some:
            while root[root[i]] != root[i]:
                root[i] = root[root[i]]
        yield {"a": rep[some], "b": rep[root[some]], "links": links[some]}


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.95) -> DataFrame:
    """Links vectors with a cosine of `threshold` or more: vec_id, n_links, component_id, kept.

    Equal vectors are one class, which goes on as its smallest vec_id and its size. Tables of quantised random
    projections bring classes together; the cosine, in double precision, decides. A pair that shares buckets in
    several tables counts in the first only, so nothing is emitted by pair: each bucket gives every class one
    count, and edges that span what it has linked.

    Vectors that are null, empty, zero or have a null, NaN or infinite component are linked with nothing, as are
    vectors of other lengths with each other. Rows repeated with one vec_id and vector count as other vectors;
    rows without vec_id have a null component_id. An empty table gives no rows. Other columns are ignored.
    """

    def checked(batch: pa.RecordBatch):
        values = [np.array(v, np.float64) if v and None not in v else None for v in batch.column("embedding").to_pylist()]
        good = [v is not None and bool(np.isfinite(v).all()) and bool(v.any()) for v in values]
        yield {"vec_id": batch.column("vec_id"), "vector": [(v + 0.0).astype("<f8").tobytes() if g else None for v, g in zip(values, good, strict=True)]}

    rows = map_arrow(vectors.select("vec_id", "embedding"), checked, "vec_id long, vector binary", rows=2048)
    rows = scratch.keep(rows, "vectors", compression="snappy")
    some = rows.where("vector is not null")
    reps = some.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    reps = scratch.keep(reps.withColumn("bytes", F.octet_length("vector")), "reps", compression="snappy")
    found = None
    for row in reps.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect():  # one row for each length of vectors
        one = _of_length(reps.where(F.col("bytes") == row.bytes), row.bytes // 8, row.n, threshold, scratch)
        found = one if found is None else found.union(one)
    if found is None:
        found = reps.selectExpr("rep as node", "size as links", "rep as edge").limit(0)
    found = scratch.keep(found, "found")
    labels = components(found.selectExpr("node as a", "edge as b"), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = reps.join(links, reps.rep == links.node, "left").drop("node").join(labels, reps.rep == labels.node, "left")
    classes = classes.selectExpr("vector as v", "size - 1 + coalesce(links, 0) as n", "coalesce(label, rep) as component")
    out = rows.join(classes, rows.vector == classes.v, "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    out = scratch.keep(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "links")
    scratch.drop("vectors", "reps", "found", "cc-found")
    return out


def _of_length(reps: DataFrame, dims: int, n: int, threshold: float, scratch: Scratch) -> DataFrame:
    """node, links, edge of the classes of one length that are linked."""
    hashing = Hashing(dims, *shape(n, threshold))

    def hashed(batch: pa.RecordBatch):
        keys = hashing.keys(unit(batch.column("vector")))
        yield {"key": keys.ravel(), "slot": np.tile(np.arange(hashing.tables, dtype=np.int32), len(keys)), "rep": np.repeat(batch.column("rep").to_numpy(), hashing.tables)}

    # A class without a vec_id has no name to be linked by.
    named = reps.where("rep is not null")
    keys = map_arrow(named.select("rep", "vector"), hashed, "key long, slot int, rep long", rows=512)
    buckets = scratch.keep(repeated(keys, "key", scratch, f"keys{dims}"), f"buckets{dims}")
    met = paired_blocks(buckets.join(named.select("rep", "size", "vector"), "rep"), "key", "rep", BLOCK)
    pairs = each_group(met, ["key", "lo", "hi"], lambda g: joined(g, hashing, threshold), "a long, b long, links long")
    return pairs.select(F.col("a").alias("node"), "links", F.col("b").alias("edge"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings, linked from a cosine of 0.95 on."""
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))
