"""Centroid clustering of integer vectors by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, map_arrow, table

#: Dimensions that a step of the search adds before centroids are abandoned again.
STEP = 8
#: Integers that a vector may hold: 64 squared differences of them fit in a long.
LARGEST = 1 << 27


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; of equally near ones the smaller number.

    Squared differences are added in `order`, STEP dimensions at a time. The centroid that is nearest over the first
    step is measured whole: its distance is the vector's best so far. Of the other centroids, those whose partial
    sum is strictly above the best are abandoned after each step, and survivors, which have all dimensions then,
    improve it. What is abandoned can't win or tie, as sums only grow.
    """
    v, c = vectors[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    n, dims = v.shape
    rows = np.arange(n)
    part = ((v[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(2)
    number = part.argmin(1)
    best = part[rows, number] + ((v[:, STEP:] - c[number, STEP:]) ** 2).sum(1)
    alive = part <= best[:, None]
    alive[rows, number] = False
    row, at = np.nonzero(alive)
    so_far = part[row, at]
    for start in range(STEP, dims, STEP):
        so_far = so_far + ((v[row, start : start + STEP] - c[at, start : start + STEP]) ** 2).sum(1)
        left = so_far <= best[row]
        row, at, so_far = row[left], at[left], so_far[left]
    # Survivors are in order of row and number; a stable sort by row and distance puts each row's winner first.
    first = np.lexsort((at, so_far, row))
    row, at, so_far = row[first], at[first], so_far[first]
    lead = np.ones(len(row), bool)
    lead[1:] = row[1:] != row[:-1]
    row, at, so_far = row[lead], at[lead], so_far[lead]
    wins = (so_far < best[row]) | ((so_far == best[row]) & (at < number[row]))
    number[row[wins]], best[row[wins]] = at[wins], so_far[wins]
    return number, best


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Equally long lists of whole numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def whole_numbers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors of exactly `dims` finite components, each turned into floor(scale * component)."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    # A comparison with NaN or an infinity is false below, one with null is null; coalesce makes both a refusal.
    fit = F.forall("embedding", lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(LARGEST / scale)), F.lit(False)))
    return vectors.where(F.coalesce((F.size("embedding") == dims) & fit, F.lit(False))).select("vec_id", v.cast("array<int>").alias("v"))


def seeds(kept: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<vec_id>`, in that order; vectors without an id come last, ties fall by components."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in kept.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()], np.int64)


def sums(kept: DataFrame, dims: int, number, squares: bool = False) -> list:
    """Of each group that `number` gives vectors (a batch's matrix -> whole numbers): its size and componentwise exact sums, and those of squares as doubles. A row a batch and group moves."""

    def add(batch: pa.RecordBatch):
        v = matrix(batch.column("v"), dims).astype(np.int64)
        groups, at = np.unique(number(v), return_inverse=True)
        total = np.zeros((len(groups), dims), np.int64)
        np.add.at(total, at, v)
        more = np.zeros((len(groups), dims))
        if squares:
            np.add.at(more, at, v.astype(float) ** 2)
        yield {"number": groups, "n": np.bincount(at, minlength=len(groups)), "total": list(total), "more": list(more)}

    parts = map_arrow(kept.select("v"), add, "number int, n long, total array<long>, more array<double>", rows=4096)
    flat = parts.select("number", "n", F.posexplode(F.arrays_zip("total", "more")).alias("dim", "x"))
    wide = flat.groupBy("number", "dim").agg(F.sum("n").alias("n"), F.sum("x.total").alias("total"), F.sum("x.more").alias("more"))
    return wide.collect()  # a row a centroid and dimension


def spread_first(kept: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by variance over all vectors, the largest first: most of a distance is known after the first steps."""
    variance = np.zeros(dims)
    for r in sums(kept, dims, lambda v: np.zeros(len(v), int), squares=True):
        variance[r.dim] = r.more / r.n - (r.total / r.n) ** 2
    return np.argsort(-variance, kind="stable")


def moved(centroids: np.ndarray, rows: list) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of their vectors' components; those without vectors stay."""
    out = centroids.copy()
    for r in rows:
        out[r.number, r.dim] = r.total // r.n
    return out


def clustered(vectors: DataFrame, k: int, rounds: int, scratch: Scratch, dims: int = 64, scale: int = 64) -> DataFrame:
    """Each kept vector's cluster after `rounds` rounds from k hashed seeds.

    vectors: vec_id, embedding. A round is one pass over the kept vectors as whole numbers, a table written once;
    per task and batch it moves a row for each centroid, and k * dims sums come to the driver. Returns vec_id,
    cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold a null, NaN or infinite component have no row; neither have
    those with a component of 2**27 / scale or more, whose squared distances may not fit in a long. Repeated rows
    are vectors each, seeds included. Fewer than k vectors give as many centroids as there are; an empty table
    gives no rows. Equal distances fall to the smaller number. Other columns are ignored.
    """
    kept = scratch.keep(whole_numbers(vectors, dims, scale), "whole")
    centroids = seeds(kept, k)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    order = spread_first(kept, dims)
    for _ in range(rounds):
        centroids = moved(centroids, sums(kept, dims, lambda v, c=centroids: nearest(v, c, order)[0]))

    def assign(batch: pa.RecordBatch) -> Iterator[dict]:
        number, distance = nearest(matrix(batch.column("v"), dims), centroids, order)
        yield {"vec_id": batch.column("vec_id"), "cluster": number, "distance": distance}

    found = scratch.keep(map_arrow(kept, assign, "vec_id long, cluster int, distance long", rows=4096), "found")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    scratch.drop("whole")
    return found.select(
        "vec_id", "cluster", "distance", of([inertia.get(j, 0) for j in range(len(digest))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"),
    )


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds."""
    return clustered(table(spark, sf_dir, "embeddings"), 16, 3, Scratch(spark, "centroids"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The same by plain sums over all dimensions."""
    steps = [
        """kept as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
            where len(embedding) = 64 and len([1 for x in embedding if x is null or not isfinite(x)]) = 0)""",
        "wide as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as dim from kept)",
        f"""c0 as (select number, unnest(v) as y, generate_subscripts(v, 1) as dim
            from (select v, row_number() over (order by sha256('1:' || vec_id), v) - 1 as number from kept) where number < {k})""",
    ]
    for j in range(rounds + 1):
        steps.append(f"""a{j} as (select vec_id, arg_min(number, (d, number)) as number, min(d) as d
            from (select vec_id, number, sum((x - y) * (x - y)) as d from wide join c{j} using (dim) group by all) group by vec_id)""")
        if j < rounds:
            steps.append(f"""c{j + 1} as (select number, coalesce(m, y) as y, dim from c{j} left join
                (select number, dim, cast(sum(x) as bigint) // count(*) - cast(cast(sum(x) as bigint) % count(*) < 0 as int) as m
                    from wide join a{j} using (vec_id) group by all) using (number, dim))""")
    return f"""with {", ".join(steps)},
        digests as (select number, sha256(string_agg(cast(y as varchar), ',' order by dim)) as centroid_sha256 from c{rounds} group by number)
        select vec_id, cast(number as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by number) as bigint) as cluster_inertia,
            cast(sum(d) over () as bigint) as inertia, centroid_sha256 from a{rounds} join digests using (number)"""


OP13_SQL = _sql()
