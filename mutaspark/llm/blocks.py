"""Groups of rows compared pair by pair: split into blocks where they are large, many small ones to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, arrow_schema


def repeated(rows: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """Rows whose key occurs more than once, with `n_key`, its count. Counts are a table of their own, so that the join's two sides are plain shuffles and a key with many rows is split over tasks."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n_key")).where("n_key > 1")
    counts = scratch.keep(counts.withColumnRenamed(key, "of_key"), name)
    return rows.join(counts, F.col(key) == F.col("of_key")).drop("of_key")


def paired_blocks(rows: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """Deals each key's rows into blocks of about `size` and each pair of blocks to a group of its own.

    Adds lo and hi, the pair of blocks, and block, the row's own: rows of blocks lo and hi meet in group
    (key, lo, hi), so any two rows of a key meet just once, no group exceeds about 2 * size rows, and a key that
    holds many rows becomes many groups. Needs n_key, the key's count.
    """
    n = F.expr(f"cast(ceil(n_key / {size}) as int)")
    dealt = rows.withColumn("n_blocks", n).withColumn("block", F.expr(f"cast(pmod(xxhash64({member}, 11), n_blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "n_blocks")


def each_group(rows: DataFrame, by: list[str], f: Callable[[pa.Table], Iterator[dict]], schema: str, ranged: bool = False) -> DataFrame:
    """f over each group of rows that agree in `by`. Groups are brought together by one shuffle and a sort, and run through one stream a task, so a small group costs little.

    ranged: tasks get ranges of `by`, cut at sampled splitters, rather than hashes of it.
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key, out, n_out = None, [], 0

        def flush():
            columns = [pa.array([v for o in out for v in o[k.name]], k.type) for k in kinds]
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        def close():
            nonlocal n_out
            for o in f(pa.Table.from_batches(held)):
                out.append(o)
                n_out += len(o[kinds.names[0]])

        for batch in batches:
            keys = list(zip(*(batch.column(b).to_pylist() for b in by), strict=True))
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if held and held_key != keys[start]:
                    close()
                    held = []
                    if n_out > 4096:
                        yield flush()
                        out, n_out = [], 0
                held_key = keys[start]
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            close()
        if n_out:
            yield flush()

    dealt = rows.repartitionByRange(*by) if ranged else rows.repartition(*by)
    return dealt.sortWithinPartitions(*by).mapInArrow(run, schema)
