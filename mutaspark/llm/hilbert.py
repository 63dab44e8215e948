"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows sorted by their index on the curve, and the order cut into runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, ranked, table

#: Bits a dimension: 64 cells each.
BITS = 6
#: Steps a doubling by which sizes are counted.
STEPS = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of cells (n x dimensions, values under 2**bits): Skilling's transform of 2004, over all rows at once."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess work of the curve's rotations
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def curve(dims: list[Column], bits: int = BITS) -> Column:
    """The curve index of quantised columns."""

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    return index(*dims)


def cell_of_order(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """df with the cell of a text column: distinct values in code point order, null last, spread evenly over the cells. One row a value is ranked."""
    values = df.groupBy(column).agg(F.count("*").alias("n"))
    cells = values.selectExpr(
        f"{column} as value", f"cast((row_number() over (order by {column} asc nulls last) - 1) * {1 << bits} div count(*) over () as int) as {out}"
    )
    return df.join(cells, F.col(column).eqNullSafe(F.col("value")), "left").drop("value")


def cell_of_size(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """df with the cell of a column of whole numbers from 1 on: cells hold about equal numbers of rows, cut on a logarithmic scale of STEPS steps a doubling. The steps' counts, 63 * STEPS rows at most, are ordered."""
    step = F.floor(F.log2(column) * STEPS)
    counts = df.groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    cells = counts.selectExpr("step", f"cast((sum(n) over (order by step) - n) * {1 << bits} div sum(n) over () as int) as {out}")
    return df.withColumn("own_step", step).join(cells, F.col("own_step") == F.col("step")).drop("own_step", "step")


def hilbert_shards(docs: DataFrame, shards: int, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """Each document's shard and its slot there, by the law "rows": shards' counts differ by one at most.

    docs: doc_id, text, lang, source. Dimensions: source and language in code point order, and the size, all
    quantised. Files of consecutive slots so have narrow ranges of all three at once, and readers that filter on any
    of them skip most files. Documents with equal texts (told by length and two checksums, 96 bits) are a group: all
    have the source and language of the one with the smallest doc_id, so a group lies together on the curve, and
    only a cut between two shards can part it; there are `shards` - 1 cuts, wherever groups lie, as counts must be
    even. Returns doc_id, size (UTF-8 bytes of the text, null none, and 1), text_crc32, curve, shard, slot.

    Null texts count as empty; null sources and languages have the last cell; ties fall by the text's checksums,
    then doc_id (null first), and rows that are equal in all that are interchangeable. Repeated rows each have a
    slot. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = docs.select("doc_id", "lang", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    meta = scratch.keep(meta, "meta")
    groups = meta.groupBy("text_hash", "text_crc32", "size").agg(F.min(F.struct("doc_id", "source", "lang")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.keep(groups.selectExpr("text_hash as h", "text_crc32 as c", "size as s", "first"), "groups")
    meta = meta.join(groups, F.expr("text_hash = h and text_crc32 = c and size = s"), "left")
    meta = meta.selectExpr("doc_id", "size", "text_crc32", "text_hash", "case when first is null then source else first.source end as source", "case when first is null then lang else first.lang end as lang")
    meta = scratch.keep(meta, "grouped")
    placed = cell_of_size(cell_of_order(cell_of_order(meta, "source", "c0", bits), "lang", "c1", bits), "size", "c2", bits)
    placed = placed.select("doc_id", "size", "text_crc32", "text_hash", curve([F.col("c0"), F.col("c1"), F.col("c2")], bits).alias("curve"))
    run = ranked(placed, ["curve", "text_crc32", "text_hash", "doc_id"], scratch, "ordered")
    shard = F.expr(f"cast(rank * {shards} div n_rows as int)")
    first = F.expr(f"(cast(shard as long) * n_rows + {shards - 1}) div {shards}")
    scratch.drop("meta", "groups", "grouped")
    return run.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).drop("rank", "n_rows", "text_hash")


def op4_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    run = hilbert_shards(table(spark, sf_dir, "documents"), 8, Scratch(spark, "hilbert"))
    return run.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
