"""Merkle manifest of a dataset: a tree a group of rows, a tree over the groups' roots, and a proof for every row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, arrow_schema, table, utf8_lower

#: Consecutive nodes that have one parent.
FAN = 8
#: Rows of a sorted partition, about: what a task holds of a group at once.
PART_ROWS = 200_000
#: Rows that leave a task at once, each with its proof.
OUT_ROWS = 1024
STEP = "struct<left:string,right:string>"


def leaf_digest(*values: Column) -> Column:
    """Digest of values in order: `-` for a null, else the value's length in UTF-8 bytes, a colon and the value."""
    parts = []
    for v in (v.cast("string") for v in values):
        parts += [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to: at each step the digest of the siblings around what was reached."""
    return F.aggregate(proof, leaf, lambda reached, step: F.sha2(F.concat(step["left"], reached, step["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level upward, each level from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def depth(n: int, fan: int = FAN) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def complete(first: int, leaves: list[str], n: int, fan: int = FAN) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """Of consecutive leaves from place `first` on, of a tree of n: (levels, ragged).

    levels: for each level the first index and the digests of the nodes all of whose leaves are here. ragged: (level,
    index, digest) of those nodes whose parent isn't here, the root among them if it is here.
    """
    levels, ragged, size, level = [(first, leaves)], [], n, 0
    while size > 1:
        start, nodes = levels[-1]
        end = start + len(nodes)
        low = -(-start // fan)
        high = -(-size // fan) if end == size else end // fan
        if high <= low:
            break
        parents = [parent(nodes[fan * k - start : fan * k + fan - start]) for k in range(low, high)]
        ragged += [(level, start + i, nodes[i]) for i in (*range(fan * low - start), *range(min(fan * high, end) - start, len(nodes)))]
        levels.append((low, parents))
        size, level = -(-size // fan), level + 1
    start, nodes = levels[-1]
    return levels, ragged + [(level, start + i, x) for i, x in enumerate(nodes)]


class Segment:
    """What a task holds of one group: its consecutive rows in a sorted partition."""

    def __init__(self, mark: dict):
        self.mark, self.rows, self.frames = mark, [], {}

    def leaves(self) -> list[str]:
        return [x for batch in self.rows for x in batch.column("leaf").to_pylist()]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    """Sorted records as segments: a mark (kind 0) opens one, frames (1) follow, then rows (2)."""
    now = None
    for batch in batches:
        kind, i = batch.column("kind").to_numpy(), 0
        stops = np.append(np.flatnonzero(kind != 2), batch.num_rows)
        while i < batch.num_rows:
            if kind[i] == 2:
                stop = int(stops[np.searchsorted(stops, i)])
                now.rows.append(batch.slice(i, stop - i))
                i = stop
                continue
            record = {name: batch.column(name)[i].as_py() for name in ("grp", "a", "n", "level", "idx", "children", "subroot", "root", "upper")}
            if kind[i] == 0:
                if now:
                    yield now
                now = Segment(record)
            else:
                now.frames[record["level"], record["idx"]] = record["children"]
            i += 1
    if now:
        yield now


#: Records of a part besides the row itself: where it stands, its group's figures, and a frame's parent with its children.
RECORD = f"part int, at long, kind int, grp string, leaf string, a long, n long, level int, idx long, children array<string>, subroot string, root string, upper array<{STEP}>"


def records(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows, marks and frames of each part together, in order: one exchange, and then a stream."""
    fields = [f.name for f in T.StructType.fromDDL(RECORD)]
    kinds = dict(x.split(" ", 1) for x in RECORD.split(", "))
    full = lambda df: df.select(*[F.col(c).cast(kinds[c]) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in fields], *([F.col("row")] if "row" in rows.columns and "row" in df.columns else [F.lit(None).cast(rows.schema["row"].dataType).alias("row")] if "row" in rows.columns else []))
    both = full(rows)
    for df in others:
        both = both.unionByName(full(df))
    return both.repartition("part").sortWithinPartitions("part", "at", "kind")


def range_sorted(leaves: DataFrame, by: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, marks) of a written table with grp, leaf, row. rows: with part and at, sorted by group and `by`; marks: for each part and group, its first `at`, the place `a` of its first row in the group, and the group's size n.

    A row's place in the written table breaks ties, so that equal rows are dealt over parts as well.
    """
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // PART_ROWS))
    keys = ["grp", *[f"row.{k}" for k in by], "leaf", "file", "place"]
    placed = leaves.selectExpr("grp", "leaf", "row", "xxhash64(_metadata.file_path) as file", "_metadata.row_index as place")
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("file", "place")
    schema = T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    kinds = arrow_schema(schema)

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], schema=kinds)
            at += n

    rows = scratch.keep(ordered.mapInArrow(number, schema), f"{name}-sorted").withColumn("kind", F.lit(2))
    counts = rows.groupBy("part", "grp").agg(F.count("*").alias("here"), F.min("at").alias("at"))
    marks = counts.selectExpr("part", "at", "0 as kind", "grp", "here", "coalesce(sum(here) over (partition by grp order by part rows between unbounded preceding and 1 preceding), 0) as a", "sum(here) over (partition by grp) as n")
    return rows, scratch.keep(marks, f"{name}-marks")


def assembled(ragged: DataFrame, levels: int, fan: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(frames, roots) from ragged nodes: level by level, children meet at their parent's coordinate. frames: grp, level, idx, children, digest of each parent made here; roots: grp, subroot."""
    top = F.expr("case when n = 1 then level = 0 else level = depth end and idx = 0")
    frames = []
    for level in range(levels):
        nodes = ragged.where((F.col("level") == level) & ~top).select("grp", "idx", "digest", "n", "depth")
        for made in frames[-1:]:
            nodes = nodes.unionByName(made.where(~top).select("grp", "idx", "digest", "n", "depth"))
        runs = nodes.groupBy("grp", F.expr(f"idx div {fan}").alias("up"), "n", "depth").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # `fan` nodes at most
        runs = runs.select("grp", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), F.col("run.digest").alias("children"), "n", "depth")
        frames.append(scratch.keep(runs.withColumn("digest", F.sha2(F.array_join("children", "").cast("binary"), 256)), f"{name}-level{level + 1}"))
    whole = frames[0] if frames else ragged.limit(0).selectExpr("grp", "level", "idx", "array(digest) as children", "n", "depth", "digest")
    for made in frames[1:]:
        whole = whole.unionByName(made)
    roots = ragged.where(top).select("grp", "digest").unionByName(whole.where(top).select("grp", "digest"))
    return whole, roots.withColumnRenamed("digest", "subroot")


def paths(segment: Segment, fan: int = FAN) -> Iterator[tuple[list[str], list[str]]]:
    """For each of a segment's leaves the left and the right siblings of every level, those of the upper tree last."""
    first, n, leaves = segment.mark["a"], segment.mark["n"], segment.leaves()
    levels, height = complete(first, leaves, n, fan)[0], depth(n, fan)
    upper = segment.mark["upper"] or []
    above = ([x["left"] for x in upper], [x["right"] for x in upper])
    known: dict[tuple[int, int], tuple[list[str], list[str]]] = {(height, 0): above}

    def path(level: int, index: int) -> tuple[list[str], list[str]]:
        if (level, index) in known:
            return known[level, index]
        run, at = index // fan, index % fan
        if level + 1 < len(levels) and levels[level + 1][0] <= run < levels[level + 1][0] + len(levels[level + 1][1]):
            nodes = levels[level][1][fan * run - levels[level][0] : fan * run + fan - levels[level][0]]
        else:
            nodes = segment.frames[level + 1, run]
        left, right = path(level + 1, run)
        found = ["".join(nodes[:at]), *left], ["".join(nodes[at + 1 :]), *right]
        if level:  # leaves are asked for once
            known[level, index] = found
        return found

    for place in range(first, first + len(leaves)):
        yield path(0, place)


def manifest(rows: DataFrame, by: list[str], scratch: Scratch, name: str = "manifest", fan: int = FAN, over: bool = True) -> DataFrame:
    """Each row with its group's subroot, the root over all groups, and its proof.

    rows: grp (string, may be null), leaf (hex digest) and a struct `row` of whatever else a row carries, `by` among
    its fields. Within a group, leaves ascend by `by`, nulls first; groups ascend bytewise, null first. Every `fan`
    consecutive nodes have one parent, the last run as many as there are, until one node is left. over: whether the
    groups' roots make a tree of their own; otherwise the root is the group's.

    Rows are range-partitioned by group and `by`, sorted, and written with their part; a group's count in each part
    gives every part its first place. A task builds all subtrees whose leaves it holds, and sends on only the nodes
    at its ragged ends, a few a level; those meet by coordinate, level by level. For proofs each part gets the
    parents that it doesn't hold whole, two a level and group at most, and streams once more. No group, level or
    proof is gathered anywhere; a part of a group is.

    Returns grp, row, leaf, place (in its group), subroot, root, proof: an array of (left, right), the siblings before
    and after at each level upward. Rows equal in group, `by` and leaf are leaves each, interchangeable. An empty
    table gives no rows.
    """
    leaves = scratch.keep(rows.select("grp", "leaf", "row"), f"{name}-leaves")
    rows, marks = range_sorted(leaves, by, scratch, name)

    def build(batches):
        for s in segments(batches):
            found = complete(s.mark["a"], s.leaves(), s.mark["n"], fan)[1]
            n = len(found)
            columns = {"grp": [s.mark["grp"]] * n, "n": [s.mark["n"]] * n, "depth": [depth(s.mark["n"], fan)] * n, "level": [x[0] for x in found], "idx": [x[1] for x in found], "digest": [x[2] for x in found]}
            yield pa.RecordBatch.from_pydict(columns, schema=sent)

    shape = "grp string, n long, depth int, level int, idx long, digest string"
    sent = arrow_schema(shape)
    ragged = scratch.keep(records(rows.drop("row"), marks).mapInArrow(build, shape), f"{name}-ragged")
    largest = ragged.agg(F.max("depth")).first()[0] or 0
    frames, roots = assembled(ragged, largest, fan, scratch, name)
    roots = scratch.keep(roots, f"{name}-roots")
    if over:
        top = roots.select(F.lit("").alias("grp"), F.col("subroot").alias("leaf"), F.struct("grp").alias("row"))
        top = manifest(top, ["grp"], scratch, f"{name}-top", fan, over=False).selectExpr("row.grp as g", "leaf as subroot", "root", "proof as upper")
    else:
        top = roots.select(F.col("grp").alias("g"), "subroot", F.col("subroot").alias("root"), F.lit(None).cast(f"array<{STEP}>").alias("upper"))
    # A mark a part and group: what the group's rows there need beside themselves.
    heads = marks.join(top, F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    at_end = lambda level, place: F.struct(F.lit(level).alias("l"), F.expr(f"{place} div {fan**level}L").alias("i"))
    coordinates = [at_end(level, place) for level in range(1, max(largest, 1) + 1) for place in ("a", "(a + here - 1)")]
    ends = marks.select("part", "at", F.col("grp").alias("g"), F.explode(F.array_distinct(F.array(*coordinates))).alias("end"))
    ends = ends.selectExpr("part", "at", "g", "end.l", "end.i")
    needed = ends.join(frames, F.col("grp").eqNullSafe(F.col("g")) & (F.col("level") == F.col("l")) & (F.col("idx") == F.col("i")))
    needed = needed.select("part", "at", F.lit(1).alias("kind"), "grp", "level", "idx", "children")
    out = T.StructType([*T.StructType.fromDDL("grp string, leaf string, place long, subroot string, root string").fields, T.StructField("proof", T.ArrayType(T.StructType.fromDDL("left string, right string"))), rows.schema["row"]])
    kinds = arrow_schema(out)

    def prove(batches):
        for s in segments(batches):
            if not s.rows:
                continue
            found, place = paths(s, fan), s.mark["a"]
            for batch in s.rows:
                for start in range(0, batch.num_rows, OUT_ROWS):
                    part = batch.slice(start, OUT_ROWS)
                    n = part.num_rows
                    own = [next(found) for _ in range(n)]
                    steps = pa.StructArray.from_arrays([pa.array([x for p in own for x in p[side]], pa.string()) for side in (0, 1)], ["left", "right"])
                    proof = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(p[0]) for p in own]]), pa.int32()), steps)
                    columns = [part.column("grp"), part.column("leaf"), pa.array(range(place, place + n), pa.int64()), pa.array([s.mark["subroot"]] * n), pa.array([s.mark["root"]] * n), proof.cast(kinds.field("proof").type), part.column("row")]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)
                    place += n

    return records(rows, heads, needed).mapInArrow(prove, out)


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Documents as leaves by language: row holds doc_id and `other`, the leaf of the text with its A-Z in lower case where `tampered` is true and there is a text, else null."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(tampered & F.col("text").isNotNull(), leaf_digest(*fields, utf8_lower(F.col("text"))))
    return docs.select(F.col("lang").alias("grp"), leaf_digest(*fields, F.col("text")).alias("leaf"), F.struct("doc_id", changed.alias("other")).alias("row"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; a third of them tampered with, and each verified."""
    docs = table(spark, sf_dir, "documents")
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    found = manifest(document_leaves(docs, third), ["doc_id"], Scratch(spark, "merkle"))
    found = found.withColumn("folded_root", folded(F.coalesce("row.other", "leaf"), F.col("proof")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 12, fan: int = FAN) -> str:
    """The same level by level over whole groups; trees of up to fan ** levels leaves."""
    field = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end"
    leaf = lambda text: f"sha256(concat({', '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))}))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # Digits are bytes 48 to 57: a checksum of their bits, the lowest first.
    bits = "flatten([[(ord(d) >> j) & 1 for j in range(0, 8)] for d in string_split(cast(doc_id as varchar), '')])"
    crc = f"xor(list_reduce({bits}, lambda acc, bit: xor(acc >> 1, case when (acc & 1) <> bit then 3988292384 else 0 end), 4294967295), 4294967295)"
    steps = [f"l as (select doc_id, lang, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(lower)} end as other from documents)"]

    def tree(name: str, source: str, group: str):
        steps.append(f"{name}0 as ({source})")
        for k in range(levels):
            steps.append(f"{name}r{k} as (select *, count(*) over (partition by {group}) as n, place // {fan} as up from {name}{k})")
            steps.append(f"{name}{k + 1} as (select {group}, up as place, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by place)) end as h from {name}r{k} group by {group}, up)")
        # Siblings of a node, level by level upward: what stands before and after it in its run.
        near = f"partition by {group}, up order by place rows between"
        steps.append(f"{name}s as (" + " union all ".join(f"select {group}, {k} as level, place, coalesce(string_agg(h, '') over ({near} unbounded preceding and 1 preceding), '') as lefts, coalesce(string_agg(h, '') over ({near} 1 following and unbounded following), '') as rights from {name}r{k} where n > 1" for k in range(levels)) + ")")

    tree("d", "select lang, row_number() over (partition by lang order by doc_id nulls first, leaf, other) - 1 as place, leaf as h from l", "lang")
    tree("t", f"select true as one, row_number() over (order by lang nulls first) - 1 as place, h from d{levels}", "one")
    steps += [
        f"langs as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as top from d{levels})",
        "p as (select l.*, subroot, top, row_number() over (partition by lang order by doc_id nulls first, leaf, other) - 1 as place from l join langs using (lang) union all by name select l.*, subroot, top, row_number() over (order by doc_id nulls first, leaf, other) - 1 as place from l, langs where l.lang is null and langs.lang is null)",
    ]
    for side in ("lefts", "rights"):
        own = "".join(f" left join ds d{k}_ on d{k}_.level = {k} and d{k}_.lang is not distinct from p.lang and d{k}_.place = p.place // {fan**k}" for k in range(levels))
        up = "".join(f" left join ts t{k}_ on t{k}_.level = {k} and t{k}_.place = p.top // {fan**k}" for k in range(levels))
    names = [f"d{k}_" for k in range(levels)] + [f"t{k}_" for k in range(levels)]
    fold = "coalesce(other, leaf)"
    steps.append("j as (select p.*, " + ", ".join(f"{x}.lefts as {x}l, {x}.rights as {x}r" for x in names) + f" from p{own}{up})")
    at = "j"
    for x in names:
        steps.append(f"f{x} as (select *, case when {x}l is null then {'reached' if at != 'j' else fold} else sha256({x}l || {'reached' if at != 'j' else fold} || {x}r) end as next from {at})")
        steps.append(f"g{x} as (select * exclude (next{', reached' if at != 'j' else ''}), next as reached from f{x})")
        at = f"g{x}"
    proof = "sha256(concat(" + ", ".join(f"{x}l, {x}r" for x in names) + "))"
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, (select h from t{levels}) as root, {proof} as proof_sha256, reached as folded_root, reached = (select h from t{levels}) as verified from {at}"


OP12_SQL = _sql(7)
