"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997): certain whole copies first, then a sample of fixed size in words and unequal probability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, Scratch, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than so.
CAP = 3
SEED = "pareto-1"
#: Cells of the two histograms that narrow a sample's cut.
CELLS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source, from one row a source (source, source_size).

    Targets share `share` of all sizes by weight. A target stops at `cap` times its source's size and the excess
    is shared again by weight until none is above. That ends where sources are filled to one level a weight: in
    order of their cap a weight, sources are full as long as what is left would lift the level above it.
    """
    w = "element_at(array(" + ", ".join(map(str, weights)) + f"), cast((row_number() over (order by source asc nulls last) - 1) % {len(weights)} + 1 as int))"
    capped = sizes.selectExpr("source", "source_size", f"source_size * {cap} as most", f"{w} as w")
    total = f"sum(source_size) over () * cast({share} as double)"
    order = "order by most / w, source asc nulls last"
    run = capped.selectExpr(
        "*", f"{total} as total", f"sum(most) over ({order} rows unbounded preceding) - most as full", f"sum(w) over () - (sum(w) over ({order} rows unbounded preceding) - w) as open"
    )
    levels = run.selectExpr("*", "(total - full) / open as level")
    levels = levels.selectExpr("*", "max(case when level <= most / w then level end) over () as at")
    # From the first level that fits on, levels only fall: later rows count sources as full that aren't.
    return levels.selectExpr("source", "source_size", "case when at is null or most / w <= at then cast(most as double) else at * w end as target")


def uniform(key: Column, seed: str = SEED, nth: Column | None = None) -> Column:
    """A number in (0, 1) that depends on the key, its repetition and the seed alone: 48 bits of an MD5, so that other engines can draw it too."""
    again = F.lit("") if nth is None else F.when(nth > 0, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), again).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def odds_of_size(rows: DataFrame, aims: DataFrame, scratch: Scratch) -> DataFrame:
    """of, rate, sure, left: a source's inclusion probabilities for what certain copies leave of its target.

    They are in proportion to the documents' sizes, rate * size, so that the expected words come to the rest;
    sizes above `sure` would have more than 1 and are certain, and `left` is what they leave. One row a source and
    size is ordered, and sums are exact, so every engine and run has the same rates.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.selectExpr("source", "size", "cast(n as decimal(20,0)) * size as words", "cast(n as decimal(20,0)) * (cast(size as decimal(18,0)) * size) as squares")
    above = "over (partition by source order by size desc rows between unbounded preceding and 1 preceding)"
    run = sizes.join(aims.select("aim_source", "rest").where("rest > 0"), F.col("source").eqNullSafe(F.col("aim_source"))).selectExpr(
        "source", "size", "rest", f"cast(coalesce(sum(words) {above}, 0) as double) as sure_words", f"cast(sum(squares) over (partition by source) - coalesce(sum(squares) {above}, 0) as double) as open_squares"
    )
    fits = run.selectExpr("*", "(rest - sure_words) / open_squares as rate").where("rate * size <= 1D")
    best = fits.groupBy("source").agg(F.max(F.struct("size", "rate", "rest", "sure_words")).alias("x"))
    return scratch.keep(best.selectExpr("source as of", "x.size as sure", "x.rate as rate", "x.rest - x.sure_words as left"), "odds")


def pareto_mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """How often each document is taken: doc_id, source, size (its words), source_size, target, copies, taken (words).

    A source with target t and size s takes each of its documents floor(t / s) times for certain. The rest of the
    target is a sample without replacement of that many words: a document's inclusion probability p is in
    proportion to its size (see odds_of_size), and its ranking variable is q = (u / (1 - u)) / (p / (1 - p)), u
    uniform and fixed by doc_id and seed. Documents with p = 1 are taken, others by rising q as long as they fit
    whole; of those not taken, one more is if it brings the source nearer to its target, the one that does so
    best. No document is taken more than `cap` times.

    Sources are never gathered: two histograms of q, of 1024 cells each, narrow the cut to about a millionth of
    a source's rows, and only those are sorted.

    Null sources are one source, the last. Null texts and texts without words have size 0 and are taken the
    certain number of times. Rows that share doc_id, source and size are numbered, and each number has a u of its
    own, so they are taken one by one as others are. An empty table gives no rows. Other columns are ignored.
    """
    rows, _, decided = _scheme(docs, scratch, weights, share, cap, seed)
    return decided(rows).select("doc_id", "source", "size", "source_size", "target", "copies").withColumn("taken", F.col("copies") * F.col("size"))


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, repeats: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """rows (doc_id, source, size and more) with `nth`: from 0 within equal doc_id, source and size, in any order. repeats: those of the three that occur more than once; None for none.

    Repeated rows are set aside with their partition and place in it; they are counted by partition, and the counts
    before each give its first number. So however many rows repeat, each task numbers those of one partition.
    """
    if repeats is None:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    again = repeats.selectExpr("doc_id as d", "source as s", "size as z")
    same = F.expr("doc_id <=> d and source <=> s and size = z")
    alone = rows.join(again, same, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    aside = scratch.keep(rows.join(again, same, "left_semi").withColumn("place", F.monotonically_increasing_id()), name).withColumn("part", F.expr("shiftright(place, 33)"))
    counts = aside.groupBy("doc_id", "source", "size", "part").agg(F.count("*").alias("n"))
    first = counts.selectExpr("doc_id as d", "source as s", "size as z", "part as p", "coalesce(sum(n) over (partition by doc_id, source, size order by part rows between unbounded preceding and 1 preceding), 0) as first")
    within = aside.withColumn("at", F.expr("row_number() over (partition by doc_id, source, size, part order by place) - 1"))
    placed = within.join(first, same & (F.col("part") == F.col("p"))).withColumn("nth", F.col("first") + F.col("at"))
    return alone.unionByName(placed.select(*alone.columns))


def _scheme(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame | None, Callable[[DataFrame], DataFrame]]:
    """doc_id, source, size and nth of docs; what of the first three repeats; and what adds source_size, target and copies to any rows that have these four. All it needs are tables of a row a source."""
    sizes = scratch.keep(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    repeats = scratch.keep(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")
    repeats = None if repeats.isEmpty() else repeats
    rows = numbered(sizes, repeats, scratch, "repeated")
    if repeats is not None:
        rows = scratch.keep(rows, "numbered")
    aims = scratch.keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    aims = aims.selectExpr("source as aim_source", "source_size", "target", "case when source_size > 0 then floor(target / source_size) else 0 end as whole")
    aims = aims.selectExpr("*", "case when source_size > 0 then target - whole * source_size else 0D end as rest")
    plan = aims.drop("rest").join(odds_of_size(rows, aims, scratch), F.expr("aim_source <=> of"), "left").drop("of")
    plan = scratch.keep(plan, "plan")  # its size is known from here on, so that rows aren't dealt out by source where it is small

    def ranked(some: DataFrame) -> DataFrame:
        drawn = some.join(plan, some.source.eqNullSafe(plan.aim_source)).drop("aim_source").withColumn("u", uniform(F.col("doc_id"), seed, F.col("nth")))
        drawn = drawn.withColumn("p", F.expr("case when size > 0 then case when size > sure then 1D else rate * size end end"))
        drawn = drawn.withColumn("q", F.expr("case when p < 1 and p > 0 then (u / (1 - u)) / (p / (1 - p)) end"))
        return drawn.withColumn("z", F.expr(f"q / (1 + q) * {CELLS}")).withColumn("c1", F.floor("z")).withColumn("c2", F.expr(f"floor((z - c1) * {CELLS})"))

    sampled = ranked(rows).where("q is not null").select("source", "doc_id", "size", "left", "q", "c1", "c2")
    cut1 = scratch.keep(_crossing(sampled.groupBy("source", "left", "c1").agg(F.sum("size").alias("n")), "c1", F.lit(0)), "cut1")
    in1 = sampled.join(F.broadcast(cut1) if _small(cut1) else cut1, sampled.source.eqNullSafe(cut1.at_source) & (sampled.c1 == cut1.at)).drop("at_source", "at")
    cut2 = scratch.keep(_crossing(in1.groupBy("source", "left", "c1", "before", "c2").agg(F.sum("size").alias("n")), "c2", F.col("before")).withColumnRenamed("at", "at2").withColumnRenamed("before", "before2"), "cut2")
    in2 = in1.join(cut2, in1.source.eqNullSafe(cut2.at_source) & (in1.c2 == cut2.at2)).drop("at_source", "at2")
    last = in2.selectExpr("source", "q", "doc_id", "left", "before2 + sum(size) over (partition by source order by q, doc_id rows unbounded preceding) as reach")
    ends = last.where("reach <= left").groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("end"))
    cut = cut1.select("at_source", F.col("at").alias("at1")).join(cut2.select(F.col("at_source").alias("s2"), "at2"), F.expr("at_source <=> s2"), "left").drop("s2")
    cut = scratch.keep(cut.join(ends.withColumnRenamed("source", "s3"), F.expr("at_source <=> s3"), "left").drop("s3"), "cut")
    earlier = "coalesce(c1 < at1 or (c1 = at1 and (c2 < at2 or (c2 = at2 and struct(q, doc_id) <= end))), false)"

    def picked(some: DataFrame) -> DataFrame:
        some = ranked(some)
        return some.join(cut, some.source.eqNullSafe(cut.at_source), "left").withColumn("one", F.expr(f"coalesce(p >= 1 or (q is not null and (at_source is null or {earlier})), false)"))

    taken = picked(rows)
    gap = taken.where("q is not null").groupBy("source", "left").agg(F.coalesce(F.sum(F.when(F.col("one"), F.col("size"))), F.lit(0)).alias("got")).selectExpr("source as gap_source", "left - got as gap")
    gap = scratch.keep(gap, "gap")
    fill = taken.where("q is not null and not one").join(F.broadcast(gap) if _small(gap) else gap, F.expr("source <=> gap_source")).where("abs(gap - size) < gap")
    fill = fill.groupBy("source").agg(F.min(F.struct(F.expr("abs(gap - size)").alias("off"), "q", "doc_id")).alias("best")).select(F.col("source").alias("fill_source"), "best")
    fill = scratch.keep(fill, "fill")

    def decided(some: DataFrame) -> DataFrame:
        more = "not one and q is not null and struct(q, doc_id) <=> struct(best.q, best.doc_id)"
        return picked(some).join(fill, F.expr("source <=> fill_source"), "left").withColumn("copies", F.expr(f"cast(whole + case when one or ({more}) then 1 else 0 end as long)"))

    return rows, repeats, decided


def _crossing(cells: DataFrame, cell: str, base: Column) -> DataFrame:
    """at_source, at, before: the first cell of each source in which the running size passes what the sample takes. At most 1024 rows a source are ordered."""
    run = cells.withColumn("base", base).selectExpr("source", "left", f"{cell} as at", "n", f"base + sum(n) over (partition by source order by {cell} rows unbounded preceding) - n as before")
    return run.where("before + n > left and before <= left").groupBy("source").agg(F.min(F.struct("at", "before")).alias("x")).selectExpr("source as at_source", "x.at as at", "x.before as before")


def _small(cut: DataFrame) -> bool:
    """Whether a table of one row a source is safe to broadcast."""
    return cut.count() <= 100_000


def mixed(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, each as often as it is taken. Rows stay where they are, but for those that repeat in doc_id, source and size."""
    _, repeats, decided = _scheme(docs, scratch, **how)
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    times = F.explode(F.expr("array_repeat(true, cast(copies as int))"))
    return decided(numbered(rows, repeats, scratch, "repeated-rows")).where("copies > 0").select("row", times.alias("once")).select("row.*")


def op3_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, their source's target, and the words the mix takes of each."""
    mix = pareto_mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_sql(seed: str = SEED) -> str:
    """The same mix by plain sorts over all rows of a source, for other engines."""
    return rf"""
with d0 as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
d as (select *, row_number() over (partition by doc_id, source, size) - 1 as nth from d0),
s as (select source, sum(size)::bigint as source_size, sum(size)::bigint * {CAP} as most,
  (array[{", ".join(map(str, WEIGHTS))}])[((row_number() over (order by source asc nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as w from d group by source),
r as (select *, sum(source_size) over ()::double as total,
  (sum(most) over (order by most::double / w, source asc nulls last rows unbounded preceding) - most)::double as filled,
  (sum(w) over () - (sum(w) over (order by most::double / w, source asc nulls last rows unbounded preceding) - w))::double as remaining from s),
l as (select *, max(case when (total - filled) / remaining <= most::double / w then (total - filled) / remaining end) over () as lvl from r),
t as (select source, source_size, case when lvl is null or most::double / w <= lvl then most::double else lvl * w end as target from l),
a as (select d.doc_id, d.size, d.source, t.source_size, t.target, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
  ((('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::varchar, 'null') || case when nth > 0 then '#' || nth else '' end), 1, 12))::bigint)::double + 0.5) / {float(1 << 48)!r}::double as u
  from d join t on d.source is not distinct from t.source),
b as (select *, case when source_size > 0 then target - whole * source_size else 0 end as rest from a),
-- Larger documents are certain as long as the rate that is left for this one and smaller ones is above 1.
e as (select *, coalesce(sum(size) over larger, 0)::double as sure_words, (sum(size::hugeint * size) over (partition by source) - coalesce(sum(size::hugeint * size) over larger, 0))::double as open_squares
  from b window larger as (partition by source order by size desc range between unbounded preceding and current row exclude group)),
f as (select *, case when rest > 0 and size > 0 then (rest - sure_words) / open_squares end as rate from e),
g as (select *, max(case when rate * size <= 1 then size end) over (partition by source) as sure from f),
h as (select *, max(case when size = sure then rate end) over (partition by source) as own_rate, max(case when size = sure then rest - sure_words end) over (partition by source) as remainder from g),
p as (select *, case when size > 0 and rest > 0 then case when size > sure then 1 else own_rate * size end end as p from h),
q as (select *, case when p < 1 and p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from p),
c as (select *, case when q is not null then sum(size) over (partition by source, q is null order by q, doc_id rows unbounded preceding) end as reach from q),
o as (select *, coalesce(p >= 1 or reach <= remainder, false) as one from c),
m as (select *, remainder - coalesce(sum(case when one and q is not null then size end) over (partition by source), 0) as gap from o),
n as (select *, row_number() over (partition by source, (q is not null and not one and abs(gap - size) < gap) order by abs(gap - size), q, doc_id) as nth from m)
select doc_id, size, source_size, target, ((whole + case when one or (q is not null and not one and abs(gap - size) < gap and nth = 1) then 1 else 0 end) * size)::bigint as taken from n
"""


OP3_SQL = op3_sql()
