"""Every registered query of the mutation stream against its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mutaspark.plans import catalogue, wire
from mutaspark.plans.adapters import spread

SMALL = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"create view {name[:-8]} as select * from '{SMALL}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v)
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_wire_queries_are_registered():
    assert catalogue.QUERIES["request_urls"] is wire.request_urls


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_documents_are_shown_and_digested_whole(spark, tmp_path):
    """All rows, against the plain definition: multi-byte text cut at any byte of a character, and nulls."""
    import hashlib

    rows = [(i, "a" * i + c * 9000, "de") for c in "é€😀�" for i in range(4)] + [(0, "é" * 8192, None), (1, None, "en"), (2, "", None), (3, "a" * 16383 + "�\nb", "en"), (4, "short é", "en")]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    shown = lambda t: t and t.encode()[: 16 * 1024].decode(errors="ignore").encode()
    want = {k: (None, None) if t is None else (sha(shown(t) or b""), len(t.encode()) > 16 * 1024) for k, t, _ in rows}
    assert {r.doc_id: (r.shown, r.cut) for r in catalogue.QUERIES["printable_documents"](spark, str(tmp_path)).collect()} == want
    own = lambda *fields: sha(b"".join(b"%d:%s" % (len(f), f) for f in ((x or "").encode() for x in fields)))
    assert {r.doc_id: r.digest for r in catalogue.QUERIES["document_digests"](spark, str(tmp_path)).collect()} == {k: own(t, lang) for k, t, lang in rows}


def test_a_single_row_group_is_dealt_out_however_many_splits_its_file_has(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 512).alias("props")).coalesce(1).write.parquet(str(tmp_path / "events"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        scan = spark.read.parquet(str(tmp_path / "events"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        held = [r["count"] for r in spread(scan).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 40_000 and max(held) <= 2 * 40_000 / spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
