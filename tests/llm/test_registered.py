"""Registered queries against their SQL, and the pipeline's stages against the operators' definitions."""

import html
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mutaspark.llm import registry

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t[:-8]} as select * from '{SMALL}/{t}'")
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rel = con.sql(registry.ORACLES[name])
    order = [rel.columns.index(c) for c in cols]
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs, first = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if k == 1:
            texts = [r.text.lower() for r in rows]
            assert len(texts) == len(set(texts))
        first = first or len(rows)
    assert 0 < docs.select("doc_id").distinct().count() <= first
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    lengths = pieces.groupby("sequence_id").length.sum()
    assert pieces.length.sum() == lengths.sum() and (lengths <= 2048).all()
    assert corpus_pipeline.run(spark, SMALL).count() == len(pieces)


def test_html_text_of_every_page(spark):
    """The tables' pages hold an article of a heading and paragraphs, so plain text handling can say what op1 must find."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    for r in registry.QUERIES["op1_html_text"](spark, LARGER).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, (want := "\n".join(filter(None, blocks))), len(want))


def test_quality_on_held_out_labels(spark):
    """Labels that no fit has seen: rows of remainder 2."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").where("quality is not null").collect()}
    rows = registry.QUERIES["op9_quality"](spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = np.array([s for s, y in scored if y == 1]), np.array([s for s, y in scored if y == 0])
    auc = np.mean(good[:, None] > bad) + 0.5 * np.mean(good[:, None] == bad)
    assert len(bad) >= 5 and auc > 0.97 and np.mean(good >= 0.7) > 0.9


def test_toxicity_on_held_out_labels(spark):
    """Labels that no fit has seen. The smallest tables have a few dozen toxic texts to learn from, so a larger one is used."""
    tables = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").where("toxic is not null").collect()}
    rows = registry.QUERIES["op11_toxicity"](spark, tables).collect()
    assert len(rows) == spark.read.parquet(f"{tables}/documents.parquet").count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = np.array([s for s, y in scored if y == 1]), np.array([s for s, y in scored if y == 0])
    auc = np.mean(toxic[:, None] > clean) + 0.5 * np.mean(toxic[:, None] == clean)
    assert auc > 0.97 and np.mean(toxic >= 0.3) > 0.85 and np.mean(clean >= 0.3) < 0.01


def test_pipeline_stages_by_their_definitions(spark):
    """Each filtering stage against the plain definition of what it keeps, on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in stages["exact dedup"](spark, docs, SMALL).collect()}
    last = {}
    for r in docs.collect():
        norm = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        last[norm] = max(last.get(norm, -1), r.doc_id)
    assert kept == set(last.values())
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id for r in stages["MinHash near-dedup"](spark, docs, SMALL).collect()} == {i for i in ids if find(i) == i}
    mixed = stages["mixing sources to target weights"](spark, docs, SMALL)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs.withColumn("n", F.explode(F.array_repeat(F.lit(1), 3))).drop("n")).isEmpty()
