"""The corpus pipeline, stage by stage, against plain versions; the registered queries."""

import plain as P
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline as C
from __spark_entry__ import oracle_sql, queries
from eventlens.llm.common import ranked, without

STAGES = dict(C.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    base = P.words(120, 7)
    items = [(1, " ".join(base[5:30])), (2, "one two three")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = P.edge_rows()
    rows += [(100 + i, " ".join(P.words(40, 50 + i // 2)), "en", "web", 1, *["c"] * len(P.CLASHES)) for i in range(20)]
    spark.createDataFrame(rows, P.SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path), items, rows


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def run_stage(spark, name, docs, path):
    out = STAGES[name](spark, docs, path)
    if name != "source_mixing":
        assert out.columns == docs.columns
        assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
    return out


def test_stage_order():
    assert [n for n, _ in C.STAGES] == [
        "language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "source_mixing"
    ]


def test_language_stage(spark, folder):
    path, _, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = pairs(run_stage(spark, "language_id", docs, path))
    letters = [r[:2] for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert set(out) <= set(letters)
    assert len(out) > 0.9 * len(letters)


def test_exact_stage(spark, folder):
    path, _, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = {(r[0], r[1]) for r, e in zip(rows, P.exact([r[:2] for r in rows]), strict=True) if e[3]}
    out = pairs(run_stage(spark, "exact_dedup", docs, path))
    assert out == sorted(want, key=repr)  # of repeated rows one is left


def test_near_stage(spark, folder):
    path, _, _ = folder
    docs = STAGES["exact_dedup"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    rows = pairs(docs)
    out = pairs(run_stage(spark, "ngram_jaccard_join", docs, path))
    found = P.similar(rows)
    parts = {i for i, _, c in found if i == c}
    assert {i for i, _ in out if i is not None} == parts - {None}
    assert pairs(STAGES["ngram_jaccard_join"](spark, docs.filter("doc_id = 7"), path)) == [r for r in rows if r[0] == 7]


def test_decontamination_stage(spark, folder):
    path, items, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = [r[:2] for r, e in zip(rows, P.contaminated([r[:2] for r in rows], items), strict=True) if not e[5]]
    assert pairs(run_stage(spark, "decontamination", docs, path)) == sorted(want, key=repr)


def test_mixing_stage(spark, folder):
    path, _, _ = folder
    docs = STAGES["exact_dedup"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    out = STAGES["source_mixing"](spark, docs, path)
    assert set(docs.columns) - {"copies"} <= set(out.columns)
    assert set(pairs(out)) <= set(pairs(docs))
    assert out.filter("copies < 1 or copies > 3 or taken <> copies * size").count() == 0


def test_run_on_edge_rows_and_nothing(spark, folder, tmp_path):
    path, _, _ = folder
    assert 0 < C.run(spark, path).count() < 40
    P.no_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_run_on_the_given_tables(spark):
    out = C.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 0.5 * docs.count() < out.count() <= docs.count()


def test_registered(spark):
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries() and set(oracle_sql()) <= set(queries())


def test_without_and_ranked(spark):
    docs = P.edge_docs(spark)
    none = docs.selectExpr("doc_id", "xxhash64(text) as text_key").limit(0)
    assert without(docs, none).count() == docs.count()
    all_ = docs.selectExpr("doc_id", "xxhash64(text) as text_key")
    assert without(docs, all_).count() == 0
    one = all_.filter("doc_id is null")
    assert without(docs, one).filter("doc_id is null").count() == 0
    assert without(docs, one).count() == docs.filter("doc_id is not null").count()
    r = ranked(spark.range(1000).selectExpr("string(id) as s"), [F.col("s")])
    assert [x.s for x in r.orderBy("rank").collect()] == sorted(map(str, range(1000)))
