"""The Merkle manifest against a plain version."""

import plain as P
import pytest
from pyspark.sql import functions as F

from eventlens.llm import merkle as M
from eventlens.llm.queries import merkle_digests


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_edge_rows_and_an_empty_table(spark):
    docs = P.edge_docs(spark)
    assert got(merkle_digests(docs)) == sorted(P.merkle(plain_rows(docs)), key=repr)
    assert merkle_digests(P.no_docs(spark)).count() == 0
    one = docs.filter("doc_id = 7")
    assert got(merkle_digests(one)) == P.merkle(plain_rows(one))


@pytest.mark.parametrize("digits", [1, 2])
def test_sources_of_many_blocks(spark, monkeypatch, digits):
    """Several tiers of blocks, in the tree of a hot source and in the one over sources."""
    monkeypatch.setattr(M, "DIGITS", digits)
    docs = spark.range(90).selectExpr(
        "id * 7 % 90 as doc_id", "concat('line ', id % 5, '\n', 'x') as text", "'en' as lang",
        "if(id % 3 = 0, 'hot', concat('s', id % 13)) as source", "if(id % 4 = 0, null, id) as n_chars",
    )
    assert got(merkle_digests(docs)) == sorted(P.merkle(plain_rows(docs)), key=repr)


def test_a_changed_row_is_found_and_others_stay(spark):
    docs = P.edge_docs(spark).filter("doc_id between 5 and 9")
    rows = M.merkle_manifest(docs, ("doc_id", "text"))
    fake = F.when(F.col("id") == 7, M.hashed(M.told(F.lit("7")), M.told(F.lit("other")))).otherwise(F.col("leaf"))
    ok = rows.select("id", (M.folded(fake, F.col("path")) == F.col("root")).alias("ok"))
    assert {r[0] for r in ok.filter("not ok").collect()} == {7}


def test_blocks_take_one_exchange_and_proofs_no_join(spark):
    nodes = spark.range(2000).selectExpr("string(id % 2) as part_of", "id as rank", "int(id % 2 + 7) as height", "sha2(string(id), 256) as h", "id as item")
    rolled = M._rolled_up(nodes, 0)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    above = spark.createDataFrame([], "part_of string, block long, above " + M._ABOVE)
    plan = M._unrolled(rolled, above)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
