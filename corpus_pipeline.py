"""The corpus pipeline: documents to a mixed training set, stage by stage.

Rows that share an id but not a text are documents of their own in every stage; null ids
and texts are kept or dropped like others.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.common import KEY, fresh, stored, without
from eventlens.llm.decontaminate import decontaminate
from eventlens.llm.exact_dedup import exact_dedup
from eventlens.llm.language_id import UNDETERMINED, fit_language_id, identify_languages
from eventlens.llm.mixing import mix_sources
from eventlens.llm.ngram_join import ngram_join

#: Mean probability of its language below which a document is in none of those learned.
#: A clean text of two words has more.
MIN_LANGUAGE_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the network knows, go.

    Where no row has a language, nothing can be learned and only texts without a letter go.
    """
    net = fit_language_id(docs)
    found = identify_languages(docs, net)
    if net is None:
        return docs.filter(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))
    unknown = (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < MIN_LANGUAGE_SCORE)
    return without(docs, found.filter(unknown))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays.

    Of repeated rows of that one, the first in the order of the other columns, as JSON, stays.
    """
    found = stored(exact_dedup(docs).select(*KEY, "kept"), "copies")
    repeated = found.filter("kept").groupBy(*KEY).count().filter("count > 1").select(*KEY)
    repeated = stored(repeated, "repeated")
    kept = without(docs, found.filter("not kept"))
    if repeated.isEmpty():
        return kept
    key, same_id, same_key, n, order = (fresh(x) for x in ("key", "id", "text", "n", "order"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # As JSON, since columns of some types have no order.
    again = kept.withColumns(
        {key: F.xxhash64(F.col("text").cast("string")), order: F.to_json(F.struct("doc_id", *others))}
    )
    again = again.join(
        repeated.select(F.col("doc_id").alias(same_id), F.col("text_key").alias(same_key)),
        again["doc_id"].eqNullSafe(F.col(same_id)) & again[key].eqNullSafe(F.col(same_key)),
        "left_semi",
    )
    first = Window.partitionBy("doc_id", key).orderBy(order)
    one = again.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1)
    return without(kept, repeated).unionByName(one.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id stays."""
    return without(docs, ngram_join(docs).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate(docs, items).filter("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies`` and ``taken`` words.

    Added columns: size, source_size, target, copies, taken.  A document is in the result
    once, whatever its number of copies.
    """
    chosen = mix_sources(docs).filter("copies > 0").dropDuplicates(list(KEY))
    columns = ["size", "source_size", "target", "copies", "taken"]
    chosen = stored(chosen.select(*KEY, *columns), "mix")
    clash = [c for c in docs.columns if c not in columns]
    same_id, same_key = fresh("id"), fresh("key")
    ids = chosen.select(
        F.col("doc_id").alias(same_id), F.col("text_key").alias(same_key), *columns
    )
    same = docs["doc_id"].eqNullSafe(F.col(same_id)) & F.xxhash64(
        docs["text"].cast("string")
    ).eqNullSafe(F.col(same_key))
    return docs.select(*clash).join(ids, same).select(*clash, *columns)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: The network of the first stage and the hashes that draw the mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
