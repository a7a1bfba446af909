"""What Python tasks of the n-gram join hold does not grow with the texts."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from eventlens.llm import ngram_join as N
from eventlens.llm.common import batches_of
from eventlens.llm.textbytes import shingle_sets, tidy

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark):
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("ab"), 5000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    def found():
        return [r[0] for r in texts.mapInArrow(tidy(sizes), "n long").collect()]

    before = spark.conf.get(BATCH, None)
    with batches_of(spark, 1 << 18):
        small = found()
    assert sum(small) == 400 and max(small) <= 30
    assert spark.conf.get(BATCH, None) == before
    with pytest.raises(ValueError), batches_of(spark, 1):
        raise ValueError
    assert spark.conf.get(BATCH, None) == before and found() == [400]


def test_join_takes_texts_in_small_batches(spark, monkeypatch):
    seen, write = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        seen[path.split("/")[-1].rsplit("-", 1)[0]] = spark.conf.get(BATCH, None)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    text = F.concat_ws(" ", F.lit("one two three four five six seven eight"), F.expr("id % 3"))
    N.ngram_join(spark.range(9).select(F.col("id").alias("doc_id"), text.alias("text"))).count()
    for name in ("prefixes", "links-0", "links-1", "links-last"):
        assert seen[name] == str(N.BATCH_BYTES)
    assert seen["classes"] is None


class Docs:
    """Keeps the function of a task, so that it can be called here."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        self.task = task
        raise StopIteration


@pytest.mark.parametrize("block", [1, 40, 1 << 22])
def test_recurring_shingles_are_counted_by_block(monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    docs = Docs()
    with pytest.raises(StopIteration):
        N._frequent(docs, 1)
    texts = [["a b c d", "b c", None, ""], ["", None], ["c d e", "x", "c"], [" ".join(map(str, range(50)))]]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["text"]) for t in texts]
    (out,) = docs.task(iter(batches))
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))

    want, held = Counter(), []
    for words in ([w for t in ts if t for w in t.split()] for ts in texts):
        held += words
        if len(held) >= block:
            want.update({w: n for w, n in Counter(held).items() if n > 1})
            held = []
    want.update({w: n for w, n in Counter(held).items() if n > 1})

    def key(word):
        data = np.frombuffer(word.encode(), np.uint8)
        (one,) = shingle_sets(data, np.array([0, len(data)]), 1)
        return int(one.view(np.int64)[0])

    assert got == {key(w): n for w, n in want.items()}
    for few in ([], batches[1:2]):
        assert sum(b.num_rows for b in docs.task(iter(few))) == 0
