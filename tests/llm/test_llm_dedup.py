"""Exact dedup, n-gram join, decontamination and repeated strings against plain versions."""

import random

import plain as P
import pytest
from pyspark.sql import functions as F

from eventlens.llm.components import components
from eventlens.llm.decontaminate import decontaminate
from eventlens.llm.exact_dedup import exact_dedup
from eventlens.llm.ngram_join import ngram_join
from eventlens.llm.repeats import previous_factors, remove_repeats

PAIRS = [r[:2] for r in P.edge_rows()]


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exact_dedup(spark):
    out = exact_dedup(P.edge_docs(spark).repartition(7), fan_in=2)
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(out, *names) == sorted(P.exact(PAIRS), key=repr)
    assert exact_dedup(P.no_docs(spark)).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', string(id)) as text")
    out = exact_dedup(docs.repartition(40), fan_in=3)
    assert out.filter("kept").count() == 2001
    assert got(out.filter("text_sha256 = sha2('same', 256)").select("keep_id", "group_size").distinct(), "*") == [(0, 1000)]


def test_every_merge_is_one_of_sorted_runs(spark):
    """Each round of the tree puts its rows in the order of digests."""
    from eventlens.llm.exact_dedup import digest_runs, merge_runs

    runs = digest_runs(P.edge_docs(spark)).withColumn("run", F.pmod(F.hash("text_key"), F.lit(20)))
    runs = runs.union(runs.limit(1).withColumn("run", F.lit(19)))
    plan = merge_runs(runs, 3)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert len(sorts) == 3 and all("text_sha256" in line and "keep_id" in line for line in sorts)


@pytest.fixture(scope="module")
def items():
    base = P.words(120, 7)
    return [
        (1, " ".join(base[5:30])), (2, " ".join(base[20:32]).upper()), (3, "no such words here at all in any of the texts"),
        (4, "one two, THREE"), (5, None), (6, ""), (7, "x"), (8, " ".join(base[5:30])), (9, "..."), (None, "alpha"),
    ]


def test_decontaminate(spark, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(P.edge_docs(spark), benchmark)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = P.contaminated(PAIRS, [i for i in items if i[0] is not None])
    assert got(out, *names) == sorted(want, key=repr)
    assert decontaminate(P.no_docs(spark), benchmark).count() == 0
    empty = decontaminate(P.edge_docs(spark), benchmark.filter("item_id > 100"))
    assert empty.filter("contaminated or n_items > 0").count() == 0
    assert empty.count() == len(PAIRS)


def test_every_shared_span_is_found(spark):
    rng, rows, items = random.Random(5), [], []
    for i in range(40):
        passage = P.words(10 + i % 4, 100 + i)
        items.append((i, " ".join(passage)))
        at = rng.randrange(30)
        host = P.words(60, 500 + i)
        rows.append((i, " ".join(host[:at] + passage + host[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(out, *names) == sorted(P.contaminated(rows, items), key=repr)
    assert out.filter("contaminated").count() == 40


def test_ngram_join(spark):
    out = ngram_join(P.edge_docs(spark))
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(P.similar(PAIRS), key=repr)
    assert ngram_join(P.no_docs(spark)).count() == 0


def test_ngram_join_of_random_near_copies(spark):
    """Chains and stars of near copies around the threshold, and a passage that all share."""
    rng, rows = random.Random(3), []
    shared = P.words(60, 1)
    for g in range(12):
        base = P.words(80, 10 + g)
        for _ in range(15):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text + (shared if g % 2 else []))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join(docs)
    assert got(out, "doc_id", "n_shingles", "component_id") == sorted(P.similar(rows), key=repr)
    kept = out.filter("kept").count()
    assert kept == out.select("component_id").distinct().count()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 200)] + [(300, i) for i in range(301, 340)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = sorted(((x, root(x)) for x in parent), key=repr)
    df = spark.createDataFrame(links, "a long, b long")
    assert got(components(df), "node", "component") == want
    assert components(df.limit(0)).count() == 0


def test_remove_repeats(spark):
    out = remove_repeats(P.edge_docs(spark))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(out, *names) == sorted(P.repeats(PAIRS), key=repr)
    assert remove_repeats(P.no_docs(spark)).count() == 0
    whole = out.filter("doc_id = 12").first()
    assert bytes(whole.kept) == b"" or P.sha(bytes(whole.kept)) == whole.kept_sha256


def test_remove_repeats_with_frequent_lines(spark, monkeypatch):
    """A line in all documents, between others; also with every gram taken as frequent."""
    line = "this very line stands in each and every one of the documents and is longer than one hundred bytes, so it goes"
    rows = [(i, f"{' '.join(P.words(12, i))} {line} {' '.join(P.words(12, 900 + i))}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(P.repeats(rows), key=repr)
    assert got(remove_repeats(docs), *names) == want
    from eventlens.llm import repeats

    grams = [r[0] for r in repeats._anchor_rows(docs.selectExpr("doc_id", "xxhash64(text) as text_key", "cast(text as binary) as text"), 100, 32).select("gram").distinct().collect()]
    monkeypatch.setattr(repeats, "_frequent", lambda *_: sorted(grams))
    monkeypatch.setattr(repeats, "BATCH_BYTES", 2000)
    assert got(repeats.remove_repeats(docs), *names) == want


def test_remove_repeats_next_to_a_piece_of_short_texts(spark):
    """A full piece of 1 MB, then only short, empty and null texts in the same batch."""
    full = [(i, " ".join(P.words(6000, 2000 + i))[: 1 << 15]) for i in range(32)]
    short = [(100 + i, [None, "", "short", "x" * 99][i % 4]) for i in range(40)]
    other = [(200 + i, f"{' '.join(P.words(20, 3000 + i))} {full[i][1][500:900]} end") for i in range(32)]
    parts = [
        spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")
        for rows in (full + short, other)
    ]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(P.repeats(full + short + other), key=repr)
    assert got(remove_repeats(parts[0].union(parts[1])), *names) == want


def test_previous_factors():
    import numpy as np

    data = np.frombuffer(b"abcabcabdabcabcabd" * 20 + b"zzzz", np.uint8)
    for length in (9, 16, 20, 100):
        starts = np.arange(len(data) - length + 1)
        seen, want = set(), []
        for s in starts:
            piece = data[s : s + length].tobytes()
            want.append(piece in seen)
            seen.add(piece)
        assert previous_factors(data, starts, length).tolist() == want


def test_texts_of_one_id_are_told_by_long_hashes(spark):
    """Two texts of one id whose 32-bit hashes are equal: the repeat in the second goes."""
    b = "repeated words " * 9
    rows = [(1, b), (5, "another text of the same id, that is long enough for a string of a hundred bytes " * 2), (5, b), (None, b), (None, "x" * 120)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_bytes=False)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(P.repeats(rows), key=repr)
    kinds = dict(out.dtypes)
    assert kinds["text_key"] == "bigint"
