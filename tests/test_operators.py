"""As-of join, upper median and top-k against brute force, hot keys included."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventlens.operators.asof import latest_before
from eventlens.operators.fold import last_per_id
from eventlens.operators.median import upper_median, value_figures
from eventlens.operators.topk import top_k


def brute_asof(probes, facts):
    out = []
    for key, seq, name in probes:
        before = [(s, v) for k, s, v in facts if k == key and s < seq]
        out.append((key, seq, name, max(before)[1] if before else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [50, 10**7, 10**12])
def test_asof(spark, spread):
    rng = random.Random(spread)
    seqs = rng.sample(range(spread * 40), 1500)
    # A third of all rows share one key.
    key = lambda: 0 if rng.random() < 0.33 else rng.randrange(1, 60)
    facts = [(key(), s, f"f{s}") for s in seqs[:1000]]
    probes = [(key(), s, f"p{s}") for s in seqs[1000:]]
    got = latest_before(
        spark.createDataFrame(probes, "k int, seq bigint, name string"),
        spark.createDataFrame(facts, "k int, seq bigint, v string"),
        ["k"],
        "v",
    )
    assert rows(got, "k", "seq", "name", "v") == brute_asof(probes, facts)


def test_asof_by_file_position(spark):
    rng = random.Random(1)
    position = lambda i: (i // 40, (i // 8) % 5, i)
    numbers = rng.sample(range(400), 300)
    facts = [(i % 3, position(i), f"f{i}") for i in numbers[:150]]
    probes = [(i % 3, position(i), f"p{i}") for i in numbers[150:]]
    seq = "struct<roll: bigint, split_start: bigint, row: bigint>"
    got = latest_before(
        spark.createDataFrame(probes, f"k int, seq {seq}, name string"),
        spark.createDataFrame(facts, f"k int, seq {seq}, v string"),
        ["k"],
        "v",
    )
    assert rows(got.select("k", "name", "v")) == sorted(
        ((k, n, v) for k, _, n, v in brute_asof(probes, facts)), key=repr
    )


@pytest.mark.parametrize("limit", [3, 1000, 10**6, 2**40])
def test_upper_median(spark, limit):
    rng = random.Random(limit)
    group = lambda: 0 if rng.random() < 0.33 else rng.randrange(1, 30)
    data = [(group(), rng.randrange(-limit, limit)) for _ in range(3000)]
    data += [(5, None), (99, None)]
    want = []
    for g in {g for g, _ in data}:
        values = sorted(v for k, v in data if k == g and v is not None)
        if values:
            want.append((g, len(values), values[len(values) // 2]))
    got = upper_median(spark.createDataFrame(data, "g int, v bigint"), ["g"], "v")
    assert rows(got, "g", "n", "median") == sorted(want, key=repr)


def test_top_k(spark):
    rng = random.Random(3)
    data = [(0 if i % 3 == 0 else i % 17, rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g int, v int, i int")
    got = top_k(df, ["g"], [F.col("v").desc(), F.col("i")], 4)
    want = []
    for g in {g for g, _, _ in data}:
        best = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))[:4]
        want += [(*r, n + 1) for n, r in enumerate(best)]
    assert rows(got, "g", "v", "i", "rank") == sorted(want, key=repr)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_last_per_id(spark):
    df = spark.createDataFrame(
        [([(2, "a"), (1, "b"), (2, "c"), (2, None)],), ([],), (None,)],
        "items array<struct<acc_id: bigint, value: string>>",
    )
    got = df.select(F.inline(last_per_id(F.col("items"))))
    assert rows(got, "acc_id", "value") == [(1, "b"), (2, None)]


def test_value_figures(spark):
    rng = random.Random(4)
    data = []
    for i in range(4000):
        g = rng.choice([0, 0, 0, 1, 2, None, rng.randrange(3, 40)])
        data.append((g, None if g == 2 or rng.random() < 0.2 else rng.randrange(-5, 30), i * 7919 % 4001, i))
    want = []
    for g in {r[0] for r in data}:
        mine = [r for r in data if r[0] == g]
        known = sorted((r for r in mine if r[1] is not None), key=lambda r: (r[1], -r[2]))
        top = known[-1] if known else (None,) * 4
        middle = known[len(known) // 2][1] if known else None
        want.append((g, len(mine), len(known), middle, top[1], top[3]))
    df = spark.createDataFrame(data, "g int, v bigint, o bigint, c int").repartition(5)
    got = value_figures(df, ["g"], "v", F.col("o"), ["c"])
    assert rows(got, "g", "n", "known", "median", "largest", "c") == sorted(want, key=repr)
    assert value_figures(df.limit(0), ["g"], "v").count() == 0
