"""SimHash near copies against plain versions."""

import random

import numpy as np
import plain as P
import pytest
from pyspark.sql import functions as F

from eventlens.llm import simhash as S
from eventlens.llm.components import components

PAIRS = [r[:2] for r in P.edge_rows()]


def want(rows):
    prints = [P.simhash(t) for _, t in rows]
    groups = {}
    least = P.close_components(prints)
    for (i, _), g in zip(rows, least, strict=True):
        groups.setdefault(g, []).append(i)
    first = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, f"{p:016x}", first[g]) for (i, _), p, g in zip(rows, prints, least, strict=True)]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_edge_rows_and_an_empty_table(spark):
    assert got(S.simhash_join(P.edge_docs(spark))) == sorted(want(PAIRS), key=repr)
    assert S.simhash_join(P.no_docs(spark)).count() == 0


def test_fingerprints_of_slices(monkeypatch):
    text = "  One TWO\tthree\n\nfour five six " * 40 + "Ünï end"
    whole = S.fingerprint(text.encode())
    assert whole == P.simhash(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(S, "SLICE", size)
        assert S.fingerprint(text.encode()) == whole
        assert S.fingerprint(b"one  two three") == P.simhash("one two three")
        assert S.fingerprint(b" \n ") == S.fingerprint(b"") == 0


def flips(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def cloud(seed, groups, size, spread, alone):
    """Random fingerprints: groups around centres, chains of links, and single ones."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(alone)}
    for _ in range(groups):
        at = centre = rng.getrandbits(64)
        for _ in range(size):
            out.add(flips(rng, centre, rng.randrange(spread + 1)))
            at = flips(rng, at, 4)
            out.add(at)
    return sorted(out)


def check(spark, prints, bits=4):
    longs = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in longs], "print long").repartition(5)
    links = S.close_fingerprints(df, bits)
    for a, b in links.collect():
        assert a != b
    of = {r[0]: r[1] for r in components(links).collect()}
    least = P.close_components(prints, bits)
    plain, ours = {}, {}
    for i, p in enumerate(longs):
        plain.setdefault(least[i], set()).add(p)
        ours.setdefault(of.get(p, p), set()).add(p)
    assert sorted(map(sorted, plain.values())) == sorted(map(sorted, ours.values()))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 7])
def test_close_links_of_all_pairs(bits):
    prints = np.array(cloud(bits, 12, 20, bits + 2, 900), np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints) <= bits
    forest = S.Forest(len(prints))
    for mask, radius in S.masks(bits):
        half = len(prints) // 2
        root = S.close_links(prints[:half], prints, mask, radius, bits)
        forest.link(np.r_[:half, : len(prints)], np.r_[:half, : len(prints)][root])
        root = S.close_links(prints[half:], prints, mask, radius, bits)
        at = np.r_[half : len(prints), : len(prints)]
        forest.link(at, at[root])
    root = forest.roots(np.arange(len(prints)))
    a, b = np.nonzero(near)
    assert (root[a] == root[b]).all()
    least = P.close_components(prints.tolist(), bits)
    assert len(set(least)) == len(np.unique(root))


def test_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 60)
    monkeypatch.setattr(S, "LEAF", 8)
    check(spark, cloud(1, 12, 15, 6, 500))


def test_hot_groups_are_settled(spark, monkeypatch):
    """Two large groups, one of them near a third, in shards that are dealt out."""
    for name, value in {"SHARD": 60, "LEAF": 8, "SAMPLE": 200, "MOST_MEMBERS": 16, "MOST_QUERIES": 40}.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(4)
    centre, other = rng.getrandbits(64), rng.getrandbits(64)
    prints = {flips(rng, centre, rng.randrange(5)) for _ in range(300)}
    prints |= {flips(rng, other, rng.randrange(4)) for _ in range(200)}
    prints |= {flips(rng, flips(rng, other, 9), rng.randrange(3)) for _ in range(60)}
    prints |= {flips(rng, centre, 7) for _ in range(40)} | {rng.getrandbits(64) for _ in range(200)}
    check(spark, sorted(prints))


def test_settled_groups_that_only_their_rims_link(spark):
    """Two hubs 12 bits apart; one member of each, 4 bits from its hub and from the other one."""
    ends = [0, 0xFFF]
    prints = {0, 0xFFF, 0xF, 0xFF} | {e ^ 1 << b for e in ends for b in range(20, 40)}
    assert len(S.Hubs(np.array(sorted(prints), np.uint64), 4).prints) == 2
    check(spark, sorted(prints))


def test_copies_meet_once(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "one text for a third of all rows").otherwise(F.concat(F.lit("a b c "), F.col("id"))).alias("text"),
    )
    out = S.simhash_join(docs).filter("doc_id % 3 = 0")
    assert out.select("component_id").distinct().collect() == [(0,)]
    assert out.count() == 1334
