"""Near copies by SimHash: fingerprints, and vantage-point trees that find close ones."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import keyed, stored
from eventlens.llm.components import components
from eventlens.llm.textbytes import pieces

#: Distinct fingerprints, drawn by their hashes, that shape the upper trees; about as many.
SAMPLE = 4096
#: Members that a shard should have, and members and queries of one task at most: larger
#: shards are dealt out to several tasks, so these change speed only.
SHARD, MOST_MEMBERS, MOST_QUERIES = 1 << 15, 1 << 16, 1 << 18
#: Leaves of one upper tree, at most.
MOST_SHARDS = 1024
#: Members of a leaf of a lower tree, which are all compared with its queries.
LEAF = 192
#: Neighbours within the sample that make a fingerprint a hub.
HUB = 8
#: Bytes of a text that are handled at once.
SLICE = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = b" \t\n\v\f\r"


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a text that end at white space."""
    start = 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[start:end]
        start = end


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text: a bit is set where over half of the shingles' hashes have it."""
    votes, n, last = np.zeros(64, np.int64), 0, []
    total = 0
    for part in _slices(text.translate(_LOWER)):
        found = part.split()
        total += len(found)
        found = last + found
        if len(found) < words:
            last = found
            continue
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = np.concatenate([[0], ends[: len(found) - words]]).tolist()
        ends = (ends[words - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], "<u8"
        )
        for at in range(0, len(hashes), 1 << 16):
            block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        last = found[len(found) - words + 1 :] if words > 1 else []
    if not n and total:
        return xxhash.xxh64_intdigest(b" ".join(last), seed)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, text_key, print)`` of rows ``(doc_id, text_key, text)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [
                fingerprint(data[x:y].tobytes(), words, seed)
                for _, _, data, offsets in pieces(batch, "text")
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "text_key", "print"],
            )

    return docs.mapInArrow(make, "doc_id long, text_key long, print long")


def masks(bits: int) -> list[tuple[np.uint64, int]]:
    """Parts of the 64 bits, and how far apart close fingerprints are in one of them.

    Where all 64 bits are random, a ball of 4 bits covers most distances to a vantage
    point, and no branch could be left out.  Of ``p`` parts one has ``bits // p``
    differing bits at most, and a third of the bits with one of them is a small ball.
    """
    parts = max(1, min(64, (bits + 2) // 2))
    cuts = [64 * i // parts for i in range(parts + 1)]
    made = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        made.append((np.uint64(((1 << (b - a)) - 1) << a), bits // parts))
    return made


def distances(prints: np.ndarray, other: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ other)


def _split(d: np.ndarray) -> int | None:
    """The radius around a vantage point that parts its members best; None if none does."""
    lowest, highest = int(d.min()), int(d.max())
    if lowest == highest:
        return None
    return min(max(int(np.median(d)), lowest), highest - 1)


class UpperTree:
    """A vantage-point tree over a sample, whose leaves are shards of all fingerprints."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, radius: int, shards: int):
        self.mask, self.radius = mask, radius
        self.nodes: list[tuple[np.uint64, int, int, int]] = []  # vantage point, split, inner, outer
        self.shards = 0
        self.root = self._grow(sample & mask, shards)

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        """The index of a node, or -1 - shard for a leaf."""
        split = None
        if shards > 1 and len(sample) > 1:
            # Of a few vantage points the one with the widest spread parts members best.
            some = sample[np.linspace(0, len(sample) - 1, min(8, len(sample))).astype(int)]
            spread = [distances(sample, p).std() for p in some]
            vantage = some[int(np.argmax(spread))]
            d = distances(sample, vantage)
            split = _split(d)
        if split is None:
            self.shards += 1
            return -self.shards
        at = len(self.nodes)
        self.nodes.append((vantage, split, 0, 0))
        inner = self._grow(sample[d <= split], ceil(shards / 2))
        outer = self._grow(sample[d > split], shards // 2)
        self.nodes[at] = (vantage, split, inner, outer)
        return at

    def visits(self, prints: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(shard, rows, is home)``: shards that can hold something close to each row.

        One that lies within the radius of a node's bound goes to both sides.
        """
        out, codes = [], prints & self.mask
        todo = [(self.root, np.arange(len(prints)), np.ones(len(prints), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-1 - node, rows, home))
                continue
            vantage, split, inner, outer = self.nodes[node]
            d = distances(codes[rows], vantage).astype(np.int64)
            near, far = d - self.radius <= split, d + self.radius > split
            todo.append((inner, rows[near], home[near] & (d <= split)[near]))
            todo.append((outer, rows[far], home[far] & (d > split)[far]))
        return out


class Forest:
    """Sets of linked positions, with the smallest one as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        parent = self.parent
        up = parent[at]
        while True:
            higher = parent[up]
            if (higher == up).all():
                parent[at] = up
                return up
            up = higher

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            a, b = low[open_], high[open_]
            # Of several links of one root the smallest counts; the others come again.
            np.minimum.at(self.parent, b, a)


def close_links(
    members: np.ndarray, queries: np.ndarray, mask: np.uint64, radius: int, bits: int
) -> np.ndarray:
    """For each member, then each query, the position of one that it is linked with.

    A vantage-point tree of the members is grown and asked at once: a node splits its
    members, and its queries by the triangle bound.  In its leaves, all 64 bits count.
    Groups of links come out as trees of links, however many pairs they have.
    """
    n = len(members)
    forest = Forest(n + len(queries))
    codes, asked = members & mask, queries & mask
    todo = [(np.arange(n), np.arange(len(queries)))]
    while todo:
        rows, asking = todo.pop()
        if not len(rows) or not len(asking):
            continue
        split = None
        if len(rows) > LEAF:
            vantage = codes[rows[len(rows) // 2]]
            d = distances(codes[rows], vantage)
            split = _split(d)
        if split is not None:
            q = distances(asked[asking], vantage).astype(np.int64)
            todo.append((rows[d <= split], asking[q - radius <= split]))
            todo.append((rows[d > split], asking[q + radius > split]))
            continue
        # Members with one code can be many: the most recent roots leave out what is linked.
        for first in range(0, len(rows), LEAF):
            some = rows[first : first + LEAF]
            for at in range(0, len(asking), 4096):
                few = asking[at : at + 4096]
                close = np.bitwise_count(members[some][:, None] ^ queries[few]) <= bits
                a, b = np.nonzero(close)
                forest.link(some[a], n + few[b])
    return forest.roots(np.arange(len(forest.parent)))


class Hubs:
    """Centres of large groups of close fingerprints, found in the sample.

    ``group`` tells which hubs are linked within the sample, and ``links`` leads from each
    hub to one member of its group, as the members between two hubs may all be settled;
    ``open`` has the groups that could be close to another one, by the triangle bound.
    """

    def __init__(self, sample: np.ndarray, bits: int):
        forest = Forest(len(sample))
        near = []
        for at in range(0, len(sample), 512):
            d = np.bitwise_count(sample[at : at + 512, None] ^ sample)
            a, b = np.nonzero(d <= bits)
            forest.link(a + at, b)
            near.append((a + at, b))
        a, b = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, int),) * 2
        chosen, left = [], np.ones(len(sample), bool)
        while len(a):
            counts = np.bincount(a[left[b]], minlength=len(sample)) * left
            top = int(counts.argmax())
            if counts[top] < HUB:
                break
            chosen.append(top)
            left[b[a == top]] = False
        self.bits = bits
        self.prints = sample[chosen]
        self.group = forest.roots(np.array(chosen, int)) if chosen else np.zeros(0, int)
        self.links = [(a, b) for a, b in zip(self.prints, sample[self.group], strict=True) if a != b]
        apart = np.bitwise_count(self.prints[:, None] ^ self.prints) > 3 * bits
        other = self.group[:, None] != self.group
        self.open = np.unique(self.group[(~apart & other).any(axis=1)])

    def of(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of a hub within reach of each fingerprint, or -1; and whether it is settled.

        A settled one is close to others of its group, which need no comparison, or to
        members without a hub, but not to members of another group.
        """
        hub = np.full(len(prints), -1)
        for i in reversed(range(len(self.prints))):
            hub[distances(prints, self.prints[i]) <= self.bits] = i
        settled = hub >= 0
        settled[settled] = ~np.isin(self.group[hub[settled]], self.open)
        return hub, settled


def _visits(prints: DataFrame, trees: list[UpperTree], hubs: Hubs) -> DataFrame:
    """``(shard, print, member)``: each fingerprint once as a member of a shard of each
    tree, unless it is settled, and once as a query of each shard that it could meet."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            _, settled = hubs.of(codes)
            base = 0
            for tree in trees:
                for shard, rows, home in tree.visits(codes):
                    members = rows[home & ~settled[rows]]
                    both = np.concatenate([members, rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(both), base + shard, np.int32)),
                            pa.array(codes[both].view(np.int64)),
                            pa.array(np.arange(len(both)) < len(members)),
                        ],
                        names=["shard", "print", "member"],
                    )
                base += tree.shards

    return prints.select("print").mapInArrow(route, "shard int, print long, member boolean")


def _dealt(visits: DataFrame) -> DataFrame:
    """Adds ``task``: of a large shard, every part of its members meets every part of its queries."""
    sizes = visits.groupBy("shard").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q"))
    # One row a shard, of which there are MOST_SHARDS a tree at most.
    parts = sizes.filter("m > 0").select(
        F.col("shard").alias("of"),
        F.ceil(F.col("m") / MOST_MEMBERS).alias("m"),
        F.ceil(F.col("q") / MOST_QUERIES).alias("q"),
    )
    own = F.pmod(F.xxhash64("print"), F.when(F.col("member"), F.col("m")).otherwise(F.col("q")))
    tasks = F.when(
        F.col("member"), F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: own * F.col("q") + j)
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: i * F.col("q") + own))
    return visits.join(F.broadcast(parts), F.col("shard") == F.col("of")).select(
        "shard", F.explode(tasks).alias("task"), "member", "print"
    )


def close_fingerprints(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Links ``(a, b)`` of distinct fingerprints ``(print)`` that join all close ones.

    Close means ``bits`` differing bits at most.  Not all pairs come out, but the links
    have the components that all pairs would have.

    For each of a few parts of the bits (:func:`masks`), a vantage-point tree over a sample of
    ``SAMPLE`` fingerprints parts all of them into shards by Hamming distance; each is a
    member of one shard, and a query in those that its ball overlaps.  Tasks grow
    the trees on within their shard, leave out branches by the triangle bound, and
    compare all bits in the leaves.

    A group with a good share of all fingerprints shows in the sample: what is close to its hubs is
    linked to them where it is read, and is then only a query, so its members are never
    compared with each other; its hubs are linked as they are in the sample.
    """
    n = prints.count()
    drawn = prints.select("print").filter(
        F.pmod(F.xxhash64("print"), F.lit(1 << 40)) < F.lit(round((1 << 40) * min(1, SAMPLE / max(n, 1))))
    )
    sample = np.array(sorted(r[0] for r in drawn.collect()), np.int64).view(np.uint64)
    hubs = Hubs(sample, bits)
    _, settled = hubs.of(sample)
    rest = sample[~settled]
    shards = ceil(n * len(rest) / max(len(sample), 1) / SHARD)
    shards = min(max(shards, 1), MOST_SHARDS)
    trees = [UpperTree(rest, mask, radius, shards) for mask, radius in masks(bits)]
    of_shard = [(tree.mask, tree.radius) for tree in trees for _ in range(tree.shards)]

    def to_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            hub, _ = hubs.of(codes)
            at = np.flatnonzero((hub >= 0) & (hubs.prints[hub] != codes) if len(hubs.prints) else hub > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[at].view(np.int64)), pa.array(hubs.prints[hub[at]].view(np.int64))],
                names=["a", "b"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer() -> pa.RecordBatch:
            mask, radius = of_shard[key[0]]
            members, queries = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in held)
            both = np.concatenate([members, queries]).view(np.uint64)
            root = close_links(both[: len(members)], both[len(members) :], mask, radius, bits)
            a, b = both.view(np.int64), both[root].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        key, held = None, ([], [])
        for batch in batches:
            shard, task, member, codes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (task[1:] != task[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(shard)]
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if x == y:
                    continue
                if (shard[x], task[x]) != key:
                    if key is not None:
                        yield answer()
                    key, held = (shard[x], task[x]), ([], [])
                is_member = member[x:y].astype(bool)
                held[0].append(codes[x:y][is_member])
                held[1].append(codes[x:y][~is_member])
        if key is not None:
            yield answer()

    visits = stored(_visits(prints, trees, hubs), "visits")
    found = (
        _dealt(visits).repartition("shard", "task").sortWithinPartitions("shard", "task")
        .mapInArrow(search, "a long, b long")
    )
    found = found.union(prints.mapInArrow(to_hub, "a long, b long"))
    if hubs.links:
        longs = np.array(hubs.links, np.uint64).view(np.int64).tolist()
        found = found.union(prints.sparkSession.createDataFrame(longs, "a long, b long"))
    return stored(found.distinct(), "close")


def simhash_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4,
    seed: int = 42,
) -> DataFrame:
    """The fingerprint of each document, and its component of close ones.

    Columns: doc_id, text_key, print (the fingerprint's 64 bits as a long), fingerprint
    (16 hexadecimal digits), component_id (smallest doc_id of the component).

    Shingles are ``words`` consecutive words (A-Z lowered, split at ASCII white space,
    joined by a space), repeats included; a text with fewer words is one shingle.  A
    fingerprint's bit is set where over half of the shingles' XXH64 have it.  Documents
    are linked where ``bits`` bits differ at most; see :func:`close_fingerprints`.

    Null texts and those without a word have fingerprint zero and are linked like others.
    Texts of any length are read whole, a slice at a time.  Equal fingerprints meet once, whatever
    the number of their documents.  Ids become longs; null ids count
    only where a component has no other.  Repeated rows have a row each.  An empty table gives an empty
    result.  Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = stored(fingerprints(rows, words, seed), "fingerprints")
    prints = stored(made.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    of = components(close_fingerprints(prints, bits))
    named = stored(
        prints.join(of, prints["print"] == of["node"], "left").select(
            "print", "least", F.coalesce("component", "print").alias("component")
        ),
        "print-components",
    )
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = stored(named.join(names, "component").select(F.col("print").alias("of"), "component_id"), "print-names")
    return made.join(names, F.col("print") == F.col("of")).select(
        "doc_id",
        "text_key",
        "print",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
