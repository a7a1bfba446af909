"""Documents with similar sets of word shingles: a join over groups with equal prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import KEY, attach, batches_of, keyed, most_frequent, narrowed, stored
from eventlens.llm.components import components
from eventlens.llm.textbytes import pieces, shingle_sets, tidy

#: Shingles that are kept in mind as frequent ones, in all and by each task.  They come
#: last in the order of shingles; how many there are changes speed, never results.
FREQUENT = 100_000
#: Shingles that a task looks at together to find those that recur.
BLOCK = 1 << 22
#: Bytes of text that go to a Python task at once.
BATCH_BYTES = 1 << 22
#: Rounds in which a group is compared with its next ones in a random order, and how many.
ROUNDS, NEXT = 2, 2
_PREFIX = (
    "doc_id long, text_key long, n long, digest binary, gid long, rare int, "
    "prefix array<long>"
)
#: Groups that a task knows to have given a prefix for; it starts anew beyond that.
KNOWN_GROUPS = 1 << 19


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents have, most frequent last.

    Tasks count shingles that recur within a block of texts and forget the least
    frequent of them when they hold too many; the counts are then added up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        block, size = [], 0

        def take() -> None:
            nonlocal held_keys, held_counts
            # As np.unique, without its copies of the block.
            keys = np.concatenate(block)
            block.clear()
            keys.sort()
            starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = np.concatenate([[0], starts]) if len(keys) else starts
            counts = np.diff(starts, append=len(keys))
            often = counts > 1
            keys = np.concatenate([held_keys, keys[starts[often]]])
            counts = np.concatenate([held_counts, counts[often]])
            held_keys, place = np.unique(keys, return_inverse=True)
            held_counts = np.bincount(place, counts, len(held_keys)).astype(np.int64)
            if len(held_keys) > FREQUENT:
                top = np.argsort(-held_counts, kind="stable")[:FREQUENT]
                held_keys, held_counts = held_keys[top], held_counts[top]

        for batch in batches:
            for _, _, data, offsets in pieces(batch, "text"):
                sets = shingle_sets(data, offsets, words)
                block += sets
                size += sum(map(len, sets))
                if size >= BLOCK:
                    take()
                    size = 0
        if block:
            take()
        yield pa.RecordBatch.from_arrays(
            [pa.array(held_keys.view(np.int64)), pa.array(held_counts)], names=["shingle", "n"]
        )

    counts = docs.select("text").mapInArrow(tidy(count), "shingle long, n long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n"))
    top = most_frequent(counts, FREQUENT, "shingle-counts")
    return np.array([r[0] for r in reversed(top)], np.int64).view(np.uint64)


def _prefixes(docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """One row per document: size and digest of its set, the id of its group, its prefix.

    Copies repeat the prefix of a group once a task, not once a row.  A group id is a
    hash of 40 bits, which keeps shuffled rows short; two groups with one id are
    compared as if they were one, each by its own prefix and sizes, so a clash costs a
    little time and loses no link.
    """
    order = np.argsort(frequent)
    known, place = frequent[order], order.astype(np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            for a, b, data, offsets in pieces(batch, "text"):
                n, digests, gids, rares, prefixes = [], [], [], [], []
                for s in shingle_sets(data, offsets, words):
                    n.append(len(s))
                    if not len(s):
                        digests.append(None), gids.append(None), rares.append(0), prefixes.append(None)
                        continue
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keep = len(s) - -(-percent * len(s) // 100) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[at] == s
                        rare, often_at = s[~often], at[often]
                        tail = s[often][np.argsort(place[often_at])]
                        prefix = np.concatenate([rare[:keep], tail[: max(0, keep - len(rare))]])
                        rares.append(min(keep, len(rare)))
                    else:
                        prefix = s[:keep]
                        rares.append(keep)
                    group = hashlib.blake2b(prefix.tobytes() + b"%d" % len(s), digest_size=16).digest()
                    gids.append(int.from_bytes(group[:5], "little"))
                    prefixes.append(None if group in given else prefix.view(np.int64))
                    given.add(group)
                if len(given) > KNOWN_GROUPS:
                    given.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("text_key").slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(gids, pa.int64()),
                        pa.array(rares, pa.int32()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n", "digest", "gid", "rare", "prefix"],
                )

    return docs.mapInArrow(tidy(make), _PREFIX)


def _verified(
    pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int, salts: int
) -> DataFrame:
    """The pairs of classes ``(a, b)`` whose sets are similar enough, from their texts.

    The text of ``a`` goes to each of its salts once, and the texts of its partners there.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            linked, partner = [], batch.column("b").is_valid()
            sets = (s for *_, data, at in pieces(batch, "text") for s in shingle_sets(data, at, words))
            for y, is_partner in zip(sets, partner.to_pylist(), strict=True):
                if not is_partner:
                    hub = y
                    linked.append(False)
                    continue
                x, y = (hub, y) if len(hub) < len(y) else (y, hub)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(linked, pa.bool_()))

    pairs = pairs.filter("a <> b").select("a", "b").distinct()
    pairs = stored(
        pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")), "pairs"
    )
    hubs = pairs.select(F.col("a").alias("digest"), "a", "salt", F.lit(None).cast("binary").alias("b"))
    sides = hubs.distinct().union(pairs.select(F.col("b").alias("digest"), "a", "salt", "b"))
    sides = stored(classes.join(sides, "digest").select("doc.*", "a", "salt", "b"), "sides")
    return (
        attach(narrowed(rows, sides), sides, how="inner").select("a", "salt", "b", "text")
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        .select("a", "b", "text")
        .mapInArrow(tidy(check), "a binary, b binary")
    )


def _fits(n: str, m: str, percent: int):
    """Sizes that can be similar enough."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _central_ones(shared: DataFrame, full: DataFrame, percent: int, need, beyond) -> DataFrame:
    """Pairs ``(gid, o_gid)`` of a group and the ones most like all others of a shingle.

    Of a text and its edited copies it is the text itself, which has the fewest shingles
    of its own, that is similar to most.  It is found by an aggregate, and joined to the
    rows of its shingle, which Spark can split however many they are.
    """
    own = full.filter("prefix is not null").groupBy("gid").agg(F.min("rare").alias("rare"))
    rows = shared.select("shingle", "bucket", "gid", "n")
    central = (
        rows.join(own, "gid").groupBy("shingle", "bucket")
        .agg(F.min(F.struct("rare", "n", "gid")).alias("o"))
        .select("shingle", "bucket", F.col("o.gid").alias("o_gid"), F.col("o.n").alias("o_n"))
    )
    central = stored(central, "central")
    return (
        rows.join(central, ["shingle", "bucket"]).filter("gid <> o_gid")
        .filter(_fits("n", "o_n", percent))
        .groupBy("gid", "o_gid", "n", "o_n").agg(F.count(F.lit(1)).alias("common"))
        .filter(2 * F.col("common") + beyond("n", "o_n") >= need("n", "o_n"))
        .groupBy("gid").agg(F.collect_set(F.struct("common", "o_gid")).alias("o"))
        .select("gid", F.explode(F.slice(F.sort_array("o", asc=False), 1, NEXT)).alias("o"))
        .select("gid", "o.o_gid")
    )


def _size_class(percent: int, shift: float = 0.0):
    return F.floor(F.log(F.col("n")) / F.log(F.lit(100.1 / percent)) + F.lit(shift)).cast("int")


def _next_ones(shared, of_group, turn: int, percent: int, salts: int, need, beyond) -> DataFrame:
    """Pairs ``(gid, o_gid)`` of groups that follow each other in a shingle's size class.

    The bounds of the classes move from turn to turn, so none parts the same groups twice.
    """
    rows = shared.select(
        "shingle", "salt", "gid", "n", _size_class(percent, turn / ROUNDS).alias("bucket")
    )
    if of_group is None:
        rows = rows.withColumns({"c_min": F.col("gid"), "c_max": F.col("gid")})
    else:
        rows = rows.join(of_group, "gid")
    drawn = F.xxhash64(F.lit(turn), "gid")
    rows = rows.withColumns(
        {"drawn": drawn, "salt": F.when(F.col("salt") > 0, F.pmod(drawn, F.lit(salts)) + 1).otherwise(0)}
    )
    order = Window.partitionBy("shingle", "salt", "bucket").orderBy("drawn", "gid")
    row = F.struct("gid", "n", "c_min", "c_max")
    leads = {f"o{i}": F.lead(row, i).over(order) for i in range(1, NEXT + 1)}
    pairs = (
        rows.withColumns(leads)
        .select("gid", "n", "c_min", "c_max", F.explode(F.array(*leads)).alias("o"))
        .filter("o is not null and gid <> o.gid and not (c_min = o.c_max and c_max = o.c_min)")
    )
    pairs = pairs.select("gid", "n", F.col("o.gid").alias("o_gid"), F.col("o.n").alias("o_n"))
    return (
        pairs.filter(_fits("n", "o_n", percent))
        .groupBy("gid", "o_gid", "n", "o_n").agg(F.count(F.lit(1)).alias("common"))
        .filter(2 * F.col("common") + beyond("n", "o_n") >= need("n", "o_n"))
        .select("gid", "o_gid")
    )


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    salts: int = 16,
) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of ``percent`` or more.

    A document's set are its distinct shingles of ``words`` words (A-Z lowered, split at
    ASCII white space), or its whole sequence of words if it has fewer.

    Sets are sorted, frequent shingles last, and similar sets share a shingle of their
    prefixes (a fifth of the set at 80 percent).  Equal sets are one class; classes with
    equal prefixes and sizes are one group, and only groups are joined over prefix
    shingles.  Group pairs are filtered by size, by the places of the shared shingle and
    by the number of shared prefix shingles, then expanded to their classes, whose sets
    are compared.

    So that a large group of near copies does not make all its pairs, a few first rounds
    compare each group of a shingle with its most central one and with the next ones in a
    random order only, and find components from these links.  The last round takes every pair of groups that shares a
    prefix shingle and is not in one component yet, so no component is missed.

    Columns: doc_id, text_key, n_shingles, class_digest, component_id (smallest doc_id of
    the component), component_size (documents), kept (the one that stays of a component:
    smallest id, then smallest text_key).  Documents without words, and null
    texts, are components of their own.  Null ids count only where a component has no
    other.  Equal rows share their class.  Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    with batches_of(docs.sparkSession, BATCH_BYTES):
        made = stored(_prefixes(rows, _frequent(rows, words), words, percent), "prefixes")

    full = made.filter("n > 0")
    classes = stored(
        full.groupBy("digest", "n", "gid").agg(F.min(F.struct(*KEY)).alias("doc")), "classes"
    )
    groups = classes.groupBy("gid").agg(
        F.min("digest").alias("first"), F.max("digest").alias("last")
    )
    # A frequent shingle may be in a third of all rows: its rows are dealt out anew.
    marks = full.filter("prefix is not null").select(
        "gid", "n", "rare", F.posexplode("prefix").alias("place", "shingle")
    )
    hot = F.col("place") >= F.col("rare")
    marks = marks.select(
        "shingle",
        F.when(hot, F.pmod(F.col("gid"), F.lit(salts)) + 1).otherwise(0).cast("int").alias("salt"),
        "gid",
        # One number of two, for a short row.
        F.shiftleft(F.col("n"), 31).bitwiseOR(F.col("place").cast("long")).alias("n_place"),
    )
    by_shingle = Window.partitionBy("shingle", "salt")
    # Size classes: a partner is in the same one or the next; a little wider than the
    # ratio of sizes, against rounding.
    bucket = _size_class(percent)
    shared = stored(
        marks.withColumns(
            {"least": F.min("gid").over(by_shingle), "most": F.max("gid").over(by_shingle)}
        )
        .filter((F.col("least") != F.col("most")) | (F.col("salt") > 0))
        .select(
            "shingle",
            "salt",
            "gid",
            F.shiftright("n_place", 31).alias("n"),
            F.col("n_place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("place"),
        )
        .dropDuplicates(["shingle", "salt", "gid", "n"])
        .withColumn("bucket", bucket),
        "shared-prefixes",
    )

    # 100 * common >= percent * union, as a bound of the common shingles, of which those
    # beyond the prefixes are the most that can be shared outside of them.
    def need(n: str, m: str):
        return F.ceil((F.col(n) + F.col(m)) * percent / F.lit(100 + percent) - 1e-9)

    def beyond(n: str, m: str):
        return F.ceil(F.greatest(n, m) * percent / F.lit(100) - 1e-9) - 1

    # First rounds: the classes of a group with its first one, and each group with the
    # next ones of its shingles and size class, in an order that is drawn anew each
    # time.  Pairs with few shared shingles are left to the last round, which counts all.
    first = groups.select("gid", "first")
    links, of_class, of_group = None, None, None
    for turn in range(ROUNDS):
        pairs = _next_ones(shared, of_group, turn, percent, salts, need, beyond)
        if turn == 0:
            pairs = pairs.union(_central_ones(shared, full, percent, need, beyond))
        pairs = (
            pairs.join(first.withColumnRenamed("first", "a"), "gid")
            .join(first.select(F.col("gid").alias("o_gid"), F.col("first").alias("b")), "o_gid")
            .select("a", "b")
        )
        if turn == 0:
            within = classes.select("gid", "digest").join(groups.filter("first <> last"), "gid")
            pairs = pairs.union(within.select("first", "digest"))
        with batches_of(docs.sparkSession, BATCH_BYTES):
            new = stored(_verified(pairs, classes, rows, words, percent, salts), f"links-{turn}")
        links = new if links is None else links.union(new)
        part = components(links)
        of_class = stored(
            classes.join(part, classes["digest"] == part["node"], "left").select(
                "gid", "digest", F.coalesce("component", "digest").alias("component")
            ),
            "class-components",
        )
        # Components of a group, as hashes.
        hashed = F.xxhash64("component")
        of_group = stored(
            of_class.groupBy("gid").agg(F.min(hashed).alias("c_min"), F.max(hashed).alias("c_max")),
            "group-components",
        )

    # Last round: all pairs of groups that are not yet in one component.  ``rank`` counts
    # the shingles of a prefix that any other group may have too; the others before a
    # shared one are lost for every pair.
    place = Window.partitionBy("gid").orderBy("place")
    open_rows = shared.drop("salt").join(of_group, "gid").withColumn(
        "rank", F.row_number().over(place) - 1
    )
    settled = open_rows.groupBy("shingle").agg(
        F.min("c_min").alias("s_min"), F.max("c_max").alias("s_max")
    )
    open_rows = stored(
        open_rows.join(settled.filter("s_min <> s_max").select("shingle"), "shingle", "left_semi")
        .select("shingle", "gid", "n", "bucket", "place", "rank", "c_min", "c_max"),
        "open-rows",
    )
    right = open_rows.select(
        "shingle",
        *(F.col(c).alias(f"r_{c}") for c in ("gid", "n", "place", "rank", "bucket", "c_min", "c_max")),
        F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"),
    )
    rest = F.least(F.col("n") - F.col("place"), F.col("r_n") - F.col("r_place")) - 1
    pairs = (
        open_rows.join(right, ["shingle", "bucket"])
        .filter("gid <> r_gid and (bucket <> r_bucket or gid < r_gid)")
        .filter("not (c_min = r_c_max and c_max = r_c_min)")
        .filter(_fits("n", "r_n", percent))
        .filter(F.least("rank", "r_rank") + 1 + rest >= need("n", "r_n"))
        .groupBy("gid", "r_gid", "n", "r_n").agg(F.count(F.lit(1)).alias("common"))
        .filter(F.col("common") + beyond("n", "r_n") >= need("n", "r_n"))
        .select("gid", "r_gid")
    )
    left_of = of_class.select("gid", F.col("digest").alias("a"), F.col("component").alias("ca"))
    right_of = of_class.select(
        F.col("gid").alias("r_gid"), F.col("digest").alias("b"), F.col("component").alias("cb")
    )
    expanded = pairs.join(left_of, "gid").join(right_of, "r_gid").filter("ca <> cb")
    mixed = of_group.filter("c_min <> c_max").select("gid")
    inside = (
        left_of.join(mixed, "gid", "left_semi")
        .join(right_of, F.col("gid") == F.col("r_gid"))
        .filter("ca <> cb and a < b")
    )
    left = expanded.select("a", "b").union(inside.select("a", "b"))
    with batches_of(docs.sparkSession, BATCH_BYTES):
        more = stored(_verified(left, classes, rows, words, percent, salts), "links-last")
    joined = components(links.union(more))

    named = made.join(joined, made["digest"] == joined["node"], "left").select(
        *KEY, "n", "digest", F.coalesce("component", "digest").alias("component")
    )
    named = stored(named, "named")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    names = named.filter("component is not null").groupBy("component").agg(
        F.min("doc_id").alias("component_id"),
        F.count(F.lit(1)).alias("component_size"),
        F.min(order).alias("first"),
    )
    names = stored(names, "component-names")
    alone = F.col("component").isNull()
    return named.join(names, "component", "left").select(
        *KEY,
        F.col("n").alias("n_shingles"),
        F.col("digest").alias("class_digest"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component_size", F.lit(1)).alias("component_size"),
        (alone | (order == F.col("first"))).alias("kept"),
    )
