"""A Merkle manifest of a table: a hash tree over its rows, rolled up in nested structs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import stored

#: Children of a node, and levels (digits of a rank) that one block of nodes takes.
RUN, DIGITS = 3, 6
_PATH = "array<struct<before string, after string>>"
_ABOVE = f"struct<path {_PATH}, subroot string, root string>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def told(value: Column) -> Column:
    """A value as hashed: ``-`` for null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to, with the siblings of a path."""
    return F.aggregate(
        path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256)
    )


def siblings(path: Column) -> Column:
    """The hashes of a path in one string: level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes: the least h with ``RUN ** h >= n``."""
    out = F.lit(0)
    for h in range(39):
        out += (n > RUN**h).cast("int")
    return out


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within ``part_of`` and its ``height``.

    The rows are range partitioned and sorted, so a group of any size is spread over
    tasks; sizes of partitions come to the driver, and starts of groups are joined.
    """
    by = [F.asc_nulls_first(c) for c in ("part_of", *order)]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, total = [], 0
    for number, n in sorted(tuple(r) for r in placed.groupBy(part).count().collect()):
        offsets.append((number, total))
        total += n
    offsets = placed.sparkSession.createDataFrame(offsets, "number long, offset long")
    starts = (
        placed.groupBy("part_of").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("size"))
        .join(offsets, part == F.col("number"))
        .select(F.col("part_of").alias("of"), (F.col("offset") + row).alias("start"), "size")
    )
    return (
        placed.join(offsets, part == F.col("number"))
        .join(starts, F.col("part_of").eqNullSafe(F.col("of")))
        .withColumn("rank", F.col("offset") + row - F.col("start"))
        .withColumn("height", _height(F.col("size")))
        .select("part_of", "rank", "height", "h", "item")
    )


def _children(real: Column) -> Column:
    """The nodes of a ``run``, each with the ``hashes`` that stand before and after it."""

    def child(x: Column, i: Column) -> Column:
        before = F.array_join(F.slice("hashes", F.lit(1), i), "")
        after = F.array_join(F.slice("hashes", i + 2, F.lit(RUN)), "")
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        return F.struct(
            x["node"].alias("node"), F.when(real, step).otherwise(F.array().cast(_PATH)).alias("step")
        )

    return F.transform("run", child)


def _rolled_up(nodes: DataFrame, tier: int) -> DataFrame:
    """One row per block of ``RUN ** DIGITS`` nodes: ``(part_of, block, height, h, tree)``.

    The digits of a rank are grouped away one after the other, lowest first, which nests
    the children in a struct of their parent.  All of it needs the one exchange that
    brings a block together.  Above the height of its tree a node stands for itself.
    """
    digits = [
        F.pmod(F.floor(F.col("rank") / F.lit(RUN**k)), F.lit(RUN)).cast("int").alias(f"d{k}")
        for k in range(DIGITS)
    ]
    block = F.floor(F.col("rank") / F.lit(RUN**DIGITS)).alias("block")
    rows = nodes.select("part_of", block, "height", *digits, F.struct("h", "item").alias("node"))
    rows = rows.repartition("part_of", "block")
    for k in range(DIGITS):
        keys = ["part_of", "block", "height", *(f"d{j}" for j in range(k + 1, DIGITS))]
        real = F.col("height") > tier * DIGITS + k
        rows = rows.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct(f"d{k}", "node"))).alias("run")
        )
        rows = rows.withColumn("hashes", F.transform("run", lambda x: x["node"]["h"]))

        h = F.when(real, F.sha2(F.array_join("hashes", ""), 256)).otherwise(F.element_at("hashes", 1))
        rows = rows.select(*keys, F.struct(h.alias("h"), _children(real).alias("run")).alias("node"))
    return rows.select("part_of", "block", "height", F.col("node.h").alias("h"), F.col("node").alias("tree"))


def _tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of nodes, blocks of their roots, and so on, until each tree is in one block."""
    tiers = []
    while True:
        tiers.append(stored(_rolled_up(nodes, len(tiers)), f"merkle-{name}-{len(tiers)}"))
        tallest = tiers[-1].agg(F.max("height")).first()[0] or 0
        if tallest <= DIGITS * len(tiers):
            return tiers
        nodes = tiers[-1].select(
            "part_of", F.col("block").alias("rank"), "height", "h", F.col("block").alias("item")
        )


def _paths(node: Column, levels: int) -> Column:
    """``(item, h, path)`` of all that a nested struct holds."""
    if not levels:
        return F.array(F.struct(node["item"].alias("item"), node["h"].alias("h"), F.array().cast(_PATH).alias("path")))
    return F.flatten(
        F.transform(
            node["run"],
            lambda child: F.transform(
                _paths(child["node"], levels - 1),
                lambda x: F.struct(x["item"].alias("item"), x["h"].alias("h"), F.concat(x["path"], child["step"]).alias("path")),
            ),
        )
    )


def _unrolled(tier: DataFrame, above: DataFrame) -> DataFrame:
    """``(part_of, item, h, above)`` of the nodes of a tier's blocks.

    ``above (part_of, block, above)`` has what stands above each block; it meets the
    block by aggregation, and the block's own structs hold the rest, so there is no join.
    """
    kind = tier.schema["tree"].dataType
    both = tier.select("part_of", "block", "tree", F.lit(None).cast(_ABOVE).alias("above")).unionByName(
        above.select("part_of", "block", F.lit(None).cast(kind).alias("tree"), "above")
    )
    whole = both.groupBy("part_of", "block").agg(
        F.first("tree", ignorenulls=True).alias("tree"), F.first("above", ignorenulls=True).alias("above")
    )
    found = whole.select("part_of", "above", F.explode(_paths(F.col("tree"), DIGITS)).alias("x"))
    path = F.concat("x.path", "above.path").alias("path")
    return found.select(
        "part_of", "x.item", "x.h", F.struct(path, "above.subroot", "above.root").alias("above")
    )


def _down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Hands paths down from the highest tier to the lowest."""
    for tier in reversed(tiers[1:]):
        above = _unrolled(tier, above).withColumnRenamed("item", "block").drop("h")
        above = stored(above, "merkle-paths")
    return _unrolled(tiers[0], above)


def merkle_manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs`` with its leaf, its path to the root, and both roots.

    Columns: ``id``, ``leaf``, ``subroot`` (of its source), ``root``, ``path`` (from the
    leaf upwards: hashes of the siblings before and after it in its run of three) and
    ``carried``, a struct of the expressions in ``carry``.  :func:`folded` and
    :func:`siblings` work on a path.

    A leaf is the SHA-256 of ``columns``, see :func:`told`.  The leaves of a source stand
    in the order of their ids; runs of three become a node until one is left, the subroot.
    Subroots, ordered by source, become the root in the same way.

    Ranks come from a range partitioning, so a source with a third of all rows is split.
    Blocks of 729 nodes are rolled up in nested structs (:func:`_rolled_up`), and so are
    the blocks' own hashes, tier by tier; no row ever holds more than a block.

    Null sources are one source, the first; null ids are the first of a source.  Rows of
    one id stand in the order of their leaves; repeated rows are leaves of their own.
    Null is told from empty.  A text of any length is hashed whole, in one row.  An empty
    table gives an empty result.  Other columns are not read.
    """
    leaf = hashed(*(told(docs[c]) for c in columns))
    carried = F.struct(*(c.alias(k) for k, c in (carry or {"none": F.lit(None).cast("string")}).items()))
    leaves = docs.select(
        docs[source_col].cast("string").alias("part_of"),
        leaf.alias("h"),
        F.struct(docs[id_col].alias("id"), carried.alias("carried")).alias("item"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Written before it is sampled for its ranges, so texts are hashed once.
    leaves = stored(leaves, "merkle-leaves").withColumn("id", F.col("item.id"))
    tiers = _tiers(_ranked(leaves, ["id", "h", "tie"]), "leaves")

    subroots = tiers[-1].select(F.lit(0).alias("part_of"), F.col("part_of").alias("item"), "h")
    top = _tiers(_ranked(subroots, ["item"]), "sources")
    roots = top[-1].select(
        "part_of", "block",
        F.struct(F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root")).alias("above"),
    )
    sources = stored(_down(top, roots), "merkle-sources").select(
        F.col("item").alias("part_of"),
        F.lit(0).cast("long").alias("block"),
        F.struct("above.path", F.col("h").alias("subroot"), "above.root").alias("above"),
    )
    return _down(tiers, sources).select(
        "item.id",
        F.col("h").alias("leaf"),
        "above.subroot",
        "above.root",
        "above.path",
        "item.carried",
    )
