"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) enter bins by falling size; each goes to the bin with the
tightest remaining capacity that holds it, found in a balanced tree. Groups of
one size class are alike, so the driver packs a histogram of size classes, not
groups: sizes are exact below 2**16 and rounded up to 13 significant bits above,
which leaves fewer than 260,000 classes whatever the data. Equal groups that
meet one bin enter it together, exactly as one after another.

``shard_balanced`` looks for the capacity at which the packing needs no more than
the bins asked for, while one byte less takes more: slacks double until one fits,
then bisect. Best fit isn't monotone, so a still lesser capacity that happens to
fit below one that fails isn't sought. ``pack`` alone minimises bins of a fixed
capacity.
A group larger than a bin can't be indivisible: it is cut into the fewest pieces
of whole documents that each fit, and a document larger than a bin stands alone.

Ranks that deal groups and documents out of a class or shard are counted over
salted parts, so neither a hot size nor a hot text meets in one task.

Defined results: a null text is empty, with size 8; nulls and repeated rows of
``doc_id`` are documents of their own, each with its slot; ties are ordered by
id, size and checksum; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loupe.llm.common import join_counted, staged, table

#: Sizes below 2**EXACT_BITS are their own class; larger ones keep KEPT_BITS bits.
EXACT_BITS, KEPT_BITS = 16, 13
SALTS = 64


class TightestFit:
    """A treap of bins by (remaining capacity, bin)."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]
        self._random = random.Random(7)

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def add(self, remaining: int, number: int) -> None:
        left, right = self._split(self._root, (remaining, number))
        self._root = self._merge(self._merge(left, [(remaining, number), self._random.random(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            self._root = left
            return None
        if right[2] is None:
            found, right = right[0], right[3]
        else:
            above, node = right, right[2]
            while node[2] is not None:
                above, node = node, node[2]
            found, above[2] = node[0], node[3]
        self._root = self._merge(left, right)
        return found


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Best fit decreasing over (size, count), sizes falling and at most ``capacity``.

    Returns runs (size, first, last, bin): which of the equal items, counted from
    0, enter which bin; and the number of bins. None if it takes more than ``most``.
    """
    tree, runs, bins = TightestFit(), [], 0
    for size, count in classes:
        done = 0
        while done < count:
            found = tree.take(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            remaining, number = found
            n = min(count - done, remaining // size) if size else count - done
            runs.append((size, done, done + n - 1, number))
            tree.add(remaining - n * size, number)
            done += n
    return runs, bins


def shard_balanced(classes: list[tuple[int, int]], n_bins: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first, last, bin) over ``n_bins`` bins, as even as the items allow."""
    classes = sorted(classes, reverse=True)
    runs, alone, left = [], 0, sum(s * n for s, n in classes)
    taken: dict[int, int] = {}
    for size, count in classes:  # an item above the mean of the rest gets a bin of its own
        for i in range(count):
            if alone == n_bins - 1 or size * (n_bins - alone) <= left:
                break
            runs.append((size, i, i, alone))
            taken[size], left, alone = i + 1, left - size, alone + 1
        else:
            continue
        break
    rest = [(s, n - taken.get(s, 0)) for s, n in classes if n > taken.get(s, 0)]
    if not rest:
        return runs
    fails, slack, least = -1, 0, max(-(-left // (n_bins - alone)), rest[0][0])
    while (found := pack(rest, least + slack, n_bins - alone)) is None:
        fails, slack = slack, max(1, 2 * slack)
    while slack - fails > 1:
        middle = (fails + slack) // 2
        if (tighter := pack(rest, least + middle, n_bins - alone)) is None:
            fails = middle
        else:
            found, slack = tighter, middle
    return runs + [(s, a + taken.get(s, 0), b + taken.get(s, 0), k + alone) for s, a, b, k in found[0]]


def size_class(size: Column) -> Column:
    shift = F.when(size < 1 << EXACT_BITS, F.lit(0)).otherwise(F.length(F.bin(size)) - KEPT_BITS)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor((size + unit - 1) / unit) * unit).cast("long")


def salted_rank(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int = SALTS) -> DataFrame:
    """Number the rows of each key from 0, over ``salts`` parts of each key."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    at = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    return salted.join(counts, [*keys, "_salt"]).withColumn(name, (F.col("_before") + at - 1).cast("long")).drop("_salt", "_before")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group of each document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"))


def shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """Every document's shard by size: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    rows = staged(sized(docs), "shard-rows")
    groups = staged(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("each")), "shard-groups")
    total, n_rows = groups.agg(F.sum(F.col("n") * F.col("each")), F.sum("n")).first()
    if not n_rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    mean = -(-total // n_shards)
    per = F.greatest(F.floor(F.lit(mean) / F.col("each")), F.lit(1)).cast("long")
    split = (F.col("n") * F.col("each") > mean) & (F.col("n") > 1)
    pieces = (
        groups.withColumn("per", F.when(split, per).otherwise(F.col("n")))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("per")))))
        .withColumn("held", F.least(F.col("per"), F.col("n") - F.col("piece") * F.col("per")))
        .withColumn("size_class", size_class(F.col("held") * F.col("each")))
    )
    counted = pieces.groupBy("size_class").agg(F.count(F.lit(1)).alias("c")).collect()  # fewer than 260,000 classes
    runs = shard_balanced([(r["size_class"], r["c"]) for r in counted], n_shards)
    schema = T.StructType([T.StructField("size_class", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("shard", T.IntegerType())])
    dealt = salted_rank(pieces, ["size_class"], ["group", "piece"], "rank").alias("p").join(F.broadcast(spark.createDataFrame(runs, schema)).alias("r"), "size_class").where("rank between first and last")
    dealt = staged(dealt.select("group", "piece", "n", "per", "shard"), "shard-pieces")
    one = join_counted(rows, dealt.where("n <= per").select("group", "n", "shard"), "group", n_rows)
    parts = dealt.where("n > per")  # each piece but a group's last is over half a mean: at most 4 for each shard
    cut = rows.join(F.broadcast(parts.where("piece = 0").select("group", "per")), "group")
    cut = salted_rank(cut, ["group"], ["doc_id", "size", "text_crc32"], "rank").withColumn("piece", F.floor(F.col("rank") / F.col("per")))
    cut = cut.join(F.broadcast(parts.select("group", "piece", "shard")), ["group", "piece"])
    names = ["doc_id", "size", "text_crc32", "shard"]
    return salted_rank(staged(one.select(names).unionByName(cut.select(names)), "shard-docs"), ["shard"], ["doc_id", "size", "text_crc32"], "slot", 16 * SALTS)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts stay together."""
    got = shards(table(spark, sf_dir, "documents"), 24)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_shard": op1_shard}
ORACLES: dict[str, str] = {}
