"""Filling containers of fixed capacity: best-fit decreasing over the whole corpus at once.

Best-fit decreasing depends only on how many items there are of each size, and
sizes after splitting are at most the capacity. So the sizes are counted in
parallel, the packing is decided once on that histogram (a row per distinct
size, however many items there are), and every item finds its container by its
rank among the items of its size. Equal items go through the decision in runs:
a run of items fills a run of containers with the same room.

The tightest container that still takes a size is found by descending a segment
tree over remaining capacities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut_lineage

#: Kinds of containers.
MAX_KINDS = 10_000
#: Most distinct sizes over all kinds of containers, which are the histogram that is decided on by the driver.
MAX_SIZES = 10_000_000
#: Items that share a size and are ranked in one task, on average.
RANKED_TOGETHER = 200_000
#: Runs of the decision that are broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_RUNS = 100_000


class Rooms:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while containers with that room are open.

    Only nodes that are set are kept, so the tree is as large as the open rooms
    are many, whatever the capacity.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree: set[int] = set()
        self.open: dict[int, list[tuple[int, int]]] = {}

    def push(self, room: int, first: int, count: int) -> None:
        self.open.setdefault(room, []).append((first, count))
        at = room + self.width
        while at and at not in self.tree:
            self.tree.add(at)
            at >>= 1

    def pop(self, room: int) -> tuple[int, int]:
        runs = self.open[room]
        out = runs.pop()
        if not runs:
            at = room + self.width
            self.tree.discard(at)
            while at > 1 and at ^ 1 not in self.tree:
                at >>= 1
                self.tree.discard(at)
        return out

    def tightest(self, size: int) -> int | None:
        """Smallest open room of at least ``size``."""
        at = size + self.width
        if at >= 2 * self.width:
            return None
        while at not in self.tree:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # wrapped to the next level's first node
                return None
        while at < self.width:
            at = 2 * at if 2 * at in self.tree else 2 * at + 1
        return at - self.width


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, end rank, first container, items per container) and the number of containers."""
    rooms, runs, bins = Rooms(capacity), [], 0
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = rooms.tightest(size)
            if room is None:
                room, first = capacity, bins
                count = -(-left // (capacity // size))
                bins += count
            else:
                first, count = rooms.pop(room)
            each = room // size
            full = min(count, left // each)
            if full:
                runs.append((size, rank, rank + full * each, first, each))
                rooms.push(room - each * size, first, full)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if count and left:  # the last items of this size share one container
                runs.append((size, rank, rank + left, first, each))
                rooms.push(room - left * size, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                rooms.push(room, first, count)
    return runs, bins


def pack(items: DataFrame, containers: DataFrame, *, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container, capacity, doc_id, piece, size, bin): every item in a bin of every kind of container.

    An item larger than the capacity is split into pieces that fill a bin each,
    and a rest that is packed like any item; other items are one piece, number 0.

    Defined cases: items of size 0 or null take no room and go to bin 0; equal
    sizes are ranked by a hash of the item, then by its id; repeated rows are
    items of their own; containers with a null or non-positive capacity, and
    repeated ones, are ignored; more than ``MAX_KINDS`` kinds or ``MAX_SIZES``
    distinct sizes raise; empty tables give an empty result; other columns are ignored.
    """
    rows = containers.select("container", "capacity").where("container is not null and capacity > 0").distinct().limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    kinds = sorted({(r[0], int(r[1])) for r in rows})
    spark = items.sparkSession
    sizes = items.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    kind = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in kinds])) if kinds else None
    if kind is None:
        return spark.createDataFrame([], "container string, capacity bigint, doc_id bigint, piece int, size bigint, bin bigint")
    whole = F.expr("size div capacity").cast("int")
    rest = F.col("size") % F.col("capacity")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(whole - (rest == 0).cast("int"), F.lit(0))),
        lambda p: F.struct(p.alias("piece"), F.when(p < whole, F.col("capacity")).otherwise(rest).alias("size")),
    )
    cut = sizes.select("doc_id", "size", kind.alias("k")).select("doc_id", "size", "k.container", "k.capacity").withColumn("p", F.explode(pieces))
    cut = cut.select("container", "capacity", "doc_id", F.col("p.piece").alias("piece"), F.col("p.size").alias("size"))

    histogram: dict[str, dict[int, int]] = {}
    n = 0
    counted = cut.where("size > 0").groupBy("container", "capacity", "size").count().limit(MAX_SIZES + 1).collect()
    if len(counted) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} distinct sizes")
    for r in counted:
        histogram.setdefault((r[0], r[1]), {})[r[2]] = r[3]
        n += r[3]
    runs = [(*k, *run) for k, h in histogram.items() for run in best_fit_decreasing(h, k[1])[0]]
    table = spark.createDataFrame(runs, "container string, capacity long, size long, from_rank long, to_rank long, first_bin long, each long")
    if len(runs) <= MAX_BROADCAST_RUNS:
        table = F.broadcast(table)

    # Ranks within a size: counts per hash bucket are summed up, rows are numbered within a bucket.
    buckets = max(1, -(-n // RANKED_TOGETHER))
    keyed = cut.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    keys = ["container", "capacity", "size", "bucket"]
    before = Window.partitionBy("container", "capacity", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*keys).count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece")) - 1
    ranked = keyed.withColumn("no", number).join(offsets, keys).withColumn("rank", F.col("no") + F.col("offset"))
    placed = ranked.join(table, ["container", "capacity", "size"]).where("rank >= from_rank and rank < to_rank")
    placed = placed.withColumn("bin", F.expr("first_bin + (rank - from_rank) div each"))
    out = ["container", "capacity", "doc_id", "piece", "size", "bin"]
    return placed.select(*out).unionByName(cut.where("size = 0").withColumn("bin", F.lit(0).cast("bigint")).select(*out))


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, bins, used, unused_share) of a packing."""
    per = packed.groupBy("container", "capacity").agg(F.max("bin").alias("last"), F.sum("size").alias("used"))
    room = (F.col("last") + 1) * F.col("capacity")
    return per.select("container", "capacity", (F.col("last") + 1).alias("bins"), "used", (1 - F.col("used") / room).alias("unused_share"))


def materialised_sizes(sizes: DataFrame) -> DataFrame:
    """Sizes are read several times (histogram, ranks); they are kept once instead of being counted again."""
    return cut_lineage(sizes)
