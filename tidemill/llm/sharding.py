"""Shards of near-equal bytes by a k-d tree over metadata, with distributed weighted medians.

A node that stands for k shards is cut along its widest dimension (range of values against that of the whole
table) where its left side holds k//2 of the k parts of its bytes. All nodes of a level are cut together. A cut
is found by histograms: rows are binned within the interval that holds the cut, bytes are summed by bin, and the
bin that crosses the target becomes the next interval. Only one row a node comes to the driver. Rows of equal text
share the metadata of the least of them and rows of equal values are ordered by the CRC of their text, so equal
texts stay together; only where one such group weighs more than the tolerance is it cut, by a hash of doc_id. DataFrame expressions only; the tree is a CASE
expression over columns, so shards need no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import gapless, stored

BINS = 1024
#: Share of a shard's target bytes that one cut may be off before a group of equal texts is cut.
TOLERANCE = 0.02
OVERHEAD = 8


@dataclass
class _Node:
    number: int
    first: int
    shards: int
    total: int = 0
    keys: list[str] = field(default_factory=list)
    at: int = 0
    fixed: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    below: int = 0
    cut: tuple[list[str], list[int]] | None = None

    def inside(self) -> Column:
        """Rows of the interval that holds the cut."""
        here = F.col("node") == self.number
        for key, value in zip(self.keys, self.fixed):
            here &= F.col(key) == value
        return here & F.col(self.keys[self.at]).between(self.low, self.high)

    def bin(self) -> Column:
        """Which of at most BINS bins; on halves of the 64-bit range, so that no difference overflows."""
        step = max(1, -(-(self.high - self.low + 1) // BINS))
        if step == 1 or self.high - self.low < 1 << 62:
            return ((F.col(self.keys[self.at]) - self.low) / step).cast("long") if step == 1 else F.expr(f"({self.keys[self.at]} - ({self.low})) div {step}")
        return F.expr(f"cast(floor((cast({self.keys[self.at]} as decimal(38,0)) - ({self.low})) / {step}) as long)")

    def span(self, b: int) -> tuple[int, int]:
        step = max(1, -(-(self.high - self.low + 1) // BINS))
        low = self.low + b * step
        return low, min(self.high, low + step - 1)

    def left(self) -> Column:
        """Rows on the left of the cut, in the order of the keys it names."""
        keys, values = self.cut
        test = F.col(keys[-1]) <= values[-1]
        for key, value in reversed(list(zip(keys[:-1], values[:-1]))):
            test = (F.col(key) < value) | ((F.col(key) == value) & test)
        return test


def _code(df: DataFrame, name: str) -> Column:
    """A dimension as a whole number: numbers as they are, other types as 20 bits of their hash, null as -1."""
    kind = dict(df.dtypes)[name]
    value = F.col(f"`{name}`").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.pmod(F.xxhash64(F.col(f"`{name}`").cast("string")), F.lit(1 << 20))
    return F.coalesce(F.when(F.col(f"`{name}`").isNotNull(), value), F.lit(-1)).cast("long")


def _advance(rows: DataFrame, nodes: list[_Node], tolerance: float) -> list[_Node]:
    """One histogram pass for all nodes whose cut is not found; returns those still open."""
    which = F.lit(None).cast("long")
    for n in nodes:
        which = F.when(n.inside(), n.bin()).otherwise(which)
    binned = rows.withColumn("bin", which).where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("size").alias("bytes"))
    order = Window.partitionBy("node").orderBy("bin")
    summed = binned.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.lit(0.0)
    for n in nodes:
        target = F.when(F.col("node") == n.number, F.lit(n.total * (n.shards // 2) / n.shards - n.below)).otherwise(target)
    crossing = summed.where(F.col("upto") >= target).groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto")).alias("c")).select("node", "c.*")
    found = {r["node"]: r for r in crossing.collect()}
    still = []
    for n in nodes:
        row = found[n.number]
        goal = n.total * (n.shards // 2) / n.shards - n.below
        before, after = goal - (row["upto"] - row["bytes"]), row["upto"] - goal
        low, high = n.span(row["bin"])
        names = n.keys[: n.at + 1]
        last = low == high and n.at + 1 == len(n.keys)
        if min(before, after) <= tolerance or last:
            n.cut = (names, [*n.fixed, low - 1 if before < after else high])
            continue
        n.below += row["upto"] - row["bytes"]
        n.low, n.high = low, high
        if low == high:
            n.fixed, n.at = [*n.fixed, low], n.at + 1
            n.low, n.high = (0, (1 << 32) - 1) if n.keys[n.at] == "text_crc32" else (-(1 << 63), (1 << 63) - 1)
        still.append(n)
    return still


def shards(meta: DataFrame, dims: list[str], n_shards: int) -> Column:
    """Shard number (0 to n_shards - 1) of every row of the stored table ``meta`` (size, text_crc32, tie, dims)."""
    ranges = meta.agg(F.sum("size").alias("total"), *[F.min(d).alias(f"low_{d}") for d in dims], *[F.max(d).alias(f"high_{d}") for d in dims]).first()
    if ranges["total"] is None:
        return F.lit(0)
    tolerance = TOLERANCE * ranges["total"] / n_shards
    level, tree, count = [_Node(0, 0, n_shards)], {}, 1

    def place(first: int, shards_: int, leaf, inner) -> Column:
        node = tree.get((first, shards_))
        if node is None:
            return leaf(first, shards_)
        half = shards_ // 2
        return F.when(node.left(), place(first, half, leaf, inner)).otherwise(place(first + half, shards_ - half, leaf, inner))

    while level := [n for n in level if n.shards > 1]:
        numbers = {(n.first, n.shards): n.number for n in level}
        rows = meta.withColumn("node", place(0, n_shards, lambda f, s: F.lit(numbers.get((f, s), -1)), None))
        spans = rows.where("node >= 0").groupBy("node").agg(F.sum("size").alias("total"), *[F.min(d).alias(f"low_{d}") for d in dims], *[F.max(d).alias(f"high_{d}") for d in dims])
        stats = {r["node"]: r for r in spans.collect()}
        open_ = []
        for n in level:
            s = stats.get(n.number)
            if s is None:  # fewer different rows than shards: nothing to cut
                n.cut = (["size"], [-1])
                tree[n.first, n.shards] = n
                continue
            width = lambda d: (s[f"high_{d}"] - s[f"low_{d}"]) / max(1, ranges[f"high_{d}"] - ranges[f"low_{d}"])  # noqa: B023, E731
            widest = max(dims, key=width)
            n.total, n.keys, n.low, n.high = s["total"], [widest, "text_crc32", "tie"], s[f"low_{widest}"], s[f"high_{widest}"]
            tree[n.first, n.shards] = n
            open_.append(n)
        while open_:
            open_ = _advance(rows, open_, tolerance)
        below = []
        for n in level:
            half = n.shards // 2
            below += [_Node(count, n.first, half), _Node(count + 1, n.first + half, n.shards - half)]
            count += 2
        level = below
    return place(0, n_shards, lambda f, s: F.lit(f), None)


def _with_group_dims(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Rows with the dimensions of the least row of equal text, so that copies filed under other sources lie at one point."""
    if not dims:
        return rows
    first = rows.groupBy(F.col("group").alias("_group"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc")).agg(F.min(F.struct("tie", *dims)).alias("_first"))
    joined = rows.join(first, (F.col("group") == F.col("_group")) & (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_crc")))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in dims], *[F.col(f"_first.{d}").alias(d) for d in dims])


def shard_by_bytes(documents: DataFrame, n_shards: int | None = 24, target_bytes: int | None = None, dims: tuple[str, ...] = ("source", "lang", "size"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, size, text_crc32, law, shard, slot, grown_shard) for every row of ``documents``.

    ``documents`` has doc_id and text; dimensions are its columns, or size. With ``target_bytes`` the number of
    shards is all bytes over it, rounded up. size is the UTF-8 bytes of the text and 8 more; a null text has none, and CRC 0.
    slot numbers a shard's rows from 0 without gaps; grown_shard is null under the law ``bytes``. Repeated rows
    and rows with a null doc_id each take a slot. An empty table gives an empty one.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")
    codes = [_code(documents, d).alias(f"dim_{d}") for d in dims if d != "size"]
    read = documents.select(*[F.col(f"`{c}`") for c in keep], size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.xxhash64("doc_id").alias("tie"), *codes, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = stored(read.withColumn("group", F.xxhash64("text")).drop("text"), "shard-rows")
    names = ["size" if d == "size" else f"dim_{d}" for d in dims]
    meta = stored(_with_group_dims(own, [n for n in names if n != "size"]), "shard-meta")
    if n_shards is None:
        n_shards = max(1, -(-(meta.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    placed = stored(meta.select(*[F.col(f"`{c}`") for c in keep], "size", "text_crc32", "tie", shards(meta, names, n_shards).cast("int").alias("shard")), "shard-placed")
    numbered = gapless(placed, ["shard"], ["tie", "text_crc32"], "slot")
    return numbered.select(*[F.col(f"`{c}`") for c in keep], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
