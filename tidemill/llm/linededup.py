"""Lines found in many documents, kept in levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, holder), bucketed and sorted by the hash, so that merge joins with it shuffle
nothing. A batch is anti-joined with every run: the keys that no run holds are a new run of level 0, with their
count and their holder, the largest doc_id of the batch. So a key is in one run alone, and as batches come in
descending doc_id order, its holder there is its largest doc_id of all. Of the other keys only the counts are kept,
in a delta. ``fanout`` runs, or deltas, of a level are merged to one of the next.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, lower_ascii, remove, scratch, shuffle_partitions, stored

#: Two seeds give a line 128 bits: 64 would collide among the lines of 100 TB.
SEEDS = (42, 7)
#: ``xxhash64(lit, x)`` hashes x with the literal's hash as its seed.
_SECOND = xxhash.xxh64_intdigest((SEEDS[1]).to_bytes(4, "little"), seed=SEEDS[0])
_LOWER = bytes(range(256)).lower()
_STRIP = SPACES.encode()


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): the distinct keys of at least ``min_chars`` code points of every row with a doc_id and text."""
    lines = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.split(lower_ascii(F.col("text")), "\n", -1).alias("lines"))
    keys = F.array_distinct(F.transform("lines", lambda x: F.trim(x, F.lit(SPACES))))
    exploded = lines.select("doc_id", F.explode(F.filter(keys, lambda k: F.char_length(k) >= min_chars)).alias("key"))
    return exploded.select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SEEDS[1]), "key").alias("h2"))


class Levels:
    """Tables bucketed and sorted by (h1, h2); ``fanout`` of a level are merged to one of the next.

    n additions leave O(fanout * log n) tables. A merge is a chain of full outer merge joins, bucket by bucket:
    ``n_docs`` adds up, and a holder is that of the one table that has the key.
    """

    def __init__(self, spark: SparkSession, fanout: int, buckets: int):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = [[]]

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, rows: DataFrame, level: int = 0) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fanout:
                self.add(self.merged(full), level + 1)
                self.levels[level] = []
                _drop(self.spark, full)
            level += 1

    def merged(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            both = rows.join(self.spark.table(name).withColumnsRenamed({"n_docs": "n", "holder": "h"}), ["h1", "h2"], "full")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            rows = both.select("h1", "h2", total.alias("n_docs"), F.coalesce("holder", "h").alias("holder"))
        return rows

    def drop(self) -> None:
        _drop(self.spark, self.names())
        self.levels = [[]]


def _drop(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class LineRuns:
    """The runs of one corpus and the deltas of their counts. Tables lie in the warehouse, which the cluster shares."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        buckets = buckets or shuffle_partitions(spark)
        self.spark = spark
        self.runs, self.deltas, self.batches = (Levels(spark, fanout, buckets) for _ in range(3))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (doc_id, h1, h2), whose doc_ids are below those of every batch before."""
        each = keys.select("h1", "h2", "doc_id").distinct()
        batch = self.batches.add(each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder")))
        new = self.runs.add(self.unseen(self.spark.table(batch)))
        if len(self.runs.names()) > 1:
            known = self.spark.table(batch).join(self.spark.table(new), ["h1", "h2"], "left_anti")
            self.deltas.add(known.select("h1", "h2", "n_docs", F.lit(None).cast("long").alias("holder")))
        self.batches.drop()
        self.runs.compact()
        self.deltas.compact()

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose keys no run holds."""
        for name in self.runs.names():
            batch = batch.join(self.spark.table(name), ["h1", "h2"], "left_anti")
        return batch

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, holder) of the keys that at least ``min_docs`` documents hold, over all runs."""
        held = self.runs.merged(self.runs.names())
        if self.deltas.names():
            more = self.deltas.merged(self.deltas.names()).select("h1", "h2", F.col("n_docs").alias("n_more"))
            held = held.join(more, ["h1", "h2"], "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("n_more", F.lit(0)))
        return held.where(F.col("n_docs") >= min_docs).select("h1", "h2", "holder")

    def drop(self) -> None:
        for tables in (self.runs, self.deltas, self.batches):
            tables.drop()


def _kept_lines(text: str, drops: set[tuple[int, int]], min_chars: int) -> tuple[int, list[str]]:
    """Number of lines, and the lines whose key is not to be dropped."""
    lines = text.split("\n")
    if not drops:
        return len(lines), lines
    kept = []
    for line in lines:
        key = line.encode().translate(_LOWER).strip(_STRIP)
        if len(key) < min_chars or (xxhash.xxh64_intdigest(key, SEEDS[0]), xxhash.xxh64_intdigest(key, _SECOND)) not in drops:
            kept.append(line)
    return len(lines), kept


def find_repeats(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """(drop_id, drops): for each doc_id that loses lines, the hashes of the keys that it loses.

    Keys are extracted once and stored by batch; batches are ranges of doc_id, the largest first.
    """
    spark = documents.sparkSession
    ids = documents.select("doc_id").where("doc_id IS NOT NULL")
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]), 1000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + (F.col("doc_id") > F.lit(cut)).cast("int")
    path = scratch(spark, "line-keys")
    line_keys(documents, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    try:
        for i in reversed(range(batches)):
            runs.add(keys.where(F.col("batch") == i))
        frequent = stored(runs.frequent(min_docs), "line-frequent")  # not bucketed, so that a very common key's rows can be split
        lost = keys.join(frequent, ["h1", "h2"]).where("doc_id <> holder")
        drops = stored(lost.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("drops")), "line-drops")
    finally:
        runs.drop()
    remove(spark, path)
    return drops


def line_dedup(documents: DataFrame, digest_only: bool = False, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Drops lines found in ``min_docs`` documents or more, except in the largest doc_id that holds them.

    ``documents`` has doc_id and text. Returns its columns with ``text`` replaced by the lines that stay, joined
    by a newline, or with ``digest_only`` (doc_id, n_lines, n_dropped, kept_sha256).
    Null and empty texts are one empty line (a null text stays null in the full form). Rows with a null doc_id
    neither count as documents nor lose lines. Rows that share a doc_id are one document: a key counts once and
    all of them lose or keep it. Lines within the holder stay, repeats included.
    """
    drops = find_repeats(documents.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    others = ["doc_id"] if digest_only else [c for c in documents.columns if c != "text"]
    given = F.struct(*[F.col(f"`{c}`") for c in others]).alias("given")
    joined = documents.select(given, "doc_id", "text").join(drops, F.col("doc_id") == F.col("drop_id"), "left").select("given", "text", "drops")
    names = ["given", "text", "n_lines", "n_dropped", "kept_sha256"]

    def mapped(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            totals, dropped, out = [], [], []
            for text, pairs in zip(batch.column(1), batch.column(2)):
                whole = text.as_py()
                gone = {(p["h1"] & (1 << 64) - 1, p["h2"] & (1 << 64) - 1) for p in pairs.as_py() or ()}
                n, kept = _kept_lines(whole or "", gone, min_chars)
                totals.append(n)
                dropped.append(n - len(kept))
                out.append(None if whole is None and not digest_only else "\n".join(kept))
            shas = [hashlib.sha256(x.encode()).hexdigest() if digest_only else None for x in out]
            texts = pa.array([None] * len(out) if digest_only else out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())], names=names)

    done = joined.mapInArrow(mapped, joined.select("given", "text").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string"))
    if digest_only:
        return done.select("given.doc_id", "n_lines", "n_dropped", "kept_sha256")
    return done.select(*[F.col("text") if c == "text" else F.col(f"given.`{c}`") for c in documents.columns])
