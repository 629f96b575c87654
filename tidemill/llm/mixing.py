"""Mixing sources to target weights: each document is repeated a Poisson number of times.

A document's number of copies inverts the Poisson distribution, whose mean is its source's rate, at a uniform
number hashed from its id and a seed (a large rate adds up several such draws); so it needs no state, is the same on every attempt, and documents are
independent. Expected bytes by source are in proportion to the weights. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import shuffle_partitions, stored

#: Terms of the Poisson sum that are added up for means up to ``MOST_MEAN``; beyond 64 the rest is under 1e-15.
TERMS = 64
#: A larger rate is the sum of several draws of at most this mean each.
MOST_MEAN = 16.0
#: Cap of ``mix`` and ``source_rates`` where the caller names none; with None there is no cap.
MOST_RATE = 16.0
_HEX_DIGITS = 13


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the parts' MD5, in the middle of its step, so never 0 or 1."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16**_HEX_DIGITS)


def source_rates(documents: DataFrame, weights: dict[str, float] | None = None, growth: float = 1.0, most_rate: float | None = MOST_RATE) -> DataFrame:
    """(source, rate): how often a document of each source is repeated on average.

    A source's target is ``growth`` times all bytes times its share of the weights; sources that ``weights`` does
    not name have weight 1 (without weights, all sources count alike). Null is a source of its own, of
    weight 1. Bytes are UTF-8 bytes of the text plus 1, so that empty texts count. A rate is at most ``most_rate``;
    with None sources of any size meet their targets.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    sizes = documents.groupBy("source").agg(F.sum(size.cast("long")).alias("bytes"))
    weight = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
        weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(1.0))
    weighed = sizes.withColumn("weight", F.when(F.col("source").isNull(), F.lit(1.0)).otherwise(weight))
    sized = stored(weighed, "mixing-sources")
    all_bytes, all_weights = sized.agg(F.sum("bytes"), F.sum("weight")).first()
    rate = F.lit(growth) * F.lit(all_bytes or 0) * F.col("weight") / F.lit(all_weights or 1.0) / F.col("bytes")
    return sized.select("source", (rate if most_rate is None else F.least(F.lit(most_rate), rate)).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds ``draws``, of equal means of at most ``MOST_MEAN`` that add up to the rate, and their ``steps``.

    steps is P(count <= k) of one draw for k from 0 to ``TERMS`` - 1, each term from the one before.
    """
    split = rates.withColumn("draws", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rate") / MOST_MEAN).cast("long"))).withColumn("mean", F.col("rate") / F.col("draws"))
    first = F.struct(F.exp(-F.col("mean")).alias("term"), F.array(F.exp(-F.col("mean"))).alias("steps"))
    more = lambda s, k: F.struct((s["term"] * F.col("mean") / k).alias("term"), F.concat(s["steps"], F.array(F.element_at(s["steps"], -1) + s["term"] * F.col("mean") / k)).alias("steps"))
    return split.withColumn("steps", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), first, more, lambda s: s["steps"])).drop("mean")


def mix(documents: DataFrame, weights: dict[str, float] | None = None, growth: float = 1.0, seed: int = 0, keep: list[str] | None = None, most_rate: float | None = MOST_RATE) -> DataFrame:
    """``documents``' columns (or ``keep`` of them), one row a copy, with rate, copies, copy (from 0) and shuffle_key.

    ``documents`` has doc_id, text and source. Rows are ordered by shuffle_key, a hash of id, copy and seed, over
    all partitions, so the copies of a document and the documents of a source lie anywhere. Rows that share a
    doc_id get the same number of copies; a null doc_id hashes as an empty string. A column
    of ``documents`` that is named as one of those added gives way to it. A table of sources is joined
    by adaptive execution's choice on its measured size, so any number of sources is right.
    """
    columns = documents.columns if keep is None else keep
    rates = stored(poisson_steps(source_rates(documents, weights, growth, most_rate)), "mixing-rates").withColumnRenamed("source", "_source")
    kept = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("given"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), F.col("source").alias("_of"))
    joined = kept.join(rates, F.col("_of").eqNullSafe(F.col("_source")))
    uniform = joined.withColumn("_u", hashed_uniform(F.lit(str(seed)), F.col("_key")))
    under = lambda u: F.size(F.filter("steps", lambda s: s < u)).cast("long")
    drawn = lambda j: under(hashed_uniform(F.lit(f"draw-{seed}"), F.col("_key"), j.cast("string")))
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("draws")), F.lit(0).cast("long"), lambda n, j: n + drawn(j))
    counted = uniform.withColumn("copies", F.when(F.col("draws") == 1, under(F.col("_u"))).otherwise(summed)).where("copies > 0")
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), F.col("_key"), F.col("copy").cast("string")))
    dealt = _globally_shuffled(copied.withColumn("shuffle_key", key).select("given", "rate", "copies", "copy", "shuffle_key"))
    added = ["rate", "copies", "copy", "shuffle_key"]
    return dealt.select(*[F.col(f"given.`{c}`") for c in columns if c not in added], *added)


def mixed(documents: DataFrame, weights: dict[str, float] | None = None, growth: float = 1.0, seed: int = 0, most_rate: float | None = MOST_RATE) -> DataFrame:
    """``mix`` with the columns of ``documents`` alone: a document stands in it as often as it has copies."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("given"), "doc_id", "text", "source")
    return mix(packed, weights, growth, seed, keep=["given"], most_rate=most_rate).select("given.*")


def _globally_shuffled(copies: DataFrame) -> DataFrame:
    """Rows in the order of shuffle_key over all partitions: MD5 is even, so ranges of its first byte pair are equal ranges."""
    n = shuffle_partitions(copies.sparkSession)
    place = F.conv(F.substring("shuffle_key", 1, 4), 16, 10).cast("int")
    part = F.floor(place * n / 65536).cast("int")
    return copies.repartitionById(n, part).sortWithinPartitions("shuffle_key", "copy")
