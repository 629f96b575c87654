"""Packing token sequences by linear grouping, then best fit.

Lengths are whole numbers up to the capacity, so the counts by length (at most ``capacity`` numbers, whatever
the corpus) are all that planning needs:

1. Large pieces, sorted by length, are cut into groups of equal cardinality; within a group every length counts
   as the group's largest. For these few sizes patterns are chosen one after the other: the fullest filling that
   the remaining counts allow, found by a subset-sum over capacities, used as often as the counts allow.
2. Actual pieces take the slots: a piece's rank among all large ones gives its group and place, and the plan's
   range for that place gives its sequence. Being no longer than the rounded size, it fits.
3. What the actual lengths leave free is counted per sequence, and small pieces go, the longest first, where the
   least room is left that still holds them; a move takes as many pieces and sequences at once as there are.
   What fits nowhere opens new sequences.

The driver holds counts and ranges, never pieces.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import gapless, stored
from tidemill.llm.encoding import encoder

GROUPS = 512
#: Pieces of up to capacity // SMALL tokens are small.
SMALL = 4


def pieces(documents: DataFrame, tokenizer: str, end: int | None, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only if longer than ``capacity``.

    The first piece takes the remainder, all others are full. Null is an empty text: its end id alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, end)
        for batch in batches:
            rows: list[tuple] = []
            for doc, packed in zip(batch.column(0).to_pylist(), tokens.encode_all(batch.column(1))):
                ids = np.frombuffer(packed, tokens.dtype).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(mapped, schema)


def _fullest(sizes: list[int], counts: list[int], capacity: int, first: int) -> dict[int, int]:
    """The filling of one sequence that wastes least, with size number ``first`` in it; bit k of ``reach``: sum k is possible."""
    room = capacity - sizes[first]
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i in range(first, len(sizes)):
        for _ in range(min(counts[i] - (i == first), room // sizes[i])):
            wider = (reach | reach << sizes[i]) & mask
            if wider == reach:
                break
            steps.append((i, reach))
            reach = wider
    left, used = reach.bit_length() - 1, defaultdict(int, {first: 1})
    for i, before in reversed(steps):
        if not before >> left & 1:
            used[i] += 1
            left -= sizes[i]
    return dict(used)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that use up ``counts`` of ``sizes`` (largest first); a pattern is {size number: pieces}."""
    counts, plan = list(counts), []
    first = 0
    while first < len(sizes):
        if not counts[first]:
            first += 1
            continue
        pattern = _fullest(sizes, counts, capacity, first)
        times = min(counts[i] // n for i, n in pattern.items())
        for i, n in pattern.items():
            counts[i] -= n * times
        plan.append((pattern, times))
    return plan


def linear_groups(by_length: dict[int, int], groups: int) -> tuple[int, list[tuple[int, int]]]:
    """(cardinality, [(rounded size, pieces)]): pieces in descending length, cut into groups of equal cardinality."""
    total = sum(by_length.values())
    each = max(1, -(-total // groups))
    out, filled = [], 0
    for length in sorted(by_length, reverse=True):
        n = by_length[length]
        while n:
            if filled % each == 0:
                out.append([length, 0])
            take = min(n, each - filled % each)
            out[-1][1] += take
            filled, n = filled + take, n - take
    return each, [tuple(x) for x in out]


def best_fit(free: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, pieces, class, first place)], new sequences) for small pieces of these counts.

    ``free`` counts sequences by room left; a class is the room they had at first (0: a new sequence), a place
    their rank in it. Longest first, each move fills the least sufficient room.
    """
    rooms = {r: [(r, 0, n)] for r, n in free.items() if r and n}
    moves, new = [], 0
    for length in sorted(small, reverse=True):
        rank, left = 0, small[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                opened = -(-left // (capacity // length))
                rooms[capacity] = [(0, new, opened)]
                new, room = new + opened, capacity
            kind, at, n = rooms[room].pop()
            take = min(n, left)
            if take < n:
                rooms[room].append((kind, at + take, n - take))
            if not rooms[room]:
                del rooms[room]
            if room > length:
                rooms.setdefault(room - length, []).append((kind, at, take))
            moves.append((length, rank, take, kind, at))
            rank, left = rank + take, left - take
    return moves, new


def _counts(df: DataFrame, column: str) -> dict[int, int]:
    """Counts by a column of at most ``capacity`` different values."""
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def assign(items: DataFrame, capacity: int, groups: int = GROUPS) -> DataFrame:
    """``items`` (with ``length``, 1 to ``capacity``) with sequence_id and offset; ``items`` is a stored table.

    Every row gets a place, repeats included; an empty table gives an empty one.
    """
    spark = items.sparkSession
    ranked = stored(gapless(items.withColumn("_item", F.monotonically_increasing_id()), ["length"], ["_item"], "_rank"), "packing-ranked")
    by_length = _counts(ranked, "length")
    full, least = by_length.pop(capacity, 0), capacity // SMALL
    large = {k: n for k, n in by_length.items() if k > least}
    small = {k: n for k, n in by_length.items() if k <= least}

    each, sized = linear_groups(large, groups)
    ranges, sequences = [], 0
    taken = [0] * len(sized)
    for pattern, times in configurations([s for s, _ in sized], [n for _, n in sized], capacity):
        for g, n in pattern.items():
            ranges.append((g, taken[g], taken[g] + n * times, n, sequences))
            taken[g] += n * times
        sequences += times
    before, longer = {}, 0
    for length in sorted(large, reverse=True):
        before[length], longer = longer, longer + large[length]
    firsts = spark.createDataFrame(list(before.items()) or [(0, 0)], "l long, _before long")
    slots = spark.createDataFrame(ranges or [(-1, 0, 0, 1, 0)], "g long, a long, b long, _n long, _sequence long")
    placed = ranked.join(F.broadcast(firsts), F.col("length") == F.col("l")).withColumns({"_g": F.expr(f"(_before + _rank) div {each}"), "_p": F.expr(f"(_before + _rank) % {each}")})
    inside = (F.col("_g") == F.col("g")) & (F.col("_p") >= F.col("a")) & (F.col("_p") < F.col("b"))
    sequence = F.col("_sequence") + F.expr("(_p - a) div _n")
    big = stored(placed.join(F.broadcast(slots), inside).select(*items.columns, sequence.cast("long").alias("sequence_id")), "packing-large")

    used = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    rooms = stored(gapless(stored(used, "packing-used"), ["room"], ["sequence_id"], "_place"), "packing-rooms")
    moves, new = best_fit(_counts(rooms, "room"), small, capacity)
    steps = spark.createDataFrame(moves or [(0, 0, 0, 0, 0)], "l long, a long, _n long, _class long, _at long")
    near = (F.col("length") == F.col("l")) & (F.col("_rank") >= F.col("a")) & (F.col("_rank") < F.col("a") + F.col("_n"))
    little = ranked.where(F.col("length") <= least).join(F.broadcast(steps), near).withColumn("_to", F.col("_at") + F.col("_rank") - F.col("a"))
    beside = little.where("_class > 0").join(rooms, (F.col("_class") == F.col("room")) & (F.col("_to") == F.col("_place")))
    opened = little.where("_class = 0").withColumn("sequence_id", F.col("_to") + sequences)
    alone = ranked.where(F.col("length") == capacity).withColumn("sequence_id", F.col("_rank") + sequences + new)
    columns = [*items.columns, "sequence_id"]
    every = big.select(columns).union(beside.select(columns)).union(opened.select(columns)).union(alone.select(columns))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *[c for c in items.columns if c != "length"]).rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))


def pack(documents: DataFrame, tokenizer: str, end: int | None = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every whole text.

    Texts are encoded once and never shuffled. Null texts are empty (the end id alone); null doc_ids and repeated
    rows are packed like others. A sequence holds at most ``capacity`` pieces.
    """
    return assign(stored(pieces(documents, tokenizer, end, capacity), "packing-pieces"), capacity)
