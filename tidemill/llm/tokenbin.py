"""Token ids as flat binary files: unsigned ids one after the other, and 64-bit offsets of the documents.

A corpus is a folder of parts in ascending doc_id order. Each part has ``.bin`` (unsigned little-endian ids of
2 bytes where all fit, else 4), ``.off`` (n + 1 little-endian int64: where each document starts, in ids) and
``.doc`` (n little-endian int64 doc_ids). ``manifest.json`` lists the parts, each with the number of ids and
documents before it (prefix sums over the parts), so document i starts at the part's base plus its own offset.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import shuffle_partitions
from tidemill.llm.encoding import encoder
from tidemill.llm.files import file_system, new_file, open_file


def encoded(documents: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """(doc_id, ids): the packed ids of every whole text, each with the end id; null is an empty text."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, end)
        for batch in batches:
            at = 0
            for ids in tokens.arrays(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids.cast(pa.binary())], names=["doc_id", "ids"])
                at += len(ids)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(mapped, "doc_id long, ids binary")


def _id_width(tokenizer: str, end: int | None) -> int:
    return encoder(tokenizer, end).width


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end: int | None = 1, parts: int | None = None) -> dict:
    """Writes the whole table (doc_id, text) in ascending doc_id order and returns the manifest.

    Ids, not texts, are shuffled: rows go to ranges of doc_id cut at quantiles of that column alone, and are
    sorted within. Null doc_ids come first; rows that share a doc_id follow one another, ordered by their ids.
    A task writes under a name of its own and reports it, so only the files of successful attempts are listed.
    """
    spark = documents.sparkSession
    parts = parts or shuffle_partitions(spark)
    levels = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    cuts = sorted(set(documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), levels, 10_000)).first()[0] or [])) if parts > 1 else []
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_rank_in(F.col("doc_id"), cuts))
    ordered = encoded(documents, tokenizer, end).withColumn("part", part.cast("int")).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id", "ids")
    width = _id_width(tokenizer, end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = out = None
        offsets, docs, nulls, at, number = [0], [], 0, 0, 0
        for batch in batches:
            if out is None:
                number = batch.column(2)[0].as_py()
                path, out = new_file(folder, f"part-{number:06d}")
            for doc, ids in zip(batch.column(0), batch.column(1)):
                data = ids.as_buffer()
                out.write(data)
                at += data.size // width
                offsets.append(at)
                nulls += not doc.is_valid
                docs.append(doc.as_py() or 0)
        if out is None:
            return
        out.close()
        fs, base = file_system(path)
        fs.move(base, f"{base}.bin")
        for suffix, values in (("off", offsets), ("doc", docs)):
            with fs.open_output_stream(f"{base}.{suffix}") as f:
                f.write(np.array(values, "<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": number, "path": path, "docs": len(docs), "nulls": nulls, "ids": at}])

    rows = ordered.mapInArrow(write, "part long, path string, docs long, nulls long, ids long").collect()
    listed, ids, docs = [], 0, 0
    for row in sorted(rows, key=lambda r: r["part"]):
        listed.append(row.asDict() | {"first_id": ids, "first_doc": docs})
        ids, docs = ids + row["ids"], docs + row["docs"]
    manifest = {"width": width, "ids": ids, "docs": docs, "parts": listed}
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _rank_in(value, cuts: list[int]):
    """How many of the sorted ``cuts`` are below ``value``, by halving, so the expression stays shallow."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(value <= cuts[mid], _rank_in(value, cuts[:mid])).otherwise(F.lit(mid + 1) + _rank_in(value, cuts[mid + 1 :]))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; one task a part.

    start counts the ids of all documents before it; ids_crc32 is of the ids as unsigned 32-bit little-endian.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    manifest = load_manifest(folder)
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    listed, dtype = manifest["parts"], f"<u{manifest['width']}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                part = listed[number]
                n = part["docs"]
                with open_file(f"{part['path']}.off") as f:
                    offsets = np.frombuffer(f.read_buffer(8 * (n + 1)), "<i8").tolist()
                with open_file(f"{part['path']}.doc") as f:
                    docs = np.frombuffer(f.read_buffer(8 * n), "<i8").tolist()
                docs[: part["nulls"]] = [None] * part["nulls"]
                with open_file(f"{part['path']}.bin") as f:
                    crcs = [zlib.crc32(np.frombuffer(f.read_buffer((b - a) * manifest["width"]), dtype).astype("<u4").tobytes()) for a, b in itertools.pairwise(offsets)]
                starts = pa.array([part["first_id"] + a for a in offsets[:-1]], pa.int64())
                sizes = pa.array([b - a for a, b in itertools.pairwise(offsets)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), starts, sizes, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(listed), 1, len(listed)).mapInArrow(read, schema)


def load_manifest(folder: str) -> dict:
    fs, base = file_system(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())


def token_ids(folder: str, index: int) -> np.ndarray:
    """The ids of document ``index`` (in doc_id order, from 0), through the memory map."""
    manifest = load_manifest(folder)
    part = next(p for p in manifest["parts"] if p["first_doc"] <= index < p["first_doc"] + p["docs"])
    with open_file(f"{part['path']}.off") as f:
        f.seek(8 * (index - part["first_doc"]))
        a, b = np.frombuffer(f.read_buffer(16), "<i8").tolist()
    with open_file(f"{part['path']}.bin") as f:
        f.seek(a * manifest["width"])
        return np.frombuffer(f.read_buffer((b - a) * manifest["width"]), f"<u{manifest['width']}")
