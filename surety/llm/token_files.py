"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A folder holds, for each segment ``k`` in ascending ``doc_id`` order,

* ``k.ids``: all ids of the segment, little-endian ``uint16`` if the vocabulary
  fits, else ``uint32``;
* ``k.idx``: ``int64`` bounds of its documents within the segment (one more than
  documents), then their ``int64`` doc_ids, then one bit a document that says
  whether it has a doc_id;

and ``manifest.json`` with the integer type, and for each segment its documents,
tokens and base: the number of ids in all segments before it, a prefix sum.
The files are read back through memory maps, or by ranged reads where the folder
is not on a local file system.  A task streams its ids to its open file; a segment
holds about SEGMENT_BYTES of text, so its size does not grow with the corpus.

Defined cases: null text counts as empty (its ids are the end id alone); a null
doc_id sorts first and comes back as null; repeated doc_ids are kept, ordered by
a hash of the text, and may spread over segments; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.llm import byte_bpe, shared
from surety.llm import textbytes as tb

#: Bytes of text in a segment, about, and documents read back at once.
SEGMENT_BYTES, READ_DOCS = 256 << 20, 4_096


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _read(system, path: str, first: int, count: int, dtype) -> np.ndarray:
    """``count`` integers from the ``first``: a memory map, or one ranged read."""
    size = np.dtype(dtype).itemsize
    if not count:
        return np.zeros(0, dtype)
    if system.type_name == "local":
        return np.memmap(path, dtype, "r", first * size, (count,))
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_at(count * size, first * size), dtype)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None, folder: str | None = None, segments: int | None = None) -> str:
    """Encode ``docs(doc_id, text)`` into token files; returns the folder's URI.

    Each task encodes one range of documents and streams their ids to its file; it holds a
    slice of texts and 16 bytes a document.  Only one row a segment reaches the driver.
    """
    spark = docs.sparkSession
    shared.bound_batches(spark)
    folder = folder or shared.scratch(spark, "tokens")
    json_text = open(tokenizer_path).read()
    largest = max([*json.loads(json_text)["model"]["vocab"].values(), end_id or 0])
    dtype = "<u2" if largest < 1 << 16 else "<u4"
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if segments is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENT_BYTES))
    source = spark.sparkContext.broadcast(json_text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = byte_bpe.loaded(source.value), TaskContext.get()
        segment, attempt = task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}"
        system, path = _file_system(folder)  # written under another name, then renamed: a repeated task replaces the file whole
        sizes, keys, named = [], [], []
        with system.open_output_stream(f"{path}/{segment}.ids.{attempt}") as out:
            for batch in batches:
                keys.append(batch.column(0).fill_null(0).to_numpy())
                named.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
                for _, _, data, bounds in tb.text_slices(batch.column(1)):
                    found, upto = coder.encode(data, bounds)
                    n = np.diff(upto)
                    if end_id is not None:
                        found = np.insert(found, upto[1:], end_id)
                        n = n + 1
                    out.write(memoryview(np.ascontiguousarray(found.astype(dtype))).cast("B"))
                    sizes.append(n)
        if not keys:
            system.delete_file(f"{path}/{segment}.ids.{attempt}")
            return
        n = np.concatenate(sizes)
        upto = np.concatenate(([0], np.cumsum(n))).astype("<i8")
        with system.open_output_stream(f"{path}/{segment}.idx.{attempt}") as out:
            for part in (upto, np.concatenate(keys).astype("<i8"), np.packbits(np.concatenate(named), bitorder="little")):
                out.write(memoryview(np.ascontiguousarray(part)).cast("B"))
        for kind in ("ids", "idx"):
            system.move(f"{path}/{segment}.{kind}.{attempt}", f"{path}/{segment}.{kind}")
        yield pa.record_batch({"segment": pa.array([segment], pa.int64()), "docs": pa.array([len(n)], pa.int64()), "tokens": pa.array([int(upto[-1])], pa.int64())})

    # A hot doc_id spreads by its texts, and equal texts by the place they were read from.
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), "h", "place"]
    ordered = keyed.repartitionByRange(segments, *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = sorted(tuple(r) for r in ordered.mapInArrow(write, "segment long, docs long, tokens long").collect())
    base, rows = 0, []
    for segment, count, tokens in found:
        rows.append({"segment": segment, "docs": count, "tokens": tokens, "base": base})
        base += tokens
    with system.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "tokens": base, "segments": rows}).encode())
    return folder


def manifest(folder: str) -> dict:
    system, path = _file_system(folder)
    with system.open_input_file(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(folder: str, document: int) -> np.ndarray:
    """Ids of the document at a global position; only its bounds and its ids are read."""
    m = manifest(folder)
    system, path = _file_system(folder)
    for s in m["segments"]:
        if document < s["docs"]:
            a, b = _read(system, f"{path}/{s['segment']}.idx", document, 2, "<i8").tolist()
            return np.array(_read(system, f"{path}/{s['segment']}.ids", a, b - a, m["dtype"]))
        document -= s["docs"]
    raise IndexError(document)


def token_file_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per document read back from the files: doc_id, start, n_tokens, ids_crc32 (and segment)."""
    m = manifest(folder)
    dtype, rows = m["dtype"], [(s["segment"], s["docs"], s["base"]) for s in m["segments"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        for batch in batches:
            for segment, docs, base in zip(*(c.to_pylist() for c in batch.columns)):
                for lo in range(0, docs, READ_DOCS):
                    n = min(READ_DOCS, docs - lo)
                    upto = np.array(_read(system, f"{path}/{segment}.idx", lo, n + 1, "<i8"))
                    keys = np.array(_read(system, f"{path}/{segment}.idx", docs + 1 + lo, n, "<i8"))
                    bits = _read(system, f"{path}/{segment}.idx", 8 * (2 * docs + 1) + lo // 8, -(-n // 8), "u1")
                    named = np.unpackbits(np.array(bits), bitorder="little")[:n].astype(bool)
                    ids = _read(system, f"{path}/{segment}.ids", int(upto[0]), int(upto[-1] - upto[0]), dtype)
                    at = (upto - upto[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:])]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(keys, mask=~named),
                            "start": pa.array(base + upto[:-1]),
                            "n_tokens": pa.array(np.diff(upto)),
                            "ids_crc32": pa.array(crc, pa.int64()),
                            "segment": pa.array(np.full(n, segment, np.int64)),
                        }
                    )

    told = spark.createDataFrame(rows, "segment long, docs long, base long").repartition(max(1, len(rows)))
    return told.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, segment long")
