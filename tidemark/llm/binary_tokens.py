"""Flat token files: unsigned integers, 64-bit document offsets, memory-mapped reading.

A shard ``x`` is two files. ``x.bin`` holds the ids one after another as
little-endian unsigned integers (16 bits where the vocabulary allows, else 32).
``x.idx`` holds, as little-endian signed 64-bit integers: the version, the
bytes per id, the number of documents n, the number of leading documents without
a doc_id, n + 1 offsets in ids from the shard's start, and n doc_ids. Where a
shard stands in the whole comes from prefix sums over the shards' token counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidemark.llm.words import encoder, plain_array, text_slices
from tidemark.session import stage, staging_root

VERSION = 1
READ_DOCS = 4096

SHARDS = "shard int, file string, n_docs long, n_tokens long"


def id_bytes(vocabulary: str, end_id: int) -> int:
    return 2 if max(encoder(vocabulary).size - 1, end_id) < 1 << 16 else 4


def write_token_files(docs: DataFrame, vocabulary: str, *, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode whole texts in ascending doc_id order into shard files; returns the stored manifest.

    ``folder`` (default: a new one in the session's shared folder) is any place pyarrow's file systems
    and all executors reach. Null texts are empty, null doc_ids come first, rows that share a doc_id
    follow in input order, extra columns are not read, an empty table writes no shard. Every attempt
    writes files of its own and the manifest names those of the attempt that counted, so a lost or
    repeated task leaves at most an unnamed file.
    """
    root = folder or f"{staging_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    width = id_bytes(vocabulary, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(vocabulary)
        shard = context.partitionId()
        store, base = fs.FileSystem.from_uri(root)
        name = f"shard-{shard:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        keys, sizes, missing, sink = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}.bin")
            missing += batch.column(0).null_count
            keys.append(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False))
            for a, b in text_slices(batch.column(1)):
                starts, ids = enc.encode(plain_array(batch.column(1).slice(a, b - a)))
                sizes.append(np.diff(starts) + 1)
                sink.write(np.insert(ids, starts[1:], end_id).astype(f"<u{width}").tobytes())
        if sink is None:
            return
        sink.close()
        keys, ends = np.concatenate(keys), np.cumsum(np.concatenate(sizes))
        head = np.array([VERSION, width, len(keys), missing, 0], "<i8")
        with store.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(head.tobytes() + ends.astype("<i8").tobytes() + keys.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": len(keys), "n_tokens": int(ends[-1])}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    manifest = stage(rows.mapInArrow(write, SHARDS), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), F.lit(root).alias("folder"))


def _mapped(store: fs.FileSystem, path: str) -> memoryview:
    """The bytes of a file, memory-mapped where the file system is a local one."""
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


def read_token_files(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (, ids).

    The checksum is over the ids as little-endian unsigned 32-bit integers. The manifest holds a row
    per shard file; shards are read side by side.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(row["folder"])
                index = np.frombuffer(_mapped(store, f"{base}/{row['file']}.idx"), "<i8")
                version, width, n, missing = index[:4].tolist()
                if version != VERSION:
                    raise ValueError(f"{row['file']}: format version {version}")
                offsets, keys = index[4 : 5 + n], index[5 + n : 5 + 2 * n]
                ids = np.frombuffer(_mapped(store, f"{base}/{row['file']}.bin"), f"<u{width}") if offsets[-1] else np.zeros(0, "<u4")
                for a in range(0, n, READ_DOCS):
                    b = min(n, a + READ_DOCS)
                    own = ids[offsets[a] : offsets[b]].astype("<u4")
                    ends = (offsets[a : b + 1] - offsets[a]).tolist()
                    parts = [own[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
                    data = [pa.array(keys[a:b], mask=np.arange(a, b) < missing), pa.array(row["base"] + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    if with_ids:
                        data.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(data, names=[x.split()[0] for x in schema.split(", ")])

    shards = manifest.count()
    return manifest.repartition(max(1, shards)).mapInArrow(read, schema)
