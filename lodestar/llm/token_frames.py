"""Token-ID / binary output: zstandard seekable files of token ids.

A shard file holds, one after the other, an independent zstandard frame for each document (ids,
little-endian, 2 or 4 bytes wide, with the frame's own content checksum), a skippable frame
with the document index (an Arrow stream of doc_id and n_tokens; its schema metadata has the
width), and the seek table of the public zstandard seekable format: a skippable frame with each
frame's compressed size, size and checksum (low 32 bits of XXH64), then the footer.  A reader takes
the footer, the table and the index, and decompresses only the documents asked for.

Files are ordered: shards by doc_id range, documents by doc_id within; a task begins a new file beyond ``file_bytes``,
which bounds what it holds.  A file is written under a
name of its own attempt and counts only once its manifest row is stored, so lost executors and
speculative attempts do no harm.

Defined results: a null text is empty (its only id is the end id); null doc_ids come first; equal
doc_ids are all written, in the order of a hash of their texts (so that one id with very many rows is dealt to several
shards); other columns are ignored; an empty table
gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, docs_of, n_parts, new_path, open_store, parts_of, put_bytes, ship, sizes
from .pieces import encoder

SKIPPABLE_INDEX, SKIPPABLE_TABLE, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "shard long, file long, path string, n_docs long, n_tokens long, n_bytes long"


class ShardWriter:
    def __init__(self, width: int, level: int = 3):
        import zstandard

        self.width, self.z = width, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.out, self.table, self.ids, self.counts, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        import xxhash

        frame = self.z.compress(data)
        self.out.append(frame)
        self.size += len(frame)
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.counts.append(len(data) // self.width)

    def finish(self) -> bytes:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())], metadata={"width": str(self.width)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as w:
            w.write_batch(pa.record_batch([pa.array(self.ids, pa.int64()), pa.array(self.counts, pa.int64())], schema=schema))
        index = sink.getvalue().to_pybytes()
        body = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        return b"".join((*self.out, struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", SKIPPABLE_TABLE, len(body) + len(footer)), body, footer))


class ShardReader:
    """Reads a shard through ``read(start, length)``; only the tail and the frames asked for are fetched."""

    def __init__(self, read, size: int):
        self.read = read
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable file with checksums")
        at = size - 9 - 12 * n
        table = np.frombuffer(read(at, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.lengths, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        magic, length = struct.unpack("<II", read(int(self.starts[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        index = pa.ipc.open_stream(read(int(self.starts[-1]) + 8, length)).read_all()
        self.width = int(index.schema.metadata[b"width"])
        self.doc_ids, self.counts = index["doc_id"].to_pylist(), index["n_tokens"].to_pylist()

    def ids(self, i: int, frame: bytes | None = None) -> np.ndarray:
        import xxhash
        import zstandard

        frame = self.read(int(self.starts[i]), int(self.sizes[i])) if frame is None else frame
        data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.lengths[i]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"checksum of document {self.doc_ids[i]}")
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4")

    def every(self, chunk: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, read in pieces of about ``chunk`` bytes."""
        i = 0
        while i < len(self.sizes):
            end = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + chunk, "right")) - 1)
            data, base = self.read(int(self.starts[i]), int(self.starts[end] - self.starts[i])), int(self.starts[i])
            for k in range(i, end):
                yield k, self.ids(k, data[int(self.starts[k]) - base : int(self.starts[k + 1]) - base])
            i = end

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardReader:
        return cls(lambda at, n: data[at : at + n], len(data))


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, shards: int | None = None, path: str | None = None, file_bytes: int = 64 << 20) -> DataFrame:
    """Encode, sort and write all documents; returns the stored manifest with each file's ``base``, the ids before it."""
    spark = docs.sparkSession
    ship(spark)
    path = path or new_path(spark, "tokens")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(MANIFEST.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, file = encoder(tokenizer, "drop"), TaskContext.get().partitionId(), 0
        end, w = np.array([end_id], enc.dtype).tobytes(), ShardWriter(enc.width)

        def stored() -> pa.RecordBatch:
            data = w.finish()
            put_bytes(to := f"{path}/shard-{shard:06d}-{file:04d}-{uuid.uuid4().hex}.zst", data)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, file, to, len(w.ids), sum(w.counts), len(data)), kinds, strict=True)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w.add(doc_id, enc.encode(text) + end)
                if w.size >= file_bytes:
                    yield stored()
                    file, w = file + 1, ShardWriter(enc.width)
        if w.ids:
            yield stored()

    rows = docs_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shards or parts_of(spark, sizes(docs)[1]), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    manifest = cut(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless left out, the ids of all documents, or of those asked for, read back from the files."""
    spark: SparkSession = manifest.sparkSession
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                store, p = open_store(r.path)
                with store.open_input_file(p) as f:
                    shard = ShardReader(lambda at, n, f=f: f.read_at(n, at), f.size())
                    starts = np.concatenate(([0], np.cumsum(shard.counts))) + int(r.base)
                    found = shard.every() if wanted is None else ((i, shard.ids(i)) for i, d in enumerate(shard.doc_ids) if d in wanted)
                    rows = []
                    for i, ids in found:
                        raw = ids.astype("<u4").tobytes()
                        rows.append((shard.doc_ids[i], int(starts[i]), len(ids), zlib.crc32(raw), *([raw] if with_ids else [])))
                        if len(rows) == 2000:
                            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                            rows = []
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    ship(spark)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    spread = manifest.repartition(max(n_parts(spark), 1))
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
