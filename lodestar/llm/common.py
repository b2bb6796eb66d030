"""What the operators share: storage, folds, word splitting and connected components."""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship  # noqa: F401

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a folder of our own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_lodestar_dir", None) or "file://" + tempfile.mkdtemp(prefix="lodestar-ckpt-")
        spark.sparkContext._lodestar_dir = base
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(docs: DataFrame, *cols: str) -> DataFrame:
    """doc_id, the text as bytes (null: empty) and nothing that could clash with our own names."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *cols)


def fold(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


def py_fold(doc_id, mod: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(512, 0x9E3779B97F4A7C15, np.uint64))
    # The powers by place in a text, and those that take a word back to its own places.
    _AT = np.cumprod(np.full(1 << 18, 0x9E3779B97F4A7C15, np.uint64))
    _BACK = np.cumprod(np.append(np.uint64(1), np.full((1 << 18) - 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)))
#: Lower-cases A-Z and turns the white space of the contracts into spaces.
FOLD_CASE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def hash_words(text: bytes, fold: bytes = FOLD_CASE) -> np.ndarray:
    """A 64-bit hash of each word after ``fold``, from the bytes of the whole text at once.

    Each byte times a power by its place in the word (from 512 on, with its place mixed in), summed by word and mixed.
    For texts and words that are not very long the powers go by the place in the text, and the sums are taken back: the same values."""
    if len(text) + 2 <= len(_AT):
        raw = np.frombuffer(b"".join([b" ", text.translate(fold), b" "]), np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts = edge[::2]
        sizes = edge[1::2] - starts
        if not len(sizes):
            return np.zeros(0, np.uint64)
        if sizes.max() <= 512:
            value = raw.astype(np.uint64)
            value += np.uint64(1)
            value *= _AT[: len(raw)]
            with np.errstate(over="ignore"):
                return mix(np.add.reduceat(value, edge)[::2] * _BACK[starts] + sizes.astype(np.uint64))
    raw = np.frombuffer(b" " + text.translate(fold), np.uint8)
    inside = raw != 32
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(~inside[at - 1])
    sizes = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        power = _POWERS[place & 511]
        if place.max() > 511:
            power = power * (2 * (place >> 9).astype(np.uint64) + np.uint64(1))
        h = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * power, starts) + sizes.astype(np.uint64)
        return mix(h)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack_ints(x: np.ndarray) -> bytes:
    """Byte planes of little-endian numbers, compressed."""
    import zstandard

    x = np.ascontiguousarray(x)
    return struct.pack("<IB", len(x), x.dtype.itemsize) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unpack_ints(data: bytes, dtype) -> np.ndarray:
    import zstandard

    n, width = struct.unpack("<IB", data[:5])
    raw = zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, n * width))
    return np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().reshape(-1).view(dtype) if n else np.zeros(0, dtype)


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    return pack_ints(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data, np.uint64), dtype=np.uint64)


def lower_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z only; bytes.split() parts at exactly 0x09-0x0D and 0x20."""
    return text.lower().split()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled training rows, those with the smallest id hashes: (doc_id, text, y).

    The label side is bounded, so broadcasting it is safe and the texts stay where they are.
    Of several labels of one id the largest holds, of several texts of one id the first in order; rows of a null id
    or label are left out."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .where(fold(mod) != held)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs_of(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


EDGES_HELD = 1_000_000  # edges that a task joins at once


def stars(a: np.ndarray, b: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges as (centre, other node), one row for each other node.

    The centre is the smallest node, or with a salt the first one in an order drawn by it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if salt:
        order = np.argsort(ranks(nodes, salt), kind="stable")
        back = np.empty(len(nodes), np.int64)
        back[order] = np.arange(len(nodes))
        nodes, at = nodes[order], back[at]
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new, least = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label][other], nodes[other]


def ranks(nodes: np.ndarray, salt: int) -> np.ndarray:
    """A permutation of the 64-bit numbers, another for each salt."""
    with np.errstate(over="ignore"):
        return mix(nodes.astype(np.int64).view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))


def packed_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """An edge list of longs as rows of packed arrays (x, y); edges with a null end and loops go."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([pack_ints(x)], pa.binary()), pa.array([pack_ints(y)], pa.binary())], names=["x", "y"])

    rows = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return rows.mapInArrow(run, "x binary, y binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of packed edges (x, y: arrays of longs) as (node, root), stored; root: the smallest node.

    Rounds of contraction.  A task joins its edges to stars, under an order of the nodes that is drawn anew for each round.
    The stars meet by node: a node that is a centre in no task leaves the graph and points to the first of its centres;
    the centres that met there are the edges of the next round.  So a node has a row for each task at most, however many
    edges it has, a round keeps a fixed share of the nodes at most, and ``EDGES_HELD`` edges or fewer are one task's work
    and end the search.  Nodes without an edge to another are not returned."""
    import pyarrow as pa

    spark = edges.sparkSession
    ship(spark)
    buckets = n_parts(spark)
    store = Store(spark)

    def round_(edges: DataFrame, salt: int) -> DataFrame:
        def deal(held: list) -> pa.RecordBatch:
            centre, node = stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)), salt)
            own = np.unique(centre)
            centre, node = np.concatenate([centre, own]), np.concatenate([node, own])
            with np.errstate(over="ignore"):
                part = (mix(node.view(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(buckets + 1))
            rows = [(k, pack_ints(node[order[s:e]]), pack_ints(centre[order[s:e]])) for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > s]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "node", "centre"])

        def local(batches):
            held, size = [], 0
            for b in batches:
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                    held.append((unpack_ints(x, np.int64), unpack_ints(y, np.int64)))
                    size += len(held[-1][0])
                    if size >= EDGES_HELD:
                        yield deal(held)
                        held, size = [], 0
            if size:
                yield deal(held)

        def settle(key, pdf):
            node, centre = (np.concatenate([unpack_ints(x, np.int64) for x in pdf[c]]) for c in ("node", "centre"))
            order = np.lexsort((ranks(centre, salt), node))
            node, centre = node[order], centre[order]
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            to = np.repeat(centre[first], np.diff(np.append(first, len(node))))
            leaves = first[~np.logical_or.reduceat(node == centre, first)]
            pair = np.unique(np.stack([centre, to], 1)[centre != to], axis=0)
            return pd.DataFrame({"n": [len(pair)], "x": [pack_ints(pair[:, 0])], "y": [pack_ints(pair[:, 1])], "v": [pack_ints(node[leaves])], "m": [pack_ints(to[leaves])]})

        dealt = edges.mapInArrow(local, "bucket int, node binary, centre binary")
        return store.cut(dealt.groupBy("bucket").applyInPandas(settle, "n long, x binary, y binary, v binary, m binary"), "contract")

    def rows(level: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                for v, m in zip(b.column("v").to_pylist(), b.column("m").to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(unpack_ints(v, np.int64)), pa.array(unpack_ints(m, np.int64))], names=["node", "root"])

        return level.select("v", "m").mapInArrow(run, "node long, root long")

    # Stored first, so that what makes the edges and what joins them do not hold Python workers at once.
    levels, now = [], store.cut(edges.select("x", "y"), "edges")
    while True:
        levels.append(round_(now, len(levels) + 1))
        left = levels[-1].agg(F.sum("n")).first()[0]
        if not left:
            break
        now = levels[-1].where("n > 0").select("x", "y").coalesce(-(-left // EDGES_HELD))
    found = rows(levels[-1])
    for level in reversed(levels[:-1]):  # what a node points to may have left in a later round
        later = found.select(F.col("node").alias("root"), F.col("root").alias("_end"))
        found = rows(level).join(later, "root", "left").select("node", F.coalesce("_end", "root").alias("root")).unionByName(found)
    found = store.cut(found, "pointers")
    least = found.groupBy("root").agg(F.min("node").alias("_low")).select("root", F.least("_low", "root").alias("_low"))
    out = cut(found.join(least, "root").select("node", F.col("_low").alias("root")).unionByName(least.select(F.col("root").alias("node"), F.col("_low").alias("root"))), "components")
    store.drop()
    return out


def named_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``components`` of an edge list over any values: nodes are numbered in a stored table; root: the smallest value."""
    store = Store(edges.sparkSession)
    e = store.cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "named")
    names = store.cut(e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct().withColumn("k", F.monotonically_increasing_id()), "names")
    numbered = e.join(names.select(F.col("node").alias("a"), F.col("k").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("k").alias("y")), "b")
    found = components(packed_edges(numbered, "x", "y")).select(F.col("node").alias("k"), F.col("root").alias("c")).join(names, "k")
    least = found.groupBy("c").agg(F.min("node").alias("root"))
    out = cut(found.join(least, "c").select("node", "root"), "components")
    store.drop()
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that Spark hands to Python at once within the block: bounds the memory of workers whose rows are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run within the block delete their shuffle files when they end: for those whose result is stored at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


class Store:
    """Tables and folders in the shared folder that one operator needs until its result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, what: str) -> str:
        self.paths.append(new_path(self.spark, what))
        return self.paths[-1]

    def cut(self, df: DataFrame, what: str = "cut") -> DataFrame:
        path = self.path(what)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for p in self.paths:
            drop_path(self.spark, p)
        self.paths = []


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id is surely not among ``ids``, all others): a Bloom filter tells, so only the second part need be shuffled.

    Rows of a null doc_id are in the first part."""
    ship(docs.sparkSession)
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom(ids.select(F.col("doc_id").cast("long"))))

    @F.pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.has(x.to_numpy(np.int64)))

    flagged = docs.withColumn("_among", among(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))) & F.col("doc_id").isNotNull())
    return flagged.where(~F.col("_among")).select(docs.columns), flagged.where("_among").select(docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids``; those of a null doc_id stay."""
    clear, rest = parted(docs, ids)
    return clear.unionByName(rest.join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text, which set the number of buckets and partitions."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    return int(n), int(size)


def parts_of(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Partitions for so many bytes: the session's number, or more where a part would hold over ``each`` bytes."""
    return max(n_parts(spark), -(-size // each))


class Bloom:
    """Which longs are among those of a table: no false negatives, and at most ``most_bits`` bits whatever the table's size.

    It only saves work: beyond its size it lets more rows through, which a join then drops."""

    def __init__(self, ids: DataFrame, most_bits: int = 1 << 27):
        import pyarrow as pa

        spark, n = ids.sparkSession, ids.count()
        self.bits = bits = min(most_bits, 1 << max(16, (12 * n).bit_length()))
        slice_ = 1 << 13

        def run(batches):
            mine = np.zeros(bits // 8, np.uint8)
            for b in batches:
                for h in Bloom.places(b.column(0).to_numpy(zero_copy_only=False), bits):
                    np.bitwise_or.at(mine, h >> 3, np.left_shift(np.uint8(1), (h & 7).astype(np.uint8)))
            rows = [(s, mine[s : s + slice_].tobytes()) for s in range(0, len(mine), slice_) if mine[s : s + slice_].any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["s", "v"])

        def merge(key, pdf):
            return pd.DataFrame({"s": [key[0]], "v": [np.bitwise_or.reduce([np.frombuffer(v, np.uint8) for v in pdf["v"]]).tobytes()]})

        self.field = np.zeros(bits // 8, np.uint8)
        for r in ids.mapInArrow(run, "s long, v binary").groupBy("s").applyInPandas(merge, "s long, v binary").collect():
            self.field[r.s : r.s + slice_] = np.frombuffer(r.v, np.uint8)

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        x = ids.astype(np.int64).view(np.uint64)
        return [(ranks(x.view(np.int64), k) & np.uint64(bits - 1)).astype(np.int64) for k in (101, 102, 103, 104)]

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for h in self.places(ids, self.bits):
            out &= (self.field[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
        return out


def open_store(uri: str):
    """(pyarrow file system, path) of a folder or file in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else Path(uri).resolve().as_uri())


def put_bytes(uri: str, data: bytes) -> None:
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as f:
        f.write(data)


def get_bytes(uri: str, at: int = 0, size: int | None = None) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        return f.read() if size is None else f.read_at(size, at)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
