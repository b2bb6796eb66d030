"""Packing: lexical retrieval packing by sharded BM25 inverted indexes.

1. Documents are encoded once.  A document's full windows are sequences of their own; what is left (its tail, shorter
   than a window) is packed, by the likeness of the whole texts.  Document frequencies cover all documents.
2. Documents are dealt to shards of ``shard_docs`` so that lexical neighbours meet.  A document enters the lists of
   its ``RARE`` rarest shared terms; each list is ordered by two min-hashes of the rarer ``SHARE`` of the terms, salted by its own
   term, so that like documents lie side by side.
   The document that stands beside it in most lists, in ``AGREE`` at least, is its partner; partners and theirs (connected
   components) get consecutive places, and shards are ranges of places.  Each list gives two pairs a document, however long it is;
   lists beyond ``LIST`` documents are split by the same min-hash.  A group larger than a shard goes on in the next one.
3. A shard has an inverted index of all terms of its documents, weighted by BM25 with the idf and mean length of all
   documents.  The longest unused tail is the seed; with all its terms it asks the index, and the unused documents fill its
   window, best first, down to the last one that shares a term; only then do the longest unused tails follow.  The last
   piece of a window is cut and its rest stays unused, with its own turn later.

A shard's work is bounded by ``shard_docs`` whatever the input's size, so time grows with the input; the price is that
neighbours beyond the shard are not offered.  Step 2 is there for that; tests hold its recall of the best neighbour
against a brute-force search over all documents.

Defined results: a null text is empty and has only the end id; equal rows are packed each on its
own; null doc_ids are packed like others; other columns are ignored; an empty table gives an empty
result.  The end id is no term.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, components, cut, docs_of, get_bytes, mix, pack_ints, parts_of, put_bytes, ship, unpack_ints
from .pieces import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ROW = "rid long, doc_id long, doc_tokens long, crcs array<long>, tail binary, terms binary, counts binary"
K1, B = 1.2, 0.75
RARE, SHARE, AGREE, LIST = 16, 0.4, 2, 4096
COMMON, SEEDS = 1 / 10, 32  # terms in more of a shard's documents are scored as a dense product; seeds scored at once


def encode(docs: DataFrame, tokenizer: str, window: int, end_id: int, store: Store) -> DataFrame:
    """A number of each row, doc_id, doc_tokens, the crc32 of each full window, the ids of the tail (2 or 4 bytes each), and terms with counts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rid = encoder(tokenizer, "lead"), TaskContext.get().partitionId() << 40
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            out: dict[str, list] = {"doc_tokens": [], "crcs": [], "tail": [], "terms": [], "counts": []}
            for own in enc.encode_all(b.column("text").to_pylist()):
                ids = np.frombuffer(own + end, enc.dtype).astype("<u4")
                full = len(ids) // window * window
                out["doc_tokens"].append(len(ids))
                out["crcs"].append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, full, window)])
                out["tail"].append(ids[full:].astype("<u2" if enc.width == 2 else "<u4").tobytes())
                terms, counts = np.unique(ids[:-1], return_counts=True)
                out["terms"].append(terms.astype("<u4").tobytes()), out["counts"].append(counts.astype("<u4").tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), b.column("doc_id").cast(pa.int64()), pa.array(out["doc_tokens"], pa.int64()), pa.array(out["crcs"], pa.list_(pa.int64())),
                                              *(pa.array(out[c], pa.binary()) for c in ("tail", "terms", "counts"))], names=["rid", "doc_id", *out])
            rid += n

    rows = docs_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return store.cut(rows.mapInArrow(run, ROW), "encoded")


def document_frequencies(encoded: DataFrame, vocab: int) -> np.ndarray:
    """In how many documents each term occurs; one row per task and slice of the vocabulary is shuffled."""
    slice_ = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocab + slice_, np.int64)
        for b in batches:
            for terms in b.column("terms").to_pylist():
                df[np.frombuffer(terms, "<u4")] += 1
        if df.any():
            starts = list(range(0, vocab, slice_))
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([df[s : s + slice_].tobytes() for s in starts], pa.binary())], names=["s", "v"])

    def add(key, pdf):
        return pd.DataFrame({"s": [key[0]], "v": [np.sum([np.frombuffer(v, np.int64) for v in pdf.v], axis=0).tobytes()]})

    got = encoded.select("terms").mapInArrow(run, "s long, v binary").groupBy("s").applyInPandas(add, "s long, v binary").collect()
    out = np.zeros(vocab + slice_, np.int64)
    for r in got:
        out[r.s : r.s + slice_] = np.frombuffer(r.v, np.int64)
    return out


def places(encoded: DataFrame, df: np.ndarray, n: int, parts: int) -> DataFrame:
    """(rid, root) of the rows that have a partner: rows of one root are lexical neighbours."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(df)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(list, min-hash, rid) of each document and rare term, packed by bucket."""
        df = shared.value
        for b in batches:
            keys, marks, rids = [], [], []
            for rid, raw in zip(b.column("rid").to_pylist(), b.column("terms").to_pylist(), strict=True):
                t = np.frombuffer(raw, "<u4").astype(np.uint64)
                d = df[t.astype(np.int64)]
                t, d = t[d > 1], d[d > 1]
                if not len(t):
                    continue
                if len(t) > RARE:
                    near = np.lexsort((t, d))
                    some, rest = t[near[:RARE]], t[near[: max(RARE, int(len(t) * SHARE))]]
                else:
                    some = rest = t
                with np.errstate(over="ignore"):
                    h = mix(rest * np.uint64(0x9E3779B97F4A7C15) + mix(some)[:, None])
                    one, two = h.min(1), (h * np.uint64(0xD1B54A32D192ED03)).min(1)
                    mark = one & ~np.uint64(0xFFFFFFFF) | two >> np.uint64(32)
                    split = np.maximum(1, df[some.astype(np.int64)] // LIST).astype(np.uint64)
                    keys.append(mix(some + mix(one) % split * np.uint64(0xD1B54A32D192ED03)))
                marks.append(mark), rids.append(np.full(len(some), rid))
            if keys:
                key, mark, rid = np.concatenate(keys), np.concatenate(marks), np.concatenate(rids)
                part = (key % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                rows = [(k, *(pack_ints(x[order[lo:hi]]) for x in (key, mark, rid))) for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "key", "mark", "rid"])

    def beside(key, pdf):
        """Pairs of rows side by side in a list, in both directions, dealt by the first one."""
        key, mark, rid = (np.concatenate([unpack_ints(x, t) for x in pdf[c]]) for c, t in (("key", np.uint64), ("mark", np.uint64), ("rid", np.int64)))
        order = np.lexsort((rid, mark, key))
        key, rid = key[order], rid[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        a, b = np.concatenate([rid[same], rid[same + 1]]), np.concatenate([rid[same + 1], rid[same]])
        with np.errstate(over="ignore"):
            part = (mix(a.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((a, part))
        at = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        rows = [(k, pack_ints(a[order[lo:hi]]), pack_ints(b[order[lo:hi]])) for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
        return pd.DataFrame(rows, columns=["part", "a", "b"])

    def partner(key, pdf):
        """The neighbour of each row that stands beside it in most lists."""
        a, b = (np.concatenate([unpack_ints(x, np.int64) for x in pdf[c]]) for c in ("a", "b"))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        a, b, count = a[first], b[first], np.diff(np.append(first, len(order)))
        order = np.lexsort((b, -count, a))
        best = order[np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1])))]
        best = best[count[best] >= AGREE]
        return pd.DataFrame({"x": [pack_ints(a[best])], "y": [pack_ints(b[best])]})

    pairs = encoded.select("rid", "terms").mapInArrow(lists, "bucket int, key binary, mark binary, rid binary").groupBy("bucket").applyInPandas(beside, "part int, a binary, b binary")
    return components(pairs.groupBy("part").applyInPandas(partner, "x binary, y binary")).select(F.col("node").alias("rid"), "root")


def in_shards(encoded: DataFrame, df: np.ndarray, n: int, shard_docs: int, parts: int, store: Store) -> DataFrame:
    """The rows in ranges of places, neighbours side by side; a task's rows are cut into shards.

    Places are uniform numbers of 62 bits.  Those of grouped rows are kept in a file for each task that encoded, so that the
    encoded rows are shuffled once and need no join."""
    spark, folder = encoded.sparkSession, store.path("places")
    near = places(encoded, df, n, parts)
    # A group lies in one place, one beyond a shard in several; rows without a partner lie by themselves.
    large = near.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") > shard_docs)
    place = F.shiftrightunsigned(F.xxhash64("root", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("rid"), F.ceil(F.col("_n") / shard_docs)))), 2)
    near = near.join(large, "root", "left").select("rid", place.alias("place"), F.shiftright("rid", 40).alias("task"))

    def keep(key, pdf):
        pdf = pdf.sort_values("rid")
        put_bytes(path := f"{folder}/{uuid.uuid4().hex}", pdf["rid"].to_numpy(np.int64).tobytes() + pdf["place"].to_numpy(np.int64).tobytes())
        return pd.DataFrame({"task": [key[0]], "path": [path]})

    files = spark.sparkContext.broadcast({r.task: r.path for r in near.groupBy("task").applyInPandas(keep, "task long, path string").collect()})  # a row for each task
    held: dict[int, np.ndarray] = {}

    @F.pandas_udf("long")
    def place_of(rid: pd.Series) -> pd.Series:
        x = rid.to_numpy(np.int64)
        out = (mix(x.view(np.uint64)) >> np.uint64(2)).astype(np.int64)
        for task in np.unique(x >> 40).tolist():
            if task in files.value:
                if task not in held:
                    if len(held) > 3:
                        held.clear()
                    held[task] = np.frombuffer(get_bytes(files.value[task]), np.int64).reshape(2, -1)
                known, at = held[task], np.minimum(np.searchsorted(held[task][0], x), held[task].shape[1] - 1)
                out = np.where(known[0][at] == x, known[1][at], out)
        return pd.Series(out)

    ranges = max(1, -(-n // shard_docs))
    placed = encoded.withColumn("place", place_of("rid"))
    part = F.shiftright(F.shiftright("place", 31) * ranges, 31).cast("int")
    return placed.repartitionById(ranges, part).sortWithinPartitions("place", "rid")


class Shard:
    """The inverted index of a shard: postings in order of term, with BM25 weights; frequent terms as a dense matrix."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = n = len(terms)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term, count = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64)
        length = np.bincount(doc, count, n)
        weight = (idf[term] * count * (K1 + 1) / (count + (K1 * (1 - B + B * length / mean))[doc])).astype(np.float32)
        names, code = np.unique(term, return_inverse=True)
        held = np.bincount(code, minlength=len(names))
        frequent = held > max(64, n * COMMON)
        column = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.matrix = np.zeros((int(frequent.sum()), n), np.float32)
        use = frequent[code]
        self.matrix[column[code[use]], doc[use]] = weight[use]
        order = np.argsort(code[~use], kind="stable")
        self.doc, self.weight = doc[~use][order], weight[~use][order]
        self.first = np.concatenate(([0], np.cumsum(np.where(frequent, 0, held))))
        at = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
        self.codes, self.column = [code[a:z] for a, z in zip(at[:-1], at[1:], strict=True)], column

    def scores(self, seeds: list[int]) -> np.ndarray:
        """BM25 of every document for each seed's terms; a seed's own is 0."""
        q = np.zeros((len(seeds), len(self.matrix)), np.float32)
        rows, lo, hi = [], [], []
        for k, s in enumerate(seeds):
            c = self.codes[s]
            col = self.column[c]
            q[k, col[col >= 0]] = 1
            c = c[col < 0]
            rows.append(np.full(len(c), k)), lo.append(self.first[c]), hi.append(self.first[c + 1])
        rows, lo, hi = np.concatenate(rows), np.concatenate(lo), np.concatenate(hi)
        size = hi - lo
        if size.sum():
            at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            out = np.bincount(np.repeat(rows, size) * self.n + self.doc[at], self.weight[at], len(seeds) * self.n).reshape(len(seeds), self.n).astype(np.float32)
        else:
            out = np.zeros((len(seeds), self.n), np.float32)
        if len(self.matrix):
            out += q @ self.matrix
        out[np.arange(len(seeds)), seeds] = 0
        return out


def fill(shard: Shard, length: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, first id, length, sequence, offset) of the pieces of all tails."""
    left, out, n = length.astype(np.int64).copy(), [], len(length)
    order = np.lexsort((np.arange(n), -left))
    sequence = at = 0

    def put(i: int, offset: int) -> int:
        take = min(int(left[i]), window - offset)
        out.append((i, int(length[i] - left[i]), take, sequence, offset))
        left[i] -= take
        return offset + take

    while True:
        while at < n and not left[order[at]]:
            at += 1
        live = order[at:][left[order[at:]] > 0]
        if not len(live):
            return out
        seeds = live[:SEEDS].tolist()
        score = shard.scores(seeds)
        for k, s in enumerate(seeds):
            if not left[s]:
                continue  # an earlier seed took it
            offset, mine = put(s, 0), score[k]
            mine[left == 0] = 0
            take = 16
            while offset < window:
                some = np.flatnonzero(mine > 0)
                if not len(some):
                    break
                if len(some) > take:  # the best of them; more if they do not fill the window
                    some = some[np.argpartition(-mine[some], take - 1)[:take]]
                for d in some[np.lexsort((some, -mine[some]))].tolist():
                    if offset == window:
                        break
                    offset = put(d, offset)
                    mine[d] = 0
                take *= 4
            rest = at
            while offset < window and rest < n:
                if left[order[rest]]:
                    offset = put(int(order[rest]), offset)
                else:
                    rest += 1
            sequence += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, shard_docs: int = 4096) -> DataFrame:
    """One row per piece; each id of each document lies in exactly one piece."""
    spark = docs.sparkSession
    ship(spark)
    store = Store(spark)
    enc = encoder(tokenizer, "lead")
    dtype, vocab = str(enc.dtype.str), enc.tok.get_vocab_size(with_added_tokens=True)
    encoded = encode(docs, tokenizer, window, end_id, store)
    n, total, size = encoded.agg(F.count("*"), F.coalesce(F.sum(F.col("doc_tokens") - 1), F.lit(0)), F.coalesce(F.sum(F.octet_length("terms").cast("long")), F.lit(0))).first()
    if not n:
        store.drop()
        return spark.createDataFrame([], PIECES)
    df = document_frequencies(encoded, vocab)
    idf = np.log1p((n - df + 0.5).clip(0.5) / (df + 0.5))
    shared, mean = spark.sparkContext.broadcast(idf), max(total / n, 1)
    item = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base, fields = [], TaskContext.get().partitionId() << 36, ("place", "doc_id", "doc_tokens", "crcs", "tail", "terms", "counts")
        names = [c.split()[0] for c in PIECES.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal base
            _, doc_ids, tokens, crcs, tails, terms, counts = zip(*rows, strict=True)
            shard = Shard([np.frombuffer(x, "<u4") for x in terms], [np.frombuffer(x, "<u4") for x in counts], shared.value, mean)
            out = []
            for i, own in enumerate(crcs):
                for k, crc in enumerate(own):
                    out.append((doc_ids[i], k * window, window, crc, tokens[i], base, 0))
                    base += 1
            pieces = fill(shard, np.array([len(x) // item for x in tails]), window)
            for i, first, size, sequence, offset in pieces:
                ids = np.frombuffer(tails[i], dtype)
                out.append((doc_ids[i], tokens[i] - len(ids) + first, size, zlib.crc32(ids[first : first + size].astype("<u4").tobytes()), tokens[i], base + sequence, offset))
            base += 1 + max((p[3] for p in pieces), default=-1)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

        def whole_groups() -> int:
            """Where a shard ends: behind its last document, or the next one that ends a group."""
            ends = (k for k in range(shard_docs, 2 * shard_docs) if held[k][0] != held[k - 1][0])
            return next(ends, shard_docs)

        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in fields), strict=True)
            while len(held) >= 2 * shard_docs:
                at = whole_groups()
                yield packed(held[:at])
                held = held[at:]
        if held:
            yield packed(held)

    placed = in_shards(encoded, df, n, shard_docs, parts_of(spark, size, 16 << 20), store)
    out = cut(placed.select("place", "doc_id", "doc_tokens", "crcs", "tail", "terms", "counts").mapInArrow(run, PIECES), "pieces")
    store.drop()
    return out
