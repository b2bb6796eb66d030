"""LM scoring: deleted interpolation of n-gram maximum-likelihood estimates.

The model mixes a smoothed unigram with the maximum-likelihood estimates of the bigram and the
trigram.  The weights depend on the frequency buckets of the two contexts; they are learned by
expectation-maximisation on the counts of deleted documents, a tenth of the training documents,
under estimates from the others.  Scores use the counts of all training documents.

1. Documents are cut in scan order into blocks of about ``block_tokens`` tokens; a block (word hashes
   in local coding, ids, roles) is a file in the shared folder and a row of a stored manifest.
2. Each block sends its distinct n-grams with their counts to hash buckets, one packed row for
   each block and bucket: counts are summed per block before they are shuffled, so a frequent
   n-gram costs a row's entry for each block, not for each token.  The number of buckets follows the bytes of text.
   This goes in ``PASSES`` passes, each for a range of the n-grams: its totals are stored and its shuffle files
   deleted before the next, so that the keys on disk at once are a share of all.
3. A bucket adds up the counts, in 64 bits, and returns to each block the totals of its own n-grams, without keys;
   those of the fitted documents only for n-grams that the block's deleted documents hold.
4. With these a block has all it needs.  Deleted documents give a histogram of context buckets and
   quantised probability ratios, bounded in size whatever the corpus, on which EM runs; then every
   document is scored.

Words and n-grams are told apart by 62 bits of a hash at every size: among 10^9 distinct words one in some 10^9
shares its count with another, among 10^12 distinct n-grams one in some 4,600,000.  A document is never split, so one very long document is a block by itself.

Defined results: a null or empty text is its end token only; rows of a null doc_id are scored,
never learned from and not held out; repeated rows count each; an empty table gives an empty
result; without training rows N and V are 0 and both scores are sums of log10(0.5/0.5) = 0; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, cut, docs_of, get_bytes, hash_words, mix, pack_ints, pack_keys, parts_of, put_bytes, ship, shuffles_dropped, sizes, unpack_ints, unpack_keys

HELD, FIT, DELETED = 0, 1, 2
LEVELS, STEP = 14, 2  # context buckets: powers of two; ratio bins: STEP to an octave
TOTALS = "bucket int, block long, fit binary, all binary"
PASSES = 4  # ranges of n-grams that are shuffled one after the other; a power of two, 16 at most
#: Hashes of the start and the end of a document; no word has them but by chance.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


class Block:
    """Documents as word hashes, each led by the start sign; ``first`` has each document's position."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, roles: np.ndarray):
        self.lengths, self.roles = lengths, roles
        self.first = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        n = len(hashes)
        lead = np.zeros(n, bool)
        lead[self.first] = True
        self.token = ~lead
        self.role = np.repeat(roles, lengths + 1)
        prev = np.roll(hashes, 1)
        prev[lead] = hashes[lead]
        prev2 = np.roll(prev, 1)
        prev2[lead] = hashes[lead]
        with np.errstate(over="ignore"):
            two = mix(hashes + np.uint64(0x9E3779B97F4A7C15) * mix(prev + np.uint64(2)))
            three = mix(two + np.uint64(0xD1B54A32D192ED03) * mix(prev2 + np.uint64(3)))
        # The low two bits hold the order: 1 to 3, and 0 for the start sign by itself.
        one, two, three = mix(hashes) & ~np.uint64(3) | (~lead).astype(np.uint64), two & ~np.uint64(3) | np.uint64(2), three & ~np.uint64(3) | np.uint64(3)
        self.grams = np.concatenate([one, two, three])

    @cached_property
    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams in order, and the place of each position's n-grams of the three orders among them."""
        order = np.argsort(self.grams)
        ranked = self.grams[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        group = np.empty(len(order), np.int32)
        group[order] = np.cumsum(new, dtype=np.int32) - 1
        return ranked[new], group.reshape(3, -1)

    def counted(self, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams of one of ``parts`` (a power of two) equal ranges, with their counts in fitted and in deleted documents."""
        mine = np.flatnonzero(self.grams >> np.uint64(64 - (parts.bit_length() - 1)) == part) if parts > 1 else np.arange(len(self.grams))
        grams, n = self.grams[mine], len(self.token)
        order = np.argsort(grams)
        mine, grams = mine[order], grams[order]
        new = np.concatenate(([True], grams[1:] != grams[:-1]))[: len(grams)]
        group, at = np.cumsum(new) - 1, mine % n
        role = np.where((mine < 2 * n) | self.token[at], self.role[at], HELD)  # no trigram ends in a start sign
        return grams[new], *(np.bincount(group[role == r], minlength=int(new.sum())).astype(np.uint64) for r in (FIT, DELETED))

    def lookups(self, totals: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, ...]:
        """c1, c2, c3 and the counts of both contexts at the tokens in ``pick`` (positions)."""
        c = totals.astype(np.float64)
        one, two, three = self.ranked[1]
        return c[one[pick]], c[two[pick]], c[three[pick]], c[one[pick - 1]], c[two[pick - 1]]

    @staticmethod
    def dump(hashes: np.ndarray, lengths: np.ndarray, roles: np.ndarray, ids: list) -> bytes:
        vocab, local, count = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which pack better
        number = np.empty(len(vocab), np.uint32)
        number[order] = np.arange(len(vocab), dtype=np.uint32)
        known = np.array([i is not None for i in ids], np.uint8)
        parts = [pack_keys(vocab), pack_ints(number), pack_ints(number[local]), pack_ints(lengths.astype(np.int64)), pack_ints(roles.astype(np.uint8)),
                 pack_ints(np.array([i or 0 for i in ids], np.int64)), pack_ints(known)]
        return b"".join(struct.pack("<I", len(p)) + p for p in parts)

    @staticmethod
    def load(data: bytes) -> tuple[Block, list]:
        parts, at = [], 0
        while at < len(data):
            n = struct.unpack_from("<I", data, at)[0]
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        vocab, number = unpack_keys(parts[0]), unpack_ints(parts[1], np.uint32)
        ordered = np.empty_like(vocab)
        ordered[number] = vocab
        hashes = ordered[unpack_ints(parts[2], np.uint32)]
        ids, known = unpack_ints(parts[5], np.int64), unpack_ints(parts[6], np.uint8)
        return Block(hashes, unpack_ints(parts[3], np.int64), unpack_ints(parts[4], np.uint8)), [int(i) if k else None for i, k in zip(ids, known, strict=True)]


def role_of(doc_id, mod: int = 5, held: int = 1, deleted: int = 10) -> int:
    if doc_id is None:
        return HELD
    crc = zlib.crc32(str(doc_id).encode())
    return HELD if crc % mod == held else DELETED if crc // mod % deleted == 0 else FIT


def _level(c: np.ndarray) -> np.ndarray:
    """Frequency bucket of a context: 0 for unseen, then powers of two."""
    return np.minimum(LEVELS - 1, np.ceil(np.log2(c + 1))).astype(np.int64)


def estimates(look: tuple[np.ndarray, ...], n: float, v: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c1, c2, c3, x2, x3 = look
    p1 = (c1 + 0.5) / (n + 0.5 * (v + 1))
    p2 = np.divide(c2, x2, out=np.zeros_like(c2), where=x2 > 0)
    p3 = np.divide(c3, x3, out=np.zeros_like(c3), where=x3 > 0)
    return p1, p2, p3, _level(x2) * LEVELS + _level(x3)


def _bin(p: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Quantised log2 ratio to the unigram, 0 for an estimate of zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(STEP * np.log2(p / p1)), -60, 120) + 61, 0).astype(np.int64)


def learn_weights(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM on the histogram: weights of unigram, bigram and trigram for each pair of context buckets.

    A bucket pair starts from, and is smoothed by five tokens of, the weights of all."""
    b, rest = np.divmod(codes, 256 * 256)
    ratio = lambda k: np.where(k > 0, 2.0 ** ((k - 61.0) / STEP), 0.0)
    r = np.stack([np.ones(len(codes)), ratio(rest // 256), ratio(rest % 256)], 1)
    whole = np.array([0.4, 0.3, 0.3])
    for _ in range(rounds):
        post = r * whole
        post /= post.sum(1, keepdims=True)
        if len(codes):
            whole = (post * counts[:, None]).sum(0) / counts.sum()
    w = np.tile(whole, (LEVELS * LEVELS, 1))
    for _ in range(rounds):
        post = r * w[b]
        post *= (counts / post.sum(1))[:, None]
        sums = np.stack([np.bincount(b, post[:, j], LEVELS * LEVELS) for j in range(3)], 1) + 5 * whole
        w = sums / sums.sum(1, keepdims=True)
    level2, level3 = np.divmod(np.arange(LEVELS * LEVELS), LEVELS)
    w[level3 == 0, 2] = 0  # an unseen context has no estimate
    w[level2 == 0, 1] = 0
    w[:, 0] = np.maximum(w[:, 0], 1e-6)
    return w / w.sum(1, keepdims=True)


def score(docs: DataFrame, mod: int = 5, held: int = 1, block_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    import pandas as pd

    spark = docs.sparkSession
    ship(spark)
    made = Store(spark)
    parts = parts_of(spark, sizes(docs)[1], 8 << 20)
    buckets = 1 << max(4, (parts - 1).bit_length())
    folder = made.path("lm-blocks")
    where = lambda block: f"{folder}/block-{block & 0xFF:02x}/{block:016x}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, lengths, size = [], [], [], 0

        def flush():
            nonlocal ids, hashes, lengths, size
            block = uuid.uuid4().int >> 66
            roles = np.array([role_of(i, mod, held) for i in ids], np.uint8)
            h, n = np.concatenate(hashes), np.array(lengths, np.int64)
            put_bytes(where(block), Block.dump(h, n, roles, ids))
            fit, gone = (int(n[roles == r].sum()) for r in (FIT, DELETED))
            ids, hashes, lengths, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([{"block": block, "fit": fit, "gone": gone}], schema=pa.schema([("block", pa.int64()), ("fit", pa.int64()), ("gone", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = np.concatenate(([START], hash_words(text), [END]))
                ids.append(doc_id), hashes.append(h), lengths.append(len(h) - 1)
                size += len(h)
                if size >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    blocks = made.cut(docs_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(store, "block long, fit long, gone long"), "lm-manifest")
    total = blocks.agg(F.coalesce(F.sum("fit"), F.lit(0)).alias("fit"), F.coalesce(F.sum("gone"), F.lit(0)).alias("gone")).first()

    def sender(part: int):
        def send(pdfs: Iterator) -> Iterator:
            for pdf in pdfs:
                for block in pdf["block"]:
                    b, _ = Block.load(get_bytes(where(block)))
                    keys, fit, gone = b.counted(part, PASSES)
                    first, own = part * (buckets // PASSES), buckets // PASSES
                    ends = np.searchsorted(keys, np.arange(first + 1, first + own, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1)))
                    cuts = np.concatenate(([0], ends, [len(keys)]))
                    yield pd.DataFrame([(first + k, block, pack_keys(keys[s:e]), pack_ints(fit[s:e]), pack_ints(gone[s:e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s],
                                       columns=["bucket", "block", "keys", "fit", "gone"])

        return send

    def add_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(k) for k in pdf["keys"]]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        new = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        group = np.empty(len(every), np.int64)
        group[order] = np.cumsum(new) - 1
        counts = {c: [unpack_ints(x, np.uint64) for x in pdf[c]] for c in ("fit", "gone")}
        starts = np.flatnonzero(new)
        sums = [np.add.reduceat(np.concatenate(counts[c])[order], starts) for c in ("fit", "gone")]
        ones = every[order][new] & np.uint64(3) == 1
        rows, at = [(key[0], -1, struct.pack("<qq", int((ones & (sums[0] > 0)).sum()), int((ones & (sums[0] + sums[1] > 0)).sum())), b"")], 0
        for block, k, gone in zip(pdf["block"], keys, counts["gone"], strict=True):
            g = group[at : at + len(k)]
            rows.append((key[0], block, pack_ints(np.where(gone > 0, sums[0][g], np.uint64(0))), pack_ints(sums[0][g] + sums[1][g])))
            at += len(k)
        return pd.DataFrame(rows, columns=["bucket", "block", "fit", "all"])

    spread = blocks.select("block").repartition(4 * parts, "block")
    added = [made.path("lm-totals") for _ in range(PASSES)]
    with shuffles_dropped(spark):
        for part, path in enumerate(added):
            sent = spread.mapInPandas(sender(part), "bucket int, block long, keys binary, fit binary, gone binary")
            sent.groupBy("bucket").applyInPandas(add_up, TOTALS).write.option("compression", "zstd").parquet(path)
    totals = spark.read.schema(TOTALS).parquet(*added)
    v_fit = v_all = 0
    for r in totals.where("block = -1").select("fit").collect():  # one row for each bucket
        x, y = struct.unpack("<qq", r["fit"])
        v_fit, v_all = v_fit + x, v_all + y
    own = lambda what: totals.where("block <> -1").select("bucket", "block", F.col(what).alias("counts")).groupBy("block")

    def gathered(pdf: pd.DataFrame) -> np.ndarray:
        return np.concatenate([unpack_ints(x, np.uint64) for x in pdf.sort_values("bucket")["counts"]])

    def histogram(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b, _ = Block.load(get_bytes(where(key[0])))
        pick = np.flatnonzero(b.token & (b.role == DELETED))
        p1, p2, p3, level = estimates(b.lookups(gathered(pdf), pick), total.fit, v_fit)
        code, n = np.unique((level * 256 + _bin(p2, p1)) * 256 + _bin(p3, p1), return_counts=True)
        return pd.DataFrame({"code": code, "n": n})

    seen = own("fit").applyInPandas(histogram, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    weights = learn_weights(seen["code"].to_numpy(np.int64), seen["n"].to_numpy(float))
    n_all = total.fit + total.gone

    def judge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b, ids = Block.load(get_bytes(where(key[0])))
        pick = np.flatnonzero(b.token)
        p1, p2, p3, level = estimates(look := b.lookups(gathered(pdf), pick), n_all, v_all)
        w = weights[level]
        starts = np.concatenate(([0], np.cumsum(b.lengths)))[:-1].astype(np.int64)
        sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731  each document has its end token
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": b.lengths, "n_known": sums((look[0] > 0).astype(np.int64)), "base_score": sums(np.log10(p1)),
                             "score": sums(np.log10(w[:, 0] * p1 + w[:, 1] * p2 + w[:, 2] * p3))})

    scored = own("all").applyInPandas(judge, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    is_held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == held, F.lit(False))
    out = cut(scored.select("doc_id", is_held.alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score"), "lm-scores")
    made.drop()
    return out
