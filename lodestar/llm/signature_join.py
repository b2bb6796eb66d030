"""N-gram Jaccard join: signature trees with dual traversal.

Exact links between documents whose word-shingle sets have a Jaccard similarity of at least
``num``/100, and the classes that the links form.

1. Each document's shingles become a sorted set of 64-bit hashes; only its size, a 128-bit digest of
   the set and, packed by hash bucket, its keys are stored.  The keys are digests of parts: the range
   of hashes is cut into so many parts that the hashes two linked sets do not share cannot touch all
   of them, so some part is equal in both.  A part holds several hashes, so a passage that
   unlinked documents share seldom makes a whole part equal, however frequent it is.
2. Documents of one digest are one class, named by its smallest doc_id.  Copies within a batch go on
   once, so a group of copies costs an entry for each batch.
3. Sets that share a key are joined; connected components of this graph are regions within which
   links lie.  In each of them the sets meet once more by the hashes of their prefixes, rare hashes first.  Sets
   that share one are joined if their sizes and the parities of their hashes by bucket, of which linked sets differ in few, allow a
   link; the components are the final regions.  Without that test sets that are merely a little alike chain up,
   from some size of the corpus on, to one region of a large share of it.  Which hashes are frequent is learnt from a sample of about
   ``order_docs`` documents; any order is correct, this one parts sets that share a common passage only.
4. The packed sets of the documents in regions of two or more meet by region, once each; the others are
   left out by a Bloom filter of bounded size.  Regions beyond ``block_sets`` sets or ``region_limit`` shingles
   are dealt to blocks.  In a region or block a signature tree is built over the sets by size: a node holds the
   OR of its members' token bitmaps and their size range.  Dual traversal compares nodes, prunes a pair of nodes
   when the maximum possible overlap or the sizes exclude a link or all members are linked already, and checks the
   remaining pairs of sets exactly.  Linked sets are merged at once, so a group of near copies costs about one
   check each, and only a spanning forest of links leaves the task.
5. The sets of a block are stored.  One set of each class found in a block meets those of other blocks, so that
   near copies become one class.  Regions with several classes left go up the tree: their sets are dealt anew by
   size to leaf blocks, each stored once, and the OR-bitmap and size range of every block enter the region's stored tree.
   Each block outside the largest class walks that tree and reads only the blocks it cannot exclude;
   pairs of one class are not compared.  No set is shuffled for a pair.
   Connected components of all the forests give the classes.

The bitmap is in unary code: bit (bucket, c) is set if a set has more than c hashes in the bucket, so
the OR of bitmaps is the maximum of counters and the number of common bits, a sum of minima, bounds
the overlap of any two members.

Defined results: null or empty texts, and texts without a word, have an empty set, link with nothing
and are their own component; equal rows link; rows of one doc_id with different texts have each the class of
their own text, and classes named by one doc_id are one; rows of a null doc_id are returned with a null component
and link with nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Store, batches_of, components, cut, docs_of, get_bytes, hash_words, mix, pack_ints, pack_keys, packed_edges, parted, parts_of, put_bytes, ship, sizes, stars, unpack_ints, unpack_keys

BUCKETS, LEAF, FAN = 512, 32, 6
BATCH = 2000  # documents described at once
SMALL, LISTED, PIVOTS = 24, 400, 4096  # sets of a prefix hash whose pairs are listed with others', by themselves, and tested at all: more are joined untested


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; a shorter text is one window; no word: none."""
    h = hash_words(text)
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        acc = np.full(n, 0x9E3779B97F4A7C15 + k, np.uint64)
        for i in range(k):
            acc = mix(acc * np.uint64(0x100000001B3) + h[i : i + n])
    return np.unique(acc)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def size_classes(n: int, num: int) -> list[tuple[int, int, int]]:
    """The two classes (class, parts, most differences) in which a set of n hashes takes part.

    Interval i of sizes starts where a link with the first size of interval i - 1 ends, so linked sets lie
    in one interval or in neighbouring ones.  Class c is for pairs whose smaller set is in interval c - 1."""
    i, low, high = 0, 1, 100 // num + 1
    while n >= high:
        i, low, high = i + 1, high, 100 * high // num + 1
    out = []
    for c, first, second in ((i, low, high), (i + 1, high, 100 * high // num + 1)):
        most = (first + second - 2) * (100 - num) // (100 + num)
        out.append((c, most + 2 + most // 24, most))
    return out


def part_keys(s: np.ndarray, num: int) -> np.ndarray:
    """A key of 48 bits for each part of the set that has hashes, in both of its classes.

    Of K parts at least K - d are equal in two linked sets with at most d differences.  A set with K - d or more
    parts without a hash could be equal to another in those alone; its first n - ceil(t n) + 1 hashes are
    keys as well, of which two such sets share one."""
    out = []
    with np.errstate(over="ignore"):
        mixed = mix(s)
        for c, parts, most in size_classes(len(s), num):
            part = (s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # ascending, as s is
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            tag = np.uint64(c) * np.uint64(0x9E3779B97F4A7C15)
            out.append(mix(np.add.reduceat(mixed, first) + mix(tag + part[first])))
            if parts - len(first) >= parts - most:
                out.append(mix(mixed[: len(s) - _ceil(num * len(s), 100) + 1] + mix(~tag)))
    return np.unique(np.concatenate(out) & ~np.uint64(0xFFFF))


class Node:
    __slots__ = ("bits", "low", "high", "members", "children", "sole")

    def __init__(self, bits, low, high, members, children):
        self.bits, self.low, self.high, self.members, self.children = bits, low, high, members, children
        self.sole = -1  # the component of all members, once they are in one


def buckets_for(sets: list[np.ndarray]) -> int:
    """Counters of a bitmap: about as many as the largest set has hashes, so that most are 0 or 1."""
    return min(1 << 13, max(BUCKETS, 1 << max((len(s) for s in sets), default=1).bit_length()))


def bitmap(s: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.int32)


class SignatureTree:
    """Leaves of sets of similar size, then nodes of FAN children."""

    def __init__(self, sets: list[np.ndarray], order: list[int], buckets: int = BUCKETS):
        self.order = {i: k for k, i in enumerate(order)}
        bits = [bitmap(sets[i], buckets) for i in order]
        kind = np.uint8 if max(int(b.max(initial=0)) for b in bits) < 256 else np.int32
        self.bits = np.array(bits, kind)
        level = []
        for at in range(0, len(order), LEAF):
            m = order[at : at + LEAF]
            level.append(Node(self.bits[at : at + LEAF].max(0), len(sets[m[0]]), len(sets[m[-1]]), m, None))
        self.root = grown(level)

    def rows(self, members: list[int]) -> np.ndarray:
        at = self.order[members[0]]
        return self.bits[at : at + len(members)]


def grown(level: list[Node]) -> Node:
    """The tree over nodes in order of size."""
    while len(level) > 1:
        level = [Node(np.maximum.reduce([c.bits for c in g]), min(c.low for c in g), max(c.high for c in g), [i for c in g for i in c.members], g)
                 for g in (level[at : at + FAN] for at in range(0, len(level), FAN))]
    return level[0]


def may_link(num: int, low_a: int, high_a: int, low_b: int, high_b: int, bits_a: np.ndarray, bits_b: np.ndarray) -> bool:
    """Whether two members of these sizes and bitmaps could link: overlap >= t/(1+t) (|A|+|B|)."""
    if 100 * high_a < num * low_b or 100 * high_b < num * low_a:
        return False
    most = int(np.minimum(bits_a, bits_b).sum(dtype=np.int64))
    # A set of a node has at least ``low`` hashes; with overlap o the union is at least low_a + low_b - o.
    o = min(most, high_a, high_b)
    return 100 * o >= num * (max(low_a, o) + max(low_b, o) - o)


class Linker:
    """Finds a spanning forest of the links among sets, with the dual traversal."""

    def __init__(self, sets: list[np.ndarray], num: int, roots: list[int] | None = None):
        first: dict[int, int] = {}
        parent = [first.setdefault(r, i) for i, r in enumerate(roots)] if roots else list(range(len(sets)))
        self.sets, self.num, self.parent, self.edges, self.checks = sets, num, parent, [], 0

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        self.checks += 1
        both = np.concatenate([a, b])
        both.sort()
        o = int((both[1:] == both[:-1]).sum())
        return 100 * o >= self.num * (len(a) + len(b) - o)

    def leaves(self, tree_a: SignatureTree, tree_b: SignatureTree, a: Node, b: Node) -> None:
        """The pairs of two leaves (or of one) whose sizes and bitmaps allow a link, checked one after the other."""
        n, m = (np.array([len(self.sets[i]) for i in x.members], np.int64) for x in (a, b))
        r, s = (np.array([self.find(i) for i in x.members]) for x in (a, b))
        near = (100 * n[:, None] >= self.num * m) & (100 * m >= self.num * n[:, None]) & (r[:, None] != s)
        i, j = np.nonzero(np.triu(near, 1) if a is b else near)
        bits_a, bits_b = tree_a.rows(a.members), tree_b.rows(b.members)
        for at in range(0, len(i), 512):
            x, y = i[at : at + 512], j[at : at + 512]
            most = np.minimum(bits_a[x], bits_b[y]).sum(1, dtype=np.int64)
            for k in np.flatnonzero(100 * most >= self.num * (n[x] + m[y] - most)).tolist():
                p, q = a.members[x[k]], b.members[y[k]]
                u, v = self.find(p), self.find(q)
                if u != v and self.linked(p, q):
                    self.parent[max(u, v)] = min(u, v)
                    self.edges.append((p, q))

    def sole(self, n: Node) -> int:
        """The component that holds all members, or -1."""
        if n.sole < 0:
            r = self.find(n.members[0])
            if any(self.find(i) != r for i in n.members[1:]):
                return -1
            n.sole = r
        return self.find(n.sole)

    def walk(self, tree_a: SignatureTree, tree_b: SignatureTree) -> None:
        todo = [(tree_a.root, tree_b.root)]
        while todo:
            a, b = todo.pop()
            s = self.sole(a)
            if s >= 0 and (a is b or s == self.sole(b)):
                continue
            if a is not b and not may_link(self.num, a.low, a.high, b.low, b.high, a.bits, b.bits):
                continue
            if a.children is None and b.children is None:
                self.leaves(tree_a, tree_b, a, b)
            elif a is b:
                c = a.children
                todo += [(c[x], c[y]) for y in range(len(c)) for x in range(y)] + [(x, x) for x in c]
            elif b.children is None or (a.children is not None and len(a.members) >= len(b.members)):
                todo += [(c, b) for c in a.children]
            else:
                todo += [(a, c) for c in b.children]


def forest(sets: list[np.ndarray], num: int, block: list[int] | None = None, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the components; with ``block``, only links between the two blocks; sets of equal ``roots`` are joined already."""
    link, buckets = Linker(sets, num, roots), buckets_for(sets)
    groups: dict[int, list[int]] = {}
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        groups.setdefault(block[i] if block else 0, []).append(i)
    trees = [SignatureTree(sets, order, buckets) for _, order in sorted(groups.items())]
    if len(trees) == 1:
        link.walk(trees[0], trees[0])
    elif len(trees) == 2:
        link.walk(*trees)
    return link.edges


def prefix(s: np.ndarray, num: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 hashes by (frequency, hash), 32 bits of each; two linked sets share one."""
    take = len(s) - _ceil(num * len(s), 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = np.where(frequent[at] == s, counts[at], 0)
        if often.any():
            s = s[np.lexsort((s, often))]
    return (s[:take] >> np.uint64(32)).astype("<u4")


def parity_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity bitmaps of sets of n hashes: at 0.8 unlike sets differ in half of them, linked ones in fewer."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(1, 0.75 * n))).astype(np.int64), 64, 1 << 13)


def parities(s: np.ndarray) -> bytes:
    """Whether each bucket holds an odd number of hashes.  Two sets differ in no more bits than in hashes."""
    bits = int(parity_bits(np.array(len(s))))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Sets by size and parity bitmap, and which pairs of them could link."""

    def __init__(self, n: np.ndarray, raw: list[bytes], num: int):
        self.n, self.num, self.bits = n, num, np.array([len(r) * 8 for r in raw], np.int64)
        self.row, self.tables = np.zeros((2, len(raw)), np.int64), {}  # a set's row in the table of its own bits and in that of half of them
        for bits in np.unique(self.bits).tolist():
            for half in (0, 1):
                own = np.flatnonzero(self.bits == bits)
                x = np.frombuffer(b"".join(raw[i] for i in own), "<u8").reshape(len(own), -1)
                if half and bits == 64:
                    continue
                if half:  # the parity over two buckets is that of both bits
                    x = x[:, : bits // 128] ^ x[:, bits // 128 :]
                table = self.tables.setdefault(bits >> half, [])
                self.row[half, own] = sum(map(len, table)) + np.arange(len(own))
                table.append(x)
        self.tables = {bits: np.concatenate(t) for bits, t in self.tables.items()}

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.n[a], self.n[b]
        out = 100 * np.minimum(n, m) >= self.num * np.maximum(n, m)
        most = n + m - 2 * -(-self.num * (n + m) // (100 + self.num))  # hashes in which linked sets of these sizes differ
        bits = np.minimum(self.bits[a], self.bits[b])
        out &= np.maximum(self.bits[a], self.bits[b]) <= 2 * bits if self.num >= 50 else True
        for k in np.unique(bits[out]).tolist():
            some = np.flatnonzero(out & (bits == k))
            for lo in range(0, len(some), step := max(1, (1 << 24) // k)):
                at = some[lo : lo + step]
                x, y = (self.tables[k][self.row[(self.bits[i] > k).astype(np.int64), i]] for i in (a[at], b[at]))
                out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[at]
        return out


def candidates(keys: np.ndarray, sets: np.ndarray, test: Parities) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of an equal key that join the same components as all such pairs that could link, and maybe more."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    small = np.repeat(size <= SMALL, size)
    pairs = []
    for d in range(1, min(SMALL, int(size.max(initial=0)))):
        at = np.flatnonzero(small[:-d] & (keys[d:] == keys[:-d]))
        pairs.append(np.unique(sets[at] * len(test.n) + sets[at + d]))
    a, b = np.divmod(np.unique(np.concatenate(pairs)), len(test.n)) if pairs else (np.zeros(0, np.int64),) * 2
    fit = np.concatenate([test.may_link(a[lo : lo + 500_000], b[lo : lo + 500_000]) for lo in range(0, len(a), 500_000)] or [np.zeros(0, bool)])
    x, y = [a[fit]], [b[fit]]
    done = set()
    for lo, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        own = np.unique(sets[lo : lo + n])
        if (mark := own.tobytes()) in done:
            continue
        done.add(mark)
        if len(own) <= LISTED:
            i, j = np.triu_indices(len(own), 1)
            near = test.may_link(own[i], own[j])
            x.append(own[i[near]]), y.append(own[j[near]])
            continue
        if len(own) > PIVOTS:
            x.append(np.full(len(own), own[0])), y.append(own)
            continue
        label = np.arange(len(own))  # of the component of each, so that copies of one text are tested once
        for i in range(len(own) - 1):
            rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            near = rest[test.may_link(np.full(len(rest), own[i]), own[rest])] if len(rest) else rest
            if len(near):
                label[np.isin(label, label[near])] = label[i]
                x.append(np.full(len(near), own[i])), y.append(own[near])
    return np.concatenate(x), np.concatenate(y)


def frequent_hashes(docs: DataFrame, width: int, order_docs: int, n: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur three times or more in a part of a sample of about ``order_docs`` documents, at most ``most`` a part, and their counts."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(n, 1))) < order_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [shingles(t, width) for b in batches for t in b.column("text").to_pylist()]
        if sets:
            h, c = np.unique(np.concatenate(sets), return_counts=True)
            keep = np.flatnonzero(c >= 3)
            keep = keep[np.argsort(-c[keep], kind="stable")[:most]]
            yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([c[keep].astype(np.int64).tobytes()], pa.binary())], names=["h", "c"])

    got = docs_of(some).repartition(4).mapInArrow(run, "h binary, c binary").collect()
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = np.concatenate([np.frombuffer(r.h, np.uint64) for r in got]), np.concatenate([np.frombuffer(r.c, np.int64) for r in got])
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse, c, len(u)).astype(np.int64)


def packed(keys: np.ndarray, ids: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, keys, ids) by the leading bits of the keys."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    ends = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1)))
    cuts = np.concatenate(([0], ends, [len(keys)])).tolist()
    return [(k, pack_keys(keys[s:e]), pack_ints(ids[s:e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]


def refs_of(path: str, ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, str, int, int]]:
    """Stores sets one after the other; (doc_id, path, first byte, size) of each."""
    put_bytes(path, b"".join(s.astype("<u8").tobytes() for s in sets))
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1] * 8
    return [(i, path, int(a), len(s)) for i, a, s in zip(ids, at, sets, strict=True)]


def read_set(path: str, at: int, n: int) -> np.ndarray:
    return np.frombuffer(get_bytes(path, at, 8 * n), "<u8")


def runs(pdfs: Iterator, *by: str) -> Iterator:
    """(key, rows) of each run of equal keys in rows that come sorted by them."""
    key, held = None, []
    for pdf in pdfs:
        for r in pdf.itertuples(index=False):
            now = tuple(getattr(r, c) for c in by)
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(r)
    if held:
        yield key, held


def near_duplicates(docs: DataFrame, width: int = 4, num: int = 85, region_limit: int = 4_000_000, block_sets: int = 128, order_docs: int = 16_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, stored."""
    with batches_of(docs.sparkSession, BATCH):
        return _near_duplicates(docs, width, num, region_limit, block_sets, order_docs)


def _near_duplicates(docs: DataFrame, width: int, num: int, region_limit: int, block_sets: int, order_docs: int) -> DataFrame:
    import pandas as pd

    spark = docs.sparkSession
    ship(spark)
    store = Store(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs, n_bytes = sizes(docs)
    parts = parts_of(spark, n_bytes)
    buckets = 1 << max(3, (parts - 1).bit_length())
    order = spark.sparkContext.broadcast(frequent_hashes(docs, width, order_docs, n_docs))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and for each batch and bucket one row of packed keys with their documents."""
        names = ["doc_id", "n", "h1", "h2", "rare", "bits", "bucket", "keys", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            n, h1, h2, rare, bits, heads = [], [], [], [], [], {}
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(t, width)
                x, y = digest(s)
                n.append(len(s)), h1.append(x), h2.append(y), rare.append(None), bits.append(None)
                if len(s) and i is not None and ((x, y) not in heads or i < heads[x, y][0]):  # copies in a batch go on once
                    heads[x, y] = (i, heads[x, y][1] if (x, y) in heads else part_keys(s, num))
                    rare[-1], bits[-1] = prefix(s, num, *order.value).tobytes(), parities(s)
            rows = len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, kinds[1]), pa.array(h1, kinds[2]), pa.array(h2, kinds[3]), pa.array(rare, kinds[4]), pa.array(bits, kinds[5]), *(pa.nulls(rows, k) for k in kinds[6:])], names=names)
            if heads:
                some = packed(np.concatenate([k for _, k in heads.values()]), np.repeat(np.array([i for i, _ in heads.values()], np.int64), [len(k) for _, k in heads.values()]), buckets)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), k) for k in kinds[:6]), *(pa.array(list(c), k) for c, k in zip(zip(*some), kinds[6:]))], names=names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The prefixes of the sets of regions, packed by bucket, each hash mixed with its region; and for each bucket the sets' sizes and parities."""
        for b in batches:
            sets = [np.frombuffer(x, "<u4").astype(np.uint64) for x in b.column("rare").to_pylist()]
            if not sets:
                continue
            lens, bits = [len(x) for x in sets], b.column("bits").to_pylist()
            ids, n = b.column("doc_id").to_numpy(), b.column("n").to_numpy()
            at, region = np.repeat(np.arange(len(sets)), lens), np.repeat(b.column("region").to_numpy().astype(np.uint64), lens)
            with np.errstate(over="ignore"):
                keys = mix(mix(region + np.uint64(1)) + np.concatenate(sets)) & ~np.uint64(0xFFFF)
            out = []
            for k, x, y in packed(keys, at, buckets):
                own, place = np.unique(unpack_ints(y, np.int64), return_inverse=True)
                out.append((k, x, pack_ints(place.astype(np.uint32)), pack_ints(ids[own]), pack_ints(n[own]), b"".join(bits[i] for i in own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["bucket", "keys", "at", "ids", "n", "bits"])

    def meet_near(key, pdf):
        """Documents of a prefix hash that could link are joined, a star for each component."""
        ids, n = ([unpack_ints(x, np.int64) for x in pdf[c]] for c in ("ids", "n"))
        base = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        sets = np.concatenate([unpack_ints(x, np.uint32).astype(np.int64) + lo for x, lo in zip(pdf["at"], base[:-1].tolist(), strict=True)])
        ids, n = np.concatenate(ids), np.concatenate(n)
        ends, whole = np.cumsum(parity_bits(n) // 8).tolist(), b"".join(pdf["bits"])
        test = Parities(n, [whole[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)], num)
        a, b = candidates(np.concatenate([unpack_keys(x) for x in pdf["keys"]]), sets, test)
        low, high = stars(ids[a], ids[b])
        return pd.DataFrame({"x": [pack_ints(low)], "y": [pack_ints(high)]})

    def meet(key, pdf):
        """Documents of a key are joined; what the keys of the bucket join is a star for each component."""
        keys, ids = np.concatenate([unpack_keys(x) for x in pdf["keys"]]), np.concatenate([unpack_ints(x, np.int64) for x in pdf["ids"]])
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        low, high = stars(ids[first][np.cumsum(first) - 1], ids)
        return pd.DataFrame({"x": [pack_ints(low)], "y": [pack_ints(high)]})

    def met(entries: DataFrame, how) -> DataFrame:
        found = components(entries.groupBy("bucket").applyInPandas(how, "x binary, y binary"))
        return found.select(F.col("node").alias("doc_id"), F.col("root").alias("region"))

    described = store.cut(docs_of(docs).mapInArrow(describe, "doc_id long, n long, h1 long, h2 long, rare binary, bits binary, bucket int, keys binary, ids binary"), "sets")
    own_rows = described.where("bucket IS NULL").select("doc_id", "n", "h1", "h2")
    classes = own_rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    coarse = met(described.where("bucket IS NOT NULL").select("bucket", "keys", "ids"), meet)
    heads = described.where("rare IS NOT NULL").select("doc_id", "n", "rare", "bits").join(coarse, "doc_id")
    members = met(heads.mapInArrow(again, "bucket int, keys binary, at binary, ids binary, n binary, bits binary"), meet_near)
    members = store.cut(members.join(classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n")), "doc_id"), "regions")
    large = store.cut(members.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).where((F.col("sets") > block_sets) | (F.col("total") > region_limit))
                      .select("region", F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(2 * F.col("total") / region_limit)).cast("int").alias("blocks")), "large")
    bloom = spark.sparkContext.broadcast(Bloom(members.select("doc_id")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the documents that may be members, once for each batch of copies."""
        for b in batches:
            b = b.filter(pa.array(b.column("doc_id").is_valid()))
            b = b.filter(pa.array(bloom.value.has(b.column("doc_id").to_numpy())))
            sets = {(i, s.tobytes()) for i, s in zip(b.column("doc_id").to_pylist(), (shingles(t, width) for t in b.column("text").to_pylist()), strict=True) if len(s)}
            ids, raw = zip(*sorted(sets), strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "shingles"])

    folder = store.path("set-blocks")
    SPEC = "a long, b long, region long, path string, at long, n long"
    columns = [c.split()[0] for c in SPEC.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if c != "path"})

    def link(pdfs: Iterator) -> Iterator:
        """The links within each (region, block); the sets of blocks of large regions are stored."""
        for (region, _), rows in runs(pdfs, "region", "block"):
            sets, ids = [np.frombuffer(r.shingles, np.uint64) for r in rows], [r.doc_id for r in rows]
            split = rows[0].blocks > 1
            out = [(ids[i], ids[j], region if split else None, None, None, None) for i, j in forest(sets, num)]
            if split:
                out += [(i, None, region, path, at, n) for i, path, at, n in refs_of(f"{folder}/{uuid.uuid4().hex}", ids, sets)]
            yield frame(out)

    dealt = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks"))
    met_sets = docs_of(docs).mapInArrow(sets_of, "doc_id long, shingles binary").join(members.join(large, "region", "left").select("doc_id", "region", F.coalesce("blocks", F.lit(1)).alias("blocks")), "doc_id")
    grouped = met_sets.withColumn("block", dealt).repartition(parts, "region", "block").sortWithinPartitions("region", "block", "doc_id")
    linked = store.cut(grouped.mapInPandas(link, SPEC), "links")
    links = linked.where("path IS NULL").select("a", "b")
    if large.head(1):
        refs = linked.where("path IS NOT NULL").select(F.col("a").alias("doc_id"), "region", "path", "at", "n")
        inner = linked.where("path IS NULL AND region IS NOT NULL").select("a", "b")

        def rooted(links: DataFrame) -> DataFrame:
            c = components(packed_edges(links)).select(F.col("node").alias("doc_id"), "root")
            return store.cut(refs.join(c, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "rooted")

        def link_refs(pdfs: Iterator) -> Iterator:
            for _, rows in runs(pdfs, "region", "block"):
                yield pd.DataFrame([(rows[i].doc_id, rows[j].doc_id) for i, j in forest([read_set(r.path, r.at, r.n) for r in rows], num)], columns=["a", "b"], dtype="int64")

        reps = rooted(inner).where("root = doc_id")
        per = reps.groupBy("region").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("now"))
        reps = reps.join(per, "region").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("now")))
        more = store.cut(reps.repartition(parts, "region", "block").sortWithinPartitions("region", "block", "doc_id").mapInPandas(link_refs, "a long, b long"), "links")
        links, inner = links.unionByName(more), inner.unionByName(more)
        now = rooted(inner)
        per = now.groupBy("region", "root").agg(F.count("*").alias("sets"))
        several = store.cut(per.groupBy("region").agg(F.max_by("root", F.struct("sets", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("region", "main"), "several")
        # Sizes of linked sets lie in one band or in neighbouring ones, as a band is a little wider than the ratio 100 / num.
        band = F.floor(F.log(F.col("n").cast("double")) / (1.001 * math.log(100 / num) if num < 100 else 1.0)).cast("int")
        rest = now.join(several, "region").withColumn("inner", F.col("root") == F.col("main")).withColumn("band", band)
        groups = rest.groupBy("region", "inner", "band").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("blocks"))
        rest = rest.join(groups, ["region", "inner", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("blocks")))
        rest = rest.repartition(parts, "region", "inner", "band", "block").sortWithinPartitions("region", "inner", "band", "block", "n", "doc_id")

        def leaf_blocks(pdfs: Iterator) -> Iterator:
            """Stores each block as a leaf of its region's tree: path, sizes and OR-bitmap."""
            for (region, outer, _, _), rows in runs(pdfs, "region", "inner", "band", "block"):
                sets, path = [read_set(r.path, r.at, r.n) for r in rows], f"{folder}/{uuid.uuid4().hex}"
                put_bytes(path, pickle.dumps(([r.doc_id for r in rows], [r.root for r in rows], sets)))
                bits = np.maximum.reduce([bitmap(s) for s in sets])
                yield pd.DataFrame({"region": [region], "inner": [outer], "path": [path], "low": [len(sets[0])], "high": [len(sets[-1])], "bits": [pack_ints(bits)]})

        leaves = store.cut(rest.mapInPandas(leaf_blocks, "region long, inner boolean, path string, low long, high long, bits binary"), "leaves")

        def plant(key, pdf):
            """Stores the leaves of a region for its tree."""
            path = f"{folder}/{uuid.uuid4().hex}"
            rows = sorted(zip(pdf["low"].tolist(), pdf["high"].tolist(), pdf["path"].tolist(), pdf["inner"].tolist(), pdf["bits"].tolist(), strict=True))
            put_bytes(path, pickle.dumps(rows))
            return pd.DataFrame({"region": [key[0]], "tree": [path]})

        trees = store.cut(leaves.groupBy("region").applyInPandas(plant, "region long, tree string"), "trees")

        def climb(pdfs: Iterator) -> Iterator:
            """Each block outside the main class walks the region's tree and meets the blocks that it cannot exclude."""
            for (tree,), rows in runs(pdfs, "tree"):
                kept = pickle.loads(get_bytes(tree))
                place = {x[2]: k for k, x in enumerate(kept)}
                root = grown([Node(unpack_ints(bits, np.int32), low, high, [k], None) for k, (low, high, _, _, bits) in enumerate(kept)])
                for r in rows:
                    mine, (ids, roots, sets) = place[r.path], pickle.loads(get_bytes(r.path))
                    out = [(ids[i], ids[j]) for i, j in forest(sets, num, None, roots)]
                    low, high, bits, todo = r.low, r.high, unpack_ints(r.bits, np.int32), [root]
                    while todo:
                        node = todo.pop()
                        if not may_link(num, low, high, node.low, node.high, bits, node.bits):
                            continue
                        if node.children is not None:
                            todo += node.children
                        elif kept[k := node.members[0]][3] or k > mine:  # two blocks outside the main class meet once
                            ids_b, roots_b, sets_b = pickle.loads(get_bytes(kept[k][2]))
                            both = [*ids, *ids_b]
                            out += [(both[i], both[j]) for i, j in forest([*sets, *sets_b], num, [0] * len(ids) + [1] * len(ids_b), [*roots, *roots_b])]
                    yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        walkers = leaves.where("NOT inner").join(trees, "region").repartition(parts, "path").sortWithinPartitions("tree")
        links = links.unionByName(store.cut(walkers.mapInPandas(climb, "a long, b long"), "links"))
    found = components(packed_edges(links))
    own = classes.select("h1", "h2", "rep").join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    # An empty set gets a digest of its own, so that empty texts are not one key.
    keyed = own_rows.withColumn("h1", F.when(F.col("n") == 0, F.xxhash64("doc_id")).otherwise(F.col("h1"))).withColumn("h2", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("h2")))
    joined = keyed.join(own, ["h1", "h2"], "left")
    own_id = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = cut(joined.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id")), "classes")
    store.drop()
    return out


def keep_one(docs: DataFrame, width: int, num: int) -> DataFrame:
    """One document of each class of near copies: the one whose doc_id names the class.

    Rows of a null doc_id stay; of several rows of one doc_id that stays the first by text does.  Only rows that may go are shuffled."""
    found = near_duplicates(docs, width, num).where("doc_id IS NOT NULL")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("stays"))
    doubtful = cut(rows.where("n > 1 OR stays = 0"), "doubtful")
    gone = doubtful.where("stays = 0").select("doc_id")
    clear, rest = parted(docs, doubtful)
    rest = cut(rest.join(gone, "doc_id", "left_anti").select(docs.columns), "rest")
    first = rest.groupBy("doc_id").agg(F.min("text").alias("_t"))
    chosen = rest.join(first, "doc_id").where(F.col("text").eqNullSafe(F.col("_t"))).drop("_t").dropDuplicates(["doc_id"])
    return clear.unionByName(chosen.select(docs.columns))
