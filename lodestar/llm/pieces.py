"""Tokenizing by cached pieces.

A pre-tokenizer that never joins characters across certain white space lets a text be cut there and
each piece be encoded on its own; equal pieces are encoded once per worker by the tokenizers
library.  Two cuts are known: ``drop`` (white space is no token: cut at ASCII white space and drop
it) and ``lead`` (a space leads the next token: keep it at the piece's front).  Texts with white
space beyond ASCII are encoded whole in the second mode.  The added tokens of the tokenizer file hold as the library has it:
a text with the content of one, in whatever case, is encoded whole.  ``literal`` makes them ordinary text.

Most of the time goes to words met for the first time.  For byte-level vocabularies ``encode_all`` takes
many texts at once, finds their words in arrays and merges the new ones side by side, with the merges of the tokenizer file in
the library's order (``Merges``); tests hold the ids equal to the library's.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import cached_property

import numpy as np

_LEAD = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]")
_TAIL = ".,;:!?*#$%&|<>()[]{}-_/"
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


#: Byte-level vocabularies write a byte as itself where it is printable, and the others in order from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def _kinds() -> np.ndarray:
    """For each byte: 0 space, 1 letter or part of one, 2 digit, 3 sign, 4 line feed, 5 any other."""
    out = np.full(256, 5, np.uint8)
    out[33:127] = 3
    out[[c for c in range(128) if chr(c).isalpha()]] = 1
    out[48:58], out[10], out[32], out[ord("'")] = 2, 4, 0, 5
    out[128:192], out[0xC3:0xCA] = 1, 1
    return out


_KINDS = _kinds()
#: Of 24 bytes, the first so many, as three numbers.
_MASKS = np.array([[255] * k + [0] * (24 - k) for k in range(24)] + [[0] * 24], np.uint8).view("<u8").astype(np.uint64)


class Merges:
    """The merges of a byte-level BPE, done for many words side by side, and a table of the words met.

    A round does one merge in each piece, the first of those of the lowest rank, as the library does.  Ranks and words lie
    in arrays with open addressing.  A word of up to 23 bytes is its own key, with its length, so none is taken for another."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict, dtype: np.dtype, bits: int = 21):
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.dtype = dtype
        self.first = np.array([vocab[chr(_BYTES[b])] for b in range(256)], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        self.bits = max(12, 2 + int(len(key)).bit_length())
        self.key, self.rank = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, self.NONE, np.int32)
        left, at = np.arange(len(key)), self.slot(key)
        while len(left):  # the last writer of a slot stays, the others go on to the next one
            free = self.rank[at] == self.NONE
            self.rank[at[free]] = left[free]
            put = self.rank[at] == left
            self.key[at[put]] = key[left[put]]
            left, at = left[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        self.held, self.slots, self.used = 0, 1 << bits, 0
        self.names, self.at, self.count = np.zeros((self.slots, 3), np.uint64), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.ids = np.zeros(1 << 16, dtype)

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b
        at = self.slot(key)
        found, out = self.key[at], self.rank[at]
        other = np.flatnonzero((found != key) & (out != self.NONE))
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            found, out[other] = self.key[at[other]], self.rank[at[other]]
            other = other[(found != key[other]) & (out[other] != self.NONE)]
        return out

    def merged(self, sym: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, given as symbols and the number of the piece of each, and the piece of each id."""
        rank = np.full(len(sym), self.NONE, np.int32)
        pair = np.flatnonzero(own[1:] == own[:-1])
        rank[pair] = self.ranks(sym[pair], sym[pair + 1])
        done = [(sym[:0], own[:0])]
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            least, sizes = np.minimum.reduceat(rank, starts), np.diff(starts, append=len(sym))
            over = least == self.NONE
            if over.any():  # nothing is left to merge there
                gone = np.repeat(over, sizes)
                done.append((sym[gone], own[gone]))
                sym, rank, own = sym[~gone], rank[~gone], own[~gone]
                if not len(sym):
                    break
                least, sizes = least[~over], sizes[~over]
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            whose = own[hits]
            at = hits[np.concatenate(([True], whose[1:] != whose[:-1]))]
            sym[at] = self.made[least]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol before each has gone
            sym, rank, own = sym[keep], rank[keep], own[keep]
            rank[at] = self.NONE
            for x in (at, at - 1):
                x = x[(x >= 0) & (x + 1 < len(sym))]
                x = x[own[x + 1] == own[x]]
                rank[x] = self.ranks(sym[x], sym[x + 1])
        sym, own = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(own, kind="stable")
        return sym[order], own[order]

    def looked(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, or else a free one, and whether it is there."""
        with np.errstate(over="ignore"):
            h = names[:, 0] * np.uint64(0x9E3779B97F4A7C15) + names[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + names[:, 2] * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        slot, there = (h >> np.uint64(32)).astype(np.int64) & (self.slots - 1), np.zeros(len(names), bool)
        left = np.arange(len(names))
        while len(left):
            at = slot[left]
            got, own = self.names.take(at, 0), names.take(left, 0) if len(left) < len(names) else names
            same = (got[:, 0] == own[:, 0]) & (got[:, 1] == own[:, 1]) & (got[:, 2] == own[:, 2])
            there[left[same]] = True
            left = left[~same & (self.count[at] > 0)]
            slot[left] = (slot[left] + 1) & (self.slots - 1)
        return slot, there

    def enter(self, names: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        while len(names):
            slot, there = self.looked(names)
            own = np.flatnonzero(~there)
            own = own[np.unique(slot[own], return_index=True)[1]]  # one word for each free slot
            self.names[slot[own]], self.at[slot[own]], self.count[slot[own]] = names[own], at[own], count[own]
            self.held += len(own)
            there[own] = True
            names, at, count = names[~there], at[~there], count[~there]

    def encode(self, texts: list[bytes], odd_ids: Callable[[bytes, bool], bytes]) -> list[bytes]:
        """The ids of texts that can be cut before each space.

        A word is what lies between spaces, with the space before it but for the first of a text.  One that is not of ASCII and Latin
        letters, digits, signs and line feeds inside goes to ``odd_ids`` with whether it is a first one; in the others a piece is a run
        of one kind of characters, with the space if that is before it."""
        raw = np.frombuffer(b"".join([b" ", b" ".join(texts), b" ", bytes(24)]), np.uint8)
        n = len(raw) - 25
        begin = np.flatnonzero(raw == 32)
        size = np.diff(begin) - 1
        words, begin = len(size), begin[:-1]
        head = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # the first word of each text
        names = np.lib.stride_tricks.sliding_window_view(raw, 24)[begin + 1].view("<u8") & _MASKS[np.minimum(size, 24)]
        names[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        slot, there = self.looked(names)
        there &= size < 24
        there[head[:-1]] = False
        at, count = np.where(there, self.at[slot], 0).astype(np.int64), np.where(there, self.count[slot], 0).astype(np.int64)
        new = np.flatnonzero(~there)
        # The bytes of the new words, each with its space, and a space behind them all.
        width = size[new] + 1
        off = np.cumsum(width) - width
        own = np.repeat(np.arange(len(new), dtype=np.int32), width)
        raw_new = np.append(raw[np.arange(int(width.sum())) + np.repeat(begin[new] - off, width)], np.uint8(32))
        kind = _KINDS[raw_new]
        wide = np.flatnonzero(raw_new > 127)
        if len(wide):
            c, before, after = raw_new[wide], raw_new[wide - 1], raw_new[wide + 1]
            part = (c < 192) & (before >= 0xC3) & (before <= 0xC9)
            lead = (c >= 0xC3) & (c <= 0xC9) & (after >= 128) & (after < 192) & ~((c == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((c == 0xC9) & (after > 0x8F))
            kind[wide[~(part | lead)]] = 5
        feed = np.flatnonzero(kind == 4)
        kind[feed[(raw_new[feed - 1] == 32) | (raw_new[feed + 1] == 10) | (raw_new[feed + 1] == 32)]] = 5
        first = np.isin(new, head[:-1], assume_unique=False)
        odd = (np.maximum.reduceat(kind, off) == 5) | (width > 200) | (width == 1) & ~first if len(new) else np.zeros(0, bool)
        start = np.concatenate(([True], (kind[1:-1] == 0) | (kind[1:-1] != kind[:-2]) & (kind[:-2] != 0)))
        keep = ~odd[own]
        keep[off[first]] = False
        piece = np.cumsum(start, dtype=np.int32) - 1
        sym, piece = self.merged(self.first[raw_new[:-1][keep]], piece[keep])
        made = np.bincount(own[np.flatnonzero(start)][piece], minlength=len(new)) if len(new) else np.zeros(0, np.int64)
        rest = [odd_ids(raw_new[off[i] + 1 : off[i] + width[i]].tobytes(), bool(first[i])) for i in np.flatnonzero(odd).tolist()]
        more = np.frombuffer(b"".join(rest), self.dtype)
        size_new = made.copy()
        size_new[odd] = [len(x) // self.dtype.itemsize for x in rest]
        if self.used + len(sym) + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(sym) + len(more), self.dtype)])
        here = self.used
        self.ids[here : here + len(sym)], self.ids[here + len(sym) : here + len(sym) + len(more)] = sym, more
        place = here + np.cumsum(made) - made
        place[odd] = here + len(sym) + np.cumsum(size_new[odd]) - size_new[odd]
        at[new], count[new] = place, size_new
        total = np.cumsum(count)
        out = self.ids[np.arange(int(total[-1])) + np.repeat(at - (total - count), count)].tobytes()
        if self.held + len(new) <= self.slots // 2:  # of new words beyond that none is kept: those met first are the frequent ones
            keep = ~odd & ~first & (width <= 24)
            self.enter(names[new[keep]], place[keep], made[keep].astype(np.int32))
            self.used += len(sym)
        ends = (np.concatenate(([0], total))[head] * self.dtype.itemsize).tolist()
        return [out[a:z] for a, z in zip(ends, ends[1:], strict=False)]


class PieceEncoder(dict):
    """Maps a piece (bytes) to its ids as little-endian bytes of ``width``."""

    def __init__(self, path: str, mode: str, width: int = 2, limit: int = 450_000, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = literal
        added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.mode, self.limit, self.spaced = mode, limit, Spaced(self)
        self.width = width if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 8 * width else 4
        # Where the tokenizer folds case itself, folding A-Z beforehand changes nothing and halves the table.
        self.folds = all(self.whole_ids(c.upper()) == self.whole_ids(c) for c in "abcdefghijklmnopqrstuvwxyz")
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        # A byte-level pre-tokenizer keeps a run of letters, with a space before it, as one token: its merges alone give the ids.
        byte_level = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None and not self.tok.pre_tokenizer.add_prefix_space
        named = any(t.content.strip().isalpha() for t in self.tok.get_added_tokens_decoder().values())
        self.merges = self.tok.model.tokenize if mode == "lead" and byte_level and self.tok.pre_tokenizer.use_regex and not named else None

    @cached_property
    def many(self) -> Merges | None:
        """The merges for many words at once, where the file has no more to them than their order."""
        if self.merges is None:
            return None
        model = json.loads(self.tok.to_str())["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return Merges(model, self.dtype) if plain and all(chr(c) in model["vocab"] for c in _BYTES.values()) else None

    def whole_ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def whole(self, text: bytes) -> bytes:
        return self.packed(self.whole_ids(text.decode("utf-8", "replace")))

    def packed(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def letters(self, word: bytes) -> bool:
        """Whether the merges alone encode the word: ASCII and Latin letters only."""
        if self.merges is None or len(word) > 200:
            return False
        if word.isalpha():  # of bytes: ASCII
            return True
        text = word.decode("utf-8", "replace")
        return text.isalpha() and max(text) < "\u0250"

    def merged(self, piece: bytes) -> bytes:
        return self.packed([t.id for t in self.merges(piece.decode("latin-1").translate(_BYTES))])

    def __missing__(self, piece: bytes) -> bytes:
        """A word and the ASCII punctuation behind it are separate tokens in both modes, so each has an entry of its own.

        Once the table is full no entry is added: the words met first are the frequent ones."""
        if len(piece) > 200:
            return self.whole(piece)
        if self.letters(piece):
            ids = self.merged(piece)
            if len(self) < self.limit:
                self[piece] = ids
            return ids
        parts = _LEAD.findall(piece) if self.mode == "lead" and not piece.isspace() else [piece]
        text = piece.decode("utf-8", "replace")
        head = text.rstrip(_TAIL)
        if len(parts) > 1:
            ids = b"".join(map(self.held, parts))
        elif head and len(head) < len(text) and (head[-1].isalpha() or head[-1] in "0123456789"):
            ids = self.held(head.encode()) + self[text[len(head) :].encode()]
        else:
            ids = self.whole(piece)
        if len(self) < self.limit and piece[:1] != b" ":
            self[piece] = ids
        return ids

    def encode_all(self, texts: list[bytes], block: int = 1 << 19) -> list[bytes]:
        """``encode`` of each text; those of some ``block`` bytes are taken at once."""
        if self.many is None:
            return [self.encode(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for k, text in enumerate(texts):
            if self.apart(text):
                held.append(k)
                size += len(text) + 1
            else:
                out[k] = self.encode(text)
            if held and (size >= block or k == len(texts) - 1):
                for i, ids in zip(held, self.many.encode([texts[i] for i in held], self.odd), strict=True):
                    out[i] = ids
                held, size = [], 0
        return out

    def odd(self, word: bytes, first: bool) -> bytes:
        return self[word] if first else self.spaced[word]

    def held(self, piece: bytes) -> bytes:
        """A piece from the table it belongs to."""
        return self.spaced[piece[1:]] if piece[:1] == b" " and len(piece) > 1 else self[piece]

    def apart(self, text: bytes) -> bool:
        """Whether a cut before each space is safe, where spaces lead."""
        if self.folds or self.added and self.added.search(text) or b"  " in text or text[-1:] == b" ":
            return False
        return text.isascii() or not _ODD.search(text.decode("utf-8", "replace"))

    def encode(self, text: bytes) -> bytes:
        if self.added and self.added.search(text):
            return self.whole(text)
        if self.folds:
            text = text.lower()
        if self.mode == "drop":
            return b"".join(map(self.__getitem__, text.split()))
        if not text.isascii() and _ODD.search(text.decode("utf-8", "replace")):
            return self.whole(text)
        if b"  " in text or text[-1:] == b" ":
            return b"".join(map(self.held, _LEAD.findall(text)))
        # Without double spaces a cut before each space is safe; what a piece holds beyond one word is cut when it is first met.
        first, *rest = text.split(b" ")
        return (self[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


class Spaced(dict):
    """Pieces by what follows their leading space."""

    def __init__(self, owner: PieceEncoder):
        self.owner = owner

    def __missing__(self, rest: bytes) -> bytes:
        ids = self.owner.merged(b" " + rest) if self.owner.letters(rest) else self.owner.__missing__(b" " + rest)
        if len(self) < self.owner.limit:
            self[rest] = ids
        return ids


_ENCODERS: dict = {}


def encoder(path: str, mode: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    if (path, mode) not in _ENCODERS:
        _ENCODERS[path, mode] = PieceEncoder(path, mode)
    return _ENCODERS[path, mode]
