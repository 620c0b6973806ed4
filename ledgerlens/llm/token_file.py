"""Token ids in a compressed binary file: context mixing and range coding.

A segment has one model, learned from its ids and kept before them: order 0, the
frequencies of all ids, and orders 1 and 2, the id met most often after the same
one or two ids (order 2 by a hash of the two) with the share in which it came.
It is where every block begins.  A block learns from its own ids as it is read:
order 0 takes in their counts (brought up to date at doubling positions), orders
1 and 2 the id that came after the same one or two ids and how often it came
again, and how far each kind of guess is trusted follows how often it came true.
The three predictions are mixed into one distribution over the segment's ids,
and a range coder codes the id's share of it in one step.

Ids are cut into blocks, each coded and checksummed on its own; a block's first
ids have no context, and nothing learned in a block leaves it.  All blocks of a
segment move in lockstep, one id of each at a time, so a step is a few vector
operations however many blocks there are.
"""

from __future__ import annotations

import functools
import itertools
import json
import string
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, TEXT, id_ranges, map_text, range_of, shared_path, shuffle_partitions, text_slices, word_tokenizer

BLOCK = 8192
SEGMENT_IDS = 8_000_000
MAGIC = b"LTC3"

TOTAL_BITS = 24
GAIN = 128  # bits that a guess must save: it takes about 24 in the file
TOGETHER = 128 << 20  # bytes of counts of the blocks read in lockstep
STRETCHES = 1 << 20  # looked up together
SLOT_BITS, LEVELS, CLASSES = 12, 8, 32
# sixteenths of order 0 that a block's own counts have, by the position at which they were taken
OWN = {256: 1, 512: 2, 1024: 3, 2048: 4, 4096: 6}
U = np.uint64
WORD, LEAST = U(32), U(1 << 32)


def _best(context: np.ndarray, nxt: np.ndarray, contexts: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each context: the id (rank) met most often after it (the least of equal ones), how often, and how often the context is met."""
    small = contexts * kinds <= 1 << 32
    key = context.astype(np.uint32 if small else np.int64)
    key *= key.dtype.type(kinds)
    key += nxt.astype(key.dtype)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(at, append=len(key))
    of, x = np.divmod(key[at].astype(np.int64), kinds)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    most = np.maximum.reduceat(count * kinds + (kinds - 1 - x), first)
    guess, hits, met = np.zeros(contexts, np.int64), np.zeros(contexts, np.int64), np.zeros(contexts, np.int64)
    guess[of[first]], hits[of[first]], met[of[first]] = kinds - 1 - most % kinds, most // kinds, np.add.reduceat(count, first)
    return guess, hits, met


class Mixture:
    """A segment's model: what its blocks begin with, over the ranks of the segment's ids.

    Order 0 has ``order0_bits``, at least one count for each id.  The context of a rank is rank + 1, and 0 where the block begins.
    """

    def __init__(self, ids: np.ndarray, weights: np.ndarray, guess1: np.ndarray, trust1: np.ndarray, guess2: np.ndarray, trust2: np.ndarray):
        self.ids, self.weights = ids.astype(np.int64), weights
        self.cum = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        self.order0_bits = int(self.cum[-1]).bit_length() - 1
        self.guess1, self.trust1, self.guess2, self.trust2 = (v.astype(np.int64) for v in (guess1, trust1, guess2, trust2))
        self.slot1, self.slot2 = self._slots(len(ids) + 1, len(guess2))

    @staticmethod
    def _slots(contexts: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
        c = np.arange(contexts, dtype=np.int64)
        return (c * 0x9E3779B1 >> 9) & slots - 1, (c * 0x85EBCA6B >> 9) & slots - 1

    @classmethod
    def learn(cls, ids: np.ndarray, ranks: np.ndarray, size: np.ndarray) -> Mixture:
        """From the ids met, in order, and blocks of their ranks as rows."""
        kinds, n = len(ids), int(size.sum())
        x = ranks.reshape(-1)[:n]
        met = np.bincount(x, minlength=kinds)
        bits = max(18, min(kinds.bit_length() + 2, TOTAL_BITS - 2 if kinds <= 1 << TOTAL_BITS - 2 else TOTAL_BITS - 1))
        if kinds > 1 << bits:
            raise ValueError("too many different ids in a segment")
        cum = np.arange(kinds + 1) + np.concatenate([[0], np.cumsum(met)]) * ((1 << bits) - kinds) // n
        weights = np.diff(cum)
        share = weights / (1 << bits)
        a = np.zeros(ranks.shape, np.int32)
        a[:, 1:] = ranks[:, :-1] + 1
        guess1, trust1 = cls._trusted(share, *_best(a.reshape(-1)[:n], x, kinds + 1, kinds))
        slots = 1 << min(16, max(4, n.bit_length() - 7))
        slot1, slot2 = cls._slots(kinds + 1, slots)
        key = slot1.astype(np.int32)[a]
        key[:, 1:] ^= slot2.astype(np.int32)[a[:, :-1]]
        guess2, trust2 = cls._trusted(share, *_best(key.reshape(-1)[:n], x, slots, kinds))
        return cls(ids, weights, guess1, trust1, guess2, trust2)

    @staticmethod
    def _trusted(share: np.ndarray, guess: np.ndarray, hits: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Guesses and how far (of 256) each is trusted beyond order 0; 0 where it would not pay for its place."""
        p = share[guess]
        trust = np.clip(256 * (hits / np.maximum(met, 1) - p) / np.maximum(1 - p, 1e-9), 0, 255).astype(np.int64)
        w = trust / 256
        gain = hits * np.log2((w + (1 - w) * p) / p) + (met - hits) * np.log2(1 - w)
        trust = np.where(gain > GAIN, trust, 0)
        return np.where(trust > 0, guess, 0), trust

    def pack(self) -> bytes:
        parts = [np.diff(self.ids, prepend=0).astype("<u4"), self.weights.astype("<u4"), self.guess1.astype("<u4"), self.trust1.astype("u1"),
                 self.guess2.astype("<u4"), self.trust2.astype("u1")]
        # bytes of equal weight together, which deflate takes better
        planes = [p.view("u1").reshape(len(p), -1).T.tobytes() for p in parts]
        return zlib.compress(struct.pack("<II", len(self.ids), len(self.guess2)) + b"".join(planes))

    @classmethod
    def unpack(cls, data: bytes) -> Mixture:
        raw = zlib.decompress(data)
        kinds, slots = struct.unpack_from("<II", raw)
        at, parts = 8, []
        for n, width in ((kinds, 4), (kinds, 4), (kinds + 1, 4), (kinds + 1, 1), (slots, 4), (slots, 1)):
            plane = np.frombuffer(raw, "u1", n * width, at).reshape(width, n)
            parts.append(np.ascontiguousarray(plane.T).view("<u4" if width == 4 else "u1").reshape(-1))
            at += n * width
        parts[0] = np.cumsum(parts[0], dtype=np.int64)
        return cls(*parts)

    @functools.cached_property
    def owner(self) -> np.ndarray:
        """The rank that holds each count of order 0."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint16 if len(self.ids) <= 1 << 16 else np.int32), self.weights.astype(np.int64))


class Contexts:
    """Guesses of orders 1 and 2 (a row each): in each block the id that came after a context there, beside the segment's guess."""

    START = (9000, 16000, 24000, 32000, 40000, 47000, 53000, 58000)  # trust of 65536 in an id that came so often again
    RATES = np.array([5, 6]).reshape(2, 1, 1)

    def __init__(self, lanes: int, model: Mixture):
        kind = np.concatenate([model.trust1, model.trust2]) * CLASSES >> 8
        self.said = np.concatenate([model.guess1, model.guess2]) << 5 | kind
        # in a slot: the context's tag, the rank and, below, three bits of how often it came again
        self.slots = np.zeros(2 * lanes << SLOT_BITS, np.int64)
        # trust in a block's own guesses by how often they came, and in the segment's by its trust
        every = 2 * np.arange(CLASSES) + (np.arange(CLASSES) > 0)
        self.trust = np.concatenate([np.tile(self.START, 2 * lanes), np.tile(every * (32768 // CLASSES), 2 * lanes)])
        each = np.arange(2 * lanes).reshape(2, lanes)
        self.first, self.cells = each << SLOT_BITS, np.stack([each * LEVELS, 2 * lanes * LEVELS + each * CLASSES])

    def look(self, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The guesses trusted most and how far, for the contexts' hashes and their places among the segment's guesses."""
        n = key.shape[1]
        self.tag = (key >> SLOT_BITS & 0xFFFF) + 1
        self.tag <<= 40
        self.at = key & (1 << SLOT_BITS) - 1
        self.at += self.first[:, :n]
        found = self.slots.take(self.at)
        found ^= self.tag
        self.known = found < 1 << 40
        said = self.said.take(place)
        self.cell, self.guess = np.empty((2, 2, n), np.int64), np.empty((2, 2, n), np.int64)
        self.level = np.bitwise_and(found, LEVELS - 1, out=self.cell[0]).copy()
        np.bitwise_and(said, CLASSES - 1, out=self.cell[1])
        self.cell += self.cells[:, :, :n]
        np.right_shift(found, 3, out=self.guess[0])
        np.right_shift(said, 5, out=self.guess[1])
        self.now = self.trust.take(self.cell)
        own = self.now[0] * self.known
        return np.where(own > self.now[1], self.guess[0], self.guess[1]), np.maximum(own, self.now[1])

    def learn(self, x: np.ndarray) -> None:
        hits = self.guess == x
        step = hits * 65000
        step -= self.now
        step >>= self.RATES
        step[0] *= self.known
        step += self.now
        self.trust[self.cell] = step
        hit = hits[0] & self.known
        stays = self.known & (self.level > 1)
        stays |= hit
        level = np.where(hit, np.minimum(self.level + 1, LEVELS - 1), self.level >> 1)
        level *= stays
        level |= self.tag
        level |= np.where(stays, self.guess[0], x) << 3
        self.slots[self.at] = level


class Blocks:
    """The mixed distributions of the next id of blocks read in lockstep, as counts of 2**24, and what the blocks have learned."""

    def __init__(self, model: Mixture, lanes: int, block: int):
        self.model, self.lanes, self.kinds = model, lanes, len(model.ids)
        self.contexts, self.second = Contexts(lanes, model), len(model.guess1)
        self.ids = np.zeros((block, lanes), np.int32)
        self.bits = model.order0_bits + 4
        self.free = (1 << TOTAL_BITS) - (2 << model.order0_bits)  # an id has a count of what is left, whatever the guesses weigh
        self.taken, self.rest = 0, 16
        self.a, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def renew(self, t: int) -> None:
        """Order 0 takes in the ids so far: of its 16 parts ``rest`` stay the segment's, and each id so far has ``unit`` counts."""
        self.taken, self.rest = t, 16 - OWN[t]
        self.unit = (1 << self.model.order0_bits) // t * OWN[t]
        seen = np.sort(self.ids[:t].T, axis=1)
        if not hasattr(self, "below"):
            self.below = np.zeros((self.lanes, self.kinds + 1), np.uint16)
            self.row = np.arange(self.lanes) * (self.kinds + 1)
        for row, ranks in zip(self.below, seen):
            np.cumsum(np.bincount(ranks, minlength=self.kinds), out=row[1:])
        self.seen, self.place = seen.reshape(-1), np.arange(self.lanes) * t
        begins = self.model.cum.take(seen)
        begins *= self.rest
        begins += np.arange(t) * self.unit
        # of ``t`` equal ranges of counts, how many ids begin before each; ids are ``unit`` apart at least, so few begin in one
        self.shift = self.bits - (t.bit_length() - 1)
        met = np.bincount(((begins >> self.shift) + self.place[:, None]).reshape(-1), minlength=self.lanes * t)
        self.start = np.cumsum(met) - met - np.repeat(self.place, t)
        self.begins, self.begin_at = np.pad(begins, ((0, 0), (0, 16)), constant_values=np.iinfo(np.int64).max).reshape(-1), np.arange(self.lanes) * (t + 16)

    def counts(self, x: np.ndarray) -> np.ndarray:
        """How many of order 0's counts lie below each block's rank ``x``."""
        c = self.model.cum.take(x)
        c *= self.rest
        if self.taken:
            c += self.below.reshape(-1).take(self.row[:x.shape[-1]] + x) * np.int64(self.unit)
        return c

    def owner(self, c: np.ndarray) -> np.ndarray:
        """The rank that holds the order-0 count ``c`` of each block."""
        if not self.taken:
            return self.model.owner.take(c >> 4, mode="clip").astype(np.int64)
        # the last id so far, in order, that begins at or below c
        c = np.clip(c, 0, (1 << self.bits) - 1)  # where a guess is found, c means nothing
        first, begin_at = self.place[:len(c)], self.begin_at[:len(c)]
        at = self.start.take(first + (c >> self.shift))
        most = -(-16 // OWN[self.taken])
        while most:
            span = most + 1 >> 1
            at += span * (self.begins.take(begin_at + (at + (span - 1))) <= c)
            most -= span
        x = self.seen.take(first + np.maximum(at - 1, 0)).astype(np.int64)
        end = self.model.cum.take(x + 1) * self.rest + at * self.unit
        other = self.model.owner.take((c - at * self.unit) // self.rest, mode="clip")
        return np.where((at > 0) & (c < end), x, other)

    def look(self, t: int, live: int) -> None:
        """Both guesses, what they weigh and what is left to order 0."""
        if t in OWN:
            self.renew(t)
        if live < len(self.a):
            self.a, self.before = self.a[:live], self.before[:live]
        model, a = self.model, self.a
        key, place = np.empty((2, live), np.int64), np.empty((2, live), np.int64)
        np.right_shift(a * 0x9E3779B1, 5, out=key[0])
        np.bitwise_xor(key[0], self.before * 0x85EBCA6B >> 5, out=key[1])
        place[0] = a
        np.bitwise_xor(model.slot1.take(a), model.slot2.take(self.before), out=place[1])
        place[1] += self.second
        g, w = self.contexts.look(key, place)
        w[1] *= self.free
        w[1] >>= 16
        w[0] *= self.free - w[1]
        w[0] >>= 16
        w[0] *= (g[0] != g[1]) | (w[1] == 0)  # one guess is not counted twice
        self.g, self.w, self.w0 = g, w, (1 << TOTAL_BITS) - w[0] - w[1]

    def share(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of ``x`` begins and how wide it is."""
        both = np.empty((2, len(x)), np.int64)
        both[0] = x
        np.add(x, 1, out=both[1])
        both = self.counts(both)
        both *= self.w0
        both >>= self.bits
        begin, width = both
        width -= begin
        for some, of in ((self.w * (self.g < x), begin), (self.w * (self.g == x), width)):
            of += some[0]
            of += some[1]
        return begin, width

    def find(self, slot: np.ndarray) -> np.ndarray:
        """The rank whose share holds ``slot``: order 0 decides, once the guesses' weights before the slot are taken off."""
        g, w = self.g, self.w
        end = self.counts(g + 1)  # of the guesses' shares, which their weights close
        end *= self.w0
        end >>= self.bits
        end += w
        below = g[1] < g[0]  # of equal guesses one has no weight
        end[0] += w[1] * below
        end[1] += w[0] * ~below
        past = w * (slot >= end)
        end -= slot
        inside = (end > 0) & (end <= w)
        rest = slot - past[0]
        rest -= past[1]
        # the least order-0 count whose scaled value exceeds the rest is one past the wanted one;
        # below 2**51 over below 2**25 the quotient of doubles, cut, is that of integers
        rest += 1
        rest <<= self.bits
        rest -= 1
        x = self.owner((rest / self.w0).astype(np.int64))
        np.copyto(x, g[0], where=inside[0])
        np.copyto(x, g[1], where=inside[1])
        return x

    def learn(self, t: int, x: np.ndarray) -> None:
        self.contexts.learn(x)
        self.ids[t, :len(x)] = x
        self.before, self.a = self.a, x + 1


def _lanes(ranks: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks as rows and their lengths: the last may be short, the others are full."""
    n = -(-len(ranks) // block)
    out = np.zeros((n, block), np.int32)
    out.reshape(-1)[:len(ranks)] = ranks
    size = np.full(n, block)
    if n:
        size[-1] = len(ranks) - (n - 1) * block
    return out, size


def encode_blocks(ids: np.ndarray, vocab: int, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """The model of the ids (values below ``vocab``), and each block of them coded on its own."""
    ids = np.asarray(ids)
    if not len(ids):
        return b"", []
    if int(ids.max()) >= vocab:
        raise ValueError("an id is not in the vocabulary")
    met = np.bincount(ids, minlength=vocab) > 0
    x, size = _lanes((np.cumsum(met, dtype=np.int32) - 1)[ids], block)
    model = Mixture.learn(np.flatnonzero(met), x, size)
    group = _together(model)
    return model.pack(), [c for i in range(0, len(x), group) for c in _encode(model, x[i:i + group], size[i:i + group])]


def _together(model: Mixture) -> int:
    return max(1, TOGETHER // (2 * len(model.ids) + 2))


def _encode(model: Mixture, x: np.ndarray, size: np.ndarray) -> list[bytes]:
    n, last = len(x), int(size[-1])
    low, span = np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    longest = int(size[0])
    words, at = np.zeros((n, longest + 2), U), np.zeros(n, np.int64)  # a step gives one word at most
    blocks = Blocks(model, n, longest)
    for t in range(longest):
        live = n if t < last else n - 1
        blocks.look(t, live)
        rank = x[:live, t].astype(np.int64)
        begin, width = (v.view(U) for v in blocks.share(rank))
        blocks.learn(t, rank)
        lo, sp = low[:live], span[:live]
        unit = sp >> U(TOTAL_BITS)
        add = begin * unit
        lo += add
        np.multiply(width, unit, out=sp)
        over = np.flatnonzero(lo < add)
        if len(over):  # the sum ran over: one more in the word before
            words[over, at[over] - 1] += U(1)
        out = np.flatnonzero(sp < LEAST)
        if len(out):
            settled = lo[out]
            words[out, at[out]] = settled >> WORD
            at[out] += 1
            lo[out] = settled << WORD
            sp[out] <<= WORD
    # the word that begins next lies in the span, and zeros follow it
    end = low + (LEAST - U(1))
    over = np.flatnonzero(end < low)
    words[over, at[over] - 1] += U(1)
    words[np.arange(n), at] = end >> WORD
    at += 1
    over = words >> WORD
    while over.any():
        words &= LEAST - U(1)
        words[:, :-1] += over[:, 1:]
        over = words >> WORD
    raw = words.astype("<u4")
    return [r[:k].tobytes() for r, k in zip(raw, at.tolist())]


def decode_blocks(model: Mixture, coded: list[bytes], size: np.ndarray) -> np.ndarray:
    """Ids of blocks coded by ``encode_blocks``; all but the last are full."""
    group = _together(model)
    return model.ids.take(np.concatenate([_decode(model, coded[i:i + group], size[i:i + group]) for i in range(0, len(coded), group)]))


def _decode(model: Mixture, coded: list[bytes], size: np.ndarray) -> np.ndarray:
    n, longest, last = len(coded), int(size[0]), int(size[-1])
    most = max(len(c) // 4 for c in coded) + 3  # zeros follow a block
    words = np.zeros((n, most), "<u4")
    for row, c in zip(words, coded):
        row[:len(c) // 4] = np.frombuffer(c, "<u4", len(c) // 4)
    code = words[:, 0].astype(U) << WORD | words[:, 1].astype(U)
    words, at = words.reshape(-1), np.arange(n) * most + 2
    ends = np.arange(1, n + 1) * most - 1
    span = np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    blocks = Blocks(model, n, longest)
    for t in range(longest):
        live = n if t < last else n - 1
        blocks.look(t, live)
        co, sp = code[:live], span[:live]
        unit = sp >> U(TOTAL_BITS)
        slot = np.minimum(co // unit, U((1 << TOTAL_BITS) - 1)).view(np.int64)
        x = blocks.find(slot)
        begin, width = blocks.share(x)
        blocks.learn(t, x)
        co -= begin.view(U) * unit
        np.multiply(width.view(U), unit, out=sp)
        need = np.flatnonzero(sp < LEAST)
        if len(need):
            co[need] = co[need] << WORD | words.take(np.minimum(at[need], ends[need])).astype(U)
            at[need] += 1
            sp[need] <<= WORD
    return blocks.ids.T.reshape(-1)[:int(size.sum())]


def pack(ids: np.ndarray, vocab: int, block: int = BLOCK) -> bytes:
    """One segment: magic, vocabulary, block size, ids, model length; length and CRC-32 of every block; the model; then the blocks."""
    model, blocks = encode_blocks(ids, vocab, block)
    raw = np.asarray(ids, "<u4").tobytes()
    head = [struct.pack("<4sIIQI", MAGIC, vocab, block, len(ids), len(model))]
    head += [struct.pack("<II", len(c), zlib.crc32(raw[4 * i * block:4 * (i + 1) * block])) for i, c in enumerate(blocks)]
    return b"".join([*head, model, *blocks])


def unpack(data: bytes) -> np.ndarray:
    """Ids of a segment; raises ValueError if it is cut short, its model does not unpack or a block fails its checksum."""
    try:
        magic, vocab, block, n, model_size = struct.unpack_from("<4sIIQI", data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at, count = 24, -(-n // block)
        table = [struct.unpack_from("<II", data, at + 8 * i) for i in range(count)]
    except struct.error:
        raise ValueError("segment cut short") from None
    at += 8 * count
    packed, at = data[at:at + model_size], at + model_size
    coded = []
    for size, _ in table:
        coded.append(data[at:at + size])
        at += size
    if at != len(data):
        raise ValueError("segment cut short")
    if not count:
        return np.zeros(0, np.int64)
    try:
        model = Mixture.unpack(packed)
    except zlib.error:
        raise ValueError("the model fails its checksum") from None
    size = np.full(count, block)
    size[-1] = n - (count - 1) * block
    ids = decode_blocks(model, coded, size)
    raw = ids.astype("<u4").tobytes()
    for i, (_, crc) in enumerate(table):
        if zlib.crc32(raw[4 * i * block:4 * (i + 1) * block]) != crc:
            raise ValueError(f"block {i} fails its checksum")
    return ids


def _pieces(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, one after the other."""
    done = np.cumsum(size)
    return pool[np.repeat(start - done + size, size) + np.arange(done[-1] if len(done) else 0)]


class Met:
    """Ids of the stretches met lately, as arrays, so that many are looked up together.

    Beyond ``limit`` stretches or ``max_bytes`` of them, those met again since the last time stay, at most half as many.
    """

    def __init__(self, limit: int = 400_000, max_bytes: int = 32 << 20):
        self.limit, self.max_bytes = limit, max_bytes
        self._set(pa.array([], pa.large_binary()), np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _set(self, names: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.names, self.ids, self.size, self.start = names, ids, size, np.cumsum(size) - size
        self.again = np.zeros(len(names), bool)

    def _full(self) -> bool:
        return len(self.names) > self.limit or self.names.nbytes > self.max_bytes

    def _thin(self) -> None:
        stay = np.flatnonzero(self.again)[:self.limit // 2]
        self._set(self.names.take(pa.array(stay)), _pieces(self.ids, self.start[stay], self.size[stay]), self.size[stay])
        if self._full():
            self.__init__(self.limit, self.max_bytes)

    def look(self, stretches: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` of distinct stretches and their numbers of ids.

        ``make`` gives the order in which it took new ones, their ids in that order and the numbers of these.
        """
        if self._full():
            self._thin()
        at = pc.fill_null(pc.index_in(stretches, value_set=self.names), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(new):
            again, known = self.again, len(self.names)
            order, ids, size = make(stretches.take(pa.array(new)))
            new = new[order]
            self._set(pa.concat_arrays([self.names, stretches.take(pa.array(new))]), np.concatenate([self.ids, ids]), np.concatenate([self.size, size]))
            self.again[:known] = again
            at[new] = known + np.arange(len(new))
        return self.start[at], self.size[at]


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The library drops white space and never joins what it separates, so texts
    are cut at ASCII white space and each stretch not met lately goes through the
    library once.  Where the vocabulary's own rules lower letters and part them
    from marks, stretches that differ in ASCII capitals or in the ASCII marks
    at their end share the ids of what they have in common.
    """

    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        self.tok = word_tokenizer(path)
        self.vocab = self.tok.get_vocab_size()
        self.met = Met()
        added = self.tok.get_added_tokens_decoder()
        self.mark_id, self.mark = max((i, t.content) for i, t in added.items() if t.special)
        spec = json.loads(self.tok.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.folds = ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in cuts] == ["Split", "ByteLevel"]
                      and cuts[0]["pattern"] == {"Regex": self.WORDS} and spec["model"].get("end_of_word_suffix") == "</w>"
                      and all(t.content.startswith("<|") and not t.normalized for t in added.values()))
        self.is_word = np.isin(np.arange(256), list(string.ascii_letters.encode() + string.digits.encode()))
        self.last = np.zeros(self.vocab, bool)  # ids that end a word
        self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.plain = self.tok
        if self.folds:  # for words of small ASCII letters, which the vocabulary's own rules leave as they are
            self.plain = type(self.tok).from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        probe = "It's  a\ttest\n of\x0bcuts ."
        if self.encode([probe]) != [self._ids(probe).tobytes()]:
            raise ValueError("a vocabulary that drops white space is needed")

    def _new(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order in which stretches were taken, their ids and the numbers of these.

        Many go to a call: those of letters alone, where each is one word, or else parted by a special string, which joins nothing.
        """
        text, kind = stretches.cast(pa.large_string()), np.full(len(stretches), 2)
        if self.folds:
            kind[pc.and_not(pc.utf8_is_alpha(text), pc.string_is_ascii(text)).to_numpy(zero_copy_only=False)] = 1
            kind[pc.and_(pc.ascii_is_alpha(text), pc.ascii_is_lower(text)).to_numpy(zero_copy_only=False)] = 0
        order, ids, size = [], [], []
        for which, tok in enumerate((self.plain, self.tok)):
            words = np.flatnonzero(kind == which)
            for at in range(0, len(words), 1000):
                part = words[at:at + 1000]
                found = self._ids(" ".join(text.take(pa.array(part)).to_pylist()), tok)
                ends = np.flatnonzero(self.last[found]) + 1
                if len(ends) != len(part):  # some letter became more than a letter
                    kind[part] = 2
                    continue
                order.append(part)
                ids.append(found)
                size.append(np.diff(ends, prepend=0))
        rest = np.flatnonzero(kind == 2)
        names = text.take(pa.array(rest)).to_pylist()
        marked = np.array([self.mark in s for s in names], bool)
        for i in np.flatnonzero(marked).tolist():
            order.append(rest[i:i + 1])
            ids.append(self._ids(names[i]))
            size.append(np.array([len(ids[-1])]))
        plain = np.flatnonzero(~marked)
        for at in range(0, len(plain), 1000):
            part = plain[at:at + 1000]
            found = self._ids(self.mark.join(["", *(names[i] for i in part.tolist())]))
            cuts = np.flatnonzero(found == self.mark_id)
            if len(cuts) != len(part):
                raise ValueError("special strings do not part stretches")
            order.append(rest[part])
            ids.append(found[found != self.mark_id])
            size.append(np.diff(cuts, append=len(found)) - 1)
        return np.concatenate(order), np.concatenate(ids), np.concatenate(size)

    def _ids(self, text: str, tok=None) -> np.ndarray:
        return np.array((tok or self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _parted(self, stretches: pa.Array) -> pa.Array:
        """Each stretch without ASCII capitals, as two: up to the marks at its end, and these (empty where it has none)."""
        special = pc.match_substring(stretches, "<|")
        # lowered by itself, a letter before a combining mark may compose where its capital does not
        low = pc.if_else(pc.and_not(pc.string_is_ascii(stretches), special), pc.ascii_lower(stretches), stretches)
        size = pc.binary_length(pc.ascii_rtrim(low, characters=string.punctuation)).to_numpy()
        _, at, data = low.buffers()
        at = np.frombuffer(at, np.int64)[low.offset:low.offset + len(low) + 1]
        # marks that follow a mark beyond ASCII are of one run with it
        cut = at[:-1] + size
        parts = np.flatnonzero((size > 0) & ~special.to_numpy(zero_copy_only=False))
        parts = parts[self.is_word[np.frombuffer(data or b"", np.uint8)[cut[parts] - 1]]]
        both = np.empty(2 * len(low) + 1, np.int64)
        both[:-1:2], both[1::2], both[-1] = at[:-1], at[1:], at[-1]
        both[2 * parts + 1] = cut[parts]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(low), [None, pa.py_buffer(both), data])

    def encode(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """Ids of each text, and ``end`` after them; a stretch that comes often in the texts is looked up once."""
        split = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.large_string()), ""))
        first, stretches = split.offsets.to_numpy(), split.flatten()
        ids, counts = [], [np.zeros(1, np.int64)]
        for at in range(0, len(stretches), STRETCHES):
            some = stretches.slice(at, STRETCHES)
            coded = (self._parted(some) if self.folds else some.cast(pa.large_binary())).dictionary_encode()
            start, size = (v[coded.indices.to_numpy()] for v in self.met.look(coded.dictionary, self._new))
            ids.append(_pieces(self.met.ids, start, size).tobytes())
            counts.append(np.cumsum(size)[1::2] + counts[-1][-1] if self.folds else np.cumsum(size) + counts[-1][-1])
        raw, ends = memoryview(b"".join(ids)), np.concatenate(counts)[first] * 4
        return [bytes(raw[a:z]) + end for a, z in itertools.pairwise(ends.tolist())]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenize(docs: DataFrame, path: str, end_id: int | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids``, little-endian unsigned 32-bit integers, closed by ``end_id`` if given."""
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def make():
        e = encoder(path)
        return lambda texts: [pa.array(e.encode(texts, end), pa.binary())]

    return map_text(docs, make, [("ids", T.BinaryType())], text_col, keep, 2 * SLICE_BYTES)


def write_tokens(docs: DataFrame, path: str, to: str, end_id: int, text_col: str = "text", id_col: str = "doc_id",
                 block: int = BLOCK, segment_ids: int = SEGMENT_IDS) -> None:
    """Tokenize whole texts and write their ids in ascending id order (null ids last, equal ids by their tokens).

    Partitions are ranges of ids and hold segments of whole documents; a row of
    the table is one segment: (part, segment, doc_ids, lengths, n_ids, data).
    """
    bounds = id_ranges(docs, id_col, shuffle_partitions(docs.sparkSession))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    dealt = tokenize(src, path, end_id, "text", ["id"]).withColumn("part", range_of(F.col("id"), bounds))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(
        "part", F.col("id").asc_nulls_last(), "ids").select("part", "id", F.col("ids").alias(TEXT))
    schema = "part int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, data binary"

    def run(batches):
        vocab, held, segment, size, part = encoder(path).vocab, [], 0, 0, None

        def flush():
            ids = np.frombuffer(b"".join(r for _, r in held), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                 pa.array([[len(r) // 4 for _, r in held]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                 pa.array([pack(ids, vocab, block)], pa.binary())], names=["part", "segment", "doc_ids", "lengths", "n_ids", "data"])

        for b in (s for batch in batches for s in text_slices([batch], TEXT)):
            for p, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held and (p != part or size >= segment_ids):
                    yield flush()
                    held, segment, size = [], segment + 1 if p == part else 0, 0
                held.append((doc, raw))
                part, size = p, size + len(raw) // 4
        if held:
            yield flush()

    dealt.mapInArrow(run, schema).write.option("compression", "none").parquet(to)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of a token file: (part, segment, place, doc_id, offset in the segment, n_tokens, ids_crc32[, ids])."""
    schema = "part int, segment int, place int, doc_id long, `offset` long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part, segment, docs, lengths, data = (b.column(c)[i].as_py() for c in range(5))
                ids = unpack(data)
                ends = np.cumsum(lengths).astype(np.int64)
                raw, starts = memoryview(ids.astype("<u4").tobytes()), ends - lengths
                out = [pa.array(np.full(len(docs), part, np.int32)), pa.array(np.full(len(docs), segment, np.int32)),
                       pa.array(np.arange(len(docs), dtype=np.int32)), pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths, pa.int64()),
                       pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(starts.tolist(), ends.tolist())], pa.int64())]
                if keep_ids:
                    out.append(pa.array([ids[a:z] for a, z in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["part", "segment", "place", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"][:len(out)])

    return spark.read.parquet(path).select("part", "segment", "doc_ids", "lengths", "data").mapInArrow(run, schema)


def token_index(docs: DataFrame, path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id",
                to: str | None = None, block: int = BLOCK, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the token file (to the shared folder, unless ``to`` names a place), read it back and index its documents.

    Returns (doc_id, start, n_tokens, ids_crc32) in the file's terms: ``start``
    counts the ids of all documents before.  A null or empty text has the end id
    only.  One row out for each row in, repeated rows included; an empty table
    gives an empty file and an empty result.
    """
    spark = docs.sparkSession
    to = to or shared_path(spark, "tokens")
    write_tokens(docs, path, to, end_id, text_col, id_col, block, segment_ids)
    segments = spark.read.parquet(to).select("part", "segment", "n_ids")
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each partition: as many as the shuffle has
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    first = segments.withColumn("inside", F.sum("n_ids").over(within)).join(before, "part").select(
        "part", "segment", (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("first"))
    found = read_tokens(spark, to).join(first, ["part", "segment"])
    return found.select(F.col("doc_id").alias(id_col), (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
