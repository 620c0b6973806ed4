"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into stretches that no piece crosses (a run of
spaces and what follows it).  The stretches not met before are concatenated
and indexed by a suffix array, every piece of the vocabulary is looked up by
binary search, and each range of suffixes found gives the edges of that piece.
The edges are sorted by position and relaxed from left to right: an edge is
taken if its piece can follow the piece that ends where it starts, which in
byte-pair encoding holds for exactly one edge into each position (see
``bpe``).  Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Neighbours
from .common import Recent, map_text

SPACE = "▁"
INDEX_CHARS = 1 << 18
NUL = "\ud800"  # stands for a NUL inside a text, as 0 separates stretches; texts hold no surrogates


class SuffixArray:
    """Suffixes of a text of small codes, ordered by their first ``depth`` codes.

    ``codes`` are 1..top, 0 separates stretches.  The first codes of a suffix are
    packed into 64-bit words, so ordering compares a word at a time.
    """

    def __init__(self, codes: np.ndarray, depth: int, top: int):
        self.bits = next(b for b in (8, 16, 21) if top < 1 << b)
        self.per, self.depth = 64 // self.bits, depth
        words = -(-depth // self.per)
        padded = np.concatenate([codes, np.zeros(words * self.per, np.int64)]).astype(np.uint64)
        n = len(codes)
        keys = []
        for w in range(words):
            key = np.zeros(n, np.uint64)
            for i in range(w * self.per, (w + 1) * self.per):
                key = (key << np.uint64(self.bits)) | padded[i:i + n]
            keys.append(key)
        self.order = np.lexsort(keys[::-1])
        self.keys = [k[self.order] for k in keys]

    def ranges(self, pieces: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 rank of the suffixes that begin with each piece (codes, filled up with 0)."""
        def bounds(rows, level):
            part = pieces[rows, level * self.per:(level + 1) * self.per].astype(np.uint64)
            low = np.zeros(len(part), np.uint64)
            for i in range(self.per):
                low <<= np.uint64(self.bits)
                if i < part.shape[1]:
                    low |= part[:, i]
            free = np.maximum(0, (level + 1) * self.per - size[rows]) * self.bits
            return low, low | ((np.uint64(1) << free.astype(np.uint64)) - np.uint64(1))

        low, high = bounds(np.arange(len(pieces)), 0)
        lo, hi = np.searchsorted(self.keys[0], low, "left"), np.searchsorted(self.keys[0], high, "right")
        for level in range(1, len(self.keys)):
            rows = np.flatnonzero((hi > lo) & (size > level * self.per))
            low, high = bounds(rows, level)
            for i, a, b in zip(rows.tolist(), low, high):
                inside = self.keys[level][lo[i]:hi[i]]
                lo[i], hi[i] = lo[i] + inside.searchsorted(a, "left"), lo[i] + inside.searchsorted(b, "right")
        return lo, hi


class PieceCodec:
    """Encoder and decoder for a SentencePiece byte-pair model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a model with byte pieces is needed")
        if sp.normalize("ﬁ  é ") != f"{SPACE}ﬁ{SPACE}{SPACE}é{SPACE}":
            raise ValueError("a model that keeps texts as they are and adds a leading space is needed")
        score = {sp.id_to_piece(i): sp.get_score(i) for i in ids if i not in special and not sp.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in score):
            raise ValueError("pieces that cross a space are not supported")
        self.fits = Neighbours(list, lambda a, b: -score[a + b] if a + b in score else None).fit
        # Only pieces that merging can produce take part.
        self.pieces = sorted(p for p in score if self.fits("", p))
        self.id = {p: sp.piece_to_id(p) for p in self.pieces}
        self.size = np.array([len(x) for x in self.pieces])
        self.longest = int(self.size.max())
        self.chars = np.zeros((len(self.pieces), self.longest), np.int64)
        for row, piece in zip(self.chars, self.pieces):
            row[:len(piece)] = [ord(c) for c in piece]
        unknown = next((i for i in ids if sp.is_unknown(i)), None)
        self.raw = [b"" if sp.is_control(i) else " ⁇ ".encode() if i == unknown else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.memo = Recent(100_000)

    def stretches(self, text: str | None) -> list[str]:
        """Cut after normalisation; no piece crosses a cut."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in marked or marked[-1] == SPACE:
            return re.findall(f"{SPACE}+[^{SPACE}]*", marked)
        return [SPACE + x for x in marked[1:].split(SPACE)]

    def index(self, new: list[str]) -> list[bytes]:
        """Ids of stretches, some hundred thousand characters at a time (one stretch at least)."""
        part = np.cumsum([len(s) + 1 for s in new]) // INDEX_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(new)]
        return [raw for a, b in zip(cuts, cuts[1:]) for raw in self._encode(new[a:b])]

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(start, end, token) of all piece occurrences and of characters outside the vocabulary; the tokens' strings."""
        chars, codes = np.unique(text, return_inverse=True)  # code 0 is the separator
        array = SuffixArray(codes, self.longest, len(chars))
        at = np.minimum(np.searchsorted(chars, self.chars), len(chars) - 1)
        here = np.flatnonzero((chars[at] == self.chars).all(axis=1))
        lo, hi = array.ranges(at[here], self.size[here])
        n = hi - lo
        token = np.repeat(np.arange(len(here)), n)
        ranks = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        start = array.order[ranks]
        end = start + np.repeat(self.size[here], n)
        lone = np.array([chr(c) not in self.id for c in chars.tolist()])
        lone[0] = False
        alone = np.flatnonzero(lone[codes])
        token = np.concatenate([token, len(here) + codes[alone]])
        names = [self.pieces[i] for i in here.tolist()] + [chr(c) for c in chars.tolist()]
        return np.concatenate([start, alone]), np.concatenate([end, alone + 1]), token, names

    def _may_follow(self, before: np.ndarray, token: np.ndarray, names: list[str], begins: np.ndarray, n_pieces: int) -> np.ndarray:
        ok = begins | (before >= n_pieces) | (token >= n_pieces)  # nothing merges with a character outside the vocabulary
        ask = np.flatnonzero(~ok)
        if len(ask):
            pairs, at = np.unique(before[ask] * np.int64(len(names)) + token[ask], return_inverse=True)
            left, right = np.divmod(pairs, len(names))
            fits = self.fits
            ok[ask] = np.array([fits(names[a], names[b]) for a, b in zip(left.tolist(), right.tolist())], bool)[at]
        return ok

    def _encode(self, new: list[str]) -> list[bytes]:
        joined = "\0".join(s.replace("\0", NUL) for s in new) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start, end, token, names = self._edges(text)
        n_pieces = len(names) - len(np.unique(text))
        stops = np.flatnonzero(text == 0)
        first = np.concatenate([[0], stops[:-1] + 1])
        unit_first = np.repeat(first, stops - first + 1)
        depth = end - unit_first[start]
        deepest = int(depth.max(initial=0))
        by_depth = np.argsort(depth.astype(np.uint16) if deepest < 1 << 16 else depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, deepest + 2))
        last = np.full(len(text) + 1, -1, np.int64)
        back = np.zeros(len(text) + 1, np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            e = by_depth[lo:hi]
            s, t = start[e], token[e]
            begins = s == unit_first[s]
            ok = (begins | (last[s] >= 0))
            ok[ok] = self._may_follow(last[s[ok]], t[ok], names, begins[ok], n_pieces)
            good = e[ok]
            last[end[good]], back[end[good]] = token[good], start[good]
        # walk back from the end of every stretch
        unit, place = np.arange(len(new)), stops.copy()
        units, found = [], []
        live = place > first
        unit, place = unit[live], place[live]
        while len(unit):
            units.append(unit)
            found.append(last[place])
            place = back[place]
            live = place > first[unit]
            unit, place = unit[live], place[live]
        step = np.repeat(np.arange(len(units)), [len(u) for u in units])
        unit, token = np.concatenate(units), np.concatenate(found)
        order = np.lexsort((-step, unit))
        unit, token = unit[order], token[order]
        if (token < 0).any():
            raise ValueError("a position without a token: the model is not a byte-pair model")
        ids = [[self.id[p]] for p in names[:n_pieces]] + [[self.bytes[b] for b in ("\0" if c == NUL else c).encode("utf-8", "replace")] for c in names[n_pieces:]]
        lone = token >= n_pieces
        if lone.any():
            width = np.array([len(x) for x in ids])[token]
            flat = np.array([i for t in token.tolist() for i in ids[t]], "<u4")
            unit = np.repeat(unit, width)
        else:
            flat = np.array([x[0] for x in ids], "<u4")[token]
        cut = np.searchsorted(unit, np.arange(len(new) + 1)) * 4
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.stretches(t) for t in texts]
        get = self.memo.fill(itertools.chain.from_iterable(cut), self.index)
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``piece_ids`` of whole texts and ``decoded``, the text that the ids decode to.

    ``path`` names the model file on every machine.  A null text has null ids and
    decoded text, an empty one no ids.  Rows are independent: ties and repeated
    rows agree, and an empty table gives an empty result.
    """
    def make():
        c = codec(path)

        def work(texts):
            raw = c.encode(texts)
            ids = [None if t is None else np.frombuffer(r, "<u4").astype(np.int32) for t, r in zip(texts, raw)]
            return [pa.array(ids, pa.list_(pa.int32())),
                    pa.array([None if t is None else c.decode(r) for t, r in zip(texts, raw)], pa.string())]
        return work

    return map_text(docs, make, [("piece_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], text_col, keep)


def digests(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) and ``round_trip``."""
    def make():
        c = codec(path)

        def work(texts):
            raw = c.encode(texts)
            return [pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([c.decode(r) == (t or "") for t, r in zip(texts, raw)], pa.bool_())]
        return work

    return map_text(docs, make, [("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType())], text_col, keep)
