"""Token counts by a compiled finite-state tokenizer.

Each word is read by a deterministic transducer whose transitions carry the
number of tokens they emit.  A state is what later bytes can still depend on:
the longest suffix that begins some token, and for each place in it where such
a token may start, the last token before that place and the tokens counted
since.  States and transitions are compiled when first reached.

A text is read in chunks.  What a chunk does to any incoming state is a map of
three parts: the bytes up to its first white space, which continue the word
under way, the tokens of the words inside, and the bytes after its last white
space.  Such maps compose associatively, so the chunks of a text are counted
apart and combined by a prefix scan.
"""

from __future__ import annotations

import functools
import itertools
import json
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Neighbours
from .common import Recent, map_text, word_tokenizer

CHUNK = 1 << 20
STATES = 300_000
END = "</w>"
SPACE = b" \t\n\r\x0b\x0c"


def byte_letters() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, itertools.count(256)
    for b in range(256):
        table[b] = chr(b) if b in plain else chr(next(extra))
    return table


class WordTransducer:
    """Deterministic transducer from the bytes of one pre-token to its number of tokens.

    A state's table maps a byte to the next state and the tokens that transition
    emits (a later byte can undo tokens, so an emission may be negative); a last
    byte has an emission of its own, as it carries the word end.
    """

    def __init__(self, vocab: dict[str, int], merges: list, max_states: int = STATES):
        self.letters, self.vocab, self.max_states = byte_letters(), vocab, max_states
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        ranks = {p: i for i, p in enumerate(pairs)}
        self.fits = Neighbours(self._symbols, lambda a, b: ranks.get((a, b))).fit
        # What some token properly begins with; a word end is one symbol with its byte.
        self.begins = {"".join(s[:i]) for s in map(self._symbols, vocab) for i in range(1, len(s))}
        self.reset()

    @staticmethod
    def _symbols(token: str) -> list[str]:
        return [*token[:-len(END) - 1], token[-len(END) - 1:]] if token.endswith(END) and len(token) > len(END) else list(token)

    def reset(self) -> None:
        self.index: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.last: list[dict[int, int]] = []
        self.start = self._state((("", "", 0),))

    def _state(self, key: tuple) -> int:
        found = self.index.get(key)
        if found is None:
            found = self.index[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.last.append({})
        return found

    def _emit(self, places: tuple, symbol: str) -> tuple[int, str]:
        """Tokens that reading ``symbol`` adds, and the last token then: the one that fits the token before it."""
        for since, before, count in places:
            token = since + symbol
            if token in self.vocab and self.fits("", token) and (not before or self.fits(before, token)):
                return count + 1, token
        raise ValueError(f"no token of the vocabulary ends in {symbol!r}")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        places, letter = self.states[state], self.letters[byte]
        added, token = self._emit(places, letter)
        kept = tuple((since + letter, before, count - added) for since, before, count in places if since + letter in self.begins)
        found = self.next[state][byte] = (self._state((*kept, ("", token, 0))), added)
        return found

    def finish(self, state: int, byte: int) -> int:
        found = self.last[state][byte] = self._emit(self.states[state], self.letters[byte] + END)[0]
        return found

    def count(self, word: bytes) -> int:
        if len(self.states) > self.max_states:
            self.reset()
        state, n, table = self.start, 0, self.next
        for b in word[:-1]:
            state, emitted = table[state].get(b) or self.step(state, b)
            n += emitted
        end = self.last[state].get(word[-1])
        return n + (self.finish(state, word[-1]) if end is None else end)


@dataclass
class ChunkMap:
    """What a chunk does to the word under way: ``head`` continues it; ``inner`` tokens; ``tail`` begins the next word.
    A chunk without white space has only a head (``whole``)."""

    head: bytes
    inner: int
    tail: bytes
    whole: bool


class TokenCounter:
    """Token counts of texts for a byte-level BPE vocabulary with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        spec = json.loads(word_tokenizer(path).to_str())
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a byte-level BPE vocabulary with word ends is needed")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.normal = word_tokenizer(path).normalizer
        self.words = WordTransducer(model["vocab"], model["merges"])
        self.memo = Recent()

    def piece(self, raw: bytes) -> int:
        """Tokens of a stretch without ASCII white space: special strings are one each, the rest is read word by word."""
        text, n = raw.decode(), 0
        for special, part in self._parts(text):
            if special:
                n += 1
            else:
                plain = part.lower() if part.isascii() else self.normal.normalize_str(part)
                n += sum(self.words.count(w.encode()) for w in self.pattern.findall(plain))
        return n

    def _parts(self, text: str):
        if "<|" not in text:
            yield False, text
            return
        at = 0
        for m in self.special.finditer(text):
            yield False, text[at:m.start()]
            yield True, m[0]
            at = m.end()
        yield False, text[at:]

    def total(self, pieces: list[bytes]) -> int:
        return sum(map(self.memo.fill(pieces, lambda new: map(self.piece, new)), pieces))

    def chunk_map(self, chunk: bytes) -> ChunkMap:
        pieces = chunk.split()
        if not pieces:
            return ChunkMap(b"", 0, b"", not chunk)
        head = b"" if chunk[0] in SPACE else pieces[0]
        if head == chunk:
            return ChunkMap(head, 0, b"", True)
        tail = b"" if chunk[-1] in SPACE else pieces[-1]
        return ChunkMap(head, self.total(pieces[bool(head):len(pieces) - bool(tail)]), tail, False)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if a.whole and b.whole:
            return ChunkMap(a.head + b.head, 0, b"", True)
        if a.whole:
            return ChunkMap(a.head + b.head, b.inner, b.tail, False)
        if b.whole:
            return ChunkMap(a.head, a.inner, a.tail + b.head, False)
        joint = a.tail + b.head
        return ChunkMap(a.head, a.inner + b.inner + (self.total([joint]) if joint else 0), b.tail, False)

    def close(self, m: ChunkMap) -> int:
        return m.inner + self.total([x for x in (m.head, m.tail) if x])

    def scan(self, chunks: list[bytes]) -> list[int]:
        """Tokens up to the end of each chunk, as if the text ended there: a prefix scan over the chunk maps."""
        return [self.close(m) for m in itertools.accumulate(map(self.chunk_map, chunks), self.compose)]

    def count(self, raw: bytes, chunk: int = CHUNK) -> int:
        if len(raw) <= chunk:
            return self.total(raw.split())
        maps = [self.chunk_map(raw[i:i + chunk]) for i in range(0, len(raw), chunk)]
        while len(maps) > 1:  # pairwise, as a parallel scan would
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.close(maps[0])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of whole texts.

    ``path`` names the vocabulary file on every machine.  Null and empty texts
    have 0 bytes and tokens; special strings inside texts count as one token
    each, as the library counts them.  Rows are independent: ties and repeated
    rows agree, and an empty table gives an empty result.
    """
    def make():
        c = counter(path)

        def work(texts):
            raw = [t.encode() if t else b"" for t in texts]
            n = [c.count(r) for r in raw]
            return [pa.array([len(r) for r in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
        return work

    return map_text(docs, make, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], text_col, keep)
