"""What byte-pair encoding does to short strings, and which tokens may follow one another.

Greedy merging takes the best-ranked adjacent pair first, the leftmost among
equals.  Two facts make it a local matter: a run of tokens of an encoding is
itself the encoding of its text, and a sequence whose neighbours each encode
as the two of them is the encoding of the whole.  So a prefix has exactly one
last token that fits the token before it, which is what the token-count
transducer and the lattice encoder rely on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


def merge(symbols: Sequence[str], rank: Callable[[str, str], int | None]) -> list[str]:
    """Greedy merges of ``symbols``; ``rank`` gives a pair's rank (lower first) or None."""
    out = list(symbols)
    while len(out) > 1:
        best, where = None, -1
        for i in range(len(out) - 1):
            r = rank(out[i], out[i + 1])
            if r is not None and (best is None or r < best):
                best, where = r, i
        if best is None:
            break
        out[where:where + 2] = [out[where] + out[where + 1]]
    return out


class Neighbours:
    """Memo of which token pairs stand side by side in an encoding, and which tokens encode as themselves."""

    def __init__(self, split: Callable[[str], list[str]], rank: Callable[[str, str], int | None], limit: int = 400_000):
        self.split, self.rank, self.limit = split, rank, limit
        self.memo: dict[tuple[str, str], bool] = {}

    def fit(self, left: str, right: str) -> bool:
        """Whether the two encode as [left, right]; an empty ``left`` asks whether ``right`` encodes as itself."""
        key = (left, right)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            want = [left, right] if left else [right]
            found = self.memo[key] = merge(self.split(left + right), self.rank) == want
        return found
