"""Names of words, lines and word stretches of many texts at once: array arithmetic instead of a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from locusmill.llm.suffix_dedup import BASE, MIX, least_place

#: Characters that are named at once (a longer text is taken in pieces that end at white space).
BLOCK = 1 << 17
_SPACES = np.array([chr(c).isspace() for c in range(0x3001)])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        _POWERS[:] = [np.append(np.uint64(1), np.cumprod(np.full(size, b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray, turn: int = 29) -> np.ndarray:
    x = (x ^ (x >> np.uint64(turn))) * MIX
    return x ^ (x >> np.uint64(32))


def run_names(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A name of values[begin:end] for each pair, the same wherever equal values stand: differences of one running sum."""
    up, down = _powers(len(values) + 1)
    total = np.append(np.uint64(0), np.cumsum(values * up[:-1]))
    return (total[end] - total[begin]) * down[begin]


def lowered(text: str) -> str:
    """Lower case with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """The words (runs of characters that aren't white space) of some texts: text, characters start to stop, line, and name."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    line: np.ndarray
    name: np.ndarray


def _pieces(texts: list[str]):
    """(text, start, piece): whole short texts, and long ones cut at white space."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > BLOCK:
            cut = max(t.rfind(" ", at, at + BLOCK), t.rfind("\n", at, at + BLOCK))
            if cut <= at:  # one word of BLOCK characters and more
                cut = next((j for j in range(at + BLOCK, len(t)) if t[j].isspace()), len(t))
            yield i, at, t[at:cut]
            at = cut
        yield i, at, t[at:]


def words_of(texts: list[str]) -> Words:
    """All words of ``texts``, in order, without regard to case. Lines end at line feeds."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    lines = np.zeros(len(texts) + 1, np.int64)  # line feeds of a text's pieces before this one
    own: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> None:
        if not own:
            return
        codes = np.frombuffer("\n".join([lowered(p) for _, _, p in own]).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0] + [len(p) + 1 for _, _, p in own])[:-1]
        blank = _SPACES[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        part = np.searchsorted(first, begin, side="right") - 1
        feeds = np.append(0, np.cumsum(codes == 10))
        text, at = np.array([i for i, _, _ in own]), np.array([a for _, a, _ in own])
        for i, x in enumerate((text[part], at[part] + begin - first[part], at[part] + end - first[part], feeds[begin] - feeds[first[part]] + lines[text[part]], run_names(mixed(codes + np.uint64(1)), begin, end))):
            out[i].append(x)
        last = np.append(first[1:] - 1, len(codes))
        for i, (j, _, _) in enumerate(own):
            lines[j] += feeds[last[i]] - feeds[first[i]]
        own.clear()

    for piece in _pieces(texts):
        if own and size + len(piece[2]) > BLOCK or own and own[-1][0] == piece[0]:
            flush()
            size = 0
        own.append(piece)
        size += len(piece[2]) + 1
    flush()
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
    return Words(*[np.concatenate(x).astype(k) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)])


def stretches(words: Words, size: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, name, second name) of some stretches of ``size`` words: of ``places`` consecutive ones the least.

    The choice hangs on nothing outside those words, so texts that share ``size + places - 1`` consecutive words share a stretch,
    however they are punctuated or broken into lines.
    """
    n = max(0, len(words.name) - size + 1)
    begin = np.flatnonzero(words.text[:n] == words.text[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)
    if not len(begin):
        return begin, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    one, two = (run_names(mixed(words.name, turn), begin, begin + size) for turn in (29, 31))
    # between the stretches of two texts places - 1 places are free, so that no choice reaches into the next text
    text = words.text[begin]
    at = np.arange(len(begin)) + (places - 1) * (np.cumsum(np.append(0, text[1:] != text[:-1])))
    keys = np.full(at[-1] + places, np.uint64(2**64 - 1))
    keys[at] = (mixed(one) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(begin), dtype=np.uint64)
    chosen = np.unique((least_place(keys, places)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return begin[chosen], one[chosen], two[chosen]
