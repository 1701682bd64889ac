"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

BPE has a prefix property: the encoding of a word's prefix, without its last token, is the
encoding of the shorter prefix. So a trie node needs one state only, the last token of the
path down to it, and every prefix that several words share is encoded once. A token may
follow another exactly if plain merging of the two strings gives these two tokens back.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from locusmill.llm.common import text_batches

#: Distinct words and token pairs that a worker keeps, and characters of text for which one trie is built.
KEPT_WORDS, KEPT_PAIRS, TRIE_CHARS = 100_000, 100_000, 2_000_000
NEVER = 1 << 60

#: Texts of these characters only are split by SIMPLE_WORD: no character among them is changed by NFC,
#: and each of the letters has one lower-case letter. Other texts go through the library's normalizer.
SIMPLE_TEXT = re.compile(r"[\t\n\r -~¡§©«®°»¿À-ÖØ-öø-ÿ–—‘’“”…]*")
SIMPLE_WORD = re.compile(r"[a-zà-öø-ÿß]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9à-öø-ÿß]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TrieBpe:
    """A tokenizer with an end-of-word mark, no decoder, and special tokens found before normalizing."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.packed = {t: struct.pack("<I", i) for t, i in self.ids.items()}
        self.merges = [tuple(m) for m in model["merges"]]
        self.made_by = {a + b: i for i, (a, b) in enumerate(self.merges)}
        self.spines: tuple[dict, dict] = ({}, {})
        self.reach: dict[tuple[str, str], int] = {}  # letters of the longest token that ends so
        for t in self.ids:
            bare = t.removesuffix(self.end)
            for ends in {bare[-2:], bare[-1:]}:
                key = (ends, t[len(bare) :])
                self.reach[key] = max(self.reach.get(key, 1), len(bare))
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: again and again the merge of lowest rank, the leftmost first."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def split(self, token: str) -> list[str]:
        """A token's first symbols: letters, the last one with the end-of-word mark if the token has it."""
        bare = token.removesuffix(self.end)
        return [*bare[:-1], bare[-1] + token[len(bare) :]]

    def is_whole(self, token: str) -> bool:
        """True if merging gives the token itself, so that it can stand in an encoding."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = token in self.ids and self.merged(self.split(token)) == [token]
        return known

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols at one end of a token (0: left, 1: right) as it grows, each with the rank of the merge that ends it."""
        if (known := self.spines[side].get(token)) is None:
            known, rank = [(token, NEVER)], self.made_by.get(token)
            while rank is not None:
                part = self.merges[rank][side]
                known.append((part, rank))
                rank = self.made_by.get(part)
            known = self.spines[side][token] = known[::-1]
        return known

    def may_follow(self, token: str, before: str) -> bool:
        """True if merging the joined strings gives the two tokens back.

        Both grow as if alone unless the symbols that meet at the border merge first; of equal ranks the
        leftmost merge goes first.
        """
        left, right, i, j = self.spine(before, 1), self.spine(token, 0), 0, 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            rank = self.ranks.get((a, b), NEVER)
            if rank < a_ends and rank <= b_ends and rank != NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def last_token(self, path: str, states: list[str | None], end: str) -> str:
        """The last token of ``path`` (letters, then the mark ``end`` or nothing), from the states of its prefixes."""
        n, ids, follows = len(path), self.ids, self.follows
        for size in range(min(n, self.reach.get((path[-2:], end), 1)), 0, -1):
            token = path[n - size :] + end
            if token in ids and self.is_whole(token):
                if size == n:
                    return token
                if (before := states[n - size]) is None:
                    before = states[n - size] = self.last_token(path[: n - size], states, "")
                if (fits := follows.get((before, token))) is None:
                    fits = follows[before, token] = self.may_follow(token, before)
                if fits:
                    return token
        raise ValueError(f"no token for {path!r}")

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each word (in byte letters) and its tokens, by one depth-first walk over the words' trie.

        The trie is kept as its sorted words: in that order each word leaves the path to the one before
        at the node where the two part, and all states above that node still hold.
        """
        if len(self.follows) > KEPT_PAIRS:
            self.follows.clear()
        states: list[str | None] = [""]  # states[d]: the last token of the path's first d letters, None before it's asked for
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            states += [None] * (len(word) - shared)
            for depth in range(64, len(word), 64):  # else a very long word would nest too deeply
                if states[depth] is None:
                    states[depth] = self.last_token(word[:depth], states, "")
            tokens = [self.last_token(word, states, self.end)]
            left = len(word) - len(tokens[0]) + len(self.end)
            while left:
                tokens.append(states[left])
                left -= len(states[left])
            tokens.reverse()
            yield word, tokens
            before = word

    def pieces(self, text: str) -> list[str]:
        """The words of a text, in order: real characters, or byte letters after a NUL; special tokens as they are."""
        if SIMPLE_TEXT.fullmatch(text) and "<|" not in text:
            return SIMPLE_WORD.findall(text.lower())
        out: list[str] = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                out.append("\0\0" + part)
            elif SIMPLE_TEXT.fullmatch(part):
                out += SIMPLE_WORD.findall(part.lower())
            else:
                out += ["\0" + word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes those pieces that aren't known yet."""
        known, new, same = self.words, {}, []
        for piece in pieces:
            if piece not in known:
                if piece.startswith("\0\0"):
                    known[piece] = (struct.pack("<I", self.special[piece[2:]]), piece[2:])
                    continue
                word = piece[1:] if piece[0] == "\0" else piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                if new.setdefault(word, piece) != piece:
                    same.append((word, piece))
        packed = self.packed
        for word, tokens in self.encode_words(new):
            known[new[word]] = (b"".join([packed[t] for t in tokens]), " ".join(tokens))
        for word, piece in same:
            known[piece] = known[new[word]]

    def forget(self) -> None:
        """Drops the words and pairs seen so far; the vocabulary's tables stay."""
        self.words.clear()
        self.follows.clear()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Each text's ids as little-endian unsigned 32-bit integers, and its decoded text."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= TRIE_CHARS):
                size += len(texts[stop])
                stop += 1
            split = [self.pieces(t) for t in texts[start:stop]]
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            self.learn(set().union(*split))
            known = self.words
            for pieces in split:
                got = [known[p] for p in pieces]
                yield b"".join([x[0] for x in got]), " ".join([x[1] for x in got])
            start = stop


_ready: dict[str, TrieBpe] = {}


def tokenizer(path: str) -> TrieBpe:
    """One tokenizer a worker and file."""
    if path not in _ready:
        _ready[path] = TrieBpe(path)
    return _ready[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",), outputs: str = "tokens") -> DataFrame:
    """Encodes the whole of every text and decodes the ids again; narrow, one row out for each row in.

    ``outputs='tokens'``: keep..., ids array<int>, decoded string. ``outputs='digest'``: keep..., n_tokens,
    ids_sha256, decoded_sha256. A null text counts as empty (no ids, empty decoded text). Repeated rows, ties and
    null keys are rows like any other; columns that are not in ``keep`` aren't read; an empty table gives an empty
    one. The tokenizer file must be readable on every executor; without ``path`` each finds its own copy.
    """
    kept = [F.col(c) for c in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    digest = outputs == "digest"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or default_path())
        for batch in batches:
            texts = ["" if t is None else t for t in batch.pop("__text").tolist()]
            rows = []
            for ids, decoded in bpe.encode(texts):
                if digest:
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    rows.append((list(struct.unpack(f"<{len(ids) // 4}I", ids)), decoded))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            yield batch.assign(**{n: [r[i] for r in rows] for i, n in enumerate(names)})
        bpe.forget()  # the worker lives on for other stages

    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return text_batches(df.select(*kept, F.col(text).alias("__text"))).mapInPandas(run, f"{kinds}, {made}")
