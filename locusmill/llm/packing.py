"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan is made from counts, a row for each length: it names runs of sequences that hold the same lengths, so its work and size
depend on the limit and not on the documents. Documents get their rank within their length and look up the planned slot.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from locusmill.llm.common import saved, text_batches

#: Tokens of a sequence; the id after each document.
LIMIT, END_ID = 1024, 2


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """The plan of best fit by falling length: rows (length, rank, n, sequence, each, place).

    The documents of that length with ranks rank..rank+n-1 go to the sequences from ``sequence`` on, ``each`` in one, one after
    the other from token ``place`` on. Sequences with the same room are kept as runs (first, how many), so a length costs a step for
    each run that it meets. What results is what best fit gives document by document: a document goes to the fullest
    sequence with room, which is the one that got the last document of its length while that has room.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    open_, used, plan = 0, 0, []

    def put(room: int, first: int, n: int) -> None:
        nonlocal open_
        if room and n:
            rooms.setdefault(room, []).append((first, n))
            open_ |= 1 << room

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = open_ >> length << length
            if fits:
                room = (fits & -fits).bit_length() - 1
                first, n = rooms[room].pop()
                if not rooms[room]:
                    open_ ^= 1 << room
            else:
                room, first, n = limit, used, -(-left // (limit // length))
                used += n
            each = room // length
            whole, rest = min(left // each, n), 0
            if whole:
                plan.append((length, rank, whole * each, first, each, limit - room))
            if whole < n and (rest := left - whole * each):
                plan.append((length, rank + whole * each, rest, first + whole, rest, limit - room))
                put(room - rest * length, first + whole, 1)
            put(room - each * length, first, whole)
            put(room, first + whole + bool(rest), n - whole - bool(rest))
            left -= whole * each + rest
            rank += whole * each + rest
    return plan


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, in less time; a worker has one for each file.

    tiktoken does the same merges (a test holds the two together). It gives up on white space of very many characters in a row; such a
    text goes to the library itself.
    """

    def __init__(self, path: str | None) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(self.path, encoding="utf-8") as f:
            file = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.library = None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.quick.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation()
                self.library.no_padding()
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_ready: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    if path not in _ready:
        _ready[path] = Encoder(path)
    return _ready[path]


def pieces(df: DataFrame, key: str, text: str, path: str | None, limit: int, ids: bool) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids if asked, part, nth): the documents' pieces; nth counts those of one length in a partition from 0."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path).ids, np.zeros(limit + 1, np.int64)
        for batch in batches:
            rows, tokens = [], []
            for at, (part, text_) in enumerate(zip(batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                own = np.append(encode(text_), END_ID).astype("<u4")
                first = len(own) % limit or limit
                edges = [0, *range(first, len(own) + 1, limit)]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((at, i, a, b - a, zlib.crc32(own[a:b]), part, seen[b - a]))
                    seen[b - a] += 1
                    if ids:
                        tokens.append(own[a:b].astype(np.int32))
            at, *columns = np.array(rows, np.int64).reshape(-1, 7).T
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            more = [pa.array(tokens, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(at)), *made, *more], names=names)

    names = ["key", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if ids else [])]
    docs = df.select(F.col(key).alias("key"), F.spark_partition_id().alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return text_batches(docs).mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint{', ids array<int>' if ids else ''}")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, path: str | None = None, outputs: str = "ids") -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset; ``outputs='ids'``: also ids (array<int>), ``'digest'``: not.

    A document is its text's ids and END_ID. One of more than ``limit`` tokens is cut into pieces of ``limit``, of which the first may
    be shorter; all others are one piece. Pieces fill sequences of ``limit`` tokens without gaps from offset 0 on. A null text
    is empty (a piece of one token); repeated rows and null keys are documents of their own; columns other than ``key`` and
    ``text`` aren't read; an empty table gives no rows. Which of the documents of one length gets which slot is arbitrary.
    ``path``: the tokenizer's file, readable on every executor; without it each finds its own copy.

    Nothing is sorted: a piece's rank in its length is its number in its partition plus the number in the partitions
    before, from counts. Only these counts by length (``limit`` rows at most) meet on the driver.
    """
    with_ids = outputs == "ids"
    made = saved(pieces(df, key, text, path, limit, with_ids))
    counts = saved(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)
    slots = df.sparkSession.createDataFrame(plan, "length long, rank_from long, n_slots long, sequence long, each long, place long")
    ranked = made.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("nth", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(slots), ["length"]).where("nth >= rank_from and nth < rank_from + n_slots")
    i = F.col("nth") - F.col("rank_from")
    sequence = (F.col("sequence") + F.floor(i / F.col("each"))).cast("long")
    offset = (F.col("place") + i % F.col("each") * F.col("length")).cast("long")
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *(["ids"] if with_ids else []))
