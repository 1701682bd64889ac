"""Exact removal of repeated byte strings by distributed prefix doubling over a sparse suffix array.

Names stand for ranks: equal names, equal prefixes. The names of 32-byte prefixes are paired at offset 32 into
names of 64 bytes, and these at an offset of threshold - 64 into names of the threshold's length. Not every suffix
takes part: each window of the threshold's length points to the least of its 32-byte names, so equal windows point
to equal places, and only those places (about one byte in 35) are ranked first. Spark deals them out by name; a place whose
name is unique drops out, equal surroundings are settled at once, and only the windows around the other places
are named at full length, dealt out again and ordered by (document, start).

Strings are compared by two 64-bit names of fixed seed, not byte by byte: that two different strings have both names in
common is taken for impossible (about 2**-120 for a pair).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from locusmill.llm.common import bytes_of, saved, spread

#: Bytes of a first-level name; bytes that are named at once.
NAME, BLOCK = 32, 1 << 18
#: The numbers that stand for bytes and the base of the names come from this seed.
_random = np.random.Generator(np.random.PCG64(20240229))
LETTER = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + _random.integers(0, 2, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)

#: A name in more segments than this is wide: its windows are dealt out one by one instead of meeting as segments.
GROUP = 64

REMOVED, OPEN, KNOWN, WIDE = 0, 1, 2, 3


def _times(k: int) -> np.uint64:
    return np.uint64(pow(BASE, k, 1 << 64))


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all 32-byte and 64-byte strings in ``data``, by doubling from single bytes."""
    have, size = LETTER[data], 1
    first = have
    while size < 2 * NAME:
        have = have[:-size] * _times(size) + have[size:]
        size *= 2
        if size == NAME:
            first = have
    return first, have


def least_place(keys: np.ndarray, width: int) -> np.ndarray:
    """For each start, the minimum of ``keys`` over the next ``width``."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if size < width:
        keys = np.minimum(keys[: -(width - size)], keys[width - size :])
    return keys


def blocks(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text, start in the text) of stretches of text, so that each window of ``threshold`` bytes lies in one.

    Small texts share a block; a text longer than a block is cut into blocks that overlap by a window less one byte.
    """
    own: list[bytes] = []
    text: list[int] = []
    start: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < threshold:
            continue
        for at in range(0, max(1, len(t) - threshold + 1), BLOCK):
            part = t[at : at + BLOCK + threshold - 1]
            if size and size + len(part) > BLOCK:
                yield _joined(own, text, start)
                own, text, start, size = [], [], [], 0
            own.append(part)
            text.append(i)
            start.append(at)
            size += len(part)
    if own:
        yield _joined(own, text, start)


def _joined(own: list[bytes], text: list[int], start: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in own])
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(own), np.uint8), np.stack([np.array(text), np.array(start), ends - sizes, ends]), sizes


def places(texts: list[bytes], threshold: int) -> dict[str, np.ndarray]:
    """The segments: runs of windows that point to one place. kh: the place's name; sh: the segment's; text, start, n windows."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("kh", "sh", "text", "start", "n")}
    width, step = threshold - NAME + 1, threshold - 2 * NAME
    for data, (text, start, begin, end), sizes in blocks(texts, threshold):
        short, long = names(data)
        keys = ((short * MIX) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(short), dtype=np.uint64)
        least = (least_place(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # one for each window
        part = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
        valid = np.arange(len(least)) <= (end - threshold)[part]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new & valid)
        edge = np.append(np.flatnonzero(new | ~valid), len(least))
        n = edge[np.searchsorted(edge, first, side="right")] - first
        last = first + n - 1
        mixed = n.astype(np.uint64)
        for x in (long[first], long[first + step], long[last], long[last + step]):
            mixed = (mixed ^ x) * MIX
            mixed ^= mixed >> np.uint64(29)
        own = part[first]
        for c, x in (("kh", short[least[first]]), ("sh", mixed), ("text", text[own]), ("start", start[own] + first - begin[own]), ("n", n)):
            out[c].append(x)
    return {c: np.concatenate(x) if x else np.zeros(0, np.uint64 if c in ("kh", "sh") else np.int64) for c, x in out.items()}


def windows(texts: list[bytes], spans: list[np.ndarray], threshold: int) -> dict[str, np.ndarray]:
    """All windows that start in ``spans`` (start, n) of each text, by their name: a pair of 64-byte names."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("kh", "sh", "text", "start", "n")}
    step = threshold - 2 * NAME
    for i, (t, own) in enumerate(zip(texts, spans, strict=True)):
        edge = np.zeros(len(t) + 1, np.int64)
        np.add.at(edge, own[:, 0], 1)
        np.add.at(edge, own[:, 0] + own[:, 1], -1)
        wanted = np.cumsum(edge)[:-1] > 0
        for at in range(0, len(t) - threshold + 1, BLOCK):
            begin = np.flatnonzero(wanted[at : min(at + BLOCK, len(t) - threshold + 1)])
            if len(begin):
                _, long = names(np.frombuffer(t, np.uint8, count=min(BLOCK + threshold - 1, len(t) - at), offset=at))
                for c, x in (("kh", long[begin]), ("sh", long[begin + step]), ("text", np.full(len(begin), i)), ("start", at + begin), ("n", np.ones(len(begin), np.int64))):
                    out[c].append(x)
    return {c: np.concatenate(x) if x else np.zeros(0, np.uint64 if c in ("kh", "sh") else np.int64) for c, x in out.items()}


def segment_heads(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where a new name, and where a new segment of a name, begins in sorted rows."""
    kh, sh = rows.kh.to_numpy(), rows.sh.to_numpy()
    new_kh = np.append(True, kh[1:] != kh[:-1])
    return new_kh, new_kh | np.append(True, sh[1:] != sh[:-1])


ORDER = ["kh", "sh", "key", "crc", "start"]


def told_twice(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Which sorted rows equal the row before: repeated rows of a document tell of one occurrence several times."""
    out = np.full(len(rows), len(rows) > 0)
    out[:1] = False
    for c in columns:
        x = rows[c].to_numpy()
        out[1:] &= x[1:] == x[:-1]
    return out


def combined(rows: pd.DataFrame, pairs: bool) -> pd.DataFrame:
    """What a batch has to tell, ``ns`` holding n and the state: a bounded number of rows for each name.

    Of rows that tell of one occurrence one is left. A later copy within the batch is REMOVED and not sent to its name. A name in more than GROUP different segments of one batch is
    wide: its first row is sent, as KNOWN, and the others are WIDE already. Rows that need no answer are dealt out by place.
    """
    rows = rows.sort_values(ORDER, kind="stable")
    rows = rows[~told_twice(rows, ORDER)].reset_index(drop=True)
    state, kh = np.full(len(rows), OPEN), rows.kh.to_numpy().copy()
    if len(rows):
        new_kh, new = segment_heads(rows)
        moved = ~new
        state[moved] = REMOVED
        if not pairs:
            group = np.cumsum(new_kh) - 1
            wide = (np.bincount(group, new) > GROUP)[group]
            state[wide & new] = WIDE
            state[wide & new_kh] = KNOWN
            moved |= wide & ~new_kh
        kh[moved] = (rows.key.to_numpy() * 1_000_003 + rows.start.to_numpy())[moved]
    return rows.assign(kh=kh, ns=(rows.n * 4 + state).astype(np.int32)).drop(columns="n").sort_values(["key", "crc", "start"], kind="stable")


def ranked(rows: pd.DataFrame, pairs: bool) -> pd.DataFrame:
    """Sets ``state`` of rows that were dealt out by name: REMOVED if the same segment or window starts earlier (document, start).
    Rows of one document and start are one occurrence, from however many repeated rows they come.

    First occurrences of a name that stands in different segments stay OPEN, or WIDE if there are many; all others drop
    out, and with ``pairs`` all first occurrences do.
    """
    rows = rows.assign(n=rows.ns // 4, state=rows.ns % 4).drop(columns="ns")
    done = rows.state.isin((REMOVED, WIDE))
    settled, rows = rows[done], rows[~done]
    kh = rows.kh.to_numpy()
    order = np.argsort(kh, kind="stable")
    again = kh[order][1:] == kh[order][:-1]
    same = (rows.state == KNOWN).to_numpy()
    same[order[1:][again]] = True
    same[order[:-1][again]] = True
    rows = rows[same].sort_values(ORDER, kind="stable").reset_index(drop=True)
    if len(rows):
        new_kh, new = segment_heads(rows)
        group = np.cumsum(new_kh) - 1
        known = np.bincount(group, rows.state.to_numpy() == KNOWN) > 0
        different = np.bincount(group, new)
        first = np.where(known | (different > GROUP), WIDE, OPEN)
        rows["state"] = np.where(new, first[group], REMOVED)
        rows = rows[~told_twice(rows, ORDER) & (~new | (not pairs) & (known | (different > 1))[group])]
    return pd.concat([settled, rows], ignore_index=True)


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    own = [b for b in batches if len(b)]
    return pd.concat(own, ignore_index=True) if own else None


def rank_by_name(made: DataFrame, pairs: bool, extra: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Deals the rows out by name into ``parts`` tasks and ranks them; (kh, key, crc, start, n, state) of what isn't unique, and ``extra`` int columns."""
    names_ = ["kh", "key", "crc", "start", "n", "state", *extra]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (rows := _whole(batches)) is not None:
            yield ranked(rows, pairs)[names_]

    return made.repartition(parts or spread(made), "kh").mapInPandas(run, "kh bigint, key bigint, crc bigint, start int, n int, state tinyint" + "".join(f", {c} int" for c in extra))


ROWS = "kh bigint, sh bigint, key bigint, crc bigint, start int, ns int"


def _rows(found: dict[str, np.ndarray], key: np.ndarray, crc: np.ndarray, pairs: bool) -> pd.DataFrame:
    at = found["text"]
    rows = pd.DataFrame({"kh": found["kh"].view(np.int64), "sh": found["sh"].view(np.int64), "key": key[at], "crc": crc[at], "start": found["start"].astype(np.int32), "n": found["n"].astype(np.int32)})
    return combined(rows, pairs)


def repeated_windows(rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """(key, crc, start, n) of the windows in segments (kh, key, crc, start, body) of which an equal one starts earlier.

    Equal windows have one name, and all segments of a name are in ``rows``. Some names are taken at a time.
    """
    order = ["kh", "key", "crc", "start"]
    rows = rows.sort_values(order, kind="stable")
    rows = rows[~told_twice(rows, order)].reset_index(drop=True)
    new_kh = np.append(True, rows.kh.to_numpy()[1:] != rows.kh.to_numpy()[:-1])
    size = np.cumsum(rows.body.str.len().to_numpy())
    part = (size // (4 * BLOCK))[np.maximum.accumulate(np.where(new_kh, np.arange(len(rows)), 0))]
    out, step = [], threshold - 2 * NAME
    for _, own in rows.groupby(part, sort=False):
        sizes = own.body.str.len().to_numpy()
        _, long = names(np.frombuffer(b"".join(own.body), np.uint8))
        ends = np.cumsum(sizes)
        at = np.concatenate([np.arange(e - z, e - threshold + 1) for e, z in zip(ends, sizes, strict=True)])
        seg = np.repeat(np.arange(len(own)), sizes - threshold + 1)
        start = own.start.to_numpy()[seg] + at - (ends - sizes)[seg]
        a, b = long[at], long[at + step]
        doc = np.unique(own.key.to_numpy(), return_inverse=True)[1][seg]  # in order of the key
        order = np.lexsort((start, own.crc.to_numpy()[seg], doc, b, a))
        later = np.append(False, (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]))
        hit = np.sort(order[later])
        if len(hit):
            head = np.append(True, (np.diff(hit) != 1) | (np.diff(seg[hit]) != 0))
            first = hit[head]
            n = np.diff(np.append(np.flatnonzero(head), len(hit)))
            out.append(pd.DataFrame({"key": own.key.to_numpy()[seg[first]], "crc": own.crc.to_numpy()[seg[first]], "start": start[first], "n": n}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("key", "crc", "start", "n")})


#: Null keys stand from here on, 2**32 places, before all others. A document is told apart by its key and a 64-bit hash of its text
#: (column ``crc``); documents of null key by 32 bits of the text's CRC more, in the key, as there may be very many of them.
NO_KEY = -(2**63)


def document_key(key: str, text: Column) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.crc32(text) + F.lit(NO_KEY))


def text_hashes(texts: list[bytes]) -> np.ndarray:
    """XXH64 of each text as Spark's ``xxhash64`` has it."""
    return np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents with their key and crc, spans): the spans' windows also start earlier."""
    if threshold < 2 * NAME:
        raise ValueError(f"the threshold must be {2 * NAME} bytes at least")
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(document_key(key, body).alias("key"), body.alias("text"))

    def level1(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch.text.tolist()]
            yield _rows(places(texts, threshold), batch.key.to_numpy(), text_hashes(texts), False)

    def level2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [unpacked(t) for t in batch.packed.tolist()]
            key, crc = batch.key.to_numpy(), batch.crc.to_numpy()
            wide = [np.array([(x["start"], x["n"]) for x in s if x["state"] != OPEN], np.int64).reshape(-1, 2) for s in batch.spans]
            yield _rows(windows(texts, wide, threshold), key, crc, True).assign(body=None)
            own = [(x["kh"], 0, k, c, x["start"], 0, t[x["start"] : x["start"] + x["n"] - 1 + threshold]) for t, k, c, s in zip(texts, key, crc, batch.spans, strict=True) for x in s if x["state"] == OPEN]
            if own:
                yield pd.DataFrame(own, columns=["kh", "sh", "key", "crc", "start", "ns", "body"])

    def settle2(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (rows := _whole(batches)) is not None:
            with_body = rows.body.notna()
            if with_body.any():
                yield repeated_windows(rows[with_body], threshold)
            yield ranked(rows[~with_body].drop(columns="body"), True)[["key", "crc", "start", "n"]]

    size = bytes_of(docs)  # about a segment for 20 bytes; what is left for the second level is less
    parts, parts2 = spread(docs, size / 20), spread(docs, size / 30)
    first = saved(rank_by_name(docs.mapInPandas(level1, ROWS), False, parts=parts))
    per_doc = first.where(f"state <> {REMOVED}").groupBy("key", "crc").agg(F.collect_list(F.struct("start", "n", "state", "kh")).alias("spans"))
    marked = docs.mapInPandas(_pack, "key bigint, crc bigint, packed binary")
    made = marked.join(per_doc, ["key", "crc"]).mapInPandas(level2, ROWS + ", body binary")
    second = made.repartition(parts2, "kh").mapInPandas(settle2, "key bigint, crc bigint, start int, n int")
    return marked, first.where(f"state = {REMOVED}").select("key", "crc", "start", "n").unionByName(second)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as compressed bytes with their hash: they are shuffled twice."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [t.encode() for t in batch.text.tolist()]
        yield pd.DataFrame({"key": batch.key, "crc": text_hashes(texts), "packed": [squeeze(t) for t in texts]})


def unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 100, outputs: str = "text") -> DataFrame:
    """One row for each row: every byte covered by a ``threshold``-byte string that also starts earlier goes.

    Earlier: smaller key, or the same document and an earlier start; overlaps count; strings are judged on the input.
    ``outputs='digest'``: key, n_bytes, n_removed, n_spans, kept_sha256. ``outputs='text'``: also kept (binary, as a cut
    may split a character) and spans (array of start, stop in bytes of the input). Null texts count as empty, null keys come before
    all others; rows of one key and different texts are ordered by a hash of the text; a repeated row is the same document
    and gets the same result. Texts shorter than the threshold stay whole. An empty table gives an empty one.
    """
    marked, removed = repeated_spans(df, key, text, threshold)
    spans = removed.groupBy("key", "crc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    digest = outputs == "digest"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, s in zip(map(unpacked, batch.packed.tolist()), batch.spans, strict=True):
                runs = merged(s, threshold)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                whole = b"".join(kept)
                rows.append((len(t), len(t) - len(whole), len(runs), hashlib.sha256(whole).hexdigest(), *(() if digest else (whole, [{"start": a, "stop": b} for a, b in runs]))))
            names_ = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([] if digest else ["kept", "spans"])]
            yield pd.DataFrame({"key": batch.key.tolist(), **{c: [r[i] for r in rows] for i, c in enumerate(names_)}})

    schema = "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ("" if digest else ", kept binary, spans array<struct<start: int, stop: int>>")
    out = marked.join(spans, ["key", "crc"], "left").select("key", "packed", "spans").mapInPandas(cut, schema)
    return out.withColumn("key", F.when(F.col("key") >= NO_KEY + 2**32, F.col("key"))).withColumnRenamed("key", key)


def merged(spans, threshold: int) -> list[tuple[int, int]]:
    """Maximal runs (start, stop) of the bytes that the windows cover."""
    if spans is None or not len(spans):
        return []
    pairs = np.array([(x["start"], x["start"] + x["n"] - 1 + threshold) for x in spans], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > reach[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)
    return list(zip(pairs[new, 0].tolist(), reach[ends].tolist(), strict=True))


REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, base, substring(h, 2 * base + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 500)) AS base FROM d WHERE len(h) >= 200) q),
w AS (SELECT doc_id, base + i AS p, md5(substring(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, base, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM c) q),
f AS (SELECT k, min((doc_id, p)) AS first FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE (doc_id, p) <> first),
r AS (SELECT doc_id, p, coalesce(p > lag(p) OVER o + 100, true)::INTEGER AS new FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
u AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
v AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
x AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS stop, sum(b - a) AS n_removed, count(*) AS n_spans FROM v JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN stop IS NULL THEN h ELSE coalesce(head, '') || substring(h, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
