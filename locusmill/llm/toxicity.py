"""Toxicity: a linear classifier over word features, kept from leaning on who is talked about.

Besides the labelled texts it is trained on counterfactual ones: wherever a labelled text names a group, the name is
swapped for another group's, and into a text that names none a mention of one is put; the change that this makes to the
score is penalised. Neutral mentions of a group therefore add nothing, however often that group stands in toxic texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from locusmill.llm.common import saved, text_batches

#: Labelled texts of each class that the classifier is fitted on at most (those of lowest hash).
MAX_LABELLED = 4_000
#: Hashed features; texts of the sample that must hold a feature; least z of its log odds; weights of the two penalties.
SPACE, LEAST_TEXTS, LEAST_Z, RIDGE, SWAP_PENALTY = 1 << 22, 4, 2.0, 0.0002, 10.0
#: Weight of label 1 in the loss, whatever its share of the labels.
TOXIC_SHARE = 0.3
#: Words that a worker remembers the features of.
KEPT_WORDS = 150_000
WORD = re.compile(r"[^\W\d_]+")

#: Names of groups, a list for each kind; a swap stays within a list.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("christian", "muslim", "jew", "hindu", "buddhist", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "protestant"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender", "heterosexual"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "atheisten"),
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "athées"),
    ("mujer", "hombre", "chica", "chico"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "ateos"),
)
ALL_TERMS = sorted({t for terms in IDENTITY_TERMS for t in terms})


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its first four to six letters."""
    parts = [word, *(f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n)]
    return [zlib.crc32(p.encode()) % SPACE for p in parts]


def features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def swaps(words: set[str]) -> list[tuple[list[int], list[int]]]:
    """(lost, gained) features for each way to swap one group's name in a text for another's.

    A text that names no group gets a mention of one, which its words pick.
    """
    own = features(words)
    out = []
    if words.isdisjoint(ALL_TERMS):
        term = ALL_TERMS[zlib.crc32(" ".join(sorted(words)).encode()) % len(ALL_TERMS)]
        return [([], sorted(set(word_features(term)) - own))]
    for terms in IDENTITY_TERMS:
        for a in words.intersection(terms):
            rest = features(words - {a})
            for b in terms:
                if b not in words:
                    out.append((sorted(own - rest), sorted(set(word_features(b)) - rest)))
    return out


class Toxicity:
    """Weights of the selected features; scores a text from the set of its features."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.weights = dict(zip(ids.tolist(), weights.tolist(), strict=True))
        self.bias = bias
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        held: set[int] = set()
        known, weights = self.known, self.weights
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(WORD.findall((text or "").lower())):
            if (own := known.get(w)) is None:
                own = known[w] = tuple(f for f in word_features(w) if f in weights)
            if own:
                held.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(sorted(weights[f] for f in held)), -500, 500))))


def fit(sample: pd.DataFrame, ids: np.ndarray) -> Toxicity:
    """Fits on ``sample`` (y, feats, lost, gained: lists, and lists of lists for the swaps, of features in ``ids``).

    Without labels of both classes the score is constant: 0.99, or 0.01 (also with none).
    """
    y = sample.y.to_numpy(np.float64)
    none = np.zeros(0, np.int64)
    if len(y) == 0 or y.min() == y.max():
        sure = 0.01 if len(y) == 0 else float(np.clip(y.mean(), 0.01, 0.99))
        return Toxicity(none, none.astype(float), float(np.log(sure / (1 - sure))))
    p, n = y.sum(), len(y) - y.sum()
    index = {f: i for i, f in enumerate(ids.tolist())}
    row = np.repeat(np.arange(len(y)), [len(f) for f in sample.feats])
    col = np.array([index[f] for own in sample.feats for f in own], np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []  # (features, +1 or -1) of each swap, as far as they are selected
    for lost, gained in zip(sample.lost, sample.gained, strict=True):
        for a, b in zip(lost, gained, strict=True):
            sign = [(index[f], -1.0) for f in a if f in index] + [(index[f], 1.0) for f in b if f in index]
            if sign:
                pairs.append((np.array([s[0] for s in sign]), np.array([s[1] for s in sign])))
    prow = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
    pcol = np.concatenate([p[0] for p in pairs]) if pairs else none
    psign = np.concatenate([p[1] for p in pairs]) if pairs else none.astype(float)
    share = np.where(y > 0, TOXIC_SHARE / p, (1 - TOXIC_SHARE) / n)  # else a rare class would be given up
    w, bias = np.zeros(len(ids)), 0.0
    m, v, step = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1), 0.1
    for i in range(1, 301):  # Adam on all rows
        miss = (1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(y)), -30, 30))) - y) * share
        grad = np.bincount(col, miss[row], len(ids)) + RIDGE * w
        if len(pairs):
            change = np.bincount(prow, w[pcol] * psign, len(pairs))
            grad += 2 * SWAP_PENALTY * np.bincount(pcol, change[prow] * psign, len(ids)) / len(pairs)
        g = np.append(grad, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Toxicity(ids, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Toxicity:
    """Fits on the labelled rows outside the held-out fifth (crc32 of the key as text, modulo 5, is 0).

    At most ``max_labelled`` texts of each class, those of lowest hash, come to the driver, as features: a key may be on any
    number of rows. Equal texts of one key count once. Null labels and keys are left out; of several labels of one key the
    largest counts; a labelled key without rows takes a place all the same. With labels of one class, or none, the score is constant.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0))
    own = own.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    def lowest(rows: DataFrame, *order: str) -> DataFrame:
        """``max_labelled`` rows of each class, in a broadcast."""
        parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("key"), *order).limit(max_labelled) for y in (0, 1)]
        return F.broadcast(parts[0].union(parts[1]))

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    chosen = saved(lowest(rows.join(lowest(own, "key"), "key").select("y", "key", "h").distinct(), "key", "h"))
    texts = rows.join(F.broadcast(chosen), ["key", "h"]).dropDuplicates(["key", "h"]).select("y", "text")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [set(WORD.findall((t or "").lower())) for t in batch.text.tolist()]
            pairs = [swaps(w) for w in words]
            yield pd.DataFrame({"y": batch.y, "feats": [sorted(features(w)) for w in words], "lost": [[a for a, _ in p] for p in pairs], "gained": [[b for _, b in p] for p in pairs]})

    sample = saved(texts.mapInPandas(seen, SAMPLE))
    ids = selected(sample)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(ids.tolist()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            batch["feats"] = [[f for f in x if f in own] for x in batch.feats]
            for side in ("lost", "gained"):
                batch[side] = [[[f for f in swap if f in own] for swap in x] for x in batch[side]]
            yield batch

    return fit(sample.mapInPandas(cut, SAMPLE).toPandas(), ids)


SAMPLE = "y int, feats array<int>, lost array<array<int>>, gained array<array<int>>"


def selected(sample: DataFrame) -> np.ndarray:
    """The features whose log odds between the classes are LEAST_Z standard errors from 0, and that LEAST_TEXTS texts have."""
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    p, n = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not p or not n:
        return np.zeros(0, np.int64)
    by = sample.select("y", F.explode("feats").alias("f")).groupBy("f").agg(F.count("*").alias("all"), F.sum("y").alias("k")).where(F.col("all") >= LEAST_TEXTS)
    k, c = F.col("k") + 0.5, F.col("all") - F.col("k") + 0.5
    rest_k, rest_c = F.lit(p + 1) - k, F.lit(n + 1) - c
    z = (F.log(k) - F.log(rest_k) - F.log(c) + F.log(rest_c)) / F.sqrt(1 / k + 1 / rest_k + 1 / c + 1 / rest_c)
    return np.array(sorted(r.f for r in by.where(F.abs(z) >= LEAST_Z).select("f").collect()), np.int64)


def score(docs: DataFrame, model: Toxicity, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., score, predicted: one row for each row, from the whole text and nothing else.

    score: 0 to 1, higher where label 1 is likelier; predicted: 1 from 0.5. Null texts count as empty and get the score of a text
    without words. Null keys, ties and repeated rows are rows like any other; only ``keep`` and the text are read. No rows, no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=[shared.value.score(t) for t in batch.pop("__text").tolist()])
        shared.value.known.clear()  # the worker lives on for other stages

    scored = text_batches(docs.select(*keep, F.col(text).alias("__text"))).mapInPandas(run, f"{kinds}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; every row is judged by its own text, and all columns stay. Null and empty texts stay if texts without words do."""
    names = docs.columns
    rows = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(names)})
    kept = score(rows, train(docs, labels, key, text), f"c{names.index(text)}", tuple(rows.columns)).where("predicted = 0")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
