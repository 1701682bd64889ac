"""Model fitting: nets from sums over rows, merged as a tree; grouped functions for many small models."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from locusmill.operators.rows import numbered, settled
from locusmill.operators.sums import tree_sum


def with_folds(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """A fold 0..folds-1 for each row from a seeded hash of its key: the same on every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))


#: Features of a path at most (their products are one matrix), steps that scores are compared in, passes of a logistic path at most.
MAX_WIDTH, STEPS, PASSES = 2_000, 1_000, 30


def _fold_products(rows: DataFrame) -> DataFrame:
    """(fold, s): products of (x, y, 1) of the rows (fold, y, x) of each fold, summed by partition and merged as a tree."""

    def run(batches):
        held, s = None, None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for fold, own in batch.groupby("fold", sort=False):
                v = np.column_stack([np.stack(own.x.to_numpy()), own.y, np.ones(len(own))])
                if held != fold:
                    if held is not None:
                        yield pd.DataFrame({"fold": [held], "part": [part], "s": [s.ravel()]})
                    held, s = fold, np.zeros((v.shape[1], v.shape[1]))
                s += v.T @ v
        if held is not None:
            yield pd.DataFrame({"fold": [held], "part": [part], "s": [s.ravel()]})

    return tree_sum(rows.sortWithinPartitions("fold").mapInPandas(run, "fold int, part long, s array<double>"), ["fold"])


def _gaussian_path(sums: np.ndarray, lambdas: np.ndarray, alpha: float) -> tuple[list[tuple], np.ndarray]:
    """((lambda, fold, squared error) of held-out rows, weights of all rows' nets as columns, the intercepts last)."""
    found = FoldSums(sums, alpha)
    total, out = sums.sum(axis=0), []

    def full(w: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The net as weights of (x, y, 1) whose product with a row is the error."""
        c = np.zeros(found.p + 2)
        c[found.used], c[found.p] = w / found.sd, -1.0
        c[-1] = -(q[-1, :-1] @ c[:-1]) / max(q[-1, -1], 1)
        return c

    for fold, held in enumerate(sums):
        if held[-1, -1] > 0:
            for lam, w in zip(lambdas, found.nets(total - held, lambdas), strict=True):
                c = full(w, total - held)
                out.append((float(lam), fold, float(max(c @ held @ c, 0.0) / held[-1, -1])))
    whole = np.column_stack([full(w, total) for w in found.nets(total, lambdas)])
    return out, np.delete(whole, found.p, axis=0)


def _logistic_path(rows: DataFrame, total: np.ndarray, lambdas: np.ndarray | None, n_lambdas: int, alpha: float, folds: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(lambdas, (lambda, fold, AUC) of held-out rows, weights of all rows' nets as columns, the intercepts last).

    All folds and penalties (and the nets of all rows) go on together: a pass over the rows sums the gradients of all of them, and
    coordinate descent minimises the bound whose curvature is a quarter of all rows' products, which is at least each fold's. So
    the likelihood never falls, and a path costs PASSES jobs at most, however many nets it has.
    """
    context = rows.sparkSession.sparkContext
    n, p = total[-1, -1], len(total) - 2
    centre = total[-1, :p] / n
    c = FoldSums.centred(total)
    sd = np.sqrt(np.maximum(np.diag(c)[:p], 0) / n)
    used = np.flatnonzero(sd > 1e-9)
    gram = np.zeros((len(used) + 1, len(used) + 1))
    gram[:-1, :-1] = c[np.ix_(used, used)] / np.outer(sd[used], sd[used]) / n
    gram[-1, -1] = 1.0
    share = total[p, -1] / n
    if lambdas is None:
        lambdas = lambda_path(c[used, p] / sd[used] / n, n_lambdas, alpha=alpha)
    b = np.zeros((folds + 1, len(used) + 1, len(lambdas)))  # the last one is fitted to all rows
    b[:, -1] = math.log(share / (1 - share))

    def scored(batch: pd.DataFrame) -> np.ndarray:
        return np.column_stack([(np.stack(batch.x.to_numpy())[:, used] - centre[used]) / sd[used], np.ones(len(batch))])

    def passed(make, width: int) -> dict[int, np.ndarray]:
        """Sums of what ``make(fold, z, y)`` gives as (net, array) pairs."""

        def run(batches):
            held = {}
            for batch in batches:
                for fold, own in batch.groupby("fold"):
                    for net, s in make(int(fold), scored(own), own.y.to_numpy()):
                        held[net] = held[net] + s if net in held else s
            if held:
                yield pd.DataFrame({"net": list(held), "part": TaskContext.get().partitionId(), "s": [x.ravel() for x in held.values()]})

        return {r["net"]: np.array(r["s"]) for r in tree_sum(rows.mapInPandas(run, "net int, part long, s array<double>"), ["net"]).collect()}

    for _ in range(PASSES):
        sent = context.broadcast(b)

        def gradients(fold: int, z: np.ndarray, y: np.ndarray):
            for net in range(folds + 1):
                if net != fold:
                    yield net, np.append((z.T @ (y[:, None] - 1 / (1 + np.exp(-np.clip(z @ sent.value[net], -500, 500))))).ravel(), float(len(z)))  # noqa: B023

        change, found = 0.0, passed(gradients, b[0].size)
        sent.destroy()
        for net, s in found.items():
            # the bound divided by the net's rows: curvature n / (4 rows) of the scaled products
            curve = gram * (n / s[-1] / 4)
            target = s[:-1].reshape(b[net].shape) / s[-1] + curve @ b[net]
            for i, lam in enumerate(lambdas):
                new = gram_net(curve, target[:, i], lam, alpha, start=b[net][:, i], free=1)
                change = max(change, float(np.abs(new - b[net][:, i]).max()))
                b[net][:, i] = new
        if change < 1e-4:
            break
    sent = context.broadcast(b)
    size = np.abs(b[:, :-1]).sum(axis=1) * 6 + np.abs(b[:, -1]) + 1e-9  # scores stay within it, or count with its ends

    def counted(fold: int, z: np.ndarray, y: np.ndarray):
        at = np.clip(((z @ sent.value[fold]) / size[fold] + 1) * (STEPS / 2), 0, STEPS - 1).astype(int)
        for label in (0, 1):
            own = at[y == label] + STEPS * np.arange(at.shape[1])
            yield 2 * fold + label, np.bincount(own.ravel(), minlength=STEPS * at.shape[1]).astype(float)

    counts, out = passed(counted, STEPS * len(lambdas)), []
    for fold in range(folds):
        if 2 * fold in counts and 2 * fold + 1 in counts:
            no, yes = (counts[2 * fold + i].reshape(len(lambdas), STEPS) for i in (0, 1))
            below = np.cumsum(no, axis=1) - no / 2
            for lam, area, pairs in zip(lambdas, (yes * below).sum(axis=1), no.sum(axis=1) * yes.sum(axis=1), strict=True):
                if pairs:
                    out.append((float(lam), fold, float(area / pairs)))
    weights = np.zeros((p + 1, len(lambdas)))
    weights[used] = b[-1][:-1] / sd[used][:, None]
    weights[-1] = b[-1][-1] - centre @ weights[:-1]
    return lambdas, out, weights


def regularised_path(df: DataFrame, key: str, features: str, label: str, family: str = "binomial", lambdas: list[float] | None = None, n_lambdas: int = 100, alpha: float = 0.5, folds: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((lambda, fold, metric), (lambda, feature, weight)): elastic nets along a path of penalties, judged on held-out folds, and those of all rows.

    The metric is the area under the ROC curve (binomial: label above 0 or not) or the squared error (gaussian). The path goes
    from the smallest penalty under which all weights are 0 down to a hundredth of it. Columns are scaled by their spread over all
    rows, weights are for the columns as given; feature -1 is the intercept. Scores are compared in STEPS steps, those of one step count
    half. Rows with a null label, a null or non-finite feature, or no features don't count; rows must be of one width, MAX_WIDTH at most.
    Gaussian nets need one pass over the rows, whatever the folds and penalties; see ``_logistic_path`` for the others.
    """
    if family not in ("binomial", "gaussian"):
        raise ValueError(f"no such family: {family}")
    spark = df.sparkSession
    y = F.col(label).cast("double")
    x = F.col(features).cast("array<double>")
    fine = y.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = settled(with_folds(df.select(key, (F.when(y > 0, 1.0).otherwise(0.0) if family == "binomial" else y).alias("y"), x.alias("x")).where(fine), key, folds, seed).select("fold", "y", "x"))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "lambda double, fold int, metric double"), spark.createDataFrame([], "lambda double, feature int, weight double")
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features, more than {MAX_WIDTH}")
    sums = np.zeros((folds, width + 2, width + 2))
    for r in _fold_products(rows).collect():
        sums[r["fold"]] = np.array(r["s"]).reshape(width + 2, width + 2)
    total = sums.sum(axis=0)
    path = np.array(sorted(lambdas, reverse=True), float) if lambdas else None
    if family == "gaussian":
        if path is None:
            whole = FoldSums(sums, alpha)
            path = lambda_path(whole.part(total)[1] / total[-1, -1], n_lambdas, alpha=alpha)
        metrics, weights = _gaussian_path(sums, path, alpha)
    elif 0 < total[width, -1] < total[-1, -1]:
        path, metrics, weights = _logistic_path(rows, total, path, n_lambdas, alpha, folds)
    else:  # one class only: nothing to tell apart
        path, metrics, weights = np.zeros(0), [], np.zeros((width + 1, 0))
    made = [(float(lam), i if i < width else -1, float(w)) for lam, column in zip(path, weights.T, strict=True) for i, w in enumerate(column) if w or i == width]
    return spark.createDataFrame(metrics, "lambda double, fold int, metric double"), spark.createDataFrame(made, "lambda double, feature int, weight double")


def cross_validated(df: DataFrame, key: str, features: str, label: str, lambdas: list[float] | None = None, **how) -> DataFrame:
    """(lambda, fold, metric) of ``regularised_path``."""
    return regularised_path(df, key, features, label, lambdas=lambdas, **how)[0]


def chosen_lambda(metrics: DataFrame, larger_is_better: bool = True) -> DataFrame:
    """(rule, lambda): ``best``, and ``1se``: the largest lambda within a standard error of the best."""
    sign = 1 if larger_is_better else -1
    by = metrics.groupBy("lambda").agg((F.avg("metric") * sign).alias("mean"), (F.stddev_samp("metric") / F.sqrt(F.count("*"))).alias("se"))
    best = by.agg(F.max_by(F.struct("lambda", "mean", "se"), F.struct("mean", "lambda")).alias("b"))
    within = by.crossJoin(F.broadcast(best)).where(F.col("mean") >= F.col("b.mean") - F.coalesce(F.col("b.se"), F.lit(0.0)))
    return best.select(F.lit("best").alias("rule"), F.col("b.lambda").alias("lambda")).union(within.agg(F.max("lambda").alias("lambda")).select(F.lit("1se").alias("rule"), "lambda"))


def elastic_net(x: np.ndarray, y: np.ndarray, lam: float, alpha: float = 0.5, rounds: int = 200) -> np.ndarray:
    """Coordinate descent on scaled columns; weights for the scaled columns."""
    n, p = x.shape
    w, r = np.zeros(p), y - y.mean()
    for _ in range(rounds):
        change = 0.0
        for j in range(p):
            old = w[j]
            rho = x[:, j] @ r / n + old
            w[j] = np.sign(rho) * max(abs(rho) - lam * alpha, 0) / (1 + lam * (1 - alpha))
            if w[j] != old:
                r -= x[:, j] * (w[j] - old)
                change = max(change, abs(w[j] - old))
        if change < 1e-6:
            break
    return w


def gram_net(gram: np.ndarray, cross: np.ndarray, lam: float, alpha: float = 0.5, rounds: int = 200, start: np.ndarray | None = None, free: int = 0) -> np.ndarray:
    """The weights of ``elastic_net`` from the columns' mean products alone: gram with each other, cross with y; from ``start`` on.

    The last ``free`` columns have no penalty. After a round over all columns those with a weight are settled before all are looked at again.
    """
    w = np.zeros(len(cross)) if start is None else start.copy()
    fit, diagonal, kept = gram @ w, np.diag(gram).copy(), len(w) - free

    def sweep(columns: np.ndarray) -> float:
        nonlocal fit
        change = 0.0
        for j in columns:
            old = w[j]
            rho = cross[j] - fit[j] + diagonal[j] * old
            own = lam if j < kept else 0.0
            below = diagonal[j] + own * (1 - alpha)
            new = math.copysign(max(abs(rho) - own * alpha, 0.0), rho) / below if below > 0 else 0.0
            if new != old:
                fit += gram[:, j] * (new - old)
                w[j] = new
                change = max(change, abs(new - old))
        return change

    for _ in range(rounds):
        if sweep(np.arange(len(w))) < 1e-6:
            break
        active = np.flatnonzero(w)
        for _ in range(rounds):
            if sweep(active) < 1e-6:
                break
    return w


def lambda_path(cross: np.ndarray, n: int, least: float = 0.01, alpha: float = 0.5) -> np.ndarray:
    """``n`` penalties from the smallest one under which every weight is 0 down to its ``least``-th part, in equal ratios."""
    top = max(float(np.abs(cross).max(initial=0.0)) / alpha, 1e-12)
    return top * np.power(least, np.arange(n) / max(n - 1, 1))


class FoldSums:
    """Products of (columns, y, 1) by fold, from which nets are fitted and judged on folds that they haven't seen."""

    def __init__(self, sums: np.ndarray, alpha: float) -> None:
        """``sums``: (folds, p + 2, p + 2); columns without spread are left out, others scaled by their spread over all rows."""
        self.sums, self.alpha, self.p = sums, alpha, sums.shape[1] - 2
        c = self.centred(total := sums.sum(axis=0))
        self.n = total[-1, -1]
        sd = np.sqrt(np.maximum(np.diag(c)[: self.p], 0) / max(self.n, 1))
        self.used = np.flatnonzero(sd > 1e-9)
        self.sd, self.spread = sd[self.used], c[self.p, self.p]

    @staticmethod
    def centred(q: np.ndarray) -> np.ndarray:
        return (q - np.outer(q[:, -1], q[-1]) / max(q[-1, -1], 1))[:-1, :-1]

    def part(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """(gram, cross, square of y, rows) of the used columns in the rows that ``q`` sums."""
        at, scale = [*self.used, self.p], np.append(self.sd, 1.0)
        c = self.centred(q)[np.ix_(at, at)] / np.outer(scale, scale)
        return c[:-1, :-1], c[:-1, -1], float(c[-1, -1]), float(q[-1, -1])

    def nets(self, q: np.ndarray, lambdas: np.ndarray) -> list[np.ndarray]:
        """Weights for each penalty, the largest first, each from the one before on."""
        gram, cross, _, n = self.part(q)
        out, w = [], None
        for lam in lambdas:
            w = gram_net(gram / max(n, 1), cross / max(n, 1), lam, self.alpha, start=w)
            out.append(w)
        return out

    def correlation(self, w: np.ndarray, q: np.ndarray) -> float:
        gram, cross, yy, _ = self.part(q)
        var = float(w @ gram @ w)
        return float(w @ cross) / math.sqrt(var * yy) if var > 1e-12 and yy > 1e-12 else 0.0

    def chosen(self, folds: list[int], lambdas: np.ndarray) -> tuple[int, float]:
        """(place of the penalty, r2): the largest correlation of y with the predictions on the left-out fold, over all ``folds`` together."""
        total = self.sums[folds].sum(axis=0)
        top, var, yy = np.zeros(len(lambdas)), np.zeros(len(lambdas)), 0.0
        for f in folds:
            gram, cross, own, _ = self.part(self.sums[f])
            yy += own
            for i, w in enumerate(self.nets(total - self.sums[f], lambdas)):
                top[i] += w @ cross
                var[i] += w @ gram @ w
        r = np.where((var > 1e-12) & (yy > 0), top / np.sqrt(np.maximum(var * yy, 1e-300)), 0.0)
        r2 = np.maximum(r, 0) ** 2
        return int(r2.argmax()), float(r2.max())


#: Numbers of the products that a worker holds before it hands them on.
HELD_SUMS = 8_000_000


def snp_models(rows: DataFrame, locus: str = "locus", lambdas: tuple[float, ...] | None = None, folds: int = 5, n_lambdas: int = 20, alpha: float = 0.5) -> DataFrame:
    """(locus, variant, weight, cv_r2, n_snps, nested_r2, nested_p) from (locus, sample, y, variant, dosage): an elastic net for each locus.

    The penalty is the one of largest cross-validated correlation on a path of ``n_lambdas`` (or of ``lambdas``). The performance is
    nested: each fold is predicted by a net whose penalty was chosen on the other folds; nested_r2 is the mean of the squared
    correlations and nested_p the two-sided tail of their summed Fisher z values. Missing dosages count as the variant's mean.

    A sample is one vector a locus. Every partition sums the products of its vectors by fold, loci one after the other; these sums,
    the square of a locus's variants in size, are merged as a tree, and a locus's task gets nothing else. A cis window is
    bounded by the genome, so its variants are too.
    """
    kind, locus_kind = rows.schema["variant"].dataType.simpleString(), rows.schema[locus].dataType.simpleString()
    variants = rows.groupBy(locus, "variant").agg(F.avg("dosage").alias("m"))
    variants = variants.withColumns({"j": F.row_number().over(Window.partitionBy(locus).orderBy("variant")) - 1, "p": F.count("*").over(Window.partitionBy(locus))})
    x = rows.join(variants, [locus, "variant"])
    item = F.when(F.col("dosage").isNotNull(), F.struct("j", (F.col("dosage") - F.col("m")).alias("x")))
    vectors = x.groupBy(locus, "sample").agg(F.collect_list(item).alias("items"), F.max("y").cast("double").alias("y"), F.max("p").cast("int").alias("p")).where("y is not null")
    vectors = vectors.select(F.col(locus).alias("locus"), F.pmod(F.xxhash64("sample"), F.lit(folds)).cast("int").alias("fold"), "y", "p", F.transform("items", lambda i: i.j).alias("j"), F.transform("items", lambda i: i.x).alias("x"))

    def summed(batches):
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def told():
            part = TaskContext.get().partitionId()
            return pd.DataFrame([(*key, part, s.ravel()) for key, s in held.items()], columns=["locus", "fold", "part", "s"])

        for batch in batches:
            for (name, fold), own in batch.groupby(["locus", "fold"], sort=False):
                p = int(own.p.iloc[0])
                v = np.zeros((len(own), p + 2))
                at = np.repeat(np.arange(len(own)), own.j.str.len())
                if len(at):
                    np.add.at(v, (at, np.concatenate(own.j.to_numpy()).astype(int)), np.concatenate(own.x.to_numpy()))
                v[:, p], v[:, p + 1] = own.y, 1
                if (name, fold) not in held:
                    if size > HELD_SUMS:
                        yield told()
                        held, size = {}, 0
                    held[name, fold] = np.zeros((p + 2, p + 2))
                    size += (p + 2) ** 2
                held[name, fold] += v.T @ v
        if held:
            yield told()

    parts = vectors.sortWithinPartitions("locus").mapInPandas(summed, f"locus {locus_kind}, fold int, part long, s array<double>")
    names_ = variants.groupBy(F.col(locus).alias("locus")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.col("variant").cast("string").alias("v")))), lambda i: i.v).alias("names"))

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        names = list(own.names.iloc[0])
        p = len(names)
        sums = np.zeros((folds, p + 2, p + 2))
        for fold, s in zip(own.fold, own.s, strict=True):
            sums[fold] = np.array(s).reshape(p + 2, p + 2)
        found = FoldSums(sums, alpha)
        out = pd.DataFrame({locus: own.locus.iloc[0], "variant": names, "weight": 0.0, "cv_r2": np.nan, "n_snps": len(found.used), "nested_r2": np.nan, "nested_p": np.nan})
        if found.n < 2 * folds or not len(found.used) or found.spread <= 1e-12:
            return out
        every = list(range(folds))
        path = lambda q: np.array(sorted(lambdas, reverse=True)) if lambdas else lambda_path(found.part(q)[1] / max(q[-1, -1], 1), n_lambdas, alpha=alpha)
        total = sums.sum(axis=0)
        best, r2 = found.chosen(every, path(total))
        weights = np.zeros(p)
        weights[found.used] = found.nets(total, path(total)[: best + 1])[-1] / found.sd
        squares, z = [], []
        for f in every:
            rest = [g for g in every if g != f]
            inner = path(sums[rest].sum(axis=0))
            at, _ = found.chosen(rest, inner)
            r = found.correlation(found.nets(sums[rest].sum(axis=0), inner[: at + 1])[-1], sums[f])
            squares.append(r * r)
            z.append(math.atanh(min(max(r, -1 + 1e-12), 1 - 1e-12)) * math.sqrt(max(sums[f][-1, -1] - 3, 0)))
        return out.assign(weight=weights, cv_r2=r2, nested_r2=float(np.mean(squares)), nested_p=math.erfc(abs(sum(z)) / math.sqrt(folds) / math.sqrt(2)))

    gathered = tree_sum(parts, ["locus", "fold"]).join(names_, "locus")
    made = gathered.groupBy("locus").applyInPandas(fit, f"{locus} {locus_kind}, variant string, weight double, cv_r2 double, n_snps int, nested_r2 double, nested_p double")
    return made.withColumn("variant", F.col("variant").cast(kind))


def heritability_fit(values: np.ndarray, squares: np.ndarray, legacy: bool = False, nodes: np.ndarray | None = None, weights: np.ndarray | None = None) -> dict:
    """Largest likelihood of h2 on [.01, .99] given the eigenvalues and the squared projections of y; se and p from its curvature.

    With ``nodes`` and ``weights`` the sum over all eigenvalues is taken from that quadrature, and ``values`` are those of ``squares`` alone.
    """
    every, how_many = (values, np.ones(len(values))) if nodes is None else (nodes, weights)

    def loglik(h: float) -> float:
        return float(-0.5 * (how_many * np.log(h * every + 1 - h)).sum() - 0.5 * (squares / (h * values + 1 - h)).sum())

    low, high, g = 0.01, 0.99, (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = loglik(a), loglik(b)
    for _ in range(60):
        if fa >= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = loglik(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = loglik(b)
    h, step = (low + high) / 2, 0.01
    bend = (loglik(min(h + step, 0.999)) - 2 * loglik(h) + loglik(max(h - step, 0.001))) / ((4 if legacy else 1) * step**2)
    se = math.sqrt(-1 / bend) if bend < 0 else None
    return {"h2": h, "loglik": loglik(h), "se": se, "p": math.erfc(abs(h / se) / math.sqrt(2)) if se else None}


#: Samples of a relationship matrix that is diagonalised in one task at most; larger ones are never whole anywhere.
MAX_SAMPLES = 2_000


def diagonalised(grm: DataFrame, by: list[str]) -> DataFrame:
    """(by..., id, place, value, loading): eigenvalues and eigenvectors of each matrix (by..., id1, id2, value), id1 <= id2.

    A matrix has MAX_SAMPLES samples at most, or the job fails; this is the one step in which it is whole.
    """
    kind = grm.schema["id1"].dataType.simpleString()
    kinds = "".join(f"{c} {grm.schema[c].dataType.simpleString()}, " for c in by)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(own.id1) | set(own.id2))
        if len(ids) > MAX_SAMPLES:
            raise ValueError(f"a relationship matrix has {len(ids)} samples, more than {MAX_SAMPLES}")
        at = {v: i for i, v in enumerate(ids)}
        k = np.zeros((len(ids), len(ids)))
        i, j = own.id1.map(at).to_numpy(int), own.id2.map(at).to_numpy(int)
        k[i, j] = k[j, i] = own.value.to_numpy()
        values, vectors = np.linalg.eigh(k)
        n = len(ids)
        return pd.DataFrame({**{c: own[c].iloc[0] for c in by}, "id": np.repeat(np.array(ids, object), n), "place": np.tile(np.arange(n), n), "value": np.tile(np.maximum(values, 0), n), "loading": vectors.ravel()})

    own_key = grm if by else grm.withColumn("__one", F.lit(1))
    return own_key.groupBy(*(by or ["__one"])).applyInPandas(fit, f"{kinds}id {kind}, place int, value double, loading double")


#: Samples of a tile, steps of the Lanczos recursions, random vectors that stand for the trace, columns that go through them at once.
ROWS, LANCZOS, PROBES, COLUMNS = 512, 30, 30, 64


def quadratures(matrix: DataFrame, columns: DataFrame, n_columns: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """{(group, column): (nodes, weights)}: Gauss quadratures of x' f(K) x for each group's matrix and each of its start vectors.

    matrix(g, t, u, i, j, v): tiles of K, cell (i, j) of tile (t, u), both halves; columns(g, t, x): the start vectors' rows t * ROWS.. as a
    flat array of ROWS times n_columns. All recursions of all groups go on together: a step multiplies tiles by the vectors' tiles where
    they meet, sums products by tile as a tree, and takes two sums a column. Vectors stay in Spark, tile by tile; what
    reaches the driver is these sums.
    """
    spark = matrix.sparkSession
    shape = (ROWS, n_columns)

    def product(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, y = np.array(r.x).reshape(shape), np.zeros(shape)
                np.add.at(y, np.array(r.i), np.array(r.v)[:, None] * x[np.array(r.j)])
                out.append((r.g, r.t, r.u, y.ravel()))
            yield pd.DataFrame(out, columns=["g", "t", "u", "s"])

    def dots(rows: DataFrame, *pairs: tuple[str, str]) -> dict[int, np.ndarray]:
        """For each group the sums of the products of two columns of vectors, a row for each pair."""

        def run(batches):
            held = {}
            for batch in batches:
                for r in batch.itertuples(index=False):
                    s = np.concatenate([(as_tile(getattr(r, a)) * as_tile(getattr(r, b))).sum(axis=0) for a, b in pairs])
                    held[r.g] = held[r.g] + s if r.g in held else s
            if held:
                yield pd.DataFrame({"g": list(held), "part": TaskContext.get().partitionId(), "s": list(held.values())})

        made = rows.select("g", *{c for pair in pairs for c in pair}).mapInPandas(run, "g long, part long, s array<double>")
        return {r["g"]: np.array(r["s"]).reshape(len(pairs), -1) for r in tree_sum(made, ["g"]).collect()}

    def combined(rows: DataFrame, make) -> DataFrame:
        """(g, t, x, old) from each tile row."""

        def run(batches):
            for batch in batches:
                out = [(r.g, r.t, *(v.ravel() for v in make(r))) for r in batch.itertuples(index=False)]
                yield pd.DataFrame(out, columns=["g", "t", "x", "old"])

        return rows.mapInPandas(run, "g long, t long, x array<double>, old array<double>")

    as_tile = lambda v: np.array(v).reshape(shape)
    norm = {g: np.sqrt(s[0]) for g, s in dots(columns, ("x", "x")).items()}
    live = {g: s > 0 for g, s in norm.items()}
    first = {g: np.where(live[g], 1 / np.where(live[g], s, 1), 0) for g, s in norm.items()}
    vectors = combined(columns, lambda r: (as_tile(r.x) * first[r.g], np.zeros(shape)))
    beta = {g: np.zeros(n_columns) for g in norm}
    alphas, betas = [], []
    for _ in range(LANCZOS):
        met = matrix.join(vectors.select("g", F.col("t").alias("u"), "x"), ["g", "u"]).select("g", "t", "u", "i", "j", "v", "x")
        w = tree_sum(met.mapInPandas(product, "g long, t long, u long, s array<double>"), ["g", "t"], part="u")
        rows = settled(vectors.join(w, ["g", "t"], "left").withColumn("s", F.coalesce("s", F.transform("x", lambda _: F.lit(0.0)))))
        sums = dots(rows, ("x", "s"), ("s", "s"))
        alpha, before = {g: s[0] for g, s in sums.items()}, beta
        # the vectors of a recursion are at right angles, so what is left of K x has this square
        square = {g: s[1] - alpha[g] ** 2 - before[g] ** 2 for g, s in sums.items()}
        live = {g: live[g] & (square[g] > 1e-10 * np.maximum(sums[g][1], 1e-300)) for g in square}
        beta = {g: np.sqrt(np.where(live[g], x, 0.0)) for g, x in square.items()}
        alphas.append(alpha)
        betas.append(beta)
        if not any(x.any() for x in live.values()):
            break
        over = {g: np.where(live[g], 1 / np.where(live[g], b, 1), 0) for g, b in beta.items()}

        def advanced(r, alpha=alpha, before=before, over=over):
            return (as_tile(r.s) - alpha[r.g] * as_tile(r.x) - before[r.g] * as_tile(r.old)) * over[r.g], as_tile(r.x)

        vectors = combined(rows, advanced)
    out = {}
    for g, size in norm.items():
        for c in range(n_columns):
            b = [x[g][c] for x in betas]
            m = next((i + 1 for i, x in enumerate(b) if x == 0), len(b))
            values, vectors_ = np.linalg.eigh(np.diag([a[g][c] for a in alphas[:m]]) + np.diag(b[: m - 1], 1) + np.diag(b[: m - 1], -1))
            out[g, c] = np.maximum(values, 0), vectors_[0] ** 2 * size[c] ** 2
    return out


def _fitted_by_quadrature(scaled: DataFrame, matrix: DataFrame, people: DataFrame, by: list[str], legacy: bool) -> DataFrame:
    """(by..., h2, loglik, se, p, error) of matrices that are too large for one task: see ``quadratures``. scaled(by..., id, y) has all of ``people``."""
    spark, outer, trait = scaled.sparkSession, by[:-1], by[-1]
    kinds = ", ".join(f"{c} {scaled.schema[c].dataType.simpleString()}" for c in by)
    groups = people.select(*outer).distinct().toPandas() if outer else None  # a row for each matrix
    numbers = spark.createDataFrame(groups.assign(g=range(len(groups))), people.select(*outer, F.lit(0).cast("long").alias("g")).schema) if outer else None
    placed = people.join(F.broadcast(numbers), outer) if outer else people.withColumn("g", F.lit(0).cast("long"))
    placed = settled(numbered(placed.select("g", "id"), ["g", "id"], "n"))
    first = placed.groupBy("g").agg(F.min("n").alias("f"), F.count("*").alias("size"))
    sizes = {r["g"]: r["size"] for r in first.collect()}
    at = settled(placed.join(F.broadcast(first), "g").select("g", "id", F.floor((F.col("n") - F.col("f")) / ROWS).cast("long").alias("t"), ((F.col("n") - F.col("f")) % ROWS).cast("int").alias("i")))
    known = matrix.join(F.broadcast(numbers), outer) if outer else matrix.withColumn("g", F.lit(0).cast("long"))
    cells = known.join(at.withColumnsRenamed({"id": "id1"}), ["g", "id1"]).join(at.select("g", F.col("id").alias("id2"), F.col("t").alias("u"), F.col("i").alias("j")), ["g", "id2"])
    halves = cells.select("g", "t", "u", "i", "j", "value").unionByName(cells.where("id1 <> id2").select("g", F.col("u").alias("t"), F.col("t").alias("u"), F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    # a tile has ROWS squared cells at most
    pick = lambda name: F.transform("c", lambda x: x[name])
    tiles = settled(halves.groupBy("g", "t", "u").agg(F.collect_list(F.struct("i", "j", "value")).alias("c")).select("g", "t", "u", pick("i").alias("i"), pick("j").alias("j"), pick("value").alias("v")))
    traits = [r[0] for r in scaled.select(trait).distinct().orderBy(trait).collect()]  # the phenotypes' names
    wanted = {tuple(r) for r in (scaled.join(F.broadcast(numbers), outer) if outer else scaled.withColumn("g", F.lit(0).cast("long"))).select("g", trait).distinct().collect()}
    found: dict[int, list] = {}
    out = []
    for start in range(0, len(traits), COLUMNS):
        own = traits[start : start + COLUMNS]
        probes = PROBES if not start else 0
        y = scaled.where(F.col(trait).isin(own))
        y = y.join(F.broadcast(numbers), outer) if outer else y.withColumn("g", F.lit(0).cast("long"))
        names = F.array_position(F.array([F.lit(v) for v in own]), F.col(trait)).cast("int") - 1
        values = y.select("g", "id", names.alias("c"), "y")
        if probes:
            signs = at.select("g", "id", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("r"))
            values = values.unionByName(signs.select("g", "id", (F.col("r") + len(own)).cast("int").alias("c"), F.when(F.xxhash64("g", "id", "r", F.lit("sign")) % 2 == 0, 1.0).otherwise(-1.0).alias("y")))
        width = len(own) + probes
        cells_ = values.join(at, ["g", "id"]).groupBy("g", "t").agg(F.collect_list(F.struct((F.col("i") * width + F.col("c")).alias("k"), "y")).alias("v"))

        def flat(batches):
            for batch in batches:
                rows = []
                for r in batch.itertuples(index=False):
                    x = np.zeros(ROWS * width)  # noqa: B023
                    for e in r.v:
                        x[e["k"]] = e["y"]
                    rows.append((r.g, r.t, x))
                yield pd.DataFrame(rows, columns=["g", "t", "x"])

        got = quadratures(tiles, settled(cells_.mapInPandas(flat, "g long, t long, x array<double>")), width)
        for g, n in sizes.items():
            if probes:
                found[g] = [np.concatenate([got[g, c][i] for c in range(len(own), width)]) for i in (0, 1)]
                found[g][1] = found[g][1] / found[g][1].sum() * n
            for c, name in enumerate(own):
                if (g, name) in wanted:
                    fit = heritability_fit(*got[g, c], legacy, *found[g])
                    out.append((*(groups.iloc[g].tolist() if outer else ()), name, fit["h2"], fit["loglik"], fit["se"], fit["p"], None))
    return spark.createDataFrame(out, f"{kinds}, h2 double, loglik double, se double, p double, error string")


def heritability(phenotypes: DataFrame, grm: DataFrame, by: list[str], scale: bool = True, legacy: bool = False) -> DataFrame:
    """(by..., h2, loglik, se, p, error) for phenotypes(by..., id, y) and grm(by[:-1]..., id1, id2, value), id1 <= id2.

    ``by`` ends with the phenotype, and what stands before it (a chromosome) has a matrix of its own; pairs that it leaves out are 0. A
    matrix of MAX_SAMPLES samples or fewer is diagonalised once, in a task; phenotypes are projected on its vectors by a join and
    a grouping, and each is fitted in a task of its own. Of larger ones only products with vectors are taken, tile by tile
    (``quadratures``): the form in y by Lanczos recursions from it, the determinant by random vectors. Samples that only one side
    has don't count; failed fits give nulls and a message.
    """
    outer = by[:-1]
    phenotypes = settled(phenotypes)
    both = phenotypes.select("id").distinct()
    matrix = settled(grm.join(both.withColumnRenamed("id", "id1"), "id1", "left_semi").join(both.withColumnRenamed("id", "id2"), "id2", "left_semi"))
    people = settled(matrix.select(*outer, F.col("id1").alias("id")).union(matrix.select(*outer, F.col("id2").alias("id"))).distinct())
    size = people.groupBy(*outer).agg(F.count("*").alias("n"))
    known = phenotypes.join(people, [*outer, "id"], "left_semi")
    finite = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))
    stats = known.groupBy(*by).agg(F.count_if(finite).alias("own"), F.avg(F.when(finite, F.col("y"))).alias("m"), F.stddev_samp(F.when(finite, F.col("y"))).alias("s"))
    stats = stats.join(size, outer) if outer else stats.crossJoin(F.broadcast(size))
    fine = (F.col("own") == F.col("n")) & (F.col("n") >= 3) & (F.col("s") > 0)
    judged = phenotypes.select(*by).distinct().join(stats.withColumn("fine", fine), by, "left")
    y = (F.col("y") - F.col("m")) / F.col("s") if scale else F.col("y")
    scaled = known.join(judged.where("fine"), by).select(*by, "id", y.alias("y"), "n")
    kinds = ", ".join(f"{c} {phenotypes.schema[c].dataType.simpleString()}" for c in by)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        row = {c: own[c].iloc[0] for c in by}
        try:
            row |= heritability_fit(own.value.to_numpy(float), own.square.to_numpy(float), legacy) | {"error": None}
        except Exception as e:  # noqa: BLE001  a failed model is a result here
            row |= {"h2": None, "loglik": None, "se": None, "p": None, "error": str(e)}
        return pd.DataFrame([row], columns=[*by, "h2", "loglik", "se", "p", "error"])

    def of(df: DataFrame, large: bool) -> DataFrame:
        """The rows of large matrices, or of the others."""
        some = size.where(F.col("n") > MAX_SAMPLES if large else F.col("n") <= MAX_SAMPLES)
        return df.join(F.broadcast(some.select(*outer)), outer, "left_semi") if outer else df.join(F.broadcast(some.select(F.lit(1).alias("one"))), F.lit(True), "left_semi")

    parts = []
    counts = size.agg(F.count_if(F.col("n") <= MAX_SAMPLES), F.count_if(F.col("n") > MAX_SAMPLES)).first()
    if counts[0]:
        vectors = settled(diagonalised(of(matrix, False), outer))
        square = F.sum(F.col("y") * F.col("loading"))
        projected = scaled.where(F.col("n") <= MAX_SAMPLES).join(vectors, [*outer, "id"]).groupBy(*by, "place").agg(F.first("value").alias("value"), (square * square).alias("square"))
        parts.append(projected.groupBy(*by).applyInPandas(fit, f"{kinds}, h2 double, loglik double, se double, p double, error string"))
    if counts[1]:
        parts.append(_fitted_by_quadrature(settled(scaled.where(F.col("n") > MAX_SAMPLES).select(*by, "id", "y")), of(matrix, True), of(people, True), by, legacy))
    none = F.lit(None).cast("double")
    failed = judged.where(~F.coalesce("fine", F.lit(False))).select(*by, none.alias("h2"), none.alias("loglik"), none.alias("se"), none.alias("p"), F.lit("the phenotype is constant or has nulls").alias("error"))
    return reduce(DataFrame.unionByName, [*parts, failed])
