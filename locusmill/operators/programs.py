"""Consensus programs: factorise many subsamples of a matrix, cluster the factors, score loci by cluster."""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from locusmill.functions.normal_means import FAMILIES, LEAST, estimated, relative_entropy
from locusmill.operators.rows import numbered, settled
from locusmill.operators.sums import tree_sum


def subsamples(rows: DataFrame, key: str, n_iter: int, fraction: float = 0.8, seed: int = 1) -> DataFrame:
    """(iter, key): exactly round(fraction * n) rows in each iteration, by a seeded hash order.

    All iterations have the same ids, so a row's place in its iteration follows from its place in the whole order, which is taken in
    range partitions.
    """
    ids = rows.select(key).distinct()
    n = ids.count()
    each = ids.crossJoin(F.broadcast(ids.sparkSession.range(n_iter).withColumnRenamed("id", "iter"))).withColumn("__h", F.xxhash64(F.col(key), F.col("iter"), F.lit(seed)))
    placed = numbered(each, ["iter", "__h", key], "__n")
    return placed.where((F.col("__n") - 1) % max(n, 1) < int(n * fraction + 0.5)).select("iter", key)


#: Loadings are settled in so many rounds over the factors of a row; sweeps for a new factor, and for all at the end; the gain that ends them.
CYCLES, GREEDY_SWEEPS, BACKFIT_SWEEPS, GAIN = 6, 6, 10, 1e-5
#: Bytes of the factors that are sent out at once; more subsamples go in blocks.
STATE_BYTES = 64_000_000


def _families(prior: str) -> tuple[str, str]:
    """``loadings/factors``, or one family for both."""
    own = tuple(prior.split("/")) if "/" in prior else (prior, prior)
    if len(own) != 2 or not set(own) <= set(FAMILIES):
        raise ValueError(f"no such prior: {prior}")
    return own


def _loadings(x: np.ndarray, state: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """First and second moments of the rows' loadings under the state, the sums that renew their priors, and their relative entropy."""
    f, k = state["f"], state["f"].shape[1]
    inner, own = f.T @ f, FAMILIES[state["families"][0]]
    size = state["f2"].sum(axis=0)
    top = x @ f
    mean = np.linalg.solve(inner + np.diag(size - np.diag(inner) + state["var"] / np.maximum(state["square"], LEAST)), top.T).T
    if own.positive:
        mean = np.maximum(mean, 0)
    second = mean * mean
    sums, entropy = [np.zeros(0)] * k, [0.0] * k
    for _ in range(CYCLES):
        for j in range(k):
            s = np.sqrt(state["var"] / size[j])
            seen = (top[:, j] - mean @ inner[:, j] + mean[:, j] * inner[j, j]) / size[j]
            post = own.posterior(seen, s, state["prior_l"][j])
            mean[:, j], second[:, j], sums[j] = post.mean, post.second, post.sums
            entropy[j] = relative_entropy(post, seen, s)
    return mean, second, sums, float(sum(entropy))


def _with_factor(judged: dict, gram: np.ndarray, total: np.ndarray) -> dict:
    """The factors of a judged state and one more: the first direction of what is left of the rows, whose products are ``gram``, sums ``total``.

    Until a prior is fitted to the new factor the state has no evidence (minus infinity).
    """
    f, xl, ll = judged["f"], judged["xl"], judged["ll"]
    rest, mean = gram - xl @ f.T - f @ xl.T + f @ ll @ f.T, total - f @ judged["l_sum"]
    v = rest[:, int(np.diag(rest).argmax())].copy()
    for _ in range(100):
        v = rest @ v
        v /= max(np.linalg.norm(v), LEAST)
    if v @ mean < 0:
        v = -v
    first, second = (FAMILIES[x] for x in judged["families"])
    if second.positive:
        v = max(np.maximum(v, 0), np.maximum(-v, 0), key=np.linalg.norm)
        v /= max(np.linalg.norm(v), LEAST)
    square = max(float(v @ rest @ v), LEAST * judged["squares"]) / judged["n"]
    left = max(float(np.trace(rest)) - square * judged["n"], 1e-9 * judged["squares"])
    return {
        "families": judged["families"], "n": judged["n"], "squares": judged["squares"], "var": left / (judged["n"] * len(v)),
        "f": np.column_stack([f, v]), "f2": np.column_stack([judged["f2"], v * v + LEAST]), "entropy_f": [*judged["entropy_f"], -np.inf], "square": np.append(judged["square"], square),
        "prior_l": [*judged["prior_l"], first.start(square)], "prior_f": [*judged["prior_f"], second.start(float((v * v).mean()))],
    }


def _judged(state: dict, sums: np.ndarray) -> dict:
    """The state with its evidence bound, its factors' shares and the sums over all rows of the subsample."""
    f, f2 = state["f"], state["f2"]
    (p, k), n = f.shape, state["n"]
    xl, ll, l_sum, entropy, by_prior = np.split(sums, np.cumsum([p * k, k * k, k, 1]))
    out = state | {"xl": xl.reshape(p, k), "ll": ll.reshape(k, k), "l_sum": l_sum, "by_prior": by_prior.reshape(k, -1)}
    share = np.diag(out["ll"]) * f2.sum(axis=0)
    evidence = -0.5 * n * p * np.log(2 * np.pi * state["var"]) - _misfit(out, f, f2) / (2 * state["var"]) + float(entropy[0]) + sum(state["entropy_f"])
    return out | {"evidence": evidence, "pve": share / (share.sum() + n * p * state["var"])}


def _misfit(judged: dict, f: np.ndarray, f2: np.ndarray) -> float:
    """Expected sum of squares of what the factors leave."""
    inner = f.T @ f
    np.fill_diagonal(inner, f2.sum(axis=0))
    return max(float(judged["squares"] - 2 * (judged["xl"] * f).sum() + (judged["ll"] * inner).sum()), 1e-9 * judged["squares"])


def _improved(judged: dict) -> dict:
    """The next state: each factor's posterior under a prior fitted to it, the loadings' priors, the residual variance."""
    f, f2, xl, ll, n = judged["f"].copy(), judged["f2"].copy(), judged["xl"], judged["ll"], judged["n"]
    entropies, priors = list(judged["entropy_f"]), list(judged["prior_f"])
    for j in range(f.shape[1]):
        if ll[j, j] <= LEAST * judged["squares"]:
            continue  # the factor has no loadings
        seen, s = (xl[:, j] - f @ ll[:, j] + f[:, j] * ll[j, j]) / ll[j, j], float(np.sqrt(judged["var"] / ll[j, j]))
        priors[j], post = estimated(judged["families"][1], seen, s, priors[j])
        f[:, j], f2[:, j] = post.mean, np.maximum(post.second, post.mean**2 + LEAST)
        entropies[j] = relative_entropy(post, seen, s)
    own = FAMILIES[judged["families"][0]]
    prior_l = [own.renewed(sums, n, prior) for sums, prior in zip(judged["by_prior"], judged["prior_l"], strict=True)]
    return {
        "families": judged["families"], "n": n, "squares": judged["squares"], "f": f, "f2": f2, "entropy_f": entropies, "prior_f": priors, "prior_l": prior_l,
        "square": np.maximum(np.diag(ll) / n, LEAST**2), "var": _misfit(judged, f, f2) / (n * len(f)),
    }


def _next(run: dict, sums: np.ndarray, gram: np.ndarray, total: np.ndarray, most: int) -> dict:
    """A run after a sweep. Its ``best`` is the last state that was judged: a sweep that lowers the evidence is taken back and ends
    its stage, so evidence never falls. A stage fits a number of factors (trace: stage, evidence); the last one fits all again."""
    judged, best = _judged(run["now"], sums), run["best"]
    fell = best is not None and judged["evidence"] < best["evidence"]
    small = best is not None and np.isfinite(best["evidence"]) and judged["evidence"] - best["evidence"] <= GAIN * abs(best["evidence"])
    stage, sweeps, trace = run["stage"], run["sweeps"] + 1, run["trace"]
    if not fell:
        best, trace = judged, [*trace, (stage, judged["evidence"])] if np.isfinite(judged["evidence"]) else trace
    out = run | {"best": best, "sweeps": sweeps, "trace": trace}
    if not small and sweeps < (GREEDY_SWEEPS if stage else BACKFIT_SWEEPS):
        return out | {"now": _improved(best)}
    if not stage:
        return out | {"done": True}
    smaller = run["smaller"]
    if smaller is not None and best["evidence"] <= smaller["evidence"]:
        best = smaller  # the last factor wasn't worth it
    elif stage < most:
        return out | {"now": _with_factor(best, gram, total), "smaller": best, "best": None, "stage": stage + 1, "sweeps": 0}
    return out | {"now": _improved(best), "best": best, "stage": 0, "sweeps": 0}  # so its first sweep is held against ``best`` too


def _fit(rows: DataFrame, width: int, runs: dict[int, tuple[int, tuple[str, str]]], k: int) -> dict[int, dict]:
    """The final states of ``runs`` (number: subsample, families) over rows (l, iters, x); one job for each sweep of all runs together."""
    context = rows.sparkSession.sparkContext
    part = F.spark_partition_id().cast("long").alias("part")

    def sums_of(states: dict[int, dict]):
        def over(batches):
            held: dict[int, np.ndarray] = {}
            at = 0
            for batch in batches:
                if not len(batch):
                    continue
                x, at = np.stack(batch.x.to_numpy()), int(batch.part.iloc[0])
                member = {}
                for row, iters in enumerate(batch.iters):
                    for i in iters:
                        member.setdefault(int(i), []).append(row)
                for run, state in states.items():
                    own = member.get(runs[run][0])
                    if own is None:
                        continue
                    v = x[own]
                    if state is None:
                        s = np.concatenate([(v.T @ v).ravel(), v.sum(axis=0), [len(v)]])
                    else:
                        mean, second, by_prior, entropy = _loadings(v, state)
                        ll = mean.T @ mean
                        np.fill_diagonal(ll, second.sum(axis=0))
                        s = np.concatenate([(v.T @ mean).ravel(), ll.ravel(), mean.sum(axis=0), [entropy], *by_prior])
                    held[run] = held[run] + s if run in held else s
            if held:
                yield pd.DataFrame({"run": list(held), "part": at, "s": list(held.values())})

        return over

    def swept(states: dict[int, dict | None]) -> DataFrame:
        return tree_sum(rows.select("iters", "x", part).mapInPandas(sums_of(states), "run long, part long, s array<double>"), ["run"])

    by_iter = {i: run for run, (i, _) in reversed(runs.items())}  # one run of each subsample brings its products
    grams = {runs[r["run"]][0]: np.array(r["s"]) for r in swept({run: None for run in by_iter.values()}).collect()}
    products = {i: (g[: width * width].reshape(width, width), g[width * width : -1]) for i, g in grams.items()}
    states: dict[int, dict] = {}
    for run, (i, families) in runs.items():
        squares = float(np.trace(products[i][0])) if i in grams else 0.0
        if squares > 0:
            none = np.zeros((width, 0))
            empty = {"families": families, "n": float(grams[i][-1]), "squares": squares, "f": none, "f2": none, "xl": none, "ll": np.zeros((0, 0)), "l_sum": np.zeros(0), "entropy_f": [], "square": np.zeros(0), "prior_l": [], "prior_f": []}
            states[run] = {"now": _with_factor(empty, *products[i]), "best": None, "smaller": None, "stage": 1, "sweeps": 0, "trace": [], "done": False}
    products_sent = context.broadcast(products)
    while active := {run: s for run, s in states.items() if not s["done"]}:
        sent = context.broadcast(active)

        def renew(own: pd.DataFrame) -> pd.DataFrame:
            run = int(own.run.iloc[0])
            new = _next(sent.value[run], np.array(own.s.iloc[0]), *products_sent.value[runs[run][0]], k)  # noqa: B023
            return pd.DataFrame({"run": [run], "state": [pickle.dumps(new)]})

        light = {run: {c: s["now"][c] for c in LIGHT} for run, s in active.items()}
        new = swept(light).groupBy("run").applyInPandas(renew, "run long, state binary").collect()
        states |= {r["run"]: pickle.loads(r["state"]) for r in new}
        sent.destroy()
    products_sent.destroy()
    return states


#: What a state tells a row's loadings.
LIGHT = ("families", "f", "f2", "var", "square", "prior_l")


def factorised(cells: DataFrame, picks: DataFrame, locus: str, feature: str, value: str, k: int, priors: str | list[str] = "point_normal/point_exponential") -> DataFrame:
    """(prior, iter, kind, key, k, value, pve, evidence): empirical-Bayes factorisations of every subsample (iter, locus) of a matrix.

    x = L F' + noise of one variance. Loadings and factors have a prior family each (``loadings/factors``, of FAMILIES); its weights
    and scales are estimated for every factor, and ``value`` is a posterior mean (kind L, key the locus, or F, key the feature). Factors
    come one at a time, each from the first direction of what is left, as long as they raise the evidence bound, ``k`` at
    most; then all are fitted again together. ``evidence`` is the bound at the end; no sweep lowers it. pve is the factor's share.
    Missing cells count as 0; subsamples of zeros only have no factor. Several ``priors`` are fitted in the same sweeps.

    Rows are not copied for the subsamples: each knows those that it is in. A sweep is one job: every partition takes its rows'
    loadings and sums products of width times k, which are merged as a tree; a subsample's new factors come from its sums in a task
    of its own. The driver holds the factors of a block of subsamples (STATE_BYTES at most), never loadings.
    """
    wanted = [priors] if isinstance(priors, str) else list(priors)
    families = {p: _families(p) for p in wanted}
    spark = cells.sparkSession
    # the width of the matrix, which is bounded, as a row is one array
    wide = cells.groupBy(F.col(locus).alias("__l")).pivot(feature, sorted({r[0] for r in cells.select(feature).distinct().collect()})).agg(F.sum(value))
    names = [c for c in wide.columns if c != "__l"]
    x = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).cast("double") for c in names])
    inside = picks.groupBy(F.col(locus).alias("__l")).agg(F.collect_set(F.col("iter").cast("long")).alias("iters"))
    rows = settled(wide.select("__l", x.alias("x")).join(inside, "__l").select(F.col("__l").cast("string").alias("l"), "iters", "x"))
    iters = sorted(r[0] for r in rows.select(F.explode("iters").alias("i")).distinct().collect())  # a number for each subsample
    each = 8 * len(names) * (len(names) + 12 * k * len(wanted))
    block = max(1, STATE_BYTES // max(each, 1))
    out = []
    for at in range(0, len(iters), block):
        labels = [(p, i) for i in iters[at : at + block] for p in wanted]
        runs = {r: (i, families[p]) for r, (p, i) in enumerate(labels)}
        out.append((labels, runs, _fit(rows, len(names), runs, k)))
    parts = [_factor_rows(spark, rows, names, *own) for own in out]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FACTOR_ROWS)


FACTOR_ROWS = "prior string, iter bigint, kind string, key string, k int, value double, pve double, evidence double"


def _factor_rows(spark, rows: DataFrame, names: list[str], labels: list[tuple[str, int]], runs: dict, states: dict[int, dict]) -> DataFrame:
    """FACTOR_ROWS of a block: loadings from the rows, factors from the states."""
    best = {run: s["best"] for run, s in states.items()}
    sent = spark.sparkContext.broadcast({run: {c: s[c] for c in (*LIGHT, "pve", "evidence")} for run, s in best.items()})

    def final(batches):
        for batch in batches:
            x = np.stack(batch.x.to_numpy()) if len(batch) else None
            for run, state in sent.value.items():
                own = [row for row, iters in enumerate(batch.iters) if runs[run][0] in iters]
                if own:
                    mean = _loadings(x[own], state)[0]
                    n = mean.shape[1]
                    yield pd.DataFrame({"prior": labels[run][0], "iter": labels[run][1], "kind": "L", "key": np.repeat(batch.l.to_numpy()[own], n), "k": np.tile(np.arange(n), len(own)), "value": mean.ravel(), "pve": np.tile(state["pve"], len(own)), "evidence": state["evidence"]})

    made = [
        pd.DataFrame({"prior": labels[run][0], "iter": labels[run][1], "kind": "F", "key": np.repeat(names, s["f"].shape[1]), "k": np.tile(np.arange(s["f"].shape[1]), len(names)), "value": s["f"].ravel(), "pve": np.tile(s["pve"], len(names)), "evidence": s["evidence"]})
        for run, s in best.items()
    ]
    own_f = spark.createDataFrame(pd.concat(made, ignore_index=True), FACTOR_ROWS) if made else spark.createDataFrame([], FACTOR_ROWS)
    return rows.mapInPandas(final, FACTOR_ROWS).unionByName(own_f)


def normalised(factors: DataFrame, norm: str = "l2") -> DataFrame:
    """Loadings and factors divided by their norm in each (iter, k); ``d`` is the product of both norms, ``ld`` = loading * d."""
    x = F.col("value")
    sizes = {"l1": F.sum(F.abs(x)), "l2": F.sqrt(F.sum(x * x)), "linf": F.max(F.abs(x))}
    if norm not in sizes:
        raise ValueError(f"no such norm: {norm}")
    own = factors.groupBy("iter", "k", "kind").agg(sizes[norm].alias("norm"))
    d = own.groupBy("iter", "k").agg(F.product("norm").alias("d"))
    out = factors.join(own, ["iter", "k", "kind"]).join(d, ["iter", "k"])
    scaled = F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))
    return out.select("iter", "k", "kind", "key", scaled.alias("value"), "d", F.when(F.col("kind") == "L", scaled * F.col("d")).alias("ld"))


def stacked(factors: DataFrame) -> DataFrame:
    """(program, feature, value): the factors of all iterations under names that are unique."""
    return factors.where("kind = 'F'").select(F.concat(F.lit("iter"), "iter", F.lit("_k"), "k").alias("program"), F.col("key").alias("feature"), "value")


def program_vectors(stack: DataFrame) -> DataFrame:
    """(program, vector): a program's values in order of the feature's name; all programs have all features, whose number is bounded."""
    return stack.groupBy("program").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("v")).select("program", F.transform("v", lambda x: x.value).alias("vector"))


#: Programs of a sample at most, samples for each k, programs whose silhouette is taken.
SAMPLE, DRAWS, JUDGED = 300, 10, 500


def medoids_of(d: np.ndarray, k: int) -> np.ndarray:
    """Rows of the distance matrix that are k medoids: picked greedily, then each swap that lowers the sum of distances most, until none does."""
    n, k = len(d), min(k, len(d))
    medoids = [int(d.sum(axis=1).argmin())]
    while len(medoids) < k:
        gain = np.maximum(d[:, medoids].min(axis=1)[:, None] - d, 0).sum(axis=0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    for _ in range(100 * k):
        by = d[:, medoids]
        near = by.argmin(axis=1)
        first = by[np.arange(n), near]
        second = np.partition(by, 1, axis=1)[:, 1] if k > 1 else np.full(n, np.inf)
        # swapping medoid m for h: all rows may come nearer to h; the rows of m lose m
        closer = np.minimum(d - first[:, None], 0)
        lost = np.minimum(d, second[:, None]) - first[:, None] - closer
        change = closer.sum(axis=0)[None, :] + np.stack([lost[near == m].sum(axis=0) for m in range(k)])
        change[:, medoids] = 0
        m, h = np.unravel_index(change.argmin(), change.shape)
        if change[m, h] >= -1e-9 * max(first.sum(), 1e-300):
            break
        medoids[m] = int(h)
    return np.array(sorted(medoids))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def medoids(vectors: DataFrame, ks: list[int], sample: int = SAMPLE, draws: int = DRAWS, seed: int = 1) -> dict[int, np.ndarray]:
    """For each k the medoids (k vectors) of least mean distance over all programs, out of ``draws`` bounded samples.

    A sample is the programs of lowest seeded hash, ``sample`` of them; if there are no more than that, the one sample is the whole. The
    medoids of each sample come from a task of their own; then every program is held against all candidates in one pass, which
    sums their distances by partition. Only candidates and sums reach the driver.
    """
    n = vectors.count()
    draws = draws if n > sample else 1
    hashed = reduce(DataFrame.unionByName, [vectors.withColumn("draw", F.lit(i)).orderBy(F.xxhash64("program", F.lit(seed), F.lit(i)), "program").limit(sample) for i in range(draws)])
    each = hashed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))

    def search(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("program", kind="stable")
        x = _stacked(own.vector)
        d = distances(x, x)
        np.fill_diagonal(d, 0)
        return pd.DataFrame({"k": own.k.iloc[0], "draw": own.draw.iloc[0], "vector": list(x[medoids_of(d, int(own.k.iloc[0]))])})

    found = each.groupBy("k", "draw").applyInPandas(search, "k int, draw int, vector array<double>").toPandas()  # draws * sum(ks) vectors
    candidates = {key: _stacked(own.vector) for key, own in found.groupby(["k", "draw"])}
    if draws == 1:
        return {k: candidates[k, 0] for k in ks if (k, 0) in candidates}
    sent = vectors.sparkSession.sparkContext.broadcast(candidates)

    def cost(batches):
        total = dict.fromkeys(sent.value, 0.0)
        for batch in batches:
            x = _stacked(batch.vector) if len(batch) else np.zeros((0, 1))
            for key, centres in sent.value.items():
                total[key] += distances(x, centres).min(axis=1).sum() if len(x) else 0.0
        yield pd.DataFrame([(*key, v) for key, v in total.items()], columns=["k", "draw", "cost"])

    costs = vectors.select("vector").mapInPandas(cost, "k int, draw int, cost double").groupBy("k", "draw").agg(F.sum("cost").alias("cost"))
    best = costs.groupBy("k").agg(F.min_by("draw", F.struct("cost", "draw")).alias("draw")).collect()
    return {r["k"]: candidates[r["k"], r["draw"]] for r in best}


def _assigned(vectors: DataFrame, centres: dict[int, np.ndarray], keep: list[str]) -> DataFrame:
    """(keep..., k, cluster): the nearest medoid of each program, the first of equally near ones."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*keep).schema)

    def run(batches):
        for batch in batches:
            for k, own in sent.value.items():
                if len(batch):
                    yield batch[keep].assign(k=k, cluster=distances(_stacked(batch.vector), own).argmin(axis=1))

    return vectors.select(*dict.fromkeys([*keep, "vector"])).mapInPandas(run, f"{kinds}, k int, cluster int")


def choose_k(vectors: DataFrame, ks: list[int], judged: int = JUDGED, seed: int = 1, **how) -> DataFrame:
    """(k, silhouette) of the clusterings around medoids: the mean over ``judged`` programs of lowest seeded hash (all, if there are no more).

    Each judged program's mean distance to every cluster is taken over all programs, in one pass for all ``ks``.
    """
    centres = medoids(vectors, ks, seed=seed, **how)
    few = vectors.orderBy(F.xxhash64("program", F.lit(seed), F.lit("judged")), "program").limit(judged).toPandas()
    if not len(few):
        return vectors.sparkSession.createDataFrame([], "k int, silhouette double")
    sent = vectors.sparkSession.sparkContext.broadcast((_stacked(few.vector), centres))

    def sums(batches):
        x, centres = sent.value
        held = {k: np.zeros((len(x) + 1, len(own))) for k, own in centres.items()}
        for batch in batches:
            if len(batch):
                v = _stacked(batch.vector)
                d = distances(x, v)
                d[d < 1e-7 * np.sqrt((x * x).sum(axis=1))[:, None]] = 0  # a program and itself
                for k, own in centres.items():
                    label = distances(v, own).argmin(axis=1)
                    held[k][-1] += np.bincount(label, minlength=len(own))
                    held[k][:-1] += d @ np.eye(len(own))[label]
        yield pd.DataFrame({"k": list(held), "part": TaskContext.get().partitionId(), "s": [h.ravel() for h in held.values()]})

    def width(own: pd.DataFrame) -> pd.DataFrame:
        x, centres = sent.value
        k = int(own.k.iloc[0])
        total = np.array(own.s.iloc[0]).reshape(len(x) + 1, -1)
        sizes, total = total[-1], total[:-1]
        label = distances(x, centres[k]).argmin(axis=1)
        at = np.arange(len(x))
        inside = total[at, label] / np.maximum(sizes[label] - 1, 1)
        other = np.where(sizes[None, :] > 0, total / np.maximum(sizes, 1)[None, :], np.inf)
        other[at, label] = np.inf
        outside = other.min(axis=1)
        fine = (sizes[label] > 1) & np.isfinite(outside)
        s = np.where(fine, (np.where(fine, outside, 0) - inside) / np.maximum(np.maximum(inside, np.where(fine, outside, 0)), 1e-300), 0.0)
        return pd.DataFrame({"k": [k], "silhouette": [float(s.mean())]})

    return tree_sum(vectors.select("vector").mapInPandas(sums, "k int, part long, s array<double>"), ["k"]).groupBy("k").applyInPandas(width, "k int, silhouette double")


def clustered(vectors: DataFrame, k: int, **how) -> DataFrame:
    """(program, cluster): the nearest of k medoids; see ``medoids``, also for ``how``."""
    return _assigned(vectors, medoids(vectors, [k], **how), ["program"]).select("program", "cluster")


def compared_runs(programs: DataFrame, run: list[str], pve: str = "pve") -> DataFrame:
    """(run..., n_factors, total_pve) of runs with other parameters, from a row for each factor."""
    return programs.groupBy(*run).agg(F.count("*").alias("n_factors"), F.sum(pve).alias("total_pve"))


def cluster_means(cells: DataFrame, assigned: DataFrame, key: str, value: str) -> DataFrame:
    """(key, cluster, score): mean of the cells (program, key, value) over each cluster's programs; nulls don't count."""
    return cells.join(assigned, "program").groupBy(key, "cluster").agg(F.avg(value).alias("score"))


def members_by_sample(assigned: DataFrame) -> DataFrame:
    """(cluster, iter, n): programs of each cluster in each subsample."""
    return assigned.withColumn("iter", F.regexp_extract("program", r"^iter(\d+)_", 1).cast("long")).groupBy("cluster", "iter").agg(F.count("*").alias("n"))
