"""The model grid: sparse-group lasso fits for every design and grid point.

Samples are few and features many, so a feature is the set of its slots, a bit mask. Features of a gene
with equal masks have equal gradients and so, from zero on, equal coefficients: one row stands for all
of them in a fit. Products with the data are made once per distinct mask of all genes.

All that the steps of a fit share is as long as there are slots: scores, the gradient by slot, a step size.
:func:`descent` decides on them; what it asks for is a sum over genes. A design whose masks are few is summed
in one task. Of a larger one the genes stay dealt out over the cluster: each pass sends the decisions since
the last written state to all tasks, which go over them again for their genes and add up one more step.

Most genes of a model keep no coefficient. Which of them can't have one, whatever the gradient by slot does within the
bounds that it has kept to so far, is told from these bounds (:meth:`Genes.within`), and steps leave them out: a coefficient that is
zero all the time adds nothing, so models are the same.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.residues import mask_bits, slots_of
from ..sources.tables import checkpointed, released


def group_weights(groups: DataFrame, kind: str = "median") -> DataFrame:
    """``groups(combo_idx, gene, n_features, var_sites[, penalty])`` with ``weight``."""
    n, v = F.col("n_features").cast("double"), F.col("var_sites").cast("double")
    w = {"std": F.sqrt(n), "sqrt": F.sqrt(v)}.get(kind)
    return groups.withColumn("weight", w if w is not None else v + F.col("penalty"))


def gradient_at_zero(features: DataFrame, combo: DataFrame, continuous: bool = False) -> DataFrame:
    """``(combo_idx, gene, pos, aa, g)``: the products of each feature with the response; for a binary
    one, with the share of the other class (signed) over the number of slots."""
    return _with_gradient(features, combo, continuous).select("combo_idx", "gene", "pos", "aa", "g")


def _with_gradient(rows: DataFrame, combo: DataFrame, continuous: bool) -> DataFrame:
    """``rows`` of masks with ``g`` as in :func:`gradient_at_zero`."""
    n, last = F.count("*"), combo.agg(F.max("slot").alias("last")).first()["last"]
    pos = F.sum(F.when(F.col("y") > 0, 1.0).otherwise(0.0)) / n
    shape = combo.groupBy("combo_idx").agg(n.alias("n"), pos.alias("m1"), F.map_from_entries(F.collect_list(F.struct("slot", "y"))).alias("ys"))
    y = lambda i: F.try_element_at("ys", F.lit(i))
    b = (lambda i: y(i)) if continuous else (lambda i: F.when(y(i) > 0, 1 - F.col("m1")).otherwise(-F.col("m1")) / F.col("n"))
    by_slot = F.array(*(F.coalesce(b(i), F.lit(0.0)) for i in range((last if last is not None else -1) + 1))).cast("array<double>")
    shape = shape.select("combo_idx", by_slot.alias("by_slot"))
    return rows.join(shape, "combo_idx").withColumn("g", _sum_of_slots(rows, "by_slot", last)).drop("by_slot")


def _sum_of_slots(rows: DataFrame, values: str, last: int | None) -> Column:
    """The sum of the array ``values`` over the slots of a row's mask, of which ``last`` is the highest one."""
    total = F.lit(0.0)
    if dict(rows.dtypes)["mask"] == "bigint":  # compiled, where a function of arrays is not
        for i in range((last if last is not None else -1) + 1):
            total = total + F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.coalesce(F.get(values, F.lit(i)), F.lit(0.0))).otherwise(0.0)
        return total
    return F.aggregate(F.transform(slots_of(F.col("mask"), True), lambda i: F.coalesce(F.get(values, i), F.lit(0.0))), total, lambda a, x: a + x)


def lambda_scale(gradient: DataFrame, weights: DataFrame, grid: DataFrame) -> DataFrame:
    """``(combo_idx[, penalty], lambda1, lambda2, l1_abs, l2_abs)``: fractions of the least penalties that leave
    no coefficient, for each penalty that ``weights`` may have. The grid has one row per pair of fractions. A row of
    ``gradient`` may stand for several equal features, by its ``times``."""
    times = F.col("times") if "times" in gradient.columns else F.lit(1)
    more = ["penalty"] if "penalty" in weights.columns else []
    top = gradient.groupBy("combo_idx").agg(F.max(F.abs("g")).alias("l1_max"))
    firsts = grid.select("lambda1").distinct()
    per = gradient.join(top, "combo_idx").crossJoin(F.broadcast(firsts)).withColumn("l1_abs", F.col("lambda1") * F.col("l1_max"))  # grid points
    rest = F.greatest(F.abs("g") - F.col("l1_abs"), F.lit(0.0))
    norms = per.groupBy("combo_idx", "lambda1", "gene").agg(F.first("l1_abs").alias("l1_abs"), F.sqrt(F.sum(times * rest * rest)).alias("norm"))
    most = norms.hint("merge").join(weights.filter("weight > 0").select("combo_idx", "gene", *more, "weight"), ["combo_idx", "gene"]).groupBy("combo_idx", *more, "lambda1").agg(
        F.first("l1_abs").alias("l1_abs"), F.max(F.col("norm") / F.col("weight")).alias("l2_max")
    )
    return most.join(grid, "lambda1").select("combo_idx", *more, "lambda1", "lambda2", F.round("l1_abs", 9).alias("l1_abs"), F.round(F.col("lambda2") * F.col("l2_max"), 9).alias("l2_abs"))


def prox(coef: DataFrame, l1: Column, l2_weight: Column, keys: list[str]) -> DataFrame:
    """``coef`` after a soft threshold by ``l1`` and a shrink of each group by ``l2_weight``; zeros go."""
    soft = coef.withColumn("s", F.signum("weight") * F.greatest(F.abs("weight") - l1, F.lit(0.0))).filter("s <> 0")
    norms = soft.groupBy(*keys).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    ratio = F.greatest(F.col("norm") - l2_weight, F.lit(0.0)) / F.col("norm")
    return soft.join(norms, keys).withColumn("weight", F.round(F.col("s") * ratio, 9)).filter("weight <> 0").drop("s", "norm")


def empty_models(combo: DataFrame, features: DataFrame, continuous: bool = False) -> DataFrame:
    """``(combo_idx, intercept)`` of designs without features: log odds of the classes, or the mean."""
    p, q = F.sum((F.col("y") > 0).cast("double")), F.sum((F.col("y") <= 0).cast("double"))
    value = F.avg("y") if continuous else F.when((p > 0) & (q > 0), F.log(p / q)).otherwise(0.0)
    designs = combo.groupBy("combo_idx").agg(F.round(value, 9).alias("intercept"))
    return designs.join(features.select("combo_idx").distinct().hint("merge"), "combo_idx", "left_anti")


def _shrink(v: np.ndarray, l1: float, l2: float, starts: np.ndarray, group: np.ndarray, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
    s = np.sign(v) * np.maximum(np.abs(v) - l1, 0)
    if not len(s):
        return s
    norm = np.sqrt(np.add.reduceat(times * s * s, starts))
    keep = np.where(norm > l2 * weight, (norm - l2 * weight) / np.where(norm > 0, norm, 1), 0)
    return s * keep[group]


class Trial(NamedTuple):
    """A step to try: how far momentum carries, the loss's gradient by slot, and the step size's inverse."""

    k: float
    b: np.ndarray
    size: float


class Outcome(NamedTuple):
    intercept: float
    fit: np.ndarray
    steps: list[Trial]


def first_gradient(y: np.ndarray, continuous: bool) -> np.ndarray:
    """By slot, what penalties are measured against: the response, or the share of the other class, signed."""
    share = float((np.abs(y - 1) < 1e-12).mean())
    return y if continuous else np.where(np.abs(y - 1) < 1e-12, 1 - share, -share) / len(y)


#: Accepted steps after which a descent starts anew from where it is; as many as one has unless more are asked for.
RESTART = 100


def descent(y: np.ndarray, continuous: bool, maxiter: int = 100, strict: bool = True) -> Generator[Trial, tuple[np.ndarray, float, float], Outcome]:
    """Accelerated proximal gradient descent, as far as it needs no gene.

    Yields trials; is sent, of the coefficients that a trial leads to, the scores by slot, the squared length of
    their difference to where the trial started, and the product of that difference with the gradient. ``strict``
    asks a step for enough descent; else any excess under 1 will do. Accepted trials are in the outcome.

    A step size only shrinks, and is as small as the genes of the first steps ask for, of which few are left later. So after each
    ``RESTART`` steps it is sought again and momentum begins anew; a shorter descent has none of that."""
    n = len(y)
    share = float((np.abs(y - 1) < 1e-12).mean())
    fit, fit_prev, steps = np.zeros(n), np.zeros(n), []
    c = c_prev = 0.0 if continuous or share >= 1 else float(np.log(max(share, 1e-300) / (1 - share)))
    size, a, a_prev = (1.0 if continuous else 1.0 / n), 1.0, 0.0

    def loss(scores: np.ndarray) -> float:
        return float(np.logaddexp(0, -y * scores).mean())

    for step in range(maxiter):
        if step and step % RESTART == 0:
            size, a, a_prev = (1.0 if continuous else 1.0 / n), 1.0, 1.0
        k = (a_prev - 1) / a
        fit_s, sc = fit + k * (fit - fit_prev), c + k * (c - c_prev)
        b = fit_s - y if continuous else -y / n / (1 + np.exp(np.clip(y * (fit_s + sc), -700, 700)))
        gc = 0.0 if continuous else float(b.sum())
        at_s = 0.0 if continuous else loss(fit_s + sc)
        fit_prev, c_prev = fit, c
        while True:
            fit, squared, along = yield Trial(k, b, size)
            if continuous:
                r, l = squared, float(((fit - fit_s) ** 2).sum())
            else:
                c = sc - gc / size
                r = (squared + (c - sc) ** 2) / 2
                l = loss(fit + c) - at_s - along - (c - sc) * gc
            if r <= 1e-20 or l <= r * size * (1 + 1e-12) or (not strict and abs(l - r * size) < 1):
                break
            size = max(2 * size, l / r)
        steps.append(Trial(k, b, size))
        a_prev, a = a, (1 + np.sqrt(4 * a * a + 1)) / 2
        if r <= 1e-20:
            break
    return Outcome(c, fit, steps)


class Genes:
    """Masks of some genes of a design, ``masks`` sorted by gene, ``genes`` their gene numbers, ``times``
    how many equal features each stands for, ``weight`` the genes' weights."""

    def __init__(self, masks: list | np.ndarray, genes: np.ndarray, weight: np.ndarray, n: int, times: np.ndarray | None = None):
        self.times = np.ones(len(masks)) if times is None else times.astype(float)
        self.bits, self.of = mask_bits(masks, n)
        self._group(genes)
        self.weight = weight[genes[self.starts]]

    def weighed(self, weight: np.ndarray) -> Genes:
        """The same with other weights of its genes."""
        out = copy(self)
        out.weight = weight
        return out

    def _group(self, genes: np.ndarray) -> None:
        new = np.append(True, genes[1:] != genes[:-1])[: len(genes)]
        self.starts, self.group = np.flatnonzero(new), np.cumsum(new) - 1

    def within(self, low: np.ndarray, high: np.ndarray, l1: float, l2: float, held: np.ndarray | None = None) -> tuple[Genes, np.ndarray]:
        """The genes that may get a coefficient at a gradient by slot between ``low`` and ``high`` or have one of the masks that are
        ``held``, and the places of their masks; all others stay at zero from zero on. What rounding may move is left in."""
        if not len(self.of):
            return self, np.zeros(0, np.int64)
        most = np.maximum(np.abs(self.bits @ low), np.abs(self.bits @ high))
        rest = np.maximum(most * (1 + 1e-9) - l1 * (1 - 1e-9), 0)[self.of]
        norms = self.norms(rest)
        may = (norms > 0) & (norms >= l2 * self.weight * (1 - 1e-9))
        if held is not None:
            may[self.group[held]] = True
        at = np.flatnonzero(may[self.group])
        part = Genes.__new__(Genes)
        part.times, part.bits, part.of = self.times[at], self.bits, self.of[at]
        part._group(self.group[at])
        part.weight = self.weight[self.group[at][part.starts]]
        return part, at

    def back(self, v: np.ndarray) -> np.ndarray:
        return (self.bits @ v)[self.of]

    def scores(self, beta: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.times * beta, len(self.bits)) @ self.bits

    def norms(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.add.reduceat(self.times * v * v, self.starts)) if len(v) else np.zeros(0)

    def most(self, l1: float, first: np.ndarray) -> float:
        """The second penalty's least value that leaves no coefficient of these genes."""
        on = self.weight > 0
        return float((self.norms(np.maximum(np.abs(self.back(first)) - l1, 0))[on] / self.weight[on]).max(initial=0.0))

    def step(self, state: tuple[np.ndarray, np.ndarray], trial: Trial, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients after a trial, where it started, and the gradient there."""
        beta, prev = state
        s, g = beta + trial.k * (beta - prev), self.back(trial.b)
        return _shrink(s - g / trial.size, l1 / trial.size, l2 / trial.size, self.starts, self.group, self.weight, self.times), s, g

    def sums(self, new: np.ndarray, s: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, float, float]:
        d = new - s
        return self.scores(new), float(self.times * d @ d), float(self.times * d @ g)


def fit_one(
    masks: np.ndarray, genes: np.ndarray, weight: np.ndarray, y: np.ndarray, f1: float, f2: float, continuous: bool, maxiter: int = 100, strict: bool = True,
    times: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of one model; see :class:`Genes` and :func:`descent`."""
    design = Genes(masks, genes, weight, len(y), times)
    first = first_gradient(y, continuous)
    l1 = f1 * np.abs(design.back(first)).max()
    beta, c, _ = _descend(design, y, l1, f2 * design.most(l1, first), continuous, maxiter, strict)
    return beta, c


#: By what share of the largest gradient bounds are set wider than it went, so that they are not passed at each step.
SLACK = 0.1


def _wider(bounds: tuple[np.ndarray, np.ndarray] | None, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bounds`` as they are if ``b`` is between them, else wider ones around both."""
    if bounds is not None and (b >= bounds[0]).all() and (b <= bounds[1]).all():
        return bounds
    more = SLACK * np.abs(b).max(initial=0.0)
    low, high = b - more, b + more
    return (low, high) if bounds is None else (np.minimum(bounds[0], low), np.maximum(bounds[1], high))


def _inside(b: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> bool:
    return bool((b >= bounds[0]).all() and (b <= bounds[1]).all())


def _around(b: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    more = slack * np.abs(b).max(initial=0.0)
    return b - more, b + more


def _steps(
    design: Genes, asked: Generator, trial: Trial, state: tuple[np.ndarray, np.ndarray], l1: float, l2: float, limits: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, Outcome | None, list[np.ndarray]]:
    """Goes on from ``trial`` with the coefficients ``state`` and those before them, to the end or a gradient by slot beyond
    ``limits``: coefficients, those before them, how it ended, and what was sent.

    A step goes over genes that have a coefficient or may get one near the present gradient. How near is meant
    is less where steps have cost more than telling these genes again, and more where the gradient left soon."""
    whole, sent, size = np.array(state), [], len(design.times)
    part, at, bounds, slack, work = design, np.arange(size), None, SLACK, 0
    beta, prev = whole[0], whole[1]
    new = beta
    try:
        while limits is None or _inside(trial.b, limits):
            out = bounds is None or not _inside(trial.b, bounds)
            if out or (work > 2 * size and len(at) > 64):
                if bounds is not None:
                    slack = min(SLACK, 2 * slack) if out and work < size else slack / 4 if not out else slack
                whole[:, at] = beta, prev
                bounds, work = _around(trial.b, slack), 0
                part, at = design.within(*bounds, l1, l2, np.flatnonzero(whole.any(0)))
                beta, prev = whole[:, at]
            new, s, g = part.step((beta, prev), trial, l1, l2)
            sums = part.sums(new, s, g)
            sent.append(np.append(sums[0], sums[1:]))
            work += len(at) + 16
            later = asked.send(sums)
            if later.b is not trial.b:
                beta, prev = new, beta
            trial = later
    except StopIteration as end:
        whole[:, at] = new, beta
        return whole[0], whole[1], end.value, sent
    whole[:, at] = beta, prev
    return whole[0], whole[1], None, sent


def _descend(design: Genes, y: np.ndarray, l1: float, l2: float, continuous: bool, maxiter: int, strict: bool) -> tuple[np.ndarray, float, np.ndarray]:
    asked, zero = descent(y, continuous, maxiter, strict), np.zeros(len(design.times))
    beta, _, end, _ = _steps(design, asked, next(asked), (zero, zero), l1, l2)
    return beta, end.intercept, end.fit


def input_rmse(scores: np.ndarray, touched: np.ndarray, intercept: float, y: np.ndarray) -> float:
    """Over training species; those without a hit predict 0."""
    return float(np.sqrt(((np.where(touched, scores + intercept, 0.0) - y) ** 2).mean()))


#: Distinct masks of genes, summed over genes, that one task fits; models of larger designs whose
#: state is held at once, and accepted steps after which it is written.
MASKS_IN_TASK, MODELS_AT_ONCE, STEPS_WRITTEN = 4_000_000, 64, 8

#: Steps up to which the genes of a large design are dealt out at once: that many passes are bounded, and in the first steps many genes are near.
LONG_DESCENT = 100

#: Least slack at which the genes near a gradient are told; a model that still has too many for a task is dealt out. Masks of
#: such genes below which a round may look further, and above which it looks less far; large designs fitted at the same time.
LEAST_SLACK, FEW_NEAR, MANY_NEAR, DESIGNS_AT_ONCE = 1e-3, 100_000, 500_000, 4

MODEL = "combo_idx long, penalty double, lambda1 double, lambda2 double, intercept double, rmse double, num_genes int"
_MODEL = [x.split()[0] for x in MODEL.split(", ")]


def feature_kinds(features: DataFrame) -> DataFrame:
    """``(combo_idx, gene, kinds)``: a gene's distinct masks in order, with how many features have each."""
    n = features.groupBy("combo_idx", "gene", "mask").agg(F.count("*").alias("times"))
    return n.groupBy("combo_idx", "gene").agg(F.array_sort(F.collect_list(F.struct("mask", "times"))).alias("kinds"))


def _number(names: pd.Series | list, sizes: list[int]) -> np.ndarray:
    return np.repeat(np.arange(len(names)), sizes)


def fit_models(
    features: DataFrame, combo: DataFrame, weights: DataFrame, grid: DataFrame, continuous: bool = False, maxiter: int = 100, strict: bool = True,
    masks_in_task: int = MASKS_IN_TASK, kinds: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(models, coef)`` of all designs, penalties and grid points: ``MODEL`` rows, and a row
    ``(combo_idx, penalty, lambda1, lambda2, gene, pos, aa, weight)`` per coefficient that is not zero.

    ``weights(combo_idx, gene, weight[, penalty])`` has a row per gene and penalty; a repeat of a design (with
    other null alignments) is a design of its own. A design of at most ``masks_in_task`` distinct masks of genes is
    one task for each penalty and ``lambda1``; larger ones are fitted by :func:`fit_kept`, or in up to ``LONG_DESCENT`` steps :func:`fit_dealt`. ``kinds`` are those of
    :func:`feature_kinds` where they are there already. Results depend on sorted rows only, so a lost task gives the same again."""
    spark = features.sparkSession
    if "penalty" not in weights.columns:
        weights = weights.withColumn("penalty", F.lit(0.0))
    mask = dict(features.dtypes)["mask"]
    per = (feature_kinds(features) if kinds is None else kinds).select("combo_idx", "gene", F.col("kinds.mask").alias("masks"), F.col("kinds.times").alias("times"))
    per = checkpointed(per) if kinds is None else per
    sizes = per.groupBy("combo_idx").agg(F.sum(F.size("masks")).alias("n"))
    large = [r["combo_idx"] for r in sizes.filter(F.col("n") > masks_in_task).collect()]
    found = []
    if sizes.count() > len(large):
        found.append(_fit_small(per.filter(~F.col("combo_idx").isin(large)), combo, weights, grid, continuous, maxiter, strict, mask))

    def fitted(c: int) -> DataFrame:
        own = (d.filter(F.col("combo_idx") == c) for d in (per, combo, weights))
        return fit_kept(*own, grid, continuous, maxiter, strict, masks_in_task if maxiter > LONG_DESCENT else 0)

    with ThreadPoolExecutor(DESIGNS_AT_ONCE) as pool:  # a round of one design leaves most tasks idle
        found += pool.map(fitted, large)
    rows = found[0] if found else spark.createDataFrame([], f"{MODEL}, gene string, mask {mask}, weight double")
    for part in found[1:]:
        rows = rows.unionByName(part)
    rows = checkpointed(rows)
    # No side of a join of genes or features is sent whole through the driver, however small its files are.
    coef = rows.filter("gene IS NOT NULL").hint("merge").join(features.select("combo_idx", "gene", "mask", "pos", "aa"), ["combo_idx", "gene", "mask"])
    return rows.filter("gene IS NULL").select(*_MODEL), checkpointed(coef.select(*_MODEL[:4], "gene", "pos", "aa", "weight"))


def _fit_small(
    per: DataFrame, combo: DataFrame, weights: DataFrame, grid: DataFrame, continuous: bool, maxiter: int, strict: bool, mask: str
) -> DataFrame:
    """A task fits one design at one penalty and ``lambda1`` with all its ``lambda2``; its input is a row per gene."""
    ys = F.transform(F.array_sort(F.collect_list(F.struct("slot", "y"))), lambda x: x["y"])
    points = grid.groupBy("lambda1").agg(F.array_sort(F.collect_set("lambda2")).alias("seconds"))
    heads = combo.groupBy("combo_idx").agg(ys.alias("ys")).crossJoin(F.broadcast(points))  # grid points
    heads = heads.select(F.col("combo_idx").alias("head_idx"), F.col("lambda1").alias("head_lambda1"), "ys", "seconds")
    rows = per.hint("merge").join(weights.select("combo_idx", "gene", "penalty", "weight"), ["combo_idx", "gene"]).crossJoin(F.broadcast(points.select("lambda1")))  # grid points
    rows = rows.join(heads, (F.col("combo_idx") == F.col("head_idx")) & (F.col("lambda1") == F.col("head_lambda1"))).drop("head_idx", "head_lambda1")
    out_type = f"{MODEL}, gene string, mask {mask}, weight double"
    columns = [x.split()[0] for x in out_type.split(", ")]

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        f = group.sort_values("gene").reset_index(drop=True)
        genes = _number(f["gene"], f["masks"].map(len))
        masks, times = [m for x in f["masks"] for m in x], np.concatenate(f["times"].tolist())
        y, out = np.array(f["ys"][0], float), []
        design, first = Genes(masks, genes, f["weight"].to_numpy(float), len(y), times), first_gradient(y, continuous)
        l1 = float(key[2]) * np.abs(design.back(first)).max()
        most = design.most(l1, first)
        for second in f["seconds"][0]:
            beta, c, scores = _descend(design, y, l1, float(second) * most, continuous, maxiter, strict)
            on = np.flatnonzero(beta)
            touched = design.bits[np.unique(design.of[on])].any(0) if len(on) else np.zeros(len(y), bool)
            head = (int(key[0]), float(key[1]), float(key[2]), float(second), c, input_rmse(scores, touched, c, y), len(np.unique(genes[on])))
            out.append((*head, None, None, None))
            out += [(*head, f["gene"][genes[j]], masks[j], float(beta[j])) for j in on]
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({"mask": "Int64"}) if mask == "bigint" else frame

    return rows.groupBy("combo_idx", "penalty", "lambda1").applyInPandas(fit, out_type)


class _Model(NamedTuple):
    penalty: float
    lambda1: float
    lambda2: float
    l1: float
    l2: float


class _Design:
    """A design whose genes are dealt out: its response, models, and ``rows(gene, masks, times, weights)`` with a weight for each penalty."""

    def __init__(self, per: DataFrame, combo: DataFrame, weights: DataFrame, grid: DataFrame, continuous: bool):
        spark = per.sparkSession
        self.y = y = np.array([r["y"] for r in combo.select("slot", "y").orderBy("slot").collect()], float)  # one design's slots
        self.combo_idx = combo.select("combo_idx").first()["combo_idx"]
        self.penalties = penalties = sorted(r["penalty"] for r in weights.select("penalty").distinct().collect())
        by_penalty = weights.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("penalty", "weight"))).alias("w"))
        wanted = F.array(*(F.lit(p) for p in penalties))
        rows = per.hint("merge").join(by_penalty, "gene").select("gene", "masks", "times", F.transform(wanted, lambda p: F.try_element_at("w", p)).alias("weights"))
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.rows = checkpointed(rows.repartition(tasks, "gene"))
        first, n = first_gradient(y, continuous), len(y)

        def designs(batch: pa.RecordBatch) -> tuple[list, np.ndarray, list[Genes]]:
            masks = batch.column("masks")
            genes = np.repeat(np.arange(batch.num_rows), np.asarray(masks.value_lengths(), np.int64))
            inner, times = masks.flatten(), np.asarray(batch.column("times").flatten(), float)
            flat = inner.to_numpy(zero_copy_only=False) if pa.types.is_integer(inner.type) else inner.to_pylist()
            w = np.array(batch.column("weights").to_pylist(), float)
            one = Genes(flat, genes, w[:, 0], n, times)
            return flat, genes, [one.weighed(w[genes[one.starts], p]) for p in range(len(penalties))]

        self.designs = designs

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = max((float(np.abs(designs(b)[2][0].back(first)).max(initial=0.0)) for b in batches if b.num_rows), default=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([top])], ["top"])

        top = self.rows.mapInArrow(tops, "top double").agg(F.max("top").alias("top")).first()["top"] or 0.0
        points = sorted((r["lambda1"], r["lambda2"]) for r in grid.select("lambda1", "lambda2").distinct().collect())  # grid points
        firsts = sorted({p[0] for p in points})

        def mosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros((len(penalties), len(firsts)))
            for batch in batches:
                if batch.num_rows:
                    here = designs(batch)[2]
                    best = np.maximum(best, [[d.most(f * top, first) for f in firsts] for d in here])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(best.size)), pa.array(best.ravel())], ["at", "most"])

        most = {r["at"]: r["most"] for r in self.rows.mapInArrow(mosts, "at long, most double").groupBy("at").agg(F.max("most").alias("most")).collect()}
        self.models = [
            _Model(p, f1, f2, f1 * top, f2 * most[i * len(firsts) + firsts.index(f1)]) for i, p in enumerate(penalties) for f1, f2 in points
        ]


def fit_dealt(
    per: DataFrame, combo: DataFrame, weights: DataFrame, grid: DataFrame, continuous: bool = False, maxiter: int = 100, strict: bool = True
) -> DataFrame:
    """All models of one design whose genes stay dealt out; rows as of a design fitted in a task.

    A pass tries one step of each model that is not done, over all genes: tasks go again over the steps since
    the state was last written, add up the trial and give a sum by slot. Every ``STEPS_WRITTEN`` accepted
    steps the state is written, so that a pass goes over few of them and a lost task needs no more than its own genes."""
    return fit_kept(per, combo, weights, grid, continuous, maxiter, strict, 0)


def fit_kept(
    per: DataFrame, combo: DataFrame, weights: DataFrame, grid: DataFrame, continuous: bool = False, maxiter: int = 100, strict: bool = True,
    masks_in_task: int = MASKS_IN_TASK,
) -> DataFrame:
    """All models of one design whose genes are too many for a task; rows as of a design fitted in a task.

    In a round all genes are asked whether they may get a coefficient near the model's present gradient by slot. Those that may,
    and those that have one, go to one task for each model, which takes steps until the gradient leaves what was meant by near. A
    model whose genes near the gradient have over ``masks_in_task`` masks is asked about again more closely, and at last has its genes dealt out in
    each step (:func:`fit_dealt`). What is left out is zero all the while, so models are the same either way."""
    design = _Design(per, combo, weights, grid, continuous)
    spark, rows, y, models = per.sparkSession, design.rows, design.y, design.models
    found, dealt = [], list(range(len(models))) if masks_in_task <= 0 else []
    asked = {k: descent(y, continuous, maxiter, strict) for k in range(len(models)) if k not in dealt}
    trials, slack = {k: next(g) for k, g in asked.items()}, dict.fromkeys(asked, SLACK)
    sent: dict[int, list[np.ndarray]] = {k: [] for k in asked}
    state, heads, end_parts = None, [], []
    while trials:
        limits = {k: _around(trials[k].b, slack[k]) for k in trials}
        near = checkpointed(_near(rows, design, limits))
        size = {r["k"]: r["n"] for r in near.groupBy("k").agg(F.sum(F.size("masks")).alias("n")).collect()}  # a row per model
        for k in [k for k in trials if size.get(k, 0) > masks_in_task]:
            slack[k] /= 5
            if slack[k] < LEAST_SLACK:
                dealt.append(k)
                del trials[k], asked[k]
        going = [k for k in trials if size.get(k, 0) <= masks_in_task]
        if going:
            new = checkpointed(_taken(near, state, design, {k: (limits[k], np.array(sent[k])) for k in going}, continuous, maxiter, strict))
            for r in new.filter("gene IS NULL").select("k", "sent", "done", "rmse", "num_genes").collect():  # a row per model: its sums by slot
                k, lines = r["k"], np.array(r["sent"], float).reshape(-1, len(y) + 2)
                n = size.get(k, 0)
                slack[k] = min(4 * SLACK, 2 * slack[k]) if n < FEW_NEAR else max(SLACK / 8, slack[k] / 2) if n > MANY_NEAR else slack[k]
                sent[k] += list(lines)
                try:
                    for line in lines:
                        trials[k] = asked[k].send((line[:-2], float(line[-2]), float(line[-1])))
                except StopIteration as end:
                    heads.append((*models[k][:3], float(end.value.intercept), r["rmse"], r["num_genes"]))
                    del trials[k]
            own = new.filter("gene IS NOT NULL")
            end_parts.append(own.filter("done"))
            kept = own.filter(~F.col("done"))
            state = kept if state is None else kept.unionByName(state.filter(~F.col("k").isin(going)))
    out = f"{MODEL.split(', ', 1)[1]}, gene string, mask {dict(rows.dtypes)['masks'][6:-1]}, weight double"
    names = [x.split()[0] for x in out.split(", ")]
    if heads:
        head = spark.createDataFrame([(*h, None, None, None) for h in heads], out)
        found.append(head)
        place = spark.createDataFrame([(k, *m[:3]) for k, m in enumerate(models)], "k int, penalty double, lambda1 double, lambda2 double")
        known = head.drop("gene", "mask", "weight").join(F.broadcast(place), ["penalty", "lambda1", "lambda2"])  # models
        for part in end_parts:
            each = part.select("k", "gene", F.inline(F.arrays_zip(F.col("masks").alias("mask"), F.col("beta").alias("weight")))).filter("weight <> 0")
            found.append(each.join(F.broadcast(known), "k").select(*names))
    found += [
        _fit_block(spark, rows, [models[k] for k in dealt[at : at + MODELS_AT_ONCE]], design.penalties, y, continuous, maxiter, strict, design.designs)
        for at in range(0, len(dealt), MODELS_AT_ONCE)
    ]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result.select(F.lit(design.combo_idx).cast("long").alias("combo_idx"), *names)


def _near(rows: DataFrame, design: _Design, limits: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(k, gene, masks, times, weight)``: genes that may get a coefficient of model ``k`` within its ``limits``."""
    models, place, designs = design.models, {p: i for i, p in enumerate(design.penalties)}, design.designs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, genes, ds = designs(batch)
            for k, bounds in limits.items():
                m = models[k]
                at = pa.array(np.unique(genes[ds[place[m.penalty]].within(*bounds, m.l1, m.l2)[1]]))
                w = pa.array(np.array([x[place[m.penalty]] for x in batch.column("weights").take(at).to_pylist()], float))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), *(batch.column(c).take(at) for c in ("gene", "masks", "times")), w], ["k", "gene", "masks", "times", "weight"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"k int, gene string, masks {kinds['masks']}, times {kinds['times']}, weight double")


def _taken(
    near: DataFrame, state: DataFrame | None, design: _Design, todo: dict[int, tuple[tuple[np.ndarray, np.ndarray], np.ndarray]], continuous: bool, maxiter: int, strict: bool
) -> DataFrame:
    """Steps of the models ``todo`` over genes ``near`` and those of ``state``, a task for each model. A row for each gene with a coefficient
    now or before, and one without a gene for each model: the sums by slot that it sent, and if it is done, its error and number of genes."""
    models, y, kinds = design.models, design.y, dict(near.dtypes)
    columns = ["k", "gene", "masks", "times", "weight", "beta", "prev"]
    none = lambda c: F.lit(None).cast("array<double>").alias(c)
    rows = near.filter(F.col("k").isin(list(todo))).select(*columns[:5], none("beta"), none("prev"))
    if state is not None:
        rows = rows.unionByName(state.filter(F.col("k").isin(list(todo))).select(*columns))
    # A model without genes goes on too.
    spark = near.sparkSession
    heads = spark.createDataFrame([(k,) for k in todo], "k int").select("k", *(F.lit(None).cast(t).alias(c) for c, t in zip(columns[1:], ("string", kinds["masks"], kinds["times"], "double", "array<double>", "array<double>"), strict=True)))
    out = f"k int, gene string, masks {kinds['masks']}, times {kinds['times']}, weight double, beta array<double>, prev array<double>, sent array<double>, done boolean, rmse double, num_genes int"
    names = [x.split()[0] for x in out.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        (limits, lines), m = todo[k], models[k]
        table = table.filter(table.column("gene").is_valid())
        # Of a gene that is near and has a state, the row with its state goes on.
        table = table.append_column("fresh", table.column("beta").is_null())
        order = pc.sort_indices(table.select(["gene", "fresh"]), [("gene", "ascending"), ("fresh", "ascending")]).to_numpy()
        codes = table.column("gene").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        table = table.take(order[np.append(True, codes[order][1:] != codes[order][:-1])[: len(order)]]).combine_chunks()
        lists = {c: table.column(c).combine_chunks() for c in ("masks", "times")}
        length = np.asarray(lists["masks"].value_lengths(), np.int64)
        inner = lists["masks"].flatten()
        flat = inner.to_numpy(zero_copy_only=False) if pa.types.is_integer(inner.type) else inner.to_pylist()
        genes = np.repeat(np.arange(len(length)), length)
        genes_of = Genes(flat, genes, table.column("weight").to_numpy().astype(float), len(y), np.asarray(lists["times"].flatten(), float))
        held = ~table.column("fresh").to_numpy().astype(bool)
        whole = np.zeros((2, len(genes)))
        for i, c in enumerate(("beta", "prev")):
            whole[i][held[genes]] = np.asarray(table.column(c).combine_chunks().flatten(), float)
        asked = descent(y, continuous, maxiter, strict)
        trial = next(asked)
        for line in lines:
            trial = asked.send((line[:-2], float(line[-2]), float(line[-1])))
        beta, prev, end, more = _steps(genes_of, asked, trial, (whole[0], whole[1]), m.l1, m.l2, limits)
        wanted = beta != 0 if end else (beta != 0) | (prev != 0)
        some = np.unique(genes[wanted])
        inside = np.isin(genes, some)
        offsets = np.append(0, np.cumsum(length[some])).astype(np.int32)
        part = table.take(pa.array(some))
        rmse = number = None
        if end:
            on = np.flatnonzero(beta)
            touched = genes_of.bits[np.unique(genes_of.of[on])].any(0) if len(on) else np.zeros(len(y), bool)
            rmse, number = input_rmse(end.fit, touched, end.intercept, y), len(np.unique(genes[on]))
        null = lambda c: pa.nulls(1, types[c])
        own = [pa.array(np.full(len(some), k, np.int32)), *(part.column(c).combine_chunks() for c in columns[1:5]), *(pa.ListArray.from_arrays(offsets, pa.array(x[inside])) for x in (beta, prev)), pa.nulls(len(some), pa.list_(pa.float64())), pa.array(np.full(len(some), end is not None)), pa.nulls(len(some), pa.float64()), pa.nulls(len(some), pa.int32())]
        types = {c: x.type for c, x in zip(names, own, strict=True)}
        head = [pa.array([k], pa.int32()), *(null(c) for c in names[1:7]), pa.array([np.concatenate(more).tolist() if more else []], pa.list_(pa.float64())), pa.array([end is not None]), pa.array([rmse], pa.float64()), pa.array([number], pa.int32())]
        return pa.Table.from_arrays([pa.chunked_array([a, b], a.type) for a, b in zip(own, head, strict=True)], names)

    return rows.unionByName(heads).groupBy("k").applyInArrow(run, out)


def _fit_block(spark: SparkSession, rows: DataFrame, models: list[_Model], penalties: list[float], y: np.ndarray, continuous: bool, maxiter: int, strict: bool, designs) -> DataFrame:
    mask, n = dict(rows.dtypes)["masks"][6:-1], len(y)
    kept = ["gene", "masks", "times", "weights"]
    place = {p: i for i, p in enumerate(penalties)}

    def replayed(batch: pa.RecordBatch, steps: list[list[Trial]], bounds: list, wanted):
        """By model, its number, the genes of its design that may have coefficients, the places of their masks, and the
        coefficients after ``steps`` and before the last of them. A
        written state holds what is not zero: a gene's ``at`` is the model's number times the gene's masks, plus the mask's."""
        flat, genes, ds = designs(batch)
        size = np.bincount(genes, minlength=batch.num_rows)
        before = np.cumsum(size) - size
        if "at" in batch.schema.names:
            gene = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("at").value_lengths(), np.int64))
            model, j = np.divmod(np.asarray(batch.column("at").flatten(), np.int64), size[gene])
            order = np.argsort(model, kind="stable")
            cuts, j = np.searchsorted(model[order], np.arange(len(models) + 1)), (before[gene] + j)[order]
            values = [np.asarray(batch.column(c).flatten(), float)[order] for c in ("beta", "prev")]
        for k in wanted:
            beta, prev = np.zeros(len(flat)), np.zeros(len(flat))
            if "at" in batch.schema.names:
                part = slice(cuts[k], cuts[k + 1])
                beta[j[part]], prev[j[part]] = values[0][part], values[1][part]
            d, on = ds[place[models[k].penalty]].within(*bounds[k], models[k].l1, models[k].l2)
            beta, prev = beta[on], prev[on]
            for trial in steps[k]:
                beta, prev = d.step((beta, prev), trial, models[k].l1, models[k].l2)[0], beta
            yield k, d, on, (beta, prev), flat, genes

    def tried(state: DataFrame, steps: list[list[Trial]], trials: dict[int, Trial]) -> dict[int, np.ndarray]:
        shared = spark.sparkContext.broadcast((steps, trials, bounds))  # slots of each model and step

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done, asked, kept_to = shared.value
            total = {k: np.zeros(n + 2) for k in asked}
            for batch in batches:
                if batch.num_rows:
                    for k, d, _, held, _, _ in replayed(batch, done, kept_to, asked):
                        scores, squared, along = d.sums(*d.step(held, asked[k], models[k].l1, models[k].l2))
                        total[k] += np.append(scores, (squared, along))
            columns = np.repeat(list(total), n + 2), np.tile(np.arange(n + 2), len(total)), np.concatenate(list(total.values()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["k", "i", "x"])

        out = {k: np.zeros(n + 2) for k in trials}
        for r in state.mapInArrow(run, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect():  # slots of each model
            out[r["k"]][r["i"]] = r["x"]
        shared.destroy()
        return out

    def written(state: DataFrame, steps: list[list[Trial]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = []
                for k, _, at, (beta, prev), _, genes in replayed(batch, steps, bounds, range(len(models))) if batch.num_rows else ():
                    size = np.bincount(genes, minlength=batch.num_rows)
                    some = np.flatnonzero((beta != 0) | (prev != 0))
                    on = at[some]
                    parts.append((genes[on], k * size[genes[on]] + on - (np.cumsum(size) - size)[genes[on]], beta[some], prev[some]))
                gene, *columns = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int),) * 4
                order = np.argsort(gene, kind="stable")
                offsets = np.searchsorted(gene[order], np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], t)) for x, t in zip(columns, (pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], [*kept, "at", "beta", "prev"])

        return checkpointed(state.mapInArrow(run, f"gene string, masks array<{mask}>, times array<bigint>, weights array<double>, at array<bigint>, beta array<double>, prev array<double>"))

    state, steps = rows, [[] for _ in models]
    running = {k: descent(y, continuous, maxiter, strict) for k in range(len(models))}
    trials, outcomes, bounds = {k: next(g) for k, g in running.items()}, {}, [None] * len(models)
    while trials:
        for k, trial in trials.items():
            bounds[k] = _wider(bounds[k], trial.b)
        sums, later = tried(state, steps, trials), {}
        for k, trial in trials.items():
            try:
                later[k] = running[k].send((sums[k][:n], float(sums[k][n]), float(sums[k][n + 1])))
                if later[k].b is not trial.b:
                    steps[k].append(trial)
            except StopIteration as end:
                outcomes[k] = end.value
                steps[k].append(trial)
        trials = later
        if trials and max(map(len, steps)) >= STEPS_WRITTEN:
            new = written(state, steps)
            if state is not rows:
                released(state)
            state, steps = new, [[] for _ in models]

    def nonzero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kind = batch.column("gene").to_pylist(), batch.schema.field("masks").type.value_type
            for k, _, at, (beta, _), flat, genes in replayed(batch, steps, bounds, range(len(models))) if batch.num_rows else ():
                some = np.flatnonzero(beta)
                on = at[some]
                columns = [k] * len(on), [names[genes[j]] for j in on], [flat[j] for j in on], beta[some]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.string(), kind, pa.float64()), strict=True)], ["k", "gene", "mask", "weight"])

    found = checkpointed(state.mapInArrow(nonzero, f"k int, gene string, mask {mask}, weight double"))
    if state is not rows:
        released(state)
    genes = {r["k"]: r["n"] for r in found.groupBy("k").agg(F.countDistinct("gene").alias("n")).collect()}  # models at once
    touched = np.zeros((len(models), n), bool)
    for r in found.select("k", F.explode(slots_of(F.col("mask"), mask != "bigint")).alias("slot")).distinct().collect():  # slots of each model
        touched[r["k"], r["slot"]] = True
    heads = [(k, *m[:3], float(outcomes[k].intercept), input_rmse(outcomes[k].fit, touched[k], outcomes[k].intercept, y), genes.get(k, 0)) for k, m in enumerate(models)]
    head = spark.createDataFrame(heads, "k int, " + MODEL.split(", ", 1)[1])
    rest = [F.lit(None).cast(t).alias(c) for c, t in (("gene", "string"), ("mask", mask), ("weight", "double"))]
    return head.select(*_MODEL[1:], *rest).unionByName(found.join(F.broadcast(head), "k").drop("k"))  # models at once


def fit_grid(
    features: DataFrame, combo: DataFrame, weights: DataFrame, grid: DataFrame, continuous: bool = False, maxiter: int = 100, strict: bool = True,
    masks_in_task: int = MASKS_IN_TASK, kinds: DataFrame | None = None,
) -> DataFrame:
    """Models and coefficients in one table, a row with a null gene for each model; see :func:`fit_models`."""
    models, coef = fit_models(features, combo, weights, grid, continuous, maxiter, strict, masks_in_task, kinds)
    key = ["combo_idx", "penalty", "lambda1", "lambda2"]
    none = models.select(*_MODEL, *(F.lit(None).cast(t).alias(c) for c, t in (("gene", "string"), ("pos", "int"), ("aa", "string"), ("weight", "double"))))
    return none.unionByName(coef.join(models, key).select(none.columns))


def kkt_residuals(
    features: DataFrame, combo: DataFrame, weights: DataFrame, models: DataFrame, coef: DataFrame, continuous: bool = False, kinds: DataFrame | None = None
) -> DataFrame:
    """``(combo_idx, penalty, lambda1, lambda2, residual)``: how far a model is from the least penalised loss.

    At the least, the gradient of each feature and the penalties' own cancel where the coefficient is not
    zero, and stay within the penalties where it is. The largest departure is given as a share of the first penalty.
    Joins and sums of slots and genes; a gene of zeros is told by its gradient alone."""
    key, feature = ["combo_idx", "penalty", "lambda1", "lambda2"], ["gene", "pos", "aa"]
    if "penalty" not in weights.columns:
        weights = weights.withColumn("penalty", F.lit(0.0))
    grid = models.select("lambda1", "lambda2").distinct()
    kinds = (feature_kinds(features) if kinds is None else kinds).select("combo_idx", "gene", F.inline("kinds"))
    scale = checkpointed(lambda_scale(_with_gradient(kinds, combo, continuous), weights, grid).select(*key, "l1_abs", "l2_abs"))  # a row per model
    slots = slots_of(F.col("mask"), dict(features.dtypes)["mask"] != "bigint")
    hit = coef.hint("merge").join(features, ["combo_idx", *feature]).select(*key, "weight", F.explode(slots).alias("slot")).groupBy(*key, "slot").agg(F.sum("weight").alias("s"))
    n = combo.groupBy("combo_idx").agg(F.count("*").alias("n"))
    at = models.join(combo.select("combo_idx", "slot", "y"), "combo_idx").join(hit, [*key, "slot"], "left").join(n, "combo_idx")
    f = F.coalesce("s", F.lit(0.0)) + F.col("intercept")
    b = f - F.col("y") if continuous else -F.col("y") / F.col("n") / (1 + F.exp(F.col("y") * f))
    sides = at.select(*key, "slot", b.alias("b")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "b"))), lambda x: x["b"]).alias("bs")).join(scale, key)
    sides = F.broadcast(checkpointed(sides))  # a row per model, as long as there are slots
    g = _sum_of_slots(features, "bs", combo.agg(F.max("slot").alias("last")).first()["last"])
    rest = F.greatest(F.abs("g") - F.col("l1_abs"), F.lit(0.0))
    w = weights.select("combo_idx", "penalty", "gene", F.col("weight").alias("w"))
    # A gene is by itself, and of the genes only those that have a coefficient or depart from the least are met again.
    norms = kinds.join(sides, "combo_idx").select(*key, "gene", "times", g.alias("g"), "l1_abs", "l2_abs").groupBy(*key, "gene").agg(F.sqrt(F.sum(F.col("times") * rest * rest)).alias("rest"), F.first("l1_abs").alias("l1"), F.first("l2_abs").alias("l2")).filter("rest > 0")
    zero = norms.hint("merge").join(w, ["combo_idx", "penalty", "gene"]).withColumn("off", F.col("rest") - F.col("l2") * F.col("w")).filter("off > 0")
    group = coef.groupBy(*key, "gene").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    zero = zero.hint("merge").join(group.select(*key, "gene"), [*key, "gene"], "left_anti").groupBy(*key).agg(F.max(F.col("off") / F.col("l1")).alias("off"))
    every = group.hint("merge").join(features, ["combo_idx", "gene"]).join(sides, key).select(*key, *feature, "norm", g.alias("g"), "l1_abs", "l2_abs")
    every = every.hint("merge").join(coef.select(*key, *feature, "weight"), [*key, *feature], "left").hint("merge").join(w, ["combo_idx", "penalty", "gene"])
    pull = F.col("g") + F.col("l1_abs") * F.signum("weight") + F.col("l2_abs") * F.col("w") * F.col("weight") / F.col("norm")
    own = every.groupBy(*key).agg(F.max(F.when(F.col("weight").isNotNull(), F.abs(pull)).otherwise(rest) / F.col("l1_abs")).alias("own"))
    both = models.select(*key).join(zero, key, "left").join(own, key, "left")
    return both.select(*key, F.coalesce(F.greatest("off", "own"), F.lit(0.0)).alias("residual"))
