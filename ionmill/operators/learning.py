"""Learning: linear and network thetas (I1, I2), gradients and losses (A16-A19), solvers (L6-L12), initialisers, dropout and the EM loop.

Everything that grows with the data (features, thetas, beliefs, gradients) is a distributed aggregation; only weights and gradients, one
number per feature, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decayed_rate
from ..plans.lineage import cut


def used_features(features: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Distinct indexes, of the rows that ``folds`` keeps."""
    rows = features if folds is None else features.join(folds, folds.columns, "left_semi")
    return rows.select("idx").distinct()


def theta_linear(features: DataFrame, param: DataFrame, key: str) -> DataFrame:
    """The sum of weights at set features. An index without a weight counts 0."""
    return features.join(param, "idx", "left").groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("theta"))


def quadratic_pairs(features: DataFrame, key: str) -> DataFrame:
    """every pair of set features without the bias (index 0), once. The indexes of one row meet in one array, so nothing is joined."""
    packed = features.where("idx > 0").groupBy(key).agg(F.array_sort(F.collect_set("idx")).alias("_i"))
    pairs = F.flatten(F.transform("_i", lambda x, k: F.transform(F.slice("_i", k + 2, F.size("_i")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return packed.select(key, F.explode(pairs).alias("p")).select(key, "p.a", "p.b")


def with_shares(thetas: DataFrame, group: str) -> DataFrame:
    """rho = e^theta / (1 + sum e^theta) and log_denominator, per group."""
    w = Window.partitionBy(group)
    top = F.greatest(F.max("theta").over(w), F.lit(0.0))
    denominator = top + F.log(F.exp(-top) + F.sum(F.exp(F.col("theta") - top)).over(w))
    return thetas.withColumn("log_denominator", denominator).withColumn("rho", F.exp(F.col("theta") - F.col("log_denominator")))


def gradient_linear(features: DataFrame, thetas: DataFrame, key: str, group: str) -> DataFrame:
    """Per index, sum over groups of nu f - (sum of nu) rho f. thetas: key, group, theta, nu, and nu_stay of the group."""
    shared = with_shares(thetas, group)
    total = F.sum("nu").over(Window.partitionBy(group)) + F.col("nu_stay")
    pull = shared.select(key, (F.col("nu") - total * F.col("rho")).alias("pull"))
    return features.join(pull, key).groupBy("idx").agg(F.sum("pull").alias("grad"))


def loss(thetas: DataFrame, group: str) -> DataFrame:
    """Q summed over groups."""
    shared = with_shares(thetas, group)
    moved = F.sum(F.col("nu") * (F.col("theta") - F.col("log_denominator")))
    per = shared.groupBy(group).agg(moved.alias("q"), (F.max("nu_stay") * F.max("log_denominator")).alias("stay"))
    return per.agg(F.sum(F.col("q") - F.col("stay")).alias("q"))


def penalty(param: DataFrame, weight: float, bias_share: float = 0.0) -> DataFrame:
    """-weight / 2 times the sum of squares; the bias (index 0) counts ``bias_share`` (networks: 0.01)."""
    return param.agg((-0.5 * weight * F.sum(F.col("weight") * F.col("weight") * F.when(F.col("idx") == 0, bias_share).otherwise(1.0))).alias("l2"))


def zero_unused(param: DataFrame, used: DataFrame) -> DataFrame:
    """L19."""
    return param.join(used.withColumn("_used", F.lit(True)), "idx", "left").select("idx", F.when(F.col("_used"), F.col("weight")).otherwise(0.0).alias("weight"))


def split(rows: DataFrame, fold: int, column: str = "cv_group") -> tuple[DataFrame, DataFrame]:
    """(training, validation)."""
    return rows.where(F.col(column) != fold), rows.where(F.col(column) == fold)


def minibatch(rows: DataFrame, key: str, batches: int, seed: int = 0) -> DataFrame:
    """L4: a batch number per key, round robin in a seeded order of equal sizes up to one."""
    place = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("batch", (place % batches).cast("int"))


# Solvers: E3, L6-L12 -----------------------------------------------------------------------------------------------------------------


class Solver:
    """Ascent steps on weights; ``used`` lists the indexes that move."""

    def step(self, w: np.ndarray, g: np.ndarray, used: np.ndarray, rate: float) -> None:
        raise NotImplementedError


class Sgd(Solver):
    def step(self, w, g, used, rate):
        w[used] += rate * g[used]


@dataclass
class Momentum(Solver):
    size: int
    momentum: float = 0.9
    v: np.ndarray = field(init=False)

    def __post_init__(self):
        self.v = np.zeros(self.size)

    def step(self, w, g, used, rate):
        self.v[used] = self.momentum * self.v[used] + rate * g[used]
        w[used] += self.v[used]


@dataclass
class Adam(Solver):
    """L8; amsgrad keeps the largest second moment. L9: decay, on ``decayed`` indexes only. L11: belief, with the plain first moment."""

    size: int
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    amsgrad: bool = False
    decay: float = 0.0
    decayed: Sequence[int] = ()
    belief: bool = False

    def __post_init__(self):
        self.m, self.v, self.most, self.t = np.zeros(self.size), np.zeros(self.size), np.zeros(self.size), 0

    def step(self, w, g, used, rate):
        self.t += 1
        m = self.m[used] = self.beta1 * self.m[used] + (1 - self.beta1) * g[used]
        off = g[used] - m if self.belief else g[used]
        v = self.v[used] = self.beta2 * self.v[used] + (1 - self.beta2) * off * off + (self.eps if self.belief else 0.0)
        if self.amsgrad:
            v = self.most[used] = np.maximum(self.most[used], v)
        m_hat = m if self.belief else m / (1 - self.beta1**self.t)
        move = rate * m_hat / (np.sqrt(v / (1 - self.beta2**self.t)) + self.eps)
        if self.decay:
            tied = np.isin(used, list(self.decayed))
            w[used[tied]] -= rate * self.decay * w[used[tied]]
        w[used] += move


@dataclass
class AdaDelta(Solver):
    """Ignores the rate."""

    size: int
    rho: float = 0.95
    eps: float = 1e-8

    def __post_init__(self):
        self.g2, self.d2 = np.zeros(self.size), np.zeros(self.size)

    def step(self, w, g, used, rate):
        self.g2[used] = self.rho * self.g2[used] + (1 - self.rho) * g[used] ** 2
        move = np.sqrt(self.d2[used] + self.eps) / np.sqrt(self.g2[used] + self.eps) * g[used]
        self.d2[used] = self.rho * self.d2[used] + (1 - self.rho) * move**2
        w[used] += move


#: Solver by configuration number; others are plain ascent.
SOLVERS: dict[int, Callable[[int], Solver]] = {
    0: lambda n: Sgd(), 1: lambda n: Momentum(n), 2: lambda n: Adam(n), 3: lambda n: AdaDelta(n), 4: lambda n: Adam(n, decay=0.01, decayed=(0,)), 5: lambda n: Adam(n, belief=True),
}


def solver(number: int, size: int) -> Solver:
    return SOLVERS.get(number, SOLVERS[0])(size)


def initial_weights(size: int, kind: str = "uniform", seed: int = 0, bias: bool = True, fan_in: int = 1) -> np.ndarray:
    """Seeded weights; a linear model's bias starts between -3 and 0."""
    rng = np.random.default_rng(seed)
    w = {"uniform": lambda: rng.uniform(-0.5, 0.5, size), "normal": lambda: rng.normal(0, 0.1, size), "zero": lambda: np.zeros(size), "scaled": lambda: rng.normal(0, math.sqrt(2 / fan_in), size)}[kind]()
    if bias and size:
        w[0] = rng.uniform(-3, 0)
    return w


# Networks: I2, L13-L16 ---------------------------------------------------------------------------------------------------------------

_ACTS: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda z: z, lambda z: np.ones_like(z)),
    "relu": (lambda z: np.maximum(z, 0), lambda z: (z > 0) * 1.0),
    "leaky": (lambda z: np.where(z > 0, z, 0.01 * z), lambda z: np.where(z > 0, 1.0, 0.01)),
    "alternating": (lambda z: np.where(np.arange(z.shape[-1]) % 2, np.minimum(z, 0), np.maximum(z, 0)), lambda z: np.where(np.arange(z.shape[-1]) % 2, z < 0, z > 0) * 1.0),
}


@dataclass
class Network:
    """The first layer adds sparse columns and has no bias of its own (index 0 is one of its inputs); later layers have the bias first."""

    inputs: int
    nodes: Sequence[int]
    acts: Sequence[str]
    weights: np.ndarray
    frozen: Sequence[bool] = ()

    def shapes(self) -> list[tuple[int, int]]:
        return [(self.inputs, self.nodes[0]), *((a + 1, b) for a, b in zip(self.nodes, self.nodes[1:]))]

    def layers(self) -> list[np.ndarray]:
        out, at = [], 0
        for a, b in self.shapes():
            out.append(self.weights[at:at + a * b].reshape(b, a))
            at += a * b
        if at != len(self.weights):
            raise ValueError(f"{len(self.weights)} weights for {at} places")
        return out

    def forward(self, features: Sequence[int], keep: Sequence[np.ndarray] | None = None, p: Sequence[float] = ()) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        """(theta, layer inputs z, layer outputs a). keep: kept nodes per hidden layer, scaled by 1 / (1 - p)."""
        layers, zs, acts = self.layers(), [], []
        a = None
        for k, w in enumerate(layers):
            z = w[:, list(features)].sum(axis=1) if k == 0 else w[:, 0] + w[:, 1:] @ a
            a = _ACTS[self.acts[k]][0](z)
            if keep is not None and k < len(layers) - 1:
                a = a * keep[k] / (1 - p[k])
            zs.append(z)
            acts.append(a)
        return float(a[0]), zs, acts

    def gradient(self, features: Sequence[int]) -> np.ndarray:
        """D theta / d weight, by backward deltas; frozen layers get 0."""
        layers = self.layers()
        _, zs, acts = self.forward(features)
        out = [np.zeros_like(w) for w in layers]
        delta = _ACTS[self.acts[-1]][1](zs[-1])
        for k in range(len(layers) - 1, -1, -1):
            if not (self.frozen and self.frozen[k]):
                if k == 0:
                    out[0][:, list(features)] = delta[:, None]
                else:
                    out[k][:, 0], out[k][:, 1:] = delta, delta[:, None] * acts[k - 1][None, :]
            if k:
                delta = (layers[k][:, 1:].T @ delta) * _ACTS[self.acts[k - 1]][1](zs[k - 1])
        return np.concatenate([g.ravel() for g in out])


def dropout_mask(nodes: int, p: float, seed: int) -> np.ndarray:
    """Exactly floor(p * nodes) nodes are dropped."""
    keep = np.ones(nodes)
    keep[np.random.default_rng(seed).permutation(nodes)[:math.floor(p * nodes)]] = 0
    return keep


def theta_network(features: DataFrame, key: str, net: Network) -> DataFrame:
    """I2."""
    held = features.sparkSession.sparkContext.broadcast(net)  # as many weights as the model has

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            theta = [held.value.forward(x)[0] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(theta, pa.float64())], [key, "theta"])

    packed = features.groupBy(key).agg(F.array_sort(F.collect_set("idx")).alias("idx"))
    return packed.mapInArrow(run, f"{key} {packed.schema[key].dataType.simpleString()}, theta double")


def gradient_network(features: DataFrame, thetas: DataFrame, key: str, group: str, net: Network) -> DataFrame:
    """Per weight, the sum of pull times the unweighted gradient; partial sums leave each batch."""
    held = features.sparkSession.sparkContext.broadcast(net)
    total = F.sum("nu").over(Window.partitionBy(group)) + F.col("nu_stay")
    pull = with_shares(thetas, group).select(key, (F.col("nu") - total * F.col("rho")).alias("pull"))
    packed = features.groupBy(key).agg(F.array_sort(F.collect_set("idx")).alias("idx")).join(pull, key).select("idx", "pull")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grad = np.zeros(len(held.value.weights))
        for batch in batches:
            for idx, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grad += p * held.value.gradient(idx)
        at = np.flatnonzero(grad)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(grad[at])], ["idx", "grad"])

    return packed.mapInArrow(run, "idx long, grad double").groupBy("idx").agg(F.sum("grad").alias("grad"))


# EM: L1-L5, L18 ----------------------------------------------------------------------------------------------------------------------


def ascend(features: DataFrame, thetas_of: Callable[[DataFrame], DataFrame], weights: np.ndarray, key: str, group: str, *, steps: int = 20, rate: float = 0.05, solver_number: int = 2, least_gain: float = 1e-4, no_progress: int = 3, l2: float = 0.0, decay: str = "none", rate_floor: float = 1e-3) -> tuple[np.ndarray, float]:
    """Gradient ascent on the linear model; the best weights and their Q. thetas_of adds group, nu and nu_stay to (key, theta)."""
    spark = features.sparkSession
    used = np.array(sorted(r.idx for r in used_features(features).collect()))  # one number per feature
    step, best, best_q, idle, last = solver(solver_number, len(weights)), weights.copy(), -math.inf, 0, -math.inf
    w = weights.copy()
    for k in range(1, steps + 1):
        param = spark.createDataFrame([(int(i), float(w[i])) for i in used], "idx long, weight double")
        thetas = cut(thetas_of(theta_linear(features, F.broadcast(param), key)))
        q = (loss(thetas, group).first()[0] or 0.0) - 0.5 * l2 * float((w[1:] ** 2).sum())
        if q > best_q:
            best, best_q = w.copy(), q
        idle = idle + 1 if q - last < least_gain * abs(q) else 0
        if idle >= no_progress:
            break
        if idle:
            rate = max(rate / 2, rate_floor)
        last = q
        g = np.zeros(len(w))
        for r in gradient_linear(features, thetas, key, group).collect():  # one number per feature
            g[r.idx] = r.grad
        g[1:] -= l2 * w[1:]
        rate = decayed_rate(rate, k, decay)
        step.step(w, g, used, rate)
    return best, best_q


def em(expect: Callable[[np.ndarray], tuple[Callable[[DataFrame], DataFrame], float]], features: DataFrame, size: int, key: str, group: str, *, rounds: int = 5, restarts: int = 1, least_gain: float = 1e-3, no_progress: int = 2, init: str = "uniform", seed: int = 0, **settings) -> tuple[np.ndarray, list[float]]:
    """L1, L2: alternate ``expect`` (weights to expected counts, and a metric) and ascend(); the weights of the best restart and its Q per round."""
    best, best_path = initial_weights(size, init, seed), [-math.inf]
    for r in range(restarts):
        w, path, idle = initial_weights(size, init, seed + r), [], 0
        for _ in range(rounds):
            thetas_of, _ = expect(w)
            w, q = ascend(features, thetas_of, w, key, group, **settings)
            idle = idle + 1 if path and q - path[-1] < least_gain * abs(q) else 0
            path.append(q)
            if idle >= no_progress:
                break
        if path[-1] > best_path[-1]:
            best, best_path = w, path
    return best, best_path
