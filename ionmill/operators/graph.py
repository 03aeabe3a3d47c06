"""Fragmentation graph operators G2-G3, G10-G20, I3, X3 over fragment and transition tables keyed by mol_id.

Growth is a loop of frontier joins, each an equi join on (mol_id, node) with the filter applied before the next. A round's frontier is
checkpointed, so its plan does not hold the rounds before. A frontier holds only what is new, so the loop ends with an empty one, on cycles too;
only ``likely_expansion`` and the walks take a number of rounds.
Molecules are independent, so every join is co-partitioned by molecule and no round gathers more than its frontier.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

EDGE = ["mol_id", "from_id"]


def log_probs(transitions: DataFrame, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """logp = theta - log(1 + sum of e^theta) over a fragment's transitions."""
    w = Window.partitionBy(*keys, "from_id")
    top = F.greatest(F.max("theta").over(w), F.lit(0.0))
    return transitions.withColumn("logp", F.col("theta") - top - F.log(F.exp(-top) + F.sum(F.exp(F.col("theta") - top)).over(w)))


def persistence(transitions: DataFrame, fragments: DataFrame, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """Log-probability that a fragment stays; 0 without transitions; null (forbidden) for intermediates if the column is_intermediate is there."""
    k = list(keys)
    stay = transitions.groupBy(*k, F.col("from_id").alias("frag_id")).agg(F.greatest(F.max("theta"), F.lit(0.0)).alias("top"), F.collect_list("theta").alias("_t"))
    logp = -(F.col("top") + F.log(F.exp(-F.col("top")) + F.aggregate("_t", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))))
    out = fragments.select(*k, "frag_id", *(["is_intermediate"] if "is_intermediate" in fragments.columns else [])).join(stay, [*k, "frag_id"], "left")
    value = F.coalesce(logp, F.lit(0.0))
    if "is_intermediate" in fragments.columns:
        value = F.when(~F.col("is_intermediate"), value)
    return out.select(*k, "frag_id", value.alias("logp"))


def mark_duplicates(edges: DataFrame, order: Column) -> DataFrame:
    """Of edges with equal ends the first counts; others are duplicates that still carry probability."""
    return edges.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("mol_id", "from_id", "to_id").orderBy(order)) > 1)


def min_depth(transitions: DataFrame, root: int = 0) -> DataFrame:
    """G2's reachability: mol_id, frag_id, depth of every fragment reached from the root."""
    edges = cut(transitions.select("mol_id", "from_id", F.col("to_id").alias("frag_id")).distinct())
    seen = front = cut(edges.select("mol_id").distinct().select("mol_id", F.lit(root).cast("long").alias("frag_id"), F.lit(0).alias("depth")))
    for d in count(1):
        step = front.select("mol_id", F.col("frag_id").alias("from_id")).join(edges, EDGE).select("mol_id", "frag_id").distinct()
        front = cut(step.join(seen, ["mol_id", "frag_id"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def remove_detours(transitions: DataFrame, depths: DataFrame) -> DataFrame:
    """Drops edges that do not lead deeper; trans_id is dense per molecule."""
    a = depths.select("mol_id", F.col("frag_id").alias("from_id"), F.col("depth").alias("d_from"))
    b = depths.select("mol_id", F.col("frag_id").alias("to_id"), F.col("depth").alias("d_to"))
    kept = transitions.join(a, ["mol_id", "from_id"]).join(b, ["mol_id", "to_id"]).where("d_from < d_to").drop("d_from", "d_to")
    return kept.withColumn("trans_id", F.row_number().over(Window.partitionBy("mol_id").orderBy("from_id", "to_id")) - 1)


def height(depths: DataFrame) -> DataFrame:
    """G12."""
    return depths.groupBy("mol_id").agg((F.max("depth") + 1).alias("height"))


def likely_expansion(transitions: DataFrame, threshold: float, most: int = 3, root: int = 0) -> DataFrame:
    """The most likely path to each fragment, grown while its log-probability is at least ``threshold``."""
    edges = cut(log_probs(transitions).select("mol_id", "from_id", F.col("to_id").alias("frag_id"), F.col("logp").alias("step")))
    seen = front = cut(edges.select("mol_id").distinct().select("mol_id", F.lit(root).cast("long").alias("frag_id"), F.lit(0.0).alias("logp")))
    for _ in range(most):
        grown = front.withColumnRenamed("frag_id", "from_id").join(edges, EDGE).select("mol_id", "frag_id", (F.col("logp") + F.col("step")).alias("logp"))
        front = cut(grown.where(F.col("logp") >= threshold).groupBy("mol_id", "frag_id").agg(F.max("logp").alias("logp")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.groupBy("mol_id", "frag_id").agg(F.max("logp").alias("logp"))


def direct_paths(transitions: DataFrame, annotated: DataFrame, root: int = 0) -> DataFrame:
    """Annotated fragments that the root reaches through annotated ones only."""
    own = transitions.join(annotated.select("mol_id", F.col("frag_id").alias("to_id")), ["mol_id", "to_id"], "left_semi")
    return min_depth(own, root).select("mol_id", "frag_id")


def needed(transitions: DataFrame, annotated: DataFrame, root: int = 0) -> DataFrame:
    """Fragments to keep: annotated ones, the root, and those that lead to an annotated one that has no direct path."""
    direct = direct_paths(transitions, annotated, root)
    front = keep = cut(annotated.select("mol_id", "frag_id").join(direct, ["mol_id", "frag_id"], "left_anti").distinct())
    back = cut(transitions.select("mol_id", "from_id", F.col("to_id").alias("frag_id")).distinct())
    while True:
        front = cut(front.join(back, ["mol_id", "frag_id"]).select("mol_id", F.col("from_id").alias("frag_id")).distinct().join(keep, ["mol_id", "frag_id"], "left_anti"))
        if front.isEmpty():
            break
        keep = keep.unionByName(front)
    roots = transitions.select("mol_id").distinct().select("mol_id", F.lit(root).cast("long").alias("frag_id"))
    return keep.unionByName(annotated.select("mol_id", "frag_id")).unionByName(roots).distinct()


def evidence_edges(transitions: DataFrame, beliefs: DataFrame, least: float) -> DataFrame:
    """Edges whose belief reaches ``least`` at some depth; beliefs: mol_id, from_id, to_id, logp."""
    return transitions.join(beliefs.where(F.col("logp") >= least).select("mol_id", "from_id", "to_id").distinct(), ["mol_id", "from_id", "to_id"], "left_semi")


def sample_edges(transitions: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``most`` edges of each molecule (the feature: a sampling operator)."""
    draw = F.xxhash64("mol_id", "from_id", "to_id", F.lit(seed))
    return transitions.withColumn("place", F.row_number().over(Window.partitionBy("mol_id").orderBy(draw, "from_id", "to_id"))).where(F.col("place") <= most).drop("place")


def paths_to(transitions: DataFrame, targets: DataFrame, root: int = 0) -> DataFrame:
    """Edges on root paths to fragments in ``targets`` (mol_id, frag_id)."""
    edges = cut(transitions.select("mol_id", "from_id", F.col("to_id").alias("frag_id")).distinct())
    down = min_depth(transitions, root).select("mol_id", F.col("frag_id").alias("from_id"))
    front, found = targets.select("mol_id", "frag_id").distinct(), None
    while True:
        step = edges.join(front, ["mol_id", "frag_id"]).join(down, EDGE, "left_semi")
        step = cut(step if found is None else step.join(found, [*EDGE, "frag_id"], "left_anti"))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        front = step.select("mol_id", F.col("from_id").alias("frag_id")).distinct()
    none = edges.limit(0)
    return (none if found is None else found).select("mol_id", "from_id", F.col("frag_id").alias("to_id")).distinct()


def common_ancestors(transitions: DataFrame, targets: DataFrame) -> DataFrame:
    """Ancestors with more than one target below, and how many."""
    edges = cut(transitions.select("mol_id", "from_id", F.col("to_id").alias("frag_id")).distinct())
    front = targets.select("mol_id", F.col("frag_id").alias("target"), "frag_id").distinct()
    found = None
    while True:
        step = front.join(edges, ["mol_id", "frag_id"]).select("mol_id", "target", F.col("from_id").alias("frag_id")).distinct()
        front = cut(step if found is None else step.join(found, ["mol_id", "target", "frag_id"], "left_anti"))
        found = front if found is None else found.unionByName(front)
        if front.isEmpty():
            break
    return found.distinct().groupBy("mol_id", F.col("frag_id").alias("ancestor")).agg(F.count(F.lit(1)).alias("n_targets")).where("n_targets > 1")


def random_walks(transitions: DataFrame, walks: int, seed: int = 0, weighted: bool = False, explore: float = 0.1, most: int = 50) -> DataFrame:
    """Edges that seeded walks from the root meet, per molecule. Weighted walks follow softmax weights with the choice to stay."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        mol = key[0].as_py()
        rng = np.random.default_rng([seed, abs(hash(int(mol))) % (1 << 32)])
        out: dict[int, list[tuple[int, float]]] = {}
        for a, b, t in zip(*(table.column(c).to_pylist() for c in ("from_id", "to_id", "theta")), strict=True):
            out.setdefault(a, []).append((b, t))
        for v in out.values():
            v.sort()
        met = set()
        for _ in range(walks + int(weighted)):
            at, seen = 0, {0}
            for _ in range(most):
                ways = [x for x in out.get(at, ()) if x[0] not in seen]
                if not ways:
                    break
                if weighted and rng.random() >= explore:
                    w = np.exp(np.array([0.0, *(t for _, t in ways)]))
                    k = int(rng.choice(len(w), p=w / w.sum())) - 1
                    if k < 0:
                        break
                else:
                    k = int(rng.integers(len(ways)))
                met.add((at, ways[k][0]))
                at = ways[k][0]
                seen.add(at)
        rows = sorted(met)
        return pa.table({"mol_id": pa.array([mol] * len(rows), pa.int64()), "from_id": pa.array([a for a, _ in rows], pa.int64()), "to_id": pa.array([b for _, b in rows], pa.int64())})

    return transitions.select("mol_id", "from_id", "to_id", "theta").groupBy("mol_id").applyInArrow(run, "mol_id long, from_id long, to_id long")
