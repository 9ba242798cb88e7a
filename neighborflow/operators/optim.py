"""Sparse optimizer steps on embedding tables: gradients of a row are summed, then rows that have one move once.

A table is (id, vec); states are array columns beside it. Rows without gradients stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.functions.keys import key, uniform
from neighborflow.functions.vectors import constant_like, sum_vectors, zip_map
from neighborflow.operators import tensor

STATES = {"sgd": {}, "adam": {"m": 0.0, "v": 0.0}, "adagrad": {"state_sum": 0.0}, "rmsprop": {"v": 0.0}}
DEFAULTS = {
    "sgd": {"weight_decay": 0.0},
    "adam": {"weight_decay": 0.0, "epsilon": 1e-8, "beta1": 0.9, "beta2": 0.999, "adam_w": 0.0},
    "adagrad": {"weight_decay": 0.0, "epsilon": 1e-8},
    "rmsprop": {"weight_decay": 0.0, "epsilon": 1e-8, "alpha": 0.99},
}


def dedup_gradients(grads: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, grad) rows to one row per id, summed in double."""
    return sum_vectors(grads, ["id"], "grad", "grad", dim)


def with_state(table: DataFrame, kind: str) -> DataFrame:
    """The table with its optimizer's fresh state."""
    if kind not in STATES:
        raise ValueError(f"optimizer must be one of {sorted(STATES)}")
    out = table.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))
    for name, value in STATES[kind].items():
        out = out.withColumn(name, constant_like(F.col("vec"), value))
    return out.withColumn("beta1t", F.lit(1.0)).withColumn("beta2t", F.lit(1.0)) if kind == "adam" else out


def xavier_uniform(spark: SparkSession, n: int, dim: int, seed: int) -> DataFrame:
    """A new table (id, vec) of n rows, uniform in plus or minus the square root of 6 / (n + dim), each element by its own
    key: rows may be made again anywhere."""
    bound = (6 / (n + dim)) ** 0.5
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (uniform(key(seed, "init", F.col("id"), i)) * 2 - 1) * bound).alias("vec"))


def state_names(kind: str) -> list[str]:
    return [*STATES[kind], *(["beta1t", "beta2t"] if kind == "adam" else [])]


def step(table: DataFrame, grads: DataFrame, kind: str, lr: float, params: dict | None = None, dim: int | None = None, summed: bool = False) -> DataFrame:
    """One lazy step. The join is by id, so a table bucketed or partitioned by id is not shuffled. ``summed``: grads have
    one row per id already, as ``dedup_gradients`` gives them; steps on the same gradients sum them once."""
    if kind not in DEFAULTS:
        raise ValueError(f"optimizer must be one of {sorted(DEFAULTS)}")
    if unknown := set(params or {}) - set(DEFAULTS[kind]):
        raise ValueError(f"{kind} has no parameter {sorted(unknown)}")
    p = DEFAULTS[kind] | (params or {})
    wd = p["weight_decay"]
    joined = table.join((grads if summed else dedup_gradients(grads, dim)).select("id", F.col("grad").alias("_g")), "id", "left")
    hit, w, g = F.col("_g").isNotNull(), F.col("vec"), F.col("_g")
    decoupled = kind == "adam" and p["adam_w"] > 0.5
    if wd and not decoupled:
        g = F.zip_with(g, w, lambda a, b: a + F.lit(wd) * b)
    new: dict[str, Column] = {}
    if kind == "sgd":
        new["vec"] = F.zip_with(w, g, lambda a, b: a - F.lit(lr) * b)
    elif kind == "adam":
        b1, b2 = F.lit(p["beta1"]), F.lit(p["beta2"])
        new["beta1t"], new["beta2t"] = F.col("beta1t") * b1, F.col("beta2t") * b2
        new["m"] = F.zip_with("m", g, lambda m, x: b1 * m + (1 - b1) * x)
        new["v"] = F.zip_with("v", g, lambda v, x: b2 * v + (1 - b2) * x * x)
        base = F.transform(w, lambda a: a - F.lit(lr * wd) * a) if decoupled and wd else w
        new["vec"] = zip_map(lambda a, m, v: a - F.lit(lr) * (m / (1 - new["beta1t"])) / (F.sqrt(v / (1 - new["beta2t"])) + F.lit(p["epsilon"])), base, new["m"], new["v"])
    elif kind == "adagrad":
        new["state_sum"] = F.zip_with("state_sum", g, lambda s, x: s + x * x)
        new["vec"] = zip_map(lambda a, x, s: a - F.lit(lr) * x / (F.sqrt(s) + F.lit(p["epsilon"])), w, g, new["state_sum"])
    else:
        al = F.lit(p["alpha"])
        new["v"] = F.zip_with("v", g, lambda v, x: al * v + (1 - al) * x * x)
        new["vec"] = zip_map(lambda a, x, v: a - F.lit(lr) * x / (F.sqrt(v) + F.lit(p["epsilon"])), w, g, new["v"])
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


class SparseOptimizer:
    """Gradients of several tables buffered until ``step``."""

    def __init__(self, kind: str, params: dict | None = None):
        self.kind, self.params, self.tables, self.grads, self.need_apply = kind, params, {}, {}, set()

    def add_embedding(self, name: str, table: DataFrame) -> None:
        if name in self.tables:
            raise ValueError(f"{name} already has an optimizer")
        self.tables[name] = with_state(table, self.kind)

    def gather(self, name: str, indices: DataFrame, training: bool = False) -> DataFrame:
        """Rows (pos, id) of a table; in training the table is marked, and ``step`` waits for its gradients."""
        if training:
            self.need_apply.add(name)
        return tensor.gather(self.tables[name], indices, ["vec"])

    def add_gradients(self, name: str, grads: DataFrame) -> None:
        self.grads[name] = self.grads[name].unionByName(grads) if name in self.grads else grads

    def step(self, lr: float) -> None:
        from neighborflow.scratch import written

        if missing := self.need_apply - set(self.grads):
            raise ValueError(f"{sorted(missing)} were gathered for training and have no gradients")
        for name, grads in self.grads.items():
            self.tables[name] = written(step(self.tables[name], grads, self.kind, lr, self.params), "embedding")
        self.grads, self.need_apply = {}, set()
