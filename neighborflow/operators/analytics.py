"""Aggregation over sampled neighbourhoods, ranking metrics, batch statistics, cache admission."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neighborflow.functions.vectors import linear, sum_vectors
from neighborflow.operators.tensor import BROADCAST_BYTES, row_bytes
from neighborflow.scratch import written


def with_vectors(edges: DataFrame, feats: DataFrame, by: list[str], shared: str | None = None) -> DataFrame:
    """Edges with ``vec``: the neighbour's row of feats (id, vec). ``shared``: the column of the edges that names the row, where
    many neighbours have the same one. Such a table is measured; if it is at most BROADCAST_BYTES, decoded, it goes to every
    task and no vector is shuffled. The edges, which are narrow, are then put in order of ``by``, so that sums combine before
    their shuffle; a group may span tasks."""
    at = shared or "nbr"
    table = feats.select(F.col("id").alias("_at"), "vec")
    if shared:
        size = feats.agg(F.coalesce(F.sum(row_bytes(feats, ["vec"])), F.lit(0)).alias("n")).first()["n"]  # one number
        if size <= BROADCAST_BYTES:
            parts = int(feats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            edges, table = edges.repartitionByRange(parts, *by, at), F.broadcast(table)
    return edges.join(table, F.col(at) == F.col("_at")).drop("_at")


def mean_aggregate(edges: DataFrame, feats: DataFrame, by: list[str], with_root: bool = True, dim: int | None = None, shared: str | None = None) -> DataFrame:
    """(by, agg[, root]): elementwise mean of the neighbours' vectors (feats: id, vec); ``shared`` as in ``with_vectors``."""
    joined = with_vectors(edges.select(*by, shared or "nbr"), feats, by, shared)
    sums = sum_vectors(joined, by, "vec", "total", dim, rows="n")
    out = sums.select(*by, F.transform("total", lambda x: x / F.col("n")).alias("agg"))
    return out.join(feats.toDF("ctr", "root"), "ctr") if with_root else out


def layered_mean(levels: list[DataFrame], feats: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, vec) of the seeds after a forward pass over sampled layers, the last hop first: each layer's vector is the
    mean of a vertex's own and the mean of its sampled neighbours' (nbr, ctr). Vertices without neighbours keep theirs."""
    held = feats
    for edges in reversed(levels):
        near = mean_aggregate(edges.select("nbr", "ctr").distinct(), held, ["ctr"], with_root=False, dim=dim).toDF("id", "_near")
        held = held.join(near, "id", "left").select("id", F.when(F.col("_near").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_near", lambda x, y: (x + y) / 2)).alias("vec"))
    return held


@dataclass(frozen=True)
class Layer:
    """Weights of a layer: of the neighbours' mean, of a vertex's own vector (None: it has no part), and the bias."""

    near: list[list[float]]
    root: list[list[float]] | None = None
    bias: list[float] | None = None


def layered_forward(levels: list[DataFrame], feats: DataFrame, layers: list[Layer]) -> DataFrame:
    """(id, vec) after a forward pass over sampled layers (nbr, ctr), the last hop first, one of ``layers`` each: weighted
    mean of the neighbours plus the weighted own vector, negatives cut to 0 but after the last. A vertex without
    neighbours has a mean of 0."""
    if len(levels) != len(layers):
        raise ValueError("a layer is needed for each sampled hop")
    held = feats
    for at, (edges, layer) in enumerate(zip(reversed(levels), layers, strict=True)):
        width = len(layer.near[0])
        near = mean_aggregate(edges.select("nbr", "ctr"), held, ["ctr"], with_root=False, dim=width).toDF("id", "_near")
        new = linear(F.coalesce("_near", F.array(*[F.lit(0.0)] * width)), layer.near, layer.bias)
        if layer.root:
            new = F.zip_with(new, linear(F.col("vec"), layer.root), lambda x, y: x + y)
        if at + 1 < len(layers):
            new = F.transform(new, lambda x: F.greatest(x, F.lit(0.0)))
        held = held.join(near, "id", "left").select("id", new.alias("vec"))
    return held


def layer_weights(weights: DataFrame) -> list[dict[str, np.ndarray]]:
    """Matrices by layer and part from rows (layer, part, row, values): parts near, root and bias, the last with one value a
    row. A model's weights do not grow with the data; more than BROADCAST_BYTES of them are refused."""
    size = weights.agg(F.sum(8 * F.size("values")).alias("n")).first()["n"] or 0  # one number
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of weights are too many to send to every task")
    found: dict[int, dict[str, dict[int, list[float]]]] = {}
    for r in weights.select("layer", "part", "row", "values").collect():  # bounded above
        found.setdefault(r["layer"], {}).setdefault(r["part"], {})[r["row"]] = r["values"]
    return [{part: np.array([rows[i] for i in sorted(rows)], float) for part, rows in found[layer].items()} for layer in sorted(found)]


def kept(seed: int, layer: int, pos: np.ndarray, dim: int, share: float) -> np.ndarray:
    """Which elements of rows at ``pos`` stay under dropout: a hash of place and dimension, the same wherever it is taken."""
    with np.errstate(over="ignore"):
        x = pos.astype("u8")[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim, dtype="u8") * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed * 1_000_003 + layer)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) / float(1 << 53) >= share


#: Rows of a batch that go through a layer's matrices at once.
SLICE_ROWS = 1024


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, nulls as zeros."""
    out = np.zeros((len(vectors), width))
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    out[there] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def flow_forward(nodes: DataFrame, edges: DataFrame, feats: DataFrame, weights: DataFrame, hops: int, dropout: float = 0.0, seed: int = 62) -> DataFrame:
    """(pos, id, vec) of the seeds after a forward pass over a sampled flow, as ``resample_all`` gives it: nodes (pos, id, hop),
    edges (hop, ctr_pos, nbr_pos). Features are gathered once for all nodes. Each hop, the last first, is a block of its own
    whose targets are the first of its sources: the neighbours' mean and the target's own vector go through a layer's
    matrices, SLICE_ROWS at a time, so that a worker holds one batch as it comes and a slice of what is made; between layers
    negatives are cut to 0 and, in training, a share ``dropout`` of the elements, the rest being scaled up. A node without
    features has zeros, one without neighbours a mean of zeros."""
    model = layer_weights(weights)
    if len(model) != hops:
        raise ValueError("a layer is needed for each sampled hop")
    sent = nodes.sparkSession.sparkContext.broadcast(model)
    held = nodes.join(feats.select("id", "vec"), "id", "left").select("pos", "id", "hop", "vec")
    for layer, hop in enumerate(reversed(range(hops))):
        near = sum_vectors(edges.where(F.col("hop") == hop).join(held.select(F.col("pos").alias("nbr_pos"), "vec"), "nbr_pos"), ["ctr_pos"], "vec", "near", rows="n")
        block = held.where(F.col("hop") <= hop).join(near.withColumnRenamed("ctr_pos", "pos"), "pos", "left")

        def forward(batches, layer=layer):
            w = sent.value[layer]
            width, out = w["near"].shape[1], len(w["near"])
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    pos = part.column("pos").to_numpy(zero_copy_only=False)
                    n = part.column("n").fill_null(1).to_numpy(zero_copy_only=False).astype(float)
                    new = matrix(part.column("near"), width) / np.maximum(n, 1)[:, None] @ w["near"].T
                    if "root" in w:
                        new += matrix(part.column("vec"), width) @ w["root"].T
                    if "bias" in w:
                        new += w["bias"][:, 0]
                    if layer + 1 < hops:
                        new = np.maximum(new, 0)
                        if dropout:
                            new = new * kept(seed, layer, pos, out, dropout) / (1 - dropout)
                    ends = pa.array(np.arange(len(new) + 1, dtype=np.int32) * out)
                    vec = pa.ListArray.from_arrays(ends, pa.array(new.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("pos"), part.column("id"), part.column("hop"), vec], ["pos", "id", "hop", "vec"])

        held = written(block.mapInArrow(forward, "pos long, id long, hop int, vec array<double>"), "layer")
    return held.select("pos", "id", "vec")


def normalised_sum(edges: DataFrame, feats: DataFrame, dim: int | None = None, shared: str | None = None) -> DataFrame:
    """(ctr, agg): neighbours' vectors, each over the square root of both ends' degrees; ``shared`` as in ``with_vectors``."""
    d_nbr = edges.groupBy("nbr").agg(F.count("*").alias("_dn"))
    d_ctr = edges.groupBy("ctr").agg(F.count("*").alias("_dc"))
    weighted = edges.join(d_nbr, "nbr").join(d_ctr, "ctr").select("ctr", shared or "nbr", (1 / F.sqrt(F.col("_dn") * F.col("_dc"))).alias("_a"))
    return sum_vectors(with_vectors(weighted, feats, ["ctr"], shared), ["ctr"], "vec", "agg", dim, weight="_a")


def attention_aggregate(edges: DataFrame, feats: DataFrame, by: list[str], score: str, dim: int | None = None, shared: str | None = None) -> DataFrame:
    """(by, agg): neighbours' vectors weighted by the softmax of an edge score within the group; ``shared`` as in
    ``with_vectors``."""
    top = edges.groupBy(*by).agg(F.max(score).alias("_top"))
    e = edges.join(top, by).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = e.groupBy(*by).agg(F.sum("_e").alias("_z"))
    weighted = e.join(total, by).select(*by, shared or "nbr", (F.col("_e") / F.col("_z")).alias("_a"))
    return sum_vectors(with_vectors(weighted, feats, by, shared), by, "vec", "agg", dim, weight="_a")


def mean_reciprocal_rank(scores: DataFrame, query: str, score: str, label: str) -> DataFrame:
    """mrr over queries: the best rank of a positive, equal scores sharing the better rank, nulls last. The rank is one more
    than the number of higher scores, so both steps combine on the map side and no query is sorted in one task."""
    best = scores.where(F.col(label) == 1).groupBy(F.col(query).alias("_q")).agg(F.max(score).alias("_best"))
    higher = F.coalesce(F.col(score) > F.col("_best"), F.col("_best").isNull() & F.col(score).isNotNull())
    ranked = scores.join(best, F.col(query).eqNullSafe(F.col("_q"))).groupBy("_q").agg((F.sum(higher.cast("long")) + 1).alias("_r"))
    return ranked.agg(F.avg(1 / F.col("_r")).alias("mrr"))


def auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney with ties at the mean rank. Ranks come from counts per distinct score, so the running sum is over
    scores, numbered by range, not over rows in one task."""
    from neighborflow.operators.numbering import prefix_sum

    per = scores.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    ranked = prefix_sum(per, ["s"], "n", "below")
    t = ranked.agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return t.select(F.when((p > 0) & (n > 0), (F.col("r") - p * (p + 1) / 2) / (p * n)).alias("auc"))


def confusion(pred: DataFrame, predicted: str, label: str) -> DataFrame:
    one = lambda a, b: F.sum(F.when((F.col(predicted) == a) & (F.col(label) == b), 1).otherwise(0)).cast("long")
    t = pred.agg(one(1, 1).alias("tp"), one(1, 0).alias("fp"), one(0, 0).alias("tn"), one(0, 1).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return t.withColumn("accuracy", F.when(n > 0, (F.col("tp") + F.col("tn")) / n))


def argmax_accuracy(vectors: DataFrame, vec: str, label: str) -> DataFrame:
    """Share of rows whose largest component, the first of equals, is at the label."""
    at = F.array_position(F.col(vec), F.array_max(vec)) - 1
    return vectors.agg(F.avg((at == F.col(label)).cast("double")).alias("accuracy"))


def weighted_mean(batches: DataFrame, value: str, size: str) -> DataFrame:
    return batches.agg((F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("mean"))


def batch_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per batch: seeds, nodes, edges."""
    n = nodes.groupBy("batch_id").agg(F.sum((F.col("hop") == 0).cast("long")).alias("batch_size"), F.count("*").alias("num_nodes"))
    return n.join(edges.groupBy("batch_id").agg(F.count("*").alias("num_edges")), "batch_id", "left").select("batch_id", "batch_size", "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"))


def hop_counts(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes per (batch, type, hop) and edges per (batch, type, hop)."""
    return nodes.groupBy("batch_id", "vtype", "hop").agg(F.count("*").alias("num_sampled_nodes")), edges.groupBy("batch_id", "etype", "hop").agg(F.count("*").alias("num_sampled_edges"))


def cache_admission(accesses: DataFrame, ratio: float, ways: int = 32) -> DataFrame:
    """(id, set_id, cnt) of the rows that a cache of ``ways`` entries per set admits: the most accessed, ties by id."""
    coverage = min(16384, max(ways, round(ways / ratio)))
    counts = accesses.where("id >= 0").groupBy("id").agg(F.count("*").alias("cnt")).withColumn("set_id", F.floor(F.col("id") / coverage).cast("long"))
    w = Window.partitionBy("set_id").orderBy(F.col("cnt").desc(), F.col("id").asc())
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= ways).select("id", "set_id", "cnt")


def hit_rate(accesses: DataFrame, cached: DataFrame) -> DataFrame:
    hits = accesses.where("id >= 0").groupBy("id").agg(F.count("*").alias("n")).join(cached.select("id", F.lit(1).alias("_in")), "id", "left")
    return hits.agg((F.sum(F.when(F.col("_in") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("hit_rate"))
