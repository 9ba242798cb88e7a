"""Negative edges for link batches, with deterministic draws."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neighborflow.functions.keys import key, key_int, uniform
from neighborflow.operators.tensor import BROADCAST_BYTES
from neighborflow.scratch import written


def how_many(n_pos: int, amount: float, batch_size: int) -> int:
    """At least one per batch."""
    return max(ceil(amount * n_pos), ceil(n_pos / batch_size)) if n_pos else 0


def _drawn(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("neg_pos"))


def draw_uniform(rows: DataFrame, seed: int, role: str, n_nodes: int, name: str, *more) -> DataFrame:
    """A node in [0, n_nodes) for each row, by the key of its place and the role."""
    return rows.withColumn(name, key_int(key(seed, role, F.col("neg_pos"), *more)) % n_nodes)


def draw_weighted(rows: DataFrame, weights: DataFrame, seed: int, role: str, name: str) -> DataFrame:
    """Nodes in proportion to weights (id, w): each node owns an interval of the running sum, in the order of ids, and a draw
    takes the node in whose interval it falls. Draws are ranked among the intervals' ends, sorted together, and the node is
    looked up by that rank: an equi-join, with no node or interval on more than one row."""
    from neighborflow.operators.numbering import number_rows, prefix_sum, search_sorted

    sound = weights.where("w > 0").select("id", F.col("w").cast("double").alias("w"))
    ends = written(number_rows(prefix_sum(sound, ["id"], "w", "lo"), ["id"], "_r").select("id", "_r", "lo", (F.col("lo") + F.col("w")).alias("hi")), "ends")
    total = ends.agg(F.max("hi").alias("w")).first()["w"]  # one number
    if not total:
        raise ValueError("the weights sum to nothing")
    drawn = rows.withColumn("_u", uniform(key(seed, role, F.col("neg_pos"))) * F.lit(float(total)))
    # The rank among the intervals' beginnings, less one; the first begins at 0.
    placed = search_sorted(ends.select("lo"), drawn, "lo", "_u", "_at").withColumn("_at", F.col("_at") - 1)
    return placed.join(ends.select(F.col("_r").alias("_at"), F.col("id").alias(name)), "_at").select(*rows.columns, name)


def binary_negatives(spark, n_pos: int, amount: float, batch_size: int, n_src: int, n_dst: int, seed: int, src_weights: DataFrame | None = None, dst_weights: DataFrame | None = None) -> DataFrame:
    """(neg_pos, nbr, ctr): both ends drawn, uniformly or by weights (id, w)."""
    rows = _drawn(spark, how_many(n_pos, amount, batch_size))
    return _draw(_draw(rows, End("src", "nbr", n_src, weights=src_weights), seed), End("dst", "ctr", n_dst, weights=dst_weights), seed)


def triplet_negatives(positives: DataFrame, n_pos: int, amount: float, batch_size: int, n_dst: int, seed: int, dst_weights: DataFrame | None = None) -> DataFrame:
    """(neg_pos, nbr, ctr): the source nbr of a drawn positive (pos, nbr, ctr), which so needs no sampling of its own, with
    a drawn destination ctr."""
    rows = draw_uniform(_drawn(positives.sparkSession, how_many(n_pos, amount, batch_size)), seed, "pick", max(1, n_pos), "pos")
    return _draw(rows.join(positives.select("pos", "nbr"), "pos"), End("dst", "ctr", n_dst, weights=dst_weights), seed).select("neg_pos", "nbr", "ctr")


@dataclass(frozen=True)
class End:
    """One end of negative links: its role in keys, its column, nodes to draw from, their times and weights."""

    role: str
    name: str
    n_nodes: int
    time: DataFrame | None = None
    weights: DataFrame | None = None


def _draw(rows: DataFrame, end: End, seed: int, *attempt: int) -> DataFrame:
    if end.weights is None:
        return draw_uniform(rows, seed, end.role, end.n_nodes, end.name, *map(F.lit, attempt))
    return draw_weighted(rows, end.weights, seed, "-".join([end.role, *map(str, attempt)]), end.name)


def temporal_links(rows: DataFrame, ends: list[End], seed: int, retries: int | None = None) -> DataFrame:
    """rows (neg_pos, t) with the ends' columns, nodes whose times are at most t. Where no node of a kind is that old, the
    earliest of its kind is taken.

    Without ``retries`` a draw is taken straight from the nodes that are old enough: nodes are numbered by time, the
    number of those up to t is found once for each t, and the key picks one of these places. With weights the running
    sum up to t takes the place of the number. With ``retries`` draws are made from all nodes and made again while one is
    too late; after the first and ``retries`` more, a last one in which a later node gives way to the earliest."""
    if retries is None:
        for e in ends:
            rows = _from_prefix(rows, e, seed)
        return rows
    return _retried(rows, ends, seed, retries)


def _from_prefix(rows: DataFrame, end: End, seed: int) -> DataFrame:
    from neighborflow.operators.numbering import number_rows, prefix_sum, search_sorted

    nodes = end.time.where(F.col("t").isNotNull()).select("id", "t")
    draw = key(seed, end.role, F.col("neg_pos"))
    if end.weights is None:
        nodes = number_rows(nodes, ["t", "id"], "_place")
        times = end.time.where(F.col("t").isNotNull()).groupBy("t").agg(F.count("*").alias("_n"))
        upto = search_sorted(times, rows.select(F.col("t").alias("_t")).distinct(), "t", "_t", "_many", count="_n")
        placed = rows.join(upto, F.col("t").eqNullSafe(F.col("_t")), "left").withColumn("_at", F.when(F.col("_many") > 0, key_int(draw) % F.col("_many")).otherwise(0).cast("long"))
        return placed.join(nodes.select(F.col("_place").alias("_at"), F.col("id").cast("long").alias(end.name)), "_at", "left").select(*rows.columns, end.name)
    weighted = nodes.join(end.weights.where("w > 0").select("id", F.col("w").cast("double").alias("w")), "id")
    nodes = written(number_rows(prefix_sum(weighted, ["t", "id"], "w", "_lo"), ["t", "id"], "_place"), "places")
    sums = nodes.select((F.col("_place") + 1).alias("_many"), (F.col("_lo") + F.col("w")).alias("_sum"))
    upto = search_sorted(nodes.select("t"), rows.select(F.col("t").alias("_t")).distinct(), "t", "_t", "_many").join(sums, "_many", "left")
    drawn = rows.join(upto, F.col("t").eqNullSafe(F.col("_t")), "left").withColumn("_u", uniform(draw) * F.coalesce("_sum", F.lit(0.0)))
    placed = search_sorted(nodes.select("_lo"), drawn, "_lo", "_u", "_at").withColumn("_at", F.greatest(F.col("_at") - 1, F.lit(0)))
    return placed.join(nodes.select(F.col("_place").alias("_at"), F.col("id").cast("long").alias(end.name)), "_at", "left").select(*rows.columns, end.name)


def _retried(rows: DataFrame, ends: list[End], seed: int, retries: int) -> DataFrame:
    """Where the nodes' times are few enough to be sent to every task, all draws are looked up in one pass without a
    shuffle; else only links that have found none go on to the next draw, a written table each."""
    earliest = [e.time.agg(F.min_by("id", F.struct("t", "id")).alias("n")).first()["n"] for e in ends]  # one number each
    few = all(e.weights is None and e.n_nodes * 16 <= BROADCAST_BYTES for e in ends)
    times = [e.time.select(F.col("id").alias("_id"), F.col("t").alias("_t")) for e in ends]

    def timed(cur: DataFrame, i: int) -> DataFrame:
        for e, t in zip(ends, times, strict=True):
            cur = _draw(cur, e, seed, i).join(F.broadcast(t) if few else t, F.col(e.name) == F.col("_id"), "left").withColumnRenamed("_t", f"{e.name}_t").drop("_id")
        return cur

    ok = reduce(Column.__and__, [F.coalesce(F.col(f"{e.name}_t") <= F.col("t"), F.lit(False)) for e in ends])
    settled = [F.when(F.col(f"{e.name}_t") <= F.col("t"), F.col(e.name)).otherwise(F.lit(n)).cast("long").alias(e.name) for e, n in zip(ends, earliest, strict=True)]
    drawn = [F.col(e.name).cast("long").alias(e.name) for e in ends]
    keep = rows.columns
    if few:
        cur, found = rows, F.lit(None)
        for i in range(retries + 2):
            cur = timed(cur, i)
            got = F.struct(*settled) if i > retries else F.when(ok, F.struct(*drawn))
            cur = cur.select(*keep, (F.coalesce("_got", got) if i else got).alias("_got"))
        return cur.select(*keep, *[F.col("_got")[e.name].alias(e.name) for e in ends])
    pending, done = rows, []
    for i in range(retries + 1):
        cur = written(timed(pending, i), "draw")
        done.append(cur.where(ok).select(*keep, *drawn))
        pending = cur.where(~ok).select(*keep)
    return reduce(DataFrame.unionByName, [*done, timed(pending, retries + 1).select(*keep, *settled)])


def temporal_negatives(rows: DataFrame, node_time: DataFrame, n_nodes: int, seed: int, role: str, retries: int | None = None) -> DataFrame:
    """rows (neg_pos, t) to (neg_pos, node): a draw not later than t, else the earliest node of all."""
    return temporal_links(rows, [End(role, "node", n_nodes, node_time)], seed, retries).select("neg_pos", "node")


def deduplicated(negatives: DataFrame) -> DataFrame:
    """Of equal pairs the first place stays."""
    return negatives.groupBy("nbr", "ctr").agg(F.min("neg_pos").alias("neg_pos")).select("neg_pos", "nbr", "ctr")


def exact_negatives(spark, many: int, n_src: int, n_dst: int, seed: int, positives: DataFrame | None = None) -> DataFrame:
    """(neg_pos, nbr, ctr): ``many`` different pairs, none of them in positives (nbr, ctr); all there are if there are fewer.

    Pairs are whole numbers nbr * n_dst + ctr. A keyed bijection takes each place to a rank among the numbers that are no
    positives, and the rank becomes a number by the positives that come before it: of the sorted positives, the j-th has as
    many others before it as its number less j, so those with at most ``rank`` others before them are counted and
    added. One pass, dense or sparse, without trying."""
    from neighborflow.functions.keys import permuted
    from neighborflow.operators.numbering import number_rows, search_sorted

    if n_src * n_dst >= 1 << 62:
        raise ValueError("the pairs of nodes must be fewer than 2^62")
    others, taken = n_src * n_dst, None
    if positives is not None:
        inside = positives.where((F.col("nbr") >= 0) & (F.col("nbr") < n_src) & (F.col("ctr") >= 0) & (F.col("ctr") < n_dst))
        taken = number_rows(inside.select((F.col("nbr") * n_dst + F.col("ctr")).cast("long").alias("_code")).distinct(), ["_code"], "_j")
        others -= taken.count()
    ranked = permuted(_drawn(spark, min(many, others)), "neg_pos", others, seed, "exact", "_rank")
    if taken is None:
        ranked = ranked.withColumn("_code", F.col("_rank"))
    else:
        gaps = taken.select((F.col("_code") - F.col("_j")).alias("_gap"))
        ranked = search_sorted(gaps, ranked, "_gap", "_rank", "_before").withColumn("_code", F.col("_rank") + F.col("_before"))
    ctr = F.col("_code") % n_dst
    return ranked.select("neg_pos", F.call_function("div", F.col("_code") - ctr, F.lit(n_dst)).alias("nbr"), ctr.alias("ctr"))


def equal_shares(rows: DataFrame, rank: str, order: list) -> DataFrame:
    """Rows dealt to ranks, each cut to the smallest rank's number of rows, so that all take as many steps; what is over in
    the given order, which must be total, is left out."""
    from neighborflow.operators.numbering import number_rows

    ranked = number_rows(rows, [rank, *order], "_r")
    sizes = ranked.groupBy(rank).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))  # one row per rank
    least = sizes.agg(F.min("_n").alias("n")).first()["n"]
    return ranked.join(F.broadcast(sizes), rank).where(F.col("_r") - F.col("_first") < F.lit(least or 0)).select(*rows.columns)


def balanced(links: DataFrame, label: str, seed: int) -> DataFrame:
    """(place, ...): links shuffled by key so that the labels take turns; what one label has more comes last."""
    from neighborflow.operators.numbering import number_rows

    order = key(seed, "turn", F.col(label), F.col("pos"))
    ranked = number_rows(links.withColumn("_k", order), [label, "_k", "pos"], "_r")
    first = ranked.groupBy(label).agg(F.min("_r").alias("_first"))  # one row per label
    turn = ranked.join(F.broadcast(first), label).withColumn("_turn", F.col("_r") - F.col("_first"))
    return number_rows(turn, ["_turn", label], "place").drop("_k", "_r", "_first", "_turn")


def interleave(positives: DataFrame, negatives: DataFrame, n_pos: int, n_neg: int, batch_size: int) -> DataFrame:
    """Link batches: ceil(n_pos / batch_size) batches, positives first in each with label 1, then their share of the
    negatives with label 0 and input id -1; with times t, if both have them."""
    batches = max(1, ceil(n_pos / batch_size))
    share = max(1, ceil(n_neg / batches))
    t = ["t"] if "t" in positives.columns and "t" in negatives.columns else []
    a = positives.select(F.floor(F.col("pos") / batch_size).cast("long").alias("batch_id"), (F.col("pos") % batch_size).cast("long").alias("pos"), F.col("pos").alias("input_id"), "nbr", "ctr", F.lit(1.0).alias("label"), *t)
    size = F.least(F.lit(batch_size), F.lit(n_pos) - F.floor(F.col("neg_pos") / share) * batch_size)
    b = negatives.select(F.floor(F.col("neg_pos") / share).cast("long").alias("batch_id"), (size + F.col("neg_pos") % share).cast("long").alias("pos"), F.lit(-1).cast("long").alias("input_id"), "nbr", "ctr", F.lit(0.0).alias("label"), *t)
    return a.unionByName(b)


def without_false_negatives(negatives: DataFrame, edges: DataFrame) -> DataFrame:
    return negatives.join(edges.select("nbr", "ctr").distinct(), ["nbr", "ctr"], "left_anti")


def link_split(edges: DataFrame, seed: int, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Edges with split train, val or test by key."""
    u = uniform(key(seed, "split", F.col("eid")))
    return edges.withColumn("split", F.when(u < 1 - val - test, "train").when(u < 1 - test, "val").otherwise("test"))
