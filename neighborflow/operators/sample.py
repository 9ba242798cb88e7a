"""Neighbourhood sampling.

``one_hop``: every centre of a list on its own, duplicates included. ``resample_all``: hop after hop from all nodes so
far. ``neighbor_sample``: batches of seeds over typed edges; each hop expands the vertices found in the hop before, keeps
at most k edges per batch, centre and edge type, and keeps edges to vertices already seen. Options: weights, replacement,
time, disjoint trees.

The frontier is always joined to the edges before edges are ranked, so only candidates are shuffled; each edge type has
its k as a literal, so that the ranking keeps k rows per group on both sides of its exchange.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neighborflow.functions.keys import exponential_key, key, key_int, uniform
from neighborflow.model import EdgeType, edge_type_ids
from neighborflow.scratch import written

COMPARE = {
    "strictly_increasing": lambda e, t: e > t,
    "monotonically_increasing": lambda e, t: e >= t,
    "strictly_decreasing": lambda e, t: e < t,
    "monotonically_decreasing": lambda e, t: e <= t,
    "last": lambda e, t: e <= t,
}


def one_hop(centres: DataFrame, edges: DataFrame, k: int, seed: int, weight: str | None = None) -> DataFrame:
    """(pos, ctr, eid, nbr) for centres (pos, id). k <= 0 takes all. At most k neighbours: all of them, whatever their
    weights; more: k by key, or the k largest ln(u)/weight."""
    cand = centres.select("pos", F.col("id").alias("ctr")).join(edges, "ctr")
    if k <= 0:
        return cand.select("pos", "ctr", "eid", "nbr")
    draw = key(seed, F.col("pos"), F.col("ctr"), F.col("eid"))
    if weight is None:
        order = [draw.asc(), F.col("eid").asc()]
    else:  # rows whose weight is no positive number come last, in order of their key
        order = [F.when(F.col(weight) > 0, exponential_key(draw, F.col(weight))).desc_nulls_last(), draw.asc(), F.col("eid").asc()]
    w = Window.partitionBy("pos").orderBy(*order)
    return cand.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("pos", "ctr", "eid", "nbr")


def sample_offsets(centres: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(pos, offset): exclusive prefix sums of min(degree, k)."""
    from neighborflow.operators.layout import degree
    from neighborflow.operators.numbering import prefix_sum

    deg = centres.join(degree(edges).toDF("id", "deg"), "id", "left").select("pos", F.least(F.coalesce("deg", F.lit(0)), F.lit(k if k > 0 else 2**62)).alias("n"))
    return prefix_sum(deg, ["pos"], "n", "offset").select("pos", "offset")


def resample_all(seeds: DataFrame, edges: DataFrame, fanout: list[int], seed: int, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (pos, id, hop) and edges (hop, ctr_pos, nbr_pos, eid): each hop samples from all unique nodes so far. A node's hop
    is 0 for seeds, else one more than that of the edges it was found by; places ascend with it."""
    from neighborflow.operators.layout import append_unique

    nodes, found = seeds.select(F.col("pos").cast("long").alias("pos"), "id"), None
    when = F.lit(0)
    for hop, k in enumerate(fanout):
        got = written(one_hop(nodes, edges, k, seed * 1000 + hop, weight).withColumn("npos", F.col("eid")), "hop")
        before = nodes.count()
        nodes, _ = append_unique(nodes, got.select("npos", F.col("nbr").alias("id")))
        nodes, when = written(nodes, "nodes"), F.when(F.col("pos") >= before, hop + 1).otherwise(when)
        out = got.join(nodes.toDF("nbr_pos", "nbr"), "nbr").select(F.lit(hop).alias("hop"), F.col("pos").alias("ctr_pos"), "nbr_pos", "eid")
        found = out if found is None else found.unionByName(out)
    return nodes.withColumn("hop", when.cast("int")), found


@dataclass(frozen=True)
class Options:
    """weighted: draw by wgt, never an edge of weight 0; replace: k independent draws, but for the rule ``last``, which draws
    nothing; time: a rule of COMPARE between an edge's time and its centre's; disjoint: within a batch a vertex belongs to one seed's tree."""

    weighted: bool = False
    replace: bool = False
    time: str | None = None
    disjoint: bool = False
    seed: int = 62


def _redrawn(cand: DataFrame, group: list[str], k: int, o: Options) -> DataFrame:
    """k independent draws for each group. All edges are numbered by group and id, or also summed up by weight, in a range
    sort, so that a group may span tasks; a draw is its group's first number plus a place, or a point of its sum, and is
    joined to the one edge there."""
    from neighborflow.operators.numbering import number_rows, prefix_within, search_sorted

    draws = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    if not o.weighted:
        placed = number_rows(cand, [*group, "eid"], "_r")
        each = placed.groupBy(*group).agg(F.min("_r").alias("_first"), F.count("*").alias("_deg")).select(*group, "_first", "_deg", draws.alias("draw"))
        chosen = each.select((F.col("_first") + key_int(key(o.seed, *[F.col(g) for g in group], F.col("draw"))) % F.col("_deg")).alias("_r"))
        return chosen.join(placed, "_r").select(*cand.columns)
    summed = written(number_rows(prefix_within(cand, group, ["eid"], "wgt", "_hi", "_all"), [*group, "eid"], "_r"), "summed")
    each = summed.groupBy(*group).agg(F.first("_all").alias("_all")).select(*group, "_all", draws.alias("draw"))
    points = each.withColumn("_u", uniform(key(o.seed, *[F.col(g) for g in group], F.col("draw"), "weight")) * F.col("_all"))
    found = search_sorted(summed.select(*group, "_hi"), points, "_hi", "_u", "_r", by=tuple(group))
    return found.select("_r").join(summed, "_r").select(*cand.columns)


def _pick(cand: DataFrame, group: list[str], k: int, o: Options, draw: Column) -> DataFrame:
    if k < 0:
        return cand
    if o.replace and o.time != "last":
        return _redrawn(cand, group, k, o)
    order = [exponential_key(draw, F.col("wgt")).desc(), F.col("eid").asc()] if o.weighted else [draw.asc(), F.col("eid").asc()]
    if o.time == "last":
        order = [F.col("etime").desc(), F.col("eid").asc()]
    w = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def neighbor_sample(edges: dict[EdgeType, DataFrame], seeds: DataFrame, fanout: dict[EdgeType, list[int]], options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """seeds (batch_id, pos, vtype, id[, t]) to edges (batch_id, hop, etype, eid, nbr_type, nbr, ctr_type, ctr) and nodes
    (batch_id, vtype, id, hop, pos, root): for each vertex the hop that found it, 0 for seeds, and its seed's place."""
    o = options
    if o.time is not None and o.time not in COMPARE:
        raise ValueError(f"time must be one of {sorted(COMPARE)}")
    ids = edge_type_ids(edges)
    hops = len(next(iter(fanout.values()))) if fanout else 0
    t = F.col("t").cast("long") if "t" in seeds.columns else F.lit(None).cast("long")
    first = seeds.select("batch_id", "vtype", "id", F.col("pos").cast("long").alias("pos"), t.alias("t"))
    # A vertex that is a seed twice belongs to the first place; its time is the first place's.
    frontier = first.groupBy("batch_id", "vtype", "id").agg(F.min("pos").alias("pos"), F.min_by("t", "pos").alias("t")).withColumn("root", F.col("pos"))
    levels, found = [frontier.withColumn("hop", F.lit(0))], []
    upward = o.time in ("strictly_increasing", "monotonically_increasing")
    for hop in range(hops):
        parts = []
        for e in sorted(edges):
            k = fanout.get(e, [0] * hops)[hop]
            if k == 0:
                continue
            f = frontier.where(F.col("vtype") == e.ctr).select("batch_id", F.col("id").alias("ctr"), "t", "root")
            cand = f.join(edges[e], "ctr")
            if o.weighted:
                cand = cand.where("wgt > 0")
            if o.time:
                cand = cand.where(COMPARE[o.time](F.col("etime"), F.col("t")))
            draw = key(o.seed, F.col("batch_id"), hop, ids[e], F.col("ctr"), F.col("eid"))
            got = _pick(cand, ["batch_id", "ctr"], k, o, draw)
            parts.append(
                got.select("batch_id", F.lit(hop).alias("hop"), F.lit(str(e)).alias("etype"), F.lit(ids[e]).alias("etype_id"), "eid", F.lit(e.nbr).alias("nbr_type"), "nbr", F.lit(e.ctr).alias("ctr_type"), "ctr", "root",
                           (F.col("etime").cast("long") if "etime" in got.columns else F.lit(None).cast("long")).alias("etime"))
            )
        if not parts:
            break
        level = reduce(DataFrame.unionByName, parts)
        if hop or len(parts) > 1 or hops > 1:
            level = written(level, "level")  # used three times below; lineage ends here
        seen = reduce(DataFrame.unionByName, [x.select("batch_id", "vtype", "id", "root") for x in levels])
        met = level.select("batch_id", F.col("nbr_type").alias("vtype"), F.col("nbr").alias("id"), "root", "eid", "etime")
        if o.disjoint:
            # An edge into another tree's vertex is dropped; a new vertex goes to the smallest (root, edge).
            old = seen.select("batch_id", F.col("vtype").alias("nbr_type"), F.col("id").alias("nbr"), F.col("root").alias("owner"))
            new = met.join(seen, ["batch_id", "vtype", "id"], "left_anti").groupBy("batch_id", F.col("vtype").alias("nbr_type"), F.col("id").alias("nbr")).agg(F.min("root").alias("owner"))
            level = level.join(old.unionByName(new), ["batch_id", "nbr_type", "nbr"]).where("root = owner").drop("owner")
            met = level.select("batch_id", F.col("nbr_type").alias("vtype"), F.col("nbr").alias("id"), "root", "eid", "etime")
        found.append(level.drop("root", "etime", "etype_id"))
        when = F.min("etime") if upward else F.max("etime")
        fresh = met.join(seen.drop("root"), ["batch_id", "vtype", "id"], "left_anti").groupBy("batch_id", "vtype", "id").agg(F.min("root").alias("root"), when.alias("t"))
        frontier = fresh.select("batch_id", "vtype", "id", F.lit(None).cast("long").alias("pos"), "t", "root")
        frontier = written(frontier, "frontier") if hop + 1 < hops else frontier
        levels.append(frontier.withColumn("hop", F.lit(hop + 1)))
    nodes = reduce(DataFrame.unionByName, [x.select("batch_id", "vtype", "id", "hop", "pos", "root") for x in levels])
    if not found:
        none = seeds.sparkSession.createDataFrame([], "batch_id long, hop int, etype string, eid long, nbr_type string, nbr long, ctr_type string, ctr long")
        return none, nodes
    return reduce(DataFrame.unionByName, found), nodes


def renumber(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local ids per batch and vertex type: seeds first in their order, then by hop and id. Returns edges with row and
    col, and nodes with local_id."""
    from neighborflow.operators.numbering import number_within

    local = number_within(nodes, ["batch_id", "vtype"], ["hop", F.col("pos").asc_nulls_last(), "id"], "local_id")
    by = local.select("batch_id", "vtype", "id", "local_id")
    out = edges.join(by.toDF("batch_id", "nbr_type", "nbr", "row"), ["batch_id", "nbr_type", "nbr"]).join(by.toDF("batch_id", "ctr_type", "ctr", "col"), ["batch_id", "ctr_type", "ctr"])
    return out, local


def call_groups(batches: DataFrame, batch_size: int, per_call: int) -> DataFrame:
    """Batches with call_id: as many whole batches to a call as hold at most ``per_call`` seeds, one at least."""
    if batch_size < 1:
        raise ValueError("the batch size must be positive")
    return batches.withColumn("call_id", F.floor(F.col("batch_id") / max(1, per_call // batch_size)).cast("long"))


def seed_batches(seeds: DataFrame, batch_size: int, shuffle_seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """(input_id, id, ...) to batches in input order or by key: batch_id, pos within the batch; the last may be short or
    dropped."""
    from neighborflow.operators.numbering import number_rows

    order = ["input_id"] if shuffle_seed is None else [key(shuffle_seed, F.col("input_id")).asc(), F.col("input_id").asc()]
    rows = number_rows(seeds, order, "place")
    if drop_last:
        n = rows.count()
        rows = rows.where(F.col("place") < n // batch_size * batch_size)
    return rows.select(*seeds.columns, F.floor(F.col("place") / batch_size).cast("long").alias("batch_id"), (F.col("place") % batch_size).cast("long").alias("pos"))
