"""Loaders: seeds and options in, batches of sampled edges, nodes and attributes out.

A loader's tables are lazy; ``write`` stores them as files of whole batches, which trainers open a batch at a time.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neighborflow.functions.keys import epoch_seed, key
from neighborflow.model import EdgeType
from neighborflow.operators import negative, tensor
from neighborflow.operators.numbering import number_rows
from neighborflow.operators.sample import COMPARE, Options, call_groups, neighbor_sample, renumber, seed_batches
from neighborflow.plans.batches import open_batches, write_batches
from neighborflow.plans.stores import FeatureStore, GraphStore
from neighborflow.scratch import folder, written

#: Most links of a batch that one task numbers the ends of.
BATCH_LINKS = 1 << 20


@dataclass
class Sampled:
    """edges (with row, col), nodes (with local_id) and the batch's inputs. Edges and nodes are sampled when one of them is
    first asked for."""

    sample: Callable[[], tuple[DataFrame, DataFrame]]
    inputs: DataFrame

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return self.sample()

    @property
    def edges(self) -> DataFrame:
        return self._tables[0]

    @property
    def nodes(self) -> DataFrame:
        return self._tables[1]

    def positives(self) -> DataFrame:
        """The inputs that were given: drawn negatives have an input id of -1."""
        return self.inputs.where("input_id >= 0")

    def with_features(self, features: FeatureStore, vtype: str, name: str) -> DataFrame:
        """Node attribute by node; unknown ids get nulls."""
        table = features.get(vtype, name)
        if table is None:
            raise KeyError((vtype, name))
        return tensor.gather(table, self.nodes.where(F.col("vtype") == vtype), [c for c in table.columns if c != "id"])

    def with_edge_features(self, features: FeatureStore, edge_type, name: str) -> DataFrame:
        table = features.get(edge_type, name)
        if table is None:
            raise KeyError((edge_type, name))
        mine = self.edges.where(F.col("etype") == str(EdgeType(*edge_type)))
        return mine.join(table.withColumnRenamed("id", "eid"), "eid", "left")

    def write(self, path: str, files: int | None = None) -> None:
        """Edges, nodes and inputs as files of whole batches; see ``plans.batches`` for how trainers open them."""
        write_batches({"edges": self.edges, "nodes": self.nodes, "inputs": self.inputs}, path, files)

    def batches(self, path: str | None = None, rank: int = 0, world: int = 1) -> Iterator[tuple[int, list, list]]:
        """(batch, edge rows, node rows) in order, of one of ``world`` trainers: written once, under ``path`` or in the shared
        folder, and opened a batch at a time."""
        if path is None:
            path = folder(self.edges.sparkSession, "batches")
            self.write(path)
        for batch, rows in open_batches(path, rank, world):
            yield batch, rows["edges"], rows["nodes"]


def parse_fanout(layers: int, text: str) -> list[int]:
    """``"30,20"``; a single value holds for all layers."""
    values = [int(x) for x in text.split(",")]
    values = values * layers if len(values) == 1 else values
    if len(values) != layers:
        raise ValueError("one fan-out per layer is needed")
    return values


def fanout_by_type(num_neighbors, types: list[EdgeType]) -> dict[EdgeType, list[int]]:
    """A list for all types or a dict by type; missing types are not sampled."""
    if isinstance(num_neighbors, dict):
        hops = len(next(iter(num_neighbors.values())))
        given = {EdgeType(*k): list(v) for k, v in num_neighbors.items()}
        if any(len(v) != hops for v in given.values()):
            raise ValueError("all edge types need the same number of hops")
        return {t: given.get(t, [0] * hops) for t in types}
    return {t: list(num_neighbors) for t in types}


def seeds_per_call(fanout: list[int], budget_bytes: int, disjoint: bool = False) -> int:
    """Seeds that a bounded step may take, from its memory; 32,768 if any fan-out is open."""
    if any(k <= 0 for k in fanout):
        return 32768
    n = 0.1107662486009992 * budget_bytes / prod(fanout)
    return max(1, int(n / fanout[0] if disjoint else n))


def replica_slice(seeds: DataFrame, replica: int, replicas: int, batch_size: int, drop_last: bool = True, shuffle_seed: int | None = None) -> DataFrame:
    """A replica's batches (input_id, ..., batch_id, pos): input ids dealt round in their order or by key; so that all
    replicas take as many steps, each has the same number of seeds and the rest is left out where drop_last is set."""
    if not 0 <= replica < replicas:
        raise ValueError("the replica must be one of the replicas")
    order = ["input_id"] if shuffle_seed is None else [key(shuffle_seed, F.col("input_id")).asc(), F.col("input_id").asc()]
    rows = number_rows(seeds, order, "_place")
    n = rows.count()
    per = n // replicas // batch_size * batch_size if drop_last else -(-n // replicas)
    own = rows.where((F.col("_place") % replicas == replica) & (F.col("_place") < per * replicas)).withColumn("_own", F.floor(F.col("_place") / replicas))
    return own.select(*seeds.columns, F.floor(F.col("_own") / batch_size).cast("long").alias("batch_id"), (F.col("_own") % batch_size).cast("long").alias("pos"))


def check_options(subgraph_type: str = "directional", directed: bool = True, temporal_strategy: str = "uniform", compression: str | None = None, heterogeneous: bool = False, custom_sampler=None) -> None:
    if custom_sampler is not None:
        raise ValueError("custom samplers are not accepted")
    if not directed or subgraph_type != "directional":
        raise ValueError("only directional subgraphs are sampled")
    if compression == "CSR" and heterogeneous:
        raise ValueError("heterogeneous output is COO")
    if temporal_strategy != "uniform":
        warnings.warn("only the uniform temporal strategy is supported; using it", stacklevel=3)


def check_metadata(metadata: dict) -> None:
    """Values of a batch's metadata are texts or edge types of three texts, its keys texts."""
    for k, v in metadata.items():
        triple = isinstance(v, tuple) and len(v) == 3 and all(isinstance(x, str) for x in v)
        if not isinstance(k, str) or not (isinstance(v, str) or triple):
            raise ValueError(f"{k!r}: metadata are texts or edge types")


def check_stores(graph, features=None) -> None:
    if not isinstance(graph, GraphStore) or not (features is None or isinstance(features, FeatureStore)):
        raise NotImplementedError("loaders take this library's graph and feature stores")


def _in_calls(out: Sampled, batch_size: int, per_call: int | None) -> Sampled:
    if per_call is None:
        return out
    if per_call < 1:
        raise ValueError("a call takes one seed at least")
    return Sampled(lambda: tuple(call_groups(df, batch_size, per_call) for df in (out.edges, out.nodes)), call_groups(out.inputs, batch_size, per_call))


def _numbered_ends(pairs: DataFrame) -> DataFrame:
    """pairs with edge_label_row and edge_label_col, where the ends are of two types: a batch's seeds of a type come first in
    the order of their first places, so their local ids follow from its pairs alone. One shuffle by batch."""
    out = pairs.repartition("batch_id")
    for end, name in (("nbr", "edge_label_row"), ("ctr", "edge_label_col")):
        out = out.withColumn("_first", F.min("pos").over(Window.partitionBy("batch_id", end)))
        out = out.withColumn(name, (F.dense_rank().over(Window.partitionBy("batch_id").orderBy("_first")) - 1).cast("long")).drop("_first")
    return out.where("nbr IS NOT NULL AND ctr IS NOT NULL")


def check_weights(counts: dict[str, int], **weights) -> None:
    """Weights (id, w) by end, each a pair of vertex type and table: one row for each vertex of the type, no null, and one
    number type for both ends."""
    given = {end: (vtype, df) for end, (vtype, df) in weights.items() if df is not None}
    kinds = {end: df.schema["w"].dataType.simpleString() for end, (_, df) in given.items()}
    if len(set(kinds.values())) > 1:
        raise ValueError(f"the weights of both ends need one type, not {sorted(kinds.values())}")
    for end, (vtype, df) in given.items():
        if kinds[end] not in ("float", "double"):
            raise ValueError(f"the {end} weights must be fractional numbers, not {kinds[end]}")
        found = df.agg(F.count("w").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("w").alias("least")).first()  # five numbers
        n = counts[vtype]
        if (found["n"], found["d"]) != (n, n) or (n and (found["lo"], found["hi"]) != (0, n - 1)):
            raise ValueError(f"the {end} weights need a row for each of the {n} nodes of {vtype}, not {found['n']}")
        if n and found["least"] < 0:
            raise ValueError(f"the {end} weights must not be negative")


def neighbor_loader(
    graph: GraphStore, num_neighbors, input_nodes: DataFrame, vtype: str | None = None, batch_size: int = 16, shuffle: bool = False, drop_last: bool = False,
    replace: bool = False, disjoint: bool = False, weighted: bool = False, temporal_comparison: str | None = None, seed: int = 62, local_seeds_per_call: int | None = None, epoch: int = 0, **other,
) -> Sampled:
    """input_nodes: (input_id, id[, t]) of one vertex type; without one, the graph must have a single type. With
    local_seeds_per_call each table has call_id: the group of whole batches, of at most so many seeds, that are meant to be
    sampled and read together. Each epoch shuffles and samples anew, reproducibly."""
    check_stores(graph)
    check_options(**other)
    seed = epoch_seed(seed, epoch)
    types = graph.edge_types()
    vtype = vtype or (types[0].ctr if graph.is_homogeneous else None)
    if vtype is None:
        raise ValueError("a graph of several vertex types needs the seeds' type")
    if batch_size < 1:
        raise ValueError("the batch size must be positive")
    if drop_last and input_nodes.limit(batch_size).count() < batch_size:
        raise ValueError("fewer inputs than one batch, and drop_last leaves out all of them")
    batches = seed_batches(input_nodes, batch_size, seed if shuffle else None, drop_last).withColumn("vtype", F.lit(vtype))
    if temporal_comparison is not None and temporal_comparison not in COMPARE:
        raise ValueError(f"temporal_comparison must be one of {sorted(COMPARE)}")
    edges, nodes = neighbor_sample(graph.edges(), batches, fanout_by_type(num_neighbors, types), Options(weighted, replace, temporal_comparison, disjoint, seed))
    edges, nodes = renumber(edges, nodes)
    return _in_calls(Sampled(lambda: (edges, nodes), batches.select("batch_id", "pos", "input_id", "id")), batch_size, local_seeds_per_call)


def link_neighbor_loader(
    graph: GraphStore, num_neighbors, links: DataFrame, edge_type, batch_size: int = 16, negatives: str | None = None, amount: float = 1.0, temporal_comparison: str | None = None, disjoint: bool = False, weighted: bool = False, replace: bool = False, seed: int = 62,
    src_weights: DataFrame | None = None, dst_weights: DataFrame | None = None, node_time: dict[str, DataFrame] | None = None, temporal_retries: int | None = None, local_seeds_per_call: int | None = None,
) -> Sampled:
    """links: (pos, nbr, ctr[, label][, t]), pos from 0 without gaps. Both ends of a batch's links are its seeds; inputs
    carry edge_label_row, edge_label_col (local ids), label and input_id, -1 for negatives. Negatives are drawn by
    src_weights and dst_weights (id, w), a row for each node; with node_time, (id, t) by vertex type, and links' times, a negative takes the
    time of the positive at its place, counted round, and is drawn from the nodes that are not later; with
    temporal_retries from all nodes, and again that many times while one is later."""
    check_stores(graph)
    if negatives not in (None, "binary", "triplet"):
        raise ValueError("negatives must be binary or triplet")
    if negatives == "triplet" and "label" in links.columns:
        raise ValueError("triplets take no labels")
    if temporal_comparison and "t" not in links.columns:
        warnings.warn("links without times are sampled without time", stacklevel=2)
        temporal_comparison = None
    t = EdgeType(*edge_type)
    n = links.count()
    has_t = "t" in links.columns
    if has_t and temporal_comparison is not None and temporal_comparison not in COMPARE:
        raise ValueError(f"temporal_comparison must be one of {sorted(COMPARE)}")
    fanout, largest = fanout_by_type(num_neighbors, graph.edge_types()), batch_size
    if negatives:
        counts, many = graph.counts(), negative.how_many(n, amount, batch_size)
        check_weights(counts, src=(t.nbr, src_weights), dst=(t.ctr, dst_weights))
        timed = has_t and node_time is not None
        if timed:
            # A link lends its time to the negatives at its place, counted round.
            places = F.sequence(F.col("pos").cast("long"), F.lit(many - 1).cast("long"), F.lit(max(1, n)).cast("long"))
            rows = links.where(F.col("pos") < many).select(F.explode(places).alias("neg_pos"), "t")
            src, dst = (negative.End(role, col, counts[v], node_time[v], w) for role, col, v, w in (("src", "nbr", t.nbr, src_weights), ("dst", "ctr", t.ctr, dst_weights)))
            if negatives == "binary":
                neg = negative.temporal_links(rows, [src, dst], seed, temporal_retries)
            else:
                picked = negative.draw_uniform(negative.temporal_links(rows, [dst], seed, temporal_retries), seed, "pick", max(1, n), "pos")
                neg = picked.join(links.select("pos", "nbr"), "pos").select("neg_pos", "nbr", "ctr", "t")
        elif negatives == "binary":
            neg = negative.binary_negatives(links.sparkSession, n, amount, batch_size, counts[t.nbr], counts[t.ctr], seed, src_weights, dst_weights)
        else:
            neg = negative.triplet_negatives(links, n, amount, batch_size, counts[t.ctr], seed, dst_weights)
        if has_t and not timed:
            neg = neg.withColumn("_p", F.col("neg_pos") % max(1, n)).join(links.select(F.col("pos").alias("_p"), "t"), "_p").drop("_p")
        pairs = negative.interleave(links, written(neg, "negatives"), n, many, batch_size)  # read for inputs and for seeds
        largest += ceil(many / max(1, ceil(n / batch_size)))
    else:
        label = F.col("label").cast("double") if "label" in links.columns else F.lit(1.0)
        pairs = links.select(F.floor(F.col("pos") / batch_size).cast("long").alias("batch_id"), (F.col("pos") % batch_size).cast("long").alias("pos"), F.col("pos").alias("input_id"), "nbr", "ctr", label.alias("label"), *(["t"] if has_t else []))
    ends = F.explode(F.array(F.struct(F.lit(t.nbr).alias("vtype"), F.col("nbr").alias("id"), (F.col("pos") * 2).alias("p")), F.struct(F.lit(t.ctr).alias("vtype"), F.col("ctr").alias("id"), (F.col("pos") * 2 + 1).alias("p"))))
    seeds = pairs.withColumn("e", ends).select("batch_id", F.col("e.vtype").alias("vtype"), F.col("e.id").alias("id"), F.col("e.p").alias("pos"), *(["t"] if has_t else []))
    options = Options(weighted, replace, temporal_comparison if has_t else None, disjoint, seed)
    out = Sampled(lambda: renumber(*neighbor_sample(graph.edges(), seeds, fanout, options)), pairs)
    if t.nbr != t.ctr and largest <= BATCH_LINKS:
        out.inputs = _numbered_ends(pairs)
    else:
        local = out.nodes.select("batch_id", "vtype", "id", "local_id")
        a = local.where(F.col("vtype") == t.nbr).select("batch_id", F.col("id").alias("nbr"), F.col("local_id").alias("edge_label_row"))
        b = local.where(F.col("vtype") == t.ctr).select("batch_id", F.col("id").alias("ctr"), F.col("local_id").alias("edge_label_col"))
        out.inputs = pairs.join(a, ["batch_id", "nbr"]).join(b, ["batch_id", "ctr"])
    return _in_calls(out, batch_size, local_seeds_per_call)
