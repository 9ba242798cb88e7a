"""Golden neighbourhoods on small graphs, and invariants where a draw decides."""

import pytest
from pyspark.sql import functions as F

from neighborflow.model import EdgeType, merged_edges, vertex_counts, vertex_offsets
from neighborflow.operators import sample
from neighborflow.operators.sample import Options, neighbor_sample, renumber
from neighborflow.plans.batches import batch_range, open_batches
from neighborflow.plans.loaders import check_weights, link_neighbor_loader, neighbor_loader, parse_fanout
from neighborflow.plans.stores import FeatureStore, GraphStore

CITES, WRITES = EdgeType("paper", "cites", "paper"), EdgeType("author", "writes", "paper")


def edges(spark, nbr, ctr, wgt=None, etime=None):
    rows = [(i, a, b, *([float(wgt[i])] if wgt else []), *([etime[i]] if etime else [])) for i, (a, b) in enumerate(zip(nbr, ctr, strict=True))]
    return spark.createDataFrame(rows, "eid long, nbr long, ctr long" + ", wgt double" * bool(wgt) + ", etime long" * bool(etime))


def seeds(spark, ids, vtype, batch=None, t=None):
    rows = [((i // batch if batch else 0), (i % batch if batch else i), vtype, x, *([t] if t is not None else [])) for i, x in enumerate(ids)]
    return spark.createDataFrame(rows, "batch_id long, pos long, vtype string, id long" + ", t long" * (t is not None))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_biased_never_takes_weight_zero(spark):
    g = {EdgeType("v", "e", "v"): edges(spark, [3, 4, 5], [0, 1, 2], wgt=[0, 12, 14])}
    e, n = neighbor_sample(g, seeds(spark, [0, 1, 2], "v"), {EdgeType("v", "e", "v"): [1]}, Options(weighted=True))
    e, n = renumber(e, n)
    assert rows(e, "row", "col") == [(3, 1), (4, 2)]


def test_link_batch_of_papers_and_authors(spark):
    cites = edges(spark, [0, 1, 2, 4, 3, 4, 5, 5], [4, 5, 4, 3, 2, 1, 0, 1])
    writes = edges(spark, [0, 1, 2, 3, 3, 0], [0, 1, 2, 3, 4, 5])
    g = GraphStore(spark)
    g.put_edge_index(cites, CITES, size=(6, 6))
    g.put_edge_index(writes, WRITES, size=(4, 6))
    links = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([0, 1, 2, 3, 3, 0], [0, 1, 2, 3, 4, 5], strict=True))], "pos long, nbr long, ctr long")
    out = link_neighbor_loader(g, {CITES: [2, 2], WRITES: [2, 2]}, links, WRITES, batch_size=5)
    first = out.nodes.where("batch_id = 0")
    assert sorted(r["id"] for r in first.where("vtype = 'paper'").collect()) == [0, 1, 2, 3, 4, 5]
    assert [first.where(f"vtype = 'paper' AND hop = {h}").count() for h in (0, 1, 2)] == [5, 1, 0]
    assert [first.where(f"vtype = 'author' AND hop = {h}").count() for h in (0, 1, 2)] == [4, 0, 0]
    e = out.edges.where("batch_id = 0")
    assert [e.where(f"etype = '{CITES}' AND hop = {h}").count() for h in (0, 1)] == [7, 1]
    assert [e.where(f"etype = '{WRITES}' AND hop = {h}").count() for h in (0, 1)] == [5, 1]
    got = sorted((r["pos"], r["edge_label_row"], r["edge_label_col"]) for r in out.inputs.where("batch_id = 0").collect())
    assert [(a, b) for _, a, b in got] == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 4)]


def test_type_without_fanout_is_not_sampled(spark):
    g = {CITES: edges(spark, [0, 1, 2, 4, 3, 4, 5, 5], [4, 5, 4, 3, 2, 1, 0, 1]), WRITES: edges(spark, [0, 1, 2, 3, 3, 0], [0, 1, 2, 3, 4, 5])}
    e, n = neighbor_sample(g, seeds(spark, [0, 1], "paper"), {CITES: [1, 1]})
    assert e.where(F.col("etype") == str(WRITES)).count() == 0 and n.where("vtype = 'author'").count() == 0


def test_two_hops_of_two_types(spark):
    ctr, nbr = [4, 5, 6, 7, 8, 9, 8, 9, 8, 7, 6, 5, 4, 5], [0, 1, 2, 3, 3, 0, 4, 5, 6, 8, 7, 8, 9, 9]
    a = edges(spark, nbr[:6], [c - 4 for c in ctr[:6]])
    p = edges(spark, [x - 4 for x in nbr[6:]], [c - 4 for c in ctr[6:]])
    e, _ = neighbor_sample({WRITES: a, CITES: p}, seeds(spark, [0, 1], "paper"), {WRITES: [-1, -1], CITES: [-1, -1]})
    got = {(t, h): sorted(r["eid"] for r in e.where((F.col("etype") == str(t)) & (F.col("hop") == h)).collect()) for t in (WRITES, CITES) for h in (0, 1)}
    assert got == {(WRITES, 0): [0, 1], (WRITES, 1): [4, 5], (CITES, 0): [5, 6, 7], (CITES, 1): [0, 1, 2]}


def test_temporal_chain(spark):
    g = {CITES: edges(spark, [2, 1, 0, 0], [3, 2, 1, 2], etime=[0, 1, 2, 0])}
    e, n = neighbor_sample(g, seeds(spark, [3], "paper", t=-1), {CITES: [2, 2, 2]}, Options(time="strictly_increasing"))
    assert rows(e, "hop", "eid") == [(0, 0), (1, 1), (2, 2)]
    assert [r["id"] for r in renumber(e, n)[1].orderBy("local_id").collect()] == [3, 2, 1, 0]


def test_temporal_heterogeneous(spark):
    g = {CITES: edges(spark, [2, 1, 0, 0], [3, 2, 1, 2], etime=[0, 1, 2, 0]), WRITES: edges(spark, [0, 0, 1, 1, 2, 2, 2], [3, 2, 2, 1, 3, 2, 0], etime=[0, 0, 1, 0, 2, 1, 1])}
    e, n = neighbor_sample(g, seeds(spark, [3], "paper", t=-1), {CITES: [2, 2, 2], WRITES: [2, 2, 0]}, Options(time="strictly_increasing"))
    w = e.where(F.col("etype") == str(WRITES))
    assert sorted(r["eid"] for r in w.collect()) == [0, 2, 4, 5]
    assert [w.where(f"hop = {h}").count() for h in range(3)] == [2, 2, 0]
    assert {r["id"] for r in n.where("vtype = 'author'").collect()} == {0, 1, 2}


@pytest.mark.parametrize("disjoint,count", [(False, 2), (True, 1)])
def test_disjoint_trees(spark, disjoint, count):
    g = {CITES: edges(spark, [2, 2], [0, 1])}
    e, n = neighbor_sample(g, seeds(spark, [0, 1], "paper"), {CITES: [1]}, Options(disjoint=disjoint))
    assert e.count() == count and {r["id"] for r in n.collect()} == {0, 1, 2}


def test_ring_invariants(spark):
    dst = [*range(1, 34), 0, 5, 12, 8, 15, 20, 25, 30, 1, 3, 6, 9, 11, 13, 17, 19, 23, 27, 31]
    src = [*range(34), *range(18)]
    g = GraphStore(spark)
    g.put_edge_index((dst, src), ("person", "knows", "person"), size=(34, 34))
    assert g.is_homogeneous and g.graph().count() == 52
    inputs = spark.range(34).select(F.col("id").alias("input_id"), "id")
    for disjoint in (False, True):
        out = neighbor_loader(g, [5, 5], inputs, batch_size=8, disjoint=disjoint)
        e = out.edges.cache()
        pairs = set(zip(dst, src, strict=True))
        assert all((r["nbr"], r["ctr"]) in pairs for r in e.collect())
        assert e.groupBy("batch_id", "eid").count().where("count > 1").count() == 0
        n = {(r["batch_id"], r["local_id"]): r["id"] for r in out.nodes.collect()}
        assert all(n[(r["batch_id"], r["row"])] == r["nbr"] and n[(r["batch_id"], r["col"])] == r["ctr"] for r in e.collect())
        assert len(n) == out.nodes.select("batch_id", "id").distinct().count()
    feats = FeatureStore()
    feats.put("person", "feat", spark.range(34).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec")))
    assert all(r["vec"][0] == r["id"] for r in out.with_features(feats, "person", "feat").collect())
    got = list(out.batches())
    assert [b for b, _, _ in got] == [0, 1, 2, 3, 4] and sum(len(es) for _, es, _ in got) == e.count()


def test_stack_a_takes_all_of_low_degree(spark):
    g = edges(spark, [1, 2, 3, 4, 5], [0, 0, 0, 1, 1], wgt=[0, 1, 2, 0, 0])
    centres = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "pos long, id long")
    assert sample.one_hop(centres, g, 2, 1, "wgt").groupBy("pos").count().where("count <> 2").count() == 0
    assert sample.one_hop(centres, g, -1, 1).count() == 8
    assert {r["eid"] for r in sample.one_hop(centres, g, 2, 1, "wgt").where("pos = 1").collect()} == {3, 4}
    assert rows(sample.sample_offsets(centres, g, 2), "pos", "offset") == [(0, 0), (1, 2), (2, 4)]


def test_draws_are_near_uniform(spark):
    g = edges(spark, list(range(10)), [0] * 10)
    centres = spark.range(2000).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("id"))
    n = {r["eid"]: r["count"] for r in sample.one_hop(centres, g, 3, 5).groupBy("eid").count().collect()}
    assert len(n) == 10 and all(450 < x < 750 for x in n.values())


def test_replacement_draws_k(spark):
    g = {CITES: edges(spark, [1, 2], [0, 0])}
    e, _ = neighbor_sample(g, seeds(spark, [0, 3], "paper"), {CITES: [5]}, Options(replace=True))
    assert e.count() == 5


def test_replacement_over_a_hub_and_by_weight(spark):
    """A centre with most of all edges: draws are spread over them, by weight where asked, and none of weight 0."""
    n = 1200
    g = {CITES: edges(spark, list(range(n)), [0 if i % 4 else i for i in range(n)], wgt=[float(i % 3) for i in range(n)])}
    e, _ = neighbor_sample(g, seeds(spark, [0, 4], "paper"), {CITES: [6000]}, Options(replace=True))
    got = {r["eid"]: r["count"] for r in e.where("ctr = 0").groupBy("eid").count().collect()}
    assert sum(got.values()) == 6000 and e.where("ctr = 4").count() == 6000 and set(got) <= {i for i in range(n) if i % 4 or i == 0} and len(got) > 850
    e, _ = neighbor_sample(g, seeds(spark, [0, 4], "paper"), {CITES: [6000]}, Options(replace=True, weighted=True))
    got = {r["eid"]: r["count"] for r in e.where("ctr = 0").groupBy("eid").count().collect()}
    assert sum(got.values()) == 6000 and all(i % 3 for i in got)
    heavy = sum(c for i, c in got.items() if i % 3 == 2)
    assert abs(heavy / 6000 - 2 / 3) < 0.03


def test_last_takes_the_latest_even_with_replacement(spark):
    g = {CITES: edges(spark, list(range(10)), [50] * 10, etime=list(range(10)))}
    s = seeds(spark, [50], "paper").withColumn("t", F.lit(7).cast("long"))
    for replace in (False, True):
        e, _ = neighbor_sample(g, s, {CITES: [3]}, Options(replace=replace, time="last"))
        assert sorted(r["eid"] for r in e.collect()) == [5, 6, 7]


def test_numbering_rules(spark):
    g = {WRITES: edges(spark, [0, 1], [0, 1]), CITES: edges(spark, [5], [2])}
    counts = vertex_counts(g, {WRITES: (4, 3)})
    assert counts == {"author": 4, "paper": 6} and vertex_offsets(counts) == {"author": 0, "paper": 4}
    assert rows(merged_edges(g, counts), "etype", "eid", "nbr", "ctr") == [(0, 0, 0, 4), (0, 1, 1, 5), (1, 0, 9, 6)]


def test_options_are_checked(spark):
    assert parse_fanout(3, "30") == [30, 30, 30]
    with pytest.raises(ValueError):
        parse_fanout(3, "1,2")
    with pytest.raises(ValueError):
        GraphStore(spark).put_edge_index(([0], [1]), CITES, "csr")
    g = GraphStore(spark)
    g.put_edge_index(([0], [1]), CITES)
    ids = spark.range(1).select(F.col("id").alias("input_id"), "id")
    for bad in ({"directed": False}, {"subgraph_type": "induced"}, {"custom_sampler": object()}):
        with pytest.raises(ValueError):
            neighbor_loader(g, [1], ids, **bad)


def test_binary_and_triplet_negatives(spark):
    g = GraphStore(spark)
    g.put_edge_index(edges(spark, [0, 1, 2, 3, 3, 0], [0, 1, 2, 3, 4, 5]), WRITES, size=(4, 6))
    links = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip([0, 1, 2, 3, 3, 0], [0, 1, 2, 3, 4, 5], strict=True))], "pos long, nbr long, ctr long")
    for kind in ("binary", "triplet"):
        for amount in (1.0, 2.0):
            out = link_neighbor_loader(g, {WRITES: [2]}, links, WRITES, batch_size=3, negatives=kind, amount=amount)
            per = {(r["batch_id"], r["label"]): r["count"] for r in out.inputs.groupBy("batch_id", "label").count().collect()}
            assert per == {(b, x): (3 if x else 3 * amount) for b in (0, 1) for x in (1.0, 0.0)}
            assert out.inputs.where("label = 0 AND input_id >= 0").count() == 0


def test_triplets_repeat_sources_and_draw_destinations(spark):
    """Sources are those of drawn positives, so a batch's negatives add destinations only."""
    from neighborflow.operators import negative

    pos = spark.createDataFrame([(i, 100 + i, 7) for i in range(6)], "pos long, nbr long, ctr long")
    got = negative.triplet_negatives(pos, 6, 3.0, 2, 5, 1).collect()
    assert len(got) == 18 and {r["nbr"] for r in got} <= set(range(100, 106)) and {r["ctr"] for r in got} <= set(range(5)) and len({r["ctr"] for r in got}) > 2
    only = spark.createDataFrame([(3, 1.0), (4, 0.0)], "id long, w double")
    assert {r["ctr"] for r in negative.triplet_negatives(pos, 6, 3.0, 2, 5, 1, only).collect()} == {3}


@pytest.mark.parametrize("retries", [None, 5])
@pytest.mark.parametrize("few", [True, False])
def test_negatives_exist_in_time(spark, few, retries, monkeypatch):
    """Nodes 0 to 4 appear at times 0 to 4; a link at time 1 has only nodes 0 and 1 to take, whichever way they are drawn."""
    from neighborflow.operators import negative

    monkeypatch.setattr(negative, "BROADCAST_BYTES", 1 << 20 if few else 0)
    times = spark.createDataFrame([(i, i) for i in range(5)], "id long, t long")
    asked = spark.createDataFrame([(i, i % 5) for i in range(200)], "neg_pos long, t long")
    ends = [negative.End("src", "nbr", 5, times), negative.End("dst", "ctr", 5, times)]
    got = {r["neg_pos"]: (r["t"], r["nbr"], r["ctr"]) for r in negative.temporal_links(asked, ends, 3, retries).collect()}
    assert len(got) == 200 and all(a <= t and b <= t for t, a, b in got.values())
    assert {(a, b) for t, a, b in got.values() if t == 0} == {(0, 0)}
    if retries is None:
        assert {a for t, a, _ in got.values() if t == 4} == set(range(5))
        w = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 9.0), (3, 1.0), (4, 1.0)], "id long, w double")
        drawn = negative.temporal_links(asked, [negative.End("src", "nbr", 5, times, w)], 3).collect()
        assert len(drawn) == 200 and all(r["nbr"] <= r["t"] and r["nbr"] != 1 for r in drawn)
        late = [r["nbr"] for r in drawn if r["t"] >= 2]
        assert late.count(2) > 0.6 * len(late)


def test_link_loader_negatives_in_time(spark):
    g = GraphStore(spark)
    knows = EdgeType("v", "e", "v")
    g.put_edge_index(edges(spark, [2, 1, 0, 0, 1, 2, 1], [3, 2, 1, 2, 3, 4, 0], etime=[5, 6, 7, 3, 4, 8, 2]), knows, size=(5, 5))
    links = spark.createDataFrame([(0, 3, 2, 10), (1, 2, 1, 2)], "pos long, nbr long, ctr long, t long")
    times = spark.createDataFrame([(i, i) for i in range(5)], "id long, t long")
    for kind in ("binary", "triplet"):
        out = link_neighbor_loader(g, {knows: [2]}, links, knows, batch_size=2, negatives=kind, amount=2.0, node_time={"v": times}).inputs.collect()
        neg = [r for r in out if r["label"] == 0.0]
        assert len(out) == 6 and len(neg) == 4 and sorted(r["t"] for r in neg) == [2, 2, 10, 10]
        assert all(r["ctr"] <= r["t"] and (kind == "triplet" or r["nbr"] <= r["t"]) for r in neg)


def test_layers_forward(spark):
    """Two layers by hand: 0 takes from 1 and 2, 1 from 2."""
    from neighborflow.operators import analytics

    hop = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "nbr long, ctr long")
    feats = spark.createDataFrame([(0, [0.0]), (1, [4.0]), (2, [8.0])], "id long, vec array<double>")
    got = {r["id"]: r["vec"][0] for r in analytics.layered_mean([hop, hop], feats).collect()}
    assert got == {0: (3.0 + (6.0 + 8.0) / 2) / 2, 1: (6.0 + 8.0) / 2, 2: 8.0}


def test_batch_files_are_whole_and_shared_out(spark, tmp_path):
    """Each batch lies in one file of each table; trainers' batches are disjoint and together all."""
    g = GraphStore(spark)
    knows = EdgeType("v", "e", "v")
    n = 200
    g.put_edge_index(edges(spark, [(i * 7 + 1) % n for i in range(3 * n)], [i % n for i in range(3 * n)]), knows, size=(n, n))
    inputs = spark.range(n).select(F.col("id").alias("input_id"), "id")
    out = neighbor_loader(g, [2, 2], inputs, batch_size=8, local_seeds_per_call=20)
    path = str(tmp_path / "b")
    out.write(path, files=5)
    for name in ("edges", "nodes", "inputs"):
        held = spark.read.parquet(f"{path}/{name}").select("batch_id", F.input_file_name().alias("file")).groupBy("batch_id").agg(F.count_distinct("file").alias("f")).collect()
        assert len(held) == 25 and all(r["f"] == 1 for r in held)
    seen = {}
    for rank in range(3):
        for batch, rows_ in open_batches(f"file:{path}", rank, 3):
            assert batch not in seen and batch in batch_range(path, rank, 3)
            seen[batch] = rows_
    assert sorted(seen) == list(range(25)) and list(seen) == sorted(seen)
    want = rows(out.edges, "batch_id", "hop", "eid", "row", "col")
    assert sorted((r["batch_id"], r["hop"], r["eid"], r["row"], r["col"]) for b in seen.values() for r in b["edges"]) == want
    assert all(r["call_id"] == r["batch_id"] // 2 for b in seen.values() for t in b.values() for r in t)
    again = {b: (len(e), len(v)) for b, e, v in out.batches(path)}
    assert again == {b: (len(r["edges"]), len(r["nodes"])) for b, r in seen.items()}
    with pytest.raises(ValueError):
        batch_range(path, 3, 3)
    with pytest.raises(ValueError):
        neighbor_loader(g, [2], inputs, batch_size=8, local_seeds_per_call=0)


def test_weights_are_checked(spark):
    counts = {"a": 3, "b": 2}
    w = lambda rows_, kind="double": spark.createDataFrame(rows_, f"id long, w {kind}")
    good = w([(0, 1.0), (1, 0.0), (2, 2.0)])
    check_weights(counts, src=("a", good), dst=("b", None))
    check_weights(counts, src=("a", good), dst=("b", w([(0, 1.0), (1, 3.0)])))
    for bad in (w([(0, 1.0), (1, 1.0)]), w([(0, 1.0), (1, 1.0), (3, 1.0)]), w([(0, 1.0), (1, 1.0), (1, 1.0)]), w([(0, 1.0), (1, None), (2, 1.0)]), w([(0, 1.0), (1, -1.0), (2, 1.0)]), w([(0, 1), (1, 1), (2, 1)], "int")):
        with pytest.raises(ValueError):
            check_weights(counts, src=("a", bad), dst=("b", None))
    with pytest.raises(ValueError):
        check_weights(counts, src=("a", good), dst=("b", w([(0, 1.0), (1, 3.0)], "float")))
    g = GraphStore(spark)
    knows = EdgeType("v", "e", "v")
    g.put_edge_index(edges(spark, [1, 2, 3], [0, 0, 1]), knows, size=(5, 5))
    links = spark.createDataFrame([(0, 1, 0)], "pos long, nbr long, ctr long")
    with pytest.raises(ValueError, match="each of the 5 nodes"):
        link_neighbor_loader(g, {knows: [1]}, links, knows, negatives="binary", dst_weights=good)


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_flow_forward_against_numpy(spark, dropout):
    """Three hops; a node without features, targets without neighbours, and a hub."""
    import numpy as np

    from neighborflow.operators import analytics

    rng = np.random.default_rng(4)
    g = edges(spark, [int(x) for x in rng.integers(0, 60, 300)], [int(x) for x in np.where(rng.random(300) < 0.4, 3, rng.integers(0, 50, 300))])
    seeds_ = spark.createDataFrame([(i, x) for i, x in enumerate([3, 7, 55, 12])], "pos long, id long")
    nodes, flow = sample.resample_all(seeds_, g, [3, 2, 2], 9)
    feats = {i: rng.normal(size=5) for i in range(58)}
    w = [(rng.normal(size=(6, 5)), rng.normal(size=(6, 5)), rng.normal(size=6)), (rng.normal(size=(4, 6)), None, rng.normal(size=4)), (rng.normal(size=(2, 4)), rng.normal(size=(2, 4)), None)]
    table = [(i, part, r, [float(x) for x in np.atleast_1d(m[r])]) for i, ms in enumerate(w) for part, m in zip(("near", "root", "bias"), ms) if m is not None for r in range(len(m))]
    weights = spark.createDataFrame(table, "layer int, part string, row int, values array<double>")
    fdf = spark.createDataFrame([(i, v.tolist()) for i, v in feats.items()], "id long, vec array<double>")
    got = {r["pos"]: r["vec"] for r in analytics.flow_forward(nodes, flow, fdf, weights, 3, dropout, 5).collect()}
    held = {r["pos"]: feats.get(r["id"], np.zeros(5)) for r in nodes.collect()}
    hop_of = {r["pos"]: r["hop"] for r in nodes.collect()}
    all_edges = [(r["hop"], r["ctr_pos"], r["nbr_pos"]) for r in flow.collect()]
    for layer, hop in enumerate((2, 1, 0)):
        near, root, bias = w[layer]
        new = {}
        for p in (p for p in held if hop_of[p] <= hop):
            mine = [held[b] for h, a, b in all_edges if h == hop and a == p]
            x = near @ (np.mean(mine, axis=0) if mine else np.zeros(near.shape[1])) + (root @ held[p] if root is not None else 0) + (bias if bias is not None else 0)
            if layer < 2:
                x = np.maximum(x, 0) * (analytics.kept(5, layer, np.array([p]), len(x), dropout)[0] / (1 - dropout) if dropout else 1)
            new[p] = x
        held = new
    assert sorted(got) == [0, 1, 2, 3] and all(np.allclose(got[p], held[p]) for p in got)
    if dropout:
        share = analytics.kept(5, 0, np.arange(4000), 8, dropout).mean()
        assert abs(share - 0.7) < 0.02
    with pytest.raises(ValueError):
        analytics.flow_forward(nodes, flow, fdf, weights, 2)


def test_flow_forward_in_slices(spark, monkeypatch):
    """A slice of rows at a time leaves the worker; the size of slices changes nothing, nor do nodes without vectors."""
    from neighborflow.operators import analytics

    nodes = spark.range(50).select(F.col("id").alias("pos"), "id", F.lit(0).alias("hop"))
    flow = spark.range(90).select(F.lit(0).alias("hop"), (F.col("id") % 40).alias("ctr_pos"), (F.col("id") * 7 % 50).alias("nbr_pos"))
    feats = spark.range(45).select("id", F.array(F.col("id") / 3, F.col("id") % 5 - 2.5).alias("vec"))
    weights = spark.createDataFrame([(0, "near", 0, [1.0, 2.0]), (0, "root", 0, [0.5, -1.0])], "layer int, part string, row int, values array<double>")
    run = lambda: {r["pos"]: r["vec"] for r in analytics.flow_forward(nodes, flow, feats, weights, 1).collect()}
    whole = run()
    monkeypatch.setattr(analytics, "SLICE_ROWS", 3)
    sliced = run()
    assert len(whole) == 50 and sliced.keys() == whole.keys() and all(sliced[p] == pytest.approx(whole[p]) for p in whole)


def test_pointers_expand(spark):
    from neighborflow.operators import layout

    g = edges(spark, list(range(20)), [3 if i % 2 else i % 7 for i in range(20)])
    got = rows(layout.expand_pointers(layout.row_pointers(g, 9)), "pos", "row")
    assert got == list(enumerate(sorted(3 if i % 2 else i % 7 for i in range(20))))


def test_local_ids_of_links_follow_from_their_batch(spark, monkeypatch):
    """Numbered from the batch's pairs alone, without sampling, and from the sampled nodes: the same ids."""
    from neighborflow.plans import loaders

    g = GraphStore(spark)
    g.put_edge_index(edges(spark, [0, 1, 2, 3, 3, 0], [0, 1, 2, 3, 4, 5]), WRITES, size=(4, 6))
    links = spark.createDataFrame([(i, i * 7 % 4, i * 5 % 6, i // 3) for i in range(11)], "pos long, nbr long, ctr long, t long")
    times = {"author": spark.createDataFrame([(i, i) for i in range(4)], "id long, t long"), "paper": spark.createDataFrame([(i, i // 2) for i in range(6)], "id long, t long")}
    for more in ({}, {"node_time": times}):
        for kind, amount in (("binary", 2.5), ("triplet", 0.3), (None, 1.0)):
            got = []
            for bound in (loaders.BATCH_LINKS, 0):
                with monkeypatch.context() as m:
                    m.setattr(loaders, "BATCH_LINKS", bound)
                    if bound:
                        m.setattr(loaders, "neighbor_sample", None)
                    out = link_neighbor_loader(g, {WRITES: [2]}, links, WRITES, batch_size=4, negatives=kind, amount=amount, **more)
                    got.append(rows(out.inputs, "batch_id", "pos", "input_id", "nbr", "ctr", "label", "t", "edge_label_row", "edge_label_col"))
            assert got[0] == got[1] and len({x[:2] for x in got[0]}) == len(got[0]) == 11 + {"binary": 28, "triplet": 4, None: 0}[kind]
            assert all(x[6] == x[2] // 3 for x in got[0] if x[2] >= 0)
    local = {(r["batch_id"], r["id"]): r["local_id"] for r in out.nodes.where("vtype = 'paper'").collect()}
    assert all(local[x[0], x[4]] == x[8] for x in got[0])


def test_search_counts_values_as_often_as_told(spark):
    from neighborflow.operators.numbering import search_sorted

    v, p = spark.createDataFrame([(1, 4), (3, 2), (8, 1)], "v long, n long"), spark.createDataFrame([(None,), (0,), (1,), (5,), (9,)], "p long")
    assert {r["p"]: r["k"] for r in search_sorted(v, p, "v", "p", "k", count="n").collect()} == {None: 0, 0: 0, 1: 4, 5: 6, 9: 7}
