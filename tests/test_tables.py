"""Row tables, optimizers, layout, sources, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neighborflow.functions import partition as P
from neighborflow.functions.keys import epoch_seed, key, permuted, positive_ints, uniform
from neighborflow.functions.vectors import sum_vectors
from neighborflow.model import cast_within
from neighborflow.operators import analytics, layout, negative, optim, sample, tensor
from neighborflow.operators.numbering import number_rows, number_within, prefix_sum, prefix_within, search_sorted
from neighborflow.plans import loaders
from neighborflow.plans.stores import FeatureStore, GraphStore
from neighborflow.queries import QUERIES
from neighborflow.sources import binary, ranks
from neighborflow.streaming import ingest


def test_gather_and_scatter(spark):
    t = spark.range(50).select("id", F.array(*[F.col("id") + c for c in range(4)]).cast("array<double>").alias("vec"))
    idx = spark.createDataFrame([(0, 7), (1, 7), (2, -1), (3, 49)], "pos long, id long")
    got = {r["pos"]: r["vec"] for r in tensor.gather(t, idx, ["vec"]).collect()}
    assert got == {0: [7, 8, 9, 10], 1: [7, 8, 9, 10], 2: None, 3: [49, 50, 51, 52]}
    upd = spark.createDataFrame([(0, 3, [0.0]), (1, 3, [1.0]), (2, -1, [9.0])], "pos long, id long, vec array<double>")
    after = {r["id"]: r["vec"] for r in tensor.scatter(t, upd, "vec").collect()}
    assert after[3] == [1.0] and after[4] == [4, 5, 6, 7] and len(after) == 50
    with pytest.raises(ValueError):
        tensor.sub_table(t, 5, 5)


def test_casts_stay_in_their_class():
    with pytest.raises(ValueError):
        cast_within(None, "float32", "int64")


def test_feature_store(spark):
    s = FeatureStore()
    s.put("paper", "x", spark.range(5).select("id", F.col("id").cast("double").alias("value")))
    assert s.get("paper", "y") is None and s.remove("paper", "y") is False and s.size("paper", "x") == (5,)
    s.put("paper", "x", spark.createDataFrame([(0, 2, 9.0)], "pos long, id long, value double"), indexed=True)
    assert {r["id"]: r["value"] for r in s.get("paper", "x").collect()}[2] == 9.0
    assert s.remove("paper", "x") is True


def test_layouts(spark):
    g = GraphStore(spark)
    g.put_edge_index(([1, 2, 0, 2], [0, 0, 2, 2]), ("v", "e", "v"), size=(4, 4))
    ptr, col = g.get_edge_index(("v", "e", "v"), "csc")
    assert [r["ptr"] for r in ptr.orderBy("row").collect()] == [0, 2, 2, 4, 4]
    assert [r["col"] for r in col.orderBy("row", "pos_in_row").collect()] == [1, 2, 0, 2]
    loops = layout.add_self_loops(g.get_edge_index(("v", "e", "v")), 4)
    assert [(r["row"], r["col"]) for r in loops.orderBy("row", "pos_in_row").collect()] == [(0, 0), (0, 1), (0, 2), (1, 1), (2, 2), (2, 0), (2, 2), (3, 3)]
    t = spark.createDataFrame(list(enumerate([3, 11, 2, 10])), "pos long, id long")
    n = spark.createDataFrame(list(enumerate([4, 5, 2, 11, 6, 9, 10, 5])), "npos long, id long")
    unique, mapped = layout.append_unique(t, n)
    assert [r["id"] for r in unique.orderBy("pos").collect()] == [3, 11, 2, 10, 4, 5, 6, 9]
    assert [r["pos"] for r in mapped.orderBy("npos").collect()] == [4, 5, 2, 1, 6, 7, 3, 5]


def test_numbering_within_keys_that_span_tasks(spark):
    """One vertex has half of all edges, some edges have none: numbers and sizes equal a sort's, and parts share the work."""
    edges = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 99).when(F.col("id") % 101 == 1, None).otherwise(F.col("id") % 13).cast("long").alias("k"), (F.col("id") * 1103 % 4001).alias("o"), "id")
    got = number_within(edges, ["k"], ["o"], "n", "size")
    rows = sorted((r["k"] is not None, r["k"] or 0, r["o"], r["n"], r["size"]) for r in got.collect())
    groups = {}
    for has, k, o, _, _ in rows:
        groups.setdefault((has, k), []).append(o)
    assert rows == [(*g, o, i, len(v)) for g, v in sorted(groups.items()) for i, o in enumerate(v)]
    assert "Window" not in got._jdf.queryExecution().toString()
    wide = layout.column_list(edges.select("id", F.col("id").alias("eid"), F.col("k").alias("ctr"), F.col("o").alias("nbr")))
    assert sorted(r["pos_in_row"] for r in wide.where("row = 99").collect()) == list(range(2000))


def test_numbering_matches_a_sort(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("a"), "id")
    got = [r["n"] for r in number_rows(df, ["a", "id"], "n").orderBy("a", "id").collect()]
    assert got == list(range(1000))
    sums = prefix_sum(df, ["a", "id"], "id", "s").orderBy("a", "id").collect()
    total = 0
    for r in sums:
        assert r["s"] == total
        total += r["id"]
    assert number_rows(df.limit(0), ["a", "id"], "n").count() == 0


def test_partition_arithmetic(spark):
    r = spark.range(10).select("id", P.even_rank(F.col("id"), 10, 4).alias("e"), P.near_even_rank(F.col("id"), 10, 4).alias("n"), *[c.alias(x) for c, x in zip(P.round_robin(F.col("id"), 2, 3), "rs", strict=True)]).orderBy("id").collect()
    assert [x["e"] for x in r] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3] and [x["n"] for x in r] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert [(x["r"], x["s"]) for x in r] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


@pytest.mark.parametrize("kind,params", [("sgd", {"weight_decay": 0.1}), ("adam", {"weight_decay": 0.1}), ("adam", {"weight_decay": 0.1, "adam_w": 1.0}), ("adagrad", {}), ("rmsprop", {"weight_decay": 0.1})])
def test_optimizers_against_numpy(spark, kind, params):
    rng = np.random.default_rng(1)
    w, ids, g = rng.normal(size=(6, 3)), [0, 2, 2, 5], rng.normal(size=(4, 3))
    opt = optim.SparseOptimizer(kind, params)
    opt.add_embedding("t", spark.createDataFrame([(i, w[i].tolist()) for i in range(6)], "id long, vec array<double>"))
    m, v, b = np.zeros_like(w), np.zeros_like(w), np.ones((6, 2))
    for _ in range(3):
        opt.add_gradients("t", spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, g, strict=True)], "id long, grad array<double>"))
        opt.step(0.1)
        for i in set(ids):
            x, wd = sum(g[k] for k in range(4) if ids[k] == i), params.get("weight_decay", 0)
            if params.get("adam_w"):
                w[i] -= 0.1 * wd * w[i]
            else:
                x = x + wd * w[i]
            if kind == "sgd":
                w[i] -= 0.1 * x
            elif kind == "adam":
                b[i] *= (0.9, 0.999)
                m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.999 * v[i] + 0.001 * x * x
                w[i] -= 0.1 * (m[i] / (1 - b[i, 0])) / (np.sqrt(v[i] / (1 - b[i, 1])) + 1e-8)
            else:
                v[i] = v[i] + x * x if kind == "adagrad" else 0.99 * v[i] + 0.01 * x * x
                w[i] -= 0.1 * x / (np.sqrt(v[i]) + 1e-8)
    got = np.array([r["vec"] for r in opt.tables["t"].orderBy("id").collect()])
    assert np.allclose(got, w)
    with pytest.raises(ValueError):
        optim.step(opt.tables["t"], spark.createDataFrame([], "id long, grad array<double>"), kind, 0.1, {"nope": 1})
    with pytest.raises(ValueError):
        opt.add_embedding("t", opt.tables["t"])


def test_metrics(spark):
    s = spark.createDataFrame([(0, 0.9, 1), (0, 0.5, 0), (1, 0.9, 0), (1, 0.4, 1), (2, 0.3, 0)], "q int, s double, y int")
    assert analytics.mean_reciprocal_rank(s, "q", "s", "y").first()[0] == pytest.approx(0.75)
    odd = spark.createDataFrame([(0, None, 1), (0, 0.5, 0), (0, None, 0), (1, 0.5, 1), (1, 0.5, 0), (1, 0.5, 1), (None, 0.2, 1), (None, 0.9, 0)], "q int, s double, y int")
    assert analytics.mean_reciprocal_rank(odd, "q", "s", "y").first()[0] == pytest.approx((1 / 2 + 1 + 1 / 2) / 3)
    assert analytics.auc(s, "s", "y").first()[0] == pytest.approx((2.5 + 1) / 6)
    assert analytics.auc(s.where("y = 1"), "s", "y").first()[0] is None


def test_weighted_and_temporal_negatives(spark):
    w = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 3.0)], "id long, w double")
    n = {r["node"]: r["count"] for r in negative.draw_weighted(spark.range(4000).toDF("neg_pos"), w, 3, "src", "node").groupBy("node").count().collect()}
    assert sum(n.values()) == 4000 and set(n) == {0, 2} and 800 < n[0] < 1200
    many = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("w"))
    n = {r["node"]: r["count"] for r in negative.draw_weighted(spark.range(20_000).toDF("neg_pos"), many, 9, "src", "node").groupBy("node").count().collect()}
    want = {i: 20_000 * (i % 7) / sum(j % 7 for j in range(300)) for i in range(300) if i % 7}
    assert set(n) <= set(want) and sum((n.get(i, 0) - e) ** 2 / e for i, e in want.items()) < 350  # chi-square, 256 degrees of freedom
    nodes = spark.createDataFrame([(i, i * 10) for i in range(5)], "id long, t long")
    rows = spark.createDataFrame([(i, 5) for i in range(50)], "neg_pos long, t long")
    assert {r["node"] for r in negative.temporal_negatives(rows, nodes, 5, 1, "dst").collect()} == {0}
    assert negative.how_many(0, 1.0, 4) == 0 and negative.how_many(10, 0.1, 2) == 5


@pytest.mark.parametrize("parts,dim,stride,offset", [(3, 16, 16, 0), (5, 31, 32, 0), (3, 13, 16, 3)])
def test_binary_round_trip(spark, tmp_path, parts, dim, stride, offset):
    full = np.arange(101 * stride, dtype="<f4").reshape(101, stride)
    t = spark.createDataFrame([(i, full[i].tolist()) for i in range(101)], "id long, vec array<float>")
    names = binary.write_binary(t, str(tmp_path / "t"), parts, "float32", 101)
    back = binary.read_binary(spark, names, "float32", dim, stride, offset)
    got = np.array([r["vec"] for r in back.orderBy("id").collect()])
    assert np.array_equal(got, full[:, offset : offset + dim])
    (tmp_path / "bad").write_bytes(b"123")
    with pytest.raises(ValueError):
        binary.read_binary(spark, [str(tmp_path / "bad")], "float32", 2)


def test_npy_and_embedding_files(spark, tmp_path):
    a = np.arange(12, dtype="<i4").reshape(4, 3)
    np.save(tmp_path / "a.npy", a)
    got = binary.read_table(spark, str(tmp_path / "a.npy"))
    assert [list(r["vec"]) for r in got.orderBy("id").collect()] == a.tolist()
    with pytest.raises(ValueError):
        binary.read_table(spark, "x.pt")
    t = optim.with_state(spark.range(3).select("id", F.array(F.lit(1.0)).alias("vec")), "adam")
    binary.save_embedding(t, str(tmp_path / "emb"))
    assert binary.load_embedding(spark, str(tmp_path / "emb"), optim.state_names("adam")).count() == 3


def test_stream_appends_once(spark, tmp_path):
    spark.createDataFrame([(0, 1, 2), (1, 2, 2)], "eid long, nbr long, ctr long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("eid long, nbr long, ctr long").parquet(str(tmp_path / "in"))
    ingest.append_edges(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_parts_by_prefix(spark, tmp_path):
    t = spark.range(10_000).select("id", (F.col("id") * 2).cast("float").alias("value"))
    binary.write_binary(t, str(tmp_path / "v"), 3, "float32", 10_000)
    back = binary.read_parts(spark, str(tmp_path / "v"), 3, "float32", n=10_000)
    assert back.count() == 10_000 and back.where("value <> id * 2").count() == 0
    with pytest.raises(ValueError):
        binary.read_parts(spark, str(tmp_path / "v"), 3, "float32", n=9_999)
    got = binary.deal_round_robin(back, 64, 3).groupBy("rank").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sum(r["n"] for r in got) == 10_000 and all(r["m"] == r["n"] - 1 for r in got)


def test_fractional_prefix_sums(spark):
    from neighborflow.operators.numbering import prefix_sum

    rows = spark.createDataFrame([(i, 0.25) for i in range(40)], "id long, v double")
    assert [r["s"] for r in prefix_sum(rows, ["id"], "v", "s").orderBy("id").collect()] == [0.25 * i for i in range(40)]


def test_binary_parts_are_whole(spark, tmp_path):
    t = spark.range(10).select("id", F.col("id").cast("int").alias("value"))
    names = binary.write_binary(t, f"file:{tmp_path}/few", 7, "int32", 10)
    assert [np.fromfile(f"{tmp_path}/few_part_{i}_of_7", "<i4").tolist() for i in range(7)] == [[0, 1], [2, 3], [4, 5], [6, 7], [8, 9], [], []]
    assert len(list(tmp_path.iterdir())) == len(names)
    with pytest.raises(ValueError):
        binary.write_binary(t, str(tmp_path / "gap"), 2, "int32", 11)


def test_ranks_are_dumped_and_loaded(spark, tmp_path):
    t = spark.range(10).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    empty = spark.range(0).select("id", F.lit(1).alias("value"))
    ranks.dump_ranks({"v": t, "none": empty}, str(tmp_path / "d"), 3)
    assert [sorted(r["id"] for r in ranks.load_ranks(spark, str(tmp_path / "d"), "v", k).collect()) for k in range(3)] == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9]]
    assert ranks.load_ranks(spark, str(tmp_path / "d"), "v").count() == 10 and ranks.load_ranks(spark, str(tmp_path / "d"), "none", 0).count() == 0
    about = {r["name"]: r for r in ranks.about_ranks(spark, str(tmp_path / "d")).collect()}
    assert (about["v"]["n"], about["v"]["dims"], about["v"]["types"], about["none"]["n"]) == (10, [2], ["array<double>"], 0)
    for bad in (-1, 3):
        with pytest.raises(ValueError):
            ranks.load_ranks(spark, str(tmp_path / "d"), "v", bad)
    with pytest.raises(KeyError):
        ranks.load_ranks(spark, str(tmp_path / "d"), "w")


def test_local_parts_and_cached_rows(spark):
    t = spark.range(10).select("id", (F.col("id") * 10).alias("value"))
    parts = [tensor.local_table(t, r, 10, 4).withColumn("id", F.col("id") - 3 * r) for r in range(4)]
    assert sorted(map(tuple, tensor.from_local_tables(parts, 10).collect())) == [(i, i * 10) for i in range(10)]
    for bad in (parts[::-1], [*parts[:3], parts[3].withColumn("value", F.lit("x"))]):
        with pytest.raises(ValueError):
            tensor.from_local_tables(bad, 10)
    idx = spark.createDataFrame([(0, 3), (1, 3), (2, -1), (3, 99), (4, 5)], "pos long, id long")
    got = tensor.gather_cached(t, idx, spark.createDataFrame([(3,), (99,)], "id long"), ["value"])
    assert sorted((r["pos"], r["value"], r["hit"]) for r in got.collect()) == [(0, 30, True), (1, 30, True), (2, None, False), (3, None, False), (4, 50, False)]
    upd = spark.createDataFrame([(0, 3, 7.9)], "pos long, id long, value double")
    after = tensor.scatter(t, upd, "value")
    assert after.schema["value"].dataType.simpleString() == "bigint" and after.where("id = 3").first()["value"] == 7


def test_attributes_once_and_checked_groups(spark):
    s, t = FeatureStore(), spark.range(5).select("id", F.lit(1.0).alias("value"))
    assert s.put_once("paper", "x", t, 5)
    for name, table, n in (("x", t, 5), ("y", t, 6), ("z", t.withColumn("id", F.col("id") + 1), 5), ("w", t.withColumn("id", F.lit(0)), 5)):
        with pytest.raises(ValueError):
            s.put_once("paper", name, table, n)
    assert s.put(("a", "to", "b"), "x", t)
    with pytest.raises(ValueError):
        s.put(("a", "b"), "x", t)


def test_loaders_check_their_input(spark):
    from neighborflow.plans import loaders

    g = GraphStore(spark)
    g.put_edge_index(([1, 2], [0, 0]), ("v", "e", "v"), size=(3, 3))
    seeds = spark.range(3).select(F.col("id").alias("input_id"), "id")
    with pytest.raises(NotImplementedError):
        loaders.neighbor_loader({}, [2], seeds, "v", 2)
    with pytest.raises(ValueError):
        loaders.neighbor_loader(g, [2], seeds, "v", 4, drop_last=True)


def test_exact_negatives_are_different_and_no_positives(spark):
    """Dense and sparse, and all there are; a hub that is linked with all nodes has no negative."""
    positives = spark.createDataFrame([(a, b) for a in range(4) for b in range(4) if (a, b) != (2, 3)], "nbr long, ctr long")
    got = negative.exact_negatives(spark, 5, 4, 5, 7, positives).collect()
    pairs = {(r["nbr"], r["ctr"]) for r in got}
    assert sorted(r["neg_pos"] for r in got) == list(range(5)) and pairs == {(2, 3), (0, 4), (1, 4), (2, 4), (3, 4)}
    assert negative.exact_negatives(spark, 3, 1, 1, 7).count() == 1 and negative.exact_negatives(spark, 3, 1, 1, 7, spark.createDataFrame([(0, 0)], "nbr long, ctr long")).count() == 0
    links = {(a, b) for a in range(40) for b in range(25) if a == 7 or (a * 31 + b * 17) % 4 == 0}
    positives = spark.createDataFrame([*links, *list(links)[:50], (99, 3), (-1, 2)], "nbr long, ctr long")
    free = {(a, b) for a in range(40) for b in range(25)} - links
    for many in (20, 600, len(free), 5000):
        got = [(r["nbr"], r["ctr"]) for r in negative.exact_negatives(spark, many, 40, 25, 3, positives).collect()]
        assert len(got) == len(set(got)) == min(many, len(free)) and set(got) <= free
    n = negative.exact_negatives(spark, 400, 40, 25, 5, positives).groupBy("nbr").count().collect()
    assert len(n) >= 35 and max(r["count"] for r in n) <= 22


def test_keys_reach_past_32_bits(spark):
    big = 3 * 10**12
    ids = [r["n"] for r in negative.draw_uniform(spark.range(2000).toDF("neg_pos"), 1, "src", big, "n").collect()]
    assert len(set(ids)) == 2000 and min(ids) >= 0 and sum(i > 1 << 32 for i in ids) > 1950 and abs(sum(ids) / 2000 / big - 0.5) < 0.03
    got = negative.exact_negatives(spark, 300, 1 << 31, 1 << 30, 4, spark.createDataFrame([(5, 6)], "nbr long, ctr long")).collect()
    assert len({(r["nbr"], r["ctr"]) for r in got}) == 300 and all(0 <= r["nbr"] < 1 << 31 and 0 <= r["ctr"] < 1 << 30 for r in got)
    u = spark.range(1000).select(uniform(key(3, F.col("id"))).alias("u")).collect()
    assert all(0 < r["u"] < 1 for r in u) and len({r["u"] for r in u}) == 1000


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one(spark, n):
    got = [r["y"] for r in permuted(spark.range(n).toDF("x"), "x", n, 5, "t", "y").collect()]
    assert sorted(got) == list(range(n)) and (n < 97 or got != list(range(n)))


def test_search_among_sorted(spark):
    """Values and probes that tie, with and without a key that one half of all rows share."""
    values = [(7 if i % 2 else i % 5, i * 37 % 50) for i in range(400)]
    probes = [(k, p) for k in (0, 3, 7, 9) for p in range(-1, 51)]
    v, p = spark.createDataFrame(values, "k long, v long"), spark.createDataFrame(probes, "k long, p long")
    for inclusive in (True, False):
        at = lambda a, b: a < b or (inclusive and a == b)
        got = search_sorted(v, p, "v", "p", "n", inclusive=inclusive).collect()
        assert len(got) == len(probes) and all(r["n"] == sum(at(x[1], r["p"]) for x in values) for r in got)
        got = search_sorted(v, p, "v", "p", "n", by=("k",), inclusive=inclusive).collect()
        assert all(r["n"] == sum(at(x, (r["k"], r["p"])) for x in values) for r in got)


def test_sums_within_keys_that_span_tasks(spark):
    rows = [(0 if i % 2 else i % 7, i * 29 % 601, float(i % 11)) for i in range(600)]
    got = prefix_within(spark.createDataFrame(rows, "k long, o long, w double"), ["k"], ["o"], "w", "s", "all").collect()
    for r in got:
        own = [x for x in rows if x[0] == r["k"]]
        assert r["s"] == pytest.approx(sum(x[2] for x in own if x[1] <= r["o"])) and r["all"] == pytest.approx(sum(x[2] for x in own))
        assert r["o"] != max(x[1] for x in own) or r["s"] == r["all"]


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("code", ["<f4", ">f8", "<f2", "<i2"])
def test_npy_by_ranges(spark, tmp_path, order, code):
    """Both orders of elements and bytes, cut into many ranges, whole and by rows and columns."""
    a = np.asarray(np.arange(311 * 7).reshape(311, 7) % 1000, code, order=order)
    np.save(tmp_path / "a.npy", a)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        whole = binary.read_npy(spark, str(tmp_path / "a.npy"))
        assert whole.rdd.getNumPartitions() > 4
        got = {r["id"]: r["vec"] for r in whole.collect()}
        assert got == {i: a[i].astype("f8").tolist() for i in range(311)}
        part = binary.read_npy(spark, f"file:{tmp_path}/a.npy", 50, 120, 2, 5).collect()
        assert {r["id"]: r["vec"] for r in part} == {i: a[i, 2:5].astype("f8").tolist() for i in range(50, 120)}
        np.save(tmp_path / "b.npy", a[:, 0])
        assert [r["value"] for r in binary.read_npy(spark, str(tmp_path / "b.npy"), 300).orderBy("id").collect()] == a[300:, 0].tolist()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_npy_header_and_shapes(spark, tmp_path):
    np.save(tmp_path / "c.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "e.npy", np.zeros((0, 3), "<f4"))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "e.npy").read_bytes() + b"123")
    (tmp_path / "no.npy").write_bytes(b"no numbers here")
    for name in ("c", "cut", "no", "missing"):
        with pytest.raises(ValueError):
            binary.read_npy(spark, str(tmp_path / f"{name}.npy"))
    assert binary.read_npy(spark, str(tmp_path / "e.npy")).collect() == []
    t = spark.range(1000).select("id", F.array(*[(F.col("id") * 3 + c).cast("float") for c in range(3)]).alias("vec"))
    binary.write_npy(t, str(tmp_path / "w.npy"), "float32", 1000)
    assert (np.load(tmp_path / "w.npy") == np.arange(1000)[:, None] * 3 + np.arange(3)).all()
    assert "Scan" in binary.read_npy(spark, str(tmp_path / "w.npy"))._jdf.queryExecution().toString()


def test_ids_run_over_files(spark, tmp_path):
    t = spark.range(1000).select("id", (F.col("id") * 2).alias("value"))
    names = binary.write_binary(t, str(tmp_path / "p"), 7, "int64", 1000)
    got = binary.read_binary(spark, names, "int64", start=100, end=900)
    assert sorted((r["id"], r["value"]) for r in got.collect()) == [(i, 2 * i) for i in range(100, 900)]


@pytest.mark.parametrize("dim", [1, 16, 17, 1000])
def test_sums_of_vectors_of_any_length(spark, dim):
    """A hot group, combined before the shuffle; the plan does not grow with the length."""
    df = spark.range(300).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.col("id") * i % 13).cast("float")).alias("v"))
    got = sum_vectors(df, ["k"], "v", "s", rows="n")
    plan = got._jdf.queryExecution().toString()
    assert len(plan) < 60_000
    v = np.arange(300)[:, None] * np.arange(1, dim + 1) % 13
    k = np.where(np.arange(300) % 3 > 0, 7, np.arange(300) % 5)
    for r in got.collect():
        assert r["s"] == v[k == r["k"]].sum(axis=0).tolist() and r["n"] == (k == r["k"]).sum()
    if dim == 16:
        assert [r["s"] for r in sum_vectors(df, ["k"], "v", "s", dim).orderBy("k").collect()] == [r["s"] for r in got.orderBy("k").collect()]


def test_shared_vectors_are_not_shuffled(spark):
    """Vectors that many neighbours share go to every task; a hub and a row that is missing give the same sums as a join by id."""
    e = spark.range(400).select(F.when(F.col("id") % 2 > 0, 7).otherwise(F.col("id") % 9).alias("ctr"), F.col("id").alias("nbr"), (F.col("id") % 6).alias("v"), (F.col("id") % 10 / 7).alias("score"))
    table = spark.createDataFrame([(i, [float(i * j % 11) for j in range(40)]) for i in range(5)], "id long, vec array<float>")
    feats = e.select(F.col("nbr").alias("id"), F.col("v").alias("_v")).join(table.toDF("_v", "vec"), "_v").select("id", "vec")
    rows = lambda df: {r["ctr"]: r["agg"] for r in df.collect()}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (lambda t, **k: analytics.mean_aggregate(e, t, ["ctr"], False, **k), lambda t, **k: analytics.normalised_sum(e, t, **k), lambda t, **k: analytics.attention_aggregate(e, t, ["ctr"], "score", **k)):
            near, want = f(table, shared="v"), rows(f(feats))
            assert "BroadcastHashJoin" in near._jdf.queryExecution().executedPlan().toString()
            got = rows(near)
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        for name in ("mean_aggregate", "normalised_sum", "attention_aggregate"):
            assert "BroadcastHashJoin" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("small,block", [(256, 1024), (3, 5), (0, 1000)])
def test_cooccurrence_of_hot_baskets(spark, small, block, monkeypatch):
    """Repeated memberships, a basket of half of all rows, nulls: the same pairs whether baskets are rows, blocks or both."""
    monkeypatch.setattr(layout, "SMALL_BASKET", small)
    monkeypatch.setattr(layout, "BASKET", block)
    rows = [(0 if i % 2 else i % 40, i * 7 % 23) for i in range(300)] + [(None, 1), (None, 2), (5, None)]
    df = spark.createDataFrame(rows, "k long, i long")
    baskets, want = {}, {}
    for k, i in rows:
        if k is not None and i is not None:
            baskets.setdefault(k, []).append(i)
    for own in baskets.values():
        for x, a in enumerate(own):
            for y, b in enumerate(own):
                if x != y and a != b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = {(r["a"], r["b"]): r["cnt"] for r in layout.cooccurrence(df, "i", "k", 40).collect()}
    assert got == {p: n for p, n in want.items() if n >= 40}


def test_cooccurrence_tasks_grow_with_pairs(spark, monkeypatch):
    """Pairs are dealt to as many tasks as hold a fixed number each; the counts stay the same."""
    df = spark.range(300).select((F.col("id") % 60).alias("k"), (F.col("id") * 7 % 23).alias("i"))
    rows = lambda: sorted(map(tuple, layout.cooccurrence(df, "i", "k", 2).collect()))
    want = rows()
    monkeypatch.setattr(layout, "TASK_ROWS", 40)
    assert want and rows() == want
    assert "REPARTITION_BY_NUM" in (plan := layout.cooccurrence(df, "i", "k", 2)._jdf.queryExecution().executedPlan().toString()) and ", 15)" in plan


def test_equal_shares(spark):
    rows = spark.createDataFrame([(0, 5), (0, 1), (0, 3), (1, 2), (1, 9)], "rank int, id long")
    assert sorted(map(tuple, negative.equal_shares(rows, "rank", ["id"]).collect())) == [(0, 1), (0, 3), (1, 2), (1, 9)]
    assert negative.equal_shares(rows.where("id > 99"), "rank", ["id"]).count() == 0


def test_layer_subgraph_has_loops(spark):
    edges = spark.createDataFrame([(0, 2), (0, 2), (1, 0)], "ctr_pos long, nbr_pos long")
    targets = spark.createDataFrame([(0,), (1,)], "pos long")
    assert sorted(map(tuple, layout.layer_subgraph(edges, targets, True).collect())) == [(0, 0), (0, 2), (0, 2), (1, 0), (1, 1)]
    assert layout.layer_subgraph(edges, targets).count() == 3


def test_layered_forward(spark):
    feats = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -4.0]), (2, [5.0, 6.0])], "id long, vec array<double>")
    edges = spark.createDataFrame([(1, 0), (2, 0), (0, 1)], "nbr long, ctr long")
    first, last = analytics.Layer([[1.0, 0.0], [0.0, 1.0]], [[1.0, 1.0], [-1.0, 0.0]], [0.5, 0.0]), analytics.Layer([[1.0, -1.0]])
    hidden = {0: [7.5, 0.0], 1: [0.5, 0.0], 2: [11.5, 0.0]}  # near (4, 1), (1, 2), (0, 0); own (3, -1), (-1, -3), (11, -5)
    got = {r["id"]: r["vec"] for r in analytics.layered_forward([edges, edges], feats, [first, last]).collect()}
    assert got == {0: [(hidden[1][0] + hidden[2][0]) / 2], 1: [hidden[0][0]], 2: [0.0]}
    with pytest.raises(ValueError):
        analytics.layered_forward([edges], feats, [first, last])


def test_optimizer_waits_for_gradients(spark):
    o = optim.SparseOptimizer("sgd")
    o.add_embedding("a", spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, vec array<double>"))
    got = o.gather("a", spark.createDataFrame([(0, 1)], "pos long, id long"), training=True).first()
    assert got["vec"] == [2.0]
    with pytest.raises(ValueError):
        o.step(0.1)
    o.add_gradients("a", spark.createDataFrame([(1, [10.0])], "id long, grad array<double>"))
    o.step(0.1)
    assert {r["id"]: r["vec"] for r in o.tables["a"].collect()} == {0: [1.0], 1: [1.0]} and not o.need_apply


def test_calls_streams_and_metadata(spark):
    b = spark.createDataFrame([(i, i // 4) for i in range(30)], "input_id long, batch_id long")
    assert [r["call_id"] for r in sample.call_groups(b, 4, 11).orderBy("input_id").collect()] == [i // 4 // 2 for i in range(30)]
    assert {r["call_id"] for r in sample.call_groups(b, 4, 1).collect()} == set(range(8))
    one, again, other = (positive_ints(spark, 3, s, 100).collect() for s in (1, 1, 2))
    assert one == again != other and all(0 <= r["value"] < 1 << 31 for r in one)
    loaders.check_metadata({"a": "text", "b": ("u", "e", "v")})
    for bad in ({"a": 1}, {"a": ("u", "e")}, {3: "text"}):
        with pytest.raises(ValueError):
            loaders.check_metadata(bad)
    g = GraphStore(spark)
    g.put_edge_index(([0], [1]), ("v", "e", "v"), size=(2, 2))
    assert [(tuple(t), kind, size) for t, kind, size in g.edge_attrs()] == [(("v", "e", "v"), "coo", (2, 2))]


def test_intermediate_tables_are_cleared_and_shared(spark):
    """Nothing falls back to a folder of one machine on a cluster."""
    import os
    from types import SimpleNamespace as N

    from neighborflow import scratch

    t = scratch.written(spark.range(5), "t")
    path = t.inputFiles()[0].removeprefix("file://")
    assert t.count() == 5 and os.path.exists(path)
    scratch.clear(spark)
    assert not os.path.exists(path)
    context = lambda master: N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
    conf = N(get=lambda k, *d: "/warehouse" if k == "spark.sql.warehouse.dir" else None)
    assert scratch.shared_dir(N(conf=conf, sparkContext=context("local[8]"))) == "/warehouse/checkpoints"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(N(conf=conf, sparkContext=context(master)))


def test_lists_without_ids_and_epochs(spark):
    e = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (0, 1), (2, 2)], "nbr long, ctr long")
    ptr, col = layout.coo_to_csr(e, 4)
    assert [r["ptr"] for r in ptr.orderBy("row").collect()] == [0, 2, 3, 4, 4]
    assert [tuple(r) for r in col.select("row", "pos_in_row", "col").orderBy("row", "pos_in_row").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 0), (2, 0, 2)]
    ptr, col = layout.coo_to_csr(e, 4, both_ways=True)
    assert [r["ptr"] for r in ptr.orderBy("row").collect()] == [0, 2, 3, 5, 5] and col.count() == 5
    assert epoch_seed(62, 0) == 62 and len({epoch_seed(62, i) for i in range(50)}) == 50
    assert [r["vec"] for r in optim.xavier_uniform(spark, 3, 2, 1).collect()] == [r["vec"] for r in optim.xavier_uniform(spark, 3, 2, 1).repartition(3).orderBy("id").collect()]
    v = [x for r in optim.xavier_uniform(spark, 2000, 3, 1).collect() for x in r["vec"]]
    assert max(map(abs, v)) <= (6 / 2003) ** 0.5 and abs(sum(v) / len(v)) < 0.002
