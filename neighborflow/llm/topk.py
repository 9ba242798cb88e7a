"""Exact top-k search by inner product with a pivot table.

Vectors are turned into whole numbers. A bounded sample gives the pivots, each as far from those before as can be; every
vector's distances to all pivots are computed once and written with it, in blocks of vectors that lie near each other.
As q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, and by the triangle inequality |q - x| is at least the difference of their
distances to any pivot, the largest such difference bounds a score from above. Blocks have bounds likewise, from the range
of their distances. Each block of queries meets its best block first, which gives each query a score to beat; then all
blocks whose bound reaches it. Within a pair of blocks each query takes candidates in the order of their bounds, and stops
when the next bound is under its k-th score: what is left cannot belong to the result. Blocks pass through the tasks, never
whole tables, and their number of rows is bounded.

Where vectors have no structure, as random ones in many dimensions, distances to pivots are nearly alike and bounds rule
little out; then the search evaluates nearly all pairs, and is exact all the same.

Defined results. A vector that is null, has a null or non-finite component (or one that is not finite times 256), or has no
id takes no part. A shorter vector counts as followed by zeros; an empty one is all zeros. A query is a row: rows that share an id
are queries of their own, candidates of each other, and equal in rank order but for a fixed order of rows. Equal scores go to the
smaller id. Scores are exact; one past the bounds of a long is
that bound, and ranked as it. An empty table has no rows. Extra columns take no
part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neighborflow.llm.common import Scratch, small_batches

#: Rows the pivots are chosen from, pivots, rows of a block of candidates and of queries, candidates evaluated at first.
SAMPLE, PIVOTS, BLOCK, QUERY_BLOCK, STEP = 2048, 32, 1024, 256, 32
#: Bytes of vectors a block may hold, for vectors of many dimensions.
BLOCK_BYTES = 16 << 20
#: Bounds are widened by this share of the squares they come from: distances are kept as single floats.
SLACK = 1e-6

BLOCKS = "query boolean, ids binary, rows binary, vecs binary, dists binary, n long, lo array<double>, hi array<double>, norm double"


def whole(vectors, dim: int, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of each component, rows of one length."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def choose_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows of the sample, the first and then each the farthest from all before; none twice."""
    if not len(sample):
        return sample
    found, near = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(found) < many and near.max() > 0:
        found.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[found[-1]], axis=1))
    return sample[found]


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(v - p, axis=1) for p in pivots], axis=1)


def _packed(query: bool, ids, rows, v: np.ndarray, dists: np.ndarray) -> dict:
    exact = "<f4" if np.abs(v).max(initial=0) < 1 << 24 else "<f8"
    return {
        "query": query, "ids": np.asarray(ids, "<i8").tobytes(), "rows": np.asarray(rows, "<i8").tobytes(), "vecs": v.astype(exact).tobytes(), "dists": dists.astype("<f4").tobytes(), "n": len(v),
        "lo": dists.min(axis=0).tolist(), "hi": dists.max(axis=0).tolist(), "norm": float((v * v).sum(axis=1).max()),
    }


class _Block:
    """A block read back from its row's columns."""

    def __init__(self, ids: bytes, rows: bytes, vecs: bytes, dists: bytes, n: int, dim: int):
        self.ids, self.rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
        self.dists = np.frombuffer(dists, "<f4").reshape(n, -1)
        self.v = np.frombuffer(vecs, f"<f{len(vecs) // (n * dim)}").reshape(n, dim)
        self.norms = (self.v.astype("<f8") ** 2).sum(axis=1)


def _scores(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of each query (rows of q) with its own candidates (rows of c), exact."""
    if exact:
        return np.einsum("qd,qsd->qs", q, c, dtype="<f8", casting="safe")
    whole_q = [[int(x) for x in row] for row in q.tolist()]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(high, max(low, sum(a * int(b) for a, b in zip(own, x)))) for x in rows] for own, rows in zip(whole_q, c.tolist())], object)


def search(q: _Block, c: _Block, worst: np.ndarray, k: int, widest: float) -> tuple[list, np.ndarray, int]:
    """(query place, id, row, score) of each query's k best among the candidates that reach its score to beat (``worst``),
    taken in the order of their bounds; each query's score to beat from now on; and how many pairs were evaluated."""
    nq, nc, dim = len(q.ids), len(c.ids), q.v.shape[1]
    apart = np.zeros((nq, nc), "<f4")
    for p in range(q.dists.shape[1]):
        np.maximum(apart, np.abs(q.dists[:, p, None] - c.dists[None, :, p]), out=apart)
    squares = q.norms[:, None] + c.norms[None, :]
    bound = (squares - apart.astype("<f8") ** 2) / 2 + SLACK * (squares + widest)
    bound[np.isnan(bound)] = np.inf  # past what a double holds nothing is ruled out
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    exact = dim * float(np.abs(q.v).max(initial=0)) * float(np.abs(c.v).max(initial=0)) < 2**53
    kth = worst.copy()
    held: list[list[tuple]] = [[] for _ in range(nq)]
    at, step, pairs = 0, STEP, 0
    active = np.arange(nq)
    while at < nc and len(active):
        active = active[bound[active, at] >= kth[active]]
        if not len(active):
            break
        places = order[active, at : at + step]
        scores = _scores(q.v[active], c.v[places], exact)
        pairs += scores.size
        good = (scores >= kth[active, None]) & (c.rows[places] != q.rows[active, None])
        for i, j in zip(*good.nonzero()):
            held[active[i]].append((-int(scores[i, j]), int(c.ids[places[i, j]]), int(c.rows[places[i, j]])))
        for i in active[good.any(axis=1)]:
            held[i] = sorted(held[i])[:k]
            if len(held[i]) == k:
                last = float(-held[i][-1][0])  # a long; rounded down where a double cannot hold it
                kth[i] = max(kth[i], last if abs(last) < 2**53 else np.nextafter(last, -np.inf))
        at, step = at + step, min(2 * step, 256)
    return [(i, ident, row, -score) for i, own in enumerate(held) for score, ident, row in own], kth, pairs


def _index(spark: SparkSession, table: DataFrame, scratch: Scratch, divisor: int, id_col: str, vec_col: str) -> tuple[DataFrame, float, int]:
    """The pivot table in blocks, of candidates and of queries, the square of the widest distance kept, and the vectors' length."""
    raw = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256 * x) < float("inf"))
    raw = raw.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", sound), F.lit(False)))
    raw = scratch.save(raw.withColumn("row", F.monotonically_increasing_id()), "vectors")
    dim = max(1, raw.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0)  # one number
    sample = raw.orderBy(F.xxhash64("id", "v"), "id", "row").limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
    pivots = choose_pivots(whole([r["v"] for r in sample], dim), PIVOTS)
    per_block, per_query = (max(1, min(n, BLOCK_BYTES // (8 * dim))) for n in (BLOCK, QUERY_BLOCK))

    def homes(batches):
        np.seterr(over="ignore", invalid="ignore")
        for pdf in filter(len, batches):
            d = _distances(whole(pdf["v"], dim), pivots)
            yield pdf.assign(home=d.argmin(axis=1), far=d.min(axis=1))

    def pack(batches):
        np.seterr(over="ignore", invalid="ignore")
        kept = {False: ([], [], [], [], per_block), True: ([], [], [], [], per_query)}

        def close(query):
            ids, rows, v, dists, _ = kept[query]
            block = _packed(query, ids, rows, np.array(v), np.array(dists))
            for part in (ids, rows, v, dists):
                part.clear()
            return block

        for pdf in filter(len, batches):
            v = whole(pdf["v"], dim)
            out = []
            for ident, row, own, d in zip(pdf["id"].tolist(), pdf["row"].tolist(), v, _distances(v, pivots)):
                for query in (False, True) if ident % divisor == 0 else (False,):
                    ids, rows, vs, dists, most = kept[query]
                    ids.append(ident), rows.append(row), vs.append(own), dists.append(d)
                    if len(ids) == most:
                        out.append(close(query))
            if out:
                yield pd.DataFrame(out)
        if rest := [close(query) for query in (False, True) if kept[query][0]]:
            yield pd.DataFrame(rest)

    placed = raw.mapInPandas(homes, "id long, v array<double>, row long, home long, far double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = placed.repartitionByRange(parts, "home", "far", "row").sortWithinPartitions("home", "far", "row").mapInPandas(pack, BLOCKS)
    blocks = scratch.save(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    widest = blocks.agg(F.max(F.array_max("hi")).alias("d")).first()["d"] or 0.0  # one number
    return blocks, float(widest) * float(widest), dim


def _bounds(queries: DataFrame, candidates: DataFrame, widest: float) -> DataFrame:
    """(qb, cb, bound): for each two blocks what no score between them exceeds. Blocks are dealt to a grid of tasks."""
    rows, cols = -(-queries.count() // 64), -(-candidates.count() // 1024)
    dealt = lambda df, c, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(max(1, n_own)))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n_other) - 1).cast("long"))))
    q = dealt(queries.toDF("qb", "q_lo", "q_hi", "q_norm"), "qb", "i", rows, "j", cols)
    c = dealt(candidates.toDF("cb", "c_lo", "c_hi", "c_norm"), "cb", "j", cols, "i", rows)
    below, above = F.zip_with("q_lo", "c_hi", lambda a, b: a - b), F.zip_with("c_lo", "q_hi", lambda a, b: a - b)
    apart = F.greatest(F.lit(0.0), F.array_max(below), F.array_max(above))
    squares = F.col("q_norm") + F.col("c_norm")
    return q.join(c, ["i", "j"]).select("qb", "cb", ((squares - apart * apart) / 2 + SLACK * (squares + widest)).alias("bound"))


def top_k(spark: SparkSession, table: DataFrame, k: int = 5, divisor: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is a multiple of ``divisor``, the k rows of largest score."""
    small_batches(spark)
    scratch = Scratch(spark, "topk")
    blocks, widest, dim = _index(spark, table, scratch, divisor, id_col, vec_col)
    payload, of = ["ids", "rows", "vecs", "dists", "n"], {q: blocks.where(F.col("query") == q) for q in (True, False)}
    queries = of[True].select(F.col("block").alias("qb"), *[F.col(c).alias(f"q_{c}") for c in payload])
    candidates = of[False].select(F.col("block").alias("cb"), *[F.col(c).alias(f"c_{c}") for c in payload])
    met = scratch.save(_bounds(of[True].select("block", "lo", "hi", "norm"), of[False].select("block", "lo", "hi", "norm"), widest), "bounds")

    def seek(batches):
        np.seterr(over="ignore", invalid="ignore")
        for pdf in batches:
            for r in pdf.itertuples():
                q, c = _Block(r.q_ids, r.q_rows, r.q_vecs, r.q_dists, r.q_n, dim), _Block(r.c_ids, r.c_rows, r.c_vecs, r.c_dists, r.c_n, dim)
                worst = np.full(len(q.ids), -np.inf) if r.worst is None else np.frombuffer(r.worst, "<f8")
                got, kth, _ = search(q, c, worst, k, widest)
                at = [g[0] for g in got]
                yield pd.DataFrame({"qb": [r.qb], "worst": [kth.tobytes()], "least": [float(kth.min())], "query_row": [q.rows[at]], "query_id": [q.ids[at]], **{c: [[g[i] for g in got]] for i, c in ((1, "vec_id"), (2, "row"), (3, "score"))}})

    columns = ["query_row", "query_id", "vec_id", "row", "score"]
    schema = "qb long, worst binary, least double, " + ", ".join(f"{c} array<long>" for c in columns)

    def evaluated(pairs: DataFrame) -> DataFrame:
        return pairs.join(queries, "qb").join(candidates, "cb").mapInPandas(seek, schema)

    best = met.groupBy("qb").agg(F.max_by("cb", F.struct("bound", "cb")).alias("cb"))
    best = scratch.save(best, "best")
    first = scratch.save(evaluated(best.withColumn("worst", F.lit(None).cast("binary"))), "first")
    rest = met.join(first.select("qb", "worst", "least"), "qb").where("bound >= least").join(best, ["qb", "cb"], "left_anti")
    every = first.unionByName(evaluated(rest.select("qb", "cb", "worst")))
    every = every.select(F.explode(F.arrays_zip(*columns)).alias("g")).select("g.*")
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
