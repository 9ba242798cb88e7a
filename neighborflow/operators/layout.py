"""Graph layout: degrees, row pointers, self loops, deduplicating appends, relabelling, batching of graphs, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborflow.operators.numbering import number_rows, number_within, prefix_sum


#: Memberships of a basket that are paired within one row, and items of a larger one that are paired in one task.
SMALL_BASKET, BASKET = 256, 1024
#: Memberships, and pairs, that a task counts at once.
TASK_ROWS = 1 << 19


def degree(edges: DataFrame, by: str = "ctr") -> DataFrame:
    """by, deg: combined on the map side."""
    return edges.groupBy(by).agg(F.count("*").alias("deg"))


def row_pointers(edges: DataFrame, n_rows: int, by: str = "ctr") -> DataFrame:
    """(row, ptr) for rows 0 to n_rows: exclusive prefix sums of degrees, isolated rows included."""
    rows = edges.sparkSession.range(n_rows + 1).select(F.col("id").alias("row"))
    deg = rows.join(degree(edges, by), rows.row == F.col(by), "left").select("row", F.coalesce("deg", F.lit(0)).alias("deg"))
    return prefix_sum(deg, ["row"], "deg", "ptr").select("row", "ptr")


def column_list(edges: DataFrame, by: str = "ctr", other: str = "nbr") -> DataFrame:
    """(row, pos_in_row, col, eid): the compressed list; the place in the row is its order by edge id. A row's edges may
    span tasks, so a vertex with most of all edges is no task's work alone."""
    rows = edges.select(F.col(by).alias("row"), F.col(other).alias("col"), "eid")
    return number_within(rows, ["row"], ["eid"], "pos_in_row").select("row", "pos_in_row", "col", "eid")


def coo_to_csr(edges: DataFrame, n_rows: int, both_ways: bool = False, by: str = "ctr", other: str = "nbr") -> tuple[DataFrame, DataFrame]:
    """Pointers (row, ptr) and columns (row, pos_in_row, col) of an edge list without ids, optionally with reverse edges.
    Repeated edges become one; a row's columns ascend."""
    pairs = edges.select(F.col(by).alias("ctr"), F.col(other).alias("nbr"))
    if both_ways:
        pairs = pairs.unionByName(pairs.select(F.col("ctr").alias("nbr"), F.col("nbr").alias("ctr")))
    pairs = pairs.distinct().withColumn("eid", F.col("nbr"))
    return row_pointers(pairs, n_rows), column_list(pairs).drop("eid")


def expand_pointers(pointers: DataFrame) -> DataFrame:
    """(pos, row): the row of each place of a compressed list from its pointers (row, ptr); the inverse of ``row_pointers``.
    Every row finds the next one's pointer by number, so no window runs over the rows."""
    nxt = pointers.select((F.col("row") - 1).alias("row"), F.col("ptr").alias("_end"))
    spans = pointers.join(nxt, "row").where(F.col("_end") > F.col("ptr"))
    return spans.select(F.explode(F.sequence("ptr", F.col("_end") - 1)).alias("pos"), "row")


def add_self_loops(edges: DataFrame, n_rows: int) -> DataFrame:
    """(row, pos_in_row, col): a loop first in every row, present loops kept; pointers move by the row's number."""
    loops = edges.sparkSession.range(n_rows).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("pos_in_row"), F.col("id").alias("col"))
    rest = column_list(edges).select("row", (F.col("pos_in_row") + 1).alias("pos_in_row"), "col")
    return loops.unionByName(rest)


def append_unique(targets: DataFrame, neighbours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """targets (pos, id) keep their places; new neighbour ids follow in ascending order. Returns (unique: pos, id) and
    (map: npos, id, pos) for neighbours (npos, id)."""
    n = targets.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n")).first()["n"]  # one number
    fresh = neighbours.select("id").distinct().join(targets, "id", "left_anti")
    numbered = number_rows(fresh, ["id"], "r").select((F.col("r") + n).alias("pos"), "id")
    unique = targets.select(F.col("pos").cast("long").alias("pos"), "id").unionByName(numbered)
    return unique, neighbours.join(unique, "id").select("npos", "id", "pos")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("eid", F.col("ctr").alias("nbr"), F.col("nbr").alias("ctr"), *[c for c in edges.columns if c not in ("eid", "nbr", "ctr")])


def cooccurrence(pairs: DataFrame, item: str, basket: str, at_least: int) -> DataFrame:
    """(a, b, cnt): items that share baskets, each shared membership counted, no diagonal.

    A basket of few memberships becomes one row, its array of items, and pairs come out of the row: one shuffle by groups of
    baskets, and a group's pairs are counted before the next. Memberships and pairs are counted ahead, and dealt to as many
    tasks as hold TASK_ROWS each, so a task's table of pairs does not grow with the input. Larger baskets, of which there
    are few, are split into blocks of items by a hash, and each two blocks meet in a task of their own: its pairs are its
    result, but no task gets a whole basket. There memberships are counted first, so a repeated one multiplies instead of
    making more pairs."""
    from neighborflow.scratch import written

    rows = pairs.select(F.col(basket).alias("k"), F.col(item).alias("i"))
    sizes, few = rows.groupBy("k").agg(F.count("*").alias("n")), F.col("n") <= SMALL_BASKET
    made = F.sum(F.when(few, F.col("n") * (F.col("n") - 1) / 2))
    total = sizes.agg(F.sum("n").alias("rows"), made.alias("pairs"), F.max("n").alias("most")).first()  # three numbers
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(max(total["rows"] or 0, total["pairs"] or 0)) // TASK_ROWS))
    small, found = rows.where("k IS NOT NULL AND i IS NOT NULL"), None
    if (total["most"] or 0) > SMALL_BASKET:
        large = written(sizes.where(~few).select("k"), "large")
        small, found = small.join(large, "k", "left_anti"), _in_blocks(rows.join(large, "k", "left_semi"))
    # A group's baskets are in one task, and pairs of a group are counted there; pairs of all groups then meet in one task each.
    grouped = small.withColumn("g", F.pmod(F.xxhash64("k"), F.lit(8 * parts))).repartition(parts, "g")
    packed = grouped.groupBy("g", "k").agg(F.collect_list("i").alias("all")).where(F.size("all") > 1)
    each = packed.select("g", F.explode("all").alias("a"), "all").select("g", "a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
    counted = each.groupBy("g", "a", "b").agg(F.count("*").alias("c")).select("a", "b", "c").repartition(parts, "a", "b")
    half = counted.groupBy("a", "b").agg(F.sum("c").alias("cnt"))
    if found is not None:
        half = half.unionByName(found.groupBy("a", "b").agg(F.sum("c").alias("cnt"))).groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))
    half = half.where(F.col("cnt") >= at_least)
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return half.select(both.alias("p"), "cnt").select(F.col("p.x").alias("a"), F.col("p.y").alias("b"), "cnt")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """(a, b, c) with a < b: pairs of items of each basket (k, i) and the product of their memberships."""
    m = rows.groupBy("k", "i").agg(F.count("*").alias("c"))
    blocks = m.groupBy("k").agg(F.ceil(F.count("*") / BASKET).cast("int").alias("blocks"))
    placed = m.join(blocks, "k").withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("k", "i", "c", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    left, right = dealt.toDF("k", "a", "ca", "oa", "lo", "hi"), dealt.toDF("k", "b", "cb", "ob", "lo", "hi")
    return left.join(right, ["k", "lo", "hi"]).where("a < b AND (lo = hi OR oa <> ob)").select("a", "b", (F.col("ca") * F.col("cb")).alias("c"))


def layer_subgraph(edges: DataFrame, targets: DataFrame, loops: bool = False) -> DataFrame:
    """(row, col) of a sampled layer as a matrix from edges (ctr_pos, nbr_pos): a row for each target (pos), repeated edges
    kept; with ``loops`` each target also has (pos, pos)."""
    own = edges.select(F.col("ctr_pos").alias("row"), F.col("nbr_pos").alias("col"))
    return own.unionByName(targets.select(F.col("pos").alias("row"), F.col("pos").alias("col"))) if loops else own


def relabel_subgraphs(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """Edges with local ids: the rank of a node among its graph's distinct nodes. A graph may span tasks."""
    nodes = edges.select(graph, F.col("nbr").alias("node")).union(edges.select(graph, "ctr")).distinct()
    local = number_within(nodes, [graph], ["node"], "local")
    return edges.join(local.toDF(graph, "nbr", "nbr_local"), [graph, "nbr"]).join(local.toDF(graph, "ctr", "ctr_local"), [graph, "ctr"])


def collate(local_edges: DataFrame, graph: str = "graph") -> DataFrame:
    """Graphs with local ids put into one batch: ids move by the number of nodes before."""
    sizes = local_edges.groupBy(graph).agg((F.max(F.greatest("nbr_local", "ctr_local")) + 1).alias("n_nodes"))
    offsets = prefix_sum(sizes, [graph], "n_nodes", "offset").select(graph, "offset")
    return local_edges.join(offsets, graph).select(graph, "eid", (F.col("nbr_local") + F.col("offset")).alias("nbr_batch"), (F.col("ctr_local") + F.col("offset")).alias("ctr_batch"))


def endpoint_mean(edges: DataFrame, prior: DataFrame, name: str = "prior_mean") -> DataFrame:
    """Edge attribute: the mean of its endpoints' values in prior (id, value)."""
    both = edges.join(prior.toDF("nbr", "_a"), "nbr", "left").join(prior.toDF("ctr", "_b"), "ctr", "left")
    return both.withColumn(name, (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")
