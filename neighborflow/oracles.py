"""DuckDB twins of the queries: the same rows, columns and names in plain SQL."""

from __future__ import annotations

from hashlib import md5

SEED = 62


def _u(*parts: str) -> str:
    """A uniform number from the key of SQL expressions."""
    return f"((({_int(*parts)} >> 11) + 0.5) / 4503599627370496.0)"


def _key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def _int(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr({_key(*parts)}, 1, 16) AS UBIGINT) & CAST(9223372036854775807 AS UBIGINT) AS BIGINT)"


OF = "(SELECT o_orderkey AS eid, o_orderkey AS nbr, o_custkey AS ctr, o_totalprice AS wgt, CAST(epoch(o_orderdate) AS BIGINT) AS etime FROM orders)"
LIVES = "(SELECT c_custkey AS eid, c_custkey AS nbr, CAST(c_nationkey AS BIGINT) AS ctr FROM customer)"
#: Customers as a graph: by each order a customer reaches another one.
NEAR = "(SELECT o_orderkey AS eid, (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS nbr, o_custkey AS ctr FROM orders)"
NATION = "(SELECT CAST(n_nationkey AS BIGINT) AS eid, CAST(n_nationkey AS BIGINT) AS nbr, CAST(n_regionkey AS BIGINT) AS ctr FROM nation)"
#: Customers' orders as graphs by nation, with local ids.
GRAPHS = """
    e AS (SELECT c_nationkey AS graph, o_orderkey AS eid, o_orderkey + 10000000 AS nbr, o_custkey AS ctr FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY node) - 1 AS local FROM (SELECT graph, nbr AS node FROM e UNION SELECT graph, ctr FROM e)),
    l AS (SELECT e.graph, eid, a.local AS nbr_local, b.local AS ctr_local FROM e JOIN n a ON a.graph = e.graph AND a.node = e.nbr JOIN n b ON b.graph = e.graph AND b.node = e.ctr)
"""
ONEHOP = f"SELECT o_custkey AS pos, o_custkey AS ctr, o_orderkey AS eid, o_orderkey AS nbr, row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(SEED, 'o_custkey', 'o_custkey', 'o_orderkey')}, o_orderkey) AS rn FROM orders"
#: Two hops: nation to customers (8), customers to orders (3). The type customer-lives-nation is number 0, order-of-customer 1.
HETERO = f"""
    h0 AS (SELECT c_nationkey // 5 AS batch_id, c_custkey AS eid, c_custkey AS nbr, c_nationkey AS ctr FROM customer
           QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_key(SEED, 'c_nationkey // 5', 0, 0, 'c_nationkey', 'c_custkey')}, c_custkey) <= 8),
    h1 AS (SELECT batch_id, o_orderkey AS eid, o_orderkey AS nbr, o_custkey AS ctr FROM orders JOIN (SELECT DISTINCT batch_id, nbr AS c FROM h0) ON c = o_custkey
           QUALIFY row_number() OVER (PARTITION BY batch_id, o_custkey ORDER BY {_key(SEED, 'batch_id', 1, 1, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3),
    e AS (SELECT CAST(batch_id AS BIGINT) AS batch_id, 0 AS hop, 'customer__lives__nation' AS etype, eid, nbr, CAST(ctr AS BIGINT) AS ctr FROM h0
          UNION ALL SELECT CAST(batch_id AS BIGINT), 1, 'order__of__customer', eid, nbr, ctr FROM h1),
    v AS (SELECT CAST(n_nationkey // 5 AS BIGINT) AS batch_id, 'nation' AS vtype, CAST(n_nationkey AS BIGINT) AS id, 0 AS hop, CAST(n_nationkey % 5 AS BIGINT) AS pos FROM nation
          UNION ALL SELECT DISTINCT CAST(batch_id AS BIGINT), 'customer', nbr, 1, NULL FROM h0
          UNION ALL SELECT DISTINCT CAST(batch_id AS BIGINT), 'order', nbr, 2, NULL FROM h1)
"""
GRADS = """
    g0 AS (SELECT o_custkey % ((SELECT count(*) FROM embeddings) - 7) AS id, unnest(range(64)) AS dim, o_totalprice / 1e6 AS p FROM orders),
    g AS (SELECT id, dim, sum(p * CASE WHEN dim % 2 = 0 THEN 1.0 ELSE -0.5 END) AS g FROM g0 GROUP BY ALL),
    t AS (SELECT vec_id AS id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings)
"""


def _optimizer(first: str, columns: dict[str, str], steps: int) -> str:
    """``steps`` passes of expressions over (w, g, states); rows without a gradient stay."""
    sql, last = f"s0 AS (SELECT t.id, t.dim, w, g.g, {first} FROM t LEFT JOIN g USING (id, dim))", "s0"
    for i in range(1, steps + 1):
        stages = [f"{e} AS {c}" for c, e in columns.items()]
        sql += f", s{i} AS (SELECT id, dim, g, {', '.join(stages)} FROM (SELECT *, g + 0.01 * w AS gd FROM {last}))"
        last = f"s{i}"
    return f"WITH {GRADS}, {sql} SELECT id, CAST(dim AS INTEGER) AS dim, round(w, 6) AS val FROM {last}"


def _adam(decoupled: bool) -> str:
    g = "g" if decoupled else "gd"
    w = "(w - 0.1 * 0.01 * w)" if decoupled else "w"
    m, v = f"(0.9 * m + 0.1 * {g})", f"(0.999 * v + 0.001 * {g} * {g})"
    new = f"{w} - 0.1 * ({m} / (1 - 0.9 * b1)) / (sqrt({v} / (1 - 0.999 * b2)) + 1e-8)"
    keep = lambda e, c: f"CASE WHEN g IS NULL THEN {c} ELSE {e} END"
    return _optimizer("0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2", {"w": keep(new, "w"), "m": keep(m, "m"), "v": keep(v, "v"), "b1": keep("b1 * 0.9", "b1"), "b2": keep("b2 * 0.999", "b2")}, 2)


CSR = lambda by, n: f"SELECT row, CAST(coalesce(sum(deg) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM (SELECT r.row, count(o_orderkey) AS deg FROM (SELECT unnest(range((SELECT count(*) + 1 FROM {n}))) AS row) r LEFT JOIN orders ON {by} = r.row GROUP BY 1)"

#: Negatives of all orders in batches of 512: batch, place, number.
_LINKS = """
    k0 AS (SELECT count(*) AS n, CAST(ceil(count(*) / ceil(count(*) / 512)) AS BIGINT) AS share, (SELECT count(*) FROM customer) AS c FROM orders),
    k AS (SELECT n, c, i, i // share AS batch_id, least(512, n - i // share * 512) + i % share AS pos FROM (SELECT n, c, share, unnest(range(n)) AS i FROM k0))
"""


def _shuffled(source: str) -> str:
    """(i, x) of ``source`` through the keyed bijection over the digits of x to the base low, in ranges high and low."""
    sql = f"(SELECT i, high, low, others, x // low AS a, x % low AS b FROM {source})"
    for r in range(4):
        moved = ("a", "b", "high") if r % 2 == 0 else ("b", "a", "low")
        new = f"({moved[0]} + {_int(SEED, chr(39) + 'exact' + chr(39), r, moved[1])} % {moved[2]}) % {moved[2]}"
        sql = f"(SELECT i, high, low, others, {new + ' AS a, b' if r % 2 == 0 else 'a, ' + new + ' AS b'} FROM {sql})"
    return f"SELECT i, high, low, others, a * low + b AS x FROM {sql}"


def _exact_negatives(n_src: str, n_dst: str, taken: str, many: str) -> str:
    """Places go through the bijection until they are ranks among the pairs that are not taken; a rank moves up by the taken
    pairs before it."""
    return f"""
        WITH RECURSIVE p AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS j FROM (SELECT DISTINCT nbr * {n_dst} + ctr AS code FROM {taken})),
        k0 AS (SELECT {n_src} * {n_dst} - (SELECT count(*) FROM p) AS others), k1 AS (SELECT others, CAST(floor(sqrt(others - 1)) AS BIGINT) + 1 AS high FROM k0),
        k AS (SELECT others, high, (others + high - 1) // high AS low FROM k1),
        w AS ({_shuffled('(SELECT i, high, low, others, i AS x FROM k, (SELECT unnest(range(' + many + ')) AS i))')} UNION ALL {_shuffled('(SELECT * FROM w WHERE x >= others)')}),
        r AS (SELECT i, x FROM w WHERE x < others), g AS (SELECT j + 1 AS c, code - j AS gap FROM p),
        s AS (SELECT i, x + coalesce((SELECT max(c) FROM g WHERE gap <= x), 0) AS code FROM r)
        SELECT i AS neg_pos, code // {n_dst} AS nbr, code % {n_dst} AS ctr FROM s"""


def _layer(held: str, new: str, out: int, near: int, root: int, bias: float, cut: bool) -> str:
    """A layer of ``out`` elements: the weighted mean of the neighbours plus the weighted own vector plus the bias."""
    weight = lambda shift: f"((o * 7 + dim * 3 + {shift}) % 11 - 5) / 10.0::DOUBLE"
    value = f"sum(coalesce(m, 0) * {weight(near)} + w * {weight(root)}) + {bias}"
    return f"""{new} AS (SELECT id, o AS dim, {f"greatest({value}, 0)" if cut else value} AS w FROM {held} LEFT JOIN (SELECT ctr AS id, dim, avg(w) AS m FROM e JOIN {held} ON {held}.id = nbr GROUP BY 1, 2) USING (id, dim),
        (SELECT unnest(range({out})) AS o) GROUP BY 1, 2)"""


def _hetero_biased(before: str) -> str:
    return f"""
        WITH h0 AS (SELECT c_nationkey // 5 AS b, c_custkey AS eid, c_nationkey AS ctr FROM customer WHERE c_acctbal > 0
                    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY ln({_u(SEED, 'c_nationkey // 5', 0, 0, 'c_nationkey', 'c_custkey')}) / c_acctbal DESC, c_custkey) <= 6),
        h1 AS (SELECT b, o_orderkey AS eid, o_custkey AS ctr FROM orders JOIN (SELECT DISTINCT b, eid AS c FROM h0) ON c = o_custkey WHERE o_totalprice > 0 {before}
               QUALIFY row_number() OVER (PARTITION BY b, o_custkey ORDER BY ln({_u(SEED, 'b', 1, 1, 'o_custkey', 'o_orderkey')}) / o_totalprice DESC, o_orderkey) <= 2)
        SELECT CAST(b AS BIGINT) AS batch_id, 0 AS hop, 'customer__lives__nation' AS etype, eid, eid AS nbr, CAST(ctr AS BIGINT) AS ctr FROM h0
        UNION ALL SELECT CAST(b AS BIGINT), 1, 'order__of__customer', eid, eid, ctr FROM h1"""


ORACLES = {
    "minimum_slice": f"""
        WITH s AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_mktsegment = 'BUILDING' QUALIFY place < 100),
        b AS (SELECT place // 16 AS batch_id, place % 16 AS pos, id FROM s),
        e AS (SELECT b.batch_id, o_orderkey AS eid, o_custkey AS ctr, o_totalprice FROM b JOIN orders ON o_custkey = b.id
              QUALIFY row_number() OVER (PARTITION BY b.batch_id, o_custkey ORDER BY {_key(SEED, 'b.batch_id', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3)
        SELECT CAST(e.batch_id AS BIGINT) AS batch_id, 0 AS hop, eid, eid AS nbr, ctr, row_number() OVER (PARTITION BY e.batch_id ORDER BY eid) - 1 AS row, b.pos AS col, o_totalprice
        FROM e JOIN b ON b.batch_id = e.batch_id AND b.id = e.ctr""",
    "degree": "SELECT o_custkey AS ctr, count(*) AS deg FROM orders GROUP BY 1",
    "csr_row_ptr": CSR("o_custkey", "customer"),
    "csr_columns": "SELECT o_custkey AS row, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos_in_row, o_orderkey AS col FROM orders",
    "csc_columns": "SELECT c_custkey AS row, 0::BIGINT AS pos_in_row, CAST(c_nationkey AS BIGINT) AS col FROM customer",
    "csr_self_loop": f"SELECT c_custkey AS row, 0::BIGINT AS pos_in_row, c_custkey AS col FROM customer UNION ALL SELECT ctr, row_number() OVER (PARTITION BY ctr ORDER BY eid), nbr FROM {NEAR}",
    "append_unique": """
        WITH t AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_mktsegment = 'BUILDING'),
        f AS (SELECT id, (SELECT count(*) FROM t) + row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT id FROM t)))
        SELECT o_orderkey AS npos, u.id, u.pos FROM orders JOIN (SELECT id, pos FROM t UNION ALL SELECT id, pos FROM f) u ON u.id = o_custkey""",
    "vertex_offsets": """
        WITH c AS (SELECT 'customer' AS vtype, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region)
        SELECT vtype, n, CAST(sum(n) OVER (ORDER BY vtype) - n AS BIGINT) AS "offset" FROM c""",
    "typed_edges": """
        WITH o AS (SELECT (SELECT count(*) FROM customer) AS n0, (SELECT count(*) FROM nation) AS n1, (SELECT count(*) FROM orders) AS n2)
        SELECT 0 AS etype, c_custkey AS eid, c_custkey AS nbr, c_nationkey + n0 AS ctr FROM customer, o
        UNION ALL SELECT 1, n_nationkey, n_nationkey + n0, n_regionkey + n0 + n1 + n2 FROM nation, o
        UNION ALL SELECT 2, o_orderkey, o_orderkey + n0 + n1, o_custkey FROM orders, o""",
    "reverse_edges": "SELECT o_orderkey AS eid, o_custkey AS nbr, o_orderkey AS ctr FROM orders",
    "edge_ids": "SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS eid, l_orderkey AS ctr, l_partkey AS nbr, l_extendedprice FROM lineitem",
    "cooccurrence": "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS cnt FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 3",
    "subgraph_relabel": f"WITH {GRAPHS} SELECT graph, eid, nbr_local, ctr_local FROM l",
    "collate_graphs": f"""WITH {GRAPHS}, s AS (SELECT graph, count(*) AS n FROM n GROUP BY 1), o AS (SELECT graph, CAST(sum(n) OVER (ORDER BY graph) - n AS BIGINT) AS off FROM s)
        SELECT l.graph, eid, nbr_local + off AS nbr_batch, ctr_local + off AS ctr_batch FROM l JOIN o ON o.graph = l.graph""",
    "endpoint_mean": f"SELECT eid, round((a.c_acctbal + b.c_acctbal) / 2, 6) AS prior_mean FROM {NEAR} e LEFT JOIN customer a ON a.c_custkey = e.nbr LEFT JOIN customer b ON b.c_custkey = e.ctr",
    "gather_vec": """
        WITH i AS (SELECT o_orderkey AS pos, o_orderkey % (SELECT count(*) FROM embeddings) - 3 AS id FROM orders),
        v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
        SELECT pos, id, round(e[1], 6) AS v0, round(list_reduce(e, lambda a, x: a + x, 0.0::DOUBLE), 6) AS total FROM i LEFT JOIN v ON vec_id = id""",
    "gather_cast": "SELECT o AS pos, id, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 2) AS value FROM (SELECT l_orderkey AS o, min(l_partkey) AS id FROM lineitem GROUP BY 1) LEFT JOIN part ON p_partkey = id",
    "scatter_upsert": "SELECT c_custkey AS id, coalesce(v, c_acctbal) AS value FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1) ON o_custkey = c_custkey",
    "slice_vec": "SELECT vec_id AS id, CAST(unnest(range(8)) AS INTEGER) AS dim, round(CAST(unnest(embedding[5:12]) AS DOUBLE), 6) AS val FROM embeddings WHERE vec_id >= 10 AND vec_id < 40",
    "local_slice": "SELECT c_custkey AS id, c_acctbal AS value FROM customer, (SELECT count(*) AS n FROM customer) WHERE c_custkey >= 2 * CAST(ceil(n / 7) AS BIGINT) AND c_custkey < least(n, 3 * CAST(ceil(n / 7) AS BIGINT))",
    "truncate_vec": "SELECT vec_id AS id, CAST(unnest(range(16)) AS INTEGER) AS dim, round(CAST(unnest(embedding[1:16]) AS DOUBLE), 6) AS val FROM embeddings",
    "partition_even": "SELECT o_orderkey // CAST(ceil(n / 7) AS BIGINT) AS rank, count(*) AS cnt, min(o_orderkey) AS first FROM orders, (SELECT count(*) AS n FROM orders) GROUP BY 1",
    "partition_near_even": """
        SELECT CASE WHEN o_orderkey < (n % 7) * (n // 7 + 1) THEN o_orderkey // (n // 7 + 1) ELSE (o_orderkey - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS rank, count(*) AS cnt, min(o_orderkey) AS first
        FROM orders, (SELECT count(*) AS n FROM orders) GROUP BY 1""",
    "partition_round_robin": "SELECT o_orderkey AS id, (o_orderkey // 64) % 5 AS rank, (o_orderkey // 64) // 5 * 64 + o_orderkey % 64 AS slot FROM orders",
    "rank_counts": "SELECT (o_custkey - 2) // CAST(ceil(n / 6) AS BIGINT) AS rank, count(*) AS cnt FROM orders, (SELECT count(*) AS n FROM customer) WHERE o_custkey >= 2 GROUP BY 1",
    "dedup_ids": "SELECT o_custkey AS id, count(*) AS cnt FROM orders GROUP BY 1",
    "sort_places": "SELECT o_custkey - 5 AS id, o_orderkey AS pos, row_number() OVER (ORDER BY o_custkey < 5, o_custkey, o_orderkey) - 1 AS place FROM orders",
    "link_inverse": """
        WITH p AS (SELECT o_orderkey // 256 AS batch_id, o_orderkey % 256 AS pos, 0 AS side, o_custkey AS id FROM orders UNION ALL SELECT o_orderkey // 256, o_orderkey % 256, 1, o_custkey % 97 FROM orders)
        SELECT batch_id, side, pos, dense_rank() OVER (PARTITION BY batch_id ORDER BY id) - 1 AS inverse FROM p""",
    "onehop_all": "SELECT o_custkey AS pos, o_orderkey AS eid, o_orderkey AS nbr FROM orders",
    "onehop_uniform": f"SELECT pos, eid, nbr FROM ({ONEHOP}) WHERE rn <= 3",
    "onehop_weighted": f"""
        SELECT o_custkey AS pos, o_orderkey AS eid, o_orderkey AS nbr FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ln({_u(SEED, 'o_custkey', 'o_custkey', 'o_orderkey')}) / o_totalprice DESC, {_key(SEED, 'o_custkey', 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3""",
    "sample_offsets": "SELECT pos, CAST(coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT c_custkey AS pos, least(count(o_orderkey), 3) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)",
    "twohop_resample_all": f"""
        WITH e AS (SELECT o_orderkey AS eid, (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS nbr, o_custkey AS ctr FROM orders),
        n0 AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
        g0 AS (SELECT nbr FROM n0 JOIN e ON e.ctr = n0.id QUALIFY row_number() OVER (PARTITION BY pos ORDER BY {_key(62000, 'pos', 'ctr', 'eid')}, eid) <= 2),
        n1 AS (SELECT pos, id FROM n0 UNION ALL SELECT (SELECT count(*) FROM n0) + row_number() OVER (ORDER BY nbr) - 1, nbr FROM (SELECT DISTINCT nbr FROM g0 WHERE nbr NOT IN (SELECT id FROM n0))),
        g1 AS (SELECT nbr FROM n1 JOIN e ON e.ctr = n1.id QUALIFY row_number() OVER (PARTITION BY pos ORDER BY {_key(62001, 'pos', 'ctr', 'eid')}, eid) <= 2)
        SELECT pos, id FROM n1 UNION ALL SELECT (SELECT count(*) FROM n1) + row_number() OVER (ORDER BY nbr) - 1, nbr FROM (SELECT DISTINCT nbr FROM g1 WHERE nbr NOT IN (SELECT id FROM n1))""",
    "hetero_twohop": f"WITH {HETERO} SELECT batch_id, hop, etype, eid, nbr, ctr FROM e",
    "hetero_nodes": f"WITH {HETERO} SELECT batch_id, vtype, id, hop, row_number() OVER (PARTITION BY batch_id, vtype ORDER BY hop, pos NULLS LAST, id) - 1 AS local_id FROM v",
    "hop_counts": f"WITH {HETERO} SELECT batch_id, etype, hop, count(*) AS num_sampled_edges FROM e GROUP BY ALL",
    "batch_statistics": f"WITH {HETERO} SELECT v.batch_id, v.batch_size, v.num_nodes, coalesce(e.n, 0) AS num_edges FROM (SELECT batch_id, count(*) FILTER (WHERE hop = 0) AS batch_size, count(*) AS num_nodes FROM v GROUP BY 1) v LEFT JOIN (SELECT batch_id, count(*) AS n FROM e GROUP BY 1) e ON e.batch_id = v.batch_id",
    "biased_onehop": f"""
        SELECT o_custkey // 64 AS batch_id, o_orderkey AS eid, o_orderkey AS nbr, o_custkey AS ctr FROM orders WHERE o_orderkey % 3 <> 0 AND o_totalprice > 0
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ln({_u(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}) / o_totalprice DESC, o_orderkey) <= 3""",
    "temporal_onehop": f"""
        SELECT o_custkey // 64 AS batch_id, o_orderkey AS eid, o_orderkey AS nbr, o_custkey AS ctr FROM orders WHERE epoch(o_orderdate) <= 852076800
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3""",
    "temporal_last": """
        WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), s AS (SELECT user_id AS u, (min(t) + max(t)) // 2 AS t0 FROM e GROUP BY 1)
        SELECT user_id AS ctr, event_id AS eid, event_id AS nbr FROM e JOIN s ON u = user_id WHERE t <= t0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id) <= 4""",
    "disjoint_onehop": f"""
        WITH g AS (SELECT o_custkey // 64 AS batch_id, o_orderkey AS eid, o_orderkey % 50 AS nbr, o_custkey AS ctr, o_custkey % 64 AS root FROM orders
                   QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 2)
        SELECT batch_id, eid, nbr, ctr FROM g QUALIFY root = min(root) OVER (PARTITION BY batch_id, nbr)""",
    "replace_onehop": f"""
        WITH p AS (SELECT o_custkey // 64 AS batch_id, o_custkey AS ctr, o_orderkey AS eid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS deg FROM orders),
        d AS (SELECT DISTINCT batch_id, ctr, deg, i FROM p, (SELECT unnest(range(4)) AS i)), x AS (SELECT batch_id, ctr, {_int(SEED, 'batch_id', 'ctr', 'i')} % deg AS place FROM d)
        SELECT x.batch_id, x.ctr, eid, count(*) AS draws FROM x JOIN p ON p.ctr = x.ctr AND p.place = x.place GROUP BY ALL""",
    "seed_batches": "SELECT o_orderkey AS input_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 AS pos FROM orders",
    "shuffle_drop_last": f"""
        WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_key(SEED, 'o_orderkey')}, o_orderkey) - 1 AS r FROM orders)
        SELECT o_orderkey AS input_id, r // 1024 AS batch_id, r % 1024 AS pos FROM p WHERE r < (SELECT count(*) FROM orders) // 1024 * 1024""",
    "replica_slices": """
        WITH p AS (SELECT o_orderkey AS input_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () // 4 // 128 * 128 AS per FROM orders)
        SELECT input_id, (r // 4) // 128 AS batch_id, (r // 4) % 128 AS pos FROM p WHERE r % 4 = 2 AND r < per * 4""",
    "batch_offsets": """
        WITH b AS (SELECT c_custkey // CAST(ceil(n / 6) AS BIGINT) AS rank, CAST(ceil(count(*) / 16) AS BIGINT) AS batches FROM customer, (SELECT count(*) AS n FROM customer) GROUP BY 1)
        SELECT rank, batches, CAST(sum(batches) OVER (ORDER BY rank) - batches AS BIGINT) AS "offset" FROM b""",
    "negative_binary": f"SELECT i AS neg_pos, {_int(SEED, chr(39) + 'src' + chr(39), 'i')} % n AS nbr, {_int(SEED, chr(39) + 'dst' + chr(39), 'i')} % c AS ctr FROM (SELECT count(*) AS n, unnest(range(CAST(greatest(ceil(0.5 * count(*)), ceil(count(*) / 512)) AS BIGINT))) AS i FROM orders), (SELECT count(*) AS c FROM customer)",
    "negative_triplet": f"""
        WITH d AS (SELECT i, n, {_int(SEED, chr(39) + 'pick' + chr(39), 'i')} % n AS pos FROM (SELECT count(*) AS n, unnest(range(CAST(ceil(0.25 * count(*)) AS BIGINT))) AS i FROM orders))
        SELECT i AS neg_pos, o_orderkey AS nbr, {_int(SEED, chr(39) + 'dst' + chr(39), 'i')} % (SELECT count(*) FROM customer) AS ctr FROM d JOIN orders ON o_orderkey = pos""",
    "negative_temporal": f"""
        WITH f AS (SELECT o_custkey AS id, min(CAST(epoch(o_orderdate) AS BIGINT)) AS t FROM orders GROUP BY 1), c AS (SELECT c_custkey AS id, coalesce(t, 1099511627776) AS t FROM customer LEFT JOIN f ON id = c_custkey),
        r AS (SELECT id, t, row_number() OVER (ORDER BY t, id) - 1 AS place FROM c),
        m AS (SELECT x.t, count(r.id) AS many FROM (SELECT DISTINCT CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders) x LEFT JOIN r ON r.t <= x.t GROUP BY 1),
        d AS (SELECT o_orderkey AS neg_pos, CASE WHEN many > 0 THEN {_int(SEED, chr(39) + 'dst' + chr(39), 'o_orderkey')} % many ELSE 0 END AS place FROM orders JOIN m ON m.t = CAST(epoch(o_orderdate) AS BIGINT))
        SELECT neg_pos, id AS node FROM d JOIN r USING (place)""",
    "negative_temporal_retried": f"""
        WITH f AS (SELECT o_custkey AS id, min(CAST(epoch(o_orderdate) AS BIGINT)) AS t FROM orders GROUP BY 1), c AS (SELECT c_custkey AS id, coalesce(t, 1099511627776) AS t FROM customer LEFT JOIN f ON id = c_custkey),
        a AS (SELECT o_orderkey AS neg_pos, CAST(epoch(o_orderdate) AS BIGINT) AS t, i, {_int(SEED, chr(39) + 'dst' + chr(39), 'o_orderkey', 'i')} % (SELECT count(*) FROM customer) AS node FROM orders, (SELECT unnest(range(7)) AS i)),
        g AS (SELECT neg_pos, arg_min(node, i) AS node FROM a JOIN c ON c.id = a.node WHERE c.t <= a.t GROUP BY 1)
        SELECT o_orderkey AS neg_pos, coalesce(g.node, (SELECT id FROM c ORDER BY t, id LIMIT 1)) AS node FROM orders LEFT JOIN g ON neg_pos = o_orderkey""",
    "negative_weighted": f"""
        WITH w AS (SELECT o_custkey AS id, count(*) AS w FROM orders GROUP BY 1), s AS (SELECT id, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER (ORDER BY id) - w AS lo FROM w),
        d AS (SELECT i, {_u(SEED, chr(39) + 'src' + chr(39), 'i')} * (SELECT count(*) FROM orders) AS u FROM (SELECT unnest(range(CAST(greatest(ceil(0.5 * count(*)), ceil(count(*) / 512)) AS BIGINT))) AS i FROM orders))
        SELECT i AS neg_pos, id AS node FROM d JOIN s ON u >= lo AND u < hi""",
    "link_batches": f"""
        WITH k AS (SELECT count(*) AS n, CAST(ceil(count(*) / 512) AS BIGINT) AS b, CAST(ceil(count(*) / ceil(count(*) / 512)) AS BIGINT) AS share FROM orders)
        SELECT o_orderkey // 512 AS batch_id, o_orderkey % 512 AS pos, o_orderkey AS input_id, o_orderkey AS nbr, o_custkey AS ctr, 1.0::DOUBLE AS label FROM orders
        UNION ALL SELECT i // share, least(512, n - i // share * 512) + i % share, -1, {_int(SEED, chr(39) + 'src' + chr(39), 'i')} % n, {_int(SEED, chr(39) + 'dst' + chr(39), 'i')} % c, 0.0
        FROM (SELECT n, share, unnest(range(n)) AS i FROM k), (SELECT count(*) AS c FROM customer)""",
    "false_negatives": f"""
        SELECT neg_pos, d.nbr, d.ctr FROM (SELECT i AS neg_pos, {_int(SEED, chr(39) + 'src' + chr(39), 'i')} % c AS nbr, {_int(SEED, chr(39) + 'dst' + chr(39), 'i')} % c AS ctr
        FROM (SELECT unnest(range(count(*))) AS i FROM orders), (SELECT count(*) AS c FROM customer)) d WHERE NOT EXISTS (SELECT 1 FROM {NEAR} e WHERE e.nbr = d.nbr AND e.ctr = d.ctr)""",
    "exact_negatives": _exact_negatives("(SELECT count(*) FROM customer)", "(SELECT count(*) FROM nation)", "(SELECT c_custkey AS nbr, CAST(c_nationkey AS BIGINT) AS ctr FROM customer)", "(SELECT count(*) FROM customer)"),
    "all_negatives": "SELECT c_custkey AS nbr, CAST(n_nationkey AS BIGINT) AS ctr FROM customer, nation WHERE c_nationkey <> n_nationkey",
    "replace_weighted": f"""
        WITH p AS (SELECT o_custkey // 64 AS batch_id, o_custkey AS ctr, o_orderkey AS eid, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS hi, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders WHERE o_totalprice > 0),
        d AS (SELECT DISTINCT batch_id, ctr, i FROM p, (SELECT unnest(range(4)) AS i)),
        x AS (SELECT d.batch_id, d.ctr, i, arg_min(eid, hi) AS eid FROM d JOIN p ON p.ctr = d.ctr AND hi > total * {_u(SEED, 'd.batch_id', 'd.ctr', 'i', chr(39) + 'weight' + chr(39))} GROUP BY ALL)
        SELECT batch_id, ctr, eid, count(*) AS draws FROM x GROUP BY ALL""",
    "equal_split": f"""
        WITH l AS (SELECT {_int(SEED, chr(39) + 'rank' + chr(39), 'o_orderkey')} % 5 AS rank, o_orderkey AS eid FROM orders WHERE {_u(SEED, chr(39) + 'split' + chr(39), 'o_orderkey')} < 0.8),
        p AS (SELECT rank, eid, row_number() OVER (PARTITION BY rank ORDER BY eid) AS place FROM l)
        SELECT rank, eid FROM p WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY rank))""",
    "call_groups": "SELECT c_custkey AS input_id, (row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS batch_id, (row_number() OVER (ORDER BY c_custkey) - 1) // 64 // 15 AS call_id FROM customer",
    "random_ints": f"SELECT pos, s AS subsequence, {_int(SEED, 's', 'pos')} % 2147483648 AS value FROM (SELECT unnest(range(count(*))) AS pos FROM orders), (SELECT CAST(unnest(range(2)) AS INTEGER) AS s)",
    "layer_subgraph": f"""
        WITH n0 AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
        g AS (SELECT pos, nbr FROM n0 JOIN {NEAR} e ON e.ctr = n0.id QUALIFY row_number() OVER (PARTITION BY pos ORDER BY {_key(62000, 'pos', 'ctr', 'eid')}, eid) <= 2),
        n1 AS (SELECT pos, id FROM n0 UNION ALL SELECT (SELECT count(*) FROM n0) + row_number() OVER (ORDER BY nbr) - 1, nbr FROM (SELECT DISTINCT nbr FROM g WHERE nbr NOT IN (SELECT id FROM n0)))
        SELECT g.pos AS row, n1.pos AS col FROM g JOIN n1 ON n1.id = g.nbr UNION ALL SELECT pos, pos FROM n0""",
    "buffered_steps": _optimizer("0.0::DOUBLE AS s", {"w": "CASE WHEN g IS NULL THEN w ELSE w - 0.1 * gd / (sqrt(s + gd * gd) + 1e-8) END"}, 1),
    "embedding_files": f"""
        WITH {GRADS}, s AS (SELECT t.id, t.dim, w, g, g + 0.01 * w AS gd FROM t LEFT JOIN g USING (id, dim))
        SELECT id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN g IS NULL THEN w ELSE w - 0.1 * gd / (sqrt(gd * gd) + 1e-8) END, 6) AS val, round(CASE WHEN g IS NULL THEN 0 ELSE gd * gd END, 6) AS state FROM s""",
    "layered_forward": f"""
        WITH f0 AS (SELECT c_custkey AS id, dim, w FROM customer JOIN (SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings) ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)),
        e AS (SELECT nbr, ctr FROM {NEAR}), {_layer('f0', 'f1', 4, 0, 2, 0.1, True)}, {_layer('f1', 'f2', 2, 1, 3, 0.0, False)}
        SELECT id, CAST(dim AS INTEGER) AS dim, round(w, 5) AS val FROM f2""",
    "round_robin_parts": """
        SELECT c_custkey AS id, c_acctbal AS value, c_custkey // 16 % 5 AS rank, c_custkey // 80 * 16 + c_custkey % 16 AS slot FROM customer""",
    "link_split": f"""
        WITH s AS (SELECT o_orderkey AS eid, {_u(SEED, chr(39) + 'split' + chr(39), 'o_orderkey')} AS u FROM orders)
        SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS cnt, CAST(sum(eid) AS BIGINT) AS eids FROM s GROUP BY 1""",
    "temporal_split": """
        WITH r AS (SELECT event_id, row_number() OVER (ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) - 1 AS r FROM events)
        SELECT event_id, CASE WHEN r < CAST(floor(0.8 * (SELECT count(*) FROM events)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r""",
    "rating_filter": "SELECT l_partkey AS p, count(*) AS cnt FROM lineitem WHERE l_quantity >= 4 GROUP BY 1",
    "coo_to_csr_both_ways": f"""
        WITH b AS (SELECT nbr, ctr FROM {NEAR} UNION SELECT ctr, nbr FROM {NEAR}), d AS (SELECT r.row, count(b.nbr) AS deg FROM (SELECT unnest(range((SELECT count(*) + 1 FROM customer))) AS row) r LEFT JOIN b ON b.ctr = r.row GROUP BY 1)
        SELECT row, CAST(coalesce(sum(deg) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM d""",
    "split_tables": f"""
        WITH s AS (SELECT label, {_u(SEED, chr(39) + 'node' + chr(39), 'vec_id')} AS u FROM embeddings)
        SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS split, label, count(*) AS cnt FROM s GROUP BY ALL""",
    "mask_index_split": """
        WITH m AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT count(*) AS n FROM m)
        SELECT id, place, CASE WHEN place < (n % 5) * (n // 5 + 1) THEN place // (n // 5 + 1) ELSE (place - (n % 5) * (n // 5 + 1)) // (n // 5) + n % 5 END AS rank FROM m, n""",
    "batch_caps": "SELECT * FROM (SELECT o_orderkey AS input_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 AS pos FROM orders) WHERE batch_id < 3",
    "no_leakage_onehop": f"""
        SELECT s.o_orderkey AS batch_id, o.o_orderkey AS eid, o.o_orderkey AS nbr, o.o_custkey AS ctr FROM orders s JOIN orders o ON o.o_custkey = s.o_custkey
        WHERE CAST(epoch(o.o_orderdate) AS BIGINT) <= CAST(epoch(s.o_orderdate) AS BIGINT) - 1
        QUALIFY row_number() OVER (PARTITION BY s.o_orderkey ORDER BY {_key(SEED, 's.o_orderkey', 0, 0, 'o.o_custkey', 'o.o_orderkey')}, o.o_orderkey) <= 2""",
    "temporal_increasing": f"""
        WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), s AS (SELECT user_id AS u, (min(t) + max(t)) // 2 AS t0 FROM e GROUP BY 1)
        SELECT user_id AS ctr, event_id AS eid, event_id AS nbr FROM e JOIN s ON u = user_id WHERE t > t0
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_key(SEED, '0', 0, 0, 'user_id', 'event_id')}, event_id) <= 3""",
    "biased_temporal": f"""
        SELECT o_custkey // 64 AS batch_id, o_orderkey AS eid, o_orderkey AS nbr, o_custkey AS ctr FROM orders WHERE epoch(o_orderdate) < 852076800 AND o_totalprice > 0
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ln({_u(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}) / o_totalprice DESC, o_orderkey) <= 3""",
    "dedup_grads": f"WITH {GRADS} SELECT id, CAST(dim AS INTEGER) AS dim, round(g, 6) AS val FROM g",
    "sgd_step": _optimizer("0 AS x", {"w": "CASE WHEN g IS NULL THEN w ELSE w - 0.1 * gd END"}, 1),
    "adam_step": _adam(False),
    "adamw_step": _adam(True),
    "adagrad_step": _optimizer("0.0::DOUBLE AS s", {"w": "CASE WHEN g IS NULL THEN w ELSE w - 0.1 * gd / (sqrt(s + gd * gd) + 1e-8) END", "s": "CASE WHEN g IS NULL THEN s ELSE s + gd * gd END"}, 2),
    "rmsprop_step": _optimizer("0.0::DOUBLE AS v", {"w": "CASE WHEN g IS NULL THEN w ELSE w - 0.1 * gd / (sqrt(0.99 * v + 0.01 * gd * gd) + 1e-8) END", "v": "CASE WHEN g IS NULL THEN v ELSE 0.99 * v + 0.01 * gd * gd END"}, 2),
    "xavier_init": f"SELECT c_custkey AS id, CAST(dim AS INTEGER) AS dim, round(({_u(SEED, chr(39) + 'init' + chr(39), 'c_custkey', 'dim')} * 2 - 1) * sqrt(6.0 / (n + 8)), 6) AS val FROM (SELECT c_custkey, count(*) OVER () AS n FROM customer), (SELECT unnest(range(8)) AS dim)",
    "mean_aggregate": f"""
        SELECT ctr, CAST(dim AS INTEGER) AS dim, round(avg(w), 6) AS val FROM (SELECT ctr, nbr % (SELECT count(*) FROM embeddings) AS v FROM ({ONEHOP}) WHERE rn <= 3)
        JOIN (SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings) ON vec_id = v GROUP BY 1, 2""",
    "attention_aggregate": f"""
        WITH e AS (SELECT o_custkey AS ctr, o_orderkey % (SELECT count(*) FROM embeddings) AS v, exp(o_totalprice / 100000 - max(o_totalprice / 100000) OVER (PARTITION BY o_custkey)) AS x FROM orders),
        a AS (SELECT ctr, v, x / sum(x) OVER (PARTITION BY ctr) AS a FROM e)
        SELECT ctr, CAST(dim AS INTEGER) AS dim, round(sum(a * w), 6) AS val FROM a JOIN (SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings) ON vec_id = v GROUP BY 1, 2""",
    "full_inference": "SELECT c_custkey AS id, coalesce(round(avg(o_totalprice), 6), 0.0) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "mrr": "WITH r AS (SELECT l_orderkey, l_returnflag, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) SELECT round(avg(1.0 / r), 6) AS mrr FROM (SELECT min(r) AS r FROM r WHERE l_returnflag = 'R' GROUP BY l_orderkey)",
    "auc": """
        WITH s AS (SELECT l_quantity AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n AS below FROM s),
        t AS (SELECT sum(p * (below + (n + 1) / 2)) AS r, sum(p) AS p, sum(n) - sum(p) AS q FROM r)
        SELECT round(CAST((r - p * (p + 1) / 2) / (p * q) AS DOUBLE), 6) AS auc FROM t""",
    "confusion": """
        WITH c AS (SELECT count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND NOT b) AS tn, count(*) FILTER (WHERE NOT a AND b) AS fn FROM (SELECT l_quantity > 25 AS a, l_returnflag = 'R' AS b FROM lineitem))
        SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c""",
    "argmax_accuracy": "SELECT round(avg(CASE WHEN list_position(v, list_max(v)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)",
    "weighted_mean_loss": "SELECT round(sum(l * n) / sum(n), 4) AS mean FROM (SELECT avg(o_totalprice) AS l, count(*) AS n FROM orders GROUP BY o_orderkey // 512)",
    "lfu_admission": "SELECT id, id // 128 AS set_id, cnt FROM (SELECT o_custkey AS id, count(*) AS cnt FROM orders GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY id // 128 ORDER BY cnt DESC, id) <= 32",
    "cache_hit_rate": """
        WITH c AS (SELECT o_custkey AS id, count(*) AS cnt FROM orders GROUP BY 1), a AS (SELECT cnt, row_number() OVER (PARTITION BY id // 128 ORDER BY cnt DESC, id) AS r FROM c)
        SELECT round(sum(cnt) FILTER (WHERE r <= 32) / sum(cnt), 6) AS hit_rate FROM a""",
    "earliest_latest": "SELECT o_custkey AS id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1",
    "gather_edges": "SELECT p AS pos, eid, o_orderkey AS nbr, o_custkey AS ctr FROM (SELECT l_partkey AS p, min(l_orderkey) AS eid FROM lineitem GROUP BY 1) LEFT JOIN orders ON o_orderkey = eid",
    "update_edges": "SELECT o_orderkey AS eid, round(coalesce(q, o_totalprice), 2) AS wgt FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 100) ON l_orderkey = o_orderkey",
    "hetero_biased": _hetero_biased(""),
    "hetero_biased_temporal": _hetero_biased("AND epoch(o_orderdate) <= 852000000"),
    "csc_to_coo": "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos, o_custkey AS ctr, o_orderkey AS nbr FROM orders",
    "hop_node_counts": f"WITH {HETERO} SELECT batch_id, vtype, hop, count(*) AS num_sampled_nodes FROM v GROUP BY ALL",
    "temporal_monotone": f"""
        WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), s AS (SELECT user_id AS u, (min(t) + max(t)) // 2 AS t0 FROM e GROUP BY 1)
        SELECT user_id AS ctr, event_id AS eid, event_id AS nbr FROM e JOIN s ON u = user_id WHERE t >= t0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_key(SEED, 0, 0, 0, 'user_id', 'event_id')}, event_id) <= 3""",
    "hetero_temporal": f"""
        WITH h0 AS (SELECT c_nationkey // 5 AS b, c_custkey AS eid, c_nationkey AS ctr FROM customer
                    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_key(SEED, 'c_nationkey // 5', 0, 0, 'c_nationkey', 'c_custkey')}, c_custkey) <= 6),
        h1 AS (SELECT b, o_orderkey AS eid, o_custkey AS ctr FROM orders JOIN (SELECT DISTINCT b, eid AS c FROM h0) ON c = o_custkey WHERE epoch(o_orderdate) <= 852000000
               QUALIFY row_number() OVER (PARTITION BY b, o_custkey ORDER BY {_key(SEED, 'b', 1, 1, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 2)
        SELECT CAST(b AS BIGINT) AS batch_id, 0 AS hop, 'customer__lives__nation' AS etype, eid, eid AS nbr, CAST(ctr AS BIGINT) AS ctr FROM h0
        UNION ALL SELECT CAST(b AS BIGINT), 1, 'order__of__customer', eid, eid, ctr FROM h1""",
    "edge_features": f"""
        WITH e AS (SELECT o_custkey // 64 AS batch_id, o_orderkey AS eid, o_custkey % 64 AS col, o_totalprice AS value FROM orders
                   QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3)
        SELECT batch_id, eid, row_number() OVER (PARTITION BY batch_id ORDER BY eid) - 1 AS row, col, value FROM e""",
    "coo_to_csr_columns": f"""
        WITH e AS (SELECT nbr, ctr FROM {NEAR}), u AS (SELECT ctr, nbr FROM e UNION SELECT nbr, ctr FROM e)
        SELECT ctr AS row, row_number() OVER (PARTITION BY ctr ORDER BY nbr) - 1 AS pos_in_row, nbr AS col FROM u""",
    "epoch_batches": f"""
        SELECT o_custkey // 64 AS batch_id, o_orderkey AS eid, o_orderkey AS nbr, o_custkey AS ctr FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(int(md5(b'62|epoch|1').hexdigest()[:8], 16), 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3""",
    "batch_files": f"""
        SELECT o_custkey // 64 // 4 AS call_id, o_custkey // 64 AS batch_id, o_orderkey AS eid, o_orderkey AS nbr, o_custkey AS ctr FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3""",
    "link_positives": "SELECT o_orderkey // 512 AS batch_id, o_orderkey % 512 AS pos, o_orderkey AS input_id, o_orderkey AS nbr, o_custkey AS ctr FROM orders",
    "link_loader_weighted": f"""
        WITH w AS (SELECT c_custkey AS id, count(o_orderkey) + 1 AS w FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT id, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER (ORDER BY id) - w AS lo FROM w),
        k0 AS (SELECT count(*) AS n, CAST(greatest(ceil(0.5 * count(*)), ceil(count(*) / 512)) AS BIGINT) AS many FROM orders), k AS (SELECT n, many, CAST(ceil(many / ceil(n / 512)) AS BIGINT) AS share FROM k0),
        d AS (SELECT i, n, share, {_int(SEED, chr(39) + 'pick' + chr(39), 'i')} % n AS src, {_u(SEED, chr(39) + 'dst' + chr(39), 'i')} * (SELECT sum(w) FROM w) AS u FROM k, (SELECT unnest(range((SELECT many FROM k0))) AS i))
        SELECT i // share AS batch_id, least(512, n - i // share * 512) + i % share AS pos, o_orderkey AS nbr, id AS ctr FROM d JOIN orders ON o_orderkey = src JOIN s ON u >= lo AND u < hi""",
    "loader_batches": f"""
        WITH e AS (SELECT DISTINCT o_custkey // 64 AS batch_id, o_orderkey AS id, o_totalprice AS value FROM orders
                   QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3)
        SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY id) - 1 AS local_id, value FROM e""",
    "link_loader": f"""
        WITH {_LINKS}, p AS (SELECT o_orderkey // 512 AS batch_id, o_orderkey % 512 AS pos, o_orderkey AS input_id, o_orderkey AS nbr, o_custkey AS ctr, 1.0::DOUBLE AS label FROM orders
              UNION ALL SELECT batch_id, pos, -1, {_int(SEED, chr(39) + 'src' + chr(39), 'i')} % n, {_int(SEED, chr(39) + 'dst' + chr(39), 'i')} % c, 0.0 FROM k),
        a AS (SELECT batch_id, nbr, row_number() OVER (PARTITION BY batch_id ORDER BY min(pos), nbr) - 1 AS edge_label_row FROM p GROUP BY 1, 2),
        b AS (SELECT batch_id, ctr, row_number() OVER (PARTITION BY batch_id ORDER BY min(pos), ctr) - 1 AS edge_label_col FROM p GROUP BY 1, 2)
        SELECT p.*, edge_label_row, edge_label_col FROM p JOIN a USING (batch_id, nbr) JOIN b USING (batch_id, ctr)""",
    "link_loader_temporal": f"""
        WITH {_LINKS}, f AS (SELECT o_custkey AS id, min(CAST(epoch(o_orderdate) AS BIGINT)) AS t FROM orders GROUP BY 1), c AS (SELECT c_custkey AS id, coalesce(t, 1099511627776) AS t FROM customer LEFT JOIN f ON id = c_custkey),
        o AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders),
        rc AS (SELECT id, t, row_number() OVER (ORDER BY t, id) - 1 AS place FROM c), ro AS (SELECT id, t, row_number() OVER (ORDER BY t, id) - 1 AS place FROM o),
        m AS (SELECT x.t, (SELECT count(*) FROM rc WHERE rc.t <= x.t) AS mc, (SELECT count(*) FROM ro WHERE ro.t <= x.t) AS mo FROM (SELECT DISTINCT t FROM o) x),
        d AS (SELECT batch_id, pos, o.t, CASE WHEN mo > 0 THEN {_int(SEED, chr(39) + 'src' + chr(39), 'i')} % mo ELSE 0 END AS po, CASE WHEN mc > 0 THEN {_int(SEED, chr(39) + 'dst' + chr(39), 'i')} % mc ELSE 0 END AS pc FROM k JOIN o ON o.id = i % n JOIN m ON m.t = o.t)
        SELECT batch_id, pos, ro.id AS nbr, rc.id AS ctr, d.t FROM d JOIN ro ON ro.place = po JOIN rc ON rc.place = pc""",
    "negative_triplet_weighted": f"""
        WITH w AS (SELECT o_custkey AS id, count(*) AS w FROM orders GROUP BY 1), s AS (SELECT id, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER (ORDER BY id) - w AS lo FROM w),
        d AS (SELECT i, n, {_int(SEED, chr(39) + 'pick' + chr(39), 'i')} % n AS pos, {_u(SEED, chr(39) + 'dst' + chr(39), 'i')} * n AS u FROM (SELECT count(*) AS n, unnest(range(CAST(ceil(0.25 * count(*)) AS BIGINT))) AS i FROM orders))
        SELECT i AS neg_pos, o_orderkey AS nbr, id AS ctr FROM d JOIN orders ON o_orderkey = pos JOIN s ON u >= lo AND u < hi""",
    "negative_unique": f"""
        WITH d AS (SELECT i, {_int(SEED, chr(39) + 'src' + chr(39), 'i')} % c AS nbr, {_int(SEED, chr(39) + 'dst' + chr(39), 'i')} % (SELECT count(*) FROM nation) AS ctr FROM (SELECT unnest(range(CAST(ceil(0.5 * count(*)) AS BIGINT))) AS i FROM orders), (SELECT count(*) AS c FROM customer))
        SELECT min(i) AS neg_pos, nbr, ctr FROM d GROUP BY 2, 3""",
    "balanced_links": f"""
        WITH r AS (SELECT o_orderkey AS pos, CAST(o_totalprice > 150000 AS INTEGER) AS label FROM orders), t AS (SELECT pos, label, row_number() OVER (PARTITION BY label ORDER BY {_key(SEED, chr(39) + 'turn' + chr(39), 'label', 'pos')}, pos) AS turn FROM r)
        SELECT row_number() OVER (ORDER BY turn, label) - 1 AS place, pos, label FROM t""",
    "layered_mean": f"""
        WITH e AS (SELECT DISTINCT nbr, ctr FROM (SELECT (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS nbr, o_custkey AS ctr FROM orders
                   QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key(SEED, 'o_custkey // 64', 0, 0, 'o_custkey', 'o_orderkey')}, o_orderkey) <= 3)),
        f0 AS (SELECT c_custkey AS id, dim, w FROM customer JOIN (SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings) ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)),
        f1 AS (SELECT f0.id, dim, coalesce((w + m) / 2, w) AS w FROM f0 LEFT JOIN (SELECT ctr AS id, dim, avg(w) AS m FROM e JOIN f0 ON f0.id = nbr GROUP BY 1, 2) USING (id, dim)),
        f2 AS (SELECT f1.id, dim, coalesce((w + m) / 2, w) AS w FROM f1 LEFT JOIN (SELECT ctr AS id, dim, avg(w) AS m FROM e JOIN f1 ON f1.id = nbr GROUP BY 1, 2) USING (id, dim))
        SELECT id, round(max(w) FILTER (WHERE dim = 0), 6) AS first, round(sum(w), 4) AS total FROM f2 GROUP BY 1""",
    "sampled_forward": f"""
        WITH e AS (SELECT * FROM {NEAR}),
        n0 AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
        g0 AS (SELECT pos AS c, nbr FROM n0 JOIN e ON e.ctr = n0.id QUALIFY row_number() OVER (PARTITION BY pos ORDER BY {_key(62000, 'pos', 'ctr', 'eid')}, eid) <= 3),
        n1 AS (SELECT pos, id FROM n0 UNION ALL SELECT (SELECT count(*) FROM n0) + row_number() OVER (ORDER BY nbr) - 1, nbr FROM (SELECT DISTINCT nbr FROM g0 WHERE nbr NOT IN (SELECT id FROM n0))),
        g1 AS (SELECT pos AS c, nbr FROM n1 JOIN e ON e.ctr = n1.id QUALIFY row_number() OVER (PARTITION BY pos ORDER BY {_key(62001, 'pos', 'ctr', 'eid')}, eid) <= 2),
        x AS (SELECT c_custkey AS id, i, w FROM customer JOIN (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings) ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)),
        w AS (SELECT o, i, ((o * 7 + i * 3) % 11 - 5) / 50.0::DOUBLE AS a0, ((o * 7 + i * 3 + 1) % 11 - 5) / 50.0::DOUBLE AS a1, ((o * 7 + i * 3 + 2) % 11 - 5) / 50.0::DOUBLE AS b0, ((o * 7 + i * 3 + 3) % 11 - 5) / 50.0::DOUBLE AS b1
              FROM (SELECT unnest(range(256)) AS o), (SELECT unnest(range(256)) AS i)),
        m0 AS (SELECT c, i, avg(x.w) AS m FROM g1 JOIN x ON x.id = g1.nbr GROUP BY 1, 2),
        h AS (SELECT n1.pos, n1.id, o AS i, greatest(sum(coalesce(m, 0) * a0 + x.w * b0), 0) AS w FROM n1 JOIN x USING (id) LEFT JOIN m0 ON m0.c = n1.pos AND m0.i = x.i JOIN w ON w.i = x.i GROUP BY 1, 2, 3),
        m1 AS (SELECT c, i, avg(h.w) AS m FROM g0 JOIN h ON h.id = g0.nbr GROUP BY 1, 2),
        y AS (SELECT n0.pos, n0.id, o, sum(coalesce(m, 0) * a1 + h.w * b1) AS w FROM n0 JOIN h USING (id) LEFT JOIN m1 ON m1.c = n0.pos AND m1.i = h.i JOIN w ON w.i = h.i GROUP BY 1, 2, 3)
        SELECT pos, id, round(max(w) FILTER (WHERE o = 0), 5) AS first, round(sum(w), 4) AS total FROM y GROUP BY 1, 2""",
    "normalised_sum": """
        WITH e AS (SELECT (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS nbr, o_custkey AS ctr FROM orders),
        x AS (SELECT nbr, ctr, 1 / sqrt(count(*) OVER (PARTITION BY nbr) * count(*) OVER (PARTITION BY ctr)) AS a FROM e)
        SELECT ctr, CAST(dim AS INTEGER) AS dim, round(sum(a * w), 6) AS val FROM x JOIN (SELECT vec_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings) ON vec_id = nbr % (SELECT count(*) FROM embeddings) GROUP BY 1, 2""",
    "npy_slice": "SELECT vec_id AS id, CAST(unnest(range(8)) AS INTEGER) AS dim, round(CAST(unnest(embedding[5:12]) AS DOUBLE), 6) AS val FROM embeddings WHERE vec_id >= 100",
    "binary_parts": "SELECT vec_id AS id, CAST(unnest(range(64)) AS INTEGER) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) AS val FROM embeddings",
    "running_price": "SELECT o_orderkey AS id, round(coalesce(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 2) AS before FROM orders",
    "rank_dump": """
        WITH a AS (SELECT 'customer' AS name, c_custkey AS id, round(c_acctbal, 2) AS total, count(*) OVER () AS n FROM customer
        UNION ALL SELECT 'vector', vec_id, round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda p, x: p + x, 0.0::DOUBLE), 4), count(*) OVER () FROM embeddings)
        SELECT name, CAST(CASE WHEN id < (n % 7) * (n // 7 + 1) THEN id // (n // 7 + 1) ELSE (id - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS INTEGER) AS rank, id, total FROM a""",
    "local_parts": "SELECT c_custkey AS id, c_acctbal AS value FROM customer",
    "cached_gather": """
        WITH c AS (SELECT o_custkey AS id, count(*) AS cnt FROM orders GROUP BY 1), a AS (SELECT id, row_number() OVER (PARTITION BY id // 128 ORDER BY cnt DESC, id) AS r FROM c)
        SELECT o_orderkey AS pos, o_custkey AS id, c_acctbal AS value, CAST(r <= 32 AS INTEGER) AS hit FROM orders JOIN a ON id = o_custkey JOIN customer ON c_custkey = o_custkey""",
}
