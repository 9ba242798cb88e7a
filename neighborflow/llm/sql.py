"""DuckDB twins of queries, built from parts: DuckDB has no crc32 and no loop over a tree's levels."""

from __future__ import annotations

#: The table of 256 steps of crc32, and the checksum of the bytes that ``{hex}``, a column of hexadecimal digits, spells.
CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i))"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(length({hex}) / 2 AS BIGINT)), lambda i: CAST('0x' || substr({hex}, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle(rows: int = 12, tops: int = 4) -> str:
    """Each level's runs of eight become the next one's nodes until one is left; then the same over the languages; paths and
    folds follow the levels. ``rows`` levels of rows, ``tops`` of languages."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"

    low = leaf(f"translate(text, '{UPPER}', '{LOWER}')")
    step = "SELECT k, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {} GROUP BY k, pos // 8"
    parts = [
        CRC_TABLE,
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {leaf('text')} AS leaf, {low} AS low, hex(CAST(doc_id AS VARCHAR)) AS digits FROM documents)",
        f"""l AS (SELECT doc_id, k, leaf, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n,
             CASE WHEN {CRC.format(hex='digits')} % 3 = 0 THEN low ELSE leaf END AS start FROM d, crc)""",
        "t0 AS (SELECT k, pos, n, leaf AS node FROM l)",
        *[f"t{i + 1} AS ({step.format(f't{i}')})" for i in range(rows)],
        f"u0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, node, k AS lang FROM t{rows})",
        *[f"u{i + 1} AS ({step.format(f'u{i}')})" for i in range(tops)],
        "p0 AS (SELECT l.*, u.pos AS rank, '' AS path, start AS fold FROM l JOIN u0 u ON l.k = u.lang)",
    ]

    def climb(i: int, tree: str, on: str) -> str:
        others = "string_agg(node, '') OVER (PARTITION BY k, pos // 8 ORDER BY pos ROWS BETWEEN {})"
        return (
            f"p{i + 1} AS (SELECT p.* EXCLUDE (path, fold), p.path || coalesce(s.lo, '') || coalesce(s.hi, '') AS path, "
            "CASE WHEN s.n > 1 THEN sha256(coalesce(s.lo, '') || p.fold || coalesce(s.hi, '')) ELSE p.fold END AS fold "
            f"FROM p{i} p JOIN (SELECT k, pos, n, {others.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS lo, {others.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS hi FROM {tree}) s ON {on})"
        )

    parts += [climb(i, f"t{i}", f"s.k = p.k AND s.pos = p.pos >> {3 * i}") for i in range(rows)]
    parts += [climb(rows + i, f"u{i}", f"s.pos = p.rank >> {3 * i}") for i in range(tops)]
    return (
        f"WITH {', '.join(parts)} SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(p.path) AS proof_sha256, p.fold AS folded_root, p.fold = r.node AS verified "
        f"FROM p{rows + tops} p JOIN u0 s ON s.lang = p.k CROSS JOIN u{tops} r"
    )


def spelling() -> str:
    """Words by count; near words share what one deleted letter leaves, at the same place of both or of one alone; forms and
    their chains, at most 20 tenfold steps."""
    letter = "substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)"
    return f"""
        WITH RECURSIVE {CRC_TABLE},
        r AS (SELECT id, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents) GROUP BY id, run),
        x AS (SELECT run, c, hex(encode(id || ':' || run)) AS digits FROM r),
        h AS (SELECT run, c, {CRC.format(hex='digits')} AS h FROM x, crc),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN {letter} ELSE run END AS word, c FROM h),
        words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        half AS (SELECT DISTINCT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                 UNION SELECT DISTINCT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word),
        near AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
        best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS n FROM near JOIN words ON b = word GROUP BY a),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.b END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM words w LEFT JOIN best ON a = word),
        chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c ON c.word = f.word
    """


def topk() -> str:
    """All scores of each query, ranked."""
    return """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """
