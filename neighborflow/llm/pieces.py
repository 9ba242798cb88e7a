"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary is a BPE model with byte fallback, so the right ids are those of its merges. They are the one path of a
lattice: nodes are places in the text, arcs are pieces, and an arc may follow another only if merging their two strings
yields just these two pieces; arcs weigh minus one, forbidden successions minus infinity. A sequence is what the merges
produce exactly if every adjacent pair is, so one path of finite weight exists, and the max-plus optimum finds it.

Pieces never run from a mark other than the blank's into a blank, so words are encoded apart and remembered. A giant
text is cut into chunks at fixed places, wherever they fall. The state at a cut is the piece that covers the character
before it and how far it reaches over the cut. Each chunk yields its transfer matrix from states at its left cut to
states at its right one; matrices are combined by max-plus products in a tree of tasks; the best states at all cuts follow; then each chunk
is traced back on its own between its two states. Chunks are rows, spread over all tasks.

Defined results: null and empty texts have no ids; equal texts have equal ids, and a giant text that repeats is encoded
once; the blank mark U+2581 in a text reads as a blank, as the model has it, so only there decoding does not give the
text back; rows that repeat are returned each; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.llm.common import Scratch, id_text

BLANK = "▁"
UNKNOWN, START = -2, -1
#: Characters above which a text counts as giant, characters of a chunk, and chunks whose matrices a task multiplies.
GIANT, CHUNK, SPAN = 1 << 15, 1 << 13, 1 << 12
#: Characters of whole texts whose words are learnt together.
TOGETHER = 1 << 20


class Vocabulary:
    """Pieces and scores of a model file, and which piece may follow which."""

    ROOM = 600_000

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.score = [sp.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.id))
        self.byte = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.bytes = [b"" if special[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(self.text)]
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.known: dict[int, bool] = {}
        self.breaks = "\n" if not any("\n" in p for p in self.id) else None

    def merged(self, s: str) -> list:
        """The merges on a short string, one at a time: the highest score, the leftmost of equals."""
        parts = list(s)
        while True:
            best = None
            for i in range(len(parts) - 1):
                got = self.id.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or self.score[got] > best[0]):
                    best = (self.score[got], i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may come after piece a; after the start or an unknown character, whether it may be at all."""
        key = a << 20 | b if a >= 0 else -1 - b
        got = self.known.get(key)
        if got is None:
            if len(self.known) > self.ROOM:
                self.known.clear()
            pair = ([self.text[a]] if a >= 0 else []) + [self.text[b]]
            got = self.known[key] = self.merged("".join(pair)) == pair
        return got


def walk(v: Vocabulary, s: str, at: int, last: int, stop: int) -> dict[int, tuple[int, int]]:
    """From a path that ends at ``at`` with piece ``last``: place to (last piece, its length) for each place up to
    ``stop`` that a path reaches. Each place has one path at most."""
    ids, longest, known, follows = v.id, v.longest, v.known, v.follows
    ends: dict[int, tuple[int, int]] = {at: (last, 0)}
    dead = 0
    for i in range(at + 1, stop + 1):
        found = None
        for j in range(max(at, i - longest), i):  # long pieces first: fewer of them exist
            piece = ids.get(s[j:i])
            if piece is None:
                if j == i - 1 and j in ends and s[j] not in ids:
                    found = (UNKNOWN, 1)
            elif j in ends:
                before = ends[j][0]
                ok = known.get(before << 20 | piece if before >= 0 else -1 - piece)
                if ok or (ok is None and follows(before, piece)):
                    found = (piece, i - j)
                    break
        if found:
            ends[i] = found
            dead = 0
        elif (dead := dead + 1) >= longest:
            break
    return ends


def trace(v: Vocabulary, s: str, ends: dict, at: int, start: int) -> list[int]:
    """Ids of the path from ``start`` to ``at``; unknown characters as their bytes."""
    out: list[int] = []
    while at > start:
        piece, n = ends[at]
        if piece == UNKNOWN:
            out += [v.byte[b] for b in reversed(s[at - 1].encode("utf-8", "surrogatepass"))]
        else:
            out.append(piece)
        at -= n
    return out[::-1]


class Arcs:
    """Finds the pieces inside many words at once: substring hashes from prefix sums, looked up in two hash tables."""

    BITS = 20

    def __init__(self, v: Vocabulary):
        self.n = v.longest
        size = (1 << 18) + 64
        for seed in range(1, 100):
            base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 1)
            self.base, self.powers = base, np.cumprod(np.full(size, base, np.uint64))
            self.inverse = np.cumprod(np.full(size, np.uint64(pow(int(base), -1, 2**64)), np.uint64))
            self.inverse = np.concatenate([np.ones(1, np.uint64), self.inverse])
            if self._fill(v):
                break

    def _mix(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def _fill(self, v: Vocabulary) -> bool:
        names = list(v.id)
        self.tables = [(np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)) for _ in range(2)]
        codes, lengths = np.array([ord(c) for p in names for c in p], np.uint64), np.array([len(p) for p in names])
        starts = np.cumsum(lengths) - lengths
        within = np.arange(len(codes)) - np.repeat(starts, lengths)
        hashes = self._mix(np.add.reduceat(codes * self.powers[within], starts) + lengths.astype(np.uint64))
        rest = np.arange(len(names))
        for t, (key, piece) in enumerate(self.tables):
            slot = self._slot(hashes[rest], t)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], piece[slot[first]] = hashes[rest][first], np.array([v.id[names[i]] for i in rest[first]], np.int32)
            rest = np.delete(rest, first)
        return len(rest) == 0

    def _slot(self, h: np.ndarray, t: int) -> np.ndarray:
        return ((h >> np.uint64(64 - self.BITS)) if t == 0 else (h & np.uint64((1 << self.BITS) - 1))).astype(np.int64)

    def find(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray) -> np.ndarray:
        h = self._mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        out = np.full(len(h), -1, np.int32)
        for t, (key, piece) in enumerate(self.tables):
            slot = self._slot(h, t)
            hit = key[slot] == h
            out[hit] = piece[slot[hit]]
        return out


class Encoder:
    """Whole texts, word by word, with a bounded memory; and the steps of the scan over a chunk."""

    ROOM, BLOCK, LONG = 180_000, 1 << 17, 40

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.arcs = v, {}, Arcs(v)
        self.pair_key, self.pair_ok = np.full(1 << 21, np.iinfo(np.int64).min), np.zeros(1 << 21, bool)

    def unit(self, w: str) -> bytes:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > self.ROOM:
                self.known.clear()
            self._alone(w)
            got = self.known[w]
        return got

    def learn(self, new: list[str]) -> None:
        """Put words into the memory: short ones of known characters many at once, others by themselves."""
        block, size = [], 0
        for w in new:
            if len(w) > self.LONG:
                self._alone(w)
                continue
            block.append(w)
            size += len(w)
            if size > self.BLOCK:
                self._together(block)
                block, size = [], 0
        if len(block) > 8:
            self._together(block)
        else:
            for w in block:
                self._alone(w)

    def _alone(self, w: str) -> None:
        self.known[w] = np.array(trace(self.v, w, walk(self.v, w, 0, START, len(w)), len(w), 0), "<u4").tobytes()

    def _together(self, block: list[str]) -> None:
        """The walk of many words side by side: all arcs that end at a word's r-th place, for r = 1, 2, ..."""
        v = self.v
        codes = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        first = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(block)), lengths)
        end = np.arange(1, len(codes) + 1)
        at = end - first[word]  # the place within the word after each character
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.arcs.powers[: len(codes)], dtype=np.uint64)])
        starts, ends, found = [], [], []
        for n in range(1, min(v.longest, int(lengths.max())) + 1):
            e = end[at >= n]
            got = self.arcs.find(codes, e - n, e, total)
            if n == 1 and (got < 0).any():  # an unknown character
                got[got < 0] = UNKNOWN
            hit = got != -1
            starts.append(e[hit] - n)
            ends.append(e[hit])
            found.append(got[hit])
        a, e, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(found).astype(np.int64)
        place = at[e - 1]
        order = np.argsort(place, kind="stable")
        a, e, piece = a[order], e[order], piece[order]
        cuts = np.searchsorted(place[order], np.arange(1, int(lengths.max()) + 2))
        w_of = word[e - 1]
        node_a, node_e = a + w_of, e + w_of  # each word has one node more than characters
        nothing = -3
        last, back = np.full(len(codes) + len(block), nothing, np.int64), np.zeros(len(codes) + len(block), np.int64)
        last[first + np.arange(len(block))] = START
        for r in range(len(cuts) - 1):
            s = slice(cuts[r], cuts[r + 1])
            before, p, na, ne = last[node_a[s]], piece[s], node_a[s], node_e[s]
            live = before != nothing
            before, p, na, ne = before[live], p[live], na[live], ne[live]
            yes = self._may_follow(np.where(p == UNKNOWN, np.int64(1) << 50, np.where(before >= 0, before << 20 | p, -1 - p)))
            last[ne[yes]], back[ne[yes]] = p[yes], (ne - na)[yes]
        node, who = first + np.arange(len(block)) + lengths, np.arange(len(block))
        begin = node - lengths
        unknown, ids, owners = np.zeros(len(block), bool), [], []
        while len(who):
            got = last[node]
            unknown[who[got == UNKNOWN]] = True
            ids.append(got)
            owners.append(who)
            node = node - back[node]
            more = node > begin[who]
            node, who = node[more], who[more]
        ids, owners = np.concatenate(ids)[::-1], np.concatenate(owners)[::-1]
        order = np.argsort(owners, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        to = (np.cumsum(np.bincount(owners, minlength=len(block))) * 4).tolist()
        at_byte = 0
        for w, odd, stop in zip(block, unknown.tolist(), to, strict=True):
            if odd:
                self._alone(w)
            else:
                self.known[w] = flat[at_byte:stop]
            at_byte = stop

    def _may_follow(self, keys: np.ndarray) -> np.ndarray:
        """What is known of many successions, from a table of the latest; the rest one by one."""
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        ok, miss = self.pair_ok[slot], np.flatnonzero(self.pair_key[slot] != keys)
        if len(miss):
            v = self.v
            new, which = np.unique(keys[miss], return_inverse=True)
            got = np.array([True if k == 1 << 50 else v.follows(START, -1 - k) if k < 0 else v.follows(k >> 20, k & 0xFFFFF) for k in new.tolist()])
            ok[miss] = got[which]
            self.pair_key[slot[miss]], self.pair_ok[slot[miss]] = keys[miss], ok[miss]
        return ok

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Texts as little-endian unsigned 32-bit ids."""
        split, seen = [self._units(t) for t in texts], set()
        for x in split:
            seen.update(x)
        if len(self.known) + len(seen) // 2 > self.ROOM:
            self.known.clear()
        self.learn([u for u in seen if u not in self.known])
        return [b"".join(map(self.known.__getitem__, x)) for x in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def _units(self, text: str) -> list[str]:
        """Words of a text."""
        return self._split(normal(text)) if text else []

    def _split(self, full: str) -> list[str]:
        """Words of a normal text; a line break that no piece holds is a word of its own."""
        br = self.v.breaks
        if BLANK * 2 not in full and not full.endswith(BLANK):  # one blank before each word: no loop is needed
            full = full.replace(BLANK, " " + BLANK)
            return list(filter(None, (full if br is None else full.replace(br, f" {br} ")).split(" ")))
        if br is None or br not in full:
            return units(full)
        lines = full.split(br)
        out = units(lines[0])
        for x in lines[1:]:
            out.append(br)
            out += units(x)
        return out

    def prepare(self, chunks: list[tuple]) -> None:
        """Learn the whole words of many chunks together."""
        seen = set()
        for w, lo, hi, first, last in chunks:
            if cut := self.parts(w, lo, hi, first, last):
                seen.update(self._split(w[cut[0] : cut[1]]))
        if len(self.known) + len(seen) // 2 > self.ROOM:
            self.known.clear()
        self.learn([u for u in seen if u not in self.known])

    def entries(self, w: str, c: int) -> list[tuple[int, int]]:
        """States at cut c of window w: (reach over the cut, piece)."""
        out = [] if w[c - 1] in self.v.id else [(0, UNKNOWN)]
        for s in range(max(0, c - self.v.longest), c):
            for e in range(c, min(len(w), s + self.v.longest) + 1):
                piece = self.v.id.get(w[s:e])
                if piece is not None and self.v.follows(START, piece):
                    out.append((e - c, piece))
        return out

    def parts(self, w: str, lo: int, hi: int, first: bool, last: bool):
        """Of a chunk [lo, hi) in window w: where its first and last words begin, or None if fewer than two do."""
        begin = lo if first else next((i for i in range(max(1, lo), hi) if w[i] == BLANK and w[i - 1] != BLANK), None)
        end = next((i for i in range(hi - 1, lo, -1) if w[i] == BLANK and w[i - 1] != BLANK), None)
        return (begin, end) if begin is not None and end is not None and begin < end else None

    def exits(self, ends: dict, hi: int, last: bool, size: int) -> list[tuple[int, int, int]]:
        """(reach, piece, end) of the paths that cover the character before the right cut."""
        if last:
            return [(0, ends[size][0], size)] if size in ends else []
        return [(e - hi, ends[e][0], e) for e in range(hi, min(size, hi + self.v.longest) + 1) if e in ends and ends[e][1] and e - ends[e][1] < hi]

    def matrix(self, w: str, lo: int, hi: int, first: bool, last: bool) -> list[tuple]:
        """The finite cells of a chunk's transfer matrix: (reach in, piece in, reach out, piece out, weight)."""
        size = len(w)
        stop = size if last else min(size, hi + self.v.longest - 1)
        heads = [(0, START)] if first else self.entries(w, lo)
        cut = self.parts(w, lo, hi, first, last)
        cells = []
        if cut is None:
            for reach, piece in heads:
                ends = walk(self.v, w, lo + reach, piece, stop)
                cells += [(reach, piece, r, p, -float(self._steps(ends, e, lo + reach))) for r, p, e in self.exits(ends, hi, last, size)]
            return cells
        tail = walk(self.v, w, cut[1], START, stop)
        out = [(r, p, self._steps(tail, e, cut[1])) for r, p, e in self.exits(tail, hi, last, size)]
        middle = sum(map(len, map(self.unit, self._split(w[cut[0] : cut[1]])))) // 4
        for reach, piece in heads:
            ends = walk(self.v, w, lo + reach, piece, cut[0])
            if cut[0] in ends:
                done = self._steps(ends, cut[0], lo + reach) + middle
                cells += [(reach, piece, r, p, -float(done + n)) for r, p, n in out]
        return cells

    def _steps(self, ends: dict, at: int, start: int) -> int:
        n = 0
        while at > start:
            at, n = at - ends[at][1], n + 1
        return n

    def between(self, w: str, lo: int, hi: int, first: bool, last: bool, came: tuple[int, int], goes: tuple[int, int]) -> bytes:
        """The chunk's ids from its state at the left cut to that at the right one."""
        size, at = len(w), lo + came[0]
        stop = size if last else hi + goes[0]
        cut = self.parts(w, lo, hi, first, last)
        as_bytes = lambda ids: np.array(ids, "<u4").tobytes()
        if cut is None:
            return as_bytes(trace(self.v, w, walk(self.v, w, at, came[1], stop), stop, at))
        head = trace(self.v, w, walk(self.v, w, at, came[1], cut[0]), cut[0], at)
        tail = trace(self.v, w, walk(self.v, w, cut[1], START, stop), stop, cut[1])
        return as_bytes(head) + b"".join(map(self.unit, self._split(w[cut[0] : cut[1]]))) + as_bytes(tail)


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[str, Encoder] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One per worker process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encoder_of(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary_of(path))
    return _encoders[path]


def normal(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


def units(s: str) -> list[str]:
    """Runs of blanks with the word after them. Only the first unit can lack a blank."""
    words = s.split(BLANK)
    out, blanks = [words[0]] if words[0] else [], 0
    for w in words[1:]:
        blanks += 1
        if w:
            out.append(BLANK * blanks + w)
            blanks = 0
    if blanks:
        out.append(BLANK * blanks)
    return out


def multiply(a: dict, b: dict) -> dict:
    """Max-plus product of sparse matrices {(from, to): weight}."""
    by: dict = {}
    for (x, y), w in b.items():
        by.setdefault(x, []).append((y, w))
    out: dict = {}
    for (x, y), w in a.items():
        for z, u in by.get(y, ()):
            if w + u > out.get((x, z), -np.inf):
                out[(x, z)] = w + u
    return out


def tree(matrices: list[dict], lo: int = 0, hi: int | None = None) -> tuple:
    """(product, left half, right half) of matrices in order, by products of halves of halves."""
    hi = len(matrices) if hi is None else hi
    if hi - lo == 1:
        return matrices[lo], None, None
    mid = (lo + hi) // 2
    left, right = tree(matrices, lo, mid), tree(matrices, mid, hi)
    return multiply(left[0], right[0]), left, right


def cuts_between(node: tuple, x: tuple, z: tuple) -> list[tuple]:
    """The states at all cuts of the best path from x to z, both included: back down the tree, each half gets its own
    end states."""
    out = [x]

    def split(node, x, z):
        _, left, right = node
        if left is None:
            out.append(z)
            return
        y = max(((w + right[0][(m, z)], m) for (a, m), w in left[0].items() if a == x and (m, z) in right[0]), key=lambda t: t[0])[1]
        split(left, x, y)
        split(right, y, z)

    split(node, x, z)
    return out


def best_states(matrices: list[dict]) -> list[tuple]:
    """The states at all cuts, the start's and the end's included, of the best path through matrices in order."""
    root = tree(matrices)
    (x, z), _ = max(root[0].items(), key=lambda kv: kv[1])
    return cuts_between(root, x, z)


STATES = ["reach_in", "piece_in", "reach_out", "piece_out"]


def _matrices(pdf: pd.DataFrame, by: str) -> list[dict]:
    """Matrices in the order of ``by`` from their cells."""
    first = pdf[by].min()
    out: list[dict] = [{} for _ in range(pdf[by].max() - first + 1)]
    for n, a, b, c, d, w in pdf[[by, *STATES, "weight"]].itertuples(index=False):
        out[n - first][((a, b), (c, d))] = w
    return out


def scan(cells: DataFrame, span: int) -> DataFrame:
    """digest, n and the states at both cuts of each chunk, from the cells (digest, n, states, weight) of all matrices.

    Products of ``span`` chunks' matrices are tasks of their own; a text's products are combined; the states at the cuts
    between these go back to the same tasks. A value of Spark's holds 2 GB at most, so a text has at most 64 such products.
    Cells are few bytes but slow to multiply, so they are dealt to a fixed number of tasks, which Spark does not merge by
    their bytes.
    """
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    run = cells.withColumn("run", F.floor(F.col("n") / span).cast("int")).repartition(tasks, "digest", "run")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        root = tree(_matrices(pdf, "n"))[0]
        return pd.DataFrame([(pdf["digest"].iloc[0], pdf["run"].iloc[0], *x, *z, w) for (x, z), w in root.items()], columns=["digest", "run", *STATES, "weight"])

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        at = best_states(_matrices(pdf, "run"))
        return pd.DataFrame([(pdf["digest"].iloc[0], r, *at[r], *at[r + 1]) for r in range(len(at) - 1)], columns=["digest", "run", "x0", "x1", "z0", "z1"])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, x1, z0, z1 = (int(v) for v in pdf[["x0", "x1", "z0", "z1"]].iloc[0])
        at, first = cuts_between(tree(_matrices(pdf, "n")), (x0, x1), (z0, z1)), int(pdf["n"].min())
        return pd.DataFrame([(pdf["digest"].iloc[0], first + i, *at[i], *at[i + 1]) for i in range(len(at) - 1)], columns=["digest", "n", *STATES])

    kinds = ", ".join(f"{c} int" for c in STATES)
    products = run.groupBy("digest", "run").applyInPandas(product, f"digest string, run int, {kinds}, weight double")
    ends = products.groupBy("digest").applyInPandas(between, "digest string, run int, x0 int, x1 int, z0 int, z1 int")
    return run.join(ends, ["digest", "run"]).groupBy("digest", "run").applyInPandas(within, f"digest string, n int, {kinds}")


def encode(spark: SparkSession, docs: DataFrame, model_path: str, giant: int = GIANT, chunk: int = CHUNK, span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit)."""
    src = id_text(docs)

    def plain(batches):
        encoder = encoder_of(model_path)
        for pdf in filter(len, batches):
            for _, part in pdf.groupby(pdf["text"].str.len().cumsum() // TOGETHER):
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": encoder.encode_many(part["text"].tolist())})
        encoder.known.clear()  # words go with the task; which pieces may follow which stays

    small = src.where(F.length("text") <= giant).mapInPandas(plain, "doc_id long, ids binary")
    s = scratch or Scratch(spark, "pieces")
    long_ = src.where(F.length("text") > giant).withColumn("digest", F.sha2("text", 256))
    named = long_.select("doc_id", "digest")
    # A chunk's window holds as many characters more on either side as the longest piece can reach.
    size = F.length("full")
    margin = 64
    cut = (
        long_.groupBy("digest").agg(F.first("text").alias("text"))
        .select("digest", F.concat(F.lit(BLANK), F.translate("text", " ", BLANK)).alias("full"))
        .select("digest", "full", size.alias("size"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))).alias("n"))
        .select(
            "digest", "n",
            F.least(F.lit(margin), F.col("n") * chunk).alias("lo"),
            (F.least(F.lit(margin), F.col("n") * chunk) + F.least(F.lit(chunk), F.col("size") - F.col("n") * chunk)).alias("hi"),
            (F.col("n") * chunk + chunk >= F.col("size")).alias("last"),
            F.substring("full", F.greatest(F.lit(0), F.col("n") * chunk - margin) + 1, F.lit(chunk + 2 * margin)
                        - F.greatest(F.lit(0), F.lit(margin) - F.col("n") * chunk)).alias("w"),
        )
    )
    chunks = s.save(cut.repartition("digest", "n"), "chunks")

    def matrices(batches):
        encoder = encoder_of(model_path)
        for pdf in filter(len, batches):
            for at in range(0, len(pdf), 64):
                part = [(d, n, (w, lo, hi, n == 0, last)) for d, n, lo, hi, last, w in pdf.iloc[at : at + 64].itertuples(index=False)]
                encoder.prepare([c for _, _, c in part])
                rows = [(d, n, *cell) for d, n, c in part for cell in encoder.matrix(*c)]
                yield pd.DataFrame(rows, columns=["digest", "n", "reach_in", "piece_in", "reach_out", "piece_out", "weight"])
        encoder.known.clear()

    cells = chunks.select("digest", "n", "lo", "hi", "last", "w").mapInPandas(matrices, "digest string, n int, reach_in int, piece_in int, reach_out int, piece_out int, weight double")

    states = scan(s.save(cells, "cells"), span)

    def back(batches):
        encoder = encoder_of(model_path)
        for pdf in filter(len, batches):
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                rows = [((w, lo, hi, n == 0, last), (a, b), (c, d)) for n, lo, hi, last, w, a, b, c, d in part.drop(columns="digest").itertuples(index=False)]
                encoder.prepare([x for x, _, _ in rows])
                yield pd.DataFrame({"digest": part["digest"], "n": part["n"], "ids": [encoder.between(*x, came, goes) for x, came, goes in rows]})
        encoder.known.clear()

    traced = chunks.join(states, ["digest", "n"]).select("digest", "n", "lo", "hi", "last", "w", "reach_in", "piece_in", "reach_out", "piece_out").mapInPandas(back, "digest string, n int, ids binary")
    whole = traced.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("parts")).select("digest", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("ids"))
    return small.unionByName(named.join(whole, "digest").select("doc_id", F.unhex("ids").alias("ids")))


def decode_ids(v: Vocabulary, ids: bytes) -> str:
    """Text of ids: pieces joined, byte pieces as bytes, the first blank dropped."""
    out = b"".join(map(v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text."""

    def run(batches):
        v = vocabulary_of(model_path)
        for pdf in filter(len, batches):
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                yield part.assign(text=[decode_ids(v, x) if x is not None else None for x in part["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, text string")
