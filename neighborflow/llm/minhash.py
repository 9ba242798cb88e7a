"""MinHash near-duplicates with sequential Bayesian verification.

Words are lower-cased (A-Z) runs of anything but ASCII white space; a document's set holds its distinct shingles of
``k`` words, or the whole sequence if it has fewer words. Documents with one word sequence form a class, and only
classes are compared. Banded signatures propose candidates. Each candidate's signatures are compared a batch of hashes
at a time and dropped once the posterior probability of reaching the threshold falls under the chosen miss
probability; survivors are confirmed on their full word sets.

Groups of near copies share buckets, and pairs within a bucket are never all emitted. First each class is compared with
the bucket mate it meets most often. Then rounds of new centres per bucket compare only members whose components still
differ. At last the buckets that still hold several components are compared whole, in blocks of bounded size: a task
gets two blocks, tests their pairs in place and returns only links that join components. So the components are those
of the graph of all candidates, without its edges inside components. A bucket, a centre or a group of copies with many
rows is dealt over tasks by a salt before any shuffle on its key, and only rows that a pair names are shuffled.

Defined results: null and empty texts, and those of white space only, have no shingles, link to nothing and are their
own component; rows that share a doc_id count as one node; a null doc_id keeps its row, with its class's component;
an empty table gives an empty one; extra columns are ignored. Very long texts are used whole; the shingle hashes of
one text at a time are in memory. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.llm.common import Scratch, id_text


@dataclass(frozen=True)
class MinHashParams:
    """k words a shingle; link at numerator/denominator or more; bands of rows; hashes compared at once; the posterior
    probability under which a candidate is given up; rounds of bucket centres before the exhaustive one, members and
    shingles of its blocks."""

    k: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 30
    rows: int = 5
    batch: int = 25
    miss: float = 1e-6
    rounds: int = 1
    block: int = 512
    block_shingles: int = 500_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def fewest(self) -> list[tuple[int, int]]:
        """(hashes compared, fewest matches to go on). With a uniform prior, P(similarity >= t | m of n agree) is the
        chance of at most m successes in n + 1 trials of probability t."""
        t, out = self.numerator / self.denominator, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            tail, m = 0.0, 0
            while m <= n and (tail := tail + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < self.miss:
                m += 1
            out.append((n, m))
        return out


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, k: int) -> set:
    """The exact set: tuples of words."""
    w = words(text)
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Word hashes by prefix sums over bytes, shingle hashes from word hashes, signatures from shingle hashes."""

    def __init__(self, p: MinHashParams):
        self.p = p
        rng = np.random.default_rng(97)
        self.a = rng.integers(0, 2**32, p.hashes, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, p.hashes, dtype=np.uint32)
        self.weights = rng.integers(1, 2**63, p.k, dtype=np.uint64) | np.uint64(1)
        self.powers = np.cumprod(np.full(4096, _P, np.uint64))
        self.inverse = np.cumprod(np.full(4096, np.uint64(pow(int(_P), -1, 2**64)), np.uint64))

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.full(2 * n, _P, np.uint64))
            self.inverse = np.cumprod(np.full(2 * n, np.uint64(pow(int(_P), -1, 2**64)), np.uint64))

    def word_hashes(self, w: list[bytes]) -> np.ndarray:
        """Of any number of words, a block of bytes at a time."""
        out, at = [], 0
        while at < len(w):
            end, size = at, 0
            while end < len(w) and (size == 0 or size + len(w[end]) < _BLOCK):
                size += len(w[end]) + 1
                end += 1
            buf = np.frombuffer(b" ".join(w[at:end]), np.uint8)
            self._grow(len(buf) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * self.powers[: len(buf)], dtype=np.uint64)])
            n = np.fromiter(map(len, w[at:end]), np.int64, end - at)
            start = np.cumsum(n + 1) - n - 1
            out.append(_mix((total[start + n] - total[start]) * self.inverse[start] + n.astype(np.uint64)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def sets(self, many: list[list[bytes]]) -> list[np.ndarray]:
        """Distinct shingle hashes of each document, its words hashed together with the others'."""
        h = self.word_hashes([x for w in many for x in w])
        k, out, at = self.p.k, [], 0
        for w in many:
            own, n = h[at : at + len(w)], len(w)
            at += n
            take = [own[i : n - k + 1 + i] for i in range(k)] if n >= k else [own[i : i + 1] for i in range(n)]
            s = sum((x * c for x, c in zip(take, self.weights, strict=False)), np.zeros(len(take[0]) if take else 0, np.uint64))
            out.append(np.unique(_mix(s + np.uint64(min(n, k)))))
        return out

    def signature(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.p.hashes, 2**32 - 1, np.uint32)
        for i in range(0, len(x), 2048):
            h = np.multiply.outer(x[i : i + 2048], self.a)
            h += self.b
            np.minimum(best, h.min(0), out=best)
        return best

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key per row and band."""
        s = signatures.reshape(len(signatures), self.p.bands, self.p.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.p.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), s.shape[:2]).copy()
        for r in range(self.p.rows):
            key = _mix(key + s[:, :, r] * _P)
        return key.view(np.int64)


def signatures(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """doc_id, n_shingles, digest of the word sequence (null without words), sig."""

    def run(batches):
        hasher = Hasher(p)
        for pdf in filter(len, batches):
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                many = [words(t) for t in part["text"]]
                sets = hasher.sets(many)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in many],
                        "sig": [hasher.signature(s).tobytes() if len(s) else None for s in sets],
                    }
                )

    return id_text(docs).mapInPandas(run, "doc_id long, n_shingles long, digest binary, sig binary")


def band_keys(reps: DataFrame, p: MinHashParams) -> DataFrame:
    """rep, key: one row per band."""

    def run(batches):
        hasher = Hasher(p)
        for pdf in filter(len, batches):
            if len(pdf):
                keys = hasher.keys(np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1))
                yield pd.DataFrame({"rep": pdf["rep"].to_numpy(), "keys": list(keys)})

    return reps.select("rep", "sig").mapInPandas(run, "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))


#: Rows of one key that a task takes before the rest of them go to others, and most ids or keys that are sent to every
#: task; beyond that they are joined by a shuffle.
SPREAD, FEW = 1024, 500_000


def _sent(df: DataFrame) -> DataFrame:
    """A written table, marked to be sent to every task if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _salts(many) -> F.Column:
    return F.greatest(F.ceil(many / SPREAD), F.lit(1)).cast("int")


def dealt(big: DataFrame, small: DataFrame, key: str, by: str, s: Scratch, name: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has one row a key and in ``many`` how often it occurs in ``big``. A key with
    more than SPREAD rows is dealt to several tasks by a salt, a hash of the column ``by``; keeps salt and salts."""
    crowds = _sent(s.save(small.where(F.col("many") > SPREAD).select(key, _salts(F.col("many")).alias("salts")), f"{name}-crowds"))
    left = big.join(crowds, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64(by), F.col("salts")).cast("int"))
    return left.join(_fan(small.withColumn("salts", _salts(F.col("many")))).drop("many", "salts"), [key, "salt"], how)


def _fan(small: DataFrame) -> DataFrame:
    """A row for each salt."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _meet(pairs: DataFrame, held: DataFrame, s: Scratch, name: str) -> DataFrame:
    """pairs (a, b) with what ``held`` (rep, one more column) has for both. Only rows that a pair names are shuffled, and
    a centre with many mates is dealt over tasks."""
    column = held.columns[1]
    ends = pairs.select(F.col("a").alias("rep"), F.lit(True).alias("first")).union(pairs.select("b", F.lit(False)))
    ids = s.save(ends.groupBy("rep").agg(F.max("first").alias("first"), F.sum(F.col("first").cast("long")).alias("many")), f"{name}-ids")
    need = s.save(held.join(_sent(ids), "rep"), f"{name}-need")
    right = pairs.join(need.select(F.col("rep").alias("b"), F.col(column).alias(f"{column}_b")), "b")
    left = need.where("first").select(F.col("rep").alias("a"), "many", F.col(column).alias(f"{column}_a"))
    return dealt(right, left, "a", "b", s, name).select("a", "b", f"{column}_a", f"{column}_b")


def bayes(pairs: DataFrame, reps: DataFrame, p: MinHashParams, s: Scratch, name: str) -> DataFrame:
    """The candidates (a, b) that no batch of hashes rules out."""
    both = _meet(pairs, reps.select("rep", "sig"), s, f"{name}-sig")
    fewest = p.fewest()

    def run(batches):
        for pdf in filter(len, batches):
            left = np.frombuffer(b"".join(pdf["sig_a"]), np.uint32).reshape(len(pdf), -1)
            right = np.frombuffer(b"".join(pdf["sig_b"]), np.uint32).reshape(len(pdf), -1)
            live, hits, done = np.arange(len(pdf)), np.zeros(len(pdf), np.int64), 0
            for n, least in fewest:
                hits[live] += (left[live, done:n] == right[live, done:n]).sum(1)
                live, done = live[hits[live] >= least], n
            yield pdf.iloc[live][["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, p: MinHashParams, s: Scratch, name: str) -> DataFrame:
    """The pairs that reach the threshold on their full sets."""
    both = _meet(pairs, texts.toDF("rep", "text"), s, f"{name}-text")

    def run(batches):
        last, held = None, set()
        for pdf in filter(len, batches):
            keep = []
            for x, y in zip(pdf["text_a"], pdf["text_b"], strict=True):
                if x != last:
                    last, held = x, shingles(x, p.k)
                other = shingles(y, p.k)
                same = len(held & other)
                keep.append(p.denominator * same >= p.numerator * (len(held) + len(other) - same) and same > 0)
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def exhaust(members: DataFrame, reps: DataFrame, texts: DataFrame, p: MinHashParams, s: Scratch, name: str) -> DataFrame:
    """Links (a, b) between members (key, salt, salts, rep, comp) of one bucket in different components. A bucket is split
    into blocks by a hash, of bounded members and shingles on average; each two blocks meet in one task, so a hot bucket
    is dealt over many, and its members are dealt to blocks by salt. A pair is tested in the first band that it shares
    only, by batches of hashes, then on full sets."""
    ids = _sent(s.save(members.select("rep").distinct(), f"{name}-ids"))
    needed = s.save(reps.select("rep", "n", "sig").join(ids, "rep").join(texts.toDF("rep", "text").join(ids, "rep", "left_semi"), "rep"), f"{name}-need")
    sized = members.join(needed.select("rep", "n"), "rep")
    blocks = _fan(sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum("n") / p.block_shingles)).cast("int").alias("blocks"), F.max("salts").alias("salts"))).drop("salts")
    own = members.join(blocks, ["key", "salt"]).withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "rep", "comp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = placed.join(needed.drop("n"), "rep")
    fewest = p.fewest()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        keys = Hasher(p).keys(sig)
        band = int(np.flatnonzero((keys == pdf["key"].iloc[0]).all(0))[0])
        rep, own, two = pdf["rep"].tolist(), pdf["own"].to_numpy(), pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        _, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        sets: dict = {}
        out, held = [], 0

        def words_of(i: int) -> set:
            nonlocal held
            if i not in sets:
                if held > p.block_shingles:  # sets are large; at most so many shingles stay
                    sets.clear()
                    held = 0
                sets[i] = shingles(pdf["text"].iat[i], p.k)
                held += len(sets[i])
            return sets[i]

        for x in range(len(pdf) - 1):
            rest = np.arange(x + 1, len(pdf))
            rest = rest[comp[rest] != comp[x]]
            if two:
                rest = rest[own[rest] != own[x]]
            if band:
                rest = rest[~(keys[rest, :band] == keys[x, :band]).any(1)]
            hits, done = np.zeros(len(rest), np.int64), 0
            for n, least in fewest:
                hits += (sig[rest, done:n] == sig[x, done:n]).sum(1)
                rest, hits, done = rest[hits >= least], hits[hits >= least], n
            for y in rest.tolist():
                if comp[y] != comp[x]:
                    u, v = words_of(x), words_of(y)
                    same = len(u & v)
                    if same and p.denominator * same >= p.numerator * (len(u) + len(v) - same):
                        out.append((rep[x], rep[y]))
                        comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return full.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp: the smallest node reachable. In each round every node moves to its neighbour of least priority, a hash
    that changes with the round, and on to that one's choice; edges then join what the nodes moved to. A round keeps about
    half of the nodes, whatever the order of ids, so the number of rounds grows with the logarithm of a chain's length.
    The moves are put together from the last round back, at a cost that halves likewise. Every step is a written table."""
    s = scratch
    edges = s.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        r = len(moves)
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        least = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(rank("b")).alias("m"), (F.count("*") + 1).alias("many"))
        choice = s.save(least.select(F.col("a").alias("node"), F.least("m", rank("a"))["id"].alias("to"), "many"), f"{name}-choice-{r}")
        hot = not choice.where(F.col("many") > SPREAD).isEmpty()

        def met(big: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:  # a star's leaves are dealt over tasks
            return dealt(big, small, key, by, s, f"{name}-{key}-{r}") if hot else big.join(small.drop("many"), key)  # noqa: B023

        move = met(choice.drop("many"), choice.toDF("to", "on", "many"), "to", "node").select("node", F.col("on").alias("to"))
        move = s.save(move.join(choice.select("node", "many"), "node") if hot else move, f"{name}-move-{r}")
        ends = move if hot else move.withColumn("many", F.lit(1))
        new = met(edges, ends.toDF("a", "c", "many"), "a", "b").select("a", "b", "c")
        new = met(new, ends.toDF("b", "d", "many"), "b", "a").where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        edges = s.save(new, f"{name}-edges-{r + 1}")
        s.drop(f"{name}-edges-{r}", f"{name}-choice-{r}", *[f"{name}-{k}-{r}-crowds" for k in ("to", "a", "b") if hot])
        moves.append(move.select("node", "to"))
    if not moves:
        return edges.toDF("node", "comp")
    root = moves[-1]
    for r in range(len(moves) - 2, -1, -1):
        root = s.save(moves[r].join(root.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("to")), f"{name}-root-{r}")
    least = root.groupBy("to").agg(F.min("node").alias("comp"), F.count("*").alias("many"))
    out = s.save(dealt(root, s.save(least, f"{name}-least"), "to", "node", s, name).select("node", "comp"), name)
    s.drop(f"{name}-least", *[f"{name}-move-{r}" for r in range(len(moves))], *[f"{name}-root-{r}" for r in range(len(moves) - 1)])
    return out


def joined(comp: DataFrame, links: DataFrame, s: Scratch, name: str) -> DataFrame:
    """Components (node, comp) with more links: those of the links between components, put on top."""
    between = links.join(comp.toDF("a", "c"), "a", "left").join(comp.toDF("b", "d"), "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    top = components(between, s, f"{name}-top")
    moved = comp.join(_sent(top).toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return s.save(moved.unionByName(top.join(comp.select("node"), "node", "left_anti")), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, p: MinHashParams = MinHashParams(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    s = scratch or Scratch(spark, "minhash")
    texts = id_text(docs)
    sigs = s.save(signatures(docs, p), "sigs")
    reps = s.save(sigs.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"), F.min("n_shingles").cast("int").alias("n"), F.count("*").alias("many")), "reps")
    bands = s.save(band_keys(reps, p), "bands")
    shared = s.save(bands.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("many")).where("many > 1"), "shared")
    live = s.save(dealt(bands, shared, "key", "rep", s, "live"), "live")
    s.drop("bands", "shared")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        kept = s.save(bayes(pairs, reps, p, s, name), f"{name}-kept")
        found = s.save(confirm(kept, texts, p, s, name), f"{name}-links")
        s.drop(f"{name}-sig-need", f"{name}-text-need")
        return found

    # Each class against the mate it shares most buckets with.
    first = live.where("rep <> centre").groupBy("rep", "centre").agg(F.count("*").alias("n")).groupBy("rep").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    tested = s.save(first.select(F.col("centre").alias("a"), F.col("rep").alias("b")), "tested-0")
    comp = components(checked(tested, "round-0"), s, "comp-0")
    for r in range(1, p.rounds + 2):
        at = live.select("key", "salt", "salts", "rep").join(comp.toDF("rep", "c"), "rep", "left").select("key", "salt", "salts", "rep", F.coalesce("c", "rep").alias("comp"))
        split = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", "key", F.lit(r))).alias("centre"), F.max("salts").alias("salts")).where("lo <> hi")
        open_ = s.save(at.join(_fan(split).select("key", "salt", "centre"), ["key", "salt"]), f"open-{r}")
        if open_.isEmpty():
            break
        if r <= p.rounds:  # one new centre per bucket
            raw = open_.where(F.col("comp") != F.col("centre.comp")).select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b"))
            fresh = s.save(raw.distinct().join(tested, ["a", "b"], "left_anti"), f"tested-{r}")
            more = checked(fresh, f"round-{r}")
            tested = tested.unionByName(fresh)
        else:  # whatever is left
            more = s.save(exhaust(open_.drop("centre"), reps, texts, p, s, f"round-{r}"), f"round-{r}-links")
            s.drop(f"round-{r}-need")
        if not more.isEmpty():
            comp = joined(comp, more, s, f"comp-{r}")
    classes = s.save(reps.select("digest", "rep", "many").join(comp.toDF("rep", "comp"), "rep", "left").select("digest", "many", F.coalesce("comp", "rep").alias("comp")), "classes")
    rows = sigs.select("doc_id", "n_shingles", "digest", F.coalesce("doc_id", F.monotonically_increasing_id()).alias("at"))
    if scratch is None:
        s.only("sigs", "classes")
    out = dealt(rows, classes, "digest", "at", s, "rows", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
