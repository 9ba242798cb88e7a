"""Document fingerprints by a randomised edit embedding.

A walk reads a text with shared random bits: at step j it writes the current character and moves on if bit j of that
character's class is one. Two texts with few edits fall back in step soon after each edit, so edit distance turns into
Hamming distance of what they write. As the bits are shared, a character's stay is one table look-up, and a walk takes
one look-up per character, done for many texts side by side. A fingerprint keeps one random bit of what was written at
sampled steps, on two scales of step numbers, so texts of similar length share a scale. Bands of bits propose near texts:
each band samples 32 bits of 48 neighbouring samples, and bands start all along what a walk reached. Where two walks are
in step for a twentieth of their way, whatever the place, a band agrees; where they are not, 32 bits seldom do. The
Hamming distance over all sampled steps that either walk reached verifies.

Defined results: null and empty texts have an all-zero fingerprint with no steps; equal texts have equal fingerprints
and likeness 1; texts more than two scales apart have likeness 0. Documents are ordered by doc_id descending, nulls
last, ties by text; the last is followed by the first, a single document by itself. Repeated rows are documents of
their own; an empty table gives an empty one; extra columns are ignored. Texts are used whole at any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neighborflow.llm.common import id_text

CLASSES, PERIOD, SAMPLES, SCALES = 64, 1 << 14, 1024, 2
#: Bits of a band, the neighbouring samples that they are drawn from, and samples from one band's start to the next.
BAND_BITS, REACH, STRIDE = 32, 48, 4
_BLOCK = 1 << 21

_rng = np.random.default_rng(40961)
_moves = _rng.random((CLASSES, PERIOD)) < 0.5
_moves[:, -1] = True
#: Steps a character of a class stays if the walk comes to it at step j.
STAY = np.zeros((CLASSES, PERIOD), np.uint8)
_next = np.full(CLASSES, PERIOD - 1)
for _j in range(PERIOD - 1, -1, -1):
    _next = np.where(_moves[:, _j], _j, _next)
    STAY[:, _j] = np.minimum(_next - _j + 1, 255)
_STAY = STAY.ravel()
_FRACTIONS = np.sort(_rng.random(SAMPLES))
_BITS = _rng.integers(0, 2, (64, CLASSES, SAMPLES), dtype=np.uint8)
#: The samples of each band, in order.
_BANDS = np.stack([np.sort(start + _rng.choice(REACH, BAND_BITS, replace=False)) for start in range(0, SAMPLES - REACH + 1, STRIDE)])


def classes(text: str) -> np.ndarray:
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((u * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def scale_of(n: int) -> int:
    """The least power of two above 2.2 steps a character."""
    return max(4, int(2.2 * n + 1).bit_length())


def walks(codes: list[np.ndarray], at: list[int]) -> list[np.ndarray]:
    """For each text, the step at which each of its characters is left, if its walk starts at step ``at``."""
    out: list = [None] * len(codes)
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    done = 0
    while done < len(order):
        longest = len(codes[order[done]])
        lanes = order[done : done + max(1, _BLOCK // max(1, longest))]
        done += len(lanes)
        lengths = np.array([len(codes[i]) for i in lanes])
        grid = np.zeros((longest, len(lanes)), np.int32)
        for k, i in enumerate(lanes):
            grid[: lengths[k], k] = codes[i]
        grid *= PERIOD
        left = np.zeros((longest, len(lanes)), np.int64)
        j = np.array([at[i] for i in lanes], np.int64)
        live = np.searchsorted(-lengths, -np.arange(longest), "left")  # lanes longer than each place
        for place in range(longest):
            n = live[place]
            if n < len(j):
                j = j[:n]
            j = j + _STAY[grid[place, :n] + (j & (PERIOD - 1))]
            left[place, :n] = j
        for k, i in enumerate(lanes):
            out[i] = left[: lengths[k], k].copy()
    return out


def bits(code: np.ndarray, left: np.ndarray, scale: int) -> np.ndarray:
    """The sampled bits of a walk on one scale; zero where it never came."""
    steps = (_FRACTIONS * (1 << scale)).astype(np.int64)
    reached = int(np.searchsorted(steps, left[-1])) if len(left) else 0
    out = np.zeros(SAMPLES, np.uint8)
    if reached:
        char = np.searchsorted(left, steps[:reached], "right")
        out[:reached] = _BITS[scale % 64, code[char], np.arange(reached)]
    return out


def fingerprint(code: np.ndarray, left: np.ndarray) -> str:
    """Scale, steps and the bits of SCALES scales as hex."""
    scale = scale_of(len(code))
    body = b"".join(np.packbits(bits(code, left, scale + s)).tobytes() for s in range(SCALES))
    return f"{scale:02x}{int(left[-1]) if len(left) else 0:014x}{body.hex()}"


def parse(f: str) -> tuple[int, int, np.ndarray]:
    return int(f[:2], 16), int(f[2:16], 16), np.frombuffer(bytes.fromhex(f[16:]), np.uint8).reshape(SCALES, -1)


def likeness(f: str, g: str) -> float:
    """One less twice the share of differing bits among the steps that either walk reached, at least 0."""
    if f == g:
        return 1.0
    (sf, tf, bf), (sg, tg, bg) = parse(f), parse(g)
    scale = max(sf, sg)
    if scale - min(sf, sg) >= SCALES:
        return 0.0
    reached = int(np.searchsorted((_FRACTIONS * (1 << scale)).astype(np.int64), max(tf, tg)))
    if not reached:
        return 0.0
    differ = np.unpackbits(bf[scale - sf] ^ bg[scale - sg])[:reached].sum()
    return max(0.0, 1.0 - 2.0 * float(differ) / reached)


def picks(reached: int) -> np.ndarray:
    """The samples of each band within the first ``reached``; a walk shorter than a band has the first one."""
    return _BANDS[: max(1, (reached - REACH) // STRIDE + 1)]


def band_bits(f: str) -> dict[int, np.ndarray]:
    """For each scale, the bits of its bands, packed to one number a band."""
    scale, steps, body = parse(f)
    out = {}
    for s in range(SCALES):
        reached = int(np.searchsorted((_FRACTIONS * (1 << (scale + s))).astype(np.int64), steps))
        out[scale + s] = np.packbits(np.unpackbits(body[s])[picks(reached)], axis=1).view(">u4")[:, 0]
    return out


def bands(f: str) -> list[str]:
    """Keys of the bands on each scale, all along what the walk reached there."""
    return [f"{scale}:{b}:{x:08x}" for scale, got in band_bits(f).items() for b, x in enumerate(got.tolist())]


def banded(f: str, g: str) -> bool:
    """Whether two fingerprints share a band."""
    one, other = band_bits(f), band_bits(g)
    return any((x[: len(y)] == y[: len(x)]).any() for x, y in ((one[scale], other[scale]) for scale in one.keys() & other.keys()))


def fingerprints_of(texts: list[str]) -> list[str]:
    codes = [classes(t) for t in texts]
    return [fingerprint(c, w) for c, w in zip(codes, walks(codes, [0] * len(codes)), strict=True)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text."""

    def run(batches):
        for pdf in filter(len, batches):
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"], "fingerprint": fingerprints_of(part["text"].tolist())})

    return id_text(docs).mapInPandas(run, "doc_id long, fingerprint string")


def members(fingerprints: DataFrame) -> DataFrame:
    """(doc_id, rep): each document and the smallest doc_id with its fingerprint. Rows without a doc_id take no part."""
    named = fingerprints.where("doc_id IS NOT NULL")
    return named.select("doc_id", "fingerprint").join(named.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "fingerprint").select("doc_id", "rep")


#: Fingerprints of one band that a task takes before the rest of them go to others.
SPREAD = 1024


def near_pairs(fingerprints: DataFrame, queries: DataFrame, least: float = 0.5) -> DataFrame:
    """Search: (query, rep, likeness) of fingerprints that share a band with a query's and verify. A fingerprint stands for
    all its documents: ``query`` is the smallest doc_id with it among the queries, ``rep`` the one among all, and
    ``members`` gives the rest, so copies are not expanded into pairs. A band that many fingerprints share is dealt over
    tasks."""
    keyed = lambda df: df.mapInPandas(lambda it: (pd.DataFrame({"fingerprint": p["fingerprint"], "band": [bands(f) for f in p["fingerprint"]]}) for p in filter(len, it)), "fingerprint string, band array<string>").select("fingerprint", F.explode("band").alias("band"))
    one = lambda df, name: df.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias(name))
    left, right = one(queries, "query"), one(fingerprints, "rep")
    sought, held = keyed(left.select("fingerprint")).toDF("f", "band"), keyed(right.select("fingerprint")).toDF("g", "band")
    hot = held.groupBy("band").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts")).where("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    dealt = held.join(hot, "band", "left").withColumn("salt", F.pmod(F.xxhash64("g"), salts).cast("int")).drop("salts")
    asked = sought.join(hot, "band", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    pairs = asked.join(dealt, ["band", "salt"]).select("f", "g").distinct()

    def verify(batches):
        for p in filter(len, batches):
            yield p.assign(likeness=[likeness(f, g) for f, g in zip(p["f"], p["g"], strict=True)])

    near = pairs.mapInPandas(verify, "f string, g string, likeness double").where(F.col("likeness") >= least)
    return near.join(left.withColumnRenamed("fingerprint", "f"), "f").join(right.withColumnRenamed("fingerprint", "g"), "g").select("query", "rep", "likeness")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_banded boolean"


def _compare(rows: list[tuple]) -> pd.DataFrame:
    """rows: (doc_id, text) in order; results of all but the last, each with its successor."""
    texts = [t for _, t in rows]
    codes = [classes(t) for t in texts]
    left = walks(codes, [0] * len(codes))
    own = [fingerprint(c, w) for c, w in zip(codes, left, strict=True)]
    ids, kept, tails, tail_at, edited = [], [], [], [], []
    for i in range(len(rows) - 1):
        m = len(texts[i]) // 3
        n = len(texts[i]) - m
        new = texts[i + 1][:m]
        edited.append(texts[i][:n] + new)
        kept.append(n)
        tails.append(codes[i + 1][: len(new)])
        tail_at.append(int(left[i][n - 1]) if n else 0)
        ids.append(rows[i][0])
    more = walks(tails, tail_at)  # the walk over what was kept is the same
    out = []
    for i, n in enumerate(kept):
        f = fingerprint(np.concatenate([codes[i][:n], tails[i]]), np.concatenate([left[i][:n], more[i]]))
        out.append((ids[i], len(texts[i]), hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(), own[i], f, likeness(own[i], f), likeness(own[i], own[i + 1]), banded(own[i], f)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def edited_likeness(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For every document: fingerprints of its text and of its text with the last third replaced from the next document's
    beginning, and their likeness. Documents are dealt to ranges of doc_id; each range also gets the first document of
    the next one, so whole texts are shuffled once."""
    src = id_text(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts  # several to a task, so that tasks come out even
    found = src.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(found), reverse=True)
    coarse = cuts[63::64]
    above = lambda values: F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in values]), lambda x: x > F.col("doc_id"))) if values else F.lit(0)
    if coarse:
        block = above(coarse)
        inner = F.size(F.filter(F.slice(F.array(*[F.lit(x).cast("long") for x in cuts]), block * 64 + 1, F.lit(64)), lambda x: x > F.col("doc_id")))
        bucket = block * 64 + inner
    else:
        bucket = above(cuts)
    dealt = src.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(bucket))
    # The first document of each range goes to the range before as well: who goes where is known from the ids alone, one
    # row per range, which is sent to all tasks; then its text is picked.
    over = Window.partitionBy(F.lit(0)).orderBy("of")
    heads = dealt.groupBy(F.col("bucket").alias("of")).agg(F.max("doc_id").alias("head")).withColumn("to", F.coalesce(F.lag("of").over(over), F.max("of").over(Window.partitionBy(F.lit(0)))))
    guests = dealt.join(F.broadcast(heads), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy(F.col("to").alias("bucket"), "doc_id").agg(F.min("text").alias("text")).select("bucket", "doc_id", "text", F.lit(1).alias("guest"))
    both = dealt.select("bucket", "doc_id", "text", F.lit(0).alias("guest")).unionByName(guests)
    ordered = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        held, chars, last = [], 0, None
        for pdf in filter(len, batches):
            for b, d, t, guest in zip(pdf["bucket"], pdf["doc_id"], pdf["text"], pdf["guest"], strict=True):
                if held and (b != last or chars > _BLOCK or len(held) > 512):
                    if len(held) > 1:
                        yield _compare(held)
                    held = held[-1:] if b == last else []
                    chars = sum(len(x) for _, x in held)
                held.append((d if d == d else None, t))
                chars, last = chars + len(t), b
        if len(held) > 1:
            yield _compare(held)

    return ordered.mapInPandas(run, RESULT)
