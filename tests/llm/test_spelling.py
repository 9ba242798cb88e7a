import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from neighborflow.llm import spelling as S
from neighborflow.llm.common import Scratch

from .corpora import documents, hard_texts

LETTERS = "abcdefghàß÷ÿ"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def truth(rows, ratio=10):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def found(spark, docs, **more):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in S.variants(spark, docs, **more).collect())


def mutated(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(LETTERS) + w[i:], w[:i] + rng.choice(LETTERS) + w[i + 1 :]])


@pytest.mark.parametrize("meetings", [4, S.MEETINGS])
def test_variants_against_brute_force(spark, meetings):
    """With few meetings allowed in a bucket, buckets are cut down to one open letter."""
    rng = random.Random(meetings)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(6, 14))) for _ in range(25)] + ["commonstem" + c for c in LETTERS] + ["a" * n for n in range(7, 14)]
    words = base + [mutated(rng, rng.choice(base)) for _ in range(250)]
    words += [mutated(rng, w) for w in words[-100:]]
    rows = []
    for i in range(120):
        own = [w for w in rng.choices(words, k=60)]
        rows.append((i, rng.choice([" ", ", ", "1"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in own)))
    rows += [(200 + i, " ".join([base[0]] * 50 + [mutated(rng, base[0]) for _ in range(3)] * 2)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spark, docs, meetings=meetings) == truth(rows)


def test_pairs_are_reported_once_and_hot_buckets_are_cut(spark):
    """Many words with the same first half, and many with the same second."""
    rng = random.Random(3)
    tail = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    words = sorted({"prefix" + tail(6) for _ in range(150)} | {tail(6) + "suffix" for _ in range(150)} | {"prefix" + tail(7) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))
    for meetings in (1, 200, 1 << 20):
        got = [tuple(sorted(r)) for r in S.near_words(spark, df, Scratch(spark, "t"), meetings).collect()]
        assert len(got) == len(set(got)) and sorted(got) == want


def test_chains_ties_and_lengths(spark):
    rows = [(0, " ".join(["abcdefg"] * 1)), (1, "abcdefg " * 2 + "abcdefgh " * 40 + "abcdefghi " * 500 + "mmmmmma " * 3 + "mmmmmmc " * 30 + "mmmmmmb " * 30 + "ÀÀÀÀÀÀÀ " * 3 + "ààààààà " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(spark, docs)
    assert got == truth(rows)
    by = {r[0]: r for r in got}
    assert by["mmmmmma"][1] == "mmmmmmb" and by["ÀÀÀÀÀÀÀ"][4] == 0


def test_hard_texts_nulls_and_clashing_columns(spark):
    texts = [*hard_texts(), "x" * 5000, "wordwords " * 30_000, "wordword " * 5]
    docs = documents(spark, texts, extra=True).withColumn("word", F.lit(1)).withColumn("run", F.lit(1)).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(spark, docs.unionAll(docs)) == truth(rows * 2)
    assert found(spark, docs.limit(0)) == []
