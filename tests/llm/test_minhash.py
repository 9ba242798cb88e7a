import random

import pytest

from neighborflow.llm import minhash as M

from .corpora import documents, hard_texts, prose


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = prose(rng, 1) + str(rng.randint(0, 99))
    return " ".join(w)


def truth(texts, p):
    """Components by comparing all pairs."""
    sets, parent = [M.shingles(t or "", p.k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and p.denominator * same >= p.numerator * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_all_pairs(spark, k):
    rng = random.Random(k)
    texts = [prose(rng, rng.randint(5, 150)) for _ in range(60)]
    texts += [edited(rng, texts[rng.randrange(60)], s) for s in (0.01, 0.03, 0.05, 0.08, 0.1, 0.15) for _ in range(15)]
    base = prose(rng, 90)  # a family whose members lie about the threshold from each other
    texts += [edited(rng, base, 0.04 if k == 2 else 0.015) for _ in range(70)] + hard_texts()
    rng.shuffle(texts)
    p = M.MinHashParams(k=k, block=16)
    got = {r["doc_id"]: r for r in M.near_duplicates(spark, documents(spark, texts, extra=True), p).collect()}
    comp, sizes = truth(texts, p)
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_words_and_short_texts():
    assert M.words("AÉ b c\tD\x0be") == ["aÉ".encode(), "b c".encode(), b"d", b"e"]
    assert M.shingles("One", 2) == {(b"one",)} and M.shingles(" \n", 2) == set() and M.shingles("a b a b", 2) == {(b"a", b"b"), (b"b", b"a")}
    h = M.Hasher(M.MinHashParams(k=2))
    for t in ("one", "", "a b a b", "x y z " * 300_000):
        assert len(h.sets([M.words(t)])[0]) == len(M.shingles(t, 2))


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert M.near_duplicates(spark, documents(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in M.near_duplicates(spark, df).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (4, 4, True)], key=str)


def test_bounds_keep_what_reaches_the_threshold():
    p = M.MinHashParams()
    assert [n for n, _ in p.fewest()] == [25, 50, 75, 100, 125, 150]
    rng = random.Random(9)
    lost = 0
    for _ in range(3000):
        hits = [rng.random() < 0.8 for _ in range(150)]
        lost += any(sum(hits[:n]) < m for n, m in p.fewest())
    assert lost <= 3


def test_components_of_long_chains(spark):
    """A chain under random ids takes few rounds; a star, a sorted chain and a pair come out too."""
    from neighborflow.llm.common import Scratch

    rng = random.Random(4)
    ids = rng.sample(range(1_000_000), 10_000)
    chain = list(zip(ids, ids[1:]))
    star = [(2_000_000, 2_000_000 + i) for i in range(1, 3000)]
    row = [(3_000_000 + i, 3_000_001 + i) for i in range(2000)]
    links = spark.createDataFrame([*chain, *star, *row, (7_000_001, 7_000_000), (8, 8)], "a long, b long")
    rounds = []

    class Counted(Scratch):
        def save(self, df, name):
            rounds.extend([name] * ("move" in name))
            return super().save(df, name)

    got = {r["node"]: r["comp"] for r in M.components(links, Counted(spark, "chain"), "c").collect()}
    want = {i: min(ids) for i in ids} | {2_000_000 + i: 2_000_000 for i in range(3000)} | {3_000_000 + i: 3_000_000 for i in range(2001)} | {7_000_000: 7_000_000, 7_000_001: 7_000_000}
    assert got == want and len(rounds) <= 20, len(rounds)


def test_hot_keys_are_dealt(spark, monkeypatch):
    """Buckets, centres and groups of copies far over the bound of a task give the same components."""
    monkeypatch.setattr(M, "SPREAD", 7)
    monkeypatch.setattr(M, "FEW", 3)
    rng = random.Random(11)
    base = prose(rng, 60)
    texts = [base] * 40 + [edited(rng, base, 0.02) for _ in range(60)] + [prose(rng, 30) for _ in range(20)]
    p = M.MinHashParams(k=2, block=16)
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark, documents(spark, texts), p).collect()}
    assert [got[i] for i in range(len(texts))] == truth(texts, p)[0]
