import hashlib
import random

import numpy as np
import pytest

from neighborflow.llm import fingerprint as M

from .corpora import documents, hard_texts, prose


def slow_walk(text):
    """The embedding a step at a time: what is written, and where each character is left."""
    code, j, left, out = M.classes(text), 0, [], []
    for c in code:
        while True:
            out.append(c)
            move = M._moves[c, j % M.PERIOD]
            j += 1
            if move:
                break
        left.append(j)
    return out, left


def test_look_ups_walk_as_steps_do():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 20, 400, 3)] + ["", "é🙂"]
    walks = M.walks([M.classes(t) for t in texts], [0] * len(texts))
    for t, w in zip(texts, walks, strict=True):
        written, left = slow_walk(t)
        assert w.tolist() == left
        scale = M.scale_of(len(t))
        got = M.bits(M.classes(t), w, scale)
        steps = (M._FRACTIONS * (1 << scale)).astype(int)
        assert all(b == (M._BITS[scale % 64, written[s], k] if s < len(written) else 0) for k, (s, b) in enumerate(zip(steps, got, strict=True)))


def test_likeness_follows_edits():
    """An edit throws a walk off for a while, now and then for long: most near texts are far likelier than others."""
    rng = random.Random(2)
    near, far, banded = [], [], 0
    for _ in range(40):
        a = prose(rng, 300)
        w = list(a)
        for _ in range(len(w) // 100):
            w[rng.randrange(len(w))] = rng.choice("abcdefg")
        del w[rng.randrange(len(w))]
        f, g, h = M.fingerprints_of([a, "".join(w), prose(rng, 300)])
        assert M.likeness(f, f) == 1.0
        near.append(M.likeness(f, g))
        far.append(M.likeness(f, h))
        banded += bool(set(M.bands(f)) & set(M.bands(g)))
    assert np.median(near) > 0.6 and np.quantile(near, 0.1) > np.median(far) and max(far) < 0.4 and banded >= 36


@pytest.mark.parametrize("ids", [[5, 9, 2, 40, 7, 8, 1, 0, 33, 12, 11, 3], list(range(12)), [7] * 12, [*range(11), None]])
def test_next_documents(spark, ids):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    got = M.edited_likeness(spark, df).collect()
    order = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        m = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - m] + order[(k + 1) % len(order)][1][:m]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    texts_of = {}
    for r in got:
        texts_of.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(texts_of[1]) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_one_and_no_document(spark):
    assert M.edited_likeness(spark, documents(spark, [])).count() == 0
    r = M.edited_likeness(spark, documents(spark, ["abcdef"], extra=True)).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


@pytest.mark.parametrize("spread", [2, 1024])
def test_search_finds_near_texts(spark, spread, monkeypatch):
    monkeypatch.setattr(M, "SPREAD", spread)
    rng = random.Random(4)
    texts = [prose(rng, 200) for _ in range(30)]
    near = [t[:300] + "x" + t[302:] for t in texts[:10]] + texts[:5]
    fp = M.fingerprint_documents(documents(spark, texts + near)).cache()
    pairs, of = M.near_pairs(fp, fp.where("doc_id < 10")).collect(), M.members(fp).collect()
    found = {(r["query"], m["doc_id"]) for r in pairs for m in of if m["rep"] == r["rep"]}
    brute = {(a, b) for a in range(10) for b in range(45) if M.likeness(*M.fingerprints_of([(texts + near)[a], (texts + near)[b]])) >= 0.5}
    assert found == brute and {(i, 30 + i) for i in range(10)} <= found and {(i, 40 + i) for i in range(5)} <= found
    assert np.isclose(M.likeness(*M.fingerprints_of(["", ""])), 1.0)
    copies = M.fingerprint_documents(documents(spark, ["a text of some length, copied"] * 30))
    assert [tuple(r) for r in M.near_pairs(copies, copies).collect()] == [(0, 0, 1.0)] and M.members(copies).count() == 30


EDITS = {
    "first tenth": lambda rng, t: prose(rng, 300)[: len(t) // 10] + t[len(t) // 10 :],
    "first fifth": lambda rng, t: prose(rng, 300)[: len(t) // 5] + t[len(t) // 5 :],
    "first third": lambda rng, t: prose(rng, 300)[: len(t) // 3] + t[len(t) // 3 :],
    "middle": lambda rng, t: t[: len(t) // 3] + prose(rng, 300)[: len(t) // 3] + t[2 * len(t) // 3 :],
    "last third": lambda rng, t: t[: len(t) - len(t) // 3] + prose(rng, 300)[: len(t) // 3],
    "scattered": lambda rng, t: "".join(rng.choice("qzxj") if rng.random() < 0.03 else c for c in t),
    "inserted": lambda rng, t: "".join(c + "zx" * (rng.random() < 0.01) for c in t),
}


@pytest.mark.parametrize("edit", sorted(EDITS))
def test_bands_find_near_texts_wherever_the_edit_is(edit):
    """Of the pairs of likeness 0.5 or more, at least nine in ten share a band."""
    rng, found = random.Random(6), []
    for _ in range(120):
        a = prose(rng, rng.choice([60, 200, 400]))
        f, g = M.fingerprints_of([a, EDITS[edit](rng, a)])
        shared = bool(set(M.bands(f)) & set(M.bands(g)))
        assert shared == M.banded(f, g)
        if M.likeness(f, g) >= 0.5:
            found.append(shared)
    assert len(found) >= 20 and np.mean(found) >= 0.9


def test_other_texts_seldom_share_a_band():
    rng = random.Random(7)
    keys = [set(M.bands(f)) for f in M.fingerprints_of([prose(rng, 200) for _ in range(120)])]
    assert sum(bool(keys[i] & keys[j]) for i in range(120) for j in range(i)) <= 20  # of 7,140


def test_bands_reach_along_the_walk():
    for reached in (1, 70, 300, 1024):
        got = np.unique(M.picks(reached))
        assert got.max() < max(reached, M.REACH) and len(got) > 0.9 * min(reached, M.REACH) * (reached >= M.REACH)
    assert len(np.unique(M.picks(1024))) > 950
