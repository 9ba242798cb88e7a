import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neighborflow.llm import quality, toxicity

from .corpora import documents, hard_texts, prose

BAD = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def corpus():
    """Texts, quality labels, toxic labels."""
    rng, texts, q, t = random.Random(1), [], [], []
    for i in range(600):
        w = prose(rng, rng.randint(20, 120)).split()
        toxic, poor = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if poor:
            w = [x + "***" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        texts.append(" ".join(w))
        q.append(int(not poor))
        t.append(int(toxic))
    return texts, q, t


def frames(spark, corpus):
    texts, q, t = corpus
    labels = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(q, t, strict=True))], "doc_id long, quality int, toxic int")
    return documents(spark, texts, extra=True), labels


def test_toxicity_held_out(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = toxicity.score(docs, model).toPandas().set_index("doc_id")["score"]
    held = [i for i in range(600) if i % 3 == 0]
    assert np.mean([(got[i] >= 0.5) == corpus[2][i] for i in held]) > 0.97
    hidden = ["th1s 1s an 1d10t ing", "or i d i o t and m o r o n at", "ioioi idiiiiot mooooron on", "m.o.r.o.n and s-c-u-m", "5cum or 1diot"]
    scores = model.score(model.evidence(hidden))
    assert (scores >= 0.5).all(), scores
    assert (model.score(model.evidence(["an on th", "1234 5678", "a b c d e", "$$$ ***"])) < 0.5).all()
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == (got < 0.5).sum()


def test_toxicity_hard_texts(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = toxicity.fit(docs, labels, F.lit(True))
    hard = hard_texts()
    got = toxicity.score(documents(spark, hard, extra=True), model).toPandas().set_index("doc_id")["score"]
    assert len(got) == len(hard) and got.between(0, 1).all() and got[3] == got[4] and got[5] == got[6] and got[0] == got[1]
    assert toxicity.keep(documents(spark, hard), model).count() == len(hard)
    assert toxicity.score(documents(spark, []), model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] == 0.0


def test_letters_of_any_script(spark, corpus):
    """Hidden words count in whatever letters they are written."""
    bad = {"idiot": "дурень", "moron": "głąbøł", "scum": "βλάκας"}
    texts = [" ".join(bad.get(w, w) for w in t.split()) for t in corpus[0]]
    docs, labels = frames(spark, (texts, *corpus[1:]))
    model = toxicity.fit(docs, labels, F.lit(True))
    hidden = ["an д.у.р.е.н.ь on", "an дуреееень on", "th głą.bøł ing", "th gggłąbøł ing", "re βλά-κας st", "re β λ ά κ α ς st"]
    scores = model.score(model.evidence(hidden))
    assert (scores >= 0.5).all(), scores
    assert toxicity.decode("щ.ж", model.chars).replace(" ", "") == "щж"  # letters never seen stand for themselves
    assert (model.score(model.evidence(["ан.он ррррин", "щ.ж.щ æ.œ"])) < 0.5).all()


def test_lattice_against_all_paths(spark, corpus):
    """The decoder's path is the best of every way to read the span."""
    model = toxicity.fit_chars(documents(spark, corpus[0]))

    def best(span):
        units = [(m[1], len(m[0])) for m in toxicity._UNIT.finditer(span)]
        paths = [("", 0.0)]
        for c, n in units:
            paths = [(s + e, w + x) for s, w in paths for e, x in toxicity._options(c, n)]
        def weigh(s, w):
            a = b = 0
            for ch in s:
                c = toxicity._CODE[ch]
                if c == 0 and b == 0:
                    continue
                w += model.rows[a][b][c]
                a, b = (0, 0) if c == 0 else (b, c)
            return w + (model.rows[a][b][0] if b else 0.0)
        return max(weigh(s, w) for s, w in paths), {s for s, w in paths if abs(weigh(s, w) - max(weigh(p, q) for p, q in paths)) < 1e-6}

    for span in ("1d10t", "m0r.on", "s c u m", "aaan", "th1ing"):
        _, winners = best(span)
        assert {"".join(w.split()) for w in winners} & {"".join(toxicity.decode(span, model).split())}


def test_doubles_have_a_closed_form(spark, corpus):
    """For words of letters with doubles the short way is the lattice's best path, less the entry fee."""
    model = toxicity.fit_chars(documents(spark, corpus[0]))
    restorer, rng = toxicity.Restorer(model), random.Random(6)
    rows = model.rows

    def weigh(w):
        a = b = 0
        total = 0.0
        for ch in w:
            total += rows[a][b][ord(ch)]
            a, b = b, ord(ch)
        return total + rows[a][b][0]

    for _ in range(300):
        w = "".join(rng.choice("anerthig") * rng.choice([1, 1, 2]) for _ in range(rng.randint(1, 7)))
        if toxicity._RUN.search(w) or not toxicity._DOUBLE.search(w):
            continue
        paths = [("", 0)]
        for m in toxicity._UNIT.finditer(w):
            paths = [(p + m[1] * k, n + (k < len(m[0]))) for p, n in paths for k in range(1, len(m[0]) + 1)]
        value = lambda p, n: weigh(p) + n * toxicity.SHORTER + (toxicity.ENTRY if n else 0.0)
        assert abs(max(value(*x) for x in paths) - max(value(p, n) for p, n in paths if p == restorer.word(w)[0])) < 1e-6, w


def test_words_of_other_scripts_stay(spark, corpus):
    model = toxicity.fit_chars(documents(spark, corpus[0]))
    words = toxicity.Restorer(model).words
    for w in ("привет", "żółćłka", "дурааак", "привет1", "ооо", "zażółć", "βλάκας", "æble", "日本語"):
        assert w.strip("1") in words(f"an {w} th"), (w, words(w))


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_disguised_words_are_found(spark):
    """Of the held-out toxic documents found in plain writing, at least nine in ten are found in each disguise."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, labels, fold != 0)
    texts = [r["text"] or "" for r in docs.join(labels.where((fold == 0) & (F.col("toxic") == 1)), "doc_id").select("text").collect()]
    plain = model.score(model.evidence(texts)) >= 0.5
    assert plain.mean() >= 0.85
    digits, marks, rng = str.maketrans("oieastbl", "01345781"), str.maketrans("asi", "@$!"), random.Random(3)
    toxic = lambda w: model.weigh(w.strip(".,").lower()) > 0
    hide = {
        "some digits": lambda w: "".join(c.translate(digits) if rng.random() < 0.5 else c for c in w),
        "marks": lambda w: w.translate(marks),
        "spaces": " ".join,
        "dots": ".".join,
        "long": lambda w: "".join(c * 3 if c in "aeiou" else c for c in w),
        "doubled": lambda w: "".join(c * 2 for c in w),
    }
    for name, f in hide.items():
        found = model.score(model.evidence([" ".join(f(w) if toxic(w) else w for w in t.split()) for t in texts])) >= 0.5
        assert found[plain].mean() >= 0.9, (name, found[plain].mean())
    clean = [r["text"] or "" for r in docs.join(labels.where((fold == 0) & (F.col("toxic") == 0)), "doc_id").select("text").collect()]
    assert (model.score(model.evidence(clean)) >= 0.5).mean() <= 0.02


def test_trigram_counts_do_not_depend_on_cuts():
    text = "the thing and " * 400_000
    cells, n = toxicity.trigram_cells([text])
    short, m = toxicity.trigram_cells(["the thing and "] * 10)
    assert set(cells) >= set(short) and n.sum() == pytest.approx(m.sum() * 40_000, rel=1e-3)
    assert len(toxicity.trigram_cells([])[0]) == 0


def test_quality_held_out(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = quality.score(docs, model).toPandas().set_index("doc_id")["score"]
    held = [i for i in range(600) if i % 3 == 0]
    assert np.mean([(got[i] >= 0.7) == corpus[1][i] for i in held]) > 0.97
    assert quality.keep(docs, model).count() == (got >= 0.7).sum()


def test_quality_hard_texts(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = quality.fit(docs, labels, F.lit(True))
    hard = hard_texts()
    got = quality.score(documents(spark, hard, extra=True), model).toPandas().set_index("doc_id")["score"]
    assert len(got) == len(hard) and got.between(0, 1).all() and got[3] == got[4] and got[5] == got[6] and got[0] == got[1]
    assert quality.score(documents(spark, []), model).count() == 0
    one = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert quality.score(docs, one).agg(F.min("score")).first()[0] == 1.0
    nothing = quality.fit(docs, labels.limit(0), F.lit(True))
    assert quality.score(docs, nothing).agg(F.min("score")).first()[0] == 1.0


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = quality.Network(x[:3000], y[:3000])
    s = net.score(x[3000:])
    for lo, hi in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        at = (s >= lo) & (s < hi)
        assert abs(s[at].mean() - y[3000:][at].mean()) < 0.1
    assert isinstance(pd.Series(s), pd.Series)


def test_vectors_and_pooling_against_brute_force(spark, monkeypatch):
    """Neighbours' sums, pooled vectors and scores, recomputed word by word."""
    monkeypatch.setattr(quality, "TOKENS", 50)  # long texts are added up in parts
    rng = random.Random(8)
    texts = [prose(rng, n) + rng.choice(["", " X9!! ***", " Don't, \"stop\" -- now..."]) for n in (0, 1, 2, 3, 40, 400, 30)] + [None, "a a a", "12 34"]
    pooler = quality.fit_vectors(documents(spark, texts, extra=True))

    def vector(name):
        v = np.zeros(quality.DIM)
        for p, s in zip(*(x[0] for x in quality.entries([name])), strict=True):
            v[p] += s
        return v

    sums = np.zeros((quality.SLOTS, quality.DIM))
    for t in texts:
        cores = [quality.core_of(w) for w in (t or "").split()]
        for i, c in enumerate(cores):
            for j in range(max(0, i - 2), min(len(cores), i + 3)):
                if j != i and c and cores[j]:
                    sums[quality.slot(c)] += vector(cores[j])
    near = np.stack([v / max(np.linalg.norm(v), 1e-9) * quality.NEAR * quality.NONZERO**0.5 for v in sums])
    assert np.allclose(pooler.near, near, atol=1e-5)
    for t in texts:
        words = (t or "").split()
        parts = [[], []]
        for u in (u for w in words for u in quality.units(w)):
            parts[u.startswith("~")].append(vector(u) + (0 if u.startswith("~") else near[quality.slot(u)]))
        own = [vector(u) for u in quality.whole_units(t or "", words)]
        want = np.concatenate([np.mean(p, 0) if p else np.zeros(quality.DIM) for p in (*parts, own)])
        assert np.allclose(pooler.pool(t or ""), want, atol=1e-4)
    x = np.stack([pooler.pool(t or "") for t in texts]).astype(float)
    net = quality.Network(np.tile(x, (6, 1)), np.tile(np.arange(len(texts)) % 2, 6).astype(float))
    for row, got in zip(x, net.score(x), strict=True):
        hidden = np.tanh(((row - net.mean) / net.scale) @ net.p[0] + net.p[1])
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip((hidden @ net.p[2] + net.p[3][0]) / net.temperature, -30, 30))), abs=1e-9)


def test_quality_keeps_hard_texts(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = quality.fit(docs, labels, F.lit(True))
    hard = documents(spark, hard_texts(), extra=True)
    scores = {r["doc_id"]: r["score"] for r in quality.score(hard, model).collect()}
    kept = quality.keep(hard, model)
    assert kept.columns == hard.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}


def test_cores_are_hashed_once(monkeypatch):
    """Over many flushes each core's entries are hashed once, and sums are those of every pair of neighbours."""
    rng, hashed, entries = random.Random(4), [], quality.entries
    texts = [(prose(rng, 30) + " -- A-b (c1)").split() for _ in range(40)]
    monkeypatch.setattr(quality, "TOKENS", 60)
    monkeypatch.setattr(quality, "entries", lambda names: hashed.extend(names) or entries(names))
    near = quality.Neighbours()
    for words in texts:
        near.add(words)
    near.flush()
    assert len(hashed) == len(set(hashed))
    want = np.zeros((quality.SLOTS, quality.DIM))
    for words in texts:
        cores = [quality.core_of(w) for w in words]
        for i, a in enumerate(cores):
            for b in cores[max(0, i - quality.WINDOW) : i] + cores[i + 1 : i + 1 + quality.WINDOW]:
                if a and b:
                    want[quality.slot(a)] += quality.index_vectors([b])[0]
    assert (near.sums.reshape(want.shape) == want).all()


def test_pooled_vectors_are_means_of_units(monkeypatch):
    """Whatever a task remembers: after a reset, and for words of marks only, the means are those over all units."""
    monkeypatch.setattr(quality, "ROOM", 20)
    pooler = quality.Pooler(np.random.default_rng(2).normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32))
    rng = random.Random(8)
    for text in [prose(rng, 25) + " (The-end)! THE iPad 12 b2 a_b -- ...", "-- ...", "", *[prose(rng, 20) for _ in range(5)]]:
        got, units = pooler.pool(text), [u for w in text.split() for u in quality.units(w)]
        for part, mine in ((0, [u for u in units if u[0] != "~"]), (1, [u for u in units if u[0] == "~"])):
            want = pooler.vectors_of(mine).mean(0) if mine else np.zeros(quality.DIM)
            assert np.allclose(got[part * quality.DIM : (part + 1) * quality.DIM], want, atol=1e-5)


def test_no_vector_is_kept_for_a_core():
    """Cores are kept as entries and slots, vectors only for shapes and marks; what was learnt before changes no bit."""
    near = np.random.default_rng(2).normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    text = " ".join(f"w{chr(97 + i % 26)}{'bcdfg'[i % 5]}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" + (",", "", "!")[i % 3] for i in range(6000)) + " -- (x)"
    pooler, fresh = quality.Pooler(near), quality.Pooler(near)
    pooler.pool("One \"more\" text, that comes first! iPad 12 ...")
    assert pooler.pool(text).tobytes() == fresh.pool(text).tobytes()
    assert len(fresh.known) > 5000 and len(fresh.vectors) <= 1024


def test_one_mark_at_the_end_as_by_the_pattern():
    for word in ["end.", "end_", "a1,", "ab-", "don't", "x'", "É!", "²)", "a²", "é", "ab́", ".", "..", "_", "a.b", "a..", "12%", "ß‍"]:
        m = quality._CORE.search(word)
        assert quality.core_of(word) == (m[0].lower() if m else "")
        after = word[m.end() :] if m else ""
        marks = ([f"~before {word[: m.start()]}"] if m and m.start() else []) + (["~broken" if quality._CORE.search(after) else f"~after {after}"] if after else [])
        assert quality.units(word) == ((m[0].lower(), quality.shape(m[0]), *marks) if m else (f"~only {word}",))
