"""Toxicity by noisy-channel deobfuscation: Viterbi over character lattices, then a score of the restored text.

A character trigram model is counted over the whole corpus, for all letters of any script that it holds. Every word is a
lattice: each run of one observed character may stand for itself, for the letters it looks like, for fewer copies, for
nothing or for a word boundary, each at a channel cost. The best path under the model is the restored text. Where a word
shows no sign of disguise but doubled letters, taking one back costs an entry fee, so plain words survive by themselves;
for such words the best path has a closed form, as taking back a double changes two terms of the model only, and a word
without doubled letters has the one path. Single characters and pairs kept apart by spaces are decoded as rows. Evidence
is learned from labelled rows: words and word beginnings of the restored texts, weighted by the lower bound of their log
odds where chance is ruled out for all features that could pass, then a logistic curve over a document's summed evidence.

Defined results: null and empty texts hold no evidence and get the curve's lowest score; equal texts get equal scores;
without labels of both kinds every score is 0.0 and nothing is rejected; labels of one document that disagree count as
toxic; a null label counts as none; of equally good paths the first in the order of the options wins, of equally good
evidence the larger weight counts once; repeated rows are scored each; an empty table gives an empty one; extra columns
are ignored. Plain numbers are no words. Texts are used whole at any length.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborflow.llm.common import Scratch, id_text

#: Bound of the labelled sample that the evidence is fitted on.
SAMPLE_ROWS = 10_000
BEGINNINGS = (4, 5, 6, 7, 8)
#: The letters that a character can be written for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Log costs of the channel: a look-alike, a shorter run, a dropped mark, a mark taken as a boundary, a look-alike that
#: stands for nothing or a boundary, and the first double taken back in a word without other signs.
LOOK, SHORTER, DROPPED, BOUNDARY, NO_LETTER, ENTRY = -1.2, -0.7, -0.5, -1.0, -7.0, -4.0


class _Codes(dict):
    """The number of a letter is its code point, that of a boundary 0."""

    def __missing__(self, char: str) -> int:
        return ord(char)


_CODE = _Codes({" ": 0})
#: A cell is three numbers of BITS bits.
BITS = 21
_LOW = (1 << BITS) - 1
_OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$") + "¡¿«»“”’"
_LEFT = _OUTER.replace("!", "").replace("|", "")
_RUN = re.compile(r"(.)\1{2,}")
_UNIT = re.compile(r"(.)\1*", re.S)
_DOUBLE = re.compile(r"(.)\1", re.S)
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_EDGE = re.compile(r"^([@$])\1{2,}|([@$])\2{2,}$")
_BLOCK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point the number of its letter in lower case, or 0."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for i in range(len(out)):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def _summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and their counts' sums."""
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def trigram_cells(texts) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero cells and counts of (before, before, letter); anything but a letter is a boundary, code 0."""
    lut, place, names = _letters(), np.full(sys.maxunicode + 1, -1, np.int32), np.zeros(1, np.int64)
    place[0] = 0
    cells, counts = [], []

    def add(joined: str) -> None:
        nonlocal names, cells, counts
        code = lut[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = place[code]
        if len(new := np.unique(code[c < 0])):
            place[new] = len(names) + np.arange(len(new))
            names = np.concatenate([names, new])
            c = place[code]
        k, c = len(names), c.astype(np.int64)
        a, b, c = c[:-2].copy(), c[1:-1], c[2:]
        a[b == 0] = 0
        cell = ((a * k + b) * k + c)[(b != 0) | (c != 0)]
        if k**3 <= 4 * _BLOCK:
            n = np.bincount(cell, minlength=k**3)
            local = np.flatnonzero(n)
            n = n[local]
        else:
            local, n = np.unique(cell, return_counts=True)
        cells.append((names[local // (k * k)] << 2 * BITS) | (names[local // k % k] << BITS) | names[local % k])
        counts.append(n)
        if len(cells) > 1 and sum(map(len, cells)) > max(_BLOCK, 2 * len(cells[0])):
            got = _summed(cells, counts)
            cells, counts = [got[0]], [got[1]]

    held, size = [], 0
    for t in texts:
        for at in range(0, len(t), _BLOCK):  # a cut inside a long text starts two characters early
            held.append(f"  {t[:_BLOCK]} " if at == 0 else f"{t[at - 2 : at + _BLOCK]} ")
            size += len(held[-1])
            if size > _BLOCK:
                add("".join(held))
                held, size = [], 0
    if held:
        add("".join(held))
    return _summed(cells, counts)


class _Row(dict):
    """Log probabilities of the letters after two others; letters never seen there back off."""

    def __init__(self, seen: dict, unseen):
        super().__init__(seen)
        self.unseen = unseen

    def __missing__(self, c: int) -> float:
        got = self[c] = self.unseen(c)
        return got


class _Lazy(dict):
    """Made entry by entry as they are asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, k: int):
        got = self[k] = self.make(k)
        return got


class CharModel:
    """Interpolated log probabilities from sparse trigram counts. A letter never seen counts as one seen once, so that
    every letter has a probability."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        order = np.argsort(cells)
        self.cells, self.counts = cells[order], counts[order]
        self.pairs, n2 = _summed([self.cells & ((1 << 2 * BITS) - 1)], [self.counts])
        letters, n1 = _summed([self.cells & _LOW], [self.counts])
        total = n1.sum() + len(letters) + 1
        self.p1 = _Row(dict(zip(letters.tolist(), ((n1 + 1) / total).tolist(), strict=True)), lambda c: 1 / total)
        self.n2 = n2
        self.p2 = _Lazy(self._after_one)
        self.rows = _Lazy(lambda a: _Lazy(lambda b: self._after_two(a, b)))

    def __reduce__(self):
        return CharModel, (self.cells, self.counts)

    @staticmethod
    def _after(keys: np.ndarray, counts: np.ndarray, before: int) -> dict[int, int]:
        at, end = np.searchsorted(keys, [before << BITS, (before + 1) << BITS])
        return dict(zip((keys[at:end] & _LOW).tolist(), counts[at:end].tolist(), strict=True))

    def _after_one(self, b: int) -> _Row:
        seen, p1 = self._after(self.pairs, self.n2, b), self.p1
        of = sum(seen.values()) + 5
        return _Row({c: (n + 5 * p1[c]) / of for c, n in seen.items()}, lambda c: 5 * p1[c] / of)

    def _after_two(self, a: int, b: int) -> _Row:
        seen, p2 = self._after(self.cells, self.counts, (a << BITS) | b), self.p2[b]
        of = sum(seen.values()) + 5
        return _Row({c: math.log((n + 5 * p2[c]) / of) for c, n in seen.items()}, lambda c: math.log(5 * p2[c] / of))


def fit_chars(docs: DataFrame) -> CharModel:
    """The model from every text; what reaches the driver is one row for each distinct trigram of letters."""

    def count(batches):
        def texts():
            for pdf in filter(len, batches):
                yield from pdf["text"]

        cells, n = trigram_cells(texts())
        yield pd.DataFrame({"cell": cells, "n": n})

    got = id_text(docs).select("text").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    return CharModel(got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def _options(char: str, run: int) -> list[tuple[str, float]]:
    """What a run of one observed character may stand for, with the channel's log cost."""
    out = []
    letters = [(char, 0.0)] if char.isalpha() else []
    letters += [(c, LOOK) for c in LOOKS_LIKE.get(char, "")]
    for c, cost in letters:
        if c == char or run <= 2:
            out.append((c * run, cost))
        if run > 1:
            out.append((c, cost + SHORTER))
        if run > 2:
            out.append((c * 2, cost + SHORTER))
    if not letters:
        out += [("", DROPPED), (" ", BOUNDARY)]
    elif not char.isalpha():  # it looks like a letter, so that it means none is less likely
        out += [("", NO_LETTER), (" ", NO_LETTER)]
    return out


def decode(span: str, model: CharModel) -> str:
    """The best path of the lattice of a lower-case span."""
    rows = model.rows
    best = {(0, 0): (0.0, None)}
    for m in _UNIT.finditer(span):
        options = _options(m[1], len(m[0]))
        nxt: dict = {}
        for (a, b), (score, back) in best.items():
            for emit, cost in options:
                x, y, s = a, b, score + cost
                for ch in emit:
                    c = _CODE[ch]
                    if c == 0 and y == 0:
                        continue
                    s += rows[x][y][c]
                    x, y = (0, 0) if c == 0 else (y, c)
                if (old := nxt.get((x, y))) is None or s > old[0]:
                    nxt[(x, y)] = (s, (back, emit))
        best = nxt
    back = max(((s + (rows[a][b][0] if b else 0.0), p) for (a, b), (s, p) in best.items()), key=lambda t: t[0])[1]
    out = []
    while back:
        back, emit = back
        out.append(emit)
    return "".join(reversed(out))


class Restorer:
    """Words of a text after deobfuscation. known: a bounded memory of words already restored."""

    ROOM = 120_000

    def __init__(self, model: CharModel):
        self.model, self.known, self.gains = model, {}, {}

    def gain(self, x: int, y: int, z: int) -> float:
        """What a path gains if of two letters y between x and z one is taken back."""
        got = self.gains.get((x, y, z))
        if got is None:
            rows = self.model.rows
            got = self.gains[(x, y, z)] = SHORTER + rows[x][y][z] - rows[x][y][y] - rows[y][y][z]
        return got

    def undouble(self, core: str) -> str:
        """The best path of a word of letters with runs of at most two."""
        total, out, at = ENTRY, [], 0
        for m in _DOUBLE.finditer(core):
            i, j = m.span()
            gain = self.gain(_CODE[core[i - 1]] if i else 0, _CODE[m[1]], _CODE[core[j]] if j < len(core) else 0)
            if gain > 0:
                total += gain
                out.append(core[at : i + 1])
                at = j
        return "".join([*out, core[at:]]) if total > 0 else core

    def word(self, w: str) -> tuple[str, ...]:
        core = _EDGE.sub("", w.lstrip(_LEFT).rstrip(_OUTER)).lstrip(_LEFT).rstrip(_OUTER)
        if core.isalpha():
            if not _DOUBLE.search(core):
                return (core,)
            if not _RUN.search(core):
                return (self.undouble(core),)
            return (*decode(core, self.model).split(), core)  # the word as written is a reading too
        if core.isdigit() or not any(c.isalpha() or c in LOOKS_LIKE for c in core):
            return ()
        return (*decode(core, self.model).split(), *_LETTERS.findall(core))

    def spaced(self, words: list[str]) -> list[str]:
        """What rows of single characters and pairs spell: at least two single ones, or one in a row of three or more."""
        out, run, single = [], [], 0
        for w in [*words, "   "]:
            if len(w) <= 2 and (w.isalpha() or all(c.isalpha() or c in LOOKS_LIKE for c in w)):
                run.append(w)
                single += len(w) == 1
                continue
            if single > 1 or single and len(run) > 2:
                row = " ".join(run)
                if (got := self.known.get(row)) is None:
                    got = self.known[row] = tuple(decode(row, self.model).split()) if any(x.isalpha() for x in row) else ()
                out += got
            if run:
                run, single = [], 0
        return out

    def words(self, text: str) -> set[str]:
        raw = text.lower().split()
        known, found = self.known, set()
        if len(known) > self.ROOM:
            known.clear()
        single = False
        for w in set(raw):
            got = known.get(w)
            if got is None:
                got = known[w] = self.word(w)
            found.update(got)
            single = single or len(w) == 1
        if single:
            found.update(self.spaced(raw))
        return found


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


class ToxicityModel:
    """Evidence of words and word beginnings, and the curve from a document's evidence to its score."""

    def __init__(self, chars: CharModel, lexicon: dict[str, float], curve=(0.0, 0.0, 0.0), fitted: bool = True):
        self.chars, self.lexicon, self.curve, self.fitted = chars, lexicon, np.array(curve), fitted

    def weigh(self, word: str) -> float:
        lex = self.lexicon
        return max([lex.get(word, 0.0), *(lex.get(f"{word[:n]}*", 0.0) for n in BEGINNINGS if len(word) >= n)])

    def evidence(self, texts) -> np.ndarray:
        """Per text, over its distinct restored words: the sum of their weights and how many have one, as logs."""
        restorer, lex, known = Restorer(self.chars), self.lexicon, {}
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            total, hits = 0.0, 0
            if len(known) > Restorer.ROOM:
                known.clear()
            for w in restorer.words(t):
                v = known.get(w)
                if v is None:
                    v = known[w] = self.weigh(w) if lex else 0.0
                if v:
                    total, hits = total + v, hits + 1
            out[i] = total, hits
        return np.log1p(out)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve[:2] + self.curve[2], -40, 40))) if self.fitted else np.zeros(len(evidence))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled documents, chosen by a hash of doc_id alone."""
    one = labels.where(keep & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_text(docs).join(F.broadcast(chosen), "doc_id")  # at most `rows` pairs of numbers


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset by Newton steps with a small penalty."""
    z = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(z.shape[1]), np.array([0.1] * x.shape[1] + [1e-4])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * beta)
        beta = beta - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _least_surprise(sizes: dict[int, int], rate: float) -> float:
    """The surprise that rules out chance: sizes says how many features occur in n documents. Only features that could
    reach it at all count as tries, so rare ones do not raise the bar for the others."""
    most = {n: -n * math.log(rate) for n in sizes}
    for bar in sorted(most.values()):
        if bar >= math.log(sum(sizes[n] for n in sizes if most[n] >= bar)) + 2:
            return max(bar - math.log(1 / rate), math.log(sum(sizes[n] for n in sizes if most[n] >= bar)) + 2)
    return math.inf


def fit(docs: DataFrame, labels: DataFrame, keep, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Character counts from all texts; evidence and curve from the labelled sample that ``keep`` admits, which is
    written once."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(labelled_sample(docs, labels, "toxic", keep, rows), "sample")
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    chars = fit_chars(docs)
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        scratch.drop()
        return ToxicityModel(chars, {}, fitted=False)

    def count(batches):
        restorer, seen = Restorer(chars), (Counter(), Counter())
        for pdf in filter(len, batches):
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                seen[y].update({f for w in restorer.words(text) for f in features(w)})
        both = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"feature": both, "c": [seen[0][f] for f in both], "t": [seen[1][f] for f in both]}).astype({"feature": object, "c": "int64", "t": "int64"})

    counts = scratch.save(sample.mapInPandas(count, "feature string, c long, t long").groupBy("feature").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "counts")
    rate = n1 / (n0 + n1)
    sizes = {r["n"]: r["many"] for r in counts.groupBy((F.col("c") + F.col("t")).alias("n")).agg(F.count("*").alias("many")).collect()}  # at most a row for each sampled document
    c, t = F.col("c"), F.col("t")
    q, odds = t / (t + c), F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    low = odds - 1.3 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    surprise = (t + c) * (q * F.log(q / rate) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - rate))).otherwise(0.0))
    sure = counts.where(t > c).select("feature", t, low.alias("low"), surprise.alias("surprise")).where((F.col("low") > 0.8) & (F.col("surprise") >= _least_surprise(sizes, rate)))
    # A beginning that one word accounts for would only add what that word does not mean.
    words = counts.where(~F.col("feature").endswith("*") & (t > c)).select("t", F.explode(F.array(*[F.when(F.length("feature") >= n, F.concat(F.substring("feature", 1, n), F.lit("*"))) for n in BEGINNINGS])).alias("feature"))
    one_word = words.where("feature IS NOT NULL").groupBy("feature").agg(F.max("t").alias("one"))
    got = sure.join(one_word, "feature", "left").where(~F.col("feature").endswith("*") | (F.coalesce("one", F.lit(0)) <= 0.8 * t)).select("feature", "low").toPandas()  # bounded by the sample
    lexicon = dict(zip(got["feature"], got["low"], strict=True))
    model = ToxicityModel(chars, lexicon)

    def add_up(batches):
        for pdf in filter(len, batches):
            e = model.evidence(pdf["text"])
            yield pd.DataFrame({"total": e[:, 0], "hits": e[:, 1], "y": pdf["y"].to_numpy()})

    xy = sample.mapInPandas(add_up, "total double, hits double, y int").toPandas().sort_values(["total", "hits", "y"])
    model.curve = _logistic(xy[["total", "hits"]].to_numpy(), xy["y"].to_numpy(np.float64))
    scratch.drop()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every text."""

    def run(batches):
        for pdf in filter(len, batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(model.evidence(pdf["text"]))})

    return id_text(docs).mapInPandas(run, "doc_id long, score double")


def keep(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole and with all their columns, that score under the threshold."""

    def run(batches):
        for pdf in filter(len, batches):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            if len(out := pdf[model.score(model.evidence(texts)) < threshold]):
                yield out

    return docs.mapInPandas(run, docs.schema)
