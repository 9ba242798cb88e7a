"""Text quality: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated output.

A raw word counts as several units: its lower-case core, its shape, and the marks around it; a few units of the whole
document (repetition, variety, length) join them. Every unit has a sparse ternary index vector from a hash of its name,
so there is no vocabulary. Random indexing adds to a core the index vectors of its neighbours in all texts of the
corpus: these sums are kept in SLOTS slots by a hash of the core, so what reaches the driver is bounded while all texts
count; cores that share a slot share its sum, and keep index vectors of their own. A document is the mean of its cores'
vectors, that of its shapes and marks, and that of its own units, side by side. A network with one hidden layer is trained
on a bounded sample of labelled documents, and a temperature fitted on a fifth of them that training did not see turns
its output into probabilities.

Defined results: null and empty texts, and those of white space only, have the unit of an empty document and get a score
like any other; equal texts get equal scores; without labels of both kinds every score is the share of label 1 (1.0
without labels); labels of one document that disagree count as low quality; null labels count as none; a score at the
threshold is kept; repeated rows are scored each; an empty table gives an empty one; extra columns are ignored. Texts are
used whole at any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from hashlib import blake2b
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborflow.llm.common import id_text

#: Bound of the labelled sample that the network is fitted on.
SAMPLE_ROWS = 8_000
#: Length of a vector, its entries other than 0, slots of neighbours' sums, words on each side that are neighbours, hidden
#: units, and the weight of the neighbours' part.
DIM, NONZERO, SLOTS, WINDOW, HIDDEN, NEAR = 64, 4, 8192, 2, 32, 0.5
_CORE = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
#: Words that a task remembers, and tokens whose neighbours are added up at once.
ROOM, TOKENS = 200_000, 1 << 18


def shape(core: str) -> str:
    if core.isdigit():
        return "~digits"
    if not core.isalpha():
        return "~mixed"
    if core.islower():
        return "~lower"
    if core.isupper():
        return "~upper" if len(core) > 1 else "~letter"
    return "~title" if core[0].isupper() and core[1:].islower() else "~camel"


def core_of(word: str) -> str:
    """The lower-case core of a raw word, empty if it has none."""
    if word.isalnum():
        return word.lower()
    if (head := word[:-1]).isalnum():  # and one mark
        return head.lower()
    m = _CORE.search(word)
    return m[0].lower() if m else ""


def units(word: str) -> tuple[str, ...]:
    """Core in lower case, shape, and marks of a raw word; what is no core starts with a tilde."""
    if word.isalnum():  # all core
        return (word.lower(), shape(word))
    if (head := word[:-1]).isalnum():  # and one mark
        return (head.lower(), shape(head), f"~after {word[-1]}")
    m = _CORE.search(word)
    if not m:
        return (f"~only {word}",)
    out = [m[0].lower(), shape(m[0])]
    if m.start():
        out.append(f"~before {word[: m.start()]}")
    if m.end() < len(word):
        rest = word[m.end() :]
        out.append("~broken" if _CORE.search(rest) else f"~after {rest}")
    return tuple(out)


def _level(x: float, name: str) -> str:
    return f"~{name} {min(9, int(10 * x))}"


def whole_units(text: str, words: list[str], distinct: int | None = None) -> list[str]:
    """Units of the document: words that repeat the one before, lines seen before, variety, length. distinct: how many
    different words there are, where that is known."""
    n = len(words)
    if not n:
        return ["~empty"]
    again = sum(map(eq, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x]
    twice = 1 - len(set(lines)) / max(1, len(lines))
    return [_level(again, "again"), _level(twice, "lines"), _level((distinct or len(set(words))) / n if n > 20 else 1.0, "variety"), f"~length {n.bit_length()}"]


def encoded(names: list[str]) -> list[bytes]:
    try:
        return list(map(str.encode, names))
    except UnicodeEncodeError:  # lone surrogates
        return [x.encode("utf-8", "surrogatepass") for x in names]


_PLACES = np.arange(NONZERO, dtype=np.uint64) * np.uint64(16)


def entries(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each name's index vector, from a hash of the name. A place may occur twice."""
    h = np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in encoded(names)]), "<u8")
    parts = h[:, None] >> _PLACES
    return (parts % np.uint64(DIM)).astype(np.int64), 1.0 - 2.0 * ((parts >> np.uint64(15)) & np.uint64(1)).astype(np.float32)


def index_vectors(names: list[str]) -> np.ndarray:
    """The sparse ternary vectors of names."""
    out = np.zeros((len(names), DIM), np.float32)
    if names:
        at, sign = entries(names)
        np.add.at(out, (np.arange(len(names))[:, None], at), sign)
    return out


def slots(cores: list[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, encoded(cores)), np.int64, len(cores)) % SLOTS


def slot(core: str) -> int:
    return int(slots([core])[0])


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n rows at least."""
    if n <= len(a):
        return a
    out = np.zeros((2 * n, *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class Known(dict):
    """Numbers of raw words, found out by ``learn`` when a word is first looked up."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> int:
        got = self[word] = self.learn(word)
        return got

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Cores:
    """Numbers of cores from 1, and by number their entries and slot, hashed once each; 0 is no core, with signs of 0 and a
    slot after the last."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}
        self.place, self.sign, self.slot = np.zeros((1024, NONZERO), np.int16), np.zeros((1024, NONZERO), np.float32), np.full(1024, SLOTS, np.int32)
        self.done = 1

    def of(self, word: str) -> int:
        return self.number.setdefault(core_of(word), len(self.number))

    def hash(self) -> None:
        """Entries and slots of the cores that are new."""
        a, n = self.done, len(self.number)
        if a < n:
            fresh = list(islice(reversed(self.number), n - a))[::-1]
            self.place, self.sign, self.slot = _grown(self.place, n), _grown(self.sign, n), _grown(self.slot, n)
            (self.place[a:n], self.sign[a:n]), self.slot[a:n], self.done = entries(fresh), slots(fresh), n


class Neighbours:
    """Sums of the index vectors of the words around each core, by slot. An empty core is no neighbour and has none."""

    def __init__(self):
        self.sums = np.zeros(SLOTS * DIM)
        self.held: list[np.ndarray] = []
        self.size = 0
        self._reset()

    def _reset(self) -> None:
        self.cores = Cores()
        self.known = Known(self.cores.of)

    def add(self, words: list[str]) -> None:
        """One text's words."""
        self.held += [self.known.of(words), np.zeros(WINDOW, np.int64)]
        self.size += len(words)
        if self.size > TOKENS:
            self.flush()

    def flush(self) -> None:
        """Pairs of a slot and a core beside it are counted first, so a pair that comes often is added up once, and slot after
        slot; entries are hashed once a core."""
        if not self.held:
            return
        self.cores.hash()
        s, n, slot = np.concatenate(self.held), len(self.cores.number), self.cores.slot.astype(np.int64)
        for i in range(0, len(s), TOKENS):
            keys = []
            for d in range(1, WINDOW + 1):
                b = s[i + d : i + d + TOKENS]
                a = s[i : i + len(b)]
                ok = (a > 0) & (b > 0)
                a, b = a[ok], b[ok]
                keys += [slot[a] * n + b, slot[b] * n + a]
            keys = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            x, y = np.divmod(keys[first], n)
            times = np.diff(first, append=len(keys)).astype(np.float32)
            self.sums += np.bincount(((x * DIM)[:, None] + self.cores.place[y]).ravel(), (self.cores.sign[y] * times[:, None]).ravel(), SLOTS * DIM)
        self.held, self.size = [], 0
        if len(self.known) > ROOM:
            self._reset()


def near_vectors(sums: np.ndarray) -> np.ndarray:
    """The neighbours' part of vectors by slot: sums scaled to one length."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(length, 1e-9) * (NEAR * NONZERO**0.5)).astype(np.float32)


@lru_cache(maxsize=4096)
def whole_vectors(names: tuple[str, ...]) -> np.ndarray:
    """Index vectors of a document's own units, of which there are few combinations."""
    return index_vectors(list(names))


class Pooler:
    """Documents to pooled vectors. known: a bounded memory of the units of words. A core's vector is made of its entries and
    its slot's row of ``near`` when it is used; shapes and marks have few vectors, which are kept."""

    def __init__(self, near: np.ndarray):
        self.near = near
        self.rows = np.concatenate([near, np.zeros((1, DIM), near.dtype)])  # the last is of words without a core
        self._reset()

    def __reduce__(self):
        return Pooler, (self.near,)

    def _reset(self) -> None:
        self.cores = Cores()
        self.known = Known(self.learn)
        #: Shapes and marks that come together: their number, and by it the sum of their vectors and how many they are.
        self.rest: dict = {}
        self.vectors, self.units = np.zeros((1024, DIM), np.float32), np.zeros(1024, np.float32)
        self.summed = 0

    def vectors_of(self, names: list[str]) -> np.ndarray:
        """Index vectors, and for cores the neighbours' part."""
        out = index_vectors(names)
        core = [i for i, u in enumerate(names) if u[0] != "~"]
        if core:
            out[core] += self.near[slots([names[i] for i in core])]
        return out

    def learn(self, word: str) -> int:
        """The number of the word's core, and in the lower 32 bits that of its shape and marks. Most new words are lower-case
        letters only, and come once, so these take a short way."""
        if word.isalpha():
            core, rest = word.lower(), "~lower" if word.islower() else shape(word)
        elif (u := units(word))[0].startswith("~"):
            core, rest = "", u
        else:
            core, rest = u[0], u[1:]
        number = self.cores.number
        return number.setdefault(core, len(number)) << 32 | self.rest.setdefault(rest, len(self.rest))

    def sum_rest(self) -> None:
        """Vectors of the shapes and marks that are new."""
        a, n = self.summed, len(self.rest)
        if a < n:
            self.vectors, self.units = _grown(self.vectors, n), _grown(self.units, n)
            for i, x in enumerate(list(islice(reversed(self.rest), n - a))[::-1], a):
                each = [x] if isinstance(x, str) else list(x)
                self.vectors[i], self.units[i] = index_vectors(each).sum(0), len(each)
            self.summed = n

    def pool(self, text: str) -> np.ndarray:
        """Means over the words' cores, over their shapes and marks, and over the document's own units, side by side."""
        words = text.split()
        if len(self.known) > ROOM:
            self._reset()
        distinct = Counter(words)
        out = np.zeros(3 * DIM, np.float32)
        if distinct:
            k, n = self.known.of(distinct), np.fromiter(distinct.values(), np.float32, len(distinct))
            self.cores.hash()
            self.sum_rest()
            core, rest = k >> 32, k & 0xFFFFFFFF
            if total := n @ (core > 0):
                own = np.bincount(self.cores.place[core].ravel(), (self.cores.sign[core] * n[:, None]).ravel(), DIM)
                out[:DIM] = own / total + (n / total) @ self.rows[self.cores.slot[core]]
            times = np.bincount(rest, n)  # whole numbers, as are the vectors: sums do not depend on what was learnt before
            met = np.flatnonzero(times)
            if total := times[met] @ self.units[met]:
                out[DIM : 2 * DIM] = times[met] @ self.vectors[met] / total
        out[2 * DIM :] = whole_vectors(tuple(whole_units(text, words, len(distinct)))).mean(0)
        return out

    def matrix(self, texts) -> np.ndarray:
        return np.stack([self.pool(t) for t in texts]) if len(texts) else np.zeros((0, 3 * DIM), np.float32)


class Network:
    """Two layers, tanh then a sigmoid with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 600, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        held = np.arange(len(x)) % 5 == 4
        if not (0 < y[held].sum() < held.sum()):
            held[:] = False
        tx, ty = x[~held], y[~held]
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, steps + 1):
            take = rng.choice(len(tx), min(512, len(tx)), replace=False)
            bx, by = tx[take], ty[take]
            h = np.tanh(bx @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - by) / len(by)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads = [bx.T @ dh + 1e-3 * p[0], dh.sum(0), h.T @ d + 1e-3 * p[2], d.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z, t = self._logit((x if not held.any() else x[held])), y if not held.any() else y[held]
        loss = lambda temp: float(np.mean(np.logaddexp(0, z / temp) - t * z / temp))
        self.temperature = min(np.exp(np.linspace(-1.5, 2.5, 161)), key=loss)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def labelled(docs: DataFrame, labels: DataFrame, keep, rows: int) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled documents, chosen by a hash of doc_id alone."""
    one = labels.where(keep & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_text(docs).join(F.broadcast(chosen), "doc_id")  # at most `rows` pairs of numbers


def fit_vectors(docs: DataFrame) -> Pooler:
    """Neighbours' sums over all texts: one sum a dimension, combined before the shuffle; SLOTS rows reach the driver."""

    def count(batches):
        near = Neighbours()
        for pdf in filter(len, batches):
            for text in pdf["text"]:
                near.add(text.split())
        near.flush()
        sums = near.sums.reshape(SLOTS, DIM)
        hit = np.flatnonzero(sums.any(1))
        yield pd.DataFrame({"slot": hit.astype(np.int32), **{f"x{d}": sums[hit, d] for d in range(DIM)}})

    names = [f"x{d}" for d in range(DIM)]
    parts = id_text(docs).select("text").mapInPandas(count, "slot int, " + ", ".join(f"{x} double" for x in names))
    got = parts.groupBy("slot").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    sums = np.zeros((SLOTS, DIM))
    sums[got["slot"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    return Pooler(near_vectors(sums))


def fit(docs: DataFrame, labels: DataFrame, keep, rows: int = SAMPLE_ROWS):
    """(pooler, network): neighbours' sums from all texts, the network from the labelled sample that ``keep`` admits."""
    pooler = fit_vectors(docs)

    def pooled(batches):
        for pdf in filter(len, batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "y": pdf["y"].to_numpy(), "x": [v.tobytes() for v in pooler.matrix(pdf["text"].tolist())]})

    got = labelled(docs, labels, keep, rows).mapInPandas(pooled, "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "x"], kind="stable")  # at most `rows` vectors
    y = got["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return pooler, Constant(float(y.mean()) if len(y) else 1.0)
    return pooler, Network(np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(y), -1).astype(np.float64), y)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every text."""
    pooler, network = model

    def run(batches):
        for pdf in filter(len, batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": network.score(pooler.matrix(pdf["text"].tolist()))})

    return id_text(docs).mapInPandas(run, "doc_id long, score double")


def keep(docs: DataFrame, model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, whole and with all their columns, that score at least the threshold."""
    pooler, network = model

    def run(batches):
        for pdf in filter(len, batches):
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            if len(out := pdf[network.score(pooler.matrix(texts)) >= threshold]):
                yield out

    return docs.mapInPandas(run, docs.schema)
