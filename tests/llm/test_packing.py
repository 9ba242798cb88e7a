import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from neighborflow.llm import packing as K

from .corpora import documents, hard_texts, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 10), 64]) for _ in range(rng.randint(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = K.plan(counts, 64)
    used = {}
    for n, c in counts.items():
        seq, off = plan.place(np.full(c, n, np.int64), np.arange(c, dtype=np.int64))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            used.setdefault(s, []).append((o, n))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert len(used) == plan.sequences == best_fit_decreasing(lengths, 64)
    assert K.plan({}, 64).sequences == 0


def test_ids_are_the_tokenizers(spark):
    rng = random.Random(2)
    texts = [*hard_texts(), "Don't, WON'T! they're 's <|endoftext|> x", "ŉ ſ ² ¼ ª İ Σας ΟΔΟΣ", prose(rng, 5000), "word." * 40, "..,;", "é,è.", "#a, b!? c1, 2."]
    tok = Tokenizer.from_file(PATH)
    got = {}
    for r in K.encode_pieces(documents(spark, texts, extra=True), PATH, keep_ids=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        rows = sorted(got[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in rows) == ids.tobytes()
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows] == [(n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]


def test_packed_whole(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([3, 30, 300, 3000])) for _ in range(120)] + hard_texts()
    got = K.pack_documents(spark, documents(spark, texts, extra=True), PATH).toPandas()
    pieces = K.encode_pieces(documents(spark, texts), PATH).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(pieces.sort_values(key).reset_index(drop=True))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
    assert got["sequence_id"].nunique() == best_fit_decreasing(got["length"].tolist(), 4096)
    assert K.pack_documents(spark, documents(spark, []), PATH).count() == 0
