import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from neighborflow.llm import pieces as P

from .corpora import documents, hard_texts, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def odd_texts(rng, v, n):
    out = ["".join(rng.choice("ab ▁ éüthe in\n日🙂1") for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return out + ["".join(rng.choice(v.text[300:3000]) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_words_against_the_library(sp):
    v = P.Vocabulary(PATH)
    e = P.Encoder(v)
    texts = odd_texts(random.Random(1), v, 600) + ["", " ", "a" * 300, " " * 50 + "x", "<s>hi</s><0x0A>", *[t for t in hard_texts() if t]]
    assert all(ids(got) == sp.encode(t) for got, t in zip(e.encode_many(texts), texts, strict=True))
    assert all(P.decode_ids(v, got) == t.replace(P.BLANK, " ") for got, t in zip(e.encode_many(texts), texts, strict=True))


def test_scan_over_chunks_against_the_library(spark, sp):
    rng = random.Random(2)
    v = P.Vocabulary(PATH)
    texts = [t * 8 for t in odd_texts(rng, v, 60)] + ["".join(rng.choice("abthein") for _ in range(900)) for _ in range(10)] + [prose(rng, 400), None, ""]
    texts += texts[:5]
    got = {r["doc_id"]: r["ids"] for r in P.encode(spark, documents(spark, texts, extra=True), PATH, giant=60, chunk=80, span=3).collect()}
    assert len(got) == len(texts)
    assert [i for i, t in enumerate(texts) if ids(got[i]) != sp.encode(t or "")] == []


def test_products_are_associative():
    rng = random.Random(3)
    m = [{(rng.randrange(4), rng.randrange(4)): float(-rng.randrange(9)) for _ in range(9)} for _ in range(3)]
    assert P.multiply(P.multiply(m[0], m[1]), m[2]) == P.multiply(m[0], P.multiply(m[1], m[2]))


def test_hard_texts_and_round_trip(spark, sp):
    texts = hard_texts()
    out = {r["doc_id"]: r for r in P.decode(P.encode(spark, documents(spark, texts, extra=True), PATH), PATH).collect()}
    assert all(out[i]["text"] == (t or "") and ids(out[i]["ids"]) == sp.encode(t or "") for i, t in enumerate(texts))
    assert P.decode(P.encode(spark, documents(spark, []), PATH), PATH).count() == 0
