import hashlib
import zlib

import numpy as np
import pytest

from neighborflow.llm import media

from .corpora import documents, hard_texts


def test_texts_come_back(spark):
    texts = hard_texts()
    got = {r["doc_id"]: r for r in media.read_media(media.to_media(documents(spark, texts, extra=True))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        body = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert len(r["feature"]) == 16
    assert got[3]["media_sha256"] == got[4]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    assert media.read_media(media.to_media(documents(spark, []))).count() == 0


def test_rows_choose_their_filters():
    """A text's rows differ in filter, so that reading back has filters to undo."""
    import zlib as z

    body = media.payload("The thing and the other thing, again and again. " * 40 + "~" * 640 + "\0\1" * 64)[1]
    rows = np.frombuffer(body, np.uint8).reshape(-1, 64)
    data = media.png(body)
    kinds = np.frombuffer(z.decompress(data[data.index(b"IDAT") + 4 : -16]), np.uint8).reshape(-1, 65)[:, 0]
    assert set(kinds.tolist()) == {0, 1, 2} and np.array_equal(media.unpng(data), rows)
    rng = np.random.default_rng(1)
    for _ in range(200):
        some = rng.integers(0, 256, (rng.integers(1, 30), 64), dtype=np.uint8)
        assert np.array_equal(media.unpng(media.png(some.tobytes(), filters=rng.integers(0, 3, len(some)).astype(np.uint8))), some)


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_every_filter_is_undone(kinds):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (37, 64), dtype=np.uint8)
    data = media.png(rows.tobytes(), filters=np.array([kinds[i % len(kinds)] for i in range(37)], np.uint8))
    assert np.array_equal(media.unpng(data), rows)


def test_many_chunks_and_damage():
    rng = np.random.default_rng(4)
    body = rng.integers(0, 256, 64 * 4000, dtype=np.uint8).tobytes()
    data = media.png(body)
    assert data.count(b"IDAT") > 1 and media.unpng(data).tobytes() == body
    for at in (0, 20, 60, len(data) // 2, len(data) - 6):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.unpng(bytes(broken))
    with pytest.raises(ValueError):
        media.unpng(data[:-12])


def test_hash_is_robust_to_small_changes():
    rng = np.random.default_rng(5)
    base = np.cumsum(rng.normal(size=(200, 64)), axis=0) * 2 + 128
    image = np.clip(base, 0, 255).astype(np.uint8)
    noisy = np.clip(image + rng.integers(-2, 3, image.shape), 0, 255).astype(np.uint8)
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    assert (bits(image) != bits(noisy)).sum() <= 4
    assert (bits(image) != bits(image[::-1])).sum() > 8


def test_cosine_transform_is_orthonormal():
    assert np.allclose(media.COSINES @ media.COSINES.T, np.eye(media.LOW))
