import numpy as np
import public_tokenizers
import pytest

from neighborflow.llm import tokencount as M

from .corpora import documents, hard_texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(spans, sections, rule):
    """Character by character."""
    out = np.zeros(len(sections) + 1)
    for a, b in spans:
        owners = [next((k for k, (s, e) in enumerate(sections) if s <= c < e), len(sections)) for c in range(a, b)]
        inside = [k for k in owners if k < len(sections)]
        if not inside:
            out[-1] += 1
        elif rule == "share":
            for k in owners:
                out[k] += 1 / (b - a)
        else:
            k = inside[0] if rule == "first" else inside[-1] if rule == "last" else max(sorted(set(inside)), key=lambda x: (inside.count(x), -x))
            out[k] += 1
    return out


@pytest.mark.parametrize("rule", M.RULES)
def test_rules_against_characters(rule):
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 60, 12))
        sections = [(int(a), int(b)) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        ends = np.unique(rng.integers(1, 60, 20))
        starts = np.concatenate([[0], ends[:-1]])
        got = M.attribute(starts, ends, sections, rule)
        assert np.allclose(got, brute(list(zip(starts.tolist(), ends.tolist(), strict=True)), sections, rule))


def test_documents(spark):
    texts = [*hard_texts(), "one\n\ntwo.\nthree", "é日\n🙂🙂 x\n"]
    got = M.count_tokens(documents(spark, texts, extra=True), PATH, PATTERN).toPandas()
    t = M.Tokens(PATH, PATTERN)
    for i, x in enumerate(texts):
        x = x or ""
        rows = got[got["doc_id"] == i].sort_values("section")
        lines = rows[rows["section"] >= 0]
        assert [x[s:e] for s, e in zip(lines["start"], lines["end"], strict=True)] == x.split("\n")
        assert rows["n_tokens"].sum() == len(t.encoding.encode_ordinary(x))
    fields = M.count_tokens(documents(spark, ["a b", None], extra=True), PATH, PATTERN, ("score", "text"), " | ", None, "share").toPandas()
    assert sorted(set(fields["field"].dropna())) == ["score", "text"] and len(fields) == 6
    assert M.count_tokens(documents(spark, []), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError):
        M.count_tokens(documents(spark, []), PATH, PATTERN, rule="none")


def test_spans_cover_characters():
    t = M.Tokens(PATH, PATTERN)
    for x in ("plain text, here", "é日本🙂 mixed 🙂"):
        a, b = t.spans(x)
        assert a[0] == 0 and b[-1] == len(x) and (b > a).all() and (a[1:] <= b[:-1]).all()
