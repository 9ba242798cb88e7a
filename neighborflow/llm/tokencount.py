"""Token counts by offset-mapped attribution.

A document's fields are joined and encoded once, as a whole. Byte-level tokens add up to the text's bytes, so their
character spans follow from their lengths; a token spans every character that it has a byte of. Sections are character
intervals: the lines of the fields, or each field. Tokens are joined to sections by interval, and a token that crosses
a boundary goes by rule: ``majority`` to the section with most of its characters, the earlier of equals; ``first`` or
``last`` to the section of its first or last character; ``share`` to each by its part of the characters. Characters
between sections belong to none; a token with no character in a section counts outside, under section -1.

Defined results: a null field is empty; an empty document has its empty sections and no tokens; repeated rows are
counted each; an empty table gives an empty one; extra columns are ignored. Texts are encoded whole at any length.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neighborflow.llm.common import small_batches

RULES = ("majority", "first", "last", "share")
SCHEMA = "doc_id long, section int, field string, start long, end long, n_tokens double"


class Tokens:
    """Ids of a text from a file of byte-level ranks, and the byte length of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character, and one past the last, of each token."""
        ends = np.cumsum(self.size[np.array(self.encoding.encode_ordinary(text), np.int64)])
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        if text.isascii():
            return starts, ends
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str) -> np.ndarray:
    """Tokens of each section, then of none. Sections are disjoint and ascending."""
    out = np.zeros(len(sections) + 1)
    if not len(starts):
        return out
    lo, hi = np.array([s for s, _ in sections], np.int64), np.array([e for _, e in sections], np.int64)
    # The interval join: the sections that a token touches are those from a to b - 1.
    a, b = np.searchsorted(hi, starts, "right"), np.searchsorted(lo, ends, "left")
    whole = (b - a == 1) & (lo[np.minimum(a, len(lo) - 1)] <= starts) & (ends <= hi[np.minimum(a, len(lo) - 1)]) if len(lo) else np.zeros(len(starts), bool)
    out[:-1] += np.bincount(a[whole], minlength=len(sections))[: len(sections)]
    for i in np.flatnonzero(~whole):
        parts = [(min(ends[i], hi[k]) - max(starts[i], lo[k]), k) for k in range(a[i], b[i]) if min(ends[i], hi[k]) > max(starts[i], lo[k])]
        if not parts:
            out[-1] += 1
        elif rule == "share":
            for n, k in parts:
                out[k] += n / (ends[i] - starts[i])
            out[-1] += 1 - sum(n for n, _ in parts) / (ends[i] - starts[i])
        else:
            k = parts[0][1] if rule == "first" else parts[-1][1] if rule == "last" else max(parts, key=lambda p: (p[0], -p[1]))[1]
            out[k] += 1
    return out


def sections_of(fields: list[tuple[str, str]], separator: str, split: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    """The joined text, and its sections (start, end, field)."""
    out, at = [], 0
    for name, text in fields:
        for part in text.split(split) if split else [text]:
            out.append((at, at + len(part), name))
            at += len(part) + len(split or "")
        at += len(separator) - len(split or "")
    return separator.join(t for _, t in fields), out


def count_tokens(docs: DataFrame, path: str, pattern: str, fields: tuple[str, ...] = ("text",), separator: str = "\n", split: str | None = "\n", rule: str = "majority") -> DataFrame:
    """A row per document and section: its interval and tokens; section -1, from 0 to 0, holds the tokens of none."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def run(batches):
        tokens, names = Tokens(path, pattern), [f"f{i}" for i in range(len(fields))]
        for pdf in filter(len, batches):
            for at in range(0, len(pdf), 512):
                part, rows = pdf.iloc[at : at + 512], []
                for doc, *texts in part[["doc_id", *names]].itertuples(index=False):
                    text, sections = sections_of(list(zip(fields, texts, strict=True)), separator, split)
                    n = attribute(*tokens.spans(text), [(s, e) for s, e, _ in sections], rule)
                    rows += [(doc, i, f, s, e, x) for i, ((s, e, f), x) in enumerate(zip(sections, n, strict=False))]
                    rows.append((doc, -1, None, 0, 0, n[-1]))
                yield pd.DataFrame(rows, columns=["doc_id", "section", "field", "start", "end", "n_tokens"])

    return src.mapInPandas(run, SCHEMA)
