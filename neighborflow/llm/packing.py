"""Best-fit packing of token pieces into sequences of a fixed length.

Documents are encoded, closed by an end id and cut into pieces only where they exceed a sequence. Pieces are sorted by
range over (length, doc_id, piece), which spreads a common length over many tasks and gives each piece its rank among
those of its length. Lengths are whole numbers up to the sequence length, so the sorted pieces, and the sorted gaps of
the open sequences, are run lengths: a few thousand runs whatever the input. Supersteps go over the length runs from
the longest down. In each, all pieces of the run look up the smallest gap that holds them; the gaps of a run take as
many each as fit, lower ranks first; the rest sweep on to the next larger gap and at last to new sequences; then the
gaps shrink and the next superstep begins. This is best-fit decreasing, done for all equal pieces at once. The sweeps
over runs take place on the driver, as they are bounded by the sequence length; ranks and places are distributed.

Defined results: a null or empty text is the end id alone, one piece; pieces of equal length are ranked by doc_id, then
piece, so ties have one order; repeated rows are packed each; an empty table gives an empty one; extra columns are
ignored. Long texts are encoded whole. Special-token strings inside a text are read as the tokenizer file reads them.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.llm.common import Scratch, id_text

LENGTH, END_ID = 4096, 1
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: the byte's own if it is visible,
    else the next one from 256 on."""
    out, more = [], 256
    for b in range(256):
        visible = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if visible else more))
        more += not visible
    return out


class Merges:
    """Many words at once by the merges of a word-level BPE file, run by a byte-pair coder.

    The end-of-word suffix becomes a mark of three bytes that joins the last byte before any merge of the file. A coder
    that ranks joined strings does what ranked pairs do, as each string of the file has one pair that makes it: before
    that pair's turn, all lower merges inside the string have been made, and they leave just the pair.
    """

    END = "\ue000"

    def __init__(self, spec: dict):
        import tiktoken

        model = spec["model"]
        suffix, mark = model["end_of_word_suffix"], self.END.encode()
        byte = {c: bytes([b]) for b, c in enumerate(_byte_characters())}
        raw = lambda x: b"".join(byte[c] for c in x.removesuffix(suffix)) + mark * x.endswith(suffix)
        order = [*(bytes([b]) for b in range(256)), mark[:2], mark, *(bytes([b]) + mark for b in range(256))]
        order += [raw(a + b) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        ranks: dict[bytes, int] = {}
        for x in order:
            ranks.setdefault(x, len(ranks))
        self.coder = tiktoken.Encoding("words", pat_str="[^\n]+", mergeable_ranks=ranks, special_tokens={})
        self.id, self.ends = np.full(len(ranks), -1, np.int64), np.zeros(len(ranks), bool)
        special = {t["content"] for t in spec["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in special and (x := raw(token)) in ranks:
                self.id[ranks[x]], self.ends[ranks[x]] = i, token.endswith(suffix)

    def encode(self, words: list[str]) -> tuple[bytes, list[int]]:
        """Ids of words without line breaks, and the byte at which each word's ids end."""
        got = np.array(self.coder.encode_ordinary("\n".join([w + self.END for w in words])), np.int64)
        return self.id[got].astype("<u4").tobytes(), ((np.flatnonzero(self.ends[got]) + 1) * 4).tolist()


class WordEncoder:
    """Ids of whole texts for a vocabulary whose pieces never cross white space and whose normalizer is NFC, white
    space to blanks, lower case. Texts of plain Latin letters are split at white space; each chunk's words, by the file's
    own pattern, are merged once and stay in a bounded memory. Any other text, and any other kind of file, goes to the
    tokenizer whole."""

    PLAIN, MARKS = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*"), frozenset(".,;:!?")
    ROOM = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.merges = Tokenizer.from_file(path), {}, None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (
            model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
            and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            self.merges, self.find = Merges(spec), regex.compile(steps[0]["pattern"]["Regex"]).findall

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        marks, words, upto = self.MARKS, [], []
        for w in new:
            if w.isalpha():
                words.append(w)
            elif w[-1] in marks and w[:-1].isalpha():
                words += (w[:-1], w[-1])
            else:
                words += self.find(w)
            upto.append(len(words))
        ids, ends = self.merges.encode(words)
        ends = [0, *ends]
        stops = [ends[n] for n in upto]
        self.known.update(zip(new, [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [t.lower().split() if self.merges and self.PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        known, new = self.known, set()
        for c in chunks:
            if c:
                new.update(c)
        if len(known) + len(new) // 2 > self.ROOM:
            known.clear()
        self._learn([w for w in new if w not in known])
        other = iter(self._ids([t for t, c in zip(texts, chunks, strict=True) if c is None]))
        return [next(other) if c is None else b"".join(map(known.__getitem__, c)) for c in chunks]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker process: reading the merges takes a second."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    end, width = np.array([end_id], "<u4").tobytes(), 4 * length

    def run(batches):
        encoder = encoder_of(tokenizer_path)
        for pdf in filter(len, batches):
            for at in range(0, len(pdf), 512):
                part, rows = pdf.iloc[at : at + 512], []
                for doc, ids in zip(part["doc_id"], encoder.encode(part["text"].tolist()), strict=True):
                    ids += end
                    for n, i in enumerate(range(0, len(ids), width)):
                        cut = ids[i : i + width]
                        rows.append((doc, n, i // 4, len(cut) // 4, zlib.crc32(cut), *([cut] if keep_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])
        encoder.known.clear()  # the memory goes with the task; the merges stay with the process

    return id_text(docs).mapInPandas(run, PIECE_SCHEMA + ", ids binary" * keep_ids)


@dataclass
class Plan:
    """Runs of placements: pieces of one length with ranks from ``rank`` on, ``bins`` sequences from ``first`` on with
    ``each`` of them in each, the first at ``offset``. Sorted by (length, rank)."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    bins: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        order = self.length << np.int64(48) | self.rank
        at = np.searchsorted(order, length << np.int64(48) | rank, "right") - 1
        past = rank - self.rank[at]
        return self.first[at] + past % self.bins[at], self.offset[at] + length * (past // self.bins[at])


def plan(counts: dict[int, int], capacity: int = LENGTH) -> Plan:
    """The supersteps over length runs. counts: pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to runs (first sequence, sequences)
    sizes: list[int] = []  # the gaps that have runs, ascending
    rows, opened = [], 0

    def put(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, bins))

    def take(length: int, rank: int, left: int, gap: int, first: int, bins: int) -> int:
        """Fill the sequences of one run with up to ``left`` pieces; returns how many they took."""
        each = gap // length
        full = min(bins, left // each)
        if full:
            rows.append((length, rank, first, full, capacity - gap))
            put(gap - each * length, first, full)
        done, rest = full * each, left - full * each
        if rest and full < bins:  # fewer than a sequence takes
            rows.append((length, rank + done, first + full, 1, capacity - gap))
            put(gap - rest * length, first + full, 1)
            done, full = done + rest, full + 1
        put(gap, first + full, bins - full)
        return done

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes.pop(at)
            runs = gaps.pop(gap)
            for first, bins in runs:
                done = take(length, rank, left, gap, first, bins) if left else put(gap, first, bins) or 0
                rank, left = rank + done, left - done
        if left:
            need = -(-left // (capacity // length))
            take(length, rank, left, capacity, opened, need)
            opened += need
    out = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(out[:, i]) for i in range(5)), opened)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """The pieces with sequence_id and offset."""
    s = scratch or Scratch(spark, "packing")
    pieces = s.save(pieces, "pieces")  # sorting by range reads its input twice
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("length").desc(), F.col("doc_id").asc(), F.col("piece").asc()]
    ordered = pieces.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = s.save(ordered, "ordered")
    s.drop("pieces")
    part = F.shiftright("at", 33)
    runs = ordered.groupBy(part.alias("part"), "length").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy(F.col("length").desc(), "part").toPandas()
    counts = {int(k): int(v) for k, v in runs.groupby("length")["n"].sum().items()}
    made = plan(counts, capacity)
    # A row's rank among its length: the rows of that length in earlier tasks, plus its place in its own run.
    before = runs.groupby("length")["n"].cumsum() - runs["n"]
    codes = runs["part"].to_numpy(np.int64) << np.int64(16) | runs["length"].to_numpy(np.int64)
    order = np.argsort(codes)
    codes, shift = codes[order], (before - runs["at"]).to_numpy(np.int64)[order]

    def place(batches):
        for pdf in filter(len, batches):
            length, at = pdf["length"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
            rank = at + shift[np.searchsorted(codes, at >> np.int64(33) << np.int64(16) | length)] if len(pdf) else at
            sequence, offset = made.place(length, rank) if len(pdf) else (at, at)
            yield pdf.drop(columns="at").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name != "at")
    return ordered.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Encode, cut and pack: one row per piece."""
    return pack(spark, encode_pieces(docs, tokenizer_path, length, end_id, keep_ids), length)
