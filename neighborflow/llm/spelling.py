"""Spelling variants of words: pairs one edit apart, and the frequent form that a rare word varies.

Words are counted over all texts, combined before the shuffle. A word of n letters is cut into two even segments; if two
words are one edit apart, one of the segments of the word that is not longer stands unchanged in the other, the first at
its start, the second at its end, one place further if that word is longer by one. So the index holds a word's two
segments, a word is probed with the segments that words of its length, and of one less, would have there, and words meet
only in a bucket of equal length, place and segment. A bucket in which too many would meet is cut again: what its segment
leaves open is itself two even segments, one of which must be unchanged, and so on until buckets are small or one letter is
open. No bucket is capped and no pair is lost. Of the buckets that hold a pair one alone reports it: the one that follows
the first segment wherever it agrees. A pair must then be one edit apart.

Defined results. A null text has no words; a null doc_id counts as an empty one. Each occurrence counts, repeated rows as
often as they stand. Letters are code points, and only A-Z are lower-cased. Of near words with equal counts the smallest in
code-point order is the form. A chain of forms grows tenfold at each step, so it ends. An empty table has no rows. Extra
columns take no part.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Meetings in a bucket above which it is cut again.
MEETINGS = 1 << 16


def counted_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): runs of letters with at least ``least_length`` left and ``least_count`` occurrences. Where the checksum of
    ``doc_id:run`` is a multiple of ``slip``, one letter of the run is left out, as a typist would."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _bucket(word: Column, size: Column, lo: Column, hi: Column) -> Column:
    """What a word of ``size`` letters has outside letters lo to hi of an index word."""
    return F.concat(F.substring(word, F.lit(1), lo), F.lit("|"), F.substring(word, size - (F.col("of") - hi) + 1, F.col("of") - hi))


def _cut(entries: DataFrame) -> DataFrame:
    """Each entry twice: with the first, and with the second, of the two segments of what it leaves open unchanged too."""
    middle = (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("int")
    halves = F.explode(F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi"))))
    out = entries.select("word", "size", "of", "own", halves.alias("s")).select("word", "size", "of", "own", "s.lo", "s.hi")
    return out.withColumn("key", _bucket(F.col("word"), F.col("size"), F.col("lo"), F.col("hi")))


def near_words(spark: SparkSession, words: DataFrame, scratch: Scratch, meetings: int = MEETINGS) -> DataFrame:
    """(a, b): words (word) exactly one insertion, deletion or replacement apart, each pair once."""
    sized = words.select("word", F.length("word").alias("size"))
    kinds = F.explode(F.array(F.lit(True), F.lit(False)))  # as an index word and a probe for its length, or a probe for one less
    rest = sized.select("word", "size", kinds.alias("own")).withColumn("of", F.when(F.col("own"), F.col("size")).otherwise(F.col("size") - 1)).where("of > 0")
    rest, settled = _cut(rest.withColumn("lo", F.lit(0)).withColumn("hi", F.col("of"))), []
    for i in range(64):
        rest = scratch.save(rest, f"entries-{i}")
        own = F.sum(F.col("own").cast("long"))
        hot = rest.groupBy("of", "lo", "hi", "key").agg(own.alias("n"), F.count("*").alias("m")).where((F.col("n") * F.col("m") > meetings) & (F.col("hi") - F.col("lo") > 1))
        hot = scratch.save(hot.select("of", "lo", "hi", "key"), f"hot-{i}")
        if hot.isEmpty():
            settled.append(rest)
            break
        by = ["of", "lo", "hi", "key"]
        settled.append(rest.join(hot, by, "left_anti"))
        rest = _cut(rest.join(hot, by, "left_semi"))
    pairs = None
    for entries in settled:
        index = entries.where("own").select("of", "lo", "hi", "key", F.col("word").alias("a"))
        probe = entries.select(F.col("of").alias("_of"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("key").alias("_key"), F.col("word").alias("b"), "own")
        meet = (F.col("of") == F.col("_of")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("key") == F.col("_key"))
        once = (~F.col("own") | (F.col("a") < F.col("b"))) & ((F.col("hi") == F.col("of")) | (F.substring("a", F.lit(1), F.col("hi")) != F.substring("b", F.lit(1), F.col("hi"))))
        got = index.join(probe, meet & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
        pairs = got if pairs is None else pairs.unionByName(got)
    return pairs


def variants(spark: SparkSession, docs: DataFrame, ratio: int = 10, meetings: int = MEETINGS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for documents (doc_id, text): the near word of largest count as a word's form if
    that is at least ``ratio`` times its own, and the last form of its chain as its root."""
    scratch = Scratch(spark, "spelling")
    words = scratch.save(counted_words(docs.select("doc_id", "text")), "words")
    pairs = scratch.save(near_words(spark, words, scratch, meetings), "pairs")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = both.join(counts, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("w"))).alias("best"))
    found = words.join(best, "word", "left")
    formed = -F.col("best.n") >= ratio * F.col("n")
    found = scratch.save(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.w")).alias("form"), F.when(formed, -F.col("best.n")).cast("long").alias("form_n")), "forms"
    )
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("n").alias("n")).first()["n"] or 1  # one number
    for i in range(ceil(log2(max(2.0, log(most, ratio) + 1)))):  # each round doubles the steps taken
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.save(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{i}")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
