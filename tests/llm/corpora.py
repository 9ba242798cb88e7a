"""Small corpora for the operators' tests."""

import random

SYLLABLES = "an er on th ing re nd at en or ti st ha ed ou ea".split()


def word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(word(rng) for _ in range(n))


def documents(spark, texts, extra: bool = False):
    """doc_id, text from a list; ``extra`` adds columns whose names clash with those that operators make."""
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "sig", "digest", "y", "rep", "length", "n", "ids", "bucket", "guest", "media"):
            df = df.withColumn(name, F.lit("x"))
    return df


#: Null, empty, white space, odd characters, a very long text, ties and repeats.
def hard_texts() -> list:
    rng = random.Random(5)
    long_ = prose(rng, 30_000)
    return [None, "", "   \n\t", "a", "a", long_, long_, "日本語 テキスト 🙂", "é é", "x" * 5000, prose(rng, 40), "\u0000\u0001 b"]
