"""Brute-force versions and odd rows shared by the tests."""

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty, white space only, one word, odd white space, a very long word, other scripts.
ODD = [None, "", " \t\n", "one", "a\x0bb\x0cc\rd", "x" * 70_000, "naïve ünï 漢字 　 🙂", "a b c d"]


def words(text):
    return WORD.findall(text or "")


def rows(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, texts, first=0, **extra):
    df = spark.createDataFrame(rows(texts, first), DOCS)
    from pyspark.sql import functions as F

    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
