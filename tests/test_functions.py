"""Golden values of scalar functions, from independent Python restatements."""

import hashlib
import json
import re
import string
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T

TEXTS = ["Hello, World! été 漢字测试", "", "a  b\t\tc ", "The A an cat’s — “x”…", "don't stop", "foo_bar 12.5% ＡＢＣ x", "第一章 总则", "x"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def column(df, c):
    return [r[0] for r in df.select(c.alias("v"), "i").orderBy("i").select("v").collect()]


def test_token_counts(texts):
    assert column(texts, T.count_tokens(F.col("t"))) == [len(re.findall(T.TOKEN, t)) for t in TEXTS]
    cjk = [len(re.findall(T.CJK, t)) for t in TEXTS]
    assert column(texts, T.cue_cost(F.col("t"))) == [c + -(-(len(t) - c) // 4) for c, t in zip(cjk, TEXTS, strict=True)]


def test_normalize_text(texts):
    def want(t):
        t = unicodedata.normalize("NFKC", t.replace("﻿", "")).replace(" ", " ")
        for a, b in (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "...")):
            t = t.replace(a, b)
        return t

    assert column(texts, T.normalize_text(F.col("t"))) == [want(t) for t in TEXTS]
    assert column(texts, T.normalize_line(F.col("t"))) == [re.sub("[ \t]{2,}", " ", want(t)).strip() for t in TEXTS]


def test_normalize_answer(texts):
    def want(t):
        t = "".join(c for c in t.lower() if c not in string.punctuation)
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())

    assert column(texts, T.normalize_answer(F.col("t"))) == [want(t) for t in TEXTS]


def test_ids(texts):
    name = lambda t: re.sub(r"\s+", " ", t.strip().lower())
    assert column(texts, T.entity_id(F.col("t"))) == ["entity:" + hashlib.sha1(name(t).encode()).hexdigest()[:12] for t in TEXTS]
    body = [json.dumps({"edge_type": "semantic", "relation_types": [t, 'q"'], "source": t, "target": "b\n"}, sort_keys=True, ensure_ascii=False) for t in TEXTS]
    got = column(texts, T.edge_id(F.lit("semantic"), F.array(F.col("t"), F.lit('q"')), F.col("t"), F.lit("b\n")))
    assert got == ["edge:" + hashlib.sha1(b.encode()).hexdigest()[:16] for b in body]
    seed = [t + "|" + "A>B" + "|" + "c1,c2" for t in TEXTS]
    got = column(texts, T.raptor_id(F.col("t"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("c1"), F.lit("c2"))))
    assert got == ["raptor:" + hashlib.sha1(s.encode()).hexdigest()[:16] for s in seed]


def test_locates(spark):
    df = spark.createDataFrame([(0, "a.txt:L10-L12"), (1, "a:L1:L2-L3"), (2, "a.txt:7"), (3, "nothing"), (4, "a.txt:5-6")], "i int, t string")
    strict = column(df, T.parse_locate(F.col("t")))
    assert [tuple(x) if x else None for x in strict] == [("a.txt", 10, 12), ("a:L1", 2, 3), None, None, None]
    loose = column(df, T.parse_locate(F.col("t"), tolerant=True))
    assert [tuple(x) if x else None for x in loose] == [("a.txt", 10, 12), ("a:L1", 2, 3), ("a.txt", 7, 7), None, ("a.txt", 5, 6)]


def test_headings(spark):
    lines = ["# A", "### B ", "第一章 总则", "第三条 x", "第二款 y", "ARTICLE IV. z", "Section 1.2 t", "1.2.3 some words", "1. no", "plain", "#no"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    assert column(df, T.heading_level(F.col("t"))) == [1, 3, 1, 3, 2, 1, 2, 3, None, None, None]
    assert column(df, T.heading_title(F.col("t")))[:2] == ["A", "B"]


def test_placeholders(spark):
    line = 'see ![i](x.png) and [l](u) <table a>1</table> ![j](y.png)'
    df = spark.createDataFrame([(0, line)], "i int, t string")
    got = column(df, T.placeholders(F.col("t"), F.lit(4)))[0]
    assert [(p["placeholder"], p["raw"]) for p in got] == [
        ("[table_4_1]", "<table a>1</table>"), ("[image_4_1]", "![i](x.png)"), ("[image_4_2]", "![j](y.png)"), ("[link_4_1]", "[l](u)"),
    ]


def test_hash_embedding(texts):
    def want(t, dim=16):
        v = np.zeros(dim)
        for w in t.lower().split():
            h = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] % 2 == 0 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    for got, t in zip(column(texts, T.hash_embedding(F.col("t"), 16)), TEXTS, strict=True):
        assert got == pytest.approx(want(t).tolist())


def test_answers_and_judges(spark):
    said = ["<think>x</think><answer> A </answer>", "<think>x</think> B", '{"answer": "C"}', "D"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    assert column(df, T.extract_answer(F.col("t"))) == ["A", "B", "C", "D"]
    df = spark.createDataFrame(list(enumerate(["yes", "0.4", "1", "No", "perhaps"])), "i int, t string")
    assert column(df, T.judge_value(F.col("t"))) == [1.0, 0.0, 1.0, 0.0, None]
    df = spark.createDataFrame(list(enumerate(["<score>7</score>", "<score> 12.5 </score>", "none"])), "i int, t string")
    assert column(df, T.judge_score(F.col("t"))) == [0.7, 1.0, None]


def test_splits(spark):
    df = spark.createDataFrame([(0, "one？ two; three. four\nfive"), (1, " ")], "i int, t string")
    assert column(df, T.decompose(F.col("t"))) == [["one", "two", "three. four"], [""]]
    df = spark.createDataFrame([(0, "A first long sentence here. Short. Another quite long sentence!")], "i int, t string")
    assert column(df, T.split_sentences(F.col("t"))) == [["A first long sentence here.", "Another quite long sentence!"]]
    df = spark.createDataFrame([(0, "abcdefg")], "i int, t string")
    assert column(df, T.split_evenly(F.col("t"), F.lit(3))) == [["abc", "def", "g"]]
    assert column(df, T.unit_in_text(F.lit("a b c d"), F.lit("x a b c y"))) == [True]
    assert column(df, T.unit_in_text(F.lit("a b"), F.lit("x a y"), strict_short=True)) == [False]
