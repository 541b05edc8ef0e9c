"""Steps of round 3's findings, fourth pass."""

import pyarrow as pa

from corpusloom.functions import text as T
from corpusloom.operators import documents as D


def test_each_line_is_cut_once_and_in_slices(spark):
    texts = ["plain " * 500, "﻿ＡＢＣ １２", None, ""]
    docs = spark.createDataFrame([(i, f"doc_{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, file_name string, text string")
    lines = D.lines(docs)
    # one step that normalises and one that cuts; with a third, every task held one more worker
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    got = sorted((r["doc_id"], r["line_no"], r["text"]) for r in lines.collect())
    assert got == [(0, 1, " ".join(["plain"] * 384)), (0, 2, " ".join(["plain"] * 116)), (1, 1, "ABC 12")]
    kept = pa.array(["a", None, "b", "c", None], pa.string())
    assert T.by_slices(kept, str.upper, pa.string(), size=2).to_pylist() == ["A", None, "B", "C", None]
    assert len(T.by_slices(kept[:0], str.upper, pa.string())) == 0
