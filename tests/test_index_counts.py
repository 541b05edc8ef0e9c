"""Postings counted inside a task, without Spark."""

from collections import Counter

import pyarrow as pa

from corpusloom.operators import blockmax as X


def test_a_block_that_spans_batches_is_counted_once():
    docs = [("d3", ["a", "b", "a"], 0), ("d1", ["b"], 0), ("d2", ["a", "a"], 0), ("d4", ["c"], 1), ("d0", ["a", "c"], 1)]
    schema = pa.schema([("id", pa.string()), ("w", pa.list_(pa.string())), ("block", pa.int64())])
    cut = [docs[:2], docs[2:4], [], docs[4:]]
    batches = [pa.RecordBatch.from_arrays([pa.array([d[i] for d in part], schema.field(i).type) for i in range(3)], schema=schema) for part in cut]
    got, sums = {}, {}
    for b in X._counted(iter(batches)):
        for r in b.to_pylist():
            key = (r["token"], r["block"])
            assert key not in got
            if r["token"] is None:
                sums[r["block"]] = (r["tfs"], r["dls"])
            else:
                got[key] = list(zip(r["ids"], r["tfs"], r["dls"], strict=True))
    want = {}
    for i, w, block in sorted(docs):
        for t, n in Counter(w).items():
            want.setdefault((t, block), []).append((i, n, len(w)))
    assert got == want and sums == {0: ([3], [6]), 1: ([2], [3])}
