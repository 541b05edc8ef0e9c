"""Golden records, Merkle manifest and packing against plain restatements, with odd rows."""

import datetime as dt
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle, packing, survivorship
from tests.llm.common import DOCS, ODD, frame, prose

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
COLUMNS = ("n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance", "name_from", "email_from", "segment_from", "balance_from", "address_from")


def blank(s):
    return s is None or not s.strip(" \t\n\x0b\x0c\r")


def golden(rows):
    """The record of each cluster by sorting its rows once per field."""
    out, clusters = {}, {}
    for r in rows:
        clusters.setdefault(r[1] if r[1] is not None else r[0], []).append(r)
    low = dt.datetime.min
    for key, rs in clusters.items():
        latest = max((r[3] for r in rs if r[3] is not None), default=None)
        fresh = lambda r: r[3] is not None and latest - r[3] <= dt.timedelta(hours=60 * 24)  # noqa: E731, B023
        trust = lambda r: {"crm": 4, "web": 3, "store": 2, "partner": 1}.get(r[2], 0)
        recent = lambda r: (r[3] is None, -(((r[3] or low) - low) // dt.timedelta(microseconds=1)), -trust(r), r[0] is None, r[0] or 0)  # noqa: E731, B023
        trusted = lambda r: (not fresh(r), -trust(r), *recent(r))  # noqa: E731, B023
        text = lambda i: [r for r in rs if not blank(r[i])]  # noqa: E731, B023
        none = (None,) * 10
        segment = min(text(8), key=lambda r: (*recent(r), r[8]), default=none)  # noqa: B023
        email = min(text(5), key=lambda r: (*trusted(r), r[5]), default=none)  # noqa: B023
        name = min(text(4), key=lambda r: (-len(r[4]), *trusted(r), r[4]), default=none)  # noqa: B023
        city = lambda r: None if blank(r[6]) else r[6]
        place = lambda r: ((city(r) is not None, city(r) or ""), (r[7] is not None, r[7] or 0))  # noqa: E731, B023
        address = min(rs, key=lambda r: (-(city(r) is not None) - (r[7] is not None), *trusted(r), *place(r)))  # noqa: B023
        paid = [r for r in rs if r[9] is not None and np.isfinite(r[9])]
        balance = min(paid, key=lambda r: ((None if blank(r[8]) else r[8]) != segment[8], *recent(r), r[9]), default=none)  # noqa: B023
        given = city(address) is not None or address[7] is not None
        out[key] = (
            len(rs), sum(not fresh(r) for r in rs), name[4], email[5], segment[8], city(address), address[7], balance[9],
            name[0], email[0], segment[0], balance[0], address[0] if given else None,
        )
    return out


def clients(seed):
    rng = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    some = lambda *v: rng.choice(v)
    rows = []
    for i in range(400):
        at = some(None, day, day + dt.timedelta(days=60), day + dt.timedelta(days=60, microseconds=1), day + dt.timedelta(days=rng.randrange(120)))
        master = some(7, 7, 7, rng.randrange(60), i, None)  # one cluster holds nearly half
        rows.append((
            some(i, i, i, i, None, 5), master, some("crm", "web", "store", "partner", "CRM", None), at, some(None, "", " \t", "Ann", "Änne", "ann  lee", " Bo "), some(None, "a@x", "b@x", "\n"),
            some(None, "Rom", "Oslo", ""), some(None, 1, 2), some("retail", "public", None, " "), some(None, 1.005, -0.5, 2.0, float("nan"), float("inf")),
        ))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_golden_records_against_sorting(spark, seed):
    rows = clients(seed)
    df = spark.createDataFrame(rows, CLIENTS).withColumns({"_field": F.lit("clash"), "chosen": F.lit("clash"), "latest": F.lit(1)})
    got = {r["cluster_id"]: tuple(r[c] for c in COLUMNS) for r in survivorship.golden_clients(df).collect()}
    want = golden(rows)
    assert None in want and got == want


def test_golden_records_odd_tables(spark):
    df = spark.createDataFrame([], CLIENTS)
    assert survivorship.golden_clients(df).count() == 0
    long = "x" * 300_000
    rows = [(1, 1, None, None, long, None, None, None, None, None), (2, 1, "crm", None, "y", None, None, None, None, None)]
    r = survivorship.golden_clients(spark.createDataFrame(rows, CLIENTS)).first()
    assert (r["name"], r["name_from"], r["n_stale"], r["address_from"], r["balance"]) == (long, 1, 2, None, None)


def test_elimination_of_general_fields(spark):
    """Other tables and criteria than those of clients; unequal numbers of criteria; ties give the smallest value."""
    rows = [("a", 1, 5, "x"), ("a", 1, 5, "w"), ("a", 0, 9, "z"), (None, 3, 3, "n"), ("b", None, 1, "q"), ("b", 0, 0, "r")]
    df = survivorship.keyed(spark.createDataFrame(rows, "k string, p int, q int, v string"), F.col("k"))
    fields = [survivorship.Field("one", ("v",), (F.col("p"), F.col("q"))), survivorship.Field("two", ("v", "q"), (survivorship.falling(F.col("q")),), F.col("q") > 0)]
    out = survivorship.survivors(survivorship.candidates(df, fields, ["v", "q"]), 2)
    got = {(None if r["_none"] else r["_key"], r["_field"]): (r["_value"]["v"], r["_value"]["q"]) for r in out.collect()}
    assert got == {("a", "one"): ("w", None), (None, "one"): ("n", None), ("b", "one"): ("r", None), ("a", "two"): ("w", 5), (None, "two"): ("n", 3), ("b", "two"): ("q", 1)}


def test_golden_records_broadcast_nothing(spark):
    plan = survivorship.golden_clients(spark.createDataFrame(clients(3), CLIENTS))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SinglePartition" not in plan


# --- manifest ------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(one(v) for v in row))


def plain_tree(leaves, fanout):
    """Levels of nodes, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def plain_way(levels, i, fanout):
    way = []
    for nodes in levels[:-1]:
        run = i // fanout * fanout
        way.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
        i //= fanout
    return way


@pytest.mark.parametrize(("fanout", "part_rows"), [(2, 7), (3, 5), (16, 40), (16, 10_000)])
def test_manifest_against_plain_trees(spark, fanout, part_rows):
    rng = random.Random(fanout * part_rows)
    sources = ["hot"] * 150 + [f"s{i}" for i in range(12)] * 4 + [None] * 9 + ["only", "é", "z" * 300]
    docs = [(i if i % 31 else None, rng.choice(["A b", "x", None, "ÄB" * 50]), "en", s, rng.choice([1, None])) for i, s in enumerate(rng.sample(sources, len(sources)))]
    docs += docs[:25]  # repeated rows
    df = spark.createDataFrame(docs, DOCS).withColumns({"_part": F.lit("clash"), "leaf_": F.lit(0)})
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.lower(c) if i == 4 else c for i, c in enumerate(columns)]
    leaves = df.select("doc_id", "source", merkle.leaf_hash(columns).alias("leaf"), F.when(F.col("doc_id") % 3 == 0, merkle.leaf_hash(changed)).alias("other"))
    lower, top = merkle.manifest(leaves, "source", "doc_id", fanout=fanout, part_rows=part_rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in merkle.proved(lower, top, claimed="other").collect())
    groups = {}
    for d, text, lang, source, n in docs:
        leaf = plain_leaf((d, source, lang, n, text))
        other = plain_leaf((d, source, lang, n, text.lower() if text else text)) if d is not None and d % 3 == 0 else leaf
        groups.setdefault(source, []).append((d is not None, d or 0, leaf, other))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s])], fanout) for s in names}
    roof = plain_tree([trees[s][-1][0] for s in names], fanout)
    want, nodes = [], set()
    for at, s in enumerate(names):
        for i, (known, d, leaf, other) in enumerate(sorted(groups[s])):
            way = plain_way(trees[s], i, fanout) + plain_way(roof, at, fanout)
            h = other
            for before, after in way:
                h = sha(before + h + after)
            want.append((d if known else -1, leaf, trees[s][-1][0], roof[-1][0], sha("".join(b + a for b, a in way)), h))
        nodes |= {(s, level, i, h) for level, hs in enumerate(trees[s]) if level for i, h in enumerate(hs)}
    assert got == sorted(want)
    records = [(r["_group"] if r["_known"] else None, r["level"], r["number"], r["hash"]) for r in lower.nodes.collect()]
    assert len(records) == len(nodes) and set(records) == nodes  # every node once


def test_manifest_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.proved(*merkle.manifest(none, "source", "doc_id")).count() == 0
    one = none.sparkSession.createDataFrame([(None, None, sha("a"))], none.schema)
    r = merkle.proved(*merkle.manifest(one, "source", "doc_id")).first()
    assert r["root"] == r["subroot"] == r["folded_root"] == sha("a") and r["proof_sha256"] == sha("")


# --- packing --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


ODD_WORDS = ["<|endoftext|> a <|startoftext|>b", "it's I'LL 's don't 're", "İstanbul ΑΣ ß ẞ Ǆ", "é ṇ̃", "a b c\x85d\x1ce f", "ﬁ Å K ½ ² ª º µ ×÷", "漢字 한글 🙂👍🏽", "a<b <| c|>", "\x00\x01\x7f", "١٢٣ ³ 12345"]


def test_ids_equal_the_tokenizer(whole):
    rng = random.Random(8)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x340), *range(0x390, 0x3D0)]] + list("'sdtrevml <>|") * 9
    texts = [*[t for t in ODD if t], *ODD_WORDS, *["".join(rng.choice(pool) for _ in range(rng.randrange(1, 50))) for _ in range(1500)]]
    texts += [prose(rng, 300_000), "q" * 50_000 + " <|endoftext|> " + prose(rng, 200_000)]  # longer than one call
    for kept in (40, 1 << 18):
        encode = packing.WordEncoder(packing.default_vocabulary(), kept)
        for t in texts[: 600 if kept == 40 else None]:
            assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert encode(None) == encode("") == b""


@pytest.mark.parametrize("length", [64, 100, 4096])
def test_packing_against_concatenation(spark, whole, length):
    rng = random.Random(length)
    texts = [*ODD, *ODD_WORDS, *[prose(rng, rng.randrange(1, 90)) for _ in range(60)], prose(rng, 3000)]
    df = frame(spark, texts, ids="clash", _part="clash").repartition(3)
    pieces = packing.pack(df, length=length, keep=("lang",)).collect()
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for i, t in enumerate(texts)}
    held = {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids"] == part and p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids[p["doc_id"]]) and p["kept_lang"] == "en"
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        held.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["sequence_length"], p["doc_id"], p["start"]))
    starts = sorted((p["doc_id"], p["start"], p["length"]) for p in pieces)
    for i, all_ids in ids.items():
        own = [(s, n) for d, s, n in starts if d == i]
        assert own[0][0] == 0 and all(s + n == t for (s, n), (t, _) in zip(own, own[1:])) and sum(own[-1]) == len(all_ids)
    total, padded = sum(map(len, ids.values())), 0
    for rows in held.values():
        at = 0
        for offset, n, size, _, _ in sorted(rows):
            assert offset == at
            at += n
        assert at <= size <= length and (at == size or size == length)
        padded += size - at
    assert padded == (0 if length & (length - 1) == 0 else -total % length)
    assert sorted(held) == list(range(len(held)))
    rebuilt = packing.sequences(spark.createDataFrame(packing.pack(df, length=length).collect()) if length == 100 else packing.pack(df, length=length), pad_id=9).collect()
    assert all(len(r["ids"]) == held[r["sequence_id"]][0][2] and r["ids"][r["n_tokens"] :] == [9] * (len(r["ids"]) - r["n_tokens"]) for r in rebuilt)


def test_packing_odd_tables(spark):
    df = frame(spark, ["a b"])
    assert packing.pack(df.limit(0)).count() == 0
    twice = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(twice, length=8, ids=False).collect()
    assert sum(r["length"] for r in rows) == 9 and {r["doc_id"] for r in rows} == {0, None}
