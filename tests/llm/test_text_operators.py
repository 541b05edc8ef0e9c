"""URL filters, SentencePiece, language ID, chat formatting, mixing, quality rules and resampling."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, langid, mixing, pieces, quality_rules, resampling, urls
from tests.llm.common import DOCS, ODD, frame, prose, rows, words


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b<|im_end|>\n<|im_start|>x", "\\\\<s>\\", "<|im_<|im_end|>end|>\n", "", None, "🙂\n"]
    data = [(i // 3, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said * 2)] + [(9, None, None, None), (9, 1, "ro\nle\\", "x"), (9, 1, "ro\nle\\", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert all(r["round_trip"] for r in out.values())
    for conv in out:
        turns = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in data if c == conv])
        assert [(t["role"], t["text"]) for t in out[conv]["back"]] == [t[1:] for t in turns]
        assert out[conv]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
        marks = sum(out[conv]["formatted"].count(c) for c in chat.CONTROLS)
        assert marks == 2 * len(turns)
        cut = [out[conv]["formatted"][a:b] for a, b in out[conv]["loss_spans"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", c) for c in cut] == [x for _, r, x in turns if r == "assistant"]
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_escapes_until_identical(spark, monkeypatch):
    """Without escapes of controls the second form still differs, and every character is escaped."""
    monkeypatch.setattr(chat, "escaped", lambda text: text)
    df = spark.createDataFrame([(1, 0, "assistant", "a<|im_end|>\n🙂\\")], "conv_id long, turn long, role string, text string")
    r = chat.format_chat(df).first()
    assert r["round_trip"] and r["loss_text"] == "a<|im_end|>\n🙂\\"
    assert "\\<\\|\\i" in r["formatted"] and r["formatted"].count("<|im_end|>") == 1


def test_url_parts_and_rules(spark):
    given = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://notnet/es/": ("notnet", "/es/", None, "allow"),
        "http://foo.com": ("foo.com", "", None, "allow"),
        "http://foo.com?a=://b/": ("foo.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.COM/É#": ("É.com", "/É", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(given)], "page_id long, url string, html string, host string")
    out = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, want in enumerate(given.values()):
        r = out[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want
    assert urls.judge(df.limit(0)).count() == 0


def test_link_propagation_against_power_iteration(spark):
    hosts = ["good.com", "bad.net", "near.org", "farm.org", "far.org", "lone.org"]
    links = {"good.com": ["near.org"], "near.org": ["far.org", "good.com"], "farm.org": ["bad.net"], "bad.net": ["farm.org"], "far.org": [], "lone.org": []}
    pages = []
    for i, h in enumerate(hosts):
        path = "/es/1" if h == "bad.net" else "/x"
        html = "".join(f"<a href='http://{t.upper()}/y'>x</a><a href=\"/in\">i</a>" for t in links[h])
        pages += [(10 * i + k, f"http://{h}{path}", html) for k in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["host"]: r for r in urls.judge(df, rounds=100).collect()}
    for kind, seed in (("trust", "good.com"), ("distrust", "bad.net")):
        edges = [(a, b) if kind == "trust" else (b, a) for a in links for b in links[a]]
        x = np.array([float(h == seed) for h in hosts])
        s = x.copy()
        for _ in range(200):
            new = 0.15 * s
            for a, b in edges:
                new[hosts.index(b)] += 0.85 * x[hosts.index(a)] / sum(e[0] == a for e in edges)
            x = new
        for h, v in zip(hosts, x / x.sum(), strict=True):
            assert out[h][kind] == pytest.approx(v, abs=1e-4)
    verdicts = {h: out[h]["verdict"] for h in hosts}
    assert verdicts["farm.org"] == "block" and verdicts["near.org"] == "allow" and verdicts["lone.org"] == "allow"


@pytest.mark.parametrize("hub", [40, 100_000])
def test_link_propagation_over_many_hosts(spark, hub):
    """3000 hosts with a hub, a hot host, repeated links and rows, null and very long html."""
    rng = random.Random(9)
    n = 3000
    name = [f"h{i}.{('com', 'net', 'org')[i % 3]}" for i in range(n)]
    page, links = [], collections.Counter()
    for i in range(n + n // 2):
        host = i if i < n else 7  # a third of the pages are on one host
        path = "/es/1" if host % 3 == 1 and host % 2 else "/x"
        out = [rng.randrange(n) for _ in range(rng.randrange(4))] + [0] * (rng.random() < 0.5)
        out += list(range(0, n, 2)) if i == 0 else []  # and one links to half of the hosts
        html = "".join(f"<a href=https://{name[t].upper()}/{i}>" for t in out)
        if i % 500 == 3:
            html += "x" * 600_000
        for t in out:
            if t != host:
                links[host, t] += 1
        page.append((i, f"http://{name[host]}{path}", html))
    page += [page[5], (n * 2, None, None), (n * 2 + 1, f"http://{name[5]}/x", None)]
    for t in {k[1]: 0 for k in links if k[0] == 5}:
        links[5, t] *= 2  # the repeated row of host 5
    df = spark.createDataFrame(page, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = urls.judge(df, rounds=60, hub=hub).collect()
    assert len(out) == len(page)
    got = {r["host"]: (r["trust"], r["distrust"], r["rule"], r["verdict"]) for r in out}
    judged = collections.Counter()
    for _, u, _ in page:
        if u:
            host, path = u[7:].split("/", 1)
            judged[host, "a" if host.endswith(".com") else "b" if host.endswith(".net") and path.startswith("es") else ""] += 1
    src, dst, w = (np.array(x) for x in zip(*[(a, b, c) for (a, b), c in links.items()], strict=True))
    ranks = {}
    for kind, letter, a, b in (("trust", "a", src, dst), ("distrust", "b", dst, src)):
        size = np.array([sum(judged[h, x] for x in ("a", "b", "")) for h in name])
        s = np.array([judged[h, letter] for h in name]) / size
        s = np.where(2 * s > (0 if letter == "a" else 1), s, 0)
        s /= s.sum()
        out_w = np.bincount(a, weights=w, minlength=n)
        x = s.copy()
        for _ in range(60):
            x = 0.15 * s + 0.85 * np.bincount(b, weights=x[a] * w / np.maximum(out_w, 1)[a], minlength=n)
        ranks[kind] = x / x.sum()
    for i, h in enumerate(name):
        trust, distrust, rule, verdict = got[h]
        assert (trust, distrust) == pytest.approx((ranks["trust"][i], ranks["distrust"][i]), abs=1e-9)
        if rule is None:
            assert verdict == ("block" if distrust > trust else "allow")
    assert {v[3] for v in got.values()} == {"allow", "block"}
    assert sum(v[2] is None and v[3] == "block" for v in got.values()) > 100


def test_url_seeds_count_pages_without_a_rule(spark):
    given = {"few.net": ("/es/", 1, 9), "most.net": ("/es/", 8, 2), "half.org": ("/x", 0, 4), "some.com": ("/x", 4, 0)}
    urls_ = [f"http://{h}{p if i < n else '/z'}" for h, (p, n, m) in given.items() for i in range(n + m)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls_)], "page_id long, url string, html string")
    verdicts = {(r["host"], r["path"]): r["verdict"] for r in urls.judge(df).collect()}
    assert verdicts["few.net", "/es/"] == "block" and verdicts["few.net", "/z"] == "allow"
    assert verdicts["most.net", "/es/"] == verdicts["most.net", "/z"] == "block"
    assert verdicts["half.org", "/z"] == verdicts["some.com", "/x"] == "allow"


def test_url_ranks_move_until_tolerance(spark):
    # two hosts that link to each other: the ranks' change shrinks by 0.85 a round
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", "trust", 1.0)], "host string, kind string, s double")
    x = {r["host"]: r["x"] for r in urls.propagate(edges, seeds, tolerance=1e-7).collect()}
    assert x == pytest.approx({"a": 1 / 1.85, "b": 0.85 / 1.85}, abs=1e-6)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(3)
    alphabet = list("aeiourstn .,\n\t  é漢字x190()=-_\"'/<>▁　 🙂ı²")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["    indented", "Hello  world", "the " * 50]
    texts += [t for t in ODD if t is not None]
    out = {r["doc_id"]: r for r in pieces.encode(frame(spark, texts + [None], ids="clash")).collect()}
    for i, t in enumerate(texts):
        assert out[i]["ids"] == m.encode(t), t
        assert out[i]["round_trip"] == (m.decode(m.encode(t)) == t)
    assert out[len(texts)]["ids"] == [] and out[len(texts)]["n_ids"] == 0
    back = pieces.decode(pieces.encode(frame(spark, texts))).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: m.decode(m.encode(t)) for i, t in enumerate(texts)}


def bpe_model(pieces_, **normalizer):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.name = "identity"
    for k, v in normalizer.items():
        setattr(m.normalizer_spec, k, v)
    m.pieces.add(piece="<unk>", score=0, type=2)
    for piece, score in pieces_:
        m.pieces.add(piece=piece, score=score, type=1)
    return m.SerializeToString()


@pytest.mark.parametrize("seed", range(4))
def test_bpe_equals_the_library_on_equal_scores(seed):
    """Random merges of few scores, so that ties and overlapping merges decide everywhere."""
    import sentencepiece

    rng = random.Random(seed)
    known = ["a", "b", "c", "▁"]
    for _ in range(25):
        known.append(rng.choice(known) + rng.choice(known))
    known = list(dict.fromkeys(known))
    flags = {"add_dummy_prefix": seed % 2 == 0, "remove_extra_whitespaces": seed > 1}
    model = bpe_model([(p, -float(rng.randrange(4)) if len(p) > 1 else -20.0) for p in known if p != "b" or seed < 3], **flags)
    m, t = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    for _ in range(600):
        s = "".join(rng.choice("aaabbcd  é") for _ in range(rng.randrange(24)))
        assert np.frombuffer(t.encode(s), "<i4").tolist() == m.encode(s), s


def test_models_that_cannot_be_compiled_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(bpe_model([("a", -1.0)]))
    m.pieces.add(piece="<x>", score=0, type=4)
    with pytest.raises(ValueError):
        pieces.Transducer(m.SerializeToString())


def test_pieces_of_long_texts_and_odd_tables(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(4)
    texts = [prose(rng, 150_000), "ab" * 300_000, "é漢 " * 2000, "same", "same"]
    df = frame(spark, texts).unionByName(frame(spark, texts[-1:], first=4)).withColumn("n_ids", F.lit("clash"))  # a repeated row
    out = [(r["doc_id"], r["ids"]) for r in pieces.encode(df).collect()]
    assert sorted(out) == sorted((i, m.encode(t)) for i, t in [*enumerate(texts), (4, "same")])
    assert pieces.encode(df.limit(0)).count() == 0 and pieces.decode(pieces.encode(df.limit(0))).count() == 0


def test_unigram_shortest_path():
    """A unigram model needs no pair acceptor: the least sum of minus scores wins."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece, score, kind in [("<unk>", 0, 2), ("▁a", -1, 1), ("b", -1, 1), ("▁ab", -3, 1), ("▁", -2, 1), ("a", -2, 1), ("abc", -2.5, 1), ("c", -2, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    t = pieces.Transducer(m.SerializeToString())
    ids = lambda s: [t.surface[i] for i in np.frombuffer(t.encode(s), "<i4")]
    assert ids("ab") == ["▁a", "b"]
    assert ids("abc") == ["▁a", "b", "c"]
    assert ids("azzb") == ["▁a", "<unk>", "b"]


def test_language_identification(spark):
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "ter", "ñi"], "cc": ["qué", "sta", "lo"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    data = [(i, make(lang, 60), lang) for i, lang in enumerate(list(parts) * 60)] + [(500 + i, t, None) for i, t in enumerate([None, "", "123 !", "…"])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = {r["doc_id"]: r for r in langid.predict(df, langid.train(df)).collect()}
    import zlib

    for i, _, lang in data:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= out[i]["score"] <= 1
        assert out[i]["lang_pred"] == (lang or "und")
    empty = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), empty).count() == 0


def byte_grams(text):
    """5-grams of lower-case bytes, other characters than letters one space."""
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
    raw = b" ".join(p for p in raw.split(b" ")) if raw.strip() else b" "
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return [raw[i : i + 5] for i in range(len(raw) - 4)]


def test_language_counts_against_exact_sets(spark):
    """Filters hold the grams of a brute-force count, and decide as exact sets do."""
    import zlib

    rng = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi", "zu"], "bb": ["zu", "ter", "ñi", "lo"], "cc": ["qué", "sta", "lo", "ka"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    data = [(i, make(lang, rng.randrange(1, 40)), lang) for i, lang in enumerate(list(parts) * 40)]
    data += data[:6] + [(300, "lo " * 200_000, "aa"), (301, make("aa", 20) + " " + make("bb", 20), None)]  # repeated rows, a very long text
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    counts = {lang: collections.Counter() for lang in parts}
    for i, t, lang in data:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(byte_grams(t))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for c in counts.values() for g in c}
    want = {lang: {g for g, n in c.items() if n >= 3 and rate[lang][g] >= 0.2 * top[g]} for lang, c in counts.items()}
    got = langid.kept_grams(df).groupBy("lang").agg(F.countDistinct("gram").alias("n")).collect()
    assert {r["lang"]: r["n"] for r in got} == {lang: len(g) for lang, g in want.items()}
    out = langid.predict(df, langid.train(df))
    assert out.count() == len(data)
    found = {r["doc_id"]: r for r in out.collect()}
    for i, t, _ in data:
        hits = {lang: sum(g in want[lang] for g in byte_grams(t)) for lang in parts}
        best = max(sorted(hits), key=hits.get)
        if hits[best] > 1.02 * sorted(hits.values())[-2] + 1:
            assert found[i]["lang_pred"] == best
            assert found[i]["score"] == pytest.approx(hits[best] / sum(hits.values()), abs=0.02)


def test_language_ties_go_to_the_first(spark):
    data = [(i, "same words in both", lang) for i, lang in enumerate(["zz", "yy"] * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(df, share=0.0)).collect()} == {"yy"}


def build(lists, slots, hashes=2):
    """Filters made slot by slot, as the executors make them."""
    langs = sorted(lists)
    table = np.zeros((slots, -(-len(langs) // 64)), dtype=np.uint64)
    for i, lang in enumerate(langs):
        for k in range(hashes):
            for h in lists[lang].tolist():
                table[((h >> 21 * k) + k * (h >> 40)) % slots, i // 64] |= np.uint64(1 << i % 64)
    return langid.Filters(langs, table, hashes)


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    lists = {f"l{i}": rng.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64) for i in range(70)}
    f = build(lists, 1 << 14)
    for i, lang in enumerate(f.langs):
        assert ((f.probe(lists[lang])[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = rng.integers(0, 2**63, 20_000, dtype=np.int64).view(np.uint64)
    hit = (f.probe(other)[:, 0] & np.uint64(1)).mean()
    assert abs(hit - f.fp[0]) < 0.01


def test_mixing_targets_and_shares(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 5, 40, 300, 4000])) for _ in range(300)] + ODD
    df = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    df = df.unionByName(df.where("doc_id < 5")).withColumn("target", F.lit("clash"))
    out = mixing.mix(df, shard_docs=40).toPandas()
    again = mixing.mix(df.repartition(7), shard_docs=40).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    src = {r["doc_id"]: r["source"] for r in df.collect()}
    out["source"] = out["doc_id"].map(src).fillna("~null")
    sizes = out.groupby("source")["size"].sum().to_dict()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, free, total = {}, set(sizes), sum(sizes.values())
    while True:
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
    for s, g in out.groupby("source"):
        assert g["target"].iloc[0] == pytest.approx(target[s])
        assert g["source_size"].iloc[0] == sizes[s]
        assert abs(g["taken"].sum() - target[s]) <= 1
    assert (out["taken"] <= 3 * out["size"]).all()
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_meets_the_targets_of_small_sources(spark):
    rng = random.Random(3)
    sizes = {"a": [40_000], "b": [10], "c": [20, 1], "d": [33, 64, 31], "e": [5000] * 4}
    data = [(i, prose(rng, n), s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    out = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), shard_docs=2).collect()
    source = {i: s for i, _, s in data}
    for s in sizes:
        mine = [r for r in out if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
        assert all(r["taken"] == r["copies"] * r["size"] + sum(b - a for a, b in r["spans"]) <= 3 * r["size"] for r in mine)
        assert all(0 <= a < b <= r["size"] for r in mine for a, b in r["spans"])


def test_sainte_lague_against_the_sequential_rule(spark):
    rng = random.Random(7)
    for _ in range(3):
        votes = [(i, float(rng.choice([0, 1, 3, 50, 1000, 33333]))) for i in range(12)]
        seats = rng.choice([0, 1, 7, 100, 997])
        df = spark.createDataFrame(votes, "id long, v double").withColumn("n", F.lit(seats).cast("long"))
        got = {r["id"]: r["q"] for r in mixing.sainte_lague(df, [], ["id"], "v", "n", "q").collect()}
        want = dict.fromkeys(got, 0)
        for _ in range(seats if sum(v for _, v in votes) else 0):
            best = max((i for i, v in votes if v), key=lambda i: (votes[i][1] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == want


def test_quality_statistics(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["a b c", "x #*$ y", "", " ", "a b c d a b c", "Zz|<>&% é"]) for _ in range(rng.randrange(12))) for _ in range(120)] + ODD
    out = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, texts, score="clash"), None).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered))
        assert tuple(out[i][c] for c in quality_rules.BASE) == want, t
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert out[i]["base_failed"] == failed and out[i]["kept"] == (not failed)


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] + 0.1 * rng.normal(size=3000) < 0.7)).astype(float)
    m = quality_rules.fit(x, y, [-1, -1, 0])
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.93
    grid = np.linspace(0, 1, 101)
    for j in (0, 1):
        for _ in range(20):
            rowsx = np.tile(rng.uniform(0, 1, 3), (101, 1))
            rowsx[:, j] = grid
            assert (np.diff(m.score(rowsx)) <= 1e-12).all()


def test_resampling(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["junk", "spam", "alpha"]) for _ in range(60)) for _ in range(50)]
    df = frame(spark, good + bad + ODD, kept="clash")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 200, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in resampling.resample(df, labels, fraction=0.7).collect()}
    assert sum(r["kept"] for r in out.values()) == round(0.7 * len(out))
    keys = sorted((r["key"] for r in out.values()), reverse=True)
    assert min(r["key"] for r in out.values() if r["kept"]) == keys[round(0.7 * len(out)) - 1]
    assert np.mean([out[i]["kept"] for i in range(150)]) > 0.9 and np.mean([out[i]["kept"] for i in range(150, 200)]) < 0.2
    assert all(r["kept"] for r in resampling.resample(df, labels.limit(0)).collect())
    assert resampling.resample(df.limit(0), labels).count() == 0


def walk(m, x):
    """Trees scored node by node."""
    total = m.bias
    for root in m.roots:
        at = root
        while m.left[at] != at:
            at = m.left[at] if x[m.feature[at]] <= m.threshold[at] else m.right[at]
        total += m.value[at]
    return 1 / (1 + np.exp(-total))


def test_quality_training_and_scores(spark):
    """Fit through Spark on odd labels; scores equal a walk of the trees over brute-force features."""
    rng = random.Random(11)
    make = lambda bad: " ".join(("#$%" if bad and rng.random() < 0.3 else "") + rng.choice(["ab", "cde", "fghij", "X!"]) for _ in range(rng.randrange(60, 140)))
    texts = [make(i % 3 == 0) for i in range(150)] + ["a b " * 250_000, None, ""]
    df = frame(spark, texts, score="clash").unionByName(frame(spark, texts[:2], score="clash"))
    labels = [(i, int(i % 3 != 0)) for i in range(120)] + [(5, None), (None, 1), (0, 0), (0, 0), (999, 1)]
    model = quality_rules.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model is not None
    out = quality_rules.judge(df, model).collect()
    assert len(out) == len(texts) + 2
    found = {r["doc_id"]: r for r in out}
    from corpusloom.llm.words import slices

    import pyarrow as pa

    for i in list(range(0, 150, 7)) + [150, 151]:
        t = next(slices(pa.record_batch({"text": [texts[i] or ""]})))
        x = quality_rules.features(quality_rules.document_stats(t))[0]
        assert found[i]["score"] == pytest.approx(walk(model, x), abs=1e-12)
        assert found[i]["kept"] == (not found[i]["base_failed"] and found[i]["score"] >= 0.5)
    held = [i for i in range(120, 150)]
    assert np.mean([(found[i]["score"] >= 0.5) == (i % 3 != 0) for i in held]) > 0.9
    one = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert quality_rules.train(df, one) is None and quality_rules.train(df, one.limit(0)) is None
    assert quality_rules.train(df.limit(0), one) is None
    assert quality_rules.judge(df.limit(0), model).count() == 0


def spark_xxhash64(seed, doc_id, text):
    """xxhash64 over an int, a long and a string, each the next one's seed; nulls are passed over."""
    import xxhash

    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), h)
    return h if text is None else xxhash.xxh64_intdigest(text.encode(), h)


def test_resampling_against_brute_force(spark):
    """Ratios by counting word n-grams in dictionaries, noise by another hash, top-k by sorting."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"][: 2 + i % 4]) for _ in range(rng.randrange(1, 30))) for i in range(90)]
    texts += ["beta " * 150_000, "x" * 700_000, None, "", " \n"]  # longer than a slice, one word, no words
    data = rows(texts) + rows(texts)[:5]  # repeated rows
    df = spark.createDataFrame(data, DOCS)
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 80, 2)] + [(4, 0, 0), (None, 1, 0), (6, None, 0), (8, 1, None), (999, 1, 0)]
    marks = {}
    for i, q, x in labels:
        if i is not None:
            a, b = marks.get(i, (1, 0))
            marks[i] = (min(a, q or 0), max(b, x or 0))
    good = {i for i, (q, x) in marks.items() if q == 1 and x != 1}
    grams = lambda t: [*words(t), *zip(words(t), words(t)[1:], strict=False)]
    raw, target = collections.Counter(), collections.Counter()
    for i, t, *_ in data:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    size = resampling.BUCKETS
    ratio = {g: np.log((target[g] + 1) / (target.total() + size)) - np.log((raw[g] + 1) / (raw.total() + size)) for g in raw}
    want = []
    for i, t, *_ in data:
        w = sum(ratio[g] for g in grams(t)) if words(t) else resampling.LOWEST
        unit = ((spark_xxhash64(resampling.SEED, i, t) & ((1 << 52) - 1)) + 0.5) / (1 << 52)
        want.append((i, w, w - np.log(-np.log(unit))))
    for fraction in (0.4, 0.97, 1.0):
        out = resampling.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fraction=fraction).collect()
        found = sorted((r["doc_id"], r["weight"]) for r in out)
        assert [f[0] for f in found] == sorted(w[0] for w in want)
        assert [f[1] for f in found] == pytest.approx([w[1] for w in sorted(want)], rel=1e-9, abs=1e-6)
        last = sorted((w[2] for w in want), reverse=True)[round(fraction * len(want)) - 1]
        kept = collections.Counter(r["doc_id"] for r in out if r["kept"])
        assert kept == collections.Counter(w[0] for w in want if w[2] >= last)


def test_top_k_cuts_bins_until_few_rows_are_left(spark):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) for _ in range(500)], [1.0] * 40 + [2.0] * 40, [rng.choice([0.0, 1e-9, 5.0, 1e6]) for _ in range(200)] + [resampling.LOWEST] * 50):
        df = spark.createDataFrame([(v,) for v in values], "key double")
        for k in (0, 1, 39, 41, len(values) - 3, len(values), len(values) + 9):
            kept = sorted(r["key"] for r in resampling.top_k(df, k, bins=8, few=4).where("kept").collect())
            last = sorted(values, reverse=True)[min(k, len(values)) - 1] if k else np.inf
            assert kept == sorted(v for v in values if v >= last)


def test_resampling_counts_every_good_document(spark):
    n = 20_300  # more than the 20000 the target model once held
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "alpha beta").otherwise("gamma delta").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for block_rows in (1 << 20, 6000):
        out = resampling.resample(docs, labels, fraction=1.0, block_rows=block_rows)
        # target and raw are the same documents, so no document has any weight
        assert out.agg(F.max(F.abs("weight"))).first()[0] == 0


def test_chat_query_equals_its_sql_on_odd_rows(spark, tmp_path):
    """Backslashes at ends and inside, controls, line feeds in roles, nulls, long texts: the query and OP5_SQL agree."""
    import duckdb

    texts = ["a\\", "a\\\\", "\\", "a\\b", "</s>", "x<s>\\", "[INST", "a\n", None, "", "\\n\\", "<|im_end|", "é🙂\\", "w " * 200_000 + "\\"]
    roles = ["user", "assistant", "a\nb", "r\\", None, "<s>"]
    rows = [(i // 3, i % 3, roles[i % len(roles)], t) for i, t in enumerate(texts * 3)] + [(90, None, "assistant", "z\\")] * 2
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/d/conversations.parquet")
    got = chat.op5_chat_formatting(spark, f"{tmp_path}/d").toPandas()
    c = duckdb.connect()
    c.sql(f"create view conversations as from '{tmp_path}/d/conversations.parquet/*.parquet'")
    want = c.sql(chat.OP5_SQL).df()
    assert got["round_trip"].all()
    key = lambda df: sorted(tuple(int(v) if not isinstance(v, str) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)
