"""The operators for training data: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and columns of clashing names."""

from __future__ import annotations

import collections
import hashlib
import importlib.util
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldoc.llm import bpe, chat, decontaminate, hashing, licenses, near_dups, nearest, passages, quality, queries, secrets, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


needs_tokenizers = pytest.mark.skipif(importlib.util.find_spec("tokenizers") is None, reason="no tokenizers")


def words(t):
    return WORD.findall((t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, one id with two texts, a long text; a column of a clashing name."""
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, " .,;\n", "en", "s", 5), (4, "All rights RESERVED", "en", "s", 1), (4, "All rights RESERVED", "en", "s", 1), (5, "CC-BY é", "en", "s", 1), (5, "other words", "en", "s", 1), (None, "no id here", "en", "s", 1), (6, prose(60_000, 1), "en", "s", 1), (7, "x" * 600_000, "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("words", F.lit("w")).withColumn("keep", F.lit("k")).withColumn("node", F.lit(5))


def test_word_hashes_follow_words():
    import pyarrow as pa

    r = random.Random(3)
    sample = ["Ab cd, é x", "", None, "ab"] + ["".join(r.choice("ab É.,Z9") for _ in range(r.randint(0, 50))) for _ in range(500)] + ["ab cd " * 100_000, "a" * 600_000 + " b"]
    names, got = {}, [[] for _ in sample]
    for lo, _, data, rows, hashes, starts, ends in hashing.word_chunks(pa.array(sample)):
        for i, h, a, b in zip(rows, hashes, starts, ends):
            w = bytes(data[a:b]).lower().decode()
            got[lo + i].append(w)
            assert names.setdefault(h, w) == w
    assert got == [words(t) for t in sample] and len(names) == len(set(names.values()))


def test_stored_tables_are_swept(spark):
    import os

    from veldoc.llm import common

    df = common.stored(spark.range(5), "swept")
    path = common._STORED[-1]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    common.sweep(spark)
    assert not os.path.isdir(path.removeprefix("file:")) and not common._STORED


# nearest


def brute_nearest(rows, asks, k):
    out = {}
    for q, v in rows:
        if asks(q):
            scores = [(-sum(float(a) * float(b) for a, b in zip(v, w)), i) for i, w in rows if i != q]
            out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for x in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    assert dict(got) == brute_nearest(rows, lambda i: i % 20 == 0, 20)


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (20, [0.5, 0.5]), (7, [1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit(9)).withColumn("id", F.lit("x"))
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in nearest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 0.5), (20, 1, 1, 1.0), (20, 2, 0, 0.5)]
    assert nearest.nearest(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("dim, n", [(1536, 260), (16, 700)])
def test_tiles_hold_the_best(dim, n, k=5):
    """Bounds of a tile hold the products, and few candidates stay beside the best."""
    r = np.random.default_rng(2)
    a, b = r.normal(size=(50, dim)), r.normal(size=(n, dim)) * r.uniform(0.1, 10, size=(n, 1))
    blocks = []
    for v, asks in ((a, False), (b, False)):
        row = nearest._pack(__import__("pandas").DataFrame({"id": np.arange(len(v)), "key": np.arange(len(v)), "v": list(v), "dim": dim, "block": 0, "asks": asks})).iloc[0]
        blocks.append(nearest.Block(dim, *row[list(nearest._PACKED)]))
    assert (nearest.products(blocks[0].high, blocks[1].high) == blocks[0].high.astype(int) @ blocks[1].high.astype(int).T).all()
    true = a @ b.T
    for i, _, top, bottom, j in nearest.tile_best(*blocks, k):
        assert (top >= true[i, j]).all() and (bottom <= true[i, j]).all() and len(j) <= k + 3
        best = [x for x in np.argsort(-true[i]) if x != i][:k]
        assert set(best) <= set(j.tolist())


def test_nearest_of_many_blocks(spark, monkeypatch):
    """Many tiles and merges, repeated ids with other vectors, repeated rows, more equal vectors than places."""
    for name, value in (("CANDIDATES", 40), ("QUERIES", 20), ("MERGE", 3)):
        monkeypatch.setattr(nearest, name, value)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=12).astype(np.float32).tolist()) for i in range(500)]
    rows += [(700 + i, rows[40][1]) for i in range(90)]
    df = spark.createDataFrame([*rows, *rows[:50], *[rows[7]] * 300], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for x in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    assert dict(got) == brute_nearest(rows, lambda i: i % 20 == 0, 20)


def test_tiles_are_neither_broadcast_nor_repeated(spark, monkeypatch):
    for name, value in (("CANDIDATES", 64), ("QUERIES", 8)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    plan = nearest.nearest(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: re.search("[A-Za-z]", line).start()
    at = max(i for i, line in enumerate(plan) if "MapInPandas" in line)
    below = list(itertools.takewhile(lambda line: not re.search("[A-Za-z]", line) or depth(line) > depth(plan[at]), plan[at + 1 :]))
    assert below and not [line for line in below if "Broadcast" in line or "Generate" in line]


@pytest.mark.parametrize("held", [1, 4000])
def test_nearest_of_many_parts(spark, monkeypatch, held):
    for name, value in (("CANDIDATES", 32), ("QUERIES", 8), ("STRIP", 3), ("MERGE", 3), ("HELD", held)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(400)]
    df, got = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), collections.defaultdict(list)
    for x in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    assert dict(got) == brute_nearest(rows, lambda i: i % 20 == 0, 20)


def test_nearest_of_extreme_vectors(spark):
    rows = [(0, [1e200, 3.0]), (20, [5e-324, 0.0]), (1, [1e-200, 1.0]), (2, [5e-324, 5e-324]), (3, [1e300, -1.0]), (4, [-1e300, 1.0]), (5, [3.0, 1.0]), (6, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in nearest.nearest(df, F.col("vec_id") % 20 == 0, 4).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    assert dict(got) == brute_nearest(rows, lambda i: i % 20 == 0, 4)


# chats

HARD = ["", "plain", "\\### Assistant: </turn> ok", "###", "</turn>", "\\", "\\\\###\\</turn>", "### user:\nx</turn>\n", "é🎉\n\n", "\\n", "a:b"]


def test_chats_are_read_back():
    r = random.Random(5)
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "system", "", "a:\nb", "\\n", "###x</turn>"]), "".join(r.choice(HARD) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(0, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_chats(spark):
    import public_tokenizers

    rows = [(1, 1, "assistant", "b\\### c"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, 1, None, "x"), (3, 0, "assistant", "é🎉" * 50), (None, 0, "user", "q"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "long " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0)).withColumn("loss", F.lit(0))
    got = {r["conv_id"]: r for r in chat.format_chats(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}

    def loss(r):
        offsets = np.stack([r["token_starts"], r["token_ends"]], axis=1)
        return chat.loss_text(r["formatted"], offsets, np.array(r["loss"]), list(zip(r["span_starts"], r["span_ends"])))

    assert loss(got[1]) == ["b\\### c"] and loss(got[2]) == [""] and loss(got[3]) == ["é🎉" * 50] and loss(got[4]) == ["same", "same"] and loss(got[5]) == ["long " * 30_000] and loss(got[None]) == []
    assert chat.parse(got[2]["formatted"]) == [("assistant", ""), ("", "x")]
    assert chat.format_chats(df.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_op2_on_table(spark, sf):
    got = {r["conv_id"]: r for r in chat.op2_chat(spark, sf).collect()}
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [("user", HARD[2]), ("assistant", HARD[2])]
    assert set(got) == set(turns)
    for c, ts in turns.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)), len(loss), sha(loss))


# licenses


def test_op3_on_table(spark, sf, texts):
    for r in licenses.op3_licenses(spark, sf).collect():
        w, starts, labels = words(texts[r["doc_id"]]), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licenses_of_the_method(spark, odd):
    mit = licenses.TEMPLATES["mit"].split()
    rows = [(1, " ".join(mit)), (2, "intro " + " ".join(mit[:12] + ["really"] + mit[12:]) + " end"), (3, " ".join(mit[:6])), (4, "cc by cc by")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["n_base"] == 0
    assert got[2]["labels"] == "mit" and 0.6 <= got[2]["score"] < 1 and [(s["start"], s["end"]) for s in got[2]["spans"]] == [(1, len(mit) + 2)]
    assert got[3]["labels"] == "" and got[4]["n_base"] == 2 and got[4]["last_word"] == 2
    out = licenses.scan_licenses(odd).collect()
    assert len(out) == 10 and all(r["row"] == 1 and r["words"] == "w" for r in out)
    assert sorted((r["doc_id"], r["n_base"]) for r in out if r["n_base"]) == [(4, 1), (4, 1), (5, 1)]
    assert licenses.scan_licenses(odd.where("false")).count() == 0


# URLs


def brute_url(url, day, entries):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?:[^/?#]*/([^/?#]+))?", url or "")
    if not m or day is None:
        return (None, "allow")
    host, step = re.sub(r"^www\.", "", m[1].lower()), (m[2] or "").lower()
    labels = host.split(".")
    rules = ([f"{host}/{step}"] if step else []) + [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
    for rule in rules:
        held = [(d, seq, a or "allow") for r, a, d, seq in entries if r == rule and d is not None and d <= day]
        if held:
            return (rule, max(held)[2])
    return (None, "allow")


def test_urls_equal_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "example.com", "spam.org", "x.y.z.net"]
    captures = [(i, r.choice([f"http://{r.choice(['', 'www.', 'WWW.'])}{r.choice(hosts)}/{r.choice(['en', 'de', ''])}/p", None, "", "nonsense"]), r.choice([None, *range(-5, 100, 7)])) for i in range(400)]
    captures += captures[:5]
    rules = ["a.example.com", "example.com", "spam.org", "spam.org/en", "z.net", None]
    entries = [(r.choice(rules), r.choice(["block", "allow", None]), r.choice([None, *range(0, 90, 3)]), i) for i in range(150)]
    c = spark.createDataFrame(captures, "page_id long, url string, day int").withColumn("k", F.lit(0)).withColumn("best", F.lit(0))
    e = spark.createDataFrame(entries, "rule string, action string, day int, seq long")
    got = urls.filter_urls(c, e).collect()
    assert len(got) == len(captures)
    for x in got:
        assert (x["rule"], x["action"]) == brute_url(x["url"], x["day"], entries)
    assert urls.filter_urls(c.where("false"), e).count() == 0
    assert {x["action"] for x in urls.filter_urls(c, e.where("false")).collect()} == {"allow"}


# decontamination


def brute_hits(text, items):
    w = words(text)
    hit, ids = set(), set()
    for i, t in items:
        b = words(t)
        n = min(10, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_decontamination(spark, odd):
    items = [(1, prose(30, 10)), (2, prose(14, 11)), (3, "short Item of five"), (4, None), (5, "..."), (6, "w w w w w w w w w w w w"), (1, prose(12, 12))]
    b = prose(30, 10).split()
    rows = [(1, " ".join(["pre", *b[5:20], "post", *b[:9]])), (2, "SHORT item, of five! short item of five"), (3, " ".join(b[:9])), (4, "w " * 13), (5, None), (6, ""), (7, " ".join(b)), (7, " ".join(b)), (8, prose(12, 12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cands", F.lit(0)).withColumn("hits", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_benchmark(docs, bench).collect()
    assert sorted((r["doc_id"], (r["n_words"], r["n_hit"], r["hit_items"])) for r in got) == sorted((i, brute_hits(t, items)) for i, t in rows)
    out = decontaminate.find_benchmark(odd, bench).collect()
    assert len(out) == 10 and {r["n_hit"] for r in out} == {0} and all(r["words"] == "w" for r in out)
    assert decontaminate.find_benchmark(docs.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_benchmark(docs, bench.where("false")).collect()} == {0}
    changed = b[:12] + ["extra"] + b[12:]
    near = decontaminate.near_benchmark(spark.createDataFrame([(1, " ".join(changed)), (2, prose(40, 77))], "doc_id long, text string"), bench)
    assert {(r["id"], r["item_id"]) for r in near.collect()} == {(1, "1")}


# quality


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = [(i, prose(80, i, 500) + ".", "en", "a", 1) for i in range(60)]
    bad = [(100 + i, " | ".join(prose(80, i, 500).upper().split()) + "!!", "en", "b", 1) for i in range(60)]
    toxic = [(200 + i, prose(80, i, 500) + " vile vile scum. " + prose(30, i), "en", "a", 1) for i in range(60)]
    train = spark.createDataFrame(good[:40] + bad[:40] + toxic[:40], DOCS)
    told = spark.createDataFrame([(i, int(not 100 <= i < 200), int(i >= 200)) for i, *_ in good[:40] + bad[:40] + toxic[:40]] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(train, told)
    held = spark.createDataFrame(good[40:] + bad[40:] + toxic[40:], DOCS).withColumn("row_", F.lit(1)).withColumn("host", F.lit("h")).withColumn("poor", F.lit("p"))
    got = {r["doc_id"]: r for r in quality.judge(held, model).collect()}
    assert len(got) == 60 and all(r["text"] for r in got.values())
    right = sum(r["keep"] == (i < 100) for i, r in got.items())
    assert right >= 57 and all(got[i]["keep"] for i in range(40, 60))
    assert quality.judge(docs, quality.fit(docs, labels.where("false"))).where("not keep").count() == 0


def test_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 400 + [("other", "q", 0.1)] * 400 + [("tiny", "r", 0.95)]
    rates, base = quality.site_rates(spark.createDataFrame(rows, "host string, path string, bad double"))
    got = {r["host"]: r["path_rate"] for r in rates.collect()}
    assert got["big"] > 0.8 and got["other"] < 0.2 and base - 0.05 < got["tiny"] < 0.7


def brute_rates(rows):
    """Shrunken shares by plain sums: {(host, path): (host_rate, path_rate)} and the global share."""
    clip = lambda x: min(1 - quality.EPS, max(quality.EPS, x))
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for host, path, bad in rows:
        paths[host, path].append(bad)
        hosts[host].append(bad)
    base = clip(sum(bad for *_, bad in rows) / len(rows))

    def strength(groups):
        n = sum(len(g) for g, _ in groups)
        spread = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in groups) / n
        noise, level = sum(m * (1 - m) for _, m in groups) / n, sum(len(g) * m * (1 - m) for g, m in groups) / n
        return min(1e6, max(10.0, level / max(spread - noise, 1e-9)))

    k = strength([(g, base) for g in hosts.values()])
    host_rate = {h: clip((sum(g) + k * base) / (len(g) + k)) for h, g in hosts.items()}
    k = strength([(g, host_rate[h]) for (h, _), g in paths.items()])
    return {(h, p): (host_rate[h], clip((sum(g) + k * host_rate[h]) / (len(g) + k))) for (h, p), g in paths.items()}, base


def test_rates_equal_brute_force(spark):
    r = random.Random(15)
    lean = {h: r.random() for h in "abcdefgh"}
    rows = [(h, r.choice("xyz"), min(1.0, max(0.0, r.gauss(lean[h], 0.2)))) for h in r.choices("abcdefgh", [400, 90, 20, 5, 1, 1, 30, 60], k=900)]
    need, base = brute_rates(rows)
    rates, got_base = quality.site_rates(spark.createDataFrame(rows, "host string, path string, bad double"))
    got = {(x["host"], x["path"]): (x["host_rate"], x["path_rate"]) for x in rates.collect()}
    assert got_base == pytest.approx(base) and got.keys() == need.keys()
    for key in need:
        assert got[key] == pytest.approx(need[key])


def test_op6_equals_brute_force(spark, sf):
    """The query's chances from the evidence of the texts and the rates by plain sums."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    keyed = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path"), F.col("text").alias("text_in"))
    own = quality._evidence(keyed, model, ["doc_id", "host", "path"]).collect()
    chance = lambda x: 1 / (1 + np.exp(-x))
    odds = lambda p: np.log(p / (1 - p))
    rates, base = brute_rates([(x["host"], x["path"], 1 - (1 - chance(x["poor_"])) * (1 - chance(x["toxic_"]))) for x in own])
    got = {x["doc_id"]: x for x in quality.op6_quality(spark, sf).collect()}
    assert len(got) == len(own)
    for x in own:
        host_rate, path_rate = rates[x["host"], x["path"]]
        shift = min(quality.MOST_SHIFT, max(-quality.MOST_SHIFT, odds(path_rate) - odds(base)))
        poor, toxic = chance(x["poor_"] + shift), chance(x["toxic_"] + shift)
        y = got[x["doc_id"]]
        assert (y["poor"], y["toxic"], y["host_rate"], y["path_rate"]) == pytest.approx((poor, toxic, host_rate, path_rate), rel=1e-6, abs=1e-9)
        assert y["keep"] == (y["bad"] < 0.5) and y["bad"] == pytest.approx(1 - (1 - poor) * (1 - toxic))


def test_fit_of_contradicting_labels(spark):
    """Labels in either order, repeated rows and one very long text: the same model, of the worst labels."""
    r = random.Random(3)
    docs = [(i, f"{'bad awful' if i % 3 == 0 else 'fine good'} {prose(30, i)}") for i in range(60)] * 3 + [(99, "word " * 200_000)]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(3, 1, 0), (6, 1, 1), (99, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    models = []
    for _ in range(2):
        r.shuffle(labels)
        models.append(quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert np.array_equal(models[0].poor.weights, models[1].poor.weights) and np.array_equal(models[0].toxic.words, models[1].toxic.words)


def test_quality_odd(spark, odd, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.judge(odd, model).collect()
    assert len(out) == 10 and all(isinstance(r["keep"], bool) and r["node"] == 5 for r in out)
    assert quality.judge(odd.where("false"), model).count() == 0


# passages


def brute_shared(rows, n):
    """Ids with a run of n words that another text has too, or a whole text of so many words under another id."""
    at = collections.defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - n + 1):
            at[tuple(w[p : p + n])].add(i)
    return set().union(*[v for v in at.values() if len(v) > 1]) if at else set()


def test_passages(spark):
    rows = [(i, prose(200, i)) for i in range(20)]
    shared = prose(60, 999)
    rows += [(100 + i, f"{prose(90, 50 + i)} {shared} {prose(40, 80 + i)}") for i in range(30)]
    fuzzy = shared.split()
    fuzzy[20] = "other"
    fuzzy[41:43] = []
    rows += [(200, f"{prose(30, 300)} {' '.join(fuzzy)} {prose(30, 301)}"), (300, rows[0][1]), (301, rows[0][1]), (400, prose(30, 999)), (401, None), (402, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("pos", F.lit(1))
    got = passages.shared_passages(df).collect()
    ids = {r["doc_id"] for r in got}
    assert brute_shared(rows, 50) <= ids and ids == brute_shared(rows, 50) | {200}
    text = dict(rows)
    for r in got:
        assert r["end"] - r["start"] >= 50 and r["doc_id"] != r["other_id"]
        same = collections.Counter(words(text[r["doc_id"]])[r["start"] : r["end"]]) & collections.Counter(words(text[r["other_id"]])[r["other_start"] : r["other_end"]])
        assert same.total() >= r["n_same"] >= 0.8 * (r["end"] - r["start"])
    assert passages.shared_passages(df.where("false")).count() == 0


def test_passages_of_common_lines(spark):
    r = random.Random(5)
    lines = [prose(30, 700 + i, 100_000) for i in range(40)]
    rows = [(i, f"{prose(20, 1000 + i)} {r.choice(lines)} {r.choice(lines)} {prose(20, 2000 + i)}") for i in range(300)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    need = brute_shared(rows, 50)
    assert len(need) > 30 and need <= {x["doc_id"] for x in got}
    text = {i: words(t) for i, t in rows}
    for x in got:
        same = collections.Counter(text[x["doc_id"]][x["start"] : x["end"]]) & collections.Counter(text[x["other_id"]][x["other_start"] : x["other_end"]])
        assert same.total() >= x["n_same"] >= 0.8 * (x["end"] - x["start"]) >= 40
    assert len(got) == len({tuple(x) for x in got})


def test_passages_lose_no_link_of_equal_words(spark):
    """Pairs of texts with 50 equal words are just those that meet in rows of equal words, whatever text stands for a passage."""
    r, rows = random.Random(8), []
    for i in range(60):
        body = prose(130, 500 + i % 3).split()
        for at in r.sample(range(130), r.randrange(4)):
            body[at] = f"changed{i}x{at}"
        rows.append((i, f"{prose(30, 100 + i)} {' '.join(body[: r.randrange(90, 131)])} {prose(20, 200 + i)}"))
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len({tuple(x) for x in got})
    at, text = collections.defaultdict(set), {i: words(t) for i, t in rows}
    for i, w in text.items():
        for p in range(len(w) - 49):
            at[tuple(w[p : p + 50])].add(i)
    need = {(a, b) for v in at.values() for a in v for b in v if a < b}
    equal = [x for x in got if x["n_same"] == x["end"] - x["start"] == x["other_end"] - x["other_start"]]
    assert all(text[x["doc_id"]][x["start"] : x["end"]] == text[x["other_id"]][x["other_start"] : x["other_end"]] for x in equal)
    by = collections.defaultdict(list)
    for x in equal:
        by[x["other_id"]].append((x["doc_id"], x["other_start"], x["other_end"]))
    met = {(x["doc_id"], x["other_id"]) for x in equal}
    met |= {(a[0], b[0]) for v in by.values() for a in v for b in v if min(a[2], b[2]) - max(a[1], b[1]) >= 50}
    assert len(need) > 300 and {(a, b) for a, b in met if a < b} == need


def edited(text, share, seed, evenly=False):
    """A passage with about `share` of its words changed: mostly replaced, some dropped or put in."""
    r, out = random.Random(seed), text.split()
    n = round(share * len(out))
    for k, at in sorted(enumerate(range(0, len(out), max(1, len(out) // n)) if evenly else r.sample(range(len(out)), n)), key=lambda x: -x[1]):
        how = "replace" if evenly or k % 5 else r.choice(["drop", "add"])
        out[at : at + (how != "add")] = [] if how == "drop" else [f"new{r.randrange(10**9)}"]
    return " ".join(out)


def fuzzy_recall(spark, share, evenly=False, n=150, size=80):
    """Share of pairs of a passage and its edited copy, each in a text of its own, that are found."""
    rows = []
    for i in range(n):
        passage = prose(size, 9000 + i, 30_000)
        for k, t in enumerate((passage, edited(passage, share, i, evenly))):
            rows.append((2 * i + k, f"{prose(60, 20_000 + 2 * i + k, 30_000)} {t} {prose(50, 40_000 + 2 * i + k, 30_000)}"))
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x["doc_id"] // 2 == x["other_id"] // 2 for x in got)
    return len({x["doc_id"] // 2 for x in got}) / n


@pytest.mark.parametrize("share, least", [(0.05, 1.0), (0.1, 0.98), (0.15, 0.93)])
def test_passages_with_changes(spark, share, least):
    assert fuzzy_recall(spark, share) >= least


@pytest.mark.parametrize("compared", [1 << 20, 50])
def test_passages_lose_no_link_with_changes(spark, monkeypatch, compared):
    """Any two texts with a passage around a seed of theirs are joined by passages, one after the other, at a seed of it."""
    r = random.Random(compared)
    monkeypatch.setattr(passages, "COMPARED", compared)
    pool = [prose(r.choice([15, 25, 45, 60, 90]), 100 + i, 60).split() for i in range(9)]

    def changed(part):
        out, rate = [], r.choice([0, 0.04, 0.1, 0.15])
        for w in part:
            x = r.random()
            out += [w] if x >= rate else [f"c{r.randrange(10**6)}"] if x < 0.7 * rate else [] if x < 0.85 * rate else [w, f"c{r.randrange(10**6)}"]
        return out

    texts = {i: [w for part in r.sample(pool, 3) for w in [*prose(r.randrange(12), 1000 + r.randrange(10**6), 300).split(), *changed(part)]] for i in range(90)}
    got = passages.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    paired, seeds, flat = collections.defaultdict(list), collections.defaultdict(list), []
    for x in got:
        paired[x["doc_id"]].append((x["other_id"], x["start"], x["end"], x["other_start"]))
    batch, base = pa.array([" ".join(t) for t in texts.values()]), {}
    for lo, _, _, owner, hashes, _, _ in hashing.word_chunks(batch):
        value, at = passages.minimizers(hashes, owner)
        heads = np.searchsorted(owner, np.arange(owner[-1] + 1))
        for v, a in zip(value.tolist(), at.tolist()):
            i = lo + int(owner[a])
            if len(texts[i]) >= passages.MIN_WORDS:
                seeds[v].append((i, a - int(heads[owner[a]])))
        base |= {lo + k: len(flat) + int(h) for k, h in enumerate(heads)}
        flat += hashes.astype(np.uint32).tolist()
    asked = [(i, p, j, q) for places in seeds.values() for (i, p), (j, q) in itertools.combinations(places, 2) if i != j]
    K, n, at = passages.K, {i: len(t) for i, t in texts.items()}, lambda f: np.array([f(*x) for x in asked])
    side = lambda *fs: passages._extend_all(np.array(flat, np.uint32), *map(at, fs[:-1]), fs[-1])
    a, b, same = side(lambda i, p, j, q: base[i] + p - 1, lambda i, p, j, q: p, lambda i, p, j, q: base[j] + q - 1, lambda i, p, j, q: q, -1)
    c, d, more = side(lambda i, p, j, q: base[i] + p + K, lambda i, p, j, q: n[i] - p - K, lambda i, p, j, q: base[j] + q + K, lambda i, p, j, q: n[j] - q - K, 1)
    short, long = np.minimum(a + c, b + d) + K, np.maximum(a + c, b + d) + K
    wanted = np.flatnonzero((short >= passages.MIN_WORDS) & (same + more + K >= passages.MIN_IDENTITY * long)).tolist()

    def reached(i, p, far=5):
        seen, waiting = set(), [(i, p)]
        while waiting:
            i, p = waiting.pop()
            if (i, p // far) not in seen:
                seen.add((i, p // far))
                waiting += [(o, there + p - start) for o, start, end, there in paired[i] if start <= p + far and p + K <= end + far]
        return {(i, p + d) for i, p in seen for d in range(-2, 3)}

    reach = {x: reached(*x) for places in seeds.values() for x in places}
    met = collections.defaultdict(list)
    for i, p, j, q in (asked[k] for k in wanted):
        met[i, j] += [p] if (j, q // 5) in reach[i, p] else []
    lost = [asked[k] for k in wanted for i, p, j, _ in [asked[k]] if not any(p - a[k] <= x <= p + c[k] for x in met[i, j])]
    assert len(wanted) > 2000 and not lost, (len(lost), len(wanted), lost[:5])


def test_passages_of_repeated_rows(spark):
    line = prose(12, 4, 30_000)
    rows = [(1, prose(80, 1))] * 500 + [(2, prose(80, 1))] * 300 + [(k, f"{line} " * (8 + k)) for k in range(3, 7)] + [(None, None), (None, ""), (None, prose(80, 1))]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["other_id"]) for x in got if x["doc_id"] < 3) == [(1, 2), (2, 1)]
    assert {x["doc_id"] for x in got} == set(range(1, 7)) and len(got) < 40


def test_chaining():
    assert passages.chain([0, 10, 20, 25], [100, 110, 120, 5]) == [[0, 1, 2], [3]]
    assert passages.chain([0, 500], [0, 500]) == [[0], [1]]
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([a[:50], np.array([999], np.uint32), a[50:]])
    assert passages.align(a, 0, b, 0, [0, 40, 0, 60, 90, -1]) == (0, 100, 0, 101, 100)


def plain_align(a, a0, b, b0, runs):
    """One chain, word by word, as `align_all` should do it."""

    def extend(a, b):
        i = j = same = 0
        straight = True
        while i < len(a) and j < len(b):
            best = (0, 0, 0, 0)
            for d in [0] if straight else [d for d in range(-passages.SKIP, passages.SKIP + 1) if d]:
                p, q, score, n = max(d, 0), max(-d, 0), -2 * abs(d), 0
                for k in range(min(len(a) - i - p, len(b) - j - q, 10**9 if straight else passages.REACH)):
                    hit = a[i + p + k] == b[j + q + k]
                    score, n = score + (1 if hit else -2), n + hit
                    if score > best[0]:
                        best = (score, p + k + 1, q + k + 1, n)
            if not best[0] and not straight:
                break
            i, j, same, straight = i + best[1], j + best[2], same + best[3], not straight
        return i, j, same

    def hit(place, diagonal):
        return a0 <= place < a0 + len(a) and b0 <= place - diagonal < b0 + len(b) and a[place - a0] == b[place - diagonal - b0]

    lo, hi, rlo, rhi = runs[0], runs[-2], runs[0] - runs[2], runs[-2] - runs[-1]
    left, rleft, same = extend(a[: lo - a0][::-1], b[: rlo - b0][::-1])
    right, rright, more = extend(a[hi - a0 :], b[rhi - b0 :])
    same, at = same + more, lo
    for i in range(0, len(runs), 3):
        start, end, diagonal = max(runs[i], at), runs[i + 1], runs[i + 2]
        if i:
            same += max(sum(hit(w, runs[i - 1]) for w in range(at, cut)) + sum(hit(w, diagonal) for w in range(cut, start)) for cut in range(at, start + 1))
        same += sum(hit(w, diagonal) for w in range(start, end))
        at = max(at, end)
    return lo - left, hi + right, rlo - rleft, rhi + rright, same


def changed_pairs(r, n):
    """Pairs of word lists with changes, and clusters of their chains."""
    for _ in range(n):
        base, rate, b = [r.randrange(50_000) for _ in range(300)], r.choice([0, 0.02, 0.1, 0.2, 0.3]), []
        for w in base:
            x = r.random() / max(rate, 1e-9)
            b += [r.randrange(50_000)] if x < 0.7 else [] if x < 0.85 else [w, r.randrange(50_000)] if x < 1 else [w]
        a = base[r.randrange(80) : r.randrange(150, 300)] + base[:40] * r.randrange(3)
        at = {tuple(b[j : j + 5]): j for j in range(len(b) - 4)}
        found = [(i, at[k]) for i in range(len(a) - 4) if (k := tuple(a[i : i + 5])) in at and r.random() < 0.3]
        pos, ref = [p for p, _ in found], [q for _, q in found]
        yield a, b, pos, ref, passages._clusters([passages._runs(pos, ref, one) for one in passages.chain(pos, ref)])


def test_alignments_of_many_chains_are_those_of_each():
    words, sides, chains, want = [], [], [], []
    for a, b, _, _, clusters in changed_pairs(random.Random(3), 60):
        for low, high, rlow, rhigh, runs in clusters:
            a0, b0 = max(0, low - 64), max(0, rlow - 64)
            x, y = a[a0 : high + 64], b[b0 : rhigh + 64]
            while runs:
                chains.append(runs[1 : runs[0] + 1])
                runs = runs[runs[0] + 1 :]
                sides.append([len(words), len(x), a0, len(words) + len(x), len(y), b0])
                want.append(plain_align(x, a0, y, b0, chains[-1]))
            words += x + y
    assert len(want) > 100 and passages.align_all(np.array(words, np.uint32), np.array(sides), chains).tolist() == [list(w) for w in want]


def test_straight_chains_are_those_of_the_tree():
    r, columns, want = random.Random(4), [], []
    for pair in range(200):
        pos = ref = 0
        anchors = []
        for _ in range(r.randrange(1, 25)):
            gap = r.choice([1, 2, 5, 10, 11, 39, 40, 41, 60, 150, 300])
            pos, ref = pos + gap, ref + max(1, gap + r.choice([0] * 9 + [-2, 3, 30, 60]))
            anchors.append((pair, pos, ref, r.randrange(3), r.randrange(3)))
        columns += anchors
        _, p, q, left, right = (list(x) for x in zip(*anchors))
        kept = [c for c in passages.chain(p, q) if p[c[-1]] + passages.K - p[c[0]] >= passages.ENOUGH or left[c[0]] >= passages.AGREE or right[c[-1]] >= passages.AGREE]
        want += [(pair, *c) for c in passages._clusters([passages._runs(p, q, c) for c in kept])]
    pair, low, high, rlow, rhigh, offsets, runs = (x.tolist() for x in passages._straight(*np.array(columns).T))
    got = [(*x, runs[offsets[i] : offsets[i + 1]]) for i, x in enumerate(zip(pair, low, high, rlow, rhigh))]
    assert len(want) > 200 and got == want


def test_passages_of_many_chains_take_few_rounds(monkeypatch):
    """A line again and again gives two texts thousands of chains: they are sorted, not compared with each other, and aligned together."""
    began = time.process_time()
    chains = [[60 * i, 60 * i + 30, 60 * i] for i in range(10_000)]
    assert len(passages._clusters(chains)) == 1 and len(passages._clusters(chains + [[0, 600_000, 0]])[0][4]) == 4
    assert time.process_time() - began < 2
    calls, align_all = [], passages.align_all
    monkeypatch.setattr(passages, "align_all", lambda *x: calls.append(1) or align_all(*x))
    line, r = list(range(55)), random.Random(6)
    b = np.array([1_000_000 + i for i in range(70)] + line + [2_000_000 + i for i in range(70)], np.uint32)
    a = np.array([w for _ in range(500) for w in line + [r.randrange(5_000, 900_000) for _ in range(30)]], np.uint32)
    runs = [x for i in range(500) for x in (3, 85 * i, 85 * i + 55, 85 * i - 70)]
    batch = pa.RecordBatch.from_pylist([{"node": 1, "ref": 2, "runs": runs, "a": a.tobytes(), "a0": 0, "b": b.tobytes(), "b0": 0}])
    found = pa.Table.from_batches(passages._aligned(iter([batch]))).to_pylist()
    assert sorted((f["start"], f["end"], f["ref_start"], f["n_same"]) for f in found) == [(85 * i, 85 * i + 55, 70, 55) for i in range(500)]
    assert len(calls) < 12


def test_seeds_of_several_texts(spark, monkeypatch):
    """Hashes dealt in pieces give just the seeds that two texts have, and the marks lose none of them."""
    r = random.Random(9)
    line = prose(30, 12)
    rows = [f"{prose(r.randrange(100), 100 + i)} {line} {line if i % 3 else ''} {prose(60, 200 + i // 2)}" for i in range(80)] + ["", None, prose(49, 5), prose(49, 5) + " x"]
    batch = pa.RecordBatch.from_pydict({"node": list(range(-40, len(rows) - 40)), "text": rows})
    held = collections.defaultdict(set)
    for k, text in enumerate(rows):
        if len(words(text)) >= 50:
            _, _, _, owner, h, _, _ = next(hashing.word_chunks(pa.array([text])))
            for v in passages.minimizers(h, owner)[0].tolist():
                held[v].add(k)
    want = {v for v, of in held.items() if len(of) > 1}
    monkeypatch.setattr(passages, "SEEDS_HELD", 700)
    dealt = pa.Table.from_batches(passages._dealt(7, iter([batch.slice(i, 10) for i in range(0, len(rows), 10)])))
    assert set(dealt.column("part").to_pylist()) == set(range(7)) and dealt.num_rows > 14
    several = [v for k in range(7) for v in passages._repeated(dealt.filter(pa.array([p == k for p in dealt.column("part").to_pylist()]))).column("seed").to_pylist()]
    assert len(several) == len(want) > 300 and {v % 2**64 for v in several} == want
    for bits in (28, 10):
        monkeypatch.setattr(passages, "MARK_BITS", bits)
        marks = passages._marks(spark.createDataFrame([(v,) for v in several], "seed long"))
        assert len(marks.value) <= 2**bits // 64
        got = collections.Counter((v % 2**64, n) for b in passages._seeds(marks, iter([batch])) for v, n in zip(b.column("seed").to_pylist(), b.column("node").to_pylist()))
        assert {(v, n - 40) for v in want for n in held[v]} <= set(got) <= {(v, n - 40) for v in held for n in held[v]}
        assert bits == 10 or len({v for v, _ in got} - want) < 0.2 * (len(held) - len(want))


# secrets


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_op8_on_table(spark, sf, texts):
    for r in secrets.op8_secrets(spark, sf).collect():
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(base)) and [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(","))


def test_secrets_odd(spark, odd):
    cases = ["éé PassWord = 'abcdef' İ", "ſecret: abcdef", "API_KEY:abc", "token==a=b=c+d", "pwd: hunter2Zq!9x", "pin: 19990412", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "f" * 24, "passwd=" + "z" * 100_000, "secret: password1 token: f3ef4d6b2755a36d"]
    got = secrets.find_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i long, text string"), out_col="s").orderBy("i").collect()
    for r in got:
        assert [f"{x['kind']}:{x['start']}:{x['end']}" for x in r["s"] if x["kind"] != "guess"] == base_spans(cases[r["i"]])
        assert all(cases[r["i"]][x["start"] : x["end"]] == x["text"] for x in r["s"])
    kinds = [[x["kind"] for x in r["s"]] for r in got]
    assert "guess" in kinds[4] and "guess" not in kinds[5] and kinds[1] == []
    assert secrets.find_secrets(odd).count() == 10 and secrets.find_secrets(odd.where("false")).count() == 0
    clean = secrets.redact(spark.createDataFrame([("a token = 'abcdef123456' b",), (None,), ("plain",)], "text string")).collect()
    assert [r["text"] for r in clean] == ["a [SECRET]' b", None, "plain"]


def test_secrets_are_whole():
    r = random.Random(4)
    value = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(360))
    for lead in ("private_key: ", "AWS_SECRET_ACCESS_KEY=", "DB_PWD=", "db_pass: ", "Authorization: Bearer ", "bearer ", "pass=" + "z" * 200):
        assert any(lead_end <= len(lead) and b == len(lead) + 360 and k == 3 for lead_end, b, k in secrets.scan(f"{lead}{value} rest"))
    assert secrets.scan("the bearer certificates, a compass: northwest") == [] and secrets.scan("pass: " + "z" * 50_000) == []
    for n in range(300):
        v = "".join(r.choice(["password", "1999-04-12", "zzzzzzzzzzzzzz", "qwertyuiop", "abab" * 6, "x", "7", "Kq"]) for _ in range(r.randint(1, 9)))
        for enough in (4.0, 8.0, 12.0):
            assert (secrets.guess_cost(v, enough) >= enough) == (secrets.guess_cost(v) >= enough)


@needs_tokenizers
def test_secrets_by_dictionary():
    """Generated passwords are found, words of prose in the same places aren't."""
    import public_tokenizers

    ranks = secrets.dictionary(public_tokenizers.path("word_bpe_49k.json"))
    assert len(ranks) > 20_000 and ranks["password"] == 1
    r = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = [w for w in list(ranks)[:8000] if len(w) >= 6]
    alarms = [k for k in range(500) for *_, kind in secrets.scan(f"pwd: {r.choice(plain)} and", ranks=ranks) if kind == 3]
    found = [k for k in range(500) if any(kind == 3 for *_, kind in secrets.scan(f"pwd: {''.join(r.choices(letters, k=r.randint(9, 20)))} and", ranks=ranks))]
    assert not alarms and len(found) == 500


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < cost("P@ssw0rd") < cost("xkqvzjwp") and cost("aaaaaaaa") < 3 and cost("qwertyuiop") < 4 and cost("19990412") < 5 and cost("f3ef4d6b2755a36d7d9c25bd") > 20


# near duplicates


def multiset(t):
    w = words(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, t, multiset(t)) for i, t in rows]
    for a in range(len(sets)):
        for b in range(a):
            (i, t, x), (j, u, y) = sets[a], sets[b]
            if x and y and (t == u or (x & y).total() / (x | y).total() >= 0.8):
                i, j = find(i), find(j)
                parent[max(i, j)] = min(i, j)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates(spark):
    r = random.Random(8)
    rows = [(i, prose(100, i)) for i in range(30)]

    def changed(t, n, seed):
        w, rr = t.split(), random.Random(seed)
        for _ in range(n):
            w[rr.randrange(len(w))] = f"new{rr.random()}"
        return " ".join(w)

    rows += [(100 + i, changed(rows[0][1], 1, i)) for i in range(40)] + [(200 + i, changed(rows[i][1], r.choice([1, 2, 4, 8]), i)) for i in range(30)]
    rows += [(300, rows[5][1]), (301, rows[5][1].upper()), (302, "one two"), (303, "One Two!"), (304, "one two"), (305, ""), (306, ""), (307, None), (308, "...")]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("bands", F.lit(1)).withColumn("size", F.lit(1))
    got = near_dups.near_duplicates(df).collect()
    classes = {x["doc_id"]: x["class_id"] for x in got}
    assert len(got) == len(rows) and classes == brute_classes(rows)
    kept = [x["class_id"] for x in got if x["is_first"]]
    assert sorted(kept) == sorted(set(classes.values()))
    assert near_dups.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("tile", [512, 30])
def test_near_duplicates_of_an_absent_original(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dups, "TILE", tile)
    r = random.Random(11)
    rows = []
    for i in range(400):
        w = prose(200, 77).split()
        for at in r.sample(range(200), 3):
            w[at] = f"new{r.random()}"
        rows.append((i, " ".join(w)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == brute_classes(rows)


def test_common_counts(monkeypatch):
    monkeypatch.setattr(near_dups, "STRIP", 7)
    r = np.random.default_rng(3)
    a, b = ([np.unique(r.integers(0, 60, n)).astype(np.uint64) for n in (0, 5, 40, 60, 1)] for _ in range(2))
    assert near_dups.common_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_dart_signatures_estimate_weighted_similarity():
    x, y = np.array([0.5, 2.3, 1.0]), np.array([1.5, 0.3, 1.0])
    names = np.array([11, 22, 33], np.uint64)
    s = near_dups.dart_signatures(np.repeat([0, 1], 3), np.concatenate([names, names]), 2, 4000, np.concatenate([x, y]))
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


# BPE



@needs_tokenizers
def test_bpe_equals_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(6)
    alpha = "abc ABC'strevdml 0123½²٣\n\t\x1c\x85 éÉÑñßẞΣσςİıΑæ🎉中ﬁǅ<|endoftext|>!?-_"
    sample = ["", None, "It's we'RE 'll <|endoftext|> a<|startoftext|>", "<|endoftext|><|endoftext|> <|end", "ΑΣ ΟΔΟΣ Σ", "word " * 50_000, *list(texts.values())[:40]]
    sample += ["".join(r.choice(alpha) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sample)], "i long, text string").withColumn("w", F.lit(1)).repartition(3)
    out = bpe.decode(bpe.encode(df, path), path)
    for x in out.collect():
        ids = library.encode(sample[x["i"]] or "", add_special_tokens=False).ids
        assert x["token_ids"] == ids and x["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.where("false"), path).count() == 0


@needs_tokenizers
def test_bpe_of_long_words(spark, tmp_path):
    """Words without an end, over whole table and query: as the library has them, and in seconds."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    r = random.Random(12)
    made = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    sample = [made(a, n) for n in (255, 256, 257, 3000) for a in ("abcdefghijklmnopqrstuvwxyzABC", "ACGT", "aab", "日本語éß文")]
    sample += [made("abcdefghijklmnopqrstuvwxyz", 1_000_000), "a" * 1_000_000, "so " + made("xyz", 2000) + " on", None, ""]
    spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for x in bpe.op10_bpe(spark, str(tmp_path)).collect():
        got = library.encode(sample[x["doc_id"]] or "", add_special_tokens=False)
        assert x["n_tokens"] == len(got.ids) and x["ids_sha256"] == sha(" ".join(map(str, got.ids)))
        assert x["decoded_sha256"] == sha(library.decode(got.ids, skip_special_tokens=False))


def test_automaton_of_long_words():
    names = {b"a" * 5000: [1], b"a" * 4999 + b"b": [2, 3], "é".encode() * 600: [4], b"ab": [5]}
    made = bpe.Automaton.compile(names)
    assert {w: made.output(n) for w, n in zip(names, made.find(list(names)).tolist())} == names


def test_automaton(tmp_path):
    r = random.Random(9)
    names = {bytes(r.choice(b"abcde") for _ in range(r.randint(1, 7))): [r.randrange(100) for _ in range(r.randint(1, 3))] for _ in range(800)}
    made = bpe.Automaton.compile(names)
    made.save(str(tmp_path / "a.bin"))
    a = bpe.Automaton.map(str(tmp_path / "a.bin"))
    assert [a.output(k) for k in a.find(sorted(names)).tolist()] == [names[w] for w in sorted(names)]
    others = [w for w in (bytes(r.choice(b"abcdef") for _ in range(5)) for _ in range(500)) if w not in names] + [b""]
    assert (a.find(others) == -1).all()
    assert len(a.final) < sum(map(len, names)) + 1  # suffixes are shared


# all together


@needs_tokenizers
def test_pipeline_equals_brute_force(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "encode"]
    good = sorted(r["doc_id"] for r in quality.op6_quality(spark, sf).collect() if r["keep"])
    classes = brute_classes([(i, texts[i]) for i in good])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [i for i in good if classes[i] == i and not brute_hits(texts[i], items)[1]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()

    def redacted(t):
        out, at = [], 0
        for a, b, _ in secrets.scan(t, ranks=secrets.dictionary(public_tokenizers.path("word_bpe_49k.json"))):
            out += [t[at:a], "[SECRET]"] if a >= at else []
            at = max(at, b)
        return "".join(out) + t[at:]

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == kept and len(kept) < len(texts)
    for i in kept:
        assert got[i]["token_ids"] == library.encode(redacted(texts[i]), add_special_tokens=False).ids and got[i]["n_tokens"] == len(got[i]["token_ids"])


def test_stages_keep_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes, name


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Tables of hard rows, and empty ones: nulls in all columns, ties, repeated rows, a very long text and word, one id with two texts."""
    base = tmp_path_factory.mktemp("hard")
    long_text = "plain words of prose " * 20_000
    texts = ["", None, " ", "ſecret: abcdef İ", "a\x00b", long_text, "x" * 300_000, prose(80, 1), prose(80, 1), prose(80, 1) + " more", "cc by all rights reserved", "password = hunter2Zq!9x"]
    docs = [(i, t, "en" if i % 2 else None, f"s{i % 3}.net" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[7]] * 3 + [(7, "another text under the same id", "en", "s", 5), (None, prose(80, 1), None, None, None), (None, None, None, None, None)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2, 0) for i in range(12)] + [(3, None, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": ([("a", prose(80, 1)[:200]), ("b", None), (None, "cc by"), ("c", "")], "item_id string, text string"),
        "conversations": ([(1, 0, "user", None), (1, None, None, "x"), (1, 1, "assistant", "a ### b"), (None, 0, "assistant", "y"), (2, 0, "assistant", long_text)] * 2, "conv_id long, turn int, role string, text string"),
        "embeddings": ([(0, [1.0, 2.0], 1), (20, None, None), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0], 1), (40, [3.0, float("nan")], 2)], "vec_id long, embedding array<float>, label int"),
        "pages": ([(1, "http://a.b/c", "x"), (7, None, None), (7, "nonsense", ""), (14, "https://www.A.b:80/q?x", "y"), (21, "http://a.b/c", "x"), (21, "http://a.b/c", "x")], "page_id long, url string, html string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{base}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{base}/empty/{name}.parquet")
    return base, tables


@needs_tokenizers
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_hard_and_empty_tables(spark, hard, name):
    """Each query ends, with the rows that it promises: one for each row of its table, or what its docstring says."""
    base, tables = hard
    run = queries.queries()[name]
    got = run(spark, f"{base}/full").collect()
    n_docs = len(tables["documents"][0])
    if name in ("op3_licenses", "op5_decontaminate", "op6_quality", "op8_secrets", "op10_bpe"):
        assert len(got) == n_docs
    elif name == "op9_near_dups":
        assert len(got) == n_docs - 3  # rows that repeat both id and text count once
    elif name == "op4_urls":
        assert len(got) == 6
    elif name == "op2_chat":
        assert {r["conv_id"]: r["n_turns"] for r in got} == {1: 6, 2: 2, None: 2, -7: 2}
    elif name == "op1_nearest":
        assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 5.0)]
    elif name == "pipeline":
        assert len({(r["doc_id"], tuple(r["token_ids"])) for r in got}) == len(got)
    assert run(spark, f"{base}/empty").count() == (1 if name == "op2_chat" else 0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.sql(queries.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
