"""Each operator on small fixtures against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm import brown_lm, components, decontaminate, hashing, hnsw, jaccard, ngram_models, packing, secrets, sharding, url_filter
from tidewater.session import Scratch

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("na", "pi", "ro", "ve", "zu", "dek")]
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, score string, shard string, n string"


def table(spark, texts):
    """doc_id, text and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_texts():
    """Null, empty, blank, one word, repeats, long, and characters beyond ASCII."""
    return [None, "", " \t\n", "one", "one", "Éa ÉA éa b", prose(1, 60), prose(1, 60), prose(2, 30_000), "A\x0bB\x0cC\rD\x1cE"]


def test_words_and_shingles():
    for t in [x for x in odd_texts() if x is not None]:
        raw = t.encode()
        a, b, h = hashing.words(raw)
        want = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        assert [raw[i:j] for i, j in zip(a, b)] == want
        low = [w.translate(bytes(hashing.LOWER)) for w in want]
        assert len(set(low)) == len(set(h.tolist())) and all((x == y) == (p == q) for x, p in zip(low[:50], h) for y, q in zip(low[:50], h))
    before, hashing.SEGMENT = hashing.SEGMENT, 64
    try:
        assert (hashing.words(prose(2, 3000).encode())[2] != 0).all()
        cut = hashing.words(prose(2, 3000).encode())[2]
    finally:
        hashing.SEGMENT = before
    assert (cut == hashing.words(prose(2, 3000).encode())[2]).all()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(7, 7), (1000, 5), (5, 1000)] + [(2000, x) for x in range(2001, 2100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_brown_lm(spark):
    texts = odd_texts() + [prose(i, 40) for i in range(40)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    out = brown_lm.score(table(spark, texts), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1)
    got = {r["id"]: r for r in out.collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)), None] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert brown_lm.score(table(spark, []), F.lit(False)).count() == 0
    alone = brown_lm.score(table(spark, ["a b", None]), F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == pytest.approx(0) for r in alone)


def test_brown_lm_classes_come_from_all_blocks(spark, monkeypatch):
    """One block or many: the head, the classes and so the scores are the same."""
    monkeypatch.setattr(brown_lm, "HEAD", 20)
    docs = table(spark, [prose(i, 12 + i % 9) for i in range(400)])
    held = F.col("doc_id") % 7 == 0
    whole, cut = ({r["id"]: r["score"] for r in brown_lm.score(docs.repartition(n, "doc_id"), held).collect()} for n in (1, 40))
    assert cut == pytest.approx(whole, rel=1e-9)


def test_brown_lm_head_counts_all_blocks(spark, monkeypatch):
    """A word too rare for a report in most blocks is in the head by its whole count."""
    monkeypatch.setattr(brown_lm, "REPORTED", 10)
    texts = [" ".join(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 5 + [f"x{i}y{j}" for j in range(40)]) for i in range(12)] + ["dd " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("held", F.lit(False)).repartitionByRange(13, "id")
    scratch = Scratch(spark, "head")
    blocks = scratch.keep(brown_lm._blocks(docs, "bigint"), "blocks")
    for n in (2, 3):  # with 2, the reports' bounds tell which words to count
        monkeypatch.setattr(brown_lm, "HEAD", n)
        assert brown_lm._head(blocks, scratch).tolist() == hashing.words(b"aa bb cc")[2][:n].tolist()


def test_exchange_finds_classes():
    r = np.random.default_rng(0)
    true = np.arange(40) % 4
    pairs = np.zeros((41, 41))
    for _ in range(20000):
        a = r.integers(40)
        b = r.choice(np.flatnonzero(true == (true[a] + 1) % 4))
        pairs[a, b] += 1
    of = brown_lm.exchange(pairs, 4)
    assert all(len(set(of[:40][true == k])) == 1 for k in range(4)) and len(set(of[:40])) == 4


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = odd_texts() + ["a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ΣΑΣ don't I'LL x\x85y 日本"] + [prose(i, i * 7) for i in range(60)]
    rows = packing.pack(table(spark, texts), path, with_ids=True).collect()
    by, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        by[r["id"]][r["piece"]] = r
        sequences[r["sequence"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        got = []
        for p in range(len(by[i])):
            r = by[i][p]
            one = np.frombuffer(r["ids"], "<u4")
            assert r["start"] == len(got) and len(one) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["crc"]
            assert r["length"] == 2048 or p == len(by[i]) - 1
            got += one.tolist()
        assert got == ids
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(table(spark, []), path).count() == 0


def test_packing_plan_is_tight_and_complete():
    r = random.Random(8)
    histogram = Counter(min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(5000))
    ranges, n = packing.plan(dict(histogram))
    assert n <= 1.03 * sum(k * c for k, c in histogram.items()) / 2048 + 1
    used = defaultdict(list)
    fill = Counter()
    for length, first, times, base, offset in ranges:
        used[length].append((first, first + times))
        for s in range(times):
            fill[base + s] += length
            assert offset + length <= 2048
    assert max(fill.values()) <= 2048 and len(fill) == n
    for length, spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_hnsw(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8))
    x[100:200] = x[0] + r.normal(size=(100, 8)) * 0.25
    x[200:230] = x[1] * 3
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(400, None, "x"), (401, [], "x"), (402, [0.0] * 8, "x"), (403, [float("nan")] * 8, "x"), (404, [None] * 8, "x"), (405, [1.0, 2.0], "x"), (406, [1.0, 2.0], "x")]
    got = {g["id"]: (g["n_links"], g["component"]) for g in hnsw.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(400)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(400)])
        if (new == label).all():
            break
        label = new
    assert {i: got[i] for i in range(400)} == {i: (int(near[i].sum()), int(label[i])) for i in range(400)}
    assert [got[i] for i in range(400, 405)] == [(0, i) for i in range(400, 405)] and got[405] == got[406] == (1, 405)
    assert hnsw.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hnsw_audit_is_not_hidden_by_a_hot_group(monkeypatch):
    """A search that finds a hot group but misses the isolated pairs is widened until it finds them."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 32))
    x[:300] = x[0] + r.normal(size=(300, 32)) * 0.01
    x[400:410] = x[410:420] + r.normal(size=(10, 32)) * 0.01
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    class Narrow:
        def __init__(self):
            self.x = x

        def search(self, q, least, width):
            rows, nodes = np.nonzero(q @ x.T >= least)
            own = (q[rows] == x[nodes]).all(axis=1)
            found = (nodes < 300) | own | (width >= 32)
            return rows[found], nodes[found]

    monkeypatch.setattr(hnsw, "WHOLE", 2)
    rows, nodes, _, width = hnsw.audited(Narrow(), x, 0.95, np.arange(600))
    assert width == 32 and {(i, i + 10) for i in range(400, 410)} <= set(zip(rows.tolist(), nodes.tolist()))


def base_spans(t):
    out = []
    for k, (kind, pattern) in enumerate((("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(pattern, t, re.A):
            if len(m[1] if k == 0 else m[0]) >= (8, 16, 32)[k]:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_secrets(spark):
    key = hashlib.sha256(b"k").hexdigest()
    texts = odd_texts() + [
        f"é token = \"{key}\" and AKIA{'Z9' * 8}x password: short secret=abcdefgh! token=secret: abcdefghij",
        f"{key}{key} api_key='{key[:10]}' PASSWD:\x20\x20abc.def-ghi AKIAAKIA12345678901 Token==ab=cd_ef",
        "x" * 50 + " " + key[:31] + "g " + key[:32] + " AKIA1234 " + "token=abcdefgh " * 400,
        "here Zk8vQ2xLmT9aBcR4wYpN7sDf3GhJ6uKe0 is it",
        " ".join(["some_ordinary_identifier_name", "anotherOrdinaryIdentifierName", "path/to/some/ordinary/place"]),
    ]
    docs = table(spark, texts)
    model = secrets.train(secrets.random_samples(spark).unionByName(spark.createDataFrame([(f"{a}{s}{b}", 0) for a in WORDS for b in WORDS for s in ("", "_", "/", "-")] + [(f"{a}{b.capitalize()}Name", 0) for a in WORDS for b in WORDS] + [(w, 0) for w in ("some", "ordinary", "identifier", "name", "another", "path", "place", "to")] * 20, "text string, label int")))
    got = {r["id"]: r["found"] for r in secrets.scan(docs, model).collect()}
    for i, t in enumerate(texts):
        assert [(x["start"], x["rank"] - 1, x["kind"], x["end"]) for x in got[i] if x["kind"] != "markov"] == base_spans(t or ""), i
    added = {i: [texts[i][x["start"] : x["end"]] for x in f if x["kind"] == "markov"] for i, f in got.items()}
    assert added[13] == ["Zk8vQ2xLmT9aBcR4wYpN7sDf3GhJ6uKe0"] and not added[14] and not added[8]
    masked = docs.select(F.col("doc_id").alias("id"), "text").join(secrets.scan(docs, model), "id").select("id", secrets.masked(F.col("text"), F.col("found")).alias("m")).collect()
    clean = {r["id"]: r["m"] for r in masked}
    assert clean[0] is None and clean[6] == texts[6] and key not in clean[10] and clean[10].startswith('é [secret]" and [secret]x password: short [secret]!')
    assert secrets.scan(table(spark, []), model).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.net/a", "http://example.com/de/x?y", "http://example.com/den", "ftp://b.org/fr/1", "http://b.org/frx", "nothing", None, "http://net", "http://q.org/z", "http://r.org/z", "http://s.org/z", "http://x.net/a#b"]
    html = [None] * 9 + ['<link href="https://x.net/a" rel="canonical">', '<META HTTP-EQUIV=refresh content="0; URL=http://q.org/z">', '<link rel=canonical href="//b.org/fr/1">', ""]
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, host string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("x.net", "/a", "net/", "block"), 2: ("example.com", "/de/x", "example.com/de/", "block"), 3: ("example.com", "/den", None, "allow"),
        4: ("b.org", "/fr/1", "org/fr/", "allow"), 5: ("b.org", "/frx", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("net", "", None, "allow"),
        9: ("q.org", "/z", None, "block"), 10: ("r.org", "/z", None, "block"), 11: ("s.org", "/z", None, "allow"), 12: ("x.net", "/a", "net/", "block"),
    }
    both = spark.createDataFrame([("http://s.org/z", "http://q.org/z")], "source string, target string")
    more = {r["id"]: r["verdict"] for r in url_filter.judge(pages, both).collect()}
    assert [more[i] for i in (1, 4, 9, 10, 11)] == ["block", "allow", "allow", "allow", "allow"]
    assert url_filter.judge(pages.limit(0)).count() == 0


def jaccard_classes(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    return [(len(s), k) for s, k in zip(sets, label)]


def near_copies(count, words, edits, seed):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for i in range(count):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("long", [200, 3])
def test_jaccard(spark, monkeypatch, long):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = odd_texts() + near_copies(30, 80, 6, 5) + near_copies(20, 12, 2, 6) + [prose(i, 50) + " " + prose(99, 30) for i in range(20)]
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard.join(table(spark, texts), 4, 85, 100).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_classes(texts, 4, 85, 100)


def test_jaccard_empty(spark):
    assert jaccard.join(table(spark, []), 5, 80, 100).count() == 0
    assert [r["component"] for r in jaccard.join(table(spark, [None, "", "a"]), 5, 80, 100).orderBy("id").collect()] == [0, 1, 2]


def test_divide_skip():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, size=r.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owners = np.repeat(np.arange(80), [len(s) for s in sets])[order]
    for q in sets[:30]:
        got = set(jaccard.divide_skip(q, sets, flat[order], owners, 60, 100).tolist())
        assert got == {k for k, s in enumerate(sets) if len(np.intersect1d(q, s)) * 100 >= 60 * len(np.union1d(q, s))}


def tiles_by_force(a, b, least):
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        if best[2] < least:
            return sum(x[2] for x in out), len(out)
        out.append(best)
        used_a.update(range(best[0], best[0] + best[2]))
        used_b.update(range(best[1], best[1] + best[2]))


def test_tiling_equals_brute_force():
    r = random.Random(2)
    for _ in range(25):
        a = [r.randrange(6) for _ in range(25)]
        b = a[12:] + [r.randrange(6) for _ in range(8)] + a[:14]
        got = decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 4)
        assert (sum(x[2] for x in got), len(got)) == tiles_by_force(a, b, 4)


def test_decontaminate(spark):
    items = [prose(50 + i, 30) for i in range(5)] + [None, "", "too short here"]
    w = items[1].split()
    texts = odd_texts() + [prose(9, 200) + " " + items[0].upper().replace(" ", ", ") + prose(10, 100), " ".join(w[15:]) + " between " + " ".join(w[:15]), " ".join(w[:8]), items[2], items[2]]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, id string")
    got = sorted((r["id"], r["item"], r["n_tiles"]) for r in decontaminate.matches(table(spark, texts), bench).collect())
    assert got == [(10, 0, 1), (11, 1, 2), (13, 2, 1), (14, 2, 1)]
    assert decontaminate.matches(table(spark, []), bench).count() == 0
    assert decontaminate.matches(table(spark, texts), bench.limit(0)).count() == 0


def test_sharding(spark):
    texts = odd_texts()[:8] + ["hot copy"] * 300 + [prose(i, r) for i, r in enumerate(random.Random(1).choices(range(5, 60), k=600))]
    got = sharding.shard(table(spark, texts), 4).collect()
    assert sorted(r["id"] for r in got) == list(range(len(texts)))
    for r in got:
        raw = (texts[r["id"]] or "").encode()
        assert (r["size"], r["crc"], r["tokens"]) == (len(raw) + 1, zlib.crc32(raw), len(re.findall(rb"[^\x20\x09-\x0D]+", raw)))
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    rows = [sum(r["shard"] == k for r in got) for k in range(4)]
    assert max(rows) < 1.5 * min(rows)
    where = defaultdict(set)
    for r in got:
        where[texts[r["id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t != "hot copy")
    assert sharding.shard(table(spark, []), 4).count() == 0


def test_language(spark):
    r = random.Random(0)
    say = {"xx": ["alba", "corno", "dia"], "yy": ["wurz", "kraft", "blick"]}
    texts = odd_texts() + [" ".join(r.choices(say["xx" if i % 2 else "yy"], k=9)) for i in range(60)] + ["alba corno dia", "kraft blick", "123 !?"]
    docs = table(spark, texts).withColumn("lang", F.when((F.col("doc_id") >= 10) & (F.col("doc_id") < 70), F.when(F.col("doc_id") % 2 == 1, "xx").otherwise("yy")))
    model = ngram_models.train_language(docs)
    got = {x["id"]: (x["lang_pred"], x["score"]) for x in ngram_models.predict_language(docs, model).collect()}
    assert got[70][0] == "xx" and got[71][0] == "yy" and [got[i] for i in (0, 1, 2, 72)] == [("und", 0.0)] * 4
    assert all(got[i][0] == ("xx" if i % 2 else "yy") for i in range(10, 70)) and all(0 <= s <= 1 for _, s in got.values())
    none = ngram_models.train_language(docs.limit(0))
    assert {x["lang_pred"] for x in ngram_models.predict_language(docs, none).collect()} == {"und"}


def test_toxicity(spark):
    bad = ["scumbagel", "vileness"]
    r = random.Random(3)
    texts = odd_texts() + [prose(i, 40) + (" " + r.choice(bad) + " " + prose(i + 500, 20) if i % 3 == 0 else "") for i in range(240)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i + 10, int(i % 3 == 0), "x") for i in range(160)] + [(10, 1, "x"), (99999, 1, "x"), (5, None, "x")], "doc_id long, label int, text string")
    model = ngram_models.train_toxicity(docs, labels)
    got = {x["id"]: x["score"] for x in ngram_models.score_toxicity(docs, model).collect()}
    right = [(got[i + 10] >= 0.5) == (i % 3 == 0) for i in range(160, 240)]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1] and got[3] == got[4]
    empty = ngram_models.train_toxicity(docs, labels.limit(0))
    assert {round(x["score"], 6) for x in ngram_models.score_toxicity(docs, empty).collect()} == {0.5}


def test_hnsw_graphs_are_not_shuffled_to_the_vectors(spark, monkeypatch):
    """Graphs come to the vectors a bin at a time, with no exchange; links are taken a slice of queries at a time."""
    plans, keep = [], hnsw.Scratch.keep
    monkeypatch.setattr(hnsw.Scratch, "keep", lambda self, df, name, *a, **b: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(self, df, name, *a, **b))[1])
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8))
    x[100:200] = x[0] + r.normal(size=(100, 8)) * 0.25
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, [1.0, 2.0]), (301, [2.0, 4.0])], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, hnsw.link(rows).collect()))
    assert whole[-1] == (301, 1, 300) and not any("Exchange" in p for name, p in plans if name.startswith("found"))
    monkeypatch.setattr(hnsw, "BIN", 1)
    assert sorted(map(tuple, hnsw.link(rows).collect())) == whole
    assert sum(name.startswith("found") for name, _ in plans) > 1 + 4
    monkeypatch.setattr(hnsw, "SLICE", 7)
    u = hnsw._unit(x)
    g = hnsw.Graph(u, np.arange(300))
    assert all(q.max(initial=0) - q.min(initial=300) < 7 for q, _ in hnsw._links(g, u, 0.9, 300))


def test_jaccard_lists_are_made_in_passes(spark, monkeypatch):
    """The entries of all lists are never shuffled at once; any number of passes over the keys gives the same classes."""
    r, kept, keep = random.Random(4), [], jaccard.Scratch.keep
    monkeypatch.setattr(jaccard.Scratch, "keep", lambda self, df, name, *a, **b: (kept.append(name), keep(self, df, name, *a, **b))[1])
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    texts += [t + " end" for t in texts] + [t.replace("w7", "w8") for t in texts] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "PASSES", 1, raising=False)
    once = sorted(map(tuple, jaccard.join(docs, 4, 85, 100).collect()))
    monkeypatch.setattr(jaccard, "PASSES", 3)
    monkeypatch.setattr(jaccard, "PASS", 10, raising=False)
    assert sorted(map(tuple, jaccard.join(docs, 4, 85, 100).collect())) == once
    assert [k for k in kept if k.startswith("shared")] == ["shared/0", "shared/0", "shared/1", "shared/2"]
    assert len({c for _, _, c in once}) < 182 - 40


def test_pipeline_frees_each_stage(spark, monkeypatch):
    """Shuffle files of a stage are released before the next stage begins."""
    import corpus_pipeline

    log, release = [], corpus_pipeline.Scratch.release
    monkeypatch.setattr(corpus_pipeline.Scratch, "release", lambda self: (log.append("free"), release(self))[1])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, docs, d, n=n: (log.append(n), docs.limit(5))[1]) for n in ("one", "two")])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 5
    assert log == ["one", "free", "two", "free"]


def test_packing_starts_no_second_kind_of_worker(spark):
    """The plan's ranges come as Arrow: rows of Python objects would be read by Python workers with a daemon of their own."""
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(20)], "doc_id long, text string")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20
