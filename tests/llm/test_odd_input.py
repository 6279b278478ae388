"""Repeated ids and rows, clashing column names, empty tables, ties and very long texts, for every operator and the pipeline."""

import hashlib
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_llm_operators import base_spans, near_copies, prose

import corpus_pipeline
from tidewater.llm import brown_lm, components, decontaminate, hnsw, jaccard, ngram_models, packing, secrets, sharding, url_filter
from tidewater.session import Scratch

KEY = hashlib.sha256(b"another").hexdigest()[:48]
NAMES = ["_found", "_spans0", "id", "k", "label", "text2", "h", "n", "rank", "component", "shard", "score", "at", "y", "v"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "xx", "s", len(t or ""), *NAMES) for i, t in pairs], SCHEMA)


#: Two rows of id 7 with different texts, two equal rows of id 8, a null and an empty text of one id.
PAIRS = [(7, f"é {KEY} and more"), (7, f"secret = abcdefghij {prose(3, 20)}"), (8, prose(1, 60)), (8, prose(1, 60)), (9, None), (9, ""), (10, f"{KEY} {KEY}"), (11, prose(1, 60))]


def count(rows):
    out = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def test_brown_lm(spark):
    got = [(r["id"], r["n_tokens"], round(r["score"], 9)) for r in brown_lm.score(frame(spark, PAIRS), F.col("doc_id") == 11).collect()]
    assert sorted(x[0] for x in got) == [i for i, _ in PAIRS] and len({x for x in got if x[0] == 8}) == 1 and len({x for x in got if x[0] == 7}) == 2


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [(r["id"], r["crc"]) for r in packing.pack(frame(spark, PAIRS), path).collect()]
    each = [(r["id"], r["crc"]) for p in PAIRS for r in packing.pack(frame(spark, [p]), path).collect()]
    assert count(got) == count(each)


def test_hnsw(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.01], "x"), (2, [0.0, 1.0], "x"), (2, [0.0, 1.0], "x"), (3, None, "x"), (3, [0.0, 0.0], "x")]
    got = hnsw.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")).collect()
    assert count((r["id"], r["n_links"], r["component"]) for r in got) == {(1, 0, 1): 2, (2, 1, 2): 2, (3, 0, 3): 2}


def test_secrets(spark):
    """Every row is scanned for itself, also if its id or all of it is repeated."""
    got = secrets.scan(frame(spark, PAIRS), None).collect()
    assert count((r["id"], tuple((x["start"], x["rank"] - 1, x["kind"], x["end"]) for x in r["found"])) for r in got) == count((i, tuple(base_spans(t or ""))) for i, t in PAIRS)


def test_markov_ratio_equals_a_plain_one(spark):
    model = secrets.train(secrets.random_samples(spark, 300).unionByName(secrets.ordinary_samples(frame(spark, [(i, prose(i, 50)) for i in range(30)]), "doc_id", "text")))
    strings = [hashlib.md5(str(i).encode()).hexdigest()[:24] + "Zq" for i in range(20)] + ["some-ordinary-identifier-" + w for w in prose(4, 20).split()] + ["aB3/" * n for n in range(5, 12)]
    side = secrets.SIDE
    for s, found in zip(strings, [r["found"] for r in secrets.scan(frame(spark, list(enumerate(strings))), model).orderBy("id").collect()]):
        at = [secrets.SYMBOLS.index(c) for c in s]
        ratio = sum(model[a * side + b] for a, b in zip(at, at[1:]))
        wanted = ratio >= secrets.LEAST_RATIO and ratio >= secrets.LEAST_PER_CHAR * len(s) and not base_spans(s)
        assert [(x["kind"], x["start"], x["end"]) for x in found] == ([("markov", 0, len(s))] if wanted else [(k, a, e) for a, _, k, e in base_spans(s)])


def test_secrets_in_a_very_long_text(spark):
    """Many matches and one endless string: time in proportion to the text, positions right to the end."""
    long = "token=abcdefgh é " * 30_000 + "q" * 300_000 + f" {KEY}"
    begun = time.time()
    found = secrets.scan(frame(spark, [(1, long)]), secrets.train(secrets.random_samples(spark, 50))).first()["found"]
    assert time.time() - begun < 120
    base = [(x["start"], x["rank"] - 1, x["kind"], x["end"]) for x in found if x["kind"] != "markov"]
    assert base == base_spans(long)


def test_url_filter(spark):
    rows = [(1, "http://a.net/x", "", "h"), (1, "http://a.org/fr/x", None, "h"), (2, "http://b.com/", '<link rel="alternate canonical" href="http://a.net/x"><link rel=canonical href=/y>', "h"), (2, "http://b.com/", "", "h"), (3, "http://b.com/y", "", "h"), (4, "http://c.com/", "<link " * 60_000, "h"), (5, "http://c.com/z", "<meta http-equiv='Refresh' content='1;url=/'><LINK HREF='http://q.net/' REL='x  Canonical'>", "h")]
    begun = time.time()
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert time.time() - begun < 60
    assert count((r["id"], r["verdict"]) for r in got) == {(1, "block"): 1, (1, "allow"): 1, (2, "block"): 2, (3, "block"): 1, (4, "block"): 1, (5, "block"): 1}


def test_jaccard(spark):
    got = jaccard.join(frame(spark, PAIRS), 4, 85, 100).collect()
    assert count((r["id"], r["component"]) for r in got) == {(7, 7): 2, (8, 8): 2, (9, 9): 2, (10, 10): 1, (11, 8): 1}


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, prose(1, 30), "x"), (1, prose(1, 30), "x"), (2, None, "x")], "item_id long, text string, id string")
    got = [(r["id"], r["item"]) for r in decontaminate.matches(frame(spark, PAIRS), items).collect()]
    assert count(got) == {(8, 1): 4, (11, 1): 2}
    kept = decontaminate.drop_matches(frame(spark, PAIRS), items)
    assert kept.columns == frame(spark, PAIRS).columns and sorted(r["doc_id"] for r in kept.collect()) == [7, 7, 9, 9, 10]


def test_tiles_of_a_repeated_word_need_little_memory():
    tiles = decontaminate.tile(np.full(2000, 5, np.uint64), np.full(200_000, 5, np.uint64))
    assert [t[2] for t in tiles] == [2000]


def test_sharding(spark):
    pairs = PAIRS + [(100 + i % 400, prose(i, 5 + i % 40)) for i in range(2000)]
    got = sharding.shard(frame(spark, pairs), 4).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in pairs)
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    for what in ("size", "tokens"):
        sums = [sum(r[what] for r in got if r["shard"] == k) for k in range(4)]
        assert max(sums) < 1.02 * min(sums)
    rows = [sum(r["shard"] == k for r in got) for k in range(4)]
    assert max(rows) < 1.05 * min(rows)


def test_place_follows_the_dot_product():
    """The rule written out: largest share first, to the bin with room whose residual has the largest dot product, ties to the first."""
    r = np.random.default_rng(2)
    for vectors in (r.integers(1, 50, size=(60, 3)), np.tile([[3, 2, 1]], (12, 1))):
        share = vectors / vectors.sum(axis=0)
        left = [[1 / 4] * 3 for _ in range(4)]
        want = np.zeros(len(vectors), int)
        for i in sorted(range(len(vectors)), key=lambda i: (-share[i].max(), i)):
            fits = [k for k in range(4) if all(a >= b - 1e-12 for a, b in zip(left[k], share[i]))]
            dot = lambda k: float(np.dot(left[k], share[i]))
            by_bytes = share[i][0] * 2 >= share[i].max()
            want[i] = max(fits, key=lambda k: (dot(k), -k)) if fits else max(range(4), key=lambda k: (left[k][0] if by_bytes else dot(k), -k))
            left[want[i]] = [a - b for a, b in zip(left[want[i]], share[i])]
        assert (sharding.place(vectors.astype(float), 4) == want).all()


def test_toxicity(spark):
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (8, 0), (10, None)], "doc_id long, label int")
    picked, _ = ngram_models._picked(frame(spark, PAIRS), labels, 100, "doc_id", "text", "label")
    assert {(r["id"], r["y"]): r["text"] for r in picked.collect()} == {(7, 1): min(t for i, t in PAIRS if i == 7), (8, 0): prose(1, 60)}
    model = ngram_models.train_toxicity(frame(spark, PAIRS), labels)
    got = [(r["id"], r["score"]) for r in ngram_models.score_toxicity(frame(spark, PAIRS), model).collect()]
    assert sorted(i for i, _ in got) == [i for i, _ in PAIRS] and len({x for x in got if x[0] == 8}) == 1
    kept = ngram_models.drop_toxic(frame(spark, PAIRS), model, 0.5).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, s in got if s < 0.5)


def test_toxicity_fit_equals_a_dense_one(monkeypatch):
    monkeypatch.setattr(ngram_models, "CHUNK_DOCS", 7)
    r = np.random.default_rng(4)
    y = (np.arange(40) % 2).astype(float)
    found = [np.unique(np.concatenate([r.integers(0, 60, 25), [100 + k] if r.random() < 0.8 else []])).astype(np.int32) for k in y.astype(int)]
    dense = np.zeros((40, 1 << ngram_models.TOXIC_BITS), bool)
    for i, f in enumerate(found):
        dense[i, f] = True
    n = dense.sum(axis=0)
    p, q = ((1 + dense[y == k].sum(axis=0)) / (2 + (y == k).sum()) for k in (1, 0))
    ratio = np.log(p / q)
    ratio[(np.abs(ratio) < ngram_models.LEAST_RATIO) | (n < ngram_models.LEAST_DOCS)] = 0
    x = dense * ratio
    x = x / np.sqrt(np.maximum(1, (x**2).sum(axis=1)))[:, None]
    w, b, m, s, m0, s0 = np.zeros(x.shape[1]), 0.0, 0.0, 0.0, 0.0, 0.0
    for t in range(1, ngram_models.ROUNDS + 1):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        grad, grad0 = x.T @ g / 40 + 1e-7 * w, g.mean()
        m, s, m0, s0 = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2, 0.9 * m0 + 0.1 * grad0, 0.99 * s0 + 0.01 * grad0**2
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.3 * (m / c) / (np.sqrt(s / d) + 1e-9)
        b -= 0.3 * (m0 / c) / (np.sqrt(s0 / d) + 1e-9)
    intercept, (weight, scale) = ngram_models._fit(list(found), y)
    assert abs(intercept - b) < 1e-6 and np.abs(weight - w * ratio).max() < 1e-4 and np.abs(scale - ratio).max() < 1e-6


def test_language_posterior_equals_a_plain_one(spark, monkeypatch):
    texts = [(i, prose(i, 30) if i % 3 else prose(i, 30).upper() + " äöü") for i in range(60)] + [(60, "x"), (60, "ab"), (61, None), (62, "12 !"), (63, prose(5, 40_000))]
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 50, F.col("doc_id") % 12))
    for most in (1024, 4):  # with few allowed, buckets are put together
        monkeypatch.setattr(ngram_models, "MOST_LANGS", most)
        langs, prior, table = ngram_models.train_language(docs)
        shift = 16 - (table.shape[0].bit_length() - 1)
        assert langs == sorted(map(str, range(12))) and (shift > 0) == (most == 4) and np.allclose(np.exp(table.astype(np.float64)).sum(axis=0), 1, atol=1e-4)
        got = [(r["id"], r["lang_pred"], r["score"]) for r in ngram_models.predict_language(docs, (langs, prior, table)).collect()]
        want = []
        for i, t in texts:
            if t is None or not any(map(str.isalpha, t)):
                want.append((i, "und", 0.0))
                continue
            sums = prior.astype(np.float64).copy()
            for b in ngram_models.buckets(t, ngram_models.LANG_ORDERS, ngram_models.LANG_BITS):
                sums += table[b >> shift].astype(np.float64).sum(axis=0)
            k = int(sums.argmax())
            want.append((i, langs[k], float(1 / np.exp(sums - sums[k]).sum())))
        for a, b in zip(sorted(got), sorted(want)):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3


def test_brown_lm_equals_a_plain_model(spark):
    """All words in the head: classes from the exchange, then every probability by its definition."""
    texts = [prose(i, 5 + i % 30) + (f" rare{i}" if i % 3 == 0 else "") + (f" twice{i // 4}" if i % 4 < 2 else "") for i in range(80)] + ["", "never seen words"]
    held = [i % 9 == 2 or i == 81 for i in range(len(texts))]
    docs = frame(spark, list(enumerate(texts)))
    got = {r["id"]: r["score"] for r in brown_lm.score(docs, (F.col("doc_id") % 9 == 2) | (F.col("doc_id") == 81)).collect()}
    end = "</end>"
    seqs = [t.split() + [end] for t in texts]
    n = count(w for s, h in zip(seqs, held) if not h for w in s)
    key = {w: int(brown_lm.words(w.encode())[2].view(np.int64)[0]) for w in n if w != end}
    head = sorted(key, key=lambda w: (-n[w], key[w]))
    at = {w: i for i, w in enumerate([*head, end])}
    pairs = np.zeros((len(at), len(at)))
    for s, h in zip(seqs, held):
        if not h:
            for a, b in zip([end, *s], s):
                pairs[at[a], at[b]] += 1
    of = brown_lm.exchange(pairs)
    cls = {w: int(of[i]) for w, i in at.items()}
    unknown, side = brown_lm.UNKNOWN, brown_lm.CLASSES + 2
    n1, n2 = (sum(c == k for c in n.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2)
    worth = {w: 1 - d if c == 1 else c for w, c in n.items()}
    mass = count([])
    for w, x in worth.items():
        mass[cls[w]] = mass.get(cls[w], 0) + x
    share = lambda w: {cls[w]: 1 - d, unknown: d} if n[w] == 1 else {cls[w]: 1}
    counts = np.zeros((side, side))
    for s, h in zip(seqs, held):
        if not h:
            for a, b in zip([end, *s], s):
                for x, p in share(a).items():
                    for y, q in share(b).items():
                        counts[x, y] += p * q
    prior = (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * side)
    move = (counts + 5 * prior) / (counts.sum(axis=1, keepdims=True) + 5)
    assert np.allclose(move.sum(axis=1), 1) and all(abs(sum(worth[w] / mass[c] for w in n if cls[w] == c) - 1) < 1e-9 for c in mass)
    for i, s in enumerate(seqs):
        c = [cls.get(w, unknown) for w in s]
        want = sum(np.log10(move[a, b]) for a, b in zip([cls[end], *c], c)) + sum(np.log10(worth[w] / mass[cls[w]]) for w in s if w in n)
        assert abs(got[i] - want) < 1e-6 * abs(want)


def test_components_without_the_short_cut(spark, monkeypatch):
    """Large and small edge lists take other plans but give the same labels."""
    r = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 200, size=(150, 2))] + [(500 + i, 501 + i) for i in range(40)], "u long, v long")
    out = []
    for few in (0, 10_000):
        monkeypatch.setattr(components, "FEW", few)
        out.append(sorted((x["node"], x["component"]) for x in components.components(edges, Scratch(spark, "cc")).collect()))
    assert out[0] == out[1] and (540, 500) in out[0]


def write(spark, d, pairs, labels, items):
    frame(spark, pairs).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_pipeline_with_repeated_ids(spark, tmp_path):
    d = f"file://{tmp_path}"
    clean = [(i, prose(i, 60)) for i in range(20, 50)]
    toxic = [(i, prose(i, 40) + " vileness scumbagel " + prose(i + 900, 10)) for i in range(60, 90)]
    item = prose(700, 30)
    write(spark, d, PAIRS + clean + toxic + [(30, toxic[0][1]), (31, prose(55, 20) + " " + item)], [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], [(1, item)])
    docs, at = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert name == "best_fit_packing" or out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        at[name] = docs.collect()
    ids = [i for i, _ in PAIRS + clean]
    assert sorted(r["doc_id"] for r in at["toxicity"]) == sorted([*ids, 31])
    assert sorted(r["doc_id"] for r in at["ngram_jaccard_join"]) == sorted([*ids, 31])[:7] + sorted([*ids, 31])[8:]
    last = at["secret_scans"]
    assert sorted(r["doc_id"] for r in last) == sorted(ids)[:7] + sorted(ids)[8:]
    assert not any(KEY in (r["text"] or "") or "abcdefghij" in (r["text"] or "") for r in last)
    assert all(r["n_chars"] == len(r["text"] or "") and [r[c] for c in NAMES] == NAMES for r in last)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for k, (pairs, kept) in enumerate([([], 0), (PAIRS, 7)]):  # without labels nothing is toxic, without items nothing contaminated
        d = f"file://{tmp_path}/{k}"
        write(spark, d, pairs, [], [])
        assert corpus_pipeline.run(spark, d).count() == kept


def test_copies_in_bands_of_size(spark, monkeypatch):
    """Long lists: sets of unlike sizes meet in bands, and only where one asks."""
    monkeypatch.setattr(jaccard, "LONG", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    from test_llm_operators import jaccard_classes

    shared = prose(77, 12)
    texts = [shared + " " + prose(100 + i, 3 + 2 * (i % 9)) for i in range(40)] + near_copies(12, 60, 5, 9) + [shared] * 3 + near_copies(9, 14, 1, 12)
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard.join(frame(spark, list(enumerate(texts))), 4, 85, 100).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_classes(texts, 4, 85, 100)
