"""Language ID and toxicity: linear models over hashed character n-grams, scored in numpy.

Language ID is multinomial naive Bayes: log-probabilities of hashed 1- to 3-grams per language, a
matrix of one column per language and a bounded size, broadcast to the scorers.
Toxicity is logistic regression on the distinct hashed 2- to 5-grams of a text, each feature scaled
by its naive Bayes log-count ratio before fitting.

Defined results: a null or empty text has no n-gram; its language is "und" (so is that of a text
without a letter) with score 0, and its toxicity is the model's intercept. Repeated rows, also under one
id, are scored each for itself; in training languages count them all, toxicity one row of an id.
Languages of another type than string are taken as text. Without any labelled row, every language is "und" and every toxicity
0.5. Other columns of the input are ignored. Whole texts are read, in segments of SEGMENT characters
that overlap by the n-gram length less one, so memory is bounded for any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import kept

#: Characters of a text hashed at once, and of many short ones together.
SEGMENT, PIECE = 1 << 18, 1 << 15
LANG_ORDERS, LANG_BITS, MOST_LANGS = (1, 2, 3), 16, 1024
TOXIC_ORDERS, TOXIC_BITS = (2, 3, 4, 5), 20
#: Bounds of the sample that the toxicity fit takes: labelled rows, and characters of their texts.
MOST_LABELLED, MOST_CHARS = 6000, 16_000_000
#: Features of a smaller log-count ratio, or in fewer labelled texts, get no weight; steps of the fit.
LEAST_RATIO, LEAST_DOCS, ROUNDS, CHUNK_DOCS = 0.4, 3, 80, 128
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _hashes(c: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of each run of n codes: the highest bits of a mixed 32-bit hash."""
    h = c[: len(c) - n + 1] * _K[0]
    for i in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _K[i] + c[i : len(c) - n + 1 + i]
    h ^= h >> np.uint32(16)
    h *= _K[n - 1]
    h ^= h >> np.uint32(13)
    h *= _K[0] + np.uint32(2 * n)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def buckets(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a lower-cased text, segment by segment, order by order."""
    text = text.lower()
    for at in range(0, len(text), SEGMENT):
        for n in orders:
            c = _codes(text[at : at + SEGMENT + n - 1])
            if len(c) >= n:
                yield _hashes(c, n, bits)


def _batches(it: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# Language ID


def _sparse(texts: list[str], orders: tuple[int, ...], bits: int, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram of many texts, in pieces of bounded size: short texts are hashed together.

    Rows of one text stand together in a piece.
    """
    row, codes, room = [], [], piece

    def hashed():
        flat, owner = np.concatenate(codes), np.repeat(row, [len(c) for c in codes])
        for n in orders:
            if len(flat) < n:
                continue
            inside = owner[: len(owner) - n + 1] == owner[n - 1 :]  # no n-gram runs from one text into the next
            yield owner[: len(owner) - n + 1][inside], _hashes(flat, n, bits)[inside]

    for i, text in enumerate(texts):
        if len(text) > SEGMENT:
            for b in buckets(text, orders, bits):
                yield np.full(len(b), i), b
            continue
        c = _codes(text.lower())
        if len(c) > room and codes:
            yield from hashed()
            row, codes, room = [], [], piece
        row.append(i)
        codes.append(c)
        room -= len(c)
    if codes:
        yield from hashed()


def language_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): n-gram counts of all rows of non-null language; bucket -1 counts the documents."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in _batches(it):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text or "")
            for k, texts in by.items():
                seen[k] = seen.get(k, 0) + len(texts)
                into = total.setdefault(k, np.zeros(1 << LANG_BITS, np.int64))
                for _, b in _sparse(texts, LANG_ORDERS, LANG_BITS, SEGMENT):
                    into += np.bincount(b, minlength=1 << LANG_BITS)
        for k, into in total.items():
            at = np.flatnonzero(into)
            yield pa.record_batch([pa.array([k] * (len(at) + 1)), pa.array(np.concatenate(([-1], at)).astype(np.int32)), pa.array(np.concatenate(([seen[k]], into[at])))], ["lang", "bucket", "n"])

    each = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return each.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in order, log-prior, log-probabilities [bucket, language]); counts cover all rows given.

    The matrix has 2**LANG_BITS buckets up to MOST_LANGS languages; with more of them neighbouring
    buckets are put together, so that it keeps its size.
    """
    counts = language_counts(docs, text_col, lang_col)
    priors = {r["lang"]: r["n"] for r in counts.where("bucket = -1").select("lang", "n").collect()}  # a row for each language
    langs = sorted(priors)
    shift = max(0, (len(langs) - 1) // MOST_LANGS).bit_length()
    folded = counts.where("bucket >= 0").groupBy("lang", F.shiftright("bucket", shift).alias("b")).agg(F.sum("n").alias("n"))
    got = folded.toArrow()  # the matrix's own size at most
    seen = np.full((1 << (LANG_BITS - shift), len(langs)), 0.5)
    place = {k: i for i, k in enumerate(langs)}
    if got.num_rows:
        code = got.column("lang").combine_chunks().dictionary_encode()
        column = np.array([place[k] for k in code.dictionary.to_pylist()])[np.asarray(code.indices)]
        seen[np.asarray(got.column("b")), column] += np.asarray(got.column("n"))
    table = np.log(seen) - np.log(seen.sum(axis=0, keepdims=True))
    prior = np.array([priors[k] for k in langs], dtype=np.float64)
    return langs, np.log(prior / prior.sum()) if langs else prior, table.astype(np.float32)


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language, the first in order among equals, and its posterior probability."""
    langs, prior, _ = model
    bits = max(1, int(model[2].shape[0])).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(model[2])  # 2**LANG_BITS x MOST_LANGS floats at most

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in _batches(it):
            texts = batch.column(1).to_pylist()
            known = [bool(langs) and x is not None and any(map(str.isalpha, x)) for x in texts]
            sums = np.tile(prior, (len(texts), 1))
            for row, b in _sparse([x if k else "" for x, k in zip(texts, known)], LANG_ORDERS, bits):
                step = max(1, (1 << 22) // max(1, len(langs)))
                for a in range(0, len(b), step):
                    r = row[a : a + step]
                    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    sums[r[first]] += np.add.reduceat(table.take(b[a : a + step], axis=0), first, axis=0, dtype=np.float64)
            best = sums.argmax(axis=1) if langs else np.zeros(len(texts), np.int64)
            prob = [float(1 / np.exp(s - s[k]).sum()) if ok else 0.0 for s, k, ok in zip(sums, best, known)]
            yield pa.record_batch([batch.column(0), pa.array([langs[k] if ok else "und" for k, ok in zip(best, known)], pa.string()), pa.array(prob, pa.float64())], ["id", "lang_pred", "score"])

    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return each.mapInArrow(score, f"id {dict(each.dtypes)['id']}, lang_pred string, score double")


# Toxicity


def _slot() -> np.ndarray:
    """Working memory with an entry for each bucket; what it holds does not matter."""
    return kept("toxicity", lambda: np.zeros(1 << TOXIC_BITS, np.int32))


def _distinct(text: str, slot: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text; slot: working memory with an entry for each bucket."""
    out = []
    for b in buckets(text, TOXIC_ORDERS, TOXIC_BITS):
        at = np.arange(len(b), dtype=np.int32)
        slot[b] = at
        out.append(b[slot[b] == at])
    if not out:
        return np.empty(0, np.int32)
    b = np.concatenate(out)
    at = np.arange(len(b), dtype=np.int32)
    slot[b] = at
    return b[slot[b] == at]


def _fit(found: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, weight and scale of each bucket) of the texts' distinct buckets and labels; both labels occur."""
    seen = np.zeros((2, 1 << TOXIC_BITS))
    for k, f in zip(y.astype(int), found):
        seen[k][f] += 1
    ratio = np.log((1.0 + seen[1]) / (2.0 + (y == 1).sum())) - np.log((1.0 + seen[0]) / (2.0 + (y == 0).sum()))
    ratio[(np.abs(ratio) < LEAST_RATIO) | (seen.sum(axis=0) < LEAST_DOCS)] = 0
    used = np.flatnonzero(ratio)
    number = np.full(1 << TOXIC_BITS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    scale = ratio[used]
    for i, f in enumerate(found):  # a feature's value is its scale over the text's norm, so its number is all that is kept
        f = number[f]
        found[i] = f[f >= 0]
    size = np.array([len(f) for f in found])
    norm = np.array([np.sqrt(max(1.0, (scale[f] ** 2).sum())) for f in found])
    chunks = []
    for at in range(0, len(found), CHUNK_DOCS):
        chunks.append((at, np.concatenate(found[at : at + CHUNK_DOCS])))
        found[at : at + CHUNK_DOCS] = [number[:0]] * len(found[at : at + CHUNK_DOCS])  # freed at once
    intercept, w = 0.0, np.zeros(len(used))
    speed, drift, slope, drift0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):  # full-batch Adam on the log-loss
        grad, grad0, scaled = np.zeros_like(w), 0.0, w * scale
        for at, col in chunks:
            mine, n, long = y[at : at + CHUNK_DOCS], size[at : at + CHUNK_DOCS], norm[at : at + CHUNK_DOCS]
            sums = np.concatenate(([0.0], np.cumsum(scaled[col])))
            ends = np.cumsum(n)
            z = (sums[ends] - sums[ends - n]) / long + intercept
            g = (1 / (1 + np.exp(-z)) - mine) / len(y)
            grad += np.bincount(col, weights=np.repeat(g / long, n), minlength=len(w))
            grad0 += g.sum()
        grad = grad * scale + 1e-7 * w
        speed, drift = 0.9 * speed + 0.1 * grad, 0.99 * drift + 0.01 * grad**2
        slope, drift0 = 0.9 * slope + 0.1 * grad0, 0.99 * drift0 + 0.01 * grad0**2
        rate, fix = 0.3 / (1 - 0.9**t), 1 - 0.99**t
        w -= rate * speed / (np.sqrt(drift / fix) + 1e-9)
        intercept -= rate * slope / (np.sqrt(drift0 / fix) + 1e-9)
    weight = np.zeros(1 << TOXIC_BITS)
    weight[used] = w
    return float(intercept), np.stack([weight * ratio, ratio]).astype(np.float32)


def _picked(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, y, text) of the labelled rows that the fit takes, and (id, y) of all labels."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chars = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("chars")).groupBy("id").agg(F.max("chars").alias("chars"))
    rows = chars.join(known, "id").withColumn("h", F.xxhash64("id"))
    first = [rows.where(F.col("y") == y).orderBy("h", "id").limit(most // 2) for y in (0, 1)]
    so_far = Window.partitionBy("y").orderBy("h", "id")  # most / 2 rows at most
    place, total = F.row_number().over(so_far), F.sum("chars").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    some = first[0].unionByName(first[1]).withColumns({"k": place, "total": total}).where((F.col("k") == 1) | (F.col("total") <= MOST_CHARS // 2)).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    return texts.groupBy("id", "y").agg(F.min("text").alias("text")), known


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most: int = MOST_LABELLED) -> tuple[float, np.ndarray]:
    """(intercept, weight and scale of each bucket) from docs(id, text) and labels(id, label 0/1).

    `most` labelled rows are taken at most, half of them of each label, in order of the id's hash, up
    to MOST_CHARS characters (half for each label; the first row of a label whatever its length). Of
    rows of one id the least text counts, and label 1 before 0. Features are made where the texts are;
    one task fits them, so that the driver holds nothing but the model.
    """
    texts, known = _picked(docs, labels, most, id_col, text_col, label_col)
    whole = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slot()
        for batch in _batches(it, 64):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([_distinct(x.as_py(), slot).tobytes() for x in batch.column(2)], pa.binary())], ["h", "y", "f"])

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, y, found = [], [], []
        for batch in it:
            order += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            found += [np.frombuffer(x.as_py(), np.int32) for x in batch.column(2)]
            del batch
        by = np.argsort(np.array(order, np.int64), kind="stable")  # sums do not depend on how rows arrive
        y, found = np.array(y, dtype=np.float64)[by], [found[i] for i in by]  # the arrays themselves stay in place
        n = [int((y == k).sum()) for k in (0, 1)]
        model = _fit(found, y) if min(n) else (0.0, np.zeros((2, 1 << TOXIC_BITS), np.float32))
        yield pa.record_batch([pa.array([model[0]]), pa.array([model[1].tobytes()], pa.binary()), *[pa.array([k]) for k in n]], ["intercept", "table", "n0", "n1"])

    each = texts.select(F.xxhash64("id").alias("h"), "y", "text").mapInArrow(features, "h long, y int, f binary")
    got = each.repartition(1).mapInArrow(fit, "intercept double, table binary, n0 long, n1 long").collect()  # one row
    if not got or not got[0]["n0"] or not got[0]["n1"]:
        n0, n1 = (got[0]["n0"], got[0]["n1"]) if got else (0, 0)
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return float(np.log(share / (1 - share))), np.zeros((2, 1 << TOXIC_BITS), np.float32)
    one = got[0]
    shift = np.log(whole[1] / whole[0]) - np.log(one["n1"] / one["n0"])  # from the picked rows' mixture to that of all labels
    return float(one["intercept"] + shift), np.frombuffer(one["table"], np.float32).reshape(2, -1)


def _toxic(texts: pa.Array, intercept: float, w: np.ndarray, ratio: np.ndarray, slot: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for i, x in enumerate(texts):
        b = _distinct(x.as_py() or "", slot)
        r = ratio[b].astype(np.float64)
        z = intercept + w[b].sum(dtype=np.float64) / np.sqrt(max(1.0, float(r @ r)))
        out[i] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def drop_toxic(docs: DataFrame, model: tuple[float, np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below `least`; each row is judged by its own text."""
    intercept, at = model[0], docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model[1])  # 2**TOXIC_BITS floats, twice

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ratio = shared.value
        slot = _slot()
        for batch in _batches(it):
            yield batch.filter(pa.array(_toxic(batch.column(at), intercept, w, ratio, slot) < least))

    return docs.mapInArrow(keep, docs.schema)


def score_toxicity(docs: DataFrame, model: tuple[float, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1."""
    intercept = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])  # 2**TOXIC_BITS floats, twice

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        w, ratio = table
        slot = _slot()
        for batch in _batches(it):
            yield pa.record_batch([batch.column(0), pa.array(_toxic(batch.column(1), intercept, w, ratio, slot))], ["id", "score"])

    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return each.mapInArrow(score, f"id {dict(each.dtypes)['id']}, score double")
