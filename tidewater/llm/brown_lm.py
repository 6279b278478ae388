"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

P(word | before) = P(class | class before) * P(word | class). The commonest HEAD words are put into
CLASSES classes by the exchange algorithm on their bigram counts (a table of fixed size, on the
driver); every other word takes the class that one exchange step against those classes gives it,
from the nearest head words before and after it, counted where the text is and added up over all
blocks. The end token is a class
of its own, and so is the unknown word: singletons of the training texts give a share D of their
mass to it (D = n1 / (n1 + 2 n2)), which smooths emissions; transitions are smoothed towards the
classes' own frequencies. Nothing that grows with the vocabulary reaches the driver or a broadcast:
texts are encoded in blocks with a vocabulary each, and counts and classes of a block's words come
back to it by joins on word and on block.

Defined results: a null or empty text is its end token alone; repeated rows are counted and scored
each for itself; without training rows every token is unknown; an empty table gives an empty
result; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.hashing import words
from tidewater.session import Scratch

HEAD, CLASSES, SWEEPS, BLOCK_BYTES, WORDS_AT_ONCE = 768, 32, 8, 10 << 20, 1 << 15
END, UNKNOWN, SIDE = CLASSES, CLASSES + 1, CLASSES + 1
#: Words of so small a share of a block are reported to choose the head from; and so many are counted again at most.
REPORTED = 50_000
#: Stands for the end token among word hashes.
END_HASH = np.uint64(1)


def _pack(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpack(raw) -> np.ndarray:
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    four = np.zeros((len(three), 4), np.uint8)
    four[:, :3] = three
    return four.view("<u4").ravel().astype(np.int64)


_BLOCK = "block long, ids array<{key}>, held binary, ends binary, tokens binary, vocabulary binary, counts binary"


def _blocks(docs: DataFrame, key: str) -> DataFrame:
    """docs(id, text, held) in blocks of about BLOCK_BYTES, each with its own vocabulary and training counts."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def block(rows):
            hashes = [np.append(h, END_HASH) for _, _, h in rows]
            held = np.array([x for _, x, _ in rows], dtype=bool)
            size = np.array([len(h) for h in hashes])
            seen, back = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.bincount(back[~np.repeat(held, size)], minlength=len(seen))
            raw = (held.tobytes(), np.cumsum(size).tobytes(), _pack(back), seen.tobytes(), counts.astype(np.int64).tobytes())
            return pa.record_batch([pa.array([number]), pa.array([[i for i, _, _ in rows]], pa.list_(kind)), *[pa.array([x], pa.binary()) for x in raw]], ["block", "ids", "held", "ends", "tokens", "vocabulary", "counts"])

        rows, room = [], BLOCK_BYTES
        for batch in it:
            kind = batch.schema.field(0).type
            for i, x, h in zip(*batch.columns):
                raw = (x.as_py() or "").encode()
                rows.append((i.as_py(), h.as_py(), words(raw)[2]))
                room -= len(raw) + 64
                if room <= 0:
                    yield block(rows)
                    rows, room, number = [], BLOCK_BYTES, number + 1
        if rows:
            yield block(rows)

    return docs.mapInArrow(encode, _BLOCK.format(key=key))


def _each(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i] for n in batch.schema.names}
            pa.default_memory_pool().release_unused()


def _array(x, kind) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _head(blocks: DataFrame, scratch: Scratch) -> np.ndarray:
    """Hashes of the HEAD commonest training words, by their counts over all blocks.

    Blocks first report words of 1/REPORTED of their tokens or more, and the most that any other word
    has. From these bounds follows which words can be in the head; only they are counted in full. Where
    the bounds leave that open to unreported words or to too many, all words are.
    """

    def reports(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(it):
            seen, n = _array(b["vocabulary"], np.uint64), _array(b["counts"], np.int64)
            word = (n > 0) & (seen != END_HASH)
            keep = word & (n * REPORTED >= max(1, n.sum()))
            rest = n[word & ~keep].max(initial=0)
            yield pa.record_batch([pa.array(np.append(seen[keep], END_HASH).view(np.int64)), pa.array(np.append(n[keep], rest))], ["word", "n"])

    def counted(only: np.ndarray | None) -> DataFrame:
        def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _each(it):
                seen, n = _array(b["vocabulary"], np.uint64), _array(b["counts"], np.int64)
                keep = (n > 0) & (seen != END_HASH)
                if only is not None:
                    keep &= np.isin(seen, only)
                yield pa.record_batch([pa.array(seen[keep].view(np.int64)), pa.array(n[keep])], ["word", "n"])

        return sums(count)

    def sums(f) -> DataFrame:
        return blocks.select("vocabulary", "counts").mapInArrow(f, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))

    reported = scratch.keep(sums(reports), "reports")
    end = int(END_HASH)
    slack = (reported.where(F.col("word") == end).agg(F.sum("n").alias("n")).first()["n"]) or 0
    reported = reported.where(F.col("word") != end)
    top = reported.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    only = None
    if len(top) == HEAD and top[-1]["n"] > slack:
        some = reported.where(F.col("n") >= top[-1]["n"] - slack).select("word").limit(REPORTED + 1).collect()
        if len(some) <= REPORTED:
            only = np.array([r["word"] for r in some], np.int64).view(np.uint64)
    top = counted(only).orderBy(F.desc("n"), "word").limit(HEAD).collect()
    scratch.drop("reports")
    return np.array([r["word"] for r in top], np.int64).view(np.uint64)


def _local(b: dict, head: np.ndarray) -> np.ndarray:
    """Head number of each word of a block's vocabulary; len(head) for the end token; -1 for others."""
    seen = _array(b["vocabulary"], np.uint64)
    out = np.full(len(seen), -1, np.int64)
    for h, k in [*zip(head, range(len(head))), (END_HASH, len(head))]:
        i = int(np.searchsorted(seen, h))
        if i < len(seen) and seen[i] == h:
            out[i] = k
    return out


def _before(tokens: np.ndarray, held: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each (the end token before a text's first), and whether its text trains."""
    before = np.concatenate(([end], tokens[:-1]))
    return before, ~np.repeat(held, np.diff(np.concatenate(([0], ends))))


def _bigrams(blocks: DataFrame, head: np.ndarray) -> np.ndarray:
    """Counts of neighbouring head words (and the end token) in the training texts."""
    side = len(head) + 1

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, np.int64)
        for b in _each(it):
            at = _local(b, head)[_unpack(b["tokens"].as_buffer())]
            before, train = _before(at, _array(b["held"], bool), _array(b["ends"], np.int64), side - 1)
            good = train & (at >= 0) & (before >= 0)
            total += np.bincount(before[good] * side + at[good], minlength=side * side)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["pair", "n"])

    got = blocks.select("held", "ends", "tokens", "vocabulary").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # (HEAD + 1)**2 rows at most
    out = np.zeros(side * side)
    out[np.array(got.column("pair"), dtype=np.int64)] = np.array(got.column("n"))
    return out.reshape(side, side)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word of a bigram table (the last row and column is the end token, a class of its own)."""
    n = len(pairs)
    of = np.arange(n) % classes
    of[n - 1] = classes
    one = np.zeros((n, classes + 1))
    one[np.arange(n), of] = 1
    table = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(n - 1):
            to = np.bincount(of, weights=pairs[w], minlength=classes + 1)
            come = np.bincount(of, weights=pairs[:, w], minlength=classes + 1)
            self_, k = pairs[w, w], of[w]
            to[k] -= self_
            come[k] -= self_
            table[k] -= to
            table[:, k] -= come
            table[k, k] -= self_
            rows, columns = table + to[None, :], table + come[:, None]
            gain = (_phi(rows) - _phi(table)).sum(axis=1) + (_phi(columns) - _phi(table)).sum(axis=0)
            d = np.diag(table)
            gain += _phi(d + to + come + self_) - _phi(d) - (_phi(d + to) - _phi(d)) - (_phi(d + come) - _phi(d))
            out, into = table.sum(axis=1), table.sum(axis=0)
            gain -= _phi(out + to.sum() + self_) - _phi(out) + _phi(into + come.sum() + self_) - _phi(into)
            j = int(np.argmax(gain[:classes]))
            if gain[j] <= gain[k] + 1e-9:
                j = k
            moved += j != k
            of[w] = j
            table[j] += to
            table[:, j] += come
            table[j, j] += self_
        if not moved:
            break
    return of


def _near(blocks: DataFrame, head: np.ndarray, of: np.ndarray) -> DataFrame:
    """(word, n, near): training count of each word of each block, and the classes beside it there.

    near holds pairs of bytes: a slot (the class before, or SIDE and the class behind) and a count; the
    counts of a slot that is repeated add up. Words of the head have none.
    """

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(it):
            known = _local(b, head)
            tokens, counts = _unpack(b["tokens"].as_buffer()), _array(b["counts"], np.int64)
            at = np.where(known >= 0, of[known], -1)[tokens]
            _, train = _before(tokens, _array(b["held"], bool), _array(b["ends"], np.int64), 0)
            place = np.arange(len(at))
            left = np.maximum.accumulate(np.where(at >= 0, place, -1))
            left = np.where(left >= 0, at[left], END)
            right = np.minimum.accumulate(np.where(at >= 0, place, len(at) - 1)[::-1])[::-1]
            tail = np.flatnonzero((at < 0) & train)
            word, left, right = tokens[tail], left[tail].astype(np.int8), at[right[tail]].astype(np.int8)
            del tokens, at, place
            sizes, pairs = np.zeros(len(counts), np.int64), []
            for a in range(0, len(counts), WORDS_AT_ONCE):
                some = (word >= a) & (word < a + WORDS_AT_ONCE)
                w, n = (word[some] - a) * 2 * SIDE, min(WORDS_AT_ONCE, len(counts) - a)
                table = np.bincount(w + left[some], minlength=n * 2 * SIDE)
                table += np.bincount(w + SIDE + right[some], minlength=n * 2 * SIDE)
                at = np.flatnonzero(table)
                times = -(-table[at] // 255)
                last = np.cumsum(times) - 1
                one = np.full(int(times.sum()), 255, np.uint8)
                one[last] = table[at] - 255 * (times - 1)
                at = np.repeat(at, times)
                sizes[a : a + n] = 2 * np.bincount(at // (2 * SIDE), minlength=n)
                pairs.append(np.stack([(at % (2 * SIDE)).astype(np.uint8), one], axis=1).tobytes())
            keep = counts > 0
            ends = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(pairs))])
            yield pa.record_batch([pa.array(_array(b["vocabulary"], np.uint64)[keep].view(np.int64)), pa.array(counts[keep]), raw], ["word", "n", "near"])

    return blocks.select("held", "ends", "tokens", "vocabulary", "counts").mapInArrow(near, "word long, n long, near binary")


def _lexicon(blocks: DataFrame, head: np.ndarray, of: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(word, n, class): each training word's count and class, from its neighbours in all blocks."""
    one = np.zeros((len(of), SIDE))
    one[np.arange(len(of)), of] = 1
    table = one.T @ pairs @ one + 0.1
    after = np.log(table / table.sum(axis=1, keepdims=True))
    share = np.log(table.sum(axis=0)[:CLASSES])
    fixed = np.append(head, END_HASH).view(np.int64)
    by = np.argsort(fixed)
    fixed, fixed_class = fixed[by], of[by]

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(word, n, near):
            score = near[:, :SIDE] @ after[:, :CLASSES] + near[:, SIDE:] @ after[:CLASSES].T - n[:, None] * share[None, :]
            best = np.round(score, 6).argmax(axis=1)  # equal classes differ by rounding only: the first
            i = np.minimum(np.searchsorted(fixed, word), len(fixed) - 1)
            best = np.where(fixed[i] == word, fixed_class[i], best)
            return pa.record_batch([pa.array(word), pa.array(n), pa.array(best.astype(np.int32))], ["word", "n", "class"])

        word, n, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2 * SIDE))
        for batch in it:  # in order of word; the last word of a batch may go on in the next
            if not batch.num_rows:
                continue
            w, raw = np.asarray(batch.column(0)), batch.column(2)
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
            size = np.asarray(pc.binary_length(raw))
            flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, 2)
            slot = np.repeat(group, size // 2) * 2 * SIDE + flat[:, 0]
            sums = np.bincount(slot, weights=flat[:, 1], minlength=len(first) * 2 * SIDE).reshape(-1, 2 * SIDE)
            total, w = np.add.reduceat(np.asarray(batch.column(1)), first), w[first]
            if len(word) and word[0] == w[0]:
                total[0] += n[0]
                sums[0] += near[0]
            elif len(word):
                yield rows(word, n, near)
            if len(w) > 1:
                yield rows(w[:-1], total[:-1], sums[:-1])
            word, n, near = w[-1:], total[-1:], sums[-1:]
        if len(word):
            yield rows(word, n, near)

    return _near(blocks, head, of).repartition("word").sortWithinPartitions("word").mapInArrow(settle, "word long, n long, class int")


def _entries(blocks: DataFrame) -> DataFrame:
    """(word, block, at): the vocabulary of each block."""

    def entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(it):
            seen = _array(b["vocabulary"], np.int64)
            yield pa.record_batch([pa.array(seen), pa.array(np.full(len(seen), b["block"].as_py())), pa.array(np.arange(len(seen), dtype=np.int64))], ["word", "block", "at"])

    return blocks.select("block", "vocabulary").mapInArrow(entries, "word long, block long, at long")


def score(documents: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    held_out: a boolean column; rows where it is true teach nothing.
    """
    scratch = Scratch(documents.sparkSession, "brown")
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held"))
    key = dict(docs.dtypes)["id"]
    blocks = scratch.keep(_blocks(docs, key), "blocks")
    head = _head(blocks, scratch)
    pairs = _bigrams(blocks, head)
    of = exchange(pairs)
    lexicon = scratch.keep(_lexicon(blocks, head, of, pairs), "lexicon")
    sums = lexicon.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).first()
    n_all, types, n1, n2 = (sums[k] or 0 for k in ("n", "v", "n1", "n2"))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    mass = np.zeros(CLASSES + 2)
    for r in lexicon.groupBy("class").agg(F.sum(F.when(F.col("n") == 1, 1 - d).otherwise(F.col("n"))).alias("m")).collect():
        mass[r["class"]] = r["m"]
    floor = np.log10(n_all + 0.5 * (types + 1))

    back = _entries(blocks).join(lexicon, "word", "left").groupBy("block").agg(F.collect_list(F.struct((F.col("at") * 64 + F.coalesce("class", F.lit(UNKNOWN))).alias("a"), F.coalesce("n", F.lit(0)).alias("n"))).alias("info"))

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(it):
            info = b["info"].values
            a, n = (np.asarray(info.field(c)) for c in ("a", "n"))
            cls, count = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
            cls[a >> 6], count[a >> 6] = a & 63, n
            base = np.log10(count + 0.5) - floor
            with np.errstate(divide="ignore", invalid="ignore"):
                emit = np.where(count > 0, np.log10(np.where(count == 1, 1 - d, count) / mass[cls]), 0.0)
            tokens, ends = _unpack(b["tokens"].as_buffer()), _array(b["ends"], np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            total = lambda x: np.add.reduceat(x[tokens], starts)
            seq = (cls | np.where(count == 1, 64, 0)).astype(np.uint8)[tokens].tobytes()
            yield pa.record_batch(
                [b["ids"].values, pa.array(_array(b["held"], bool)), pa.array(ends - starts), pa.array(total((count > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(emit)), pa.array([seq[i:j] for i, j in zip(starts, ends)], pa.binary())],
                ["id", "held", "n_tokens", "n_known", "base", "emit", "classes"],
            )

    settled = blocks.select("block", "ids", "held", "ends", "tokens").join(back, "block").select("ids", "held", "ends", "tokens", "info").mapInArrow(settle, f"id {key}, held boolean, n_tokens long, n_known long, base double, emit double, classes binary")
    settled = scratch.keep(settled, "settled")
    scratch.drop("blocks")
    scratch.drop("lexicon")

    side = CLASSES + 2

    def steps(raw) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(raw, np.uint8).astype(np.int64)
        return np.concatenate(([END], x[:-1])), x

    def transitions(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128 * 128, np.int64)
        for batch in it:
            flat = np.frombuffer(b"".join([bytes([END]) + x.as_py() for x in batch.column(0)]), np.uint8).astype(np.int64)
            total += np.bincount(flat[:-1] * 128 + flat[1:], minlength=128 * 128)
            n = batch.num_rows - 1  # the end of a text, then the mark set before the next
            total[END * 128 + END] -= n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["pair", "n"])

    raw = np.zeros((128, 128))
    for r in settled.where(~F.col("held")).select("classes").mapInArrow(transitions, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 128 * 128 rows at most
        raw[r["pair"] >> 7, r["pair"] & 127] = r["n"]
    share = np.zeros((128, side))  # a singleton counts as its class by 1 - D, as the unknown word by D
    for x in range(128):
        if (x & 63) < side:
            share[x, x & 63] += 1 - d if x & 64 else 1
            share[x, UNKNOWN] += d if x & 64 else 0
    counts = share.T @ raw @ share
    prior = (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * side)
    table = np.log10((counts + 5 * prior) / (counts.sum(axis=1, keepdims=True) + 5))

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for x, e in zip(batch.column("classes"), batch.column("emit")):
                before, at = steps(x.as_buffer())
                out.append(e.as_py() + float(table[before & 63, at & 63].sum()))
            yield pa.record_batch([*(batch.column(c) for c in ("id", "held", "n_tokens", "n_known")), pa.array(np.full(len(out), n_all)), batch.column("base"), pa.array(out, pa.float64())], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return settled.mapInArrow(finish, f"id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
