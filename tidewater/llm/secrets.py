"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers.

All of it is DataFrame expressions. A candidate string is scored by the log-likelihood ratio of two
first-order Markov models over a 68-symbol alphabet, one trained on strings labelled random and one
on strings labelled ordinary, with add-one smoothing; the ratios form one 68 x 68 table (a fixed
size, whatever the data) that is written into the plan as a literal.

A document's spans are one expression of its own text: positions are running sums over the pieces
between matches, so no join, window or shuffle is needed, and ids are carried along, never compared.

Defined results: a null or empty text has no span; rows are scanned each for itself, whether or not
their ids or texts repeat; an empty table gives an empty result; other columns are ignored. Matches
that start at one place are ordered by kind as listed, then by end. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The base patterns. Those of access and hex hold their least lengths, which finds the
#: same matches, since a match is always the whole rest of a run of its characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIDE = len(SYMBOLS)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Ordinary identifiers and random strings that training takes at most (each).
MOST_SAMPLES = 20_000
#: Least log-likelihood ratio (natural logarithm), whole and per character.
LEAST_RATIO, LEAST_PER_CHAR = 12.0, 0.35


def _code(char: Column) -> Column:
    return F.instr(F.lit(SYMBOLS), char) - 1


def _transitions(samples: DataFrame) -> DataFrame:
    """(label, a, b, n) of neighbouring symbols of samples(text, label)."""
    at = samples.where("length(text) > 1").select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"))
    return at.select("label", F.instr(F.lit(SYMBOLS), F.substring("pair", 1, 1)).alias("a"), F.instr(F.lit(SYMBOLS), F.substring("pair", 2, 1)).alias("b")).where("a > 0 and b > 0").groupBy("label", "a", "b").agg(F.count("*").alias("n"))


def train(samples: DataFrame) -> list[float]:
    """samples(text, label 1 random / 0 ordinary) -> SIDE * SIDE log-likelihood ratios of a symbol after another."""
    count = [[[1.0] * SIDE for _ in range(SIDE)] for _ in range(2)]
    for r in _transitions(samples.where("text is not null and label in (0, 1)")).collect():  # 2 * 68 * 68 rows at most
        count[r["label"]][r["a"] - 1][r["b"] - 1] += r["n"]
    return [math.log(count[1][a][b] / sum(count[1][a])) - math.log(count[0][a][b] / sum(count[0][a])) for a in range(SIDE) for b in range(SIDE)]


def random_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Strings labelled random: digests by rule, written as hex, base64, URL-safe base64 and upper-case keys."""
    one = spark.range(n).select(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512).alias("d"), "id")
    b64 = F.base64(F.unhex(F.substring("d", 1, 64)))
    plain = F.regexp_replace(b64, "[+/=\\s]", "")
    forms = F.array(F.substring("d", 1, 40), b64, F.translate(b64, "+/=", "-_"), F.upper(plain), plain)
    return one.select(F.explode(forms).alias("text"), F.lit(1).alias("label"))


def ordinary_samples(docs: DataFrame, id_col: str, text_col: str, most_docs: int = 500) -> DataFrame:
    """Identifiers labelled ordinary: words of the documents of the least id hashes (most_docs of them), alone and joined as identifiers are."""
    least = [r[0] for r in docs.select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i"), "i").limit(most_docs).collect()]
    words = docs.where(F.col(id_col).isin(least)).select(F.xxhash64(id_col).alias("k"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![\p{L}0-9])[A-Za-z]{2,40}(?![\p{L}0-9])"), F.lit(0))).alias("w")).where("length(w) > 0")
    w = words.groupBy("w").agg(F.min("k").alias("k")).orderBy(F.xxhash64("w"), "w").limit(MOST_SAMPLES // 4)
    paired = w.select("w", F.lead("w").over(Window.orderBy("k", "w")).alias("x"))  # MOST_SAMPLES / 4 rows at most
    x = F.coalesce("x", F.lit("id"))
    forms = F.array(F.col("w"), F.concat_ws("_", F.lower("w"), F.lower(x)), F.concat(F.lower("w"), F.initcap(x)), F.concat_ws("/", F.lower("w"), F.lower(x)), F.concat_ws("-", F.lower("w"), F.lower(x)), F.upper(F.concat_ws("_", "w", x)))
    return paired.select(F.explode(forms).alias("text"), F.lit(0).alias("label"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Running sums of an array, in chunks of about the root of its length, so that no long array is copied at each step."""

    def summed(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out")))

    def whole(x: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(x))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / side).cast("int")), lambda c: summed(F.slice(x, c * side + 1, side)))
        return _let(chunks, lambda cs: _let(summed(F.transform(cs, lambda c: c["at"]))["out"], lambda ends: F.flatten(F.zip_with(cs, ends, lambda c, end: F.transform(c["out"], lambda at: at + end - c["at"])))))

    return _let(sizes, lambda x: F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(whole(x)))


def _ratio(value: Column, table: Column) -> Column:
    """The log-likelihood ratio of a string: the sum over its pairs of neighbouring symbols."""
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("before"), F.when(s["before"] < 0, F.lit(0.0)).otherwise(s["sum"] + F.element_at(table, s["before"] * SIDE + c + 1)).alias("sum"))
    return F.aggregate(F.transform(F.split(value, ""), lambda c: _code(c)), start, step)["sum"]


_NONE = "array<struct<start:bigint,rank:int,kind:string,end:bigint,part:string>>"


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches of one pattern, with the part of each that is judged."""

    def placed(hits: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else hits
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        each = F.arrays_zip(hits.alias("hit"), parts.alias("part"), _running(sizes).alias("end"))
        return F.transform(each, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(KINDS.index(kind) + 1).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["part"].alias("part")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(_NONE))


def found(text: Column, table: list[float] | None) -> Column:
    """array<struct<start, rank, kind, end>> of a text's spans in code points, end exclusive, in order of start, then kind as listed.

    Base kinds keep all their spans, overlapping ones too; a markov span is kept where no base span
    overlaps it. table: what train() returned; without it, only the base kinds are sought.
    """
    text = F.coalesce(text, F.lit(""))
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"]))
    assign = F.filter(_found(text, ASSIGN, "assign"), lambda x: F.length(x["part"]) >= 8)
    others = [_found(text, ACCESS, "access"), _found(text, HEX, "hex")]
    if not table:
        return F.array_sort(bare(F.concat(assign, *others)))
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folds to one literal

    def with_markov(a: Column) -> Column:
        def free(x: Column) -> Column:  # access and hex matches lie within one candidate, so the string itself tells
            inside = x["part"].rlike(ACCESS) | x["part"].rlike(HEX) | F.exists(a, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
            return ~inside & _let(_ratio(x["part"], ratios), lambda r: (r >= LEAST_RATIO) & (r >= LEAST_PER_CHAR * F.length(x["part"])))

        return F.concat(a, *others, F.filter(_found(text, CANDIDATE, "markov"), free))

    return F.array_sort(bare(_let(assign, with_markov)))


def scan(docs: DataFrame, table: list[float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and found(), empty where nothing is found."""
    return docs.select(F.col(id_col).alias("id"), found(F.col(text_col), table).alias("found"))


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def masked(text: Column, found: Column) -> Column:
    """The text with every span (overlapping ones merged) replaced by [secret]."""
    step = F.aggregate(
        found,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("[secret]"))).otherwise(F.lit(""))).alias("out"), x["end"].cast("bigint").alias("at"))),
    )
    return F.when(F.size(found) == 0, text).otherwise(F.concat(step["out"], F.substring(text, (step["at"] + 1).cast("int"), F.length(text))))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """A table from random strings made by rule and identifiers of the documents themselves."""
    return train(random_samples(docs.sparkSession).unionByName(ordinary_samples(docs, id_col, text_col)))
