"""The queries opN_<name> and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import table


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based bigram scores of all documents, learnt outside the held-out fold."""
    from tidewater.llm import brown_lm as B

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return B.score(docs, _fold(5) == 1).withColumnRenamed("id", "doc_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    from tidewater.llm import packing as K

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = K.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at a cosine of 0.95 or more."""
    from tidewater.llm import hnsw as H

    out = H.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text of documents."""
    from tidewater.llm import secrets as S

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = S.scan(docs, S.trained(docs))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != "markov")
    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(S.joined(base), 256).alias("base_sha256"), S.joined(F.col("found")).alias("spans"), n("markov"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page."""
    from tidewater.llm import url_filter as U

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return U.judge(pages).withColumnRenamed("id", "page_id")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at a Jaccard similarity of 0.85 or more."""
    from tidewater.llm import jaccard as J

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return J.join(docs, 4, 85, 100).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item's words in tiles of five words or more."""
    from tidewater.llm import decontaminate as D

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = D.matches(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards of near equal bytes, tokens and rows."""
    from tidewater.llm import sharding as S

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = S.shard(docs, 16)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def _fold(m: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(m))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels outside the held-out fold."""
    from tidewater.llm import ngram_models as M

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(_fold(5) != 0)
    model = M.train_toxicity(docs, labels)
    scored = M.score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows outside the held-out fold."""
    from tidewater.llm import ngram_models as M

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = M.train_language(docs.where(_fold(4) != 2))
    scored = M.predict_language(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_best_fit_packing, op3_embedding_near_dedup, op4_secret_scans, op5_url_filters, op6_ngram_jaccard_join, op7_benchmark_decontamination, op8_sharding, op9_toxicity, op10_language_id)}
_COMPONENTS = "r(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u), c AS (SELECT a, min(b) component FROM r GROUP BY a)"

_OP3 = f"""WITH RECURSIVE nodes AS (SELECT vec_id id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings),
good AS (SELECT * FROM nodes WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT x.id u, y.id v FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95), {_COMPONENTS}
SELECT nodes.id vec_id, (SELECT count(*) FROM e WHERE e.u = nodes.id) n_links, c.component component_id, nodes.id = c.component kept FROM nodes JOIN c ON c.a = nodes.id"""

def _attribute(tag: str, name: str) -> str:
    """A tag's attribute for DuckDB, whose expressions know no case."""
    got = [rf"""nullif(regexp_extract({tag}, '(?i)(?:^|[\s"''/]){name}\s*=\s*{form}', 1), '')""" for form in ('"([^"]*)"', "''([^'']*)''", r"""([^\s"''>][^\s>]*)""")]
    return f"coalesce({', '.join(got)}, '')"


_TAGS = (
    f"SELECT url source, {_attribute('t', 'href')} link FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<link\\b([^<>]*)>', 1)) t FROM pages WHERE contains(url, '://')) WHERE list_contains(regexp_split_to_array(lower({_attribute('t', 'rel')}), '\\s+'), 'canonical') "
    f"UNION ALL SELECT url, regexp_extract({_attribute('t', 'content')}, '(?i)\\burl\\s*=\\s*[\"'']?([^\"''\\s>;]+)', 1) FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<meta\\b([^<>]*)>', 1)) t FROM pages WHERE contains(url, '://')) WHERE lower({_attribute('t', 'http-equiv')}) = 'refresh'"
)
_OP5 = rf"""WITH RECURSIVE tags AS (SELECT source, replace(link, '&amp;', '&') link FROM ({_TAGS})),
named AS (SELECT source, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(source, '^([^/?#]*:)//', 1) || link WHEN starts_with(link, '/') THEN regexp_extract(source, '^([^/?#]*://[^/?#]*)', 1) || link ELSE coalesce(nullif(regexp_extract(source, '^([^/?#]*://[^/?#]*/(?:[^?#]*/)?)', 1), ''), regexp_extract(source, '^([^/?#]*://[^/?#]*)', 1) || '/') || link END target FROM tags WHERE link IS NOT NULL AND link <> ''),
pairs AS (SELECT DISTINCT regexp_replace(source, '(?s)#.*$', '') a, regexp_replace(target, '(?s)#.*$', '') b FROM named),
e AS MATERIALIZED (SELECT a u, b v FROM pairs UNION SELECT b, a FROM pairs), nodes AS (SELECT DISTINCT u id FROM e),
r(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
rules(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
urls AS (SELECT id url FROM nodes UNION SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
parts AS (SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) path FROM urls),
own AS (SELECT p.url, arg_max(rules.rule, length(rules.rule)) rule, arg_max(rules.verdict, length(rules.rule)) verdict FROM parts p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.url),
carried AS (SELECT r.a url, bool_or(own.verdict = 'allow') any_allow FROM r JOIN own ON own.url = r.b GROUP BY r.a)
SELECT pages.page_id, coalesce(parts.host, '') host, coalesce(parts.path, '') path, own.rule, coalesce(own.verdict, CASE WHEN carried.url IS NULL OR any_allow THEN 'allow' ELSE 'block' END) verdict
FROM pages LEFT JOIN parts ON parts.url = pages.url LEFT JOIN own ON own.url = pages.url LEFT JOIN carried ON carried.url = regexp_replace(pages.url, '(?s)#.*$', '')"""

_OP6 = rf"""WITH RECURSIVE words AS (SELECT doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
sets AS (SELECT id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM words),
nodes AS (SELECT id, len(s) n FROM sets), each AS (SELECT id, unnest(s) k FROM sets),
met AS (SELECT x.id a, y.id b, count(*) i FROM each x JOIN each y ON x.k = y.k AND x.id <> y.id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a u, b v FROM met JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), {_COMPONENTS}
SELECT nodes.id doc_id, nodes.n n_shingles, c.component component_id FROM nodes JOIN c ON c.a = nodes.id"""

#: Edges by rule for alias_verdicts: of every three pages two redirect to the first, and every ninth to the page before it.
_ALIASES = "SELECT a.url source, b.url target FROM pages a JOIN pages b ON b.page_id = CASE WHEN a.page_id % 9 = 0 THEN a.page_id - 1 ELSE a.page_id - a.page_id % 3 END WHERE a.page_id % 54 <> 0 AND a.page_id <> b.page_id AND a.url IS NOT NULL AND b.url IS NOT NULL"


def alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator over all pages with redirects by rule, since the pages themselves name none."""
    from tidewater.llm import url_filter as U

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    to = F.when(F.col("page_id") % 9 == 0, F.col("page_id") - 1).otherwise(F.col("page_id") - F.col("page_id") % 3)
    a = pages.where("page_id % 54 <> 0 and url is not null").select(F.col("url").alias("source"), to.alias("to"), "page_id").where("to <> page_id")
    edges = a.join(pages.where("url is not null").select(F.col("page_id").alias("to"), F.col("url").alias("target")), "to")
    return U.judge(pages, edges).withColumnRenamed("id", "page_id")


#: The others fit models, place by heuristics, tokenise or tile, which SQL cannot express; tests hold them against brute force.
SQL: dict[str, str] = {"op3_embedding_near_dedup": _OP3, "op5_url_filters": _OP5, "op6_ngram_jaccard_join": _OP6}
QUERIES["alias_verdicts"] = alias_verdicts
SQL["alias_verdicts"] = _OP5.replace("pairs AS (SELECT DISTINCT", f"pairs AS (SELECT DISTINCT regexp_replace(source, '(?s)#.*$', '') a, regexp_replace(target, '(?s)#.*$', '') b FROM ({_ALIASES}) UNION SELECT", 1)
