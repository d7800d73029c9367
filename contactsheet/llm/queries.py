"""The operators' queries over the harness tables, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.llm import collocations, decontamination, hard_negatives, host_rules, html_extraction, jaccard_join, lm_scoring, mixing, quality_classifier, sharding, token_counts, token_files, url_filter

ROOT = str(Path(__file__).resolve().parents[2])
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # for Python workers that start elsewhere
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_quality_rules(spark, d):
    """The counts of every document are kept in the checkpoint folder, so that texts are read once."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    judged = host_rules.checkpointed(host_rules.features(docs).drop("text"))
    verdicts = host_rules.host_verdicts(judged, F.col("source"))
    on = F.col("source")
    out = host_rules.join_verdicts(judged.withColumn("text", F.lit(None).cast("string")), verdicts, on)
    return out.select(
        "doc_id",
        *(F.col(f"rules_of.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
        (~F.col("rules_of.base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"),
    )


SQL["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT r, doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, ws FROM w),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM c WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT r, sum(least(8, i - coalesce(p, i - 8))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM rep) GROUP BY r),
f AS (SELECT c.*, coalesce(n, 0) AS n_repeat_words FROM c LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 5 * n_symbols > n_words AS symbols,
  10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS lengths FROM f),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS k FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule,
  unnest([short, repeats, symbols, lines, lengths]) AS bad FROM j) GROUP BY ALL),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN v > 0 THEN greatest(2.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS wt FROM m),
bad AS (SELECT source FROM h JOIN p USING (rule) GROUP BY source HAVING max((k + wt * m) / (n + wt)) > 0.75)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM j.source) AS kept FROM j
"""


@query
def op2_token_counts(spark, d):
    import public_tokenizers

    docs = table(spark, d, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


#: The rules of the query, and the names and ends of the domains on its block list.
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_ENDS = ["example.com", "example.net", "example.org"]


@query
def op4_url_filter(spark, d):
    blocked = spark.createDataFrame([(f"{a}.{b}",) for a in BLOCKED_NAMES for b in BLOCKED_ENDS], "host string")
    pages = table(spark, d, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES, blocked).select("page_id", "host", "path", "rule", "verdict")


SQL["op4_url_filter"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
l AS (SELECT a || '.' || b AS d FROM unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) x(a),
  unnest(['example.com', 'example.net', 'example.org']) y(b)),
f AS (SELECT page_id, host, path, (SELECT struct_pack(k := h || q, v := v) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  ORDER BY length(h || q) DESC LIMIT 1) AS best, EXISTS (SELECT 1 FROM l WHERE host = d OR ends_with(host, '.' || d)) AS hit FROM p)
SELECT page_id, host, path, best.k AS rule, coalesce(best.v, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""


MIX_WEIGHTS = [5, 2, 1]


@query
def op3_mixing(spark, d):
    """A document's taken words are its own times its copies; rows that repeat a document are each taken as often."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    taken = mixing.mix(docs, MIX_WEIGHTS)
    if not docs.groupBy("doc_id", "source").count().where("count > 1").isEmpty():
        rows = docs.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), mixing.word_count(F.col("text")).alias("own"))
        taken = taken.join(rows, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("size", F.col("own"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op7_sharding(spark, d):
    return sharding.shard(table(spark, d, "documents").select("doc_id", "text"), 8)


@query
def op6_decontamination(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    leaks = decontamination.find_leaks(docs, table(spark, d, "benchmark"))
    n_hit = F.aggregate("leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return leaks.select(
        "doc_id",
        "leaks.n_words",
        n_hit.alias("n_hit"),
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op9_jaccard_join(spark, d):
    return jaccard_join.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


def remainder(by: int):
    """crc32 of the doc_id as text, modulo by."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % by


@query
def op5_lm_scoring(spark, d):
    return lm_scoring.score_texts(table(spark, d, "documents").select("doc_id", "text"), remainder(7) == 2, order=3)


@query
def op8_quality_classifier(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id", "quality")
    return quality_classifier.classify(docs, labels, remainder(3) == 1)


@query
def op1_html_extraction(spark, d):
    return html_extraction.extract(table(spark, d, "pages"))


@query
def op13_token_files(spark, d):
    """The files go to a folder of this run in the checkpoint folder."""
    import public_tokenizers

    docs = table(spark, d, "documents").select("doc_id", "text")
    return token_files.token_table(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op12_hard_negatives(spark, d):
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q,
  row_number() OVER () AS r FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT ar, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other) AS w
  FROM s WHERE same QUALIFY w <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, w ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score,
  score AS negative_score FROM p JOIN s ON s.ar = p.ar AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""


@query
def op11_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents").select("lang", "text"))


SQL["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) r(k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, a, k, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, c.k, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
q AS (SELECT lang, a, k, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, k, string_split(phrase, ' ') AS ws, unnest(range(2, k)) AS m FROM f WHERE k >= 3)),
o AS (SELECT lang, array_to_string(ws[i:i+m-1], ' ') AS phrase, max(a) AS longer FROM q GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, true))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
JOIN t USING (lang) WHERE rank <= 2000
"""
