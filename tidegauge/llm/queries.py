"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import alignment, decontam, html, kneser, lines, mixing, phrases, rules, simhash, substring, topk, toxicity, urls
from tidegauge.llm.common import crc_of, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LEAST_TOXIC = 0.7
TOKENIZERS = "/opt/tokenizers"  # folder of the public tokenizers' files


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, k=10)


ORACLES["op1_topk"] = """
WITH part AS (
  SELECT vec_id, CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) AS x, i
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM part q JOIN part c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 10"""


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge(table(spark, folder, "pages"), rules)


ORACLES["op2_url_filter"] = """
WITH rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS nr FROM rest),
fit AS (
  SELECT nr, h || p AS rule, action, row_number() OVER (PARTITION BY nr ORDER BY length(h || p) DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (nr)"""


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    classifier = toxicity.train(docs, toxicity.training_labels(table(spark, folder, "labels")))
    return toxicity.scored(docs, classifier).select(
        "doc_id", F.coalesce(crc_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= LEAST_TOXIC, 1).otherwise(0).alias("predicted"))


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce(crc_of("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    model = kneser.train(docs.filter("not held_out"))
    return kneser.score(docs, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"), distance=3, width=3)


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents")).drop("text")


@query
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, folder, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_repeated(table(spark, folder, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op10_line_dedup"] = """
WITH parts AS (
  SELECT nr, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT row_number() OVER () AS nr, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM parts),
often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.nr, k.doc_id, k.line, k.pos, coalesce(k.doc_id < o.last, false) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY nr, doc_id"""


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    return aligned.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


ORACLES["op12_collocations"] = """
WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT nr, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn FROM (SELECT nr, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS ps FROM d)),
words AS (SELECT nr, lang, pn, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
          FROM (SELECT nr, lang, pn, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces)),
ahead AS (SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM words WINDOW x AS (PARTITION BY nr, pn ORDER BY p)),
f1 AS (SELECT lang, w1, count(*) AS f FROM ahead GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 c
  JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 10
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f FROM f3 c
  JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f FROM f3 c
  JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(f) AS f FROM (
  SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
left_over AS (SELECT o.* FROM one o LEFT JOIN around g ON g.lang = o.lang AND g.phrase = o.phrase WHERE coalesce(100 * g.f >= 50 * o.a, false) = false),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query
def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op13_quality_rules"] = """
WITH d AS (
  SELECT row_number() OVER () AS nr, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
words AS (SELECT nr, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
grams AS (SELECT nr, p, w || ' ' || lead(w) OVER x || ' ' || lead(w, 2) OVER x AS g FROM words WINDOW x AS (PARTITION BY nr ORDER BY p)),
twice AS (SELECT nr, g FROM grams WHERE g IS NOT NULL GROUP BY nr, g HAVING count(*) > 1),
covered AS (SELECT nr, count(DISTINCT p + k) AS n FROM grams JOIN twice USING (nr, g), (VALUES (0), (1), (2)) AS v(k) GROUP BY nr),
m AS (
  SELECT doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '\\p{Lu}{2,}')) AS shouted, len(regexp_extract_all(t, '!!+')) AS exclaimed,
         len(list_filter(ws, lambda w: regexp_matches(w, '\\p{L}'))) AS lettered,
         len(list_filter(ws, lambda w: list_contains(string_split('a and are as be by for from have in is it of on that the this to was with auf das dem den der '
           || 'die ein eine im ist mit nicht sich und von zu au dans de des du et la le les par pour que qui un une con del el en es las lo los no para por se su y', ' '),
           lower(w)))) AS stop,
         len(list_filter(ls, lambda l: regexp_matches(l, '^[\\x20\\x09-\\x0D]*([-*•‣·]|[0-9]+[.)])[\\x20\\x09-\\x0D]'))) AS bullets,
         len(list_filter(ls, lambda l: regexp_matches(l, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z'))) AS ellipses
  FROM d LEFT JOIN covered USING (nr))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1 AND shouted / n_words <= 0.4
        AND exclaimed / n_words <= 0.2 AND lettered / n_words >= 0.7 AND stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND bullets / n_lines <= 0.9
        AND ellipses / n_lines <= 0.5 AND word_chars / n_lines >= 5) AS kept
FROM m"""
