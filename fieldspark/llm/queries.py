"""The queries opN_<name> of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, langid, licenses, mixing, simhash, topk, toxicity, urls
from .common import crc_bucket, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest found of every 20th embedding, among all others."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 highest integer inner products of every 20th embedding, among all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).drop("text", "source", "draws")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the example made of each pair of conversations: number 2k is the chosen one, 2k + 1 the rejected one."""
    turns = table(spark, sf_dir, "conversations")
    pairs = chat.format_pairs(turns, F.expr("conv_id div 2 - cast(conv_id % 2 < 0 as bigint)"), F.col("conv_id") % 2 == 0)
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda s: s["text"]), "").cast("binary"), 256)
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["loss"] * F.length(s["text"]))
    return pairs.select(
        "pair_id", *[F.col(c).cast("long").alias(c) for c in ("n_prompt", "n_chosen", "n_rejected")], F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"),
        digest(F.col("chosen")).alias("chosen_sha256"), digest(F.col("rejected")).alias("rejected_sha256"), trained(F.col("chosen")).alias("chosen_trained"), trained(F.col("rejected")).alias("rejected_trained"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).select("doc_id", "coded.*")
    numbers = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of those whose crc32 modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_bucket("doc_id", 5) == 0)
    model = langid.fit(docs.filter(~F.col("held_out")))
    out = langid.predict(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by labels of those whose crc32 modulo 4 is not 2."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_bucket("doc_id", 4) != 2))
    out = toxicity.score(docs, model, out="score")
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_ann, op2_licenses, op3_simhash, op4_topk, op5_urls, op6_mixing, op7_preferences, op8_bpe, op9_language_id, op10_toxicity)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op4_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL["op5_urls"] = """
WITH rules(verdict, rule, h, p) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rests),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
fits AS (
  SELECT u.page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM urls u
  JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id
"""

ORACLE_SQL["op7_preferences"] = """
WITH convs AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t
  FROM conversations GROUP BY conv_id),
pairs AS (
  SELECT pair_id, coalesce(max(t) FILTER (side = 0), []) AS c, coalesce(max(t) FILTER (side = 1), []) AS r FROM convs GROUP BY pair_id),
sized AS (
  SELECT *, coalesce(list_min(list_filter(range(least(len(c), len(r))), lambda i: c[i + 1] IS DISTINCT FROM r[i + 1])), least(len(c), len(r))) AS n FROM pairs),
parts AS (
  SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM sized),
texts AS (
  SELECT *, list_transform([p, c, r], lambda s: array_to_string(list_transform(s, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '')) AS x,
    list_transform([c, r], lambda s: coalesce(list_sum(list_transform(list_filter(s, lambda x: x.role = 'assistant'), lambda x: length(coalesce(x.text, '')) + 11)), 0)) AS w
  FROM parts)
SELECT pair_id, CAST(n AS BIGINT) AS n_prompt, len(c) AS n_chosen, len(r) AS n_rejected, sha256(coalesce(x[1], '')) AS prompt_sha256,
  sha256(coalesce(x[2], '')) AS chosen_sha256, sha256(coalesce(x[3], '')) AS rejected_sha256, CAST(w[1] AS BIGINT) AS chosen_trained, CAST(w[2] AS BIGINT) AS rejected_trained
FROM texts
"""

def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"


_TEMPLATES = ", ".join(f"({k}, '{x.label}', {exact}, '{x.text}', {_sql_list(x.marks)}, {_sql_list(x.without)})" for k, (exact, x) in enumerate([(True, licenses.Passage(*x)) for x in licenses.BASE] + [(False, x) for x in licenses.PASSAGES]))

# Each diagonal on which a passage has a word 3-gram in common with a text is a guess of the passage's place; the guess of most
# 3-grams within six diagonals is tried. Its words (from where the first common 3-gram near it puts the passage's start to where
# the last puts its end) (or up to six words further, if fewer edits do) must keep 75 % of the passage by word edits, hold its marks and none of its kin's words, and keep
# more words than the rivals of other labels that overlap it.
ORACLE_SQL["op2_licenses"] = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
templates(template, label, exact, text, marks, without) AS (VALUES {_TEMPLATES}),
tw AS (SELECT *, string_split(text, ' ') AS w FROM templates),
tg AS (SELECT template, exact, len(w) - 2 AS grams, unnest(list_transform(range(len(w) - 2), lambda i: {{'pos': i, 'gram': w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]}})) AS g FROM tw),
dg AS (SELECT doc_id, unnest(list_transform(range(len(w) - 2), lambda i: {{'pos': i, 'gram': w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]}})) AS g FROM docs),
hits AS (SELECT doc_id, template, exact, grams, dg.g.pos AS pos, tg.g.pos AS tpos FROM dg JOIN tg ON dg.g.gram = tg.g.gram),
diagonals AS (SELECT doc_id, template, exact, grams, pos - tpos AS d, count(*) AS votes, min(tpos) AS head, max(tpos) AS tail FROM hits GROUP BY ALL),
base AS (
  SELECT doc_id, count(*) FILTER (votes = grams) AS n_base, min(d) FILTER (votes = grams) AS first_word, max(d) FILTER (votes = grams) AS last_word,
    list_distinct(coalesce(list(label) FILTER (votes = grams), [])) AS labels, max(votes / grams) AS score
  FROM diagonals JOIN templates USING (template) WHERE diagonals.exact GROUP BY doc_id),
tried AS (
  SELECT a.doc_id, a.template, a.d, arg_min(b.d, (b.head, -b.votes, b.d)) AS a, arg_max(b.d, (b.tail, b.votes, b.d)) AS b
  FROM diagonals a JOIN diagonals b ON a.doc_id = b.doc_id AND a.template = b.template AND abs(a.d - b.d) <= 6 WHERE NOT a.exact
  GROUP BY a.doc_id, a.template, a.d, a.votes HAVING (a.votes, -a.d) = max((b.votes, -b.d))),
placed AS (
  SELECT doc_id, template, d, label, marks, without, c.w AS t, docs.w AS w, greatest(a, 0) AS a, greatest(least(b + len(c.w), len(docs.w)) - 1, a, 0) AS b0 FROM tried JOIN tw c USING (template) JOIN docs USING (doc_id)),
ended AS (SELECT * EXCLUDE (b0), unnest(range(b0, least(b0 + 6, len(w) - 1) + 1)) AS b FROM placed),
spelt AS (
  SELECT * EXCLUDE (w), w[a + 1 : b + 1] AS span, levenshtein(array_to_string(list_transform(w[a + 1 : b + 1], lambda x: chr(CAST(64 + coalesce(list_position(t, x), 0) AS INTEGER))), ''), array_to_string(list_transform(t, lambda x: chr(CAST(64 + list_position(t, x) AS INTEGER))), '')) AS edits
  FROM ended),
least AS (SELECT doc_id, template, d, arg_min(s, (edits, -b)) AS s FROM spelt s GROUP BY doc_id, template, d),
spans AS (SELECT s.*, greatest(0, len(s.t) - s.edits) AS kept FROM least),
scored AS (
  SELECT *, kept / len(t) AS cover, kept / len(t) >= 0.75 AND len(list_filter(marks, lambda m: contains(' ' || array_to_string(span, ' ') || ' ', ' ' || m || ' '))) = len(marks) AND NOT list_has_any(span, without) AS valid FROM spans),
won AS (
  SELECT * FROM scored s WHERE valid AND NOT EXISTS (
    SELECT 1 FROM scored r WHERE r.doc_id = s.doc_id AND r.valid AND r.label <> s.label AND r.a <= s.b AND r.b >= s.a AND (r.kept > s.kept OR (r.kept = s.kept AND r.template < s.template)))),
passages AS (SELECT doc_id, max(cover) AS score FROM scored GROUP BY doc_id),
labelled AS (SELECT doc_id, list(DISTINCT label) AS labels FROM won GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(labelled.labels, [])))), ',') AS labels, CAST(greatest(coalesce(base.score, 0), coalesce(passages.score, 0)) AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN passages USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""
