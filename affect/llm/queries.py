"""The registered queries of this subpackage: one for each operator, over its whole table, and the pipeline.

``Q`` maps names to ``(spark, sf_dir) -> DataFrame``, ``O`` to DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affect.llm import chat, collocations, decontaminate, jaccard_join, packing, quality, ranked_search, secrets, sketch, substring_dedup, toxicity, url_filter, warc
from affect.llm.common import table

Q: dict = {}
O: dict = {}  # noqa: E741


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's vocabulary on the driver."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.contamination(docs, benchmark).select("doc_id", "contamination.*")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


Q["op1_decontaminate"] = op1_decontaminate
O["op1_decontaminate"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT rid, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item_id FROM doc_windows JOIN windows USING (n, win)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.dialogues(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return found.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


Q["op2_chat"] = op2_chat
O["op2_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, (number // 512) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS number FROM turns)),
segments AS (SELECT DISTINCT conv_id, segment FROM placed),
instructions AS (SELECT conv_id, text, min(number) AS number, min(segment) AS since FROM placed WHERE role = 'system' GROUP BY conv_id, text),
said AS (
  SELECT conv_id, segment, number, role, text FROM placed
  UNION ALL SELECT s.conv_id, s.segment, f.number, 'system', f.text FROM segments s JOIN instructions f ON f.conv_id = s.conv_id AND f.since < s.segment),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY number) AS i FROM said),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
parts AS (
  SELECT conv_id, segment, speaker, i, role = speaker AS own,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' AS body
  FROM ordered JOIN speakers USING (conv_id)),
begun AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, segment, speaker ORDER BY i) - length(body) - 1 AS begin FROM parts)
SELECT conv_id, segment, speaker, CAST(count(*) AS BIGINT) AS n_messages, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_assistant,
       string_agg(head || body || chr(10), '' ORDER BY i) AS rendered,
       coalesce(string_agg(CAST(begin AS BIGINT) || ':' || CAST(begin + length(body) AS BIGINT), ',' ORDER BY i) FILTER (WHERE own), '') AS mask
FROM begun GROUP BY conv_id, segment, speaker
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=90)


Q["op3_jaccard_join"] = op3_jaccard_join
O["op3_jaccard_join"] = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + least(3, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON least_of.x = d.doc_id
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


Q["op4_substring_dedup"] = op4_substring_dedup
O["op4_substring_dedup"] = r"""
WITH doc_words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 19], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc_words WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
gone_of AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc_words) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc_words LEFT JOIN gone_of USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


Q["op5_quality"] = op5_quality


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.fingerprint("sketch").alias("fingerprint"),
                        sketch.fingerprint("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")


Q["op6_fingerprints"] = op6_fingerprints


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return found.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"])), ";"))


Q["op7_warc"] = op7_warc
O["op7_warc"] = r"""
WITH base AS (
  SELECT coalesce(page_id, 0) AS p, url, md5(coalesce(html, '')) AS digest, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (coalesce(page_id, 0) % 7) AS day FROM pages),
records AS (
  SELECT p * 4 AS record_id, url, 'revisit' AS type, p * 1000 AS ts, tag AS etag, NULL AS changed, [('date', 'first'), ('etag', tag)] AS headers, NULL AS digest FROM base
  UNION ALL SELECT p * 4 + 1, url, 'response', p * 1000 + 10, tag, day, [('content-type', 'text/html'), ('date', 'second'), ('etag', tag), ('last-modified', day)], digest FROM base
  UNION ALL SELECT p * 4 + 2, url || '#again', 'revisit', p * 1000 + 20, CASE WHEN p % 5 = 0 THEN '"other"' ELSE tag END, NULL,
                   [('date', 'third'), ('etag', CASE WHEN p % 5 = 0 THEN '"other"' ELSE tag END), ('vary', 'accept')], NULL FROM base
  UNION ALL SELECT p * 4 + 3, regexp_replace(url, '^http:', 'https:') || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&utm_id=1' ELSE '?utm_id=1' END, 'revisit', p * 1000 + 30, NULL, day, [('expires', 'never')], NULL FROM base),
bare AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM records),
named AS (SELECT *, regexp_extract(b, '^[^/?]*') AS name FROM bare),
rest AS (SELECT *, regexp_replace(substr(b, length(name) + 1), '([?&])utm_[^&]*', '\1', 'g') AS r FROM named),
keyed AS (
  SELECT *, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(r, '&&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]$', ''), '/[?]', '?', 'g'), '/$', '') AS key FROM rest),
matched AS (
  SELECT v.record_id, v.key, v.ts, v.etag, v.changed, v.headers, arg_max(f, (f.ts, f.record_id)) AS f
  FROM (SELECT * FROM keyed WHERE type = 'revisit') v LEFT JOIN (SELECT * FROM keyed WHERE type = 'response') f ON f.key = v.key AND f.ts < v.ts
  GROUP BY v.record_id, v.key, v.ts, v.etag, v.changed, v.headers),
judged AS (
  SELECT *, CASE WHEN f.record_id IS NULL THEN 'no_earlier_response' WHEN etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN etag = f.etag AND NOT starts_with(etag, 'W/') THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN changed IS NOT NULL AND f.changed IS NOT NULL THEN CASE WHEN changed = f.changed THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'no_validator' END AS status FROM matched),
merged AS (
  SELECT *, list_sort(list_concat(headers, list_filter(f.headers, lambda h: NOT list_contains(list_transform(headers, lambda g: g[1]), h[1])))) AS h FROM judged)
SELECT record_id, key AS url, ts, f.record_id AS response_id, status, CASE WHEN status = 'resolved' THEN f.digest END AS digest,
       CASE WHEN status = 'resolved' THEN list_aggregate(list_transform(h, lambda g: g[1] || '=' || g[2]), 'string_agg', ';') END AS headers
FROM merged
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, secrets.learn(docs)).select("doc_id", "secrets")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    base = F.filter("secrets", lambda s: s["kind"] != "format")
    return found.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS[:3]],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


Q["op8_secrets"] = op8_secrets


#: The rules of the query (fixed values): host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in RULES) + " AS rules(host, path, verdict)")
    found = url_filter.verdicts(table(spark, sf_dir, "pages", "page_id", "url"), rules)
    return found.select("page.page_id", "host", "path", "rule", "verdict")


Q["op9_url_filter"] = op9_url_filter
O["op9_url_filter"] = r"""
WITH after AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(a, '^[^/?#]*', ''), '^[^?#]*') AS path FROM after),
rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
numbered AS (SELECT row_number() OVER () AS n, * FROM parsed),
fits AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN fits USING (n)
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file()))


Q["op10_packing"] = op10_packing


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))


Q["op11_collocations"] = op11_collocations
O["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE len(w) >= k))
  GROUP BY lang, k, phrase HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, j, p.f AS l, q.f AS r, (2000000::HUGEINT * c.a) // (p.f::HUGEINT + q.f) AS score
  FROM cuts c JOIN counted p ON p.lang = c.lang AND p.phrase = x JOIN counted q ON q.lang = c.lang AND q.phrase = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3)) AS lengths(m) WHERE m < k)),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


Q["op12_ranked_search"] = op12_ranked_search
O["op12_ranked_search"] = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT * FROM doc_terms WHERE len(t) > 0),
totals AS (SELECT count(*) AS total_n, CAST(sum(len(t)) AS BIGINT) AS total_l FROM counted),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
tfs AS (SELECT d, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT d, doc_id, t, unnest(t) AS term FROM counted) WHERE term IN (SELECT term FROM items) GROUP BY d, doc_id, len(t), term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, total_n),
impacts AS (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total_n) // total_l))) AS impact FROM tfs JOIN weights USING (term), totals),
scores AS (SELECT item_id, d, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY item_id, d, doc_id HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


Q["op13_toxicity"] = op13_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


Q["pipeline"] = pipeline
