"""The numbered queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store, chat_format, conversation_repair, decontamination, jaccard_join, line_dedup, lm_scoring, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_alignment, token_output


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY = {"stratum": "lang", "risk": 0.01, "error": 0.05}


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **QUALITY)


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = _store.shared_folder(spark, "token-chunks")
    token_output.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_output.digest(spark, path)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PACKING = {"buckets": 8, "budget": 16_384}


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **PACKING)


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digest(_store.written(chat_format.examples(talks), "chat-examples"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return conversation_repair.with_all(conversation_repair.digest(conversation_repair.damaged(talks)), talks)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bit_planes,
        op2_quality_rules,
        op3_backoff_automaton,
        op4_line_dedup,
        op5_decontamination,
        op6_packing,
        op7_jaccard_join,
        op8_chat_format,
        op9_substring_dedup,
        op10_quality_classifier,
        op11_suffix_array,
        op12_token_alignment,
        op13_conversation_repair,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _level(expr: str, sign: int, levels: tuple[int, ...]) -> str:
    op = ">" if sign > 0 else "<"
    return " + ".join(f"({expr} {op} {x})::int" for x in levels)


_MEASURES = {
    "symbols_pm": "(1000 * n_symbols) // n_words",
    "word_len_high": "(100 * word_chars) // n_words",
    "word_len_low": "(100 * word_chars) // n_words",
    "dup_lines_pm": "(1000 * n_dup_lines) // n_words",
    "repeat_pm": "(1000 * n_repeat_words) // n_words",
}
_SEVERITY = ", ".join(_level(_MEASURES[k], sign, levels) for k, (sign, levels) in quality_rules.LEVELS.items())

OP2_CTES = rf"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, text, lang, {_WORDS} AS w FROM {{documents}}),
wins AS (SELECT rid, i, w[i:i + 4] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, i - coalesce(prev, i - 5)))::BIGINT AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM rep) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
counts AS (
  SELECT d.rid, doc_id, lang, len(w)::BIGINT AS n_words,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM docs d JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (CASE WHEN n_words > 0 THEN greatest({_SEVERITY}) ELSE 0 END)::INT AS severity
  FROM counts),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT coalesce(lang, '') AS s, severity FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
cases AS (
  SELECT s, t, count(*) AS n, count(*) FILTER (severity >= t) AS k, 8 * (SELECT count(DISTINCT s) FROM held) AS tests
  FROM held, (SELECT unnest(range(1, 9)) AS t) GROUP BY s, t),
cutoffs AS (
  SELECT s, min(t)::INT AS threshold FROM cases
  WHERE k < {QUALITY["risk"]} * n AND list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({QUALITY["risk"]}) + (n - i) * ln(1 - {QUALITY["risk"]})))) <= {QUALITY["error"]} / tests
  GROUP BY s)"""

ORACLES = {
    "op2_quality_rules": f"""WITH {OP2_CTES.format(documents="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, severity, threshold,
  (NOT base_failed AND NOT coalesce(severity >= threshold, false)) AS kept
FROM judged LEFT JOIN cutoffs ON coalesce(lang, '') = s""",
    "op4_line_dedup": f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, i, l[i] AS line, translate(trim(l[i], {_WHITE}), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT rid, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
gone AS (SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keep IS NOT NULL AND keep <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN gone USING (key) GROUP BY rid""",
    "op5_decontamination": f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, w[i:i + least(10, len(w)) - 1] AS win FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
own AS (SELECT rid, i, k, w[i:i + k - 1] AS win FROM (
  SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT len(win) AS k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT rid, i, k, item FROM own JOIN wins USING (win)),
words AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)""",
    "op8_chat_format": rf"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\:')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + {len(chat_format.START) + len(chat_format.END) + 2} AS chars
  FROM rows),
sums AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM sums GROUP BY conv_id""",
    "op9_substring_dedup": rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT rid, doc_id, i, w[i:i + 19] AS win FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
later AS (SELECT rid, i FROM (SELECT rid, i, rank() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 20)) AS p FROM later)),
words AS (SELECT rid, w[p] AS word, p FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM docs)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)""",
    "op11_suffix_array": """WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT rid, doc_id, c, substr(x, 2 * c + 1, 2098) AS y FROM (SELECT rid, doc_id, x, unnest(range(0, len(x) // 2 - 49, 1000)) AS c FROM docs WHERE len(x) >= 100)),
wins AS (SELECT rid, doc_id, c + k AS i, substr(y, 2 * k + 1, 100) AS win FROM (SELECT rid, doc_id, c, y, unnest(range(0, len(y) // 2 - 49)) AS k FROM parts)),
gone AS (SELECT rid, i FROM wins JOIN (SELECT win, min(doc_id) AS least FROM wins GROUP BY win HAVING count(DISTINCT doc_id) > 1) USING (win) WHERE doc_id > least),
marked AS (SELECT rid, i, (i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, -1))::INT AS new FROM gone),
spans AS (SELECT rid, k, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM marked) GROUP BY rid, k),
gaps AS (SELECT rid, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS a, lo AS b FROM spans UNION ALL SELECT rid, max(hi), NULL FROM spans GROUP BY rid),
kept AS (SELECT rid, string_agg(x[2 * a + 1:coalesce(2 * b, len(x))], '' ORDER BY a) AS y, (count(*) - 1)::BIGINT AS n FROM gaps JOIN docs USING (rid) GROUP BY rid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, ((len(x) - len(coalesce(y, x))) // 2)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)""",
    "op7_jaccard_join": rf"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER_WORDS} AS w FROM documents),
sets AS (SELECT DISTINCT rid, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*)::BIGINT AS n FROM sets GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT rid, rid AS r FROM docs UNION SELECT reach.rid, b FROM reach JOIN links ON r = a)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM docs d JOIN reach USING (rid) JOIN docs e ON e.rid = r LEFT JOIN sizes ON sizes.rid = d.rid GROUP BY d.rid""",
}
