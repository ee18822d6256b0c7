"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import bpe, decontam, html_extract, importance, line_dedup, quality_model, quality_rules, simhash, suffix_dedup, token_counts, token_files, toxicity, treap_search
from veldra.llm.common import table
from veldra.llm.token_table import held_out, labelled_sample
from veldra.session import scratch, stored


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; ``VELDRA_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("VELDRA_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _judged(scores: DataFrame, held: Column, least: float) -> DataFrame:
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(3, 1)
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held, toxicity.TRAIN_ROWS)
    return _judged(toxicity.score(docs, toxicity.fit(stored(sample, "toxicity-sample"))), held, 0.7)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(5, 0)
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", ~held, quality_model.TRAIN_ROWS)
    return _judged(quality_model.score(docs, quality_model.fit(sample)), held, 0.3)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, end_id=2)
    return token_files.checksum(token_files.read_token_files(spark, path))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return rows.select("doc_id", *bpe_digest())


def bpe_digest() -> list:
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), variants=False, whole_line=True)  # as OP6_SQL states
    return rows.select("row.doc_id", "n_lines", "n_dropped", "text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hash")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("row.doc_id", "base.*", "kept")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) > 8),
keyed AS (SELECT doc_id, p, ws[p:p+7] AS k FROM win),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered c USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
s AS (SELECT sum(f) / sum(n) AS mean, var_pop(f / n) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 0 THEN greatest(mean * (1 - mean) / spread - 1, 0.0) END AS strength FROM s),
v AS (SELECT source, CASE WHEN strength IS NULL THEN mean ELSE (f + mean * strength) / (n + strength) END > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS s, unnest(range(0, len(string_split(t, chr(10))))) AS place FROM d),
p AS (SELECT doc_id, t, place, trim(translate(s, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS s FROM l),
m AS (SELECT doc_id, t, place, list_transform(string_split(s, ' '), lambda f: CASE WHEN regexp_matches(f, '[0-9]') THEN '<*>' ELSE f END) AS fs FROM p),
f AS (SELECT doc_id, t, place, fs, len(fs) AS nf, fs[1:3] AS lead FROM m WHERE len(fs) >= 3),
ex AS (SELECT fs, min(doc_id) AS first FROM f GROUP BY fs HAVING count(DISTINCT doc_id) >= 5),
leaf AS (SELECT nf, lead FROM f GROUP BY nf, lead HAVING count(DISTINCT doc_id) >= 5),
loose AS (SELECT f.* FROM f SEMI JOIN leaf USING (nf, lead) ANTI JOIN ex USING (fs)),
fl AS (SELECT doc_id, place, nf, lead, unnest(fs) AS field, unnest(range(0, nf)) AS nth FROM loose),
co AS (SELECT nf, lead, nth, field FROM fl GROUP BY nf, lead, nth, field HAVING count(DISTINCT doc_id) >= 5),
sh AS (SELECT doc_id, place, nf, lead, list((nth, field) ORDER BY nth) AS c FROM fl JOIN co USING (nf, lead, nth, field) GROUP BY doc_id, place, nf, lead HAVING count(*) >= 0.6 * nf),
ge AS (SELECT nf, lead, c, min(doc_id) AS first FROM sh GROUP BY nf, lead, c HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT doc_id, place FROM f JOIN ex USING (fs) WHERE doc_id <> first UNION SELECT doc_id, place FROM sh JOIN ge USING (nf, lead, c) WHERE doc_id <> first),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_dropped, coalesce(string_agg(l.s, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text
      FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, text FROM k
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
g AS (SELECT r, p, p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50 AS apart FROM w JOIN f USING (k) WHERE first < doc_id),
i AS (SELECT r, p, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS nth FROM g),
s AS (SELECT r, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY r, nth),
b AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM s),
k AS (SELECT d.r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept, count(*) AS n_spans, sum(z - a) AS n_removed FROM b JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP12_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS tab),
src AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT NULL, NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT r, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
e AS (SELECT r, unnest(ws) AS word FROM w),
dw AS (SELECT DISTINCT word FROM e),
b AS (SELECT word, xor(list_reduce(list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT),
        lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM dw, tab),
hashed AS (SELECT r, bucket FROM e JOIN b USING (word)),
cnt AS (SELECT bucket, count(*) FILTER (WHERE r IS NOT NULL) AS s, count(*) FILTER (WHERE r IS NULL) AS t FROM hashed GROUP BY bucket),
tot AS (SELECT sum(s) AS bs, sum(t) AS bt FROM cnt),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (bs + 10000))::DOUBLE / ((s + 1) * (bt + 10000))::DOUBLE))::BIGINT AS gain FROM cnt, tot),
f AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM hashed JOIN g USING (bucket) WHERE r IS NOT NULL GROUP BY r),
m AS (SELECT w.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight FROM w LEFT JOIN f USING (r) WHERE w.r IS NOT NULL),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, sum((n_features >= 20)::INT) OVER () AS n_docs FROM s)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, (CASE WHEN n_features >= 20 AND place <= 10 * n_docs // 100 THEN place END)::BIGINT AS rank FROM k
"""

OP13_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS z),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, z), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, low),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, a, z), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark, low),
tot AS (SELECT count(*)::BIGINT AS bn, sum(len(ws))::BIGINT AS bl FROM d WHERE len(ws) > 0),
e AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM e SEMI JOIN i USING (term) GROUP BY r, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(bn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term),
p AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * bn) // bl))) AS impact FROM tf JOIN w USING (term), tot),
s AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM p JOIN i USING (term) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_model": op2_quality_model,
    "op3_token_files": op3_token_files,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_html": op8_html,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_importance": op12_importance,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op6_line_dedup": OP6_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_importance": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
