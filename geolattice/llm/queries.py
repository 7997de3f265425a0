"""Registered queries of the operators: each runs its operator over a whole table and returns the agreed columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geolattice.llm import chat, class_lm, decontaminate, host_rules, line_dedup, main_text, near_dups, order_minhash, packing, quality, token_links, url_rules, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return class_lm.score(docs, class_lm.fit(docs))


def op2_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = order_minhash.fingerprints(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.expand(turns))


def op7_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_boosted_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge_hosts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_blocked", "kept")


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align_documents(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_order_packing, op3_line_dedup, op4_benchmark_decontamination, op5_order_minhash, op6_prefix_target_chat,
                                      op7_probminhash_dedup, op8_bradley_terry_quality, op9_boosted_html, op10_link_graph_url_filter, op11_host_rules, op12_token_links, op13_whitening)}

ORACLES = {
    "op3_line_dedup": r"""
        WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        cut AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM rows),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
        shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT keyed.*, shared.k IS NOT NULL AND keeper <> doc_id AS lost FROM keyed LEFT JOIN shared USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM judged GROUP BY r, doc_id""",
    "op6_prefix_target_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2\3', 'g') AS x,
                     regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2\3', 'g') AS y,
                     row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        f AS (SELECT *, sum(CASE role WHEN 'user' THEN length(x) + 15 WHEN 'assistant' THEN length(x) + 4
                            ELSE length(x) + length(y) + length(length(y)::varchar) + 17 END) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
        SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(upto) FILTER (role = 'assistant' OR i = n)::bigint AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op11_host_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
        cut AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        windows AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM cut)),
        twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
        covered AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS j FROM twice) GROUP BY r),
        m AS (SELECT r, doc_id, host, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                     coalesce(covered.n, 0) AS n_repeat_words FROM cut LEFT JOIN covered USING (r)),
        f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines FROM m),
        long AS (UNPIVOT (SELECT host, short::int AS short, repeats::int AS repeats, symbols::int AS symbols, lines::int AS lines FROM f WHERE host IS NOT NULL) ON short, repeats, symbols, lines INTO NAME rule VALUE failed),
        h AS (SELECT host, rule, count(*) AS n, sum(failed)::hugeint AS f FROM long GROUP BY host, rule),
        moments AS (SELECT rule, (sum(f * 1000000000 // n)::double / count(*)::double) / 1e9 AS mean,
                           (sum(CASE WHEN n > 1 THEN f * (f - 1) * 1000000000 // (n * (n - 1)) ELSE 0 END)::double / nullif(count(*) FILTER (n > 1), 0)::double) / 1e9 AS square FROM h GROUP BY rule),
        prior AS (SELECT *, square - mean * mean AS spread, greatest(mean * (1.0::double - mean) / nullif(square - mean * mean, 0) - 1.0::double, 0.0::double) AS weight FROM moments),
        rate AS (SELECT host, CASE WHEN spread > 0 THEN (f::double + mean * weight) / (n::double + weight) ELSE mean END AS rate FROM h JOIN prior USING (rule)),
        blocked AS (SELECT DISTINCT host FROM rate WHERE rate > 0.5)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, blocked.host IS NOT NULL AS host_blocked,
               NOT (short OR repeats) AND blocked.host IS NULL AS kept
        FROM f LEFT JOIN blocked ON f.host = blocked.host""",
}
