"""One query per operator, with production parameters over whole tables, and the SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklake.llm import chat_format, decontaminate, language_id, mixing, quality_rules, simhash_dedup, substring_dedup, token_count, url_filter, warc
from sparklake.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select(F.col("row").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").alias("refers_to"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "mixture")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


#: The host and path rules that the query judges by.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: What the method says where no rule above fits: junk hosts, mobile mirrors, printer pages and numbered archives.
URL_PATTERNS = (
    ("block", r"\bspam-farm\b"),
    ("block", r"\bcheap-(?:pills|loans|watches)\b"),
    ("block", r"\Am\.[^/]+\.org/"),
    ("allow", r"\Am\.[^/]+\.org/en/[0-9]{1,2}\b"),
    ("block", r"/de/[0-9]{3,}\.html\Z"),
    ("block", r"[0-9]00/?\Z"),
    ("allow", r"\Ablog\.[a-z]+\.example\.(?:org|net)/en/[0-9]+/?\Z"),
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.prefix_rule(*r) for r in URL_RULES] + [url_filter.pattern_rule(*r) for r in URL_PATTERNS]
    found = url_filter.judge(_table(spark, sf_dir, "pages"), rules)
    contract = F.col("rule").isin([r for _, r in URL_RULES])
    return found.select("page_id", "host", "path", F.when(contract, F.col("rule")).alias("rule"), "verdict", F.when(~contract, F.col("rule")).alias("pattern"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat_format.conversations(_table(spark, sf_dir, "conversations"))
    found = chat_format.format_preferences(chat_format.contrast_pairs(convs))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), " ")
    return found.withColumns({c: spans(c) for c in ("chosen_spans", "rejected_spans")})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(quality_rules.sample(docs, _table(spark, sf_dir, "labels")))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(docs, rules).select(*columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_language_id, op4_decontaminate, op5_mix_sources, op6_url_filter, op7_chat_format, op8_quality_rules, op9_simhash_dedup, op10_token_count)}

#: SQL has no XXH64, mixture inference, seeded permutation or unigram model; those operators are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        x AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM t),
        l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM (SELECT doc_id, i, array_to_string(win, ' ') AS win FROM x WHERE len(win) = 20)) WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM l),
        k AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        m AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS last FROM p)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
            CASE WHEN strlen(body) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN strlen(body) >= 1000 AND page_id < last THEN last END AS refers_to FROM m""",
    "op6_url_filter": r"""
        WITH r(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n FROM p JOIN r
            ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))),
        x(action, pattern) AS (VALUES ('block', '\bspam-farm\b'), ('block', '\bcheap-(?:pills|loans|watches)\b'), ('block', '\Am\.[^/]+\.org/'), ('allow', '\Am\.[^/]+\.org/en/[0-9]{1,2}\b'),
            ('block', '/de/[0-9]{3,}\.html\Z'), ('block', '[0-9]00/?\Z'), ('allow', '\Ablog\.[a-z]+\.example\.(?:org|net)/en/[0-9]+/?\Z')),
        y AS (SELECT page_id, pattern, action, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern) AS n FROM p JOIN x ON regexp_matches(host || path, replace(pattern, '\Z', '\z')))
        SELECT p.page_id, host, path, rule, coalesce(verdict, action, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
        FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1 LEFT JOIN y ON p.page_id = y.page_id AND y.n = 1""",
    "op7_chat_format": r"""
        WITH t AS (SELECT conv_id, row_number() OVER w AS i, coalesce(role, '') AS role, coalesce(text, '') AS text, sum((role = 'assistant')::INT) OVER w AS a FROM conversations WHERE conv_id IS NOT NULL
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '') ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT conv_id, coalesce(max(a), 0) AS n, count(*) AS turns FROM t GROUP BY 1),
        k AS (SELECT x.conv_id, x.turns, x.conv_id % nullif(x.n, 0) + 1 AS k, x.conv_id % nullif(x.n, 0) % nullif(y.n, 0) + 1 AS other FROM m x LEFT JOIN m y ON y.conv_id = xor(x.conv_id, 1)),
        p AS (SELECT t.conv_id, t.i, t.role, t.text, role = 'assistant' AND a = k AS swap, other FROM t JOIN k ON t.conv_id = k.conv_id),
        r AS (SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.i) AS i, p.role, CASE WHEN swap THEN o.text ELSE p.text END AS text
            FROM p LEFT JOIN t o ON swap AND o.conv_id = xor(p.conv_id, 1) AND o.role = 'assistant' AND o.a = other WHERE swap IS NOT TRUE OR o.conv_id IS NOT NULL),
        s AS (SELECT conv_id, 1 AS side, i, role, text FROM t UNION ALL SELECT conv_id, 2, i, role, text FROM r),
        e AS (SELECT conv_id, i FROM s GROUP BY conv_id, i HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)),
        f AS (SELECT k.conv_id, coalesce(min(e.i) - 1, any_value(k.turns)) AS prompt_turns FROM k LEFT JOIN e ON k.conv_id = e.conv_id GROUP BY 1),
        q AS (SELECT conv_id, side, i, role, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS er, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et, prompt_turns FROM s JOIN f USING (conv_id)),
        v AS (SELECT *, '<|turn|>' || er || chr(10) || et || '<|end|>' || chr(10) AS line, sum(length(er) + length(et) + 17) OVER (PARTITION BY conv_id, side, i > prompt_turns ORDER BY i) AS z FROM q)
        SELECT conv_id, prompt_turns::INTEGER AS prompt_turns,
            coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 1 AND i <= prompt_turns), '') AS prompt,
            coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 1 AND i > prompt_turns), '') AS chosen_text,
            coalesce(string_agg((z - length(et) - 8)::BIGINT || '-' || z::BIGINT, ' ' ORDER BY i) FILTER (side = 1 AND i > prompt_turns AND role = 'assistant'), '') AS chosen_spans,
            coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 2 AND i > prompt_turns), '') AS rejected_text,
            coalesce(string_agg((z - length(et) - 8)::BIGINT || '-' || z::BIGINT, ' ' ORDER BY i) FILTER (side = 2 AND i > prompt_turns AND role = 'assistant'), '') AS rejected_spans
        FROM v GROUP BY conv_id, prompt_turns""",
}
