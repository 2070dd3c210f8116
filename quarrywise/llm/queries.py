"""The numbered queries over the given tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, spread
from . import byte_bpe, chat_format, decontaminate, exact_dedup, katz_lm, packing, resampling, runs, sharding, simhash, substring_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Texts are read over all cores; other tables as they are."""
    rows = read_table(spark, sf_dir, name)
    return spread(rows) if name in ("documents", "pages") else rows


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels URLs (`labels` is about documents and says nothing of pages of the same number), so rules are mined from what the given rules say of the pages that they fit, and decide the others."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.rule_labels(pages))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


CONTROL_CASE = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    return chat_format.chat_digest(chat_format.format_chats(turns.unionByName(case)))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.lm_scores(_table(spark, sf_dir, "documents"), min_pair=1)


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), RANKS), RANKS)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.col("sha256").alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=runs.planted))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_sharding, op3_decontamination, op4_exact_dedup, op5_url_filter, op6_simhash_dedup, op7_toxicity, op8_packing, op9_chat_format, op10_lm_scoring, op11_byte_bpe, op12_periodic_runs,
        op13_resampling,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_substring_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM d, unnest(range(1, greatest(1, len(w) - 48))) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS lo FROM wins GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM wins JOIN firsts USING (h) WHERE doc_id > lo) GROUP BY doc_id, p),
words AS (SELECT doc_id, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_decontamination": f"""
WITH words AS (
    SELECT 'd' AS kind, doc_id::VARCHAR AS id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL SELECT 'b', item_id::VARCHAR, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark WHERE text IS NOT NULL),
items AS (
    SELECT DISTINCT id, least(len(w), 13) AS width, array_to_string(w[i : i + 12], ' ') AS win
    FROM words, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE kind = 'b' AND len(w) > 0),
widths AS (SELECT DISTINCT width FROM items),
hits AS (
    SELECT d.id, d.i, d.width, b.id AS item
    FROM (SELECT id, i, width, array_to_string(w[i : i + width - 1], ' ') AS win
          FROM words, widths, unnest(range(1, greatest(1, len(w) - width + 2))) AS t(i) WHERE kind = 'd') d
    JOIN items b ON b.win = d.win AND b.width = d.width),
hit_words AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT id, i, width FROM hits)) GROUP BY id),
hit_items AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT id, item FROM hits) GROUP BY id)
SELECT words.id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words hw USING (id) LEFT JOIN hit_items hi USING (id) WHERE kind = 'd'""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_url_filter": f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cuts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests),
parts AS (
    SELECT page_id, {_LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
           regexp_extract(substr(rest, length(h) + 1), '^[^?#]*\\?([^#]*)', 1) AS query FROM cuts),
given AS (
    SELECT *, CASE {" ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(url_filter.RULES, key=lambda r: -len(r.name)))} END AS rule FROM parts),
told AS (SELECT *, CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in url_filter.RULES)} END AS said FROM given),
labels_of AS (SELECT page_id, i, len(x) AS n, x[i] AS label FROM (SELECT page_id, list_filter(string_split(host, '.'), lambda v: v <> '') AS x FROM parts), unnest(range(1, len(x) + 1)) AS t(i)),
tokens AS (
    SELECT page_id, 'domain=' || string_agg(label, '.' ORDER BY i) AS token FROM labels_of WHERE i > n - 2 GROUP BY page_id
    UNION SELECT page_id, 'domain=' FROM parts WHERE page_id NOT IN (SELECT page_id FROM labels_of)
    UNION SELECT page_id, 'sub=' || label FROM labels_of WHERE i <= n - 2
    UNION SELECT page_id, 'path=' || x FROM (SELECT page_id, unnest(string_split(path, '/')) AS x FROM parts) WHERE x <> ''
    UNION SELECT page_id, 'query=' || string_split(x, '=')[1] FROM (SELECT page_id, unnest(string_split(query, '&')) AS x FROM parts) WHERE x <> ''),
bad AS (SELECT count(*) AS n, sum((said = 'block')::INT) AS bad FROM told WHERE said IS NOT NULL),
frequent AS (SELECT token FROM tokens JOIN told USING (page_id) WHERE said = 'block' GROUP BY token HAVING count(*) >= (SELECT greatest({url_filter.LEAST}, {url_filter.SUPPORT} * bad) FROM bad)),
baskets AS (SELECT page_id, said, list(token ORDER BY token) AS items FROM tokens JOIN told USING (page_id) WHERE token IN (SELECT token FROM frequent) GROUP BY page_id, said),
subsets AS (
    SELECT page_id, said, string_agg(items[i], '|' ORDER BY i) AS need
    FROM (SELECT page_id, said, items, unnest(range(1, (1 << len(items))::BIGINT)) AS m FROM baskets), unnest(range(1, len(items) + 1)) AS t(i) WHERE (m >> (i - 1)::INT) % 2 = 1 GROUP BY page_id, said, m),
rules AS (
    SELECT need, sum((said = 'block')::INT) / count(*) AS confidence FROM subsets WHERE said IS NOT NULL GROUP BY need
    HAVING sum((said = 'block')::INT) >= (SELECT greatest({url_filter.LEAST}, {url_filter.SUPPORT} * bad) FROM bad)
       AND sum((said = 'block')::INT) / count(*) >= {url_filter.CONFIDENCE} AND sum((said = 'block')::INT) / count(*) > (SELECT bad / n FROM bad)),
best AS (SELECT page_id, max(confidence) AS confidence FROM subsets JOIN rules USING (need) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, confidence FROM told LEFT JOIN best USING (page_id)""",
    "op9_chat_format": f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CASE}'),
formed AS (
    SELECT *, replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS r, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS t,
           lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || r || '<|im_sep|>' || t || '<|im_end|>'))::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' ELSE false END)
       AND last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AS valid
FROM formed GROUP BY conv_id""",
    "op10_lm_scoring": f"""
WITH steps AS (SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda t, k: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384::BIGINT) ELSE t // 2 END) ORDER BY n) AS t FROM range(256) AS r(n)),
crcs AS (
    SELECT doc_id, text, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc
    FROM documents, steps),
d AS (SELECT doc_id, crc % {katz_lm.FOLDS} = {katz_lm.HELD} AS held_out, list_append(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), ' end') AS w FROM crcs),
tok AS MATERIALIZED (SELECT doc_id, held_out, i, CASE WHEN i = 1 THEN ' begin' ELSE w[i - 1] END AS v, w[i] AS w FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
uni AS MATERIALIZED (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
bi AS MATERIALIZED (SELECT v, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY v, w),
n AS (SELECT sum(c)::BIGINT AS tokens, count(*) AS types FROM uni),
rs AS (SELECT ord, r, (SELECT count(*) FROM uni WHERE c = r) * (ord = 1)::INT + (SELECT count(*) FROM bi WHERE c = r) * (ord = 2)::INT AS n FROM range(1, 9) AS a(r), range(1, 3) AS b(ord)),
common AS (SELECT ord, {katz_lm.DISCOUNTED + 1} * max(n) FILTER (r = {katz_lm.DISCOUNTED + 1}) / nullif(max(n) FILTER (r = 1), 0) AS k FROM rs GROUP BY ord),
good AS (
    SELECT a.ord, a.r, a.n, CASE WHEN a.n > 0 AND k < 1 THEN ((a.r + 1) * b.n / (a.r * a.n) - k) / (1 - k) END AS g
    FROM rs a JOIN rs b ON b.ord = a.ord AND b.r = a.r + 1 JOIN common ON common.ord = a.ord WHERE a.r <= {katz_lm.DISCOUNTED}),
disc AS (SELECT ord, r, n, CASE WHEN g > 0 AND g <= 1 THEN g ELSE (r - 0.5) / r END AS d FROM good),
lost AS (SELECT sum((1 - d) * r * n) AS lost FROM disc WHERE ord = 1),
word AS (SELECT w, c, c * coalesce(d, 1) / (tokens + (lost <= 0)::INT) AS p FROM uni JOIN n ON true JOIN lost ON true LEFT JOIN disc ON ord = 1 AND r = c),
pair AS (SELECT v, w, bi.c, bi.c * coalesce(d, 1) AS cut, p FROM bi JOIN word USING (w) LEFT JOIN disc ON ord = 2 AND r = bi.c),
context AS (SELECT v, sum(c) AS n, sum(cut) AS mass, sum(p) AS low FROM pair GROUP BY v),
bow AS (SELECT v, n + (mass >= n - 1e-9)::INT AS whole, log10((1 - mass / (n + (mass >= n - 1e-9)::INT)) / (1 - low)) AS log_bow FROM context),
scored AS (
    SELECT tok.doc_id, tok.held_out, word.c, log10((coalesce(word.c, 0) + 1) / (tokens + types + 1)) AS base,
           CASE WHEN pair.cut IS NOT NULL THEN log10(pair.cut / whole)
                ELSE coalesce(log_bow, 0) + log10(coalesce(word.p, CASE WHEN lost > 0 THEN lost ELSE 1 END / (tokens + (lost <= 0)::INT))) END AS score
    FROM tok JOIN n ON true JOIN lost ON true LEFT JOIN word ON word.w = tok.w LEFT JOIN pair ON pair.v = tok.v AND pair.w = tok.w LEFT JOIN bow ON bow.v = tok.v)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, (SELECT tokens FROM n) AS train_tokens, sum(base) AS base_score, sum(score) AS score
FROM scored GROUP BY doc_id, held_out""",
}

_CRC_STEPS = "steps AS (SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda t, k: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384::BIGINT) ELSE t // 2 END) ORDER BY n) AS t FROM range(256) AS r(n))"


def _crc(codes: str) -> str:
    """SQL for the crc32 of a list of bytes; its query has the one row of _CRC_STEPS joined."""
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))"


ORACLE |= {
    "op12_periodic_runs": f"""
WITH {_CRC_STEPS},
told AS (SELECT doc_id, text, {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} AS h FROM documents, steps),
split AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM told),
sized AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM split),
roots AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM roots),
places AS (SELECT doc_id, w, q, unnest(range(0, n - 2 * q + 1, q)) AS c FROM (SELECT doc_id, w, n, unnest(range(1, n // {runs.TIMES} + 1)) AS q FROM d)),
periods AS MATERIALIZED (SELECT DISTINCT doc_id, q FROM places WHERE w[c + 1] = w[c + q + 1] AND w[c + 1 : c + q] = w[c + q + 1 : c + 2 * q]),
agree AS (SELECT doc_id, q, i FROM (SELECT doc_id, q, w, unnest(range(0, n - q)) AS i FROM periods JOIN d USING (doc_id)) WHERE w[i + 1] = w[i + q + 1]),
spans AS (SELECT doc_id, q, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM agree) GROUP BY doc_id, q, k),
longs AS MATERIALIZED (SELECT * FROM spans WHERE b - a + q >= greatest({runs.LEAST}, {runs.TIMES} * q)),
runs AS MATERIALIZED (SELECT doc_id, a AS start, b - a + q AS length, q AS period FROM longs x WHERE NOT EXISTS (SELECT 1 FROM longs y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.a <= x.a AND y.b + y.q >= x.b + x.q)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 0) / period DESC, start, period) = 1),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS said FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(per.said, '')) AS runs_sha256, sha256(coalesce(kept.said, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_resampling": f"""
WITH {_CRC_STEPS},
words AS (
    SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
    UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
bytes AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT) AS codes FROM (SELECT DISTINCT w FROM words)),
buckets AS (SELECT w, {_crc("codes")} % {resampling.BUCKETS} AS bucket FROM bytes, steps),
counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT count(*) FILTER (kind = 'd') + {resampling.BUCKETS} AS s_all, count(*) FILTER (kind = 'b') + {resampling.BUCKETS} AS t_all FROM words),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * s_all) / ((s + 1)::DOUBLE * t_all)))::BIGINT AS gain FROM counts, totals),
means AS (SELECT id AS doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN means USING (doc_id)),
fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN r <= {resampling.PERCENT} * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN fit USING (doc_id)""",
}
