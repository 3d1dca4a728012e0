"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, interleave, jaccard_join, mixing, near_dedup, packing, prefix_trie, quality_model, quality_rules, secrets, token_codes, token_rollup, whitening
from ._common import read
from .tokens import vocabulary

BYTE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -7L conv_id, 0L turn, 'user' role, '{tricky}' text union all select -7L, 1L, 'assistant', '{tricky}'")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return chat_format.digests(chat_format.format_chats(turns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(read(spark, sf_dir, "documents"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.report(read(spark, sf_dir, "documents"), vocabulary(BYTE), 2)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.report(read(spark, sf_dir, "documents"), {"byte_bpe_50k": vocabulary(BYTE)}, {"word_bpe_49k": vocabulary(WORDS)})


def op7_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.report(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(WORDS), 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(read(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(read(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_chat_format, op3_near_dedup, op4_quality_model, op5_token_codes, op6_token_rollup, op7_interleave, op8_mixing, op9_packing, op10_secrets, op11_prefix_trie, op12_whitening, op13_jaccard_join, pipeline)
}

_TURNS = """c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM c)"""
_LONG = "(2 * length({0}) - length(translate({0}, '\\<[' || chr(10), '')))"

_COUNTS = r"""w AS (SELECT doc_id, i, l[i] AS x, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents))),
g AS (SELECT *, lead(x, 1) OVER q AS y, lead(x, 2) OVER q AS z FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, z IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS rep FROM g),
h AS (SELECT *, rep OR coalesce(lag(rep, 1) OVER q, false) OR coalesce(lag(rep, 2) OVER q, false) AS hit FROM r WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(x)) AS word_chars, sum(hit::INT) AS n_repeat_words, sum((x = upper(x) AND x <> lower(x))::INT) AS n_upper FROM h GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
nl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
k AS (SELECT d.doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_upper, 0)::BIGINT AS n_upper
 FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN nl USING (doc_id)),
v AS (SELECT doc_id, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'upper', 'word_length']) AS rate, coalesce(unnest([greatest(n_symbols - 1, 0) * 1000 // nullif(n_words, 0), greatest(n_dup_lines - 1, 0) * 1000 // nullif(n_lines, 0), n_repeat_words * 1000 // nullif(n_words, 0), greatest(n_upper - 1, 0) * 1000 // nullif(n_words, 0), word_chars * 1000 // nullif(n_words, 0)]), 0) AS x, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM k),
vc AS (SELECT *, CASE WHEN x < 1024 THEN x ELSE (x >> (floor(log2(x + 0.5))::INT - 9)) << (floor(log2(x + 0.5))::INT - 9) END AS cell FROM v),
u AS (SELECT * FROM vc WHERE NOT failed),
fine AS (SELECT 0 AS whole, lang, source, rate, cell, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 1, lang, NULL, rate, cell, count(*) FROM u GROUP BY ALL),
f1 AS (SELECT *, sum(n) OVER o AS upto, sum(n) OVER q AS total, lead(cell) OVER o AS nxt FROM fine WINDOW q AS (PARTITION BY whole, lang, source, rate), o AS (PARTITION BY whole, lang, source, rate ORDER BY cell)),
f2 AS (SELECT *, min(CASE WHEN upto * 2 >= total THEN cell END) OVER (PARTITION BY whole, lang, source, rate) AS mid FROM f1),
f3 AS (SELECT *, round(ln(1 + nxt) * 1e6) - round(ln(1 + cell) * 1e6) AS gap FROM f2),
f4 AS (SELECT *, first_value(cell) OVER p AS low, first_value(nxt) OVER p AS hi, first_value(upto) OVER p AS below, first_value(gap) OVER p AS wide, first_value(nxt IS NOT NULL AND cell >= mid) OVER p AS has FROM f3 WINDOW p AS (PARTITION BY whole, lang, source, rate ORDER BY (nxt IS NOT NULL AND cell >= mid) DESC, gap DESC NULLS LAST, cell)),
f5 AS (SELECT whole, lang, source, rate, max(total) AS n, max(mid) AS mid, min(CASE WHEN upto * 100 >= 99 * total THEN cell END) AS high, max(CASE WHEN has THEN low END) AS low, max(CASE WHEN has THEN hi END) AS hi, max(CASE WHEN has THEN wide END) AS wide, min(CASE WHEN has AND cell >= hi AND (upto - below) * 100 >= 99 * (total - below) THEN cell END) AS top FROM f4 GROUP BY ALL),
f6 AS (SELECT *, CASE WHEN wide >= round(ln(1 + low) * 1e6) - round(ln(1 + mid) * 1e6) AND wide >= round(ln(1 + top) * 1e6) - round(ln(1 + hi) * 1e6) THEN sqrt(((1 + low) * (1 + hi))::DOUBLE) - 1 END AS middle FROM f5),
y AS (SELECT a.lang, a.source, a.rate, (a.n * a.mid + 500 * b.mid) / (a.n + 500) AS mid, (a.n * a.high + 500 * b.high) / (a.n + 500) AS high, (a.n * coalesce(a.middle, b.middle) + 500 * b.middle) / (a.n + 500) AS middle FROM f6 a JOIN f6 b ON a.whole = 0 AND b.whole = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate),
z AS (SELECT lang, source, rate, coalesce(middle, mid + 4 * (high - mid)) AS fence FROM y),
ok AS (SELECT doc_id, bool_and(cell <= coalesce(fence, cell)) AS inside FROM vc LEFT JOIN z ON vc.lang IS NOT DISTINCT FROM z.lang AND vc.source IS NOT DISTINCT FROM z.source AND vc.rate = z.rate GROUP BY doc_id)"""

#: crc: CRC-32 of each decimal id from a table made by eight steps of its polynomial; rebuilt: digests and byte counts of turns.
_REBUILT = """cell AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
ids AS (SELECT DISTINCT conv_id AS c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256))) % 9 AS h FROM conversations, cell WHERE conv_id IS NOT NULL),
named AS (SELECT conv_id AS c, turn, substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS g, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS i, g, b FROM named),
put AS (SELECT ids.c, own.i, own.g, own.b FROM ids JOIN own ON own.c = ids.c - ids.c % 5 AND own.i <= h UNION ALL SELECT ids.c, own.i, own.g, own.b FROM ids JOIN own ON own.c = ids.c AND own.i > h),
rebuilt AS (SELECT ids.c, coalesce(list(put.g ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS g, coalesce(list(put.b ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS b FROM ids LEFT JOIN put ON put.c = ids.c GROUP BY ids.c)"""

SQL: dict[str, str] = {
    "op1_quality_rules": f"""WITH {_COUNTS} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept FROM k JOIN ok USING (doc_id)""",
    "op2_chat_format": f"""WITH {_TURNS} SELECT conv_id, count(*) AS n_turns, sum(opens::INT)::BIGINT AS n_blocks, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 sum({_LONG.format("text")} + CASE WHEN opens THEN 15 + {_LONG.format("role")} ELSE 3 END)::BIGINT AS formatted_chars FROM b GROUP BY conv_id""",
    "op3_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT x AS doc_id, min(y) AS class_id, x = min(y) AS is_kept FROM reach GROUP BY x""",
    "op11_prefix_trie": f"""WITH {_REBUILT},
member AS (SELECT c, d, g[1:d] AS p, len(g) AS n, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS b FROM (SELECT *, unnest(range(len(g) + 1)) AS d FROM rebuilt)),
node AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM member GROUP BY d, p),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
below AS (SELECT p[1:e] AS p, sum(saved) AS saved, sum(leaf::INT) AS leaves FROM (SELECT node.p, saved, k IS NULL AS leaf, unnest(range(d + 1)) AS e FROM node LEFT JOIN kids ON kids.p = node.p) GROUP BY 1)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(k, 0) AS n_children, leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below ON below.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]""",
    "op13_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT x AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(y) AS component_id FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x""",
}
