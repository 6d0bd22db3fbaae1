"""The registered queries of this subpackage, over the whole of their tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.chat import conversation_digests, windows
from bazaarlake.llm.common import Scratch, id_of, table
from bazaarlake.llm.exact import radix_groups
from bazaarlake.llm.html import main_texts
from bazaarlake.llm.language import identify
from bazaarlake.llm.lines import keep_bitmaps, kept_digests
from bazaarlake.llm.mixing import mix
from bazaarlake.llm.near import near_duplicates
from bazaarlake.llm.packing import pack
from bazaarlake.llm.quality import ledger, verdicts
from bazaarlake.llm.search import search
from bazaarlake.llm.secrets import report, scan
from bazaarlake.llm.suffixes import without_repeats
from bazaarlake.llm.trie import prefix_trie
from bazaarlake.session import tune


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    planted = tune(spark).createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select(planted.columns)
    return conversation_digests(windows(rows.unionByName(planted)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents").select(
        "doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")
    )
    groups = radix_groups(docs, Scratch(spark, "op2"), carry=("digest",))
    return groups.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("row.digest")).alias("text_sha256")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    return pack(docs, Scratch(spark, "op3"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    scratch = Scratch(spark, "op4")
    return kept_digests(docs, scratch.keep(keep_bitmaps(docs, scratch), "bitmaps"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(tune(spark), sf_dir, "documents"), Scratch(spark, "op5"))
    return mixed.select(id_of("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verdicts(ledger(table(tune(spark), sf_dir, "documents")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(tune(spark), sf_dir, "documents"), Scratch(spark, "op7")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(tune(spark), sf_dir, "documents"), Scratch(spark, "op8"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(tune(spark), sf_dir, "documents"), Scratch(spark, "op9"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(tune(spark), sf_dir, "pages"), Scratch(spark, "op10"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(tune(spark), sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(tune(spark), sf_dir, name) for name in ("documents", "benchmark"))
    return search(docs, items, Scratch(spark, "op12"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie(
        table(tune(spark), sf_dir, "conversations"),
        Scratch(spark, "op13"),
        base=conv - conv % 5,
        history=F.crc32(conv.cast("string")) % 9,
    )


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_language_id": op11_language_id,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, place, part.line AS line,
                   regexp_replace(part.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
                  FROM documents) AS part
        ), keyed AS (
            SELECT *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), flagged AS (
            SELECT k.doc_id, k.place, k.line, coalesce(c.holder <> k.doc_id, false) AS dropped
            FROM keyed AS k LEFT JOIN common AS c ON c.key = k.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM flagged GROUP BY doc_id
    """,
    "op5_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents
        ), totals AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
        ), tested AS (
            SELECT w.*, 3 * source_size * (sum(weight) OVER () - coalesce(sum(weight) OVER prior, 0))
                        <= (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER prior, 0)) * weight AS capped
            FROM weighed AS w
            WINDOW prior AS (ORDER BY source_size / weight, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), rest AS (
            SELECT (sum(source_size) - 3 * coalesce(sum(source_size) FILTER (capped), 0))::BIGINT AS words,
                   coalesce(sum(weight) FILTER (NOT capped), 0)::BIGINT AS weights
            FROM tested
        ), targets AS (
            SELECT source, source_size,
                   CASE WHEN capped THEN (3 * source_size)::DOUBLE
                        ELSE (words * weight)::DOUBLE / weights END AS target
            FROM tested, rest
        ), placed AS (
            SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(doc_id::VARCHAR), doc_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM sized AS s JOIN targets AS t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN size = 0 THEN 0
                    ELSE goal // source_size * size
                         + greatest(0, least(size, goal % source_size - start)) END::BIGINT AS taken
        FROM placed
    """,
    "op6_quality_rules": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents
        ), words AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
                   generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS place
            FROM docs
        ), gram AS (
            SELECT *, lag(word) OVER o = word AS again,
                   CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN
                       concat_ws(chr(10), word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
                                 lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o)
                   END AS eight
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY place)
        ), starts AS (
            SELECT *, eight IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, eight) > 1 AS repeated FROM gram
        ), covered AS (
            SELECT *, max(repeated::INT) OVER (PARTITION BY doc_id ORDER BY place
                                               ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside
            FROM starts
        ), by_words AS (
            SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars,
                   sum(inside)::BIGINT AS n_repeat_words, count(*) FILTER (again) AS n_stutter
            FROM covered GROUP BY doc_id
        ), by_lines AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), measured AS (
            SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutter, 0) AS n_stutter,
                   length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
                   length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
            FROM docs AS d LEFT JOIN by_words USING (doc_id) LEFT JOIN by_lines USING (doc_id)
        ), judged AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
                    OR 2 * n_stutter > n_words OR n_upper > n_lower) AS kept
        FROM judged
    """,
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 1),
                                    lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
            FROM split
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            JOIN sizes AS x ON x.doc_id = a.doc_id JOIN sizes AS y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n
            HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON l.a = r.other
        )
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id,
               d.doc_id = min(r.other) AS kept
        FROM documents AS d LEFT JOIN sizes AS s ON s.doc_id = d.doc_id JOIN reach AS r ON r.doc_id = d.doc_id
        GROUP BY d.doc_id, s.n
    """,
    "op12_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), lengths AS (
            SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
        ), corpus AS (
            SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
        ), normed AS (
            SELECT doc_id, 10 + 90 * n * docs // terms AS m FROM lengths, corpus
        ), counted AS (
            SELECT doc_id, term, count(*) AS tf FROM words
            WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM counted, corpus GROUP BY term
        ), scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN normed USING (doc_id)
            GROUP BY item_id, doc_id
        )
        SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 10
    """,
    "op13_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role,
                   sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS code,
                   octet_length(encode(coalesce(text, '')))::BIGINT AS size
            FROM conversations
        ), own AS (
            SELECT conv_id, list({'code': code, 'size': size} ORDER BY turn NULLS FIRST, role, code) AS turns
            FROM turns GROUP BY conv_id
        ), history AS (
            SELECT *, xor(list_reduce(
                       flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                                              lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                                         WHEN a % 2 = 1 THEN xor(a // 2, 3988292384)
                                         ELSE a // 2 END, 4294967295), 4294967295) % 9 AS h
            FROM own
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []),
                                          list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
            FROM history AS c LEFT JOIN own AS b ON b.conv_id = c.conv_id - c.conv_id % 5
        ), paths AS (
            SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
        ), members AS (
            SELECT conv_id, depth, len(turns) = depth AS ends,
                   array_to_string(list_transform(list_slice(turns, 1, depth), lambda t: t.code), ',') AS key,
                   array_to_string(list_transform(list_slice(turns, 1, depth - 1), lambda t: t.code), ',') AS parent,
                   CASE WHEN depth > 0 THEN turns[depth].size ELSE 0 END AS size
            FROM paths
        ), nodes AS (
            SELECT key, depth, CASE WHEN depth > 0 THEN any_value(parent) END AS parent, min(conv_id) AS conv_id,
                   count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY key, depth
        ), children AS (
            SELECT parent AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
        ), below AS (
            SELECT DISTINCT a.key, d.key AS other
            FROM members AS a JOIN members AS d ON a.conv_id = d.conv_id AND a.depth <= d.depth
        ), summed AS (
            SELECT b.key, sum(o.saved)::BIGINT AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
            FROM below AS b JOIN nodes AS o ON o.key = b.other LEFT JOIN children AS c ON c.key = b.other
            GROUP BY b.key
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM nodes AS n JOIN summed AS s ON s.key = n.key
        LEFT JOIN children AS c ON c.key = n.key LEFT JOIN nodes AS p ON p.key = n.parent
    """,
}
