"""Registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, chat_format, exact_dedup, html_extract, langid, lexical_search, packing, prefix_trie, sentencepiece_bpe,
               simhash, substring_dedup, toxicity, url_filter)
from .common import crc_mod, read, sha256_text, workers_find_package

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    filters = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), filters) \
        .select("doc_id", "held_out", "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read(spark, sf_dir, "documents")) \
        .select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    trip = sentencepiece_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return trip.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                       sha256_text(F.col("decoded")).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its component, how many passages and words were cut, and the text that stays."""
    return substring_dedup.clean(read(spark, sf_dir, "documents").select("doc_id", "text"), report=True) \
        .select("doc_id", "component_id", "n_spans", "removed_words", "text")


def toxicity_model(spark: SparkSession, sf_dir: str):
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.train(read(spark, sf_dir, "documents"), labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         toxicity.predicted(F.col("score")).alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")) \
        .select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0) \
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=50) \
        .select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt from the first turns of every fifth one and their own later turns."""
    conv = F.col("conv_id")
    return prefix_trie.trie(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"),
                            base=conv - conv % 5, keep=F.crc32(conv.cast("string")) % 9, max_head=8)


PROBE = "</s>[INST] ok [/INST]"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations come as a row per turn, conversation -1 as a record of prompt and response."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(PROBE).alias("prompt"), F.lit(PROBE).alias("response"))
    turns = chat_format.canonical_turns(rows.unionByName(probe, allowMissingColumns=True))
    return chat_format.read_back(chat_format.format_turns(turns)).withColumnRenamed("id", "conv_id")


_QUERIES = [op1_url_filter, op2_html_extract, op3_language_id, op4_exact_dedup, op5_sentencepiece, op6_substring_dedup,
            op7_toxicity, op8_simhash, op9_packing, op10_nearest, op11_lexical_search,
            op12_prefix_trie, op13_chat_format]


def _registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {fn.__name__: _registered(fn) for fn in _QUERIES}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[0-9a-z\x{80}-\x{10FFFF}]+')"""
# CRC-32 (polynomial 0xEDB88320) of a number's decimal text.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda crc, b: list_reduce([xor(crc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                       lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _escaped(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in sorted(chat_format.INSTRUCT.controls, key=len, reverse=True):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_MARKS = {r: len(a) + len(b) for r, (a, b) in chat_format.INSTRUCT.roles.items()}

ORACLES = {
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
        stats AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
        items AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        tf AS (SELECT r, doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS term FROM d)
               WHERE term IN (SELECT term FROM items) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        part AS (SELECT r, doc_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                        * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS s
                 FROM tf JOIN df USING (term), stats),
        total AS (SELECT item_id, r, doc_id, sum(s)::BIGINT AS score FROM items JOIN part USING (term) GROUP BY ALL),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
                   FROM total WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50""",
    "op12_prefix_trie": f"""
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, {_CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM turns)),
        rebuilt AS (
            SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY part, pos) AS depth, t, text
            FROM convs c JOIN (SELECT conv_id AS src, 0 AS part, pos, t, text FROM turns
                               UNION ALL SELECT conv_id, 1, pos, t, text FROM turns) x
              ON (part = 0 AND src = c.base AND pos <= c.h) OR (part = 1 AND src = c.conv_id AND pos > c.h)),
        paths AS (
            SELECT conv_id, depth, strlen(text) AS bytes, list(t) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
            UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM convs),
        sized AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths),
        nodes AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
            FROM sized GROUP BY path, depth),
        children AS (SELECT path[:-2] AS parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
        below AS (
            SELECT n.path[:k] AS path, sum(saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
            FROM (SELECT *, unnest(range(depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.parent = n.path GROUP BY ALL)
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
               b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:-2]
        LEFT JOIN children c ON c.parent = n.path JOIN below b ON b.path = n.path""",
    "op13_chat_format": f"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
        sized AS (SELECT *, length({_escaped("text")})
                         + CASE role {" ".join(f"WHEN '{r}' THEN {n}" for r, n in _MARKS.items())}
                                ELSE {sum(map(len, chat_format.INSTRUCT.other))} + length({_escaped("role")}) END AS size FROM rows)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(size)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
