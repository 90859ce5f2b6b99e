"""The registered queries over ``documents``, ``pages``, ``labels`` and ``benchmark``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from horosphere.llm.byte_bpe import round_trip
from horosphere.llm.conversation_repair import repair_digests
from horosphere.llm.decontaminate import contaminated
from horosphere.llm.exact_dedup import exact_dedup
from horosphere.llm.html_extract import extract_pages
from horosphere.llm.language_id import fit_language_model, identify_language
from horosphere.llm.license_scan import license_scan
from horosphere.llm.minimax_shards import minimax_shards
from horosphere.llm.mixture import mix_sources
from horosphere.llm.parity_join import near_components
from horosphere.llm.quality_pu import fit_quality, score_quality
from horosphere.llm.tables import fold, prepare, split_pattern, table, tokenizer_path
from horosphere.llm.token_alignment import align_documents
from horosphere.llm.token_blocks import token_blocks


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~fold("doc_id", 4, 2)))
    return identify_language(docs, model, fold("doc_id", 4, 2))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda c: ~fold(c, 5, 0))
    return score_quality(docs, model).select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"), shards=16)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scan, op2_language_id, op3_exact_dedup, op4_benchmark_decontamination, op5_source_mixture,
             op6_html_extraction, op7_token_blocks, op8_quality_classifier, op9_ngram_jaccard_join,
             op10_minimax_shards, op11_conversation_repair, op12_byte_bpe, op13_token_alignment]
    return {f.__name__: _prepared(f) for f in found} | {"pipeline": corpus_pipeline.run}


def _prepared(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)
    run.__name__ = query.__name__
    return run


_WORD = r"[^\x20\x09-\x0D]+"

_OP3 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         CAST('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size::DOUBLE AS cap, 2.0 * source_size::DOUBLE / weight AS full_at FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, weight, cap,
         coalesce(least(cap, weight * (SELECT level FROM l WHERE level <= full_at * (1 + 1e-12) ORDER BY full_at LIMIT 1)), 0)
           AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.epochs,
         floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""

_OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ')
                               ELSE array_to_string(ws[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, least(len(ws), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
k AS MATERIALIZED (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.a, r.m FROM e JOIN r ON e.b = r.d)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.d = doc_id GROUP BY doc_id, n.n
"""


def _op11() -> str:
    """Every state's cheapest way row by row: (cost, edits, repaired text), least as structs; a damaged
    row's crc32 by its table."""
    none = "{'c': 1000000000, 'k': '', 'o': ''}"

    def way(state: str, cost: str, edits: str, *lines: str, only: str = "true") -> str:
        out = f"{state}.o"
        for line in lines:
            out = f"({out} || CASE WHEN {out} = '' THEN '' ELSE chr(10) END || {line})"
        return f"CASE WHEN {only} THEN {{'c': {state}.c + {cost}, 'k': {state}.k || '{edits}', 'o': {out}}} ELSE {none} END"

    def to(name: str, starts: list[tuple[str, str, tuple[str, ...]]]) -> list[str]:
        """Ways into user or assistant: keep or rerole after the given inserts."""
        return [w for state, inserts, lines in starts for w in (
            way(state, f"{2 * len(inserts)} + t", inserts + "K", *lines, "role || ':' || text",
                only=f"NOT gone AND role LIKE '{name[0]}%'"),
            way(state, f"{2 * len(inserts) + 2} + t", inserts + "R", *lines, f"'{name}:' || text", only="NOT gone"))]

    least = lambda ways: f"list_sort([{', '.join(ways)}])[1]"  # noqa: E731
    user, bot = "'user:'", "'assistant:'"
    e = way("e", "3", "D")
    s = least([way("s", "3", "D"), way("e", "t", "K", "role || ':' || text", only="NOT gone AND role LIKE 's%'")])
    u = least([way("u", "3", "D"), *to("user", [("e", "", ()), ("s", "", ()), ("a", "", ()), ("u", "I", (bot,))])])
    a = least([way("a", "3", "D"), *to("assistant", [("u", "", ()), ("e", "I", (user,)), ("s", "I", (user,)),
                                                     ("a", "I", (user,))])])
    end = least(["e", "a", way("u", "2", "I", bot), way("s", "4", "II", user, bot)])
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                                                     lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS t),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, crc),
x AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) FROM d WHERE h <> 0)),
n AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM x),
f AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') AS cut,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM n),
r AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, blank, again AND NOT blank AS dup, cut AND NOT again AND NOT blank AS trunc,
         blank OR again AS gone, (cut AND NOT again AND NOT blank)::INT AS t,
         prior IS NOT NULL AND prior[1] || role[1] NOT IN ('su', 'ua', 'au') AS bad FROM f),
v AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'k': '', 'o': ''}} AS e, {none} AS s, {none} AS u, {none} AS a
  FROM conversations
  UNION ALL
  SELECT v.conv_id, r.i, {e}, {s}, {u}, {a}
  FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1),
b AS (SELECT conv_id, {end} AS z FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
         sum(dup::INT) AS duplicate, sum(trunc::INT) AS truncated, sum(bad::INT) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, z.c::BIGINT AS cost, z.k AS audit, sha256(z.o) AS repaired_sha256
FROM b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the query; the others are tested by brute force."""
    sql = {"op3_exact_dedup": _OP3, "op5_source_mixture": _OP5, "op9_ngram_jaccard_join": _OP9,
           "op11_conversation_repair": _op11()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
