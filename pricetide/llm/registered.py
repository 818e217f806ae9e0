"""The registered queries of the numbered operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import alignment, bpe, chat, decontaminate, licenses, lines, neardup, packing, pitmanyor, quality, suffixes, variants, warc
from pricetide.llm.common import table
from pricetide.llm.registry import query
from pricetide.session import scratch_folder


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_pitman_yor")
def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"))


_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"
_LICENSE_SQL = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '@WORD') AS words FROM d
), phrase(phrase, label) AS (VALUES @PHRASES
), p AS (
  SELECT doc_id, i - 1 AS start, label
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w
        WHERE regexp_matches(text, 'cc|general|reserved')) x, phrase
  WHERE array_to_string(words[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS own
  FROM p GROUP BY doc_id
), t AS (
  SELECT label, list_distinct(regexp_extract_all(lower(text), '@WORD')) AS words
  FROM (VALUES @TEMPLATES) v(label, text)
), lines AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: regexp_extract_all(l, '@WORD')) AS ls FROM d
), run AS (
  SELECT doc_id, k, flatten(ls[i:i + k - 1]) AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines), (SELECT unnest(range(1, @LINES + 1)) AS k)
  WHERE i + k - 1 <= len(ls)
), block AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(ws)) AS own FROM run WHERE k = 1 OR len(ws) <= @MANY
), m AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(common / size) AS score
  FROM (SELECT doc_id, label, len(list_intersect(own, words)) AS common, len(words) AS size FROM block, t)
  WHERE common * 100 >= @PERCENT * size GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(found, [])))), ','), '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN m USING (doc_id)
"""
for _name, _value in {
    "@WORD": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
    "@PHRASES": ", ".join(f"({_QUOTED(p)}, {_QUOTED(n)})" for p, n in licenses.PHRASES),
    "@TEMPLATES": ", ".join(f"({_QUOTED(n)}, {_QUOTED(t)})" for n, t in licenses.TEMPLATES),
    "@PERCENT": str(licenses.PERCENT),
    "@LINES": str(licenses.RUN_LINES),
    "@MANY": str(licenses.run_words()),
}.items():
    _LICENSE_SQL = _LICENSE_SQL.replace(_name, _value)


@query("op3_license_scan", _LICENSE_SQL)
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_warc")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    read = warc.records(warc.read_archives(spark, folder, payloads=False))
    return read.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.kept_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["stop"] - r["start"])
    return left.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


_LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, i - 1 AS i, trim(ls[i], ' ') AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n,
         len(ls) AS n_lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
       UNNEST(range(1, len(ls) + 1)) AS u(i)
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM line WHERE n > 0
), pair AS (
  SELECT a.doc_id, a.i, a.p, a.n, b.doc_id AS of, a.p - b.p AS shift
  FROM worded a JOIN worded b ON b.line = a.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.p < a.p))
), step AS (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id, of, shift ORDER BY p) AS run FROM pair
), long AS (
  SELECT list(i) AS lines, doc_id FROM step GROUP BY doc_id, of, shift, run HAVING sum(n) >= 25 OR count(*) >= 8
), gone AS (
  SELECT DISTINCT doc_id, unnest(lines) AS i FROM long
)
SELECT d.doc_id, coalesce(max(l.n_lines), 0) AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line_text END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, i - 1 AS i, ls[i] AS line_text, len(ls) AS n_lines
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
                UNNEST(range(1, len(ls) + 1)) AS u(i)) l ON l.doc_id = d.doc_id
LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id
"""


@query("op10_line_dedup", _LINES_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lines.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(lines.kept_text(text, F.col("__removed")), 256).alias("kept_sha256"),
    )


_ESCAPE_SQL = "replace(replace(replace(replace({}, chr(92), repeat(chr(92), 2)), '<', chr(92) || 'l'), '[', chr(92) || 'b'), chr(10), chr(92) || 'n')"
_CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length({_ESCAPE_SQL.format('role')}) + 1 + length({_ESCAPE_SQL.format('text')}) + 11)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _records(rows: DataFrame) -> DataFrame:
    """The conversation rows as JSON records, in one of seven layouts each, as mixed sources would send them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    message = lambda *pairs: F.struct(*(v.alias(k) for k, v in pairs))
    foreign = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    messages = F.to_json(F.struct(F.array(message(("role", role), ("content", text))).alias("messages")))
    sent = F.to_json(F.struct(F.array(message(("from", foreign), ("value", text))).alias("conversations")))
    said = message(("speaker", F.struct(role.alias("kind"))), ("body", F.struct(text.alias("text"))))
    dialog = F.to_json(F.struct(F.array(said).alias("dialog")))
    flat = F.to_json(F.struct(role.alias("role"), text.alias("text")))
    one = lambda user, other: F.when(role == "user", F.to_json(user)).when(role == "assistant", F.to_json(other)).otherwise(messages)
    prompt = one(F.struct(text.alias("prompt")), F.struct(text.alias("completion")))
    instruction = one(F.struct(text.alias("instruction")), F.struct(text.alias("output")))
    nested = F.struct(text.alias("text"))
    question = one(F.struct(nested.alias("question")), F.struct(nested.alias("answer")))
    sent = F.when(role.isin("human", "gpt"), messages).otherwise(sent)  # its names for user and assistant
    layouts = [messages, sent, dialog, flat, prompt, instruction, question]
    pick = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(layouts)).cast("long"))
    record = layouts[0]
    for k, layout in enumerate(layouts[1:], 1):
        record = F.when(pick == k, layout).otherwise(record)
    return rows.select("conv_id", "turn", record.alias("record"))


@query("op5_chat_format", _CHAT_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    turns = chat.canonical_turns(_records(rows.unionByName(extra)))
    return chat.read_back(chat.formatted(turns))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = alignment.alignments(table(spark, sf_dir, "documents"), *paths, keep_groups=False)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    # the end id lies in the vocabulary of 49 408 ids
    packing.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end=1)
    return packing.read(spark, folder, keep_ids=False)


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))
