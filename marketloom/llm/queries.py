"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, contamination, htmltext, licenses, linededup, merkle, minhash, multihash, oracle_sql, quality, repair, repeats, sharding, tokencounts
from marketloom.llm.common import ascii_lower, table


def op1_token_counts(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Tokens of every section of every document; a boundary token goes to the section of its first byte."""
    import public_tokenizers

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        counted = tokencounts.section_tokens(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)
    return counted.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.inline("sections"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html gives an empty one."""
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wordings and cue lines of all documents; documents without any have no row."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and posterior of every document; null texts have no words and fail the base rule."""
    q = F.col("quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    featured = quality.judge(docs, drop_text=True)
    return featured.select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")]
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the set, component and verdict of every document, on shingles of two words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and digest of what stays of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words, items and verdict of every document against all items of `benchmark`."""
    index = contamination.build_index(table(spark, sf_dir, "documents"))
    found = contamination.matches(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        contamination.contaminated().alias("contaminated"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; sizes of shards are near equal."""
    return sharding.histogram_sort(table(spark, sf_dir, "documents"), shards=8)


def op9_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Number and digest of the tokens of every document and digest of the text they decode to."""
    return token_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_json(vocabulary)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and digest of what stays of every document."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in a 16-ary manifest by source, and the roots that originals and altered texts fold to."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.row_digest(*[F.col(c) for c in fields[:-1]], ascii_lower(F.col("text"))))
    manifest = merkle.build(table(spark, sf_dir, "documents"), fields, "doc_id", "source", carry={"altered": altered})
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("path"))
    found = merkle.proofs(manifest).select("key", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), folded.alias("folded"))
    return found.select(
        F.col("key").alias("doc_id"),
        *[merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.hex_text(F.col("proof")).alias("proof_sha256"),
        merkle.hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness to those and to the next documents'."""
    found = multihash.next_edit_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        multihash.as_hex(F.col("lanes")).alias("fingerprint"),
        multihash.as_hex(F.col("edited_lanes")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults: by the CRC-32 of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its
    `.!?` (2), is repeated (3) or gets the role user (4). Nulls count as one blank."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    rows = rows.withColumn("_case", F.crc32(key) % 20).where("_case != 0")
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_case") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("_time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost and edits of every conversation with planted faults, and the digest of the repaired one."""
    whole = table(spark, sf_dir, "conversations")
    return repair.summaries(repair.repair(damaged(whole), whole.select("conv_id").distinct()))


def vocabulary_json(path: str | None = None) -> str:
    """The tokenizer file at `path`, by default the public word-level BPE of the installed vocabulary package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_html_text": op2_html_text,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash": op4_minhash,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_bpe": op9_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle": op11_merkle,
    "op12_multiset_hash": op12_multiset_hash,
    "op13_conversation_repair": op13_conversation_repair,
}
_CAPITALS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op6_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT *, {_CAPITALS.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id""",
    "op8_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_CAPITALS.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_CAPITALS.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS phrase
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw))
), hits AS (
  SELECT doc_id, item_id, p, n FROM dw JOIN bw USING (n, phrase)
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_merkle": oracle_sql.merkle(),
    "op13_conversation_repair": oracle_sql.conversation_repair(),
}
