"""News text: cleaning, sentiment, entities, topics. Whole texts, one row per article."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.textclean import is_ascii, unescape_nfkc
from marketloom.session import materialize

# Sentiment words, ambiguous names, the small knowledge base and the topic patterns.
POSITIVE_WORDS = ["surge", "jump", "growth", "profit", "beat", "up"]
NEGATIVE_WORDS = ["plunge", "drop", "loss", "miss", "down", "warning"]
AMBIGUOUS_NAMES = ["target", "square", "block", "zoom"]
KNOWLEDGE_BASE = [
    ("apple", "Apple Inc.", "AAPL"),
    ("apple inc", "Apple Inc.", "AAPL"),
    ("apple inc.", "Apple Inc.", "AAPL"),
    ("microsoft", "Microsoft Corporation", "MSFT"),
    ("tesla", "Tesla, Inc.", "TSLA"),
    ("amazon", "Amazon.com, Inc.", "AMZN"),
    ("google", "Alphabet Inc.", "GOOGL"),
    ("alphabet", "Alphabet Inc.", "GOOGL"),
    ("meta", "Meta Platforms, Inc.", "META"),
    ("facebook", "Meta Platforms, Inc.", "META"),
]
TOPIC_PATTERNS = {
    "Earnings": [r"\bearnings\b", r"\beps\b", r"\brevenue\b", r"\bguidance\b", r"\bprofit\b", r"\bquarterly results\b"],
    "M&A": [r"\bmerger\b", r"\bacquisition\b", r"\bbuyout\b", r"\btakeover\b", r"\bspinoff\b"],
    "Macroeconomics": [r"\binflation\b", r"\binterest rate\b", r"\bfed\b", r"\bfederal reserve\b", r"\bcpi\b", r"\bgdp\b", r"\bjobless claims\b"],
    "Regulatory": [r"\bsec\b", r"\blawsuit\b", r"\bregulation\b", r"\bfine\b", r"\bantitrust\b", r"\binvestigation\b"],
    "Product Launch": [r"\bnew product\b", r"\bannounces\b", r"\brollout\b", r"\bfeatures\b", r"\bupgrade\b"],
    "Market Movement": [r"\bshares up\b", r"\bshares down\b", r"\bstock surges\b", r"\bstock plunges\b", r"\bselloff\b", r"\brally\b"],
}
MIN_CHARS = 50
#: All characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOPIC_MODEL = "keyword_taxonomy_v1"
SENTIMENT_MODEL = "fallback_heuristic_v1"


def strip(c: Column) -> Column:
    """Trims all Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def choose_text(content: str = "content", description: str = "description", title: str = "title") -> Column:
    filled = [F.nullif(F.col(c), F.lit("")) for c in (content, description, title)]
    return F.coalesce(*filled, F.lit(""))


def text_gate(text: str) -> Column:
    """ok, empty_text or extremely_short_content."""
    n = F.length(strip(F.coalesce(F.col(text), F.lit(""))))
    return F.when(n == 0, "empty_text").when(n < MIN_CHARS, "extremely_short_content").otherwise("ok")


def _steps(text: Column, *steps: Callable[[Column], Column]) -> Column:
    """One step after the other; each result is computed once, though a step names it several times."""
    held = F.array(text)
    for step in steps:
        held = F.transform(held, step)
    return held[0]


def normalize(text: str) -> Column:
    """Each replacement runs only on texts that have what it replaces."""
    has = lambda t, *words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    return _steps(
        unescape_nfkc(F.coalesce(F.col(text), F.lit(""))),
        lambda t: F.when(is_ascii(t), t).otherwise(F.regexp_replace(t, "[\\u200b-\\u200f\\ufeff]", "")),
        # a single blank stays as it is
        lambda t: F.when(has(t, "  ", "\t"), F.regexp_replace(t, "\t[ \t]*| [ \t]+", " ")).otherwise(t),
        lambda t: F.when(has(t, "\n\n\n"), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t),
        lambda t: F.when(has(t, "[+"), F.regexp_replace(t, r"(?i)\[\+\d+\s*chars\]", "")).otherwise(t),
        strip,
    )


def sentiment(df: DataFrame, text: str, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS) -> DataFrame:
    """Adds sentiment_label, sentiment_score and confidence: which word list has more words present."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    present = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    diff = present(positive) - present(negative)
    score = F.when(diff > 0, 0.8).when(diff < 0, -0.8).otherwise(0.0)
    return df.withColumns(
        {
            "sentiment_label": F.when(diff > 0, "POSITIVE").when(diff < 0, "NEGATIVE").otherwise("NEUTRAL"),
            "sentiment_score": score,
            "confidence": F.abs(score),
        }
    )


def capitalised_words(text: str) -> Column:
    """Distinct capitalised words of a text. An ASCII text needs no Unicode word borders."""
    found = lambda p: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
    return F.array_distinct(F.when(is_ascii(F.col(text)), found(r"[A-Z](?<=\b[A-Z])[a-z]+\b")).otherwise(found(r"(?U)\b[A-Z][a-z]+\b")))


def match_words(df: DataFrame, key: str, words: str, dictionary: DataFrame) -> DataFrame:
    """Dictionary names (term, label) among the words: one row per article, name and label."""
    found = df.select(key, F.explode(words).alias("term"))
    return found.join(dictionary, "term").select(key, F.col("term").alias("text"), "label").distinct()


def entities(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Dictionary names found as capitalised words. Words are made distinct inside the row before they are exploded."""
    return match_words(df.select(key, capitalised_words(text).alias("words")), key, "words", dictionary)


def resolve(found: DataFrame, key: str, knowledge: DataFrame, ambiguous: list[str] = AMBIGUOUS_NAMES) -> DataFrame:
    """Canonical names per article with their aliases; ambiguous and unknown names stay unresolved.

    knowledge: name (lower case), canonical_name, ticker.
    """
    low = found.withColumn("name", F.lower("text"))
    j = low.join(knowledge, "name", "left")
    unsure = F.col("name").isin(*ambiguous) if ambiguous else F.lit(False)
    known = ~unsure & (F.col("label") == "ORG") & F.col("ticker").isNotNull()
    rows = j.select(
        key,
        F.when(known, "ORG").otherwise(F.col("label")).alias("entity_type"),
        F.when(known, F.col("canonical_name")).otherwise(F.col("text")).alias("canonical_name"),
        F.when(known, F.col("ticker")).alias("canonical_entity_id"),
        F.when(unsure, "unresolved_ambiguous").when(known, "exact_match_kb").otherwise("unresolved_unknown").alias("resolution_method"),
        F.when(known, 1.0).otherwise(0.0).alias("resolution_confidence"),
        "text",
    )
    keys = [c for c in rows.columns if c != "text"]
    # aliases of one name inside one article
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("text")).alias("aliases"))


def entity_quality(resolved: DataFrame, key: str) -> DataFrame:
    ambiguous = F.col("resolution_method") == "unresolved_ambiguous"
    return resolved.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_extracted"),
        F.count_if(~ambiguous & F.col("canonical_entity_id").isNull()).alias("unresolved_count"),
        F.count_if(ambiguous).alias("ambiguous_count"),
    )


def _plain(patterns: list[str]) -> list[str]:
    """The same matches by fewer patterns: whole words do not overlap, so distinct ones are counted by one pattern, which looks for
    a word border only where a first letter fits."""
    words = {m[1].lower() for p in patterns if (m := re.fullmatch(r"\\b([A-Za-z0-9]+)\\b", p))}
    rest = [p for p in patterns if not re.fullmatch(r"\\b[A-Za-z0-9]+\\b", p)]
    if len(words) + len(rest) < len(patterns) or not words:  # a word given twice counts twice
        return patterns
    firsts = "".join(sorted({w[0] for w in words}))
    return [rf"(?=[{firsts}])\b(?:{'|'.join(sorted(words))})\b", *rest]


def _count(text: Column, pattern: str) -> Column:
    """Matches without regard to case. For words and borders in an ASCII text the ASCII rules say the same and are faster."""
    every = F.regexp_count(text, F.lit("(?iU)" + pattern))
    if not re.fullmatch(r"(\(\?=\[[a-z0-9]+\]\)|\(\?:|[|)]|\\b|[A-Za-z0-9 ])+", pattern):
        return every
    return F.when(is_ascii(text), F.regexp_count(text, F.lit("(?i)" + pattern))).otherwise(every)


def topic_hits(text: str, taxonomy: dict[str, list[str]]) -> Column:
    """Array of (topic_name, hits): the patterns of a topic are counted over the whole text."""
    hits = lambda ps: sum((_count(F.col(text), p) for p in _plain(ps)), F.lit(0))
    return F.array(*[F.struct(F.lit(t).alias("topic_name"), hits(ps).alias("hits")) for t, ps in taxonomy.items()])


def scored_topics(df: DataFrame, key: str, hits: str) -> DataFrame:
    """(article, topic, hits, score) for topics with a hit."""
    rows = df.where(F.col(hits).isNotNull()).select(key, F.explode(hits).alias("t")).select(key, "t.*").where("hits > 0")
    return rows.withColumn("topic_score", F.round(F.least(F.col("hits") / 3.0, F.lit(1.0)), 2))


def topics(df: DataFrame, key: str, text: str, taxonomy: dict[str, list[str]] = TOPIC_PATTERNS) -> DataFrame:
    return scored_topics(df.where(F.col(text).isNotNull()).select(key, topic_hits(text, taxonomy).alias("_hits")), key, "_hits")


def annotate(articles: DataFrame, taxonomy: dict[str, list[str]], positive: list[str], negative: list[str]) -> DataFrame:
    """Everything read off a text in one pass, without the text: gate, sentiment, words, topic hits.

    Written once, so that the tables derived from it do not read and clean the texts again.
    """
    if "description" not in articles.columns:
        articles = articles.withColumn("description", F.lit(None).cast("string"))
    gated = articles.withColumn("raw_text", choose_text()).withColumn("gate", text_gate("raw_text"))
    clean = gated.withColumn("clean_text", F.when(F.col("gate") == "ok", normalize("raw_text")))
    rows = sentiment(clean, "clean_text", positive, negative).select(
        "article_id", "published_at", "gate", "sentiment_label", "sentiment_score", "confidence",
        F.when(F.col("gate") == "ok", capitalised_words("clean_text")).alias("words"),
        F.when(F.col("gate") == "ok", topic_hits("clean_text", taxonomy)).alias("topic_hits"),
    )
    return materialize(rows, "annotated")


def main_topic(found: DataFrame, key: str) -> DataFrame:
    """Highest score, ties by name."""
    return found.groupBy(key).agg(F.min_by("topic_name", F.struct(-F.col("topic_score"), "topic_name")).alias("topic"))


def nlp_batch(articles: DataFrame, done: DataFrame, dictionary: DataFrame, knowledge: DataFrame, model_version: str, taxonomy: dict[str, list[str]] = TOPIC_PATTERNS,
              positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS) -> dict[str, DataFrame]:
    """Output tables for the articles that have no sentiment of this model version yet.

    articles: article_id, published_at, title, content (and description if present). done: article_id, model_version.
    """
    todo = articles.join(done.where(F.col("model_version") == model_version).select("article_id"), "article_id", "left_anti")
    seen = annotate(todo, taxonomy, positive, negative)
    feel = seen.select("article_id", "gate", "sentiment_label", "sentiment_score", "confidence", F.lit(model_version).alias("model_version"))
    ents = resolve(match_words(seen, "article_id", "words", dictionary), "article_id", knowledge)
    return {"sentiment": feel, "entities": ents, "topics": scored_topics(seen, "article_id", "topic_hits")}


def batch_record(out: dict[str, DataFrame], run_id: str) -> DataFrame:
    """One row per run: articles, how many passed the gate, entities and topics written."""
    s = out["sentiment"].agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("gate") == "ok").alias("processed")).withColumn("run_id", F.lit(run_id))
    e = out["entities"].agg(F.count(F.lit(1)).alias("entities")).withColumn("run_id", F.lit(run_id))
    t = out["topics"].agg(F.count(F.lit(1)).alias("topics")).withColumn("run_id", F.lit(run_id))
    return s.join(e, "run_id").join(t, "run_id")
