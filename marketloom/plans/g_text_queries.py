from pyspark.sql import functions as F

from marketloom.functions.expr import rnd
from marketloom.operators import events as E
from marketloom.operators import joins as J
from marketloom.operators import relations as L
from marketloom.operators import text as T
from marketloom.plans.d_stats_queries import t_p
from marketloom.plans.registry import query
from marketloom.plans.sqlviews import NEWS, RETURNS, r, sql
from marketloom.sources import views as V

TERMS = dict(zip(["The", "Of", "And", "To", "In", "Is"], V.SYMBOLS))
TAXONOMY = {"relative": [r"\bthat\b", r"\bwith\b"], "near": [r"\bthis\b", r"\bfrom\b"], "suffix": [r"\bthan\b", "tion"]}
POSITIVE = ["the", "and", "tion", "ing", "ent", "ed"]
NEGATIVE = ["der", "que", "los", "une", "ung", "est"]


def dictionary(spark):
    return spark.createDataFrame([(t, "ORG") for t in TERMS], "term string, label string")


def knowledge(spark):
    return spark.createDataFrame([(t.lower(), f"{s} Corp", s) for t, s in TERMS.items() if t != "Is"], "name string, canonical_name string, ticker string")


CHOSEN = NEWS + ",\nch AS (SELECT article_id, CASE WHEN article_id % 4 = 0 THEN CASE WHEN article_id % 8 = 0 THEN title ELSE url END ELSE content END AS t FROM news)"


@query(
    "nlp_01",
    sql(CHOSEN, "SELECT article_id, length(t) AS n_chars, CASE WHEN length(trim(t, E' \\t\\n\\r')) = 0 THEN 'empty_text' WHEN length(trim(t, E' \\t\\n\\r')) < 50 THEN 'extremely_short_content' ELSE 'ok' END AS gate FROM ch"),
)
def nlp_01(spark, sf):
    i = F.col("article_id")
    n = V.news(spark, sf).select(
        "article_id", F.when(i % 4 != 0, F.col("content")).otherwise("").alias("content"),
        F.when((i % 4 == 0) & (i % 8 != 0), F.col("url")).alias("description"), "title",
    )
    return n.withColumn("t", T.choose_text()).select("article_id", F.length("t").alias("n_chars"), T.text_gate("t").alias("gate"))


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '\[\+\d+\s*chars\]', '', 'gi'), '^\s+|\s+$', '', 'g'))"""


@query("nlp_02", sql(NEWS, f"SELECT article_id, sha256({CLEAN.format(t=chr(39) + ' ' + chr(39) + ' || content || ' + chr(39) + ' & fine [+12 chars] ' + chr(39))}) AS clean_sha FROM news"))
def nlp_02(spark, sf):
    """Texts wrapped in a tag, with an entity, a ligature, a zero-width mark and a provider marker."""
    n = V.news(spark, sf).withColumn("t", F.concat(F.lit("<p>"), "content", F.lit("&lt;/p&gt;&amp; \ufb01ne\u200b  [+12 chars] ")))
    return n.select("article_id", F.sha2(T.normalize("t"), 256).alias("clean_sha"))


def _present(words):
    return " + ".join(f"CAST(contains(lower(content), '{w}') AS INTEGER)" for w in words)


LONG = "length(trim(content, E' \\t\\n\\r')) >= 50"
FEEL = f"feel AS (SELECT article_id, published_at, ({_present(POSITIVE)}) - ({_present(NEGATIVE)}) AS d FROM news),\nsent AS (SELECT article_id, CASE WHEN d > 0 THEN 'POSITIVE' WHEN d < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label, CASE WHEN d > 0 THEN 0.8::DOUBLE WHEN d < 0 THEN -0.8::DOUBLE ELSE 0.0::DOUBLE END AS sentiment_score FROM feel)"


@query("nlp_03", sql(NEWS, FEEL, "SELECT article_id, sentiment_label, sentiment_score, abs(sentiment_score) AS confidence FROM sent"))
def nlp_03(spark, sf):
    df = T.sentiment(V.news(spark, sf), "content", POSITIVE, NEGATIVE)
    return df.select("article_id", "sentiment_label", "sentiment_score", "confidence")


FOUND = r"""words AS (SELECT article_id, unnest(list_distinct(regexp_extract_all(content, '[\p{L}\p{N}_]+'))) AS term FROM news),
found AS (SELECT article_id, term FROM words WHERE term IN (""" + ", ".join(f"'{t}'" for t in TERMS) + "))"


@query("nlp_04", sql(NEWS, FOUND, "SELECT article_id, term AS text, 'ORG' AS label FROM found"))
def nlp_04(spark, sf):
    return T.entities(V.news(spark, sf), "article_id", "content", dictionary(spark))


RESOLVED = """res AS (SELECT article_id, 'ORG' AS entity_type, CASE term WHEN 'The' THEN 'ECONOMY Corp' WHEN 'Of' THEN 'LARGE Corp' WHEN 'And' THEN 'MEDIUM Corp' WHEN 'In' THEN 'SMALL Corp' ELSE term END AS canonical_name,
  CASE term WHEN 'The' THEN 'ECONOMY' WHEN 'Of' THEN 'LARGE' WHEN 'And' THEN 'MEDIUM' WHEN 'In' THEN 'SMALL' END AS canonical_entity_id,
  CASE term WHEN 'To' THEN 'unresolved_ambiguous' WHEN 'Is' THEN 'unresolved_unknown' ELSE 'exact_match_kb' END AS resolution_method,
  CASE WHEN term IN ('To', 'Is') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS resolution_confidence, term AS aliases FROM found)"""


def resolved(spark, sf):
    return T.resolve(T.entities(V.news(spark, sf), "article_id", "content", dictionary(spark)), "article_id", knowledge(spark), ["to"])


@query("nlp_05", sql(NEWS, FOUND, RESOLVED, "SELECT * FROM res"))
def nlp_05(spark, sf):
    return resolved(spark, sf).withColumn("aliases", F.concat_ws(",", "aliases"))


@query(
    "nlp_06",
    sql(NEWS, FOUND, RESOLVED, "SELECT article_id, count(*) AS total_extracted, count(*) FILTER (WHERE resolution_method = 'unresolved_unknown') AS unresolved_count, count(*) FILTER (WHERE resolution_method = 'unresolved_ambiguous') AS ambiguous_count FROM res GROUP BY 1"),
)
def nlp_06(spark, sf):
    return T.entity_quality(resolved(spark, sf), "article_id")


def _hits(ps):
    return " + ".join(f"len(regexp_extract_all(content, '(?i){p}'))" for p in ps)


TOPICS = "th AS (" + " UNION ALL ".join(f"SELECT article_id, '{t}' AS topic_name, {_hits(ps)} AS hits FROM news" for t, ps in TAXONOMY.items()) + "),\ntop AS (SELECT article_id, topic_name, hits, round(least(hits / 3.0::DOUBLE, 1.0), 2) AS topic_score FROM th WHERE hits > 0),\nmain AS (SELECT article_id, min_by(topic_name, (-topic_score, topic_name)) AS topic FROM top GROUP BY 1)"


@query("nlp_07", sql(NEWS, TOPICS, "SELECT article_id, topic_name, CAST(hits AS INTEGER) AS hits, topic_score FROM top"))
def nlp_07(spark, sf):
    return T.topics(V.news(spark, sf), "article_id", "content", TAXONOMY)


@query(
    "nlp_08",
    sql(
        NEWS, FOUND, TOPICS,
        "todo AS (SELECT article_id, length(trim(content, E' \\t\\n\\r')) >= 50 AS ok FROM news WHERE article_id % 3 <> 0)",
        """SELECT 'run-1' AS run_id, count(*) AS articles, count(*) FILTER (WHERE ok) AS processed, (SELECT count(*) FROM found JOIN todo USING (article_id) WHERE ok) AS entities, (SELECT count(*) FROM top JOIN todo USING (article_id) WHERE ok) AS topics FROM todo""",
    ),
)
def nlp_08(spark, sf):
    n = V.news(spark, sf)
    done = n.where("article_id % 3 = 0").select("article_id", F.lit("v1").alias("model_version"))
    out = T.nlp_batch(n, done, dictionary(spark), knowledge(spark), "v1", TAXONOMY, POSITIVE, NEGATIVE)
    return T.batch_record(out, "run-1")


HOLIDAY = """hol AS (SELECT CAST(d AS DATE) AS day, month(d) AS m, day(d) AS dd, isodow(d) AS w, month(d) * 100 + day(d) AS md, month(d + INTERVAL 1 DAY) * 100 + day(d + INTERVAL 1 DAY) AS nx, month(d - INTERVAL 1 DAY) * 100 + day(d - INTERVAL 1 DAY) AS pv
  FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) g(d)),
cal AS (SELECT day, w < 6 AND NOT (day >= DATE '2000-01-01' AND (md IN (101, 704, 1111, 1225) OR (w = 5 AND nx IN (101, 704, 1111, 1225)) OR (w = 1 AND pv IN (101, 704, 1111, 1225))
  OR (w = 1 AND ((m IN (1, 2) AND dd BETWEEN 15 AND 21) OR (m = 5 AND dd >= 25) OR (m = 9 AND dd <= 7) OR (m = 10 AND dd BETWEEN 8 AND 14))) OR (w = 4 AND m = 11 AND dd BETWEEN 22 AND 28))) AS is_trading FROM hol)"""


def calendar(spark):
    return E.trading_calendar(spark, "1994-12-01", "2002-12-20")


@query(
    "evt_01",
    sql(
        HOLIDAY,
        "od AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)",
        "SELECT CAST(day AS VARCHAR) AS day, n, is_trading, CAST((SELECT min(c2.day) FROM cal c2 WHERE c2.is_trading AND c2.day > od.day) AS VARCHAR) AS next_trading_day FROM od JOIN cal USING (day)",
    ),
)
def evt_01(spark, sf):
    """Every order day against the calendar."""
    days = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(calendar(spark), "day").select("day", "n", "is_trading", "next_trading_day")


ALIGNED = """loc AS (SELECT article_id, published_at, published_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS lt FROM news),
al0 AS (SELECT article_id, published_at, CAST(lt AS DATE) AS day, hour(lt) * 60 + minute(lt) AS mi, is_trading FROM loc JOIN cal ON CAST(lt AS DATE) = day),
al1 AS (SELECT article_id, published_at, day, CASE WHEN NOT is_trading THEN 'WEEKEND_HOLIDAY' WHEN mi < 570 THEN 'PRE_MARKET' WHEN mi >= 960 THEN 'POST_MARKET' ELSE 'INTRADAY' END AS rel FROM al0),
aligned AS (SELECT article_id, published_at, rel, CASE WHEN rel IN ('PRE_MARKET', 'INTRADAY') THEN day ELSE (SELECT min(c.day) FROM cal c WHERE c.is_trading AND c.day > al1.day) END AS target FROM al1)"""


@query("evt_02", sql(NEWS, HOLIDAY, ALIGNED, "SELECT article_id, CAST(published_at AS VARCHAR) AS published_at, rel AS market_session_relation, CAST(target AS VARCHAR) AS target_observation_date FROM aligned"))
def evt_02(spark, sf):
    return E.align(V.news(spark, sf).select("article_id", "published_at"), calendar(spark))


FWD = "fw AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, {h} AS h, CASE WHEN count(log_return) OVER f{h} >= {h} THEN sum(log_return) OVER f{h} END AS ret, "
    + (f"CASE WHEN count(log_return) OVER f{h} >= {h} THEN stddev_samp(log_return) OVER f{h} END" if h > 1 else "CAST(NULL AS DOUBLE)")
    + f" AS vol FROM returns WINDOW f{h} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    for h in (1, 5, 20)
) + ")"
EVENTS = """ev AS (SELECT a.article_id, r.canonical_entity_id AS entity_id, a.published_at, a.rel, s.sentiment_label AS sentiment, m.topic, a.target, CAST(f.h AS VARCHAR) || 'd' AS horizon, f.ret, f.vol, b.ret AS bench, f.ret - b.ret AS abnormal
  FROM aligned a JOIN res r ON a.article_id = r.article_id AND r.canonical_entity_id IS NOT NULL LEFT JOIN sent s ON a.article_id = s.article_id LEFT JOIN main m ON a.article_id = m.article_id
  JOIN fw f ON f.symbol = r.canonical_entity_id AND f.ts = a.target AND f.ret IS NOT NULL LEFT JOIN fw b ON b.symbol = 'ECONOMY' AND b.ts = a.target AND b.h = f.h)"""
# Short texts carry no entities, topics or sentiment.
FOUND_OK = FOUND.replace("FROM news)", f"FROM news WHERE {LONG})")
TOPICS_OK = TOPICS.replace(" AS hits FROM news", f" AS hits FROM news WHERE {LONG}")
FEEL_OK = FEEL.replace("SELECT article_id, published_at, (", f"SELECT article_id, published_at, CASE WHEN {LONG} THEN 1 ELSE 0 END * ((", 1).replace(") AS d FROM news", ")) AS d FROM news", 1)
EVENT_CTES = (NEWS, FOUND_OK, RESOLVED, FEEL_OK, TOPICS_OK, HOLIDAY, ALIGNED, RETURNS, FWD, EVENTS)


def annotated(spark, sf):
    return T.annotate(V.news(spark, sf).withColumn("title", F.lit(None).cast("string")), TAXONOMY, POSITIVE, NEGATIVE)


def tickers(spark, seen):
    return T.resolve(T.match_words(seen, "article_id", "words", dictionary(spark)), "article_id", knowledge(spark), ["to"])


def main_topics(seen):
    return T.main_topic(T.scored_topics(seen, "article_id", "topic_hits"), "article_id")


def market_events(spark, sf, existing=None):
    """Texts are read once; the events come from the stored annotations."""
    seen = annotated(spark, sf)
    rows = E.article_rows(seen.select("article_id", "published_at"), tickers(spark, seen), seen)
    return E.build_events(rows, main_topics(seen), calendar(spark), V.returns(spark, sf), V.BENCHMARK, [1, 5, 20], existing)


@query(
    "evt_03",
    sql(
        *EVENT_CTES,
        f"""SELECT article_id, entity_id, CAST(published_at AS VARCHAR) AS published_at, rel AS market_session_relation, sentiment, topic, CAST(target AS VARCHAR) AS market_observation_start, horizon,
  {r('ret', 8)} AS future_return, {r('vol', 8)} AS future_volatility, {r('bench', 8)} AS benchmark_return, {r('abnormal', 8)} AS abnormal_return FROM ev WHERE NOT (article_id % 7 = 0 AND horizon = '5d')""",
    ),
)
def evt_03(spark, sf):
    """Events of one article in seven exist already for one horizon."""
    n = V.news(spark, sf).where("article_id % 7 = 0").select("article_id", F.lit("5d").alias("horizon"), F.explode(F.array(*[F.lit(s) for s in V.SYMBOLS])).alias("entity_id"))
    df = market_events(spark, sf, existing=n)
    cols = ["future_return", "future_volatility", "benchmark_return", "abnormal_return"]
    return df.select("article_id", "entity_id", "published_at", "market_session_relation", "sentiment", "topic", "market_observation_start", "horizon", *[rnd(c, 8).alias(c) for c in cols])


@query("join_09", sql(NEWS, FOUND_OK, RESOLVED, FEEL_OK, "SELECT n.article_id, CAST(n.published_at AS VARCHAR) AS published_at, r.canonical_entity_id AS entity_id, CASE WHEN n.article_id % 10 <> 0 THEN s.sentiment_label END AS sentiment_label FROM news n JOIN res r ON n.article_id = r.article_id AND r.canonical_entity_id IS NOT NULL LEFT JOIN sent s ON s.article_id = n.article_id"))
def join_09(spark, sf):
    seen = annotated(spark, sf)
    rows = E.article_rows(seen.select("article_id", "published_at"), tickers(spark, seen), seen.where("article_id % 10 <> 0"))
    return rows.select("article_id", "published_at", "entity_id", "sentiment_label")


@query("join_10", sql(NEWS, "SELECT article_id, CAST(published_at AS VARCHAR) AS published_at FROM news WHERE article_id % 3 <> 0"))
def join_10(spark, sf):
    """All articles without a result of this model version."""
    n = V.news(spark, sf).select("article_id", "published_at")
    done = n.where("article_id % 3 = 0").withColumn("model_version", F.lit("v1"))
    return J.unprocessed(n, done.where("model_version = 'v1'"), ["article_id"])


@query(
    "join_11",
    sql(
        NEWS,
        "h AS (SELECT article_id, url, sha256(lower(title)) AS hash FROM news)",
        "SELECT article_id, EXISTS (SELECT 1 FROM h h2 WHERE h2.hash = h.hash AND h2.article_id < 100) AS seen FROM h WHERE article_id >= 100",
    ),
)
def join_11(spark, sf):
    h = V.news(spark, sf).select("article_id", F.sha2(F.lower("title"), 256).alias("hash"))
    old, new = h.where("article_id < 100"), h.where("article_id >= 100")
    seen = new.join(old.select("hash").distinct(), "hash", "left_semi").withColumn("seen", F.lit(True))
    return seen.unionByName(J.unprocessed(new, old, ["hash"]).withColumn("seen", F.lit(False))).select("article_id", "seen")


@query("join_13", sql(NEWS, FEEL_OK, TOPICS_OK, "SELECT n.article_id, s.sentiment_label, m.topic FROM news n LEFT JOIN sent s USING (article_id) LEFT JOIN main m USING (article_id)"))
def join_13(spark, sf):
    seen = annotated(spark, sf)
    first = J.first_per_key(seen.select("article_id", "sentiment_label", "sentiment_score"), ["article_id"], [F.desc("sentiment_score")])
    return seen.select("article_id").join(first.drop("sentiment_score"), "article_id", "left").join(main_topics(seen), "article_id", "left")


REL1 = """pol AS (SELECT horizon, CASE sentiment WHEN 'POSITIVE' THEN 1.0::DOUBLE WHEN 'NEGATIVE' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, abnormal AS x FROM ev WHERE sentiment IS NOT NULL AND abnormal IS NOT NULL),
rel AS (SELECT horizon, count(*) AS n, corr(p, x) AS c FROM pol GROUP BY 1 HAVING count(*) >= 2)"""


@query("rel_01", sql(*EVENT_CTES, REL1, f"SELECT horizon, n AS sample_size, {r('c')} AS coefficient, {r(t_p('c * sqrt((n - 2) / (1 - c * c))', 'n - 2'))} AS p_value FROM rel"))
def rel_01(spark, sf):
    df = L.sentiment_relationship(market_events(spark, sf))
    return df.withColumns({"coefficient": rnd("coefficient"), "p_value": rnd("p_value")})


TOPIC_TEST = """tx AS (SELECT horizon, topic, abnormal AS x FROM ev WHERE topic IS NOT NULL AND abnormal IS NOT NULL),
tk AS (SELECT DISTINCT horizon, topic FROM tx),
tg AS (SELECT k.horizon, k.topic, count(*) FILTER (WHERE x.topic = k.topic) AS na, count(*) FILTER (WHERE x.topic <> k.topic) AS nb, avg(x) FILTER (WHERE x.topic = k.topic) AS ma, avg(x) FILTER (WHERE x.topic <> k.topic) AS mb,
  var_samp(x) FILTER (WHERE x.topic = k.topic) AS va, var_samp(x) FILTER (WHERE x.topic <> k.topic) AS vb FROM tk k JOIN tx x ON x.horizon = k.horizon GROUP BY 1, 2),
tw AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS dof FROM tg WHERE na >= 10 AND nb >= 10),
tp AS (SELECT *, """ + t_p("t", "dof") + " AS p FROM tw)"


@query("rel_02", sql(*EVENT_CTES, TOPIC_TEST, f"SELECT horizon, topic, na AS sample_size, {r('ma - mb')} AS coefficient, {r('t', 5)} AS t_stat, {r('p')} AS p_value FROM tp"))
def rel_02(spark, sf):
    df = L.topic_relationships(market_events(spark, sf))
    return df.withColumns({"coefficient": rnd("coefficient"), "t_stat": rnd("t_stat", 5), "p_value": rnd("p_value")})


FDR = """fd0 AS (SELECT *, p * count(*) OVER (PARTITION BY horizon) / row_number() OVER (PARTITION BY horizon ORDER BY p) AS adj FROM tp),
fdr AS (SELECT *, least(1, min(adj) OVER (PARTITION BY horizon ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM fd0)"""


@query("rel_03", sql(*EVENT_CTES, TOPIC_TEST, FDR, f"SELECT horizon, topic, {r('p')} AS p_value, {r('q')} AS adjusted_p_value FROM fdr"))
def rel_03(spark, sf):
    df = L.benjamini_hochberg(L.topic_relationships(market_events(spark, sf)), ["horizon"])
    return df.select("horizon", "topic", rnd("p_value").alias("p_value"), rnd("adjusted_p_value").alias("adjusted_p_value"))


@query(
    "rel_04",
    sql(
        *EVENT_CTES, TOPIC_TEST, FDR,
        """SELECT horizon, topic, CASE WHEN q > 0.05 THEN printf('presence of topic ''%s'': returns afterwards do not differ beyond chance (p=%.3f)', topic, q)
  ELSE printf('presence of topic ''%s'' goes together with returns afterwards: %s, %s (coefficient %.3f, p=%.3f). An observation, neither a cause nor a forecast.',
    CASE WHEN ma > mb THEN 'positive' ELSE 'negative' END, CASE WHEN abs(ma - mb) > 0.5 THEN 'strong' ELSE 'weak to moderate' END, topic, ma - mb, q) END AS finding FROM fdr""",
    ),
)
def rel_04(spark, sf):
    df = L.benjamini_hochberg(L.topic_relationships(market_events(spark, sf)), ["horizon"])
    name = F.concat(F.lit("presence of topic '"), "topic", F.lit("'"))
    return df.select("horizon", "topic", L.finding_text(name, F.col("adjusted_p_value"), F.col("coefficient")).alias("finding"))
