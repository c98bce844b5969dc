"""The views of sources/views.py as SQL common table expressions, for the comparison queries."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def _bars(name: str, symbol: str) -> str:
    px = "(1000.0::DOUBLE + l_extendedprice / l_quantity / 1000.0::DOUBLE)"
    return f"""{name}_raw AS (
  SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS ts,
         max({px}) AS high, min({px}) AS low,
         1000.0::DOUBLE + round(sum(l_extendedprice), 2) / sum(l_quantity) / 1000.0::DOUBLE AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
{name} AS (SELECT symbol, ts, (high + low) / 2 AS open, high, low, close, volume FROM {name}_raw)"""


MARKET = _bars("market_prices", "p_type")
UNIVERSE = _bars("universe_panel", "p_brand")
RETURNS = (
    MARKET
    + """,
returns AS (
  SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS daily_return,
         ln(close / nullif(lag(close) OVER w, 0)) AS log_return
  FROM market_prices WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
)
MACRO = """macro_monthly AS (
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date,
         round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) / nullif(count(CASE WHEN o_orderstatus <> 'P' THEN 1 END), 0) AS first_print, round(sum(o_totalprice), 2) / count(o_totalprice) AS revision
  FROM orders GROUP BY 1, 2),
macro_obs AS (
  SELECT series_id, observation_date, first_print AS value,
         CAST(last_day(observation_date) + 15 AS DATE) AS realtime_start FROM macro_monthly WHERE first_print IS NOT NULL
  UNION ALL
  SELECT series_id, observation_date, revision, CAST(last_day(observation_date) + 45 AS DATE) FROM macro_monthly)"""
FACTS = """filing_sums AS (
  SELECT c_nationkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
         round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev, round(sum(l_extendedprice * (1 + l_tax)), 4) AS assets,
         round(sum(l_extendedprice * l_discount), 4) AS disc, round(sum(l_extendedprice), 4) AS ext
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
filing_base AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik,
         lpad(CAST(c_nationkey AS VARCHAR), 10, '0') || CAST(year(q) AS VARCHAR) || CAST(quarter(q) AS VARCHAR) AS accession_number,
         CASE WHEN quarter(q) = 4 THEN '10-K' ELSE '10-Q' END AS form_type,
         CAST(q + INTERVAL 3 MONTH AS DATE) - 1 AS end_date, CAST(q + INTERVAL 3 MONTH AS DATE) + 39 AS filing_date,
         rev, assets, 5 * disc AS liab, assets - 5 * disc AS equity, rev - 0.6::DOUBLE * ext AS op
  FROM filing_sums),
filing_facts AS (
  SELECT cik, accession_number, form_type, filing_date, end_date, 'us-gaap:Revenues' AS concept, rev AS value FROM filing_base
  UNION ALL SELECT cik, accession_number, form_type, filing_date, end_date, 'us-gaap:Assets', assets FROM filing_base
  UNION ALL SELECT cik, accession_number, form_type, filing_date, end_date, 'us-gaap:Liabilities', liab FROM filing_base
  UNION ALL SELECT cik, accession_number, form_type, filing_date, end_date, 'us-gaap:StockholdersEquity', equity FROM filing_base
  UNION ALL SELECT cik, accession_number, form_type, filing_date, end_date, 'us-gaap:OperatingIncomeLoss', op FROM filing_base
  UNION ALL SELECT cik, accession_number, form_type, filing_date, end_date, 'us-gaap:NetIncomeLoss', 0.5::DOUBLE * op FROM filing_base)"""
NEWS = """news AS (
  SELECT doc_id AS article_id, text AS title, source AS url, source AS source_name, text AS content,
         o_orderdate + to_hours(CAST((doc_id * 7) % 24 AS INTEGER)) AS published_at
  FROM documents JOIN orders ON doc_id = o_orderkey)"""
SCORES = """scores AS (
  SELECT doc_id AS id, quality AS y, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p FROM labels)"""
PORTFOLIO = """portfolio(symbol, weight) AS (VALUES ('ECONOMY', 0.30::DOUBLE), ('LARGE', 0.25::DOUBLE), ('MEDIUM', 0.15::DOUBLE),
  ('PROMO', 0.10::DOUBLE), ('SMALL', 0.10::DOUBLE), ('STANDARD', 0.10::DOUBLE))"""
SCENARIOS = """scenarios(scenario, start_date, end_date) AS (VALUES
  ('spring_1996', DATE '1996-03-01', DATE '1996-06-30'), ('winter_1999', DATE '1999-01-01', DATE '1999-03-31'),
  ('outside_2005', DATE '2005-01-01', DATE '2005-02-01'))"""


def sql(*parts: str) -> str:
    """The last part is the SELECT; those before it are common table expressions."""
    *ctes, body = parts
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
