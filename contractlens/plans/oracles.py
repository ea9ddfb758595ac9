"""The same questions as plain SQL, for a second engine to answer."""

from __future__ import annotations

import re

from contractlens import values

# -- views over the given tables ----------------------------------------------

NUMBER = (
    "'GEMC-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
    " || '-' || strftime(l_shipdate, '%Y%m%d')"
)

LINES = """
lineitem JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
"""

FX = f"""
fx AS (
  SELECT {NUMBER} AS contract_number, n_name AS ministry, c_mktsegment AS department,
    c_name AS org_name, o_orderpriority AS buying_mode, o_orderdate AS contract_date,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    CASE WHEN l_returnflag = 'R' THEN 'service' ELSE 'goods' END AS contract_type,
    l_extendedprice AS total_value, l_quantity AS quantity,
    l_extendedprice / l_quantity AS unit_price, l_linestatus AS contract_status,
    p_name AS product_name, CASE WHEN p_size % 9 < 4 THEN NULL ELSE p_brand END AS brand
  FROM {LINES}
)
"""

JUNK_NAME = """
CASE p_size % 12 WHEN 0 THEN 'fepl-' || p_name WHEN 1 THEN 'Item ' || p_name
  WHEN 2 THEN 'TITLE' || p_name WHEN 3 THEN p_name || ' False' WHEN 4 THEN 'PBB'
  WHEN 5 THEN 'Items ' || p_name ELSE p_name END
"""

MONEY = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)"
COUNT = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"


def _date_text(day: str, clock: str) -> str:
    return f"day({day}) || '/' || month({day}) || '/' || year({day}) || ' ' || {clock}"


RAW = f"""
raw AS (
  SELECT {NUMBER} AS contract_number,
    CASE WHEN c_mktsegment = 'BUILDING' THEN ' Organization ' ELSE c_mktsegment END AS org_type,
    n_name AS ministry, c_name AS org_name, c_mktsegment AS department,
    CASE WHEN l_linenumber = 7 THEN ''
      WHEN l_linenumber = 2 AND l_linestatus = 'F' THEN '31/02/2026 09:30'
      ELSE {_date_text("o_orderdate", "lpad(CAST(l_linenumber + 7 AS VARCHAR), 2, '0') || ':30'")}
    END AS contract_date,
    CASE WHEN l_linenumber = 7 OR (l_linenumber = 2 AND l_linestatus = 'F') THEN NULL
      ELSE o_orderdate END AS d,
    l_linenumber + 7 AS h,
    CASE WHEN l_returnflag IN ('R', 'A') THEN NULL WHEN l_linenumber = 7 THEN 0.0
      ELSE l_extendedprice END AS total_value,
    {JUNK_NAME} AS product_name,
    CASE WHEN l_returnflag = 'R' THEN
        CASE l_linenumber WHEN 3 THEN 'lot' WHEN 4 THEN '0' ELSE {COUNT} END
      ELSE 'M' || l_suppkey END AS model,
    CASE l_returnflag
      WHEN 'R' THEN CASE l_linenumber WHEN 1 THEN '₹' || {MONEY} WHEN 2 THEN '₹ ' || {MONEY}
        ELSE '₹1,' || {MONEY} END
      WHEN 'A' THEN CASE l_linenumber WHEN 5 THEN {COUNT} || ' nos' WHEN 6 THEN '0'
        WHEN 7 THEN 'abc' ELSE {COUNT} END
      ELSE CASE l_linenumber WHEN 3 THEN '0' WHEN 4 THEN 'abc' WHEN 5 THEN '1,200'
        WHEN 6 THEN ' ₹5' ELSE {COUNT} END
    END AS quantity,
    l_extendedprice AS unit_price
  FROM {LINES}
)
"""

PREFIX = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'"


def _number_of(text: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(ltrim({text}), {PREFIX}), '') AS DOUBLE), 0)"


def _half_up(value: str, digits: int) -> str:
    """Round the shortest decimal form, ties away from zero."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,16)), {digits}) AS DOUBLE)"


def _clean(strip: bool = False) -> str:
    count = lambda c: _number_of(f"replace({c}, ',', '')" if strip else c)
    return f"""
{RAW},
parts AS (
  SELECT *, starts_with(quantity, '₹') AS is_service,
    total_value IS NULL AND unit_price IS NOT NULL
      AND regexp_matches(quantity, '^[0-9]') AS is_held,
    {_number_of("replace(replace(trim(quantity), '₹', ''), ',', '')")} AS s_total,
    CASE WHEN regexp_matches(model, '^[0-9]') THEN {count("model")} END AS s_count,
    CASE WHEN regexp_matches(quantity, '^[0-9]') AND {count("quantity")} > 0
      THEN {count("quantity")} END AS g_count
  FROM raw
),
cleaned AS (
  SELECT contract_number, product_name, ministry, org_name, department, model, contract_date,
    CASE WHEN lower(trim(org_type)) = 'organization' THEN 'Unknown' ELSE org_type END AS org_type,
    CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
    CASE WHEN d IS NOT NULL THEN CAST(h AS INTEGER) END AS hour,
    CASE WHEN is_service THEN 'service' ELSE 'goods' END AS contract_type,
    CASE WHEN is_service THEN s_total WHEN is_held THEN unit_price
      WHEN total_value > 0 THEN total_value END AS total_value,
    CASE WHEN is_service THEN s_count WHEN is_held OR total_value > 0 THEN g_count END AS quantity,
    CASE WHEN is_service THEN CASE WHEN s_count > 0 THEN s_total / s_count END
      WHEN is_held THEN unit_price / g_count
      WHEN total_value > 0
        THEN {_half_up("total_value / g_count", 4)}
    END AS unit_price,
    is_held
  FROM parts
)
"""


NOT_JUNK = " AND ".join(f"product_name NOT ILIKE '{p}'" for p in values.JUNK_PRODUCTS)


def _hhi(group: str) -> str:
    return f"""
WITH {FX},
v AS (SELECT {group}, brand, sum(total_value) AS v FROM fx
      WHERE {group} IS NOT NULL AND brand IS NOT NULL GROUP BY ALL),
s AS (SELECT {group}, v / nullif(sum(v) OVER (PARTITION BY {group}), 0) AS share FROM v)
SELECT {group}, round(coalesce(sum(share * share), 0) * 10000, 6) AS hhi FROM s GROUP BY {group}
"""


def _fences(source: str, product: str, price: str, k: float) -> str:
    log = f"ln(1 + greatest({price}, 0))"
    return f"""
fences AS (
  SELECT {product}, count({price}) AS peers, quantile_cont({log}, 0.25) AS q1,
    quantile_cont({log}, 0.75) AS q3, q3 + {k} * (q3 - q1) AS upper_fence
  FROM {source} WHERE {product} IS NOT NULL GROUP BY {product} HAVING count({price}) >= 5
)
"""


def _overpriced(k: float, columns: str) -> str:
    return f"""
WITH {FX}, {_fences("fx", "product_name", "unit_price", k)}
SELECT {columns}, coalesce(ln(1 + greatest(unit_price, 0)) > upper_fence, false) AS overpriced_flag
FROM fx LEFT JOIN fences USING (product_name)
"""


def _pairs(source: str, buyer: str, time: str, value: str, order: str, minutes: int, tol: float) -> str:
    w = f"(PARTITION BY {buyer} ORDER BY {time}, {order})"
    return f"""
lagged AS (
  SELECT *, lag({time}) OVER {w} AS pt, lag({value}) OVER {w} AS pv FROM {source}
),
paired AS (
  SELECT *, coalesce({buyer} IS NOT NULL
    AND epoch_us({time}) - epoch_us(pt) BETWEEN 0 AND {minutes * 60_000_000}
    AND abs({value} - pv) / nullif(pv, 0) < {tol}, false) AS pair
  FROM lagged
),
timed AS (
  SELECT *, pair OR coalesce(lead(pair) OVER {w}, false) AS timing_cluster_flag FROM paired
)
"""


def _timing(minutes: int, tol: float) -> str:
    pairs = _pairs("events", "user_id", "ts", "value", "event_id", minutes, tol)
    return f"WITH {pairs} SELECT event_id, user_id, timing_cluster_flag FROM timed"


SCORED = f"""
{_fences("events", "event_type", "value", 0.6)},
{_pairs("events", "user_id", "ts", "value", "event_id", 240, 0.1)},
flagged AS (
  SELECT timed.*, coalesce(ln(1 + greatest(value, 0)) > upper_fence, false) AS overpriced_flag
  FROM timed LEFT JOIN fences USING (event_type)
),
scored AS (
  SELECT *, CAST(overpriced_flag AS INTEGER) + CAST(timing_cluster_flag AS INTEGER) AS anomaly_score
  FROM flagged
)
"""


def _metrics(money: str) -> str:
    return f"""
SELECT count(*) AS contracts,
  round(CAST(sum(CAST({money} AS DECIMAL(18,2))) AS DOUBLE) / 10000000, 6) AS total_crore,
  count_if(overpriced_flag) AS price_flagged,
  round(avg(CAST(overpriced_flag AS DOUBLE)), 6) AS price_rate,
  count_if(timing_cluster_flag) AS timing_flagged,
  round(avg(CAST(timing_cluster_flag AS DOUBLE)), 6) AS timing_rate,
  count_if(anomaly_score > 0) AS flagged_any, count_if(anomaly_score = 2) AS flagged_both
FROM scored
"""


def _medians(source: str) -> str:
    return f"""
m AS (
  SELECT product_name, count(*) AS contract_count, avg(unit_price) AS avg_price,
    median(unit_price) AS median_price
  FROM {source}
  WHERE unit_price > 0 AND contract_type = 'goods' AND quantity > 1
    AND product_name IS NOT NULL
  GROUP BY product_name HAVING count(*) >= 10
)
"""


ANOMALY = f"""
  contract_number, ministry, department, product_name, quantity, total_value, year, month,
  buying_mode, contract_count, {_half_up("unit_price / median_price", 1)} AS price_ratio,
  {_half_up("(unit_price - median_price) / median_price * 100", 1)} AS pct_above_median
"""

# -- windows -------------------------------------------------------------------

VISITS = """
visits AS (
  SELECT CAST(o_orderdate AS DATE) AS day, 'GEMC-' || o_custkey AS number,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'results'
      WHEN o_orderstatus = 'O' THEN 'no_results' ELSE 'unknown' END AS outcome
  FROM orders
)
"""


def _notes(name: str, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT day AS from_date, day AS to_date,
    count(DISTINCT CASE WHEN outcome = 'results' THEN number END) AS contracts,
    count_if(outcome = 'results') AS rows,
    CASE WHEN count_if(outcome = 'results') > 0 THEN 'normal'
      WHEN count_if(outcome = 'no_results') > 0 THEN 'zero_confirmed'
      ELSE 'zero_assumed' END AS note
  FROM visits WHERE {where} GROUP BY day
)
"""


def _windows(step: int) -> str:
    return f"""
ends AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
w AS (
  SELECT CAST(s AS DATE) AS from_date, least(CAST(s AS DATE) + {step - 1}, b) AS to_date
  FROM (SELECT unnest(generate_series(a, b, INTERVAL {step} DAY)) AS s, b FROM ends)
)
"""


NOTES = f"{VISITS}, {_notes('notes')}"
PENDING = f"""
WITH {NOTES}, {_windows(1)}
SELECT from_date, to_date FROM w
WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.from_date = w.from_date
                  AND n.to_date = w.to_date AND n.from_date < DATE '1998-01-01')
"""

RECHECK = PENDING.replace("n.from_date < DATE '1998-01-01'", "n.note <> 'zero_assumed'")

CSV_SCORED = f"""WITH {FX}, {_fences("fx", "product_name", "unit_price", 3.0)},
            {_pairs("fx", "org_name", "contract_date", "total_value", "contract_number", 30, 0.02)},
            scored AS (
              SELECT *, CAST(overpriced_flag AS INTEGER) + CAST(timing_cluster_flag AS INTEGER)
                AS anomaly_score
              FROM (SELECT timed.*, coalesce(ln(1 + greatest(unit_price, 0)) > upper_fence, false)
                AS overpriced_flag FROM timed LEFT JOIN fences USING (product_name))
            )"""

# -- pages -----------------------------------------------------------------------

HAS_TABLE = "o_orderpriority <> '5-LOW'"
# each page has its block twice, with two product lines or none
PAGE_LEDGER = f"""
SELECT CAST(o_orderdate AS DATE) AS from_date, CAST(o_orderdate AS DATE) AS to_date,
  count_if(o_orderstatus <> 'P') AS contracts, CAST(sum(CASE WHEN {HAS_TABLE} THEN 4 ELSE 2 END) AS BIGINT) AS rows,
  'normal' AS note, count_if(o_orderstatus <> 'P') AS stored
FROM orders GROUP BY ALL
"""
CONTRACT = f"""
  'GEMC-' || o_orderkey AS contract_number, c_mktsegment AS org_type, n_name AS ministry,
  c_mktsegment AS department, c_name AS org_name, '' AS office_zone,
  o_orderpriority AS buying_mode, {_date_text("o_orderdate", "'09:30'")} AS contract_date,
  o_totalprice AS total_value, 'State ' || o_orderstatus AS contract_status
"""
FIRST_LINE = f"""
  CASE WHEN {HAS_TABLE} THEN 'Pens & ' || o_orderpriority ELSE '' END AS product_name,
  CASE WHEN {HAS_TABLE} THEN c_mktsegment ELSE '' END AS brand,
  CASE WHEN {HAS_TABLE} THEN 'M' || c_nationkey ELSE '' END AS model,
  CASE WHEN {HAS_TABLE} THEN '4' ELSE '' END AS quantity,
  CASE WHEN {HAS_TABLE} THEN o_totalprice END AS unit_price
"""
SPARE_LINE = "'Spare' AS product_name, '' AS brand, '' AS model, '' AS quantity, CAST(NULL AS DOUBLE) AS unit_price"
DETAILS = """
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
FIRST_LINES = f"SELECT {CONTRACT}, {FIRST_LINE} {DETAILS} WHERE o_orderstatus <> 'P'"


def _any_of(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _outcome(html: str) -> str:
    seen = rf"regexp_replace({html}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
    bare = rf"replace(regexp_replace({seen}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' ')"
    text = rf"lower(regexp_replace({bare}, '\s+', ' ', 'g'))"
    block = (
        r"""'(?i)\sclass\s*=\s*["''](?:[^"''>]*border[^"''>]*block|[^"''>]*block[^"''>]*border)'"""
    )
    return f"""CASE WHEN regexp_matches({seen}, {block}) THEN 'results'
  WHEN {_any_of(text, values.NO_RESULT_PHRASES)} THEN 'no_results'
  WHEN {_any_of(text, values.CAPTCHA_ERROR_PHRASES)} THEN 'captcha_error'
  ELSE 'unknown' END"""


NOTICE = """
html || CASE page_id % 3
  WHEN 0 THEN '<p>No&nbsp;<b>Records</b>' || chr(10) || ' Found</p>'
  WHEN 1 THEN '<p>Invalid CAPTCHA</p><script>no data found</script>'
  ELSE '<div class="border block"></div><p>no data found</p>' END
"""

# -- price text ---------------------------------------------------------------------

PRICE_TEXT = f"""
CASE l_linenumber WHEN 1 THEN '₹ 1,' || {MONEY} WHEN 2 THEN 'Rs. ' || {MONEY}
  WHEN 3 THEN {MONEY} || 'e5' WHEN 4 THEN '$' || chr(160) || {MONEY} WHEN 5 THEN '-'
  WHEN 6 THEN 'INR ' || {MONEY} ELSE {MONEY} END
"""
PREFIX_TEXT = f"""
CASE l_linenumber WHEN 1 THEN {COUNT} || 'abc' WHEN 2 THEN {COUNT} || ',200'
  WHEN 3 THEN {COUNT} || 'e3x' WHEN 4 THEN ' ' || {COUNT} WHEN 5 THEN ''
  WHEN 6 THEN '.' || {COUNT} ELSE {COUNT} || 'd' END
"""


def _price(text: str) -> str:
    return rf"try_cast(nullif(regexp_replace({text}, '[₹$,\s\x{{00A0}}]|[A-Za-z]', '', 'g'), '') AS DOUBLE)"


FIRST_OF = """
SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn FROM {source}
) WHERE rn = 1
"""
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
UNSEEN = """(SELECT * FROM lineitem n WHERE l_linestatus = 'O' AND NOT EXISTS
  (SELECT 1 FROM lineitem s WHERE s.l_linestatus = 'F' AND s.l_orderkey = n.l_orderkey))"""
DAY_FORMATS = ["%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", "%m/%d/%Y", "%d %b %Y", "%d %B %Y"]
DAY_TEXT = " ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in enumerate(DAY_FORMATS))


def oracle_sql() -> dict[str, str]:
    service = f"WITH {_clean()} SELECT"
    sql = {
        "hhi_by_group": _hhi("ministry"),
        "hhi_by_product": _hhi("product_name"),
        "hhi_top": f"{_hhi('ministry')} ORDER BY hhi DESC, ministry LIMIT 5",
        "hhi_missing_rate": f"""WITH {FX} SELECT count(*) AS rows,
            round(avg(CASE WHEN brand IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM fx""",
        "price_fences": f"""WITH {FX}, {_fences("fx", "product_name", "unit_price", 3.0)}
            SELECT product_name, peers, round(q1, 6) AS q1, round(q3, 6) AS q3,
              round(upper_fence, 6) AS upper_fence FROM fences""",
        "overpricing_flags": _overpriced(1.0, "contract_number, product_name"),
        "overpricing_default": _overpriced(3.0, "contract_number"),
        "timing_clusters": _timing(30, 0.02),
        "timing_clusters_wide": _timing(240, 0.1),
        "timing_clusters_contracts": f"""WITH {FX},
            {_pairs("fx", "ministry", "contract_date", "total_value", "contract_number", 30, 0.02)}
            SELECT contract_number, ministry, timing_cluster_flag FROM timed""",
        "anomaly_score": f"""WITH {SCORED}
            SELECT event_id, overpriced_flag, timing_cluster_flag, anomaly_score FROM scored""",
        "flagged_review": f"""WITH {SCORED}
            SELECT event_id, user_id, event_type, value, anomaly_score FROM scored
            WHERE anomaly_score > 0""",
        "run_metrics": f"WITH {SCORED} {_metrics('value')}",
        "clean_contracts": f"""WITH {_clean()}
            SELECT contract_number, org_type, contract_date, year, month, hour, contract_type,
              total_value, quantity, {_half_up("unit_price", 6)} AS unit_price, product_name,
              CASE WHEN contract_type = 'goods' THEN model END AS model
            FROM cleaned WHERE total_value > 0""",
        "classified_contracts": f"""WITH {_clean(strip=True)}
            SELECT contract_number, contract_type, total_value AS total_value_clean,
              quantity AS quantity_clean FROM cleaned""",
        "analysis_rows": f"""WITH {_clean()}
            SELECT contract_number, product_name, total_value FROM cleaned
            WHERE total_value > 0 AND {NOT_JUNK}""",
        "service_check": f"""{service} count(*) AS n, round(avg(quantity), 4) AS avg_quantity,
            round(avg(total_value), 4) AS avg_total FROM cleaned WHERE contract_type = 'service'""",
        "held_total_check": f"""{service} count(*) AS n, round(avg(total_value), 4) AS avg_total,
            round(avg(unit_price), 4) AS avg_unit_price FROM cleaned WHERE is_held""",
        "date_parts": f"""SELECT event_id, {_date_text("ts", "strftime(ts, '%H:%M')")} AS contract_date,
            CAST(year(ts) AS INTEGER) AS contract_year, CAST(month(ts) AS INTEGER) AS contract_month,
            CAST(hour(ts) AS INTEGER) AS contract_hour FROM events""",
        "date_formats": f"""SELECT event_id, CASE event_id % 6 {DAY_TEXT} END AS written,
            CASE WHEN event_id % 6 = 3 AND day(ts) <= 12 THEN make_date(year(ts), day(ts), month(ts))
              ELSE CAST(ts AS DATE) END AS day FROM events""",
        "org_type_fix": """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Unknown'
            ELSE c_mktsegment END AS org_type FROM customer""",
        "junk_product_filter": f"""SELECT * FROM (SELECT p_partkey, {JUNK_NAME} AS product_name FROM part)
            WHERE {NOT_JUNK}""",
        "price_clean": rf"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, written,
            {_price("written")} AS price,
            {_price(r"regexp_replace(written, '(?i)^\s*(?:rs|inr)\b\.?', '')")} AS strict_price
            FROM (SELECT *, {PRICE_TEXT} AS written FROM lineitem)""",
        "numeric_prefix": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, written,
            {_number_of("written")} AS number FROM (SELECT *, {PREFIX_TEXT} AS written FROM lineitem)""",
        "date_preview": f"""{service} contract_number, contract_date, year AS contract_year,
            month AS contract_month, hour AS contract_hour FROM cleaned
            ORDER BY contract_number LIMIT 5""",
        "unit_price_preview": f"""WITH {_clean()}
            SELECT contract_number, raw.quantity, raw.total_value, raw.unit_price AS old_unit_price,
              cleaned.unit_price AS real_unit_price
            FROM raw JOIN cleaned USING (contract_number)
            WHERE contract_type = 'goods' AND cleaned.unit_price IS NOT NULL
            ORDER BY contract_number LIMIT 10""",
        "type_coverage": f"""WITH {FX} SELECT contract_type, count(*) AS n,
            round(avg(total_value), 2) AS avg_val, round(avg(unit_price), 4) AS avg_unit_price
            FROM fx GROUP BY contract_type""",
        "product_benchmark": f"""WITH {FX}
            SELECT product_name, count(*) AS contracts, count(DISTINCT ministry) AS ministries,
              round(min(unit_price), 6) AS min_price, round(max(unit_price), 6) AS max_price,
              round(avg(unit_price), 6) AS avg_price,
              {_half_up("max(unit_price) / avg(unit_price)", 1)} AS max_vs_avg
            FROM fx WHERE contract_type = 'goods' AND quantity > 1
              AND unit_price BETWEEN 10 AND 500000
            GROUP BY product_name HAVING contracts >= 10 AND ministries >= 3
            ORDER BY max_vs_avg DESC, product_name LIMIT 50""",
        "average_outliers": f"""WITH {FX}
            SELECT contract_number, ministry, org_name, product_name, quantity,
              round(unit_price, 6) AS unit_price, total_value, contract_date, contract_status
            FROM fx WHERE unit_price > (SELECT avg(f.unit_price) * 5 FROM fx f
              WHERE f.product_name = fx.product_name)""",
        "average_outliers_named": f"""WITH {FX}
            SELECT contract_number, product_name, total_value FROM fx
            WHERE product_name IN ('hot bolt', 'blue ring', 'large ring')
              AND unit_price > (SELECT avg(f.unit_price) * 3 FROM fx f
                WHERE f.product_name = fx.product_name)""",
        "median_outliers": f"""WITH {FX}, {_medians("fx")}
            SELECT {ANOMALY}, round(median_price, 6) AS median_price, round(avg_price, 6) AS avg_price
            FROM fx JOIN m USING (product_name)
            WHERE unit_price > median_price * 5 AND quantity > 1""",
        "median_outliers_goods": f"""WITH {FX}, {_medians("fx")}
            SELECT {ANOMALY} FROM fx JOIN m USING (product_name)
            WHERE unit_price > median_price * 3 AND quantity > 1 AND contract_type = 'goods'""",
        "anomaly_impact": f"""WITH {FX}, {_medians("fx")}
            SELECT count(*) AS total_anomalies, count(DISTINCT ministry) AS ministries_involved,
              count(DISTINCT product_name) AS products_affected,
              CAST(sum(CAST(total_value AS DECIMAL(18,2))) AS DOUBLE) AS total_value_at_risk,
              round(sum(total_value - median_price * quantity), 2) AS estimated_overcharge
            FROM fx JOIN m USING (product_name)
            WHERE unit_price > median_price * 5 AND quantity > 1""",
        "analysis_chain": f"""WITH {_clean()},
            analysis AS (SELECT * FROM cleaned WHERE total_value > 0 AND {NOT_JUNK}),
            {_medians("analysis")}
            SELECT contract_number, product_name, total_value, contract_count,
              {_half_up("unit_price / median_price", 1)} AS price_ratio
            FROM analysis JOIN m USING (product_name)
            WHERE unit_price > median_price * 5 AND quantity > 1""",
        "catalog_anomalies": f"""WITH {FX}, {_medians("fx")}
            SELECT contract_number, product_name, total_value, year, month,
              {_half_up("unit_price / median_price", 1)} AS price_ratio
            FROM fx JOIN m USING (product_name)
            WHERE unit_price > median_price * 5 AND quantity > 1 AND year = 1996 AND month <= 6""",
        "sketched_prices": f"""WITH {FX} SELECT product_name, count(*) AS rows, count(DISTINCT org_name) AS buyers,
            true AS ranks_within_1_percent, true AS buyers_within_5_percent FROM fx GROUP BY product_name""",
        "top_ministries": f"""WITH {FX} SELECT ministry, count(*) AS n,
            CAST(sum(CAST(total_value AS DECIMAL(18,2))) AS DOUBLE) AS v
            FROM fx WHERE ministry <> '' GROUP BY ministry ORDER BY n DESC, ministry LIMIT 10""",
        "value_range": f"""WITH {FX} SELECT min(total_value) AS min_value,
            max(total_value) AS max_value, round(avg(total_value), 4) AS avg_value
            FROM fx WHERE total_value > 0""",
        "row_count": f"WITH {FX} SELECT count(*) AS n FROM fx",
        "dedup_first": FIRST_OF.format(columns=LINE, source="lineitem"),
        "new_contracts": FIRST_OF.format(columns=LINE, source=UNSEEN),
        "append_twice": FIRST_OF.format(
            columns=f"{LINE}, l_linestatus",
            source=f"(SELECT * FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT * FROM {UNSEEN})",
        ),
        "date_windows": f"""WITH {_windows(7)} SELECT strftime(from_date, '%d-%m-%Y') AS from_date,
            strftime(to_date, '%d-%m-%Y') AS to_date FROM w""",
        "window_note": f"WITH {NOTES} SELECT * FROM notes",
        "pending_windows": PENDING,
        "recheck_windows": RECHECK,
        "ledger_migrated": f"""WITH {NOTES}, {_windows(1)}
            SELECT count(*) AS windows_total, count(note) AS windows_done,
              count(*) - count(note) AS windows_pending, CAST(0 AS BIGINT) AS zero_assumed
            FROM w LEFT JOIN notes USING (from_date, to_date)""",
        "next_windows": f"{PENDING} ORDER BY from_date LIMIT 10",
        "ledger_latest": f"""WITH {NOTES}, {_notes("again", "outcome <> 'results'")}
            SELECT * FROM again UNION ALL
            SELECT * FROM notes WHERE from_date NOT IN (SELECT from_date FROM again)""",
        "ledger_summary": f"""WITH {NOTES} SELECT count(*) AS windows_done,
            CAST(coalesce(sum(contracts), 0) AS BIGINT) AS contracts FROM notes""",
        "review_windows": f"""WITH {NOTES} SELECT from_date, to_date FROM notes
            WHERE note = 'zero_assumed'""",
        "window_coverage": f"""WITH {NOTES}, {_windows(1)}
            SELECT count(*) AS windows_total, count(note) AS windows_done,
              count(*) - count(note) AS windows_pending,
              count_if(note = 'zero_assumed') AS zero_assumed
            FROM w LEFT JOIN notes USING (from_date, to_date)""",
        "ingest_rate": f"""WITH {NOTES}, {_windows(1)},
            d AS (SELECT CAST(sum(rows) AS BIGINT) AS rows, count(*) AS windows_done,
              greatest(epoch(max(from_date)) - epoch(min(from_date)), 1) AS sec FROM notes)
            SELECT rows, windows_done, (SELECT count(*) FROM w) AS windows_total,
              round(rows / sec * 60, 6) AS rows_per_minute, round(sec / 60, 6) AS elapsed_minutes
            FROM d""",
        "extract_contracts": FIRST_LINES,
        "extract_lines": f"""SELECT 0 AS line_no, * FROM ({FIRST_LINES}) UNION ALL
            SELECT 1 AS line_no, {CONTRACT}, {SPARE_LINE} {DETAILS}
            WHERE o_orderstatus <> 'P' AND {HAS_TABLE}""",
        "extract_rejects": f"""SELECT o_orderkey AS page_id, CAST(b AS INTEGER) AS block_no,
              CAST(n AS INTEGER) AS line_no, 'no contract number' AS reason
            FROM orders, range(2) AS x(b), range(2) AS y(n)
            WHERE o_orderstatus = 'P' AND (n = 0 OR {HAS_TABLE})""",
        "page_outcome": """SELECT page_id, 'unknown' AS outcome,
            CASE page_id % 3 WHEN 0 THEN 'no_results' WHEN 1 THEN 'captcha_error' ELSE 'results' END
              AS outcome_with_notice
            FROM pages""",
        "stream_ingest": FIRST_LINES,
        "stream_ledger": f"SELECT from_date, to_date, contracts, rows, note FROM ({PAGE_LEDGER})",
        "stream_resume": PAGE_LEDGER,
        "stream_rate": f"""SELECT CAST(4 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS pages,
            CAST(sum(CASE WHEN {HAS_TABLE} THEN 4 ELSE 2 END) AS BIGINT) AS lines,
            count_if(o_orderstatus <> 'P') AS rows_added, count_if(o_orderstatus <> 'P') AS rows_stored,
            CAST(0 AS BIGINT) AS batches_that_differ FROM orders""",
        "stream_dedup": "SELECT DISTINCT user_id || ':' || event_type AS seen FROM events",
        "quantity_split": f"""WITH {FX},
            near AS (SELECT *, count(*) OVER w AS c, sum(CAST(total_value AS DECIMAL(18,2))) OVER w AS s
              FROM fx WHERE total_value >= 40000 AND total_value < 50000
              WINDOW w AS (PARTITION BY ministry, product_name ORDER BY contract_date
                RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)),
            hits AS (SELECT ministry, product_name, contract_date FROM near WHERE c >= 3 AND s >= 50000),
            flagged AS (SELECT n.contract_number, n.c, n.s, EXISTS (SELECT 1 FROM hits h
                WHERE h.ministry = n.ministry AND h.product_name = n.product_name
                  AND h.contract_date BETWEEN n.contract_date AND n.contract_date + INTERVAL 7 DAY) AS flag
              FROM near n)
            SELECT contract_number, coalesce(c, 0) AS split_count,
              round(CAST(coalesce(s, 0) AS DOUBLE), 2) AS split_total, coalesce(flag, false) AS split_flag
            FROM fx LEFT JOIN flagged USING (contract_number)""",
        "timing_range_pairs": """WITH pairs AS (
              SELECT a.event_id AS e, b.event_id AS l, a.ts AS et, b.ts AS lt FROM events a JOIN events b
                ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id))
                AND epoch_us(b.ts) - epoch_us(a.ts) <= 14400000000 AND a.value > 0 AND b.value > 0
                AND abs(b.value - a.value) / a.value < 0.1),
            later AS (SELECT e AS event_id, count(*) AS n, arg_min(l, (lt, l)) AS p FROM pairs GROUP BY e),
            earlier AS (SELECT l AS event_id, count(*) AS n, arg_max(e, (et, e)) AS p FROM pairs GROUP BY l)
            SELECT event_id, coalesce(later.n, 0) AS later_matches, coalesce(earlier.n, 0) AS earlier_matches,
              coalesce(later.p, earlier.p) AS partner
            FROM events LEFT JOIN later USING (event_id) LEFT JOIN earlier USING (event_id)""",
        "stream_timing": _timing(30, 0.02),
        "missing_brand_by_type": f"""WITH {FX} SELECT contract_type, count(*) AS rows,
            round(avg(CASE WHEN brand IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM fx GROUP BY contract_type""",
        "csv_scan": f"""WITH {FX} SELECT contract_number, ministry, brand, product_name,
            total_value, contract_status || chr(10) || '"held", later' AS contract_status,
            CAST(contract_date AS DATE) AS contract_date FROM fx""",
        "csv_problems": f"""WITH {FX} SELECT CAST(0 AS BIGINT) AS total_value, CAST(0 AS BIGINT) AS unit_price,
            count_if(quantity = 50) AS quantity, CAST(0 AS BIGINT) AS contract_date FROM fx""",
        "csv_to_hhi": _hhi("ministry"),
        "hhi_file": _hhi("ministry"),
        "run_report": f"""WITH m AS ({CSV_SCORED} {_metrics("total_value")}),
            h AS (SELECT ministry, hhi FROM ({_hhi("ministry")}) ORDER BY hhi DESC, ministry LIMIT 5),
            gaps AS (WITH {FX} SELECT avg(CASE WHEN brand IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS missing FROM fx)
            SELECT format('{{:,}} contracts, {{:,.0f}} Cr total value', contracts, total_crore) || chr(10)
              || format('price outliers: {{:,}} ({{:.2f}}%)', price_flagged, price_rate * 100) || chr(10)
              || format('timing clusters: {{:,}} ({{:.2f}}%)', timing_flagged, timing_rate * 100) || chr(10)
              || format('by at least one: {{:,}}', flagged_any) || chr(10)
              || format('by both: {{:,}}', flagged_both) || chr(10)
              || format('without entity: {{:.1f}}%', missing) || chr(10)
              || 'most concentrated:' || chr(10)
              || (SELECT string_agg(format('{{}}: {{:,.0f}}', ministry, hhi), chr(10) ORDER BY hhi DESC, ministry) FROM h) AS report
            FROM m, gaps""",
        "csv_to_metrics": f"""{CSV_SCORED} {_metrics("total_value")}""",
        "flagged_file": f"""{CSV_SCORED} SELECT contract_number,
            contract_status || chr(10) || '"held", later' AS contract_status, anomaly_score
            FROM scored WHERE anomaly_score > 0""",
    }
    return {name: re.sub(r"\n\s*\n", "\n", text).strip() for name, text in sql.items()}
