"""DuckDB SQL that gives the rows of the queries of the same names, written apart from the Spark code."""

from __future__ import annotations

# Two phrases that a block notice holds together.
_NOTICE = ("доступ к сайту", "запрещ")

_E = """
now AS (SELECT max(ts) AS now FROM events),
ph AS (SELECT user_id AS product_id, CAST(value AS DECIMAL(12,2)) AS price, ts, event_id AS tie,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_actual FROM events),
product AS (SELECT c_custkey AS product_id, c_name AS name, c_mktsegment AS category, c_acctbal >= 0 AS is_active FROM customer),
active AS (SELECT * FROM product WHERE is_active),
cats AS (SELECT category AS kind, category <> 'MACHINERY' AS open FROM product GROUP BY category),
rates AS (SELECT currency, date, CAST(CAST(sum(v) AS DOUBLE) / count(v) AS DECIMAL(10,4)) AS rate FROM (
  SELECT CASE event_type WHEN 'purchase' THEN 'USD' WHEN 'view' THEN 'EUR' WHEN 'click' THEN 'CNY' END AS currency,
    CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(12,2)) AS v FROM events) WHERE currency IS NOT NULL GROUP BY currency, date)
"""
_L = """
now AS (SELECT max(l_shipdate) AS now FROM lineitem),
ph AS (SELECT l_partkey AS product_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS tie,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 8 + l_linenumber DESC) = 1 AS is_actual FROM lineitem),
product AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS category, p_size > 5 AS is_active FROM part),
active AS (SELECT * FROM product WHERE is_active),
subs AS (SELECT user_id, product_id, CAST(p_retailprice * 25 AS DECIMAL(12,2)) AS target_price, (user_id + product_id) % 7 <> 0 AS is_active FROM (
  SELECT DISTINCT o_custkey AS user_id, l_partkey AS product_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN part ON product_id = p_partkey)
"""
_SERIES = """
s AS (SELECT product_id, ts, CAST(price AS DOUBLE) AS p, 15 - rn - (14 - least(n, 14)) AS i, least(n, 14) AS n FROM (
  SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM ph) WHERE rn <= 14)
"""  # i runs from 1 (oldest) to n
_SPIKE = """
sp AS (SELECT product_id, ts, before AS previous, p AS current, abs(p - before) / before AS change, before_ts FROM (
  SELECT *, lag(p) OVER w AS before, lag(ts) OVER w AS before_ts FROM s WINDOW w AS (PARTITION BY product_id ORDER BY i))
  WHERE i = n AND n >= 3 AND before <> 0 AND abs(p - before) / before > 0.10)
"""
_MANIP = """
mp AS (SELECT product_id, ts3 AS ts, p AS base, greatest(p1, p2) AS peak, p3 AS after, i - 1 AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY i) AS first FROM (
    SELECT *, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2, lead(p, 3) OVER w AS p3, lead(ts, 3) OVER w AS ts3 FROM s
    WINDOW w AS (PARTITION BY product_id ORDER BY i))
  WHERE p3 IS NOT NULL AND p <> 0 AND (greatest(p1, p2) - p) / p >= 0.10 AND p3 < p) WHERE first = 1)
"""
_CYCLE = """
ends AS (SELECT product_id, max(n) AS n, max(CASE WHEN i = 1 THEN p END) AS a, max(CASE WHEN i = n THEN p END) AS b, max(ts) AS ts,
  date_diff('microsecond', min(ts), max(ts)) AS span FROM s GROUP BY product_id),
det AS (SELECT s.product_id, i - 1 AS t, e.n, p - (a + (b - a) * (i - 1) / (e.n - 1)) AS x FROM s JOIN ends e ON s.product_id = e.product_id WHERE e.n >= 6),
ok AS (SELECT product_id FROM det GROUP BY product_id HAVING stddev_pop(x) >= 1.0),
amp AS (SELECT product_id, k, sqrt(power(sum(x * cos(2 * pi() * k * t / n)), 2) + power(sum(x * sin(2 * pi() * k * t / n)), 2)) AS amp
  FROM det JOIN (SELECT unnest(range(1, 8)) AS k) ON k <= n // 2 WHERE product_id IN (SELECT product_id FROM ok) GROUP BY product_id, k),
cy AS (SELECT c.product_id, e.ts, top / total AS ratio, CAST(e.n AS DOUBLE) / k AS period_rows, e.span / 86400000000.0 / k AS period_days FROM (
  SELECT product_id, arg_max(k, amp) AS k, max(amp) AS top, sum(amp) AS total FROM amp GROUP BY product_id) c JOIN ends e ON c.product_id = e.product_id
  WHERE total >= 1e-6 AND top / total > 0.3)
"""
_FULL = f"""{_E}, {_SERIES}, {_SPIKE}, {_MANIP}, {_CYCLE},
an AS (
  SELECT product_id, 'spike' AS anomaly_type, CASE WHEN change > 0.30 THEN 'high' ELSE 'medium' END AS severity, ts, change AS metric FROM sp
  UNION ALL SELECT product_id, 'manipulation', 'high', ts, (peak - base) / base FROM mp
  UNION ALL SELECT product_id, 'cyclic', 'low', ts, ratio FROM cy)
"""


def _deals(days: int, limit: int) -> str:
    return f"""
SELECT * FROM (
  SELECT g.product_id, name, category, current_price, min_price, round(avg, 2) AS avg_price,
    round((avg - CAST(current_price AS DOUBLE)) / avg * 100, 1) AS discount_pct, current_price <= min_price AS at_min
  FROM (SELECT product_id, max(CASE WHEN is_actual THEN price END) AS current_price,
      min(CASE WHEN ts >= now - INTERVAL {days} DAY THEN price END) AS min_price,
      CAST(sum(CASE WHEN ts >= now - INTERVAL {days} DAY THEN price END) AS DOUBLE) / nullif(count(CASE WHEN ts >= now - INTERVAL {days} DAY THEN price END), 0) AS avg
    FROM ph, now GROUP BY product_id) g JOIN active p ON p.product_id = g.product_id
  WHERE min_price <> 0 AND avg <> 0)
ORDER BY discount_pct DESC, product_id LIMIT {limit}"""


def _index(of: str) -> str:
    return f"""
SELECT category, count(c) AS product_count, round(CAST(sum(c) AS DOUBLE) / count(c), 4) AS mean_price, round(median(CAST(c AS DOUBLE)), 4) AS median_price,
  round(CAST(sum(v) AS DOUBLE) / nullif(count(v), 0), 4) AS prev_mean, round(median(CAST(v AS DOUBLE)), 4) AS prev_median,
  round((CAST(sum(c) AS DOUBLE) / count(c) - CAST(sum(v) AS DOUBLE) / nullif(count(v), 0)) / nullif(CAST(sum(v) AS DOUBLE) / nullif(count(v), 0), 0) * 100, 4) AS mean_change_pct,
  round((median(CAST(c AS DOUBLE)) - median(CAST(v AS DOUBLE))) / nullif(median(CAST(v AS DOUBLE)), 0) * 100, 4) AS median_change_pct
FROM (SELECT category, CASE WHEN is_actual THEN price END AS c,
    CASE WHEN ts >= now - INTERVAL 14 DAY AND ts < now - INTERVAL 7 DAY THEN price END AS v
  FROM ph JOIN product ON ph.product_id = product.product_id{of}, now) GROUP BY category HAVING count(c) > 0"""


_INDEX = _index(" JOIN cats ON kind = category AND open")

_HEAT = """
chosen AS (SELECT product_id, name FROM active ORDER BY name, product_id LIMIT 30),
daily AS (SELECT ph.product_id, CAST(ts AS DATE) AS date, arg_max(CAST(price AS DOUBLE), (ts, tie)) AS price FROM ph JOIN chosen ON ph.product_id = chosen.product_id, now
  WHERE ts >= now - INTERVAL 7 DAY GROUP BY ph.product_id, CAST(ts AS DATE)),
grid AS (SELECT DISTINCT c.product_id, name, CAST(CAST(now AS DATE) - k AS DATE) AS date FROM chosen c JOIN daily ON daily.product_id = c.product_id, now, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS k)),
f AS (SELECT g.product_id, name, g.date, price, last_value(price IGNORE NULLS) OVER (PARTITION BY g.product_id ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM grid g LEFT JOIN daily d ON g.product_id = d.product_id AND g.date = d.date),
c AS (SELECT *, CASE WHEN price IS NOT NULL AND prev > 0 THEN (price - prev) / prev * 100 END AS change FROM f)
SELECT product_id, name, date, price, round(change, 4) AS change_pct,
  CASE WHEN change IS NULL THEN 'none' WHEN change > 5 THEN 'up2' WHEN change > 0.5 THEN 'up1' WHEN change < -5 THEN 'down2' WHEN change < -0.5 THEN 'down1' ELSE 'flat' END AS indicator FROM c"""


def _sens(currency: str, among: str = "product_id IN (SELECT product_id FROM active) AND ") -> str:
    return f"""
daily AS (SELECT product_id, CAST(ts AS DATE) AS date, arg_max(CAST(price AS DOUBLE), (ts, tie)) AS p, count(*) AS n FROM ph GROUP BY product_id, CAST(ts AS DATE)),
g AS (SELECT product_id, covar_pop(p, r) / nullif(stddev_pop(p) * stddev_pop(r), 0) AS correlation, count(*) AS sample_size FROM daily JOIN (
    SELECT date, CAST(rate AS DOUBLE) AS r FROM rates WHERE currency = '{currency}') fx ON daily.date = fx.date
  WHERE {among}product_id IN (SELECT product_id FROM daily GROUP BY product_id HAVING sum(n) >= 5) GROUP BY product_id HAVING count(*) >= 5)
"""


_URL = "'https://shop.example.com/' || CAST(p_partkey AS VARCHAR)"
_FC = "SELECT c_custkey AS product_id, DATE '2024-02-01' AS forecast_date, CAST(c_acctbal AS DECIMAL(12,2)) AS predicted_price, 'ARIMA' AS method FROM customer"
_CHANGES = """
c AS (SELECT user_id AS product_id, CAST(floor(value / 10) * 10 AS BIGINT) AS price, event_id AS arrival,
  lag(CAST(floor(value / 10) * 10 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
k AS (SELECT * FROM c WHERE before IS NULL OR before <> price)
"""
_SLUG = "lower(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'))"



def _seeds_sql(update: bool) -> str:
    taken, action = ("lower(r_name) || 's'", "updated") if update else ("r_name", "skipped")
    return f"""SELECT 'r-' || r_regionkey AS slug, {taken} AS name, '{"c" if update else "a"}' AS source_path, '{action}' AS action FROM region
UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment, 'b', 'kept' FROM customer UNION ALL SELECT 'n-' || n_nationkey, n_name, 'd/e', 'created' FROM nation"""


_HINT = """
o AS (SELECT ph.product_id, ph.ts, tie, CAST(price AS DOUBLE) AS p, sp.ts AS seen, change, row_number() OVER (PARTITION BY ph.product_id ORDER BY ph.ts DESC, tie DESC) AS k
  FROM ph JOIN sp ON ph.product_id = sp.product_id WHERE ph.ts < sp.ts - INTERVAL 14 DAY),
b AS (SELECT *, lag(p) OVER (PARTITION BY product_id ORDER BY ts, tie) AS before FROM o WHERE k <= 60),
h AS (SELECT product_id, ts AS past_ts, abs(p - before) / before AS step, CAST(CAST(seen AS DATE) - CAST(ts AS DATE) AS INTEGER) AS days_ago,
  row_number() OVER (PARTITION BY product_id ORDER BY ts, tie) AS first FROM b WHERE before <> 0 AND abs(p - before) / before >= 0.7 * change)
"""

ORACLES: dict[str, str] = {
    "active_products": f"WITH {_E} SELECT product_id, name, category FROM active",
    "by_category": f"WITH {_L} SELECT product_id, name, category FROM active WHERE category = 'Brand#13'",
    "name_search": f"WITH {_E} SELECT product_id, name FROM product WHERE contains(lower(name), 'r#00000001') ORDER BY product_id LIMIT 5",
    "latest_price": f"WITH {_L} SELECT product_id, price, ts FROM ph WHERE is_actual",
    "price_history": f"""WITH {_E}, r AS (SELECT *, lag(price) OVER (ORDER BY ts, tie) AS prev FROM ph WHERE product_id = 7 AND rn <= 30)
SELECT r.product_id, name, ts, price, CAST(price - prev AS DECIMAL(13,2)) AS delta, round(CAST(price - prev AS DOUBLE) / nullif(CAST(prev AS DOUBLE), 0) * 100, 4) AS delta_pct
FROM r JOIN product p ON p.product_id = r.product_id""",
    "product_change_log": f"""WITH {_CHANGES} SELECT product_id, price, arrival, row_number() OVER (PARTITION BY product_id ORDER BY arrival DESC) = 1 AS is_actual,
  CAST(nullif(before, 0) AS DOUBLE) AS old_price FROM k""",
    "best_deals": f"WITH {_E} {_deals(30, 20)}",
    "best_deals_lineitem": f"WITH {_L} {_deals(365, 50)}",
    "category_index": f"WITH {_E} {_index('')}",
    "heatmap": f"WITH {_E}, {_HEAT}",
    "ingest_metrics": f"""WITH {_E}, w AS (SELECT ph.* FROM ph, now WHERE ts >= now - INTERVAL 7 DAY)
SELECT (SELECT count(*) FROM w) AS total_records, (SELECT count(DISTINCT product_id) FROM w) AS unique_products, (SELECT min(ts) FROM w) AS first_ts,
  (SELECT max(ts) FROM w) AS last_ts, (SELECT count(*) FROM active) AS total_products, (SELECT count(*) FROM cats WHERE open) AS active_categories,
  (SELECT count(*) FROM active WHERE product_id NOT IN (SELECT product_id FROM ph)) AS products_without_data,
  coalesce(round(CAST((SELECT count(*) FROM w) AS DOUBLE) / nullif((SELECT count(DISTINCT product_id) FROM w), 0), 1), 0.0) AS avg_records_per_product""",
    "products_without_data": f"WITH {_E} SELECT product_id, category FROM product WHERE product_id NOT IN (SELECT product_id FROM ph)",
    "compare_products": f"""WITH {_E}, fc AS ({_FC}), ask AS (SELECT * FROM (VALUES (0, 2), (1, 2), (2, 999999999), (3, 5), (4, 1), (5, 14)) v(position, product_id)),
g AS (SELECT product_id, max(CASE WHEN is_actual THEN price END) AS current_price, min(price) FILTER (WHERE inside) AS min_price, max(price) FILTER (WHERE inside) AS max_price,
    CAST(sum(price) FILTER (WHERE inside) AS DOUBLE) / nullif(count(*) FILTER (WHERE inside), 0) AS avg, count(*) FILTER (WHERE inside) AS n,
    arg_min(CAST(price AS DOUBLE), (ts, tie)) FILTER (WHERE inside) AS first, arg_max(CAST(price AS DOUBLE), (ts, tie)) FILTER (WHERE inside) AS last
  FROM (SELECT ph.*, ts >= now - INTERVAL 30 DAY AS inside FROM ph, now) GROUP BY product_id)
SELECT CAST(position AS INTEGER) AS position, CAST(ask.product_id AS BIGINT) AS product_id, name, category, current_price, min_price, max_price, CASE WHEN avg <> 0 THEN round(avg, 4) END AS avg_price,
  CASE WHEN n >= 2 AND first > 0 THEN round((last - first) / first * 100, 1) END AS trend_pct, coalesce(n, 0) AS n_records, predicted_price AS forecast_price,
  CASE WHEN predicted_price <> 0 AND current_price <> 0 THEN CASE WHEN predicted_price > current_price THEN 'up' WHEN predicted_price < current_price THEN 'down' ELSE 'flat' END END AS direction
FROM ask JOIN product p ON p.product_id = ask.product_id LEFT JOIN g ON g.product_id = ask.product_id LEFT JOIN fc ON fc.product_id = ask.product_id""",
    "spike": f"""WITH {_E}, {_SERIES}, {_SPIKE} SELECT product_id, CASE WHEN change > 0.30 THEN 'high' ELSE 'medium' END AS severity, ts, previous, current,
  round(change, 6) AS change, CASE WHEN current > previous THEN 'up' ELSE 'down' END AS direction, round(date_diff('microsecond', before_ts, ts) / 86400000000.0, 6) AS days FROM sp""",
    "past_similar_spike": f"""WITH {_E}, {_SERIES}, {_SPIKE},
o AS (SELECT ph.product_id, ph.ts, tie, CAST(price AS DOUBLE) AS p, sp.ts AS seen, change, row_number() OVER (PARTITION BY ph.product_id ORDER BY ph.ts DESC, tie DESC) AS k
  FROM ph JOIN sp ON ph.product_id = sp.product_id WHERE ph.ts < sp.ts - INTERVAL 14 DAY),
b AS (SELECT *, lag(p) OVER (PARTITION BY product_id ORDER BY ts, tie) AS before FROM o WHERE k <= 60),
h AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts, tie) AS first FROM b WHERE before <> 0 AND abs(p - before) / before >= 0.7 * change)
SELECT product_id, round(change, 6) AS change, ts AS past_ts, round(abs(p - before) / before, 6) AS past_change, CAST(CAST(seen AS DATE) - CAST(ts AS DATE) AS INTEGER) AS days_ago FROM h WHERE first = 1""",
    "spike_messages": f"""WITH {_E}, {_SERIES}, {_SPIKE}, {_HINT}
SELECT sp.product_id, 'Sharp ' || CASE WHEN current > previous THEN 'rise' ELSE 'fall' END || ' of ' || printf('%.1f', change * 100) || '% in '
  || printf('%.1f', date_diff('microsecond', before_ts, sp.ts) / 86400000000.0) || ' days: ' || printf('%.0f', previous) || ' (' || strftime(before_ts, '%d.%m.%Y') || ') -> '
  || printf('%.0f', current) || ' (' || strftime(sp.ts, '%d.%m.%Y') || ')'
  || coalesce('. A change of ' || printf('%.1f', step * 100) || '% like it came on ' || strftime(past_ts, '%d.%m.%Y') || ' (' || days_ago || ' days before)', '') AS message
FROM sp LEFT JOIN h ON sp.product_id = h.product_id AND h.first = 1""",
    "manipulation": f"WITH {_E}, {_SERIES}, {_MANIP} SELECT product_id, 'high' AS severity, ts, base, peak, after, CAST(position AS INTEGER) AS position FROM mp",
    "cyclic": f"""WITH {_E}, {_SERIES}, {_CYCLE} SELECT product_id, 'low' AS severity, ts, round(ratio, 6) AS ratio, round(period_rows, 6) AS period_rows,
  round(period_days, 6) AS period_days FROM cy""",
    "full_detection": f"WITH {_FULL} SELECT product_id, anomaly_type, severity, ts, round(metric, 6) AS metric, now AS detected_at, false AS resolved FROM an, now",
    "anomaly_dedup": f"""WITH {_FULL} SELECT product_id, anomaly_type, severity, ts FROM an
WHERE NOT (product_id % 2 = 1 AND product_id % 3 <> 0)""",
    "anomaly_report": f"""WITH {_FULL} SELECT an.product_id, name, category, anomaly_type, severity, ts AS detected_at, false AS resolved
FROM an JOIN product p ON p.product_id = an.product_id, now WHERE ts >= now - INTERVAL 1 DAY""",
    "anomaly_summary": f"""WITH {_FULL}, r AS (SELECT an.* FROM an, now WHERE ts >= now - INTERVAL 7 DAY)
SELECT 'severity' AS kind, severity AS label, count(*) AS n FROM r GROUP BY severity UNION ALL SELECT 'type', anomaly_type, count(*) FROM r GROUP BY anomaly_type""",
    "anomaly_report_lines": f"""WITH {_FULL} SELECT strftime(ts, '%Y-%m-%d %H:%M') || ' [' || upper(severity) || '] ' || anomaly_type || ' ' || name || ' (' || category || ')' AS value
FROM an JOIN product p ON p.product_id = an.product_id, now WHERE ts >= now - INTERVAL 1 DAY AND severity = 'high'""",
    "report_text": f"""WITH {_FULL}, names AS (SELECT * FROM (VALUES ('spike', 'sharp change'), ('manipulation', 'rise before a discount'), ('cyclic', 'cyclic change')) v(code, label)),
r AS (SELECT an.*, name, category, label FROM an JOIN product p ON p.product_id = an.product_id JOIN names ON code = anomaly_type, now WHERE ts >= now - INTERVAL 1 DAY)
SELECT chr(10) || '[' || upper(severity) || '] ' || label || chr(10) || '  Product: ' || name || ' (id=' || product_id || ')' || chr(10) || '  Category: ' || category || chr(10) || '  Date: '
  || strftime(ts, '%Y-%m-%d %H:%M') || chr(10) || '  Status: active' || chr(10) || '  Description: change ' || printf('%.1f', metric * 100) || '%' AS value FROM r
UNION ALL SELECT 'Anomaly report (' || count(*) || ')' FROM r UNION ALL SELECT repeat('=', 60) UNION ALL SELECT chr(10) || repeat('=', 60) UNION ALL SELECT 'Summary:'
UNION ALL SELECT '  By type: ' || string_agg(label || ': ' || n, ', ' ORDER BY label) FROM (SELECT label, count(*) AS n FROM r GROUP BY label)
UNION ALL SELECT '  By severity: ' || string_agg(severity || ': ' || n, ', ' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM r GROUP BY severity)
UNION ALL SELECT '  Active: ' || count(*) || ', resolved: 0' FROM r""",
    "anomaly_report_json": f"""WITH {_FULL} SELECT '{{"product_id":' || CAST(an.product_id AS VARCHAR) || ',"name":"' || name || '","anomaly_type":"cyclic"}}' AS value
FROM an JOIN product p ON p.product_id = an.product_id, now WHERE ts >= now - INTERVAL 1 DAY AND anomaly_type = 'cyclic'""",
    "changed_products_detection": f"""WITH {_FULL} SELECT product_id, anomaly_type, severity, ts FROM an
WHERE product_id IN (SELECT user_id FROM events, now WHERE ts >= now - INTERVAL 1 DAY)""",
    "product_features": f"""WITH {_L}, r AS (SELECT *, CAST(price AS DOUBLE) AS p, lag(CAST(price AS DOUBLE)) OVER (PARTITION BY product_id ORDER BY ts, tie) AS before FROM ph),
g AS (SELECT product_id, count(*) AS n_records, CAST(sum(price) AS DOUBLE) / count(*) AS mean, stddev_pop(p) AS std, arg_min(p, (ts, tie)) AS first, arg_max(p, (ts, tie)) AS last,
  max(CASE WHEN before IS NOT NULL THEN CASE WHEN before > 0 THEN abs((p - before) / before) ELSE 0 END END) AS step FROM r GROUP BY product_id)
SELECT g.product_id, name, category, n_records, mean AS mean_price, round(std / mean, 6) AS volatility, round(CASE WHEN first = 0 THEN 0 ELSE (last - first) / first END, 6) AS trend,
  round(step * 100, 6) AS max_change_pct FROM g JOIN active p ON p.product_id = g.product_id WHERE n_records >= 3 AND mean <> 0""",
    "fx_sensitivity": f"""WITH {_E}, {_sens("USD")} SELECT g.product_id, name, round(correlation, 6) AS correlation, sample_size,
  CASE WHEN correlation IS NULL THEN 'none' WHEN abs(correlation) > 0.7 THEN 'strong ' || w WHEN abs(correlation) > 0.4 THEN 'moderate ' || w WHEN abs(correlation) > 0.2 THEN 'weak ' || w ELSE 'none' END AS verdict
FROM (SELECT *, CASE WHEN correlation > 0 THEN 'direct' ELSE 'inverse' END AS w FROM g) g JOIN product p ON p.product_id = g.product_id""",
    "fx_sensitivity_ranked": f"""WITH {_E}, {_sens("USD")}, chosen AS (SELECT product_id FROM active ORDER BY product_id LIMIT 30),
p AS (SELECT product_id, min(date) AS a, max(date) AS b FROM daily WHERE date IN (SELECT date FROM rates WHERE currency = 'USD') GROUP BY product_id)
SELECT g.product_id, CAST(row_number() OVER (ORDER BY abs(round(correlation, 9)) DESC NULLS LAST, g.product_id) AS INTEGER) AS place,
  'Pearson correlation ' || printf('%.3f', correlation) || ', ' || strftime(a, '%d.%m.%Y') || ' to ' || strftime(b, '%d.%m.%Y') || ', ' || sample_size || ' common dates. '
  || CASE WHEN abs(correlation) > 0.7 THEN 'Strong ' || w WHEN abs(correlation) > 0.4 THEN 'Moderate ' || w WHEN abs(correlation) > 0.2 THEN 'Weak ' || w ELSE 'None' END
  || ': as USD rises, the price ' || CASE WHEN correlation > 0 THEN 'rises' ELSE 'falls' END AS detail
FROM (SELECT *, CASE WHEN correlation > 0 THEN 'Direct' ELSE 'Inverse' END AS w FROM g) g JOIN chosen USING (product_id) JOIN p ON p.product_id = g.product_id""",
    "fx_sensitivity_p": f"""WITH {_E}, {_sens("EUR", "")}, a AS (SELECT product_id, correlation AS r, sample_size - 2 AS v, atan(abs(correlation) * sqrt((sample_size - 2) / (1 - correlation * correlation)) / sqrt(sample_size - 2)) AS th FROM g WHERE abs(correlation) < 1),
t AS (SELECT product_id, k, CASE WHEN v % 2 = 1 THEN ln(cos(th)) + sum(CASE WHEN k = 0 THEN 0 ELSE ln(2.0 * k / (2.0 * k + 1)) END) OVER w + 2 * k * ln(cos(th))
    ELSE sum(CASE WHEN k = 0 THEN 0 ELSE ln((2.0 * k - 1) / (2.0 * k)) END) OVER w + 2 * k * ln(cos(th)) END AS l
  FROM a, (SELECT unnest(range(0, 60)) AS k) WHERE k <= (v - CASE WHEN v % 2 = 1 THEN 3 ELSE 2 END) // 2 WINDOW w AS (PARTITION BY product_id ORDER BY k)),
s AS (SELECT product_id, sum(exp(l)) AS s FROM t GROUP BY product_id)
SELECT g.product_id, round(CASE WHEN correlation IS NULL THEN NULL WHEN abs(correlation) >= 1 THEN 0
  WHEN v % 2 = 1 THEN greatest(0, 1 - 2 / pi() * (th + sin(th) * coalesce(s, 0))) ELSE greatest(0, 1 - sin(th) * coalesce(s, 0)) END, 5) AS p_value
FROM g LEFT JOIN a ON a.product_id = g.product_id LEFT JOIN s ON s.product_id = g.product_id""",
    "alerts": f"""WITH {_L} SELECT user_id, s.product_id, name, price AS current_price, target_price FROM subs s JOIN ph ON ph.product_id = s.product_id AND is_actual
JOIN product p ON p.product_id = s.product_id WHERE s.is_active AND price <= target_price""",
    "alerts_state": f"""WITH {_L} SELECT is_active, count(*) AS n, CAST(sum(target_price) AS DOUBLE) AS targets FROM (
  SELECT target_price, s.is_active AND NOT coalesce(price <= target_price, false) AS is_active FROM subs s LEFT JOIN ph ON ph.product_id = s.product_id AND is_actual) GROUP BY is_active""",
    "product_upsert": f"""WITH o AS (SELECT {_URL} AS url, p_partkey AS id, p_name AS name, p_brand AS category, p_type AS code FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT {_URL} AS url, p_partkey AS id, upper(p_name) AS name, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS code FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)
SELECT coalesce(o.url, n.url) AS url, coalesce(n.name, o.name) AS name, coalesce(o.category, 'new') AS category, coalesce(nullif(n.code, ''), o.code) AS vendor_code,
  CASE WHEN o.url IS NOT NULL THEN 'a.png' END AS image_url, CASE WHEN n.url IS NOT NULL THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS last_parsed_at,
  CASE WHEN o.url IS NOT NULL THEN 's-' || CAST(o.id AS VARCHAR) ELSE replace(lower(n.name), ' ', '-') || CASE WHEN n.code = '' THEN '' ELSE '-' || {_SLUG.format("n.code")} END
    || '-' || substr(sha256(n.url), 1, 12) END AS slug, o.url IS NULL AS created
FROM o FULL JOIN n ON o.url = n.url""",
    "seed_merge": _seeds_sql(False),
    "seed_merge_update": _seeds_sql(True),
    "fx_upsert": f"WITH {_E} SELECT currency, date, CAST(CASE WHEN day(date) >= 15 THEN rate + 1 ELSE rate END AS DECIMAL(10,4)) AS rate FROM rates",
    "forecast_upsert": f"""WITH f AS ({_FC}) SELECT product_id, forecast_date, CAST(CASE WHEN product_id % 2 = 0 THEN predicted_price * 2 ELSE predicted_price END AS DECIMAL(12,2)) AS predicted_price, method FROM f
UNION ALL SELECT product_id, DATE '2024-02-02', CAST(predicted_price * 2 AS DECIMAL(12,2)), method FROM f WHERE product_id % 2 = 0""",
    "subscription_create": f"WITH {_L} SELECT user_id, product_id, target_price FROM subs WHERE product_id % 3 <> 0",
    "fx_rates_xml": f"WITH {_E} SELECT currency, date, rate FROM rates",
    "fx_backfill_calendar": "SELECT CAST(CAST(max(ts) AS DATE) - CAST(k AS INTEGER) AS DATE) AS date FROM events, (SELECT unnest(range(0, 90)) AS k) GROUP BY k",
    "clean_price": """SELECT raw, CAST(nullif(regexp_replace(split_part(raw, '₽', 1), '[^0-9]', '', 'g'), '') AS DOUBLE) AS price FROM (
  SELECT * FROM (VALUES ('12 499 ₽'), ('999₽'), (''), ('none in stock'), ('from 5 499 ₽/pc'), ('1 000')) v(raw) UNION ALL SELECT 'from ' || CAST(p_partkey AS VARCHAR) || ' 00 ₽/1 pc' FROM part)""",
    "slugify": f"SELECT p_partkey, replace(lower(p_name), ' ', '-') || '-' || replace(lower(p_brand), '#', '') || '-' || substr(sha256({_URL}), 1, 12) AS slug FROM part",
    "proxy_parts": """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'http://' WHEN s_suppkey % 3 = 1 THEN 'socks5://' ELSE '' END || 'p' || s_suppkey || '.example.com' ||
  CASE WHEN s_suppkey % 2 = 0 THEN ':' || (s_suppkey + 1000) ELSE '' END AS url, CASE WHEN s_suppkey % 3 = 1 THEN 'socks5' ELSE 'http' END AS scheme,
  'p' || s_suppkey || '.example.com' AS host, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1000 ELSE 3128 END AS INTEGER) AS port FROM supplier""",
    "heat_text": """SELECT event_id, CASE WHEN c IS NULL THEN '  -  ' ELSE CASE WHEN c > 5 THEN '▲▲' WHEN c > 0.5 THEN ' ▲' WHEN c < -5 THEN '▼▼' WHEN c < -0.5 THEN ' ▼' ELSE '  ●' END
  || printf('%+.0f', c) || '%' END AS cell FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN round((value - 50) / 10, 3) END AS c FROM events)""",
    "number_texts": """SELECT p_partkey, printf('%10.0f', p_retailprice) AS price, printf('%+.1f', p_retailprice - 1000) AS change, printf('%.1f', p_retailprice / 4096 * 100) || '%' AS share,
  CASE p_type WHEN 'PROMO' THEN 'promoted' WHEN 'SMALL' THEN 'small' ELSE p_type END AS kind FROM part""",
    "heat_indicator": """SELECT event_id, CASE WHEN c IS NULL THEN 'none' WHEN c > 5 THEN 'up2' WHEN c > 0.5 THEN 'up1' WHEN c < -5 THEN 'down2' WHEN c < -0.5 THEN 'down1' ELSE 'flat' END AS indicator FROM (
  SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN round((value - 50) / 10, 3) END AS c FROM events)""",
    "corr_verdict": """SELECT event_id, CASE WHEN r IS NULL THEN 'none' WHEN abs(r) > 0.7 THEN 'strong ' || w WHEN abs(r) > 0.4 THEN 'moderate ' || w WHEN abs(r) > 0.2 THEN 'weak ' || w ELSE 'none' END AS verdict FROM (
  SELECT event_id, r, CASE WHEN r > 0 THEN 'direct' ELSE 'inverse' END AS w FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN round(CAST(event_id % 201 AS DOUBLE) / 100 - 1, 2) END AS r FROM events))""",
    "page_extract": r"""SELECT page_id, substr(trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1), ''), ''), '\s+', ' ', 'g')), 1, 220) AS name,
  regexp_extract(url, '(\d+)', 1) AS vendor_code, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS old_price,
  nullif(regexp_extract(html, '(?is)<img[^>]*\b(?:data-)?src=["'']([^"'']+)', 1), '') AS image_url FROM pages""",
    "card_extract": """SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS card_no, p_name || ' ' || p_type AS name, floor(p_retailprice) AS price,
  CASE WHEN p_partkey % 4 = 0 THEN floor(p_retailprice) + 100 END AS old_price, CAST(p_partkey AS VARCHAR) AS vendor_code,
  CASE WHEN p_partkey % 5 <> 0 THEN '/i/' || p_partkey || '.png' END AS image_url FROM part""",
    "page_blocked": f"""SELECT page_id, contains(t, '403') OR contains(substr(low, 1, 800), '403 error') OR contains(lower(t), 'forbidden') OR contains(low, 'http 403') OR (contains(low, '{_NOTICE[0]}') AND contains(low, '{_NOTICE[1]}')) AS blocked
FROM (SELECT page_id, t, lower(t || chr(10) || substr(html, 1, 12000)) AS low FROM (SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1) AS t FROM pages))""",
    "dedupe_first": """SELECT page_id, url, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM (
  SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)) WHERE k = 1""",
    "api_products": f"""WITH {_E}, l AS (SELECT *, 'V' || CAST(product_id AS VARCHAR) AS vendor_code FROM active WHERE (contains(lower(name), 'customer') OR contains('v' || CAST(product_id AS VARCHAR), 'customer'))
  AND (contains(lower(name), '1') OR contains('v' || CAST(product_id AS VARCHAR), '1')) ORDER BY name, product_id LIMIT 20 OFFSET 20)
SELECT l.product_id, name, category, vendor_code, price AS current_price FROM l LEFT JOIN ph ON ph.product_id = l.product_id AND is_actual""",
    "api_price_history": f"WITH {_E} SELECT product_id, price, ts, is_actual FROM ph WHERE product_id = 3 AND product_id IN (SELECT product_id FROM active) ORDER BY ts DESC, tie DESC LIMIT 100",
    "api_anomalies": f"WITH {_FULL} SELECT product_id, anomaly_type, severity, ts FROM an WHERE severity = 'high' ORDER BY ts DESC, product_id, anomaly_type LIMIT 20",
    "api_subscriptions": f"WITH {_L} SELECT s.product_id, user_id, target_price, s.is_active, name FROM subs s JOIN product p ON p.product_id = s.product_id WHERE user_id = 10",
    "api_notifications": f"""WITH {_L} SELECT user_id, s.product_id, name || ': ' || CAST(price AS VARCHAR) || ' <= ' || CAST(target_price AS VARCHAR) AS message FROM subs s
JOIN ph ON ph.product_id = s.product_id AND is_actual JOIN product p ON p.product_id = s.product_id WHERE s.is_active AND price <= target_price""",
    "dashboard_summary": f"""WITH {_FULL}, w AS (SELECT ph.* FROM ph, now WHERE ts >= now - INTERVAL 7 DAY), r AS (SELECT an.* FROM an, now WHERE ts >= now - INTERVAL 7 DAY),
c AS (SELECT product_id, name FROM active ORDER BY name, product_id LIMIT 30)
SELECT CAST(7 AS INTEGER) AS period_days, (SELECT count(*) FROM w) AS records_in_window, (SELECT count(DISTINCT product_id) FROM w) AS products_updated, (SELECT count(*) FROM active) AS total_products,
  (SELECT count(*) FROM cats WHERE open) AS active_categories, (SELECT count(*) FROM active WHERE product_id NOT IN (SELECT product_id FROM ph)) AS products_without_data,
  (SELECT count(*) FROM r) AS anomalies, (SELECT count(*) FROM r WHERE severity = 'high') AS anomalies_high, (SELECT count(*) FROM r WHERE severity = 'medium') AS anomalies_medium,
  (SELECT count(*) FROM r WHERE severity = 'low') AS anomalies_low, (SELECT count(DISTINCT category) FROM product JOIN cats ON kind = category AND open WHERE product_id IN (SELECT product_id FROM ph)) AS index_rows,
  (SELECT count(*) FROM ({_deals(30, 50)})) AS deals_listed, (SELECT count(DISTINCT w.product_id) FROM w JOIN c ON c.product_id = w.product_id) AS heat_products, CAST(8 AS BIGINT) AS heat_dates,
  (SELECT count(*) FROM r WHERE anomaly_type = 'spike') AS anomalies_spike, (SELECT count(*) FROM r WHERE anomaly_type = 'manipulation') AS anomalies_manipulation,
  (SELECT count(*) FROM r WHERE anomaly_type = 'cyclic') AS anomalies_cyclic, (SELECT count(*) FROM (WITH {_sens("USD")} SELECT g.product_id FROM g JOIN (SELECT product_id FROM active ORDER BY product_id LIMIT 30) USING (product_id))) AS sensitivity_rows""",
    "dashboard_payload": f"""WITH {_FULL}, {_sens("USD")}, w AS (SELECT ph.* FROM ph, now WHERE ts >= now - INTERVAL 7 DAY), r AS (SELECT an.* FROM an, now WHERE ts >= now - INTERVAL 7 DAY),
deals AS ({_deals(30, 50)}), c AS (SELECT product_id, name FROM active ORDER BY name, product_id LIMIT 30),
sold AS (SELECT category FROM product JOIN cats ON kind = category AND open WHERE product_id IN (SELECT product_id FROM ph)),
sens AS (SELECT g.* FROM g JOIN (SELECT product_id FROM active ORDER BY product_id LIMIT 30) USING (product_id)),
fx AS (SELECT * FROM rates ORDER BY date DESC, currency LIMIT 9)
SELECT 'metrics' AS section, CAST(1 AS BIGINT) AS items, CAST(count(*) AS VARCHAR) AS first FROM w
UNION ALL SELECT 'category_index', count(DISTINCT category), min(category) FROM sold
UNION ALL SELECT 'deals_top', count(*), CAST((SELECT product_id FROM deals ORDER BY discount_pct DESC, product_id LIMIT 1) AS VARCHAR) FROM deals
UNION ALL SELECT 'heatmap', count(DISTINCT w.product_id), CAST(arg_min(c.product_id, (name, c.product_id)) AS VARCHAR) FROM w JOIN c ON c.product_id = w.product_id
UNION ALL SELECT 'sensitivity', count(*), CAST(arg_min(product_id, (-abs(correlation), product_id)) AS VARCHAR) FROM sens
UNION ALL SELECT 'anomalies_summary', 1, CAST(count(*) AS VARCHAR) FROM r
UNION ALL SELECT 'currency_rates_latest', count(*), arg_min(currency, (-epoch(date), currency)) FROM fx""",
    "latest_rates": f"WITH {_E} SELECT currency, date, rate FROM rates ORDER BY date DESC, currency LIMIT 9",
    "list_snapshots": f"""WITH {_E} SELECT kind, now - CAST(h AS INTEGER) * INTERVAL 1 HOUR AS created_at, summary FROM (
  SELECT 'index' AS kind, 0 AS h, '{{"rows":' || CAST((SELECT count(DISTINCT category) FROM product JOIN cats ON kind = category AND open WHERE product_id IN (SELECT product_id FROM ph)) AS VARCHAR) || '}}' AS summary
  UNION ALL SELECT 'deals', 1, '{{"count":' || CAST((SELECT count(*) FROM ({_deals(30, 100)})) AS VARCHAR) || '}}'
  UNION ALL SELECT 'anomalies', 2, '{{"total":' || CAST((SELECT count(*) FROM (WITH {_FULL}, r AS (SELECT an.* FROM an, now WHERE ts >= now - INTERVAL 7 DAY) SELECT * FROM r)) AS VARCHAR) || ',"days":7}}'), now""",
    "stream_change_log": f"WITH {_CHANGES} SELECT product_id, price, arrival FROM k",
    "stream_daily_last": """SELECT user_id AS product_id, CAST(ts AS DATE) AS date, arg_max(CAST(floor(value / 10) * 10 AS BIGINT), (ts, event_id)) AS price FROM events, (SELECT max(ts) AS now FROM events)
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= now - INTERVAL 1 DAY GROUP BY user_id, CAST(ts AS DATE)""",
}

# A key's rows in order, folded: the last kept and open one, and all kept.
_ONCE = """e AS (SELECT user_id AS product_id, ['spike', 'manipulation', 'cyclic'][event_id % 3 + 1] AS anomaly_type, epoch_us(ts) AS us, event_type = 'signup' AS resolved FROM events),
f AS (SELECT product_id, anomaly_type, list_reduce(list_prepend({'open': NULL::BIGINT, 'kept': []::BIGINT[]},
    list({'open': CASE WHEN resolved THEN -us ELSE us END, 'kept': []::BIGINT[]} ORDER BY us, resolved)),
    lambda a, x: CASE WHEN x.open < 0 THEN {'open': NULL::BIGINT, 'kept': a.kept}
      WHEN a.open IS NULL OR x.open - a.open > 86400000000 THEN {'open': x.open, 'kept': list_append(a.kept, x.open)} ELSE a END).kept AS kept
  FROM e GROUP BY product_id, anomaly_type),
k AS (SELECT product_id, anomaly_type, make_timestamp(unnest(kept)) AS detected_at FROM f)"""
ORACLES["anomalies_once"] = f"WITH {_ONCE} SELECT * FROM k"
ORACLES["stream_anomalies_once"] = f"WITH {_ONCE} SELECT k.* FROM k, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS passed FROM events) WHERE detected_at <= passed"

_ALERTED = """subs AS (SELECT c_custkey AS user_id, unnest([c_custkey, c_custkey + 1]) AS product_id, CAST(abs(c_acctbal) / 100 AS DECIMAL(12,2)) AS target_price, c_custkey % 5 <> 0 AS is_active FROM customer),
b AS (SELECT user_id AS product_id, event_id % 3 AS batch, arg_max(CAST(value AS DECIMAL(12,2)), event_id) AS current_price FROM events GROUP BY user_id, event_id % 3),
h AS (SELECT s.user_id, s.product_id, current_price, target_price, batch FROM subs s JOIN b ON b.product_id = s.product_id WHERE is_active AND current_price <= target_price),
fired AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY batch) = 1)"""
ORACLES["stream_alerts"] = f"WITH {_ALERTED} SELECT user_id, product_id, current_price, target_price, CAST(batch AS BIGINT) AS batch FROM fired"
ORACLES["stream_alerts_state"] = f"""WITH {_ALERTED} SELECT s.user_id, s.product_id, is_active AND f.user_id IS NULL AS is_active FROM subs s
LEFT JOIN fired f ON f.user_id = s.user_id AND f.product_id = s.product_id"""

# Merges end in what rewriting the whole table gives.
ORACLES |= {"dashboard_kept": ORACLES["dashboard_summary"], "forecast_merge": ORACLES["forecast_upsert"], "product_merge": ORACLES["product_upsert"], "price_log_merge": ORACLES["product_change_log"], "rates_merge": ORACLES["fx_upsert"]}

ORACLES["api_product_detail"] = f"""WITH {_E} SELECT p.product_id, name, category, 'V' || CAST(p.product_id AS VARCHAR) AS vendor_code, 'https://shop.example.com/p/' || CAST(p.product_id AS VARCHAR) AS url,
  p.is_active, price AS current_price FROM active p LEFT JOIN ph ON ph.product_id = p.product_id AND is_actual WHERE p.product_id = 14"""
ORACLES["api_inactive"] = f"WITH {_E} SELECT product_id, name, category FROM product WHERE NOT is_active"

ORACLES["crawl_statuses"] = """SELECT p_brand AS category, CASE WHEN p_brand = 'Brand#55' THEN 'skipped' WHEN p_brand = 'Brand#13' THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN p_brand IN ('Brand#55', 'Brand#13') THEN 0 ELSE count(*) END AS parsed FROM part GROUP BY p_brand"""
ORACLES["crawl_counts"] = """SELECT CAST(1 AS INTEGER) AS crawl, count(*) AS created, 0::BIGINT AS updated, count(*) AS saved, 0::BIGINT AS unchanged, 0::BIGINT AS anomalies FROM part WHERE p_brand <> 'Brand#55'
UNION ALL SELECT 2, 0, count(*), count(*) FILTER (p_partkey % 4 = 0), count(*) FILTER (p_partkey % 4 <> 0), 0 FROM part WHERE p_brand NOT IN ('Brand#55', 'Brand#13')"""

ORACLES |= {"name_search_indexed": ORACLES["name_search"], "api_products_indexed": ORACLES["api_products"], "api_products_after": ORACLES["api_products"]}
ORACLES["api_products_by_parsed"] = f"""WITH {_E}, l AS (SELECT *, 'V' || CAST(product_id AS VARCHAR) AS vendor_code FROM active
  ORDER BY CASE WHEN product_id % 40 <> 0 THEN DATE '2024-01-01' + CAST(product_id % 50 AS INTEGER) END DESC NULLS FIRST, product_id LIMIT 20)
SELECT l.product_id, name, category, vendor_code, price AS current_price FROM l LEFT JOIN ph ON ph.product_id = l.product_id AND is_actual"""
ORACLES["alert_notifications"] = f"""WITH {_L} SELECT user_id, lower(c_name) AS username, replace(lower(c_name), '#', '.') || '@example.com' AS email, s.product_id,
  name || ': ' || CAST(price AS VARCHAR) || ' <= ' || CAST(target_price AS VARCHAR) || ' https://shop.example.com/p/' || CAST(s.product_id AS VARCHAR) AS message
FROM subs s JOIN ph ON ph.product_id = s.product_id AND is_actual JOIN product p ON p.product_id = s.product_id JOIN customer ON c_custkey = user_id WHERE s.is_active AND price <= target_price"""
ORACLES["category_slugs"] = """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'n-' || CAST(n_nationkey AS VARCHAR) ELSE 'the-' || lower(replace(n_name, ' ', '-')) END AS slug FROM nation"""
ORACLES["iso_times"] = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts + INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '+03:30' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%SZ')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' END AS shown,
  CASE WHEN event_id % 3 = 1 THEN date_trunc('second', ts) ELSE ts END AS ts FROM events"""


def _fields(section: str, item: str, table: str, *fields: str) -> str:
    """A row for each of the fields of each row of a table."""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, '{f}' AS field, round(CAST({f} AS DOUBLE), 6) AS value FROM ({table})" for f in fields)


_METRICS = f"WITH {_E} " + ORACLES["ingest_metrics"].split(f"WITH {_E}, ")[1].replace("w AS (", "SELECT * FROM (WITH w AS (", 1) + ")"
ORACLES["dashboard_sections"] = " UNION ALL ".join([
    _fields("deals_top", "product_id", f"WITH {_E} {_deals(30, 50)}", "current_price", "min_price", "avg_price", "discount_pct"),
    _fields("category_index", "category", f"WITH {_E} {_INDEX}", "product_count", "mean_price", "median_price", "prev_mean", "prev_median"),
    _fields("metrics", "''", _METRICS, "total_records", "unique_products", "total_products", "active_categories", "products_without_data", "avg_records_per_product"),
    _fields("sensitivity", "product_id", f"WITH {_E}, {_sens('USD')} SELECT g.* FROM g JOIN (SELECT product_id FROM active ORDER BY product_id LIMIT 30) USING (product_id)", "correlation", "sample_size"),
    _fields("heatmap", "product_id || ' ' || date", f"WITH {_E}, {_HEAT}", "price", "change_pct"),
    _fields("anomalies_summary", "label", ORACLES["anomaly_summary"], "n"),
    _fields("currency_rates_latest", "currency || ' ' || date", ORACLES["latest_rates"], "rate"),
])

#: Decimal columns, which leave as doubles.
_DECIMALS = {
    "latest_price": "price", "price_history": "price delta", "best_deals": "current_price min_price", "best_deals_lineitem": "current_price min_price",
    "compare_products": "current_price min_price max_price forecast_price", "alerts": "current_price target_price", "fx_upsert": "rate",
    "forecast_upsert": "predicted_price", "subscription_create": "target_price", "fx_rates_xml": "rate", "api_products": "current_price",
    "api_price_history": "price", "api_subscriptions": "target_price", "latest_rates": "rate", "rates_merge": "rate", "forecast_merge": "predicted_price", "api_product_detail": "current_price", "api_products_indexed": "current_price", "api_products_after": "current_price", "api_products_by_parsed": "current_price", "stream_alerts": "current_price target_price",
}
for _name, _columns in _DECIMALS.items():
    _casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _columns.split())
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
