"""The same queries in plain SQL, written against the raw tables.

``VIEWS`` maps the test tables to the retail tables; every oracle query names the views it needs
and gets them as common table expressions.
"""

from __future__ import annotations

import re
from itertools import combinations_with_replacement

AS_OF = "TIMESTAMP '2026-01-01 00:00:00'"
FOREVER = "TIMESTAMP '9999-12-31 23:59:59'"

VIEWS: dict[str, str] = {}

VIEWS["lines"] = """
    SELECT l.*, o_custkey, o_orderpriority, o_orderstatus,
           l_orderkey || '-' || l_linenumber AS line_id,
           CAST(l_quantity AS INTEGER) AS qty,
           CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_cents,
           CAST(round(l_discount * 100) AS BIGINT) AS pct,
           CAST(round(l_tax * 100) AS INTEGER) AS tax_pct
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey"""

CHANNEL = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'POS'
                  WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'WEBSITE'
                  ELSE 'MOBILE_APP' END"""
UNIT_PRICE = "CAST(unit_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"

VIEWS["tx"] = f"""
    SELECT line_id AS id, CAST(l_orderkey AS VARCHAR) AS transaction_id,
           CASE WHEN tax_pct <> 8 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(l_suppkey AS VARCHAR) END AS store_id,
           {CHANNEL} AS channel, CAST(l_partkey AS VARCHAR) AS product_id, qty AS quantity,
           {UNIT_PRICE} AS unit_price, CAST(pct * 2 AS DECIMAL(18,2)) AS discount,
           l_shipdate AS transaction_timestamp
    FROM lines"""

VIEWS["ret"] = """
    SELECT line_id AS id, CAST(l_orderkey AS VARCHAR) AS transaction_id,
           CAST(l_partkey AS VARCHAR) AS product_id, qty AS quantity,
           CAST(qty * unit_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS refund_amount,
           CASE WHEN l_linestatus = 'F' THEN 'DEFECTIVE' ELSE 'WRONG_ITEM' END AS return_reason,
           l_shipdate AS return_timestamp
    FROM lines WHERE l_returnflag = 'R'"""

VIEWS["mov"] = """
    SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_partkey AS VARCHAR) AS product_id,
           CAST(l_suppkey AS VARCHAR) AS store_id,
           CASE l_returnflag WHEN 'N' THEN 'SALE' WHEN 'R' THEN 'RETURN' ELSE 'RESTOCK' END AS movement_type,
           CASE WHEN l_returnflag = 'N' THEN -CAST(l_quantity AS INTEGER)
                ELSE CAST(l_quantity AS INTEGER) END AS quantity,
           l_shipdate AS movement_timestamp
    FROM lineitem"""

VIEWS["supplier_geo"] = """
    SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["regmov"] = """
    SELECT md5(p_brand) AS product_key, md5(r_name) AS store_key,
           CAST(movement_timestamp AS DATE) AS date_day, quantity
    FROM mov JOIN part ON CAST(product_id AS BIGINT) = p_partkey
             JOIN supplier_geo ON CAST(store_id AS BIGINT) = s_suppkey"""

VIEWS["cust"] = """
    SELECT CAST(o_custkey AS VARCHAR) AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
           lower(c_mktsegment) || o_custkey || '@example.com' AS email,
           '+1-555-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS phone,
           CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'OTHER' ELSE 'M' END AS gender,
           upper(substr(r_name, 1, 2)) AS state,
           CAST(DATE '1950-01-01' + c_nationkey * 400 AS DATE) AS birth_date,
           o_orderdate AS updated_at
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey"""

VIEWS["prod"] = f"""
    SELECT CAST(l_partkey AS VARCHAR) AS product_id, p_brand AS sku, p_name AS name, p_type AS category,
           {UNIT_PRICE} AS price,
           CAST((unit_cents * 60 // 100) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS cost,
           l_shipdate AS updated_at
    FROM lines JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'"""

VIEWS["catalog"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_type AS category,
           CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(p_retailprice AS DECIMAL(18,2)) AS cost
    FROM part"""

VIEWS["store"] = """
    SELECT CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name, n_name AS city,
           upper(substr(r_name, 1, 2)) AS state, r_name AS country FROM supplier_geo"""

VIEWS["ev"] = r"""
    SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k, CAST(value AS DECIMAL(18,2)) AS amount,
           CAST(user_id AS VARCHAR) AS usr, 'T' || (event_id // 3) AS basket FROM events"""

VIEWS["mk"] = """
    SELECT 'CMP-' || (k // 10) AS campaign_id,
           'Campaign ' || (k // 10) || CASE WHEN day(ts) <= 15 THEN ' early' ELSE ' late' END AS campaign_name,
           CASE WHEN k < 50 THEN 'EMAIL' ELSE 'SOCIAL' END AS channel,
           CAST(ts AS DATE) AS campaign_date, CAST(sum(amount) AS DECIMAL(18,2)) AS cost,
           CAST(count(*) FILTER (event_type = 'view') AS INTEGER) AS impressions,
           CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS clicks,
           CAST(count(*) FILTER (event_type = 'purchase') AS INTEGER) AS conversions
    FROM ev GROUP BY ALL"""

VIEWS["tk"] = """
    SELECT CAST(event_id AS VARCHAR) AS ticket_id, usr AS customer_id, 'K' || (k // 25) AS issue_category,
           CASE WHEN k >= 20 THEN 'RESOLVED' ELSE 'OPEN' END AS status,
           CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS priority, ts AS ticket_timestamp,
           CASE WHEN k >= 20 THEN ts + to_minutes(CAST(k * 10 AS BIGINT)) END AS resolution_timestamp
    FROM ev WHERE event_type = 'error'"""

VIEWS["members"] = """
    SELECT usr AS customer_id, 'User' || usr AS first_name, 'Version' || k AS last_name,
           CASE WHEN k < 90 THEN 'malformed' || k || '#host' ELSE 'user' || k || '@example.com' END AS email,
           '+1-555-' || lpad(CAST(k AS VARCHAR), 4, '0') AS phone,
           CASE WHEN k < 40 THEN 'M' WHEN k < 80 THEN 'F' ELSE 'X' END AS gender,
           'NY' AS state, DATE '1990-01-01' AS birth_date, ts AS updated_at
    FROM ev WHERE event_type = 'signup'"""

VIEWS["baskets"] = """
    SELECT CAST(event_id AS VARCHAR) AS id, basket AS transaction_id, CASE WHEN k <> 7 THEN usr END AS customer_id,
           CAST(k // 10 + 1 AS INTEGER) AS quantity, amount AS unit_price, CAST(0 AS DECIMAL(18,2)) AS discount,
           ts AS transaction_timestamp FROM ev"""

VIEWS["basket_ret"] = """
    SELECT basket AS transaction_id, CAST(k // 20 + 1 AS INTEGER) AS quantity
    FROM ev WHERE event_type = 'error' AND k < 60"""

VIEWS["ordsales"] = """
    SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS customer_id,
           CAST(o_totalprice AS DECIMAL(18,2)) AS net, o_orderdate AS ts FROM orders"""

VIEWS["rawtx"] = f"""
    SELECT line_id AS id, CAST(l_orderkey AS VARCHAR) AS transaction_id,
           CASE WHEN tax_pct <> 8 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
           CAST(l_suppkey AS VARCHAR) AS store_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'POS' WHEN o_orderpriority = '2-HIGH' THEN '  WEBSITE '
                WHEN o_orderpriority = '5-LOW' THEN 'KIOSK' ELSE 'MOBILE_APP' END AS channel,
           CAST(l_partkey AS VARCHAR) AS product_id, qty - 3 AS quantity,
           CASE WHEN pct <> 10 THEN {UNIT_PRICE} END AS unit_price,
           CAST(pct * 2 - 1 AS DECIMAL(18,2)) AS discount, l_shipdate AS transaction_timestamp
    FROM lines"""

VIEWS["tagged"] = f"""
    SELECT md5('POS_WEB_APP-transactions-' || id) AS event_id, 'C' AS operation_type,
           strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp,
           {AS_OF} AS bronze_ingestion_time, 'run-1' AS bronze_run_id,
           id, transaction_id, customer_id, store_id, trim(channel) AS channel, product_id, quantity,
           unit_price, discount, transaction_timestamp,
           CASE WHEN trim(channel) NOT IN ('POS', 'WEBSITE', 'MOBILE_APP') THEN 'channel not in accepted values'
                WHEN quantity < 1 THEN 'quantity is below min value 1'
                WHEN unit_price IS NULL THEN 'unit_price is null'
                WHEN unit_price < 0 THEN 'unit_price is below min value 0.0'
                WHEN discount < 0 THEN 'discount is below min value 0.0' END AS quarantine_reason
    FROM rawtx"""

VIEWS["tx_silver"] = """
    SELECT * EXCLUDE (quarantine_reason, rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_timestamp DESC,
          transaction_id DESC NULLS LAST, customer_id DESC NULLS LAST, store_id DESC NULLS LAST,
          channel DESC NULLS LAST, product_id DESC NULLS LAST, quantity DESC NULLS LAST,
          unit_price DESC NULLS LAST, discount DESC NULLS LAST) AS rn
      FROM tagged WHERE quarantine_reason IS NULL) WHERE rn = 1"""

VIEWS["rawcust"] = """
    SELECT customer_id AS id, ' ' || first_name AS first_name, last_name,
           CASE WHEN gender = 'OTHER' THEN 'malformed-' || customer_id ELSE email END AS email, phone,
           CASE WHEN last_name = 'MACHINERY' THEN 'robot' ELSE lower(gender) END AS gender,
           CASE WHEN state = 'MI' THEN 'mid' ELSE lower(state) END AS state, birth_date, updated_at
    FROM cust"""

VIEWS["cust_tagged"] = f"""
    SELECT md5('CRM-customers-' || id) AS event_id, 'C' AS operation_type,
           strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS event_timestamp, {AS_OF} AS bronze_ingestion_time,
           'run-1' AS bronze_run_id, id, trim(first_name) AS first_name, last_name, email, phone,
           upper(gender) AS gender, upper(state) AS state, CAST(birth_date AS TIMESTAMP) AS birth_date,
           CASE WHEN upper(gender) NOT IN ('M', 'F', 'OTHER', 'UNKNOWN') THEN 'gender not in accepted values'
                WHEN length(state) <> 2 THEN 'state length does not equal 2' END AS quarantine_reason
    FROM rawcust"""

VIEWS["cust_silver"] = """
    SELECT * EXCLUDE (quarantine_reason, rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id, event_timestamp ORDER BY first_name DESC,
          last_name DESC, email DESC, phone DESC, gender DESC, state DESC, birth_date DESC) AS rn
      FROM cust_tagged WHERE quarantine_reason IS NULL) WHERE rn = 1"""

AUDIT_ROW = """
    SELECT '2026-01-01 00:00:00' AS "timestamp", '{table}' AS table_name, b AS bronze_count, s AS silver_count,
           q AS quarantine_count, b - q - s AS duplicate_count, b = s + q + (v - s) AS reconciled,
           round_even(s * 100.0::DOUBLE / b, 2) AS quality_score
    FROM (SELECT count(*) AS b, count(quarantine_reason) AS q, count(*) - count(quarantine_reason) AS v
          FROM {tagged}), (SELECT count(*) AS s FROM {silver})"""

VIEWS["tx_audit"] = AUDIT_ROW.format(table="transactions", tagged="tagged", silver="tx_silver")
VIEWS["cust_audit"] = AUDIT_ROW.format(table="customers", tagged="cust_tagged", silver="cust_silver")
VIEWS["audit"] = "SELECT * FROM tx_audit UNION ALL SELECT * FROM cust_audit"


def _scd2(source: str, key: str, name: str, attributes: str, gap: str = " - INTERVAL 1 SECOND") -> str:
    order = ", ".join(f"{c.strip()} NULLS LAST" for c in attributes.split(","))
    return f"""
    SELECT md5(concat({key}, '_', coalesce(CAST(updated_at AS VARCHAR), '1970-01-01'))) AS {name}, {key},
           {attributes}, updated_at AS valid_from, coalesce(nxt{gap}, {FOREVER}) AS valid_to,
           nxt IS NULL AS is_current
    FROM (SELECT *, lead(updated_at) OVER (PARTITION BY {key} ORDER BY updated_at, {order}) AS nxt FROM {source})"""


PERSON = "first_name, last_name, email, phone, gender, state, birth_date"
ITEM = "sku, name, category, price, cost"
VIEWS["dcust"] = _scd2("cust", "customer_id", "customer_key", PERSON)
VIEWS["dmember"] = _scd2("members", "customer_id", "customer_key", PERSON)
VIEWS["dprod"] = _scd2("prod", "product_id", "product_key", ITEM)
VIEWS["dprod0"] = _scd2("prod", "product_id", "product_key", ITEM, gap="")
VIEWS["dcamp"] = """
    SELECT md5(concat(campaign_id, '_', coalesce(CAST(campaign_date AS VARCHAR), '1970-01-01'))) AS campaign_key,
           campaign_id, campaign_name, channel, campaign_date AS valid_from,
           coalesce(nxt, DATE '9999-12-31') AS valid_to, nxt IS NULL AS is_current
    FROM (SELECT DISTINCT campaign_id, campaign_name, channel, campaign_date,
                 lead(campaign_date) OVER (PARTITION BY campaign_id
                     ORDER BY campaign_date, campaign_name, channel) AS nxt FROM mk)"""
VIEWS["dstore"] = f"""
    SELECT md5(concat(store_id, '_1970-01-01')) AS store_key, store_id, store_name, city, state, country,
           TIMESTAMP '1970-01-01 00:00:00' AS valid_from, {FOREVER} AS valid_to, true AS is_current FROM store"""
VIEWS["dchan"] = "SELECT DISTINCT md5(channel) AS channel_key, channel AS channel_name FROM tx"

TIER = """CASE WHEN discount = 0 THEN 'PROMO-NONE' WHEN discount <= 5 THEN 'PROMO-SEASONAL'
               WHEN discount <= 15 THEN 'PROMO-LOYALTY' ELSE 'PROMO-FLASH' END"""

def _version(dim: str, key: str, at: str) -> str:
    """The newest version that began by a moment; versions that no moment lies in do not count. Whether it still held is left to ``_held``."""
    return f"ASOF LEFT JOIN (SELECT * FROM {dim} WHERE valid_from < valid_to) {dim} ON x.{key} = {dim}.{key} AND x.{at} >= {dim}.valid_from"


def _held(dim: str, column: str, at: str, otherwise: str) -> str:
    return f"CASE WHEN x.{at} < {dim}.valid_to THEN {dim}.{column} ELSE {otherwise} END"


VIEWS["resolved"] = f"""
    SELECT x.*, {_held("dcust", "customer_key", "transaction_timestamp", "md5('CUST-UNKNOWN')")} AS customer_key,
           {_held("dprod", "product_key", "transaction_timestamp", "md5('PRD-UNKNOWN')")} AS product_key,
           coalesce(dstore.store_key, md5('ST-UNKNOWN')) AS store_key,
           coalesce({_held("dprod", "cost", "transaction_timestamp", "NULL")}, 0) AS unit_cost
    FROM tx x {_version("dcust", "customer_id", "transaction_timestamp")}
    {_version("dprod", "product_id", "transaction_timestamp")}
    LEFT JOIN dstore USING (store_id)"""
VIEWS["fsales"] = f"""
    SELECT * EXCLUDE (id, customer_id, product_id, store_id, channel, unit_cost), id AS transaction_line_id,
           md5(channel) AS channel_key, md5({TIER}) AS promotion_key, CAST(transaction_timestamp AS DATE) AS date_day,
           CAST(quantity * unit_price - discount AS DECIMAL(18,2)) AS net_sales,
           CAST(quantity * unit_cost AS DECIMAL(18,2)) AS total_cost,
           CAST(net_sales - total_cost AS DECIMAL(18,2)) AS gross_margin
    FROM resolved"""
VIEWS["fret"] = """
    SELECT r.id AS return_id, transaction_id, coalesce(product_key, md5('PRD-UNKNOWN')) AS product_key,
           CAST(return_timestamp AS DATE) AS date_day, quantity, refund_amount, return_reason, return_timestamp
    FROM ret r LEFT JOIN dprod p ON r.product_id = p.product_id AND return_timestamp >= p.valid_from
                                AND return_timestamp < p.valid_to"""

NET = "CAST(quantity * unit_price - discount AS DECIMAL(18,2))"
VIEWS["labelled"] = f"""
    SELECT CAST(transaction_timestamp AS DATE) AS date_day, coalesce(channel, 'POS') AS channel,
           coalesce(category, 'General') AS category, CAST({NET} * 100 AS BIGINT) AS cents
    FROM tx LEFT JOIN catalog USING (product_id)"""
VIEWS["slices"] = """
    SELECT CASE WHEN grouping(channel) = 1 THEN 'ALL' ELSE channel END AS channel,
           CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category,
           date_day, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_rows
    FROM labelled GROUP BY GROUPING SETS ((date_day), (date_day, channel), (date_day, category))"""
VIEWS["spans"] = """
    SELECT channel, category, min(date_day) AS a, max(date_day) AS b FROM slices
    GROUP BY channel, category HAVING sum(n_rows) >= 14"""
VIEWS["dense"] = """
    SELECT g.channel, g.category, g.date_day, coalesce(cents, 0) AS cents
    FROM (SELECT channel, category, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date_day
          FROM spans) g
    LEFT JOIN slices USING (channel, category, date_day)"""

FEATURES = (
    "day_of_week day_of_month month is_weekend is_payday is_retail_event lag_1 lag_2 lag_7 lag_14"
    " rolling_mean_7 rolling_mean_14 rolling_std_14 marketing_spend_7d avg_discount_pct stockout_rate"
).split()

VIEWS["windowed"] = """
    SELECT *, lag(cents, 1) OVER w AS l1, lag(cents, 2) OVER w AS l2, lag(cents, 7) OVER w AS l7,
           lag(cents, 14) OVER w AS l14,
           sum(cents) OVER w7 AS s7, count(cents) OVER w7 AS n7,
           sum(cents) OVER w14 AS s14, count(cents) OVER w14 AS n14,
           sum(CAST(cents AS HUGEINT) * cents) OVER w14 AS q14
    FROM dense
    WINDOW w AS (PARTITION BY channel, category ORDER BY date_day),
           w7 AS (PARTITION BY channel, category ORDER BY date_day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
           w14 AS (PARTITION BY channel, category ORDER BY date_day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"""
VIEWS["feat"] = """
    SELECT * EXCLUDE (usable) FROM (
      SELECT channel, category, date_day, CAST(cents AS DOUBLE) / 100.0::DOUBLE AS net_sales,
             CAST(isodow(date_day) - 1 AS DOUBLE) AS day_of_week, CAST(day(date_day) AS DOUBLE) AS day_of_month,
             CAST(month(date_day) AS DOUBLE) AS month,
             CAST(CASE WHEN isodow(date_day) IN (6, 7) THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend,
             CAST(CASE WHEN day(date_day) IN (1, 15, 30, 31) THEN 1 ELSE 0 END AS DOUBLE) AS is_payday,
             CAST(CASE WHEN (month(date_day), day(date_day)) IN ((7, 4), (12, 24), (12, 25), (12, 31), (1, 1))
                         OR (month(date_day) = 11 AND day(date_day) BETWEEN 23 AND 29) THEN 1 ELSE 0 END AS DOUBLE)
               AS is_retail_event,
             CAST(l1 AS DOUBLE) / 100.0::DOUBLE AS lag_1, CAST(l2 AS DOUBLE) / 100.0::DOUBLE AS lag_2,
             CAST(l7 AS DOUBLE) / 100.0::DOUBLE AS lag_7, CAST(l14 AS DOUBLE) / 100.0::DOUBLE AS lag_14,
             CAST(s7 AS DOUBLE) / CAST(n7 AS DOUBLE) / 100.0::DOUBLE AS rolling_mean_7,
             CAST(s14 AS DOUBLE) / CAST(n14 AS DOUBLE) / 100.0::DOUBLE AS rolling_mean_14,
             sqrt(CAST(n14 * q14 - CAST(s14 AS HUGEINT) * CAST(s14 AS HUGEINT) AS DOUBLE)
                  / CAST(n14 * (n14 - 1) AS DOUBLE)) / 100.0::DOUBLE AS rolling_std_14,
             0.0::DOUBLE AS marketing_spend_7d, 0.0::DOUBLE AS avg_discount_pct, 0.0::DOUBLE AS stockout_rate,
             count(*) OVER (PARTITION BY channel, category) AS usable
      FROM windowed WHERE l14 IS NOT NULL) WHERE usable >= 7"""
PAIRS = list(combinations_with_replacement(["one", *FEATURES, "net_sales"], 2))
COUNT = len(FEATURES)


def _place(i: int, j: int) -> int:
    """Where the sum of a pair of columns stands, counted from 1."""
    names = ["one", *FEATURES, "net_sales"]
    return PAIRS.index((names[min(i, j)], names[max(i, j)])) + 1


def _centred(i: int, j: int) -> str:
    plain = f"t[{_place(i, j)}] - t[{_place(0, i)}] * t[{_place(0, j)}] / t[1]"
    return f"{plain} + 1.0::DOUBLE" if i == j else plain


def _sum(values: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {values}), lambda a, b: a + b)"


def _dot(left: str, right: str) -> str:
    return _sum(f"list_transform({left}, lambda x, i: x * {right}[i])")


VIEWS["feat_held"] = """
    SELECT *, row_number() OVER newest <= least(7, count(*) OVER (PARTITION BY channel, category) // 3) AS is_test,
           row_number() OVER newest AS age FROM feat
    WINDOW newest AS (PARTITION BY channel, category ORDER BY date_day DESC)"""
# sums go to doubles by way of text, which rounds once
VIEWS["sums"] = """
    SELECT channel, category, fit, [{cells}] AS t
    FROM (SELECT *, 1 AS one, unnest(CASE WHEN is_test THEN ['whole'] ELSE ['whole', 'train'] END) AS fit FROM feat_held)
    GROUP BY channel, category, fit""".format(
    cells=", ".join(f"sum(CAST({a} AS DECIMAL(19,4)) * CAST({b} AS DECIMAL(19,4)))::VARCHAR::DOUBLE" for a, b in PAIRS)
)
VIEWS["elimination"] = f"""
    SELECT channel, category, fit, 0 AS k, t,
           [{", ".join("[" + ", ".join(_centred(i, j) for j in range(1, COUNT + 2)) + "]" for i in range(1, COUNT + 1))}] AS m FROM sums
    UNION ALL
    SELECT channel, category, fit, k + 1, t,
           list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN r ELSE
               list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END)
    FROM elimination WHERE k < {COUNT}"""
VIEWS["fitted"] = f"""
    SELECT *, t[{_place(0, COUNT + 1)}] / t[1] - {_dot("[" + ", ".join(f"t[{_place(0, i)}] / t[1]" for i in range(1, COUNT + 1)) + "]", "w")} AS c
    FROM (SELECT channel, category, fit, t, list_transform(m, lambda r, i: r[{COUNT + 1}] / r[i]) AS w
          FROM elimination WHERE k = {COUNT})"""
VIEWS["scored"] = f"""
    SELECT channel, category, w, round_even(avg(abs(e)), 2) AS mae, round_even(sqrt(avg(e * e)), 2) AS rmse,
           round_even(CASE WHEN sum(net_sales) > 0 THEN sum(abs(e)) / sum(net_sales) * 100 ELSE 0 END, 2) AS wape
    FROM (SELECT channel, category, w, net_sales,
                 net_sales - greatest({_dot("[" + ", ".join(FEATURES) + "]", "w")} + c, 0.0::DOUBLE) AS e
          FROM feat_held JOIN fitted USING (channel, category) WHERE is_test AND fit = 'train')
    GROUP BY channel, category, w"""


def _json_number(x: str) -> str:
    """As Java prints doubles: with an exponent from ten million on and below a thousandth."""
    plain, digits = f"CAST(abs({x}) AS VARCHAR)", f"ltrim(rtrim(replace(CAST(abs({x}) AS VARCHAR), '.', ''), '0'), '0')"
    mantissa = f"{digits}[1] || '.' || CASE WHEN length({digits}) > 1 THEN {digits}[2:] ELSE '0' END"
    return f"""(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE
        WHEN abs({x}) >= 1e7 THEN {mantissa} || 'E' || (strpos({plain}, '.') - 2)
        WHEN {x} <> 0 AND abs({x}) < 1e-3 THEN {mantissa} || 'E-' || (length({plain}) - 1 - length({digits}))
        ELSE {plain} END)"""


IMPACTS = " || ',' || ".join(f"""'"{f}":' || {_json_number(f"(round_even(w[{i}], 4) + 0.0)")}""" for i, f in enumerate(FEATURES, 1))
VIEWS["metrics"] = f"""
    SELECT channel, category, mae, rmse, wape,
           '{{"mae":' || {_json_number("mae")} || ',"rmse":' || {_json_number("rmse")} || ',"wape":' || {_json_number("wape")}
           || ',"channel":"' || channel || '","category":"' || category || '","evaluated_at":"2026-01-01 00:00:00","feature_impacts":{{'
           || {IMPACTS} || '}}}}' AS metrics_json
    FROM scored"""
NEXT_INPUTS = """[CAST(isodow(day) - 1 AS DOUBLE), CAST(day(day) AS DOUBLE), CAST(month(day) AS DOUBLE),
    CAST(CASE WHEN isodow(day) IN (6, 7) THEN 1 ELSE 0 END AS DOUBLE),
    CAST(CASE WHEN day(day) IN (1, 15, 30, 31) THEN 1 ELSE 0 END AS DOUBLE),
    CAST(CASE WHEN (month(day), day(day)) IN ((7, 4), (12, 24), (12, 25), (12, 31), (1, 1))
                OR (month(day) = 11 AND day(day) BETWEEN 23 AND 29) THEN 1 ELSE 0 END AS DOUBLE),
    known[-1], known[-2], known[-7], coalesce(known[-14], known[-7]), {week} / 7, mean,
    CASE WHEN len(known) >= 14 THEN sqrt({spread} / (len(known) - 1)) ELSE 0.0::DOUBLE END,
    0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]""".format(
    week=_sum("known[-7:]"), spread=_sum("list_transform(known, lambda x: (x - mean) * (x - mean))")
)
VIEWS["projected"] = f"""
    SELECT channel, category, 0 AS ahead, max(date_day) AS day, list(net_sales ORDER BY date_day) AS known
    FROM feat_held WHERE age <= 14 GROUP BY channel, category
    UNION ALL
    SELECT channel, category, ahead, day, list_append(known, greatest({_dot("inputs", "w")} + c, 0.0::DOUBLE))[-14:]
    FROM (SELECT *, {NEXT_INPUTS} AS inputs
          FROM (SELECT channel, category, ahead + 1 AS ahead, CAST(day + INTERVAL 1 DAY AS DATE) AS day, known,
                       {_sum("known")} / len(known) AS mean FROM projected WHERE ahead < 7))
    JOIN fitted USING (channel, category) WHERE fit = 'whole'"""
VIEWS["future"] = f"""
    SELECT day AS date_day, channel, category, round_even(known[-1], 2) AS forecast_sales,
           'Ridge Multi-Forecast (' || channel || '/' || category || ')' AS model_name, metrics_json, {AS_OF} AS created_at
    FROM projected JOIN metrics USING (channel, category) WHERE ahead > 0"""
VIEWS["naive"] = """
    SELECT channel, category, date_day, cents, lag(cents, 7) OVER (PARTITION BY channel, category ORDER BY date_day)
           AS predicted FROM dense QUALIFY predicted IS NOT NULL"""

VIEWS["vel"] = """
    SELECT *, CASE WHEN customer_id IS NOT NULL THEN count(*) OVER (PARTITION BY customer_id
                 ORDER BY transaction_timestamp RANGE BETWEEN INTERVAL 1 {unit} PRECEDING AND CURRENT ROW) END
              AS velocity FROM baskets"""
VIEWS["vel_day"] = VIEWS["vel"].format(unit="DAY")
VIEWS["vel_hour"] = VIEWS.pop("vel").format(unit="HOUR")

RATIO = """
    SELECT customer_id, sum(lines) AS line_count, coalesce(sum(n), 0) AS return_count,
           CAST(coalesce(sum(n), 0) AS DOUBLE) / CAST(sum(lines) AS DOUBLE) AS return_ratio
    FROM (SELECT customer_id, transaction_id, count(*) AS lines FROM {sales}
          WHERE customer_id IS NOT NULL GROUP BY ALL)
    LEFT JOIN (SELECT transaction_id, count(*) AS n FROM {returns} GROUP BY ALL) USING (transaction_id)
    GROUP BY customer_id"""
VIEWS["basket_ratio"] = RATIO.format(sales="baskets", returns="basket_ret")
VIEWS["profile"] = """
    SELECT customer_id, email, gender FROM members
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY email DESC, gender DESC) = 1"""


def _fraud(unit: str) -> str:
    return f"""
    SELECT *, CASE WHEN fraud_score >= 70 THEN 'High' WHEN fraud_score >= 35 THEN 'Medium' ELSE 'Low' END AS risk_tier
    FROM (SELECT *, least(CASE WHEN net_sales > 1500 THEN 35 WHEN net_sales > 800 THEN 15 ELSE 0 END
                 + CASE WHEN velocity >= 5 THEN 40 WHEN velocity >= 3 THEN 20 ELSE 0 END
                 + CASE WHEN bad_email THEN 15 ELSE 0 END + CASE WHEN bad_gender THEN 10 ELSE 0 END
                 + CASE WHEN many_returns THEN 20 ELSE 0 END, 100) AS fraud_score,
          list_filter([
            CASE WHEN net_sales > 1500 THEN 'High order value of $' || net_sales || ' (exceeds threshold of $1500)'
                 WHEN net_sales > 800 THEN 'Medium-high order value of $' || net_sales END,
            CASE WHEN velocity >= 5 THEN 'High transaction velocity: ' || velocity || ' transactions in the last {unit}'
                 WHEN velocity >= 3 THEN 'Elevated transaction velocity: ' || velocity
                      || ' transactions in the last {unit}' END,
            CASE WHEN bad_email THEN 'Customer profile has invalid/malformed email syntax' END,
            CASE WHEN bad_gender THEN 'Customer profile has unrecognized gender code ''' || gender || '''' END,
            CASE WHEN many_returns THEN 'Customer has a high return frequency ratio ('
                 || CAST(round_even(return_ratio * 100, 0) AS BIGINT) || '%)' END],
            lambda x: x IS NOT NULL) AS factors
          FROM (SELECT v.*, CAST(unit_price * quantity - discount AS DECIMAL(18,2)) AS net_sales, email, gender,
                       return_ratio,
                       coalesce(NOT contains(email, '@example.com') AND contains(email, 'malformed'), false)
                         AS bad_email,
                       coalesce(gender NOT IN ('M', 'F', 'OTHER', 'UNKNOWN'), false) AS bad_gender,
                       coalesce(line_count >= 3 AND return_ratio > 0.4, false) AS many_returns
                FROM vel_{unit} v LEFT JOIN profile USING (customer_id)
                LEFT JOIN basket_ratio USING (customer_id)))"""


VIEWS["scored_day"] = _fraud("day")
VIEWS["scored_hour"] = _fraud("hour")

ORACLE: dict[str, str] = {}


def _needed(sql: str, done: list[str], own: str = "") -> list[str]:
    for name, body in VIEWS.items():
        if name not in (own, *done) and re.search(rf"\b{name}\b", sql):
            _needed(body, done, name)
            if name not in done:
                done.append(name)
    return done


def oracle(name: str, sql: str) -> None:
    needed = _needed(sql, [])
    with_clause = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    recursive = any(re.search(rf"\b{v}\b", VIEWS[v]) for v in needed)
    ORACLE[name] = f"WITH {'RECURSIVE ' * recursive}{with_clause}\n{sql}" if needed else sql


# -- bronze and silver ----------------------------------------------------------------------

oracle(
    "bronze_envelope",
    f"""
    SELECT md5('POS_WEB_APP-transactions-' || id) AS event_id, id AS business_key,
           '{{"id":"' || id || '","transaction_id":"' || transaction_id || '","customer_id":'
           || coalesce('"' || customer_id || '"', 'null') || ',"store_id":"' || store_id || '","channel":"'
           || channel || '","product_id":"' || product_id || '","quantity":' || quantity || ',"unit_price":'
           || coalesce('"' || unit_price || '"', 'null') || ',"discount":"' || discount
           || '","transaction_timestamp":"' || strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') || '"}}'
           AS raw_payload,
           'POS_WEB_APP' AS source_system, 'transactions' AS topic_table, 'C' AS operation_type,
           strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp,
           {AS_OF} AS ingestion_timestamp, '1.0' AS schema_version, 0 AS kafka_partition,
           CAST(0 AS BIGINT) AS kafka_offset, 'run-1' AS pipeline_run_id
    FROM rawtx""",
)
oracle("silver_valid", "SELECT * EXCLUDE (quarantine_reason) FROM tagged WHERE quarantine_reason IS NULL")
oracle("silver_quarantine", "SELECT * FROM tagged WHERE quarantine_reason IS NOT NULL")
oracle("silver_dedup", "SELECT * FROM tx_silver")
oracle("silver_customer_versions", "SELECT * FROM cust_silver")
oracle("silver_audit", "SELECT * FROM audit")
oracle(
    "audit_upsert",
    """
    SELECT * REPLACE (CAST(0 AS BIGINT) AS bronze_count, 100.0::DOUBLE AS quality_score) FROM cust_audit
    UNION ALL SELECT * FROM tx_audit""",
)
oracle(
    "dq_pattern",
    r"""
    SELECT coalesce(CASE WHEN NOT regexp_full_match(email, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+')
                         THEN 'email does not match pattern' END, quarantine_reason, 'valid') AS reason,
           count(*) AS n FROM cust_tagged GROUP BY ALL""",
)
oracle("dq_unique", "SELECT id, count(*) AS n FROM tx GROUP BY id HAVING count(*) > 1")
oracle(
    "dq_freshness",
    """
    SELECT max(ts) AS newest,
           CAST(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts)) AS DOUBLE) / 3.6e9::DOUBLE AS age_hours,
           epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts)) <= 24 * 3600000000 AS is_fresh
    FROM events""",
)
oracle("light_silver", "SELECT * FROM rawtx WHERE quantity > 0 AND unit_price > 0")
oracle(
    "light_silver_customers",
    """
    SELECT id, first_name, last_name, email, phone, gender, state, CAST(birth_date AS VARCHAR) AS birth_date
    FROM rawcust WHERE email LIKE '%@%'""",
)

# -- staging --------------------------------------------------------------------------------

oracle("stg_customers", "SELECT * FROM cust")
oracle("stg_products", "SELECT * FROM prod")
oracle("stg_stores", "SELECT * FROM store")
oracle("stg_transactions", "SELECT * EXCLUDE (id), id AS transaction_line_id FROM tx")
oracle("stg_returns", "SELECT * EXCLUDE (id), id AS return_id FROM ret")
oracle("stg_inventory_movements", "SELECT * EXCLUDE (id), id AS movement_id FROM mov")
oracle("stg_marketing_campaigns", "SELECT * FROM mk")
oracle("stg_support_tickets", "SELECT * FROM tk")

# -- dimensions -----------------------------------------------------------------------------

oracle(
    "dim_date",
    """
    SELECT date_day, CAST(year(date_day) AS INTEGER) AS year, CAST(month(date_day) AS INTEGER) AS month,
           monthname(date_day) AS month_name, CAST(day(date_day) AS INTEGER) AS day,
           CAST(isodow(date_day) AS INTEGER) AS day_of_week, dayname(date_day) AS day_name,
           CAST(quarter(date_day) AS INTEGER) AS quarter, isodow(date_day) IN (6, 7) AS is_weekend
    FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date_day
          FROM (SELECT date_trunc('year', min(o_orderdate)) AS a,
                       date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS b FROM orders))""",
)
VALID_TO_TEXT = "* REPLACE (CAST(valid_to AS VARCHAR) AS valid_to)"
oracle("dim_customer", f"SELECT {VALID_TO_TEXT} FROM dcust")
oracle("dim_product", f"SELECT {VALID_TO_TEXT} FROM dprod")
oracle("dim_product_gapless", f"SELECT {VALID_TO_TEXT} FROM dprod0")
oracle("dim_campaign", f"SELECT {VALID_TO_TEXT} FROM dcamp")
oracle("dim_store", f"SELECT {VALID_TO_TEXT} FROM dstore")
oracle("dim_channel", "SELECT * FROM dchan")
oracle(
    "dim_promotion",
    f"""
    SELECT md5(promotion_id) AS promotion_key, * FROM (
      SELECT DISTINCT {TIER} AS promotion_id,
        CASE WHEN discount = 0 THEN 'No Promotion' WHEN discount <= 5 THEN 'Seasonal Sale (Up to $5)'
             WHEN discount <= 15 THEN 'Loyalty Rewards Tier' ELSE 'Flash Sale Special' END AS promotion_name,
        CAST(CASE WHEN discount = 0 THEN 0 WHEN discount <= 5 THEN 0.10 WHEN discount <= 15 THEN 0.20
             ELSE 0.35 END AS DOUBLE) AS discount_rate FROM tx)""",
)

# -- facts ----------------------------------------------------------------------------------

oracle("fact_sales_line", "SELECT * FROM fsales")
oracle("fact_return_line", "SELECT * FROM fret")
oracle(
    "fact_support_ticket",
    """
    SELECT ticket_id, coalesce(customer_key, md5('CUST-UNKNOWN')) AS customer_key,
           CAST(ticket_timestamp AS DATE) AS date_day, issue_category, status, priority, ticket_timestamp,
           resolution_timestamp,
           CAST(epoch_us(resolution_timestamp) - epoch_us(ticket_timestamp) AS DOUBLE) / 3.6e9::DOUBLE
             AS resolution_time_hours
    FROM tk LEFT JOIN dmember d ON tk.customer_id = d.customer_id AND ticket_timestamp >= valid_from
                               AND ticket_timestamp < valid_to""",
)
oracle(
    "fact_marketing_daily",
    """
    SELECT m.campaign_id, coalesce(campaign_key, md5('CAMP-UNKNOWN')) AS campaign_key,
           campaign_date AS date_day, cost, impressions, clicks, conversions,
           CASE WHEN clicks > 0 THEN CAST(conversions AS DOUBLE) / CAST(clicks AS DOUBLE) ELSE 0 END
             AS click_to_conv_rate
    FROM mk m LEFT JOIN dcamp c ON m.campaign_id = c.campaign_id AND campaign_date >= valid_from
                               AND campaign_date < valid_to""",
)
oracle(
    "fact_inventory_movement",
    """
    SELECT m.id AS movement_id, coalesce(product_key, md5('PRD-UNKNOWN')) AS product_key,
           coalesce(store_key, md5('ST-UNKNOWN')) AS store_key, movement_type, quantity,
           CAST(movement_timestamp AS DATE) AS date_day, movement_timestamp
    FROM mov m
    LEFT JOIN dprod p ON m.product_id = p.product_id AND movement_timestamp >= p.valid_from
                     AND movement_timestamp < p.valid_to
    LEFT JOIN dstore s ON m.store_id = s.store_id AND movement_timestamp >= s.valid_from
                      AND movement_timestamp < s.valid_to""",
)


BOUNDS = "(SELECT min(date_day) AS first, max(date_day) AS last FROM regmov)"


def _snapshot(start: str, end: str, opening: bool = False) -> str:
    moved = "greatest(date_day, a)" if opening else "date_day"
    return f"""
    SELECT md5(concat(CAST(date_day AS VARCHAR), '_', product_key, '_', store_key)) AS snapshot_key, date_day,
           product_key, store_key,
           CAST(sum(coalesce(net, 0)) OVER (PARTITION BY product_key, store_key ORDER BY date_day
                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock_on_hand
    FROM (SELECT product_key, store_key, CAST(d AS DATE) AS date_day
          FROM (SELECT DISTINCT product_key, store_key FROM regmov),
               (SELECT unnest(generate_series({start}, {end}, INTERVAL 1 DAY)) AS d FROM {BOUNDS}))
    LEFT JOIN (SELECT product_key, store_key, {moved} AS date_day, sum(quantity) AS net
               FROM (SELECT *, CAST({start} AS DATE) AS a FROM regmov, {BOUNDS}) GROUP BY ALL)
    USING (product_key, store_key, date_day)"""


oracle("fact_inventory_daily_snapshot", _snapshot("first", "last"))
oracle("inventory_snapshot_opening", _snapshot("last - 365", "last", opening=True))
DAILY = """
    SELECT CAST(movement_timestamp AS DATE) AS date_day, product_id AS product_key, store_id AS store_key,
           CAST(sum(quantity) AS BIGINT) AS net_movement FROM mov GROUP BY ALL"""
oracle("daily_movements", DAILY)
oracle(
    "stock_changes",
    f"""
    SELECT *, CAST(sum(net_movement) OVER (PARTITION BY product_key, store_key ORDER BY date_day) AS BIGINT)
              AS stock_on_hand FROM ({DAILY})""",
)
oracle(
    "snapshot_range",
    f"""
    SELECT product_key, store_key, CAST(d AS DATE) AS date_day,
           CAST(coalesce(sum(net_movement) FILTER (date_day <= d), 0) AS BIGINT) AS stock_on_hand
    FROM ({DAILY}), (SELECT CAST(date_trunc('month', max(movement_timestamp)) AS DATE) AS turn FROM mov),
         (SELECT unnest(generate_series(-3, 3)) AS ahead), LATERAL (SELECT turn + CAST(ahead AS INTEGER) AS d)
    WHERE date_day <= turn + 3 GROUP BY ALL""",
)
oracle(
    "layer_key_changes",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderstatus = 'P' THEN 'changed' END AS note FROM orders WHERE o_custkey % 7 <> 0""",
)
oracle(
    "calendar_fill",
    f"""
    SELECT product_key, store_key, date_day, CAST(coalesce(net, 0) AS BIGINT) AS net_movement
    FROM (SELECT product_key, store_key, CAST(d AS DATE) AS date_day
          FROM (SELECT DISTINCT product_key, store_key FROM regmov),
               (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY)) AS d FROM {BOUNDS}))
    LEFT JOIN (SELECT product_key, store_key, date_day, sum(quantity) AS net FROM regmov GROUP BY ALL)
    USING (product_key, store_key, date_day)""",
)
VIEWS["happened"] = """
    SELECT customer_id, e.kind AS activity_type, e.at AS activity_timestamp,
           CAST(e.at AS DATE) AS date_day, MAP {
               'PURCHASE': 'Completed a transaction: ', 'RETURN': 'Returned product in transaction: ', 'SUPPORT': 'Opened support ticket: '
           }[e.kind] || e.what AS activity_details
    FROM (
        SELECT customer_id, unnest(list_prepend({'kind': 'PURCHASE', 'at': transaction_timestamp, 'what': transaction_id}, coalesce(backs, []))) AS e
        FROM tx LEFT JOIN (
            SELECT transaction_id, list({'kind': 'RETURN', 'at': return_timestamp, 'what': transaction_id}) AS backs FROM ret GROUP BY transaction_id
        ) USING (transaction_id)
        UNION ALL SELECT customer_id, {'kind': 'SUPPORT', 'at': ticket_timestamp, 'what': ticket_id || ' - ' || issue_category} FROM tk
    ) WHERE customer_id IS NOT NULL"""
oracle(
    "fact_customer_activity",
    f"""
    SELECT x.* EXCLUDE (customer_id), md5(concat_ws('_', x.customer_id, CAST(activity_timestamp AS VARCHAR), activity_type)) AS activity_key,
           {_held("dcust", "customer_key", "activity_timestamp", "md5('CUST-UNKNOWN')")} AS customer_key
    FROM happened x {_version("dcust", "customer_id", "activity_timestamp")}""",
)
oracle(
    "pit_join_revenue",
    """
    SELECT channel_name, CAST(date_trunc('month', date_day) AS DATE) AS month, sum(net_sales) AS revenue,
           sum(gross_margin) AS gross_margin, count(*) AS lines
    FROM fsales JOIN dchan USING (channel_key) GROUP BY ALL""",
)
oracle(
    "pit_join_versions",
    """
    SELECT event_id, usr AS "user", ts, last_name AS version, customer_key
    FROM ev LEFT JOIN dmember d ON usr = d.customer_id AND ts >= valid_from AND ts < valid_to
    WHERE event_type = 'purchase'""",
)

# -- keyed latest-wins ----------------------------------------------------------------------

oracle(
    "upsert_by_key",
    """
    SELECT product_id AS id, name, price FROM catalog WHERE product_id NOT IN (SELECT product_id FROM prod WHERE updated_at >= '2001-01-01')
    UNION ALL SELECT product_id, name, price FROM prod WHERE updated_at >= '2001-01-01'""",
)
oracle(
    "delete_keys",
    """
    SELECT product_id AS id, name, price FROM catalog
    WHERE product_id NOT IN (SELECT product_id FROM prod WHERE updated_at >= '2001-01-01')""",
)
oracle(
    "latest_by_key",
    """
    SELECT product_id AS id, sku, name, category, price, cost, CAST(updated_at AS VARCHAR) AS event_timestamp FROM prod
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY updated_at DESC, sku DESC, name DESC,
                               category DESC, price DESC, cost DESC) = 1""",
)

# -- serving queries ------------------------------------------------------------------------


def _overview(sales: str, where: str, returns: str, quality: str) -> str:
    return f"""
    SELECT revenue, CASE WHEN revenue > 0 THEN round_even(CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE)
                         * 100, 2) ELSE 0 END AS margin_pct,
           CASE WHEN revenue > 0 THEN round_even(CAST(refunds AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 2)
                ELSE 0 END AS return_rate_pct, active_customers, round_even({quality}, 1) AS dq_score, alert_count
    FROM (SELECT sum({NET}) AS revenue, count(DISTINCT customer_id) AS active_customers,
                 count(*) FILTER (quantity < 0) AS alert_count FROM {sales} {where}),
         (SELECT sum(quantity * coalesce(cost, 0)) AS cost
          FROM {sales} LEFT JOIN catalog USING (product_id) {where}),
         (SELECT coalesce(sum(refund_amount), 0) AS refunds FROM ret {returns})"""


oracle("overview_kpis", _overview("tx", "", "", "(SELECT avg(quality_score) FROM audit)"))
oracle(
    "overview_channel",
    _overview(
        "rawtx",
        "WHERE channel = 'POS'",
        "WHERE transaction_id IN (SELECT transaction_id FROM rawtx WHERE channel = 'POS')",
        "98.4::DOUBLE",
    ),
)


def _trend(where: str, channel: str, category: str) -> str:
    return f"""
    SELECT * FROM (
      SELECT date_day, CAST(coalesce(actual, 0) AS DECIMAL(38,2)) AS actual, coalesce(forecast, 0::DOUBLE) AS forecast
      FROM (SELECT CAST(transaction_timestamp AS DATE) AS date_day, sum({NET}) AS actual
            FROM tx LEFT JOIN catalog USING (product_id) {where} GROUP BY ALL)
      FULL JOIN (SELECT date_day, forecast_sales AS forecast FROM future
                 WHERE channel = '{channel}' AND category = '{category}') USING (date_day)
      ORDER BY date_day DESC LIMIT 20)"""


oracle("sales_trend", _trend("", "ALL", "ALL"))
oracle("sales_trend_slice", _trend("WHERE category = 'PROMO'", "ALL", "PROMO"))
oracle("sales_trend_fallback", _trend("WHERE category = 'PROMO' AND channel = 'POS'", "ALL", "ALL"))
oracle(
    "export_forecast",
    f"""
    SELECT CAST(date_day AS VARCHAR) AS "Date", actual AS "Actual Sales", forecast AS "Forecast Sales"
    FROM ({_trend("", "ALL", "ALL")})""",
)
VIEWS["rfm"] = """
    SELECT customer_id, ((SELECT epoch_us(max(ts)) FROM ordsales) - epoch_us(max(ts))) // 86400000000 AS recency,
           count(DISTINCT transaction_id) AS frequency, sum(net) AS monetary
    FROM ordsales WHERE customer_id IS NOT NULL GROUP BY customer_id"""
VIEWS["segments"] = """
    SELECT *, CASE WHEN recency <= 7 AND frequency >= 5 AND monetary >= 1000 THEN 'Champions'
                   WHEN recency <= 14 AND frequency >= 3 THEN 'Loyal Customers'
                   WHEN recency > 20 AND frequency >= 3 THEN 'At Risk'
                   WHEN recency <= 10 AND frequency = 1 THEN 'New Customers' ELSE 'Hibernating' END AS segment
    FROM rfm"""
oracle("rfm_segments", "SELECT * FROM segments")
oracle(
    "rfm_summary",
    """
    SELECT segment, count(*) AS customers,
           round_even((SELECT count(*) FILTER (frequency > 1) * 100.0::DOUBLE / count(*) FROM segments), 2)
             AS retention_rate,
           (SELECT count(*) FROM segments) AS total_scored FROM segments GROUP BY segment""",
)
VIEWS["alerts"] = """
    SELECT product_id, store_id, stock_on_hand, round_even(rate, 2) AS avg_daily_sales,
           round_even(stock / rate, 1) AS days_of_supply,
           round_even(rate * 30 / (rate * 30 + stock) * 100, 1) AS sell_through_pct,
           CASE WHEN stock / rate < 5 THEN 'High' WHEN stock / rate < 15 THEN 'Medium' ELSE 'Low' END AS risk_tier,
           CAST(round_even(greatest(rate * 30 - stock, 0), 0) AS BIGINT) AS reorder_suggestion,
           name, price, store_name
    FROM (SELECT product_id, store_id, CAST(greatest(sum(quantity), 0) AS BIGINT) AS stock_on_hand,
                 CAST(greatest(sum(quantity), 0) AS DOUBLE) AS stock,
                 coalesce(CAST(sum(abs(quantity)) FILTER (movement_type = 'SALE') AS DOUBLE) / 30.0::DOUBLE,
                          0.1::DOUBLE) AS rate
          FROM mov GROUP BY ALL)
    LEFT JOIN catalog USING (product_id) LEFT JOIN store USING (store_id)"""
oracle("inventory_alerts", "SELECT * FROM alerts")
oracle(
    "export_inventory",
    """
    SELECT coalesce(store_name, store_id) AS "Store", product_id AS "Product ID", coalesce(name, '') AS "Product Name",
           stock_on_hand AS "Stock Level", avg_daily_sales AS "Avg Daily Sales", sell_through_pct AS "Sell Through %",
           days_of_supply AS "Days of Supply", risk_tier AS "Risk Status",
           reorder_suggestion AS "Reorder Suggestion" FROM alerts""",
)
HEALTH = """
    SELECT *, CASE WHEN NOT reconciled THEN 'Failed' WHEN quarantine_count > 0 THEN 'Degraded' ELSE 'Healthy' END
              AS status,
           CASE WHEN quarantine_count > 0 THEN quarantine_count
                || ' records failed null checks or format enums and were quarantined.' END AS incident FROM audit"""
oracle("run_health", HEALTH)
oracle("incidents", f"SELECT * FROM ({HEALTH}) WHERE quarantine_count > 0")
oracle(
    "bi_measures",
    """
    SELECT date_day, total_revenue, total_cost, total_refund, forecast_sales,
           CASE WHEN total_revenue <> 0 THEN CAST(total_revenue - total_cost AS DOUBLE) / CAST(total_revenue AS DOUBLE)
                ELSE 0 END AS gross_margin_pct,
           CASE WHEN total_revenue <> 0 THEN CAST(total_refund AS DOUBLE) / CAST(total_revenue AS DOUBLE) ELSE 0 END
             AS return_rate_pct,
           CAST(total_revenue AS DOUBLE) - forecast_sales AS forecast_variance
    FROM (SELECT date_day, coalesce(rev, 0::DECIMAL(38,2)) AS total_revenue,
                 coalesce(cst, 0::DECIMAL(38,2)) AS total_cost,
                 coalesce(ref, 0::DECIMAL(38,2)) AS total_refund, coalesce(fc, 0::DOUBLE) AS forecast_sales
          FROM (SELECT date_day, sum(net_sales) AS rev, sum(total_cost) AS cst FROM fsales GROUP BY ALL)
          FULL JOIN (SELECT date_day, sum(refund_amount) AS ref FROM fret GROUP BY ALL) USING (date_day)
          FULL JOIN (SELECT date_day, forecast_sales AS fc FROM future
                     WHERE channel = 'ALL' AND category = 'ALL') USING (date_day))""",
)
oracle(
    "current_stock",
    """
    SELECT (SELECT max(date_day) FROM regmov) AS date_day, store_key, CAST(sum(quantity) AS BIGINT) AS current_stock
    FROM regmov GROUP BY ALL""",
)
oracle(
    "revenue_by_channel",
    "SELECT channel_name, sum(net_sales) AS revenue FROM fsales JOIN dchan USING (channel_key) GROUP BY ALL",
)
oracle("customers_by_state", "SELECT state, count(DISTINCT customer_id) AS customers FROM cust GROUP BY ALL")

# -- fraud ----------------------------------------------------------------------------------


def _scores(unit: str) -> str:
    return f"""
    SELECT id AS transaction_line_id, transaction_id, customer_id, transaction_timestamp, net_sales, fraud_score,
           risk_tier,
           '["' || array_to_string(CASE WHEN len(factors) = 0 THEN ['Normal purchase indicators'] ELSE factors END,
                                   '","') || '"]' AS risk_factors,
           '1.0.0' AS score_version, CASE WHEN risk_tier = 'Low' THEN 'Approved' ELSE 'Pending' END AS review_status,
           {AS_OF} AS created_at
    FROM scored_{unit}"""


oracle("fraud_scores", _scores("day"))
oracle("fraud_scores_hourly", _scores("hour"))
oracle(
    "fraud_queue",
    """
    SELECT id AS transaction_line_id, CAST(unnest(range(len(factors))) AS INTEGER) AS position,
           unnest(factors) AS risk_factor FROM scored_day WHERE risk_tier = 'High'""",
)
oracle(
    "fraud_review",
    """
    SELECT id AS transaction_line_id, transaction_id, fraud_score,
           coalesce(status, CASE WHEN risk_tier = 'Low' THEN 'Approved' ELSE 'Pending' END) AS review_status
    FROM scored_day LEFT JOIN (
      SELECT basket AS transaction_id,
             CASE WHEN k < 40 THEN 'Approved' WHEN k < 80 THEN 'Dismissed' ELSE 'Pending' END AS status
      FROM ev WHERE event_type = 'click'
      QUALIFY row_number() OVER (PARTITION BY basket ORDER BY ts DESC, status DESC) = 1) USING (transaction_id)""",
)
oracle("velocity_count", "SELECT id, customer_id, transaction_timestamp, velocity FROM vel_day")
oracle(
    "time_since_previous",
    """
    SELECT id, customer_id, transaction_timestamp,
           CASE WHEN customer_id IS NOT NULL THEN CAST(epoch_us(transaction_timestamp) - lag(epoch_us(transaction_timestamp))
             OVER (PARTITION BY customer_id ORDER BY transaction_timestamp, id) AS DOUBLE) / 1e6::DOUBLE END
             AS seconds_since_previous FROM baskets""",
)
oracle("return_ratio", RATIO.format(sales="tx", returns="ret"))
oracle(
    "returned_quantity",
    """
    SELECT id, transaction_id, product_id, quantity, CAST(coalesce(q, 0) AS BIGINT) AS returned_qty
    FROM tx LEFT JOIN (SELECT transaction_id, sum(quantity) AS q FROM ret GROUP BY ALL) USING (transaction_id)""",
)

# -- forecast -------------------------------------------------------------------------------

oracle("sales_grouping_sets", "SELECT * FROM slices")
oracle("daily_dense_series", "SELECT * FROM dense")
oracle("forecast_features", "SELECT * FROM feat")
oracle(
    "forecast_holdout",
    """
    SELECT channel, category, date_day, row_number() OVER (PARTITION BY channel, category ORDER BY date_day DESC)
             <= least(7, count(*) OVER (PARTITION BY channel, category) // 3) AS is_test FROM feat""",
)
oracle(
    "forecast_gram",
    "\nUNION ALL\n".join(
        f"SELECT channel, category, '{a}' AS left_column, '{b}' AS right_column,"
        f" sum(CAST({a} AS DECIMAL(19,4)) * CAST({b} AS DECIMAL(19,4))) AS total FROM feat GROUP BY channel, category"
        for a, b in combinations_with_replacement([*FEATURES, "net_sales"], 2)
    ),
)
oracle(
    "forecast_accuracy",
    """
    SELECT channel, category, CAST(printf('%.6e', mae) AS DOUBLE) AS mae, CAST(printf('%.6e', rmse) AS DOUBLE) AS rmse,
           CAST(printf('%.6e', wape) AS DOUBLE) AS wape
    FROM (SELECT channel, category, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
                 CASE WHEN sum(a) > 0 THEN sum(abs(e)) / sum(a) * 100 ELSE 0 END AS wape
          FROM (SELECT channel, category, CAST(cents AS DOUBLE) / 100 AS a,
                       CAST(cents AS DOUBLE) / 100 - CAST(predicted AS DOUBLE) / 100 AS e FROM naive) GROUP BY ALL)""",
)
oracle("forecast_metrics", "SELECT * FROM metrics")
oracle("forecast_7d", "SELECT * FROM future")
oracle("trend_metrics", "SELECT mae, rmse, wape FROM metrics WHERE channel = 'POS' AND category = 'ALL'")

# -- uploads --------------------------------------------------------------------------------

oracle(
    "harmonize_upload",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS customer_id,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price, o_orderpriority AS channel, 1 AS quantity,
           0.0::DOUBLE AS discount,
           CASE WHEN o_orderpriority = '5-LOW' THEN '2026-01-01 00:00:00'
                ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS transaction_timestamp
    FROM orders""",
)
oracle(
    "upload_ids",
    """
    SELECT 'regenerated' AS upload, count(*) AS n, count(*) AS ids FROM lineitem
    UNION ALL SELECT 'kept', count(*), count(DISTINCT o_orderkey) FROM orders""",
)

# -- privacy --------------------------------------------------------------------------------


def _mask(column: str) -> str:
    return f"substr({column}, 1, 1) || '***' || substr({column}, 5)"


USER = "split_part(email, '@', 1)"
EMAIL = f"{_mask(USER)} || '@' || split_part(email, '@', 2)"
PHONE = "'***-***-' || right(phone, 4)"
oracle(
    "masked_customers",
    f"""
    SELECT customer_key, customer_id, {_mask('first_name')} AS first_name_masked, {_mask('last_name')} AS last_name_masked,
           {USER} AS email_user, {EMAIL} AS email_masked, {PHONE} AS phone_masked, gender, state, birth_date,
           valid_from, CAST(valid_to AS VARCHAR) AS valid_to, is_current FROM dcust""",
)
oracle(
    "mask_pii",
    f"""
    SELECT customer_id AS id, {_mask('first_name')} AS first_name, {_mask('last_name')} AS last_name, {EMAIL} AS email,
           {PHONE} AS phone, gender, state, CAST(date_trunc('month', birth_date) AS DATE) AS birth_date,
           CAST(updated_at AS VARCHAR) AS event_timestamp FROM cust""",
)
oracle(
    "forget_customers",
    """
    SELECT d.* REPLACE (CASE WHEN hit THEN 'DELETED_USER' ELSE first_name END AS first_name,
                        CASE WHEN hit THEN 'DELETED_USER' ELSE last_name END AS last_name,
                        CASE WHEN hit THEN 'forgotten@compliance.com' ELSE email END AS email,
                        CASE WHEN hit THEN '' ELSE phone END AS phone, CAST(valid_to AS VARCHAR) AS valid_to)
    FROM (SELECT * FROM dcust) d
    JOIN (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_acctbal < 0 AS hit FROM customer) USING (customer_id)""",
)
KEY = b"a fixed key for the checks".ljust(64, b"\0")


def _token(value: str) -> str:
    inner, outer = (bytes(b ^ pad for b in KEY).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({value}))))"


oracle(
    "tokenized_customers",
    f"""
    SELECT customer_id AS id, CAST(updated_at AS VARCHAR) AS event_timestamp, {_token("lower(email)")} AS email,
           {_token("phone")} AS phone, gender FROM cust""",
)
oracle(
    "reidentified_customers",
    """
    SELECT c.customer_id AS id, CAST(updated_at AS VARCHAR) AS event_timestamp,
           CASE WHEN c.email IN (SELECT email FROM cust WHERE CAST(customer_id AS BIGINT) % 3 <> 0) THEN lower(c.email) END AS email,
           CASE WHEN c.phone IN (SELECT phone FROM cust WHERE CAST(customer_id AS BIGINT) % 3 <> 0) THEN c.phone END AS phone FROM cust c""",
)
oracle(
    "extract_since",
    """
    WITH o AS (
        SELECT *, o_orderdate BETWEEN turn - INTERVAL 20 DAY AND turn AND o_orderkey % 3 = 0 AS late
        FROM orders, (SELECT TIMESTAMP '1998-06-01' AS turn)
    )
    SELECT CAST(o_orderkey AS VARCHAR) AS business_key, o_orderstatus AS status,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS event_timestamp,
           CASE WHEN o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM o WHERE o_orderdate < turn AND NOT late)
                THEN 'b' ELSE 'a' END AS pipeline_run_id FROM o
    UNION ALL
    SELECT CAST(o_orderkey AS VARCHAR), 'X', strftime(o_orderdate + INTERVAL 3000 DAY, '%Y-%m-%d %H:%M:%S'), 'b'
    FROM o WHERE o_orderstatus = 'P'""",
)
oracle(
    "birth_month",
    """
    SELECT customer_id AS id, CAST(updated_at AS VARCHAR) AS event_timestamp,
           CAST(date_trunc('month', birth_date) AS DATE) AS m FROM cust""",
)

# -- streaming ------------------------------------------------------------------------------

oracle("layer_versions", "SELECT id, customer_id, quantity, unit_price, transaction_timestamp FROM tx")
oracle(
    "quarantine_runs",
    """
    SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'first' ELSE 'second' END AS run_id
    FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
for _name in ("csv_upload", "json_upload"):
    oracle(
        _name,
        """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority || ',' || chr(10) || o_orderstatus AS note,
               CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
    )
oracle(
    "upload_merge",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id,
           CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
           CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey AS VARCHAR) END AS store_id,
           CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority ELSE 'WEBSITE' END AS channel,
           CAST(NULL AS VARCHAR) AS product_id,
           CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderstatus = 'P' THEN NULL ELSE 3 END AS quantity,
           CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 100 END AS DECIMAL(18,2)) AS unit_price,
           CAST(0 AS DECIMAL(18,2)) AS discount, CAST(o_orderdate AS TIMESTAMP) AS transaction_timestamp
    FROM orders""",
)
oracle(
    "cdc_envelope",
    """
    SELECT event_id AS kafka_offset, CAST(user_id AS VARCHAR) AS business_key,
           CASE event_type WHEN 'signup' THEN 'C' WHEN 'error' THEN 'D' ELSE 'U' END AS operation_type,
           md5('CORE-accounts-' || user_id) AS event_id FROM events""",
)
oracle(
    "stream_dedup",
    """
    SELECT event_id, CAST(user_id AS VARCHAR) AS "user", event_type,
           CASE WHEN event_id % 3 = 0 THEN value ELSE value + 1 END AS value,
           CASE WHEN event_id % 3 = 0 THEN ts ELSE ts + INTERVAL 1 DAY END AS ts FROM events""",
)
oracle("stream_silver", "SELECT * FROM tx_silver")
oracle("stream_compacted", "SELECT * FROM tx_silver")
oracle(
    "stream_quarantine",
    "SELECT quarantine_reason, count(*) AS n FROM tagged WHERE quarantine_reason IS NOT NULL GROUP BY ALL",
)
CDC = """
    SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events)
    UNION ALL
    SELECT user_id, CAST(value AS DECIMAL(18,2)) FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1 AND event_type <> 'error'"""
oracle("cdc_apply", CDC)
oracle("cdc_stream", CDC)
oracle(
    "bronze_event_time",
    """
    SELECT topic_table, CAST(CAST(t AS DATE) AS VARCHAR) AS day, count(*) AS n
    FROM (SELECT 'transactions' AS topic_table, transaction_timestamp AS t FROM rawtx
          UNION ALL SELECT 'customers', updated_at FROM rawcust
          UNION ALL SELECT 'support_tickets', ticket_timestamp FROM tk) GROUP BY ALL""",
)
oracle(
    "bronze_marketing",
    """
    SELECT campaign_id AS business_key, CAST(campaign_date AS VARCHAR) AS event_timestamp,
           '2026-01-01 00:00:00' AS ingested, 'MARKETING' AS source_system FROM mk""",
)
