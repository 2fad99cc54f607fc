"""Oracle SQL building blocks: the same tables as the adapters, written for DuckDB.

``oracle(body)`` puts the common table expressions a query names (and those they need) in front of it.
"""

from __future__ import annotations

import re

from opslens import fixed_values as fv

RETAIL_AS_OF = "2001-06-30"
SPANS_AS_OF = "2024-01-30"


def draw(key: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{salt}'), 1, 8) AS BIGINT)"


def draw_int(key: str, salt: str, low: int, high: int) -> str:
    return f"({low} + {draw(key, salt)} % {high - low + 1})"


def draw_dec(key: str, salt: str, low: str, high: str, places: int, precision: int) -> str:
    unit = 10**places
    first, last = round(float(low) * unit), round(float(high) * unit)
    return f"CAST({draw_int(key, salt, first, last)} / {float(unit)} AS DECIMAL({precision},{places}))"


def pick(index: str, values, kind: str = "VARCHAR") -> str:
    whens = " ".join(f"WHEN {i} THEN {quote(v) if kind == 'VARCHAR' else f'CAST({v} AS {kind})'}" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def quote(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def fix(value: str, places: int) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def ratio(num: str, den: str, places: int, scale: float = 1) -> str:
    return fix(f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) * {float(scale)}", places)


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def code(prefix: str, number: str, width: int) -> str:
    return f"'{prefix}' || lpad(CAST({number} AS VARCHAR), CAST(greatest({width}, length(CAST({number} AS VARCHAR))) AS INTEGER), '0')"


def tier(position: str, total: str) -> str:
    return (
        f"CASE WHEN {position} * 100 <= {total} * {fv.FLAGSHIP_SHARE_PCT} THEN 'Flagship' "
        f"WHEN {position} * 100 <= {total} * {fv.UNDERPERFORMING_SHARE_PCT} THEN 'Underperforming' ELSE 'Average' END"
    )


def multiplier(name: str, key: str) -> str:
    r = {k: draw_dec(key, "multiplier", *v, 2, 4) for k, v in fv.TIER_MULTIPLIER_RANGE.items()}
    return (
        f"CASE {name} WHEN 'Flagship' THEN {r['Flagship']} WHEN 'Underperforming' THEN {r['Underperforming']} "
        f"ELSE {r['Average']} END"
    )


def wage(region: str, key: str) -> str:
    bands = " ".join(f"WHEN '{r}' THEN {draw_dec(key, 'wage', *b, 2, 5)}" for r, b in fv.WAGE_BANDS.items())
    return f"CASE {region} {bands} ELSE {draw_dec(key, 'wage', *fv.WAGE_DEFAULT, 2, 5)} END"


def popularity(rank: str) -> str:
    return f"CAST(ROUND(CAST({fv.POPULARITY_TOP}::DOUBLE / (1.0::DOUBLE + {fv.POPULARITY_DECAY}::DOUBLE * ({rank} - 1)) AS DECIMAL(38,10)), 3) AS DECIMAL(6,3))"


_A = f"DATE '{RETAIL_AS_OF}'"
_SLOT = "(p_partkey % 8)"
_MONTH0 = "DATE '1999-07-01'"
_RATE = pick("l_partkey % 8", [fv.RETURN_RATE_PCT[c] for c in fv.CATEGORIES], "BIGINT")
_SALE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_REVENUE = "CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))"
_PROMO_ROWS = ", ".join(
    f"({d}, {quote(n)}, CAST({v} AS DECIMAL(3,1)), CAST({x} AS DECIMAL(4,2)))" for d, n, v, x in fv.PROMOS
)

CTES: dict[str, str] = {
    "n_stores": "SELECT COUNT(*) AS n FROM supplier",
    "stores_base": f"""
        SELECT s_suppkey + 1 AS store_id, {code('STORE-', '(s_suppkey + 1)', 4)} AS store_name, r_name AS region,
               {pick('r_regionkey', fv.REGION_WEIGHTS, 'DECIMAL(4,2)')} AS region_weight,
               {pick('((s_suppkey // 5) % 5)', fv.STORE_TYPES)} AS store_type,
               8000 + (s_suppkey + 1) * 37 % 37001 AS sq_ft,
               {_A} - CAST({draw_int('(s_suppkey + 1)', 'opened', 365, 3650)} AS INTEGER) AS opened_date,
               {tier('(s_suppkey + 1)', '(SELECT n FROM n_stores)')} AS performance_tier
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "stores": f"""
        SELECT *, {multiplier('performance_tier', 'store_id')} AS performance_multiplier,
               {draw_dec('store_id', 'trend', *fv.TREND_PCT_RANGE, 1, 4)} AS annual_trend_pct
        FROM stores_base""",
    "products_base": f"""
        SELECT p_partkey + 1 AS product_id, {code('SKU-', '(p_partkey + 1)', 5)} AS sku, p_name AS product_name,
               {pick(_SLOT, fv.CATEGORIES)} AS category, {pick('(p_partkey % 4)', fv.SUBCATEGORIES)} AS subcategory,
               CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * 0.6, 2) AS DECIMAL(18,2)) AS unit_cost,
               CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
               {pick(_SLOT, [n for n, _ in fv.SUPPLIERS])} AS supplier,
               greatest(1, CAST(ROUND({pick(_SLOT, [d for _, d in fv.SUPPLIERS], 'INTEGER')}
                    * {draw_int('(p_partkey + 1)', 'lead', *fv.LEAD_FACTOR_PCT_RANGE)} / 100.0) AS INTEGER)) AS lead_time_days
        FROM part""",
    "products": f"""
        SELECT *, {popularity('popularity_rank')} AS popularity_multiplier
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {draw('product_id', 'popularity')}, product_id) AS popularity_rank
              FROM products_base)""",
    "promo_calendar": f"""
        SELECT {_A} - day_offset AS promo_date, promo_name, volume_multiplier, extra_discount
        FROM (VALUES {_PROMO_ROWS}) AS p(day_offset, promo_name, volume_multiplier, extra_discount)""",
    "sales_base": f"""
        SELECT {_SALE_ID} AS sale_id, l_suppkey + 1 AS store_id, l_partkey + 1 AS product_id,
               CAST(l_shipdate AS DATE) AS sale_date, CAST(l_quantity AS INTEGER) AS units_sold,
               CAST(l_discount AS DECIMAL(4,2)) AS discount_pct,
               CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'Online' ELSE 'In-Store' END AS channel,
               {_REVENUE} AS revenue, l_shipdate AS created_at, l_linenumber, l_orderkey, l_partkey, l_returnflag
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
    "daily_sales": """
        SELECT sale_id, store_id, product_id, sale_date, units_sold, discount_pct, channel, promo_name, revenue, created_at
        FROM sales_base LEFT JOIN promo_calendar ON promo_date = sale_date""",
    "returns": f"""
        SELECT 'R-' || sale_id || '-' || n AS return_id, sale_id, store_id, product_id, sale_date,
               sale_date + CAST(1 + l_orderkey % 14 AS INTEGER) AS return_date,
               {pick('l_partkey % 5', fv.RETURN_REASONS)} AS return_reason,
               CAST(ROUND(revenue * CAST((85 + l_orderkey % 16) / 100.0 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS refund_amount
        FROM sales_base JOIN (VALUES (1), (2)) AS c(n) ON n = 1 OR l_linenumber = 1
        WHERE l_returnflag = 'R'
          AND {draw('sale_id', 'return')} * 100
              < ({_RATE} + CASE WHEN channel = 'Online' THEN {fv.RETURN_ONLINE_UPLIFT_PCT} ELSE 0 END) * 5 * 4294967296""",
    "months24": f"SELECT CAST(unnest(generate_series({_MONTH0}, DATE '2001-06-01', INTERVAL 1 MONTH)) AS DATE) AS period_month",
    "sales_targets": f"""
        SELECT g.store_id, period_month,
               CAST((COALESCE(CAST(rev * 100 AS BIGINT), 0) * share * 2 + 2400) // 4800 / 100.0 AS DECIMAL(18,2)) AS target_revenue,
               CAST((COALESCE(CAST(units AS BIGINT), 0) * share * 2 + 2400) // 4800 AS INTEGER) AS target_units
        FROM (SELECT s_suppkey + 1 AS store_id, period_month,
                     75 + {draw("(CAST(s_suppkey + 1 AS VARCHAR) || '-' || CAST(period_month AS VARCHAR))", 'target')} % 50 AS share
              FROM supplier, months24) g
        LEFT JOIN (SELECT store_id, SUM(revenue) AS rev, SUM(units_sold) AS units FROM sales_base
                   WHERE sale_date BETWEEN {_MONTH0} AND {_A} GROUP BY store_id) m USING (store_id)""",
    "inventory": f"""
        SELECT snapshot_id, store_id, product_id, snapshot_date,
               CAST({draw('snapshot_id', 'on_hand')} % 500 AS INTEGER) AS units_on_hand,
               CAST(20 + {draw('snapshot_id', 'reorder')} % 61 AS INTEGER) AS reorder_point,
               CAST({draw('snapshot_id', 'supply')} % 600 / 10.0 AS DECIMAL(6,1)) AS days_of_supply,
               CAST({draw('snapshot_id', 'on_order')} % 151 AS INTEGER) AS units_on_order
        FROM (SELECT (p_partkey + 1) || '-' || ((p_partkey * 4 + i) % n + 1) || '-' || CAST(d AS VARCHAR) AS snapshot_id,
                     (p_partkey * 4 + i) % n + 1 AS store_id, p_partkey + 1 AS product_id, d AS snapshot_date
              FROM part, n_stores, (VALUES (0), (1), (2), (3)) AS k(i),
                   (SELECT CAST(unnest(generate_series({_A} - 49, {_A}, INTERVAL 7 DAY)) AS DATE) AS d))""",
    "staff_shifts": f"""
        SELECT shift_id, store_id, shift_date, shift_type,
               CAST(5 + {draw('shift_id', 'headcount')} % 10 AS INTEGER) AS headcount,
               CAST(40 + {draw('shift_id', 'hours')} % 73 AS INTEGER) AS hours_worked,
               {wage("CASE region WHEN 'AMERICA' THEN 'West' WHEN 'EUROPE' THEN 'Northeast' END", 'shift_id')} AS hourly_wage
        FROM (SELECT store_id || '-' || CAST(d AS VARCHAR) || '-' || t AS shift_id, store_id, d AS shift_date, t AS shift_type, region
              FROM stores_base, (VALUES {', '.join(f"('{s}')" for s in fv.SHIFT_TYPES)}) AS k(t),
                   (SELECT CAST(unnest(generate_series({_A} - 729, {_A}, INTERVAL 1 DAY)) AS DATE) AS d))""",
}

_QUESTION = "'Question ' || (k % 5)"
_IS_SQL = "event_type IN ('click', 'error')"
_FAILED = f"({_IS_SQL} AND k % 3 = 0)"
_PLANNED = "(event_type = 'view' AND k % 9 <> 0)"

CTES.update(
    {
        "events_k": "SELECT *, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events",
        "all_spans": f"""
        SELECT CAST(event_id AS VARCHAR) AS record_id, user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS trace_id,
               CASE event_type WHEN 'purchase' THEN 'Agent' WHEN 'click' THEN '{fv.SQL_SPAN}' WHEN 'error' THEN '{fv.SQL_TOOL_SPAN}'
                    WHEN 'view' THEN '{fv.PLANNING_PREFIX}-' || (k % 4) WHEN 'signup' THEN '{fv.TURN_SPAN}' END AS span_name,
               'SPAN' AS record_type, ts AS start_ts, ts + to_milliseconds(CAST(ROUND(value * 100) AS BIGINT)) AS end_ts,
               CAST(ts + to_milliseconds(CAST(ROUND(value * 100) AS BIGINT)) AS DATE) AS event_date,
               date_diff('millisecond', ts, ts + to_milliseconds(CAST(ROUND(value * 100) AS BIGINT))) AS duration_ms,
               'user' || user_id AS user_name,
               CASE WHEN user_id % 5 = 0 THEN '0' WHEN user_id % 7 <> 0 THEN 't' || user_id END AS thread_id,
               'm' || event_id AS message_id, CASE WHEN k % 2 = 0 THEN 'm' || (event_id - 1) END AS parent_message_id,
               CASE WHEN user_id % 10 = 9 THEN 'OTHER_ASSISTANT' ELSE 'OPS_ASSISTANT' END AS agent_name,
               'Agent' AS agent_type, 'RETAIL' AS database_name,
               CASE WHEN event_type = 'signup' AND k % 11 <> 0 THEN {_QUESTION} END AS question,
               CASE WHEN event_type = 'signup' THEN 'Answer ' || event_id END AS response_text,
               CASE WHEN event_type = 'signup' AND k % 19 <> 0 THEN CASE WHEN k % 17 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END END AS status,
               CASE WHEN event_type = 'signup' AND value > 150 THEN 'SLOW' END AS status_description,
               CASE WHEN {_IS_SQL} THEN CASE WHEN k % 3 = 0 THEN 'ERROR' ELSE 'SUCCESS' END END AS sql_status,
               CASE WHEN {_FAILED} THEN CASE (k // 3) % 3 WHEN 0 THEN 'error code 000904: invalid identifier ''T.COL_' || (k % 7) || ''''
                    WHEN 1 THEN 'error code 001003: syntax error' ELSE 'statement timed out' END END AS sql_error,
               CASE WHEN {_IS_SQL} THEN 'q' || event_id END AS query_id,
               CASE WHEN {_IS_SQL} THEN 'SELECT ' || k || ' AS n' END AS final_sql,
               CASE WHEN {_IS_SQL} THEN 'WH_' || (k % 3) END AS sql_warehouse,
               CASE WHEN {_IS_SQL} AND k % 13 <> 0 THEN k * 10 END AS sql_num_rows,
               CASE WHEN {_IS_SQL} THEN CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END END AS verified_query_used,
               CASE WHEN {_FAILED} AND k % 2 = 0 THEN 'check failed at ' || k END AS validation_error,
               CASE WHEN event_type = 'view' THEN 'model-' || substr('abc', CAST(k % 3 + 1 AS INTEGER), 1) END AS model,
               CASE WHEN event_type = 'view' THEN k % 4 END AS planning_step,
               CASE WHEN {_PLANNED} THEN CASE WHEN k % 10 = 0 THEN 13 ELSE k * 23 + 1200 END END AS tokens_total,
               CASE WHEN {_PLANNED} THEN k * 20 + 1000 END AS tokens_input,
               CASE WHEN {_PLANNED} THEN k * 3 + 200 END AS tokens_output,
               CASE WHEN {_PLANNED} THEN k * 14 + 700 END AS tokens_cache_read,
               CASE WHEN event_type = 'signup' AND k % 6 = 0 THEN 'SUCCESS' END AS chart_status
        FROM events_k""",
        "spans": "SELECT * FROM all_spans WHERE agent_name = 'OPS_ASSISTANT'",
        "recent_spans": f"SELECT * FROM spans WHERE event_date >= DATE '{SPANS_AS_OF}' - 7",
        "sql_spans": f"SELECT * FROM spans WHERE span_name = '{fv.SQL_SPAN}'",
        "turn_spans": f"SELECT * FROM spans WHERE span_name = '{fv.TURN_SPAN}'",
        "picked": "SELECT MIN(trace_id) AS id FROM sql_spans",
        "query_history": """
        SELECT 'q' || event_id AS query_id, 'WH_' || (k % 3) AS warehouse_name, k * 3 + 5 AS compilation_time,
               CAST(ROUND(value * 100) AS BIGINT) AS execution_time, k * 1000003 AS bytes_scanned,
               k % 20 AS partitions_scanned, 20 + k % 5 AS partitions_total, k * 10 AS rows_produced
        FROM events_k WHERE event_type = 'click' AND event_id % 10 <> 0""",
        "refresh_history": """
        SELECT ts AS start_time, 'spans_' || (k % 3) AS table_name,
               CAST(CAST(ROUND(value * 100) AS BIGINT) / 100000.0 AS DECIMAL(12,5)) AS credits_used
        FROM events_k WHERE event_type = 'error'""",
    }
)

_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def oracle(body: str) -> str:
    """The query with the table expressions it needs, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in CTES and word not in order:
                need(CTES[word])
                if word not in order:
                    order.append(word)

    need(body)
    if not order:
        return body.strip()
    heads = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in order)
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {heads},\n{text[5:]}"
    return f"WITH {heads}\n{text}"
