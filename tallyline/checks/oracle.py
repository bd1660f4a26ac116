"""The registered queries once more as plain SQL over the supplied tables.

The history joined to a forecast is the same on every row of a group, so ``max`` reads it back
without the rounding that an average of equal doubles may add.

Written for DuckDB and from the definitions of the reports, not from the Spark code.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
CUTOVER = "TIMESTAMP '2024-01-24 00:00:00'"

EVENTS = """
ev AS (
  SELECT event_id,
         date_trunc('second', ts) AS event_time,
         CAST(user_id % 10 + 1 AS INTEGER) AS store_id,
         'P' || lpad(CAST(k % 25 AS VARCHAR), 2, '0') AS product_id,
         'C' || CAST((k % 25) // 5 AS VARCHAR) AS category,
         CASE event_type WHEN 'error' THEN 'RETURN' WHEN 'signup' THEN 'RESTOCK' ELSE 'SALE' END
           AS transaction_type,
         CAST(CASE event_type WHEN 'error' THEN 1 + event_id % 5
                              WHEN 'signup' THEN 10 + event_id % 91
                              ELSE 1 + event_id % 10 END AS INTEGER) AS quantity,
         value AS unit_price,
         date_trunc('second', ts + INTERVAL 5 SECOND) AS inserted_at,
         CASE WHEN ts >= TIMESTAMP '2024-01-24 00:00:00' THEN 'realtime' ELSE 'historical' END
           AS source
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

LINES = """
ln AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS event_time,
         CAST(l_suppkey % 10 + 1 AS INTEGER) AS store_id,
         'P' || lpad(CAST(l_partkey % 25 AS VARCHAR), 2, '0') AS product_id,
         'C' || CAST((l_partkey % 25) // 5 AS VARCHAR) AS category,
         CASE WHEN l_returnflag <> 'R' THEN 'SALE' WHEN l_linestatus = 'F' THEN 'RETURN'
              ELSE 'RESTOCK' END AS transaction_type,
         CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice AS unit_price
  FROM lineitem
)"""

PREDICTIONS = EVENTS + """,
past AS (SELECT * FROM ev WHERE event_time < TIMESTAMP '2024-01-24 00:00:00'),
sold AS (
  SELECT product_id, store_id, CAST(isodow(event_time) AS INTEGER) AS dow, SUM(quantity) AS q
  FROM past WHERE transaction_type = 'SALE' GROUP BY ALL
),
slots AS (
  SELECT product_id, store_id, d.day AS forecast_date, CAST(h.hour AS INTEGER) AS forecast_hour,
         CAST(isodow(d.day) AS INTEGER) AS dow
  FROM (SELECT DISTINCT product_id, store_id FROM past),
       (SELECT CAST(DATE '2024-01-24' + CAST(i AS INTEGER) AS DATE) AS day FROM range(7) t(i)) d,
       (SELECT i AS hour FROM range(24) t(i)) h
),
base AS (
  SELECT s.*, (1 + COALESCE(q, 0) % 16) / 32.0 * (1 + forecast_hour % 2)
         * CASE CAST(substr(s.product_id, 2, 2) AS INTEGER) % 3 WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 2 END
         / 8.0 AS demand
  FROM slots s LEFT JOIN sold o
    ON s.product_id = o.product_id AND s.store_id = o.store_id AND s.dow = o.dow
),
pr AS (
  SELECT sha256(v.version || '|' || product_id || '|' || store_id || '|' || forecast_date || '|'
                || forecast_hour) AS prediction_id,
         TIMESTAMP '2024-01-24 00:00:00' AS prediction_time,
         v.version AS model_version, product_id, store_id, forecast_date, forecast_hour,
         CAST(demand AS DOUBLE) * v.factor AS predicted_demand,
         CAST(round(CAST(CAST(demand AS DOUBLE) * v.factor * CAST(0.8 AS DOUBLE) AS DECIMAL(18,6)), 2)
              AS DOUBLE) AS confidence_lower,
         CAST(round(CAST(CAST(demand AS DOUBLE) * v.factor * CAST(1.2 AS DOUBLE) AS DECIMAL(18,6)), 2)
              AS DOUBLE) AS confidence_upper,
         dow AS day_of_week, CAST(month(forecast_date) AS INTEGER) AS month,
         CASE WHEN dow >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CAST(1.0 AS DOUBLE) AS seasonal_factor
  FROM base, (VALUES ('fixture_v1', CAST(1.0 AS DOUBLE)), ('fixture_v2', CAST(0.5 AS DOUBLE)))
       v(version, factor)
),
p1 AS (
  SELECT * FROM pr QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id, store_id, forecast_date, forecast_hour
                                              ORDER BY prediction_time DESC, model_version DESC) = 1
)"""

ACCURACY = PREDICTIONS + """,
actual AS (
  SELECT product_id, store_id, CAST(event_time AS DATE) AS d, hour(event_time) AS h,
         CAST(SUM(quantity) AS BIGINT) AS actual_demand
  FROM ev WHERE transaction_type = 'SALE' GROUP BY ALL
),
acc AS (
  SELECT p.product_id, p.store_id, p.forecast_date, p.forecast_hour, p.predicted_demand,
         a.actual_demand, abs(p.predicted_demand - a.actual_demand) AS absolute_error,
         abs(p.predicted_demand - a.actual_demand) / nullif(a.actual_demand, 0) * 100
           AS percentage_error,
         p.model_version, p.prediction_time
  FROM pr p JOIN actual a ON p.product_id = a.product_id AND p.store_id = a.store_id
                         AND p.forecast_date = a.d AND p.forecast_hour = a.h
)"""

REVENUE = "CAST(SUM(quantity * CAST(unit_price AS DECIMAL(18,2))) AS DOUBLE)"
PRICE = "CAST(SUM(CAST(unit_price AS DECIMAL(18,2))) AS DOUBLE)"
UNITS = "CAST(SUM(quantity) AS BIGINT)"
SALE = "transaction_type = 'SALE'"


def revenue_of(kind: str) -> str:
    return (
        f"CAST(SUM(CASE WHEN transaction_type = '{kind}' THEN quantity * "
        "CAST(unit_price AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)"
    )


def count_of(kind: str) -> str:
    return f"CAST(COUNT(*) FILTER (WHERE transaction_type = '{kind}') AS BIGINT)"


def units_of(kind: str) -> str:
    return f"CAST(COALESCE(SUM(quantity) FILTER (WHERE transaction_type = '{kind}'), 0) AS BIGINT)"


def days(n: int) -> str:
    return f"CAST(event_time AS DATE) >= CAST({AS_OF} AS DATE) - INTERVAL {n} DAY"


def hours(n: int) -> str:
    return f"event_time >= {AS_OF} - INTERVAL {n} HOUR"


NEXT_DAYS = (
    f"forecast_date BETWEEN CAST({CUTOVER} AS DATE) AND CAST({CUTOVER} AS DATE) + INTERVAL 7 DAY"
)

HOURLY = f"""
  SELECT category, date_trunc('hour', event_time) AS hour, {REVENUE} AS hourly_revenue
  FROM ev WHERE {SALE} AND {hours(168)} GROUP BY ALL"""

MOVING = EVENTS + f""",
hourly AS ({HOURLY}),
moving AS (
  SELECT category, hour, hourly_revenue,
         avg(hourly_revenue) OVER w AS moving_avg_24h,
         stddev_pop(hourly_revenue) OVER w AS std_dev_24h
  FROM hourly
  WINDOW w AS (PARTITION BY category ORDER BY hour ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)
)"""


def alerts(sensitivity: float, top: int | None) -> str:
    limit = "" if top is None else f"LIMIT {top}"
    return MOVING + f""",
scored AS (
  SELECT *, (hourly_revenue - moving_avg_24h) / nullif(std_dev_24h, 0) AS z_score FROM moving
  WHERE std_dev_24h > 0
),
alerts AS (
  SELECT *, CASE WHEN z_score > 0 THEN 'High' ELSE 'Low' END AS anomaly_type
  FROM scored WHERE round(abs(z_score), 9) > {sensitivity}
  ORDER BY hour DESC, abs(z_score) DESC, category {limit}
)"""


def rollup(keys: str, where: str, extra: str = "") -> str:
    return f"""WITH {EVENTS}
SELECT {keys}, CAST(COUNT(*) AS BIGINT) AS transaction_count, {UNITS} AS total_quantity,
       {REVENUE} AS total_revenue {extra}
FROM ev WHERE {where} GROUP BY ALL"""


PRIORITY = PREDICTIONS + f""",
s30 AS (SELECT product_id, SUM(quantity) AS total_sold_30d FROM ev
        WHERE {SALE} AND event_time < {CUTOVER}
          AND CAST(event_time AS DATE) >= CAST({CUTOVER} AS DATE) - INTERVAL 30 DAY
        GROUP BY product_id),
p7 AS (SELECT product_id, SUM(predicted_demand) AS predicted_7d FROM p1 WHERE {NEXT_DAYS}
       GROUP BY product_id),
prio AS (
  SELECT s.product_id, CAST(total_sold_30d AS BIGINT) AS total_sold_30d,
         CAST(COALESCE(predicted_7d, 0) AS DOUBLE) AS predicted_7d,
         CASE WHEN predicted_7d > CAST(total_sold_30d AS DOUBLE) / 30 * 7 * 1.2 THEN 'High Priority'
              WHEN predicted_7d > CAST(total_sold_30d AS DOUBLE) / 30 * 7 * 0.8 THEN 'Normal'
              ELSE 'Low Priority' END AS priority
  FROM s30 s LEFT JOIN p7 p ON s.product_id = p.product_id WHERE total_sold_30d > 0
  ORDER BY COALESCE(predicted_7d, 0) DESC, s.product_id LIMIT 50
)"""

RESTOCK = PREDICTIONS + f""",
h AS (SELECT product_id, store_id, avg(quantity) AS historical_avg FROM ev
      WHERE {SALE} AND event_time < {CUTOVER} AND event_time >= {CUTOVER} - INTERVAL 30 DAY
      GROUP BY product_id, store_id),
rec AS (
  SELECT p.product_id, p.store_id, p.forecast_date, SUM(p.predicted_demand) AS predicted_demand_7d,
         max(h.historical_avg) AS historical_avg_7d,
         SUM(p.predicted_demand) / nullif(max(h.historical_avg), 0) AS demand_ratio
  FROM p1 p LEFT JOIN h ON p.product_id = h.product_id AND p.store_id = h.store_id
  WHERE {NEXT_DAYS} GROUP BY p.product_id, p.store_id, p.forecast_date
  HAVING SUM(p.predicted_demand) > 0
),
labelled AS (
  SELECT *, CASE WHEN demand_ratio > 1.5 THEN 'HIGH_DEMAND'
                 WHEN demand_ratio > 1.2 THEN 'MODERATE_INCREASE'
                 WHEN demand_ratio < 0.8 THEN 'LOW_DEMAND' ELSE 'NORMAL' END AS recommendation
  FROM rec
)"""

METRICS = ACCURACY + """,
metrics AS (
  SELECT model_version, CAST(COUNT(*) AS BIGINT) AS samples,
         sqrt(avg(power(predicted_demand - actual_demand, 2))) AS rmse,
         avg(abs(predicted_demand - actual_demand)) AS mae,
         1 - SUM(power(predicted_demand - actual_demand, 2))
             / (SUM(power(actual_demand, 2)) - power(SUM(actual_demand), 2) / COUNT(*)) AS r2_score
  FROM acc GROUP BY model_version
)"""

FACTORS = """
  CASE WHEN hour(event_time) BETWEEN 9 AND 12 THEN 1.5 WHEN hour(event_time) BETWEEN 12 AND 14 THEN 1.3
       WHEN hour(event_time) BETWEEN 17 AND 20 THEN 1.7 WHEN hour(event_time) BETWEEN 20 AND 22 THEN 1.2
       WHEN hour(event_time) BETWEEN 0 AND 6 THEN 0.2 ELSE 1.0 END
  * CAST(list_extract([0.7, 0.75, 0.9, 0.95, 1.0, 1.05, 1.1, 1.05, 1.0, 1.1, 1.5, 1.8],
                      month(event_time)) AS DOUBLE)
  * CASE WHEN isodow(event_time) >= 6 THEN CAST(1.4 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END"""

EVENT_COLUMNS = "event_time, store_id, product_id, category, transaction_type, quantity, unit_price"

TEXT_FIELDS = """'{"event_time":"' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || '","store_id":' || store_id
  || ',"product_id":"' || product_id || '","category":"' || category || '","transaction_type":"'
  || transaction_type || '","quantity":' || quantity || ',"unit_price":'
  || CAST(unit_price AS VARCHAR) || '}'"""

ENRICHED = f"""SELECT {EVENT_COLUMNS}, quantity * unit_price AS revenue,
       CAST(hour(event_time) AS INTEGER) AS hour_of_day,
       CAST(dayofweek(event_time) + 1 AS INTEGER) AS day_of_week,
       isodow(event_time) >= 6 AS is_weekend, CAST(year(event_time) AS INTEGER) AS year,
       CAST(month(event_time) AS INTEGER) AS month, CAST(day(event_time) AS INTEGER) AS day
FROM ev"""
VALID = "quantity > 0 AND unit_price > 0 AND quantity * unit_price > 0"

SLOT_FEATURES = f"""
  SELECT product_id, store_id, CAST(isodow(event_time) AS INTEGER) AS day_of_week,
         CAST(hour(event_time) AS INTEGER) AS hour_of_day, CAST(month(event_time) AS INTEGER) AS month,
         CASE WHEN isodow(event_time) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN month(event_time) IN (11, 12) THEN 1 ELSE 0 END AS is_holiday_season,
         CASE WHEN month(event_time) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer,
         {UNITS} AS total_demand, avg(quantity) AS avg_demand,
         CAST(COUNT(*) AS BIGINT) AS transaction_count
  FROM ev WHERE {SALE} GROUP BY ALL HAVING SUM(quantity) > 0"""

SLOT_KEYS = "product_id, store_id, day_of_week, hour_of_day, month, is_weekend, is_holiday_season, is_summer"

WEEKDAYS = f"""
weekdays AS (
  SELECT product_id, store_id, isodow(event_time) AS dow, avg(quantity) AS avg_demand,
         CAST(COUNT(*) AS BIGINT) AS n
  FROM ev WHERE {SALE} GROUP BY ALL
)"""

# Every date from the first to the last event.
HELD = """
held AS (
  SELECT isodow(d) AS dow, month(d) AS month
  FROM (SELECT unnest(generate_series(date_trunc('day', min(event_time)), max(event_time), INTERVAL 1 DAY))
               AS d FROM ev)
)"""
WEEKLY_HISTORY = """round(COALESCE(avg_demand, 1.0), 6) AS avg_demand,
       round(CAST(COALESCE(n, 0) AS DOUBLE) / dates_of_weekday, 6) AS transaction_count"""

GRID = f"""
grid AS (
  SELECT product_id, store_id, CAST(CAST({AS_OF} AS DATE) + CAST(i AS INTEGER) AS DATE)
           AS forecast_date, CAST(j AS INTEGER) AS hour_of_day
  FROM (SELECT DISTINCT product_id, store_id FROM ev), range(7) a(i), range(24) b(j)
),
slots AS (
  SELECT product_id, store_id, forecast_date, hour_of_day,
         CAST(isodow(forecast_date) AS INTEGER) AS day_of_week,
         CAST(month(forecast_date) AS INTEGER) AS month,
         CASE WHEN isodow(forecast_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN month(forecast_date) IN (11, 12) THEN 1 ELSE 0 END AS is_holiday_season,
         CASE WHEN month(forecast_date) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer
  FROM grid
)"""

REALTIME_COLUMNS = f"{EVENT_COLUMNS}, inserted_at, CAST(event_time AS DATE) AS event_date"


def _money_text(x: str) -> str:
    return (
        f"'$' || CASE WHEN abs({x}) >= 1e6 THEN format('{{:.2f}}M', {x} / 1e6) "
        f"WHEN abs({x}) >= 1e3 THEN format('{{:.2f}}K', {x} / 1e3) ELSE format('{{:.2f}}', {x}) END"
    )


def _count_text(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) >= 1e9 THEN format('{{:.1f}}B', {x} / 1e9) "
        f"WHEN abs({x}) >= 1e6 THEN format('{{:.1f}}M', {x} / 1e6) "
        f"WHEN abs({x}) >= 1e3 THEN format('{{:.1f}}K', {x} / 1e3) ELSE format('{{:.1f}}', {x}) END"
    )


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    ev, ln, pr, acc = (f"WITH {cte}\n" for cte in (EVENTS, LINES, PREDICTIONS, ACCURACY))

    # Ingest
    q["parse_events"] = ev + f"SELECT {EVENT_COLUMNS} FROM ev"
    q["enrich_events"] = ev + ENRICHED
    q["validate_events"] = ev + ENRICHED + f" WHERE {VALID}"
    q["rejected_events"] = ev + f"""
SELECT reason, CAST(COUNT(*) AS BIGINT) AS rejected FROM (
  SELECT 'unreadable' AS reason FROM events
  UNION ALL
  SELECT CASE WHEN quantity <= 0 THEN 'non-positive quantity'
              WHEN unit_price <= 0 THEN 'non-positive unit_price'
              ELSE 'non-positive revenue' END FROM ev WHERE NOT ({VALID})
) GROUP BY reason"""
    q["events_to_json"] = ev + f"SELECT {TEXT_FIELDS} AS value FROM ev"
    q["stream_lake_sink"] = q["validate_events"]
    q["stream_restart"] = q["validate_events"]
    q["lake_history_then_stream"] = q["validate_events"]
    q["unified_from_tables"] = ev + f"""
SELECT {EVENT_COLUMNS}, source FROM ev WHERE source = 'realtime' OR ({VALID})"""
    q["unified_raw"] = ev + f"""
SELECT {EVENT_COLUMNS}, 'realtime' AS source FROM ev
UNION ALL SELECT {EVENT_COLUMNS}, 'historical' FROM ev WHERE {VALID}"""
    q["unified_json"] = ev + f"""
SELECT left(value, length(value) - 1) || ',"source":"' || source || '"}}' AS value
FROM (SELECT source, {TEXT_FIELDS} AS value FROM ev)"""
    q["stream_ingest"] = q["parse_events"]
    q["realtime_table"] = ev + f"SELECT {REALTIME_COLUMNS} FROM ev"
    q["realtime_compacted"] = q["realtime_table"]
    q["lake_compacted"] = q["validate_events"]
    q["unified_by_completeness"] = q["unified_from_tables"]
    q["lake_pruned_scan"] = (
        ev + ENRICHED + f" WHERE {VALID} AND event_time >= {CUTOVER}"
    )
    q["retention_90d"] = ev + (
        f"SELECT {REALTIME_COLUMNS} FROM ev "
        "WHERE event_time > TIMESTAMP '2024-04-10 12:00:00' - INTERVAL 90 DAY"
    )

    # Serving
    q["unified_events"] = ev + f"SELECT {EVENT_COLUMNS}, source FROM ev"
    q["sales_by_category"] = ev + f"""
SELECT category, transaction_type, CAST(COUNT(*) AS BIGINT) AS transaction_count,
       {UNITS} AS total_quantity, {REVENUE} AS total_revenue, {PRICE} / COUNT(*) AS avg_unit_price
FROM ev WHERE {SALE} GROUP BY ALL"""
    q["sales_by_category_lineitem"] = q["sales_by_category"].replace(EVENTS, LINES).replace(
        "FROM ev", "FROM ln"
    )
    q["sales_by_store"] = ev + f"""
SELECT store_id, CAST(COUNT(*) AS BIGINT) AS transaction_count, {UNITS} AS total_quantity,
       {REVENUE} AS total_revenue FROM ev WHERE {SALE} GROUP BY ALL"""
    q["hourly_sales_trend"] = ev + f"""
SELECT date_trunc('hour', event_time) AS hour, CAST(COUNT(*) AS BIGINT) AS transaction_count,
       {UNITS} AS total_quantity, {REVENUE} AS total_revenue FROM ev WHERE {SALE} GROUP BY ALL"""
    q["product_performance"] = ev + f"""
SELECT product_id, category, CAST(COUNT(*) AS BIGINT) AS transaction_count,
       {UNITS} AS total_quantity, {REVENUE} AS total_revenue, {PRICE} / COUNT(*) AS avg_unit_price
FROM ev WHERE {SALE} GROUP BY ALL"""
    q["return_rate"] = ev + f"""
SELECT category, product_id, {count_of('SALE')} AS sales_count,
       {count_of('RETURN')} AS return_count, {revenue_of('SALE')} AS total_sales_revenue,
       {revenue_of('RETURN')} AS total_return_value,
       {count_of('RETURN')} / nullif(CAST({count_of('SALE')} AS DOUBLE), 0) * 100 AS return_rate_pct
FROM ev GROUP BY ALL HAVING {count_of('SALE')} > 0"""
    q["store_daily_performance"] = ev + f"""
SELECT store_id, CAST(event_time AS DATE) AS date, {count_of('SALE')} AS sales_transactions,
       {count_of('RETURN')} AS return_transactions, {revenue_of('SALE')} AS daily_revenue,
       {revenue_of('SALE')} / COUNT(*) AS avg_transaction_value, {UNITS} AS total_items_moved
FROM ev WHERE {days(30)} GROUP BY ALL"""
    q["peak_hours"] = ev + f"""
SELECT CAST(isodow(event_time) AS INTEGER) AS day_of_week, CAST(hour(event_time) AS INTEGER) AS hour,
       CAST(COUNT(*) AS BIGINT) AS transaction_count, {REVENUE} AS revenue,
       {REVENUE} / COUNT(*) AS avg_basket_value
FROM ev WHERE {SALE} AND {days(30)} GROUP BY ALL"""

    # Rollups
    q["rollup_daily"] = rollup(
        "CAST(event_time AS DATE) AS date, store_id, category, transaction_type", SALE
    )
    q["rollup_hourly"] = rollup("date_trunc('hour', event_time) AS hour, store_id, category", SALE)
    q["rollup_product"] = rollup(
        "product_id, category, transaction_type",
        "true",
        f", {PRICE} / COUNT(*) AS avg_unit_price",
    )
    q["rollup_late_data"] = q["rollup_hourly"]
    q["rollup_compacted"] = q["rollup_product"]

    # Live
    q["home_kpis"] = ev + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_transactions, {REVENUE} AS total_revenue,
       CAST(COUNT(DISTINCT product_id) AS BIGINT) AS unique_products,
       CAST(COUNT(DISTINCT store_id) AS BIGINT) AS unique_stores FROM ev WHERE {SALE}"""
    q["home_kpis_rolled"] = q["home_kpis"]
    for report in ("sales_by_category", "sales_by_store", "hourly_sales_trend", "product_performance"):
        q[f"{report}_rolled"] = q[report]
    q["rollup_hourly_read"] = rollup(
        "date_trunc('hour', event_time) AS hour, store_id, category", f"{SALE} AND event_time < {CUTOVER}"
    )
    q["daily_sales_rolled"] = ev + f"""
SELECT CAST(event_time AS DATE) AS date, store_id, CAST(COUNT(*) AS BIGINT) AS transaction_count,
       {UNITS} AS total_quantity, {REVENUE} AS total_revenue
FROM ev WHERE {SALE} AND event_time < {AS_OF} AND event_time >= {AS_OF} - INTERVAL 14 DAY GROUP BY ALL"""
    q["data_freshness"] = ev + """
SELECT max(event_time) AS latest_event, CAST(COUNT(*) AS BIGINT) AS total_records,
       max(inserted_at) AS latest_insert FROM ev"""
    q["latest_events"] = ev + f"""
SELECT {EVENT_COLUMNS}, quantity * unit_price AS total_value, inserted_at,
       CASE WHEN {SALE} THEN '🛒 ' ELSE '↩️ ' END || transaction_type AS type_label
FROM ev ORDER BY inserted_at DESC, event_time DESC, store_id, product_id, category,
  transaction_type, quantity, unit_price LIMIT 5"""
    q["realtime_kpis"] = ev + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_transactions, {REVENUE} AS total_revenue,
       {REVENUE} / COUNT(*) AS avg_basket_value, {UNITS} AS total_quantity
FROM ev WHERE {SALE} AND {hours(24)}"""
    q["realtime_kpis_past"] = ev + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_transactions, {REVENUE} AS total_revenue,
       {REVENUE} / COUNT(*) AS avg_basket_value, {UNITS} AS total_quantity
FROM ev WHERE {SALE} AND event_time < {CUTOVER} AND event_time >= {CUTOVER} - INTERVAL 24 HOUR"""
    q["realtime_hourly"] = ev + f"""
SELECT date_trunc('hour', event_time) AS hour, {REVENUE} AS revenue,
       CAST(COUNT(*) AS BIGINT) AS transactions FROM ev WHERE {SALE} AND {hours(24)} GROUP BY ALL"""
    q["realtime_by_category"] = ev + f"""
SELECT category, {REVENUE} AS revenue, CAST(COUNT(*) AS BIGINT) AS transactions
FROM ev WHERE {SALE} AND {hours(168)} GROUP BY ALL"""
    q["realtime_by_store"] = ev + f"""
SELECT store_id, {REVENUE} AS revenue, CAST(COUNT(*) AS BIGINT) AS transactions
FROM ev WHERE {SALE} AND {hours(168)} GROUP BY ALL ORDER BY revenue DESC, store_id LIMIT 10"""
    q["top_products"] = ev + f"""
SELECT product_id, category, {REVENUE} AS revenue, {UNITS} AS quantity_sold,
       CAST(COUNT(*) AS BIGINT) AS transactions
FROM ev WHERE {SALE} AND {hours(24)} GROUP BY ALL
ORDER BY revenue DESC, product_id, category LIMIT 15"""
    q["monthly_distribution"] = ln + """
SELECT CAST(strftime(event_time, '%Y%m') AS INTEGER) AS month, CAST(COUNT(*) AS BIGINT) AS events
FROM ln GROUP BY ALL"""
    q["event_span"] = ev + """
SELECT CAST(COUNT(*) AS BIGINT) AS events, min(event_time) AS first_event,
       max(event_time) AS last_event FROM ev"""

    # History
    daily = f"""
  SELECT CAST(event_time AS DATE) AS date, {REVENUE} AS revenue,
         CAST(COUNT(*) AS BIGINT) AS transactions, {UNITS} AS items_sold
  FROM ev WHERE {SALE} AND {days(30)} GROUP BY ALL"""
    q["daily_sales_trend"] = ev + daily
    q["daily_sales_summary_stats"] = ev + f"""
SELECT CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
       CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_daily_revenue,
       CAST(SUM(transactions) AS BIGINT) AS total_transactions,
       CAST(SUM(items_sold) AS BIGINT) AS total_items FROM ({daily})"""
    heat = f"""
  SELECT CAST(isodow(event_time) AS INTEGER) AS day_of_week, CAST(hour(event_time) AS INTEGER) AS hour,
         CAST(COUNT(*) AS BIGINT) AS transaction_count, dayname(event_time) AS day_name
  FROM ev WHERE {SALE} AND {days(30)} GROUP BY ALL"""
    q["peak_hours_heatmap"] = ev + heat
    columns = ", ".join(
        f"CAST(max(transaction_count) FILTER (WHERE hour = {h}) AS BIGINT) AS h{h}" for h in range(24)
    )
    q["peak_hours_matrix"] = ev + f"SELECT day_of_week, day_name, {columns} FROM ({heat}) GROUP BY ALL"
    q["peak_hour"] = (
        ev + f"SELECT * FROM ({heat}) ORDER BY transaction_count DESC, day_of_week, hour LIMIT 1"
    )
    q["store_performance"] = ev + f"""
SELECT *, CASE WHEN sales_count = 0 AND return_count = 0 THEN 0
          ELSE return_count / nullif(CAST(sales_count AS DOUBLE), 0) * 100 END AS return_rate
FROM (SELECT store_id, {revenue_of('SALE')} AS total_revenue, {count_of('SALE')} AS sales_count,
             {count_of('RETURN')} AS return_count
      FROM ev WHERE {days(30)} GROUP BY ALL) ORDER BY total_revenue DESC, store_id LIMIT 15"""
    q["return_rate_top"] = ev + f"""
SELECT category, product_id, {count_of('SALE')} AS sales_count,
       {count_of('RETURN')} AS return_count,
       {count_of('RETURN')} / nullif(CAST({count_of('SALE')} AS DOUBLE), 0) * 100 AS return_rate_pct
FROM ev WHERE {days(30)} GROUP BY ALL HAVING {count_of('SALE')} > 5
ORDER BY return_rate_pct DESC, category, product_id LIMIT 20"""
    q["category_performance"] = ev + f"""
SELECT *, total_revenue / SUM(total_revenue) OVER () * 100 AS revenue_share FROM (
  SELECT category, CAST(COUNT(*) AS BIGINT) AS total_transactions, {REVENUE} AS total_revenue,
         {REVENUE} / COUNT(*) AS avg_transaction_value, {UNITS} AS total_items
  FROM ev WHERE {SALE} AND {days(30)} GROUP BY ALL)"""
    q["category_cards"] = f"""
SELECT category, {_money_text('total_revenue')} AS revenue_text,
       {_money_text('avg_transaction_value')} AS avg_value_text,
       {_count_text('CAST(total_items AS DOUBLE)')} AS items_text,
       format('{{:.1f}}%', CASE WHEN abs(revenue_share) <= 1 THEN revenue_share * 100
                              ELSE revenue_share END) AS share_text
FROM ({q["category_performance"]})"""
    q["category_performance"] = (
        "SELECT category, total_transactions, total_revenue, avg_transaction_value, total_items, "
        f"round(revenue_share, 6) AS revenue_share FROM ({q['category_performance']})"
    )
    q["growth_rate"] = ln + f"""
SELECT month, revenue, previous_revenue, round(CASE WHEN previous_revenue = 0
         THEN CASE WHEN revenue = 0 THEN 0 ELSE 100 END
         ELSE (revenue - previous_revenue) / previous_revenue * 100 END, 6) AS growth_pct
FROM (SELECT *, lag(revenue) OVER (ORDER BY month) AS previous_revenue FROM (
  SELECT CAST(strftime(event_time, '%Y%m') AS INTEGER) AS month, {REVENUE} AS revenue
  FROM ln WHERE {SALE} GROUP BY ALL))"""
    q["store_leaderboard"] = ev + f"""
SELECT store_id, revenue, CAST(rank() OVER (ORDER BY revenue DESC) AS INTEGER) AS revenue_rank
FROM (SELECT store_id, {REVENUE} AS revenue FROM ev WHERE {SALE} GROUP BY ALL)"""
    q["revenue_metrics"] = ev + f"""
SELECT CAST(SUM(CAST(r AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
       CAST(SUM(CAST(r AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_revenue,
       max(r) AS max_revenue, min(r) AS min_revenue
FROM (SELECT product_id, category, {REVENUE} AS r FROM ev WHERE {SALE} GROUP BY ALL)"""
    q["performance_metrics"] = ev + """
SELECT CAST(COUNT(*) AS BIGINT) AS total_transactions,
       CAST(COUNT(DISTINCT product_id) AS BIGINT) AS unique_products,
       CAST(COUNT(DISTINCT store_id) AS BIGINT) AS unique_stores FROM ev"""
    q["product_cards"] = ev + f"""
SELECT product_id, {_money_text('r')} AS revenue_text, {_money_text('a')} AS avg_value_text,
       {_count_text('u')} AS items_text,
       format('{{:.1f}}%', CASE WHEN abs(s) <= 1 THEN s * 100 ELSE s END) AS return_text
FROM (SELECT product_id, {REVENUE} AS r, {REVENUE} / COUNT(*) AS a,
             CAST(SUM(quantity) AS DOUBLE) AS u,
             {count_of('RETURN')} / CAST(COUNT(*) AS DOUBLE) AS s FROM ev GROUP BY ALL)"""

    # Inventory
    q["stock_movement"] = ev + f"""
SELECT transaction_type, CAST(COUNT(*) AS BIGINT) AS transaction_count, {UNITS} AS total_quantity,
       {REVENUE} AS total_value FROM ev WHERE {days(30)} GROUP BY ALL"""
    q["net_stock_movement"] = ev + f"""
SELECT *, restock_qty - sales_qty + return_qty AS net_movement,
       CASE WHEN restock_qty - sales_qty + return_qty > 0 THEN 'Increase' ELSE 'Decrease' END
         AS direction
FROM (SELECT {units_of('SALE')} AS sales_qty, {units_of('RETURN')} AS return_qty,
             {units_of('RESTOCK')} AS restock_qty FROM ev WHERE {days(30)})"""
    q["product_history"] = ev + f"""
SELECT *, units_restocked + units_returned - units_sold AS net_units
FROM (SELECT CAST(event_time AS DATE) AS date, store_id, CAST(COUNT(*) AS BIGINT) AS events,
             {units_of('SALE')} AS units_sold, {units_of('RETURN')} AS units_returned,
             {units_of('RESTOCK')} AS units_restocked, {revenue_of('SALE')} AS revenue
      FROM ev WHERE product_id = 'P07' AND event_time < {AS_OF} GROUP BY ALL)"""
    q["category_stock_status"] = ev + f"""
SELECT category, {count_of('SALE')} AS sales_count, {count_of('RETURN')} AS return_count,
       {count_of('RESTOCK')} AS restock_count, {units_of('SALE')} AS total_sold,
       {units_of('RETURN')} AS total_returned, {units_of('RESTOCK')} AS total_restocked,
       {units_of('RESTOCK')} - {units_of('SALE')} + {units_of('RETURN')} AS net_stock_change
FROM ev WHERE {days(30)} GROUP BY ALL"""
    q["slow_moving_products"] = ev + f"""
SELECT product_id, category, {UNITS} AS total_sold_30d, CAST(COUNT(*) AS BIGINT) AS transaction_count,
       CAST(date_diff('day', min(event_time), max(event_time)) AS INTEGER) AS days_active,
       SUM(quantity) / nullif(CAST(date_diff('day', min(event_time), max(event_time)) AS DOUBLE), 0)
         AS avg_daily_sales
FROM ev WHERE {SALE} AND {days(30)} GROUP BY ALL
HAVING SUM(quantity) > 0 AND date_diff('day', min(event_time), max(event_time)) > 5
ORDER BY avg_daily_sales, product_id, category LIMIT 20"""
    q["high_demand_products"] = pr + f"""
SELECT s.product_id, s.category, CAST(total_sold_30d AS BIGINT) AS total_sold_30d,
       CAST(COALESCE(predicted_7d, 0) AS DOUBLE) AS predicted_7d, transaction_count,
       CAST(total_sold_30d AS DOUBLE) / 30 AS avg_daily_sales
FROM (SELECT product_id, category, SUM(quantity) AS total_sold_30d,
             CAST(COUNT(*) AS BIGINT) AS transaction_count
      FROM ev WHERE {SALE} AND event_time < {CUTOVER}
        AND CAST(event_time AS DATE) >= CAST({CUTOVER} AS DATE) - INTERVAL 30 DAY GROUP BY ALL) s
LEFT JOIN (SELECT product_id, SUM(predicted_demand) AS predicted_7d FROM p1 WHERE {NEXT_DAYS}
           GROUP BY product_id) p ON s.product_id = p.product_id
ORDER BY total_sold_30d DESC, s.product_id, s.category LIMIT 20"""
    q["restock_priority"] = f"WITH {PRIORITY} SELECT * FROM prio"
    q["restock_priority_counts"] = f"""WITH {PRIORITY}
SELECT CAST(COUNT(*) FILTER (WHERE priority = 'High Priority') AS BIGINT) AS high_priority,
       CAST(COUNT(*) FILTER (WHERE priority = 'Normal') AS BIGINT) AS normal_priority,
       CAST(COUNT(*) FILTER (WHERE priority = 'Low Priority') AS BIGINT) AS low_priority FROM prio"""

    q["restock_priority_counts_all"] = q["restock_priority_counts"].replace("LIMIT 50", "")

    # Anomalies
    q["sales_anomaly_stats"] = f"""WITH {MOVING}
SELECT category, hour, hourly_revenue, round(moving_avg_24h, 6) AS moving_avg_24h,
       round(std_dev_24h, 6) AS std_dev_24h FROM moving"""
    listed = """SELECT category, hour, hourly_revenue, round(moving_avg_24h, 6) AS moving_avg_24h,
       round(std_dev_24h, 6) AS std_dev_24h, round(z_score, 6) AS z_score, anomaly_type FROM alerts"""
    q["anomaly_alerts"] = f"WITH {alerts(2.0, 50)} {listed}"
    q["anomaly_alerts_all"] = f"WITH {alerts(1.0, None)} {listed}"
    for key, top in (("anomaly_counts", 50), ("anomaly_counts_all", None)):
        q[key] = f"""WITH {alerts(1.0, top)}
SELECT CAST(COUNT(*) AS BIGINT) AS total_anomalies,
       CAST(COUNT(*) FILTER (WHERE round(z_score, 9) > 1.0) AS BIGINT) AS high_anomalies,
       CAST(COUNT(*) FILTER (WHERE round(z_score, 9) < -1.0) AS BIGINT) AS low_anomalies FROM alerts"""
    for key, top in (("anomaly_summary", 50), ("anomaly_summary_all", None)):
        q[key] = f"""WITH {alerts(1.0, top)}
SELECT category, CAST(COUNT(*) AS BIGINT) AS anomaly_count, round(avg(z_score), 6) AS avg_z_score,
       round(max(z_score), 6) AS max_z_score, round(min(z_score), 6) AS min_z_score
FROM alerts GROUP BY category"""
    q["anomaly_bands"] = f"""WITH {MOVING}
SELECT category, hour, hourly_revenue AS revenue, round(moving_avg_24h, 6) AS moving_avg,
       round(std_dev_24h, 6) AS std_dev, round(moving_avg_24h + 2.0 * std_dev_24h, 6) AS upper_band,
       round(moving_avg_24h - 2.0 * std_dev_24h, 6) AS lower_band FROM moving"""
    q["anomaly_bands_filtered"] = q["anomaly_bands"] + " WHERE category IN ('C1', 'C3')"
    q["anomaly_stats_filled"] = f"""WITH {EVENTS},
seen AS ({HOURLY}),
spine AS (SELECT category, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
          FROM seen GROUP BY category),
hourly AS (SELECT p.category, p.hour, COALESCE(hourly_revenue, 0) AS hourly_revenue
           FROM spine p LEFT JOIN seen s ON p.category = s.category AND p.hour = s.hour)
SELECT category, hour, hourly_revenue, round(avg(hourly_revenue) OVER w, 6) AS moving_avg_24h,
       round(stddev_pop(hourly_revenue) OVER w, 6) AS std_dev_24h FROM hourly
WINDOW w AS (PARTITION BY category ORDER BY hour ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"""

    # Forecasts
    rounded_accuracy = """SELECT product_id, store_id, forecast_date, forecast_hour, predicted_demand,
       actual_demand, absolute_error, round(percentage_error, 6) AS percentage_error, model_version,
       prediction_time FROM acc"""
    summary = """
  SELECT model_version, CAST(COUNT(*) AS BIGINT) AS predictions_made,
         CAST(COUNT(actual_demand) AS BIGINT) AS predictions_with_actual,
         round(avg(absolute_error), 6) AS avg_absolute_error,
         round(avg(percentage_error), 6) AS avg_percentage_error,
         round(quantile_cont(percentage_error, 0.5), 6) AS median_percentage_error,
         round(quantile_cont(percentage_error, 0.9), 6) AS p90_percentage_error
  FROM acc GROUP BY model_version"""
    q["prediction_accuracy"] = acc + rounded_accuracy
    q["prediction_accuracy_bucketed"] = acc + rounded_accuracy
    q["model_performance_summary"] = acc + summary
    q["model_performance_sketched"] = acc + f"""
SELECT model_version, predictions_made, avg_percentage_error, TRUE AS median_percentage_error_within,
       TRUE AS p90_percentage_error_within
FROM ({summary})"""
    q["model_history"] = acc + f"""
SELECT model_version, avg_percentage_error, median_percentage_error, predictions_made
FROM ({summary}) ORDER BY model_version DESC LIMIT 5"""
    q["ml_metrics_sql"] = f"""WITH {METRICS}
SELECT model_version, samples, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
       round(r2_score, 6) AS r2_score FROM metrics"""
    q["active_model"] = f"""WITH {METRICS}
SELECT model_version, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2_score, 6) AS r2_score,
       samples AS training_samples, {CUTOVER} AS training_date
FROM metrics ORDER BY model_version DESC LIMIT 1"""
    q["model_activation"] = f"""WITH {METRICS}
SELECT model_version, samples AS training_samples,
       CAST(CASE WHEN model_version = 'fixture_v1' THEN 1 ELSE 0 END AS INTEGER) AS is_active
FROM metrics"""
    q["daily_demand_forecast"] = pr + """
SELECT forecast_date, product_id, store_id, model_version, SUM(predicted_demand) AS total_daily_demand,
       min(predicted_demand) AS min_hourly_demand, max(predicted_demand) AS max_hourly_demand,
       SUM(predicted_demand) / COUNT(*) AS avg_hourly_demand,
       max(prediction_time) AS latest_prediction_time
FROM pr WHERE forecast_date >= DATE '2024-01-24' GROUP BY ALL"""
    q["restock_recommendations"] = f"""WITH {RESTOCK}
SELECT product_id, store_id, forecast_date, predicted_demand_7d, historical_avg_7d, demand_ratio,
       recommendation FROM labelled"""
    q["high_demand_restock"] = f"""WITH {RESTOCK}
SELECT product_id, store_id, predicted_demand_7d, historical_avg_7d, recommendation FROM (SELECT * FROM labelled WHERE recommendation = 'HIGH_DEMAND'
  ORDER BY predicted_demand_7d DESC, product_id, store_id, forecast_date LIMIT 20)"""
    q["restock_7d"] = f"""WITH {RESTOCK}
SELECT product_id, store_id, predicted_7d, CASE WHEN ratio > 1.5 THEN 'HIGH_DEMAND'
         WHEN ratio > 1.2 THEN 'MODERATE_INCREASE' WHEN ratio < 0.8 THEN 'LOW_DEMAND'
         ELSE 'NORMAL' END AS recommendation
FROM (SELECT p.product_id, p.store_id, SUM(predicted_demand) AS predicted_7d,
             SUM(predicted_demand) / nullif(max(historical_avg), 0) AS ratio
      FROM p1 p LEFT JOIN h ON p.product_id = h.product_id AND p.store_id = h.store_id
      WHERE {NEXT_DAYS} GROUP BY p.product_id, p.store_id HAVING SUM(predicted_demand) > 0)
ORDER BY predicted_7d DESC, product_id, store_id LIMIT 30"""
    q["restock_7d_filtered"] = f"""SELECT * FROM ({q["restock_7d"]})
WHERE recommendation = 'HIGH_DEMAND'"""
    q["predictions_count"] = pr + "SELECT CAST(COUNT(*) AS BIGINT) AS count FROM pr"
    q["forecast_dimensions"] = pr + """
SELECT 'product_id' AS dimension, product_id AS choice
FROM (SELECT DISTINCT product_id FROM pr ORDER BY product_id LIMIT 50)
UNION ALL
SELECT 'store_id', CAST(store_id AS VARCHAR)
FROM (SELECT DISTINCT store_id FROM pr ORDER BY store_id LIMIT 20)"""
    by_day = f"""
  SELECT forecast_date, SUM(predicted_demand) AS total_demand,
         round(avg(confidence_lower), 6) AS avg_lower, round(avg(confidence_upper), 6) AS avg_upper,
         CAST(COUNT(*) AS BIGINT) AS product_count
  FROM p1 WHERE {NEXT_DAYS} GROUP BY forecast_date"""
    q["forecast_by_day"] = pr + by_day
    q["forecast_by_day_filtered"] = pr + by_day.replace(
        "WHERE", "WHERE product_id = 'P03' AND store_id = 4 AND"
    )
    q["forecast_totals"] = pr + f"""
SELECT SUM(total_demand) AS total_forecast, SUM(total_demand) / COUNT(*) AS avg_daily_demand
FROM ({by_day})"""
    q["accuracy_by_product"] = acc + """
SELECT product_id, round(avg(predicted_demand), 6) AS avg_predicted,
       round(avg(actual_demand), 6) AS avg_actual, round(avg(absolute_error), 6) AS avg_error,
       round(avg(percentage_error), 6) AS avg_pct_error, CAST(COUNT(*) AS BIGINT) AS sample_count
FROM acc GROUP BY product_id HAVING COUNT(*) >= 3
ORDER BY avg(percentage_error), product_id LIMIT 20"""
    q["recent_accuracy"] = acc + f"""
SELECT round(avg(percentage_error), 6) AS avg_error FROM acc
WHERE forecast_date >= CAST({AS_OF} AS DATE) - INTERVAL 7 DAY"""
    q["forecast_next7_by_store"] = pr + f"""
SELECT forecast_date, product_id, store_id, SUM(predicted_demand) AS daily_forecast
FROM p1 WHERE {NEXT_DAYS} GROUP BY ALL"""
    for key in (
        "high_demand_products",
        "restock_priority",
        "restock_recommendations",
        "forecast_totals",
        "forecast_next7_by_store",
    ):
        q[f"{key}_all_versions"] = q[key].replace("FROM p1", "FROM pr")
    q["predictions_by_version"] = pr + """
SELECT model_version, CAST(COUNT(*) AS BIGINT) AS predictions, min(forecast_date) AS first_date,
       max(forecast_date) AS last_date FROM pr GROUP BY model_version"""
    q["latest_predictions"] = pr + """
SELECT product_id, forecast_date, predicted_demand FROM (
  SELECT * FROM pr ORDER BY prediction_time DESC, forecast_date, product_id, store_id, forecast_hour,
    model_version LIMIT 10)"""
    q["top_forecasts"] = pr + """
SELECT forecast_date, forecast_hour, product_id, store_id, model_version, predicted_demand
FROM pr WHERE forecast_date >= DATE '2024-01-24'
ORDER BY forecast_date, predicted_demand DESC, product_id, store_id, forecast_hour, model_version
LIMIT 10"""
    q["relation_counts"] = pr + """
SELECT 'realtime' AS name, CAST(COUNT(*) AS BIGINT) AS row_count FROM ev
UNION ALL SELECT 'historical', CAST(COUNT(*) AS BIGINT) FROM ev WHERE source = 'historical'
UNION ALL SELECT 'unified', CAST(COUNT(*) AS BIGINT) FROM ev
UNION ALL SELECT 'predictions', CAST(COUNT(*) AS BIGINT) FROM pr"""
    q["unified_preview"] = ev + f"""
SELECT {EVENT_COLUMNS}, source FROM ev ORDER BY {EVENT_COLUMNS} LIMIT 10"""
    files = """
SELECT prediction_id, prediction_time, model_version, product_id, store_id, forecast_date,
       forecast_hour, predicted_demand, confidence_lower, confidence_upper, day_of_week, month,
       is_weekend, seasonal_factor FROM pr"""
    q["save_predictions"] = pr + files
    q["predictions_csv_roundtrip"] = pr + files
    q["import_predictions"] = pr + files

    # Model features
    q["training_features"] = ev + (
        "SELECT * REPLACE (round(avg_demand, 6) AS avg_demand) FROM (" + SLOT_FEATURES + ")"
    )
    q["training_features_weekday"] = f"""WITH {EVENTS}, {WEEKDAYS}
SELECT s.* EXCLUDE (avg_demand, transaction_count), round(w.avg_demand, 6) AS avg_demand,
       w.n AS transaction_count
FROM ({SLOT_FEATURES}) s JOIN weekdays w
  ON s.product_id = w.product_id AND s.store_id = w.store_id AND s.day_of_week = w.dow"""
    q["training_features_weekly"] = f"""WITH {EVENTS}, {WEEKDAYS}, {HELD},
spans AS (SELECT dow, month, COUNT(*) AS dates FROM held GROUP BY ALL),
sold AS (SELECT product_id, store_id, isodow(event_time) AS dow, month(event_time) AS month,
                hour(event_time) AS h, SUM(quantity) AS units FROM ev WHERE {SALE} GROUP BY ALL)
SELECT g.product_id, g.store_id, CAST(g.dow AS INTEGER) AS day_of_week, CAST(g.h AS INTEGER) AS hour_of_day,
       CAST(g.month AS INTEGER) AS month, CASE WHEN g.dow >= 6 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN g.month IN (11, 12) THEN 1 ELSE 0 END AS is_holiday_season,
       CASE WHEN g.month IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer,
       round(CAST(COALESCE(units, 0) AS DOUBLE) / dates, 6) AS total_demand, {WEEKLY_HISTORY}
FROM (SELECT * FROM (SELECT DISTINCT product_id, store_id FROM ev), spans, range(24) t(h)) g
LEFT JOIN sold s USING (product_id, store_id, dow, month, h)
LEFT JOIN weekdays w USING (product_id, store_id, dow)
JOIN (SELECT dow, COUNT(*) AS dates_of_weekday FROM held GROUP BY dow) d USING (dow)"""
    q["score_features_weekly"] = f"""WITH {EVENTS}, {GRID}, {WEEKDAYS}, {HELD}
SELECT s.*, {WEEKLY_HISTORY} FROM slots s
LEFT JOIN weekdays w ON s.product_id = w.product_id AND s.store_id = w.store_id AND s.day_of_week = w.dow
JOIN (SELECT dow, COUNT(*) AS dates_of_weekday FROM held GROUP BY dow) d ON s.day_of_week = d.dow"""
    q["ml_split"] = ev + f"""
SELECT {SLOT_KEYS},
       CAST('0x' || substr(md5(concat_ws('|', 42, {SLOT_KEYS})), 1, 8) AS BIGINT) % 100 < 80 AS in_training
FROM ({SLOT_FEATURES})"""
    q["ml_predict_checks"] = f"""WITH {EVENTS}, {GRID}
SELECT product_id, store_id, forecast_date, hour_of_day AS forecast_hour,
       sha256(concat_ws('|', '20240131_000000', product_id, store_id, forecast_date, hour_of_day))
         AS prediction_id,
       '20240131_000000' AS model_version, {AS_OF} AS prediction_time, day_of_week, month, is_weekend,
       CAST(CASE WHEN month IN (11, 12) THEN 1.5 WHEN month IN (6, 7, 8) THEN 1.1 ELSE 1.0 END AS DOUBLE)
         AS seasonal_factor,
       TRUE AS in_band
FROM slots"""
    q["ml_predict_active"] = q["ml_predict_checks"]
    q["forecast_grid"] = f"WITH {EVENTS}, {GRID} SELECT * FROM slots"
    q["score_features"] = f"""WITH {EVENTS}, {GRID},
hist AS (SELECT product_id, store_id, isodow(event_time) AS dow, avg(quantity) AS avg_demand,
                COUNT(*) AS n FROM ev WHERE {SALE} GROUP BY ALL)
SELECT s.*, round(COALESCE(avg_demand, 1.0), 6) AS avg_demand,
       CAST(COALESCE(n, 1) AS BIGINT) AS transaction_count
FROM slots s LEFT JOIN hist t
  ON s.product_id = t.product_id AND s.store_id = t.store_id AND s.day_of_week = t.dow"""

    # Demand shape
    q["calendar_weight"] = ev + f"SELECT event_id, round({FACTORS}, 6) AS weight FROM ev"
    q["price_adjustment"] = ev + f"""
SELECT event_id, round(adjustment, 6) AS adjustment,
       round(unit_price / nullif(adjustment, 0), 6) AS level_price
FROM (SELECT event_id, unit_price,
             (CAST(1.0 AS DOUBLE) - floor((epoch({AS_OF}) - epoch(event_time)) / 86400) / 30
               * CAST(0.005 AS DOUBLE))
             * CASE WHEN month(event_time) IN (11, 12) THEN CAST(0.85 AS DOUBLE)
                    WHEN month(event_time) IN (1, 7) THEN CAST(0.90 AS DOUBLE)
                    ELSE CAST(1.0 AS DOUBLE) END AS adjustment FROM ev)"""
    q["weighted_sample"] = ev + f"""
SELECT event_id, {EVENT_COLUMNS} FROM ev
WHERE CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE)
      / 4294967296 <= CAST(0.3 AS DOUBLE) * ({FACTORS})"""
    return q
