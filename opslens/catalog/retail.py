"""Catalog entries: retail questions and checks."""

from __future__ import annotations

from opslens.catalog.registry import entry
from opslens.catalog.sqltext import RETAIL_AS_OF, big, dbl, ratio
from opslens.functions.periods import between, period_range
from opslens.operators import retail
from opslens.sources.retail import RetailTables

AS_OF = RETAIL_AS_OF
Q4 = ("2000-10-01", "2000-12-31")
REGION = "AMERICA"


def tables(spark, location) -> RetailTables:
    return RetailTables(spark, location, AS_OF)


@entry(
    "vq_top_stores_by_revenue",
    f"""
    SELECT store_name, {dbl('SUM(revenue)')} AS total_revenue
    FROM daily_sales JOIN stores USING (store_id)
    WHERE sale_date BETWEEN DATE '2001-05-01' AND DATE '2001-05-31'
    GROUP BY store_name ORDER BY SUM(revenue) DESC, store_name LIMIT 10""",
)
def top_stores(spark, location):
    t = tables(spark, location)
    month = period_range("last month", AS_OF)
    sales = t.daily_sales(("store_id", "sale_date", "revenue"), first=month.start)
    return retail.top_stores_by_revenue(sales, t.stores(), AS_OF)


@entry(
    "vq_inventory_alerts",
    f"""
    SELECT store_name, product_name, units_on_hand, reorder_point
    FROM inventory JOIN stores USING (store_id) JOIN products_base USING (product_id)
    WHERE region = '{REGION}' AND units_on_hand < reorder_point
      AND snapshot_date = (SELECT MAX(snapshot_date) FROM inventory)""",
)
def inventory_alerts(spark, location):
    t = tables(spark, location)
    return retail.inventory_alerts(t.inventory(), t.stores(), t.products(ranked=False), REGION)


@entry(
    "vq_target_attainment",
    f"""
    WITH months AS (
        SELECT store_id, CAST(DATE_TRUNC('month', sale_date) AS DATE) AS period_month, SUM(revenue) AS actual
        FROM daily_sales WHERE sale_date BETWEEN DATE '{Q4[0]}' AND DATE '{Q4[1]}' GROUP BY ALL)
    SELECT region, {dbl('SUM(actual)')} AS actual_revenue, {dbl('SUM(target_revenue)')} AS target_revenue,
           {ratio('SUM(actual)', 'SUM(target_revenue)', 1, 100)} AS attainment_pct
    FROM months JOIN sales_targets USING (store_id, period_month) JOIN stores USING (store_id)
    GROUP BY region""",
)
def target_attainment(spark, location):
    t = tables(spark, location)
    sales = t.daily_sales(("store_id", "sale_date", "revenue"), *Q4)
    return retail.target_attainment(sales, t.sales_targets(), t.stores(), between(*Q4))


@entry(
    "vq_category_wow_drop",
    f"""
    WITH weeks AS (
        SELECT category, CAST(DATE_TRUNC('week', sale_date) AS DATE) AS week_start, SUM(revenue) AS revenue
        FROM daily_sales JOIN products_base USING (product_id) GROUP BY ALL),
    pairs AS (
        SELECT *, LAG(revenue) OVER (PARTITION BY category ORDER BY week_start) AS prev FROM weeks)
    SELECT category, week_start, {dbl('revenue')} AS revenue, {dbl('prev')} AS prev_week_revenue,
           {ratio('(revenue - prev)', 'prev', 1, 100)} AS wow_change_pct
    FROM pairs WHERE prev IS NOT NULL ORDER BY wow_change_pct, category, week_start LIMIT 10""",
)
def category_wow_drop(spark, location):
    t = tables(spark, location)
    return retail.category_wow_drop(t.daily_sales(("product_id", "sale_date", "revenue")), t.products(ranked=False))


@entry(
    "vq_sales_per_sqft",
    f"""
    SELECT store_name, sq_ft, {dbl('SUM(revenue)')} AS total_revenue, {ratio('SUM(revenue)', 'sq_ft', 2)} AS revenue_per_sqft
    FROM daily_sales JOIN stores USING (store_id) GROUP BY store_name, sq_ft
    ORDER BY revenue_per_sqft, store_name, sq_ft LIMIT 10""",
)
def sales_per_sqft(spark, location):
    t = tables(spark, location)
    return retail.sales_per_sqft(t.daily_sales(("store_id", "revenue")), t.stores())


@entry(
    "vq_staffing_vs_revenue",
    f"""
    WITH h AS (SELECT store_id, SUM(hours_worked) AS hours FROM staff_shifts
               WHERE shift_date >= DATE '2001-04-01' GROUP BY store_id),
    r AS (SELECT store_id, SUM(revenue) AS rev FROM daily_sales WHERE sale_date BETWEEN DATE '2001-04-01' AND DATE '{AS_OF}' GROUP BY store_id)
    SELECT store_name, {big('COALESCE(hours, 0)')} AS total_labor_hours, {dbl('COALESCE(rev, 0)')} AS total_revenue,
           {ratio('COALESCE(rev, 0)', 'hours', 2)} AS revenue_per_labor_hour
    FROM stores LEFT JOIN h USING (store_id) LEFT JOIN r USING (store_id)""",
)
def staffing_vs_revenue(spark, location):
    t = tables(spark, location)
    quarter = period_range("this quarter", AS_OF)
    sales = t.daily_sales(("store_id", "sale_date", "revenue"), first=quarter.start, last=AS_OF)
    return retail.staffing_vs_revenue(t.staff_shifts(quarter.start), sales, t.stores(), quarter)


@entry(
    "vq_regional_revenue",
    f"""
    SELECT region, {dbl('SUM(revenue)')} AS total_revenue FROM daily_sales JOIN stores USING (store_id)
    WHERE sale_date BETWEEN DATE '{Q4[0]}' AND DATE '{Q4[1]}' GROUP BY region""",
)
def regional_revenue(spark, location):
    t = tables(spark, location)
    return retail.regional_revenue(t.daily_sales(("store_id", "sale_date", "revenue"), *Q4), t.stores(), *Q4)


@entry(
    "vq_top_products",
    f"""
    SELECT product_name, category, {big('SUM(units_sold)')} AS total_units
    FROM daily_sales JOIN products_base USING (product_id) JOIN stores USING (store_id)
    WHERE region = '{REGION}' GROUP BY product_name, category
    ORDER BY SUM(units_sold) DESC, product_name, category LIMIT 5""",
)
def top_products(spark, location):
    t = tables(spark, location)
    sales = t.daily_sales(("store_id", "product_id", "units_sold"))
    return retail.top_products(sales, t.products(ranked=False), t.stores(), REGION)


@entry(
    "vq_online_penetration",
    f"""
    SELECT region, {ratio("SUM(revenue) FILTER (channel = 'Online')", 'SUM(revenue)', 1, 100)} AS online_pct
    FROM daily_sales JOIN stores USING (store_id) GROUP BY region""",
)
def online_penetration(spark, location):
    t = tables(spark, location)
    return retail.online_penetration(t.daily_sales(("store_id", "channel", "revenue")), t.stores())


@entry(
    "vq_return_rate_by_category",
    f"""
    SELECT category, COUNT(DISTINCT return_id) AS return_count, COUNT(DISTINCT d.sale_id) AS transaction_count,
           {ratio('COUNT(DISTINCT return_id)', 'COUNT(DISTINCT d.sale_id)', 2, 100)} AS return_rate_pct
    FROM daily_sales d JOIN products_base p ON p.product_id = d.product_id LEFT JOIN returns r ON r.sale_id = d.sale_id
    GROUP BY category""",
)
def return_rate(spark, location):
    t = tables(spark, location)
    sales = t.daily_sales(("sale_id", "product_id"))
    return retail.return_rate_by_category(sales, t.returns(), t.products(ranked=False))


@entry(
    "vq_labor_cost_pct",
    f"""
    SELECT {dbl('cost')} AS total_labor_cost, {dbl('rev')} AS total_revenue, {ratio('cost', 'rev', 2, 100)} AS labor_cost_pct
    FROM (SELECT SUM(hours_worked * hourly_wage) AS cost FROM staff_shifts WHERE shift_date >= DATE '2001-04-01'),
         (SELECT SUM(revenue) AS rev FROM daily_sales WHERE sale_date BETWEEN DATE '2001-04-01' AND DATE '{AS_OF}')""",
)
def labor_cost(spark, location):
    t = tables(spark, location)
    quarter = period_range("this quarter", AS_OF)
    sales = t.daily_sales(("sale_date", "revenue"), first=quarter.start, last=AS_OF)
    return retail.labor_cost_pct(t.staff_shifts(quarter.start), sales, quarter)


@entry(
    "vq_supplier_lead_vs_stockouts",
    f"""
    SELECT supplier, {ratio('SUM(lead_time_days)', 'COUNT(lead_time_days)', 1)} AS avg_lead_time_days,
           COUNT(*) FILTER (units_on_hand < reorder_point) AS stockout_count
    FROM inventory JOIN products_base USING (product_id)
    WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM inventory) GROUP BY supplier""",
)
def supplier_lead(spark, location):
    t = tables(spark, location)
    return retail.supplier_lead_vs_stockouts(t.inventory(), t.products(ranked=False))


@entry(
    "chk_tier_revenue",
    f"""
    SELECT performance_tier, COUNT(DISTINCT store_id) AS n_stores,
           {ratio('SUM(revenue)', 'COUNT(DISTINCT store_id)', 0)} AS avg_revenue_per_store
    FROM daily_sales JOIN stores USING (store_id) GROUP BY performance_tier""",
)
def tier_revenue(spark, location):
    t = tables(spark, location)
    return retail.revenue_per_store_by_tier(t.daily_sales(("store_id", "revenue")), t.stores())


@entry(
    "chk_product_concentration",
    f"""
    SELECT CASE WHEN popularity_rank * 10 <= (SELECT COUNT(*) FROM part) THEN 'Top 10%' ELSE 'Rest' END AS segment,
           {dbl('ROUND(SUM(revenue), 0)')} AS total_revenue
    FROM daily_sales JOIN products USING (product_id) GROUP BY segment""",
)
def concentration(spark, location):
    t = tables(spark, location)
    return retail.product_concentration(t.daily_sales(("product_id", "revenue")), t.products())


@entry(
    "chk_region_last30",
    f"""
    SELECT region, {dbl('SUM(revenue)')} AS total_revenue FROM daily_sales JOIN stores USING (store_id)
    WHERE sale_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' GROUP BY region""",
)
def region_last30(spark, location):
    t = tables(spark, location)
    sales = t.daily_sales(("store_id", "sale_date", "revenue"), first="2001-05-31", last=AS_OF)
    return retail.region_last_days(sales, t.stores(), AS_OF)
