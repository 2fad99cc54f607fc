"""Catalog entries: metrics, model checks, business asks and periods."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.catalog.registry import BODIES, entry
from opslens.catalog.retail import AS_OF, REGION, tables
from opslens.catalog.sqltext import big, dbl, quote, ratio
from opslens.functions.periods import period_range, totals_by_period
from opslens.plans import asks, checks
from opslens.plans.model import RETAIL_MODEL
from opslens.plans.query import Where, semantic_query
from opslens.plans.rollups import RollupStore
from opslens.sources import sinks
from opslens.sources.retail import SALES_COLUMNS


class ModelTables(dict):
    """The model's tables by name, built when first used."""

    def __init__(self, spark, location) -> None:
        super().__init__()
        self._retail = tables(spark, location)

    def __missing__(self, name: str) -> DataFrame:
        make = getattr(self._retail, name)
        self[name] = make(ranked=False) if name == "products" else make()
        return self[name]

    def pick(self, name: str, columns: tuple[str, ...]) -> DataFrame:
        if name != "daily_sales":
            return self[name]
        return self._retail.daily_sales([c for c in SALES_COLUMNS if c in columns])


_SALES = "daily_sales JOIN stores USING (store_id) JOIN products_base USING (product_id)"


@entry(
    "sem_query",
    f"""
    SELECT region, category, {dbl('SUM(revenue)')} AS total_revenue, {big('SUM(units_sold)')} AS total_units_sold,
           CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue) AS avg_order_value
    FROM {_SALES} WHERE sale_date >= DATE '2001-01-01'
    GROUP BY region, category ORDER BY SUM(revenue) DESC, region, category LIMIT 15""",
)
def sem_query(spark, location):
    return semantic_query(
        ModelTables(spark, location),
        ["daily_sales.total_revenue", "daily_sales.total_units_sold", "daily_sales.avg_order_value"],
        ["stores.region", "products.category"],
        [Where("daily_sales.sale_date", lambda d: d >= F.lit("2001-01-01").cast("date"))],
        order_by=["-total_revenue"],
        limit=15,
    )


@entry(
    "sem_query_multi_grain",
    f"""
    WITH a AS (SELECT region, store_type, SUM(revenue) AS revenue FROM {_SALES} GROUP BY ALL),
    b AS (SELECT region, store_type, SUM(target_revenue) AS target FROM sales_targets JOIN stores USING (store_id) GROUP BY ALL),
    c AS (SELECT region, store_type, SUM(hours_worked) AS hours FROM staff_shifts JOIN stores USING (store_id) GROUP BY ALL),
    d AS (SELECT region, store_type, COUNT(*) AS n FROM returns JOIN stores USING (store_id) GROUP BY ALL)
    SELECT region, store_type, {dbl('revenue')} AS total_revenue, {dbl('target')} AS total_target_revenue,
           {big('hours')} AS total_labor_hours, COALESCE(n, 0) AS return_count
    FROM a FULL JOIN b USING (region, store_type) FULL JOIN c USING (region, store_type) FULL JOIN d USING (region, store_type)""",
)
def sem_multi_grain(spark, location):
    return semantic_query(
        ModelTables(spark, location),
        ["total_revenue", "total_target_revenue", "total_labor_hours", "return_count"],
        ["region", "store_type"],
    )


@entry("sem_rollup_since", BODIES["sem_query"])
def sem_rollup_since(spark, location):
    made, store = ModelTables(spark, location), RollupStore(spark, sinks.work_folder(spark, "rollups"))
    metrics = ["total_revenue", "total_units_sold", "avg_order_value"]
    for groups in (["region", "category"], ["region", "category", "daily_sales.sale_date"]):
        store.build(made, [f"daily_sales.{m}" for m in metrics], groups, "first")
    since = Where("daily_sales.sale_date", lambda d: d >= F.lit("2001-01-01").cast("date"))
    return store.query(made, {"daily_sales": "first"}, metrics, ["region", "category"], [since], ["-total_revenue"], 15)


@entry("sem_rollup_multi_grain", BODIES["sem_query_multi_grain"])
def sem_rollup_multi_grain(spark, location):
    made, store = ModelTables(spark, location), RollupStore(spark, sinks.work_folder(spark, "rollups"))
    metrics = ["total_revenue", "total_target_revenue", "total_labor_hours", "return_count"]
    for metric in metrics:
        store.build(made, [metric], ["region", "store_type", "store_name"], "first")
    versions = {r.base: r.version for r in store.rollups()}
    return store.query(made, versions, metrics, ["region", "store_type"])


_ENUMS = [(d, RETAIL_MODEL.table(d.table)) for d in RETAIL_MODEL.dimensions if d.is_enum]
_SQL_NAME = {"products": "products_base"}


def _values(d) -> str:
    return ", ".join(quote(v) for v in d.values)


@entry(
    "sem_check_enum",
    " UNION ALL ".join(
        f"SELECT '{d.name}' AS dimension, {d.name} AS value, COUNT(*) AS occurrences FROM {_SQL_NAME.get(t.name, t.name)} "
        f"WHERE {d.name} NOT IN ({_values(d)}) GROUP BY {d.name}"
        for d, t in _ENUMS
    ),
)
def sem_check_enum(spark, location):
    return checks.enum_violations(ModelTables(spark, location))


@entry(
    "sem_check_enum_summary",
    " UNION ALL ".join(
        f"SELECT '{d.name}' AS dimension, COUNT(*) FILTER ({d.name} IN ({_values(d)})) AS inside, "
        f"COUNT(*) FILTER ({d.name} NOT IN ({_values(d)})) AS outside, COUNT(*) FILTER ({d.name} IS NULL) AS missing "
        f"FROM {_SQL_NAME.get(t.name, t.name)}"
        for d, t in _ENUMS
    ),
)
def sem_check_enum_summary(spark, location):
    return checks.enum_summary(ModelTables(spark, location))


@entry(
    "sem_check_pk",
    " UNION ALL ".join(
        f"SELECT '{t.name}' AS table_name, {big('SUM(n)')} AS row_count, "
        f"{big('COALESCE(SUM(n) FILTER (m), 0)')} AS null_keys, COUNT(*) FILTER (n > 1 AND NOT m) AS duplicate_keys, "
        f"{big('COALESCE(SUM(n - 1) FILTER (n > 1 AND NOT m), 0)')} AS extra_rows FROM (SELECT COUNT(*) AS n, "
        f"{' OR '.join(f'{k} IS NULL' for k in t.primary_key)} AS m FROM {_SQL_NAME.get(t.name, t.name)} GROUP BY {', '.join(t.primary_key)})"
        for t in RETAIL_MODEL.tables
    ),
)
def sem_check_pk(spark, location):
    return checks.key_violations(ModelTables(spark, location))


@entry(
    "sem_check_fk",
    " UNION ALL ".join(
        f"SELECT '{r.source}.{r.column} -> {r.target}' AS relationship, COUNT(DISTINCT {r.column}) AS orphan_keys, COUNT(*) AS orphan_rows "
        f"FROM {r.source} WHERE {r.column} NOT IN (SELECT {r.target_column} FROM {_SQL_NAME.get(r.target, r.target)})"
        for r in RETAIL_MODEL.relationships
    ),
)
def sem_check_fk(spark, location):
    return checks.orphans(ModelTables(spark, location))


# -- one gate per metric -----------------------------------------------------

_GATES = {
    "total_revenue": ("region", _SALES, dbl("SUM(revenue)")),
    "total_units_sold": ("category", _SALES, big("SUM(units_sold)")),
    "transaction_count": ("channel", "daily_sales", "COUNT(*)"),
    "avg_discount_pct": ("store_type", _SALES, "CAST(SUM(discount_pct) AS DOUBLE) / COUNT(discount_pct)"),
    "avg_order_value": ("performance_tier", _SALES, "CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue)"),
    "online_revenue_pct": (
        "region",
        _SALES,
        "CAST(SUM(CASE WHEN channel = 'Online' THEN revenue ELSE 0 END) AS DOUBLE) / NULLIF(CAST(SUM(revenue) AS DOUBLE), 0) * 100.0",
    ),
    "avg_units_on_hand": ("snapshot_date", "inventory", "CAST(SUM(units_on_hand) AS DOUBLE) / COUNT(units_on_hand)"),
    "inventory_alert_count": (
        "category",
        "inventory JOIN products_base USING (product_id)",
        "COUNT(*) FILTER (units_on_hand < reorder_point)",
    ),
    "total_units_on_order": ("supplier", "inventory JOIN products_base USING (product_id)", big("SUM(units_on_order)")),
    "total_headcount": ("shift_type", "staff_shifts", big("SUM(headcount)")),
    "total_labor_hours": ("region", "staff_shifts JOIN stores USING (store_id)", big("SUM(hours_worked)")),
    "total_labor_cost": ("store_name", "staff_shifts JOIN stores USING (store_id)", dbl("SUM(hours_worked * hourly_wage)")),
    "total_target_revenue": ("period_month", "sales_targets", dbl("SUM(target_revenue)")),
    "avg_lead_time_days": ("supplier", "products_base", "CAST(SUM(lead_time_days) AS DOUBLE) / COUNT(lead_time_days)"),
    "return_count": ("return_reason", "returns", "COUNT(*)"),
    "total_refund_amount": ("return_date", "returns", dbl("SUM(refund_amount)")),
}


def _metric_entry(metric: str, dimension: str, source: str, value: str) -> None:
    @entry(f"met_{metric}", f"SELECT {dimension}, {value} AS {metric} FROM {source} GROUP BY {dimension}")
    def query(spark, location):
        return semantic_query(ModelTables(spark, location), [metric], [dimension])


for _metric, (_dimension, _source, _value) in _GATES.items():
    _metric_entry(_metric, _dimension, _source, _value)


@entry(
    "met_return_rate_pct",
    """
    WITH s AS (SELECT category, COUNT(*) AS n FROM daily_sales JOIN products_base USING (product_id) GROUP BY category),
    r AS (SELECT category, COUNT(*) AS n FROM returns JOIN products_base USING (product_id) GROUP BY category)
    SELECT category, CAST(COALESCE(r.n, 0) AS DOUBLE) / NULLIF(CAST(s.n AS DOUBLE), 0) * 100.0 AS return_rate_pct
    FROM s FULL JOIN r USING (category)""",
)
def met_return_rate(spark, location):
    return semantic_query(ModelTables(spark, location), ["return_rate_pct"], ["category"])


@entry(
    "met_return_rate_pct_promo",
    """
    WITH s AS (SELECT promo_name, COUNT(*) AS n FROM daily_sales GROUP BY promo_name),
    r AS (SELECT promo_name, COUNT(*) AS n FROM returns LEFT JOIN daily_sales USING (sale_id) GROUP BY promo_name)
    SELECT s.promo_name, CAST(COALESCE(r.n, 0) AS DOUBLE) / NULLIF(CAST(s.n AS DOUBLE), 0) * 100.0 AS return_rate_pct
    FROM s FULL JOIN r ON s.promo_name IS NOT DISTINCT FROM r.promo_name""",
)
def met_return_rate_promo(spark, location):
    return semantic_query(ModelTables(spark, location), ["return_rate_pct"], ["promo_name"])


# -- business asks -----------------------------------------------------------


@entry(
    "ask_revenue_by",
    f"""
    SELECT performance_tier, {dbl('SUM(revenue)')} AS total_revenue FROM daily_sales JOIN stores USING (store_id)
    WHERE sale_date >= DATE '2001-01-01' AND sale_date < DATE '2001-04-01' GROUP BY performance_tier""",
)
def ask_revenue_by(spark, location):
    return asks.revenue_by(ModelTables(spark, location), "performance tier", "last quarter", AS_OF)


@entry(
    "ask_inventory_alerts",
    """
    SELECT store_name, product_name, units_on_hand, reorder_point
    FROM inventory JOIN stores USING (store_id) JOIN products_base USING (product_id)
    WHERE region = 'EUROPE' AND units_on_hand < reorder_point AND snapshot_date = (SELECT MAX(snapshot_date) FROM inventory)""",
)
def ask_inventory_alerts(spark, location):
    return asks.inventory_alerts(ModelTables(spark, location), "EUROPE")


@entry(
    "ask_target_attainment",
    f"""
    WITH months AS (
        SELECT store_id, CAST(DATE_TRUNC('month', sale_date) AS DATE) AS period_month, SUM(revenue) AS actual
        FROM daily_sales WHERE sale_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' GROUP BY ALL)
    SELECT store_type, {dbl('SUM(actual)')} AS actual_revenue, {dbl('SUM(target_revenue)')} AS target_revenue,
           {ratio('SUM(actual)', 'SUM(target_revenue)', 1, 100)} AS attainment_pct
    FROM months JOIN sales_targets USING (store_id, period_month) JOIN stores USING (store_id) GROUP BY store_type""",
)
def ask_target_attainment(spark, location):
    return asks.target_attainment(ModelTables(spark, location), "store type", "year to date", AS_OF)


@entry(
    "ask_staffing_vs_revenue",
    f"""
    WITH h AS (SELECT store_id, SUM(hours_worked) AS hours FROM staff_shifts
               WHERE shift_date >= DATE '2000-10-01' AND shift_date < DATE '2001-01-01' GROUP BY store_id),
    r AS (SELECT store_id, SUM(revenue) AS rev FROM daily_sales
          WHERE sale_date >= DATE '2000-10-01' AND sale_date < DATE '2001-01-01' GROUP BY store_id)
    SELECT store_name, {big('COALESCE(hours, 0)')} AS total_labor_hours, {dbl('COALESCE(rev, 0)')} AS total_revenue,
           {ratio('COALESCE(rev, 0)', 'hours', 2)} AS revenue_per_labor_hour
    FROM stores LEFT JOIN h USING (store_id) LEFT JOIN r USING (store_id)""",
)
def ask_staffing(spark, location):
    return asks.staffing_vs_revenue(ModelTables(spark, location), "Q4 2000", AS_OF)


@entry(
    "ask_return_rate",
    f"""
    SELECT 'Electronics' AS category, r AS return_count, s AS transaction_count, {ratio('r', 's', 2, 100)} AS return_rate_pct
    FROM (SELECT COUNT(*) AS s FROM daily_sales JOIN products_base USING (product_id) WHERE category = 'Electronics'),
         (SELECT COUNT(*) AS r FROM returns JOIN products_base USING (product_id) WHERE category = 'Electronics')""",
)
def ask_return_rate(spark, location):
    return asks.return_rate(ModelTables(spark, location), "Electronics")


@entry(
    "ask_returns_by_reason",
    "SELECT return_reason, COUNT(*) AS return_count FROM returns WHERE lower(return_reason) = 'not as described' GROUP BY return_reason",
)
def ask_returns_by_reason(spark, location):
    return asks.returns_by_reason(ModelTables(spark, location), "NOT as described")


@entry(
    "ask_top_products",
    f"""
    SELECT product_name, category, {big('SUM(units_sold)')} AS total_units
    FROM {_SALES} WHERE region = '{REGION}' GROUP BY product_name, category
    ORDER BY SUM(units_sold) DESC, product_name, category LIMIT 3""",
)
def ask_top_products(spark, location):
    return asks.top_products(ModelTables(spark, location), 3, REGION)


@entry(
    "ask_supplier_lead_time",
    "SELECT supplier, CAST(SUM(lead_time_days) AS DOUBLE) / COUNT(lead_time_days) AS avg_lead_time_days FROM products_base GROUP BY supplier",
)
def ask_supplier_lead_time(spark, location):
    return asks.supplier_lead_time(ModelTables(spark, location))


@entry(
    "ask_compare",
    f"""
    SELECT category, {dbl("SUM(revenue) FILTER (sale_date >= DATE '2001-01-01' AND sale_date < DATE '2001-04-01')")} AS q1,
           {dbl("SUM(revenue) FILTER (sale_date >= DATE '2000-10-01' AND sale_date < DATE '2001-01-01')")} AS q4
    FROM daily_sales JOIN products_base USING (product_id)
    WHERE sale_date >= DATE '2000-10-01' AND sale_date < DATE '2001-04-01' GROUP BY category""",
)
def ask_compare(spark, location):
    t = ModelTables(spark, location)
    same = {"tables": t, "dimension": "category", "as_of": AS_OF}
    slots = {"q1": {**same, "period": "Q1 2001"}, "q4": {**same, "period": "Q4 2000"}}
    return asks.compare(asks.revenue_by, slots, ["category"], "total_revenue")


_PERIODS = [period_range(p, AS_OF) for p in (*fv.RELATIVE_PERIODS, "Q4 2000", "Q1 2001")]


_DAY = f"DATE '{AS_OF}'"
_BOUNDS = {
    "last month": ("DATE_TRUNC('month', day) - INTERVAL 1 MONTH", "DATE_TRUNC('month', day)"),
    "this month": ("DATE_TRUNC('month', day)", "day + 1"),
    "last quarter": ("DATE_TRUNC('quarter', day) - INTERVAL 3 MONTH", "DATE_TRUNC('quarter', day)"),
    "this quarter": ("DATE_TRUNC('quarter', day)", "day + 1"),
    "year to date": ("DATE_TRUNC('year', day)", "day + 1"),
    "last week": ("DATE_TRUNC('week', day) - INTERVAL 7 DAY", "DATE_TRUNC('week', day)"),
    "Q4 2000": ("DATE '2000-10-01'", "DATE '2000-10-01' + INTERVAL 3 MONTH"),
    "Q1 2001": ("DATE '2001-01-01'", "DATE '2001-01-01' + INTERVAL 3 MONTH"),
}


def _bounds(name: str) -> tuple[str, str]:
    trailing = re.fullmatch(r"last (\d+) days", name)
    return (f"day - {trailing[1]}", "day + 1") if trailing else _BOUNDS[name]


@entry(
    "period_range",
    "WITH p AS ("
    + " UNION ALL ".join(
        f"SELECT '{p.name}' AS period, CAST({_bounds(p.name)[0]} AS DATE) AS period_start, CAST({_bounds(p.name)[1]} AS DATE) AS period_end "
        f"FROM (SELECT {_DAY} AS day)"
        for p in _PERIODS
    )
    + f""")
    SELECT period, period_start, period_end, COUNT(sale_date) AS lines, {dbl('SUM(revenue)')} AS revenue
    FROM p LEFT JOIN daily_sales ON sale_date >= period_start AND sale_date < period_end GROUP BY ALL""",
)
def periods(spark, location):
    first = min(p.start for p in _PERIODS)
    sales = tables(spark, location).daily_sales(("sale_date", "revenue"), first=first)
    return totals_by_period(sales, "sale_date", _PERIODS, {"lines": F.lit(1), "revenue": F.col("revenue")})
