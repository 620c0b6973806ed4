"""Independent DuckDB SQL for every SQL-expressible query.

Each query is written against the raw test tables (views named like the
parquet files).  Shared derivations are CTE fragments; ``sql(deps, body)``
assembles the WITH clause in dependency order.  The SQL repeats the
semantics from the operator docstrings, not the Spark code: integer money
units, NULLIF for safe division, explicit window frames.
"""

from __future__ import annotations


def c2(x: str) -> str:
    """DOUBLE with two exact decimals -> BIGINT hundredths."""
    return f"CAST(round({x} * 100) AS BIGINT)"


def u0(x: str) -> str:
    return f"CAST(round({x}) AS BIGINT)"


def dbl(x: str, scale: int) -> str:
    return f"(CAST({x} AS DOUBLE) / {float(10 ** scale)!r}::DOUBLE)"


MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def month_of(period: str) -> str:
    return f"{MONTHS}[CAST(substr({period}, 6, 2) AS INTEGER)]"


def per(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m')"


CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTE[name] = (deps, body)


cte("pl_u", [], f"""
SELECT l_suppkey AS entity, {per('l_shipdate')} AS period,
  sum({c2('l_extendedprice')}) * 100 AS sales4,
  sum({c2('l_extendedprice')} * {c2('l_tax')}) AS other4,
  sum({u0('l_quantity')} * {c2('p_retailprice')}) * 100 AS cogs4,
  sum(CASE WHEN l_linenumber = 1 THEN {c2('l_extendedprice')} ELSE 0 END) * 100 AS opex4,
  sum(CASE WHEN l_linenumber = 7 THEN {c2('l_extendedprice')} ELSE 0 END) * 100 AS salary4,
  sum({c2('l_extendedprice')} * {c2('l_discount')}) AS fee4
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2""")

cte("pl_d", ["pl_u"], f"""
SELECT entity, period, {month_of('period')} AS month,
  {dbl('sales4', 4)} AS sales_value,
  {dbl('sales4 + other4', 4)} AS total_incomes,
  {dbl('cogs4', 4)} AS cogs,
  {dbl('sales4 + other4 - cogs4', 4)} AS gross_profit,
  {dbl('opex4', 4)} AS operational_expenses,
  {dbl('salary4', 4)} AS staff_salary,
  {dbl('fee4', 4)} AS foodmandu_charges,
  {dbl('opex4 + salary4 + fee4', 4)} AS total_expenses,
  {dbl('sales4 + other4 - cogs4 - (opex4 + salary4 + fee4)', 4)} AS profit,
  {dbl('other4', 4)} AS bread_income
FROM pl_u""")

PL_SELECT = """entity, period, month, sales_value, total_incomes, cogs, gross_profit,
  gross_profit / NULLIF(total_incomes, 0) AS gross_margin,
  cogs / NULLIF(total_incomes, 0) AS cogs_ratio,
  operational_expenses, staff_salary, foodmandu_charges, total_expenses, profit,
  profit / NULLIF(total_incomes, 0) AS profit_margin, bread_income,
  staff_salary / NULLIF(sales_value, 0) AS salary_to_sales"""

cte("pl", ["pl_d"], f"SELECT {PL_SELECT} FROM pl_d")


def _net() -> str:
    return f"{c2('l_extendedprice')} * (100 - {c2('l_discount')})"


cte("ms_u", [], f"""
SELECT l_suppkey AS entity, {per('o_orderdate')} AS period,
  sum({c2('l_extendedprice')}) * 100 AS gross4,
  sum({c2('l_extendedprice')} * {c2('l_discount')}) AS disc4,
  sum({c2('l_extendedprice')} * {c2('l_tax')}) AS vat4,
  sum({_net()}) AS net4,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN {_net()} ELSE 0 END) AS cash4,
  sum(CASE WHEN o_orderpriority = '2-HIGH' THEN {_net()} ELSE 0 END) AS foodmandu4,
  sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN {_net()} ELSE 0 END) AS pokhara4,
  sum(CASE WHEN o_orderpriority = '5-LOW' THEN {_net()} ELSE 0 END) AS credit4
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2""")

cte("ms_d", ["ms_u"], f"""
SELECT entity, period, {month_of('period')} AS month, CAST(substr(period, 6, 2) AS INTEGER) AS month_num,
  {dbl('gross4', 4)} AS total_sales, {dbl('disc4', 4)} AS discount, {dbl('vat4', 4)} AS vat,
  {dbl('net4', 4)} AS net_sales, {dbl('cash4', 4)} AS cash_sales, {dbl('foodmandu4', 4)} AS foodmandu_sales,
  {dbl('pokhara4', 4)} AS pokhara_sales, {dbl('credit4', 4)} AS credit_sales
FROM ms_u""")

cte("ms", ["ms_d"], """
SELECT entity, period, month, month_num, total_sales, discount,
  discount / NULLIF(total_sales, 0) AS discount_pct, vat, net_sales,
  cash_sales, cash_sales / NULLIF(net_sales, 0) AS cash_pct,
  foodmandu_sales, foodmandu_sales / NULLIF(net_sales, 0) AS foodmandu_pct,
  pokhara_sales, pokhara_sales / NULLIF(net_sales, 0) AS pokhara_pct,
  credit_sales, credit_sales / NULLIF(net_sales, 0) AS credit_pct
FROM ms_d""")

_SIGNED = f"CASE WHEN l_linestatus = 'F' THEN {c2('l_extendedprice')} ELSE -{c2('l_extendedprice')} END"

cte("pmov", [], f"""
SELECT l_suppkey AS entity, {per('l_shipdate')} AS period, p_brand AS party, 'creditor' AS type,
  sum({_SIGNED}) AS mov2
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
UNION ALL
SELECT l_suppkey, {per('l_shipdate')}, 'customer-' || CAST(o_custkey % 10 AS VARCHAR), 'debtor',
  sum({_SIGNED})
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")

cte("parties", ["pmov"], f"""
SELECT entity, period, type, trim(party) AS party,
  {dbl('close2 - mov2', 2)} AS opening, {dbl('close2', 2)} AS closing, {dbl('mov2', 2)} AS movement
FROM (SELECT *, sum(mov2) OVER (PARTITION BY entity, type, party ORDER BY period
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close2 FROM pmov)
WHERE party IS NOT NULL AND lower(trim(party)) <> '' AND close2 IS NOT NULL
  AND NOT contains(lower(trim(party)), 'grand total') AND lower(trim(party)) <> 'total'""")

cte("waste", [], f"""
SELECT entity, period, trim(item) AS item, CAST(ktm AS DOUBLE) AS ktm, CAST(pkr AS DOUBLE) AS pkr,
  CAST(coalesce(NULLIF(tot, 0), ktm + pkr) AS DOUBLE) AS total
FROM (SELECT l_suppkey AS entity, {per('l_shipdate')} AS period, p_type AS item,
        sum(CASE WHEN l_linestatus = 'O' THEN {u0('l_quantity')} ELSE 0 END) AS ktm,
        sum(CASE WHEN l_linestatus = 'F' THEN {u0('l_quantity')} ELSE 0 END) AS pkr,
        sum({u0('l_quantity')}) AS tot
      FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
WHERE item IS NOT NULL AND lower(trim(item)) <> ''
  AND lower(trim(item)) NOT IN ('pizza', 'bansbari', 'total') AND NOT starts_with(lower(trim(item)), 'total')""")

cte("cat", [], f"""
SELECT l_suppkey AS entity, trim(p_brand) AS category, CAST(sum({u0('l_quantity')}) AS DOUBLE) AS qty,
  {dbl(f"sum({c2('l_extendedprice')})", 2)} AS value
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2""")

cte("daily", [], f"""
SELECT entity, date,
  {dbl('coalesce(cash2, 0)', 2)} AS cash, {dbl('coalesce(online2, 0)', 2)} AS online,
  {dbl('coalesce(credit2, 0)', 2)} AS credit, {dbl('total2', 2)} AS total_sales,
  CAST(customers AS BIGINT) AS customers, {dbl('dine_in2', 2)} AS dine_in_sales,
  CASE WHEN customers <> 0 AND dine_in2 <> 0 THEN {dbl('dine_in2', 2)} / CAST(customers AS DOUBLE) END AS avg_ticket,
  dayname(date) AS day_of_week, CAST(isodow(date) - 1 AS INTEGER) AS dow
FROM (SELECT user_id // 3 AS entity, CAST(ts AS DATE) AS date,
        sum(CASE WHEN event_type = 'purchase' THEN {c2('value')} ELSE 0 END) AS cash2,
        sum(CASE WHEN event_type = 'click' THEN {c2('value')} ELSE 0 END) AS online2,
        sum(CASE WHEN event_type = 'view' THEN {c2('value')} ELSE 0 END) AS credit2,
        sum(CASE WHEN event_type = 'signup' THEN {c2('value')} END) AS dine_in2,
        sum({c2('value')}) AS total2, count(DISTINCT user_id) AS customers
      FROM events GROUP BY 1, 2)
WHERE total2 IS NOT NULL AND year(date) >= 2020 AND total2 <= 50000000""")

cte("fm0", ["pl", "ms", "parties", "waste"], f"""
SELECT pl.*, ms.net_sales, ms.cash_pct, ms.foodmandu_pct, ms.pokhara_pct, ms.credit_pct, ms.discount_pct,
  ms.cash_sales, ms.foodmandu_sales, ms.credit_sales, pt.creditor_total, pt.debtor_total, wt.wastage_units
FROM pl
LEFT JOIN ms USING (entity, period)
LEFT JOIN (SELECT entity, period,
             {dbl(f"sum(CASE WHEN type = 'creditor' THEN {c2('closing')} END)", 2)} AS creditor_total,
             {dbl(f"sum(CASE WHEN type = 'debtor' THEN {c2('closing')} END)", 2)} AS debtor_total
           FROM parties GROUP BY 1, 2) pt USING (entity, period)
LEFT JOIN (SELECT entity, period, sum(total) AS wastage_units FROM waste GROUP BY 1, 2) wt USING (entity, period)""")

_W = "PARTITION BY entity ORDER BY period"


def _fill(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")


cte("fm1", ["fm0"], f"""
SELECT * EXCLUDE (creditor_total, debtor_total, wastage_units),
  sales_value / NULLIF(lag(sales_value) OVER ({_W}), 0) - 1.0 AS sales_mom_pct,
  cogs / NULLIF(lag(cogs) OVER ({_W}), 0) - 1.0 AS cogs_mom_pct,
  profit / NULLIF(lag(profit) OVER ({_W}), 0) - 1.0 AS profit_mom_pct,
  cash_pct * net_sales AS liquidity_proxy,
  coalesce(foodmandu_pct, 0.0::DOUBLE) AS platform_dependency,
  coalesce(credit_pct, 0.0::DOUBLE) AS credit_exposure,
  {_fill('creditor_total')}, {_fill('debtor_total')}, {_fill('wastage_units')}
FROM fm0""")

STRESS_SQL = """CAST((coalesce(profit_margin, 1.0::DOUBLE) < 0.08::DOUBLE
   OR coalesce(cogs_ratio, 0.0::DOUBLE) > 0.52::DOUBLE
   OR (coalesce(margin_pressure, 0.0::DOUBLE) > 0.05::DOUBLE AND coalesce(profit_margin, 1.0::DOUBLE) < 0.12::DOUBLE)) AS INTEGER)"""

FM_COLS = """entity, period, month, sales_value, total_incomes, cogs, gross_profit, gross_margin, cogs_ratio,
  operational_expenses, staff_salary, foodmandu_charges, total_expenses, profit, profit_margin, bread_income,
  salary_to_sales, net_sales, cash_pct, foodmandu_pct, pokhara_pct, credit_pct, discount_pct, cash_sales,
  foodmandu_sales, credit_sales, creditor_total, debtor_total, wastage_units, sales_mom_pct, cogs_mom_pct,
  profit_mom_pct, margin_pressure, liquidity_proxy, platform_dependency, credit_exposure, stress"""

cte("fm2", ["fm1"], "SELECT *, cogs_mom_pct - sales_mom_pct AS margin_pressure FROM fm1")

cte("fm", ["fm2"], f"SELECT {FM_COLS} FROM (SELECT *, {STRESS_SQL} AS stress FROM fm2)")


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTE[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(deps: list[str], body: str) -> str:
    names = _order(deps)
    if not names:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTE[n][1].strip()})" for n in names)
    return f"WITH {parts}\n{body.strip()}"


ORACLE: dict[str, str] = {}


def oracle(name: str, deps: list[str], body: str) -> None:
    ORACLE[name] = sql(deps, body)


oracle("monthly_pl", ["pl"], "SELECT * FROM pl")
oracle("monthly_sales", ["ms"], "SELECT * FROM ms")
oracle("party_balances", ["parties"], "SELECT * FROM parties")
oracle("wastage", ["waste"], "SELECT * FROM waste")
oracle("category_sales", ["cat"], "SELECT * FROM cat")
oracle("daily_sales", ["daily"], "SELECT * FROM daily")
oracle("daily_dropped", [], f"""
SELECT count(*) FILTER (WHERE NOT coalesce(total2 IS NOT NULL AND year(date) >= 2020 AND total2 <= 50000000, false)) AS dropped
FROM (SELECT user_id // 3 AS entity, CAST(ts AS DATE) AS date, sum({c2('value')}) AS total2 FROM events GROUP BY 1, 2)""")
oracle("feature_matrix", ["fm"], "SELECT * FROM fm")
oracle("stress_label", ["fm"], """
SELECT entity, period, profit_margin, cogs_ratio, margin_pressure, stress FROM fm""")
oracle("mom_change", ["pl"], f"""
SELECT entity, period, sales_mom_pct, cogs_mom_pct, profit_mom_pct, cogs_mom_pct - sales_mom_pct AS margin_pressure
FROM (SELECT entity, period,
        sales_value / NULLIF(lag(sales_value) OVER ({_W}), 0) - 1.0 AS sales_mom_pct,
        cogs / NULLIF(lag(cogs) OVER ({_W}), 0) - 1.0 AS cogs_mom_pct,
        profit / NULLIF(lag(profit) OVER ({_W}), 0) - 1.0 AS profit_mom_pct
      FROM pl)""")
oracle("party_totals", ["parties"], f"""
SELECT entity, period,
  {dbl(f"sum(CASE WHEN type = 'creditor' THEN {c2('closing')} END)", 2)} AS creditor_total,
  {dbl(f"sum(CASE WHEN type = 'debtor' THEN {c2('closing')} END)", 2)} AS debtor_total
FROM parties GROUP BY 1, 2""")
oracle("wastage_totals", ["waste"], "SELECT entity, period, sum(total) AS wastage_units FROM waste GROUP BY 1, 2")
oracle("fill_totals", ["fm"], "SELECT entity, period, creditor_total, debtor_total, wastage_units FROM fm")


# ====================================================================== descriptive
from ..operators.descriptive import DESCRIBE_DAILY, DESCRIBE_FEATURES, DESCRIBE_PL, KPI_METRICS  # noqa: E402
from ..operators.diagnostic import GRANGER_PAIRS, VARIANCE_COMPONENTS  # noqa: E402


def q(x: str, digits: int) -> str:
    s = float(10 ** digits)
    return f"(floor(({x}) * {s!r}::DOUBLE + 0.5::DOUBLE) / {s!r}::DOUBLE)"


def xstd(n: str, sx: str, sxx: str, scale: int) -> str:
    """Sample std from exact sums; the big numerator goes through VARCHAR so
    its conversion to DOUBLE is correctly rounded."""
    num = f"CAST(CAST(({n}) * ({sxx}) - ({sx}) * ({sx}) AS VARCHAR) AS DOUBLE)"
    den = f"((CAST({n} AS DOUBLE) * CAST(({n}) - 1 AS DOUBLE)) * {float(10 ** (2 * scale))!r}::DOUBLE)"
    return f"(CASE WHEN {n} >= 2 THEN sqrt({num} / {den}) END)"


def xmean(n: str, sx: str, scale: int) -> str:
    return f"(CASE WHEN {n} > 0 THEN {dbl(sx, scale)} / CAST({n} AS DOUBLE) END)"


def h(x: str) -> str:
    return f"CAST({x} AS HUGEINT)"


cte("lt2", ["fm"], """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS rn FROM fm) WHERE rn <= 2""")

_kpi_aggs = ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS {c}__l, max(CASE WHEN rn = 2 THEN {c} END) AS {c}__p"
                      for _, c in KPI_METRICS)
_kpi_rows = "\nUNION ALL\n".join(
    f"SELECT entity, {i} AS metric_order, '{label}' AS metric, CAST({c}__l AS DOUBLE) AS latest, "
    f"CAST(CASE WHEN n_rows = 1 THEN {c}__l ELSE {c}__p END AS DOUBLE) AS previous FROM kg"
    for i, (label, c) in enumerate(KPI_METRICS))
oracle("kpi_change", ["lt2"], f"""
, kg AS (SELECT entity, max(rn) AS n_rows, {_kpi_aggs} FROM lt2 GROUP BY entity)
SELECT *, CASE WHEN latest IS NOT NULL AND previous IS NOT NULL AND previous <> 0
               THEN (latest - previous) / abs(previous) END AS change_pct
FROM ({_kpi_rows})""")

oracle("channel_mix", ["ms"], """
SELECT entity, period, month, net_sales, cash_pct, foodmandu_pct, pokhara_pct, credit_pct
FROM ms WHERE net_sales IS NOT NULL""")

cte("trend", ["ms"], """
SELECT entity, CAST(substr(period, 1, 4) AS INTEGER) AS year, month, month_num, net_sales AS sales
FROM ms WHERE net_sales IS NOT NULL""")
oracle("sales_trend", ["trend"], "SELECT * FROM trend")


def _pct(v: str, n: str, p: float) -> str:
    pos = f"(CAST({n} - 1 AS DOUBLE) * {p!r}::DOUBLE)"
    lo = f"{v}[CAST(floor({pos}) AS BIGINT) + 1]"
    hi = f"{v}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN ceil({pos}) = floor({pos}) OR {lo} = {hi} THEN {lo} "
            f"ELSE (ceil({pos}) - {pos}) * {lo} + ({pos} - floor({pos})) * {hi} END)")


def describe_sql(src: str, cols: list[str]) -> str:
    long = "\nUNION ALL\n".join(f"SELECT entity, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}"
                                for c in cols)
    return f"""
, dl AS ({long}),
dg AS (SELECT entity, feature, count(value) AS cnt, avg(value) AS m, stddev_samp(value) AS s, min(value) AS mn,
              max(value) AS mx, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS v
       FROM dl GROUP BY 1, 2)
SELECT entity, feature, cnt AS count, {q('m', 4)} AS mean, {q('s', 4)} AS std, mn AS min,
  {_pct('v', 'cnt', 0.25)} AS q25, {_pct('v', 'cnt', 0.5)} AS q50, {_pct('v', 'cnt', 0.75)} AS q75, mx AS max
FROM dg"""


oracle("describe_pl", ["pl"], describe_sql("pl", DESCRIBE_PL))
oracle("describe_daily", ["daily"], describe_sql("daily", DESCRIBE_DAILY))
oracle("describe_features", ["fm"], describe_sql("fm", DESCRIBE_FEATURES))

_u4s = "CAST(round(sales * 10000.0::DOUBLE) AS BIGINT)"
oracle("sales_volatility", ["trend"], f"""
SELECT entity, year, n, {xmean('n', 'sx', 4)} AS mean, {xstd('n', 'sx', 'sxx', 4)} AS std,
  {xstd('n', 'sx', 'sxx', 4)} / NULLIF({xmean('n', 'sx', 4)}, 0) AS cv
FROM (SELECT entity, year, count(sales) AS n, sum({_u4s}) AS sx, sum({h(_u4s)} * {h(_u4s)}) AS sxx
      FROM trend GROUP BY 1, 2)""")

_c2t = c2("total_sales")
oracle("daily_volatility", ["daily"], f"""
SELECT entity, n, {xmean('n', 'sx', 2)} AS mean, {xstd('n', 'sx', 'sxx', 2)} AS std,
  {xstd('n', 'sx', 'sxx', 2)} / NULLIF({xmean('n', 'sx', 2)}, 0) AS cv
FROM (SELECT entity, count(total_sales) AS n, sum({_c2t}) AS sx, sum({h(_c2t)} * {h(_c2t)}) AS sxx
      FROM daily GROUP BY 1)""")

oracle("dow_seasonality", ["daily"], f"""
SELECT entity, dow, dow_mean, overall_mean, dow_mean / NULLIF(overall_mean, 0) AS seasonal
FROM (SELECT entity, dow, {xmean('n', 'sx', 2)} AS dow_mean, {xmean('n_all', 'sx_all', 2)} AS overall_mean
      FROM (SELECT *, sum(n) OVER (PARTITION BY entity) AS n_all, sum(sx) OVER (PARTITION BY entity) AS sx_all
            FROM (SELECT entity, dow, count(*) AS n, sum({_c2t}) AS sx FROM daily GROUP BY 1, 2)))""")

oracle("stockout_proxy", ["cat"], f"""
SELECT entity, rank, category, qty, value, share, stockout_risk_score FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY stockout_risk_score DESC, category) AS rank FROM (
    SELECT *, least(greatest(share * 100.0::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE) AS stockout_risk_score FROM (
      SELECT *, CASE WHEN {dbl('total2', 2)} <> 0 THEN value / {dbl('total2', 2)} ELSE 0.0::DOUBLE END AS share
      FROM (SELECT *, sum({c2('value')}) OVER (PARTITION BY entity) AS total2 FROM cat))))
WHERE rank <= 10""")

# ====================================================================== quality
oracle("source_coverage", ["pl"], """
SELECT entity, count(DISTINCT period) AS periods,
  CASE WHEN count(DISTINCT period) >= 5 THEN 'per_file' ELSE 'legacy' END AS route
FROM pl GROUP BY entity""")

cte("dq_nc", ["ms", "pl", "daily", "parties"], """
SELECT 0 AS o, 'monthly_sales_2026' AS dataset, 'net_sales' AS col, count(*) AS rows, count_if(net_sales IS NULL) AS nulls FROM ms WHERE net_sales IS NOT NULL
UNION ALL SELECT 0, 'monthly_sales_2026', 'cash_pct', count(*), count_if(cash_pct IS NULL) FROM ms WHERE net_sales IS NOT NULL
UNION ALL SELECT 1, 'monthly_pl', 'sales_value', count(*), count_if(sales_value IS NULL) FROM pl
UNION ALL SELECT 1, 'monthly_pl', 'cogs', count(*), count_if(cogs IS NULL) FROM pl
UNION ALL SELECT 1, 'monthly_pl', 'gross_profit', count(*), count_if(gross_profit IS NULL) FROM pl
UNION ALL SELECT 1, 'monthly_pl', 'profit', count(*), count_if(profit IS NULL) FROM pl
UNION ALL SELECT 2, 'daily_sales', 'total_sales', count(*), count_if(total_sales IS NULL) FROM daily
UNION ALL SELECT 2, 'daily_sales', 'cash', count(*), count_if(cash IS NULL) FROM daily
UNION ALL SELECT 2, 'daily_sales', 'online', count(*), count_if(online IS NULL) FROM daily
UNION ALL SELECT 3, 'creditors', 'closing', count(*), count_if(closing IS NULL) FROM parties WHERE type = 'creditor'
UNION ALL SELECT 4, 'debtors', 'closing', count(*), count_if(closing IS NULL) FROM parties WHERE type = 'debtor'""")

oracle("dq_completeness", ["dq_nc"], """
SELECT dataset, rows, CASE WHEN rows = 0 THEN 0.0::DOUBLE
  ELSE 1.0::DOUBLE - CAST(nulls AS DOUBLE) / CAST(rows * n_cols AS DOUBLE) END AS completeness
FROM (SELECT o, dataset, max(rows) AS rows, sum(nulls) AS nulls, count(*) AS n_cols FROM dq_nc GROUP BY 1, 2)""")

oracle("dq_issues", ["dq_nc"], f"""
, cov AS (SELECT (SELECT count(DISTINCT period) FROM pl) AS m, (SELECT count(DISTINCT date) FROM daily) AS d)
SELECT o AS dataset_order, dataset, 'Empty dataset' AS issue, 'High' AS severity, 'No rows extracted' AS detail
FROM (SELECT o, dataset, max(rows) AS rows FROM dq_nc GROUP BY 1, 2) WHERE rows = 0
UNION ALL
SELECT o, dataset, 'Missing values', CASE WHEN CAST(nulls AS DOUBLE) / CAST(rows AS DOUBLE) < 0.3::DOUBLE THEN 'Medium' ELSE 'High' END,
  col || ': ' || CAST(CAST({q('CAST(nulls AS DOUBLE) / CAST(rows AS DOUBLE) * 100.0::DOUBLE', 0)} AS BIGINT) AS VARCHAR) || '% missing'
FROM dq_nc WHERE rows > 0 AND nulls > 0
UNION ALL
SELECT 90, 'coverage', CASE WHEN m >= 6 THEN 'Full' ELSE 'Partial' END || ' ' || CAST(m AS VARCHAR) || '-month window',
  CASE WHEN m >= 6 THEN 'Low' ELSE 'Medium' END,
  'P&L for ' || CAST(m AS VARCHAR) || ' months loaded; daily grain for ' || CAST(d AS VARCHAR) || ' days' FROM cov
UNION ALL
SELECT 91, 'schema', 'Semi-structured Excel', 'Low', 'Headers irregular; values extracted via label/column mapping'""")

# ====================================================================== diagnostic
_vd_aggs = ", ".join(f"max(CASE WHEN rn = 1 THEN coalesce({c}, 0.0::DOUBLE) END) AS {c}__l, "
                     f"max(CASE WHEN rn = 2 THEN coalesce({c}, 0.0::DOUBLE) END) AS {c}__p"
                     for _, c, _ in VARIANCE_COMPONENTS)
_vd_rows = "\nUNION ALL\n".join(
    f"SELECT entity, {i} AS component_order, '{label}' AS component, {c}__l - {c}__p AS value, '{note}' AS note FROM vg"
    for i, (label, c, note) in enumerate(VARIANCE_COMPONENTS))
cte("vd", ["lt2"], f"""
WITH vg AS (SELECT entity, max(rn) AS n_rows, max(CASE WHEN rn = 1 THEN margin_pressure END) AS mp, {_vd_aggs}
            FROM lt2 GROUP BY entity HAVING max(rn) >= 2)
{_vd_rows}
UNION ALL
SELECT entity, {len(VARIANCE_COMPONENTS)}, 'Margin Pressure', mp, 'COGS MoM% − Sales MoM%' FROM vg""")
oracle("variance_decomposition", ["vd"], "SELECT * FROM vd")

_x, _y = c2("sales_value"), c2("cogs")
cte("elast", ["pl"], f"""
SELECT entity, n, CASE WHEN my <> 0 THEN slope * mx / my END AS elasticity, r2, slope, my - slope * mx AS intercept
FROM (SELECT entity, n, CASE WHEN n >= 3 AND cxx <> 0 THEN cxy / cxx END AS slope,
        CAST(sx AS DOUBLE) / 100.0::DOUBLE / CAST(n AS DOUBLE) AS mx,
        CAST(sy AS DOUBLE) / 100.0::DOUBLE / CAST(n AS DOUBLE) AS my,
        CASE WHEN n >= 3 AND cxx <> 0 AND cyy <> 0 THEN (cxy / cxx) * (cxy / cyy) END AS r2
      FROM (SELECT entity, n, sx, sy,
              CAST(CAST(n * sxx - {h('sx')} * sx AS VARCHAR) AS DOUBLE) AS cxx,
              CAST(CAST(n * syy - {h('sy')} * sy AS VARCHAR) AS DOUBLE) AS cyy,
              CAST(CAST(n * sxy - {h('sx')} * sy AS VARCHAR) AS DOUBLE) AS cxy
            FROM (SELECT entity, count(*) AS n, sum({_x}) AS sx, sum({_y}) AS sy,
                    sum({h(_x)} * {h(_x)}) AS sxx, sum({h(_y)} * {h(_y)}) AS syy, sum({h(_x)} * {h(_y)}) AS sxy
                  FROM pl WHERE sales_value IS NOT NULL AND cogs IS NOT NULL GROUP BY 1)))""")
oracle("cost_elasticity", ["elast"], "SELECT * FROM elast")


def _granger_sql(i: int, cause: str, effect: str, label: str) -> str:
    return f"""
SELECT entity, {i} AS test_order, '{label}' AS test, {q('f', 3)} AS f_stat, {q('p', 4)} AS p_approx, n,
  CASE WHEN p < 0.10::DOUBLE THEN 'Evidence of causation' ELSE 'No significant causation at 10%' END AS result
FROM (SELECT *, CASE WHEN f > 0 THEN least(greatest(exp(-f / 2.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS p
  FROM (SELECT entity, n, CASE WHEN ssr_u > 0 THEN (ssr_r - ssr_u) / (ssr_u / CAST(greatest(n - 3, 1) AS DOUBLE))
                       ELSE 0.0::DOUBLE END AS f
    FROM (SELECT entity, max(n) AS n, sum((y - br * yl) * (y - br * yl)) AS ssr_r,
            sum(CASE WHEN b1 IS NOT NULL THEN (y - b1 * yl - b2 * xl) * (y - b1 * yl - b2 * xl)
                     ELSE (y - br * yl) * (y - br * yl) END) AS ssr_u
          FROM (SELECT *, CASE WHEN a <> 0 THEN d / a ELSE 0.0::DOUBLE END AS br,
                  CASE WHEN a * c - b * b <> 0 THEN (c * d - b * e) / (a * c - b * b) END AS b1,
                  CASE WHEN a * c - b * b <> 0 THEN (a * e - b * d) / (a * c - b * b) END AS b2
                FROM (SELECT *, sum(yl * yl) OVER (PARTITION BY entity) AS a, sum(yl * xl) OVER (PARTITION BY entity) AS b,
                        sum(xl * xl) OVER (PARTITION BY entity) AS c, sum(yl * y) OVER (PARTITION BY entity) AS d,
                        sum(xl * y) OVER (PARTITION BY entity) AS e
                      FROM (SELECT * FROM (
                              SELECT entity, n, CAST({effect} AS DOUBLE) AS y,
                                lag(CAST({effect} AS DOUBLE)) OVER (PARTITION BY entity ORDER BY period) AS yl,
                                lag(CAST({cause} AS DOUBLE)) OVER (PARTITION BY entity ORDER BY period) AS xl,
                                row_number() OVER (PARTITION BY entity ORDER BY period) AS rn
                              FROM gbase)
                            WHERE rn > 1 AND y IS NOT NULL AND yl IS NOT NULL AND xl IS NOT NULL)))
          GROUP BY entity)))"""


cte("gbase", ["fm"], """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM fm
               WHERE sales_value IS NOT NULL AND cogs IS NOT NULL) WHERE n >= 4""")
oracle("granger_lag1", ["fm", "gbase"], """
SELECT entity, 0 AS test_order, 'Granger (COGS → Sales)' AS test, NULL::DOUBLE AS f_stat, NULL::DOUBLE AS p_approx,
  n, 'Insufficient data (n<4)' AS result
FROM (SELECT entity, count(*) AS n FROM fm WHERE sales_value IS NOT NULL AND cogs IS NOT NULL GROUP BY 1) WHERE n < 4
UNION ALL""" + "\nUNION ALL".join(_granger_sql(i, c, e, lbl) for i, (c, e, lbl) in enumerate(GRANGER_PAIRS)))

oracle("root_cause_notes", ["fm", "vd", "elast", "parties"], """
, v AS (SELECT entity, max(CASE WHEN component = 'Margin Pressure' THEN value END) AS mp,
               max(CASE WHEN component = 'COGS Δ' THEN value END) AS cogs_delta FROM vd GROUP BY 1),
lp AS (SELECT entity, max(period) AS period FROM parties WHERE type = 'creditor' GROUP BY 1),
topc AS (SELECT entity, party, closing FROM (
           SELECT p.entity, p.party, p.closing,
                  row_number() OVER (PARTITION BY p.entity ORDER BY p.closing DESC, p.party DESC) AS r
           FROM parties p JOIN lp ON p.entity = lp.entity AND p.period = lp.period WHERE p.type = 'creditor')
         WHERE r = 1),
j AS (SELECT e.entity, v.mp, v.cogs_delta, el.elasticity, el.r2, topc.party, topc.closing
      FROM (SELECT DISTINCT entity FROM fm) e LEFT JOIN v USING (entity) LEFT JOIN elast el USING (entity)
      LEFT JOIN topc USING (entity))
SELECT * FROM (
  SELECT entity, 0 AS note_order, CASE WHEN mp > 0 THEN 'COGS grew faster than sales — margin compression is a primary stress driver.' END AS note FROM j
  UNION ALL
  SELECT entity, 1, CASE WHEN cogs_delta > 0 THEN 'COGS increased by NPR ' || format('{:,.0f}', cogs_delta) || ' MoM — investigate purchase-cost elasticity.' END FROM j
  UNION ALL
  SELECT entity, 2, CASE WHEN elasticity IS NOT NULL THEN 'Estimated COGS–sales elasticity ≈ ' || format('{:,.2f}', elasticity) || ' (R²=' || coalesce(format('{:,.2f}', r2), 'nan') || '): costs move closely with revenue.' END FROM j
  UNION ALL
  SELECT entity, 3, CASE WHEN party IS NOT NULL THEN 'Top creditor concentration: ' || party || ' (NPR ' || format('{:,.0f}', closing) || ').' END FROM j)
WHERE note IS NOT NULL""")

# ====================================================================== predictive
_c2s = c2("total_sales")
oracle("daily_features", ["daily"], f"""
SELECT entity, date, total_sales, lag1, lag7, roll7, roll7_std, dow FROM (
  SELECT *, CASE WHEN n_ >= 3 THEN {xmean('n_', 'sx_', 2)} END AS roll7,
            CASE WHEN n_ >= 3 THEN {xstd('n_', 'sx_', 'sxx_', 2)} END AS roll7_std
  FROM (SELECT *, lag(total_sales) OVER w AS lag1, lag(total_sales, 7) OVER w AS lag7,
          count({_c2s}) OVER f AS n_, sum({_c2s}) OVER f AS sx_, sum({h(_c2s)} * {h(_c2s)}) OVER f AS sxx_
        FROM daily
        WINDOW w AS (PARTITION BY entity ORDER BY date),
               f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))
WHERE cash IS NOT NULL AND online IS NOT NULL AND credit IS NOT NULL AND total_sales IS NOT NULL
  AND customers IS NOT NULL AND dine_in_sales IS NOT NULL AND avg_ticket IS NOT NULL AND day_of_week IS NOT NULL
  AND dow IS NOT NULL AND lag1 IS NOT NULL AND lag7 IS NOT NULL AND roll7 IS NOT NULL AND roll7_std IS NOT NULL""")


def _erf_sql(x: str) -> str:
    from ..functions.stats import AS_A, AS_P
    a1, a2, a3, a4, a5 = (f"{a!r}::DOUBLE" for a in AS_A)
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {AS_P!r}::DOUBLE * abs({x})))"
    poly = f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))))"
    y = f"(1.0::DOUBLE - {poly} * exp(-(abs({x}) * abs({x}))))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


def _phi_sql(z: str) -> str:
    import math
    return f"(0.5::DOUBLE * (1.0::DOUBLE + {_erf_sql(f'(({z}) / {math.sqrt(2.0)!r}::DOUBLE)')}))"


_forecast = f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM daily),
g AS (SELECT entity, count(*) AS n, sum({_c2s}) AS sx, sum({h(_c2s)} * {h(_c2s)}) AS sxx,
        count(CASE WHEN rn <= 7 THEN {_c2s} END) AS n7, sum(CASE WHEN rn <= 7 THEN {_c2s} END) AS s7,
        sum(CASE WHEN rn <= 7 THEN {h(_c2s)} * {h(_c2s)} END) AS s7xx, max(date) AS last_date
      FROM r GROUP BY 1 HAVING count(*) >= 7),
s AS (SELECT entity, last_date, {xmean('n7', 's7', 2)} AS mu, {xmean('n', 'sx', 2)} AS overall,
        coalesce(NULLIF({xstd('n7', 's7', 's7xx', 2)}, 0.0::DOUBLE), NULLIF({xstd('n', 'sx', 'sxx', 2)}, 0.0::DOUBLE),
                 1.0::DOUBLE) AS sigma FROM g),
dm AS (SELECT entity, dow, {xmean('dn', 'dsx', 2)} AS dmean
       FROM (SELECT entity, dow, count(*) AS dn, sum({_c2s}) AS dsx FROM daily GROUP BY 1, 2)),
hz AS (SELECT s.*, CAST(step AS INTEGER) AS step, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date,
         CAST(isodow(CAST(last_date + CAST(step AS INTEGER) AS DATE)) - 1 AS INTEGER) AS dow
       FROM (SELECT *, unnest(generate_series(1, 7)) AS step FROM s) s),
fc AS (SELECT hz.*, mu * (CASE WHEN overall <> 0 THEN coalesce(dm.dmean, overall) / overall ELSE 1.0::DOUBLE END) AS forecast
       FROM hz LEFT JOIN dm ON hz.entity = dm.entity AND hz.dow = dm.dow)"""
oracle("forecast_daily", ["daily"], f"""{_forecast}
SELECT entity, step, date, dow, forecast, forecast - 1.2815515655446004::DOUBLE * sigma AS p10, forecast AS p50,
  forecast + 1.2815515655446004::DOUBLE * sigma AS p90,
  {q(_phi_sql('(0.6::DOUBLE * mu - forecast) / sigma'), 6)} AS cash_flow_stress_prob
FROM fc""")


def _sim_percentile(p: float, n: int) -> str:
    import math
    pos = p * (n - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    return f"sims[{lo + 1}]" if lo == hi else f"(sims[{lo + 1}] * '{hi - pos!r}'::DOUBLE + sims[{hi + 1}] * '{pos - lo!r}'::DOUBLE)"


def _sim_uniform(start: int) -> str:
    return f"((('0x' || substr(digest, {start}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


_sim_draw = f"sqrt(-2.0::DOUBLE * ln({_sim_uniform(1)})) * cos('6.283185307179586'::DOUBLE * {_sim_uniform(17)})"
oracle("forecast_daily_sim", ["daily"], f"""{_forecast},
dg AS (SELECT fc.*, md5('sim-42:' || entity || ':' || step || ':' || i) AS digest
       FROM (SELECT *, unnest(generate_series(0, 499)) AS i FROM fc) fc),
sm AS (SELECT entity, step, date, dow, forecast, mu, list_sort(list(forecast + sigma * {q(_sim_draw, 6)})) AS sims
       FROM dg GROUP BY entity, step, date, dow, forecast, mu)
SELECT entity, step, date, dow, forecast, {_sim_percentile(0.1, 500)} AS p10, {_sim_percentile(0.5, 500)} AS p50, {_sim_percentile(0.9, 500)} AS p90,
  CAST(len(list_filter(sims, lambda x: x < 0.6::DOUBLE * mu)) AS DOUBLE) / 500.0::DOUBLE AS cash_flow_stress_prob
FROM sm""")

# ====================================================================== prescriptive
_r4 = lambda c: f"CAST(round({c} * 10000.0::DOUBLE) AS BIGINT)"
_crit = [("liquidity", 0.3), ("profitability", 0.25), ("feasibility", 0.2), ("risk_reduction", 0.25)]
_st = ", ".join(f"sqrt(sum({c} * {c})) AS n_{c}, max({c}) AS hi_{c}, min({c}) AS lo_{c}" for c, _ in _crit)


def _dist(kind: str) -> str:
    terms = []
    for c, w in _crit:
        v = f"((CASE WHEN n_{c} <> 0 THEN {c} / n_{c} END) * {w!r}::DOUBLE)"
        ref = f"((CASE WHEN n_{c} <> 0 THEN {kind}_{c} / n_{c} END) * {w!r}::DOUBLE)"
        terms.append(f"({v} - {ref}) * ({v} - {ref})")
    acc = "0.0::DOUBLE"
    for t in terms:
        acc = f"({acc} + {t})"
    return f"sqrt({acc})"


oracle("topsis_rank", ["pl", "ms"], f"""
, pa AS (SELECT entity, sum({_r4('profit')}) AS profit4, sum({_r4('total_incomes')}) AS inc4, sum({_r4('cogs')}) AS cogs4
         FROM pl GROUP BY 1),
ma AS (SELECT entity, sum({_r4('cash_sales')}) AS cash4, sum({_r4('net_sales')}) AS net4 FROM ms GROUP BY 1),
alts AS (SELECT pa.entity, CAST(cash4 AS DOUBLE) / NULLIF(CAST(net4 AS DOUBLE), 0) AS liquidity,
           CAST(profit4 AS DOUBLE) / NULLIF(CAST(inc4 AS DOUBLE), 0) AS profitability, s_acctbal AS feasibility,
           1.0::DOUBLE - CAST(cogs4 AS DOUBLE) / NULLIF(CAST(inc4 AS DOUBLE), 0) AS risk_reduction
         FROM pa JOIN ma ON pa.entity = ma.entity JOIN supplier ON s_suppkey = pa.entity),
st AS (SELECT {_st} FROM alts)
SELECT entity, liquidity, profitability, feasibility, risk_reduction,
  {q('CASE WHEN dp + dn <> 0 THEN dn / (dp + dn) END', 10)} AS topsis_score
FROM (SELECT alts.*, {_dist('hi')} AS dp, {_dist('lo')} AS dn FROM alts, st)""")


# ====================================================================== text
from ..functions.text import (AUDIT_KEYWORDS, DOT_RUN, NOISE_TERMS, NOT_WORD, SECTION_PATTERNS,  # noqa: E402
                              STOP_WORDS, WORD, WS, section_regex)
from ..operators.retrieval import (DEDUP_PREFIX, FALLBACK_CHARS, INTRO, MAX_SENTENCES, NO_HITS,  # noqa: E402
                                   OVERLAP_CAP, PRIORITY_CHARS, PRIORITY_SECTIONS, PRIORITY_SHEETS, RERANK_RULES)

NL = "chr(10)"


def s_lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '\\x00', ' ', 'g'), '{WS}+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def dots_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{DOT_RUN}')) AS INTEGER)"


def section_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {s_lit(section_regex(p, n))}) THEN {s_lit(n)}"
                     for p, n in SECTION_PATTERNS)
    return f"(CASE {whens} ELSE 'General' END)"


def lowq_page_sql(x: str) -> str:
    return (f"(contains(lower({x}), 'table of contents') OR contains(lower({x}), 'list of figures') "
            f"OR ({dots_sql(x)} >= 3 AND length({x}) < 2500))")


def lowq_chunk_sql(x: str) -> str:
    return f"(length({x}) < 80 OR {dots_sql(x)} >= 2 OR starts_with(lower({x}), 'table of contents'))"


def useful_sql(x: str) -> str:
    noise = " OR ".join(f"contains(lower({x}), {s_lit(t)})" for t in NOISE_TERMS)
    return (f"(length({x}) >= 40 AND NOT regexp_matches({x}, '{DOT_RUN}') "
            f"AND NOT regexp_matches({x}, '^(?:\\p{{Nd}}|\\.|{WS})+$') "
            f"AND NOT regexp_matches({strip_sql(x)}, '^#+{WS}*(?:{WORD}|{WS})+$') AND NOT ({noise}))")


def audit_sql(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {s_lit(k)})" for k in AUDIT_KEYWORDS) + ")"


def terms_sql(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z]{{4,}}'), lambda w: lower(w)))"


def kw_sql(x: str) -> str:
    stop = "[" + ", ".join(s_lit(w) for w in STOP_WORDS) + "]"
    return f"list_filter({terms_sql(x)}, lambda w: NOT list_contains({stop}, w))"


def overlap_sql(terms: str, text: str) -> str:
    return f"CAST(len(list_filter({terms}, lambda t: contains(lower({text}), t))) AS INTEGER)"


def split_sql(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


cte("pages", [], f"""
SELECT doc_id, source, clean FROM (SELECT doc_id, source, {norm_sql('text')} AS clean FROM documents)
WHERE clean <> '' AND NOT {lowq_page_sql('clean')}""")


def _end(x: str, size: int = 800) -> str:
    e0 = f"least(({x}) + {size}, n)"
    r = f"instr(reverse(substr(clean, ({x}) + 1, {e0} - ({x}))), ' .')"
    b = f"(CASE WHEN {r} > 0 THEN ({x}) + ({e0} - ({x})) - {r} - 1 ELSE -1 END)"
    return f"(CASE WHEN {e0} < n AND {b} > ({x}) + {size // 2} THEN {b} + 1 ELSE {e0} END)"


_nx = "greatest(e - 150, s + 1)"
cte("spans", ["pages"], f"""
WITH RECURSIVE r(doc_id, source, clean, n, s, e) AS (
  SELECT doc_id, source, clean, n, 0, {_end('0')}
  FROM (SELECT *, length(clean) AS n FROM pages)
  UNION ALL
  SELECT doc_id, source, clean, n, {_nx}, {_end(_nx)} FROM r WHERE e < n)
SELECT doc_id, source, clean, s, e, trim(substr(clean, s + 1, e - s)) AS piece FROM r""")

cte("chunks", ["spans"], f"""
SELECT 'chunk_' || CAST(doc_id AS VARCHAR) || '_' || printf('%04d', pos) AS chunk_id, doc_id, source,
  CAST(pos AS INTEGER) AS pos, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", piece AS text,
  {section_sql('piece')} AS section
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos FROM spans
      WHERE piece <> '' AND NOT {lowq_chunk_sql('piece')})""")

oracle("normalize_text", [], f"SELECT doc_id, {norm_sql('text')} AS text FROM documents")
oracle("detect_section", [], f"SELECT doc_id, {section_sql(norm_sql('text'))} AS section FROM documents")
oracle("low_quality_pages", [], f"""
SELECT doc_id, CAST(length(clean) AS INTEGER) AS n_chars, {dots_sql('clean')} AS dot_runs, {lowq_page_sql('clean')} AS low_quality
FROM (SELECT doc_id, {norm_sql('text')} AS clean FROM documents)""")
oracle("clean_pages", ["pages"], "SELECT doc_id, clean AS text FROM pages")
oracle("chunk_text", ["chunks"], 'SELECT chunk_id, doc_id, pos, start, "end", text, section FROM chunks')
oracle("low_quality_chunks", ["spans"], f"""
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", {lowq_chunk_sql('piece')} AS low_quality FROM spans""")

oracle("markdown_sections", [], f"""
SELECT doc_id, 0 AS pos, 'summary_' || CAST(doc_id AS VARCHAR) || '_0001' AS chunk_id, text, 'Research Summary' AS section
FROM documents
UNION ALL
SELECT doc_id, CAST(i AS INTEGER) AS pos, 'summary_' || CAST(doc_id AS VARCHAR) || '_' || printf('%04d', i + 1) AS chunk_id,
  sec AS text, {strip_sql(f"replace(string_split(sec, {NL})[1], '#', '')")} AS section
FROM (SELECT doc_id, unnest(hs) AS sec, unnest(generate_series(1, len(hs))) AS i
      FROM (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, {NL} || '## '),
                     lambda p: {strip_sql('p')}), lambda p: p <> ''),
                     lambda p: CASE WHEN starts_with(p, '#') THEN p ELSE '## ' || p END) AS hs FROM documents))""")

cte("sents", ["pages"], f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS spos, sentence FROM (
  SELECT doc_id, unnest(ss) AS sentence, unnest(generate_series(1, len(ss))) AS i
  FROM (SELECT doc_id, {split_sql('clean')} AS ss FROM pages))""")
oracle("sentence_split", ["sents"], "SELECT * FROM sents")
oracle("useful_sentences", ["sents"], f"SELECT doc_id, spos, {useful_sql(strip_sql('sentence'))} AS useful FROM sents")

_UT = "(SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"
oracle("audit_query_flag", [], f"SELECT conv_id, turn, {audit_sql('text')} AS audit FROM {_UT}")
oracle("query_terms", [], f"""
SELECT conv_id, turn, CAST(len({terms_sql('text')}) AS INTEGER) AS n_terms,
  array_to_string(list_sort({terms_sql('text')}), ' ') AS terms, array_to_string(list_sort({kw_sql('text')}), ' ') AS keywords
FROM {_UT}""")
oracle("keyword_overlap", [], f"""
SELECT u.conv_id, u.turn, {overlap_sql(terms_sql('u.text'), 'r.text')} AS overlap
FROM {_UT} u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1""")

# ---------------------------------------------------------------- retrieval
cte("emb", [], """
SELECT vec_id, vec, sqrt(list_reduce(list_transform(vec, lambda x: x * x), lambda a, x: a + x)) AS vnorm
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)""")

cte("corpus", ["chunks", "emb"], """
SELECT c.chunk_id, c.doc_id, 1 AS page, c.section, 'proposal' AS source_type, c.source AS file_name,
  '' AS sheet_name, '' AS report_period, c.text, e.vec, e.vnorm
FROM chunks c JOIN emb e ON c.doc_id = e.vec_id""")

cte("qs", ["emb"], f"""
SELECT *, CASE WHEN audit THEN greatest(eff_k * 8, 24) ELSE greatest(eff_k * 3, eff_k) END AS fetch_k FROM (
  SELECT item_id AS question_id, text AS question, lower(text) AS q_lower, {audit_sql('text')} AS audit,
    {terms_sql('text')} AS terms, {kw_sql('text')} AS kw, 5 AS k,
    CASE WHEN {audit_sql('text')} THEN greatest(5, 8) ELSE 5 END AS eff_k, e.vec AS qvec, e.vnorm AS qnorm
  FROM benchmark JOIN emb e ON e.vec_id = item_id)""")

cte("cand", ["qs", "corpus"], """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS fetch_rank FROM (
    SELECT q.*, c.*, list_reduce(list_transform(generate_series(1, len(c.vec)), lambda i: q.qvec[i] * c.vec[i]),
                                 lambda a, x: a + x) / (q.qnorm * c.vnorm) AS similarity
    FROM qs q, corpus c))
WHERE fetch_rank <= fetch_k""")


def _field_sql(name: str) -> str:
    return {"section": "section", "source_type": "source_type", "page": "page",
            "sheet_lower": "lower(coalesce(sheet_name, ''))", "section_lower": "lower(section)",
            "doc_lower": "lower(text)", "period_lower": "lower(coalesce(report_period, ''))"}[name]


def _cond_sql(field: str, op: str, value) -> str:
    f = _field_sql(field)
    if op == "eq":
        return f"{f} = {value if isinstance(value, int) else s_lit(value)}"
    if op == "in":
        return f"{f} IN ({', '.join(s_lit(v) for v in value)})"
    if op == "not_in":
        return f"{f} NOT IN ({', '.join(s_lit(v) for v in value)})"
    if op == "startswith":
        return f"starts_with({f}, {s_lit(value)})"
    if op == "contains_any":
        return "(" + " OR ".join(f"contains({f}, {s_lit(v)})" for v in value) + ")"
    raise ValueError(op)


def _score_sql() -> str:
    acc = "similarity"
    for qcond, hconds, boost in RERANK_RULES:
        if qcond == "@overlap":
            term = f"least(CAST({overlap_sql('terms', 'text')} AS DOUBLE) * {boost!r}::DOUBLE, {OVERLAP_CAP!r}::DOUBLE)"
        else:
            conds = [_cond_sql(*h) for h in hconds]
            if qcond == "@audit":
                conds.insert(0, "audit")
            elif qcond is not None:
                conds.insert(0, f"contains(q_lower, {s_lit(qcond)})")
            term = f"(CASE WHEN {' AND '.join(conds)} THEN {boost!r}::DOUBLE ELSE 0.0::DOUBLE END)"
        acc = f"({acc} + {term})"
    return acc


cte("hits", ["cand"], f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, similarity DESC, chunk_id) AS rank
  FROM (SELECT *, {q(_score_sql(), 4)} AS score FROM cand))
WHERE rank <= eff_k""")

oracle("knn_cosine", ["cand"], "SELECT question_id, fetch_rank, chunk_id, similarity FROM cand WHERE fetch_rank <= k")
oracle("knn_overfetch", ["cand"], "SELECT question_id, fetch_rank, chunk_id, similarity, fetch_k FROM cand")
oracle("hybrid_rerank", ["hits"], "SELECT question_id, rank, chunk_id, similarity, score FROM hits")
oracle("ask_topk", ["hits"], "SELECT question_id, rank, chunk_id, score, audit, eff_k FROM hits WHERE rank <= k")

LABEL_SQL = """(CASE WHEN source_type = 'audit_data' THEN concat_ws(' | ', 'Audit Data',
    coalesce(NULLIF(report_period, ''), 'Unknown period'), NULLIF(file_name, ''),
    coalesce(NULLIF(sheet_name, ''), NULLIF(section, '')))
  ELSE 'Proposal p.' || CAST(page AS VARCHAR) || ' | ' || coalesce(section, 'General') END)"""

oracle("context_blocks", ["hits"], f"""
SELECT question_id, string_agg('[Source ' || CAST(rank AS VARCHAR) || ' | ' || {LABEL_SQL} || ' | Relevance: '
  || CAST(score AS VARCHAR) || ']' || {NL} || text, {NL} || {NL} ORDER BY rank) AS context
FROM hits WHERE rank <= k GROUP BY question_id""")


def _cut_sql(x: str, n: int) -> str:
    return f"(substr({x}, 1, {n}) || CASE WHEN length({x}) > {n} THEN '...' ELSE '' END)"


_pri = (f"(section IN ({', '.join(s_lit(v) for v in PRIORITY_SECTIONS)}) "
        f"OR sheet_name IN ({', '.join(s_lit(v) for v in PRIORITY_SHEETS)}))")
oracle("extractive_answer", ["hits", "qs"], f"""
, hl AS (SELECT *, {LABEL_SQL} AS label FROM hits),
pq AS (SELECT question_id,
         arg_min(struct_pack(source_type := source_type, label := label, text := text), rank) FILTER (WHERE {_pri}) AS pri,
         arg_min(struct_pack(section := section, page := page, text := text), rank) AS top
       FROM hl GROUP BY question_id),
ss AS (SELECT question_id, rank, kw, score, label, sentence, spos FROM (
         SELECT question_id, rank, kw, score, label, {strip_sql('raw')} AS sentence, spos FROM (
           SELECT question_id, rank, kw, score, label, unnest(sp) AS raw, unnest(generate_series(0, len(sp) - 1)) AS spos
           FROM (SELECT *, {split_sql('text')} AS sp FROM hl)))
       WHERE {useful_sql('sentence')}),
t6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sscore DESC, rank, spos) AS srank
                      FROM (SELECT *, CAST({overlap_sql('kw', 'sentence')} AS DOUBLE) + score AS sscore FROM ss))
       WHERE srank <= {MAX_SENTENCES}),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, substr(sentence, 1, {DEDUP_PREFIX}) ORDER BY srank) AS dup
                      FROM t6) WHERE dup = 1),
ln AS (SELECT question_id, string_agg('- ' || sentence || ' (' || label || ')', {NL} || {NL} ORDER BY srank) AS ls
       FROM dd GROUP BY question_id)
SELECT q.question_id,
  CASE WHEN pq.top IS NULL THEN {s_lit(NO_HITS)}
       WHEN pq.pri IS NOT NULL AND pq.pri.source_type = 'audit_data'
         THEN 'Based on audit data (' || pq.pri.label || '):' || {NL} || {NL} || {_cut_sql('pq.pri.text', PRIORITY_CHARS)}
       WHEN ln.ls IS NOT NULL THEN {s_lit(INTRO)} || {NL} || {NL} || ln.ls
       ELSE 'Based on the most relevant section (' || pq.top.section || ', p. ' || CAST(pq.top.page AS VARCHAR) || '):'
            || {NL} || {NL} || {_cut_sql('pq.top.text', FALLBACK_CHARS)} END AS answer,
  'extractive' AS backend
FROM qs q LEFT JOIN pq ON q.question_id = pq.question_id LEFT JOIN ln ON q.question_id = ln.question_id""")


# ====================================================================== model lab (SQL-checkable parts)
from ..operators.lab import FEATURE_COLS  # noqa: E402

_med_aggs = ", ".join(f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS v_{c}, count({c}) AS n_{c}"
                      for c in FEATURE_COLS)
_imp_cols = ", ".join(f"coalesce(fm.{c}, {_pct(f'm.v_{c}', f'm.n_{c}', 0.5)}, 0.0::DOUBLE) AS {c}"
                      for c in FEATURE_COLS)
cte("imputed", ["fm"], f"""
SELECT fm.entity, fm.period, {_imp_cols}, fm.stress
FROM fm JOIN (SELECT entity, {_med_aggs} FROM fm GROUP BY entity) m ON fm.entity = m.entity""")
oracle("impute_features", ["imputed"], "SELECT * EXCLUDE (stress) FROM imputed")
oracle("degenerate_label", ["imputed"], f"""
SELECT i.entity, i.period, i.cogs_ratio, CAST(i.cogs_ratio > {_pct('m.v', 'm.n', 0.5)} AS INTEGER) AS label
FROM imputed i JOIN (SELECT entity, list_sort(list(cogs_ratio) FILTER (WHERE cogs_ratio IS NOT NULL)) AS v,
                            count(cogs_ratio) AS n FROM imputed GROUP BY entity) m ON i.entity = m.entity""")

oracle("classification_metrics", [], """
WITH d AS (SELECT lang, quality AS label, CAST(n_chars AS DOUBLE) AS s, CAST(n_chars >= 500 AS INTEGER) AS pred
           FROM labels JOIN documents USING (doc_id)),
conf AS (SELECT lang, count(*) AS n, sum(CAST(label = pred AS BIGINT)) AS correct,
           sum(CAST(label = 1 AND pred = 1 AS BIGINT)) AS tp, sum(CAST(label = 0 AND pred = 1 AS BIGINT)) AS fp,
           sum(CAST(label = 1 AND pred = 0 AS BIGINT)) AS fn FROM d GROUP BY lang),
bs AS (SELECT lang, s, sum(CAST(label = 1 AS BIGINT)) AS pos, sum(CAST(label = 0 AS BIGINT)) AS neg FROM d GROUP BY 1, 2),
nb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM bs),
auc AS (SELECT lang, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
          CAST(sum(pos * (neg_below * 2 + neg)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS ROC_AUC
        FROM nb GROUP BY lang)
SELECT conf.lang, CAST(correct AS DOUBLE) / CAST(n AS DOUBLE) AS accuracy,
  CASE WHEN tp * 2 + fp + fn > 0 THEN CAST(tp * 2 AS DOUBLE) / CAST(tp * 2 + fp + fn AS DOUBLE) ELSE 0.0::DOUBLE END AS F1,
  auc.ROC_AUC
FROM conf LEFT JOIN auc USING (lang)""")

_e = f"({c2('total_sales')} - {c2('lag1')})"
_yv = c2("total_sales")
oracle("regression_metrics", ["daily"], f"""
, df AS (SELECT * FROM (SELECT *, lag(total_sales) OVER w AS lag1, lag(total_sales, 7) OVER w AS lag7,
            count({_yv}) OVER f AS n_ FROM daily
            WINDOW w AS (PARTITION BY entity ORDER BY date),
                   f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
         WHERE cash IS NOT NULL AND online IS NOT NULL AND credit IS NOT NULL AND customers IS NOT NULL
           AND dine_in_sales IS NOT NULL AND avg_ticket IS NOT NULL AND lag1 IS NOT NULL AND lag7 IS NOT NULL
           AND n_ >= 3)
SELECT entity, n, CAST(sae AS DOUBLE) / 100.0::DOUBLE / CAST(n AS DOUBLE) AS MAE,
  sqrt(CAST(sse AS DOUBLE) / 10000.0::DOUBLE / CAST(n AS DOUBLE)) AS RMSE,
  CASE WHEN CAST(CAST(n * syy - {h('sy')} * sy AS VARCHAR) AS DOUBLE) <> 0
       THEN 1.0::DOUBLE - (CAST(sse AS DOUBLE) * CAST(n AS DOUBLE)) / CAST(CAST(n * syy - {h('sy')} * sy AS VARCHAR) AS DOUBLE) END AS R2
FROM (SELECT entity, count(*) AS n, sum(abs({_e})) AS sae, sum({h(_e)} * {h(_e)}) AS sse, sum({_yv}) AS sy,
        sum({h(_yv)} * {h(_yv)}) AS syy FROM df GROUP BY entity)""")


# ====================================================================== grid (cell table)
from ..operators.grid import INVENTORY_SHOWN, SECTION_MAP, SECTION_MAP_EXTRA  # noqa: E402
from ..operators.chunking import SHEET_CHUNK_SIZE  # noqa: E402
from ..sources.grid import PARTY_HEADER, PARTY_SHEETS, PL_LABELS  # noqa: E402


def jfmt(x: str, d: int) -> str:
    """Java's %.<d>f: half-up rounding of the shortest decimal form; a
    negative value that rounds to zero keeps its sign ('-0.0')."""
    r = f"printf('%.{d}f', round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {d}))"
    return f"(CASE WHEN ({x}) < 0 AND NOT starts_with({r}, '-') THEN '-' || {r} ELSE {r} END)"


def fshort(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN abs({x}) >= 1000000 THEN {jfmt(f'({x}) / 1000000.0::DOUBLE', 2)} || 'M' "
            f"WHEN abs({x}) >= 1000 THEN format('{{:,.0f}}', {x}) "
            f"WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE {jfmt(x, 3)} END)")


def flong(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN abs({x}) >= 1000 THEN format('{{:,.2f}}', {x}) "
            f"WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE {jfmt(x, 2)} END)")


def plain_sql(x: str) -> str:
    return (f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE rtrim(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,6)) AS VARCHAR), '0') END)")


def clean_sql(x: str) -> str:
    return f"(CASE WHEN trim({x}) = '' OR lower(trim({x})) = 'nan' THEN NULL ELSE trim({x}) END)"


def _file(e: str, p: str) -> str:
    return (f"('Supplier ' || CAST({e} AS VARCHAR) || ' Monthly Report - ' || "
            f"strftime(CAST({p} || '-01' AS DATE), '%B %Y') || '.xlsx')")


def _pl_cell_rows() -> str:
    sels = [f"SELECT entity, period, 0 AS r, 0 AS c, 'Supplier ' || CAST(entity AS VARCHAR) AS s, NULL::DOUBLE AS n FROM pl",
            "SELECT entity, period, 2, 0, 'Particulars', NULL FROM pl",
            "SELECT entity, period, 2, 1, month, NULL FROM pl",
            "SELECT entity, period, 2, 2, '%', NULL FROM pl"]
    for i, (label, col) in enumerate(PL_LABELS):
        sels.append(f"SELECT entity, period, {3 + i}, 0, {s_lit(label)}, NULL FROM pl")
        sels.append(f"SELECT entity, period, {3 + i}, 1, NULL, {col} FROM pl")
        sels.append(f"SELECT entity, period, {3 + i}, 2, CASE WHEN sales_value <> 0 THEN "
                    f"{jfmt(f'{col} / sales_value * 100.0::DOUBLE', 1)} || '%' END, NULL FROM pl")
    return "\nUNION ALL ".join(sels)


def _party_cell_rows() -> str:
    parts = []
    for ptype, sheet, idx in PARTY_SHEETS:
        rows = (f"(SELECT *, CAST(row_number() OVER (PARTITION BY entity, period ORDER BY party) + 2 AS INTEGER) AS r "
                f"FROM parties WHERE type = '{ptype}')")
        heads = " UNION ALL ".join([f"SELECT DISTINCT entity, period, 0 AS r, 0 AS c, {s_lit(sheet)} AS s, NULL::DOUBLE AS n FROM parties WHERE type = '{ptype}'"]
                                   + [f"SELECT DISTINCT entity, period, 2, {j}, {s_lit(h)}, NULL FROM parties WHERE type = '{ptype}'"
                                      for j, h in enumerate(PARTY_HEADER)])
        body = (f"SELECT entity, period, r, 0, party, NULL FROM {rows} UNION ALL "
                f"SELECT entity, period, r, 1, NULL, opening FROM {rows} UNION ALL "
                f"SELECT entity, period, r, 4, NULL, closing FROM {rows}")
        tot = (f"SELECT entity, period, max(r) + 1, 0, 'Grand Total', NULL FROM {rows} GROUP BY 1, 2 UNION ALL "
               f"SELECT entity, period, max(r) + 1, 4, NULL, {dbl(f'sum({c2(chr(99) + chr(108) + chr(111) + chr(115) + chr(105) + chr(110) + chr(103))})', 2)} FROM {rows} GROUP BY 1, 2")
        parts.append(f"SELECT {_file('entity', 'period')} AS file, {s_lit(sheet)} AS sheet, {idx} AS sheet_idx, "
                     f"CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx, s AS str_value, CAST(n AS DOUBLE) AS num_value "
                     f"FROM ({heads} UNION ALL {body} UNION ALL {tot})")
    return "\nUNION ALL\n".join(parts)


cte("cells", ["pl", "parties"], f"""
SELECT * FROM (
  SELECT {_file('entity', 'period')} AS file, 'PL' AS sheet, 0 AS sheet_idx, CAST(r AS INTEGER) AS row_idx,
    CAST(c AS INTEGER) AS col_idx, s AS str_value, CAST(n AS DOUBLE) AS num_value
  FROM ({_pl_cell_rows()})
  UNION ALL
  {_party_cell_rows()})
WHERE str_value IS NOT NULL OR num_value IS NOT NULL""")

_KEY_SQL = f"lower(coalesce({clean_sql('str_value')}, CAST(num_value AS VARCHAR)))"
_labels_lower = ", ".join(s_lit(l.lower()) for l, _ in PL_LABELS)
oracle("label_lookup", ["cells"], f"""
SELECT file, sheet, label, value FROM (
  SELECT k.file, k.sheet, k.key AS label, v.num_value AS value,
         row_number() OVER (PARTITION BY k.file, k.sheet, k.key ORDER BY k.row_idx) AS rk
  FROM (SELECT file, sheet, row_idx, {_KEY_SQL} AS key FROM cells WHERE sheet = 'PL' AND col_idx = 0) k
  LEFT JOIN (SELECT file, sheet, row_idx, num_value FROM cells WHERE sheet = 'PL' AND col_idx = 1) v
    ON k.file = v.file AND k.sheet = v.sheet AND k.row_idx = v.row_idx
  WHERE k.key IN ({_labels_lower}))
WHERE rk = 1""")

_like_labels = ["Sales Value", "Cost of Goods Sold", "Gross Profit", "Net Profit", "Staff Salary", "Total"]
_like_vals = " UNION ALL ".join(f"SELECT {s_lit(l)} AS label, {s_lit(l.lower())} AS needle" for l in _like_labels)
oracle("label_lookup_like", ["cells"], f"""
SELECT file, sheet, label, value FROM (
  SELECT k.file, k.sheet, lb.label,
         CASE WHEN v.num_value IS NOT NULL THEN {flong('v.num_value')} ELSE v.t END AS value,
         row_number() OVER (PARTITION BY k.file, k.sheet, lb.label ORDER BY k.row_idx, CASE v.col_idx WHEN 1 THEN 0 ELSE 1 END) AS rk
  FROM (SELECT file, sheet, row_idx, {_KEY_SQL} AS key FROM cells WHERE sheet = 'PL' AND col_idx = 0) k
  JOIN ({_like_vals}) lb ON contains(k.key, lb.needle)
  JOIN (SELECT file, sheet, row_idx, col_idx, num_value, {clean_sql('str_value')} AS t FROM cells
        WHERE sheet = 'PL' AND col_idx IN (1, 2)) v
    ON k.file = v.file AND k.sheet = v.sheet AND k.row_idx = v.row_idx
  WHERE v.num_value IS NOT NULL OR (v.t IS NOT NULL AND NOT ends_with(v.t, '%')))
WHERE rk = 1""")

_m3 = "substr(regexp_extract(file, '- (\\w+) \\d{4}\\.xlsx$', 1), 1, 3)"
oracle("month_columns", ["cells"], f"""
SELECT file, sheet, col_idx AS month_col, col_idx + 1 AS pct_col FROM (
  SELECT file, sheet, row_idx, col_idx, row_number() OVER (PARTITION BY file, sheet ORDER BY row_idx, col_idx) AS rk
  FROM cells WHERE sheet = 'PL' AND row_idx < 8
    AND ({_KEY_SQL} = lower({_m3}) OR starts_with({_KEY_SQL}, lower({_m3}) || ',')))
WHERE rk = 1""")

cte("nonnull", ["cells"], f"SELECT * FROM cells WHERE num_value IS NOT NULL OR {clean_sql('str_value')} IS NOT NULL")
oracle("grid_header", ["nonnull"], """
SELECT c.file, c.sheet, c.n_cols, h.header_row FROM
  (SELECT file, sheet, count(DISTINCT col_idx) AS n_cols FROM nonnull GROUP BY 1, 2) c
LEFT JOIN (SELECT file, sheet, min(row_idx) AS header_row FROM (
             SELECT file, sheet, row_idx, count(*) AS n FROM nonnull WHERE row_idx < 5 GROUP BY 1, 2, 3) WHERE n >= 2
           GROUP BY 1, 2) h ON c.file = h.file AND c.sheet = h.sheet""")

oracle("row_to_line", ["cells"], f"""
SELECT file, sheet, row_idx, string_agg(t, ' | ' ORDER BY col_idx) AS line FROM (
  SELECT file, sheet, row_idx, col_idx,
         CASE WHEN num_value IS NOT NULL THEN {plain_sql('num_value')} ELSE {clean_sql('str_value')} END AS t FROM cells)
WHERE t IS NOT NULL GROUP BY 1, 2, 3""")

_smap = {**SECTION_MAP, **SECTION_MAP_EXTRA}
_sec_case = "CASE " + " ".join(f"WHEN sheet = {s_lit(k)} THEN {s_lit(v)}" for k, v in _smap.items()) + " ELSE trim(sheet) END"
cte("sheets", ["cells"], "SELECT DISTINCT file, sheet, sheet_idx FROM cells")
oracle("section_map", ["sheets"], f"SELECT file, sheet, {_sec_case} AS section FROM sheets")
oracle("file_inventory", ["sheets"], f"""
SELECT file, CAST(count(*) AS INTEGER) AS sheets,
  array_to_string(list_slice(list(sheet ORDER BY sheet_idx), 1, {INVENTORY_SHOWN}), ', ')
    || CASE WHEN count(*) > {INVENTORY_SHOWN} THEN '...' ELSE '' END AS sheet_names
FROM sheets GROUP BY file""")


def period_sql(name: str, year: str) -> str:
    from ..functions.scalar import PERIOD_RULES
    whens = []
    for tokens, month in PERIOD_RULES:
        conds = [f"contains(lower({name}), {year})" if t == "{year}" else f"contains(lower({name}), {s_lit(t)})"
                 for t in tokens]
        whens.append(f"WHEN {' AND '.join(conds)} THEN {s_lit(month + ' ')} || {year}")
    return f"(CASE {' '.join(whens)} ELSE 'Unknown Period' END)"


_year = "regexp_extract(file, '(\\d{4})\\.xlsx$', 1)"
cte("inv", ["sheets"], f"""
SELECT file, {period_sql('file', _year)} AS period, string_agg(sheet, ', ' ORDER BY sheet_idx) AS sheets,
  CAST(count(*) AS VARCHAR) AS sheet_count FROM sheets GROUP BY file""")
oracle("audit_inventory", ["inv"], "SELECT * FROM inv")
oracle("detect_period", ["inv"], "SELECT file, period FROM inv")

_probes = [("sales_value", "PL", 3, 1), ("cogs", "PL", 5, 1), ("profit", "PL", 11, 1),
           ("first_creditor_closing", "Creditors Analysis", 3, 4)]
_pconds = [(f"(sheet = {s_lit(s)} AND row_idx = {r} AND col_idx = {c})", n) for n, s, r, c in _probes]
oracle("cell_probe", ["cells"], f"""
SELECT file, {', '.join(f'max(CASE WHEN {cond} THEN num_value END) AS {n}' for cond, n in _pconds)}
FROM cells WHERE {' OR '.join(cond for cond, _ in _pconds)} GROUP BY file""")


# KPI texts: highlights in listed order, then the creditor rows and their total, then the debtors.
_kpi_labels = ["Sales Value", "Cost of Goods Sold", "Gross Profit", "Net Profit", "Staff Salary"]
_kpi_vals = " UNION ALL ".join(f"SELECT {i} AS o, {s_lit(l)} AS label" for i, l in enumerate(_kpi_labels))
_who = "regexp_extract(file, '^(Supplier \\d+)', 1)"
cte("kpi", ["cells", "inv"], f"""
WITH hl AS (SELECT file, string_agg('- ' || label || ': ' || value, {NL} ORDER BY o) AS t FROM (
      SELECT k.file, lb.o, lb.label, {flong('v.num_value')} AS value,
             row_number() OVER (PARTITION BY k.file, lb.label ORDER BY k.row_idx) AS rk
      FROM (SELECT file, row_idx, {_KEY_SQL} AS key FROM cells WHERE sheet = 'PL' AND col_idx = 0) k
      JOIN ({_kpi_vals}) lb ON contains(k.key, lower(lb.label))
      JOIN (SELECT file, row_idx, num_value FROM cells WHERE sheet = 'PL' AND col_idx = 1 AND num_value IS NOT NULL) v
        ON v.file = k.file AND v.row_idx = k.row_idx)
    WHERE rk = 1 GROUP BY file),
pr AS (SELECT n.file, n.sheet, n.row_idx, n.name, c.closing
       FROM (SELECT file, sheet, row_idx, {clean_sql('str_value')} AS name FROM cells WHERE sheet <> 'PL' AND col_idx = 0 AND row_idx >= 3) n
       JOIN (SELECT file, sheet, row_idx, num_value AS closing FROM cells WHERE col_idx = 4 AND num_value IS NOT NULL) c
         ON n.file = c.file AND n.sheet = c.sheet AND n.row_idx = c.row_idx
       WHERE n.name IS NOT NULL AND NOT contains(lower(n.name), 'grand total') AND lower(n.name) <> 'total'),
cr AS (SELECT file, string_agg('- ' || name || ': closing balance ' || format('{{:,.2f}}', closing), {NL} ORDER BY row_idx) AS t,
         sum({c2('closing')}) AS total2 FROM pr WHERE sheet = 'Creditors Analysis' GROUP BY file),
db AS (SELECT file, sum({c2('closing')}) AS total2, count(*) AS n FROM pr WHERE sheet = 'Debtors Analysis' GROUP BY file)
SELECT inv.file, inv.period AS report_period,
  concat_ws({NL}, 'Audit KPI Summary for ' || {_who}, 'Source file: ' || file, 'Report period: ' || period, 'Business: ' || {_who},
    CASE WHEN hl.t IS NOT NULL THEN 'Profit & Loss highlights:' || {NL} || hl.t END,
    CASE WHEN cr.t IS NOT NULL THEN 'Top creditors:' || {NL} || cr.t || {NL} || '- Total creditor closing balance (top entries): '
      || format('{{:,.2f}}', {dbl('cr.total2', 2)}) END,
    CASE WHEN db.n > 0 THEN '- Total debtor closing balance: ' || format('{{:,.2f}}', {dbl('db.total2', 2)}) || ' across ' || db.n || ' customers' END) AS text
FROM inv LEFT JOIN hl USING (file) LEFT JOIN cr USING (file) LEFT JOIN db USING (file)
WHERE hl.t IS NOT NULL OR cr.t IS NOT NULL OR db.n > 0""")
oracle("kpi_summary", ["kpi"], "SELECT * FROM kpi")


# Sheets as markdown tables: columns with any value, renumbered; trailing "col..." headers dropped.
_short = f"CASE WHEN num_value IS NOT NULL THEN {fshort('num_value')} ELSE {clean_sql('str_value')} END"
_raw = f"CASE WHEN num_value IS NOT NULL THEN {plain_sql('num_value')} ELSE {clean_sql('str_value')} END"
cte("md", ["cells", "nonnull"], f"""
WITH c AS (SELECT file, sheet, row_idx, {_short} AS t, {_raw} AS raw,
             dense_rank() OVER (PARTITION BY file, sheet ORDER BY col_idx) - 1 AS pos FROM nonnull),
n AS (SELECT file, sheet, max(row_idx) + 1 AS n_rows, max(row_idx) + 1 AS max_rows
      FROM cells GROUP BY 1, 2),
hdr AS (SELECT file, sheet, min(row_idx) AS header_row FROM (
          SELECT file, sheet, row_idx FROM nonnull WHERE row_idx < 5 GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2),
hc AS (SELECT c.file, c.sheet, c.pos, c.raw FROM c JOIN hdr USING (file, sheet) WHERE c.row_idx = hdr.header_row),
slots AS (SELECT file, sheet, unnest(generate_series(0, max(pos))) AS pos FROM hc GROUP BY 1, 2),
names AS (SELECT s.file, s.sheet, s.pos, coalesce(hc.raw, 'col' || s.pos) AS name FROM slots s LEFT JOIN hc USING (file, sheet, pos)),
shown AS (SELECT file, sheet, pos, name FROM (
            SELECT *, max(CASE WHEN NOT starts_with(name, 'col') THEN pos END) OVER (PARTITION BY file, sheet) AS last FROM names)
          WHERE pos <= last),
head AS (SELECT file, sheet, '| ' || string_agg(name, ' | ' ORDER BY pos) || ' |' || {NL} || '| ' || string_agg('---', ' | ') || ' |' AS t
         FROM shown GROUP BY 1, 2),
body AS (SELECT file, sheet, string_agg(line, {NL} ORDER BY row_idx) AS t FROM (
           SELECT r.file, r.sheet, r.row_idx, '| ' || string_agg(coalesce(c.t, ''), ' | ' ORDER BY s.pos) || ' |' AS line,
                  bool_or(c.t IS NOT NULL AND c.t <> '') AS filled
           FROM (SELECT DISTINCT c.file, c.sheet, c.row_idx FROM c JOIN hdr USING (file, sheet) JOIN n USING (file, sheet)
                 WHERE c.row_idx > header_row AND c.row_idx <= header_row + max_rows) r
           JOIN shown s USING (file, sheet)
           LEFT JOIN c ON c.file = r.file AND c.sheet = r.sheet AND c.row_idx = r.row_idx AND c.pos = s.pos
           GROUP BY 1, 2, 3) WHERE filled GROUP BY 1, 2),
plain AS (SELECT file, sheet, string_agg(line, {NL} ORDER BY row_idx) AS t FROM (
            SELECT file, sheet, row_idx, string_agg(raw, ' | ' ORDER BY pos) AS line FROM c JOIN n USING (file, sheet)
            WHERE row_idx < max_rows GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT file, sheet, CASE WHEN header_row IS NULL THEN plain.t ELSE
    concat_ws({NL}, head.t, coalesce(body.t, ''), CASE WHEN n_rows - header_row - 1 > max_rows
      THEN {NL} || '*...' || (n_rows - header_row - 1 - max_rows) || ' additional rows not shown*' END) END AS markdown
FROM (SELECT DISTINCT file, sheet FROM c) JOIN n USING (file, sheet) LEFT JOIN hdr USING (file, sheet) LEFT JOIN head USING (file, sheet)
LEFT JOIN body USING (file, sheet) LEFT JOIN plain USING (file, sheet)""")
oracle("grid_markdown", ["md"], "SELECT file, sheet, markdown FROM md")


def pack_sql(src: str, size: int = SHEET_CHUNK_SIZE) -> str:
    """(file, sheet, pos, chunk) from (file, sheet, text): whole lines packed into chunks, the table header repeated."""
    return f"""
WITH RECURSIVE src AS ({src}),
ln AS (SELECT file, sheet, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i
       FROM (SELECT file, sheet, string_split(text, {NL}) AS ls FROM src WHERE len(text) > {size})),
sep AS (SELECT file, sheet, coalesce(min(CASE WHEN starts_with(line, '|') AND contains(line, '---') THEN i END), 3) AS upto
        FROM ln WHERE i <= 3 GROUP BY 1, 2),
top AS (SELECT file, sheet, string_agg(line || {NL}, '' ORDER BY i) AS head, sum(len(line) + 1) AS head_len
        FROM ln JOIN sep USING (file, sheet) WHERE i <= upto AND starts_with(line, '|') GROUP BY 1, 2),
walk AS (SELECT file, sheet, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS part, CAST(len(line) + 1 AS BIGINT) AS used FROM ln WHERE i = 1
         UNION ALL
         SELECT w.file, w.sheet, w.i + 1, CASE WHEN w.used + len(l.line) + 1 > {size} THEN w.part + 1 ELSE w.part END,
                CAST(CASE WHEN w.used + len(l.line) + 1 > {size} THEN coalesce(t.head_len, 0) ELSE w.used END + len(l.line) + 1 AS BIGINT)
         FROM walk w JOIN ln l ON l.file = w.file AND l.sheet = w.sheet AND l.i = w.i + 1
         LEFT JOIN top t ON t.file = w.file AND t.sheet = w.sheet),
packed AS (SELECT file, sheet, part, CASE WHEN part > 0 THEN coalesce(any_value(head), '') ELSE '' END || string_agg(line, {NL} ORDER BY i) AS chunk
           FROM walk JOIN ln USING (file, sheet, i) LEFT JOIN top USING (file, sheet) GROUP BY 1, 2, 3)
SELECT file, sheet, 0 AS pos, text AS chunk FROM src WHERE len(text) <= {size}
UNION ALL
SELECT file, sheet, CAST(row_number() OVER (PARTITION BY file, sheet ORDER BY part) - 1 AS INTEGER) AS pos, chunk
FROM packed WHERE {strip_sql('chunk')} <> ''"""


cte("mdlines", ["md"], pack_sql("SELECT file, sheet, markdown AS text FROM md"))
oracle("chunk_lines", ["mdlines"], "SELECT file, sheet, pos, chunk FROM mdlines")

cte("sheetlines", ["md", "inv"], pack_sql(f"""
  SELECT file, sheet, 'Audit Record | Period: ' || period || ' | File: ' || file || ' | Sheet: ' || sheet || {NL} || markdown AS text
  FROM md JOIN inv USING (file) WHERE markdown <> ''"""))
_AUDIT_ID = "'audit_' || sha256(file) || '_' || printf('%02d', part) || '_' || printf('%03d', sub)"
cte("audit", ["sheetlines", "sheets", "inv", "kpi"], f"""
SELECT {_AUDIT_ID} AS chunk_id, 0 AS page, section, 'audit_data' AS source_type, file AS file_name, sheet_name, report_period, text, part, sub
FROM (
  SELECT file, period AS report_period, 0 AS part, 0 AS sub, 'Audit Data Overview' AS section, 'Overview' AS sheet_name,
    concat_ws({NL}, 'Supplier Audit Dataset', 'File: ' || file, 'Period: ' || period, 'Sheets: ' || sheets,
      'Data categories: sales, P&L, food margin, purchases, cash flow, creditors, debtors, wastage, inventory.') AS text FROM inv
  UNION ALL
  SELECT file, report_period, 1, 0, 'Audit KPI Summary', 'KPI Summary', text FROM kpi
  UNION ALL
  SELECT l.file, inv.period, s.sheet_idx + 2, l.pos, {_sec_case.replace('sheet', 'l.sheet')}, l.sheet, l.chunk
  FROM sheetlines l JOIN sheets s USING (file, sheet) JOIN inv USING (file))""")
oracle("audit_chunks", ["audit"], """
SELECT chunk_id, page, section, source_type, file_name, sheet_name, report_period, text FROM audit""")
oracle("ingest_manifest", ["audit"], f"""
SELECT file_name, count(*) AS chunks, max(CASE WHEN section = 'Audit Data Overview' THEN report_period END) AS report_period,
  max(CASE WHEN section = 'Audit Data Overview' THEN string_split(text, {NL})[-1] END) AS last_line
FROM audit GROUP BY file_name""")


# ====================================================================== sinks
oracle("sink_roundtrip", ["fm"], "SELECT * FROM fm")
oracle("daily_csv_roundtrip", ["daily"], "SELECT * FROM daily")
oracle("index_upsert", ["chunks"], """
SELECT chunk_id, doc_id, version, quality FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) AS rk FROM (
    SELECT chunk_id, doc_id, CAST(0 AS BIGINT) AS version, NULL::INTEGER AS quality FROM chunks
    UNION ALL
    SELECT c.chunk_id, c.doc_id, CAST(1 AS BIGINT), l.quality FROM chunks c JOIN labels l ON c.doc_id = l.doc_id))
WHERE rk = 1""")


# ====================================================================== remaining inventory items
oracle("top_creditor", ["parties"], """
SELECT entity, period, party, closing FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY closing DESC, party) AS rk
  FROM parties WHERE type = 'creditor') WHERE rk = 1""")
oracle("pl_from_grid", ["pl"], "SELECT * FROM pl")
oracle("lenient_number", ["cells"], """
SELECT file, sheet, row_idx, col_idx,
  CASE WHEN isnan(TRY_CAST(trim(str_value) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(str_value) AS DOUBLE) END AS value
FROM cells WHERE str_value IS NOT NULL""")
oracle("clean_cell", [], f"SELECT doc_id, {clean_sql('source')} AS source, {clean_sql('lang')} AS lang FROM documents")
oracle("format_numbers", ["pl"], f"""
SELECT entity, period, {flong('sales_value')} AS sales_long, {fshort('sales_value')} AS sales_short,
  {flong('gross_margin')} AS margin_long, {fshort('profit')} AS profit_short FROM pl""")
oracle("monthly_pl_legacy", ["pl"], "SELECT * FROM pl")

oracle("corpus_coverage", [], """
SELECT d.source, count(*) AS n_docs, count(e.vec_id) AS n_indexed, count(*) - count(e.vec_id) AS n_without_vector
FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id GROUP BY d.source""")

cte("summaries", [], ORACLE["markdown_sections"])
oracle("corpus_union", ["chunks", "summaries", "audit"], """
SELECT chunk_id, 'proposal' AS source_type, section, CAST(len(text) AS INTEGER) AS n_chars FROM chunks
UNION ALL SELECT chunk_id, 'proposal', section, CAST(len(text) AS INTEGER) FROM summaries
UNION ALL SELECT chunk_id, source_type, section, CAST(len(text) AS INTEGER) FROM audit""")
oracle("monthly_pl_csv_roundtrip", ["pl"], "SELECT * FROM pl")
ORACLE["manifest_roundtrip"] = ORACLE["ingest_manifest"]
oracle("dq_summary", ["pl", "daily"], f"""
SELECT 'Indexed ' || (SELECT count(*) FROM pl) || ' workbooks. Monthly P&L months: ' || (SELECT count(DISTINCT period) FROM pl)
  || '. Daily sales days: ' || (SELECT count(DISTINCT date) FROM daily) || '. Issues logged: '
  || (SELECT count(*) FROM ({ORACLE['dq_issues']})) || '.' AS summary""")


# ====================================================================== sheets read back, and source routing
from ..sources.sheets import DAILY_PLANTED  # noqa: E402


def _years_before(n: int) -> str:
    return f"(SELECT entity, strftime(CAST(period || '-01' AS DATE) + INTERVAL {n} YEAR, '%Y-%m') AS period, total_sales FROM ms)"


oracle("sales_from_grid", ["ms"], f"""
SELECT ms.*, a.total_sales AS sales_last_year, b.total_sales AS sales_two_years_ago FROM ms
LEFT JOIN {_years_before(1)} a USING (entity, period) LEFT JOIN {_years_before(2)} b USING (entity, period)""")
oracle("parties_from_grid", ["parties"], "SELECT * FROM parties")
oracle("wastage_from_grid", ["waste"], "SELECT * FROM waste")
oracle("categories_from_grid", ["cat"], "SELECT * FROM cat")
oracle("daily_from_grid", ["daily"], "SELECT * FROM daily")
_planted = {}
for _, _, _reason in DAILY_PLANTED:
    _planted[_reason] = _planted.get(_reason, 0) + 1
oracle("daily_rejected", ["daily"], f"""
SELECT entity, reason, CAST(n AS BIGINT) AS n FROM (SELECT DISTINCT entity FROM daily),
  (VALUES {', '.join(f"('{r}', {n})" for r, n in _planted.items())}) v(reason, n)""")
cte("probed", ["pl", "ms", "waste"], f"""
SELECT {_file('entity', 'period')} AS file, entity, period, pl.sales_value AS margin_sales, pl.cogs AS margin_cogs, ms.net_sales, ms.cash_pct AS cash_share,
  ms.cash_sales AS cash_balance, ms.credit_sales AS bank_balance, ms.net_sales AS total_opening, ms.total_sales AS total_inflows,
  w.ktm AS wastage_ktm, w.pkr AS wastage_pkr, pl.cogs AS material_purchase, pl.staff_salary AS total_salary
FROM pl FULL JOIN ms USING (entity, period)
FULL JOIN (SELECT entity, period, sum(ktm) AS ktm, sum(pkr) AS pkr FROM waste GROUP BY 1, 2) w USING (entity, period)""")
oracle("report_probes", ["probed"], "SELECT * EXCLUDE (entity, period) FROM probed")
_probe_lines = [("'- Total Sales Value: '", "margin_sales"), ("'- Cost of Goods Sold: '", "margin_cogs"),
                ("'- Net Sales (' || strftime(CAST(period || '-01' AS DATE), '%B %Y') || '): '", "net_sales"), ("'- Cash Sales share: '", "cash_share"),
                ("'- Cash Balance: '", "cash_balance"), ("'- Bank Balance: '", "bank_balance"), ("'- Total Opening: '", "total_opening")]
oracle("kpi_summary_full", ["kpi", "probed"], f"""
, o AS (SELECT file, nullif(concat_ws({NL}, {', '.join(f"{begin} || {flong(c)}" for begin, c in _probe_lines)}), '') AS t, entity,
               strftime(CAST(period || '-01' AS DATE), '%B %Y') AS named FROM probed)
SELECT coalesce(kpi.file, o.file) AS file, coalesce(kpi.report_period, o.named) AS report_period,
  CASE WHEN kpi.file IS NULL THEN concat_ws({NL}, 'Audit KPI Summary for Supplier ' || entity, 'Source file: ' || o.file, 'Report period: ' || named,
                                            'Business: Supplier ' || entity, o.t)
       WHEN o.t IS NULL THEN kpi.text
       WHEN contains(kpi.text, {NL} || 'Top creditors:') THEN replace(kpi.text, {NL} || 'Top creditors:', {NL} || o.t || {NL} || 'Top creditors:')
       WHEN contains(kpi.text, {NL} || '- Total debtor') THEN replace(kpi.text, {NL} || '- Total debtor', {NL} || o.t || {NL} || '- Total debtor')
       ELSE kpi.text || {NL} || o.t END AS text
FROM kpi FULL JOIN o ON kpi.file = o.file WHERE kpi.file IS NOT NULL OR o.t IS NOT NULL""")
cte("routed", ["pl"], """
WITH w AS (SELECT strftime(m, '%Y-%m') AS period FROM (SELECT unnest(generate_series(date_trunc('month', max(l_shipdate)) - INTERVAL 5 MONTH,
             date_trunc('month', max(l_shipdate)), INTERVAL 1 MONTH)) AS m FROM lineitem))
SELECT pl.*, count(*) OVER (PARTITION BY entity) AS n FROM pl WHERE period IN (SELECT period FROM w)""")
for _name, _least in (("routed_pl", 5), ("routed_pl_complete", 6)):
    oracle(_name, ["routed"], f"SELECT * EXCLUDE (n), CASE WHEN n >= {_least} THEN 'monthly' ELSE 'legacy' END AS route FROM routed")
oracle("routed_daily", ["routed", "daily"], """
SELECT o.entity, daily.* EXCLUDE (entity), CASE WHEN daily.entity IS NULL THEN NULL WHEN o.entity IN (SELECT entity FROM routed WHERE n >= 6)
  THEN 'workbook' ELSE 'csv' END AS route FROM (SELECT DISTINCT user_id // 3 AS entity FROM events) o LEFT JOIN daily ON daily.entity = o.entity""")

oracle("knn_exact", ["emb"], """
SELECT question_id, rank, vec_id, similarity FROM (
  SELECT q.vec_id AS question_id, e.vec_id, list_reduce(list_transform(list_zip(q.vec, e.vec), lambda p: p[1] * p[2]), lambda a, x: a + x) / (q.vnorm * e.vnorm) AS similarity,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_reduce(list_transform(list_zip(q.vec, e.vec), lambda p: p[1] * p[2]), lambda a, x: a + x) / (q.vnorm * e.vnorm) DESC, e.vec_id) AS INTEGER) AS rank
  FROM emb q, emb e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id AND q.vnorm > 0 AND e.vnorm > 0) WHERE rank <= 10""")
