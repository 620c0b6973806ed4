"""Golden fixtures: rows of the reference's exported tables, as literals.

monthly P&L (six months, one business), the sales/party/wastage columns of
its feature matrix, and its daily sales for one month.
"""

# Monthly P&L rows (period, month, sales_value, total_incomes, cogs, gross_profit,
# operational_expenses, staff_salary, foodmandu_charges, total_expenses, profit, bread_income).
PL_ROWS = [
    ("2026-01", "Jan", 2142381.4, 2357582.4, 1124957.2887500003, 1232625.1112499996, 128733.5, 392496.0, 48181.0,
     727858.47, 504766.64124999964, 143290.0),
    ("2026-02", "Feb", 1916459.53, 2052138.61, 1096534.9385000002, 955603.6714999999, 182490.0, 398076.0, 53798.0,
     780567.84, 175035.83149999997, 135679.08),
    ("2026-03", "Mar", 2300768.9699999997, 2558114.3299999996, 1256775.7532999997, 1301338.5766999999, 213344.91,
     524754.0, 39595.0, 1251421.05, 49917.52669999981, 0.0),
    ("2026-04", "Apr", 2313740.2800000003, 2498482.2800000003, 1301754.0809000004, 1196728.1990999999,
     199209.66999999998, 475397.0, 42080.0, 1095907.6099999999, 100820.58909999998, 164800.0),
    ("2026-05", "May", 2391924.0, 2821795.0, 1444167.4557, 1377627.5443, 191689.0, 484768.0, 41372.0, 951562.0,
     426065.54429999995, 357960.0),
    ("2026-06", "Jun", 2131326.41, 2189620.41, 1197788.3783, 991832.0317000002, 183378.0, 469673.0, 43442.0,
     866838.0, 124994.03170000017, 0.0),
]

# Feature-matrix columns from the sales sheet and the totals
# (period, net_sales, cash_pct, foodmandu_pct, pokhara_pct, credit_pct, discount_pct, cash_sales,
# foodmandu_sales, credit_sales, creditor_total, debtor_total, wastage_units).
SALES_ROWS = [
    ("2026-01", 2423015.958300001, 0.7426418938084463, 0.11203178793360236, 0.08718162968609117,
     0.05546208139474514, 0.005878596533230356, 1799433.16, 271454.81, 134385.50830000106, 611189.21, 250600.54,
     344.0),
    ("2026-02", 2172206.7631, 0.6822402154227046, 0.09768628088477752, 0.09930819830988123, 0.12016683565034245,
     0.026347776806076254, 1481966.81, 212194.8, 261027.21310000005, 619906.85, 306319.64, 194.0),
    ("2026-03", 2599868.936099998, 0.743529576879274, 0.07985974874235513, 0.09731738646007979, 0.0787932627124243,
     0.020576013876813314, 1933079.45, 207624.88, 204852.15609999822, 838360.96, 452503.56, 229.0),
    ("2026-04", 2614526.5164000015, 0.758253854977043, 0.08713236548607524, 0.07361962052885604,
     0.07920033516627802, 0.030760061945657072, 1982474.81, 227809.88, 207071.3764000014, 801849.4500000001,
     467476.56, 279.0),
    ("2026-05", 2702874.1877999995, 0.7946860011816937, 0.06595567814612285, 0.06826946323764808,
     0.07060788795180181, 0.014829096829410153, 2147936.28, 178269.9, 190844.23779999968, 835792.0599999999,
     528754.84, 217.0),
    ("2026-06", 2408398.8433000003, 0.7834887461640228, 0.08258595977710498, 0.06031151792157979,
     0.07307399843244244, 0.01259905766527486, 1886953.39, 198899.93, 175991.3333000004, 1251532.94, 399617.56,
     237.0),
]

# Daily sales of one month (date, cash, online, credit, total_sales, customers, dine_in_sales).
DAILY_ROWS = [
    ("2026-05-01", 9632.0, 63412.0, 4015.0, 77059.0, 50, 67101.0),
    ("2026-05-02", 13736.0, 71023.0, 9365.0, 94124.0, 52, 76450.0),
    ("2026-05-03", 19775.0, 54920.0, 11175.0, 85870.0, 56, 70947.0),
    ("2026-05-04", 6205.0, 34970.0, 2470.0, 43645.0, 25, 38965.99),
    ("2026-05-05", 15220.0, 55202.0, 8000.0, 78422.0, 52, 70423.0),
    ("2026-05-06", 6872.0, 6871.0, 4328.0, 18071.0, 11, 14126.0),
    ("2026-05-07", 16130.0, 37561.0, 1890.0, 55581.0, 31, 52094.0),
    ("2026-05-08", 11539.0, 35357.0, 4030.0, 50926.0, 37, 46729.0),
    ("2026-05-09", 941.0, 77486.0, 11215.0, 89642.0, 50, 76611.0),
    ("2026-05-10", 14147.0, 57901.0, 21135.0, 93183.0, 60, 94958.0),
    ("2026-05-11", 17302.0, 80202.0, 9455.0, 106959.0, 55, 94862.0),
    ("2026-05-12", 15381.0, 32266.0, 0.0, 47647.0, 34, 42052.0),
    ("2026-05-13", 11900.0, 43704.0, 1950.0, 57554.0, 42, 55403.0),
    ("2026-05-14", 7705.0, 48845.0, 0.0, 56550.0, 38, 51210.0),
    ("2026-05-15", 17405.0, 59185.0, 4725.0, 81315.0, 45, 72463.0),
    ("2026-05-16", 23140.0, 67030.0, 25900.0, 116070.0, 70, 92936.0),
    ("2026-05-17", 18470.0, 59020.0, 0.0, 77490.0, 51, 77500.0),
    ("2026-05-18", 5380.0, 16250.0, 4838.0, 26468.0, 18, 22041.0),
    ("2026-05-19", 22045.0, 21930.0, 9350.0, 53325.0, 35, 43452.0),
    ("2026-05-20", 5015.0, 74026.0, 1545.0, 80586.0, 48, 64352.0),
    ("2026-05-21", 21774.0, 41007.0, 9520.0, 72301.0, 59, 64356.0),
    ("2026-05-22", 40100.0, 64362.0, 5820.0, 110282.0, 57, 86434.0),
    ("2026-05-23", 15520.0, 34690.0, 14960.0, 65170.0, 47, 54658.0),
    ("2026-05-24", 12252.0, 67523.0, 11910.0, 91685.0, 58, 73883.0),
    ("2026-05-25", 8860.0, 21304.0, 1700.0, 31864.0, 31, 27553.0),
    ("2026-05-26", 5875.0, 58703.0, 6440.0, 71018.0, 28, 55361.0),
    ("2026-05-27", 9910.0, 28965.0, 9295.0, 48170.0, 31, 37047.0),
    ("2026-05-28", 23525.0, 54588.0, 4965.0, 83078.0, 61, 75863.0),
    ("2026-05-29", 18505.0, 70942.0, 1415.0, 90862.0, 57, 78305.0),
    ("2026-05-30", 23963.0, 69658.0, 11730.0, 105351.0, 54, 75020.0),
    ("2026-05-31", 14382.0, 84897.0, 0.0, 99279.0, 53, 98317.0),
]

# The five prescriptive actions and their criteria.
ACTIONS = [
    ("Reduce perishable production by 10%", 0.8, 0.6, 0.9, 0.7),
    ("Renegotiate top creditor terms", 0.9, 0.5, 0.6, 0.8),
    ("Rebalance Foodmandu vs cash channel mix", 0.7, 0.75, 0.7, 0.65),
    ("Optimize staffing to sales density", 0.6, 0.85, 0.7, 0.6),
    ("Hold safety cash buffer (15% of monthly sales)", 0.95, 0.4, 0.8, 0.9),
]
