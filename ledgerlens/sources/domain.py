"""Domain tables of the financial half, derived from the test tables.

entity = supplier (``l_suppkey``), period = ``yyyy-MM``.  Every table is
keyed by entity so that per-entity windows never need a global ordering.
Money is summed as integer units (see ``functions.money``) and converted to
DOUBLE once.

Joins against ``part`` and ``orders`` are plain equi-joins: Catalyst
broadcasts a side only when its size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks with runtime
sizes); beyond that it shuffles both sides on the key.  We never force a
broadcast of a table that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents, to_double, units
from ..functions.scalar import MONTH_ORDER, day_name, monday0, period_of
from .tables import Tables

# Order priority -> sales channel (cash, delivery platform,
# second branch, credit).  '4-NOT SPECIFIED' belongs to no channel.
CHANNELS = {
    "cash": "1-URGENT",
    "foodmandu": "2-HIGH",
    "pokhara": "3-MEDIUM",
    "credit": "5-LOW",
}

# Wastage rows that are headings or totals, not items.
WASTAGE_SKIP = ["pizza", "bansbari", "total"]

PL_COLUMNS = ["entity", "period", "month", "sales_value", "total_incomes", "cogs", "gross_profit",
              "gross_margin", "cogs_ratio", "operational_expenses", "staff_salary",
              "foodmandu_charges", "total_expenses", "profit", "profit_margin", "bread_income",
              "salary_to_sales"]


def month_of_period(period: Column) -> Column:
    arr = F.array(*[F.lit(m) for m in MONTH_ORDER])
    return F.element_at(arr, F.substring(period, 6, 2).cast("int"))


def ratio(num: Column, den: Column) -> Column:
    """NULL when the denominator is 0 or NULL (pandas: ``if den``)."""
    return F.try_divide(num, den)


def pl_from_units(g: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Finish a P&L from integer sums in 1e-4 units; ``keep`` names columns to pass on.

    Expects columns entity, period, sales4, other4, cogs4, opex4, salary4, fee4.
    """
    inc4 = F.col("sales4") + F.col("other4")
    gp4 = inc4 - F.col("cogs4")
    tot4 = F.col("opex4") + F.col("salary4") + F.col("fee4")
    profit4 = gp4 - tot4
    d = g.select(
        "entity", "period",
        month_of_period(F.col("period")).alias("month"),
        to_double(F.col("sales4"), 4).alias("sales_value"),
        to_double(inc4, 4).alias("total_incomes"),
        to_double(F.col("cogs4"), 4).alias("cogs"),
        to_double(gp4, 4).alias("gross_profit"),
        to_double(F.col("opex4"), 4).alias("operational_expenses"),
        to_double(F.col("salary4"), 4).alias("staff_salary"),
        to_double(F.col("fee4"), 4).alias("foodmandu_charges"),
        to_double(tot4, 4).alias("total_expenses"),
        to_double(profit4, 4).alias("profit"),
        to_double(F.col("other4"), 4).alias("bread_income"), *keep,
    )
    d = (d.withColumn("gross_margin", ratio(F.col("gross_profit"), F.col("total_incomes")))
          .withColumn("cogs_ratio", ratio(F.col("cogs"), F.col("total_incomes")))
          .withColumn("profit_margin", ratio(F.col("profit"), F.col("total_incomes")))
          .withColumn("salary_to_sales", ratio(F.col("staff_salary"), F.col("sales_value"))))
    return d.select(*PL_COLUMNS, *keep)


def _lines_with_part(t: Tables, *li_cols: str, part_cols=("p_retailprice",), where=None) -> DataFrame:
    li = t.lineitem.select("l_partkey", *li_cols)
    if where is not None:
        li = li.where(where)
    part = t.part.select("p_partkey", *part_cols)
    return li.join(part, li.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey")


def monthly_pl(t: Tables, parts: int | None = None) -> DataFrame:
    """T3 (S3): per (entity, period) P&L.

    sales = sum(ext); other income = sum(ext*tax); cogs = sum(qty*retail
    price); operational expenses = line 1 revenue; staff salary = line 7
    revenue; platform charges = sum(ext*discount).  With ``parts`` the joined
    lines move, by entity, and not their partial sums."""
    j = _lines_with_part(t, "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                         "l_discount", "l_tax", "l_shipdate")
    j = j.select(F.col("l_suppkey").alias("entity"), period_of("l_shipdate").alias("period"), cents("l_extendedprice").alias("ext"),
                 cents("l_tax").alias("tax"), cents("l_discount").alias("disc"), units("l_quantity").alias("qty"),
                 cents("p_retailprice").alias("price"), F.col("l_linenumber").alias("ln"))
    if parts is not None:
        j = j.repartition(parts, "entity")
    ext, ln, zero = F.col("ext"), F.col("ln"), F.lit(0).cast("bigint")
    g = j.groupBy("entity", "period").agg(
        (F.sum(ext) * 100).alias("sales4"),
        F.sum(ext * F.col("tax")).alias("other4"),
        (F.sum(F.col("qty") * F.col("price")) * 100).alias("cogs4"),
        (F.sum(F.when(ln == 1, ext).otherwise(zero)) * 100).alias("opex4"),
        (F.sum(F.when(ln == 7, ext).otherwise(zero)) * 100).alias("salary4"),
        F.sum(ext * F.col("disc")).alias("fee4"),
    )
    return pl_from_units(g)


MS_COLUMNS = ["entity", "period", "month", "month_num", "total_sales", "discount", "discount_pct",
              "vat", "net_sales", "cash_sales", "cash_pct", "foodmandu_sales", "foodmandu_pct",
              "pokhara_sales", "pokhara_pct", "credit_sales", "credit_pct"]


def monthly_sales(t: Tables, parts: int | None = None) -> DataFrame:
    """T2 (S2): per (entity, order period) sales and channel mix.

    net = sum(ext*(1-discount)); channels split net sales by order priority;
    each channel share is over net sales, discount share over gross.  With
    ``parts`` the joined lines move, by entity, and not their partial sums."""
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    od = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority")
    j = li.join(od, li.l_orderkey == od.o_orderkey).drop("l_orderkey", "o_orderkey")
    if parts is not None:
        j = j.repartition(parts, "l_suppkey")
    ext, tax, disc = cents("l_extendedprice"), cents("l_tax"), cents("l_discount")
    net = ext * (F.lit(100) - disc)
    zero = F.lit(0).cast("bigint")
    aggs = [(F.sum(ext) * 100).alias("gross4"), F.sum(ext * disc).alias("disc4"),
            F.sum(ext * tax).alias("vat4"), F.sum(net).alias("net4")]
    for name, prio in CHANNELS.items():
        aggs.append(F.sum(F.when(F.col("o_orderpriority") == prio, net).otherwise(zero)).alias(f"{name}4"))
    g = j.groupBy(F.col("l_suppkey").alias("entity"), period_of("o_orderdate").alias("period")).agg(*aggs)
    cols = [
        "entity", "period",
        month_of_period(F.col("period")).alias("month"),
        F.substring("period", 6, 2).cast("int").alias("month_num"),
        to_double(F.col("gross4"), 4).alias("total_sales"),
        to_double(F.col("disc4"), 4).alias("discount"),
        to_double(F.col("vat4"), 4).alias("vat"),
        to_double(F.col("net4"), 4).alias("net_sales"),
    ] + [to_double(F.col(f"{n}4"), 4).alias(f"{n}_sales") for n in CHANNELS]
    d = g.select(*cols).withColumn("discount_pct", ratio(F.col("discount"), F.col("total_sales")))
    for n in CHANNELS:
        d = d.withColumn(f"{n}_pct", ratio(F.col(f"{n}_sales"), F.col("net_sales")))
    return d.select(*MS_COLUMNS)


def _signed_ext() -> Column:
    # Fulfilled lines add to the balance, open lines draw it down.
    return F.when(F.col("l_linestatus") == "F", cents("l_extendedprice")).otherwise(-cents("l_extendedprice"))


def party_movements(t: Tables) -> DataFrame:
    """Per (entity, period, type, party) balance movement in cents."""
    cred = (_lines_with_part(t, "l_suppkey", "l_extendedprice", "l_linestatus", "l_shipdate",
                             part_cols=("p_brand",))
            .groupBy(F.col("l_suppkey").alias("entity"), period_of("l_shipdate").alias("period"),
                     F.col("p_brand").alias("party"))
            .agg(F.sum(_signed_ext()).alias("mov2"))
            .withColumn("type", F.lit("creditor")))
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_shipdate")
    od = t.orders.select("o_orderkey", "o_custkey")
    deb = (li.join(od, li.l_orderkey == od.o_orderkey)
           .groupBy(F.col("l_suppkey").alias("entity"), period_of("l_shipdate").alias("period"),
                    F.concat(F.lit("customer-"), (F.col("o_custkey") % 10).cast("string")).alias("party"))
           .agg(F.sum(_signed_ext()).alias("mov2"))
           .withColumn("type", F.lit("debtor")))
    return cred.unionByName(deb)


def keep_party_row(party: Column, closing: Column) -> Column:
    """S7 row filter: named party, known closing, not a total line."""
    p = F.lower(F.trim(party))
    return (party.isNotNull() & (p != "") & closing.isNotNull()
            & ~p.contains("grand total") & (p != "total"))


def party_balances(t: Tables) -> DataFrame:
    """T5 (S7 + U1): creditor and debtor balances, one table with ``type``.

    closing = running sum of movements per (entity, type, party) by period;
    opening = closing - movement.  The window runs over the already
    aggregated rows (at most one per period), so a hot party stays small."""
    return _balances(party_movements(t))


def _balances(m: DataFrame) -> DataFrame:
    """Running balances from (entity, period, type, party, mov2) movements."""
    w = Window.partitionBy("entity", "type", "party").orderBy("period").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("close2", F.sum("mov2").over(w))
    out = m.select(
        "entity", "period", "type", F.trim("party").alias("party"),
        to_double(F.col("close2") - F.col("mov2"), 2).alias("opening"),
        to_double(F.col("close2"), 2).alias("closing"),
        to_double(F.col("mov2"), 2).alias("movement"),
    )
    return out.where(keep_party_row(F.col("party"), F.col("closing")))


# A row of a monthly report before its sheets are laid out as cells (see ``grid.laid_out``): its file, which sheets it
# gives, a text, a place, numbers, and named lines in the order of their names.
REPORT_ROW = ["file", "kind", "label", "place", "v", "items"]


def _balance_items(name: Column, kept: Column) -> Column:
    item = F.struct(F.trim(name).alias("name"), to_double(F.col("close2") - F.col("mov2"), 2).alias("a"),
                    to_double(F.col("close2"), 2).alias("b"), F.lit(None).cast("double").alias("c"))
    return F.array_sort(F.collect_list(F.when(kept, item)))


def _cent_items(name: Column, kept: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(kept, F.struct(F.trim(name).alias("name"), (F.col("close2") - F.col("mov2")).alias("a"), F.col("close2").alias("b")))))


def _running(party: str) -> Column:
    return F.sum("mov2").over(Window.partitionBy("entity", party).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def pl_with_creditors(t: Tables, parts: int) -> DataFrame:
    """T3 and the creditors of T5 in a row per (entity, period): the P&L, ``items`` (name, a = opening, b = closing) and ``total2``, the sum of the closings in cents.

    Lines joined with part move once, by entity, into ``parts`` partitions; the sums
    by brand give the balances and, added up, the P&L."""
    j = _lines_with_part(t, "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate",
                         part_cols=("p_retailprice", "p_brand"))
    j = j.select(F.col("l_suppkey").alias("entity"), period_of("l_shipdate").alias("period"), "p_brand", cents("l_extendedprice").alias("ext"),
                 cents("l_tax").alias("tax"), cents("l_discount").alias("disc"), units("l_quantity").alias("qty"),
                 cents("p_retailprice").alias("price"), F.col("l_linenumber").alias("ln"),
                 (F.col("l_linestatus") == "F").alias("closed")).repartition(parts, "entity")
    ext, zero = F.col("ext"), F.lit(0).cast("bigint")
    g = j.groupBy("entity", "period", "p_brand").agg(
        F.sum(ext).alias("sales2"), F.sum(ext * F.col("tax")).alias("other4"), F.sum(F.col("qty") * F.col("price")).alias("cogs2"),
        F.sum(F.when(F.col("ln") == 1, ext).otherwise(zero)).alias("opex2"), F.sum(F.when(F.col("ln") == 7, ext).otherwise(zero)).alias("salary2"),
        F.sum(ext * F.col("disc")).alias("fee4"), F.sum(F.when(F.col("closed"), ext).otherwise(-ext)).alias("mov2"))
    g = g.withColumn("close2", _running("p_brand"))
    kept = keep_party_row(F.trim("p_brand"), F.col("close2"))
    d = g.groupBy("entity", "period").agg(
        (F.sum("sales2") * 100).alias("sales4"), F.sum("other4").alias("other4"), (F.sum("cogs2") * 100).alias("cogs4"),
        (F.sum("opex2") * 100).alias("opex4"), (F.sum("salary2") * 100).alias("salary4"), F.sum("fee4").alias("fee4"),
        _balance_items(F.col("p_brand"), kept).alias("items"), F.sum(F.when(kept, F.col("close2"))).alias("total2"))
    return pl_from_units(d, ("items", "total2"))


def debtors_by_report(t: Tables, parts: int) -> DataFrame:
    """The debtors of T5 in a row per (entity, period), like the creditors of ``pl_with_creditors``; lines joined with orders move once, by entity."""
    li = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("entity"), period_of("l_shipdate").alias("period"), cents("l_extendedprice").alias("ext"),
                           (F.col("l_linestatus") == "F").alias("closed"))
    od = t.orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("cgrp"))
    j = li.join(od, li.l_orderkey == od.o_orderkey).drop("l_orderkey", "o_orderkey").repartition(parts, "entity")
    ext = F.col("ext")
    g = j.groupBy("entity", "period", "cgrp").agg(F.sum(F.when(F.col("closed"), ext).otherwise(-ext)).alias("mov2"))
    g = g.withColumn("close2", _running("cgrp")).withColumn("party", F.concat(F.lit("customer-"), F.col("cgrp").cast("string")))
    kept = keep_party_row(F.trim("party"), F.col("close2"))
    return g.groupBy("entity", "period").agg(_balance_items(F.col("party"), kept).alias("items"), F.sum(F.when(kept, F.col("close2"))).alias("total2"))


def keep_wastage_item(item: Column) -> Column:
    """S8 row filter; also skips 'total ...' lines to avoid double counting."""
    i = F.lower(F.trim(item))
    return (item.isNotNull() & (i != "") & ~i.isin(*WASTAGE_SKIP) & ~i.startswith("total"))


def wastage(t: Tables, parts: int | None = None) -> DataFrame:
    """T6 (S8): returned quantities per item; the two 'branches' are line
    status O and F; a zero total falls back to the branch sum.  With ``parts``
    the joined lines move, by entity, and not their partial sums."""
    j = _lines_with_part(t, "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate",
                         part_cols=("p_type",), where=F.col("l_returnflag") == "R")
    if parts is not None:
        j = j.repartition(parts, "l_suppkey")
    q = units("l_quantity")
    zero = F.lit(0).cast("bigint")
    g = j.groupBy(F.col("l_suppkey").alias("entity"), period_of("l_shipdate").alias("period"),
                  F.col("p_type").alias("item")).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(zero)).alias("ktm"),
        F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(zero)).alias("pkr"),
        F.sum(q).alias("tot"))
    total = F.coalesce(F.nullif(F.col("tot"), F.lit(0)), F.col("ktm") + F.col("pkr"))
    return (g.where(keep_wastage_item(F.col("item")))
             .select("entity", "period", F.trim("item").alias("item"),
                     F.col("ktm").cast("double").alias("ktm"), F.col("pkr").cast("double").alias("pkr"),
                     total.cast("double").alias("total")))


def _grains(j: DataFrame, sums: list[str], grains: list[tuple[Column | None, Column, Column, dict[str, Column]]]) -> DataFrame:
    """Sums per (entity, grain, period, key) of lines dealt by entity; a grain is (condition, period, key, values) and has its place as number.

    A line becomes a row for each grain after it has moved, so lines move once."""
    each = []
    for i, (where, period, key, values) in enumerate(grains):
        row = F.struct(F.lit(i).alias("grain"), period.alias("period"), key.cast("string").alias("key"),
                       *[(values[c] if c in values else F.lit(None)).cast("bigint").alias(c) for c in sums])
        each.append(row if where is None else F.when(where, row))
    rows = j.select("entity", F.inline(F.array_compact(F.array(*each))))
    return rows.groupBy("entity", "grain", "period", "key").agg(*[F.sum(c).alias(c) for c in sums])


def reports_by_part(t: Tables, parts: int) -> DataFrame:
    """P&L, creditors (T5) and wastage (T6) of each (entity, period) as whole numbers, which take less room than what they give.

    That is the sums that ``pl_from_units`` takes; ``items`` (name, a = opening, b = closing, in cents) and ``total2``; ``waste`` (name, a = ktm, b = pkr, c = total), both
    in the order of the names, and ``ktm``, ``pkr``, ``total``.  Lines are joined with part, and move by entity, once for all of these."""
    # whole numbers, the month and two flags take less room than what they are made of
    status, returned = F.col("l_linestatus"), F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    li = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "month").alias("month"), cents("l_extendedprice").alias("ext"), cents("l_tax").alias("tax"),
                           cents("l_discount").alias("disc"), units("l_quantity").alias("qty"), F.col("l_linenumber").alias("ln"),
                           F.when(status == "F", 1).when(status == "O", 2).otherwise(0).cast("byte").alias("status"), returned.alias("returned"))
    part = t.part.select("p_partkey", cents("p_retailprice").alias("price"), "p_brand", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey").withColumn("p_type", F.when(F.col("returned"), F.col("p_type"))).repartition(parts, "entity")
    j = j.withColumn("period", period_of("month"))
    ext, qty, ln, status, zero = F.col("ext"), F.col("qty"), F.col("ln"), F.col("status"), F.lit(0).cast("bigint")
    lines = {"sales2": ext, "other4": ext * F.col("tax"), "cogs2": qty * F.col("price"), "opex2": F.when(ln == 1, ext).otherwise(zero),
             "salary2": F.when(ln == 7, ext).otherwise(zero), "fee4": ext * F.col("disc"), "mov2": F.when(status == 1, ext).otherwise(-ext)}
    waste = {"sales2": F.when(status == 2, qty).otherwise(zero), "other4": F.when(status == 1, qty).otherwise(zero), "cogs2": qty}
    g = _grains(j, list(lines), [(None, F.col("period"), F.col("p_brand"), lines), (F.col("returned"), F.col("period"), F.col("p_type"), waste)])
    w = Window.partitionBy("entity", "grain", "key").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("close2", F.sum("mov2").over(w))
    of_line, of_waste = F.col("grain") == 0, (F.col("grain") == 1) & keep_wastage_item(F.col("key"))
    kept = of_line & keep_party_row(F.trim("key"), F.col("close2"))
    ktm, pkr, tot = F.col("sales2"), F.col("other4"), F.col("cogs2")
    total = F.coalesce(F.nullif(tot, F.lit(0)), ktm + pkr)
    item = F.struct(F.trim("key").alias("name"), ktm.alias("a"), pkr.alias("b"), total.alias("c"))
    return g.groupBy("entity", "period").agg(
        *[(F.sum(F.when(of_line, F.col(c))) * scale).alias(name) for c, name, scale in (("sales2", "sales4", 100), ("other4", "other4", 1), ("cogs2", "cogs4", 100),
                                                                                      ("opex2", "opex4", 100), ("salary2", "salary4", 100), ("fee4", "fee4", 1))],
        _cent_items(F.col("key"), kept).alias("items"), F.sum(F.when(kept, F.col("close2"))).alias("total2"),
        F.array_sort(F.collect_list(F.when(of_waste, item))).alias("waste"), *[F.sum(F.when(of_waste, x)).alias(n) for n, x in (("ktm", ktm), ("pkr", pkr), ("total", total))])


def reports_by_order(t: Tables, parts: int) -> DataFrame:
    """Debtors (T5) and sales (T2) of each (entity, period) that has either, as whole numbers like ``reports_by_part``; ``n_debtors`` and ``n_sales`` tell which.

    Lines are joined with orders, and move by entity, once for both."""
    li = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "month").alias("month"), cents("l_extendedprice").alias("ext"),
                           cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), (F.col("l_linestatus") == "F").alias("closed"))
    channel = F.coalesce(*[F.when(F.col("o_orderpriority") == prio, F.lit(i)) for i, prio in enumerate(CHANNELS.values())])
    od = t.orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("cgrp"), F.trunc("o_orderdate", "month").alias("ordered"), channel.cast("byte").alias("channel"))
    j = li.join(od, li.l_orderkey == od.o_orderkey).drop("l_orderkey", "o_orderkey").repartition(parts, "entity")
    j = j.withColumns({"period": period_of("month"), "ordered": period_of("ordered")})
    ext, disc, zero = F.col("ext"), F.col("disc"), F.lit(0).cast("bigint")
    net = ext * (F.lit(100) - disc)
    sales = {"gross2": ext, "disc4": ext * disc, "vat4": ext * F.col("tax"), "net4": net,
             **{f"{n}4": F.when(F.col("channel") == i, net).otherwise(zero) for i, n in enumerate(CHANNELS)}}
    moved = {"gross2": F.when(F.col("closed"), ext).otherwise(-ext)}
    g = _grains(j, list(sales), [(None, F.col("period"), F.col("cgrp"), moved), (None, F.col("ordered"), F.lit(None), sales)])
    w = Window.partitionBy("entity", "grain", "key").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("mov2", F.col("gross2")).withColumn("close2", F.sum("gross2").over(w)).withColumn("party", F.concat(F.lit("customer-"), F.col("key")))
    of_debtor, of_sales = F.col("grain") == 0, F.col("grain") == 1
    kept = of_debtor & keep_party_row(F.trim("party"), F.col("close2"))
    return g.groupBy("entity", "period").agg(
        F.count_if(of_debtor).alias("n_debtors"), _cent_items(F.col("party"), kept).alias("items"), F.sum(F.when(kept, F.col("close2"))).alias("total2"),
        F.count_if(of_sales).alias("n_sales"), (F.sum(F.when(of_sales, F.col("gross2"))) * 100).alias("gross4"),
        *[F.sum(F.when(of_sales, F.col(c))).alias(c) for c in sales if c != "gross2"])


def category_sales(t: Tables) -> DataFrame:
    """T7 (S9): per (entity, category = brand) quantity and value."""
    j = _lines_with_part(t, "l_suppkey", "l_quantity", "l_extendedprice", part_cols=("p_brand",))
    g = j.groupBy(F.col("l_suppkey").alias("entity"), F.trim("p_brand").alias("category")).agg(
        F.sum(units("l_quantity")).alias("q"), F.sum(cents("l_extendedprice")).alias("v2"))
    return (g.where(F.col("category").isNotNull() & (F.col("category") != "") & F.col("v2").isNotNull())
             .select("entity", "category", F.col("q").cast("double").alias("qty"),
                     to_double(F.col("v2"), 2).alias("value")))


# The reference's limits on a day's sales.
MIN_YEAR, MAX_DAY_TOTAL = 2020, 500_000.0

DAILY_COLUMNS = ["entity", "date", "cash", "online", "credit", "total_sales", "customers",
                 "dine_in_sales", "avg_ticket", "day_of_week", "dow"]

# Event type -> daily sales column.
EVENT_CHANNELS = {"cash": "purchase", "online": "click", "credit": "view", "dine_in": "signup"}


def _daily_units(t: Tables) -> DataFrame:
    """Sums in cents per (outlet = user_id div 3, day)."""
    ev = t.events.select("user_id", "ts", "event_type", "value")
    v = cents("value")
    zero = F.lit(0).cast("bigint")
    aggs = [F.sum(F.when(F.col("event_type") == et, v).otherwise(zero)).alias(f"{c}2")
            for c, et in EVENT_CHANNELS.items() if c != "dine_in"]
    aggs += [F.sum(F.when(F.col("event_type") == EVENT_CHANNELS["dine_in"], v)).alias("dine_in2"),
             F.sum(v).alias("total2"), F.count_distinct("user_id").alias("customers")]
    return ev.groupBy(F.expr("user_id div 3").alias("entity"), F.to_date("ts").alias("date")).agg(*aggs)


def _daily_kept(min_year: int, max_total: float) -> Column:
    return F.col("total2").isNotNull() & (F.year("date") >= min_year) & (F.col("total2") <= F.lit(round(max_total * 100)))


def daily_dropped(t: Tables, min_year: int = MIN_YEAR, max_total: float = MAX_DAY_TOTAL) -> DataFrame:
    """How many days ``daily_sales`` leaves out, for the quality report."""
    return _daily_units(t).agg(F.count_if(~F.coalesce(_daily_kept(min_year, max_total), F.lit(False))).alias("dropped"))


def daily_sales(t: Tables, min_year: int = MIN_YEAR, max_total: float = MAX_DAY_TOTAL) -> DataFrame:
    """T4 (S5): per (outlet = user_id div 3, day) sales.

    Days with no total, a year before ``min_year`` or a total above
    ``max_total`` are dropped (``daily_dropped`` counts them); missing channel
    amounts are 0; avg_ticket = dine-in / customers when both are non-zero."""
    zero = F.lit(0).cast("bigint")
    g = _daily_units(t).where(_daily_kept(min_year, max_total))
    d = g.select(
        "entity", "date",
        to_double(F.coalesce("cash2", zero), 2).alias("cash"),
        to_double(F.coalesce("online2", zero), 2).alias("online"),
        to_double(F.coalesce("credit2", zero), 2).alias("credit"),
        to_double(F.col("total2"), 2).alias("total_sales"),
        F.col("customers").cast("bigint").alias("customers"),
        to_double(F.col("dine_in2"), 2).alias("dine_in_sales"),
        day_name("date").alias("day_of_week"),
        monday0("date").cast("int").alias("dow"),
    )
    d = d.withColumn("avg_ticket", F.when((F.col("customers") != 0) & (F.col("dine_in_sales") != 0),
                                          F.col("dine_in_sales") / F.col("customers").cast("double")))
    return d.select(*DAILY_COLUMNS)


# ------------------------------------------------------------------ one-pass ledger
# Numbers of the ledger's grains: per (entity, ship period), (entity, order period) and (entity, ship period, brand,
# customer group or part type).
GRAINS = {"pl": 0, "sales": 1, "creditor": 2, "debtor": 3, "waste": 4}
# Each grain's sums; they share the columns a, b, c ...
_SUMS = "abcdefg"
_GRAIN_SUMS = {
    "pl": ["ext2", "tax4", "cogs2", "opex2", "salary2", "disc4"],
    "sales": ["ext2", "disc4", "net4", *[f"{n}4" for n in CHANNELS]],
    "creditor": ["mov2"],
    "debtor": ["mov2"],
    "waste": ["ktm", "pkr", "tot", "n_ret"],
}


def _summed(grain: str, name: str) -> Column:
    return F.col(_SUMS[_GRAIN_SUMS[grain].index(name)])


def ledger_aggregates(t: Tables) -> DataFrame:
    """Every ledger grain in one pass: lineitem joined once with part and
    orders (referential integrity assumed, as in the separate tables), its
    lines dealt by entity, then a row for each grain and one aggregation by
    (entity, grain, period, key).

    The lines move, not the grains: a line has few repeats within a task, so
    partial sums of five grains would be five times its size.  What follows
    works on groups within an entity and needs no further exchange (a generator
    keeps the layout of its input, GROUPING SETS do not)."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus", "l_returnflag")
    part = t.part.select("p_partkey", cents("p_retailprice").alias("price"), "p_brand", "p_type")
    od = t.orders.select("o_orderkey", period_of("o_orderdate").alias("op"), "o_orderpriority", (F.col("o_custkey") % 10).alias("cgrp"))
    li = li.select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("entity"), period_of("l_shipdate").alias("sp"),
                   cents("l_extendedprice").alias("ext"), cents("l_tax").alias("tax"), cents("l_discount").alias("disc"),
                   units("l_quantity").alias("qty"), "l_linenumber", "l_linestatus", "l_returnflag")
    j = li.join(part, li.l_partkey == part.p_partkey).join(od, li.l_orderkey == od.o_orderkey) \
          .drop("l_partkey", "p_partkey", "l_orderkey", "o_orderkey").repartition("entity")
    ext, qty, line = F.col("ext"), F.col("qty"), F.col("l_linenumber")
    zero = F.lit(0).cast("bigint")
    net = ext * (F.lit(100) - F.col("disc"))
    ret = F.col("l_returnflag") == "R"
    status = F.col("l_linestatus")
    values = {"ext2": ext, "tax4": ext * F.col("tax"), "cogs2": qty * F.col("price"),
              "opex2": F.when(line == 1, ext).otherwise(zero), "salary2": F.when(line == 7, ext).otherwise(zero),
              "disc4": ext * F.col("disc"), "net4": net, "mov2": F.when(status == "F", ext).otherwise(-ext),
              "ktm": F.when(ret & (status == "O"), qty).otherwise(zero), "pkr": F.when(ret & (status == "F"), qty).otherwise(zero),
              "tot": F.when(ret, qty).otherwise(zero), "n_ret": F.when(ret, F.lit(1)).otherwise(F.lit(0)),
              **{f"{n}4": F.when(F.col("o_orderpriority") == prio, net).otherwise(zero) for n, prio in CHANNELS.items()}}
    keys = {"pl": ("sp", F.lit(None)), "sales": ("op", F.lit(None)), "creditor": ("sp", F.col("p_brand")),
            "debtor": ("sp", F.concat(F.lit("customer-"), F.col("cgrp").cast("string"))), "waste": ("sp", F.col("p_type"))}

    def grain(name):
        period, key = keys[name]
        sums = [values[v] for v in _GRAIN_SUMS[name]]
        sums += [F.lit(None)] * (len(_SUMS) - len(sums))
        return F.struct(F.lit(GRAINS[name]).alias("grain"), F.col(period).alias("period"), key.cast("string").alias("key"),
                        *[v.cast("bigint").alias(c) for v, c in zip(sums, _SUMS)])

    rows = j.select("entity", F.inline(F.array(*[grain(n) for n in GRAINS])))
    return rows.groupBy("entity", "grain", "period", "key").agg(*[F.sum(c).alias(c) for c in _SUMS])


def ledger_features(t: Tables) -> DataFrame:
    """J1-J3 in one pass: P&L, sales mix, party totals and wastage units per
    (entity, period) from a single evaluation of ``ledger_aggregates``.

    The grains stay in one table: a window runs the balances of every party,
    and one conditional aggregation folds the grains into a row per entity and
    period.  Lineitem is scanned once and joined twice; the rest works on
    aggregates.  Periods without a P&L row are left out (left join on the P&L)."""
    def grain(name):
        return F.col("grain") == GRAINS[name]

    run = Window.partitionBy("entity", "grain", "key").orderBy("period").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    g = ledger_aggregates(t).withColumn("close2", F.sum(_summed("creditor", "mov2")).over(run))
    kept = keep_party_row(F.col("key"), F.col("close2"))
    waste = grain("waste") & (_summed("waste", "n_ret") > 0) & keep_wastage_item(F.col("key"))
    ktm, pkr, tot = (_summed("waste", x) for x in ("ktm", "pkr", "tot"))
    units_lost = F.coalesce(F.nullif(tot, F.lit(0)), ktm + pkr).cast("double")

    def one(name, value, alias, scale=1):
        return F.max(F.when(grain(name), _summed(name, value) * scale)).alias(alias)

    d = g.groupBy("entity", "period").agg(
        F.count_if(grain("pl")).alias("n_pl"),
        one("pl", "ext2", "sales4", 100), one("pl", "tax4", "other4"), one("pl", "cogs2", "cogs4", 100),
        one("pl", "opex2", "opex4", 100), one("pl", "salary2", "salary4", 100), one("pl", "disc4", "fee4"),
        one("sales", "ext2", "gross4", 100), one("sales", "disc4", "less4"), one("sales", "net4", "net4"),
        *[one("sales", f"{n}4", f"{n}4") for n in CHANNELS],
        F.sum(F.when(grain("creditor") & kept, F.col("close2"))).alias("creditor2"),
        F.sum(F.when(grain("debtor") & kept, F.col("close2"))).alias("debtor2"),
        F.sum(F.when(waste, units_lost)).alias("wastage_units")).where("n_pl > 0")
    net = to_double(F.col("net4"), 4)
    d = d.withColumns({
        "net_sales": net, "discount_pct": ratio(to_double(F.col("less4"), 4), to_double(F.col("gross4"), 4)),
        **{f"{n}_sales": to_double(F.col(f"{n}4"), 4) for n in CHANNELS},
        **{f"{n}_pct": ratio(to_double(F.col(f"{n}4"), 4), net) for n in CHANNELS},
        "creditor_total": to_double(F.col("creditor2"), 2), "debtor_total": to_double(F.col("debtor2"), 2)})
    return pl_from_units(d, ("net_sales", "discount_pct", *[f"{n}_{x}" for n in CHANNELS for x in ("sales", "pct")],
                             "creditor_total", "debtor_total", "wastage_units"))
