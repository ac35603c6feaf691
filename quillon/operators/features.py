"""Feature extraction from dated transactions: running counts, as-of values, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numeric import whole_days


def before(partition: str, *order: str):
    """Strictly earlier rows of the same partition."""
    return Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running_count(condition: Column, window) -> Column:
    return F.coalesce(F.count_if(condition).over(window), F.lit(0)).cast("long")


def as_of(value: Column, condition: Column, window) -> Column:
    """The latest earlier value for which the condition held."""
    return F.last(F.when(condition, value), ignorenulls=True).over(window)


def tier_by_quantile(spend: DataFrame, q: float, high: str, low: str) -> DataFrame:
    """key, tier: high from the interpolated quantile of spend on. One row of thresholds is joined back."""
    cut = spend.agg(F.percentile("spend", q).alias("q"))
    return spend.crossJoin(F.broadcast(cut)).withColumn("tier", F.when(F.col("spend") >= F.col("q"), high).otherwise(low)).drop("q")


def bucket(x: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The name of the first edge that x doesn't exceed."""
    out = None
    for edge, name in edges:
        out = F.when(x <= edge, name) if out is None else out.when(x <= edge, name)
    return out.otherwise(last)


def invoices(rows: DataFrame, tier_quantile: float = 0.8, salt: str = "decision") -> DataFrame:
    """Cancellations with what was known before each: earlier cancellations, the latest earlier
    order of positive amount (its age and total), the customer's tier. Rows: invoice, customer,
    date, quantity, price; invoices that start with C cancel. Cancellations without an earlier
    order are left out, but count as earlier cancellations of later ones."""
    known = rows.where(F.col("customer").isNotNull())
    inv = known.groupBy("invoice").agg(F.first("customer", ignorenulls=True).alias("customer"), F.min("date").alias("date"), F.sum(F.col("quantity") * F.col("price")).alias("amount"))
    inv = inv.withColumn("cancel", F.col("invoice").startswith("C"))
    tiers = tier_by_quantile(inv.where(~F.col("cancel")).groupBy("customer").agg(F.sum("amount").alias("spend")), tier_quantile, "enterprise", "standard")
    w = before("customer", "date", "invoice")
    paid = ~F.col("cancel") & (F.col("amount") > 0)
    seen = inv.withColumns({"prior_refunds": running_count(F.col("cancel"), w), "order_date": as_of(F.col("date"), paid, w), "order_total": as_of(F.col("amount"), paid, w)})
    out = seen.where(F.col("cancel") & F.col("order_date").isNotNull()).join(tiers, "customer", "left")
    return out.select(
        F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.col("invoice")), 256), 1, 24).alias("key"),
        "customer", "prior_refunds", F.coalesce("tier", F.lit("standard")).alias("tier"),
        F.greatest(whole_days(F.col("date"), F.col("order_date")), F.lit(0)).alias("age_days"), F.round("order_total", 2).alias("total"), F.round(F.abs("amount"), 2).alias("refunded"),
    )
