"""Archive queries: search, filters, detail and counts."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions import dates, text
from tillspark.functions.catalogue import catalogue


def in_period(period: str, now: datetime) -> Column:
    """``all``, ``month``, ``previous`` or ``year``; undated receipts pass each of them."""
    if period == "all":
        return F.lit(True)
    day = F.col("transactionDate")
    first: date = now.date().replace(day=1)
    prefix = {
        "month": first.strftime("%Y-%m-"),
        "previous": (first - timedelta(days=1)).strftime("%Y-%m-"),
        "year": first.strftime("%Y-"),
    }[period]
    undated = day.isNull() | (day == "")
    return undated | (day.startswith(prefix) & dates.is_real_date(day))


def search(receipts: DataFrame, items: DataFrame, now: datetime, query: str = "",
           category: str = "", period: str = "all") -> DataFrame:
    """Receipts by text, category and period.

    The text may match the merchant names or any item of the receipt; the item test is an
    existence join on the receipt id, so no list of matches leaves the executors. Matching
    items are made distinct map-side first, so a receipt with many of them is one row.
    """
    spark = receipts.sparkSession
    if category:
        receipts = receipts.where(F.col("categoryId") == category)
    receipts = receipts.where(in_period(period, now))
    wanted = query.strip().lower()
    if not wanted:
        return receipts
    names = F.lower(F.concat("normalizedName", F.lit(" "), "rawName"))
    matching = items.where(F.contains(names, F.lit(wanted))).select("receiptId").distinct()
    return spark.sql(
        """SELECT r.* FROM {receipts} r
           WHERE contains(lower(concat(coalesce(merchantNormalized, ''), ' ',
                                       coalesce(merchantRaw, ''))), :wanted)
              OR EXISTS (SELECT 1 FROM {matching} m WHERE m.receiptId = r.id)""",
        args={"wanted": wanted}, receipts=receipts, matching=matching)


def receipt_detail(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Receipts with their items in long form, by position.

    A receipt may have any number of items, so they are not folded into an array. The order
    is within a receipt only and follows the join's partitions, without a shuffle of its own.
    """
    lines = items.select(
        F.col("receiptId").alias("id"), F.col("id").alias("itemId"), "position",
        text.product_key(F.col("normalizedName"), F.col("rawName")).alias("name"),
        "quantity", "unitPriceMinor", "totalPriceMinor", "userEdited")
    heads = receipts.select("id", "status", "transactionDate", "merchantNormalized",
                            "currency", "totalMinor")
    return heads.join(lines, "id", "left").sortWithinPartitions(
        "id", "position", "itemId")


def pending_count(receipts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Distinct receipts that wait for work, by their own status or by a job's."""
    waiting = receipts.where(F.col("status").isin("queued", "processing")).select("id")
    working = jobs.where(F.col("status").isin("pending", "processing")).select(
        F.coalesce(text.blank_to_null(F.col("receiptId")), "id").alias("id"))
    return waiting.union(working).distinct().agg(F.count(F.lit(1)).alias("pending"))


def archive_size(receipts: DataFrame) -> DataFrame:
    return receipts.agg(F.count(F.lit(1)).alias("receipts"))


def status_labels(receipts: DataFrame, language: str) -> DataFrame:
    """Receipts with the label of their status; an unknown status shows as it is."""
    labels = catalogue(receipts.sparkSession, "status.").where(F.col("lang") == language)
    labels = labels.select(F.col("key").alias("status_key"), F.col("text").alias("label"))
    keyed = receipts.withColumn("status_key", F.concat(F.lit("status."), "status"))
    return keyed.join(F.broadcast(labels), "status_key", "left").withColumn(
        "statusLabel", F.coalesce("label", "status")).drop("status_key", "label")
