"""Live insights: products, price changes, spending and findings from streams of versions.

Receipts and items come as versions with ``server_sequence`` and perhaps ``_deleted``; they may
come late and in any order, and an item stays with its receipt. The newest version of each is
kept in buckets by receipt. Beside them lie, for each of these buckets, what its lines add to
products and what its receipts add to categories and merchants; a micro-batch makes both anew for
the buckets that it touches, and readers add the buckets up. So no product, category or merchant
is gathered anywhere, however many lines it has, and a product's latest price is found again among
the lines of its buckets when the latest one is taken back.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.operators import insights
from tillspark.operators.ordered import latest
from tillspark.streaming.buckets import BUCKETS, Batch, Store
from tillspark.streaming.sources import run_available

_RECEIPTS = ("id string, server_sequence long, _deleted boolean, transactionDate string, "
             "totalMinor long, categoryId string, merchantNormalized string, merchantRaw string")
# An item as kept has the name of its product, and what its receipt was when it was written.
_ITEMS = ("id string, receiptId string, server_sequence long, _deleted boolean, name string, "
          "unitPriceMinor long, totalPriceMinor long, quantity double")
_LINES = f"{_ITEMS}, transactionDate string, in_current boolean"
_SUMMARY = ("id string, total long, frequency long, quantity double, latest long, "
            "latestDate string, latestItem string, price_sum long, observations long")
_SPENDING = "key string, dimension string, total long, count long, previousTotal long, rows long"
TABLES = {"receipts": (_RECEIPTS, "id"), "items": (_LINES, "receiptId"),
          "summary": (_SUMMARY, None), "spending": (_SPENDING, None)}
_SUMS = ("total", "count", "previousTotal", "rows")


def open_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, root, TABLES, buckets)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _versions(rows: DataFrame, schema: str) -> DataFrame:
    """The rows of a batch with the columns that are kept."""
    for name, value in (("server_sequence", F.lit(0).cast("long")), ("_deleted", F.lit(False))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return rows.withColumn("_deleted", F.coalesce("_deleted", F.lit(False))).select(
        *_names(schema))


def _newest(old: DataFrame, fresh: DataFrame, schema: str, key: str) -> DataFrame:
    """The newest version of each row. Rows move once, by their receipt: combining them before
    would sort all of them a second time, and few versions of a row lie in one task."""
    names = _names(schema)
    both = old.select(*names).unionByName(fresh).repartition(key)
    return latest(both, list(dict.fromkeys([key, "id"])), "server_sequence").select(*names)


def _spending(receipts: DataFrame, now: datetime) -> DataFrame:
    """What the receipts of each bucket add to categories and merchants."""
    return insights.spent(receipts, now, "bucket").groupBy("bucket", "key", "dimension").agg(
        *[F.sum(c).alias(c) for c in _SUMS]).where("rows > 0")


def _summaries(lines: DataFrame) -> DataFrame:
    """What the live lines of each bucket add to products."""
    return insights.placed_summaries(lines.where("not _deleted and name != ''"), "bucket")


def apply(store: Store, now: datetime, receipts: DataFrame | None, items: DataFrame | None,
          stream: str, number: int) -> None:
    """One micro-batch of versions of either kind."""
    batch = Batch(store, stream, number)
    if batch.done:
        return
    touched = []
    if receipts is not None:
        fresh_r = _versions(receipts, _RECEIPTS)
        touched.append(fresh_r.select("id"))
    if items is not None:
        fresh_i = _versions(items.withColumn("name", insights.product_name()), _ITEMS)
        touched.append(fresh_i.select("receiptId"))
    buckets = store.buckets_of(touched)
    heads, old_i = batch.old("receipts", buckets), batch.old("items", buckets)
    if receipts is not None:
        heads = batch.put("receipts", _newest(heads, fresh_r, _RECEIPTS, "id"), buckets)
        batch.put("spending", _spending(
            heads.withColumn("bucket", store.bucket("id")), now), buckets)
    dated = insights.dated(heads.where("not _deleted"), now)
    if items is not None:
        kept = _newest(old_i, fresh_i, _ITEMS, "receiptId")
        lines = batch.put("items", kept.join(dated, "receiptId", "left").select(
            *_names(_LINES)), buckets)
    else:
        lines = old_i.drop("transactionDate", "in_current").join(dated, "receiptId", "left")
    batch.put("summary", _summaries(
        lines.withColumn("bucket", store.bucket("receiptId"))), buckets)
    batch.commit()


def follow(versions: DataFrame, collection: str, now: datetime, store: Store, stream: str,
           checkpoint: str) -> None:
    """Applies a stream of versions of ``receipts`` or ``items`` to the store."""
    def write(batch: DataFrame, number: int) -> None:
        parts = {"receipts": None, "items": None, collection: batch}
        apply(store, now, parts["receipts"], parts["items"], stream, number)

    run_available(versions.writeStream.foreachBatch(write), checkpoint)


def _products(store: Store) -> DataFrame:
    return insights.added_up(store.read("summary"))


def product_totals(store: Store) -> DataFrame:
    return _products(store).where("frequency > 0").select("id", "total", "quantity", "frequency")


def price_changes(store: Store) -> DataFrame:
    return insights.drifted(_products(store))


def findings(store: Store, **limits) -> DataFrame:
    spent = store.read("spending").groupBy(F.col("key").alias("id"), "dimension").agg(
        *[F.sum(c).alias(c) for c in _SUMS])
    return insights.best_findings(
        insights.with_change(spent), insights.with_price_change(_products(store)), **limits)
