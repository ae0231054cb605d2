"""Registered streaming queries; each runs over the whole log and must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.operators import insights
from tillspark.plans import insights as insight_plans
from tillspark.plans import maintenance as maintenance_plans
from tillspark.plans import replication as replication_plans
from tillspark.plans import views
from tillspark.session import work_dir
from tillspark.sources import adapter
from tillspark.streaming import levels, live, replicate, stateful
from tillspark.streaming.sources import stream_parquet


def _stream(s, d, name):
    schema = s.read.parquet(f"{d}/{name}.parquet").schema
    return stream_parquet(s, d, schema, f"{name}.parquet")


def _incoming(s, d):
    return adapter.incoming_from_events(_stream(s, d, "events"))


def _state(s, d):
    base = work_dir(s, "state")
    changes = _incoming(s, d).drop("owner_id")
    replicate.follow_state(changes, f"{base}/out", f"{base}/checkpoint")
    return replicate.followed_state(s, f"{base}/out")


def _notifications(s, d):
    base = work_dir(s, "notify")
    replicate.notify(_incoming(s, d), f"{base}/out", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out").drop("batch")


def _transitions(s, d):
    base = work_dir(s, "transitions")
    incoming = _incoming(s, d).where(F.col("collection_name") != "settings")
    stateful.follow_transitions(adapter.parsed_changes(incoming).select(
        "collection_name", "document_id", "server_sequence", "status"),
        f"{base}/out", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out")


def _limiter(s, d):
    base = work_dir(s, "limiter")
    attempts = adapter.attempts_from_events(_stream(s, d, "events"))
    stateful.follow_failures(attempts, f"{base}/out", f"{base}/checkpoint",
                             maintenance_plans.LIMIT, maintenance_plans.SECONDS)
    return s.read.parquet(f"{base}/out")


def _live(s, d):
    """Every receipt with wrong figures first, then as it is, then some tombstones."""
    base = work_dir(s, "live")
    wrong = {"totalMinor": F.col("totalMinor") + 777, "categoryId": F.lit("household")}
    rounds = ((0, wrong), (1, {}), (2, {"_deleted": F.lit(True)}))
    for number, changed in rounds:
        receipts = adapter.receipts_from(_stream(s, d, "orders"), s, d)
        if number == 2:
            receipts = receipts.where(F.col("id").cast("long") % 50 == 3)
        versions = receipts.withColumns(
            {"server_sequence": F.lit(number).cast("long"), **changed})
        replicate.live_comparison(versions, adapter.NOW, insights.CATEGORY, f"{base}/out",
                                  f"{base}/checkpoint-{number}", str(number))
    return replicate.latest_comparison(s, f"{base}/out")


_FOLLOWED: dict[tuple[str, str], live.Store] = {}


def _live_insights(result):
    """Receipts and items with wrong figures, then as they are and with tombstones of some.

    The streams run once for each application and data folder; the queries read one store.
    """
    def run(s, d):
        key = (s.sparkContext.applicationId, d)
        if key not in _FOLLOWED or not _FOLLOWED[key].manifest()["version"]:
            _FOLLOWED[key] = _follow_insights(s, d)
        return result(_FOLLOWED[key])
    return run


def _follow_insights(s, d):
    base = work_dir(s, "insights")
    store = live.open_store(s, f"{base}/store")
    wrong = {"receipts": {"totalMinor": F.col("totalMinor") + 777,
                          "categoryId": F.lit("household")},
             "items": {"unitPriceMinor": F.lit(9_999_999).cast("long"),
                       "totalPriceMinor": F.col("totalPriceMinor") * 3}}
    dead = {"receipts": F.col("id").cast("long") % 50 == 3,
            "items": (F.col("receiptId").cast("long") % 50 == 3) | (F.col("position") == 6)}
    for number, collection in enumerate(("receipts", "items", "receipts", "items")):
        if collection == "receipts":
            rows = adapter.receipts_from(_stream(s, d, "orders"), s, d)
        else:
            rows = adapter.receipt_items_from(_stream(s, d, "lineitem"), s, d)
        rows = rows.withColumn("server_sequence", F.lit(number).cast("long"))
        if number < 2:
            rows = rows.withColumns(wrong[collection])
        else:
            rows = rows.withColumn("_deleted", dead[collection])
        live.follow(rows, collection, adapter.NOW, store, f"round{number}",
                    f"{base}/checkpoint-{number}")
    return store


_LEVELS: dict[tuple[str, str], levels.Levels] = {}
BATCHES = 9


def _levelled(result):
    """The log in files by sequence, each a micro-batch; followed once for each application."""
    def run(s, d):
        key = (s.sparkContext.applicationId, d)
        if key not in _LEVELS or not _LEVELS[key].manifest()["version"]:
            base = work_dir(s, "levels")
            changes = adapter.incoming_documents(s, d).drop("owner_id")
            changes.repartitionByRange(BATCHES, "server_sequence").write.parquet(f"{base}/log")
            kept = levels.Levels(s, f"{base}/state", "collection_name string, "
                                 "document_id string, document_json string, server_sequence long, "
                                 "is_deleted boolean, created_at string, updated_at string")
            levels.follow(stream_parquet(s, f"{base}/log", changes.schema, max_bytes=1), kept,
                          f"{base}/checkpoint")
            _LEVELS[key] = kept
        return result(_LEVELS[key], s, d)
    return run


def _document_reads(kept, s, d):
    """The receipts whose ids are those of customers, where there are such."""
    ids = adapter.customer_ids(s, d)
    return kept.documents(ids.select(F.lit("receipts").alias("collection_name"),
                                     F.col("id").alias("document_id")))


QUERIES = {
    "stream_current_state": _state,
    "stream_levelled_state": _levelled(lambda kept, s, d: kept.state()),
    "document_reads": _levelled(_document_reads),
    "stream_notifications": _notifications,
    "stream_transitions": _transitions,
    "stream_failure_limiter": _limiter,
    "stream_category_comparison": _live,
    "stream_product_totals": _live_insights(live.product_totals),
    "stream_price_changes": _live_insights(live.price_changes),
    "stream_findings": _live_insights(live.findings),
}


def _without_tombstones(sql: str) -> str:
    return sql.replace(
        "FROM orders", "FROM (SELECT * FROM orders WHERE o_orderkey % 50 <> 3) orders").replace(
        "FROM lineitem", "FROM (SELECT * FROM lineitem WHERE l_orderkey % 50 <> 3 "
        "AND l_linenumber <> 7) lineitem")


ORACLE = {
    "stream_current_state": replication_plans.ORACLE["current_state"],
    "stream_levelled_state": replication_plans.ORACLE["current_state"],
    "document_reads": replication_plans.DOCUMENT_READS,
    "stream_notifications": views.sql(
        """SELECT 'RESYNC' AS event, collection_name, max(server_sequence) AS server_sequence,
  collection_name = 'receipts' AS "wakeExtraction" FROM changes GROUP BY collection_name""",
        views.INCOMING),
    "stream_transitions": replication_plans.ORACLE["status_transitions"],
    "stream_failure_limiter": maintenance_plans.FAILURE_LIMITER,
    "stream_category_comparison": insight_plans.ORACLE["category_comparison"].replace(
        "FROM orders", "FROM (SELECT * FROM orders WHERE o_orderkey % 50 <> 3) orders"),
    **{f"stream_{name}": _without_tombstones(insight_plans.ORACLE[name])
       for name in ("product_totals", "price_changes", "findings")},
}
