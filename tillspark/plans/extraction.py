"""Registered validation and extraction merge queries."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tillspark.functions.dates import iso_micros
from tillspark.model import SUPPORTED_LOCALES
from tillspark.operators import bridge, contract, extraction, queue, step
from tillspark.operators.replication import SHARD
from tillspark.plans import views
from tillspark.session import cut_lineage, work_dir
from tillspark.sources import adapter
from tillspark.sources.item_index import ItemIndex
from tillspark.streaming.levels import Levels

NOW = datetime(2001, 8, 15, 9, 30, 0, 250000)
STAMP = iso_micros(NOW)
LAST_SEQUENCE = 5_000_000


def _receipts(s, d):
    return adapter.receipts(s, d).withColumn("_deleted", F.col("id").cast("long") % 50 == 3)


def _items(s, d):
    return adapter.receipt_items(s, d).withColumn("_deleted", F.col("position") == 6)


def _validated(s, d, rules=contract.SERVER):
    return contract.validate_extractions(adapter.extractions(s, d), rules)


def _judged(s, d):
    return extraction.judge(contract.accepted(_validated(s, d)), _receipts(s, d), _items(s, d))


def _valid(s, d):
    e = F.col("extraction")
    return contract.accepted(_validated(s, d)).select(
        "job_id", "receipt_id", e["merchant"]["rawName"].alias("merchantRaw"),
        e["transactionDate"].alias("transactionDate"), e["currency"].alias("currency"),
        e["taxMinor"].alias("taxMinor"), e["totalMinor"].alias("totalMinor"),
        F.size(e["items"]).alias("items"))


def _rejects(rules=contract.SERVER):
    return lambda s, d: contract.rejected(_validated(s, d, rules)).select(
        "job_id", F.array_join("violations", ",").alias("violations"))


def _merged(s, d):
    merged = extraction.merged_receipts(_judged(s, d), NOW, "ollama", "vision:latest")
    return merged.select(
        "id", "status", "transactionDate", "merchantRaw", "merchantNormalized", "currency",
        "totalMinor", "categoryId", "overallConfidence", "userConfirmed",
        F.col("ai.providerId").alias("providerId"), F.col("ai.promptVersion").alias("prompt"),
        F.col("ai.schemaVersion").alias("schemaVersion"), "updatedAt", "updatedByDevice")


def _set_status(s, d):
    targets = adapter.extraction_jobs(s, d).where(F.col("status") == "pending").select(
        F.col("receipt_id").alias("id"), F.lit("queued").alias("new_status"))
    return extraction.set_status(_receipts(s, d), targets, NOW).select(
        "id", "status", "updatedAt", "updatedByDevice")


def _candidates(s, d):
    """Without jobs for the receipts that have none; some statuses set to processing."""
    key = F.col("id").cast("long")
    receipts = _receipts(s, d).withColumns({
        "status": F.when(key % 6 == 1, "processing").otherwise(F.col("status")),
        "userConfirmed": (F.col("status") == "queued") & F.col("totalMinor").isNull()})
    return extraction.backfill(receipts, adapter.extraction_jobs(s, d, gaps=True),
                               adapter.stored_images(s, d))


def _prompts(s, d):
    return adapter.extraction_jobs(s, d).select("id", extraction.receipt_prompt(
        F.col("locale"), F.col("currency")).alias("prompt"))


def _summary_rejects(s, d):
    """Generated summaries made from documents: their lines observed, their text suggested."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    summary = F.to_json(F.struct(
        F.split(text, "\n").alias("observations"),
        F.when(key % 5 != 0, text).alias("suggestion"),
        F.when(key % 11 == 0, 1).alias("more")))
    documents = s.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", summary.alias("summary"))
    return contract.rejected(contract.validate_summaries(documents)).select(
        "doc_id", F.array_join("violations", ",").alias("violations"))


def _snapshot_rejects(s, d):
    """Snapshot requests made from orders: foreign locales, fractional totals, odd lists."""
    key = F.col("o_orderkey")
    locales = F.array(*[F.lit(x) for x in (*SUPPORTED_LOCALES, "en; ignore rules")])
    snapshot = F.concat(
        F.lit('{"locale":"'), F.get(locales, (key % 6).cast("int")),
        F.lit('","period":{},"total":'), F.when(key % 7 == 0, "1.5").otherwise("1"),
        F.lit(',"previousTotal":0,"categories":[{"id":"a"}],"merchants":'),
        F.when(key % 11 == 0, "[1]").otherwise("[]"), F.lit(',"items":[],"priceChanges":[]}'))
    orders = s.read.parquet(f"{d}/orders.parquet").select(
        key.cast("string").alias("id"), snapshot.alias("snapshot"))
    return contract.rejected(contract.validate_snapshots(orders)).select(
        "id", F.array_join("violations", ",").alias("violations"))


def _log(s, d):
    """All receipts and items as log rows."""
    both = bridge.documents(_receipts(s, d), "receipts").unionByName(
        bridge.documents(_items(s, d), "receipt_items"))
    return bridge.append(both, 0, STAMP, shards=True)


def _answer(content, mime_type, prompt):
    """A model that knows only the number of its receipt, and sometimes fails."""
    number = int(content)
    if number % 11 == 0:
        raise extraction.ModelUnavailable("busy")
    if number % 7 == 0:
        return "no receipt"
    item = {"rawName": "THING", "normalizedName": "", "quantity": 1, "unitPriceMinor": number,
            "totalPriceMinor": number, "categoryId": "other", "confidence": 0.5}
    return json.dumps({
        "schemaVersion": 1, "documentType": "receipt",
        "merchant": {"rawName": "SHOP", "normalizedName": "Shop"}, "transactionDate": None,
        "currency": "EUR", "subtotalMinor": None, "taxMinor": None, "discountMinor": None,
        "totalMinor": number, "categoryId": "other", "items": [item], "confidence": 0.5,
        "warnings": []})


def _claim(s, d):
    claimed = queue.due(adapter.extraction_jobs(s, d), NOW).withColumn(
        "status", F.lit("processing"))
    return claimed, _receipts(s, d).select(F.col("imageHash").alias("hash"),
                                           F.col("id").cast("binary").alias("content"))


def _setting():
    return (_answer, NOW, "ollama", "vision:latest", LAST_SEQUENCE,
            F.concat("receipt_id", F.lit("-new-"), F.col("position").cast("string")))


def _step(s, d):
    return step.extraction_step(_log(s, d), *_claim(s, d), *_setting())


def _indexed_step(s, d):
    """The same step after the log came in two batches, on levelled state and the item index."""
    log = cut_lineage(_log(s, d).drop(SHARD), "log")
    levels = Levels(s, work_dir(s, "step-levels"), log.schema.simpleString()[7:-1].replace(
        ":", " "))
    index = ItemIndex(s, work_dir(s, "step-index"))
    for batch, odd in enumerate((0, 1)):
        levels.append(log.where(F.col("server_sequence") % 2 == odd), batch)
    middle = log.agg((F.max("server_sequence") / 2).cast("long").alias("middle")).first().middle
    for part in (log.where(F.col("server_sequence") <= middle), log):
        index.update(part)
    claimed, content = _claim(s, d)
    return step.documents_step(*step.indexed_documents(levels, index, claimed), claimed, content,
                               *_setting())


def _written(collection, *columns):
    """Columns of the documents that the step on the index appends."""
    def run(s, d):
        changes = _indexed_step(s, d)[0].where(F.col("collection_name") == collection)
        return bridge.parsed(changes, collection).selectExpr(*columns)
    return run


QUERIES = {
    "log_receipts": lambda s, d: bridge.typed(_log(s, d), "receipts").where("NOT _deleted").drop(
        "warnings", "ai", "subtotalMinor", "taxMinor", "discountMinor", "overallConfidence",
        "_deleted"),
    "log_items": lambda s, d: bridge.typed(_log(s, d), "receipt_items").where(
        "NOT _deleted").drop("confidence", "_deleted"),
    "sequence_allocation": lambda s, d: _log(s, d).select(
        "collection_name", "document_id", "server_sequence"),
    "extraction_step_jobs": lambda s, d: _step(s, d)[1].select(
        "id", "status", "attempts", "last_error_code"),
    "extraction_step_changes": lambda s, d: _step(s, d)[0].select(
        "collection_name", "document_id", "is_deleted", "server_sequence"),
    "extraction_step_receipts": _written(
        "receipts", "id", "status", "merchantRaw", "merchantNormalized", "transactionDate",
        "currency", "totalMinor", "categoryId", "imageHash", "capturedAt", "overallConfidence",
        "userConfirmed", "ai.modelId AS modelId", "updatedAt", "updatedByDevice",
        "_deleted"),
    "extraction_step_items": _written(
        "receipt_items", "id", "receiptId", "rawName", "normalizedName", "quantity",
        "unitPriceMinor", "totalPriceMinor", "categoryId", "confidence", "position",
        "userEdited", "updatedAt", "updatedByDevice", "_deleted"),
    "extraction_step_outcomes": lambda s, d: _indexed_step(s, d)[1],
    "extraction_valid": _valid,
    "extraction_rejects": _rejects(),
    "extraction_rejects_client": _rejects(contract.CLIENT),
    "extraction_apply_receipts": _merged,
    "extraction_apply_items": lambda s, d: extraction.new_items(_judged(s, d), NOW).select(
        "receiptId", "position", "rawName", "normalizedName", "quantity", "unitPriceMinor",
        "totalPriceMinor", "updatedByDevice"),
    "extraction_apply_tombstones": lambda s, d: extraction.item_tombstones(
        _judged(s, d), _items(s, d), NOW).select("id", "receiptId", "_deleted", "updatedAt"),
    "extraction_skips": lambda s, d: extraction.job_outcomes(_judged(s, d), NOW).where(
        F.col("status") == "skipped"),
    "extraction_outcomes": lambda s, d: extraction.job_outcomes(_judged(s, d), NOW).groupBy(
        "status").agg(F.count(F.lit(1)).alias("jobs")),
    "job_readiness": lambda s, d: extraction.job_readiness(
        adapter.extraction_jobs(s, d), _receipts(s, d)),
    "receipt_status_set": _set_status,
    "backfill": lambda s, d: extraction.backfill_requests(_candidates(s, d)).drop("ord"),
    "backfill_receipts": lambda s, d: extraction.backfilled_receipts(
        _candidates(s, d), NOW).select("id", "status", "userConfirmed", "updatedAt"),
    "receipt_prompts": _prompts,
    "summary_rejects": _summary_rejects,
    "snapshot_rejects": _snapshot_rejects,
}

_JUDGED = """judged AS (
  SELECT e.*, r.status = 'confirmed' OR e.okey % 50 = 3 OR edited.rid IS NOT NULL AS skip,
    r."transactionDate"
  FROM extractions e JOIN receipts r ON r.id = e.receipt_id
  LEFT JOIN (SELECT DISTINCT "receiptId" AS rid FROM items
    WHERE "userEdited" AND position <> 6) edited ON edited.rid = e.receipt_id
  WHERE violations = '')"""
_VIEWS = (views.RECEIPTS, views.ITEMS, views.EXTRACTIONS, _JUDGED)

_LINES = """lines AS (
  SELECT j.receipt_id, i.*, row_number() OVER (
    PARTITION BY j.receipt_id ORDER BY i.position, i.id) - 1 AS place
  FROM judged j JOIN items i ON i."receiptId" = j.receipt_id WHERE NOT skip)"""

_CODES = {kind: (code, int(counted)) for kind, code, _, _, counted in queue.FAILURES}
_STEP = f"""step AS (
  SELECT j.id, j.receipt_id, j.attempts,
    CASE WHEN r.status = 'confirmed' OR k % 50 = 3 THEN 'skipped'
      WHEN r."imageHash" <> j.image_hash THEN 'invalid' WHEN k % 11 = 0 THEN 'http'
      WHEN k % 7 = 0 THEN 'invalid' WHEN edited.rid IS NOT NULL THEN 'skipped'
      ELSE 'completed' END AS way
  FROM (SELECT *, CAST(receipt_id AS BIGINT) AS k FROM jobs WHERE status = 'pending'
    AND (next_attempt_at IS NULL OR next_attempt_at <= '{STAMP}')) j
  JOIN receipts r ON r.id = j.receipt_id
  LEFT JOIN (SELECT DISTINCT "receiptId" AS rid FROM items
    WHERE "userEdited" AND position <> 6) edited ON edited.rid = j.receipt_id)"""
_STEP_JOBS = f"""SELECT id, CASE WHEN way IN ('skipped', 'completed') THEN way
    WHEN tries >= 5 THEN 'failed' ELSE 'pending' END AS status, tries AS attempts, code
    AS last_error_code
FROM (SELECT *, attempts + CASE way WHEN 'invalid' THEN {_CODES["invalid"][1]}
    WHEN 'http' THEN {_CODES["http"][1]} ELSE 0 END AS tries,
    CASE way WHEN 'invalid' THEN '{_CODES["invalid"][0]}' WHEN 'http' THEN '{_CODES["http"][0]}'
      WHEN 'skipped' THEN 'user_edited' END AS code FROM step)"""
_MESSAGES = " ".join(
    f"WHEN '{code}' THEN '{message}'" for code, message in {
        **{code: message for kind, code, message, _, _ in queue.FAILURES
           if kind in ("http", "invalid")}, "user_edited": "User edits were preserved"}.items())
_STEP_CHANGES = f"""SELECT collection_name, document_id, is_deleted, {LAST_SEQUENCE}
  + row_number() OVER (ORDER BY collection_name, document_id) AS server_sequence
FROM (SELECT 'receipts' AS collection_name, receipt_id AS document_id, FALSE AS is_deleted
  FROM step WHERE way = 'completed'
  UNION ALL SELECT 'receipt_items', i.id, TRUE FROM items i JOIN step s
    ON s.receipt_id = i."receiptId" AND s.way = 'completed' WHERE i.position <> 6
  UNION ALL SELECT 'receipt_items', receipt_id || '-new-0', FALSE FROM step
  WHERE way = 'completed')"""

_CANDIDATES = """candidates AS (
  SELECT r.id, r."imageHash", r.currency, CAST(r.id AS BIGINT) AS okey,
    CAST(r.id AS BIGINT) % 6 = 1 OR (r.status = 'queued' AND r."totalMinor" IS NULL
      AND r."merchantNormalized" IS NULL) AS reset
  FROM receipts r
  WHERE CAST(r.id AS BIGINT) % 50 <> 3 AND (r.status = 'queued' OR CAST(r.id AS BIGINT) % 6 = 1)
    AND r.id NOT IN (SELECT receipt_id FROM jobs)
    AND r."imageHash" IN (SELECT id FROM images))"""

_PROMPT = extraction.RECEIPT_PROMPT.replace("'", "''").replace("{locale}", "en-GB").replace(
    "{currency}", "EUR")

ORACLE = {
    "log_receipts": views.sql(
        "SELECT * FROM receipts WHERE CAST(id AS BIGINT) % 50 <> 3", views.RECEIPTS),
    "log_items": views.sql("SELECT * FROM items WHERE position <> 6", views.ITEMS),
    "sequence_allocation": views.sql(
        """SELECT collection_name, document_id,
  row_number() OVER (ORDER BY collection_name, document_id) AS server_sequence
FROM (SELECT 'receipts' AS collection_name, id AS document_id FROM receipts
  UNION ALL SELECT 'receipt_items', id FROM items)""", views.RECEIPTS, views.ITEMS),
    "extraction_step_jobs": views.sql(
        _STEP_JOBS, views.JOBS, views.RECEIPTS, views.ITEMS, _STEP),
    "extraction_step_changes": views.sql(
        _STEP_CHANGES, views.JOBS, views.RECEIPTS, views.ITEMS, _STEP),
    "extraction_step_receipts": views.sql(
        f"""SELECT r.id, 'needs_review' AS status, 'SHOP' AS "merchantRaw",
  'Shop' AS "merchantNormalized", "transactionDate", 'EUR' AS currency,
  CAST(r.id AS BIGINT) AS "totalMinor", 'other' AS "categoryId", "imageHash", "capturedAt",
  0.5e0 AS "overallConfidence", "userConfirmed", 'vision:latest' AS "modelId",
  '{STAMP}' AS "updatedAt", 'extraction-worker' AS "updatedByDevice", FALSE AS _deleted
FROM receipts r JOIN step s ON s.receipt_id = r.id WHERE way = 'completed'""",
        views.JOBS, views.RECEIPTS, views.ITEMS, _STEP),
    "extraction_step_items": views.sql(
        f"""SELECT i.id, i."receiptId", "rawName", "normalizedName", quantity, "unitPriceMinor",
  "totalPriceMinor", "categoryId", CAST(NULL AS DOUBLE) AS confidence, position, "userEdited",
  '{STAMP}' AS "updatedAt", 'extraction-worker' AS "updatedByDevice", TRUE AS _deleted
FROM items i JOIN step s ON s.receipt_id = i."receiptId" AND way = 'completed'
WHERE position <> 6
UNION ALL SELECT receipt_id || '-new-0', receipt_id, 'THING', 'THING', 1,
  CAST(receipt_id AS BIGINT), CAST(receipt_id AS BIGINT), 'other', 0.5e0, 0, FALSE, '{STAMP}',
  'extraction-worker', FALSE FROM step WHERE way = 'completed'""",
        views.JOBS, views.RECEIPTS, views.ITEMS, _STEP),
    "extraction_step_outcomes": views.sql(
        f"""SELECT o.id, j.receipt_id, image_hash, provider_id, locale, currency, o.status,
  o.attempts, CASE WHEN o.status = 'pending' THEN '2001-08-15T09:30:30.250000Z' END
    AS next_attempt_at, o.last_error_code,
  CASE o.last_error_code {_MESSAGES} END AS last_error_message, created_at,
  '{STAMP}' AS updated_at
FROM ({_STEP_JOBS}) o JOIN jobs j ON j.id = o.id""",
        views.JOBS, views.RECEIPTS, views.ITEMS, _STEP),
    "extraction_valid": views.sql(
        """SELECT job_id, receipt_id, merchant_raw AS "merchantRaw",
  tx_date AS "transactionDate", 'EUR' AS currency, CAST(0 AS BIGINT) AS "taxMinor",
  total AS "totalMinor", CAST(lines AS INTEGER) AS items
FROM extractions WHERE violations = ''""", views.EXTRACTIONS),
    "extraction_rejects": views.sql(
        "SELECT job_id, violations FROM extractions WHERE violations <> ''", views.EXTRACTIONS),
    "extraction_rejects_client": views.sql(
        """SELECT job_id, client_violations AS violations FROM extractions
WHERE client_violations <> ''""", views.EXTRACTIONS),
    "extraction_apply_receipts": views.sql(
        f"""SELECT receipt_id AS id, 'needs_review' AS status,
  coalesce(tx_date, "transactionDate") AS "transactionDate", merchant_raw AS "merchantRaw",
  merchant_normalized AS "merchantNormalized", 'EUR' AS currency, total AS "totalMinor",
  'food_grocery' AS "categoryId", 0.75e0 AS "overallConfidence", FALSE AS "userConfirmed",
  'ollama' AS "providerId", 'receipt-v1' AS prompt, 1 AS "schemaVersion",
  '{STAMP}' AS "updatedAt", 'extraction-worker' AS "updatedByDevice"
FROM judged WHERE NOT skip""", *_VIEWS),
    "extraction_apply_items": views.sql(
        """SELECT receipt_id AS "receiptId", CAST(place AS INTEGER) AS position, "rawName",
  coalesce(nullif("normalizedName", ''), "rawName") AS "normalizedName", quantity,
  "unitPriceMinor", "totalPriceMinor", 'extraction-worker' AS "updatedByDevice" FROM lines""",
        *_VIEWS, _LINES),
    "extraction_apply_tombstones": views.sql(
        f"""SELECT id, "receiptId", TRUE AS _deleted, '{STAMP}' AS "updatedAt" FROM items
WHERE position <> 6 AND "receiptId" IN (SELECT receipt_id FROM judged WHERE NOT skip)""",
        *_VIEWS),
    "extraction_skips": views.sql(
        f"""SELECT job_id AS id, receipt_id, 'skipped' AS status,
  CAST(NULL AS VARCHAR) AS next_attempt_at, 'user_edited' AS last_error_code,
  'User edits were preserved' AS last_error_message, '{STAMP}' AS updated_at
FROM judged WHERE skip""", *_VIEWS),
    "extraction_outcomes": views.sql(
        """SELECT CASE WHEN skip THEN 'skipped' ELSE 'completed' END AS status,
  count(*) AS jobs FROM judged GROUP BY 1""", *_VIEWS),
    "job_readiness": views.sql(
        """SELECT j.id AS job_id, j.receipt_id,
  CASE WHEN r.status = 'confirmed' OR CAST(r.id AS BIGINT) % 50 = 3 THEN 'skipped'
    WHEN r."imageHash" <> j.image_hash THEN 'invalid' ELSE 'ready' END AS readiness
FROM jobs j JOIN receipts r ON r.id = j.receipt_id""", views.JOBS, views.RECEIPTS),
    "receipt_status_set": views.sql(
        f"""SELECT r.id, 'queued' AS status, '{STAMP}' AS "updatedAt",
  'extraction-worker' AS "updatedByDevice"
FROM receipts r JOIN jobs j ON j.receipt_id = r.id
WHERE j.status = 'pending' AND r.status <> 'confirmed' AND CAST(r.id AS BIGINT) % 50 <> 3""",
        views.JOBS, views.RECEIPTS),
    "backfill": views.sql(
        """SELECT id AS receipt_id, "imageHash" AS image_hash, 'en-GB' AS locale, currency
FROM candidates""", views.RECEIPTS, views.SOME_JOBS, views.SOME_IMAGES, _CANDIDATES),
    "backfill_receipts": views.sql(
        f"""SELECT id, 'queued' AS status, FALSE AS "userConfirmed", '{STAMP}' AS "updatedAt"
FROM candidates WHERE reset""", views.RECEIPTS, views.SOME_JOBS, views.SOME_IMAGES, _CANDIDATES),
    "summary_rejects": """SELECT doc_id, violations FROM (SELECT doc_id, concat_ws(',',
  CASE WHEN doc_id % 11 = 0 THEN 'extra_key' END,
  CASE WHEN len(string_split(coalesce(text, ''), chr(10))) > 3 THEN 'observations' END,
  CASE WHEN length(text) > 500 AND doc_id % 5 <> 0 THEN 'suggestion' END) AS violations
FROM documents) WHERE violations <> ''""",
    "snapshot_rejects": """SELECT CAST(o_orderkey AS VARCHAR) AS id, violations
FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 6 = 5 THEN 'locale' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'total' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'merchants' END) AS violations FROM orders)
WHERE violations <> ''""",
    "receipt_prompts": views.sql(f"SELECT id, '{_PROMPT}' AS prompt FROM jobs", views.JOBS),
}
