"""Registered maintenance, text and snapshot queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tillspark.functions import language, money
from tillspark.functions.dates import display_date
from tillspark.operators import limiter, maintenance
from tillspark.plans import views
from tillspark.session import cut_lineage, work_dir
from tillspark.sources import adapter, snapshot
from tillspark.sources.increments import Snapshots

NOW = datetime(2001, 8, 15, 9, 30, 0, 250000)
STAMP = "2001-08-15T09:30:00.250Z"
DEVICE = "dev-9"
LIMIT, SECONDS = 2, 3 * 86400


def _key(column="id"):
    return F.col(column).cast("long")


def _new_receipts(s, d):
    requests = s.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("c-"), "c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 == 0, "CHF").alias("currency"))
    made = maintenance.new_receipts(requests, NOW, DEVICE, receipt_id=F.col("id"))
    return made.select("id", "status", "capturedAt", "transactionDate", "currency",
                       "totalMinor", "categoryId", F.size("warnings").alias("warnings"),
                       "userConfirmed", F.col("ai.providerId").alias("providerId"),
                       "updatedAt", "updatedByDevice")


def _captures(s, d):
    return adapter.images(s, d).select(
        F.concat(F.lit("cap-"), F.left("id", F.lit(40))).alias("id"), F.lit("EUR").alias("currency"),
        F.col("id").alias("imageHash"), "mimeType", "width", "height", "sizeBytes",
        (F.col("sizeBytes") % 10 != 0).alias("stored"))


def _captured(part):
    def run(s, d):
        frame = maintenance.captured(_captures(s, d), NOW, DEVICE)[part]
        if part == 0:
            return frame.select("id", "status", "imageHash",
                                F.array_join("warnings", ",").alias("warnings"), "updatedAt")
        if part == 1:
            return frame.select("id", "receiptId", "width", "sizeBytes", "remoteStatus")
        return frame.select("type", "receiptId", "status", "attempts", "createdAt")
    return run


def _amount_texts(s, d):
    """Form texts made from order totals: plain amounts, blanks, exponents and rubbish."""
    key = F.col("o_orderkey")
    minor = F.round(F.col("o_totalprice") * 100).cast("long")
    amount = (
        F.when(key % 5 == 0, "").when(key % 7 == 0, "abc").when(key % 11 == 0, " 12.5 ")
        .when(key % 13 == 0, "1e3").when(key % 17 == 0, "NaN").when(key % 19 == 0, "Infinity")
        .when(key % 23 == 0, F.lit(None)).when(key % 29 == 0, "  ").when(key % 31 == 0, "-.5")
        .otherwise(money.to_euro(minor)))
    return s.read.parquet(f"{d}/orders.parquet").select(key.cast("string").alias("id"),
                                                        amount.alias("total"))


def _edit(s, d):
    forms = _amount_texts(s, d).where(_key() % 4 == 1).select(
        "id", "total", F.when(_key() % 3 == 0, "").otherwise(F.concat(F.lit("Shop "), "id"))
        .alias("merchant"), F.lit("2001-08-01").alias("transactionDate"),
        F.when(_key() % 5 == 1, "").otherwise("chf").alias("currency"),
        F.lit("").alias("categoryId"))
    updated = maintenance.update_receipts(
        adapter.receipts(s, d), maintenance.edit_form(forms), NOW, DEVICE)
    return updated.select("id", "status", "transactionDate", "merchantNormalized", "merchantRaw",
                          "totalMinor", "currency", "categoryId", "userConfirmed", "updatedAt",
                          "updatedByDevice")


def _patch(s, d):
    """Only the merchant given, no confirmation."""
    changes = adapter.receipts(s, d).where(_key() % 6 == 0).select(
        "id", F.lit(False).alias("confirmed"),
        F.array(F.lit("merchantNormalized")).alias("present"),
        F.struct(F.lit("Mercato").alias("merchantNormalized"),
                 F.lit(None).cast("long").alias("totalMinor")).alias("new"))
    return maintenance.update_receipts(adapter.receipts(s, d), changes, NOW, DEVICE).select(
        "id", "status", "merchantNormalized", "totalMinor", "userConfirmed", "updatedAt")


def _replaced(s, d):
    item = F.struct(F.lit("Pane").alias("rawName"), F.lit("").alias("normalizedName"),
                    F.lit(1290).cast("long").alias("totalPriceMinor"))
    other = F.struct(F.lit(None).cast("string").alias("rawName"),
                     F.lit("Latte").alias("normalizedName"),
                     F.lit(None).cast("long").alias("totalPriceMinor"))
    edits = adapter.receipts(s, d).where(_key() % 3 == 0).select(
        F.col("id").alias("receiptId"), F.lit(True).alias("userEdited"),
        F.when(_key() % 2 == 0, F.array(item, other)).otherwise(F.array(item)).alias("items"))
    return maintenance.replace_items(adapter.receipt_items(s, d), edits, NOW, DEVICE).select(
        "receiptId", "position", "rawName", "normalizedName", "totalPriceMinor", "categoryId",
        "userEdited", "updatedByDevice")


def _cascade(s, d):
    receipts = adapter.receipts(s, d)
    return maintenance.cascade_delete(
        receipts.where(_key() % 7 == 0).select("id"), receipts, adapter.receipt_items(s, d),
        adapter.images(s, d), adapter.client_jobs(s, d))


def _kept_images(s, d):
    images = adapter.images(s, d)
    return maintenance.apply_cascade(images, "images", _cascade(s, d)).select("id", "receiptId")


def _invalidated(s, d):
    migrated = maintenance.migrate(adapter.settings(s, d), "settings", 1)
    old = language.resolve_language(F.col("locale"), F.array(F.lit("fr-CA")))
    changed = maintenance.change_language(migrated, F.lit("it"), old, F.lit("it"),
                                          language.locale_for(F.lit("it")))
    return changed.select("id", "locale", "languagePreference", "aiSummary")


def _languages(s, d):
    settings = adapter.settings(s, d)
    tags = F.array(F.lit("pt-BR"), F.col("locale"), F.lit("de-DE"))
    return settings.select(
        "id", language.normalize_language(F.col("locale")).alias("normalized"),
        language.detect_language(tags).alias("detected"),
        language.resolve_language(F.col("locale"), F.array(F.lit("fr-CA"))).alias("resolved"),
        language.locale_for(F.col("locale")).alias("formatting"))


def _money_texts(s, d):
    receipts = adapter.receipts(s, d)
    change = (F.col("totalMinor") - 20000000) / 1000000
    return receipts.select(
        "id", money.to_euro(F.col("totalMinor")).alias("euro"),
        money.signed_money(F.col("totalMinor") - 20000000).alias("signed"),
        money.signed_percent(change).alias("percent"),
        display_date(F.col("transactionDate"), F.lit("Date to review")).alias("day"))


def _summaries(s, d):
    """Summaries whose observations are the lines of a document and whose suggestion is its text,
    stored and read back."""
    documents = s.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", F.split("text", "\n").alias("observations"), F.col("text").alias("suggestion"))
    stored = maintenance.stored_summary(documents, F.sha2("suggestion", 256), NOW).select(
        "doc_id", F.from_json("aiSummary", "observations array<string>, suggestion string, "
                              "datasetHash string, generatedAt string").alias("value"))
    value = F.col("value")
    return stored.select(
        "doc_id", F.size(value["observations"]).alias("observations"),
        F.sha2(F.array_join(value["observations"], "\n"), 256).alias("observed"),
        F.sha2(value["suggestion"], 256).alias("suggested"),
        value["datasetHash"].alias("datasetHash"), value["generatedAt"].alias("generatedAt"))


def _tables(s, d):
    return {"receipts": adapter.receipts(s, d), "receipt_items": adapter.receipt_items(s, d)}


def _verified(s, d):
    return snapshot.backup(_tables(s, d), work_dir(s, "backup"))


def _exported(s, d):
    """Rows of the exported parts, read back from the JSON."""
    path = work_dir(s, "export")
    snapshot.export({"receipts": adapter.receipts(s, d), "items": adapter.receipt_items(s, d),
                     "images": adapter.images(s, d)}, path, STAMP, include_images=True)
    parts = [s.read.schema("id string").json(f"{path}/{name}").select(
        F.lit(name).alias("part"), "id") for name in ("receipts", "items", "images")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _kept_tables(s, d):
    """The same tables as stored ones: snapshots read them several times."""
    return {name: cut_lineage(df, name) for name, df in _tables(s, d).items()}


def _earlier(tables):
    """The tables before their last edits: other totals of one category, no seventh items."""
    total = F.when(F.col("categoryId") == "BUILDING", 777).otherwise(F.col("totalMinor"))
    return {"receipts": tables["receipts"].withColumn("totalMinor", total.cast("long")),
            "receipt_items": tables["receipt_items"].where(F.col("position") != 6)}


def _incremental(s, d):
    """A backup of the earlier tables, then one that rewrites the buckets that changed."""
    kept, tables = Snapshots(s, work_dir(s, "snapshots")), _kept_tables(s, d)
    kept.backup(_earlier(tables))
    kept.backup(tables)
    return kept.verify()


def _restored(table, *columns):
    """The earlier tables are live; a restore brings the snapshot's rows back."""
    def run(s, d):
        kept, live = (Snapshots(s, work_dir(s, name)) for name in ("snapshots", "live"))
        tables = _kept_tables(s, d)
        kept.backup(tables)
        live.backup(_earlier(tables))
        kept.restore(live)
        return live.read(table).select(*columns)
    return run


_NO_VALUES = ("subtotalMinor", "taxMinor", "discountMinor", "overallConfidence")
_RECEIPT = ("id", "status", "capturedAt", "transactionDate", "merchantRaw", "merchantNormalized",
            "currency", "totalMinor", "categoryId", "imageHash", "userConfirmed", "updatedAt",
            "updatedByDevice")
_ITEM = ("id", "receiptId", "rawName", "normalizedName", "quantity", "unitPriceMinor",
         "totalPriceMinor", "categoryId", "position", "userEdited", "updatedAt", "updatedByDevice")


def _export_of(part):
    """One part of the export read back with all its columns and bytes."""
    def run(s, d):
        path = work_dir(s, "export")
        images = adapter.images(s, d).withColumn("full", F.encode("id", "UTF-8"))
        tables = {"receipts": adapter.receipts(s, d), "items": adapter.receipt_items(s, d),
                  "images": images}
        snapshot.export(tables, path, STAMP, include_images=True)
        schema = tables[part].schema
        if part == "images":
            schema = images.withColumn("full", F.col("full").cast("string")).schema
        back = s.read.schema(schema).json(f"{path}/{part}")
        if part == "receipts":
            return back.select(*_RECEIPT, *_NO_VALUES, F.size("warnings").alias("warnings"),
                               F.col("ai.providerId").alias("providerId"))
        return back
    return run


QUERIES = {
    "snapshot_incremental": _incremental,
    "snapshot_restore": _restored("receipts", *_RECEIPT),
    "snapshot_restore_items": _restored("receipt_items", *_ITEM),
    "export_receipts": _export_of("receipts"),
    "export_items": _export_of("items"),
    "export_images": _export_of("images"),
    "new_receipts": _new_receipts,
    "captured_receipts": _captured(0),
    "captured_images": _captured(1),
    "captured_jobs": _captured(2),
    "edit_receipts": _edit,
    "patch_receipts": _patch,
    "replace_items": _replaced,
    "cascade_delete": _cascade,
    "cascade_kept_images": _kept_images,
    "migrate_settings": lambda s, d: maintenance.migrate(
        adapter.settings(s, d), "settings", 1),
    "migrate_jobs": lambda s, d: maintenance.migrate(
        adapter.client_jobs(s, d), "jobs", 1).select("id", "type", "status"),
    "default_settings": lambda s, d: maintenance.default_settings(
        s, maintenance.migrate(adapter.settings(s, d), "settings", 1)),
    "summary_invalidate": _invalidated,
    "stored_summaries": _summaries,
    "to_minor": lambda s, d: _amount_texts(s, d).select(
        "id", money.to_minor(F.col("total")).alias("minor")),
    "money_texts": _money_texts,
    "language_resolution": _languages,
    "snapshot_export": _exported,
    "snapshot_verify": _verified,
    "failure_limiter": lambda s, d: limiter.limit_failures(
        adapter.attempts(s, d), LIMIT, SECONDS, 900),
}

_STORED = "\"sizeBytes\" % 10 <> 0"

_TEXTS = """texts AS (
  SELECT o_orderkey AS okey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'abc'
    WHEN o_orderkey % 11 = 0 THEN ' 12.5 ' WHEN o_orderkey % 13 = 0 THEN '1e3'
    WHEN o_orderkey % 17 = 0 THEN 'NaN' WHEN o_orderkey % 19 = 0 THEN 'Infinity'
    WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '  '
    WHEN o_orderkey % 31 = 0 THEN '-.5'
    ELSE printf('%d.%02d', CAST(round(o_totalprice * 100) AS BIGINT) // 100,
      CAST(round(o_totalprice * 100) AS BIGINT) % 100) END AS total
  FROM orders),
minors AS (
  SELECT okey, CAST(okey AS VARCHAR) AS id, CASE WHEN total IN ('', 'abc', 'NaN', 'Infinity')
      THEN NULL WHEN trim(total) = '' THEN 0
      ELSE CAST(floor(CAST(trim(total) AS DOUBLE) * 100 + 0.5e0) AS BIGINT) END AS minor
  FROM texts)"""

_REMOVED = """removed AS (
  SELECT 'receipt_items' AS collection, id AS "documentId" FROM items
    WHERE CAST("receiptId" AS BIGINT) % 7 = 0
  UNION ALL SELECT 'images', min(id) FROM images
    WHERE CAST("receiptId" AS BIGINT) % 7 = 0
      AND "receiptId" IN (SELECT id FROM receipts) GROUP BY "receiptId"
  UNION ALL SELECT 'jobs', id FROM client_jobs WHERE CAST("receiptId" AS BIGINT) % 7 = 0
  UNION ALL SELECT 'receipts', id FROM receipts WHERE CAST(id AS BIGINT) % 7 = 0)"""

_MIGRATED = """migrated AS (SELECT * EXCLUDE ("syncEnabled", "syncToken"),
  'auto' AS "languagePreference", 'auto' AS "themePreference" FROM settings)"""

_NORMAL = """CASE WHEN first IN ('en', 'it', 'de', 'es', 'fr') THEN first END AS normalized
  FROM (SELECT *, split_part(lower(replace(trim(locale), '_', '-')), '-', 1) AS first
    FROM settings)"""

_WALK = f"""steps AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS rn FROM attempts),
walk AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS ord,
    CAST([] AS BIGINT[]) AS kept, CAST(NULL AS VARCHAR) AS decision,
    CAST(NULL AS BIGINT) AS wait_seconds FROM attempts
  UNION ALL
  SELECT key, rn, ord,
    CASE WHEN len(live) >= {LIMIT} THEN live WHEN failed THEN list_append(live, at_micros)
      ELSE CAST([] AS BIGINT[]) END,
    CASE WHEN len(live) >= {LIMIT} THEN 'blocked' WHEN failed THEN 'failed' ELSE 'allowed' END,
    CASE WHEN len(live) >= {LIMIT} THEN greatest(1, CAST(ceil(
      ({SECONDS}000000 - (at_micros - live[1])) / 1000000e0) AS BIGINT)) END
  FROM (SELECT s.key, s.rn, s.ord, s.at_micros, s.failed,
      list_filter(w.kept, lambda x: x > s.at_micros - {SECONDS}000000) AS live
    FROM walk w JOIN steps s ON s.key = w.key AND s.rn = w.rn + 1))"""

FAILURE_LIMITER = views.sql(
    "SELECT key, ord, decision, wait_seconds FROM walk WHERE rn > 0",
    views.ATTEMPTS, _WALK).replace("WITH ", "WITH RECURSIVE ", 1)

def _names(columns):
    return ", ".join(f'"{c}"' for c in columns)


_VERIFIED = """SELECT 'receipts' AS "table", count(*) AS rows, TRUE AS matches FROM orders
UNION ALL SELECT 'receipt_items', count(*), TRUE FROM lineitem"""

ORACLE = {
    "snapshot_incremental": _VERIFIED,
    "snapshot_restore": views.sql(f"SELECT {_names(_RECEIPT)} FROM receipts", views.RECEIPTS),
    "snapshot_restore_items": views.sql(f"SELECT {_names(_ITEM)} FROM items", views.ITEMS),
    "export_receipts": views.sql(
        f"""SELECT {_names(_RECEIPT)}, CAST(NULL AS BIGINT) AS "subtotalMinor",
  CAST(NULL AS BIGINT) AS "taxMinor", CAST(NULL AS BIGINT) AS "discountMinor",
  CAST(NULL AS DOUBLE) AS "overallConfidence", 0 AS warnings, CAST(NULL AS VARCHAR) AS "providerId"
FROM receipts""", views.RECEIPTS),
    "export_items": views.sql(
        f"""SELECT {_names(_ITEM)}, CAST(NULL AS DOUBLE) AS confidence FROM items""", views.ITEMS),
    "export_images": views.sql(
        """SELECT *, 'data:image/jpeg;base64,' || base64(encode(id)) AS "full" FROM images""",
        views.IMAGES),
    "new_receipts": f"""SELECT 'c-' || c_custkey AS id, 'manual' AS status,
  '{STAMP}' AS "capturedAt", '2001-08-15' AS "transactionDate",
  CASE WHEN c_custkey % 3 = 0 THEN 'CHF' ELSE 'EUR' END AS currency,
  CAST(NULL AS BIGINT) AS "totalMinor", 'other' AS "categoryId", 0 AS warnings,
  FALSE AS "userConfirmed", CAST(NULL AS VARCHAR) AS "providerId", '{STAMP}' AS "updatedAt",
  '{DEVICE}' AS "updatedByDevice" FROM customer""",
    "captured_receipts": views.sql(
        f"""SELECT 'cap-' || left(id, 40) AS id,
  CASE WHEN {_STORED} THEN 'queued' ELSE 'failed' END AS status, id AS "imageHash",
  CASE WHEN {_STORED} THEN '' ELSE 'Salvataggio immagine incompleto' END AS warnings,
  '{STAMP}' AS "updatedAt" FROM images""", views.IMAGES),
    "captured_images": views.sql(
        f"""SELECT id, 'cap-' || left(id, 40) AS "receiptId", width, "sizeBytes",
  'pending' AS "remoteStatus" FROM images WHERE {_STORED}""", views.IMAGES),
    "captured_jobs": views.sql(
        f"""SELECT 'image-upload' AS type, 'cap-' || left(id, 40) AS "receiptId",
  'pending' AS status, 0 AS attempts, '{STAMP}' AS "createdAt"
FROM images WHERE {_STORED}""", views.IMAGES),
    "edit_receipts": views.sql(
        f"""SELECT m.id, 'confirmed' AS status, '2001-08-01' AS "transactionDate",
  CASE WHEN okey % 3 <> 0 THEN 'Shop ' || m.id END AS "merchantNormalized",
  CASE WHEN okey % 3 <> 0 THEN 'Shop ' || m.id END AS "merchantRaw", minor AS "totalMinor",
  CASE WHEN okey % 5 = 1 THEN 'EUR' ELSE 'CHF' END AS currency, 'other' AS "categoryId",
  TRUE AS "userConfirmed", '{STAMP}' AS "updatedAt", '{DEVICE}' AS "updatedByDevice"
FROM minors m WHERE okey % 4 = 1""", _TEXTS),
    "patch_receipts": views.sql(
        f"""SELECT id, status, 'Mercato' AS "merchantNormalized", "totalMinor", "userConfirmed",
  '{STAMP}' AS "updatedAt" FROM receipts WHERE CAST(id AS BIGINT) % 6 = 0""", views.RECEIPTS),
    "replace_items": views.sql(
        f"""SELECT "receiptId", position, "rawName", "normalizedName", "totalPriceMinor",
  "categoryId", "userEdited", "updatedByDevice" FROM items
WHERE CAST("receiptId" AS BIGINT) % 3 <> 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, 'Pane', 'Pane', 1290, 'other', TRUE, '{DEVICE}'
FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, '', 'Latte', NULL, 'other', TRUE, '{DEVICE}'
FROM orders WHERE o_orderkey % 6 = 0""", views.ITEMS),
    "cascade_delete": views.sql("SELECT * FROM removed", views.RECEIPTS, views.ITEMS,
                                views.IMAGES, views.CLIENT_JOBS, _REMOVED),
    "cascade_kept_images": views.sql(
        """SELECT id, "receiptId" FROM images
WHERE id NOT IN (SELECT "documentId" FROM removed WHERE collection = 'images')""",
        views.RECEIPTS, views.ITEMS, views.IMAGES, views.CLIENT_JOBS, _REMOVED),
    "migrate_settings": views.sql("SELECT * FROM migrated", views.SETTINGS, _MIGRATED),
    "migrate_jobs": views.sql(
        "SELECT id, type, status FROM client_jobs WHERE type <> 'ai-extraction'",
        views.CLIENT_JOBS),
    "default_settings": views.sql(
        """SELECT * FROM migrated
UNION ALL BY NAME SELECT 'singleton' AS id, 'en-GB' AS locale, 'auto' AS "languagePreference",
  'auto' AS "themePreference", 'EUR' AS "defaultCurrency", 20e0 AS "insightMinimumPercent",
  CAST(1000 AS BIGINT) AS "insightMinimumMinor\"""", views.SETTINGS, _MIGRATED),
    "summary_invalidate": views.sql(
        f"""SELECT id, 'it-IT' AS locale, 'it' AS "languagePreference",
  CASE WHEN normalized = 'it' THEN "aiSummary" END AS "aiSummary"
FROM (SELECT *, {_NORMAL})""", views.SETTINGS),
    "stored_summaries": f"""SELECT doc_id,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS observations, sha256(text) AS observed,
  sha256(text) AS suggested, sha256(text) AS "datasetHash", '{STAMP}' AS "generatedAt"
FROM documents""",
    "to_minor": views.sql("SELECT id, minor FROM minors", _TEXTS),
    "money_texts": views.sql(
        """SELECT id, coalesce(printf('%d.%02d', "totalMinor" // 100, "totalMinor" % 100), '')
    AS euro,
  CASE WHEN diff > 0 THEN '+' WHEN diff < 0 THEN '-' ELSE '' END
    || printf('%d.%02d EUR', abs(coalesce(diff, 0)) // 100, abs(coalesce(diff, 0)) % 100)
    AS signed,
  coalesce(CASE WHEN diff > 0 THEN '+' WHEN diff < 0 THEN '-' ELSE '' END
    || CASE WHEN tenths % 10 = 0 THEN CAST(tenths // 10 AS VARCHAR)
      ELSE (tenths // 10) || '.' || (tenths % 10) END || '%', '—') AS percent,
  CASE WHEN "transactionDate" IS NULL THEN 'Date to review'
    ELSE strftime(CAST("transactionDate" AS DATE), '%d %b %Y') END AS day
FROM (SELECT *, "totalMinor" - 20000000 AS diff,
    CAST(floor(abs(("totalMinor" - 20000000) / 1000000e0) * 10 + 0.5e0) AS BIGINT) AS tenths
  FROM receipts)""", views.RECEIPTS),
    "language_resolution": views.sql(
        f"""SELECT id, normalized, coalesce(normalized, 'de') AS detected,
  CASE WHEN locale IN ('', 'auto') THEN 'fr' ELSE coalesce(normalized, 'en') END AS resolved,
  CASE coalesce(normalized, 'en') WHEN 'en' THEN 'en-GB' WHEN 'it' THEN 'it-IT'
    WHEN 'de' THEN 'de-DE' WHEN 'es' THEN 'es-ES' ELSE 'fr-FR' END AS formatting
FROM (SELECT *, {_NORMAL})""", views.SETTINGS),
    "snapshot_export": views.sql(
        """SELECT 'receipts' AS part, id FROM receipts
UNION ALL SELECT 'items', id FROM items UNION ALL SELECT 'images', id FROM images""",
        views.RECEIPTS, views.ITEMS, views.IMAGES),
    "snapshot_verify": _VERIFIED,
    "failure_limiter": FAILURE_LIMITER,
}
