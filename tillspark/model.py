"""Declared schemas, enumerations and limits of the receipt tables.

Readers always get one of these schemas; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(required: bool, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, not required) for n, t in fields.items()])


_S, _L, _D, _B, _I = (T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(),
                      T.IntegerType())

PROVENANCE = _struct(False, providerId=_S, modelId=_S, promptVersion=_S, schemaVersion=_I)

RECEIPTS = _struct(
    False, id=_S, status=_S, capturedAt=_S, transactionDate=_S, merchantRaw=_S,
    merchantNormalized=_S, currency=_S, subtotalMinor=_L, taxMinor=_L, discountMinor=_L,
    totalMinor=_L, categoryId=_S, imageHash=_S, overallConfidence=_D,
    warnings=T.ArrayType(_S), userConfirmed=_B, ai=PROVENANCE, updatedAt=_S,
    updatedByDevice=_S,
)

RECEIPT_ITEMS = _struct(
    False, id=_S, receiptId=_S, rawName=_S, normalizedName=_S, quantity=_D,
    unitPriceMinor=_L, totalPriceMinor=_L, categoryId=_S, confidence=_D, position=_I,
    userEdited=_B, updatedAt=_S, updatedByDevice=_S,
)

IMAGES = _struct(
    False, id=_S, receiptId=_S, mimeType=_S, width=_I, height=_I, sizeBytes=_L,
    remoteStatus=_S, remoteFileId=_S, createdAt=_S,
)

CLIENT_JOBS = _struct(
    False, id=_S, type=_S, receiptId=_S, status=_S, attempts=_I, nextAttemptAt=_S,
    lastErrorCode=_S, lastErrorMessage=_S, createdAt=_S, updatedAt=_S,
)

SETTINGS = _struct(
    False, id=_S, locale=_S, languagePreference=_S, themePreference=_S, defaultCurrency=_S,
    selectedAiProvider=_S, insightMinimumPercent=_D, insightMinimumMinor=_L, aiSummary=_S,
)

AUDIT_EVENTS = _struct(
    False, id=_S, type=_S, collection=_S, documentId=_S, resolvedAt=_S, winnerDevice=_S,
)

CHANGES = _struct(
    False, owner_id=_S, collection_name=_S, document_id=_S, document_json=_S,
    server_sequence=_L, is_deleted=_B, created_at=_S, updated_at=_S,
)

EXTRACTION_JOBS = _struct(
    False, id=_S, receipt_id=_S, image_hash=_S, provider_id=_S, locale=_S, currency=_S,
    status=_S, attempts=_I, next_attempt_at=_S, last_error_code=_S, last_error_message=_S,
    created_at=_S, updated_at=_S,
)

EXTRACTED_ITEM = _struct(
    False, rawName=_S, normalizedName=_S, quantity=_D, unitPriceMinor=_L,
    totalPriceMinor=_L, categoryId=_S, confidence=_D,
)

EXTRACTION = _struct(
    False, schemaVersion=_I, documentType=_S,
    merchant=_struct(False, rawName=_S, normalizedName=_S),
    transactionDate=_S, currency=_S, subtotalMinor=_L, taxMinor=_L, discountMinor=_L,
    totalMinor=_L, categoryId=_S, items=T.ArrayType(EXTRACTED_ITEM), confidence=_D,
    warnings=T.ArrayType(_S),
)

# Enumerations and limits of the data model.
RECEIPT_STATUSES = ("captured", "queued", "processing", "needs_review", "confirmed",
                    "failed", "manual")
IMAGE_STATUSES = ("pending", "uploading", "uploaded", "failed", "remote")
CLIENT_JOB_TYPES = ("image-upload", "image-download", "ai-insight")
CLIENT_JOB_STATUSES = ("pending", "processing", "completed", "failed")
SERVER_JOB_STATUSES = ("pending", "processing", "completed", "failed", "skipped")
REPLICATED_COLLECTIONS = ("receipts", "receipt_items")
OWNER_ID = "single-user"
UNKNOWN_MERCHANT = "__unknown_merchant__"
SUPPORTED_LOCALES = ("en-GB", "it-IT", "de-DE", "es-ES", "fr-FR")
PULL_BATCH_DEFAULT, PULL_BATCH_MAX = 100, 500
MAX_ATTEMPTS = 5
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
FULL_SIDE, THUMBNAIL_SIDE = 2200, 320
EXTRACTED_ITEMS_MAX, WARNINGS_MAX, NAME_MAX, CATEGORY_MAX = 250, 30, 300, 80
ERROR_MESSAGE_MAX = 300
PROMPT_VERSION = "receipt-v1"
EXTRACTION_DEVICE = "extraction-worker"

# Category ids with their chart colours.
CATEGORIES = (
    ("food_grocery", "#0f766e"),
    ("restaurant", "#d97706"),
    ("transport", "#2563eb"),
    ("home", "#7c3aed"),
    ("health", "#dc2626"),
    ("personal", "#db2777"),
    ("entertainment", "#0891b2"),
    ("other", "#64748b"),
)
DEFAULT_COLOUR = "#64748b"
