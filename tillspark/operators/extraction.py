"""Guarded merge of extracted documents into receipts and items, and its job outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions.dates import iso_micros
from tillspark.functions.text import is_sha256
from tillspark.model import EXTRACTION_DEVICE, PROMPT_VERSION

# The prompts a text model receives.
RECEIPT_PROMPT = (
    "Analizza lo scontrino e restituisci esclusivamente JSON conforme allo schema.\n"
    "Gli importi sono interi nell'unita minima della valuta. Non inventare testo illeggibile.\n"
    "Normalizza esercente e prodotti in modo prudente; usa categoryId 'other' se incerto.\n"
    "Locale: {locale}. Valuta predefinita: {currency}.")
INSIGHT_PROMPT = (
    "Genera al massimo tre osservazioni e un suggerimento usando soltanto i dati\n"
    "aggregati forniti. Non inventare dati, non fare previsioni e non offrire consulenza "
    "fiscale o\nd'investimento. Scrivi nella lingua indicata dal locale {locale}. Restituisci "
    "esclusivamente JSON\nconforme allo schema.")


def protected() -> Column:
    """Missing, deleted or confirmed by the user; reads the receipt after a left join."""
    return (F.col("status").isNull() | F.coalesce("_deleted", F.lit(False))
            | F.coalesce("userConfirmed", F.lit(False)))


def job_readiness(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """What may happen to each claimed job before the model is called."""
    known = receipts.select(F.col("id").alias("receipt_id"), "status", "_deleted",
                            "userConfirmed", "imageHash")
    joined = jobs.select(F.col("id").alias("job_id"), "receipt_id", "image_hash").join(
        known, "receipt_id", "left")
    return joined.select(
        "job_id", "receipt_id",
        F.when(F.col("status").isNull(), "not_ready").when(protected(), "skipped")
        .when(~F.col("imageHash").eqNullSafe(F.col("image_hash")), "invalid")
        .otherwise("ready").alias("readiness"))


def user_edited(items: DataFrame) -> DataFrame:
    """Receipts with a live item that the user has edited."""
    return (items.where(~F.coalesce("_deleted", F.lit(False)) & F.col("userEdited"))
            .select(F.col("receiptId").alias("receipt_id")).distinct()
            .withColumn("edited", F.lit(True)))


def judge(extractions: DataFrame, receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Extractions with the receipt they go to and whether it must be left alone."""
    edited = user_edited(items)
    heads = receipts.select(F.col("id").alias("receipt_id"), F.struct("*").alias("receipt"),
                            "status", "_deleted", "userConfirmed")
    joined = extractions.join(heads, "receipt_id", "left").join(edited, "receipt_id", "left")
    skip = protected() | F.coalesce("edited", F.lit(False))
    return joined.withColumn("skip", skip).drop("status", "_deleted", "userConfirmed", "edited")


def merged_receipts(judged: DataFrame, now: datetime, provider_id: str,
                    model_id: str) -> DataFrame:
    """New versions of the receipts that take an extraction."""
    taken = judged.where(~F.col("skip"))
    new = F.col("extraction")
    old = F.col("receipt")
    provenance = F.struct(
        F.lit(provider_id).alias("providerId"), F.lit(model_id).alias("modelId"),
        F.lit(PROMPT_VERSION).alias("promptVersion"), new["schemaVersion"].alias("schemaVersion"))
    return taken.select(
        old["id"].alias("id"), F.lit("needs_review").alias("status"),
        old["capturedAt"].alias("capturedAt"),
        F.coalesce(new["transactionDate"], old["transactionDate"]).alias("transactionDate"),
        new["merchant"]["rawName"].alias("merchantRaw"),
        new["merchant"]["normalizedName"].alias("merchantNormalized"),
        *[new[n].alias(n) for n in ("currency", "subtotalMinor", "taxMinor", "discountMinor",
                                    "totalMinor", "categoryId")],
        old["imageHash"].alias("imageHash"), new["confidence"].alias("overallConfidence"),
        new["warnings"].alias("warnings"), old["userConfirmed"].alias("userConfirmed"),
        provenance.alias("ai"), F.lit(iso_micros(now)).alias("updatedAt"),
        F.lit(EXTRACTION_DEVICE).alias("updatedByDevice"), old["_deleted"].alias("_deleted"))


def taken_receipts(judged: DataFrame) -> DataFrame:
    """The receipts that take an extraction, each once."""
    return judged.where(~F.col("skip")).select(F.col("receipt_id").alias("receiptId")).distinct()


def item_tombstones(judged: DataFrame, items: DataFrame, now: datetime) -> DataFrame:
    """Live items of those receipts, marked deleted, also when the new list is empty."""
    live = items.where(~F.coalesce("_deleted", F.lit(False)))
    return live.join(taken_receipts(judged), "receiptId").select(*live.columns).withColumns({
        "_deleted": F.lit(True), "updatedAt": F.lit(iso_micros(now)),
        "updatedByDevice": F.lit(EXTRACTION_DEVICE)})


def new_items(judged: DataFrame, now: datetime, item_id: Column | None = None) -> DataFrame:
    """Extracted items by position; a list has at most 250 entries by contract."""
    rows = judged.where(~F.col("skip")).select(
        "receipt_id", F.posexplode("extraction.items").alias("position", "item"))
    item = F.col("item")
    return rows.select(
        (item_id if item_id is not None else F.uuid()).alias("id"),
        F.col("receipt_id").alias("receiptId"), item["rawName"].alias("rawName"),
        F.coalesce(F.nullif(item["normalizedName"], F.lit("")), item["rawName"])
        .alias("normalizedName"),
        *[item[n].alias(n) for n in ("quantity", "unitPriceMinor", "totalPriceMinor",
                                     "categoryId", "confidence")],
        "position", F.lit(False).alias("userEdited"), F.lit(iso_micros(now)).alias("updatedAt"),
        F.lit(EXTRACTION_DEVICE).alias("updatedByDevice"), F.lit(False).alias("_deleted"))


def job_outcomes(judged: DataFrame, now: datetime) -> DataFrame:
    """Completed, or skipped because the user's edits were kept."""
    skip = F.col("skip")
    return judged.select(
        F.col("job_id").alias("id"), "receipt_id",
        F.when(skip, "skipped").otherwise("completed").alias("status"),
        F.lit(None).cast("string").alias("next_attempt_at"),
        F.when(skip, "user_edited").alias("last_error_code"),
        F.when(skip, "User edits were preserved").alias("last_error_message"),
        F.lit(iso_micros(now)).alias("updated_at"))


def set_status(receipts: DataFrame, targets: DataFrame, now: datetime) -> DataFrame:
    """New versions with the status of ``targets`` (id, new_status), unless protected."""
    hit = receipts.join(targets.select("id", "new_status"), "id").where(~protected())
    return hit.withColumns({
        "status": F.col("new_status"), "updatedAt": F.lit(iso_micros(now)),
        "updatedByDevice": F.lit(EXTRACTION_DEVICE)}).drop("new_status")


def backfill(receipts: DataFrame, jobs: DataFrame, store: DataFrame) -> DataFrame:
    """Live receipts that wait for extraction, have their image and no job.

    ``reset`` marks those whose receipt must be put back to queued and unconfirmed: blank
    ones that an old client had confirmed, and ones left in processing.
    """
    waiting = receipts.where(
        ~F.coalesce("_deleted", F.lit(False))
        & F.col("status").isin("queued", "processing", "failed")
        & is_sha256(F.col("imageHash")))
    blank = (F.coalesce("userConfirmed", F.lit(False)) & F.col("merchantNormalized").isNull()
             & F.col("totalMinor").isNull()
             & (F.coalesce(F.col("ai.providerId"), F.lit("")) == ""))
    stored = store.select(F.col("hash").alias("imageHash"))
    queued = jobs.select(F.col("receipt_id").alias("id"))
    return (waiting.join(queued, "id", "left_anti").join(stored, "imageHash", "left_semi")
            .withColumn("reset", blank | (F.col("status") == "processing")))


def backfilled_receipts(candidates: DataFrame, now: datetime) -> DataFrame:
    return candidates.where("reset").drop("reset").withColumns({
        "status": F.lit("queued"), "userConfirmed": F.lit(False),
        "updatedAt": F.lit(iso_micros(now)), "updatedByDevice": F.lit(EXTRACTION_DEVICE)})


def backfill_requests(candidates: DataFrame) -> DataFrame:
    """Queue requests of the candidates."""
    return candidates.select(
        F.col("id").alias("receipt_id"), F.col("imageHash").alias("image_hash"),
        F.lit("en-GB").alias("locale"),
        F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.lit("EUR"))).alias("currency"),
        F.lit(0).cast("long").alias("ord"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def receipt_prompt(locale: Column, currency: Column) -> Column:
    return _filled(RECEIPT_PROMPT, {"locale": locale, "currency": currency})


def insight_prompt(locale: Column, snapshot_json: Column) -> Column:
    return F.concat(_filled(INSIGHT_PROMPT, {"locale": locale}),
                    F.lit("\n\nDati aggregati:\n"), snapshot_json)


def call_model(requests: DataFrame, call: Callable[[bytes, str, str], str]) -> DataFrame:
    """Runs an injected model over job rows (job_id, receipt_id, content, mimeType, prompt).

    ``call(content, mime_type, prompt)`` returns the reply text. An error becomes a failure
    class and does not stop the other rows of its task. Missing content or a missing file is a file
    error; an unreachable model is ``ModelUnavailable`` or any ``OSError``.
    """
    schema = "job_id string, receipt_id string, reply string, failure string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [_safe_call(call, row) for row in zip(
                batch["content"], batch["mimeType"], batch["prompt"])]
            yield pd.DataFrame({
                "job_id": batch["job_id"], "receipt_id": batch["receipt_id"],
                "reply": [r for r, _ in replies], "failure": [f for _, f in replies]})

    columns = ["job_id", "receipt_id", "content", "mimeType", "prompt"]
    return requests.select(*columns).mapInPandas(run, schema)


class ModelUnavailable(Exception):
    """The model cannot be reached or answers with an error of its own; raised by the callable."""


def _safe_call(call, arguments) -> tuple[str | None, str | None]:
    if arguments[0] is None:
        return None, "file"
    try:
        return call(*arguments), None
    except LookupError:
        return None, "lookup"
    except TimeoutError:
        return None, "timeout"
    except FileNotFoundError:
        return None, "file"
    except (ModelUnavailable, OSError):  # HTTP clients derive their errors from OSError
        return None, "http"
    except ValueError:
        return None, "invalid"
    except Exception:  # any other error of a provider
        return None, "other"
