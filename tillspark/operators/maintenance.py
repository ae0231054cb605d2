"""Row creation, edits, cascade deletes and migrations as table transforms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.functions import money, text
from tillspark.functions.dates import iso_millis
from tillspark.model import CLIENT_JOBS, IMAGES, RECEIPT_ITEMS, RECEIPTS, SETTINGS
from tillspark.session import cut_lineage

# The settings row of a new archive.
DEFAULT_SETTINGS = ("singleton", "en-GB", "auto", "auto", "EUR", None, 20.0, 1000, None)
EDITABLE = ("merchantRaw", "merchantNormalized", "transactionDate", "totalMinor", "currency",
            "categoryId")
CAPTURE_FAILED = "Salvataggio immagine incompleto"


def _null(kind="string") -> Column:
    return F.lit(None).cast(kind)


def new_receipts(requests: DataFrame, now: datetime, device: str,
                 status: Column | None = None, receipt_id: Column | None = None,
                 warnings: Column | None = None) -> DataFrame:
    """Receipts with their defaults. ``requests``: currency, and imageHash for captures."""
    none = F.array().cast("array<string>")
    stamp = F.lit(iso_millis(now))
    given = {
        "id": receipt_id if receipt_id is not None else F.uuid(),
        "status": status if status is not None else F.lit("manual"),
        "capturedAt": stamp, "transactionDate": F.lit(now.date().isoformat()),
        "currency": F.coalesce("currency", F.lit("EUR")), "categoryId": F.lit("other"),
        "imageHash": F.col("imageHash") if "imageHash" in requests.columns else _null(),
        "warnings": warnings if warnings is not None else none,
        "userConfirmed": F.lit(False),
        "ai": F.struct(*[_null(f.dataType).alias(f.name) for f in RECEIPTS["ai"].dataType]),
        "updatedAt": stamp, "updatedByDevice": F.lit(device),
    }
    return requests.select(*[
        given.get(f.name, _null(f.dataType)).cast(f.dataType).alias(f.name) for f in RECEIPTS])


def new_jobs(receipts: DataFrame, kind: str, now: datetime,
             job_id: Column | None = None) -> DataFrame:
    """Pending jobs of one kind, one for each receipt."""
    stamp = F.lit(iso_millis(now))
    given = {
        "id": job_id if job_id is not None else F.uuid(), "type": F.lit(kind),
        "receiptId": F.col("id"), "status": F.lit("pending"), "attempts": F.lit(0),
        "createdAt": stamp, "updatedAt": stamp,
    }
    return receipts.select(*[
        given.get(f.name, _null(f.dataType)).cast(f.dataType).alias(f.name)
        for f in CLIENT_JOBS])


def captured(captures: DataFrame, now: datetime,
             device: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Receipts, images and upload jobs of captures.

    ``captures``: id, currency, imageHash, mimeType, width, height, sizeBytes, stored. A
    capture whose image could not be stored leaves a failed receipt and nothing else.
    """
    stored = F.col("stored")
    receipts = new_receipts(
        captures, now, device, F.when(stored, "queued").otherwise("failed"), F.col("id"),
        F.when(stored, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit(CAPTURE_FAILED))))
    kept = captures.where("stored")
    images = kept.select(
        F.col("imageHash").alias("id"), F.col("id").alias("receiptId"), "mimeType", "width",
        "height", "sizeBytes", F.lit("pending").alias("remoteStatus"),
        _null().alias("remoteFileId"), F.lit(iso_millis(now)).alias("createdAt"))
    jobs = new_jobs(kept.select("id"), "image-upload", now)
    return receipts, images.select(*IMAGES.names), jobs


def edit_form(forms: DataFrame) -> DataFrame:
    """Form texts to a change frame: amounts to minor units, blanks to null or a default."""
    merchant = text.blank_to_null(F.col("merchant"))
    fields = {
        "merchantRaw": merchant, "merchantNormalized": merchant,
        "transactionDate": text.blank_to_null(F.col("transactionDate")),
        "totalMinor": money.to_minor(F.col("total")),
        "currency": F.upper(F.coalesce(text.blank_to_null(F.col("currency")), F.lit("EUR"))),
        "categoryId": F.coalesce(text.blank_to_null(F.col("categoryId")), F.lit("other")),
    }
    return forms.select(
        "id", F.lit(True).alias("confirmed"),
        F.array(*[F.lit(n) for n in fields]).alias("present"),
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("new"))


def update_receipts(receipts: DataFrame, changes: DataFrame, now: datetime,
                    device: str) -> DataFrame:
    """New versions of edited receipts.

    ``changes``: id, confirmed, present (names of the given fields), new (struct of
    editable fields). A confirmation is kept once it was given.
    """
    edited = receipts.join(changes, "id")
    columns = {
        name: F.when(F.array_contains("present", name), F.col("new")[name])
        .otherwise(F.col(name))
        for name in EDITABLE if name in changes.schema["new"].dataType.names}
    columns |= {
        "userConfirmed": F.col("confirmed") | F.col("userConfirmed"),
        "status": F.when(F.col("confirmed"), "confirmed").otherwise(F.col("status")),
        "updatedAt": F.lit(iso_millis(now)), "updatedByDevice": F.lit(device)}
    return edited.withColumns(columns).select(*receipts.columns)


def replace_items(items: DataFrame, edits: DataFrame, now: datetime, device: str) -> DataFrame:
    """The item table after some receipts got a new list.

    ``edits``: receiptId, userEdited, items (array of structs with any item fields).
    """
    kept = items.join(edits.select("receiptId"), "receiptId", "left_anti")
    rows = edits.select("receiptId", F.col("userEdited").alias("byUser"),
                        F.posexplode("items").alias("position", "item"))
    given = set(edits.schema["items"].dataType.elementType.names)

    def read(name: str) -> Column:
        kind = RECEIPT_ITEMS[name].dataType
        return F.col("item")[name].cast(kind) if name in given else _null(kind)

    values = {
        "id": F.coalesce(text.blank_to_null(read("id")), F.uuid()),
        "receiptId": F.col("receiptId"), "rawName": F.coalesce(read("rawName"), F.lit("")),
        "normalizedName": F.coalesce(text.blank_to_null(read("normalizedName")),
                                     read("rawName"), F.lit("")),
        "categoryId": F.coalesce(text.blank_to_null(read("categoryId")), F.lit("other")),
        "position": F.col("position"),
        "userEdited": F.col("byUser") | F.coalesce(read("userEdited"), F.lit(False)),
        "updatedAt": F.lit(iso_millis(now)), "updatedByDevice": F.lit(device)}
    fresh = rows.select(*[values.get(n, read(n)).alias(n) for n in RECEIPT_ITEMS.names])
    return kept.select(*RECEIPT_ITEMS.names).unionByName(fresh)


def cascade_delete(ids: DataFrame, receipts: DataFrame, items: DataFrame, images: DataFrame,
                   jobs: DataFrame) -> DataFrame:
    """What a deletion removes: (collection, documentId) of the receipts, all their items and
    jobs, and the first image found of each."""
    gone = cut_lineage(ids.select(F.col("id").alias("receiptId")).distinct(), "cascade-ids")

    def named(collection: str, document_id: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(collection).alias("collection"),
                            F.col(document_id).alias("documentId"))

    first_image = images.join(gone, "receiptId", "left_semi").groupBy("receiptId").agg(
        F.min("id").alias("id"))
    return (
        named("receipt_items", "id", items.join(gone, "receiptId", "left_semi"))
        .unionByName(named("images", "id", first_image))
        .unionByName(named("jobs", "id", jobs.join(gone, "receiptId", "left_semi")))
        .unionByName(named("receipts", "id", receipts.join(
            gone.withColumnRenamed("receiptId", "id"), "id", "left_semi"))))


def apply_cascade(table: DataFrame, collection: str, removed: DataFrame) -> DataFrame:
    """A table without the removed documents."""
    gone = removed.where(F.col("collection") == collection).select(
        F.col("documentId").alias("id"))
    return table.join(gone, "id", "left_anti")


def _settings_v4(df: DataFrame) -> DataFrame:
    return df.withColumns({"languagePreference": F.lit("auto"),
                           "themePreference": F.lit("auto")})


# Steps by table and the schema version each one leads to.
MIGRATIONS = {
    "settings": {2: lambda df: df.drop("syncEnabled"), 3: lambda df: df.drop("syncToken"),
                 4: _settings_v4},
    "jobs": {2: lambda df: df.where(F.col("type") != "ai-extraction")},
}
VERSIONS = {"receipts": 1, "receipt_items": 1, "images": 1, "jobs": 2, "settings": 4,
            "audit_events": 1}


def migrate(df: DataFrame, table: str, from_version: int) -> DataFrame:
    """Runs the steps between a stored version and the present one, in order."""
    for version in range(from_version + 1, VERSIONS[table] + 1):
        df = MIGRATIONS.get(table, {}).get(version, lambda same: same)(df)
    return df


def default_settings(spark: SparkSession, settings: DataFrame) -> DataFrame:
    """Adds the default row when there is none."""
    row = spark.createDataFrame([DEFAULT_SETTINGS], SETTINGS)
    missing = row.join(settings.select("id"), "id", "left_anti")
    return settings.select(*SETTINGS.names).unionByName(missing.select(*SETTINGS.names))


def change_language(settings: DataFrame, preference: Column, old_language: Column,
                    new_language: Column, locale: Column) -> DataFrame:
    """Stores a language; a summary in another language is dropped."""
    return settings.withColumns({
        "languagePreference": preference, "locale": locale,
        "aiSummary": F.when(old_language == new_language, F.col("aiSummary"))})


def stored_summary(summaries: DataFrame, dataset_hash: Column, now: datetime) -> DataFrame:
    """The settings value of validated summaries (observations, suggestion)."""
    value = F.struct("observations", "suggestion", dataset_hash.alias("datasetHash"),
                     F.lit(iso_millis(now)).alias("generatedAt"))
    return summaries.withColumn("aiSummary", F.to_json(value, {"ignoreNullFields": "false"}))


def catalogue_gaps(catalogue: DataFrame, base: str = "en") -> DataFrame:
    """Keys a language lacks against the base language, and keys only it has."""
    keys = catalogue.select("lang", "key")
    languages = keys.select("lang").distinct()
    # The languages are a handful by nature; each must have every base key.
    wanted = keys.where(F.col("lang") == base).select("key").withColumn(
        "lang", F.explode(languages.agg(F.collect_set("lang")).scalar()))
    missing = wanted.select("lang", "key").exceptAll(keys).withColumn("gap", F.lit("missing"))
    extra = keys.exceptAll(wanted.select("lang", "key")).withColumn("gap", F.lit("extra"))
    blank = catalogue.where(F.coalesce("text", F.lit("")) == "").select(
        "lang", "key", F.lit("blank").alias("gap"))
    return missing.unionByName(extra).unionByName(blank)
