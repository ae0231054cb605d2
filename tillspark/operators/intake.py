"""Image intake: hash check, content-addressed store, sizes and metadata rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.functions.dates import iso_millis
from tillspark.functions.money import half_up
from tillspark.functions.once import settle
from tillspark.model import MAX_UPLOAD_BYTES
from tillspark.operators.contract import upload_violations
from tillspark.session import cut_lineage


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Every file as path, length and content, whatever its name.

    The bytes of oversized files are not read; their content is null and their length makes
    them ``too_large`` in ``checked_uploads``.
    """
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= MAX_UPLOAD_BYTES
    return files.where(fits).select("path", "length", "content").unionByName(
        files.where(~fits).select("path", "length", F.lit(None).cast("binary").alias("content")))


def stored_path(file_hash: Column, thumbnail: bool = False) -> Column:
    suffix = ".thumb.jpg" if thumbnail else ".jpg"
    return F.concat(F.substring(file_hash, 1, 2), F.lit("/"), file_hash, F.lit(suffix))


def checked_uploads(uploads: DataFrame) -> DataFrame:
    """Adds ``hash``, ``size`` and the broken rules; reads the bytes once."""
    size = F.octet_length("content").cast("long")
    if "length" in uploads.columns:
        size = F.coalesce(size, F.col("length"))
    return settle(uploads, hash=F.sha2("content", 256), size=size,
                  violations=upload_violations(size))


def rejected_uploads(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def store_results(checked: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each valid upload; the first of a hash stores it unless it was there.

    The first upload is found by a partial minimum, and then matched on (hash, upload), so
    that a hash uploaded a billion times is no hot join key. What was read from the bytes is
    written down once, so they are not hashed again for the second use.
    """
    valid = cut_lineage(checked.where(F.size("violations") == 0).drop("content"), "intake")
    first = valid.groupBy("hash").agg(F.min("upload_id").alias("upload_id"))
    if stored is not None:
        first = first.join(stored.select("hash"), "hash", "left_anti")
    marked = valid.join(first.withColumn("is_new", F.lit(True)), ["hash", "upload_id"], "left")
    return marked.select(
        "upload_id", "receiptId", F.col("hash").alias("fileId"), "size",
        stored_path(F.col("hash")).alias("path"), F.col("is_new").isNull()
        .alias("alreadyExisted"), "locale", F.upper("currency").alias("currency"))


def new_content(checked: DataFrame, results: DataFrame) -> DataFrame:
    """Bytes to write, each hash once; ``prefix`` is the folder."""
    fresh = results.where(~F.col("alreadyExisted")).select("upload_id")
    return checked.join(fresh, "upload_id", "left_semi").select(
        F.substring("hash", 1, 2).alias("prefix"), "hash", "content")


def write_content(content: DataFrame, root: str) -> None:
    content.write.mode("append").partitionBy("prefix").parquet(root)


def output_size(width: Column, height: Column, maximum: int) -> Column:
    """Scaled size: never larger, same ratio, at least one pixel."""
    ratio = F.least(F.lit(1.0), F.lit(float(maximum)) / F.greatest(width, height))
    side = {n: F.greatest(F.lit(1).cast("long"), half_up(c * ratio)).cast("int")
            for n, c in (("width", width), ("height", height))}
    return F.struct(*[c.alias(n) for n, c in side.items()])


def upsert_remote_images(images: DataFrame, arrivals: DataFrame, now: datetime) -> DataFrame:
    """Metadata after image bytes arrived from another device.

    ``arrivals``: id (hash), receiptId, variant, sizeBytes, ord. Unknown images are inserted
    as remote with the receipt of their first arrival; the last full variant sets the size.
    """
    full = F.col("variant") == "full"
    seen = arrivals.groupBy("id").agg(
        F.min_by("receiptId", "ord").alias("firstReceipt"),
        F.max_by(F.when(full, F.col("sizeBytes")), F.when(full, F.col("ord"))).alias("fullSize"))
    merged = images.join(seen, "id", "full_outer")
    absent = F.col("receiptId").isNull() & F.col("createdAt").isNull()

    def default(name: str, value: Column) -> Column:
        return F.when(absent, value).otherwise(F.col(name)).alias(name)

    return merged.select(
        "id", default("receiptId", F.col("firstReceipt")),
        default("mimeType", F.lit("image/jpeg")), default("width", F.lit(0)),
        default("height", F.lit(0)),
        F.coalesce("fullSize", "sizeBytes", F.lit(0).cast("long")).alias("sizeBytes"),
        default("remoteStatus", F.lit("remote")), default("remoteFileId", F.col("id")),
        default("createdAt", F.lit(iso_millis(now))))


def image_bytes(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Bytes by (hash, variant); a missing one stays null."""
    return requests.join(store.select("hash", "variant", "content"), ["hash", "variant"], "left")
