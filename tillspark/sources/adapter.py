"""Maps the driver's star schema to the receipt tables.

Every rule is a function of the columns of one row, so a mapping adds no window and no
grouping: at any size it is a scan plus key lookups whose strategy Catalyst picks by size.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillspark.functions.dates import comparable_period
from tillspark.functions.once import settle
from tillspark.functions.text import sha256_hex
from tillspark.model import EXTRACTED_ITEMS_MAX, REPLICATED_COLLECTIONS

NOW = datetime(2001, 7, 14, 12, 0, 0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _minor(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_from(_table(spark, sf_dir, "orders"), spark, sf_dir)


def receipts_between(spark: SparkSession, sf_dir: str, first: date, last: date) -> DataFrame:
    """Receipts whose transaction date can lie in a range of days; the range reaches the scan."""
    orders = _table(spark, sf_dir, "orders")
    kind = orders.schema["o_orderdate"].dataType
    begin, end = (F.lit(d.isoformat()).cast(kind) for d in (first, last + timedelta(days=1)))
    placed = F.col("o_orderdate")
    return receipts_from(orders.where((placed >= begin) & (placed < end)), spark, sf_dir)


def receipts_of_period(spark: SparkSession, sf_dir: str, now: datetime) -> DataFrame:
    """Receipts that the comparison of ``now`` can count."""
    period = comparable_period(now)
    return receipts_between(spark, sf_dir, period.previous_start, period.end)


def owned_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with the id of the settings row of their customer."""
    owner = F.concat(F.lit("s-"), "o_custkey").alias("owner")
    return receipts_from(_table(spark, sf_dir, "orders"), spark, sf_dir, owner)


def receipts_from(orders: DataFrame, spark: SparkSession, sf_dir: str,
                  *more: Column) -> DataFrame:
    """Receipts of an order table or stream, with more columns of it if wanted."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey",
                                                        "c_mktsegment")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("o_orderkey")
    stamp = F.timestamp_seconds(
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key % 86400)
    joined = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return joined.select(
        key.cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "confirmed")
        .when(F.col("o_orderstatus") == "O", "needs_review")
        .otherwise("queued").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("capturedAt"),
        F.when(key % 37 != 0, F.col("o_orderdate").cast("date").cast("string"))
        .alias("transactionDate"),
        F.when(key % 19 != 0, F.upper("n_name")).alias("merchantRaw"),
        F.when(key % 17 != 0, F.col("n_name")).alias("merchantNormalized"),
        F.lit("EUR").alias("currency"),
        _none("long").alias("subtotalMinor"), _none("long").alias("taxMinor"),
        _none("long").alias("discountMinor"),
        F.when(key % 23 != 0, _minor(F.col("o_totalprice"))).alias("totalMinor"),
        F.when(key % 41 == 0, "").otherwise(F.col("c_mktsegment")).alias("categoryId"),
        sha256_hex(key.cast("string")).alias("imageHash"),
        _none("double").alias("overallConfidence"),
        F.array().cast("array<string>").alias("warnings"),
        (F.col("o_orderstatus") == "F").alias("userConfirmed"),
        F.struct(_none().alias("providerId"), _none().alias("modelId"),
                 _none().alias("promptVersion"), _none("int").alias("schemaVersion"))
        .alias("ai"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("updatedAt"),
        F.concat(F.lit("dev-"), F.col("o_custkey") % 4).alias("updatedByDevice"), *more,
    )


# Market segments as category ids; a segment that is not here stays an unknown category.
SEGMENT_CATEGORIES = {"AUTOMOBILE": "transport", "BUILDING": "home",
                      "FURNITURE": "food_grocery", "HOUSEHOLD": "restaurant"}


def with_known_categories(receipts: DataFrame) -> DataFrame:
    """Receipts whose category is one of the catalogue's, but for one segment."""
    return receipts.replace(SEGMENT_CATEGORIES, subset=["categoryId"])


def receipt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one receipt may share a position; the id orders them."""
    return receipt_items_from(_table(spark, sf_dir, "lineitem"), spark, sf_dir)


def receipt_items_from(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    item_id = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.unix_date(F.col("l_shipdate").cast("date")),
        _minor(F.col("l_extendedprice")), F.col("l_quantity").cast("long"))
    return joined.select(
        item_id.alias("id"),
        F.col("l_orderkey").cast("string").alias("receiptId"),
        F.upper("p_name").alias("rawName"),
        F.when(F.col("l_partkey") % 29 == 0, "").otherwise(F.col("p_name"))
        .alias("normalizedName"),
        F.when(F.col("l_partkey") % 43 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_partkey") % 31 != 0,
               _minor(F.col("l_extendedprice") / F.col("l_quantity"))).alias("unitPriceMinor"),
        _minor(F.col("l_extendedprice")).alias("totalPriceMinor"),
        F.col("p_type").alias("categoryId"),
        _none("double").alias("confidence"),
        (F.col("l_linenumber") - 1).alias("position"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("userEdited"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("updatedAt"),
        F.concat(F.lit("dev-"), F.col("l_suppkey") % 4).alias("updatedByDevice"),
    )


def incoming_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written documents of all collections, one for each event, in event order."""
    return incoming_from_events(_table(spark, sf_dir, "events"))


def incoming_from_events(events: DataFrame) -> DataFrame:
    event = F.col("event_id")
    doc = F.col("user_id").cast("string")
    status = (
        F.when(F.col("event_type") == "click", "queued")
        .when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "purchase", "needs_review")
        .when(F.col("event_type") == "signup", "confirmed").otherwise("failed"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    deleted = F.col("event_type") == "error"
    device = F.concat(F.lit("dev-"), F.get_json_object("props", "$.k").cast("int") % 4)
    document = F.concat(
        F.lit('{"_deleted":'), deleted.cast("string"), F.lit(',"id":"'), doc,
        F.lit('","status":"'), status, F.lit('","updatedAt":"'), stamp,
        F.lit('","updatedByDevice":"'), device, F.lit('"}'))
    collection = (F.when(event % 50 == 7, "settings").when(event % 3 == 0, "receipt_items")
                  .otherwise("receipts"))
    return events.select(
        F.lit("single-user").alias("owner_id"), collection.alias("collection_name"),
        doc.alias("document_id"), document.alias("document_json"),
        (event + 1).alias("server_sequence"), deleted.alias("is_deleted"),
        stamp.alias("created_at"), stamp.alias("updated_at"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incoming_documents(spark, sf_dir).where(
        F.col("collection_name").isin(*REPLICATED_COLLECTIONS))


def customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))


def parsed_changes(changes_df: DataFrame) -> DataFrame:
    """The log with status and device read from the payload."""
    fields = F.from_json("document_json",
                         "status string, updatedAt string, updatedByDevice string")
    return changes_df.withColumn("doc", fields).select(
        "collection_name", "document_id", "server_sequence", "is_deleted",
        F.col("doc.status").alias("status"), F.col("doc.updatedAt").alias("updatedAt"),
        F.col("doc.updatedByDevice").alias("updatedByDevice"))


def push_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event order, document and the small state value each pushed row carries."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("document_id"),
        (F.floor("value").cast("long") % 4).alias("value"),
        (F.col("event_type") == "error").alias("is_deleted"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-in attempts, one for each event: errors, clicks and views are failures."""
    return attempts_from_events(_table(spark, sf_dir, "events"))


def attempts_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("ord"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"),
        F.col("event_type").isin("error", "click", "view").alias("failed"))


def extraction_jobs(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """One job for each order; ``gaps`` leaves receipts without a job, where that is the case
    to be looked at."""
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    if gaps:
        orders = orders.where(key % 3 == 0)
    statuses = F.array(*[F.lit(s) for s in ("pending", "processing", "completed", "failed")])
    created = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.000000'Z'")
    later = F.date_format(F.expr("o_orderdate + interval 1 day"),
                          "yyyy-MM-dd'T'HH:mm:ss.000000'Z'")
    failed = key % 4 == 3
    return orders.select(
        F.concat(F.lit("job-"), key).alias("id"), key.cast("string").alias("receipt_id"),
        sha256_hex(F.when(key % 5 == 0, F.concat(F.lit("old-"), key))
                   .otherwise(key.cast("string"))).alias("image_hash"),
        F.lit("ollama").alias("provider_id"), F.lit("en-GB").alias("locale"),
        F.lit("EUR").alias("currency"),
        F.get(statuses, (key % 4).cast("int")).alias("status"),
        (key % 7).cast("int").alias("attempts"),
        F.when(key % 6 < 4, later).alias("next_attempt_at"),
        F.when(failed, "worker_error").alias("last_error_code"),
        F.when(failed, "AI extraction failed").alias("last_error_message"),
        created.alias("created_at"), created.alias("updated_at"))


def client_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload jobs of the client, one for each order; some of other types."""
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    statuses = F.array(*[F.lit(s) for s in ("pending", "processing", "completed", "failed")])
    created = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.000'Z'")
    return orders.select(
        F.concat(F.lit("up-"), key).alias("id"),
        F.when(key % 10 == 4, "ai-extraction").when(key % 10 == 6, "ai-insight")
        .otherwise("image-upload").alias("type"),
        F.when(key % 14 != 0, key.cast("string")).alias("receiptId"),
        F.get(statuses, (F.floor(key / 2) % 4).cast("int")).alias("status"),
        (key % 9).cast("int").alias("attempts"),
        F.when(key % 3 != 0, F.date_format(F.expr("o_orderdate + interval 1 day"),
                                           "yyyy-MM-dd'T'HH:mm:ss.000'Z'"))
        .alias("nextAttemptAt"),
        F.when(key % 6 == 0, "503").alias("lastErrorCode"),
        F.when(key % 6 == 0, "unavailable before").alias("lastErrorMessage"),
        created.alias("createdAt"), created.alias("updatedAt"))


def images(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Image rows of the client, one for each order; some receipts have two and some none.
    ``gaps`` leaves hashes without an image, where that is the case to be looked at."""
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    if gaps:
        orders = orders.where(key % 4 != 0)
    return orders.select(
        sha256_hex(key.cast("string")).alias("id"),
        F.when(key % 12 == 1, key + 1).otherwise(key).cast("string").alias("receiptId"),
        F.lit("image/jpeg").alias("mimeType"),
        (key % 4000 + 1).cast("int").alias("width"),
        (key % 3000 * 2 + 1).cast("int").alias("height"),
        (key % 100000 + 1000).cast("long").alias("sizeBytes"),
        F.when(key % 3 == 0, "uploaded").otherwise("pending").alias("remoteStatus"),
        _none().alias("remoteFileId"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("createdAt"))


# Rules that a reply breaks by its order, from remainder 1 of BROKEN_EVERY on: the rule and the part
# of the reply, as JSON, that breaks it. The items rule is broken by a list beyond its bound.
BROKEN_EVERY = 97
BROKEN = (
    ("schema_version", "schemaVersion", "2"), ("document_type", "documentType", '"invoice"'),
    ("merchant", "merchant", '{"rawName":12}'),
    ("transaction_date", "transactionDate", '"14.07.2001"'), ("currency", "currency", '"EURO"'),
    ("subtotal", "subtotalMinor", "-1"), ("tax", "taxMinor", "1.5"),
    ("discount", "discountMinor", '"0"'), ("category", "categoryId", "5"),
    ("items", "items", None), ("confidence", "confidence", "1.5"), ("warnings", "warnings", "[null]"))


def reply_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receiptId, lines): the items of each receipt as a model would read them from the paper.

    A list longer than a reply may be is cut one entry beyond that bound, which the contract
    rejects all the same; the limit by rank works in each task before the shuffle.
    """
    place = Window.partitionBy("receiptId").orderBy("position", "id")
    names = ("rawName", "normalizedName", "quantity", "unitPriceMinor", "totalPriceMinor",
             "categoryId")
    ranked = receipt_items(spark, sf_dir).select(
        "receiptId", "position", "id", *names, F.lit(0.5).alias("confidence")).withColumn(
        "place", F.row_number().over(place)).where(F.col("place") <= EXTRACTED_ITEMS_MAX + 1)
    entry = F.struct("place", F.struct(*names, "confidence").alias("item"))
    return ranked.groupBy("receiptId").agg(F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: e["item"]).alias("lines"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies for all orders with their line items, well formed or broken by rule.

    Made in settled steps: as one expression, the text stands in it for each way to wrap it, and
    the method that Spark generates is beyond what the JVM compiles.
    """
    key = F.col("o_orderkey")
    total = _minor(F.col("o_totalprice"))
    orders = _table(spark, sf_dir, "orders").withColumn("receiptId", key.cast("string")).join(
        reply_items(spark, sf_dir), "receiptId", "left")
    rule = key % BROKEN_EVERY
    beyond = EXTRACTED_ITEMS_MAX + 1
    lines = F.when(rule == 1 + [name for name, _, _ in BROKEN].index("items"), F.slice(
        F.flatten(F.array_repeat("lines", beyond)), 1, beyond)).otherwise(F.col("lines"))
    parts = {
        "schemaVersion": F.lit("1"), "documentType": F.lit('"receipt"'),
        "merchant": F.to_json(F.struct(F.upper("o_orderpriority").alias("rawName"),
                                       F.col("o_orderpriority").alias("normalizedName"))),
        "transactionDate": F.when(key % 31 == 0, "null").otherwise(
            F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'))),
        "currency": F.lit('"eur"'), "subtotalMinor": F.lit("null"), "taxMinor": F.lit("0"),
        "discountMinor": F.lit("0"),
        "totalMinor": F.when(key % 13 == 0, -total).otherwise(total).cast("string"),
        "categoryId": F.lit('"food_grocery"'),
        "items": F.coalesce(F.to_json(lines, {"ignoreNullFields": "false"}), F.lit("[]")),
        "confidence": F.lit("0.75"), "warnings": F.lit("[]")}
    for number, (_, field, broken) in enumerate(BROKEN, 1):
        if broken is not None:
            parts[field] = F.when(rule == number, broken).otherwise(parts[field])
    single = [n for n in parts if n != "items"]
    listed = settle(orders, items=parts["items"])
    written = settle(listed, **{n: F.concat(F.lit(f'"{n}":'), parts[n]) for n in single})
    texts = [F.concat(F.lit('"items":'), "items") if n == "items" else F.col(n) for n in parts]
    made = settle(written, body=F.concat(
        F.lit("{"), F.concat_ws(",", *texts),
        F.when(key % 29 == 0, ',"extra":1').otherwise(""), F.lit("}")))
    body = F.col("body")
    fenced = F.when(key % 11 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))) \
        .otherwise(body)
    reply = F.when(key % 7 == 0, F.substring(body, 1, 80)).otherwise(fenced)
    return made.select(F.col("receiptId").alias("receipt_id"),
                       F.concat(F.lit("job-"), key).alias("job_id"), reply.alias("reply"))


def stored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes present in the image store, which lacks some."""
    return images(spark, sf_dir, gaps=True).select(F.col("id").alias("hash"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests whose bytes are document texts, most with the JPEG start bytes."""
    docs = _table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    text = F.encode("text", "UTF-8")
    content = F.when(doc % 4 == 1, text).otherwise(
        F.concat(F.unhex(F.lit("FFD8FF")), text))
    claimed = F.when(doc % 10 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(
        F.upper(sha256_hex(content)))
    return docs.select(
        doc.alias("upload_id"), content.alias("content"), claimed.alias("sha256"),
        F.when(doc % 13 == 0, "image/png").otherwise("image/jpeg").alias("mimeType"),
        F.when(doc % 26 == 0, "image/jpeg").when(doc % 13 == 0, "image/png")
        .otherwise("image/jpeg").alias("contentType"),
        F.when(doc % 17 == 0, F.concat(F.lit("r "), doc)).otherwise(
            F.concat(F.lit("r_"), doc)).alias("receiptId"),
        F.when(doc % 19 == 0, "xx-XX").otherwise("it-IT").alias("locale"),
        F.when(doc % 23 == 0, "EURO").otherwise("eur").alias("currency"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the page table, some rewritten to private or special hosts."""
    page = F.col("page_id")
    host = (F.when(page % 10 == 1, "192.168.1.100:11434").when(page % 10 == 2, "169.254.169.254")
            .when(page % 10 == 3, "printer.local").when(page % 10 == 4, "10.300.0.1")
            .when(page % 10 == 5, "224.0.0.251").when(page % 10 == 6, "user:pw@localhost"))
    url = F.when(host.isNull(), F.col("url")).otherwise(
        F.concat(F.regexp_replace("url", r"^(https?)://.*$", "$1"), F.lit("://"), host,
                 F.lit("/v1/")))
    return _table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings rows at schema version 1, one for each customer."""
    customer = _table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    tags = F.array(*[F.lit(t) for t in ("it-IT", "FR_ca", " de-DE ", "pt-BR", "auto", "es", "")])
    return customer.select(
        F.concat(F.lit("s-"), key).alias("id"),
        F.get(tags, (key % 7).cast("int")).alias("locale"),
        F.lit("EUR").alias("defaultCurrency"), _none().alias("selectedAiProvider"),
        F.lit(20.0).alias("insightMinimumPercent"),
        F.lit(1000).cast("long").alias("insightMinimumMinor"),
        F.when(key % 2 == 0, '{"observations":[]}').alias("aiSummary"),
        (key % 2 == 0).alias("syncEnabled"), F.lit("token").alias("syncToken"))
