"""Inverted index of letter trigrams for the archive's text search.

Merchant names and items repeat, so grams are those of distinct texts: postings are rows (gram,
text id), sorted by gram, and members are rows (text id, receipt id). Grams that receipts have more
than ``hot_share`` times as often as there are receipts are counted but not posted: they would
narrow nothing and make the longest lists. A search takes the rarest grams of its text, keeps the
texts that have all of them, and gives the receipts of those to the exact search. Two texts of one
id, a hash, only add receipts to be looked at.

A text of less than three letters, or one whose grams are all hot, is searched without the index.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.operators import archive

GRAM, HOT_SHARE, PROBES = 3, 0.2, 4


_MEMBERS = "text_id long, text string, id string"


def _grams(texts: DataFrame) -> DataFrame:
    """(gram, text_id, receipts) of rows (text_id, text, receipts), each gram of a text once."""
    spots = F.sequence(F.lit(1), F.length("text") - (GRAM - 1))
    grams = F.array_distinct(F.transform(spots, lambda i: F.substring(F.col("text"), i, GRAM)))
    return texts.select(F.explode(grams).alias("gram"), "text_id", "receipts")


def build(receipts: DataFrame, items: DataFrame, root: str, hot_share: float = HOT_SHARE) -> None:
    """Writes ``members`` (text_id, text, id), ``texts`` (text_id, text, receipts), ``counts``
    (gram, receipts, posted) and ``postings`` (gram, text_id).

    Each receipt has a text once, and each text is cut into grams once for the counts and once
    for the postings, however many receipts have it; nothing of the size of grams by receipts is
    made. A text or gram of many receipts is a hot key only of counts, which combine map-side.
    """
    spark = receipts.sparkSession
    names = F.lower(F.concat(F.coalesce("merchantNormalized", F.lit("")), F.lit(" "),
                             F.coalesce("merchantRaw", F.lit(""))))
    texts = receipts.select("id", names.alias("text")).unionByName(items.select(
        F.col("receiptId").alias("id"),
        F.lower(F.concat("normalizedName", F.lit(" "), "rawName")).alias("text")))
    texts = texts.where(F.length("text") >= GRAM).distinct().withColumn(
        "text_id", F.xxhash64("text"))
    texts.select("text_id", "text", "id").write.parquet(f"{root}/members")
    members = spark.read.schema(_MEMBERS).parquet(f"{root}/members")
    members.groupBy("text_id", "text").agg(F.count("*").alias("receipts")).write.parquet(
        f"{root}/texts")
    texts = spark.read.schema("text_id long, text string, receipts long").parquet(f"{root}/texts")
    share = hot_share * receipts.count()
    (_grams(texts).groupBy("gram").agg(F.sum("receipts").alias("receipts"))
     .withColumn("posted", F.col("receipts") <= share)
     .repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/counts"))
    cold = spark.read.parquet(f"{root}/counts").where("posted").select("gram")
    # The id in the range key lets a common gram lie in several files.
    (_grams(texts).select("gram", "text_id").join(cold, "gram", "left_semi")
     .repartitionByRange("gram", "text_id").sortWithinPartitions("gram", "text_id")
     .write.parquet(f"{root}/postings"))


def candidates(spark: SparkSession, root: str, query: str) -> DataFrame | None:
    """Ids of receipts with a text that has the rarest grams of ``query``; null if the index
    cannot tell.

    A gram that the index has never seen is in no receipt.
    """
    wanted = query.strip().lower()
    grams = sorted({wanted[i:i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if not grams:
        return None
    known = {r["gram"]: r for r in spark.read.schema(
        "gram string, receipts long, posted boolean").parquet(f"{root}/counts").where(
        F.col("gram").isin(grams)).collect()}
    members = spark.read.schema(_MEMBERS).parquet(f"{root}/members").select("text_id", "id")
    if len(known) < len(grams):
        return members.select("id").limit(0)
    rare = sorted((r["receipts"], g) for g, r in known.items() if r["posted"])[:PROBES]
    if not rare:
        return None
    postings = spark.read.schema("gram string, text_id long").parquet(f"{root}/postings")
    hits = postings.where(F.col("gram").isin([g for _, g in rare])).distinct()
    texts = hits.groupBy("text_id").agg(F.count("*").alias("hits")).where(
        F.col("hits") == len(rare))
    return members.join(texts, "text_id", "left_semi").select("id").distinct()


def search(receipts: DataFrame, items: DataFrame, root: str, now: datetime, query: str = "",
           category: str = "", period: str = "all") -> DataFrame:
    """The same rows as ``archive.search``; the exact test runs on the candidates only."""
    found = candidates(receipts.sparkSession, root, query) if query.strip() else None
    if found is not None:
        receipts = receipts.join(found, "id", "left_semi")
        items = items.join(found.withColumnRenamed("id", "receiptId"), "receiptId", "left_semi")
    return archive.search(receipts, items, now, query, category, period)
