"""Month-to-date spending against the same days of the month before.

All aggregates here combine map-side, so a hot category, merchant or product costs one
partial row for each task and not a long shuffle partition.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions import dates, money, text
from tillspark.functions.catalogue import catalogue
from tillspark.model import CATEGORIES, DEFAULT_COLOUR, UNKNOWN_MERCHANT

CATEGORY, MERCHANT = "category", "merchant"


def is_usable() -> Column:
    return (F.col("totalMinor").isNotNull() & F.col("transactionDate").isNotNull()
            & (F.col("transactionDate") != ""))


def usable(receipts: DataFrame) -> DataFrame:
    """Receipts with a total and a non-empty date."""
    return receipts.where(is_usable())


def both_periods(receipts: DataFrame, now: datetime) -> DataFrame:
    """Usable receipts of either period with a flag for the current one."""
    period = dates.comparable_period(now)
    day = F.col("transactionDate")
    last = max(period.last_counted, period.previous_end)
    current = dates.text_between(day, period.start, period.last_counted)
    previous = dates.text_between(day, period.previous_start, period.previous_end)
    return (usable(receipts).where(dates.text_between(day, period.previous_start, last))
            .where((current | previous) & dates.is_real_date(day))
            .withColumn("in_current", current))


def measures() -> list[Column]:
    amount = F.coalesce(F.col("totalMinor"), F.lit(0))
    return [
        F.coalesce(F.sum(F.when(F.col("in_current"), amount)), F.lit(0)).alias("total"),
        F.count(F.when(F.col("in_current"), 1)).alias("count"),
        F.coalesce(F.sum(F.when(~F.col("in_current"), amount)), F.lit(0))
        .alias("previousTotal"),
    ]


def with_change(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "difference": F.col("total") - F.col("previousTotal"),
        "changePercent": money.percent_change(F.col("total"), F.col("previousTotal")),
    })


def period_totals(receipts: DataFrame, now: datetime) -> DataFrame:
    """Period bounds, both totals, their difference and percent change."""
    period = dates.comparable_period(now)
    totals = with_change(both_periods(receipts, now).agg(*measures()).drop("count"))
    bounds = {"start": period.start, "end": period.end,
              "previousStart": period.previous_start, "previousEnd": period.previous_end}
    return totals.withColumns({k: F.lit(v.isoformat()) for k, v in bounds.items()})


def spending_keys() -> dict[str, Column]:
    """What a receipt counts to."""
    return {
        CATEGORY: text.category_key(F.col("categoryId")),
        MERCHANT: text.merchant_key(F.col("merchantNormalized"), F.col("merchantRaw")),
    }


def comparison(receipts: DataFrame, now: datetime, dimension: str) -> DataFrame:
    """One row for each key seen in either period; ``count`` is of the current one."""
    keyed = both_periods(receipts, now).withColumn("id", spending_keys()[dimension])
    return with_change(keyed.groupBy("id").agg(*measures()))


def contributions(receipts: DataFrame, now: datetime, dimension: str, *more: str) -> DataFrame:
    """What each receipt adds to ``comparison``: nothing (a null key) outside both periods and
    for deleted ones. Columns id, server_sequence, ``more``, key, total, count, previousTotal,
    rows."""
    period = dates.comparable_period(now)
    day = F.col("transactionDate")
    amount = F.coalesce(F.col("totalMinor"), F.lit(0))
    good = (F.col("totalMinor").isNotNull() & (F.coalesce(day, F.lit("")) != "")
            & dates.is_real_date(day) & ~F.coalesce("_deleted", F.lit(False)))
    current = F.coalesce(good & dates.text_between(
        day, period.start, period.last_counted), F.lit(False))
    previous = F.coalesce(good & ~current & dates.text_between(
        day, period.previous_start, period.previous_end), F.lit(False))
    return receipts.select(
        "id", "server_sequence", *more,
        F.when(current | previous, spending_keys()[dimension]).alias("key"),
        F.when(current, amount).otherwise(0).alias("total"),
        current.cast("long").alias("count"),
        F.when(previous, amount).otherwise(0).alias("previousTotal"),
        (current | previous).cast("long").alias("rows"))


def spent(receipts: DataFrame, now: datetime, *more: str) -> DataFrame:
    """What each receipt adds to its category and to its merchant, as rows with a dimension."""
    parts = [contributions(receipts, now, d, *more).where("key is not null").withColumn(
        "dimension", F.lit(d)) for d in (CATEGORY, MERCHANT)]
    return parts[0].unionByName(parts[1])


def compared(deltas: DataFrame) -> DataFrame:
    """The comparison from any number of contributions and their retractions."""
    sums = deltas.where(F.col("key").isNotNull()).groupBy(F.col("key").alias("id")).agg(
        *[F.sum(c).alias(c) for c in ("total", "count", "previousTotal", "rows")])
    return with_change(sums.where("rows > 0").drop("rows"))


def comparison_all(receipts: DataFrame, now: datetime) -> DataFrame:
    """Totals, categories and merchants from a single pass over the receipts."""
    keyed = both_periods(receipts, now).withColumns(spending_keys())
    grouped = keyed.groupingSets(
        [[F.col(CATEGORY)], [F.col(MERCHANT)], []], CATEGORY, MERCHANT
    ).agg(F.grouping_id().alias("gid"), *measures())
    dimension = F.when(F.col("gid") == 1, CATEGORY).when(F.col("gid") == 2, MERCHANT) \
        .otherwise("all")
    key = F.when(F.col("gid") == 1, F.col(CATEGORY)).when(F.col("gid") == 2, F.col(MERCHANT)) \
        .otherwise("all")
    return with_change(grouped.select(
        dimension.alias("dimension"), key.alias("id"), "total", "count", "previousTotal"))


def product_name() -> Column:
    return text.product_key(F.col("normalizedName"), F.col("rawName"))


def _named_items(items: DataFrame) -> DataFrame:
    return items.withColumn("name", product_name()).where(F.col("name") != "")


def product_totals(receipts: DataFrame, items: DataFrame, now: datetime) -> DataFrame:
    """Items of current receipts by product."""
    period = dates.comparable_period(now)
    current = usable(receipts).where(
        dates.in_current(F.col("transactionDate"), period)).select("id")
    bought = _named_items(items).join(
        current.withColumnRenamed("id", "receiptId"), "receiptId", "left_semi")
    return bought.groupBy(F.col("name").alias("id")).agg(
        F.sum(F.coalesce("totalPriceMinor", F.lit(0))).alias("total"),
        F.sum(F.coalesce("quantity", F.lit(1.0))).alias("quantity"),
        F.count(F.lit(1)).alias("frequency"))


def price_changes(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Latest unit price against the rounded mean of all earlier observations.

    Every priced item counts; one without a usable receipt has the empty date and sorts
    first. The latest is the greatest (date, item id), found by a partial aggregate.
    """
    dated = usable(receipts).select(F.col("id").alias("receiptId"), "transactionDate")
    priced = (_named_items(items).where(F.col("unitPriceMinor").isNotNull())
              .select("receiptId", "id", "name", "unitPriceMinor")
              .join(dated, "receiptId", "left"))
    order = F.struct(F.coalesce("transactionDate", F.lit("")), F.col("id"))
    observed = priced.groupBy(F.col("name").alias("id")).agg(
        F.max_by("unitPriceMinor", order).alias("latest"),
        F.sum("unitPriceMinor").alias("price_sum"), F.count(F.lit(1)).alias("observations"))
    return drifted(observed)


def drifted(observed: DataFrame) -> DataFrame:
    """Price changes of products from their latest price, sum and number of observations."""
    return with_price_change(observed).where(F.col("observations") >= 2).select(
        "id", "latest", "previousAverage", "difference", "changePercent")


def with_price_change(observed: DataFrame) -> DataFrame:
    """Mean of all observations but the latest; null when there is only one."""
    earlier = F.col("observations") - 1
    mean = F.when(earlier >= 1, money.half_up(
        (F.col("price_sum") - F.col("latest")).cast("double") / earlier.cast("double")))
    return observed.withColumn("previousAverage", mean).withColumns({
        "difference": F.col("latest") - F.col("previousAverage"),
        "changePercent": money.percent_change(F.col("latest"), F.col("previousAverage"))})


def product_findings(receipts: DataFrame, items: DataFrame, now: datetime) -> DataFrame:
    """Both product views from one pass over the items: current totals and price drift."""
    return with_price_change(product_summaries(product_lines(receipts, items, now)))


def product_lines(receipts: DataFrame, items: DataFrame, now: datetime,
                  *more: str) -> DataFrame:
    """What each item adds to its product: its figures and the day of its receipt, if usable.

    ``more``: columns that each receipt, usable or not, hands to its items.
    """
    return _named_items(items).join(dated(receipts, now, *more), "receiptId", "left").select(
        "name", "id", "unitPriceMinor", "totalPriceMinor", "quantity", "transactionDate",
        "in_current", *more)


def dated(receipts: DataFrame, now: datetime, *more: str) -> DataFrame:
    """What receipts hand to their items: the day, if usable, and whether it is a current one."""
    period = dates.comparable_period(now)
    good = is_usable()
    day = F.when(good, F.col("transactionDate")).alias("transactionDate")
    heads = receipts if more else usable(receipts)
    return heads.select(F.col("id").alias("receiptId"), day, F.when(
        good, dates.in_current(F.col("transactionDate"), period)).alias("in_current"), *more)


def product_summaries(lines: DataFrame, *by: str) -> DataFrame:
    """Current totals, latest price, price sum and observations of each product (and ``by``)."""
    return placed_summaries(lines, *by).drop("latestDate", "latestItem")


def placed_summaries(lines: DataFrame, *by: str) -> DataFrame:
    """``product_summaries`` with day and item of the latest price, so that they add up."""
    current = F.coalesce("in_current", F.lit(False))
    day = F.coalesce("transactionDate", F.lit("")).alias("day")
    place = F.when(F.col("unitPriceMinor").isNotNull(), F.struct(day, "id", "unitPriceMinor"))
    return lines.groupBy(*by, F.col("name").alias("_name")).agg(
        F.sum(F.when(current, F.coalesce("totalPriceMinor", F.lit(0)))).alias("total"),
        F.count(F.when(current, 1)).alias("frequency"),
        F.sum(F.when(current, F.coalesce("quantity", F.lit(1.0)))).alias("quantity"),
        F.max(place).alias("_place"), F.sum("unitPriceMinor").alias("price_sum"),
        F.count("unitPriceMinor").alias("observations")).select(
        *by, F.col("_name").alias("id"), "total", "frequency", "quantity",
        F.col("_place.unitPriceMinor").alias("latest"), F.col("_place.day").alias("latestDate"),
        F.col("_place.id").alias("latestItem"), "price_sum", "observations")


def added_up(parts: DataFrame) -> DataFrame:
    """Summaries of products from ``placed_summaries`` of parts of their lines."""
    place = F.when(F.col("observations") > 0, F.struct("latestDate", "latestItem"))
    return parts.groupBy("id").agg(
        *[F.sum(c).alias(c) for c in ("total", "frequency", "quantity")],
        F.max_by("latest", place).alias("latest"),
        *[F.sum(c).alias(c) for c in ("price_sum", "observations")])


def by_total(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("total"), "id")


def _price_order() -> tuple[Column, Column]:
    return F.desc(F.abs(F.coalesce("changePercent", F.lit(0.0)))), F.asc("id")


def by_price_change(df: DataFrame) -> DataFrame:
    return df.orderBy(*_price_order())


def positive(df: DataFrame) -> DataFrame:
    return df.where(F.col("total") > 0)


def top_by_total(df: DataFrame, n: int = 5) -> DataFrame:
    """Panel of the first ``n``; plans as a bounded heap in each task."""
    return by_total(df).limit(n)


def top_price_changes(df: DataFrame, n: int = 5) -> DataFrame:
    return by_price_change(df).limit(n)


def category_share(categories: DataFrame) -> DataFrame:
    """Chart data: major units, share of the positive total, colour of the category."""
    spark = categories.sparkSession
    shown = positive(categories)
    whole = shown.agg(F.sum("total")).scalar()
    colours = spark.createDataFrame(list(CATEGORIES), "id string, colour string")
    return shown.join(F.broadcast(colours), "id", "left").select(
        "id", "total", (F.col("total") / 100).alias("amount"),
        (F.col("total").cast("double") / whole.cast("double")).alias("share"),
        F.coalesce("colour", F.lit(DEFAULT_COLOUR)).alias("colour"))


def significant(minimum_minor: int, minimum_percent: float) -> Column:
    percent = F.abs("changePercent")
    return F.coalesce((F.abs("difference") >= minimum_minor) & (percent >= minimum_percent),
                      F.lit(False))


def findings(receipts: DataFrame, items: DataFrame, now: datetime,
             minimum_minor: int = 1000, minimum_percent: float = 20.0) -> DataFrame:
    """The best finding of each type: category, merchant, frequent product, price change."""
    return best_findings(comparison_all(receipts, now), product_findings(receipts, items, now),
                         minimum_minor, minimum_percent)


def best_findings(spending: DataFrame, products: DataFrame, minimum_minor: int = 1000,
                  minimum_percent: float = 20.0) -> DataFrame:
    """``findings`` from compared categories and merchants and from products."""
    passed = significant(minimum_minor, minimum_percent)
    names = ["id", "difference", "changePercent", "total", "frequency"]

    compared = spending.where(F.col("dimension").isin(CATEGORY, MERCHANT) & passed)
    entry = F.struct("id", "difference", "changePercent", "total",
                     F.lit(None).cast("long").alias("frequency"))
    order = F.struct(-F.abs("difference"), -F.col("total"), F.col("id"))
    spending = (compared.groupBy(F.col("dimension").alias("type"))
                .agg(F.min_by(entry, order).alias("best")).select("type", "best.*"))

    blank, none = F.lit(None).cast("long"), F.lit(None).cast("double")
    frequent = F.when(F.col("frequency") >= 2, F.struct(-F.col("frequency"), -F.col("total"),
                                                        F.col("id")))
    changed = F.when(passed, F.struct(-F.abs(F.coalesce("changePercent", F.lit(0.0))),
                                      F.col("id")))
    best = products.agg(
        F.min_by(F.struct("id", blank.alias("difference"), none.alias("changePercent"), "total",
                          "frequency"), frequent).alias("frequency"),
        F.min_by(F.struct("id", "difference", "changePercent", blank.alias("total"),
                          blank.alias("frequency")), changed).alias("price"))
    bought = best.select(F.explode(F.array(
        F.struct(F.lit("frequency").alias("type"), F.col("frequency").alias("best")),
        F.struct(F.lit("price").alias("type"), F.col("price").alias("best")))).alias("found"))
    bought = bought.where(F.col("found.best").isNotNull()).select("found.type", "found.best.*")

    rank = F.array_position(F.array(*[F.lit(t) for t in
                                      (CATEGORY, MERCHANT, "frequency", "price")]),
                            F.col("type")).cast("int")
    found = spending.unionByName(bought)
    return found.select(rank.alias("rank"), "type", *names)


def insight_text(found: DataFrame, currency: str = "EUR") -> DataFrame:
    """One sentence for each finding and language; amounts are plain decimals."""
    spark = found.sparkSession
    up = F.col("difference") > 0
    key = (
        F.when(F.col("type") == "frequency",
               F.when(F.col("frequency") == 1, "insight.frequency_one")
               .otherwise("insight.frequency_other"))
        .otherwise(F.concat(F.lit("insight."), "type", F.when(up, "_up").otherwise("_down"))))
    keyed = found.withColumns({
        "key": key,
        "percent": F.coalesce(money.one_decimal(F.col("changePercent")), F.lit("")),
        "amount": F.concat(money.to_euro(F.abs("difference")), F.lit(f" {currency}")),
    })
    sentences = F.broadcast(catalogue(spark, "insight."))
    labelled = category_labels(keyed.join(sentences, "key"), F.col("id"))
    labelled = merchant_labels(labelled, F.col("id"))
    filled = F.col("text")
    for placeholder, value in (
            ("{{category}}", F.col("category_label")), ("{{merchant}}", F.col("merchant_label")),
            ("{{product}}", F.col("id")), ("{{percent}}", F.col("percent")),
            ("{{amount}}", F.coalesce("amount", F.lit(""))),
            ("{{count}}", F.coalesce(F.col("frequency").cast("string"), F.lit("")))):
        filled = F.replace(filled, F.lit(placeholder), value)
    return labelled.select("rank", "lang", "type", filled.alias("sentence"))


def category_labels(df: DataFrame, category: Column) -> DataFrame:
    """Adds ``category_label`` in the language of column ``lang``; unknown ids read Other."""
    labels = catalogue(df.sparkSession, "category.").select(
        F.col("lang"), F.col("key").alias("category_key"), F.col("text").alias("category_label"))
    known = F.when(category.isin(*[c for c, _ in CATEGORIES]), category).otherwise("other")
    return df.withColumn("category_key", F.concat(F.lit("category."), known)).join(
        F.broadcast(labels), ["lang", "category_key"], "left").drop("category_key")


def merchant_labels(df: DataFrame, merchant: Column) -> DataFrame:
    """Adds ``merchant_label`` in the language of column ``lang``."""
    unknown = catalogue(df.sparkSession, "merchant.unknown").select(
        "lang", F.col("text").alias("unknown_merchant"))
    label = F.when(merchant == UNKNOWN_MERCHANT, F.col("unknown_merchant")).otherwise(merchant)
    return df.join(F.broadcast(unknown), "lang", "left").withColumn(
        "merchant_label", label).drop("unknown_merchant")


def snapshot_rows(receipts: DataFrame, items: DataFrame, now: datetime) -> DataFrame:
    """The snapshot handed to a text model, one JSON entry a row.

    Products and merchants have no size bound, so the snapshot stays distributed; written
    in (section, total, id) order its parts are the arrays of the document.
    """
    compared = comparison_all(receipts, now)
    columns = ["id", "total", "count", "previousTotal", "difference", "changePercent"]
    sections = compared.select(
        F.when(F.col("dimension") == CATEGORY, "categories")
        .when(F.col("dimension") == MERCHANT, "merchants").otherwise("totals")
        .alias("section"), "id", F.to_json(F.struct(*columns)).alias("entry"))
    products = product_totals(receipts, items, now)
    products = products.select(
        F.lit("items").alias("section"), "id",
        F.to_json(F.struct("id", "total", "quantity", "frequency")).alias("entry"))
    prices = price_changes(receipts, items)
    prices = prices.select(
        F.lit("priceChanges").alias("section"), "id",
        F.to_json(F.struct("id", "latest", "previousAverage", "difference", "changePercent"))
        .alias("entry"))
    return sections.unionByName(products).unionByName(prices)


SNAPSHOT_FIGURES = ("total", "count", "previousTotal", "quantityThousandths", "latest",
                    "previousAverage")


def snapshot_measures(receipts: DataFrame, items: DataFrame, now: datetime,
                      locale: str) -> DataFrame:
    """All that the snapshot says as (section, id, whole figures as text, blank where none).

    Differences and percentages follow from these. One pass over the receipts, one over the
    items; the period and the locale are rows of their own.
    """
    def entry(section, present=True, **figures):
        return F.struct(
            F.lit(section).alias("section") if isinstance(section, str) else
            section.alias("section"), F.col("id").alias("id"),
            F.lit(present).alias("present") if isinstance(present, bool) else
            F.coalesce(present, F.lit(False)).alias("present"),
            *[F.coalesce(figures.get(n, F.lit(None)).cast("string"), F.lit("")).alias(n)
              for n in SNAPSHOT_FIGURES])

    compared = comparison_all(receipts, now).select(F.array(entry(
        F.col("dimension"), total=F.col("total"), count=F.col("count"),
        previousTotal=F.col("previousTotal"))).alias("entries"))
    products = product_findings(receipts, items, now).select(F.array(
        entry("items", F.col("frequency") > 0, total=F.col("total"), count=F.col("frequency"),
              quantityThousandths=F.round(F.col("quantity") * 1000).cast("long")),
        entry("priceChanges", F.col("observations") >= 2, latest=F.col("latest"),
              previousAverage=F.col("previousAverage"))).alias("entries"))
    period = dates.comparable_period(now)
    bounds = (period.start, period.end, period.previous_start, period.previous_end)
    texts = (("period", " ".join(b.isoformat() for b in bounds)), ("locale", locale))
    frame = receipts.sparkSession.createDataFrame(list(texts), "kind string, id string")
    settings = frame.select(F.array(entry(F.col("kind"))).alias("entries"))
    return compared.unionByName(products).unionByName(settings).select(
        F.inline("entries")).where("present").drop("present")


def dataset_hash(rows: DataFrame, columns: list[str], language: str | Column,
                 by: list[str] | None = None) -> DataFrame:
    """SHA-256 over a row multiset: independent of order, one partial sum for each task.

    ``by``: one hash for each value of these columns, of which ``language`` may be one.

    Each row's digest is split in four 60-bit lanes; the lanes are summed exactly.
    """
    digest = text.sha256_hex(F.concat_ws("\u001f", *columns))
    lanes = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
             for i in range(4)]
    summed = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(lane).alias(f"lane{i}") for i, lane in enumerate(lanes)])
    parts = [F.coalesce(F.col(f"lane{i}"), F.lit(0)).cast("string") for i in range(4)]
    language = F.lit(language) if isinstance(language, str) else language
    return summed.select(*(by or []), "rows", text.sha256_hex(
        F.concat_ws("|", language, F.col("rows").cast("string"), *parts))
        .alias("datasetHash"))
