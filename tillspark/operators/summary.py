"""Generated summaries as one step: the figures of each owner, their hash, the prompt, the reply,
its contract and the stored value.

A snapshot is one document, because a model takes one prompt. Its lists grow with what an owner
bought, so owners are counted before any list is built: one with more than ``max_entries`` entries
is an outcome of its own and never gathered in one row. The hash is summed over rows and has no
such bound.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions import dates
from tillspark.functions.language import normalize_language
from tillspark.operators import contract, extraction, insights, maintenance
from tillspark.operators.insights import CATEGORY, MERCHANT
from tillspark.session import cut_lineage

MAX_ENTRIES = 2_000
FIGURES = (*insights.SNAPSHOT_FIGURES, "quantity")
TOO_LARGE = "too_large"


def _entry(section: str | Column, **figures: Column) -> list[Column]:
    name = F.lit(section) if isinstance(section, str) else section
    blank = F.lit(None)
    return [F.col("owner"), name.alias("section"), F.col("id"), *[
        figures.get(n, blank).cast("double" if n == "quantity" else "long").alias(n)
        for n in FIGURES]]


def owner_figures(receipts: DataFrame, items: DataFrame, now: datetime) -> DataFrame:
    """(owner, section, id, figures): what each owner's snapshot says, as rows.

    ``receipts`` has a column ``owner``; rows without one, and items without a receipt, belong to
    nobody's snapshot. One pass over the receipts of the periods and one over the items.
    """
    owned = receipts.where(F.col("owner").isNotNull())
    keyed = insights.both_periods(owned, now).withColumns(insights.spending_keys())
    spent = keyed.groupingSets(
        [[F.col("owner"), F.col(CATEGORY)], [F.col("owner"), F.col(MERCHANT)], [F.col("owner")]],
        "owner", CATEGORY, MERCHANT).agg(F.grouping_id().alias("gid"), *insights.measures())
    section = F.when(F.col("gid") == 1, CATEGORY).when(F.col("gid") == 2, MERCHANT) \
        .otherwise("all")
    key = F.when(F.col("gid") == 1, F.col(CATEGORY)).when(F.col("gid") == 2, F.col(MERCHANT)) \
        .otherwise("all")
    spending = spent.withColumns({"section": section, "id": key}).select(*_entry(
        F.col("section"), **{n: F.col(n) for n in ("total", "count", "previousTotal")}))

    lines = insights.product_lines(owned, items, now, "owner")
    products = insights.with_price_change(insights.product_summaries(
        lines.where(F.col("owner").isNotNull()), "owner"))
    bought = products.where("frequency > 0").select(*_entry(
        "items", total=F.col("total"), count=F.col("frequency"), quantity=F.col("quantity"),
        quantityThousandths=F.round(F.col("quantity") * 1000)))
    priced = products.where("observations >= 2").select(*_entry(
        "priceChanges", latest=F.col("latest"), previousAverage=F.col("previousAverage")))
    return spending.unionByName(bought).unionByName(priced)


def owner_hashes(settings: DataFrame, figures: DataFrame, now: datetime) -> DataFrame:
    """(owner, datasetHash): over the figures, the period, the locale and the language."""
    period = dates.comparable_period(now)
    bounds = " ".join(d.isoformat() for d in (period.start, period.end, period.previous_start,
                                              period.previous_end))
    language = F.coalesce(normalize_language(F.col("locale")), F.lit("en")).alias("language")
    heads = settings.select(F.col("id").alias("owner"), "locale", language)
    texts = heads.select("owner", F.inline(F.array(
        F.struct(F.lit("period").alias("section"), F.lit(bounds).alias("id")),
        F.struct(F.lit("locale").alias("section"), F.coalesce("locale", F.lit("")).alias("id")))))
    columns = ["section", "id", *insights.SNAPSHOT_FIGURES]
    rows = figures.select("owner", "section", "id", *[
        F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n)
        for n in insights.SNAPSHOT_FIGURES])
    rows = rows.unionByName(texts.select("owner", "section", "id", *[
        F.lit("").alias(n) for n in insights.SNAPSHOT_FIGURES]))
    rows = rows.join(heads.select("owner", "language"), "owner")
    return insights.dataset_hash(rows, columns, F.col("language"), ["owner", "language"]).select(
        "owner", "datasetHash")


def _sorted(section: str, first: Column, names: list[str]) -> Column:
    """The entries of a section in order, as structs of ``names``."""
    entry = F.when(F.col("section") == section, F.struct(first.alias("_order"), *names))
    ordered = F.array_sort(F.collect_list(entry))
    return F.transform(ordered, lambda e: F.struct(*[e[n].alias(n) for n in names]))


def snapshots(settings: DataFrame, figures: DataFrame, now: datetime) -> DataFrame:
    """(owner, locale, snapshot): the document of each owner; one without receipts has zeros."""
    period = dates.comparable_period(now)
    changed = insights.with_change(figures)
    drift = F.col("section") == "priceChanges"
    difference = F.col("latest") - F.col("previousAverage")
    changed = changed.withColumns({
        "difference": F.when(drift, difference).otherwise(F.col("difference")),
        "changePercent": F.when(drift, insights.money.percent_change(
            F.col("latest"), F.col("previousAverage"))).otherwise(F.col("changePercent")),
        "frequency": F.col("count")})
    spent = ["id", "total", "count", "previousTotal", "difference", "changePercent"]
    largest, steepest = -F.col("total"), -F.abs(F.coalesce("changePercent", F.lit(0.0)))
    whole = F.col("section") == "all"
    lists = changed.groupBy("owner").agg(
        F.max(F.when(whole, F.col("total"))).alias("total"),
        F.max(F.when(whole, F.col("previousTotal"))).alias("previousTotal"),
        _sorted(CATEGORY, largest, spent).alias("categories"),
        _sorted(MERCHANT, largest, spent).alias("merchants"),
        _sorted("items", largest, ["id", "total", "quantity", "frequency"]).alias("items"),
        _sorted("priceChanges", steepest, ["id", "latest", "previousAverage", "difference",
                                           "changePercent"]).alias("priceChanges"))
    heads = settings.select(F.col("id").alias("owner"), "locale").join(lists, "owner", "left")
    bounds = {"start": period.start, "end": period.end, "previousStart": period.previous_start,
              "previousEnd": period.previous_end}
    none = F.lit(0).cast("long")
    document = F.struct(
        "locale", F.struct(*[F.lit(v.isoformat()).alias(n) for n, v in bounds.items()])
        .alias("period"), F.coalesce("total", none).alias("total"),
        F.coalesce("previousTotal", none).alias("previousTotal"),
        *[F.coalesce(F.col(n), F.array().cast(lists.schema[n].dataType)).alias(n)
          for n in contract.SNAPSHOT_LISTS])
    return heads.select("owner", "locale", F.to_json(
        document, {"ignoreNullFields": "false"}).alias("snapshot"))


def insight_step(settings: DataFrame, receipts: DataFrame, items: DataFrame,
                 call: Callable[[bytes, str, str], str], now: datetime,
                 max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(settings afterwards, outcome of each of its rows).

    ``settings``: unique ids, which are the owners of the receipts, with locale and aiSummary.
    The model is called once for each owner whose snapshot keeps the contract, as in the extraction
    step; a reply that keeps its contract becomes ``aiSummary``. Whatever went wrong leaves the
    old summary. An outcome is (id, status ``saved`` or ``unavailable``, failure, violations).
    """
    figures = cut_lineage(owner_figures(receipts, items, now), "summary-figures")
    large = figures.groupBy("owner").count().where(F.col("count") > max_entries).select("owner")
    large = cut_lineage(large, "summary-large")
    left = settings.join(large.withColumnRenamed("owner", "id"), "id", "left_anti")
    checked = cut_lineage(contract.validate_snapshots(
        snapshots(left, figures.join(large, "owner", "left_anti"), now)), "summary-snapshots")
    good = F.size("violations") == 0
    requests = checked.where(good).select(
        F.col("owner").alias("job_id"), F.lit(None).cast("string").alias("receipt_id"),
        F.lit(b"").alias("content"), F.lit("application/json").alias("mimeType"),
        extraction.insight_prompt(F.col("locale"), F.col("snapshot")).alias("prompt"))
    replies = cut_lineage(extraction.call_model(requests, call), "summary-replies")
    answered = cut_lineage(contract.validate_summaries(
        replies.where(F.col("failure").isNull()), "reply"), "summary-answers")

    parsed = F.from_json("reply", "observations array<string>, suggestion string")
    hashes = owner_hashes(settings, figures, now)
    summaries = answered.where(good).select(F.col("job_id").alias("owner"), parsed.alias("s")) \
        .select("owner", F.coalesce("s.observations", F.array().cast("array<string>"))
                .alias("observations"), "s.suggestion").join(hashes, "owner")
    stored = maintenance.stored_summary(summaries, F.col("datasetHash"), now).select(
        F.col("owner").alias("id"), F.col("aiSummary").alias("_new"))
    after = settings.join(stored, "id", "left").withColumn(
        "aiSummary", F.coalesce("_new", "aiSummary")).select(*settings.columns)

    def outcome(rows: DataFrame, owner: str, failure: Column, violations: Column) -> DataFrame:
        return rows.select(
            F.col(owner).alias("id"),
            F.when(failure.isNull(), "saved").otherwise("unavailable").alias("status"),
            failure.alias("failure"), violations.alias("violations"))

    none = F.array().cast("array<string>")
    outcomes = outcome(large.join(settings.select(F.col("id").alias("owner")), "owner",
                                  "left_semi"), "owner", F.lit(TOO_LARGE), none)
    for rows, owner, failure, violations in (
            (checked.where(~good), "owner", F.lit("invalid_request"), F.col("violations")),
            (replies.where(F.col("failure").isNotNull()), "job_id", F.col("failure"), none),
            (answered, "job_id", F.when(~good, "invalid"), F.col("violations"))):
        outcomes = outcomes.unionByName(outcome(rows, owner, failure, violations))
    return after, outcomes
