"""Registered insight queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tillspark.functions.catalogue import LANGUAGE_ORDER, catalogue_sql
from tillspark.functions.dates import iso_millis
from tillspark.functions.language import locale_for
from tillspark.model import CATEGORIES, DEFAULT_COLOUR
from tillspark.operators import insights, rollup, summary
from tillspark.operators.extraction import ModelUnavailable
from tillspark.plans import views
from tillspark.session import work_dir
from tillspark.sources import adapter
from tillspark.sources.rollups import Rollups

NOW = adapter.NOW


def _receipts(spark, sf_dir):
    return adapter.receipts(spark, sf_dir)


def _period(s, d, now=NOW):
    return adapter.receipts_of_period(s, d, now)


def _items(spark, sf_dir):
    return adapter.receipt_items(spark, sf_dir)


def _comparison(dimension):
    return lambda s, d: insights.comparison(_period(s, d), NOW, dimension)


def _products(s, d):
    return insights.product_totals(_period(s, d), _items(s, d), NOW)


def _edited(receipts):
    """Every seventh receipt is deleted, every fifth of the others costs more on another day."""
    key, day = F.col("id").cast("long"), F.col("transactionDate")
    edited = receipts.where((key % 7 != 0) & (key % 5 == 0)).withColumns({
        "totalMinor": F.col("totalMinor") + 700,
        "transactionDate": F.date_sub(day.cast("date"), 9).cast("string"),
        "categoryId": F.when(key % 10 == 0, "gift").otherwise(F.col("categoryId"))})
    return receipts.where((key % 7 == 0) | (key % 5 == 0)), edited


def _rolled(result):
    """A query on the stored rollup after the edits came in as differences."""
    def run(s, d):
        rollups = Rollups(s, work_dir(s, "rollup"))
        rollups.apply(rollup.daily(_receipts(s, d)), 0)
        rollups.apply(rollup.differences(*_edited(_receipts(s, d))), 1)
        return result(rollups.of_period(NOW))
    return run


def _prices(s, d):
    return insights.price_changes(_receipts(s, d), _items(s, d))


def _snapshot_hash(s, d):
    rows = insights.snapshot_measures(_receipts(s, d), _items(s, d), NOW, "en-GB")
    return insights.dataset_hash(rows, ["section", "id", *insights.SNAPSHOT_FIGURES], "en")


def _snapshot_rows(s, d):
    rows = insights.snapshot_rows(_receipts(s, d), _items(s, d), NOW)
    return rows.select("section", "id", *[
        F.get_json_object("entry", f"$.{name}").cast("long").alias(name)
        for name in ("total", "difference")])


def _known(s, d):
    return adapter.with_known_categories(_receipts(s, d))


def _known_period(s, d):
    return adapter.with_known_categories(_period(s, d))


def _labels_known(s, d):
    """Each category of the comparison with its label in each language."""
    compared = insights.comparison(_known_period(s, d), NOW, insights.CATEGORY)
    languages = F.explode(F.array(*map(F.lit, LANGUAGE_ORDER)))
    return insights.category_labels(compared.select("id", "total", languages.alias("lang")),
                                    F.col("id"))


def _owners(s, d):
    """Settings of all customers; some have a locale that was never migrated."""
    raw = F.col("locale")
    return adapter.settings(s, d).withColumn(
        "locale", F.when(raw == "pt-BR", raw).otherwise(locale_for(raw))).select(
        "id", "locale", "aiSummary")


def _summarise(content, mime_type, prompt):
    """A model that counts what the snapshot lists, and sometimes fails."""
    snapshot = json.loads(prompt.split("Dati aggregati:\n", 1)[1])
    if snapshot["total"] % 11 == 1:
        raise ModelUnavailable("busy")
    if snapshot["total"] % 7 == 1:
        return "no summary"
    observations = [f"{len(snapshot['items'])} products",
                    f"{len(snapshot['categories'])} categories"]
    observations += [f"price of {p['id']}" for p in snapshot["priceChanges"][:1]]
    merchants = [m["id"] for m in snapshot["merchants"][:1]]
    return json.dumps({"observations": observations,
                       "suggestion": merchants[0] if merchants else None})


def _step(part):
    def run(s, d):
        return summary.insight_step(_owners(s, d), adapter.owned_receipts(s, d), _items(s, d),
                                    _summarise, NOW)[part]
    return run


QUERIES = {
    "insight_step": _step(0),
    "insight_step_outcomes": lambda s, d: _step(1)(s, d).withColumn(
        "violations", F.array_join("violations", ",")),
    "category_share_known": lambda s, d: insights.category_share(
        insights.comparison(_known_period(s, d), NOW, insights.CATEGORY)),
    "category_labels_known": _labels_known,
    "insight_text_known": lambda s, d: insights.insight_text(
        insights.findings(_known(s, d), _items(s, d), NOW)),
    "receipts_view": lambda s, d: _receipts(s, d).drop(
        "warnings", "ai", "subtotalMinor", "taxMinor", "discountMinor", "overallConfidence"),
    "items_view": lambda s, d: _items(s, d).drop("confidence"),
    "period_totals": lambda s, d: insights.period_totals(_period(s, d), NOW),
    "period_totals_morning": lambda s, d: insights.period_totals(
        _period(s, d), NOW.replace(hour=11, minute=59, second=59)),
    "period_totals_clamped": lambda s, d: insights.period_totals(
        _period(s, d, NOW.replace(month=3, day=31)), NOW.replace(month=3, day=31)),
    "category_comparison": _comparison(insights.CATEGORY),
    "merchant_comparison": _comparison(insights.MERCHANT),
    "comparison_grouping_sets": lambda s, d: insights.comparison_all(_period(s, d), NOW),
    "product_totals": _products,
    "price_changes": _prices,
    "findings": lambda s, d: insights.findings(_receipts(s, d), _items(s, d), NOW),
    "category_share": lambda s, d: insights.category_share(
        insights.comparison(_period(s, d), NOW, insights.CATEGORY)),
    "top_categories": lambda s, d: insights.top_by_total(insights.positive(
        insights.comparison(_period(s, d), NOW, insights.CATEGORY))),
    "top_merchants": lambda s, d: insights.top_by_total(insights.positive(
        insights.comparison(_period(s, d), NOW, insights.MERCHANT))),
    "top_products": lambda s, d: insights.top_by_total(_products(s, d)),
    "top_price_changes": lambda s, d: insights.top_price_changes(_prices(s, d)),
    "insight_text": lambda s, d: insights.insight_text(
        insights.findings(_receipts(s, d), _items(s, d), NOW)),
    "snapshot_hash": _snapshot_hash,
    "snapshot_rows": _snapshot_rows,
    "rollup_period_totals": _rolled(lambda rows: rollup.period_totals(rows, NOW)),
    "rollup_category_comparison": _rolled(
        lambda rows: rollup.comparison(rows, NOW, insights.CATEGORY)),
    "rollup_merchant_comparison": _rolled(
        lambda rows: rollup.comparison(rows, NOW, insights.MERCHANT)),
}

CHANGE = """total - "previousTotal" AS difference,
  CASE WHEN "previousTotal" = 0 THEN CASE WHEN total = 0 THEN 0e0 END
    ELSE CAST(total - "previousTotal" AS DOUBLE) / CAST("previousTotal" AS DOUBLE) * 100e0 END
    AS "changePercent\""""


def _flagged(last="2001-07-14", start="2001-07-01", prev="2001-06-01", prev_end="2001-06-14"):
    return f"""flagged AS (
  SELECT *, CASE WHEN "categoryId" = '' THEN 'other' ELSE coalesce("categoryId", 'other') END
      AS category,
    coalesce(nullif("merchantNormalized", ''), nullif("merchantRaw", ''),
      '__unknown_merchant__') AS merchant,
    "transactionDate" >= '{start}' AS in_current
  FROM receipts
  WHERE "totalMinor" IS NOT NULL AND "transactionDate" IS NOT NULL
    AND ("transactionDate" BETWEEN '{start}' AND '{last}'
      OR "transactionDate" BETWEEN '{prev}' AND '{prev_end}'))"""


def _grouped(key: str, name: str = "grouped") -> str:
    return f"""{name} AS (
  SELECT {key} AS id,
    CAST(coalesce(sum("totalMinor") FILTER (WHERE in_current), 0) AS BIGINT) AS total,
    count(*) FILTER (WHERE in_current) AS count,
    CAST(coalesce(sum("totalMinor") FILTER (WHERE NOT in_current), 0) AS BIGINT)
      AS "previousTotal"
  FROM flagged GROUP BY 1)"""


def _totals(start, end, prev, prev_end, last=None):
    return views.sql(f"""SELECT total, "previousTotal", {CHANGE}, '{start}' AS start,
  '{end}' AS "end", '{prev}' AS "previousStart", '{prev_end}' AS "previousEnd"
FROM grouped""", views.RECEIPTS, _flagged(last or end, start, prev, prev_end), _grouped("1"))


def _compared(key, tail=""):
    return views.sql(f'SELECT id, total, count, "previousTotal", {CHANGE} FROM grouped {tail}',
                     views.RECEIPTS, _flagged(), _grouped(key))


PRODUCTS = """named AS (
  SELECT *, trim(coalesce(nullif("normalizedName", ''), "rawName", '')) AS name FROM items),
products AS (
  SELECT name AS id, CAST(sum(coalesce("totalPriceMinor", 0)) AS BIGINT) AS total,
    sum(coalesce(quantity, 1e0)) AS quantity, count(*) AS frequency
  FROM named WHERE name <> '' AND "receiptId" IN (
    SELECT id FROM receipts WHERE "totalMinor" IS NOT NULL
      AND "transactionDate" BETWEEN '2001-07-01' AND '2001-07-14')
  GROUP BY 1)"""

PRICES = """observed AS (
  SELECT n.name, n."unitPriceMinor" AS price, row_number() OVER (PARTITION BY n.name
      ORDER BY coalesce(r."transactionDate", '') DESC, n.id DESC) AS back
  FROM named n LEFT JOIN receipts r ON r.id = n."receiptId" AND r."totalMinor" IS NOT NULL
  WHERE n.name <> '' AND n."unitPriceMinor" IS NOT NULL),
averaged AS (
  SELECT name AS id, max(price) FILTER (WHERE back = 1) AS latest,
    CAST(floor(CAST(sum(price) FILTER (WHERE back > 1) AS DOUBLE)
      / CAST(count(*) - 1 AS DOUBLE) + 0.5e0) AS BIGINT) AS "previousAverage"
  FROM observed GROUP BY 1 HAVING count(*) >= 2),
prices AS (
  SELECT id, latest, "previousAverage", latest - "previousAverage" AS difference,
    CASE WHEN "previousAverage" = 0 THEN CASE WHEN latest = 0 THEN 0e0 END
      ELSE CAST(latest - "previousAverage" AS DOUBLE) / CAST("previousAverage" AS DOUBLE)
        * 100e0 END AS "changePercent"
  FROM averaged)"""

FOUND = f"""cats AS (SELECT *, {CHANGE} FROM by_category),
merch AS (SELECT *, {CHANGE} FROM by_merchant),
found AS (
  (SELECT 1 AS rank, 'category' AS type, id, difference, "changePercent", total,
     CAST(NULL AS BIGINT) AS frequency FROM cats
   WHERE abs(difference) >= 1000 AND abs("changePercent") >= 20
   ORDER BY abs(difference) DESC, total DESC, id LIMIT 1)
  UNION ALL
  (SELECT 2, 'merchant', id, difference, "changePercent", total, NULL FROM merch
   WHERE abs(difference) >= 1000 AND abs("changePercent") >= 20
   ORDER BY abs(difference) DESC, total DESC, id LIMIT 1)
  UNION ALL
  (SELECT 3, 'frequency', id, NULL, NULL, total, frequency FROM products
   WHERE frequency >= 2 ORDER BY frequency DESC, total DESC, id LIMIT 1)
  UNION ALL
  (SELECT 4, 'price', id, difference, "changePercent", NULL, NULL FROM prices
   WHERE abs(difference) >= 1000 AND abs("changePercent") >= 20
   ORDER BY abs("changePercent") DESC, id LIMIT 1))"""

_FOUND_VIEWS = (views.RECEIPTS, views.ITEMS, _flagged(), _grouped("category", "by_category"),
                _grouped("merchant", "by_merchant"), PRODUCTS, PRICES, FOUND)

_SENTENCE = f"""SELECT rank, lang, type, replace(replace(replace(replace(replace(replace(text,
    '{{{{category}}}}', category_label), '{{{{merchant}}}}', merchant_label),
    '{{{{product}}}}', id), '{{{{percent}}}}', percent), '{{{{amount}}}}', amount),
    '{{{{count}}}}', coalesce(CAST(frequency AS VARCHAR), '')) AS sentence
FROM (SELECT f.*, t.lang, t.text,
    coalesce(printf('%d.%02d EUR', abs(difference) // 100, abs(difference) % 100), '') AS amount,
    coalesce(CASE WHEN tenths % 10 = 0 THEN CAST(tenths // 10 AS VARCHAR)
      ELSE (tenths // 10) || '.' || (tenths % 10) END, '') AS percent,
    (SELECT c.text FROM {catalogue_sql("category.")} WHERE c.lang = t.lang
       AND c.key = 'category.other') AS category_label,
    CASE WHEN f.id = '__unknown_merchant__' THEN (SELECT m.text FROM
       {catalogue_sql("merchant.")} WHERE m.lang = t.lang) ELSE f.id END AS merchant_label
  FROM (SELECT *, CAST(floor(abs("changePercent") * 10 + 0.5e0) AS BIGINT) AS tenths
        FROM found) f
  JOIN {catalogue_sql("insight.")} ON t.key = CASE WHEN type = 'frequency'
    THEN CASE WHEN frequency = 1 THEN 'insight.frequency_one' ELSE 'insight.frequency_other' END
    ELSE 'insight.' || type || CASE WHEN difference > 0 THEN '_up' ELSE '_down' END END)"""
_SENTENCE = (_SENTENCE.replace("catalogue(lang, key, text) WHERE c.", "c(lang, key, text) WHERE c.")
             .replace("catalogue(lang, key, text) WHERE m.", "m(lang, key, text) WHERE m.")
             .replace("catalogue(lang, key, text) ON t.", "t(lang, key, text) ON t."))

_LANES = " || '|' || ".join(
    f"CAST(sum(CAST(('0x' || substr(digest, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR)"
    for i in range(4))

_KNOWN_RECEIPTS = views.RECEIPTS.replace("c_mktsegment END", "CASE c_mktsegment " + " ".join(
    f"WHEN '{segment}' THEN '{category}'"
    for segment, category in adapter.SEGMENT_CATEGORIES.items()) + " ELSE c_mktsegment END END")
_COLOURS = "(VALUES " + ", ".join(f"('{c}', '{colour}')" for c, colour in CATEGORIES) + ")"
_LABEL_KEY = "'category.' || CASE WHEN {0} IN (" + ", ".join(
    f"'{c}'" for c, _ in CATEGORIES) + ") THEN {0} ELSE 'other' END"

_EDITED_RECEIPTS = views.RECEIPTS.replace("receipts AS (", "before AS (", 1) + """,
receipts AS (SELECT * REPLACE (
    CASE WHEN edited THEN "totalMinor" + 700 ELSE "totalMinor" END AS "totalMinor",
    CASE WHEN edited THEN strftime(CAST("transactionDate" AS DATE) - 9, '%Y-%m-%d')
      ELSE "transactionDate" END AS "transactionDate",
    CASE WHEN edited AND CAST(id AS BIGINT) % 10 = 0 THEN 'gift' ELSE "categoryId" END
      AS "categoryId")
  FROM (SELECT *, CAST(id AS BIGINT) % 5 = 0 AS edited FROM before
    WHERE CAST(id AS BIGINT) % 7 <> 0))"""


_OWNED_RECEIPTS = views.RECEIPTS.replace(
    """AS "updatedByDevice"\n""", """AS "updatedByDevice", 's-' || o_custkey AS owner\n""")


def _by_owner(key: str, name: str) -> str:
    return _grouped(key, name).replace(f"SELECT {key} AS id", f"SELECT owner, {key} AS id") \
        .replace("GROUP BY 1", "GROUP BY 1, 2")


_OWNER_PRODUCTS = """named AS (
  SELECT i.*, r.owner, trim(coalesce(nullif("normalizedName", ''), "rawName", '')) AS name,
    CASE WHEN "totalMinor" IS NOT NULL THEN "transactionDate" END AS day
  FROM items i JOIN receipts r ON r.id = i."receiptId"),
products AS (
  SELECT owner, name AS id, CAST(sum(coalesce("totalPriceMinor", 0)) AS BIGINT) AS total,
    sum(coalesce(quantity, 1e0)) AS quantity, count(*) AS frequency
  FROM named WHERE name <> '' AND day BETWEEN '2001-07-01' AND '2001-07-14' GROUP BY 1, 2),
observed AS (
  SELECT owner, name, "unitPriceMinor" AS price, row_number() OVER (
    PARTITION BY owner, name ORDER BY coalesce(day, '') DESC, id DESC) AS back
  FROM named WHERE name <> '' AND "unitPriceMinor" IS NOT NULL),
prices AS (
  SELECT owner, name AS id, max(price) FILTER (WHERE back = 1) AS latest,
    CAST(floor(CAST(sum(price) FILTER (WHERE back > 1) AS DOUBLE)
      / CAST(count(*) - 1 AS DOUBLE) + 0.5e0) AS BIGINT) AS average
  FROM observed GROUP BY 1, 2 HAVING count(*) >= 2)"""

_STEPPED = f"""heads AS (
  SELECT id AS owner, "aiSummary", ['it-IT', 'fr-FR', 'de-DE', 'pt-BR', 'en-GB', 'es-ES',
    'en-GB'][CAST(CAST(substr(id, 3) AS BIGINT) % 7 + 1 AS INTEGER)] AS locale FROM settings),
said AS (
  SELECT owner, 'category' AS section, id, total, count, "previousTotal",
    CAST(NULL AS BIGINT) AS thousandths, CAST(NULL AS BIGINT) AS latest,
    CAST(NULL AS BIGINT) AS average FROM by_category
  UNION ALL SELECT owner, 'merchant', id, total, count, "previousTotal", NULL, NULL, NULL
    FROM by_merchant
  UNION ALL SELECT owner, 'all', 'all', total, count, "previousTotal", NULL, NULL, NULL
    FROM by_owner
  UNION ALL SELECT owner, 'items', id, total, frequency, NULL,
    CAST(round(quantity * 1000) AS BIGINT), NULL, NULL FROM products
  UNION ALL SELECT owner, 'priceChanges', id, NULL, NULL, NULL, NULL, latest, average FROM prices
  UNION ALL SELECT owner, 'period', '2001-07-01 2001-07-14 2001-06-01 2001-06-14', NULL, NULL,
    NULL, NULL, NULL, NULL FROM heads
  UNION ALL SELECT owner, 'locale', locale, NULL, NULL, NULL, NULL, NULL, NULL FROM heads),
hashes AS (
  SELECT owner, count(*) AS rows, {_LANES} AS lanes FROM (
    SELECT owner, sha256(concat_ws(chr(31), section, id, coalesce(CAST(total AS VARCHAR), ''),
      coalesce(CAST(count AS VARCHAR), ''), coalesce(CAST("previousTotal" AS VARCHAR), ''),
      coalesce(CAST(thousandths AS VARCHAR), ''), coalesce(CAST(latest AS VARCHAR), ''),
      coalesce(CAST(average AS VARCHAR), ''))) AS digest FROM said) GROUP BY owner),
first_price AS (
  SELECT owner, id FROM (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY
    abs(coalesce(CASE WHEN average = 0 THEN CASE WHEN latest = 0 THEN 0e0 END
      ELSE CAST(latest - average AS DOUBLE) / CAST(average AS DOUBLE) * 100e0 END, 0e0)) DESC, id)
    AS place FROM prices) WHERE place = 1),
first_merchant AS (
  SELECT owner, id FROM (SELECT owner, id, row_number() OVER (PARTITION BY owner
    ORDER BY total DESC, id) AS place FROM by_merchant) WHERE place = 1),
counted AS (
  SELECT owner, count(*) FILTER (WHERE section = 'items') AS products,
    count(*) FILTER (WHERE section = 'category') AS categories,
    coalesce(max(total) FILTER (WHERE section = 'all'), 0) AS total FROM said GROUP BY owner),
stepped AS (
  SELECT h.owner AS id, h.locale, h."aiSummary", CASE WHEN h.locale = 'pt-BR'
      THEN 'invalid_request' WHEN total % 11 = 1 THEN 'http' WHEN total % 7 = 1 THEN 'invalid' END
    AS failure,
    '{{"observations":["' || products || ' products","' || categories || ' categories"'
      || coalesce(',"price of ' || p.id || '"', '') || '],"suggestion":'
      || coalesce('"' || m.id || '"', 'null') || ',"datasetHash":"'
      || sha256(CASE WHEN h.locale = 'pt-BR' THEN 'en' ELSE substr(h.locale, 1, 2) END || '|'
        || rows || '|' || lanes) || '","generatedAt":"{iso_millis(NOW)}"}}' AS summary
  FROM heads h JOIN counted c ON c.owner = h.owner JOIN hashes k ON k.owner = h.owner
  LEFT JOIN first_price p ON p.owner = h.owner LEFT JOIN first_merchant m ON m.owner = h.owner)"""
_STEP_VIEWS = (_OWNED_RECEIPTS, views.ITEMS, views.SETTINGS, _flagged(),
               _by_owner("category", "by_category"), _by_owner("merchant", "by_merchant"),
               _by_owner("1", "by_owner"), _OWNER_PRODUCTS, _STEPPED)


def _edited_sql(name):
    return ORACLE[name].replace(views.RECEIPTS, _EDITED_RECEIPTS)


ORACLE = {
    "insight_step": views.sql(
        """SELECT id, locale, CASE WHEN failure IS NULL THEN summary ELSE "aiSummary" END
  AS "aiSummary" FROM stepped""", *_STEP_VIEWS),
    "insight_step_outcomes": views.sql(
        """SELECT id, CASE WHEN failure IS NULL THEN 'saved' ELSE 'unavailable' END AS status,
  failure, CASE failure WHEN 'invalid_request' THEN 'locale' WHEN 'invalid' THEN 'not_json_object'
    ELSE '' END AS violations FROM stepped""", *_STEP_VIEWS),
    "category_share_known": views.sql(
        f"""SELECT id, total, total / 100e0 AS amount,
  CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS share,
  coalesce(colour, '{DEFAULT_COLOUR}') AS colour
FROM grouped LEFT JOIN {_COLOURS} AS colours(known, colour) ON known = id WHERE total > 0""",
        _KNOWN_RECEIPTS, _flagged(), _grouped("category")),
    "category_labels_known": views.sql(
        f"""SELECT id, total, lang, text AS category_label FROM grouped
JOIN {catalogue_sql("category.")} ON key = {_LABEL_KEY.format("id")}""",
        _KNOWN_RECEIPTS, _flagged(), _grouped("category")),
    "insight_text_known": views.sql(
        _SENTENCE.replace("c.key = 'category.other'", "c.key = " + _LABEL_KEY.format("f.id")),
        _KNOWN_RECEIPTS, *_FOUND_VIEWS[1:]),
    "receipts_view": views.sql("SELECT * FROM receipts", views.RECEIPTS),
    "items_view": views.sql("SELECT * FROM items", views.ITEMS),
    "period_totals": _totals("2001-07-01", "2001-07-14", "2001-06-01", "2001-06-14"),
    "period_totals_morning": _totals("2001-07-01", "2001-07-14", "2001-06-01", "2001-06-14",
                                     "2001-07-13"),
    "period_totals_clamped": _totals("2001-03-01", "2001-03-31", "2001-02-01", "2001-02-28"),
    "category_comparison": _compared("category"),
    "merchant_comparison": _compared("merchant"),
    "comparison_grouping_sets": views.sql(
        f"""SELECT dimension, id, total, count, "previousTotal", {CHANGE} FROM (
  SELECT 'category' AS dimension, * FROM by_category UNION ALL
  SELECT 'merchant', * FROM by_merchant UNION ALL
  SELECT 'all', 'all', total, count, "previousTotal" FROM by_nothing)""",
        views.RECEIPTS, _flagged(), _grouped("category", "by_category"),
        _grouped("merchant", "by_merchant"), _grouped("1", "by_nothing")),
    "product_totals": views.sql("SELECT * FROM products", views.RECEIPTS, views.ITEMS, PRODUCTS),
    "price_changes": views.sql("SELECT * FROM prices", views.RECEIPTS, views.ITEMS, PRODUCTS,
                               PRICES),
    "findings": views.sql("SELECT * FROM found", *_FOUND_VIEWS),
    "category_share": views.sql(
        """SELECT id, total, total / 100e0 AS amount,
  CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS share, '#64748b' AS colour
FROM grouped WHERE total > 0""", views.RECEIPTS, _flagged(), _grouped("category")),
    "top_categories": _compared("category", "WHERE total > 0 ORDER BY total DESC, id LIMIT 5"),
    "top_merchants": _compared("merchant", "WHERE total > 0 ORDER BY total DESC, id LIMIT 5"),
    "top_products": views.sql("SELECT * FROM products ORDER BY total DESC, id LIMIT 5",
                              views.RECEIPTS, views.ITEMS, PRODUCTS),
    "top_price_changes": views.sql(
        """SELECT * FROM prices ORDER BY abs(coalesce("changePercent", 0)) DESC, id LIMIT 5""",
        views.RECEIPTS, views.ITEMS, PRODUCTS, PRICES),
    "insight_text": views.sql(_SENTENCE, *_FOUND_VIEWS),
    "snapshot_rows": views.sql(
        """SELECT section, id, total, total - "previousTotal" AS difference FROM (
  SELECT 'categories' AS section, * FROM by_category UNION ALL
  SELECT 'merchants', * FROM by_merchant UNION ALL
  SELECT 'totals', 'all', total, count, "previousTotal" FROM by_nothing UNION ALL
  SELECT 'items', id, total, frequency, NULL FROM products)
UNION ALL SELECT 'priceChanges', id, NULL, difference FROM prices""",
        views.RECEIPTS, views.ITEMS, _flagged(), _grouped("category", "by_category"),
        _grouped("merchant", "by_merchant"), _grouped("1", "by_nothing"), PRODUCTS, PRICES),
    "snapshot_hash": views.sql(
        f"""SELECT count(*) AS rows, sha256('en|' || count(*) || '|' || {_LANES})
  AS "datasetHash"
FROM (SELECT sha256(concat_ws(chr(31), section, id, coalesce(CAST(total AS VARCHAR), ''),
    coalesce(CAST(count AS VARCHAR), ''), coalesce(CAST("previousTotal" AS VARCHAR), ''),
    coalesce(CAST(thousandths AS VARCHAR), ''), coalesce(CAST(latest AS VARCHAR), ''),
    coalesce(CAST(average AS VARCHAR), ''))) AS digest
  FROM (SELECT 'category' AS section, id, total, count, "previousTotal",
      CAST(NULL AS BIGINT) AS thousandths, CAST(NULL AS BIGINT) AS latest,
      CAST(NULL AS BIGINT) AS average FROM by_category UNION ALL
    SELECT 'merchant', id, total, count, "previousTotal", NULL, NULL, NULL
      FROM by_merchant UNION ALL
    SELECT 'all', 'all', total, count, "previousTotal", NULL, NULL, NULL
      FROM by_nothing UNION ALL
    SELECT 'items', id, total, frequency, NULL, CAST(round(quantity * 1000) AS BIGINT), NULL,
      NULL FROM products UNION ALL
    SELECT 'priceChanges', id, NULL, NULL, NULL, NULL, latest, "previousAverage"
      FROM prices UNION ALL
    SELECT 'period', '2001-07-01 2001-07-14 2001-06-01 2001-06-14', NULL, NULL, NULL, NULL,
      NULL, NULL UNION ALL
    SELECT 'locale', 'en-GB', NULL, NULL, NULL, NULL, NULL, NULL))""",
        views.RECEIPTS, views.ITEMS, _flagged(), _grouped("category", "by_category"),
        _grouped("merchant", "by_merchant"), _grouped("1", "by_nothing"), PRODUCTS, PRICES),
}
ORACLE |= {f"rollup_{name}": _edited_sql(name)
           for name in ("period_totals", "category_comparison", "merchant_comparison")}
