"""Validation of model replies and requests as columns of broken rule names.

A reply is parsed once into a variant. ``from_json`` turns a value of the wrong type into
null; the variant keeps its type, so a wrong value and a missing one stay apart. Types are
taken strictly: a text ``"12"`` or a ``1.0`` is not an integer. The entries of a list are read
and judged within one expression, so that rows carry the verdict and not the entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions.once import bound, settle
from tillspark.functions.text import is_currency, is_sha256, trim_blank
from tillspark.model import (CATEGORY_MAX, EXTRACTED_ITEM, EXTRACTED_ITEMS_MAX, EXTRACTION,
                             MAX_UPLOAD_BYTES, NAME_MAX, SUPPORTED_LOCALES, WARNINGS_MAX)

DATE_PATTERN = r"\A\d{4}-\d{2}-\d{2}\z"
MAP = "map<string,variant>"
MERCHANT_FIELDS = ("rawName", "normalizedName")
NESTED = ("merchant", "items")


@dataclass(frozen=True)
class Rules:
    """The server fills absent fields and forbids others; the client needs every field."""

    absent_ok: bool = True
    extra_ok: bool = False
    limit_texts: bool = True
    limit_warnings: bool = True


SERVER = Rules()
CLIENT = Rules(absent_ok=False, extra_ok=True, limit_texts=False, limit_warnings=False)


def clean_reply(reply: Column) -> Column:
    """Drops blanks and a code fence around the text."""
    trimmed = trim_blank(reply)
    opened = F.regexp_replace(trimmed, r"\A```(?:json)?(?U:\s*)", "")
    bare = F.regexp_replace(opened, r"(?U:\s*)```\z", "")
    fenced = trimmed.startswith("```") | trimmed.endswith("```")
    return F.when(fenced, bare).otherwise(trimmed)


def _object(names: Iterable[str]) -> str:
    """Type that reads these fields of an object as variants: SQL null where one is left out,
    a null variant where it is null. Anything but an object becomes null."""
    return f"struct<{', '.join(f'{n}: variant' for n in names)}>"


def _kinds(fields: Column, names: Iterable[str]) -> Column:
    """Type of each field, read once; every rule then looks at plain text."""
    return F.struct(*[F.coalesce(F.schema_of_variant(fields[n]), F.lit("ABSENT")).alias(n)
                      for n in names])


class _Checks:
    """Rules over one object: ``fields`` holds its variants by name, ``kinds`` their types."""

    def __init__(self, rules: Rules, fields: Column, kinds: Column):
        self.rules, self.fields, self.kinds = rules, fields, kinds

    def read(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self.fields[name], "$", kind)

    def given(self, name: str, test: Column, nullable: bool = False) -> Column:
        """Holds when the test does, or the field may be null or left out and is."""
        free = (["VOID"] if nullable else []) + (["ABSENT"] if self.rules.absent_ok else [])
        good = F.coalesce(test, F.lit(False))
        return self.kinds[name].isin(*free) | good if free else good

    def text(self, name: str, limit: int | None = None, nullable: bool = False,
             test: Callable[[Column], Column] | None = None) -> Column:
        good = self.kinds[name] == "STRING"
        if limit is not None and self.rules.limit_texts:
            good = good & (F.char_length(self.read(name, "string")) <= limit)
        if test is not None:
            good = good & test(self.read(name, "string"))
        return self.given(name, good, nullable)

    def minor(self, name: str) -> Column:
        return self.given(name, (self.kinds[name] == "BIGINT")
                          & (self.read(name, "bigint") >= 0), True)

    def number(self, name: str, high: float = float("inf")) -> Column:
        kind = self.kinds[name]
        numeric = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        value = self.read(name, "double")
        within = value >= 0.0 if high == float("inf") else bound(
            value, lambda v: v.between(0.0, high))
        return self.given(name, numeric & within, True)

    def keys(self, allowed: Iterable[str], given: Column) -> Column:
        """Holds when the object with the fields ``given``, a map, has no others."""
        if self.rules.extra_ok:
            return F.lit(True)
        known = F.array(*[F.lit(k) for k in allowed])
        return F.size(F.array_except(F.map_keys(given), known)) == 0

    def texts(self, name: str, limit: int | None) -> Column:
        entries = self.read(name, "array<variant>")
        good = self.kinds[name].startswith("ARRAY") & F.forall(
            entries, lambda e: F.coalesce(F.schema_of_variant(e) == "STRING", F.lit(False)))
        if limit is not None:
            good = good & (F.size(entries) <= limit)
        return self.given(name, good)


def _merchant_ok(rules: Rules, parsed: Column) -> Column:
    def judge(fields: Column) -> Column:
        check = _Checks(rules, fields, _kinds(fields, MERCHANT_FIELDS))
        return fields.isNotNull() & check.text("rawName", NAME_MAX, True) & check.text(
            "normalizedName", NAME_MAX, True)

    good = bound(F.try_variant_get(parsed, "$.merchant", _object(MERCHANT_FIELDS)), judge)
    given = F.try_variant_get(parsed, "$.merchant", MAP)
    return good & _Checks(rules, given, given).keys(MERCHANT_FIELDS, given)


def _item_ok(check: _Checks) -> Column:
    return (check.text("rawName", NAME_MAX)
            & check.text("normalizedName", NAME_MAX) & check.number("quantity")
            & check.minor("unitPriceMinor") & check.minor("totalPriceMinor")
            & check.text("categoryId", CATEGORY_MAX) & check.number("confidence", 1.0))


def _items_ok(rules: Rules, parsed: Column) -> Column:
    """Whether ``items`` is a list within its bound whose entries all hold. A list that has an
    entry beyond the bound breaks the rule whatever the entries are, so they are not read."""
    names = EXTRACTED_ITEM.names

    def entry(fields: Column) -> Column:
        return F.struct(fields.alias("fields"), _kinds(fields, names).alias("kinds"))

    items = F.try_variant_get(parsed, "$.items", f"array<{_object(names)}>")
    good = F.forall(F.transform(items, entry), lambda e: F.coalesce(
        e["fields"].isNotNull() & _item_ok(_Checks(rules, e["fields"], e["kinds"])),
        F.lit(False)))
    if not rules.extra_ok:
        good = good & F.forall(
            F.try_variant_get(parsed, "$.items", f"array<{MAP}>"),
            lambda given: _Checks(rules, given, given).keys(names, given))
    beyond = F.try_variant_get(parsed, f"$.items[{EXTRACTED_ITEMS_MAX}]", "variant")
    return F.when(beyond.isNotNull(), False).otherwise(F.coalesce(good, F.lit(False)))


def _collect(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in order."""
    named = F.array(*[F.when(~F.coalesce(good, F.lit(False)), name)
                      for name, good in rules.items()])
    return F.array_compact(named)


def _extraction_violations(rules: Rules) -> Column:
    """Broken rules of a parsed reply, from the columns that ``validate_extractions`` adds."""
    parsed, fields, kinds = F.col("_parsed"), F.col("_fields"), F.col("_kinds")
    check = _Checks(rules, fields, kinds)
    version = (kinds["schemaVersion"] == "BIGINT") & (check.read("schemaVersion", "bigint") == 1)

    def nested(name: str, good: Column) -> Column:
        left_out = F.try_variant_get(parsed, f"$.{name}", "variant").isNull()
        return left_out | good if rules.absent_ok else good

    broken = {
        "extra_key": check.keys(EXTRACTION.names, F.try_variant_get(parsed, "$", MAP)),
        "schema_version": check.given("schemaVersion", version),
        "document_type": check.text("documentType", test=lambda t: t == "receipt"),
        "merchant": nested("merchant", F.col("_merchant_ok")),
        "transaction_date": check.text("transactionDate", None, True,
                                       lambda t: t.rlike(DATE_PATTERN)),
        "currency": check.text("currency", test=lambda t: F.char_length(t) == 3),
        "subtotal": check.minor("subtotalMinor"), "tax": check.minor("taxMinor"),
        "discount": check.minor("discountMinor"), "total": check.minor("totalMinor"),
        "category": check.text("categoryId", CATEGORY_MAX),
        "items": nested("items", F.col("_items_ok")),
        "confidence": check.number("confidence", 1.0),
        "warnings": check.texts("warnings", WARNINGS_MAX if rules.limit_warnings else None),
    }
    return F.when(fields.isNull(), F.array(F.lit("not_json_object"))).otherwise(
        _collect(broken))


def reply_fields(cleaned: Column) -> Column:
    """The top level of a JSON object as a map of variants; null for anything else."""
    return F.try_variant_get(F.try_parse_json(cleaned), "$", MAP)


def validate_extractions(replies: DataFrame, rules: Rules = SERVER) -> DataFrame:
    """Adds ``cleaned`` and ``violations`` to rows with a ``reply``."""
    single = [n for n in EXTRACTION.names if n not in NESTED]
    cleaned = settle(replies, cleaned=clean_reply(F.col("reply")))
    parsed = settle(cleaned, _parsed=F.try_parse_json("cleaned"))
    read = settle(parsed, _fields=F.try_variant_get("_parsed", "$", _object(single)))
    judged = settle(read, _kinds=_kinds(F.col("_fields"), single),
                    _merchant_ok=_merchant_ok(rules, F.col("_parsed")),
                    _items_ok=_items_ok(rules, F.col("_parsed")))
    return settle(judged, violations=_extraction_violations(rules)).select(
        *replies.columns, "cleaned", "violations")


def accepted(validated: DataFrame) -> DataFrame:
    """Valid replies as a struct ``extraction`` with the defaults of absent fields."""
    parsed = settle(validated.where(F.size("violations") == 0),
                    _raw=F.from_json("cleaned", EXTRACTION))
    raw = F.col("_raw")
    items = F.transform(
        F.coalesce(raw["items"], F.array().cast(EXTRACTION["items"].dataType)),
        lambda i: F.struct(
            F.coalesce(i["rawName"], F.lit("")).alias("rawName"),
            F.coalesce(i["normalizedName"], F.lit("")).alias("normalizedName"),
            i["quantity"].alias("quantity"), i["unitPriceMinor"].alias("unitPriceMinor"),
            i["totalPriceMinor"].alias("totalPriceMinor"),
            F.coalesce(i["categoryId"], F.lit("other")).alias("categoryId"),
            i["confidence"].alias("confidence")))
    filled = {
        "schemaVersion": F.coalesce(raw["schemaVersion"], F.lit(1)),
        "documentType": F.lit("receipt"), "merchant": raw["merchant"],
        "transactionDate": raw["transactionDate"],
        "currency": F.upper(F.coalesce(raw["currency"], F.lit("EUR"))),
        "subtotalMinor": raw["subtotalMinor"], "taxMinor": raw["taxMinor"],
        "discountMinor": raw["discountMinor"], "totalMinor": raw["totalMinor"],
        "categoryId": F.coalesce(raw["categoryId"], F.lit("other")), "items": items,
        "confidence": raw["confidence"],
        "warnings": F.coalesce(raw["warnings"], F.array().cast("array<string>")),
    }
    return parsed.withColumn(
        "extraction", F.struct(*[c.alias(n) for n, c in filled.items()])
    ).drop("_raw", "cleaned", "violations", "reply")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("violations") > 0)


SUMMARY_FIELDS = ("observations", "suggestion")
SNAPSHOT_LISTS = ("categories", "merchants", "items", "priceChanges")
SNAPSHOT_FIELDS = ("locale", "period", "total", "previousTotal", *SNAPSHOT_LISTS)


def _validate(rows: DataFrame, column: str, names: tuple[str, ...],
              rules_of: Callable[[_Checks], dict[str, Column]], rules: Rules) -> DataFrame:
    parsed = settle(rows, _fields=reply_fields(F.col(column)))
    typed = settle(parsed, _kinds=_kinds(F.col("_fields"), names))
    broken = rules_of(_Checks(rules, F.col("_fields"), F.col("_kinds")))
    violations = F.when(F.col("_fields").isNull(), F.array(F.lit("not_json_object"))) \
        .otherwise(_collect(broken))
    return settle(typed, violations=violations).drop("_fields", "_kinds")


def validate_summaries(rows: DataFrame, column: str = "summary",
                       rules: Rules = SERVER) -> DataFrame:
    """Rules of a generated summary: at most three observations, suggestion up to 500."""
    return _validate(rows, column, SUMMARY_FIELDS, lambda check: {
        "extra_key": check.keys(SUMMARY_FIELDS, check.fields),
        "observations": check.texts("observations", 3),
        "suggestion": check.text("suggestion", 500, True)}, rules)


def validate_snapshots(rows: DataFrame, column: str = "snapshot") -> DataFrame:
    """Rules of a snapshot request: supported locale, integer totals, lists of objects."""
    def rules_of(check: _Checks) -> dict[str, Column]:
        kinds = check.kinds
        broken = {
            "extra_key": check.keys(SNAPSHOT_FIELDS, check.fields),
            "locale": check.text("locale", test=lambda t: t.isin(*SUPPORTED_LOCALES)),
            "period": kinds["period"].startswith("OBJECT"),
            "total": kinds["total"] == "BIGINT",
            "previousTotal": kinds["previousTotal"] == "BIGINT"}
        for name in SNAPSHOT_LISTS:
            broken[name] = kinds[name].startswith("ARRAY") & F.forall(
                check.read(name, "array<variant>"),
                lambda e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)))
        return broken

    return _validate(rows, column, SNAPSHOT_FIELDS, rules_of, SERVER)


def upload_violations(size: Column | None = None) -> Column:
    """Broken rules of an upload row: request fields, then its bytes."""
    content = F.col("content")
    return _collect({
        "receipt_id": F.col("receiptId").rlike(r"\A[A-Za-z0-9_-]{1,64}\z"),
        "locale": F.col("locale").isin(*SUPPORTED_LOCALES),
        "currency": is_currency(F.col("currency")),
        "too_large": (F.octet_length(content) if size is None else size) <= MAX_UPLOAD_BYTES,
        "type_mismatch": F.col("contentType") == F.col("mimeType"),
        "not_jpeg_type": F.col("mimeType") == "image/jpeg",
        "not_jpeg_bytes": F.hex(F.substring(content, 1, 3)) == "FFD8FF",
        "hash_mismatch": is_sha256(F.lower("sha256"))
        & (F.lower("sha256") == F.sha2(content, 256)),
    })
