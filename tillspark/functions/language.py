"""Language tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillspark.functions.text import trim_blank

# Languages with a catalogue and the locale each one formats with.
LOCALES = {"en": "en-GB", "it": "it-IT", "de": "de-DE", "es": "es-ES", "fr": "fr-FR"}
LANGUAGES = tuple(LOCALES)


def normalize_language(tag: Column) -> Column:
    """First subtag in lower case when it is supported, else null."""
    first = F.split_part(F.lower(F.replace(trim_blank(tag), F.lit("_"), F.lit("-"))),
                         F.lit("-"), F.lit(1))
    return F.when(first.isin(*LANGUAGES), first)


def detect_language(tags: Column) -> Column:
    """First supported tag of a list, English when there is none."""
    known = F.filter(F.transform(tags, normalize_language), lambda tag: tag.isNotNull())
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit("en"))


def resolve_language(preference: Column, tags: Column) -> Column:
    return (
        F.when(F.coalesce(preference, F.lit("")).isin("", "auto"), detect_language(tags))
        .otherwise(F.coalesce(normalize_language(preference), F.lit("en")))
    )


def locale_for(language: Column) -> Column:
    pairs = [F.lit(part) for pair in LOCALES.items() for part in pair]
    known = F.coalesce(normalize_language(language), F.lit("en"))
    return F.try_element_at(F.create_map(*pairs), known)
