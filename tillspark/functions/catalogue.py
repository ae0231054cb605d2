"""Label and sentence catalogue as a small dimension (language, key, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The texts users see, by key, in the order en, it, de, es, fr.
TEXTS = {
    "category.food_grocery": ("Groceries", "Spesa alimentare", "Lebensmittel", "Alimentación",
                              "Courses alimentaires"),
    "category.restaurant": ("Dining", "Ristorazione", "Gastronomie", "Restauración",
                            "Restauration"),
    "category.transport": ("Transport", "Trasporti", "Verkehr", "Transporte", "Transports"),
    "category.home": ("Home", "Casa", "Haushalt", "Hogar", "Maison"),
    "category.health": ("Health", "Salute", "Gesundheit", "Salud", "Santé"),
    "category.personal": ("Personal", "Persona", "Persönliches", "Personal", "Personnel"),
    "category.entertainment": ("Leisure", "Tempo libero", "Freizeit", "Ocio", "Loisirs"),
    "category.other": ("Other", "Altro", "Sonstiges", "Otros", "Autre"),
    "status.captured": ("Captured", "Acquisito", "Erfasst", "Capturado", "Capturé"),
    "status.queued": ("Queued", "In coda", "In Warteschlange", "En cola", "En attente"),
    "status.processing": ("Processing", "Analisi", "In Analyse", "Analizando", "Analyse"),
    "status.needs_review": ("Review needed", "Da controllare", "Zu prüfen", "Por revisar",
                            "À vérifier"),
    "status.confirmed": ("Confirmed", "Confermato", "Bestätigt", "Confirmado", "Confirmé"),
    "status.failed": ("Failed", "Non riuscito", "Fehlgeschlagen", "Fallido", "Échec"),
    "status.manual": ("Manual", "Manuale", "Manuell", "Manual", "Manuel"),
    "merchant.unknown": ("Receipt without a merchant", "Scontrino senza esercente",
                         "Beleg ohne Händler", "Recibo sin comercio", "Ticket sans commerçant"),
    "date.unknown": ("Date to review", "Data da verificare", "Datum prüfen",
                     "Fecha por revisar", "Date à vérifier"),
    "insight.category_up": (
        "Spending on {{category}} increased by {{percent}}%.",
        "La spesa per {{category}} è aumentata del {{percent}}%.",
        "Die Ausgaben für {{category}} sind um {{percent}} % gestiegen.",
        "El gasto en {{category}} ha aumentado un {{percent}} %.",
        "Les dépenses en {{category}} ont augmenté de {{percent}} %."),
    "insight.category_down": (
        "Spending on {{category}} decreased by {{percent}}%.",
        "La spesa per {{category}} è diminuita del {{percent}}%.",
        "Die Ausgaben für {{category}} sind um {{percent}} % gesunken.",
        "El gasto en {{category}} ha disminuido un {{percent}} %.",
        "Les dépenses en {{category}} ont diminué de {{percent}} %."),
    "insight.merchant_up": (
        "You spent {{amount}} more at {{merchant}}.",
        "Hai speso {{amount}} in più da {{merchant}}.",
        "Du hast bei {{merchant}} {{amount}} mehr ausgegeben.",
        "Has gastado {{amount}} más en {{merchant}}.",
        "Vous avez dépensé {{amount}} de plus chez {{merchant}}."),
    "insight.merchant_down": (
        "You spent {{amount}} less at {{merchant}}.",
        "Hai speso {{amount}} in meno da {{merchant}}.",
        "Du hast bei {{merchant}} {{amount}} weniger ausgegeben.",
        "Has gastado {{amount}} menos en {{merchant}}.",
        "Vous avez dépensé {{amount}} de moins chez {{merchant}}."),
    "insight.frequency_one": (
        "{{product}} was purchased {{count}} time.",
        "{{product}} è stato acquistato {{count}} volta.",
        "{{product}} wurde {{count}} Mal gekauft.",
        "{{product}} se ha comprado {{count}} vez.",
        "{{product}} a été acheté {{count}} fois."),
    "insight.frequency_other": (
        "{{product}} was purchased {{count}} times.",
        "{{product}} è stato acquistato {{count}} volte.",
        "{{product}} wurde {{count}} Mal gekauft.",
        "{{product}} se ha comprado {{count}} veces.",
        "{{product}} a été acheté {{count}} fois."),
    "insight.price_up": (
        "The price of {{product}} increased by {{percent}}%.",
        "Il prezzo di {{product}} è aumentato del {{percent}}%.",
        "Der Preis von {{product}} ist um {{percent}} % gestiegen.",
        "El precio de {{product}} ha aumentado un {{percent}} %.",
        "Le prix de {{product}} a augmenté de {{percent}} %."),
    "insight.price_down": (
        "The price of {{product}} decreased by {{percent}}%.",
        "Il prezzo di {{product}} è diminuito del {{percent}}%.",
        "Der Preis von {{product}} ist um {{percent}} % gesunken.",
        "El precio de {{product}} ha disminuido un {{percent}} %.",
        "Le prix de {{product}} a diminué de {{percent}} %."),
}
LANGUAGE_ORDER = ("en", "it", "de", "es", "fr")


def rows(prefix: str = "") -> list[tuple[str, str, str]]:
    return [
        (language, key, text)
        for key, texts in TEXTS.items() if key.startswith(prefix)
        for language, text in zip(LANGUAGE_ORDER, texts)
    ]


def catalogue(spark: SparkSession, prefix: str = "") -> DataFrame:
    """At most a few hundred constant rows, so joins with it are broadcast."""
    return spark.createDataFrame(rows(prefix), "lang string, key string, text string")


def catalogue_sql(prefix: str = "") -> str:
    """The same rows as a SQL values list, for checks in another engine."""
    quoted = ("(" + ", ".join("'" + part.replace("'", "''") + "'" for part in row) + ")"
              for row in rows(prefix))
    return "(VALUES " + ", ".join(quoted) + ") AS catalogue(lang, key, text)"
