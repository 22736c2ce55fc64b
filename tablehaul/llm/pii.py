"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablehaul.llm.columns import whole
from tablehaul.llm.spans import Kind, counted, listed, ordered, places

#: A candidate beyond the base kinds counts from this score on.
LEAST = 0.6

# Context words near a span, in the languages of the corpora.
PHONE_WORDS = r"\b(phone|tel|telephone|call|mobile|cell|fax|telefon|handy|tél|portable|teléfono|móvil)\b"
CARD_WORDS = r"\b(card|visa|credit|debit|mastercard|karte|kreditkarte|carte|tarjeta)\b"
BANK_WORDS = r"\b(iban|account|bank|konto|compte|cuenta|transfer)\b"
ID_WORDS = r"\b(ssn|social security|tax id|national id|sozialversicherung|sécurité sociale|seguridad social)\b"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(match: Column, fewest: int, most: int) -> Column:
    number = digits(match)
    return F.length(number).between(fewest, most) & F.call_function("luhn_check", number)


def mod97(match: Column) -> Column:
    """The check of bank account numbers: letters count 10 to 35, the first four characters go last."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)", -1), F.lit(0), step) == 1


BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

# Possessive repeats find the same spans as greedy ones here, since nothing they
# take can start what follows, and neither recurse nor go back on long runs.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", score=0.9, base=True, needs="@"),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
        valid=lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), score=0.6, context=r"\b(ip|host|address|server|adresse)\b", gain=0.3, base=True,
    ),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13,}+", valid=lambda m: luhn(m, 14, 19), score=0.8, context=CARD_WORDS, gain=0.2, base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", valid=lambda m: F.length(digits(m)).between(10, 15), score=0.7, context=PHONE_WORDS, gain=0.3, base=True, needs="+"),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        valid=mod97, score=0.7, context=BANK_WORDS, gain=0.3,
    ),
    Kind(
        "national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        valid=lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), score=0.4, context=ID_WORDS, gain=0.5, needs="-",
    ),
    Kind(
        "local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
        score=0.3, context=PHONE_WORDS, gain=0.4,
    ),
    Kind("short_card", r"[0-9](?:[ -]?[0-9]){12,}+", valid=lambda m: luhn(m, 13, 13), score=0.4, context=CARD_WORDS, gain=0.4),
)


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds ``into``: the spans of every whole text with kind, place, matched text and score.

    The base kinds are found whatever their score. Bank accounts (mod-97), national
    ids, local phone numbers and short cards need ``LEAST``, which the weak ones
    only reach with a context word near them. A null or empty text has no spans;
    spans of different kinds may overlap; equal rows get equal spans. Everything
    happens inside the row, so nothing is shuffled.
    """
    value = whole(text)
    found = F.concat(*[places(value, kind, rank, LEAST) for rank, kind in enumerate(KINDS)])
    return df.withColumn(into, ordered(found))


def pii_digest(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans and scores."""
    found = find_pii(documents.select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    kept = found.select("doc_id", "pii", F.filter("pii", lambda s: s["kind"].isin(base)).alias("base"))
    return kept.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
