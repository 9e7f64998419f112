"""Scalar column expressions for money, rates, dates, tokens and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import LABELS, PAYLOAD, TOPIC_PREFIX, UNKNOWN_TOPIC

UNICODE_MINUS = "−"

# The token and number shapes the text operators agree on.
TOKEN_PATTERN = "[a-z0-9]+"
NUMBER_PATTERN = r"-?\d[\d,]*(?:\.\d+)?"


def topic_for(tenant: Column) -> Column:
    """Message-bus topic of a tenant; null and empty share the fallback topic."""
    return F.when(F.coalesce(tenant, F.lit("")) == "", F.lit(UNKNOWN_TOPIC)).otherwise(
        F.concat(F.lit(TOPIC_PREFIX), tenant)
    )


def payload_struct(payload: Column) -> Column:
    """All payload fields in one parse of the JSON text."""
    return F.from_json(payload, PAYLOAD)


def epoch_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def flexible_date(created: Column) -> Column:
    """Day of a `created` that is epoch seconds or an ISO text (its first ten characters)."""
    text = created.cast("string")
    return F.when(
        text.rlike(r"^\d+$"), F.to_date(F.timestamp_seconds(text.try_cast("bigint")))
    ).otherwise(F.substring(text, 1, 10).try_cast("date"))


def strict_cents(amount: Column) -> Column:
    """Whole cents, NULL where the text is missing or not an integer."""
    return amount.try_cast("bigint")


def live_cents(amount: Column) -> Column:
    """Whole cents, fractions cut off, 0 where the text is missing or no number."""
    whole = F.coalesce(amount.try_cast("bigint"), amount.try_cast("double").try_cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def dollars(cents: Column) -> Column:
    return F.round(cents.cast("double") / F.lit(100.0), 2)


def safe_ratio(numerator: Column, denominator: Column, undefined: float | None = None) -> Column:
    """Rate to four places; NULL (or ``undefined``) where the denominator is zero."""
    ratio = F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 4)
    return ratio if undefined is None else F.coalesce(ratio, F.lit(undefined))


def numeric_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def numbers(text: Column) -> Column:
    """Every number written in a text, as doubles, with thousands separators removed."""
    found = F.regexp_extract_all(
        F.translate(text, UNICODE_MINUS, "-"), F.lit(NUMBER_PATTERN), F.lit(0)
    )
    return F.transform(found, lambda x: F.translate(x, ",", "").try_cast("double"))


def _let(value: Column, body) -> Column:
    """``body`` of the value, with the value written (and computed) once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_round(value: Column, places: int) -> Column:
    """Correctly rounded to ``places``, true ties to even, as C and Python print numbers.

    The built-in roundings work on the shortest decimal form of a double, which may be a tie
    where the double itself is not. The product with 10^places is split into its double and
    its exact error (the factor has few bits, so both partial products are exact), which
    tells on which side of the tie the value lies.
    """
    scale = F.lit(float(10**places))

    def error_of(size: Column) -> Column:
        spread = size * F.lit(134217729.0)  # 2^27 + 1 splits a double into two halves
        return _let(
            spread - (spread - size),
            lambda high: (high * scale - size * scale) + (size - high) * scale,
        )

    def rounded(x: Column) -> Column:
        scaled = F.abs(x) * scale
        part = scaled % F.lit(1.0)
        whole = scaled - part
        odd = whole % F.lit(2.0) == 1.0
        tie_up = _let(error_of(F.abs(x)), lambda e: (e > 0) | ((e == 0) & odd))
        up = (part > 0.5) | ((part == 0.5) & tie_up)
        size = (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale
        return F.when(x < 0, -size).otherwise(size)

    return _let(value, rounded)


def plain_text(value: Column) -> Column:
    """A double as Python prints it: shortest form, exponents only below 1e-4 or from 1e16."""
    size = F.abs(value)
    digits = F.rtrim(value.cast("decimal(38,16)").cast("string"), F.lit("0"))
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    # The built-in text form switches to exponents below 1e-3 and from 1e7.
    unusual = ((size < 1e-3) & (size >= 1e-4)) | ((size >= 1e7) & (size < 1e16))
    return F.when(unusual, plain).otherwise(value.cast("string"))


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", exact_round(value, places))


def signed_fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%+.{places}f", exact_round(value, places))


def percent_text(value: Column, places: int = 1) -> Column:
    return F.concat(fixed(value * F.lit(100.0), places), F.lit("%"))


def nearest_label(raw: Column, labels: list[str] = LABELS) -> Column:
    """Exact label, else the one sharing most tokens; the earliest label wins ties."""
    cleaned = F.translate(F.lower(F.trim(raw)), " ", "_")
    words = F.array_distinct(
        F.filter(F.split(F.translate(cleaned, "_", " "), r"\s+"), lambda t: t != "")
    )
    candidates = F.array(
        *[
            F.struct(
                F.size(
                    F.array_intersect(words, F.array(*[F.lit(w) for w in label.split("_")]))
                ).alias("overlap"),
                F.lit(-position).alias("preference"),
                F.lit(label).alias("label"),
            )
            for position, label in enumerate(labels)
        ]
    )
    return F.when(cleaned.isin(labels), cleaned).otherwise(F.array_max(candidates)["label"])


def severity_band(score: Column) -> Column:
    return F.when(score >= 0.97, "high").when(score >= 0.9, "mid").otherwise("low")


def faithfulness_band(score: Column) -> Column:
    return F.when(score >= 0.9, "ok").when(score >= 0.75, "warn").otherwise("danger")
