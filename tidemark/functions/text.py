"""Column expressions that write sentences: metric formats, descriptions, prompts, alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import fixed, percent_text, plain_text, signed_fixed
from tidemark.schemas import ALERT_ICONS, DEFAULT_ICON, METRICS, TYPE_LABELS


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def type_label(kind: Column) -> Column:
    """Display label of an anomaly type; unknown types show their own words."""
    labels = _literal_map({k: v[0] for k, v in TYPE_LABELS.items()})
    return F.coalesce(F.try_element_at(labels, kind), F.translate(kind, "_", " "))


def type_icon(kind: Column) -> Column:
    icons = _literal_map({k: v[1] for k, v in TYPE_LABELS.items()})
    return F.coalesce(F.try_element_at(icons, kind), F.lit(DEFAULT_ICON))


def metric_text(metric: Column, value: Column) -> Column:
    """Compact display of a metric value: money, percentage or count by metric name."""
    thousands = F.concat(fixed(value / F.lit(1000.0), 1), F.lit("k"))
    count = F.when(value >= 1000, thousands).otherwise(fixed(value, 0))
    return (
        F.when(metric == "mrr", F.concat(F.lit("$"), count))
        .when(metric.isin("conversion_rate", "refund_rate"), percent_text(value))
        .otherwise(count)
    )


def movement_sentence(metric: str, value: Column, mean: Column) -> Column:
    """One sentence on how a metric moved against its mean."""
    change = F.when(mean == 0, F.lit(0.0)).otherwise(F.abs((value - mean) / mean) * F.lit(100.0))
    moved, level = fixed(change, 0), percent_text(value)

    def sentence(before: str, figure: Column, after: str) -> Column:
        return F.concat(F.lit(before), figure, F.lit(after))

    # The sentence wording the classifier is trained on.
    rise, fall = {
        "mrr": (
            sentence("MRR rose ", moved, "% above its usual level."),
            sentence("MRR fell ", moved, "% below its usual level."),
        ),
        "refund_rate": (
            sentence("Refund rate climbed to ", level, ", well above normal."),
            sentence("Refund rate dropped to ", level, "."),
        ),
        "conversion_rate": (
            sentence("Conversion rate rose to ", level, "."),
            sentence("Conversion rate slipped to ", level, "."),
        ),
        "checkout_volume": (
            sentence("Checkout volume jumped ", moved, "% above baseline."),
            sentence("Checkout volume dropped ", moved, "% below baseline."),
        ),
    }.get(metric, (F.lit(f"{metric} shifted from its baseline."),) * 2)
    return F.when(value > mean, rise).otherwise(fall)


def describe(contributors: Column, metrics: list[str] = METRICS, top_k: int = 2) -> Column:
    """Description from the leading contributors of rows with ``<m>`` and ``<m>_mean``."""
    sentences = F.create_map(
        *[
            x
            for m in metrics
            for x in (F.lit(m), movement_sentence(m, F.col(m), F.col(f"{m}_mean")))
        ]
    )
    chosen = F.filter(
        F.transform(
            F.slice(contributors, 1, top_k), lambda c: F.try_element_at(sentences, c["metric"])
        ),
        lambda s: s.isNotNull(),
    )
    return F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(
        F.lit("Metrics deviated from baseline.")
    )


def driver_list(contributors: Column) -> Column:
    """``metric (+1.23sd)`` for every contributor, comma-separated."""
    return F.array_join(
        F.transform(
            contributors,
            lambda c: F.concat(c["metric"], F.lit(" ("), signed_fixed(c["sd"], 2), F.lit("sd)")),
        ),
        ", ",
    )


def metrics_text(values: Column) -> Column:
    """The metric map in prompt form, in the fixed metric order."""
    parts = [
        F.concat(F.lit(f"'{m}': "), plain_text(F.element_at(values, F.lit(m)))) for m in METRICS
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def first_sentence(text: Column) -> Column:
    """Text up to the first full stop of its first line."""
    line = F.substring_index(F.translate(F.coalesce(text, F.lit("")), "\r", "\n"), "\n", 1)
    return F.substring_index(F.trim(line), ".", 1)


def grounded_explanation(
    tenant: Column,
    kind: Column,
    day: Column,
    score: Column,
    contributors: Column,
    lead_text: Column,
) -> Column:
    """Explanation built only from record fields and the best document's first sentence."""
    drivers = F.when(F.size(contributors) > 0, driver_list(contributors)).otherwise(
        F.lit("multiple metrics")
    )
    return F.trim(
        F.concat(
            F.lit("Tenant "), tenant,
            F.lit(" shows a "), kind,
            F.lit(" anomaly on "), day,
            F.lit(" (score "), plain_text(score),
            F.lit("). The main drivers were "), drivers,
            F.lit(". "), first_sentence(lead_text), F.lit("."),
        )
    )


# The instruction lines that close every prompt.
PROMPT_INSTRUCTION = (
    "Explain, in 2-3 sentences, what most likely happened. Ground every claim "
    "in the drivers, metrics, or retrieved context above. Do not invent "
    "numbers that are not shown."
)


def reason_prompt(
    tenant: Column,
    day: Column,
    kind: Column,
    confidence: Column,
    score: Column,
    contributors: Column,
    values: Column,
    context_texts: Column,
) -> Column:
    """Prompt text: record fields, drivers, metrics and the retrieved documents as bullets."""
    bullets = F.array_join(F.transform(context_texts, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat(
        F.lit("TENANT: "), tenant,
        F.lit("\nDATE: "), day,
        F.lit("\nANOMALY TYPE: "), kind,
        F.lit(" (confidence "), plain_text(confidence),
        F.lit(")\nSCORE: "), plain_text(score),
        F.lit("\nDRIVERS: "), driver_list(contributors),
        F.lit("\nMETRICS: "), metrics_text(values),
        F.lit("\n\nRETRIEVED CONTEXT:\n"), bullets,
        F.lit("\n\n" + PROMPT_INSTRUCTION),
    )


def search_query(kind: Column, contributors: Column, description: Column) -> Column:
    """Retrieval query of a record: type, driver names, description."""
    names = F.array_join(F.transform(contributors, lambda c: c["metric"]), " ")
    return F.concat_ws(" ", kind, names, F.coalesce(description, F.lit("")))


def alert_text(
    kind: Column, tenant: Column, day: Column, score: Column, explanation: Column
) -> Column:
    icon = F.coalesce(F.try_element_at(_literal_map(ALERT_ICONS), kind), F.lit(DEFAULT_ICON))
    return F.concat(
        icon, F.lit(" *"), kind, F.lit("* for `"), tenant, F.lit("` on "), day,
        F.lit(" (score "), plain_text(score), F.lit(")\n"), explanation,
    )
