"""Sentences and messages as Column functions, in words of our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ptsi_summary(kind: Column, days: Column, multiple: Column, sigma: Column, normal: Column) -> Column:
    """What is known of a source, clause by clause; clauses without a value are left out."""
    clauses = (
        F.concat(kind, F.lit(" heat source")),
        F.format_string("%.1f days between first and last detection", days),
        F.when(multiple > 0, F.format_string("%.1f times the mean output", multiple)),
        F.when(sigma.isNotNull(), F.format_string("%+.1f standard deviations", sigma)),
        F.coalesce(F.when(normal, "usual").when(~normal, "unusual"), F.lit("nothing to compare with")),
    )
    return F.concat_ws("; ", *clauses)


def dispatch_message(title: Column, fields: dict[str, Column]) -> Column:
    """A title and a line "name: value" for each field that has a value."""
    return F.concat_ws("\n", title, *[F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields.items()])


def water_needed(litres: Column, cubic_metres: Column) -> Column:
    """Litres of water, or how much to smother where water doesn't help; null if neither is known."""
    amount = lambda v, unit: F.concat(F.format_number(v, 0), F.lit(unit))
    return F.coalesce(amount(litres, " litres"), amount(cubic_metres, " m3 to cover"))
