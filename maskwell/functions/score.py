"""Context, risk and confidence of spans: Column -> Column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import RISK, RISK_BELOW
from . import validate

WINDOW = 50


def _map(table: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))


def before(text: Column, start: Column, window: int = WINDOW) -> Column:
    low = F.greatest(F.lit(0), start - window)
    return F.substring(text, low + 1, start - low)


def entity(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def after(text: Column, end: Column, window: int = WINDOW) -> Column:
    return F.substring(text, end + 1, F.lit(window))


def context(text: Column, start: Column, end: Column, window: int = WINDOW) -> Column:
    """The span with up to ``window`` characters on either side."""
    low = F.greatest(F.lit(0), start - window)
    return F.substring(text, low + 1, end + window - low)


def risk(type_: Column, space: Column, confidence: Column, strict: bool = False) -> Column:
    """Level by type and confidence.  Without ``strict`` the types of the pii vocabulary have the base level medium."""
    base = F.coalesce(F.try_element_at(_map(RISK), type_), F.lit("medium"))
    base = base if strict else F.when(space == "entity", base).otherwise("medium")
    return F.when(confidence >= 0.9, base).when(confidence >= 0.7, F.element_at(_map(RISK_BELOW), base)).otherwise("low")


def adjusted(type_: Column, space: Column, source: Column, confidence: Column, text: Column, around: Column) -> Column:
    """Confidence after the penalties of format, context, common word and length, and the bonus of sure rules; three places."""
    own = F.when(space == "entity", validate.orchestrator_format(type_, text)).otherwise(F.lit(True))
    value = confidence * F.when(own, 1.0).otherwise(0.7) * F.when(validate.negated(around), 0.5).otherwise(1.0)
    value = value * F.when((type_ == "person") & validate.common_word(text), 0.6).otherwise(1.0) * F.when(F.length(text).between(1, 100), 1.0).otherwise(0.8)
    value = F.when((source == "rule_based") & (confidence >= 0.9), F.least(F.lit(1.0), value * 1.1)).otherwise(value)
    return F.round(value, 3)


def decile_label(confidence: Column) -> Column:
    low = (F.floor(confidence * 10) * 10).cast("int")
    return F.concat(low.cast("string"), F.lit("%-"), (low + 9).cast("string"), F.lit("%"))


def domain_context(text: Column, start: Column, end: Column, window: int = 30) -> Column:
    return F.concat(F.lit("..."), before(text, start, window), F.lit("**"), entity(text, start, end), F.lit("**..."))
