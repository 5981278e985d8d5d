"""Aggregates over span rows, compliance and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.score import decile_label
from ..plans.catalog import FRAMEWORKS, REQUIRED_STRATEGIES


def counts(spans: DataFrame, *by: str) -> DataFrame:
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def summary(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text_col: str = "text", high: float = 0.8) -> DataFrame:
    """Per document: total_entities, high_confidence_entities, text_length, detection_coverage (entities a hundred words), entity_types."""
    got = spans.groupBy(key).agg(F.count(F.lit(1)).alias("total_entities"), F.count_if(F.col("confidence") >= high).alias("high_confidence_entities"), F.array_sort(F.collect_set("type")).alias("entity_types"))
    words = F.size(F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != ""))
    base = docs.select(key, F.length(text_col).alias("text_length"), words.alias("__words"))
    out = base.join(got, key, "left")
    total = F.coalesce("total_entities", F.lit(0))
    return out.select(key, total.alias("total_entities"), F.coalesce("high_confidence_entities", F.lit(0)).alias("high_confidence_entities"), "text_length", F.round(100 * total / F.greatest("__words", F.lit(1)), 2).alias("detection_coverage"), F.coalesce("entity_types", F.array().cast("array<string>")).alias("entity_types"))


def statistics(spans: DataFrame) -> DataFrame:
    """kind, name, n: running counters by detector, type and confidence decile, from one pass."""
    rows = spans.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in (("detector", F.col("source")), ("type", F.col("type")), ("confidence", decile_label(F.col("confidence"))))])).alias("r"))
    return rows.select("r.*").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def rollup(spans: DataFrame, *by: str) -> DataFrame:
    """Extension: subtotals over the columns given."""
    return spans.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def framework_types(spark: SparkSession) -> DataFrame:
    """framework, pii_type, strategies: a bridge of fixed size."""
    rows = [(f, t, list(REQUIRED_STRATEGIES.get((f, t), ()))) for f, types in FRAMEWORKS.items() for t in types]
    return spark.createDataFrame(rows, "framework string, pii_type string, strategies array<string>")


def pii_type(type_):
    """Entity vocabulary to pii vocabulary."""
    return F.when(type_ == "person", "person_name").otherwise(type_)


def compliance(spans: DataFrame, *keys: str, strategies: dict[str, str] | None = None) -> DataFrame:
    """Per key and framework: the types found that it protects, and whether the strategy in use answers its demands.

    ``strategies`` maps types to what was applied to them; without it any protected type is a breach.
    """
    bridge = F.broadcast(framework_types(spans.sparkSession))  # a few dozen rows
    hit = spans.withColumn("pii_type", pii_type(F.col("type"))).join(bridge, "pii_type")
    if strategies:
        used = F.create_map(*[F.lit(x) for kv in strategies.items() for x in kv])
        own = F.try_element_at(used, F.col("pii_type"))
        fine = own.isNotNull() & (own != "none") & ((F.size("strategies") == 0) | F.array_contains("strategies", own))
    else:
        fine = F.lit(False)
    return hit.groupBy(*keys, "framework").agg(F.count(F.lit(1)).alias("entities"), F.array_sort(F.collect_set("pii_type")).alias("types"), F.bool_and(fine).alias("is_compliant"))


def latest(log: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last entry of each key."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in ties])
    return log.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def audit_entries(redacted: DataFrame, form: str, user: str, frameworks: list[str], key: str = "doc_id") -> DataFrame:
    """One audit row a document of :func:`maskwell.plans.engine.redact`."""
    return redacted.select(
        F.lit(f"redact_{form}").alias("operation"), F.lit(user).alias("user_id"), F.col(key).cast("string").alias("document_id"), F.array_sort(F.map_keys("redaction_count")).alias("pii_types_processed"),
        F.aggregate(F.map_values("redaction_count"), F.lit(0).cast("long"), lambda a, x: a + x).alias("entity_count"), F.lit(True).alias("success"), F.array(*map(F.lit, frameworks)).cast("array<string>").alias("compliance_frameworks"),
    )


def audit_entry(form: Column, document: Column, counts: Column, success: Column, at: Column, user: str | None = None, frameworks: tuple[str, ...] = (), path: str | None = None) -> Column:
    """The audit of one output as a struct; ``counts`` is the document's map of redactions by type."""
    return F.struct(
        at.alias("timestamp"), F.concat(F.lit("redact_"), form).alias("operation"), F.lit(user).cast("string").alias("user_id"), document.cast("string").alias("document_id"),
        F.array_sort(F.map_keys(counts)).alias("pii_types_processed"), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x).alias("entity_count"), success.alias("success"),
        F.array(*map(F.lit, frameworks)).cast("array<string>").alias("compliance_frameworks"), F.struct(F.lit(path).cast("string").alias("output_path"), form.alias("format")).alias("metadata"),
    )


def audit_query(log: DataFrame, start=None, end=None, operation: str | None = None, user: str | None = None, limit: int = 100) -> DataFrame:
    """The newest entries under the filters given."""
    for condition in ((F.col("timestamp") >= start) if start is not None else None, (F.col("timestamp") <= end) if end is not None else None, (F.col("operation") == operation) if operation else None, (F.col("user_id") == user) if user else None):
        if condition is not None:
            log = log.filter(condition)
    return log.orderBy(F.col("timestamp").desc(), "document_id").limit(limit)
