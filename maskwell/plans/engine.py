"""The engine's entry points: detect, redact and report over a frame of documents."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import offsets, score
from ..functions import redact as R
from ..operators import spans as S
from .catalog import Pattern


class Rules:
    """Custom rules at run time; a pattern that is no regular expression is refused."""

    def __init__(self):
        self.patterns: list[Pattern] = []

    def add(self, regex: str, type_: str, confidence: float = 0.8) -> bool:
        try:
            re.compile(regex)
        except re.error:
            return False
        if not type_ or not 0 <= confidence <= 1:
            return False
        self.patterns.append(Pattern("custom", type_, regex, confidence))
        return True

    def remove(self, regex: str) -> bool:
        before = len(self.patterns)
        self.patterns = [p for p in self.patterns if p.regex != regex]
        return len(self.patterns) < before

    def types(self) -> list[str]:
        return sorted({p.type for p in self.patterns})

    def load(self, spark, path: str) -> int:
        """Rules from a JSON file (a list of {pattern, pii_type, confidence, flags}); rows that make no rule are skipped."""
        good = 0
        for row in spark.read.option("multiLine", True).json(path).collect():  # a rule file's rows
            r = row.asDict()
            if r.get("pattern") and r.get("pii_type"):
                prefix = "(?i)" if int(r.get("flags") or 0) & 2 else ""
                good += self.add(prefix + r["pattern"], r["pii_type"], float(r.get("confidence") or 0.8))
        return good


def strict_patterns(patterns: list[Pattern]) -> list[Pattern]:
    """The patterns with those that match almost every word narrowed: names as written with capitals, ids with a digit."""
    out = []
    for p in patterns:
        if p.detector == "enhanced" and p.type == "person_name":
            p = replace(p, ignore_case=False)
        elif p.detector == "enhanced" and p.type == "health_insurance_id":
            p = replace(p, regex=r"\b(?=[A-Z]*[0-9])[A-Z0-9]{6,12}\b")
        out.append(p)
    return out


def detect(docs: DataFrame, detectors=("enhanced", "healthcare", "financial", "rule_based"), types=None, rules: Rules | None = None, steps=(), text_col: str = "text", merge_at: float | None = 0.7, least: float = 0.5, strict: bool = False, around_col: str | None = None) -> DataFrame:
    """``docs`` with array<span> ``spans``: extracted, merged, those of ``least`` confidence, the surest first.  All narrow.

    With ``steps`` the text is preprocessed first; spans and their texts are those of the *original* text, which stays in
    ``text_col`` (see :mod:`offsets`).  ``strict`` narrows the patterns that match almost every word.  ``around_col`` gets the
    spans' contexts (of the text that was searched).
    """
    patterns = S.select_patterns(detectors, types, dense=True, custom=rules.patterns if rules else None)
    if strict:
        patterns = strict_patterns(patterns)
    if not steps:
        return S.extract_all(docs, patterns, text_col, merge_at=merge_at, least=least, around_col=around_col)
    seen = offsets.preprocessed(docs, steps, text_col)
    found = S.extract_all(seen, patterns, "__seen", merge_at=merge_at, least=least, around_col=around_col)
    return offsets.mapped_back(found, text_col).drop("__seen", "__map")


def detect_rows(docs: DataFrame, *keep: str, columns: tuple[str, ...], detectors=("enhanced", "healthcare", "financial", "rule_based"), text_col: str = "text", merge_at: float | None = 0.7, least: float = 0.5, strict: bool = False) -> DataFrame:
    """The spans of :func:`detect` as rows, see :func:`maskwell.operators.spans.extract_rows`."""
    patterns = S.select_patterns(detectors, dense=True)
    return S.extract_rows(docs, strict_patterns(patterns) if strict else patterns, *keep, columns=columns, text_col=text_col, merge_at=merge_at, least=least)


def _cut(docs: DataFrame, parts: tuple[str, ...], detectors, text_col: str, merge_at: float | None, least: float, strict: bool) -> DataFrame:
    patterns = S.select_patterns(detectors, dense=True)
    return S.extract_all(docs, strict_patterns(patterns) if strict else patterns, text_col, None, merge_at, least, cut_col="__cut", cut=parts)


def redact_docs(docs: DataFrame, out_col: str = "redacted_text", detectors=("enhanced", "healthcare", "financial", "rule_based"), text_col: str = "text", merge_at: float | None = 0.7, least: float = 0.5, strict: bool = False, **options) -> DataFrame:
    """What :func:`redact` gives of :func:`detect`, without the text and its spans, from one pass that hands on only gaps, the
    spans that stay and their numbers by type."""
    return redact(_cut(docs, ("own", "gaps", "types", "counts"), detectors, text_col, merge_at, least, strict), text_col, out_col, **options)


def redaction_counts(docs: DataFrame, detectors=("enhanced", "healthcare", "financial", "rule_based"), text_col: str = "text", merge_at: float | None = 0.7, least: float = 0.5, strict: bool = False) -> DataFrame:
    """``docs`` without the text, with ``redaction_count`` alone: neither texts nor spans leave the pass."""
    df = _cut(docs, ("types", "counts"), detectors, text_col, merge_at, least, strict)
    return df.withColumn("redaction_count", F.map_from_arrays("__cut.types", "__cut.counts")).drop("__cut")


def redact(found: DataFrame, text_col: str = "text", out_col: str = "redacted_text", **options) -> DataFrame:
    """``found`` (see :func:`detect`) with the redacted text and ``redaction_count``, a map of types; overlaps are resolved
    first, unless the pass has left that in ``__cut`` (``cut_col`` of :func:`maskwell.operators.scan.scan`)."""
    if "__cut" in found.columns:
        cut = F.col("__cut")
        df = found.withColumn(out_col, R.splice(cut["own"], cut, lambda x: R.replacement(x["type"], x["text"], **options)))
        return df.withColumn("redaction_count", F.map_from_arrays(cut["types"], cut["counts"])).drop("__cut")
    df = found.withColumn("__cut", R.cut(F.col(text_col), F.col("spans")))
    df = df.withColumn("__own", R.resolve(F.col("spans"), F.col("__cut")))
    df = df.withColumn(out_col, R.splice(F.col("__own"), F.col("__cut"), lambda x: R.replacement(x["type"], x["text"], **options)))
    types = F.array_distinct(F.transform("__own", lambda x: x["type"]))
    count = F.map_from_arrays(types, F.transform(types, lambda t: F.size(F.filter("__own", lambda x: x["type"] == t)).cast("long")))
    return df.withColumn("redaction_count", count).drop("__own", "__cut")


def _counted(values) -> object:
    """map<string, long> of an array's values, by value."""
    names = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(values, lambda v: v == n)).cast("long")))


def report(docs: DataFrame, *keep: str, text_col: str = "text", high: float = 0.8, detectors=("enhanced", "healthcare", "financial", "rule_based"), merge_at: float = 0.7, least: float = 0.5, **options) -> DataFrame:
    """The result of a detection as one row a document: success, candidates, summary and metadata, beside the columns kept and
    the text.  A candidate's metadata are its risk, its adjusted confidence and its context.  Narrow; ``to_json`` of a row is
    what an API hands out.  A null text is no success."""
    found = detect(docs, detectors, text_col=text_col, merge_at=merge_at, least=least, around_col="__around", **options)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keep])

    def candidate(z):
        s, around = z["s"], z["c"]
        own = F.struct(
            score.risk(s["type"], s["space"], s["confidence"]).alias("risk_level"), score.adjusted(s["type"], s["space"], s["source"], s["confidence"], s["text"], around).alias("adjusted_confidence"), around.alias("context")
        )
        return F.struct(
            F.substring(F.sha2(F.concat_ws("|", key, s["start"].cast("string"), s["end"].cast("string"), s["type"]), 256), 1, 32).alias("id"), s["type"].alias("type"), s["text"].alias("text"),
            s["confidence"].alias("confidence"), s["start"].alias("start_char"), s["end"].alias("end_char"), s["source"].alias("source"), own.alias("metadata"),
        )

    df = found.withColumn("candidates", F.transform(F.arrays_zip(F.col("spans").alias("s"), F.col("__around").alias("c")), candidate))
    own, text = F.col("candidates"), F.col(text_col)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    types = F.transform(own, lambda c: c["type"])
    summary = F.struct(
        F.size(own).cast("long").alias("total_entities"), F.size(F.filter(own, lambda c: c["confidence"] >= high)).cast("long").alias("high_confidence_entities"), F.array_distinct(types).alias("entity_types"),
        _counted(types).alias("entities_by_type"), _counted(F.transform(own, lambda c: c["metadata"]["risk_level"])).alias("risk_distribution"), F.length(text).cast("long").alias("text_length"),
        F.round(100 * F.size(own) / F.greatest(words, F.lit(1)), 2).alias("detection_coverage"),
    )
    settings = F.struct(F.lit(float(least)).alias("confidence_threshold"), F.lit(float(merge_at)).alias("merge_threshold"))
    meta = F.struct(F.array(*map(F.lit, detectors)).alias("detectors_used"), settings.alias("pipeline_settings"))
    return df.select(*keep, text_col, "spans", text.isNotNull().alias("success"), "candidates", summary.alias("summary"), meta.alias("metadata"))


def redact_result(results: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``results`` (see :func:`report`) with ``redaction``: success, error, redacted_text and counts.  A result that is no success,
    or has no text, is an error row with an empty text, and stops nothing."""
    done = redact(results, text_col, "__redacted", **options)
    error = F.when(~F.coalesce(F.col("success"), F.lit(False)), "Invalid detection result").when(F.coalesce(F.col(text_col), F.lit("")) == "", "No text to redact")
    fine = error.isNull()
    made = F.struct(fine.alias("success"), error.alias("error"), F.when(fine, F.col("__redacted")).otherwise("").alias("redacted_text"), F.when(fine, F.col("redaction_count")).alias("redaction_count"))
    return done.withColumn("redaction", made).drop("__redacted", "redaction_count")
