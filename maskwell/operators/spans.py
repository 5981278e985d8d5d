"""Span extraction, merging and enrichment.

A span is struct<start, end, type, space, source, confidence, text, subtype>; offsets count code
points from 0, ``end`` is exclusive.  Extraction is row-local and needs no shuffle, no window and
no Python, so the same code serves batch and streaming frames: matches and the gaps between them
give the offsets.  A whole plan of patterns goes through :func:`extract_all`, one Arrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import score, validate
from ..plans.catalog import DENSE_TYPES, DETECTORS, Pattern
from .scan import ROW, rows, scan

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("space", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("subtype", T.StringType()),
    ]
)
SPANS = T.ArrayType(SPAN)


def matches(text: Column, regex: str, group: int = 0) -> Column:
    """array<struct<start, end, text>> of all matches, or of their capture group: its first place from the match on."""
    lit = F.lit(regex)
    hits = F.regexp_extract_all(text, lit, F.lit(0))
    groups = F.regexp_extract_all(text, lit, F.lit(group)) if group else hits
    gaps = F.split(text, regex, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    rows = F.zip_with(F.zip_with(hits, groups, lambda h, g: F.struct(h.alias("h"), g.alias("g"))), gaps, lambda hg, gap: F.struct(hg["h"].alias("h"), hg["g"].alias("g"), gap.alias("gap")))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["gap"])
        low = at + (F.instr(p["h"], p["g"]) - 1 if group else 0)
        return F.when(p["h"].isNull(), s).otherwise(F.struct((at + F.length(p["h"])).alias("at"), F.concat(s["out"], F.array(F.struct(low.alias("start"), (low + F.length(p["g"])).alias("end"), p["g"].alias("text")))).alias("out")))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(regex), found).otherwise(none)


def _kept(p: Pattern, found: Column) -> Column:
    """The detector's own filter and confidence, per match."""
    checked = found
    if p.detector == "rule_based" and p.type in ("credit_card", "ssn", "ip_address"):
        checked = F.filter(found, lambda x: validate.legacy_keeps(F.lit(p.type), x["text"]))
    elif p.detector == "enhanced":
        checked = F.filter(found, lambda x: F.length(x["text"]) >= 2)

    def span(x: Column) -> Column:
        confidence = F.lit(float(p.confidence))
        if p.detector == "enhanced" and p.type in ("credit_card", "email", "ssn", "date", "date_of_birth"):
            valid = validate.by_type(F.lit(p.type), x["text"])
            confidence = F.when(valid, F.least(F.lit(1.0), confidence * 1.2)).when(~valid, confidence * 0.5).otherwise(confidence)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(p.type).alias("type"), F.lit(p.space).alias("space"), F.lit(p.detector).alias("source"),
            F.round(confidence, 6).alias("confidence"), x["text"].alias("text"), F.lit(p.subtype).alias("subtype"),
        )

    return F.transform(checked, span)


def select_patterns(detectors=("enhanced", "healthcare", "financial", "rule_based"), types=None, dense: bool = False, custom: list[Pattern] | None = None) -> list[Pattern]:
    """The patterns a plan needs: those of other types never enter it."""
    found = [p for d in detectors for p in DETECTORS[d]] + list(custom or [])
    return [p for p in found if (types is None or p.type in types) and (dense or not _dense(p))]


def extract(df: DataFrame, patterns: list[Pattern], text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``df`` with array<span> ``out_col``, in order of pattern, then place."""
    parts = [_kept(p, matches(F.col(text_col), p.full, p.group)) for p in patterns]
    none = F.lit(None).cast(SPANS)
    return df.withColumn(out_col, F.concat(F.filter(F.array(F.lit(None).cast(SPAN)), lambda x: x.isNotNull()), *parts) if parts else F.coalesce(none, F.array().cast(SPANS)))


def _dense(p: Pattern) -> bool:
    return p.detector == "enhanced" and p.type in DENSE_TYPES


def extract_all(df: DataFrame, patterns: list[Pattern], text_col: str = "text", out_col: str | None = "spans", merge_at: float | None = None, least: float | None = None, around_col: str | None = None, **cut) -> DataFrame:
    """As :func:`extract`, then :func:`merge` and :func:`threshold` if asked for, in one Arrow pass (see :mod:`scan`); the way for
    many patterns, and for those that match almost every word."""
    return scan(df, patterns, SPAN, text_col, out_col, merge_at, least, around_col, score.WINDOW, **cut)


COLUMNS = tuple(c for f, c in ROW.items() if f != "around")  # those of :func:`explode`


def extract_rows(df: DataFrame, patterns: list[Pattern], *keep: str, columns: tuple[str, ...] = COLUMNS, text_col: str = "text", merge_at: float | None = None, least: float | None = None) -> DataFrame:
    """What :func:`explode` gives of :func:`extract_all`, straight from the pass; ``columns`` may have ``context`` too."""
    return rows(df, patterns, SPAN, *keep, columns=columns, text_col=text_col, merge_at=merge_at, least=least, window=score.WINDOW)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over hull, 0 for disjoint spans."""
    inter = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    return F.when(inter > 0, inter / (F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"]))).otherwise(F.lit(0.0))


def fold(spans: list[dict], threshold: float) -> list[dict]:
    """Ordered greedy merge: by start, each span joins the first earlier one it overlaps enough, which grows.

    Only spans that reach past the current start can overlap it, so the others are retired.
    """
    done: list[dict] = []
    live: list[int] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        live = [i for i in live if done[i]["end"] > s["start"]]
        for i in live:
            e = done[i]
            inter = min(e["end"], s["end"]) - max(e["start"], s["start"])
            hull = max(e["end"], s["end"]) - min(e["start"], s["start"])
            if inter > 0 and inter / hull >= threshold:
                a, b = e["end"] - e["start"], s["end"] - s["start"]
                base = e if e["confidence"] >= s["confidence"] else s
                mean = (e["confidence"] * a + s["confidence"] * b) / (a + b)
                done[i] = {**base, "start": min(e["start"], s["start"]), "end": max(e["end"], s["end"]), "confidence": min(1.0, mean), "source": f"{e['source']}+{s['source']}"}
                break
        else:
            live.append(len(done))
            done.append(dict(s))
    return done


def merge(df: DataFrame, threshold: float = 0.7, col: str = "spans") -> DataFrame:
    """Spans merged within each row; no shuffle.  The fold is ordered and not associative, so it is an Arrow UDF over the row's array."""

    @F.pandas_udf(SPANS)
    def folded(rows):
        return rows.map(lambda spans: fold([dict(s) for s in spans], threshold), na_action="ignore")

    return df.withColumn(col, F.when(F.size(col) > 1, folded(F.col(col))).otherwise(F.col(col)))


def threshold(df: DataFrame, least: float = 0.5, col: str = "spans") -> DataFrame:
    """Spans of confidence ``least`` and more, the surest first, else in order."""
    kept = F.filter(F.col(col), lambda x: x["confidence"] >= least)
    keyed = F.transform(kept, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x.alias("x")))
    return df.withColumn(col, F.transform(F.array_sort(keyed), lambda k: k["x"]))


def explode(df: DataFrame, *keep: str, col: str = "spans", around_col: str | None = None) -> DataFrame:
    """One row a span, its fields as columns ``start_char``, ``end_char``, ``type`` and so on, beside the columns kept; with
    ``around_col`` also its ``context``."""
    each = F.arrays_zip(F.col(col).alias("s"), F.col(around_col).alias("c")) if around_col else F.transform(col, lambda x: F.struct(x.alias("s")))
    return df.select(*keep, F.explode(each).alias("__s")).select(
        *keep, F.col("__s.s.start").alias("start_char"), F.col("__s.s.end").alias("end_char"), F.col("__s.s.type").alias("type"), F.col("__s.s.space").alias("space"), F.col("__s.s.source").alias("source"),
        F.col("__s.s.confidence").alias("confidence"), F.col("__s.s.text").alias("entity"), F.col("__s.s.subtype").alias("subtype"), *([F.col("__s.c").alias("context")] if around_col else []),
    )


def span_id(*keys: str) -> Column:
    """A deterministic id."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 32)


def enrich(spans: DataFrame, text_col: str = "text", strict: bool = False) -> DataFrame:
    """Span rows (with their context, or their whole text, beside) with context, risk, validation flags and ``adjusted`` confidence."""
    out = spans if "context" in spans.columns else spans.withColumn("context", score.context(F.col(text_col), F.col("start_char"), F.col("end_char")))
    out = out.withColumn("risk", score.risk(F.col("type"), F.col("space"), F.col("confidence"), strict))
    return out.withColumn("adjusted", score.adjusted(F.col("type"), F.col("space"), F.col("source"), F.col("confidence"), F.col("entity"), F.col("context")))


def ensemble(spans: DataFrame, *keys: str) -> DataFrame:
    """Votes on equal (start, end, type): the mean confidence with 0.1 for each further detector, 0.2 at most, capped at 1."""
    by = [*keys, "start_char", "end_char", "type"]
    voted = spans.groupBy(*by).agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("__mean"), F.array_sort(F.collect_list("source")).alias("sources"))
    lifted = F.least(F.lit(1.0), F.col("__mean") + F.least(F.lit(0.2), 0.1 * (F.col("votes") - 1)))
    return voted.select(*by, "votes", F.round(F.when(F.col("votes") > 1, lifted).otherwise(F.col("__mean")), 6).alias("confidence"), "sources")


def chunks(text: Column, size: int = 512) -> Column:
    """Sentences packed in order into chunks of at most ``size`` characters (a longer sentence is its own): array<struct<start, text>> with true offsets."""
    parts = F.transform(F.split(text, r"(?<=\. )", -1), lambda p: p)
    none = F.expr("cast(array() as array<struct<start:int,text:string>>)")
    folded = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("start"), F.lit("").alias("held"), none.alias("out")),
        lambda s, p: F.when(F.length(s["held"]) + F.length(p) <= size, F.struct(s["start"].alias("start"), F.concat(s["held"], p).alias("held"), s["out"].alias("out"))).otherwise(
            F.struct((s["start"] + F.length(s["held"])).alias("start"), p.alias("held"), F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["held"].alias("text"))))).alias("out"))
        ),
        lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["held"].alias("text"))))),
    )
    return folded
