"""Detectors as plug-ins: a registry of named detectors that run side by side in one Arrow pass.

A detector gives spans of a text; one that raises costs its own spans of that row and leaves an entry in ``errors``, the
others' spans stay.  A detector with a model is given as a factory, which a task calls once.  Tagging models (token labels
with B- and I- prefixes) are wrapped by :func:`tagger`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import CONTEXT_TYPES, KNOWLEDGE_TYPES, MODEL_LABELS, Pattern
from .scan import BATCH_BYTES, Scanner, merged
from .spans import SPAN

ERROR = T.StructType([T.StructField("detector", T.StringType()), T.StructField("error", T.StringType())])

Found = Iterable[tuple]  # (start, end, type, confidence) of a text, with a subtype at will
Tagged = Iterable[tuple[int, int, str, float]]  # (start, end, label, score) of a chunk's tokens, in order


@dataclass(frozen=True)
class Detector:
    """``make()`` gives the function from a text to its spans."""

    name: str
    types: tuple[str, ...]
    make: Callable[[], Callable[[str], Found]]
    enabled: bool = True
    space: str = "entity"


def of_function(name: str, types: Iterable[str], find: Callable[[str], Found], **more) -> Detector:
    return Detector(name, tuple(types), lambda: find, **more)


def of_patterns(name: str, patterns: list[Pattern]) -> Detector:
    """A detector of the catalog's patterns, with their validators."""

    def make():
        scanner = Scanner(patterns)

        def find(text):
            for a, b, i, c in zip(*scanner.spans(text), strict=True):
                yield a, b, patterns[i].type, c, patterns[i].subtype

        return find

    return Detector(name, tuple(sorted({p.type for p in patterns})), make, space=patterns[0].space if patterns else "entity")


class Registry:
    """Detectors by name, in order of addition; a name added again replaces the former in its place."""

    def __init__(self, *detectors: Detector):
        self.detectors: dict[str, Detector] = {}
        for d in detectors:
            self.add(d)

    def add(self, d: Detector) -> Registry:
        self.detectors[d.name] = d
        return self

    def remove(self, name: str) -> bool:
        return self.detectors.pop(name, None) is not None

    def enable(self, name: str, on: bool = True) -> None:
        self.detectors[name] = replace(self.detectors[name], enabled=on)

    def types(self) -> dict[str, tuple[str, ...]]:
        return {d.name: d.types for d in self.detectors.values() if d.enabled}

    def detect(self, df: DataFrame, text_col: str = "text", types: set[str] | None = None, merge_at: float | None = 0.8, least: float | None = 0.5) -> DataFrame:
        """``df`` with array<span> ``spans`` (merged, those of ``least`` confidence, the surest first) and array ``errors``."""
        own = [d for d in self.detectors.values() if d.enabled and (types is None or types & set(d.types))]
        kept = [f for f in df.schema.fields if f.name not in ("spans", "errors")]
        schema = T.StructType([*kept, T.StructField("spans", T.ArrayType(SPAN)), T.StructField("errors", T.ArrayType(ERROR))])

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc
            from pyspark.sql.pandas.types import to_arrow_type

            kinds = [to_arrow_type(T.ArrayType(k)) for k in (SPAN, ERROR)]
            finders = [(d, *_made(d)) for d in own]

            def look(text):
                rows, errors = [], []
                for d, find, broken in finders:
                    try:
                        if broken:
                            raise broken
                        found = [(*x, "")[:5] for x in find(text)]
                        found = [x for x in found if types is None or x[2] in types]
                        if any(not 0 <= x[0] <= x[1] <= len(text) for x in found):
                            raise ValueError("a span outside the text")
                        rows += [(*x, d) for x in found]
                    except Exception as e:  # this detector's row, and no more
                        errors.append({"detector": d.name, "error": f"{type(e).__name__}: {e}"[:200]})
                return _joined(text, rows, merge_at, least), errors

            for batch in batches:
                text = batch.column(batch.schema.get_field_index(text_col))
                sizes, a, held = pc.fill_null(pc.binary_length(text), 0).to_pylist(), 0, 0
                for b, size in enumerate(sizes, 1):
                    held += size
                    if held >= BATCH_BYTES or b == len(sizes):
                        seen = [look(t) if t is not None else ([], []) for t in text.slice(a, b - a).to_pylist()]
                        part = batch.slice(a, b - a)
                        columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([s[i] for s in seen], kinds[i]) for i in (0, 1))], names=schema.names)
                        a, held = b, 0

        return df.mapInArrow(run, schema)


def _made(d: Detector):
    try:
        return d.make(), None
    except Exception as e:  # a model that cannot be loaded
        return None, e


def _joined(text: str, rows: list[tuple], merge_at: float | None, least: float | None) -> list[dict]:
    starts, ends, sure = ([r[i] for r in rows] for i in (0, 1, 3))
    base, parts, shown = list(range(len(rows))), [[i] for i in range(len(rows))], (starts, ends)
    if merge_at is not None:
        starts, ends, sure, base, parts = merged(starts, ends, sure, merge_at)
    out = []
    for a, b, c, i, made in zip(starts, ends, sure, base, parts, strict=True):
        if least is None or c >= least:
            source = "+".join(rows[j][5].name for j in made)
            out.append({"start": a, "end": b, "type": rows[i][2], "space": rows[i][5].space, "source": source, "confidence": float(c), "text": text[shown[0][i] : shown[1][i]], "subtype": rows[i][4]})
    return sorted(out, key=lambda s: -s["confidence"]) if least is not None else out


# ---------------------------------------------------------------- tagging models


def bare(label: str) -> str:
    """A label without its B- or I-."""
    return (label[2:] if label[:2].upper() in ("B-", "I-") else label).upper()


def folded(tagged: Tagged) -> list[tuple[int, int, str, float]]:
    """Token labels as spans: an I- goes on with the span before it if the label is the same and no O stands between; a B- or
    another label begins a new one.  The score is the mean of the tokens'."""
    out: list[list] = []
    last = "O"
    for start, end, label, score in tagged:
        if label.upper() == "O":
            last = "O"
            continue
        name = bare(label)
        if out and last == name and label[:2].upper() != "B-":
            out[-1][1] = end
            out[-1][3].append(score)
        else:
            out.append([start, end, name, [score]])
        last = name
    return [(a, b, name, sum(scores) / len(scores)) for a, b, name, scores in out]


def pieces(text: str, most: int = 512) -> list[tuple[int, str]]:
    """Sentences packed in order into pieces of at most ``most`` characters, with their true places; a longer sentence is cut."""
    out, start, held = [], 0, 0
    for end in [i + 2 for i in range(len(text)) if text.startswith(". ", i)] + [len(text)]:
        if held > start and end - start > most:
            out.append((start, text[start:held]))
            start = held
        while end - start > most:
            out.append((start, text[start : start + most]))
            start += most
        held = end
    return [*out, (start, text[start:])] if start < len(text) else out


def tagger(name: str, load: Callable[[], Callable[[str], Tagged]], labels: dict[str, str] = MODEL_LABELS, default: str | None = None, most: int = 512, space: str = "entity") -> Detector:
    """A detector of a tagging model: ``load()`` gives the function from a piece of text to its tagged tokens.  Labels become
    types; those that ``labels`` lacks take ``default``, or are dropped."""

    def make():
        tag = load()

        def find(text):
            for at, piece in pieces(text, most):
                for a, b, label, score in folded(tag(piece)):
                    if type_ := labels.get(label, default):
                        yield at + a, at + b, type_, score, label

        return find

    return Detector(name, tuple(sorted({*labels.values(), *([default] if default else [])})), make, space=space)


# ---------------------------------------------------------------- labels as columns


def label_type(label: Column, labels: dict[str, str] = MODEL_LABELS, default: str | None = None) -> Column:
    """The type of a model's label, its B- or I- left out; ``default``, or null, for one that ``labels`` lacks."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.regexp_replace(label, "^[BbIi]-", ""))), F.lit(default))


def knowledge_type(type_: Column) -> Column:
    """A knowledge-base type as an entity type; custom for others."""
    return F.when(F.lower(type_).isin(*KNOWLEDGE_TYPES), F.lower(type_)).otherwise("custom")


def context_type(word: Column) -> Column:
    """The type that a context word speaks of, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CONTEXT_TYPES.items() for x in kv]), F.lower(word))
