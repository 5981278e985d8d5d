"""Redaction of one value: Column -> Column, and of a text with spans."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import GENERAL_LABELS

MASK = "X"
# Own lists for pseudonyms.
FIRST = ("Alex", "Blake", "Casey", "Drew", "Emery", "Finley", "Harper", "Jordan")
LAST = ("Abbot", "Barnes", "Carver", "Dalton", "Ellis", "Foster", "Garner")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def mask_default(c: Column, mask: str = MASK) -> Column:
    n = F.length(c)
    return F.when(n > 2, F.concat(F.substring(c, 1, 1), F.repeat(F.lit(mask), n - 2), F.substring(c, -1, 1))).when(n == 2, F.concat(F.substring(c, 1, 1), F.lit(mask))).otherwise(F.lit(mask))


def full_mask(c: Column, mask: str = MASK, preserve_length: bool = True) -> Column:
    return F.repeat(F.lit(mask), F.length(c) if preserve_length else F.lit(5))


def _keep_last_four(c: Column, mask: str) -> Column:
    """Digits but the last four masked, other characters kept."""
    return F.regexp_replace(c, r"[0-9](?=(?:[^0-9]*[0-9]){4})", mask)


def mask_card(c: Column, mask: str = MASK, preserve_format: bool = True) -> Column:
    d = _digits(c)
    plain = F.concat(F.repeat(F.lit(mask), F.length(d) - 4), F.substring(d, -4, 4))
    kept = F.when(c.rlike("[- ]"), _keep_last_four(c, mask)).otherwise(plain) if preserve_format else plain
    return F.when(F.length(d) < 4, mask_default(c, mask)).otherwise(kept)


def mask_ssn(c: Column, mask: str = MASK) -> Column:
    d = _digits(c)
    head = F.when(F.contains(c, F.lit("-")), F.lit(f"{mask * 3}-{mask * 2}-")).otherwise(F.lit(mask * 5))
    return F.when(F.length(d) == 9, F.concat(head, F.substring(d, -4, 4))).otherwise(mask_default(c, mask))


def mask_phone(c: Column, mask: str = MASK, preserve_format: bool = True) -> Column:
    d = _digits(c)
    kept = _keep_last_four(c, mask) if preserve_format else F.concat(F.repeat(F.lit(mask), F.length(d) - 4), F.substring(d, -4, 4))
    return F.when(F.length(d) < 4, mask_default(c, mask)).otherwise(kept)


def mask_email(c: Column, mask: str = MASK) -> Column:
    user = F.substring_index(c, "@", 1)
    masked = F.concat(F.substring(user, 1, 1), F.repeat(F.lit(mask), F.length(user) - 1), F.substring(c, F.length(user) + 1, F.length(c)))
    return F.when(F.contains(c, F.lit("@")) & (F.length(user) > 1), masked).otherwise(mask_default(c, mask))


def mask_name(c: Column, mask: str = MASK) -> Column:
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda p: p != "")
    masked = F.array_join(F.transform(parts, lambda p: F.concat(F.substring(p, 1, 1), F.repeat(F.lit(mask), F.length(p) - 1))), " ")
    return F.when(F.size(parts) >= 2, masked).otherwise(mask_default(c, mask))


def partial_mask(type_: Column, c: Column, mask: str = MASK, preserve_format: bool = True) -> Column:
    return (
        F.when(type_ == "credit_card", mask_card(c, mask, preserve_format))
        .when(type_ == "ssn", mask_ssn(c, mask))
        .when(type_ == "phone", mask_phone(c, mask, preserve_format))
        .when(type_ == "email", mask_email(c, mask))
        .when(type_.isin("person_name", "person"), mask_name(c, mask))
        .otherwise(mask_default(c, mask))
    )


def generalize(type_: Column, c: Column) -> Column:
    labels = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in GENERAL_LABELS.items()))
    return F.coalesce(F.try_element_at(labels, type_), F.concat(F.lit("["), F.upper(type_), F.lit("]")))


def hash_token(c: Column) -> Column:
    return F.concat(F.lit("TOK_"), F.substring(F.sha2(c, 256), 1, 15))


def keyed_token(c: Column, key: str) -> Column:
    """The same token for the same value and key; a vault (:func:`vault`) turns it back."""
    return F.concat(F.lit("TOK_"), F.substring(F.sha2(F.concat(F.lit(key), F.lit(":"), c), 256), 1, 24))


def vault(values: DataFrame, key: str, value_col: str = "value") -> DataFrame:
    """token, sealed: one row a distinct value, sealed with AES under the key."""
    own = values.select(F.col(value_col).alias("__v")).filter("__v is not null").distinct()
    secret = F.unhex(F.substring(F.sha2(F.lit(key), 256), 1, 32))
    return own.select(keyed_token(F.col("__v"), key).alias("token"), F.aes_encrypt("__v", secret, F.lit("GCM")).alias("sealed"))


def reveal(tokens: DataFrame, sealed: DataFrame, key: str, token_col: str = "token") -> DataFrame:
    """``tokens`` with the ``value`` of each token in the vault, null for others."""
    secret = F.unhex(F.substring(F.sha2(F.lit(key), 256), 1, 32))
    return tokens.join(sealed.select(F.col("token").alias(token_col), "sealed"), token_col, "left").withColumn("value", F.aes_decrypt("sealed", secret, F.lit("GCM")).cast("string")).drop("sealed")


def _pick(c: Column, salt: str, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def pseudonym(type_: Column, c: Column, salt: str = "") -> Column:
    """A stand-in that depends on the value, the type and the salt alone."""
    first = F.element_at(F.array(*map(F.lit, FIRST)), _pick(c, salt + "f", len(FIRST)) + 1)
    last = F.element_at(F.array(*map(F.lit, LAST)), _pick(c, salt + "l", len(LAST)) + 1)
    number = F.lpad(_pick(c, salt + "n", 10000).cast("string"), 4, "0")
    return (
        F.when(type_.isin("person_name", "person"), F.concat_ws(" ", first, last))
        .when(type_ == "email", F.concat(F.lit("user"), number, F.lit("@example.com")))
        .when(type_ == "phone", F.concat(F.lit("(555) 000-"), number))
        .when(type_ == "address", F.concat(number, F.lit(" Main Street")))
        .otherwise(F.concat(F.lit("PSEUDONYM_"), type_, F.lit("_"), F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 8)))
    )


def replacement(type_: Column, c: Column, default: str = "partial_mask", per_type: dict | None = None, custom: dict | None = None, mask: str = MASK, preserve_format: bool = True, preserve_length: bool = True, key: str | None = None) -> Column:
    """What a span becomes: a custom text first, then the type's strategy or the default."""

    def apply(strategy: str) -> Column:
        return {
            "full_removal": lambda: F.lit(""),
            "full_mask": lambda: full_mask(c, mask, preserve_length),
            "partial_mask": lambda: partial_mask(type_, c, mask, preserve_format),
            "tokenization": lambda: keyed_token(c, key) if key else hash_token(c),
            "pseudonymization": lambda: pseudonym(type_, c),
            "generalization": lambda: generalize(type_, c),
            "none": lambda: c,
        }[strategy]()

    out = apply(default)
    for name, strategy in (per_type or {}).items():
        out = F.when(type_ == name, apply(strategy)).otherwise(out)
    for name, text in (custom or {}).items():
        out = F.when(type_ == name, F.lit(text)).otherwise(out)
    return out


CUT = "struct<own:array<int>,gaps:array<string>>"


def cut(text: Column, spans: Column) -> Column:
    """Where ``text`` is replaced: of spans that overlap, in order of start, the first and longest stays.  ``own`` has the
    places in ``spans`` of those that stay, ``gaps`` the text before, between and after them (as it is, if none stays)."""

    @F.pandas_udf(CUT)
    def cut_(texts, starts, ends):
        import pandas as pd

        rows = []
        for text_, a, b in zip(texts, starts, ends, strict=True):
            if text_ is None or a is None:
                rows.append(([], [text_]))
                continue
            a, b = a.tolist(), b.tolist()
            own, gaps, at = [], [], 0
            for i in sorted(range(len(a)), key=lambda i: (a[i], -b[i])):
                if a[i] >= at:
                    own.append(i)
                    gaps.append(text_[at : a[i]])
                    at = b[i]
            rows.append((own, [*gaps, text_[at:]]))
        return pd.DataFrame(rows, columns=["own", "gaps"])

    return cut_(text, F.transform(spans, lambda x: x["start"]), F.transform(spans, lambda x: x["end"]))


def resolve(spans: Column, cut_: Column) -> Column:
    """The spans that stay, in order."""
    return F.transform(cut_["own"], lambda i: F.get(spans, i))


def splice(own: Column, cut_: Column, of) -> Column:
    """The text with each span of ``own`` (see :func:`resolve`) replaced by ``of(span)``; no piece is copied twice."""
    gaps = cut_["gaps"]
    pieces = F.transform(own, lambda x, i: F.concat(F.get(gaps, i), of(x)))
    return F.when(F.size(own) > 0, F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))).otherwise(F.element_at(gaps, 1))
