"""Secret scanning: fixed patterns plus a pair of character Markov models, in DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) are found left to right without
overlap.  Offsets come from the lengths of the matches and of the gaps between
them (``regexp_extract_all`` and ``split`` with the same pattern), so nothing is
marked in the text and no Python runs.

The method's own kind is ``markov``: every run of key characters (``TOKEN``) is scored by the
log-likelihood ratio of two first-order character models, one of random strings and
one of ordinary identifiers, summed over its transitions: a short token must look more
random than a long one.  Both are trained with DataFrame aggregates from labelled samples
(token, label); the model is a table of (alphabet + 1)^2 numbers.  A part of the samples, chosen
by hash, takes no part in the counts; the least score is calibrated on it: midway between the score
that all but ``ERROR_RATE`` of its ordinary tokens stay below and the one that all but as many
of its random tokens reach, and not below 0.  A token that reaches the least score and that base spans do not
cover whole is reported; it may overlap base spans.

Defined results: null text counts as empty and has no spans; texts of any length
are read whole; equal texts give equal results; other columns are handed on
untouched by :func:`scan` (its own columns replace any of the same name).
"""

from __future__ import annotations

import math
import random
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"  # a run of the class is always matched whole, so the length can stand in the pattern
KINDS = ("assign", "access", "hex")
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"  # with base-64 padding
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SMOOTHING = 2.0  # what was seldom seen is no strong sign
HELD_OUT = 4  # one labelled token in so many calibrates
ERROR_RATE = 0.001

#: Ordinary identifier parts of the built-in labelled sample.
WORDS = (
    "account action address agent array async auth base batch begin block buffer build byte cache call chain change channel char check child class clean client close code collect column command commit common compile config connect content context control copy count create current data date debug decode default delete depth detail device dict diff direct document domain double driver dump edit element email empty encode engine entry error event exception execute export factory fetch field file filter find first flag float folder format frame from function generate global group handle hash header height helper host html http image import index info init input insert instance integer item iterate join json key label last layer length level library limit line link list load local lock logger login loop main manager mapping match memory merge message method metric middle mode model module monitor mouse name network node normal notify null number object offset open option order output package page panel parent parse partition path pattern pending pixel point pool position post prefix print private process profile project property protocol provider public query queue random range read record reference refresh register release remote remove render replace report request reset resolve resource response result return root route row rule runtime sample schema scope screen script search section select sequence server service session setting shape shared signal simple size socket sort source split stack start state static status storage store stream string struct style submit suffix switch symbol sync system table target task template test text thread time title token total trace transaction transform tree trigger tuple type unique unit update upload user util valid value variable vector version view visible wait width window word worker wrapper write zone"
).split()
#: Parts of syllables of the built-in sample's words of any tongue.
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p pf ph pl pr qu r s sch sh sl sp st str t th tr v w wh x y z zw".split() + [""] * 8
VOWELS = "a e i o u a e i o ai au ea ee ei eu ie io oa oe oo ou ui y".split()
CODAS = "b c ch ck d f g k l ll ld m mp n nd ng nn ns nt p pf r rd rn rs rt s ss st t th tt tz x z".split() + [""] * 16


class Model(NamedTuple):
    ratios: list[float]  # of all transitions, row by row of the alphabet (its last symbol: any other character)
    least: float  # the score from which a token counts as random


def default_samples(spark: SparkSession, size: int = 12_000, seed: int = 11) -> DataFrame:
    """Labelled tokens: 1 for strings drawn at random from hex, base-32, -36, -62 and both -64 digits, 0 for identifiers,
    paths and long words put together of WORDS in the usual spellings, for words of any tongue (syllables of ONSETS,
    VOWELS and CODAS), and for numbers, dates and ruling lines.
    ``size`` bounds the sample."""
    rng = random.Random(seed)
    digits = ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    rows = [("".join(rng.choice(d) for _ in range(rng.randint(16, 44))), 1) for d in digits for _ in range(size // 2 // len(digits))]
    for _ in range(size // 2):
        parts = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        titles, number = [p.title() for p in parts], str(rng.randint(1, 2030))
        spelt = ("_".join(parts), "_".join(parts).upper(), "-".join(parts), parts[0] + "".join(titles[1:]), "".join(titles), "/".join(parts), "".join(parts), "/" + "/".join(parts[:-1]) + "/" + "-".join(parts[:2]))
        other = ("".join(rng.choice("0123456789") for _ in range(rng.randint(16, 24))), f"{rng.randint(1970, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", rng.choice("-=_+/") * rng.randint(16, 80))
        spoken = "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(rng.randint(4, 8)))
        text = rng.choice(spelt) if (kind := rng.random()) < 0.6 else rng.choice((spoken, spoken.title())) if kind < 0.9 else rng.choice(other)
        rows.append((text + (rng.choice(("", "_", "-", "/")) + number if rng.random() < 0.3 else ""), 0))
    return spark.createDataFrame(rows, "token string, label int")


def train(samples: DataFrame, smoothing: float = SMOOTHING, held_out: int = HELD_OUT, error_rate: float = ERROR_RATE) -> Model:
    """The ratios from the samples' larger part, the least score from the rest."""
    n = len(ALPHABET) + 1
    long = samples.filter("length(token) > 1").withColumn("held", F.pmod(F.crc32("token"), F.lit(held_out)) == 0)
    pairs = long.filter("not held").select("label", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"), "token")
    pairs = pairs.select("label", code_at(F.col("token"), F.col("i"), n).alias("a"), code_at(F.col("token"), F.col("i") + 1, n).alias("b"))
    counts = {0: [[smoothing] * n for _ in range(n)], 1: [[smoothing] * n for _ in range(n)]}
    for r in pairs.groupBy("label", "a", "b").count().collect():  # 2 n^2 rows at most
        counts[r.label][r.a][r.b] += r["count"]
    ratios = [math.log(counts[1][a][b] / sum(counts[1][a])) - math.log(counts[0][a][b] / sum(counts[0][a])) for a in range(n) for b in range(n)]
    held = long.filter("held").select("label", score(F.col("token"), ratios).alias("score"))
    edges = {r.label: (r.low, r.high) for r in held.groupBy("label").agg(F.percentile("score", F.lit(error_rate)).alias("low"), F.percentile("score", F.lit(1 - error_rate)).alias("high")).collect()}
    ordinary, chance = edges.get(0, (0.0, 0.0))[1], edges.get(1, (0.0, 0.0))[0]
    return Model(ratios, max(0.0, (ordinary + chance) / 2))


def score(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token: positive where the model of random strings explains it better."""
    n, table = len(ALPHABET) + 1, F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    place = lambda i: (code_at(token, i, n) * n + code_at(token, i + 1, n) + 1).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, place(i)))


def code_at(token: Column, at: Column, n: int) -> Column:
    place = F.instr(F.lit(ALPHABET), F.substring(token, at, F.lit(1)))
    return F.when(place > 0, place - 1).otherwise(n - 1)


def _spans(text: str, pattern: str, kind: str, keep: str = "true") -> str:
    """SQL of array<struct<start, end, kind, hit>> for all matches of ``pattern`` in column ``text``.

    The fold carries (position, spans) over the gaps before each match.
    """
    lit = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    hits, gaps = f"regexp_extract_all({text}, {lit}, 0)", f"split({text}, {lit}, -1)"
    step = "named_struct('at', s.at + length(p.gap) + length(p.hit), 'out', concat(s.out, array(named_struct('start', s.at + length(p.gap), 'end', s.at + length(p.gap) + length(p.hit), 'hit', p.hit))))"
    folded = (
        f"aggregate(zip_with({hits}, {gaps}, (h, g) -> named_struct('hit', h, 'gap', g)), "
        "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,hit:string>>)), "
        f"(s, p) -> if(p.hit is null, s, {step}), s -> s.out)"
    )
    return f"transform(filter({folded}, x -> {keep}), x -> named_struct('start', x.start, 'ord', {KINDS.index(kind) if kind in KINDS else len(KINDS)}, 'end', x.end, 'kind', '{kind}', 'hit', x.hit))"


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``found``: array<struct<start, ord, end, kind, hit>> ordered by start, then kind."""
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,hit:string>>)")
    df = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    group2 = "length(regexp_extract(x.hit, '" + ASSIGN.replace("\\", "\\\\").replace("'", "\\'") + "', 2)) >= 12"
    for kind, pattern, keep in (("assign", ASSIGN, group2), ("access", ACCESS, "true"), ("hex", HEX, "true"), ("markov", TOKEN, "true")):
        df = df.withColumn(f"__{kind}", F.when(F.col("__text").rlike(pattern), F.expr(_spans("__text", pattern, kind, keep))).otherwise(none))
    df = df.withColumn("base", F.sort_array(F.concat("__assign", "__access", "__hex")))

    def free(x: Column) -> Column:
        """Base spans, in order of start, leave some of the token uncovered."""
        reach = F.aggregate("base", x["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
        return reach < x["end"]

    extra = F.filter("__markov", lambda x: free(x) & (score(x["hit"], model.ratios) >= model.least))
    df = df.withColumn("found", F.sort_array(F.concat("base", F.when(F.size("__markov") > 0, extra).otherwise(none))))
    return df.drop("__text", *[f"__{k}" for k in (*KINDS, "markov")])


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The input with every span found replaced by ``mask`` (overlapping spans by one); a null text stays null."""
    df = scan(docs, model, text_col)
    folded = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).alias("out"),
        ),
    )
    done = df.withColumn("__done", folded)
    rest = F.expr(f"substring(`{text_col}`, __done.at + 1)")
    clean = F.when(F.size("found") > 0, F.concat(F.col("__done.out"), rest)).otherwise(F.col(text_col))
    return done.withColumn(text_col, clean).drop("__done", "base", "found")
