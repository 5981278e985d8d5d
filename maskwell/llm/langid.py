"""Language identification in two levels: family, then pairs of languages within it.

A text is the square root of its relative counts of hashed byte n-grams (1 to 4,
lower case), so its length is 1 whatever the text's.  Level 1: one linear support
vector machine a family against the rest.  Level 2: within the chosen family, one
machine for every pair of languages; most votes win, margins break ties.  Machines are
fitted in numpy (squared hinge loss, accelerated gradient) on a sample of at most
``PER_LANGUAGE`` labelled texts a language, drawn evenly by a hash of the id.

Defined results: a null text or one without a letter is ``und`` with score 0; equal
texts agree; whole texts count; with one language learned every lettered text is that
language; without labelled rows every text is ``und``; other columns are handed on
(``lang_pred`` and ``score`` are replaced).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow

BITS = 12
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 600
REGULAR, STEPS = 1e-4, 80

# Families of ISO 639-1 codes.  A code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tk uz",
    "indic": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def vector(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    counts = np.zeros(1 << BITS)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        mixed = (code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        counts += np.bincount(mixed, minlength=1 << BITS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, regular: float = REGULAR, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias for labels +1 and -1; the two classes weigh alike."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = look = np.zeros(x1.shape[1], np.float32)
    step, t = 0.25, 1.0  # rows have length 2**0.5, so the gradient's slope is below 4
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x1 @ look))
        grad = regular * look - 2 * x1.T @ (share * y * gap)
        new = (look - np.float32(step) * grad).astype(np.float32)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, langs: list[str]):
        self.langs = langs
        self.family = [FAMILY_OF.get(x, x) for x in langs]
        self.families = sorted({*self.family})
        self.pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if self.family[a] == self.family[b]]
        self.weights = np.zeros((1 << BITS, len(self.families) + len(self.pairs)), np.float32)
        self.bias = np.zeros(len(self.families) + len(self.pairs), np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each row."""
        z = x @ self.weights + self.bias
        k = len(self.families)
        squash = lambda m: 1 / (1 + np.exp(-4 * m))
        chosen = z[:, :k].argmax(1) if k > 1 else np.zeros(len(x), int)
        sure = squash(z[np.arange(len(x)), chosen]) if k > 1 else np.ones(len(x))
        votes = np.zeros((len(x), len(self.langs)))
        margin = np.full((len(x), len(self.langs)), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            m = z[:, k + j]
            votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
            margin[:, a], margin[:, b] = np.minimum(margin[:, a], m), np.minimum(margin[:, b], -m)
        inside = np.array([self.families.index(f) for f in self.family])
        best = np.where(inside[None] == chosen[:, None], votes, -np.inf).argmax(1)
        low = margin[np.arange(len(x)), best]
        return [self.langs[i] for i in best], np.clip(sure * np.where(np.isinf(low), 1.0, squash(np.where(np.isinf(low), 0, low))), 0, 1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the labelled rows given: the caller leaves held-out rows out."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}  # a row a language
    model = Model(sorted(counts))
    if not counts:
        return model
    dice = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 33)
    limit = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, per_language / n) * 0x7FFFFFFF))])
    sample = own.filter(dice <= F.element_at(limit, F.col("lang"))).select("text", "lang")

    def work():
        import pyarrow as pa

        return lambda column: [pa.array([vector(t).tobytes() for t in column.to_pylist()], pa.binary())]

    rows = append_arrow(sample, "text", [T.StructField("vector", T.BinaryType())], work).select("lang", "vector").collect()  # about per_language rows of 16 KiB a language
    x = np.stack([np.frombuffer(r.vector, np.float32) for r in rows]) if rows else np.zeros((0, 1 << BITS), np.float32)
    lang = np.array([r.lang for r in rows])
    family = np.array([FAMILY_OF.get(c, c) for c in lang])
    if len(model.families) > 1:
        for j, name in enumerate(model.families):
            model.weights[:, j], model.bias[j] = svm(x, np.where(family == name, 1.0, -1.0))
    for j, (a, b) in enumerate(model.pairs):
        two = (lang == model.langs[a]) | (lang == model.langs[b])
        at = len(model.families) + j
        model.weights[:, at], model.bias[at] = svm(x[two], np.where(lang[two] == model.langs[a], 1.0, -1.0))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and double ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        import pyarrow as pa

        model = shared.value

        def apply(column):
            texts = column.to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            use = [i for i, t in enumerate(texts) if t and model.langs and any(c.isalpha() for c in t)]
            for a in range(0, len(use), 256):
                part = use[a : a + 256]
                found, sure = model.predict(np.stack([vector(texts[i]) for i in part]))
                score[part] = sure
                for i, x in zip(part, found, strict=True):
                    lang[i] = x
            return [pa.array(lang), pa.array(score)]

        return apply

    return append_arrow(docs, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work)
