"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

Texts become normalized vectors of hashed byte bigrams and trigrams of the lower-cased text. A linear SVM for each pair of
families votes on the family, and one for each pair of its languages on the language. The classifiers are fitted on a
bounded sample of labelled rows, ``SAMPLE`` for each language and ``TOTAL`` in all; every other step sees all rows and whole texts.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import per_row, table

#: Labelled rows of each language that the classifiers are fitted on, at most, and of all languages together: the more
#: languages there are, the fewer rows of each. The vectors of all reach the driver, 16 KB each.
SAMPLE, TOTAL = 600, 6000
#: Hashed features, a power of two; passes of the solver; its regularization.
FEATURES, PASSES, COST = 1 << 12, 20, 10.0
#: A text is taken in pieces of this many bytes, so that memory doesn't follow its length.
PIECE = 1 << 18

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn ur mr gu pa ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: f for f, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """A code's family; a code that the table lacks is a family of its own."""
    base = re.split("[-_]", lang.lower())[0]
    return _FAMILY.get(base, "=" + lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """The unit vector of square roots of hashed bigram and trigram counts; zero for a text of fewer than two bytes."""
    out = np.zeros(FEATURES)
    raw = text.lower().encode("utf-8", "replace")
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + 2], np.uint8).astype(np.uint32)  # pieces overlap by two bytes
        if len(b) > 1:
            two = b[:-1] * np.uint32(256) + b[1:]
            two = two[:PIECE]
            out += np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
        if len(b) > 2:
            three = (b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:])[:PIECE]
            out += np.bincount(((three ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> np.uint32(20), minlength=FEATURES)
    out = np.sqrt(out)
    norm = math.sqrt(float(out @ out))
    return (out / norm if norm else out).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, seed: int = 3) -> np.ndarray:
    """L2-regularized hinge loss by dual coordinate descent; the last weight is the bias. y holds 1 and -1."""
    r, n = np.random.default_rng(seed), len(x)
    x = np.concatenate([x, np.ones((n, 1), np.float32)], 1)
    q, a, w = (x * x).sum(1), np.zeros(n), np.zeros(x.shape[1], np.float32)
    for _ in range(PASSES):
        moved = 0.0
        for i in r.permutation(n):
            new = min(max(a[i] - (y[i] * float(x[i] @ w) - 1) / q[i], 0.0), COST)
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Pairwise separators: names of the classes and, for each pair (i, j), a column of ``w`` that is positive for i."""

    families: list[str]
    languages: dict[str, list[str]]
    w: np.ndarray
    column: dict[tuple[str, str], int]

    @staticmethod
    def fit(x: np.ndarray, lang: list[str]) -> Model:
        fam = np.array([family(v) for v in lang])
        tags, weights, column = np.array(lang), [], {}
        families = sorted(set(fam))
        languages = {f: sorted(set(tags[fam == f])) for f in families}
        for names, of in [(families, fam)] + [(v, tags) for v in languages.values()]:
            for a, b in itertools.combinations(names, 2):
                rows = (of == a) | (of == b)
                column[a, b] = len(weights)
                weights.append(fit_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0)))
        return Model(families, languages, np.array(weights, np.float32).T if weights else np.zeros((FEATURES + 1, 0), np.float32), column)

    def _vote(self, names: list[str], margin: np.ndarray) -> tuple[str, float]:
        """The class with most votes, margins deciding ties; and the logistic of its smallest margin."""
        if len(names) == 1:
            return names[0], 1.0
        votes = {c: [0, 0.0, math.inf] for c in names}
        for a, b in itertools.combinations(names, 2):
            m = float(margin[self.column[a, b]])
            for c, v in ((a, m), (b, -m)):
                votes[c][0] += v > 0
                votes[c][1] += v
                votes[c][2] = min(votes[c][2], v)
        best = max(names, key=lambda c: (votes[c][0], votes[c][1], c))
        return best, 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * votes[best][2]))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return "und", 0.0
        margin = features(text) @ self.w[:-1] + self.w[-1]
        f, p = self._vote(self.families, margin)
        lang, q = self._vote(self.languages[f], margin)
        return lang, p * q


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """Fit on at most ``sample`` rows of each language and ``total`` of all, drawn by a hash of id and text.

    Null and empty texts and null labels are left out; rows without an id are drawn like others. Equal rows are drawn
    together, up to the limit. The limits hold before anything reaches the driver, and no text does.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(total + 1).collect()}
    if not counts:
        return Model.fit(np.zeros((0, FEATURES), np.float32), [])
    if len(counts) > total:
        raise ValueError(f"more than {total} languages")
    each = min(sample, total // len(counts))
    draw = F.xxhash64("id", "text")
    share = F.lit(0)
    for k, n in counts.items():  # some more than are wanted, then the least hashes
        share = F.when(F.col("lang") == k, F.lit(int((1 << 30) * min(1.0, 1.2 * each / n + 20 / n)))).otherwise(share)
    some = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) <= share)
    some = some.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("i") <= each).select("lang", "text")

    def make():
        return lambda ts: ([features(t).tobytes() for t in ts],)

    drawn = per_row(some, ["lang"], "text", "x binary", make).toArrow().to_pydict()
    order = sorted(range(len(drawn["lang"])), key=lambda i: (drawn["lang"][i], drawn["x"][i]))  # the same whatever task ends first
    x = np.stack([np.frombuffer(drawn["x"][i], np.float32) for i in order]) if order else np.zeros((0, FEATURES), np.float32)
    return Model.fit(x, [drawn["lang"][i] for i in order])


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", with_text: bool = False) -> DataFrame:
    """lang_pred and score of each row. Null texts and texts without a letter are ``und`` with score 0.

    Only the text is looked at. Rows are independent, so ties, repeats and empty tables need no care; a model without
    classes calls everything ``und``.
    """

    def make():
        def work(texts):
            out = [model.predict(t) for t in texts]
            return [o[0] for o in out], [o[1] for o in out]

        return work

    return per_row(docs, keep, text, "lang_pred string, score double", make, text if with_text else None)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id, as text, leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
