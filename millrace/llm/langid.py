"""Language of a text in two steps: first its family, then the languages within it.

A text is the square roots of its shares of hashed three-byte grams of letters.
Linear support vector machines, one against one, decide between families, and
others of the same kind between the languages of the winning family. They are
trained on the driver on at most ``PER_LANGUAGE`` texts of each language.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, fresh, lean, materialize, steps, text_bytes

#: The bound of the training sample for each language.
PER_LANGUAGE = 800
GRAMS = 2048
#: Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no af is nb nn fo lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc co rm sc la".split(),
    "slavic": "ru uk pl cs sk bg sr hr sl be mk bs".split(),
    "uralic": "fi et hu se kv".split(),
    "turkic": "tr az kk uz tk ky tt ug ba cv".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga cy gd br kw gv".split(),
    "hellenic": "el sq hy".split(),
    "indo-aryan": "hi bn ur pa gu mr ne si or as sd sa".split(),
    "iranian": "fa ps ku tg os".split(),
    "semitic": "ar he mt am ti".split(),
    "dravidian": "ta te kn ml".split(),
    "austronesian": "id ms tl jv su mg mi sm to fj haw ceb".split(),
    "niger-congo": "sw zu xh st sn ny rw ln lg ts tn ss ve yo ig wo ff ak ee".split(),
    "east-asian": "zh ja ko yue mn".split(),
    "mainland": "vi th lo km my bo dz".split(),
    "isolated": "eu ka eo ia ie io vo ht qu ay gn nv iu kl so ha om".split(),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
#: Signs, digits and white space are one boundary.
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def grams(text: pa.Array) -> np.ndarray:
    """A row of unit length for each lower-cased text."""
    data, offsets = text_bytes(text)
    code = _CODE[data]
    n = len(text)
    out = np.zeros((n, GRAMS), np.float32)
    if len(code) >= 3:
        row = np.repeat(np.arange(n), np.diff(offsets))
        inside = (row[2:] == row[:-2]) & (code[1:-1] > 0)
        key = (code[:-2] * 160 + code[1:-1]) * 160 + code[2:]
        key = ((key * 2654435761) >> 7) % GRAMS
        out = np.bincount((row[2:] * GRAMS + key)[inside], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
    out = np.sqrt(out)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss for y of -1 and 1, classes weighted alike; accelerated descent."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    share = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean()).astype(np.float32) * cost / len(y)
    w = ahead = np.zeros(x.shape[1], np.float32)
    step, t = 1 / (1 + 4 * float(share.sum())), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead - 2 * x.T @ (share * y * slack))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w


@dataclass
class Duel:
    """One-against-one machines over names; a single name wins alone."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, names: list[str], label: np.ndarray) -> Duel:
        pairs = list(combinations(range(len(names)), 2))
        got = [_machine(x[(label == i) | (label == j)].astype(np.float32), np.where(label[(label == i) | (label == j)] == i, 1, -1).astype(np.float32)) for i, j in pairs]
        return cls(names, pairs, np.stack(got) if got else np.zeros((0, GRAMS + 1), np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner by votes, ties by margins; and its least margin as a probability."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, least = np.zeros((len(x), len(self.names))), np.full((len(x), len(self.names)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            for who, m in ((i, margins[:, k]), (j, -margins[:, k])):
                votes[:, who] += (m > 0) + 1e-3 * np.tanh(m)
                least[:, who] = np.minimum(least[:, who], m)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-3 * np.minimum(least[np.arange(len(x)), best], 12)))


@dataclass
class LanguageModel:
    families: Duel
    members: list[Duel]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        which, p = self.families.predict(x)
        lang = np.empty(len(x), object)
        for k, duel in enumerate(self.members):
            own = np.flatnonzero(which == k)
            best, q = duel.predict(x[own])
            lang[own] = np.array(duel.names, object)[best]
            p[own] *= q
        return lang.tolist(), p


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Model of every non-null ``lang`` of documents whose fold of four is not 2; None without such a row with a letter.

    Only the sample of each language is bounded: what the driver holds grows with
    the number of languages, and its work with the pairs of families and of
    languages within one.
    """
    rows = docs.where(fold(F.col("doc_id"), 4) != 2).where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    # a share of the rows by hash, twice what is needed, before the rows of a language meet
    dice = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.join(F.broadcast(counts), "lang").where(dice < F.lit(2.0 * per_language + 64) / F.col("n")).select("lang", F.lower("text").alias("text"), F.xxhash64("text", "doc_id").alias("h"))
    sample = materialize(some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language).select("lang", "text"))

    def run(batches):
        for batch in steps(batches):
            x = grams(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = sample.repartition(6).mapInArrow(run, "lang string, x binary").orderBy("lang", "x").toArrow()  # at most per_language rows of each language
    if not got.num_rows:
        return None
    x = np.concatenate([text_bytes(c)[0] for c in got["x"].chunks]).view(np.float16).reshape(-1, GRAMS)
    lang = np.array(got["lang"].to_pylist())
    names = sorted(set(lang.tolist()))
    groups = sorted({family(n) for n in names})
    kin = np.array([groups.index(family(n)) for n in lang])
    members = []
    for k in range(len(groups)):
        own = [n for n in names if family(n) == groups[k]]
        members.append(Duel.fit(x[kin == k], own, np.array([own.index(n) for n in lang[kin == k]])))
    return LanguageModel(Duel.fit(x, groups, kin), members)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names; a text that is null or has no letter is ``und`` with score 0."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = lean(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in steps([pa.RecordBatch.from_arrays([text], ["text"])]):
            got, p = shared.value.predict(grams(part.column("text")))
            langs += got
            scores.append(p)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang", "score"])

    text = F.coalesce(F.col("text"), F.lit(""))
    found = fresh(docs, "found")
    out = docs.withColumn(found, run(F.lower(text)))
    letters = text.rlike("\\p{L}")
    return out.withColumns({"lang_pred": F.when(letters, F.col(f"{found}.lang")).otherwise("und"), "score": F.when(letters, F.col(f"{found}.score")).otherwise(0.0)}).drop(found)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang, …).

    A null text, an empty one and one without a letter are ``und``. Rows are
    predicted one by one, so repeated rows agree; equal votes go to the greater
    margins, then to the name that sorts first. Null ids are never held out. Null
    languages teach nothing. Very long texts are a step of their own. Other
    columns are not read. An empty table gives no rows.
    """
    found = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
