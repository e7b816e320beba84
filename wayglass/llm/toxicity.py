"""Toxicity by weak supervision.

Voters are the entries of hand-written lexicons in four languages, hand-written patterns over them, and the human label, which is
as noisy as any voter and which only rows of the training folds have. A generative label model takes only their votes, estimates by
expectation maximisation how often each voter fires on toxic and on clean text, and how strongly voters go together beyond that, and
counts correlated voters as less evidence. Word features that its posterior labels find in toxic text are added as lexicon entries, and
the model is fitted once more. The posterior labels then train a linear classifier over word features of both classes, which alone gives the score.

Bounds: `sample_toxic` and `sample_clean` labelled rows at most are used to fit all this (those with the smallest hash of doc_id).
Their words are counted by Spark; the driver gets votes, `features` names at most, and which rows hold those, never texts. Every
document is scored, over its whole text.

Defined results: a null or empty text is scored from the classifier's intercept; documents without a label are scored like
others; very long texts are scored whole; repeated rows are scored each, in the sample one of the texts of a doc_id stands for it, and of
conflicting labels the toxic one holds; without any toxic row in the training folds every score is 0; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import lean, text_of, written

#: Places in a worker's memory of words: bounds its memory, changes no result.
CACHE = 150_000
_WORD = re.compile(r"[^\W\d_]+")

#: Insults by language: each is a voter.
LEXICON = {
    "en": "idiot idiots moron morons loser losers clown clowns stupid dumb pathetic disgusting worthless trash garbage scum vermin imbecile filth jerk",
    "de": "trottel abschaum dreck widerlich wertlos erbärmlich dumm versager arschloch vollidiot",
    "fr": "imbécile abruti minable dégoûtant ordure crétin raclure débile connard",
    "es": "idiota imbécil asqueroso patético estúpido perdedor payaso escoria inútil",
}
WORDS = [w for line in LEXICON.values() for w in line.split()]
_ANY = "(?:" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"
#: Patterns over the text in lower case.
PATTERNS = {
    "aimed": rf"\b(?:you|he|she|they|we|du|ihr|sie|tu|vous|eres|this|that|these|those|such|so)\b(?:\W+\w+){{0,2}}?\W+{_ANY}\b",
    "named": rf"\b(?:an?|the|ein|eine|der|die|un|une|le|la|el|una)\W+{_ANY}\b",
    "closed": rf"\b{_ANY}[.!?]",
    "dismissed": r"\b(?:shut up|get lost|go to hell|drop dead|halt den mund|hau ab|ta gueule|cállate)\b",
    "shouted": r"!{3,}",
    "masked": r"\b[a-z]\*{2,}[a-z]*\b",
}
#: How often the human label is taken to be wrong on toxic and on clean text. The other voters' accuracies are estimated against this.
LABEL_ERRORS = (0.08, 0.02)
#: Voters over the number of different lexicon entries in a text.
SEVERAL = (2, 4)


@dataclass(frozen=True)
class ToxicityRules:
    sample_toxic: int = 1500
    sample_clean: int = 3500
    #: Entries that are added to the lexicon: at most so many, held by so many sampled rows, with this share of posterior toxicity among these.
    added: int = 48
    least_rows: int = 6
    least_share: float = 0.5
    #: Features of the linear classifier, those that tell the classes apart best, in either direction.
    features: int = 3000
    #: Standard deviations from what chance would give.
    least_lift: float = 2.5
    rounds: int = 400
    l2: float = 0.0005


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_features(word: str) -> list[str]:
    """A word, and its beginnings of 4 to 7 letters."""
    return ["=" + word, *["^" + word[:k] for k in range(4, min(7, len(word) - 1) + 1)]]


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def hand_votes(text: str) -> list[int]:
    """Places of the hand-written voters that fire: lexicon, numbers of entries, patterns."""
    low = text.lower()
    words = set(_WORD.findall(low))
    fired = [k for k, w in enumerate(WORDS) if w in words]
    out = fired + [len(WORDS) + k for k, n in enumerate(SEVERAL) if len(fired) >= n]
    return out + [len(WORDS) + len(SEVERAL) + k for k, p in enumerate(PATTERNS.values()) if re.search(p, low)]


N_HAND = len(WORDS) + len(SEVERAL) + len(PATTERNS)


@dataclass
class LabelModel:
    """Of each voter: how often it fires on toxic and on clean text, and what share of its evidence counts.

    A voter that doesn't fire abstains. That no hand-written one fires is a vote of its own (the last column), for clean. The first two
    columns are the human label: it says toxic, it says clean.
    """

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    share: np.ndarray
    correlations: np.ndarray

    @staticmethod
    def columns(votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """label: 1, 0, or -1 where there is none."""
        return np.column_stack([label == 1, label == 0, votes, ~votes[:, :N_HAND].any(1)]).astype(np.float64)

    @classmethod
    def fit(cls, votes: np.ndarray, label: np.ndarray, rounds: int = 25) -> LabelModel:
        v = cls.columns(votes, label)
        n, m = v.shape
        # to begin with, the label is mostly right, and so is a text on which several voters fire
        post = np.clip(np.where(label == 1, 0.8, 0.04) + np.minimum(votes.sum(1), 4) * 0.12, 0.02, 0.98)
        model = cls(0.5, np.full(m, 0.1), np.full(m, 0.01), np.ones(m), np.eye(m))
        for step in range(rounds):
            model.prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
            for name, w in (("on_toxic", post), ("on_clean", 1 - post)):
                setattr(model, name, np.clip((w @ v + 0.05) / (w.sum() + 1.0), 1e-5, 1 - 1e-5))
            missed, alarmed = LABEL_ERRORS
            model.on_toxic[:2], model.on_clean[:2] = (1 - missed, missed), (alarmed, 1 - alarmed)
            if step >= 3:
                # what is left of votes going together once the class is known
                rest = v - post[:, None] * model.on_toxic - (1 - post)[:, None] * model.on_clean
                sd = np.sqrt((rest * rest).mean(0)) + 1e-9
                model.correlations = (rest.T @ rest) / n / np.outer(sd, sd)
                over = np.clip(model.correlations - 0.3, 0, None) / 0.7
                model.share = 1 / np.maximum(over.sum(1), 1)
                model.share[:2] = 1
            post = model._posterior(v)
        return model

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        z = np.log(self.prior) - np.log1p(-self.prior) + (v * self.share) @ (np.log(self.on_toxic) - np.log(self.on_clean))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        return self._posterior(self.columns(votes, label))


def lift(n, heavy, rate: float):
    """Standard deviations by which a feature's rows are more toxic than chance would make them. Works on columns and arrays."""
    return (heavy - rate * n) / ((n * rate * (1 - rate) + 1) ** 0.5)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    intercept: float
    label_model: LabelModel | None = None
    added: tuple[str, ...] = ()

    @classmethod
    def train(cls, names: list[str], shares: np.ndarray, rows: list[np.ndarray], votes: np.ndarray, label: np.ndarray, rules: ToxicityRules) -> ToxicityModel:
        """names: features, with the share of posterior toxicity in the rows that hold them; rows: places of the features of each row."""
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        n = np.bincount(col, minlength=len(names))
        # entries for the lexicon: of features that fire on the same rows, one
        marks = np.bincount(col, np.random.default_rng(7).random(len(rows))[at], len(names)).round(9)
        good = [k for k in np.lexsort((np.arange(len(names)), -n)).tolist() if n[k] >= rules.least_rows and shares[k] >= rules.least_share and names[k][1:] not in WORDS]
        added = list({marks[k]: k for k in reversed(good)}.values())[::-1][: rules.added]
        more = np.zeros((len(rows), len(added)), bool)
        for j, k in enumerate(added):
            more[at[col == k], j] = True
        every = np.column_stack([votes, more])
        labels = LabelModel.fit(every, label)
        target = labels.posterior(every, label)
        rate = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
        # toxic rows are few: both classes pull equally
        pull = target * 0.5 / rate + (1 - target) * 0.5 / (1 - rate)
        pull /= pull.sum()
        w, b = np.zeros(len(names)), 0.0
        speed_w, speed_b = np.zeros_like(w), 0.0
        for _ in range(rules.rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col], len(rows)) + b, -30, 30)))
            g = (p - target) * pull
            speed_w = 0.9 * speed_w - 4.0 * (np.bincount(col, g[at], len(names)) + rules.l2 * w)
            speed_b = 0.9 * speed_b - 4.0 * g.sum()
            w, b = w + speed_w, b + speed_b
        return cls({f: float(v) for f, v in zip(names, w, strict=True)}, float(b), labels, tuple(names[k] for k in added))

    def scorer(self):
        """A function of a text to its score."""
        known: dict[str, tuple[str, ...]] = {}
        weights, intercept = self.weights, self.intercept

        def score(text: str) -> float:
            found: set[str] = set()
            for w in set(_WORD.findall(text.lower())):
                own = known.get(w)
                if own is None:
                    if len(known) >= CACHE:
                        known.clear()
                    own = known[w] = tuple(f for f in word_features(w) if f in weights)
                if own:
                    found.update(own)
            z = intercept + sum(weights[f] for f in sorted(found))
            return 0.0 if z < -700 else float(1 / (1 + np.exp(-z)))

        return score


def training_rows(docs: DataFrame, labels: DataFrame, rules: ToxicityRules, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, label, t: a bounded sample of the labelled documents of the training folds, by hash of doc_id; one row for each doc_id."""
    own = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("label")).filter(F.col("of").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("of")))
    own = own.groupBy("of").agg(F.max("label").alias("label"))
    parts = [own.filter(F.col("label") == k).orderBy(F.xxhash64("of"), "of").limit(n) for k, n in ((1, rules.sample_toxic), (0, rules.sample_clean))]
    ids = parts[0].unionByName(parts[1])  # sample_toxic + sample_clean rows at most
    found = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t")).join(F.broadcast(ids), F.col("id") == F.col("of"))
    return found.groupBy("id").agg(F.max("label").alias("label"), F.min_by("t", F.xxhash64("t")).alias("t"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules(), **names: str) -> ToxicityModel:
    spark = docs.sparkSession

    sample = training_rows(docs, labels, rules, **names)
    kind = sample.schema["id"].dataType.simpleString()
    rows = written(sample.select("id", "label", "t"), "sample")

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "fired": [hand_votes(t) for t in b["t"]]})

    heads = rows.mapInPandas(lean(voted), f"id {kind}, label int, fired array<int>").orderBy(F.xxhash64("id"), "id").collect()  # votes of the sample
    label = np.array([r["label"] for r in heads], int)
    if not (label == 1).any():
        return ToxicityModel({}, -800.0)
    votes = np.zeros((len(heads), N_HAND), bool)
    for i, r in enumerate(heads):
        votes[i, r["fired"]] = True
    post = LabelModel.fit(votes, label).posterior(votes, label)
    given = spark.createDataFrame([(r["id"], round(float(p), 6)) for r, p in zip(heads, post, strict=True)], f"id {kind}, p double")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        heavy: dict[str, float] = {}

        def table() -> pd.DataFrame:
            out = pd.DataFrame({"f": list(n), "n": list(n.values()), "heavy": [heavy[f] for f in n]})
            n.clear()
            heavy.clear()
            return out

        for b in batches:
            for t, p in zip(b["t"], b["p"], strict=True):
                for f in text_features(t):
                    n[f] += 1
                    heavy[f] = heavy.get(f, 0.0) + p
                if len(n) >= CACHE:
                    yield table()
        yield table()

    counts = rows.join(F.broadcast(given), "id").select("t", "p").mapInPandas(lean(counted), "f string, n long, heavy double").groupBy("f").agg(F.sum("n").alias("n"), F.round(F.sum("heavy"), 4).alias("heavy"))
    weight = F.round(F.abs(lift(F.col("n"), F.col("heavy"), float(post.mean()))), 6)
    best = counts.filter(F.col("n") >= rules.least_rows).withColumn("lift", weight).filter(F.col("lift") >= rules.least_lift)
    best = best.orderBy(F.desc("lift"), "f").limit(rules.features).collect()
    places = {r["f"]: k for k, r in enumerate(best)}

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "held": [sorted(places[f] for f in text_features(t) if f in places) for t in b["t"]]})

    # in the order of the votes
    held = rows.select("id", "t").mapInPandas(lean(kept), f"id {kind}, held array<int>").orderBy(F.xxhash64("id"), "id").collect()
    sparse = [np.array(r["held"], np.int64) for r in held]
    return ToxicityModel.train([r["f"] for r in best], np.array([r["heavy"] / r["n"] for r in best]), sparse, votes, label, rules)


def toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules(), *, text: str = "text", doc_id: str = "doc_id", model: ToxicityModel | None = None) -> DataFrame:
    """row (all columns of docs), score."""
    model = model or fit_toxicity(docs, labels, rules, text=text, doc_id=doc_id)
    small = ToxicityModel(model.weights, model.intercept)  # at most rules.features weights

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = small.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(scores)(batches)

    return docs.select(F.struct("*").alias("row"), score_of(text_of(text)).alias("score"))
