"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a whole text: densities and weights of lexicon words, lexicon words near a second person,
capitals, punctuation, and obfuscated spellings. The lexicon holds words and beginnings of words that are far
more frequent in toxic documents of the training sample, found by grouped counts. The trees and the
calibration are fitted in numpy on the sample's features.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import arrow_schema, as_batches, give_back, labelled_sample, map_rows, text_bytes, written

#: The model is fitted on so many labelled documents at most; a quarter of them calibrates it.
TRAIN_ROWS = 12_000
LEXICON_SIZE = 500
#: A term enters the lexicon from so many toxic documents on, and if it is so many times as frequent in them.
LEAST_DOCUMENTS = 6
LEAST_RATIO = 8.0
#: Words to either side within which a second person counts as near.
NEAR = 5
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32

#: Second-person words in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself ur du dich dir dein deine deinen deiner ihr euch euer eure sie ihnen "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vosotras vuestro vuestra os".split()
)
#: Characters that stand for letters in obfuscated words.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*#!_.\-]+[^\W\d_]")
_DRAWN_OUT = re.compile(r"([^\W\d_])\1\1")
_EDGES = "\"'`.,;:!?()[]{}<>*#%&|/\\-_~+=…«»„“”‚‘’¡¿"

FEATURES = (
    "log_words", "lexicon_density", "lexicon_weight", "lexicon_max", "lexicon_log_hits", "near_second_person",
    "second_person", "capital_letters", "capital_words", "exclamations", "questions", "punctuation", "obfuscated",
    "drawn_out",
)


def term_forms(word: str) -> list[str]:
    """What a word is looked up by: itself and its beginnings, marked `*`."""
    plain = word.lower().strip(_EDGES)
    if _OBFUSCATED.search(plain):
        plain = re.sub(r"[*#_.\-]", "", plain.translate(STANDS_FOR))
    return [plain, *(f"{plain[:n]}*" for n in (4, 5, 6) if len(plain) >= n)] if plain else []


class WordCodes(dict):
    """A word's weight in the lexicon (thousandths) and its flags, as one number; found once per word."""

    MOST = 200_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        weight = max((self.lexicon.get(t, 0.0) for t in term_forms(word)), default=0.0)
        bare = word.strip(_EDGES)
        flags = (
            (bare.lower() in SECOND_PERSON)
            + 2 * (len(bare) > 1 and bare.isupper())
            + 4 * bool(_OBFUSCATED.search(bare))
            + 8 * bool(_DRAWN_OUT.search(bare.lower()))
        )
        code = self[word] = int(weight * 1000) * 16 + flags
        return code


def features(text: bytes, codes: WordCodes) -> np.ndarray:
    """The features of a whole text; zeros where there are no words."""
    words = text.decode("utf-8", "replace").split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    weight, flags = (code >> 4) / 1000.0, code & 15
    hit, you = weight > 0, (flags & 1).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(you)))
    at = np.flatnonzero(hit)
    near = sums[np.minimum(at + NEAR + 1, n)] - sums[np.maximum(at - NEAR, 0)] - you[at]
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = letters[65:91].sum(), letters[97:123].sum()
    signs = letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum()
    return np.array(
        [
            np.log1p(n),
            len(at) / n,
            weight.sum() / n,
            weight.max(),
            np.log1p(len(at)),
            (near > 0).sum() / n,
            you.sum() / n,
            upper / max(upper + lower, 1),
            (flags & 2 > 0).sum() / n,
            letters[33] / n,
            letters[63] / n,
            signs / len(text),
            (flags & 4 > 0).sum() / n,
            (flags & 8 > 0).sum() / n,
        ]
    )


# ---- trees and calibration ----------------------------------------------------------------------


@dataclass
class Booster:
    """Trees of equal depth: at each inner node a feature and the greatest value that goes left."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for chosen, cuts, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, chosen[node]] > cuts[node])
            total += leaves[node - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Booster:
    """Newton steps on the log loss, with splits at quantiles of each feature."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Booster(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-6
        inner = 2**DEPTH - 1
        chosen, limits, leaves = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == at)
                found = _best_split(binned[rows], g[rows], h[rows], cuts)
                if found:
                    chosen[at], limits[at] = found
            node = 2 * node + 1 + (x[np.arange(len(y)), chosen[node]] > limits[node])
        leaf = node - inner
        top, bottom = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves = -RATE * top / (bottom + 1.0)
        margin += leaves[leaf]
        model.trees.append((chosen, limits, leaves))
    return model


def _best_split(binned, g, h, cuts) -> tuple[int, float] | None:
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f, values in enumerate(cuts):
        if not len(values) or len(g) < 20:
            continue
        left_g = np.cumsum(np.bincount(binned[:, f], g, len(values) + 1))[:-1]
        left_h = np.cumsum(np.bincount(binned[:, f], h, len(values) + 1))[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gains = left_g**2 / (left_h + 1.0) + right_g**2 / (right_h + 1.0) - whole
        gains[(left_h < 0.5) | (right_h < 0.5)] = 0
        k = int(gains.argmax())
        if gains[k] > gain:
            best, gain = (f, float(values[k])), gains[k]
    return best


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function closest to the labels, by pooling adjacent violators.

    Each pool's value is drawn a little to the middle, so that no probability is 0 or 1.
    """
    margins, place = np.unique(margin, return_inverse=True)
    positives, rows = np.bincount(place, y), np.bincount(place)
    pools: list[list[float]] = []  # positives, rows, least and greatest margin
    for m, p, n in zip(margins, positives, rows):
        pools.append([float(p), float(n), float(m), float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p, n, _, high = pools.pop()
            pools[-1][0] += p
            pools[-1][1] += n
            pools[-1][3] = high
    value = [(p + 0.5) / (n + 1) for p, n, _, _ in pools for _ in (0, 1)]
    at = [m for _, _, low, high in pools for m in (low, high)]
    return np.array(at), np.maximum.accumulate(value)


@dataclass
class Model:
    lexicon: dict[str, float]
    booster: Booster
    at: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = self.booster.margins(x)
        if not len(self.at):
            return 1 / (1 + np.exp(-margin))
        # A hint of the margin keeps the order within a pool.
        return np.clip(np.interp(margin, self.at, self.value) + 1e-6 * np.tanh(margin / 10), 0, 1)


def fit(x: np.ndarray, y: np.ndarray, calibrates: np.ndarray, lexicon: dict[str, float]) -> Model:
    booster = boost(x[~calibrates], y[~calibrates])
    held = calibrates if len(np.unique(y[calibrates])) == 2 else np.zeros(len(y), bool)
    at, value = isotonic(booster.margins(x[held]), y[held]) if held.any() else (np.zeros(0), np.zeros(0))
    return Model(lexicon, booster, at, value)


# ---- Spark --------------------------------------------------------------------------------------


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and their log ratios of document frequencies, at most `LEXICON_SIZE`."""

    def rows(columns):
        out = {"term": [], "label": []}
        for text, label in zip(columns["text"], columns["label"]):
            terms = {t for w in set(text.decode("utf-8", "replace").split()) for t in term_forms(w)}
            out["term"] += terms
            out["label"] += [label] * len(terms)
        return out

    totals = sample.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = (totals[0] or 0), totals[1] - (totals[0] or 0)
    ratio = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1)))
    found = (
        map_rows(sample, rows, "term string, label int")
        .groupBy("term")
        .agg(F.sum("label").alias("t"), F.count("*").alias("n"))
        .where(F.col("t") >= LEAST_DOCUMENTS)
        .withColumn("weight", ratio)
        .where(F.col("weight") >= float(np.log(LEAST_RATIO)))
        .orderBy((F.col("weight") * F.col("t")).desc(), "term")
        .limit(LEXICON_SIZE)
        .collect()
    )
    return {r["term"]: r["weight"] for r in found}


def train(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """Fits on at most `TRAIN_ROWS` documents whose ids in `labels` meet `usable`.

    The lexicon is learned on the part that the trees are fitted on, the calibration on the rest.
    """
    sample = written(labelled_sample(docs, labels, label, usable, TRAIN_ROWS, doc_id, text), "toxicity-sample")
    calibrates = F.pmod(F.shiftright("rank", 8), F.lit(4)) == 0
    lexicon = learn_lexicon(sample.where(~calibrates))

    def rows(columns):
        codes = WordCodes(lexicon)
        return {
            "rank": columns["rank"],
            "label": columns["label"],
            "calibrates": columns["calibrates"],
            "x": [features(t, codes) for t in columns["text"]],
        }

    measured = map_rows(
        sample.withColumn("calibrates", calibrates), rows, "rank long, label int, calibrates boolean, x array<double>"
    )
    found = measured.orderBy("rank", "label", "x").limit(TRAIN_ROWS).collect()
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], float), np.array([r["calibrates"] for r in found], bool), lexicon)


def scores(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` (bigints) of `docs` and `score`, from 0 to 1, of each whole text.

    Null and empty texts have the score of a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codes = WordCodes(shared.value.lexicon)
        for batch in batches:
            columns = batch.to_pydict()
            if batch.num_rows:
                x = np.array([features(t, codes) for t in columns.pop("text")])
                yield from as_batches({**columns, "score": shared.value.scores(x)}, target)
            del columns
            give_back()

    schema = ", ".join(f"{c} long" for c in keep) + ", score double"
    target = arrow_schema(docs.sparkSession, schema)
    return docs.select(*keep, text_bytes(text).alias("text")).mapInArrow(run, schema)
