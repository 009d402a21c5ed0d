"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Features of a text are its words and their stems (the first 4 to 8 bytes), each at least once, twice or four times.
Every word of a fixed lexicon and every pattern is a voter, and so are the words and stems of a learned lexicon: those that set labelled
training rows apart best. A voter says toxic or is silent. The label model estimates by expectation maximisation how often each
voter speaks given either class, so its accuracy when it does and what its silence tells, and how the voters' errors correlate; of correlated voters that do
the same each counts less. Known labels count in that estimate only. A logistic regression on the features of the learned lexicon
and the fixed voters is trained on the posteriors of all training rows, labelled or not.

Fitting takes a bounded sample of the training rows (``TRAIN_ROWS``) and keeps at most ``SELECTED`` features; scoring is
per row, over whole texts, without a shuffle.

Cases: null and empty texts have no features and score the classifier's base rate, as does a text without a known feature on which
every fixed voter is silent; ties between features go to the smaller hash; repeated rows are scored one by one; repeated label rows count once, toxic
if any says so; null labels are none; without training rows of both classes every score is 0; empty tables give empty
results; extra columns are kept, those named ``score`` or ``predicted`` replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import SYMBOLS, bounded_batches, is_held_out, materialize, mix, pieces, run_hashes, text_bytes, thinned, word_bounds

TRAIN_ROWS, SELECTED, MINED, THRESHOLD = 16384, 512, 128, 0.7
#: Of the labelled rows that a feature of the learned lexicon speaks on so large a share is toxic.
PRECISE = 0.9
#: Errors of two voters that correlate more than so.
STRONG = 0.3
STEMS, LEVELS, SURE = (4, 5, 6, 7, 8), (1, 2, 4), 20.0

# Words of abuse, by kind of insult, each a voter. Spelled in lower case.
LEXICON = {
    "stupidity": "idiot idiots moron morons stupid dumb imbecile dimwit fool halfwit dunce simpleton",
    "failure": "loser losers pathetic worthless useless failure hopeless",
    "filth": "scum trash garbage filth filthy disgusting vermin vile",
    "mockery": "clown clowns joke laughable ridiculous buffoon",
    "hostility": "hate despise shut kill die",
    "french": "idiote imbécile crétin minable ordure débile",
    "german": "dummkopf idiotin abschaum trottel versager widerlich",
    "spanish": "imbécil estúpido basura patético asqueroso payaso",
}
PATTERNS = {
    "second_person": r"\b[Yy]ou(?: are|'re) (?:a|an|such|so) ",
    "shouting": r"\b[A-Z]{4,}(?: [A-Z]{4,}){2,}",
    "exclaiming": r"!{3,}",
    "masked": r"[a-z][*#@$%]{2,}[a-z]",
    "get_lost": r"\b(?:[Gg]et lost|[Gg]o away|[Ss]hut up|[Ss]hut your)\b",
    "nobody": r"\b[Nn]obody (?:likes|wants|cares|needs)\b",
    "what_a": r"\b[Ww]hat an? (?:\w+ )?(?:idiot|moron|joke|loser|clown|disgrace)\b",
    "threat": r"\b(?:I will|I'll|we will|we'll) (?:find|hurt|kill|get) you\b",
    "hope_you": r"\b[Hh]ope (?:you|they) (?:die|fail|suffer|rot)\b",
    "all_of_you": r"\b(?:you people|all of you|people like you|your kind)\b",
}
#: One of these stands in every text that the pattern matches: texts without are not searched.
HINTS = {
    "second_person": ("ou are ", "ou're "), "exclaiming": ("!!!",), "get_lost": ("et lost", "o away", "hut up", "hut your"), "nobody": ("obody ",), "what_a": ("hat a",),
    "threat": (" find you", " hurt you", " kill you", " get you"), "hope_you": ("ope you ", "ope they "), "all_of_you": ("you people", "all of you", "people like you", "your kind"),
}
WORDS = [w for group in LEXICON.values() for w in group.split()]
_LEXICON_LEVEL = 1


def _feature(token: np.ndarray, level: int) -> np.ndarray:
    return mix((token >> np.uint64(20)) + np.uint64(level)).view(np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts: the text's place, and the feature as a 64-bit number."""
    data, ends = text_bytes(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    first, last, doc = word_bounds(data, ends, SYMBOLS)
    tokens, docs = [], []
    lasts = [last, *[np.minimum(first + n, last) for n in STEMS]]
    for n, hashed in zip((0, *STEMS), run_hashes(data, first, *lasts), strict=True):
        longer = slice(None) if not n else last - first > n
        tokens.append(mix(hashed[longer] + np.uint64(n)))
        docs.append(doc[longer])
    # one sort: 44 bits of the token and the text's place (a slice has fewer than 2^20 texts)
    both = np.sort((np.concatenate(tokens) >> np.uint64(20) << np.uint64(20)) | np.concatenate(docs).astype(np.uint64))
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    times, both = np.diff(np.append(new, len(both))), both[new]
    place = (both & np.uint64((1 << 20) - 1)).astype(np.int64)
    return np.concatenate([place[times >= n] for n in LEVELS]), np.concatenate([_feature(both[times >= n], n) for n in LEVELS])


def word_features(words: list[str]) -> list[int]:
    """The features that say that a word occurs."""
    raw = [np.frombuffer(w.lower().encode(), dtype=np.uint8) for w in words]
    hashed = [mix(run_hashes(r, np.array([0]), np.array([len(r)]))[0]) for r in raw]
    return [int(_feature(h, _LEXICON_LEVEL)[0]) for h in hashed]


def fixed_votes(column: pa.Array, place: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which lexicon words and patterns speak on each text."""
    out = np.zeros((len(column), len(WORDS) + len(PATTERNS)), dtype=bool)
    known = np.array(word_features(WORDS))
    order = np.argsort(known, kind="stable")
    at = np.minimum(np.searchsorted(known[order], found), len(known) - 1)
    real = known[order][at] == found
    out[place[real], order[at[real]]] = True
    texts = column.to_pylist()
    for j, (name, pattern) in enumerate(PATTERNS.items(), len(WORDS)):
        speaks, hints = re.compile(pattern).search, HINTS.get(name, ("",))
        out[:, j] = [bool(t) and any(h in t for h in hints) and speaks(t) is not None for t in texts]
    return out


@dataclass
class LabelModel:
    """``prior``: the log odds of the toxic class; ``accuracy`` of each voter: the share of texts it speaks on that are toxic; ``silence``:
    what its silence adds to the log odds; ``correlation`` of the voters' errors within a class, where it is strong.

    A voter that speaks moves the odds from the prior to its accuracy. Of voters that do the same, each counts less the more its errors
    correlate with those of the others.
    """

    prior: float
    accuracy: np.ndarray
    silence: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        speaks, silent = votes.astype(float), 1.0 - votes
        moved = np.log(self.accuracy / (1 - self.accuracy)) - self.prior
        odds = self.prior + speaks / (1 + speaks @ self.correlation) @ moved + silent / (1 + silent @ self.correlation) @ self.silence
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(votes: np.ndarray, known: np.ndarray, times: np.ndarray | None = None, rounds: int = 60) -> LabelModel:
    """Expectation maximisation. ``votes``: a row for each text; ``known``: 1, 0 or -1 for no label (a label is sure in the estimate);
    ``times``: how many texts a row stands for."""
    votes, times = votes.astype(float), np.ones(len(votes)) if times is None else times
    labelled = known >= 0
    q = np.where(labelled, known, 0.0).astype(float)
    for nth in range(rounds):
        sure = times if nth else times * labelled  # begins with what the labels say
        on, off = q * sure, (1 - q) * sure
        p1 = (on @ votes + 0.1) / (on.sum() + 1)
        p0 = (off @ votes + 0.1) / (off.sum() + 1)
        # errors of two voters that go together: the correlation that the class does not explain
        rest1, rest0 = votes - p1, votes - p0
        cover = (rest1.T * on) @ rest1 + (rest0.T * off) @ rest0
        size = np.sqrt(np.maximum(np.diag(cover), 1e-9))
        correlation = cover / np.outer(size, size)
        together = np.where(np.abs(correlation) > STRONG, np.abs(correlation), 0)  # weaker ones come with the language of a text
        np.fill_diagonal(together, 0)
        prior = np.log((on.sum() + 0.1) / (off.sum() + 0.1))
        model = LabelModel(float(prior), p1 * np.exp(prior) / (p1 * np.exp(prior) + p0), np.log((1 - p1) / (1 - p0)), together)
        new = np.where(labelled, known, model.posterior(votes))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


def fit_linear(rows: np.ndarray, columns: np.ndarray, width: int, target: np.ndarray, times: np.ndarray | None = None, ridge: float = 0.3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features given as (row, column) pairs and soft labels, by Newton steps. ``times``: how many texts a row stands for.

    Every feature marks the toxic class, so no weight is negative: those at zero that would turn negative stay out of a step.
    """
    times = np.ones(len(target)) if times is None else times
    x = np.zeros((len(target), width + 1), dtype=np.float32)
    x[rows, columns] = 1
    x[:, width] = 1
    hold = np.append(np.full(width, ridge), 1e-6)
    weights, mean = np.zeros(width + 1), float(times @ target / times.sum())
    weights[width] = np.log((mean + 1e-4) / (1 - mean + 1e-4))

    def loss(w: np.ndarray) -> float:
        odds = x @ w
        return float(times @ (np.logaddexp(0, odds) - target * odds) + 0.5 * hold @ (w * w))

    now = loss(weights)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (times * (p - target)) + hold * weights
        free = np.flatnonzero((weights > 0) | (slope < 0) | (np.arange(width + 1) == width))
        if np.abs(slope[free]).max() < 1e-4:
            break
        part = x[:, free]
        curve = (part.T @ (part * (times * p * (1 - p)).astype(np.float32)[:, None])).astype(float)
        curve[np.diag_indices(len(free))] += hold[free] + 1e-9
        step, size = np.linalg.solve(curve, slope[free]), 1.0
        while True:  # shorter until it leads down
            new = weights.copy()
            new[free] -= size * step
            new[:width] = np.maximum(new[:width], 0)
            then = loss(new)
            if then < now or size < 1e-4:
                break
            size /= 2
        if then >= now:
            break
        weights, now = new, then
    return np.round(weights[:width], 5), float(round(weights[width], 5))


@dataclass
class Classifier:
    """Weights of the selected features (sorted), then of the lexicon words and patterns."""

    label_model: LabelModel | None
    selected: np.ndarray
    weights: np.ndarray
    bias: float


def select(rows: DataFrame, most: int = SELECTED, vote: int = MINED, precise: float = PRECISE) -> tuple[list[int], list[int]]:
    """The features whose presence sets labelled toxic rows apart, the best first: those for the classifier, and those precise enough to vote."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            place, found = features(part.column("text"))
            kinds, at = np.unique(found, return_inverse=True)
            label = np.asarray(part.column("label"))[place]
            toxic = np.bincount(at[label == 1], minlength=len(kinds))
            clean = np.bincount(at[label == 0], minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(toxic), pa.array(clean)], ["feature", "toxic", "clean"])

    told = rows.where(F.col("label").isNotNull()).select("text", "label")
    total = told.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")).first()
    counts = told.mapInArrow(work, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts.where(F.col("toxic") > F.col("clean") * (total.toxic / max(total.clean, 1))), "toxicity-counts")
    p1, p0 = (F.col("toxic") + 0.5) / (total.toxic + 1), (F.col("clean") + 0.5) / (total.clean + 1)
    share = (F.col("toxic") + F.col("clean")) / (total.toxic + total.clean)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (share * of))).otherwise(0.0)
    sure = 2 * (part(F.col("toxic"), total.toxic) + part(F.col("clean"), total.clean))  # likelihood ratio: chance alone stays below
    good = counts.where((p1 > 4 * p0) & (sure > SURE))
    sharp = good.where(F.col("toxic") >= precise * (F.col("toxic") + F.col("clean")))
    best = lambda df, n: [r.feature for r in df.orderBy(sure.desc(), "feature").limit(n).collect()]
    voters = best(sharp, vote)
    # the classifier knows every voter
    return list(dict.fromkeys([*voters, *best(good, most)]))[:most], voters


def _evidence(column: pa.Array, selected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and columns of the selected features that occur, and the fixed voters' votes. ``selected`` is sorted."""
    place, found = features(column)
    votes = fixed_votes(column, place, found)
    if not len(selected):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), votes
    sieve = np.zeros(1 << 16, dtype=bool)
    sieve[selected & 0xFFFF] = True
    likely = sieve[found & 0xFFFF]
    place, found = place[likely], found[likely]
    at = np.minimum(np.searchsorted(selected, found), len(selected) - 1)
    real = selected[at] == found
    return place[real], at[real], votes


def fit(df: DataFrame, labels: DataFrame, text: str, key: str, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on about ``train_rows`` labelled rows of ``df`` and as many without label, chosen by a hash of ``key``; ``labels`` has ``key`` and ``toxic``."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    truth = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("toxic").cast("int").alias("label"))
    labelled = thinned(rows.join(truth, "k"), ["k"], train_rows)
    others = thinned(rows.join(truth, "k", "left_anti").withColumn("label", F.lit(None).cast("int")), ["k"], train_rows)
    rows = materialize(labelled.unionByName(others).select("text", "label"), "toxicity-train")
    best, voters = select(rows)
    selected = np.array(sorted(best), dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            place, column, votes = _evidence(part.column("text"), selected)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(part.num_rows + 1))
            held = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(column[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([held, pa.array([v.tobytes() for v in votes], pa.binary()), part.column("label").fill_null(-1)], ["held", "votes", "label"])

    seen = rows.mapInArrow(work, "held array<int>, votes binary, label int").toPandas()
    # texts with the same features, votes and label are one row that counts so often
    seen = seen.assign(held=[np.sort(h).astype("<i4").tobytes() for h in seen["held"]]).groupby(["label", "held", "votes"], sort=True).size().reset_index(name="times")
    seen["held"] = [np.frombuffer(h, dtype="<i4") for h in seen["held"]]
    times = seen["times"].to_numpy(dtype=float)
    known = seen["label"].to_numpy()
    width = len(WORDS) + len(PATTERNS)
    if not (known == 1).any() or not (known == 0).any():
        return Classifier(None, selected, np.zeros(len(selected) + width), 0.0)
    row = np.repeat(np.arange(len(seen)), [len(h) for h in seen["held"]])
    column = np.concatenate([np.asarray(h, dtype=np.int64) for h in seen["held"]])
    fixed = np.frombuffer(b"".join(seen["votes"]), dtype=bool).reshape(len(seen), width)
    mined = np.searchsorted(selected, voters)
    number = np.full(len(selected), -1)
    number[mined] = np.arange(len(mined))
    votes = np.zeros((len(seen), width + len(mined)), dtype=bool)
    votes[:, :width] = fixed
    votes[row[number[column] >= 0], width + number[column][number[column] >= 0]] = True
    model = fit_label_model(votes, known, times)
    y = model.posterior(votes)
    vote_row, vote_column = np.nonzero(fixed)
    row, column = np.concatenate((row, vote_row)), np.concatenate((column, vote_column + len(selected)))
    weights, bias = fit_linear(row, column, len(selected) + width, y, times)
    return Classifier(model, selected, weights, bias)


def score(df: DataFrame, text: str, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with ``score``, the classifier's probability, and ``predicted``, 1 from ``threshold`` on."""
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    selected, weights, bias, fitted = model.selected, model.weights, model.bias, model.label_model is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            place, column, votes = _evidence(part.column(text), selected)
            odds = bias + np.bincount(place, weights=weights[column], minlength=part.num_rows) + votes @ weights[len(selected) :]
            chance = np.round(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 6) if fitted else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(chance), pa.array((chance >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return df.select(*kept).mapInArrow(work, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out())
    model = fit(docs.where(~is_held_out()), labels, "text", "doc_id")
    return score(docs, "text", model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
