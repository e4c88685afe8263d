"""Mixing sources to target shares of tokens with soft membership.

Documents that name their source belong to it. For the rest a classifier, fitted on a bounded sample of
labelled documents, gives a posterior over the sources. Documents of like membership form a class; there are
at most ``LEVELS`` classes for each pair of sources. The expected tokens that each class has of each source
are summed over all documents once. Projected gradient steps then fit one nonnegative rate for each class so
that the expected tokens of all sources meet their targets; no rate exceeds the repeats its source allows.
Every document takes the rate of its class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, fingerprint, settle
from .vocab import BPE_FILE, TOKENIZER_FOLDER, token_counts

LABELLED_ROWS = 6_000  #: the most documents the classifier is fitted on
FEATURES = 2_048
LEVELS = 16  #: grades of membership between the two likeliest sources of a document
STEPS, TOLERANCE = 20_000, 1e-7  #: most gradient steps on the class sums, and the residual share at which they end
LEAST_TOTAL = 0.05  #: the mix keeps at least this part of the tokens of known source, even if some targets are missed
ROUNDING = 1e-12  #: a missing part of the wanted tokens that is no more than this comes from rounding
ENCODED_AT_ONCE = 256  #: texts handed to the tokenizer together, which bounds a worker's memory

_PIECES = re.compile(r"\w+|[^\w\s]|\n")


def source_key(source: Column) -> Column:
    """Source names in lower case without surrounding blanks; null when nothing is left."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def features(text: str) -> np.ndarray:
    """Hashed words, signs and line starts of a whole text, damped and of length one."""
    text = text.lower()
    parts = _PIECES.findall(text) + ["^" + line[:3] for line in text.split("\n")]
    names, counts = np.unique(np.array(parts, object).astype(str), return_counts=True) if parts else (np.empty(0, str), np.empty(0))
    vector = np.zeros(FEATURES, np.float32)
    if len(names):
        np.add.at(vector, (pd.util.hash_array(names.astype(object), categorize=False) % FEATURES).astype(int), np.log1p(counts))
        vector /= max(np.linalg.norm(vector), 1e-12)
    return vector


@dataclass
class Classifier:
    """Softmax regression over hashed features."""

    sources: list[str]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, sources: list[str], rounds: int = 200, rate: float = 8.0, decay: float = 1e-5) -> Classifier:
        truth = np.eye(len(sources), dtype=np.float32)[labels]
        weights, bias = np.zeros((x.shape[1], len(sources)), np.float32), np.log(truth.sum(0) + 1).astype(np.float32)
        for _ in range(rounds if len(x) else 0):
            wrong = (cls(sources, weights, bias).posteriors(x) - truth) / len(x)
            weights -= rate * (x.T @ wrong + decay * weights)
            bias -= rate * wrong.sum(0)
        return cls(sources, weights, bias)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        scores = x @ self.weights + self.bias
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def fit_classifier(documents: DataFrame, sources: list[str], labelled_rows: int = LABELLED_ROWS) -> Classifier:
    """From at most ``labelled_rows`` documents with a source of ``sources``, those of lowest hash."""
    labelled = documents.select("doc_id", "text", source_key(F.col("source")).alias("source")).dropna().filter(F.col("source").isin(sources))
    count = labelled.count()
    share = min(1.0, labelled_rows / max(count, 1))
    sample = labelled.filter(fingerprint("doc_id") % 1_000_003 < int(share * 1_000_003) + 1)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"source": batch["source"], "x": [features(t).astype("<f2").tobytes() for t in batch["text"]]})

    rows = sample.limit(labelled_rows).mapInPandas(encode, "source string, x binary").toPandas().sort_values(["source", "x"])
    x = np.frombuffer(b"".join(rows["x"]), "<f2").reshape(-1, FEATURES).astype(np.float32)
    number = {s: i for i, s in enumerate(sources)}
    return Classifier.fit(x, rows["source"].map(number).to_numpy(int), sources)


@dataclass
class Goals:
    """Targets in order of their sources."""

    sources: list[str]
    shares: np.ndarray
    repeats: np.ndarray

    @classmethod
    def read(cls, targets: DataFrame) -> Goals:
        """Targets are few and given. Of a source named twice the larger share counts; rows with nulls are left out."""
        goals: dict[str, tuple[float, int]] = {}
        for row in targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("repeats")).dropna().collect():
            goals[row["source"]] = max(goals.get(row["source"], (0.0, 0)), (row["share"], row["repeats"]))
        names = sorted(goals)
        return cls(names, np.array([goals[n][0] for n in names]), np.array([float(max(0, goals[n][1])) for n in names]))


def fit_rates(expected: np.ndarray, caps: np.ndarray, wanted: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(rates, residuals): rates in [0, cap] of classes whose expected tokens add up to what is wanted of each source.

    ``expected`` has a row for each class and a column for each source. Accelerated projected gradient steps on
    the squared distances, each measured against all tokens of its source; a residual is the share of the
    wanted tokens of a source that stays missing (negative when there are too many), and steps end when none
    is left or nothing moves any more.
    """
    room = expected.sum(0)
    scale = np.where(room > 0, room, 1.0)
    part, goal = expected / scale, wanted / scale
    missing = lambda rate: np.where(wanted > 0, 1.0 - (rate @ expected) / np.where(wanted > 0, wanted, 1.0), 0.0)
    rate = np.minimum(1.0, caps)
    if not len(rate):
        return rate, np.where(wanted > 0, 1.0, 0.0)
    size = max(np.linalg.norm(part, 2) ** 2, 1e-12)
    ahead, momentum, last = rate, 1.0, np.inf
    for step in range(steps):
        if step % 100 == 0:  # a missed target that comes no nearer can't be met
            now = float(np.square(rate @ part - goal).sum())
            if now > last * (1 - 1e-4):
                break
            last = now
        new = np.clip(ahead - (ahead @ part - goal) @ part.T / size, 0.0, caps)
        moved = new - rate
        if np.abs(new @ part - goal).max() < tolerance * max(goal.max(), 1e-12) or np.abs(moved).max() < 1e-12:
            rate = new
            break
        if moved @ (ahead - new) > 0:  # the momentum leads uphill
            momentum = 1.0
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, rate, momentum = new + (momentum - 1) / after * moved, new, after
    return rate, missing(rate)


def fit_mix(expected: np.ndarray, caps: np.ndarray, shares: np.ndarray, most: float, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(rates, residuals, total): the largest total from ``least`` to ``most`` tokens at which every share is met.

    Halves the interval of totals; sources without any tokens can't be met at any total and don't bind it.
    When shares stay missed at the least total, that is what is returned, with the residuals.
    """
    bind = expected.sum(0) > 0 if len(expected) else np.zeros(len(shares), bool)

    def at(total: float) -> tuple[bool, np.ndarray, np.ndarray]:
        rate, missing = fit_rates(expected, caps, np.where(bind, shares, 0.0) * total)
        return bool(np.abs(missing[bind]).max(initial=0.0) < 1e-4), rate, missing

    met, rate, missing = at(most)
    low, high, best = least, most, (rate, missing, most)
    if not met:
        met, rate, missing = at(least)
        best = rate, missing, least
        while met and high - low > 1e-3 * most:
            middle = (low + high) / 2
            met_there, rate, missing = at(middle)
            if met_there:
                low, best = middle, (rate, missing, middle)
            else:
                high = middle
    rate, missing, total = best
    return rate, np.where(bind | (shares <= 0), missing, 1.0), total


def classes_of(posterior: np.ndarray) -> np.ndarray:
    """The class of each posterior: its likeliest source, the next one, and the grade between the two."""
    width = posterior.shape[1]
    order = np.argsort(-posterior, axis=1, kind="stable")
    first, second = order[:, 0], order[:, min(1, width - 1)]
    p = np.take_along_axis(posterior, order[:, :2], 1)
    grade = np.minimum((p[:, 0] / np.maximum(p.sum(1) if width > 1 else p[:, 0], 1e-12) * 2 - 1) * LEVELS, LEVELS - 1).astype(int) if width > 1 else np.zeros(len(p), int)
    return ((first * width + second) * LEVELS + np.maximum(grade, 0)).astype(np.int64)


def mix(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZER_FOLDER, file: str = BPE_FILE, labelled_rows: int = LABELLED_ROWS, least_total: float = LEAST_TOTAL) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: doc_id, source (null where unknown), tokens, rate, copies; a document occurs ``copies`` times,
    never more than its source allows. report: for each source its target, own tokens, whether it can reach
    the target with its own documents, the shares of expected tokens reached by rates and by whole copies,
    and the residual of the fit. The total is the largest one up to the tokens of known source at which all
    targets are met. Without targets both results are empty; a mix without documents has no shares.
    """
    spark = documents.sparkSession
    goals = Goals.read(targets)
    sources, width = goals.sources, len(goals.sources)
    number = {s: i for i, s in enumerate(sources)}
    model = spark.sparkContext.broadcast(fit_classifier(documents, sources, labelled_rows) if sources else None)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").dropna(subset=["doc_id"])
    rows = rows.filter(F.col("source").isin(sources) | F.col("text").isNotNull()) if sources else rows.limit(0)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ENCODED_AT_ONCE):
                part = batch.iloc[at : at + ENCODED_AT_ONCE]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                own = part["source"].map(number)
                posterior = np.zeros((len(part), width))
                known = own.notna().to_numpy()
                posterior[known, own[known].astype(int)] = 1.0
                if not known.all():
                    posterior[~known] = model.value.posteriors(np.stack([features(texts[i]) for i in np.flatnonzero(~known)]))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].where(known, None).to_numpy(), "tokens": token_counts(texts, folder, file), "class": classes_of(posterior), "known": known, "posterior": list(posterior.astype(np.float32)), "print": part["print"].to_numpy()})

    # texts pass no shuffle: of rows with the same text one is kept after they were judged
    judged = rows.withColumn("print", fingerprint("text")).mapInPandas(judge, "doc_id long, source string, tokens long, class long, known boolean, posterior array<float>, print long")
    judged = settle(judged.groupBy("doc_id", "source", "print").agg(F.first(F.struct("tokens", "class", "known", "posterior")).alias("d")).select("doc_id", "source", "d.*"))

    def class_sums(weight) -> DataFrame:
        sums = [F.sum(F.col("posterior")[i] * F.col("tokens") * weight).alias(f"s{i}") for i in range(width)]
        return judged.groupBy("class", "known").agg(*sums)

    # at most two rows for each class; there are width * width * LEVELS classes
    table = sorted(class_sums(F.lit(1.0)).collect(), key=lambda r: (r["class"], r["known"])) if width else []
    expected = np.array([[r[f"s{i}"] or 0.0 for i in range(width)] for r in table]).reshape(len(table), width)
    known = np.array([r["known"] for r in table], bool)
    caps = np.array([goals.repeats[r["class"] // (width * LEVELS)] for r in table])
    own = expected[known].sum(0)
    rate, missing, total = fit_mix(expected, caps, goals.shares, float(own.sum()), least_total * float(own.sum()))
    short = _short(expected[known], caps[known], goals)

    rates = spark.createDataFrame([(r["class"], r["known"], float(x)) for r, x in zip(table, rate)], "class long, known boolean, rate double")
    chance = (fingerprint("doc_id") % 1_000_000_007) / 1_000_000_007
    every = judged.join(F.broadcast(rates), ["class", "known"])
    every = every.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    drawn = every.agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), *(F.sum(F.col("posterior")[i] * F.col("tokens") * F.col("copies")).alias(f"s{i}") for i in range(width))).first() if width else None
    by_rate, by_copies = rate @ expected if len(rate) else np.zeros(width), np.array([(drawn[f"s{i}"] if drawn else 0.0) or 0.0 for i in range(width)])
    part = lambda x, i: round(float(x[i] / x.sum()), 6) if x.sum() > 0 else None
    lines = [(s, float(goals.shares[i]), int(goals.repeats[i]), int(own[i]), not short[i], int(by_copies[i]), part(by_rate, i), part(by_copies, i), round(float(missing[i]), 6)) for i, s in enumerate(sources)]
    report = spark.createDataFrame(lines, "source string, target_share double, max_repeats long, own_tokens long, reachable boolean, used_tokens long, rate_share double, copy_share double, residual double")
    return every.select("doc_id", "source", "tokens", "rate", "copies"), report


def _short(expected: np.ndarray, caps: np.ndarray, goals: Goals) -> list[bool]:
    """Whether the fitted rates of the named documents leave each source short when the total is all their tokens.

    ``expected`` and ``caps`` are the classes of named documents. A source is short when tokens of it stay
    missing while every class that holds some of it is at its cap; what is missing below a cap is only the
    tolerance of the fit.
    """
    rate, missing = fit_rates(expected, caps, goals.shares * expected.sum())
    return [bool(x) for x in (missing > ROUNDING) & ((caps - rate) @ expected <= 0)]


def short_sources(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZER_FOLDER, file: str = BPE_FILE) -> DataFrame:
    """Sources whose own documents, repeated as often as allowed, stay below their share of all tokens of known source.

    The whole mix is made; rows are the sources that its report calls unreachable. Documents without a known
    source get their posteriors and rates in the mix but count for neither side here. Repeated rows count
    once; sources without documents and a share are short.
    """
    return mix(documents, targets, folder, file)[1].filter(~F.col("reachable")).select("source")
