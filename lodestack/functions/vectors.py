"""Vector expressions and embeddings that need no model."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.filter(pairs, lambda v: v.isNotNull()), F.lit(0.0), lambda total, v: total + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 when either is empty or all zero there."""
    width = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, width), F.slice(b, 1, width)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))


def cosine_to(query: list[float]):
    """A vectorised cosine with one fixed vector over the common length; 0 where either is empty or all zero."""
    wanted = np.asarray(query, float)

    @F.pandas_udf(DoubleType())
    def similarity(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        lengths = np.array([-1 if v is None else len(v) for v in vectors])
        for length in np.unique(lengths[lengths >= 0]):
            rows = np.flatnonzero(lengths == length)
            width = min(int(length), len(wanted))
            x, y = np.stack(vectors.iloc[rows].to_list()).astype(float)[:, :width], wanted[:width]
            size = np.sqrt((x * x).sum(1) * (y @ y))
            out[rows] = np.where(size > 0, x @ y / np.where(size > 0, size, 1.0), 0.0)
        return pd.Series(out).where(lengths >= 0, None)

    return similarity


MOCK_DIMS = 64


@F.pandas_udf(ArrayType(DoubleType()))
def mock_embedding(texts: pd.Series) -> pd.Series:
    """Place p of code point c adds c/256 at (7p + c) mod 64; length one. A stand-in without any meaning."""
    def embed(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        vector = np.bincount((np.arange(len(points)) * 7 + points) % MOCK_DIMS, points / 256.0, MOCK_DIMS)
        size = math.sqrt(float(vector @ vector))
        return vector / size if size else vector

    return pd.Series([embed(t) if isinstance(t, str) else None for t in texts])


_TERM = re.compile(r"\w+")


MOST_TERMS = 200_000  #: terms whose features a worker remembers
_KNOWN: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


def _learn(terms: list[str], dims: int) -> None:
    """Slots and values that one occurrence of each term adds; all are hashed together."""
    if len(_KNOWN) + len(terms) > MOST_TERMS:
        _KNOWN.clear()
    names = [[term, *("#" + term[i : i + 3] for i in range(len(term) - 2))] for term in terms]
    sizes = [len(n) for n in names]
    ends = np.cumsum(sizes)
    flat = np.array([n for own in names for n in own], object)
    weights = np.full(len(flat), 0.2)
    weights[ends - sizes] = 1.0
    parts = []
    for scale, salt in ((1.0, "0123456789123456"), (0.5, "6543219876543210")):
        hashes = pd.util.hash_array(flat, hash_key=salt, categorize=False)
        parts.append(((hashes % np.uint64(dims)).astype(np.int64), weights * scale * np.where(hashes >> np.uint64(63), -1.0, 1.0)))
    for term, size, end in zip(terms, sizes, ends):
        own = slice(end - size, end)
        _KNOWN[term, dims] = np.concatenate([slots[own] for slots, _ in parts]), np.concatenate([values[own] for _, values in parts])


def feature_vector(text: str, dims: int = 384) -> np.ndarray:
    """Terms (1.0) and their trigrams (0.2) under two signed hashes, the second at half weight; length one."""
    vector = np.zeros(dims)
    counts = Counter(_TERM.findall(text.lower()))
    if counts:
        new = [term for term in counts if (term, dims) not in _KNOWN]
        if new:
            _learn(list(counts) if len(_KNOWN) + len(new) > MOST_TERMS else new, dims)
        parts = [_KNOWN[term, dims] for term in counts]
        times = np.repeat(np.fromiter(counts.values(), float), [len(v) for _, v in parts])
        vector = np.bincount(np.concatenate([s for s, _ in parts]), np.concatenate([v for _, v in parts]) * times, dims)
    size = math.sqrt(float(vector @ vector))
    return vector / size if size else vector


@F.pandas_udf(ArrayType(DoubleType()))
def fallback_embedding(texts: pd.Series) -> pd.Series:
    return pd.Series([feature_vector(t) if isinstance(t, str) else None for t in texts])


def model_embedding(load, batch: int = 256):
    """A column function for a model: ``load()`` gives, once in each Python worker, a function from texts to vectors.

    Texts go to the model in batches; null texts have null vectors. Where no model can be loaded, that is
    where ``load`` returns None, :func:`feature_vector` stands in.
    """
    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in series:
            known = texts.dropna()
            vectors: list = []
            for at in range(0, len(known), batch):
                part = known.iloc[at : at + batch].tolist()
                vectors += [list(map(float, v)) for v in (encode(part) if encode else map(feature_vector, part))]
            yield pd.Series(vectors, index=known.index, dtype=object).reindex(texts.index).where(texts.notna(), None)

    return embed


def searchable_text(tracker: Column, name: Column, kind: Column, source: Column) -> Column:
    """What is embedded of a node: its module path if it has one, identity, and the source twice."""
    parts = F.split(tracker, "::")
    module = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "::")
    head = F.when(F.size(parts) > 2, F.concat(F.lit("[module: "), module, F.lit("]\n"))).otherwise(F.lit(""))
    return F.concat(head, F.concat_ws(" ", tracker, name, kind), F.lit("\n"), F.coalesce(source, F.lit("")), F.lit("\n"), F.coalesce(source, F.lit("")))
