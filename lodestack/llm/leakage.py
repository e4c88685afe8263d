"""Evaluation texts inside training texts, found with spaced seeds.

A seed is a fixed mask over consecutive words: only the words at its marked places enter the hash, so a
substituted word at another place does not hide the match. Hashes of all windows of test items meet the
hashes of all windows of all documents; around each hit the overlap is measured on the words themselves,
both exactly and with substitutions.

Words are runs of letters and digits in lower case, after compatibility composition and without characters
that show nothing, so case, punctuation, markup signs and line layout don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, settle

#: Places of each mask that enter the hash; all span at most 13 words, so a run of 13 equal words meets each.
MASKS = ((0, 1, 2, 4, 7, 8, 10, 11, 12), (0, 1, 3, 4, 5, 6, 9, 11, 12), (0, 2, 3, 5, 6, 7, 8, 10, 12))
#: Seeds of test items up to this number are broadcast (16 bytes each); beyond it hits come from a join.
BROADCAST_SEEDS = 2_000_000
FILTER_BITS = 1 << 27  #: bits of the broadcast filter before that join: 16 megabytes
HOT_SEED = 20_000  #: rows of one seed that go to one key of the join

_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORDS = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 for i in range(64)], np.uint64)


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return _WORDS.findall(text.lower())


def _word_hashes(tokens: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, object), categorize=True) if tokens else np.empty(0, np.uint64)


def seed_hashes(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """One hash for each window of the mask's span; order of words and number of the mask matter."""
    count = len(hashes) - mask[-1]
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, number + 1, np.uint64)
    for place in mask:
        total += hashes[place : place + count] * _ODD[place]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
    return total


def _overlap(item: list[str], document: list[str], diagonal: int) -> tuple[int, int, int, int]:
    """Along one alignment: start and length of the longest equal run, then of the longest stretch with
    substitutions (runs of four or more equal words, gaps of at most two)."""
    lo, hi = max(0, -diagonal), min(len(item), len(document) - diagonal)
    run = best = best_at = 0
    span_from, span_to, equal_in, loose, loose_at = -1, -1, 0, 0, 0
    for i in range(lo, hi + 1):
        if i < hi and item[i] == document[i + diagonal]:
            run += 1
            continue
        if run:
            if run > best:
                best, best_at = run, i - run
            if run >= 4:
                if span_from < 0 or i - run - span_to > 2:
                    span_from = i - run
                span_to = i
                if span_to - span_from > loose:
                    loose, loose_at = span_to - span_from, span_from
            run = 0
    return best_at, best, loose_at, loose


def _verify(item_words: dict, hits: dict, tokens: list[str]) -> list[tuple]:
    out = []
    for item_id, diagonals in hits.items():
        found = [(*_overlap(item_words[item_id], tokens, d), d) for d in diagonals]
        exact = max(found, key=lambda x: (x[1], -x[0]))
        loose = max(found, key=lambda x: (x[3], -x[2]))
        out.append((item_id, exact[1], loose[3], loose[2] + loose[4], len(item_words[item_id])))
    return out


FOUND = "item_id long, doc_id long, exact_words int, loose_words int, doc_word int, item_words int"


def _seeds_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """seed, owner, place of all masks in each row's (owner, text)."""
    for batch in batches:
        for owner, text in zip(batch.iloc[:, 0], batch["text"]):
            hashes = _word_hashes(words(text))
            for number, mask in enumerate(MASKS):
                seeds = seed_hashes(hashes, mask, number)
                if len(seeds):
                    yield pd.DataFrame({"seed": seeds.view(np.int64), "owner": owner, "place": np.arange(len(seeds), dtype=np.int32)})


def overlaps(items: DataFrame, documents: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, filter_bits: int = FILTER_BITS, hot_seed: int = HOT_SEED) -> DataFrame:
    """item_id, doc_id and the longest overlap of each pair that shares a seed.

    exact_words: the longest run of equal words; loose_words: the longest stretch with substitutions, which
    begins at word doc_word of the document. Null ids or texts are left out; of rows with one id all texts
    count; texts shorter than a mask share no seed. Empty tables give no rows.
    """
    spark = documents.sparkSession
    tests = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).dropna().distinct()
    corpus = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text")).dropna()

    schema = "seed long, owner long, place int"
    test_seeds = tests.mapInPandas(_seeds_of, schema)
    # words of an item are about six letters: this bounds the seeds without making them
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size * len(MASKS) // 2 <= broadcast_seeds:
        return _by_broadcast(spark, tests, test_seeds, corpus)
    return _by_join(tests, test_seeds, corpus, schema, filter_bits, hot_seed)


def _by_broadcast(spark, tests: DataFrame, test_seeds: DataFrame, corpus: DataFrame) -> DataFrame:
    numbered = [(n, i, t) for n, (i, t) in enumerate(sorted((r["item_id"], r["text"]) for r in tests.collect()))]
    item_words = {n: words(t) for n, _, t in numbered}
    rows = defaultdict(list)
    for n, tokens in item_words.items():
        hashes = _word_hashes(tokens)
        for number, mask in enumerate(MASKS):
            for place, seed in enumerate(seed_hashes(hashes, mask, number).tolist()):
                rows[seed].append((n, place))
    known = np.sort(np.fromiter(rows.keys(), np.uint64, len(rows)))
    shared = spark.sparkContext.broadcast((known, dict(rows), item_words, {n: i for n, i, _ in numbered}))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, where, texts, ids = shared.value
        for batch in batches:
            out = []
            token_lists = [words(t) for t in batch["text"]]
            lengths = np.array([len(t) for t in token_lists])
            flat = _word_hashes([w for t in token_lists for w in t])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            hits: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
            for number, mask in enumerate(MASKS):
                windows = seed_hashes(flat, mask, number)
                if not len(windows) or not len(seeds):
                    continue
                at = np.searchsorted(seeds, windows)
                match = np.flatnonzero(seeds[np.minimum(at, len(seeds) - 1)] == windows)
                owner = np.searchsorted(ends, match, side="right")
                for place, doc, seed in zip(match.tolist(), owner.tolist(), windows[match].tolist()):
                    if place + mask[-1] < ends[doc]:
                        for n, item_place in where[seed]:
                            hits[doc][n].add(place - int(starts[doc]) - item_place)
            for doc, found in hits.items():
                out += [(ids[n], batch["doc_id"].iat[doc], *rest) for n, *rest in _verify(texts, found, token_lists[doc])]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "exact_words", "loose_words", "doc_word", "item_words"])

    return _longest(corpus.mapInPandas(search, FOUND))


def _by_join(tests: DataFrame, test_seeds: DataFrame, corpus: DataFrame, schema: str, filter_bits: int, hot_seed: int) -> DataFrame:
    """For test sets too large to broadcast: seeds meet in a join, texts of hit pairs follow by their ids.

    A broadcast filter of ``filter_bits`` bits, made of all test seeds, keeps corpus seeds that can't hit from
    the shuffle. A seed that very many documents hold is spread over several keys. Pairs are told by all
    their alignments before any text is joined, and only texts of documents that were hit move.
    """
    left = settle(test_seeds.select("seed", F.col("owner").alias("item_id"), F.col("place").alias("item_place")))
    words_ = left.select((F.col("seed").bitwiseAND(F.lit(filter_bits - 1))).alias("bit")).distinct().groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toPandas()
    mask = np.zeros(filter_bits // 64, np.int64)
    mask[words_["word"].to_numpy(np.int64)] = words_["mask"].to_numpy(np.int64)
    shared = tests.sparkSession.sparkContext.broadcast(mask.view(np.uint64))

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for frame in _seeds_of(batches):
            bits = frame["seed"].to_numpy().view(np.uint64) & np.uint64(filter_bits - 1)
            frame = frame[(held[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) == 1]
            if len(frame):
                yield frame

    right = settle(corpus.mapInPandas(likely, schema).join(left.select("seed").distinct(), "seed", "left_semi").select("seed", F.col("owner").alias("doc_id"), "place"))
    salts = right.groupBy("seed").agg(F.ceil(F.count("*") / hot_seed).cast("int").alias("salts"))
    spread = left.join(salts, "seed").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    hot = F.broadcast(cut(salts.filter("salts > 1")))  # at most one seed in ``hot_seed`` rows
    salted = right.join(hot, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.coalesce("salts", F.lit(1))).cast("int"))
    hits = spread.drop("salts").join(salted.drop("salts"), ["seed", "salt"]).groupBy("item_id", "doc_id").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("diagonals"))
    hits = cut(hits)
    texts = corpus.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    both = hits.join(tests.withColumnRenamed("text", "item_text"), "item_id").join(texts, "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, item, diagonals, a, b in zip(batch["doc_id"], batch["item_id"], batch["diagonals"], batch["item_text"], batch["text"]):
                out += [(n, doc, *rest) for n, *rest in _verify({item: words(a)}, {item: set(diagonals)}, words(b))]
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "exact_words", "loose_words", "doc_word", "item_words"])

    return _longest(both.select("doc_id", "item_id", "diagonals", "item_text", "text").mapInPandas(measure, FOUND))


def _longest(found: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("loose_words", "doc_word", "item_words"), F.struct("loose_words", -F.col("doc_word"))).alias("best")
    return found.groupBy("item_id", "doc_id").agg(F.max("exact_words").alias("exact_words"), best).select("item_id", "doc_id", "exact_words", "best.loose_words", "best.doc_word", "best.item_words")


def leaked(items: DataFrame, documents: DataFrame, least_words: int = 13, **settings) -> DataFrame:
    """Pairs where the document holds ``least_words`` or more consecutive words of the item."""
    return overlaps(items, documents, **settings).filter(F.col("exact_words") >= least_words).select("item_id", "doc_id").distinct()


def altered(items: DataFrame, documents: DataFrame, least_words: int = 20, **settings) -> DataFrame:
    """item_id, doc_id, exact_words, loose_words of overlaps of ``least_words`` or more in which words were substituted."""
    found = overlaps(items, documents, **settings).filter((F.col("loose_words") >= least_words) & (F.col("loose_words") > F.col("exact_words")))
    return found.select("item_id", "doc_id", "exact_words", "loose_words")
