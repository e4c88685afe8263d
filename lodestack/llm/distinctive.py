"""How distinctive a term is for a node: parsimonious language models.

The weight of a term in a node is explained partly by the node and partly by the whole index. Expectation
maximisation moves the weight that the index explains away from the node; what stays is the node's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import clash_free, cut, fingerprint, release, settle, shuffle_width

OWN_SHARE = 0.1  #: the share of a node's weight that its own model is given beforehand
ROUNDS, TOLERANCE = 100, 1e-9
TESTED_EVERY = 5  #: rounds after which it is asked whether a model still moves
LARGE_NODE = 200_000  #: distinct terms from which a node's model is fitted by joins over all executors
LARGE_AT_ONCE = 1_000_000  #: large nodes fitted together, whose sums of 16 bytes are broadcast
HOT_SHARE = 1_000  #: a term in a thousandth of all (node, term) rows is broadcast: a thousand terms at most
VALID_WEIGHTS = (1.0, 2.0, 3.0)


def term_weights(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, term, weight: the summed weight of usable postings of existing nodes, repeats counted once."""
    rows = clash_free(postings, "term", "node_id", "line", "weight").filter(F.col("weight").isin(*VALID_WEIGHTS)).dropna(subset=["term", "node_id"])
    # One exchange: repeats go in the partial sets, the places of a term in a node are summed behind it. A set
    # holds at most the lines of one node's source, which is itself one value of one row.
    places = F.collect_set(F.struct(F.col("line"), F.col("weight"))).alias("places")
    summed = rows.groupBy("node_id", "term").agg(places).select("node_id", "term", F.aggregate("places", F.lit(0.0), lambda total, p: total + p["weight"]).alias("weight"))
    return summed.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def with_background(weights: DataFrame) -> DataFrame:
    """Adds the term's share of all weight and the number of its nodes; hot terms don't pass the shuffle."""
    totals = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
    stats = weights.groupBy("term").agg((F.sum("weight") / F.lit(totals[0] or 1.0)).alias("background"), F.count("*").alias("in_nodes"))
    hot = F.broadcast(stats.filter(F.col("in_nodes") * HOT_SHARE >= F.lit(totals[1])))
    cold = stats.filter(F.col("in_nodes") * HOT_SHARE < F.lit(totals[1]))
    return weights.join(hot, "term").unionByName(weights.join(hot, "term", "left_anti").join(cold, "term"))


def fit_models(owner: np.ndarray, weight: np.ndarray, background: np.ndarray, own_share: float = OWN_SHARE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Converged probabilities of each row's term in its owner's model; rows of an owner lie together.

    Every owner stops for itself once none of its probabilities moves by ``tolerance``, so its model does not
    depend on the owners it is fitted beside.
    """
    out = np.empty(len(owner))
    if not len(owner):
        return out
    at = np.arange(len(owner))
    rest = (1 - own_share) * background
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    length = np.diff(np.r_[first, len(owner)])
    probability = weight / np.repeat(np.add.reduceat(weight, first), length)
    done = np.zeros(len(first), bool)
    for number in range(1, rounds + 1):
        moved = own_share * probability
        moved = weight * moved / (rest + moved)
        new = moved / np.repeat(np.maximum(np.add.reduceat(moved, first), 1e-300), length)
        before, probability = probability, new
        if number % TESTED_EVERY:
            continue
        ended = ~done & (np.maximum.reduceat(np.abs(new - before), first) < tolerance)
        if ended.any():
            rows = np.repeat(ended, length)
            out[at[rows]] = new[rows]
            done |= ended
            if done.all():
                return out
            if length[done].sum() > 0.3 * len(at):  # go on with the others alone
                rows = np.repeat(~done, length)
                at, weight, rest, probability, length = at[rows], weight[rows], rest[rows], probability[rows], length[~done]
                first, done = np.cumsum(length) - length, np.zeros(len(length), bool)
    rows = np.repeat(~done, length)
    out[at[rows]] = probability[rows]
    return out


SCORED = "node_id long, term string, weight double, in_nodes long, score double"


def score_terms(postings: DataFrame, nodes: DataFrame, own_share: float = OWN_SHARE, large_node: int = LARGE_NODE) -> DataFrame:
    """node_id, term, weight, in_nodes and score of each term of each node.

    Rows without term or node, of nodes that don't exist, or whose weight is none of the role weights are
    left out, exact repeats count once. Scores of a node sum to one. Empty tables give no rows.
    """
    weights = settle(term_weights(postings, nodes))
    sizes = weights.groupBy("node_id").agg(F.count("*").alias("terms")).filter(F.col("terms") > large_node)
    rows = with_background(weights)
    large = cut(sizes)
    count = large.count()
    if not count:
        return _small(rows, own_share)
    out = _small(rows.join(large, "node_id", "left_anti"), own_share)
    parts = -(-count // LARGE_AT_ONCE)
    for number in range(parts):
        some = large.filter(fingerprint("node_id") % parts == number)
        out = out.unionByName(_large(rows.join(some, "node_id", "left_semi"), own_share))
    return out


def _small(rows: DataFrame, own_share: float) -> DataFrame:
    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def models(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.reset_index(drop=True)
            frame["score"] = fit_models(frame["node_id"].to_numpy(), frame["weight"].to_numpy(), frame.pop("background").to_numpy(), own_share)
            return frame[["node_id", "term", "weight", "in_nodes", "score"]]

        for batch in batches:
            if batch.empty:
                continue
            last = batch["node_id"].iat[-1]
            ended = batch["node_id"] != last
            if kept and kept[0]["node_id"].iat[0] != last or ended.any():
                yield models(pd.concat([*kept, batch[ended]]))
                kept = []
            kept.append(batch[~ended])
        if kept:
            yield models(pd.concat(kept))

    spread = rows.select("node_id", "term", "weight", "background", "in_nodes").repartition(shuffle_width(rows.sparkSession), "node_id").sortWithinPartitions("node_id", "term")
    return spread.mapInPandas(fit, SCORED)


def _large(rows: DataFrame, own_share: float) -> DataFrame:
    """The same steps as joins with one small row for each node, so that a node is spread over all tasks.

    ``rows`` hold at most ``LARGE_AT_ONCE`` nodes, so what is broadcast has a bound.
    """
    def per_node(frame: DataFrame, value, name: str) -> DataFrame:
        return F.broadcast(frame.groupBy("node_id").agg(value.alias(name)))

    spread = rows.repartition(shuffle_width(rows.sparkSession), "node_id", "term")
    now = cut(spread.join(per_node(spread, F.sum("weight"), "all"), "node_id").select(*rows.columns, (F.col("weight") / F.col("all")).alias("score"), F.lit(True).alias("live")))
    for _ in range(ROUNDS):
        mine = F.col("score") * own_share
        moved = now.withColumn("moved", F.col("weight") * mine / (F.col("background") * (1 - own_share) + mine))
        new = F.when(F.col("live"), F.col("moved") / F.greatest("all", F.lit(1e-300))).otherwise(F.col("score"))
        after = cut(moved.join(per_node(moved, F.sum("moved"), "all"), "node_id").withColumn("new", new).drop("moved", "all"))
        moving = per_node(after, F.max(F.abs(F.col("new") - F.col("score"))) >= TOLERANCE, "moving")
        release(now)
        now = cut(after.join(moving, "node_id").withColumn("live", F.col("live") & F.col("moving")).drop("moving", "score").withColumnRenamed("new", "score"))
        release(after)
        if now.filter("live").limit(1).count() == 0:
            break
    return now.select("node_id", "term", "weight", "in_nodes", "score")


def most_distinctive(scored: DataFrame) -> DataFrame:
    """The best term of each node; ties go to the term in fewer nodes, then to the first by text."""
    order = F.struct(-F.round("score", 9), "in_nodes", "term")
    return scored.groupBy("node_id").agg(F.min_by("term", order).alias("term"))
