"""Filling prompts of fixed capacity with texts of varying size: bounded-space online best fit.

The texts of one window go to lanes of about ``lane_rows`` texts, so that no window is one task. A lane
keeps a fixed number of open prompts, puts each text where it leaves least room, and when it fits nowhere
emits the fullest prompt and opens a new one. Prompts still open at the end of the lanes are merged with
each other in rounds. A text is cut only when it alone is larger than the capacity.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import STANDALONE, token_estimate
from ..runtime import clash_free, cut, fingerprint

OPEN_PROMPTS = 48
LANE_ROWS = 20_000
MERGED_LANES = 32


def pieces_of(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the fewest pieces from the left whose estimate is at most ``capacity`` each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    size = np.concatenate([[0], np.cumsum(width)])
    signs = np.concatenate([[0], np.cumsum(np.isin(points, [ord(c) for c in STANDALONE]))])
    out, at = [], 0
    while at < len(points):
        by_size = int(np.searchsorted(size, size[at] + capacity * 16 // 5, side="right")) - 1
        by_sign = int(np.searchsorted(signs, signs[at] + 3 * capacity + 2, side="right")) - 1
        end = max(at + 1, min(by_size, by_sign, len(points)))
        tokens = max(-(-int(size[end] - size[at]) * 5 // 16), int(signs[end] - signs[at]) // 3, 1)
        out.append((at, end, tokens))
        at = end
    return out


class Prompts:
    """Open prompts of one lane, ordered by the room left in them."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open, self.count = capacity, most_open, 0
        self.room: list[tuple[int, int]] = []

    def place(self, size: int) -> int:
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            left, number = self.room.pop(at)
        else:
            if len(self.room) >= self.most_open:
                self.room.pop(0)
            left, number = self.capacity, self.count
            self.count += 1
        bisect.insort(self.room, (left - size, number))
        return number


PLACED = "window_id int, lane int, prompt string, open boolean, dep_id long, piece int, pieces int, start int, end int, tokens long, capacity long"


def pack(deps: DataFrame, windows: DataFrame, lane_rows: int = LANE_ROWS, most_open: int = OPEN_PROMPTS) -> DataFrame:
    """A row for each text, or for each piece of a text that had to be cut, with the prompt it goes to.

    Columns: window_id, prompt, dep_id, piece (from 0), pieces, start and end (code points; null when the
    text is null), tokens, capacity. The size of a text is its token estimate, that of a null text its
    stored tokens. Exact repeats of a row are packed once. Rows without dep_id, without size, or whose
    window is unknown or has no positive capacity are left out. Empty tables give no rows.
    """
    rows = clash_free(deps, "dep_id", "window_id", "text", "tokens")
    rooms = windows.select(windows["window_id"].cast("int").alias("window_id"), windows["capacity"].cast("long").alias("capacity")).filter("capacity > 0").groupBy("window_id").agg(F.max("capacity").alias("capacity"))
    rows = rows.select(F.col("dep_id").cast("long").alias("dep_id"), F.col("window_id").cast("int").alias("window_id"), "text", "tokens", F.coalesce(token_estimate(F.col("text")), F.when(F.col("tokens") < 0, F.lit(0)).otherwise(F.col("tokens"))).cast("long").alias("size"))
    rows = rows.join(rooms, "window_id").dropna(subset=["dep_id", "size"])
    # A text travels only where it has to be cut; repeats are told by two hashes of it.
    rows = rows.withColumn("same", F.concat_ws(":", F.md5("text"), F.xxhash64("text", "tokens").cast("string"), F.col("text").isNull().cast("string")))
    rows = rows.select("dep_id", "window_id", "capacity", F.col("size").alias("tokens"), "same", F.when(F.col("size") > F.col("capacity"), F.col("text")).alias("text")).distinct()
    sized = cut(rows.withColumn("at", fingerprint("dep_id", "same")).drop("same"))
    lanes = sized.groupBy("window_id").agg(F.ceil(F.count("*") / lane_rows).cast("int").alias("lanes"))
    spread = sized.join(lanes, "window_id").withColumn("lane", (F.col("at") % F.col("lanes")).cast("int"))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        window, lane = key
        capacity = int(group["capacity"].iat[0])
        prompts, out = Prompts(capacity, most_open), []
        for dep, text, tokens in group.sort_values(["at", "dep_id", "tokens"], kind="stable")[["dep_id", "text", "tokens"]].itertuples(index=False):
            if tokens <= capacity:
                parts = [(None, None, tokens)]
            elif isinstance(text, str):
                parts = pieces_of(text, capacity)
            else:
                parts = [(None, None, min(capacity, tokens - t)) for t in range(0, tokens, capacity)]
            for number, (start, end, size) in enumerate(parts):
                out.append((window, lane, prompts.place(int(size)), dep, number, len(parts), start, end, size, capacity))
        done = pd.DataFrame(out, columns=["window_id", "lane", "prompt", "dep_id", "piece", "pieces", "start", "end", "tokens", "capacity"])
        done["open"] = done["prompt"].isin({number for _, number in prompts.room})
        done["prompt"] = f"{lane}." + done["prompt"].astype(str)
        return done.astype({"start": "Int32", "end": "Int32"})[["window_id", "lane", "prompt", "open", "dep_id", "piece", "pieces", "start", "end", "tokens", "capacity"]]

    placed = cut(spread.groupBy("window_id", "lane").applyInPandas(fill, PLACED))
    most = lanes.agg(F.max("lanes")).first()[0] or 0
    names = _merged_names(placed, most, most_open)
    # texts and pieces move once, when the prompts they lie in have got their last names
    return placed.join(names, ["window_id", "prompt"], "left").select("window_id", F.coalesce("name", "prompt").alias("prompt"), "dep_id", "piece", "pieces", "start", "end", "tokens", "capacity")


def _joiner(width: int, most_open: int):
    def join_up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        prompts = Prompts(int(group["capacity"].iat[0]), most_open)
        group = group.sort_values(["tokens", "prompt"], ascending=[False, True])
        group["into"] = [prompts.place(int(t)) for t in group["tokens"]]
        group["still"] = group["into"].isin({number for _, number in prompts.room})
        group["into"] = f"{width}.{key[1]}." + group["into"].astype(str)
        return group[["window_id", "lane", "prompt", "capacity", "tokens", "into", "still"]]

    return join_up


OPEN = "window_id int, lane int, prompt string, capacity long, tokens long"


def _merged_names(placed: DataFrame, lanes: int, most_open: int) -> DataFrame:
    """window_id, prompt, name: prompts left open at the end of lanes, and what they are merged into.

    Only the open prompts take part, at most ``most_open`` of each lane. Those of ``MERGED_LANES`` neighbouring
    lanes are put together, largest first; what stays open goes to the next round. None is taken apart.
    """
    open_ = cut(placed.filter("open").groupBy("window_id", "lane", "prompt", "capacity").agg(F.sum("tokens").alias("tokens")))
    names = open_.select("window_id", "prompt", F.col("prompt").alias("name"))
    width = 1
    while width == 1 or width < lanes:
        width *= MERGED_LANES

        moved = cut(open_.groupBy("window_id", F.floor(F.col("lane") / width).cast("int").alias("group")).applyInPandas(_joiner(width, most_open), OPEN + ", into string, still boolean"))
        names = cut(names.join(moved.select("window_id", F.col("prompt").alias("name"), "into"), ["window_id", "name"], "left").select("window_id", "prompt", F.coalesce("into", "name").alias("name")))
        open_ = moved.filter("still").groupBy("window_id", F.col("into").alias("prompt"), "capacity").agg(F.min("lane").alias("lane"), F.sum("tokens").alias("tokens")).select("window_id", "lane", "prompt", "capacity", "tokens")
    return names


def cut_texts(deps: DataFrame, windows: DataFrame) -> DataFrame:
    """dep_id of the texts that had to be cut."""
    return pack(deps, windows).filter("pieces > 1").select("dep_id").distinct()


def fill_report(placed: DataFrame) -> DataFrame:
    """For each window: prompts, tokens, capacity of one prompt and the share of all room that is used."""
    prompts = placed.groupBy("window_id", "prompt", "capacity").agg(F.sum("tokens").alias("tokens"))
    return prompts.groupBy("window_id", "capacity").agg(F.count("*").alias("prompts"), F.sum("tokens").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("prompts") * F.col("capacity")), 4))


def window_report(placed: DataFrame) -> DataFrame:
    """For each window: tokens of its uncut texts, prompts that hold more than the capacity, and whether little room is left.

    Little room: the prompts are at most a twentieth more than all tokens need, or one more.
    """
    prompts = placed.groupBy("window_id", "prompt", "capacity").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("pieces") == 1, F.col("tokens"))).alias("whole"))
    least = F.ceil(F.sum("tokens") / F.col("capacity"))
    return prompts.groupBy("window_id", "capacity").agg(F.sum("whole").alias("tokens"), F.sum((F.col("tokens") > F.col("capacity")).cast("long")).alias("overfull"), (F.count("*") <= F.greatest(least * 1.05, least + 1)).alias("tight"))
