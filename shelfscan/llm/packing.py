"""Texts packed into sequences of fixed token capacity, balanced by attention cost."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Cost of a text of n tokens: LINEAR n + QUADRATIC n^2, a layer's projections against its attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Pieces packed together; a group more costs at most part of one container.
GROUP = 20_000


class _Open:
    """Open sequences by room left, each room a heap by cost; a tree over the rooms gives the cheapest with enough."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.best = [(float("inf"), -1)] * (2 * self.base)

    def _set(self, room: int) -> None:
        i = self.base + room
        self.best[i] = self.heaps[room][0] if self.heaps[room] else (float("inf"), -1)
        i //= 2
        while i:
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])
            i //= 2

    def add(self, room: int, cost: float, seq: int) -> None:
        heapq.heappush(self.heaps[room], (cost, seq))
        self._set(room)

    def take(self, least: int, rooms: np.ndarray) -> tuple[float, int] | None:
        lo, hi, found = self.base + least, 2 * self.base, (float("inf"), -1)
        while lo < hi:
            if lo & 1:
                found, lo = min(found, self.best[lo]), lo + 1
            if hi & 1:
                hi -= 1
                found = min(found, self.best[hi])
            lo, hi = lo // 2, hi // 2
        if found[1] < 0:
            return None
        room = int(rooms[found[1]])
        heapq.heappop(self.heaps[room])
        self._set(room)
        return found


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each piece; pieces come in descending order, each goes to the cheapest sequence with room.
    Sequences enough for all tokens are open from the start; a piece that fits none opens one."""
    count = int(-(-sizes.sum() // capacity))
    rooms, costs = [capacity] * count, [0.0] * count
    held = _Open(capacity)
    for s in range(count):
        held.add(capacity, 0.0, s)
    out = np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        got = held.take(n, rooms)
        if got is None:
            got = (0.0, len(rooms))
            rooms.append(capacity)
            costs.append(0.0)
        cost, s = got
        rooms[s] -= n
        costs[s] = cost + LINEAR * n + QUADRATIC * n * n
        out[i] = s
        held.add(rooms[s], costs[s], s)
    return out


def containers(sizes: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """container_id, id_col, part, first_token, n_tokens of sizes(id_col, n_tokens).

    A text longer than the capacity is cut: full containers of its own and one piece for the rest; no other text is
    divided. Texts of no tokens, or of a null count or id, hold nothing and get no row; repeated ids are packed each; an empty table
    gives no rows.

    Pieces fall by hash into groups of about `group`, each packed by itself in one task: descending by size, to the
    sequence of the lowest estimated cost that has room. Groups bound the memory and the unused room they add.
    """
    rows = sizes.where((F.col("n_tokens") > 0) & F.col(id_col).isNotNull()).select(id_col, F.col("n_tokens").cast("bigint").alias("n"))
    cuts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("bigint"))))
    parts = cuts.select(
        id_col, "part", (F.col("part") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("part") * capacity).alias("n_tokens"),
    )
    groups = max(1, -(-parts.count() // group))
    keyed = parts.withColumn("g", F.pmod(F.xxhash64(id_col, "part"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", id_col, "part"], ascending=[False, True, True], kind="stable")
        pdf["container_id"] = (pdf["g"].to_numpy(np.int64) << 32) | pack(pdf["n_tokens"].to_numpy(), capacity)
        return pdf[["container_id", id_col, "part", "first_token", "n_tokens"]]

    kind = dict(sizes.dtypes)[id_col]
    return keyed.groupBy("g").applyInPandas(run, f"container_id bigint, {id_col} {kind}, part bigint, first_token bigint, n_tokens bigint")
