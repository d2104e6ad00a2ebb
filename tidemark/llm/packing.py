"""Documents into containers of fixed capacity, by sum-of-squares packing.

A document goes where the sum of squared counts of open bins per residual gap
becomes smallest.  As all sizes of a shard are known, a new bin is only weighed
against the open ones while their room is less than ``OPEN_SHARE`` of what is still to
be placed; after that it is opened only for what fits nowhere.  Documents are packed in shards of bounded size, longest first
within a shard, so that no task holds more than ``SHARD`` of them; a shard wastes at
most some bins, a share that does not grow with the corpus.  Only documents larger
than an empty container are split: into full containers and a rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut

SHARD = 20_000
OPEN_SHARE = 0.5


class Bins:
    """Open bins by gap, with sum-of-squares placement."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = self.room = 0

    def place(self, size: int, to_come: float = float("inf")) -> int:
        """The bin of an item of 1 <= size <= capacity, with ``to_come`` still to be placed.

        From gap g the item changes the sum by 2 (N(g - size) - N(g) + 1); a bin
        filled to the brim counts no more. Ties fall to the tightest gap, then to an
        open bin before a new one.
        """
        c, n = self.capacity, self.counts
        gaps = np.flatnonzero(n[size:]) + size
        best_gap, best = c, (2 * n[c - size] + 1 if c > size else 0)
        if len(gaps):
            left = gaps - size
            change = np.where(left > 0, 2 * n[left] + 2, 1) - 2 * n[gaps]
            i = int(np.argmin(change))
            if change[i] <= best or self.room >= OPEN_SHARE * to_come:
                best_gap = int(gaps[i])
        if best_gap == c and (c == size or not n[c]):
            at, self.made = self.made, self.made + 1
            self.room += c
        else:
            at = self.open[best_gap].pop()
            n[best_gap] -= 1
        self.room -= size
        if best_gap > size:
            n[best_gap - size] += 1
            self.open.setdefault(best_gap - size, []).append(at)
        return at


def pack_shard(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item index, piece number (from 1), tokens and container of every piece of one shard."""
    full = sizes // capacity
    rest = sizes - full * capacity
    full_of = np.repeat(np.arange(len(sizes)), full)
    piece_of_full = np.arange(len(full_of)) - np.repeat(np.cumsum(full) - full, full) + 1
    bins = Bins(capacity)
    bins.made = len(full_of)
    at = np.flatnonzero((rest > 0) | (sizes == 0))
    at = at[np.argsort(-rest[at], kind="stable")]
    to_come = np.cumsum(rest[at][::-1])[::-1]
    where = [bins.place(int(rest[i]), int(left)) if rest[i] else -1 for i, left in zip(at, to_come, strict=True)]
    item = np.concatenate([full_of, at])
    piece = np.concatenate([piece_of_full, full[at] + 1])
    tokens = np.concatenate([np.full(len(full_of), capacity), rest[at]])
    box = np.concatenate([np.arange(len(full_of)), np.array(where, dtype=np.int64)])
    box[box < 0] = 0  # an empty text takes no room
    return item, piece, tokens, box.astype(np.int64)


def pack(items: DataFrame, item_id: str, size: str, capacities: DataFrame, capacity_id: str, capacity: str, shard: int = SHARD) -> DataFrame:
    """(capacity, shard, container, item, piece, tokens) of every piece for every capacity.

    (shard, container) names a container. Null sizes and ids are left out, as are
    capacities below 1; equal ids are packed each; an empty item takes no room in the
    shard's first container; an empty table gives no container.
    """
    rows = cut(items.select(F.col(item_id).alias("_id"), F.col(size).cast("bigint").alias("_n")).where("_id is not null and _n is not null"))
    shards = max(1, -(-rows.count() // shard))
    caps = capacities.select(F.col(capacity_id).alias("_cid"), F.col(capacity).cast("bigint").alias("_cap")).where("_cap >= 1")
    kinds = dict(rows.dtypes) | dict(caps.dtypes)
    wanted = caps.agg(F.collect_list(F.struct("_cid", "_cap")).alias("w")).first()["w"]  # container sizes are a short stated list

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_id", kind="stable")
        item, piece, tokens, box = pack_shard(p["_n"].to_numpy(), int(p["_cap"].iloc[0]))
        return pd.DataFrame({"_cid": p["_cid"].iloc[0], "shard": p["shard"].iloc[0], "container": box, "_id": p["_id"].to_numpy()[item], "piece": piece, "tokens": tokens})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    each = F.array(*(F.struct(F.lit(w["_cid"]).cast(kinds["_cid"]).alias("_cid"), F.lit(w["_cap"]).alias("_cap")) for w in wanted))
    sharded = sharded.withColumn("_w", F.explode(each)).select("_id", "_n", "shard", "_w.*") if wanted else sharded.withColumns({"_cid": F.lit(None), "_cap": F.lit(0)}).limit(0)
    out = sharded.repartition(shards * 3, "_cid", "shard").groupBy("_cid", "shard").applyInPandas(one, f"_cid {kinds['_cid']}, shard int, container bigint, _id {kinds['_id']}, piece bigint, tokens bigint")
    return out.withColumnsRenamed({"_cid": capacity_id, "_id": item_id})
