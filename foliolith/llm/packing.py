"""Filling containers of fixed capacity in several dimensions, with certified bounds.

Items of a group are dealt to partitions of bounded size. Each partition is packed by best-fit decreasing, and
dual-feasible functions give a lower bound of its containers. Where a partition needs more than its bound, the items of
its containers with room go to a common pool of the group, are dealt anew and packed again; a new packing is kept only
if it needs fewer containers. Rounds go on until one saves nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolith.runtime import cut

#: Items packed together at most (on average, by hash); share of a container that counts as room.
PART_ITEMS, ROOM = 3_000, 0.02
#: Values of k tried in the family of rounding dual-feasible functions.
DUAL_K = range(1, 13)


def lower_bound(sizes: np.ndarray, capacity: Sequence[int]) -> int:
    """Containers that any packing needs: the best dual-feasible bound over dimensions (sizes: items x dimensions)."""
    best = 1 if len(sizes) else 0
    for d, c in enumerate(capacity):
        count = np.bincount(np.minimum(sizes[:, d], c).astype(np.int64), minlength=c + 1).astype(np.float64)
        best = max(best, bound_of_counts(count, c))
    return best


def bound_of_counts(count: np.ndarray, c: int) -> int:
    """As `lower_bound` in one dimension, from the number of items of each size 0..c."""
    x = np.arange(c + 1)
    best = count @ (x / c)
    for cut in range(1, c // 2 + 1):
        best = max(best, count @ np.where(x > c - cut, 1.0, np.where(x >= cut, x / c, 0.0)))
    for k in DUAL_K:
        scaled = (k + 1) * x
        best = max(best, count @ np.where(scaled % c == 0, x / c, scaled // c / k))
    return int(np.ceil(best - 1e-9))


def best_fit(sizes: np.ndarray, capacity: Sequence[int], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item and load of each container: items in `order`, each where least room stays."""
    cap = np.asarray(capacity, np.int64)
    load = np.zeros((max(len(sizes), 1), len(cap)), np.int64)
    of = np.zeros(len(sizes), np.int64)
    low = used = 0
    for i in order:
        size = sizes[i]
        after = load[low:used] + size
        fits = (after <= cap).all(axis=1)
        if fits.any():
            fill = np.where(fits, (after / cap).sum(axis=1), -1.0)
            at = low + int(fill.argmax())
        else:
            at = used
            used += 1
        load[at] += size
        of[i] = at
        while low < used and (load[low] >= cap).any():  # full ones at the front are not looked at again
            low += 1
    return of, load[:used]


def pack(sizes: np.ndarray, capacity: Sequence[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Best of several best-fit decreasing packings, stopping at the certified bound: containers, loads, bound."""
    bound = lower_bound(sizes, capacity)
    share = sizes / np.asarray(capacity, float)
    best: tuple[np.ndarray, np.ndarray] | None = None
    total = np.maximum(share.sum(axis=0), 1e-9)
    for key in (share.max(axis=1), share.sum(axis=1), (share * total).sum(axis=1), share[:, 0], (share**2 * total).sum(axis=1)):
        found = best_fit(sizes, capacity, np.argsort(-key, kind="stable"))
        if best is None or len(found[1]) < len(best[1]):
            best = found
        if len(best[1]) <= bound:
            break
    assert best is not None
    return best[0], best[1], bound


def _deal(items: DataFrame, group: str, turn: int) -> DataFrame:
    """A partition number for each item: as many per group as its size asks for, so that a large group is split."""
    counts = items.groupBy(group).agg(F.count("*").alias("in_group"))
    parts = F.ceil(F.col("in_group") / F.lit(PART_ITEMS)).cast("int")
    joined = items.join(counts.withColumnRenamed(group, "grp2"), F.col(group).eqNullSafe(F.col("grp2"))).drop("grp2")
    return joined.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), F.col("item"), F.col("piece")), parts).cast("int")).drop("in_group")


def packed(items: DataFrame, group: str, dims: Sequence[str], capacity: Sequence[int], most: int) -> DataFrame:
    """Rows (group, item, piece, pieces, dims..., batch): every item in a container of its group.

    `items` has `item` (unique), the group and integer dims; null or negative dims count as 0. At most `most` pieces share
    a container. An item that alone exceeds the capacity is split into as few pieces as needed, of even size; no other is.
    Null groups are a group of their own. An empty input gives an empty result.
    """
    clean = [F.greatest(F.coalesce(F.col(d), F.lit(0)), F.lit(0)).cast("bigint").alias(d) for d in dims]
    rows = items.select(group, "item", *clean)
    pieces = F.greatest(F.lit(1), *(F.ceil(F.col(d) / F.lit(c)) for d, c in zip(dims, capacity, strict=True))).cast("int")
    rows = rows.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    share = [(F.floor(F.col(d) * F.col("piece") / F.col("pieces")) - F.floor(F.col(d) * (F.col("piece") - 1) / F.col("pieces"))).cast("bigint").alias(d) for d in dims]
    rows = rows.select(group, "item", "piece", "pieces", *share).withColumn("batch", F.lit(None).cast("string"))
    names = [group, "item", "piece", "pieces", *dims, "batch"]
    schema = f"{group} {items.schema[group].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, piece int, pieces int, " + ", ".join(f"{d} bigint" for d in dims) + ", batch string, again boolean"
    caps = [*capacity, most]

    def repack(turn: int):  # noqa: ANN202
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
            sizes = np.column_stack([*(part[d].to_numpy(np.int64) for d in dims), np.ones(len(part), np.int64)])
            of, load, bound = pack(sizes, caps)
            if turn and len(load) >= part["batch"].nunique():
                return part[names].assign(again=False)
            room = (load / np.asarray(caps, float)).max(axis=1) < 1 - ROOM
            label = f"{turn}-{int(part['part'].iloc[0])}-"
            return part[names].assign(batch=[f"{label}{b}" for b in of], again=room[of] & (len(load) > bound))

        return run

    done: DataFrame | None = None
    left: int | None = None
    for turn in count():
        now = cut(_deal(rows, group, turn).groupBy(group, "part").applyInPandas(repack(turn), schema))
        used, open_ = now.agg(F.countDistinct(F.struct(F.coalesce(group, F.lit("")), "batch")), F.count_if("again")).first()
        last = not open_ or (left is not None and used >= left)
        kept = now.where("not again") if not last else now if left is None or used < left else rows
        done = kept.select(*names) if done is None else done.unionByName(kept.select(*names))
        if last:
            return done
        rows = now.where("again").drop("again")
        left = rows.agg(F.countDistinct(F.struct(F.coalesce(group, F.lit("")), "batch"))).first()[0]


def counting_rows(queue: DataFrame) -> DataFrame:
    """Per candidate the row of the highest base_revision (then the latest queued, then the highest queue_id); a row
    without candidate_id stands for itself.
    """
    item = F.coalesce(F.col("candidate_id"), F.concat(F.lit("\x00"), F.col("queue_id").cast("string")))
    rows = queue.select(item.alias("item"), "candidate_id", "run_id", "weight", "cell_count", F.coalesce(F.size("source_physical_pages"), F.lit(0)).alias("pages"), F.struct("base_revision", "queued_at", "queue_id").alias("rank"))
    rows = rows.withColumn("pages", F.greatest("pages", F.lit(0)))
    return rows.groupBy("item").agg(F.max_by(F.struct("candidate_id", "run_id", "weight", "cell_count", "pages"), "rank").alias("r")).select("item", "r.*")


#: Capacity of a review batch: weight, cells, pages; and candidates.
REVIEW_CAPACITY, REVIEW_MOST = (9, 500, 20), 10


def review_batches(queue: DataFrame) -> DataFrame:
    """Rows (run_id, batch, candidate_id, piece, pieces, weight, cell_count, pages) of the queued candidates."""
    rows = packed(counting_rows(queue), "run_id", ("weight", "cell_count", "pages"), REVIEW_CAPACITY, REVIEW_MOST)
    known = F.when(~F.startswith(F.col("item"), F.lit("\x00")), F.col("item"))
    return rows.select("run_id", F.concat_ws("/", F.coalesce("run_id", F.lit("")), "batch").alias("batch"), known.alias("candidate_id"), "piece", "pieces", "weight", "cell_count", "pages")


def certificates(batches: DataFrame) -> DataFrame:
    """Rows (run_id, batches, lower_bound): containers used and the least that any packing of the run could use."""
    dims, caps = ("weight", "cell_count", "pages"), REVIEW_CAPACITY
    sizes = batches.select("run_id", F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.least(F.col(d), F.lit(c)).alias("size")) for i, (d, c) in enumerate(zip(dims, caps, strict=True))))).alias("s"))
    counts = sizes.groupBy("run_id", "s.dim", "s.size").agg(F.count("*").alias("n"))

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        best = int(np.ceil(part.loc[part["dim"] == 0, "n"].sum() / REVIEW_MOST))
        for d, c in enumerate(caps):
            own = part[part["dim"] == d]
            best = max(best, bound_of_counts(np.bincount(own["size"].to_numpy(np.int64), own["n"].to_numpy(float), c + 1), c))
        return pd.DataFrame({"run_id": part["run_id"].iloc[:1], "lower_bound": [best]})

    bounds = counts.groupBy("run_id").applyInPandas(bound, "run_id string, lower_bound bigint")
    used = batches.select("run_id", "batch").distinct().groupBy("run_id").agg(F.count("*").alias("batches"))
    return used.join(bounds.withColumnRenamed("run_id", "r"), F.col("run_id").eqNullSafe(F.col("r"))).select("run_id", "batches", "lower_bound")


def oversize(batches: DataFrame) -> DataFrame:
    """candidate_id of the candidates that had to be split."""
    return batches.where("pieces > 1 and candidate_id is not null").select("candidate_id").distinct()
