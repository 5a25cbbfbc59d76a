"""Differences between two copies of a keyed dataset, by shared ordinals and presence bitmaps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolith.runtime import trimmed

#: Ordinals per container, and members from which a container is a bitmap instead of a sorted array.
CONTAINER, DENSE = 1 << 16, 1 << 12


class PresenceBitmap:
    """Compressed set of ordinals: containers of 2**16, each a sorted uint16 array or a packed bitmap."""

    def __init__(self, ordinals: np.ndarray | None = None) -> None:
        self.parts: dict[int, np.ndarray] = {}
        if ordinals is not None and len(ordinals):
            high = ordinals >> 16
            cuts = np.flatnonzero(np.diff(high)) + 1
            for part in np.split(ordinals, cuts):
                self._put(int(part[0] >> 16), (part & 0xFFFF).astype(np.uint16))

    def _put(self, high: int, low: np.ndarray) -> None:
        if len(low) >= DENSE:
            bits = np.zeros(CONTAINER, bool)
            bits[low] = True
            self.parts[high] = np.packbits(bits)
        elif len(low):
            self.parts[high] = low

    @staticmethod
    def _bits(part: np.ndarray | None) -> np.ndarray:
        if part is None:
            return np.zeros(CONTAINER // 8, np.uint8)
        if part.dtype == np.uint8:
            return part
        bits = np.zeros(CONTAINER, bool)
        bits[part] = True
        return np.packbits(bits)

    def _combine(self, other: PresenceBitmap, keep: bool) -> PresenceBitmap:
        out = PresenceBitmap()
        for high, part in self.parts.items():
            theirs = other.parts.get(high)
            if theirs is None and keep:
                continue
            if part.dtype == np.uint16 and (theirs is None or theirs.dtype == np.uint16):
                low = part if theirs is None else part[np.isin(part, theirs, assume_unique=True) == keep]
            else:
                b = self._bits(theirs)
                low = np.flatnonzero(np.unpackbits(self._bits(part) & (b if keep else ~b))).astype(np.uint16)
            out._put(high, low)
        return out

    def __and__(self, other: PresenceBitmap) -> PresenceBitmap:
        return self._combine(other, True)

    def __sub__(self, other: PresenceBitmap) -> PresenceBitmap:
        """AND-NOT."""
        return self._combine(other, False)

    def ordinals(self) -> np.ndarray:
        """Members in order."""
        out = [(np.int64(h) << 16) + (np.flatnonzero(np.unpackbits(p)) if p.dtype == np.uint8 else p).astype(np.int64) for h, p in sorted(self.parts.items())]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def same_text(text: Column) -> Column:
    """Form in which texts compare: without surrounding white space; null stays null."""
    return trimmed(text)


def same_pages(pages: Column) -> Column:
    """Form in which page lists compare: the distinct pages in order; null is the empty list, null elements don't count."""
    known = F.filter(F.coalesce(pages, F.array().cast("array<int>")), lambda x: x.isNotNull())
    return F.array_join(F.array_sort(F.array_distinct(known)), ",")


def differences(left: DataFrame, right: DataFrame, key: Column, order: Mapping[str, list[str]], fields: Mapping[str, Column], missing: tuple[str, str], name: str = "candidate_id") -> DataFrame:
    """Rows (name, difference): keys missing on either side, and for common keys each field whose form differs.

    `missing` names the difference of keys only on the left and only on the right. `order` has, for "left" and "right",
    the columns whose highest values choose the counting row of a key (so ties are settled by the later ones); `fields`
    gives the form of each field as a Column valid on both sides. Null keys are left out. Null equals only null. Repeated
    rows collapse; an empty side makes every key of the other one missing; further columns are ignored.

    One shuffle: map-side max_by keeps a row per key and side before it, so a key holding a third of all rows costs one
    row per task. The rows of either side then stand on their own in the partition sorted by key. Each key gets the next
    ordinal of the partition; from the ordinals of a side's rows comes its presence bitmap. AND-NOT of the bitmaps gives
    the missing keys, and their intersection picks the rows of both sides that are compared column by column. A container
    of ordinals at a time bounds the memory.
    """
    names = list(fields)

    def side(df: DataFrame, which: str) -> DataFrame:
        return df.select(key.alias(name), F.lit(which).alias("side"), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order[which]))).alias("rank"), F.struct(*(form.cast("string").alias(n) for n, form in fields.items())).alias("row")).where(F.col(name).isNotNull())

    both = side(left, "left").unionByName(side(right, "right"))
    newest = {s: F.expr(f"max_by(row, rank) FILTER (WHERE side = '{s}')").alias(s) for s in ("left", "right")}
    sides = F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), F.struct(F.lit(s == "left").alias("is_left"), f"{s}.*")) for s in ("left", "right"))))
    rows = both.groupBy(name).agg(*newest.values()).select(name, F.inline(sides)).sortWithinPartitions(name)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _containers(batches):
            keys, is_left = part.column(0), np.asarray(part.column(1))
            opens = np.append(True, np.asarray(pc.not_equal(keys[1:], keys[:-1])))
            ordinal, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
            mine, theirs = PresenceBitmap(ordinal[is_left]), PresenceBitmap(ordinal[~is_left])
            common = (mine & theirs).ordinals()
            at = [pa.array(np.flatnonzero(mask)[np.searchsorted(ordinal[mask], common)]) for mask in (is_left, ~is_left)]
            found = [((mine - theirs).ordinals(), missing[0]), ((theirs - mine).ordinals(), missing[1])]
            for i, n in enumerate(names, 2):
                x, y = (part.column(i).take(a) for a in at)
                equal = pc.if_else(pc.and_(x.is_valid(), y.is_valid()), pc.fill_null(pc.equal(x, y), False), pc.and_(x.is_null(), y.is_null()))
                found.append((common[~np.asarray(equal)], n))
            ordinals = np.concatenate([f[0] for f in found])
            kind = np.repeat(np.array([f[1] for f in found], object), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(first[ordinals])), pa.array(kind, pa.string())], [name, "difference"])

    return rows.mapInArrow(compare, f"{name} string, difference string")


def _containers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column in parts of about CONTAINER rows; the rows of a key (two at most) stay together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= CONTAINER:
            rows = joined()
            keys = rows.column(0)
            cut = rows.num_rows - 1
            while cut and keys[cut - 1] == keys[cut]:
                cut -= 1
            if cut:
                yield rows.slice(0, cut)
            held, size = [rows.slice(cut)], rows.num_rows - cut
    if held:
        yield joined()
