"""Document trees: hierarchy, paths, budgets, links, citations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolith.runtime import cut


def hierarchy(nodes: DataFrame, by: str, sequence: str, depth: str) -> DataFrame:
    """Adds `parent`: the sequence of the last earlier node of smaller depth; null for roots. Exact where no level is
    skipped. One window with a small map of the last node of each depth: no join.
    """
    deepest = max(2, nodes.agg(F.max(depth)).first()[0] or 0)
    w = Window.partitionBy(by).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(depth) == d, F.col(sequence)), True).over(w) for d in range(1, deepest)]
    parent = F.array_max(F.filter(F.array(*(F.when(F.col(depth) > d, x) for d, x in enumerate(last, 1))), lambda x: x.isNotNull()))
    return nodes.withColumn("parent", parent)


def hierarchy_by_stack(nodes: DataFrame, by: str, sequence: str, depth: str) -> DataFrame:
    """Rows (by, sequence, parent) by a stack whose length, not the members' depth, decides: after a skipped level a later
    sibling of equal depth hangs below its sibling. A missing parent is null with depth above 1. A fold over sorted batches.
    """
    rows = nodes.select(by, sequence, depth).repartition(by).sortWithinPartitions(by, sequence)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = object(), []
        for part in parts:
            parents = []
            for group, seq, deep in zip(part[by].tolist(), part[sequence].tolist(), part[depth].tolist(), strict=True):
                if group != at:
                    at, stack = group, []
                while len(stack) >= deep:
                    stack.pop()
                parents.append(stack[-1] if stack and deep > 1 else None)
                stack.append(seq)
            yield pd.DataFrame({by: part[by], sequence: part[sequence], "parent": pd.array(parents, dtype="Int64")})

    types = {c: nodes.schema[c].dataType.simpleString() for c in (by, sequence)}
    return rows.mapInPandas(fold, f"{by} {types[by]}, {sequence} {types[sequence]}, parent bigint")


def paths(nodes: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """Rows (node, depth, path): names from the root, siblings with equal names (but for case) numbered `__NN` from the
    second on. Level by level until none is left: one join per level of the tree, none per node. Nodes on a cycle have
    no root and give no row.
    """
    sibling = Window.partitionBy(parent, F.lower(name)).orderBy(node)
    named = cut(nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"), F.col(name).alias("s"), F.row_number().over(sibling).alias("k")).withColumn("s", F.when(F.col("k") > 1, F.concat("s", F.lit("__"), F.format_string("%02d", "k"))).otherwise(F.col("s"))))
    level = named.where("p is null").select("n", F.lit(1).alias("depth"), F.col("s").alias("path"))
    done = level
    for d in count(2):
        level = cut(named.join(level.select(F.col("n").alias("p"), F.col("path").alias("up")), "p").select("n", F.lit(d).alias("depth"), F.concat("up", F.lit("/"), "s").alias("path")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done.select(F.col("n").alias(node), "depth", "path")


def budgets(nodes: DataFrame, node: str, parent: str, least: str) -> DataFrame:
    """Rows (node, budget): signs that the longest path below a node needs at least: of its children the largest of one
    separator, the child's least name and the child's own budget; leaves need none. Bottom-up, one join per level until
    none is left; parents on a cycle are an error.
    """
    rows = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"), F.col(least).alias("w"))
    level = cut(rows.select("n", "p", F.col("w").cast("bigint").alias("need")))
    done = rows.select("n", F.lit(0).cast("bigint").alias("budget"))
    inner = rows.where("p is not null").select("p").distinct().count()
    for d in count():
        up = level.where("p is not null").groupBy("p").agg(F.max(F.col("need") + 1).alias("budget"))
        if up.isEmpty():
            break
        if d > inner:
            raise ValueError("nodes whose parents form a cycle")
        done = done.unionByName(up.select(F.col("p").alias("n"), "budget"))
        level = cut(rows.join(up.withColumnRenamed("p", "n"), "n").select("n", "p", (F.col("w") + F.col("budget")).alias("need")))
    return done.groupBy("n").agg(F.max("budget").alias("budget")).select(F.col("n").alias(node), "budget")


#: Notations of citations. After `Ref.`, and lists of small numbers in parentheses.
AFTER_WORD = r"(?i)\bRefs?\.?\s*((?:[0-9]{1,2}(?:\s*(?:,|and|&|-|–)\s*)?)+)"
IN_PARENTHESES = r"\(\s*([0-9]{1,2}(?:\s*,\s*[0-9]{1,2})*)\s*\)"


def citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, number, n): reference numbers 1 to 99 cited in a text, with occurrences by either notation."""
    found = F.concat(F.regexp_extract_all(text, F.lit(AFTER_WORD), F.lit(1)), F.regexp_extract_all(text, F.lit(IN_PARENTHESES), F.lit(1)))
    numbers = texts.select(key, F.explode(F.flatten(F.transform(found, lambda x: F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1))))).alias("digits"))
    numbers = numbers.select(key, F.col("digits").try_cast("int").alias("number"))
    return numbers.where(F.col("number").between(1, 99)).groupBy(key, "number").agg(F.count("*").alias("n"))


def stable_path(segment: Column, up: Column) -> Column:
    """Path of a node below its parent's; the segment alone at the root."""
    return F.concat_ws("/", up, segment)
