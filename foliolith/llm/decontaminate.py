"""Passages of evaluation items inside training documents.

Overlapping segments of the items form a BM25 index with block maxima; every passage of every document is a query against
it, searched document at a time with a moving pivot. Each segment has its own threshold: the smallest BM25 score that a
passage holding any of its runs of N_WORDS words can have. Weights are divided by it, so one threshold serves all and no
leak can be missed: every run lies inside a segment, and every N_WORDS words of a document inside a passage. Words outside
of runs of N_WORDS words that occur in items at all are no part of a query. What is retrieved is then verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolith.llm.blockmax import BlockMaxIndex
from foliolith.llm.fold import GLUE, _WORD, reader_text, words

#: Words in a row that make a leak; words of a passage and of a segment (they overlap by N_WORDS - 1).
N_WORDS, PASSAGE = 12, 24
STRIDE = PASSAGE - N_WORDS + 1
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Evaluation items of one index, on average; more items make more indexes, each with a scan of its own.
ITEMS = 50_000
_GLUE = dict.fromkeys(map(ord, GLUE))


class EvaluationIndex:
    """Items with their BM25 block-max index and the runs of words to verify."""

    def __init__(self, items: list[tuple[int, str]], n_words: int = N_WORDS) -> None:
        by_words: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in items:
            found = tuple(_WORD.findall(reader_text(text or "").translate(_GLUE)))
            if len(found) >= n_words:
                by_words.setdefault(found, []).append(item_id)
        units: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
        for w in sorted(by_words):
            units += [(w, w[at : at + PASSAGE]) for at in range(0, len(w) - n_words + 1, STRIDE)]
        self.ids = [sorted(by_words[w]) for w, _ in units]
        self.runs = [sorted({"".join(u[i : i + n_words]) for i in range(len(u) - n_words + 1)}) for _, u in units]
        self.terms: dict[str, int] = {}
        tf: list[dict[int, int]] = []
        for _, u in units:
            counts: dict[int, int] = {}
            for x in u:
                t = self.terms.setdefault(x, len(self.terms))
                counts[t] = counts.get(t, 0) + 1
            tf.append(counts)
        n = len(units)
        df = np.zeros(len(self.terms))
        for counts in tf:
            df[list(counts)] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = sum(len(u) for _, u in units) / max(n, 1)
        term, item, weight = [], [], []
        for i, ((_, u), counts) in enumerate(zip(units, tf, strict=True)):
            scale = K1 * (1 - B + B * len(u) / mean)
            score = {t: idf[t] * c * (K1 + 1) / (c + scale) for t, c in counts.items()}
            own = [self.terms[x] for x in u]
            least = min(sum(score[t] for t in set(own[k : k + n_words])) for k in range(len(own) - n_words + 1))
            for t, x in score.items():
                term.append(t)
                item.append(i)
                weight.append(x / least)
        self.index = BlockMaxIndex(np.array(term, np.int64), np.array(item, np.int64), np.array(weight), max(len(self.terms), 1), n)

    def leaks(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pairs (position of text, item id), each once."""
        spelled: list[list[str]] = []
        broken: list[dict[int, list[str]]] = []
        ids: list[int] = []
        extra_at, extra_id = [], []
        lengths: list[tuple[int, int]] = []
        sizes = np.zeros(len(texts), np.int64)
        get = self.terms.get
        for k, text in enumerate(texts):
            found, parts = words(reader_text(text)) if text else ([], [])
            for at, some in parts:
                for x in some:
                    if x in self.terms:
                        extra_at.append(len(ids) + at)
                        extra_id.append(self.terms[x])
                lengths.append((len(ids) + at, len(some)))
            ids.extend([get(x, -1) for x in found])
            sizes[k] = len(found)
            spelled.append(found)
            broken.append(dict(parts))
        if not ids or not self.ids:
            return [], []
        # Word j of a text stands in the passages j // STRIDE and, near their start, the one before.
        begin = np.cumsum(sizes) - sizes
        passages = np.maximum(1, -(-(sizes - N_WORDS + 1) // STRIDE)) * (sizes > 0)
        first = np.cumsum(passages) - passages
        at = np.concatenate([np.arange(len(ids)), np.array(extra_at, np.int64)])
        term = np.concatenate([np.array(ids, np.int64), np.array(extra_id, np.int64)])
        keep = (term >= 0) & self._in_runs(at, term, begin, sizes, lengths)[at]
        at, term = at[keep], term[keep]
        of = np.repeat(np.arange(len(texts)), sizes)[at]
        own, rest = np.divmod(at - begin[of], STRIDE)
        in_own, in_last = own < passages[of], (rest < N_WORDS - 1) & (own > 0)
        owner = np.concatenate([(first[of] + own)[in_own], (first[of] + own - 1)[in_last]])
        term = np.concatenate([term[in_own], term[in_last]])
        order = np.argsort(owner, kind="stable")
        query, unit, _ = self.index.pivots(owner[order], term[order], None, int(passages.sum()), 1.0)
        texts_out, ids_out = [], []
        which = np.repeat(np.arange(len(texts)), passages)[query]
        seen: set[tuple[int, int]] = set()
        for k, p, u in zip(which.tolist(), (query - first[which]).tolist(), unit.tolist(), strict=True):
            if (k, self.ids[u][0]) not in seen and self._verified(spelled[k], broken[k], p * STRIDE, u):
                seen.add((k, self.ids[u][0]))
                for item_id in self.ids[u]:
                    texts_out.append(k)
                    ids_out.append(item_id)
        return texts_out, ids_out

    @staticmethod
    def _in_runs(at: np.ndarray, term: np.ndarray, begin: np.ndarray, sizes: np.ndarray, lengths: list[tuple[int, int]]) -> np.ndarray:
        """Mask of the words in runs of at least N_WORDS words that occur in items at all: no leak lies outside of them.
        `lengths` has the words that are read whole or in parts, with the number of parts.
        """
        n = int(sizes.sum())
        known, size = np.zeros(n, bool), np.ones(n, np.int64)
        known[at[term >= 0]] = True
        for k, parts in lengths:
            size[k] = max(1, parts)
        opens = np.zeros(n, bool)
        opens[begin[sizes > 0]] = True
        opens[1:] |= known[1:] != known[:-1]
        run = np.cumsum(opens) - 1
        return known & (np.bincount(run, size) >= N_WORDS)[run]

    def _verified(self, spelled: list[str], broken: dict[int, list[str]], at: int, unit: int) -> bool:
        """Whether a run of the segment's words stands between borders of words of the passage that begins at `at`."""
        some = spelled[at : at + PASSAGE]
        stream = "".join(some)
        borders: set[int] | None = None
        for run in self.runs[unit]:
            found = stream.find(run)
            while found >= 0:
                if borders is None:
                    borders, size = {0}, 0
                    for k, word in enumerate(some, at):
                        for part in broken.get(k, (word,)):
                            size += len(part)
                            borders.add(size)
                if found in borders and found + len(run) in borders:
                    return True
                found = stream.find(run, found + 1)
        return False


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """Rows (key, item_key): documents holding at least N_WORDS consecutive words of an item, each pair once per row.

    Null, empty and short texts and items give none; items issued twice are found under each id; a repeated document row
    gives its rows again. Words are compared without case, punctuation, markup, line ends, invisible signs and look-alikes;
    a word broken by a wrap or a tag counts as whole. The items are broadcast, ITEMS at a time by a hash of their ids; for
    each such part of the items the documents are scanned once, whole, without a shuffle.
    """
    held = items.select(item_key, text).where(f"{item_key} is not null")
    parts = max(1, -(-held.count() // ITEMS))
    found = [_leaks_of(documents, held.where(F.pmod(F.xxhash64(item_key), F.lit(parts)) == k), key, text, item_key) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _leaks_of(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(EvaluationIndex([(r[0], r[1]) for r in items.collect()]))
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}"
    id_type = pa.int64() if items.schema[item_key].dataType.simpleString() == "bigint" else None

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                where, ids = index.leaks(part.column(1).to_pylist())
                if where:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where)), pa.array(ids, id_type)], [key, item_key])

    return documents.select(key, text).mapInArrow(scan, schema)
