"""Inverted index with block maxima: exact retrieval of every item at or above a threshold.

Postings of a term are sorted by item and cut into blocks at multiples of BLOCK items, so that blocks of different terms
cover the same items. A block has its largest weight; inside it items are one-byte offsets. For blocks without postings
there is a bit at most, and none if they are many: the memory is linear in the postings. No score can exceed its bounds, so
nothing is missed.

`pivots` moves document at a time (block-max WAND), `blocks` block at a time (block-max MaxScore); both take many queries
at once, one numpy operation for all.
"""

from __future__ import annotations

import numpy as np

#: Items that a block covers; term pointers that move in step; block bounds worked on at once.
BLOCK, POINTERS, CELLS = 16, 400_000, 500_000
#: Most keys that there could be for one that there is, for bits to find them by.
SPARSE = 48
#: Slack of single-precision sums.
SLACK = 1e-4

Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges that begin at `begin` and have `size` members: the range of each member, and the member."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]


def _joined(out: list[Hits]) -> Hits:
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32)
    query, item, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((item, query))
    return query[order], item[order], score[order]


class BlockMaxIndex:
    """Index of weights (term, item), each pair once. Items should be ordered so that similar ones are neighbours."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, weights: np.ndarray, n_terms: int, n_items: int) -> None:
        self.n_terms, self.n_items = n_terms, n_items
        self.n_blocks = -(-n_items // BLOCK) + 1
        order = np.lexsort((items, terms))
        terms, items, weights = terms[order].astype(np.int64), items[order].astype(np.int64), weights[order].astype(np.float32)
        key = terms * self.n_blocks + items // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        #: Term and place of each block, its first posting, its largest weight.
        self.key = key[first]
        self.begin = np.append(first, len(key)).astype(np.int64)
        self.top = np.maximum.reduceat(weights, first) if len(key) else np.zeros(0, np.float32)
        self.offset = (items % BLOCK).astype(np.uint8)
        self.weight = weights
        self.block_of = np.searchsorted(self.key, np.arange(n_terms + 1) * self.n_blocks)
        self.term_top = np.zeros(max(n_terms, 1), np.float32)
        np.maximum.at(self.term_top, terms, weights)
        #: Bits of the keys that there are, and the blocks before each word of bits; none if they were more than linear in the blocks.
        self.bits = self.rank = None
        if n_terms * self.n_blocks <= SPARSE * len(self.key):
            self.bits = np.zeros(n_terms * self.n_blocks // 64 + 1, np.uint64)
            np.bitwise_or.at(self.bits, self.key >> 6, np.uint64(1) << (self.key & 63).astype(np.uint64))
            count = np.bitwise_count(self.bits)
            self.rank = (np.cumsum(count, dtype=np.int64) - count).astype(np.int32)

    def nbytes(self) -> int:
        """Memory of the index."""
        return sum(x.nbytes for x in (self.key, self.begin, self.top, self.offset, self.weight, self.block_of, self.term_top, self.bits, self.rank) if x is not None)

    def _queries(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray | None, n_queries: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the queries that their largest weights can lift to the threshold, each once per query."""
        most = self.term_top[term] if weight is None else self.term_top[term] * weight
        alive = np.bincount(owner, most, n_queries) >= threshold * (1 - SLACK)
        mine = np.flatnonzero(alive[owner] & (self.term_top[term] > 0))
        mine = mine[np.unique(owner[mine].astype(np.int64) * self.n_terms + term[mine], return_index=True)[1]]
        return owner[mine], term[mine].astype(np.int64), np.ones(len(mine), np.float32) if weight is None else weight[mine].astype(np.float32)

    def _found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of some keys, and which there are."""
        if self.bits is not None:
            bits, bit = self.bits[key >> 6], np.uint64(1) << (key & 63).astype(np.uint64)
            at = self.rank[key >> 6] + np.bitwise_count(bits & (bit - np.uint64(1)))
            return np.minimum(at, len(self.key) - 1), (bits & bit) != 0
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def blocks(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray | None, n_queries: int, threshold: float) -> Hits:
        """All (query, item, score) with score >= threshold, block at a time.

        The longest lists of a query that together can't reach the threshold only add to what the others find. The block
        maxima of the others are added up; blocks that can't reach the threshold, first with the largest, then with their
        own weights of the long lists, are never opened.
        """
        own, term, weight = self._queries(owner, term, weight, n_queries, threshold)
        least = threshold * (1 - SLACK)
        length = self.block_of[term + 1] - self.block_of[term]
        most = self.term_top[term] * weight
        order = np.lexsort((-length, own))
        own, term, weight, length, most = (x[order] for x in (own, term, weight, length, most))
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(begins, append=len(own))
        total = np.cumsum(most.astype(np.float64))
        aside = total - np.repeat(np.append(0, total)[begins], size) < least
        rest = np.bincount(np.repeat(np.arange(len(begins)), size), np.where(aside, most, 0), len(begins))
        cost = np.cumsum(np.bincount(np.repeat(np.arange(len(begins)), size), np.where(aside, 0, length), len(begins)))
        out: list[Hits] = []
        at = 0
        while at < len(begins):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CELLS, "right")))
            part = slice(begins[at], begins[stop] if stop < len(begins) else len(own))
            out.append(self._open(own[begins[at:stop]], size[at:stop], term[part], weight[part], aside[part], rest[at:stop], least))
            at = stop
        return _joined(out)

    def _open(self, query: np.ndarray, size: np.ndarray, term: np.ndarray, weight: np.ndarray, aside: np.ndarray, rest: np.ndarray, least: float) -> Hits:
        row = np.repeat(np.arange(len(query)), size)
        lead = np.flatnonzero(~aside)
        which, block = _spread(self.block_of[term[lead]], self.block_of[term[lead] + 1] - self.block_of[term[lead]])
        entry = lead[which]
        place = self.key[block] - term[entry] * self.n_blocks
        pair, at = np.unique(row[entry] * self.n_blocks + place, return_inverse=True)
        bound = np.bincount(at, self.top[block] * weight[entry], len(pair))
        pair, bound = self._left(pair, bound, bound + rest[pair // self.n_blocks] >= least)
        # Long lists with their own block maxima.
        begins = np.cumsum(size) - size
        n_aside = np.bincount(row, aside, len(query)).astype(np.int64)
        which, entry = _spread(begins[pair // self.n_blocks], n_aside[pair // self.n_blocks])
        block, there = self._found(term[entry] * self.n_blocks + (pair % self.n_blocks)[which])
        bound = bound + np.bincount(which, np.where(there, self.top[block] * weight[entry], 0), len(pair))
        pair, _ = self._left(pair, bound, bound >= least)
        # Opened.
        which, entry = _spread(begins[pair // self.n_blocks], size[pair // self.n_blocks])
        block, there = self._found(term[entry] * self.n_blocks + (pair % self.n_blocks)[which])
        which, entry, block = which[there], entry[there], block[there]
        n, posting = _spread(self.begin[block], self.begin[block + 1] - self.begin[block])
        score = np.bincount(which[n] * BLOCK + self.offset[posting], self.weight[posting] * weight[entry][n], len(pair) * BLOCK)
        hit = np.flatnonzero(score >= least)
        opened = pair[hit // BLOCK]
        return query[opened // self.n_blocks], (opened % self.n_blocks) * BLOCK + hit % BLOCK, score[hit].astype(np.float32)

    @staticmethod
    def _left(pair: np.ndarray, bound: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pair[keep], bound[keep]

    def nearest(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int, threshold: float, most: int) -> Hits:
        """The `most` best items of each query among those with score >= threshold, of equal scores the first items.

        The threshold is let down in steps: a query with enough items at a higher one needs no other.
        """
        out: list[Hits] = []
        steps = [x for x in (0.8, 0.6) if x > threshold] + [threshold]
        for step in steps:
            query, item, score = self.blocks(owner, term, weight, n_queries, step)
            enough = (np.bincount(query, minlength=n_queries) >= most) | (step == threshold)
            mine = enough[query]
            query, item, score = query[mine], item[mine], score[mine]
            order = np.lexsort((item, -score, query))
            query, item, score = query[order], item[order], score[order]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            out.append((query[nth < most], item[nth < most], score[nth < most]))
            left = ~enough[owner]
            owner, term, weight = owner[left], term[left], weight[left]
        return _joined(out)

    def pivots(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray | None, n_queries: int, threshold: float) -> Hits:
        """All (query, item, score) with score >= threshold, document at a time.

        Each query has a pointer into the list of each of its terms. With the terms in order of the items they point at,
        the pivot is the first item that the largest weights of the terms up to it can lift to the threshold. If the maxima
        of the blocks around it can't, all these lists jump behind the block; else the item is scored. Queries of like
        length move in step.
        """
        own, term, weight = self._queries(owner, term, weight, n_queries, threshold)
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(begins, append=len(own))
        order = np.argsort(size, kind="stable")
        out: list[Hits] = []
        at = 0
        while at < len(order):
            step = max(1, POINTERS // int(size[order[-1]]))
            some = order[at : at + step]
            lane = np.arange(size[some].max())
            there = lane < size[some][:, None]
            where = np.where(there, begins[some][:, None] + lane, 0)
            out.append(self._walk(own[begins[some]], np.where(there, term[where], -1), np.where(there, weight[where], 0), threshold * (1 - SLACK)))
            at += step
        return _joined(out)

    def _seek(self, term: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each list the first posting whose item is at least `item`, its block and its item (n_items: none is left)."""
        block = np.searchsorted(self.key, term * self.n_blocks + item // BLOCK)
        inside = np.minimum(block, len(self.key) - 1)
        here = self.key[inside] == term * self.n_blocks + item // BLOCK
        begin, size = self.begin[inside], self.begin[inside + 1] - self.begin[inside]
        lane = np.arange(BLOCK)
        offset = self.offset[np.minimum(begin[:, None] + lane, len(self.offset) - 1)]
        less = ((offset < (item % BLOCK)[:, None]) & (lane < size[:, None])).sum(axis=1)
        block += here & (less == size)
        return self._at(term, block, np.where(here & (less < size), begin + less, -1))

    def _at(self, term: np.ndarray, block: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, posting (its first where `place` is -1) and item of pointers."""
        over = block >= self.block_of[term + 1]
        block = np.minimum(block, len(self.key) - 1)
        place = np.where(place < 0, self.begin[block], place)
        item = (self.key[block] - term * self.n_blocks) * BLOCK + self.offset[place]
        return block, place, np.where(over, self.n_items, item)

    def _walk(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: float) -> Hits:
        """Move the pointers of some queries (rows of `term` and `weight`, padded with term -1) until no pivot is left."""
        n, width = term.shape
        end = self.n_items
        most = np.where(term >= 0, self.term_top[term] * weight, 0)
        block, place, item = self._at(term, self.block_of[term], np.full(term.shape, -1))
        item = np.where(term >= 0, item, end)
        found: list[Hits] = []
        alive = np.arange(n)
        while True:
            at = item[alive]
            order = np.argsort(at, axis=1, kind="stable")
            at = np.take_along_axis(at, order, 1)
            pivot = (np.cumsum(np.take_along_axis(most[alive], order, 1), axis=1) < least).sum(axis=1)
            goal = np.where(pivot < width, at[np.arange(len(alive)), np.minimum(pivot, width - 1)], end)
            goes = goal < end
            alive, order, at, goal = alive[goes], order[goes], at[goes], goal[goes]
            if not len(alive):
                return _joined(found)
            upto = at <= goal[:, None]  # terms up to the pivot, and those that stand on it
            row, col = np.nonzero(upto)
            q, lane = alive[row], order[row, col]
            t = term[q, lane]
            near, there = self._found(t * self.n_blocks + (goal // BLOCK)[row])
            opens = np.bincount(row, np.where(there, self.top[near] * weight[q, lane], 0), len(alive)) >= least
            behind = np.where(upto, end, at).min(axis=1)
            jump = np.where(opens, goal, np.maximum(np.minimum((goal // BLOCK + 1) * BLOCK, behind), goal + 1))
            moves = item[q, lane] < jump[row]
            q2, lane2 = q[moves], lane[moves]
            block[q2, lane2], place[q2, lane2], item[q2, lane2] = self._seek(t[moves], jump[row[moves]])
            on = opens[row] & (item[q, lane] == goal[row])
            q, lane, row, t = q[on], lane[on], row[on], t[on]
            score = np.bincount(row, self.weight[place[q, lane]] * weight[q, lane], len(alive))
            hit = np.flatnonzero(score >= least)
            found.append((query[alive[hit]], goal[hit], score[hit].astype(np.float32)))
            place[q, lane] += 1
            done = place[q, lane] >= self.begin[block[q, lane] + 1]
            block[q, lane], place[q, lane], item[q, lane] = self._at(t, block[q, lane] + done, np.where(done, -1, place[q, lane]))
