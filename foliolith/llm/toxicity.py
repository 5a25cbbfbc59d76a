"""Abusive, hateful or sexual passages, by their nearest labelled examples.

Fitting, on a bounded sample of labelled documents: every passage is an example with all its words as a TF-IDF vector.
Weights use document frequencies counted over the whole corpus. Scoring: every passage of every document is a query against
a block-max index of the examples that hold toxic votes; all at a cosine of NEAR or more are found exactly. The passages
that meet one ask their VOTERS nearest examples of either kind; votes, weighted by a power of the cosine, give a raw score
that is calibrated against the labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolith.llm.blockmax import BlockMaxIndex
from foliolith.llm.fold import reader_text

#: Most labelled texts, toxic and benign, that are fitted on: those with the lowest hash.
SAMPLE = (1_000, 2_000)
#: Least cosine of a neighbour, power of the cosine in its vote, nearest examples that vote.
NEAR, SHARP, VOTERS = 0.45, 4, 16
#: Least cosine of the examples that are asked whether a vote stands.
ALIKE = 0.6
#: Benign vote that every passage begins with; examples need more toxic votes to be near at all.
PRIOR = 0.1
#: Least support of a toxic vote, as a share of the best supported one of its document.
SUPPORT = 0.25
#: Calibrated score from which a document is a case.
CASE = 0.5
#: Signs that stand for letters. Fixed values.
LEET = str.maketrans("0134578@$", "oieastbas")

#: Borders of passages; they begin with one class of signs, which the search skips to.
_BREAK = re.compile(r"[.!?:;。！？；\n](?:(?<=[.!?:;])[\"'»”’)\]]*(?=\s)|(?<=[。！？；])|(?<=\n)(?:\s*\n|(?=\s*(?:[-+>#|@/=<⚠👍•]|\*\s|\d+[.)]\s))))")
_HAN = re.compile("[㐀-鿿]")
_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-*_][^\W\d_]){3,}(?![^\W_])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_SIGNED = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_CODE = re.compile(r"(?:[^\W\d_]{1,2}\d+)+[^\W\d_]?|\d+[^\W\d_]?")
#: Marks of words that don't count and of borders between passages; entries a worker remembers.
SKIP, BORDER, MEMO = -2, -3, 400_000
#: Sign of a border among words, and the one that takes its place where a text has it: no pattern tells them apart.
_MARK, _NO_MARK = "\x03", "\x02"
#: Signs of the texts that are read at once, so that their arrays stay in the cache; one text may have more.
TOGETHER = 100_000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Of each code point 1 if it is a letter, 2 if it may stand between spaced-out ones; each code point, a blank for
    those in no word; the same for ASCII as a translation table.
    """
    kind, keep = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for mask, pattern in ((kind, r"[^\W\d_]+"), (keep, r"[^\W_]+")):
        for found in re.finditer(pattern, every):
            mask[ord(found[0][0]) : ord(found[0][-1]) + 1] = True
        mask[0xD800:0xE000] = False
    kind[[ord(x) for x in " .-*_"]] = 2
    keep[ord(_MARK)] = True
    code = np.where(keep, np.arange(0x110000, dtype=np.uint32), np.uint32(32))
    return kind, code, {i: chr(code[i]) for i in range(128)}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _stretched(flats: list[str]) -> tuple[list[int], list[int]]:
    """Texts that may have spaced-out letters (four single ones, a sign between each two), and a letter thrice in a row."""
    codes = _codes("\n".join(flats))
    kind = _tables()[0][codes]
    letter = np.zeros(len(codes) + 2, bool)
    letter[1:-1] = kind == 1
    single = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    pairs = single[:-2] & single[2:] & (kind[1:-1] == 2)
    same = (codes[1:] == codes[:-1]) & letter[2:-1]
    ends = np.cumsum([len(x) + 1 for x in flats])
    return tuple(np.unique(np.searchsorted(ends, np.flatnonzero(x), "right")).tolist() for x in (pairs[:-4] & pairs[4:], same[:-1] & same[1:]))


def together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, in runs of about TOGETHER signs."""
    some: list[str | None] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text or "") + 1
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def folded_texts(texts: Iterable[str | None]) -> list[str]:
    """Texts as read, with wrapped words, spaced-out and drawn-out letters put right."""
    flats = [reader_text(text).replace("\x02", "") if text else "" for text in texts]
    spaced, long = _stretched(flats)
    if spaced:
        for k in spaced:
            flats[k] = _SPACED.sub(lambda m: re.sub(r"[ .\-*_]", "", m[0]), flats[k])
        long = _stretched(flats)[1]
    for k in long:
        flats[k] = _LONG.sub(r"\1", flats[k])
    return [_SIGNED.sub(lambda m: m[0].translate(LEET), flat) if "@" in flat or "$" in flat else flat for flat in flats]


def folded(text: str) -> str:
    """One text as `folded_texts` gives it."""
    return folded_texts([text])[0]


def _spread_han(codes: np.ndarray) -> np.ndarray:
    """Code points of words with the pairs of Han runs as words of their own."""
    han = np.zeros(len(codes) + 2, bool)
    han[1:-1] = (codes >= 0x3400) & (codes <= 0x9FFF)
    here, before, after = han[1:-1], han[:-2], han[2:]
    out = np.full((len(codes), 3), 32, np.uint32)
    out[:, 0] = np.where(here & before & ~after, 32, codes)
    out[:-1, 1] = np.where((here & after)[:-1], codes[1:], 32)
    use = np.ones((len(codes), 3), bool)
    use[:, 1] = here | after  # a blank between Han and other signs
    use[:, 2] = here & after
    return out[use]


def _blanks(flat: str) -> tuple[str, int]:
    """Words of a folded text between blanks, with a sign for each border, and the number of borders."""
    if _MARK in flat:
        flat = flat.replace(_MARK, _NO_MARK)
    flat, n = _BREAK.subn(f" {_MARK} ", flat)
    _, table, of_ascii = _tables()
    if flat.isascii():
        return flat.translate(of_ascii), n
    codes = table[_codes(flat)]
    if _HAN.search(flat):
        codes = _spread_han(codes)
    return codes.tobytes().decode("utf-32-le"), n


def pieces(flat: str) -> list[str]:
    """Words of a folded text and, as signs, the borders between its sentences and lines; of Han runs the pairs."""
    return _blanks(flat)[0].split()


def plain_word(piece: str) -> str | None:
    """The word of a piece: digits among letters read as letters; None for codes, numbers and single letters."""
    if piece.isalpha():
        return piece if len(piece) > 1 or _HAN.match(piece) else None
    return None if _CODE.fullmatch(piece) else piece.translate(LEET)


class _Ids(dict):
    """Ids of pieces, worked out once for each."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        word = plain_word(piece) if piece[0].isalnum() else ""
        self[piece] = out = BORDER if word == "" else SKIP if word is None else self.vocabulary.get(word, -1)
        return out

    def read(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """As Model.read."""
        ids, flats, passages = [np.zeros(0, np.int64)], [], []
        for part in together(texts):
            some = folded_texts(part)
            blanks = [_blanks(flat) for flat in some]
            found = f" {_MARK} ".join([x for x, _ in blanks] + [""]).split()
            ids.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
            passages.extend([n + 1 for _, n in blanks])
            flats.extend(some)
        every = np.concatenate(ids)
        border = every == BORDER
        passage = np.cumsum(border) - border
        keep = every > SKIP
        return passage[keep], every[keep], np.repeat(np.arange(len(passages)), passages), flats


class Model:
    """Examples, weights and calibration; small enough to be sent to every worker."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.idf = np.zeros(0, np.float32)
        self.unknown = 1.0
        #: All examples, and the place among them of each item of the index of the toxic ones.
        self.index: BlockMaxIndex | None = None
        self.toxic_index: BlockMaxIndex | None = None
        self.toxic = self.benign = np.zeros(0)
        self.examples: dict[int, str] = {}
        self.steps = (np.zeros(0), np.zeros(0))
        self.ids: _Ids | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ids": None}

    def read(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Passages of texts: for each word its passage and id (-1: unknown), for each passage its text; the folded texts."""
        if self.ids is None:
            self.ids = _Ids(self.vocabulary)
        return self.ids.read(texts)

    def weighted(self, owner: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and TF-IDF weights over the norm, by passage: the root of the count times idf. Unknown words count in the norm."""
        size = len(self.idf) + 1
        key, count = np.unique(owner * size + np.where(ids < 0, size - 1, ids), return_counts=True)
        own, term = np.divmod(key, size)
        squared = np.append(self.idf, self.unknown).astype(np.float64)[term] ** 2 * count
        norm = np.sqrt(np.maximum(np.bincount(own, squared, n), 1e-12))
        known = term < size - 1
        own, term, count = own[known], term[known], count[known]
        return own, term, (self.idf[term] * np.sqrt(count) / norm[own]).astype(np.float32)

    def near(self, owner: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Mask of the words in passages that a toxic example may be near, by the largest weights of their words: a bound
        of the cosine, as repeated words count in full here.
        """
        weight = np.append(self.idf, self.unknown)[ids].astype(np.float64)
        norm = np.sqrt(np.maximum(np.bincount(owner, weight**2, n), 1e-12))
        bound = np.bincount(owner, weight * np.append(self.toxic_index.term_top[: len(self.idf)], 0)[ids], n)
        return (bound >= NEAR * 0.999 * norm)[owner]

    def votes(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw score of each passage and its nearest toxic example (-1 if none is near)."""
        raw, best = np.zeros(n), np.full(n, -1)
        if self.toxic_index is None or not len(owner):
            return raw, best
        met = np.zeros(n, bool)
        met[self.toxic_index.blocks(owner, term, weight, n, NEAR)[0]] = True
        mine = met[owner]
        return self.tally(*self.index.nearest(owner[mine], term[mine], weight[mine], n, NEAR, VOTERS), n)

    def tally(self, query: np.ndarray, item: np.ndarray, cosine: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and nearest toxic examples from neighbours: the toxic share of their votes, times the nearest cosine."""
        raw, best = np.zeros(n), np.full(n, -1)
        if not len(query):
            return raw, best
        cosine = np.minimum(cosine, 1.0).astype(np.float64)
        toxic = np.bincount(query, cosine**SHARP * self.toxic[item], n)
        benign = np.bincount(query, cosine**SHARP * self.benign[item], n)
        is_toxic = self.toxic[item] > PRIOR
        query, item, cosine = query[is_toxic], item[is_toxic], cosine[is_toxic]
        order = np.lexsort((cosine, query))
        last = order[np.flatnonzero(np.diff(query[order], append=-1))]
        nearest = np.zeros(n)
        nearest[query[last]] = cosine[last]
        best[query[last]] = item[last]
        return toxic / (toxic + benign + PRIOR) * nearest, best

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Share of toxic labels among fitted documents of a like raw score."""
        return np.interp(raw, *self.steps) if len(self.steps[0]) else raw

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None], list[str | None]]:
        """Of each text: calibrated score, passage that has it, nearest example."""
        owner, ids, of, flats = self.read(texts)
        score = np.zeros(len(texts))
        evidence: list[str | None] = [None] * len(texts)
        example: list[str | None] = [None] * len(texts)
        if self.toxic_index is None or not len(owner):
            return self.calibrated(score), evidence, example
        mask = self.near(owner, ids, len(of))
        raw, best = self.votes(*self.weighted(owner[mask], ids[mask], len(of)), len(of))
        first = np.searchsorted(of, np.arange(len(texts)))
        for p in np.flatnonzero(raw > 0).tolist():
            k = int(of[p])
            if raw[p] > score[k]:
                score[k] = raw[p]
                evidence[k] = _BREAK.split(flats[k])[p - first[k]].strip()
                example[k] = self.examples[int(best[p])]
        return self.calibrated(score), evidence, example


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps of mean y over x (pool adjacent violators)."""
    weight = np.ones(len(x)) if weight is None else weight
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([a, b, w])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] == blocks[-1][0]):
            a2, m2, n2 = blocks.pop()
            a1, m1, n1 = blocks[-1]
            blocks[-1] = [(a1 * n1 + a2 * n2) / (n1 + n2), (m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


class Sample:
    """Labelled documents and their words. `benign_weight`: labelled benign documents that one in the sample stands for, over
    the toxic ones that a toxic one stands for, so that the balance of the labels holds however many there are.
    """

    def __init__(self, rows: list[tuple[str, float]], benign_weight: float = 1.0) -> None:
        self.texts = [text for text, _ in rows]
        self.label = np.array([y for _, y in rows])
        self.benign_weight = benign_weight
        self.weight = np.where(self.label > 0.5, 1.0, benign_weight)
        words: set[str] = set()
        for some in together(self.texts):
            for flat in folded_texts(some):
                words.update(pieces(flat))
        words = {plain_word(p) or "" for p in words if p[0].isalnum()}
        self.vocabulary = {w: i for i, w in enumerate(sorted(words - {""}))}


def fit(sample: Sample, frequency: dict[str, int], n_documents: int) -> Model:
    """Model of a sample, given the number of corpus documents with each word of its vocabulary.

    Every passage of the labelled documents is an example with all its words; passages with the same words are one example
    that holds their votes, one for each document. A document is labelled, not its passages, and most passages of a toxic
    document are harmless. So the nearest examples of other documents are asked: a toxic vote stands if among them toxic
    votes outweigh benign ones and the passage is, with a factor of SUPPORT, as well supported as the best one of its
    document. In a document without a supported passage those with the least benign votes, if fewer than the toxic ones,
    share its vote, which counts the less the more other documents have one: then it is more likely labelled wrongly.
    Other toxic votes are withdrawn.
    """
    model = Model()
    model.vocabulary = sample.vocabulary
    names = sorted(sample.vocabulary)
    df = np.array([frequency.get(w, 0) for w in names])
    model.idf = np.log1p((max(n_documents, 1) + 1) / (df + 1)).astype(np.float32)
    model.unknown = float(np.median(model.idf)) if len(names) else 1.0
    owner, ids, of, flats = model.read(sample.texts)
    n = len(of)
    if not len(owner) or not (sample.label > 0.5).any():
        return model
    owner, term, weight = model.weighted(owner, ids, n)
    begins = np.searchsorted(owner, np.arange(n + 1))
    spans: list[str] = []
    for flat in flats:
        spans.extend(x.strip() for x in _BREAK.split(flat))
    # Examples in the order of their texts, so that similar ones are neighbours in the index.
    first: dict[bytes, int] = {}
    example_of = np.full(n, -1)
    heads: list[int] = []
    for p in sorted(range(n), key=spans.__getitem__):
        if begins[p + 1] > begins[p]:
            key = term[begins[p] : begins[p + 1]].tobytes() + weight[begins[p] : begins[p + 1]].tobytes()
            if key not in first:
                first[key] = len(heads)
                heads.append(p)
            example_of[p] = first[key]
    m = len(heads)
    # One vote for each document that has the example; the only document of an example, or -1.
    pairs = np.unique(np.column_stack([example_of, of])[example_of >= 0], axis=0)
    is_toxic = sample.label[pairs[:, 1]] > 0.5
    toxic = np.bincount(pairs[is_toxic, 0], minlength=m).astype(float)
    benign = np.bincount(pairs[~is_toxic, 0], sample.weight[pairs[~is_toxic, 1]], m)
    single = sample.benign_weight
    sole = np.where(np.bincount(pairs[:, 0], minlength=m) == 1, pairs[np.searchsorted(pairs[:, 0], np.arange(m)), 1], -1)

    def rows_of(examples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of examples, terms and weights of their words."""
        p = np.array(heads)[examples]
        size = begins[p + 1] - begins[p]
        at = np.repeat(begins[p] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(examples)), size), term[at], weight[at]

    own, words, force = rows_of(np.arange(m))
    model.index = BlockMaxIndex(words, own, force, len(names), m)

    def asked(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Toxic and benign votes of the nearest examples of other documents, for some examples."""
        query, item, cosine = model.index.nearest(*rows_of(some), len(some), ALIKE, VOTERS)
        other = (item == some[query]) | (sole[item] < 0) | (sole[item] != sole[some[query]])
        query, item, cosine = query[other], item[other], cosine[other]
        vote, own = np.minimum(cosine, 1.0) ** SHARP, item == some[query]
        left = [np.maximum(side[item] - own * one, 0) for side, one in ((toxic, 1), (benign, single))]
        return np.bincount(query, vote * left[0], len(some)), np.bincount(query, vote * left[1], len(some))

    for_, against = np.zeros(m), benign.copy()
    some = np.flatnonzero((toxic > 0) & (benign <= np.maximum(toxic, single)))  # the others' own words are mostly benign already
    for_[some], against[some] = asked(some)
    support = np.where(for_ > against, for_, 0)
    example, document = pairs[is_toxic].T
    best = np.zeros(len(sample.label))
    np.maximum.at(best, document, support[example])
    lowest = np.full(len(sample.label), np.inf)
    np.minimum.at(lowest, document, against[example])
    lone = (best[document] == 0) & (against[example] <= np.minimum(lowest[document], 1 + for_[example]))
    stands = (support[example] > 0) & (support[example] >= SUPPORT * best[document])
    open_ = (best[np.unique(document)] == 0).mean()  # share of toxic documents without a supported passage
    model.toxic = np.bincount(example, stands + open_ * lone / np.maximum(np.bincount(document, lone, len(sample.label))[document], 1), m)
    kept = np.flatnonzero(model.toxic > PRIOR)
    model.examples = {i: spans[heads[i]] for i in kept.tolist()}
    own, words, force = rows_of(kept)
    model.toxic_index = BlockMaxIndex(words, own, force, len(names), len(kept))
    # Benign votes that stand among toxic ones are withdrawn likewise.
    own, words, force = rows_of(np.unique(example[stands]))
    supported = BlockMaxIndex(words, own, force, len(names), own[-1] + 1 if len(own) else 0)
    some = np.flatnonzero(benign > 0)
    some = some[np.unique(supported.blocks(*rows_of(some), len(some), ALIKE)[0])]
    toxic = model.toxic
    for_, against = asked(some)
    model.benign = benign.copy()
    model.benign[some[for_ * SUPPORT > against]] = 0
    # Calibrated on the sample without each document's own examples, as a new document has none.
    met = np.zeros(n, bool)
    met[model.toxic_index.blocks(owner, term, weight, n, NEAR)[0]] = True
    mine = met[owner]
    query, item, cosine = model.index.nearest(owner[mine], term[mine], weight[mine], n, NEAR, VOTERS)
    other = sole[item] != of[query]
    raw, _ = model.tally(query[other], item[other], cosine[other], n)
    worst = np.zeros(len(sample.label))
    np.maximum.at(worst, of, raw)
    model.steps = _isotonic(worst, sample.label, sample.weight)
    return model


def corpus_frequency(documents: DataFrame, vocabulary: dict[str, int], text: str = "text") -> tuple[dict[str, int], int]:
    """Documents holding each vocabulary word, over the whole corpus, and the number of documents.

    Texts are read as in Sample and Model.read: folded, their pieces as plain words. Counted per Arrow batch before the
    shuffle; what reaches the driver is bounded by the vocabulary.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = _Ids(shared.value), 0
        size = len(shared.value)
        held = np.zeros(size, np.int64)
        for batch in batches:
            n += batch.num_rows
            for some in together(batch.column(0).to_pylist()):
                passage, ids, of, _ = known.read(some)
                own, ids = of[passage[ids >= 0]], ids[ids >= 0]
                held += np.bincount(np.unique(own * size + ids) % max(size, 1), minlength=size)
        total = {w: int(held[i]) for w, i in shared.value.items() if held[i]} | {"": n}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = documents.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r[0]: r[1] for r in rows}
    return found, found.pop("", 0)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE, key: str = "doc_id") -> Sample:
    """At most `most` texts (toxic, benign) with their label: the mean over its documents' labels, above 0.5 toxic, below benign.

    A text delivered again is one text, however many documents have it: its copies are no other documents that could bear it
    out. Texts are told apart by SHA-256. The chosen ones, bounded by `most`, are broadcast; only they reach the driver.
    """
    mean = labels.where("toxic is not null").groupBy(key).agg(F.avg("toxic").alias("label"))
    read = documents.where("text is not null").select(key, "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    texts = read.select(key, "digest").join(mean, key).groupBy("digest").agg(F.avg("label").alias("label"), F.min(key).alias(key)).where("label <> 0.5").persist()
    n_toxic, n = texts.agg(F.count_if(F.col("label") > 0.5), F.count("*")).first()
    ranked = [texts.where(cond).orderBy("digest").limit(k) for cond, k in zip(("label > 0.5", "label < 0.5"), most, strict=True)]
    chosen = ranked[0].unionByName(ranked[1])
    rows = read.join(F.broadcast(chosen), [key, "digest"]).dropDuplicates(["digest"]).orderBy(key, "digest").collect()
    texts.unpersist()
    return Sample([(r["text"], float(r["label"])) for r in rows], max(1.0, (n - n_toxic) / most[1]) / max(1.0, n_toxic / most[0]))


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    """Model fitted on a bounded sample of the labels and on word counts of the whole corpus."""
    sample = labelled_sample(documents, labels)
    return fit(sample, *corpus_frequency(documents, sample.vocabulary))


def toxicity(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score, passage, example), one per input row.

    Null, empty and blank texts score 0 without evidence; whole texts are read, however long; repeated rows score alike;
    with no toxic label at all every score is 0. A map over the scan.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, score double, passage string, example string"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score, passage, example = mine.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(passage, pa.string()), pa.array(example, pa.string())], [key, "score", "passage", "example"])

    return documents.select(key, text).mapInArrow(scan, schema)


def toxic_documents(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the rows whose score is CASE or more."""
    return toxicity(documents, model, key, text).where(F.col("score") >= CASE).select(key)


def source_rates(documents: DataFrame, model: Model, source: str = "source") -> DataFrame:
    """Rows (source, documents, cases, rate): a null source is a source of its own."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = f"{source} {documents.schema[source].dataType.simpleString()}, is_case int"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score, _, _ = shared.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((score >= CASE).astype(np.int32))], [source, "is_case"])

    flags = documents.select(source, "text").mapInArrow(scan, schema)
    return flags.groupBy(source).agg(F.count("*").alias("documents"), F.sum("is_case").cast("bigint").alias("cases"), F.avg("is_case").alias("rate"))
