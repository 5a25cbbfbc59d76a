"""Leak search against brute force over all runs of words."""

import random
import re

import pytest

from foliolith.llm import decontaminate as D
from foliolith.llm.fold import reader_text

WORDS = [f"w{i}" for i in range(40)] + ["Größe", "the", "of", "a", "x1"]


def brute(text, item):
    """Whether twelve words of the item stand in a row, where a word broken by glue may count as whole."""
    flat = reader_text(text or "").translate(D._GLUE)
    words, wanted = re.findall(r"[^\W_]+", flat), re.findall(r"[^\W_]+", reader_text(item or "").translate(D._GLUE))
    runs = {tuple(wanted[i : i + 12]) for i in range(len(wanted) - 11)}
    return any(tuple(words[i : i + 12]) in runs for i in range(len(words) - 11))


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices(WORDS, k=r.choice([5, 12, 20, 70])))) for i in range(25)] + [(99, None), (100, "")]
    items.append((77, items[3][1]))
    texts = [None, "", "w1 w2"]
    for _ in range(120):
        text = r.choices(WORDS, k=r.randint(0, 60))
        own = items[r.randrange(25)][1].split()
        n = r.choice([0, 8, 11, 12, 13, 30])
        at = r.randint(0, max(0, len(own) - n))
        text += own[at : at + n] + r.choices(WORDS, k=r.randint(0, 60))
        texts.append(" ".join(text))
    index = D.EvaluationIndex(items)
    where, ids = index.leaks(texts)
    want = {(k, i) for k, t in enumerate(texts) for i, x in items if brute(t, x)}
    assert set(zip(where, ids, strict=True)) == want and len(where) == len(want)


ITEM = "Name the earliest step at which a smeared decimal point could have been noticed by the reviewer at 59.1 minutes"


@pytest.mark.parametrize(
    "text",
    [
        ITEM.upper(),
        ITEM.replace(" ", "\n"),
        ITEM.replace("earliest", "ear-\nliest").replace("smeared", "smea-\r\n  red"),
        ITEM.replace("step", "<b>st</b>ep").replace("noticed", "no<span class='x'>ti</span>ced"),
        ITEM.replace("decimal", "\\emph{deci}mal").replace("point", "**po**int"),
        ITEM.replace("a", "а").replace("e", "е"),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM),
        ITEM.replace("m", "m\u200b").replace(" ", "\u00a0"),
        "<p>x</p>" + ITEM.replace(" ", "; ") + "<br>y",
    ],
)
def test_disguises(text):
    index = D.EvaluationIndex([(1, ITEM), (2, ITEM + " again")])
    assert set(zip(*index.leaks(["before " + text + " after"]), strict=True)) == {(0, 1), (0, 2)}


def test_near_misses():
    broken = ITEM.split()
    for k in range(5, len(broken), 6):
        broken[k] = "other"
    assert D.EvaluationIndex([(1, ITEM)]).leaks([" ".join(broken), " ".join(ITEM.split()[:11]), "x" + ITEM[:60]]) == ([], [])


def test_frame(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 6), (2, None, 7), (3, "x " * 300_000 + ITEM, 8)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, ITEM), (None, ITEM), (11, None)], "item_id bigint, text string")
    assert sorted(map(tuple, D.leaked_items(docs, items).collect())) == [(1, 10), (1, 10), (3, 10)]
    assert D.leaked_items(docs, items.limit(0)).count() == 0 and D.leaked_items(docs.limit(0), items).count() == 0
