"""Toxicity: held-out accuracy on given labels, disguises, and defined results of odd input."""

import random
import re
import time

import pytest

from foliolith.llm import toxicity as X

BENIGN = ["The reading of tick {n} was checked by the typist.", "Page {n} continues the table of hardness.", "Parasite counts belong to the storage survey {n}.", "The clerk trashed the old scan of lot {n}.", "Do not join page {n} with the legend."]
TOXIC = ["You are a worthless cretin and everybody at the {p} knows it.", "Go to hell with your {p}, halfwit.", "Hill folk breed like rats and ruin every {p}."]


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [r.choice(BENIGN).format(n=r.randint(1, 900)) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            lines.insert(r.randint(0, 6), r.choice(TOXIC).format(p=r.choice(["table", "axis", "scan"])))
        out.append(("\n".join(lines), bad))
    return out


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    rows = [(t, float(bad if r.random() > 0.05 else not bad)) for t, bad in corpus(600, 2)]
    sample = X.Sample(rows)
    from collections import Counter

    df = Counter()
    for t, _ in rows:
        df.update(set(X.pieces(t.lower())) & set(sample.vocabulary))
    return X.fit(sample, df, len(rows))


def test_held_out(model):
    data = corpus(400, 9)
    score, passage, example = model.score([t for t, _ in data])
    right = sum((s >= X.CASE) == bad for s, (_, bad) in zip(score, data, strict=True))
    assert right >= 396
    assert all(p and e for s, p, e in zip(score, passage, example, strict=True) if s >= X.CASE)


@pytest.mark.parametrize("text", ["YoU aRe A wOrThLeSs CrEtIn aNd EvErYbOdY aT tHe axis KnOwS iT.", "You are a w o r t h l e s s cr\u200betin and everybody at the scan knows it.", "Yоu аrе а wоrthlеss crеtin and everybody at the scan knows it.", "Go to hell with your scan, hallllfwit.", "note: Go to hell with your\ntable, half-\nwit.", "<b>Go</b> to hell with your <i>axis</i>, h4lfw1t."])
def test_disguises(model, text):
    assert model.score([f"Page 3 continues the table of hardness.\n\n{text}\n\nPage 9 continues."])[0][0] >= X.CASE


def test_odd_input(model):
    score, passage, example = model.score([None, "", "  \n", "!!!", "x" * 100_000, "Page 3 continues the table. " * 20_000])
    assert (score < X.CASE).all() and passage[:4] == [None] * 4 and example[:4] == [None] * 4


def test_without_toxic_labels():
    sample = X.Sample([(t, 0.0) for t, _ in corpus(20, 3)])
    model = X.fit(sample, {}, 20)
    assert (model.score(["anything at all", None])[0] == 0).all()
    assert (X.fit(X.Sample([]), {}, 0).score(["text"])[0] == 0).all()


def test_frames(spark):
    data = corpus(300, 4)
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, "clash") for i, (t, _) in enumerate(data)] + [(1000, None, "s", ""), (1001, "", None, "")], "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(i, int(bad), None) for i, (_, bad) in enumerate(data)] + [(0, None, 1), (5000, 1, 1), (0, 1, 2)], "doc_id bigint, toxic int, label int")
    model = X.trained(docs, labels)
    assert {r[0] for r in X.toxic_documents(docs, model).collect()} == {i for i, (_, bad) in enumerate(data) if bad}
    rates = {r["source"]: (r["documents"], r["cases"]) for r in X.source_rates(docs, model).collect()}
    assert sum(d for d, _ in rates.values()) == 302 and sum(c for _, c in rates.values()) == 60 and None in rates
    empty = X.trained(docs.limit(0), labels.limit(0))
    assert X.toxicity(docs, empty).count() == 302 and X.toxic_documents(docs.limit(0), empty).count() == 0


def test_corpus_frequency_reads_as_the_sample(spark):
    texts = ["сталь и оценка твёрдости", "Die Größe der Straße", "h4rdn3ss of <b>st</b>eel", "half-\nwit, hallllfwit", "re\u0301sume\u0301 of the steel", "сталь и масса", None, ""]
    sample = X.Sample([(t or "", float(i % 2)) for i, t in enumerate(texts * 2)])
    want = {}
    for t in texts:
        for w in {X.plain_word(p) for p in X.pieces(X.folded(t or "")) if p[0].isalnum()} - {None}:
            want[w] = want.get(w, 0) + 1
    found, n = X.corpus_frequency(spark.createDataFrame([(t,) for t in texts], "text string"), sample.vocabulary)
    assert n == len(texts) and found == {w: k for w, k in want.items() if w in sample.vocabulary} and set(found) == set(sample.vocabulary)


@pytest.mark.parametrize("text", ["Halfwit!", "You. Halfwit.", "Halfwit zorgblat."])
def test_few_words(model, text):
    clean, bad = (model.score([f"Page 3 continues the table of hardness.\n\n{t}\n\nPage 9 continues."]) for t in ("", text))
    assert bad[0][0] > clean[0][0] and bad[1][0].startswith("halfwit") and bad[2][0]


def read_one_by_one(text):
    """Words and borders as they are defined, text by text and by one pattern each."""
    flat = X.reader_text(text).replace("\x02", "")
    flat = X._LONG.sub(r"\1", X._SPACED.sub(lambda m: re.sub(r"[ .\-*_]", "", m[0]), flat))
    flat = X._SIGNED.sub(lambda m: m[0].translate(X.LEET), flat)
    end = r"[.!?:;][\"'»”’)\]]*(?=\s)|[。！？；]|\n\s*\n|\n(?=\s*(?:[-+>#|@/=<⚠👍•]|\*\s|\d+[.)]\s))"
    out = []
    for run in re.findall(rf"[㐀-䶿一-鿿]+|[^\W_㐀-䶿一-鿿]+|{end}", flat):
        han = len(run) > 1 and "㐀" <= run[0] <= "鿿"
        out += [run[i : i + 2] for i in range(len(run) - 1)] if han else [run if run[0].isalnum() else "\x03"]
    return flat, out


ODD = [*"aaZ9_ \n\n.!?:;\"')»-+>#|@/<*&$\x02\x03\x1c\r\t{}", *"。！漢字好㐀аеѕ​­½²İßﬁ٣𝒜👍•", "\n1. ", "\n* ", "a b c d", "x-y-z-w ", "zzz", "halfwit ", "漢字字", "h4lf", "&#x3;"]


def test_reads_many_texts_as_each_alone():
    r = random.Random(3)
    texts = ["".join(r.choices(ODD, k=r.randint(0, 40))) for _ in range(4_000)] + [None, "", "x" * 300_000]
    want = [read_one_by_one(t or "") for t in texts]
    assert X.folded_texts(texts) == [f for f, _ in want] and [X.pieces(f) for f, _ in want] == [p for _, p in want]
    ids = X._Ids({w: i for i, w in enumerate(sorted({X.plain_word(p) or "" for _, ps in want for p in ps if p[0].isalnum()}))})
    passage, found, of, flats = ids.read(texts)
    every = [(k, ids[p]) for k, (_, ps) in enumerate(want) for p in [*ps, "\x03"]]
    assert [(k, i) for k, i in every if i > X.SKIP] == list(zip(of[passage].tolist(), found.tolist(), strict=True))
    assert of.tolist() == [k for k, i in every if i == X.BORDER] and flats == [f for f, _ in want]


def test_signs_between_han_are_no_border(model):
    """Hexagrams lie among the Han signs: they were taken for borders that the text doesn't have, so evidence was missed."""
    score, passage, _ = model.score(["䷀ Page 3 ䷁ 漢䷀漢 goes on.\n\nGo to hell with your table, halfwit.\n\nPage 9 continues."])
    assert score[0] >= X.CASE and passage[0].startswith("go to hell")


def test_reading_costs_less_than_one_by_one(model):
    """Reading is most of the work of p8_found, which was over its CPU seconds when each text had arrays of its own."""
    texts = [line for t, _ in corpus(600, 8) for line in t.split("\n")]
    spent = []
    for _ in range(6):
        begin = time.process_time()
        model.read(texts)
        middle = time.process_time()
        for t in texts:
            read_one_by_one(t)
        spent.append((middle - begin, time.process_time() - middle))
    ours, theirs = map(min, zip(*spent, strict=True))
    assert ours < theirs


def test_isotonic():
    import numpy as np

    x, y = X._isotonic(np.array([0.0, 0.0, 0.5, 0.7, 0.9]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_copies_give_the_same_sample(spark):
    """Many times the labels keep the balance of toxic and benign votes, and a copied text bears nothing out."""
    data = corpus(150, 4)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)] + [(9000, None), (9001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, (_, bad) in enumerate(data)] + [(9000, 1), (9001, 0), (9002, 1), (0, None)], "doc_id bigint, toxic int")
    many = [spark.range(40).selectExpr("id * 10000 copy").crossJoin(x).withColumn("doc_id", X.F.expr("doc_id + copy")).drop("copy") for x in (docs, labels)]
    few, all_ = (X.labelled_sample(d, y, (20, 40)) for d, y in ((docs, labels), many))
    assert len(few.texts) == 60 and sorted(zip(few.texts, few.label)) == sorted(zip(all_.texts, all_.label))
    assert few.benign_weight == all_.benign_weight == pytest.approx((121 / 40) / (30 / 20))


def test_many_labels_keep_their_balance(spark):
    """Some labels are wrong: the few benign ones on abuse must not outweigh the toxic ones when there are many labels."""
    r = random.Random(6)
    data = corpus(400, 4)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(bad if r.random() > 0.1 else not bad)) for i, (_, bad) in enumerate(data)], "doc_id bigint, toxic int")
    copies = spark.range(98).selectExpr("id * 1000 copy")
    docs_many, labels_many = (copies.crossJoin(x).withColumn("doc_id", X.F.expr("doc_id + copy")).drop("copy") for x in (docs, labels))
    sample = X.labelled_sample(docs_many, labels_many, (60, 120))
    df, n = X.corpus_frequency(docs, sample.vocabulary)
    model = X.fit(sample, {w: k * 98 for w, k in df.items()}, n * 98)
    held = corpus(200, 9)
    score, _, _ = model.score([t for t, _ in held])
    assert sum(s >= X.CASE for s, (_, bad) in zip(score, held, strict=True) if bad) >= 38
