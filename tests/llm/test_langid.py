import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from sortalis.llm.langid import PENALTY, SCRIPT_NAMES, SCRIPTS, Model, label, predicted, trained, viterbi

LEARN = "lang is not null and crc32(cast(doc_id as string)) % 3 <> 1"


@pytest.fixture(scope="module")
def model(spark):
    return trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(LEARN), most_rows=100)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in predicted(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixed_text_is_cut_into_spans(model):
    en = "The onea thsh erbleing that was hain the thwhtion of edesha and the reatst inther"
    fr = "elle eaux queeau de les ouierai une éeuxment qui pour dans étretion mentoi avec"
    text = f"{en}. {fr}."
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    row = label(batch, model).to_pylist()[0]
    assert [s["lang"] for s in row["spans"]] == ["en", "fr"]
    assert abs(row["spans"][0]["end"] - len(en)) <= 12 and row["spans"][1]["end"] == len(text) - 1
    assert 0.4 < row["score"] < 0.8


def test_scripts_narrow_candidates():
    n = 1 << 16
    model = Model(["ja", "ru"], [np.zeros((2, n), np.float32)] * 2, np.array([1 << 16 | 1 << 15, 1 << 2], np.uint32))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["это слово", "日本語 テキスト"]})
    assert [r["lang_pred"] for r in label(batch, model).to_pylist()] == ["ru", "ja"]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    sizes = [5, 0, 1, 7, 6]
    first = np.append(0, np.cumsum(sizes))
    scores = rng.normal(size=(sum(sizes), 3))
    labels = viterbi(scores, first, 0.9)
    for d, n in enumerate(sizes):
        own = scores[first[d] : first[d + 1]]
        value = lambda path: sum(own[i, p] for i, p in enumerate(path)) - 0.9 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(map(value, product(range(3), repeat=n)))
        assert value(tuple(labels[first[d] : first[d + 1]])) == pytest.approx(best)


def test_edges(edge_docs, no_docs, model):
    rows = predicted(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (0, 1, 2):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].n_words) == ("und", 0, 0)
    assert by_id[8].lang_pred == "en" and by_id[100].lang_pred == by_id[101].lang_pred
    assert predicted(no_docs, model).count() == 0
    untrained = trained(no_docs)
    assert {(r.lang_pred, r.score) for r in predicted(edge_docs, untrained).collect()} == {("und", 0.0)}


def test_letters_of_all_planes_count(spark, model):
    rows = [(1, chr(0x30000) * 4), (2, chr(0x20000)), (3, "\U0001f600 12"), (4, "the \u4e2d\u6587")]
    got = {r.doc_id: r for r in predicted(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred == "und" for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert [got[i].recognised for i in (1, 2, 3)] == [0, 0, 0] and got[4].recognised == 0.6


def brute(model, text, penalty):
    """lang_pred and score, letter by letter: each word's score by language, then the best path by a plain table."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    words, at = [], 0
    while at < len(text):
        if not text[at].isalpha():
            at += 1
            continue
        end = at
        while end < len(text) and text[end].isalpha():
            end += 1
        words.append((at, end))
        at = end
    if not words:
        return "und", 0.0
    code = lambda i: ord(low[i]) if 0 <= i < len(text) and text[i].isalpha() else 0
    slot = lambda x: (x & (1 << 64) - 1) >> 48
    two = lambda i: slot((code(i - 1) * 0x9E3779B97F4A7C15 + code(i) * 0xC2B2AE3D27D4EB4F) * 0x165667B19E3779F9)
    three = lambda i: slot((code(i - 1) * 0xFF51AFD7ED558CCD + code(i) * 0xC4CEB9FE1A85EC53 + code(i + 1) * 0x9FB21C651E98DF25) * 0xD6E8FEB86659FD93)
    best, back = None, []
    for a, b in words:
        bits = 0
        for i in range(a, b):
            for name, first, last in SCRIPTS:
                if first <= ord(text[i]) <= last:
                    bits |= 1 << SCRIPT_NAMES.index(name)
        fits = [bool(bits & int(s)) for s in model.scripts]
        own = []
        for k in range(len(model.languages)):
            total = sum(float(model.tables[0][k][two(i)]) + float(model.tables[1][k][three(i)]) for i in range(a, b))
            own.append(total - (50 if any(fits) and not fits[k] else 0))
        if best is None:
            best = own
            continue
        top = max(range(len(best)), key=lambda k: best[k])
        choice = [k if best[k] >= best[top] - penalty else top for k in range(len(best))]
        back.append(choice)
        best = [max(best[k], best[top] - penalty) + own[k] for k in range(len(best))]
    label = max(range(len(best)), key=lambda k: best[k])
    path = [label]
    for choice in reversed(back):
        label = choice[label]
        path.append(label)
    letters = [0] * len(model.languages)
    for (a, b), k in zip(words, reversed(path), strict=True):
        letters[k] += b - a
    main = max(range(len(letters)), key=lambda k: letters[k])
    return model.languages[main], letters[main] / sum(letters)


def test_predictions_equal_brute_force(spark, model, small):
    rows = [(d, t) for d, t in small[1] if len(t or "") < 3000]
    rows += [(10_000, "the house und das Haus et la maison dans la ville"), (10_001, "Σας the слово"), (10_002, "x")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predicted(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(rows) > 50
    for d, t in rows:
        lang, score = brute(model, t or "", PENALTY)
        assert got[d][0] == lang and got[d][1] == pytest.approx(score)
