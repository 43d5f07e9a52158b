"""Language of documents, also where languages are mixed within one.

Method: a word is a run of letters.  The Unicode scripts of a word's letters narrow its candidates to
the languages that use one of them.  Each candidate gets a score per word, the log-likelihood of the
word's letter bigrams and trigrams against the mean of all languages.  A Viterbi pass over the words, in
which a change of language costs a penalty, labels spans; the label with the most letters is the
document's language and its share of the letters is the score; ``recognised`` is the share of the letters
in words of which some language has a script.

The model is a table of hashed letter n-grams, of a size that does not depend on the data.  It is fitted
on about ``most_rows`` labelled rows of each language, chosen by the hash of doc_id (all rows where a
language has fewer); the counts are summed in Spark.  Labels are never an input of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without labelled rows all
documents are ``und`` with score 0; ties go to the language that comes first in order; rows that repeat
are predicted alike; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortalis.llm.textcols import claim, slices, text_buffer, word_points

TABLE_BITS = 16
MOST_ROWS = 2000
PENALTY = 8.0
SLICE = 1 << 19  # bytes of text that a worker takes at a time
SCHEMA = "doc_id long, lang_pred string, score double, n_words long, spans array<struct<start:int,end:int,lang:string>>, recognised double"

#: First and last code point of Unicode script ranges.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x3FFFF),
)
SCRIPT_NAMES = tuple(dict.fromkeys(s for s, _, _ in SCRIPTS))


class _Tables:
    """By code point: the lower-case letter (0 for what is none) and the bit of its script."""

    def __init__(self) -> None:
        lower = np.zeros(0x110000, np.uint32)
        for c in word_points():
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        script = np.zeros(0x110000, np.uint32)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = 1 << SCRIPT_NAMES.index(name)
        self.lower, self.script = lower, script


_TABLES: list[_Tables] = []


def _tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


@dataclass
class Words:
    """The words of a text column: starts and ends in letters, and the hashed n-grams that end at each letter."""

    first: np.ndarray  # document d has words first[d] to first[d + 1]
    starts: np.ndarray
    ends: np.ndarray
    offset: np.ndarray  # the code point at which each document starts
    letters: np.ndarray
    script: np.ndarray  # of each word, the bits of its scripts

    def grams(self) -> Iterator[np.ndarray]:
        """For each letter, a slot of the table for each n-gram order; word edges count as a letter 0."""
        c = self.letters.astype(np.uint64)
        pad = np.concatenate([[0], c, [0]]).astype(np.uint64)
        before, after = pad[:-2], pad[2:]
        shift = np.uint64(64 - TABLE_BITS)
        yield ((before * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9) >> shift).astype(np.int64)
        yield ((before * np.uint64(0xFF51AFD7ED558CCD) + c * np.uint64(0xC4CEB9FE1A85EC53) + after * np.uint64(0x9FB21C651E98DF25)) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)


def word_spans(column: pa.Array) -> Words:
    """The words of each text."""
    raw, offsets = text_buffer(column)
    tables = _tables()
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    leading = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    offset = leading[offsets]
    letters = tables.lower[points]
    inside = letters > 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offset[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(points))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    script = np.zeros(0, np.uint32)
    if len(starts):  # reduceat runs on to the next word; what lies between has no script bit of its own
        script = np.bitwise_or.reduceat(np.where(inside, tables.script[points], 0), starts)
    return Words(np.searchsorted(starts, offset), starts, ends, offset, letters, script)


@dataclass
class Model:
    """Scores by slot and language for each n-gram order, and the scripts that each language uses."""

    languages: list[str]
    tables: list[np.ndarray]
    scripts: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """A score for each word and language; a language that none of the word's scripts belongs to loses."""
        out = np.zeros((len(words.starts), len(self.languages)), np.float32)
        if not out.size:
            return out
        for slots, table in zip(words.grams(), self.tables, strict=True):
            for k in range(len(self.languages)):
                sums = np.append(0, np.cumsum(np.where(words.letters > 0, table[k][slots], 0), dtype=np.float64))
                out[:, k] += (sums[words.ends] - sums[words.starts]).astype(np.float32)
        fits = (words.script[:, None] & self.scripts[None, :]) > 0  # none at all: all candidates stay
        out[~fits & fits.any(axis=1)[:, None]] -= 50
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row, where documents are runs of rows and each change of label costs a penalty."""
    labels = np.zeros(len(scores), np.int64)
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order) or scores.shape[1] < 2:
        return labels
    heads, sizes = first[:-1][order], counts[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # how many are longer than t
    came = np.zeros(scores.shape, np.int8)
    own = np.arange(scores.shape[1], dtype=np.int8)[None, :]
    best = scores[heads].astype(np.float64)
    for t in range(1, int(sizes[0])):
        n = active[t]
        rows = heads[:n] + t
        now = best[:n]
        top = now.argmax(axis=1)
        switched = now[np.arange(n), top][:, None] - penalty
        stay = now >= switched
        came[rows] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, switched) + scores[rows]
    label = best.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = active[t]
        rows = heads[:n] + t
        labels[rows] = label[:n]
        label[:n] = came[rows, label[:n]]
    return labels


def trained(labelled: DataFrame, most_rows: int = MOST_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits the model on about most_rows rows of each language; rows without a label are not learned from."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key")).where("lang is not null and lang <> 'und'")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], [], np.zeros(0, np.uint32))
    share: Column = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, most_rows / n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = word_spans(part.column("text"))
                own = np.repeat(np.arange(part.num_rows), np.diff(words.first))
                doc = np.repeat(own, words.ends - words.starts)
                at = np.flatnonzero(words.letters > 0)
                grams = [g[at] for g in words.grams()]
                names = part.column("lang").to_pylist()
                for name in set(names):
                    mine = np.array([n == name for n in names])
                    letter, word = mine[doc], mine[own]
                    bits = np.array([(words.script[word] >> np.uint32(b) & 1).sum() for b in range(len(SCRIPT_NAMES))])
                    new = np.concatenate([*(np.bincount(g[letter], minlength=1 << TABLE_BITS) for g in grams), bits]).astype(np.int64)
                    totals[name] = totals[name] + new if name in totals else new
        for name, total in totals.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot)), pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["lang", "slot", "n"])

    sums = chosen.select("text", "lang").mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    size = 1 << TABLE_BITS
    tallies = np.zeros((len(languages), 2 * size + len(SCRIPT_NAMES)))
    tallies[[languages.index(x) for x in sums["lang"]], sums["slot"]] = sums["n"]
    tables = []
    for order in range(2):
        part = tallies[:, order * size : (order + 1) * size] + 0.5
        logs = np.log(part / part.sum(axis=1, keepdims=True))
        tables.append((logs - logs.mean(axis=0)).astype(np.float32))
    scripts = tallies[:, 2 * size :]
    used = scripts >= np.maximum(0.05 * scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, tables, (used << np.arange(len(SCRIPT_NAMES))).sum(axis=1).astype(np.uint32))


def predicted(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """One row for each document: its language, score, number of words, and the labelled spans in code points."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield label(part, broadcast.value, penalty)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, SCHEMA)


def label(batch: pa.RecordBatch, model: Model, penalty: float = PENALTY) -> pa.RecordBatch:
    """The prediction for each row of a batch with doc_id and text."""
    claim("langid", _TABLES.clear)
    words = word_spans(batch.column("text"))
    n, kinds = batch.num_rows, max(1, len(model.languages))
    doc = np.repeat(np.arange(n), np.diff(words.first))
    labels = viterbi(model.word_scores(words), words.first, penalty)
    sizes = words.ends - words.starts
    letters = np.bincount(doc * kinds + labels, weights=sizes, minlength=n * kinds).reshape(n, kinds)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    known = (total > 0) & bool(model.languages)
    score = np.where(known, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)
    fits = (words.script & np.bitwise_or.reduce(model.scripts, initial=0)) > 0
    recognised = np.bincount(doc, weights=sizes * fits, minlength=n) / np.maximum(total, 1)
    names = np.array([*model.languages, "und"], dtype=object)
    head = np.append(True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])) if len(labels) else np.zeros(0, dtype=bool)
    if not model.languages:
        head[:] = False
    at = np.flatnonzero(head)
    tail = np.append(at[1:], len(labels)) - 1
    base = words.offset[doc[at]] if len(at) else at
    spans = pa.StructArray.from_arrays(
        [
            pa.array((words.starts[at] - base).astype(np.int32)),
            pa.array((words.ends[tail] - base if len(at) else at).astype(np.int32)),
            pa.array(names[labels[at]] if len(at) else [], pa.string()),
        ],
        names=["start", "end", "lang"],
    )
    cuts = np.searchsorted(at, words.first)
    columns = [
        batch.column("doc_id"),
        pa.array(names[np.where(known, best, len(names) - 1)], pa.string()),
        pa.array(score),
        pa.array(np.diff(words.first)),
        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans),
        pa.array(recognised),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_words", "spans", "recognised"])
