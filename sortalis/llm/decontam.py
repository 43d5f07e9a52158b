"""Documents that contain benchmark items, also with small edits.

Method (pigeonhole edit matching): an item of m words may differ from its place in a document by an
error budget of e = floor(rate * m) word edits.  The item is split into e + 1 pieces; whatever the edits,
one piece stays whole.  So every exact hit of a piece is a candidate, and nothing else can match.  The
candidate's surroundings are then verified by Myers' bit-parallel edit distance, which runs over the
document's words with the item in one bit vector.

Words are runs of letters and digits, lower-cased, so that neither case nor punctuation nor white space
hides an item; they are compared by a 64-bit hash.  In scripts without spaces (Chinese, Japanese, Thai,
Lao, Khmer, Burmese) each letter is a word.  An item of fewer than ``least_words`` words is matched
exactly: its budget is zero and the whole item is its one piece.  Items are taken in blocks of bounded size, each
against all documents; every document is read as often as there are blocks.

Defined cases: an item that is null or has no word never matches; a text that is
null or empty has no match; a document that holds several items has a row for each, and one that holds an
item twice has one row, for its best and then first place; rows that repeat give rows that repeat; empty
tables give no row; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortalis.llm.textcols import claim, mixed, ranges, slices, text_buffer, word_points

RATE, LEAST_WORDS, BLOCK_BYTES, SLICE = 0.2, 5, 16 << 20, 1 << 20
SCHEMA = "doc_id long, item_id long, distance int, item_words int, error_budget int, start int, end int"
BASE = 0x9E3779B97F4A7C15
#: Code points, ends exclusive, of scripts that are written without spaces.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000))
_LOWER: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """By code point, the lower-case letter or digit; 0 for the rest."""
    if not _LOWER:
        table = np.zeros(0x110000, np.uint64)
        for c in word_points():
            s = chr(c)
            if s.isalnum():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LOWER.append(table)
    return _LOWER[0]


def _alone(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a word of its own."""
    out = np.zeros(len(points), bool)
    if len(points) and points.max() >= UNSPACED[0][0]:
        for a, b in UNSPACED:
            out |= (points >= a) & (points < b)
    return out


def _window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[starts[i]:ends[i]] that does not depend on where the run lies."""
    if not len(values):
        return np.zeros(len(starts), np.uint64)
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(values) - 1, BASE, np.uint64)))
    downs = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(values) - 1, pow(BASE, -1, 1 << 64), np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum(values * powers, dtype=np.uint64))
    return mixed((sums[ends] - sums[starts]) * downs[np.minimum(starts, len(values) - 1)])


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): starts and ends in code points of the document's text."""
    claim("decontam", _LOWER.clear)
    raw, offsets = text_buffer(column)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    offset = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
    letters = _lower()[points]
    inside = letters > 0
    begin, end = inside.copy(), inside.copy()
    alone = _alone(points)
    apart = alone[1:] | alone[:-1]
    begin[1:] &= ~inside[:-1] | apart
    end[:-1] &= ~inside[1:] | apart
    cuts = offset[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(points))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offset)
    base = np.repeat(offset[:-1], np.diff(first))
    return _window_sums(letters, starts, ends), starts - base, ends - base, first


def myers(pattern: list[int], text: list[int]) -> list[int]:
    """For each end in the text, the edit distance of the pattern to the nearest run of the text that ends there."""
    m = len(pattern)
    equal: dict[int, int] = defaultdict(int)
    for i, symbol in enumerate(pattern):
        equal[symbol] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = mask, 0, m, []
    for symbol in text:
        eq = equal.get(symbol, 0)
        diagonal = ((eq & up) + up ^ up) | eq | down
        plus = down | ~(diagonal | up) & mask
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & mask
        minus = minus << 1 & mask
        vertical = eq | down
        up = minus | ~(vertical | plus) & mask
        down = plus & vertical
        out.append(score)
    return out


class Items:
    """The items of one block: their words, budgets and an index of their pieces."""

    def __init__(self, item_ids: list[int | None], column: pa.Array, rate: float = RATE, least_words: int = LEAST_WORDS):
        hashes, _, _, first = normal_words(column)
        self.ids, self.words, self.budgets = [], [], []
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for row, item_id in enumerate(item_ids):
            own = hashes[first[row] : first[row + 1]]
            m = len(own)
            if not m:
                continue
            budget = int(rate * m + 1e-9) if m >= least_words else 0
            cuts = [round(k * m / (budget + 1)) for k in range(budget + 2)]
            keys = _window_sums(own, np.array(cuts[:-1]), np.array(cuts[1:]))
            for a, b, key in zip(cuts, cuts[1:], keys.tolist(), strict=False):
                pieces[b - a][key].append((len(self.ids), a))
            self.ids.append(item_id)
            self.words.append(own.tolist())
            self.budgets.append(budget)
        self.pieces = {n: dict(p) for n, p in pieces.items()}
        self.sieves = {}
        for n, p in self.pieces.items():
            sieve = np.zeros(1 << 22, dtype=bool)
            sieve[np.fromiter(p, np.uint64, len(p)) >> np.uint64(42)] = True
            self.sieves[n] = np.packbits(sieve)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, word at which the item would begin) for each exact hit of a piece."""
        counts = np.diff(first)
        for n, index in self.pieces.items():
            windows = np.maximum(counts - n + 1, 0)
            at = ranges(first[:-1], windows)
            keys = _window_sums(hashes, at, at + n)
            slot = (keys >> np.uint64(42)).astype(np.int64)
            maybe = np.flatnonzero(np.unpackbits(self.sieves[n]).view(bool)[slot]) if len(slot) else []
            docs = np.repeat(np.arange(len(counts)), windows)[maybe]
            for doc, word, key in zip(docs.tolist(), at[maybe].tolist(), keys[maybe].tolist(), strict=True):
                for item, shift in index.get(key, ()):
                    yield doc, item, word - int(first[doc]) - shift

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, distance, first word, end word) for the best place of each item in each document."""
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for doc, item, begin in self.hits(hashes, first):
            places[doc, item].add(begin)
        for (doc, item), begins in sorted(places.items()):
            words, budget = self.words[item], self.budgets[item]
            low, size = int(first[doc]), int(first[doc + 1] - first[doc])
            best, reach = None, -1
            for begin in sorted(begins):
                a, b = max(0, begin - budget), min(size, begin + len(words) + budget)
                if b <= reach:
                    continue
                own = hashes[low + a : low + b].tolist()
                scores = myers(words, own)
                score = min(scores, default=budget + 1)
                if score <= budget and (best is None or score < best[0]):
                    end = scores.index(score) + 1
                    back = myers(words[::-1], own[:end][::-1])
                    best = (score, a + end - 1 - back.index(score), a + end)
                    if not score:
                        break
                reach = b if b - a >= size else reach
            if best:
                yield doc, item, *best


def _blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of about ``most_bytes`` of text at most."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // most_bytes)
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield own.toArrow()


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that match: the distance in words, the budget, and the place in code points."""
    spark, source = docs.sparkSession, docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(benchmark, most_bytes):
        shared = spark.sparkContext.broadcast(Items(block.column("item_id").to_pylist(), block.column("text").combine_chunks(), rate, least_words))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    hashes, starts, ends, first = normal_words(part.column("text"))
                    doc_ids = part.column("doc_id").to_pylist()
                    rows = [
                        (doc_ids[d], items.ids[i], distance, len(items.words[i]), items.budgets[i], int(starts[first[d] + a]), int(ends[first[d] + b - 1]))
                        for d, i, distance, a, b in items.matches(hashes, first)
                    ]
                    if rows:
                        types = [pa.int64()] * 2 + [pa.int32()] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        found = source.mapInArrow(task, SCHEMA)
        out = found if not out.columns or out.isLocal() else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that match no item, with all of their columns."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, most_bytes):
        shared = spark.sparkContext.broadcast(Items(block.column("item_id").to_pylist(), block.column("text").combine_chunks(), rate, least_words))
        docs = docs.where(_clean(shared)(F.col("text").cast("string")))
    return docs


def _clean(shared):
    """A function of a text column: whether no item of the broadcast block matches."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        keep = np.ones(len(texts), dtype=bool)
        at = 0
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE):
            hashes, _, _, first = normal_words(part.column("text"))
            keep[[at + m[0] for m in shared.value.matches(hashes, first)]] = False
            at += part.num_rows
        return pa.array(keep)

    return clean
