"""Language-model scores of documents by an interpolated modified Kneser-Ney model of order two or three.

Method: the model is counted in Spark and stored as sorted hash arrays in the shared folder, which
scoring workers map into memory.  Jobs build it one after the other, each sending compact blobs to shards:

1. words: XXH64 values of the distinct words with their counts; a word's rank in this order is its number;
2. bigrams: the pair of word numbers, spread by a bijective finaliser, with its count;
3. of order three, trigrams: they meet in the shard of the pair that is their context, as that pair's
   position there and the third word's number, and leave beside it how many followers it has once, twice
   and more often; a job of its own then gives each pair the number of distinct words before it;
4. the shards of the bigrams count, for each first word, its total and its distinct followers seen once, twice
   and more often, and, for each second word, its distinct predecessors; these partial counts meet in the
   shards of the words, as arrays beside the words.

The highest order takes raw counts, a lower one the number of distinct words before an n-gram.  Only sums
(tokens, types, counts of counts) and sizes of shards reach the driver.  An n-gram's probability is its
discounted share plus the freed mass times the probability of its last word at the order below; that of a
single word is discounted alike and interpolated with the uniform distribution over the vocabulary and one
unknown word.  A context that was never seen passes to the order below.
Counts may be of any size; a word's number has 32 bits, so that a pair is one 64-bit key, and ``trained``
raises ValueError beyond 4,294,967,294 distinct words.

A text is lower-cased in A-Z; its tokens are the words and one end; start marks come before the first.

Defined cases: a null text is empty, so it has the end alone; without training rows the vocabulary is
empty and every token has probability one; rows that repeat count as often as they occur; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.llm.blobs import bits_for, even_edges, find, in_parts, pack_counts, pack_keys, shard_bounds, shard_edges, summed, unpack_counts, unpack_keys
from sortalis.llm.textcols import ASCII_LOWER, distinct_word_hashes, mixed, slices, text_buffer, words
from sortalis.sources.shared import mapped, new_folder, write_file

SLICE = 8 << 20
END = np.uint64(0x656E642D6F662D74)  # the key of the end of a text, as if it were a word's hash
START = np.uint64((1 << 32) - 1)  # the number of the start mark; words have smaller ones
SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
CONTEXT = ("total", "once", "twice", "more", "before")
BLOBS = "shard int, n int, keys binary, counts binary"
STARTS = mixed(np.array([START << np.uint64(32) | START]))[0]  # the pair before the first token
LOW = np.uint64(0xFFFFFFFF)
CHUNK = 1 << 20  # trigrams taken at a time


def unmixed(values: np.ndarray) -> np.ndarray:
    """What ``mixed`` made the values of."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31) ^ x >> np.uint64(62)
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= x >> np.uint64(27) ^ x >> np.uint64(54)
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= x >> np.uint64(30) ^ x >> np.uint64(60)
    return x


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, index, first): the distinct keys in order, the index there of each text's words and its end; document d has tokens first[d] to first[d + 1]."""
    raw, offsets = text_buffer(column)
    raw = ASCII_LOWER[raw]
    starts, ends, first = words(raw, offsets)
    hashes, index = distinct_word_hashes(raw, starts, ends)
    if len(column):
        hashes = np.append(hashes, END)
    keys, rank = np.unique(hashes, return_inverse=True)
    return keys, np.insert(rank[index], first[1:], rank[-1] if len(column) else 0), first + np.arange(len(first))


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams have the counts one to four; 0.5, 1 and 1.5 where these give none."""
    one, two, three, four = counts_of_counts
    if not (one and two and three):
        return 0.5, 1.0, 1.5
    y = one / (one + 2 * two)
    raw = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
    return tuple(min(max(d, 0.0), k) for k, d in enumerate(raw, 1))


def cut(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    one, two, three = by
    return np.maximum(counts - np.select([counts >= 3, counts >= 2, counts >= 1], [three, two, one], 0.0), 0)


def backoff(total: np.ndarray, seen: list[np.ndarray], by: tuple[float, float, float]) -> np.ndarray:
    """The share of a context's mass that the discounts free, from its followers seen once, twice and more; one where it has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, sum(d * n for d, n in zip(by, seen, strict=True)) / total, 1.0)


@dataclass
class Model:
    """The numbers of a counted model and the folder of its arrays; workers map a shard when they first need it."""

    folder: str
    bits: int
    bases: np.ndarray  # the number of the first word of each shard, and at last how many words there are
    train_tokens: int
    order: int = 2
    pair_sizes: np.ndarray = None  # how many bigrams each shard has
    triple_sizes: np.ndarray = None  # and how many trigrams
    trigram_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    bigram_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    pairs: int = 0  # distinct bigrams
    freed: float = 0.0  # mass that the discounts of continuation counts free
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    @property
    def types(self) -> int:
        return int(self.bases[-1])

    @property
    def word_bits(self) -> np.uint64:
        """The bits of a word's number."""
        return np.uint64(max(1, self.types.bit_length()))

    def array(self, name: str, shard: int, dtype: type) -> np.ndarray:
        key = (name, shard)
        if key not in self._open:
            self._open[key] = mapped(f"{self.folder}/{name}/{shard}.bin", dtype).view(np.ndarray)
        return self._open[key]

    def counts(self, name: str, shard: int, n: int, at: np.ndarray) -> np.ndarray:
        """Those at some positions of the n counts of a file: a byte each, 255 for the large ones, whose positions and values follow."""
        raw = self.array(name, shard, np.uint8)
        out = raw[at].astype(np.float64)
        large = np.flatnonzero(out == 255)
        if len(large):
            rest = raw[n + -n % 8 :].view(np.uint64)
            places, values = rest[: len(rest) // 2], rest[len(rest) // 2 :]
            out[large] = values[np.searchsorted(places, at[large].astype(np.uint64))]
        return out

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of sorted distinct word keys, -1 for the unknown."""
        out = np.full(len(keys), -1, np.int64)
        shards, bounds = shard_bounds(keys, self.bits)
        for s, a, b in zip(shards.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = find(self.array("words", s, np.uint64), keys[a:b]) if self.bases[s + 1] > self.bases[s] else np.full(b - a, -1)
            out[a:b] = np.where(at >= 0, at + self.bases[s], -1)
        return out

    def of_words(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """The values that an array beside the words has for sorted word numbers."""
        shards = np.searchsorted(self.bases, numbers, side="right") - 1
        out = np.zeros(len(numbers), np.float64)
        heads = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(numbers) else []
        for a, b in zip(heads, np.append(heads, len(numbers))[1:], strict=True):
            s = int(shards[a])
            out[a:b] = self.counts(name, s, int(self.bases[s + 1] - self.bases[s]), numbers[a:b] - self.bases[s])
        return out

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """The positions of sorted bigram keys in their shards, -1 for the unseen."""
        out = np.full(len(keys), -1, np.int64)
        shards, bounds = shard_bounds(keys, self.bits)
        for s, a, b in zip(shards.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if self.pair_sizes[s]:
                out[a:b] = find(self.array("bigrams", s, np.uint64), keys[a:b])
        return out

    def of_pairs(self, names: tuple[str, ...], keys: np.ndarray, positions: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The values that arrays beside the bigrams have for sorted keys; 0 for the unseen and in a shard of size 0."""
        out = [np.zeros(len(keys)) for _ in names]
        shards, bounds = shard_bounds(keys, self.bits)
        for s, a, b in zip(shards.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            known = np.flatnonzero(positions[a:b] >= 0) if sizes[s] else []
            if len(known):
                for values, name in zip(out, names, strict=True):
                    values[a:b][known] = self.counts(name, s, int(self.pair_sizes[s]), positions[a:b][known])
        return out

    def trigram_counts(self, contexts: np.ndarray, positions: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The counts of sorted trigrams, each the index of its context among sorted known keys and the third word's number."""
        out, index = np.zeros(len(asked)), (asked >> self.word_bits).astype(np.int64)
        word = asked & ((np.uint64(1) << self.word_bits) - np.uint64(1))
        shards, bounds = shard_bounds(contexts[index], self.bits)
        for s, a, b in zip(shards.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if self.triple_sizes[s]:
                at = find(self.array("trigrams", s, np.uint64), positions[index[a:b]].astype(np.uint64) << self.word_bits | word[a:b])
                known = np.flatnonzero(at >= 0)
                out[a:b][known] = self.counts("trigram_counts", s, int(self.triple_sizes[s]), at[known])
        return out

    def score(self, column: pa.Array) -> pa.RecordBatch:
        """n_tokens, n_known, base_score and score of each text."""
        distinct, index, first = tokens(column)
        n = len(first) - 1
        number = self.numbers(distinct)
        known = np.flatnonzero(number >= 0)
        count, before = np.zeros(len(distinct)), np.zeros(len(distinct))
        context = {k: np.zeros(len(distinct) + 1) for k in CONTEXT[:4]}  # the last is the start mark
        count[known] = self.of_words("word_counts", number[known])
        before[known] = self.of_words("before", number[known])
        for name, values in context.items():
            values[:-1][known] = self.of_words(name, number[known])
            values[-1] = self.array(f"start_{name}", 0, np.uint64)[0] if self.pairs else 0
        base = np.log10((count + 0.5) / (self.train_tokens + 0.5 * (self.types + 1)))
        lower = cut(before, self.word_discounts) / max(self.pairs, 1) + (self.freed if self.pairs else 1.0) / (self.types + 1)
        heads = first[:-1]
        previous = np.append(len(distinct), index[:-1])
        previous[heads] = len(distinct)
        numbers = np.append(number, int(START))
        pair = pair_keys(numbers[previous], number[index])
        both = (numbers[previous] >= 0) & (number[index] >= 0)
        asked, back = np.unique(np.append(pair[both], STARTS), return_inverse=True)
        at = self.positions(asked) if self.pairs else np.full(len(asked), -1)
        where = np.full(len(pair), -1, np.int64)  # the index of a token's pair among the asked
        where[both], starts = back[:-1], back[-1]
        seen = np.zeros(len(pair))
        if self.pairs:
            seen[both] = self.of_pairs(("bigram_counts" if self.order == 2 else "pair_before",), asked, at, self.pair_sizes)[0][back[:-1]]
        total = context["total"]
        freed = backoff(total, [context[k] for k in CONTEXT[1:4]], self.bigram_discounts)
        probability = np.where(total[previous] > 0, cut(seen, self.bigram_discounts) / np.maximum(total[previous], 1), 0.0) + freed[previous] * lower[index]
        if self.order == 3 and self.pairs:
            wider = np.append(starts, where[:-1])  # the context of a token is the pair that ends before it
            wider[heads] = starts
            names = ("bigram_counts", "pair_once", "pair_twice", "pair_more")
            total, *followers = self.of_pairs(names[:1], asked, at, self.pair_sizes) + self.of_pairs(names[1:], asked, at, self.triple_sizes)
            total[sum(followers) == 0] = 0  # a pair that ends a text has no follower
            freed = backoff(total, followers, self.trigram_discounts)
            usable = np.flatnonzero((wider >= 0) & (total[wider] > 0))
            inside = usable[number[index[usable]] >= 0]
            triples, again = np.unique(wider[inside].astype(np.uint64) << self.word_bits | number[index[inside]].astype(np.uint64), return_inverse=True)
            seen = np.zeros(len(pair))
            seen[inside] = self.trigram_counts(asked, at, triples)[again]
            probability[usable] = cut(seen[usable], self.trigram_discounts) / total[wider[usable]] + freed[wider[usable]] * probability[usable]
        score = np.log10(probability)
        n_tokens = np.diff(first)
        sums = [np.add.reduceat(x, heads) if n else np.zeros(0) for x in ((count > 0).astype(np.int64)[index], base[index], score)]
        return n_tokens, sums[0].astype(np.int64), sums[1], sums[2]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The keys of pairs of word numbers."""
    return mixed(left.astype(np.uint64) << np.uint64(32) | (right.astype(np.uint64) & LOW))


def _blobs(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shards.astype(np.int32)),
            pa.array([b - a for a, b in cuts], pa.int32()),
            pa.array([pack_keys(keys[a:b]) for a, b in cuts], pa.binary()),
            pa.array([pack_counts(counts[a:b]) for a, b in cuts], pa.binary()),
        ],
        names=["shard", "n", "keys", "counts"],
    )


Edges = Callable[[int], Callable[[int], np.ndarray]]


def _merged(batches: Iterator[pa.RecordBatch], edges: Edges, columns: int = 1) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(shard, parts) of each shard of a task; a part is a range of keys: its two edges, its keys, and a row of counts for each column.

    Blobs are held at nine bytes a key or so and joined part by part.  With several columns the blobs of counts follow one another.
    """
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            counts = unpack_counts(row["counts"], row["n"] * columns).reshape(columns, -1)
            held.setdefault(row["shard"], []).append((unpack_keys(row["keys"]), counts if (counts > 255).any() else counts.astype(np.uint8)))
    for shard in sorted(held):
        yield shard, _parts(held.pop(shard), edges(shard))


def _parts(runs: list[tuple[np.ndarray, np.ndarray]], edges: Callable[[int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i, parts, (keys, counts) in in_parts(runs, edges):
        yield edges(parts)[i : i + 2], keys, counts.astype(np.uint64)


class Counts:
    """Counts taken part by part, in a byte each, the large ones apart; a file of them is what ``Model.counts`` reads."""

    def __init__(self):
        self.n, self.small, self.places, self.values = 0, [], [], []

    def add(self, counts: np.ndarray) -> None:
        large = np.flatnonzero(counts >= 255)
        self.small.append(np.minimum(counts, 255).astype(np.uint8))
        self.places.append((large + self.n).astype(np.uint64))
        self.values.append(counts[large].astype(np.uint64))
        self.n += len(counts)

    def write(self, uri: str) -> None:
        parts = [*self.small, np.zeros(-self.n % 8, np.uint8), *self.places, *self.values]
        write_file(uri, lambda out: [out.write(x.tobytes()) for x in parts])


def _write_summed(folder: str, names: tuple[str, str], shard: int, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], then: Callable) -> None:
    """Writes the distinct keys of a shard and the sums of their counts; ``then`` is given (edges, keys, counts) of each part."""
    kept = Counts()

    def write(out: BinaryIO) -> None:
        for ends, keys, counts in parts:
            keys, counts = summed(keys, counts[0])
            out.write(keys.tobytes())
            kept.add(counts)
            then(ends, keys, counts)

    write_file(f"{folder}/{names[0]}/{shard}.bin", write)
    kept.write(f"{folder}/{names[1]}/{shard}.bin")


@contextmanager
def _brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each job's shuffle files go as it ends, since what it leaves are files in the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def trained(docs: DataFrame, order: int = 2) -> Model:
    """Counts the model over all rows of the documents."""
    if order not in (2, 3):
        raise ValueError("the order is two or three")
    with _brief_shuffles(docs.sparkSession):
        return _trained(docs, order)


def _trained(docs: DataFrame, order: int) -> Model:
    spark = docs.sparkSession
    folder, bits = new_folder(spark, "model"), bits_for(docs)
    texts = docs.selectExpr("cast(text as string) text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                keys, index, _ = tokens(part.column("text"))
                yield _blobs(keys, np.bincount(index, minlength=len(keys)), *shard_bounds(keys, bits))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _merged(batches, by_key):
            seen: list[tuple[int, int]] = []
            _write_summed(folder, ("words", "word_counts"), shard, parts, lambda _, keys, counts, seen=seen: seen.append((len(keys), int(counts.sum()))))
            types, n = np.sum(seen, axis=0).tolist()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "types": [types], "tokens": [n]})

    def by_key(shard: int) -> Callable[[int], np.ndarray]:
        return shard_edges(shard, bits)

    def by_shard(frame: DataFrame) -> DataFrame:
        return frame.repartitionById(1 << bits, F.col("shard"))

    def by_number(rows: list, column: str) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for r in rows:
            out[r.shard] = r[column]
        return out

    sizes = by_shard(texts.mapInArrow(count_words, BLOBS)).mapInArrow(write_words, "shard int, types long, tokens long").collect()
    model = Model(folder, bits, np.append(0, np.cumsum(by_number(sizes, "types"))), sum(r.tokens for r in sizes), order)
    if model.types >= int(START):
        raise ValueError("more distinct words than 32-bit numbers")
    if not model.types:
        return model
    bases = model.bases

    def paired(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, keys of the pairs that end there, where texts begin) of all tokens."""
        distinct, index, first = tokens(column)
        number = model.numbers(distinct)[index].astype(np.uint64)
        previous = np.append(START, number[:-1])
        previous[first[:-1]] = START
        return number, pair_keys(previous, number), first[:-1]

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, pair, heads = paired(part.column("text"))
                pairs, counts = np.unique(np.append(pair, np.full(len(heads) if order == 3 else 0, STARTS)), return_counts=True)
                yield _blobs(pairs, counts, *shard_bounds(pairs, bits))

    def around_words(keys: np.ndarray, counts: np.ndarray, shard: int) -> pa.RecordBatch:
        """What some bigrams of a shard, with their counts at that order, add to the words around them; pairs without a count add nothing."""
        size = len(keys)
        keys, counts = keys[counts > 0], counts[counts > 0]
        pairs = unmixed(keys)
        left, right = pairs >> np.uint64(32), pairs & LOW
        both = np.concatenate([left, right])
        zeros = np.zeros(len(keys), np.uint64)
        values = np.stack([np.append(c.astype(np.uint64), zeros) for c in (counts, counts == 1, counts == 2, counts >= 3)] + [np.append(zeros, zeros + np.uint64(1))])
        rank = np.argsort(both, kind="stable")
        both, values = both[rank], values[:, rank]
        heads = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        both, values = both[heads], np.add.reduceat(values, heads, axis=1) if len(heads) else values
        target = np.where(both == START, 0, np.searchsorted(bases, both, side="right") - 1)
        # the first row has the counts of counts and how many bigrams these are, and no n-gram
        body = {"shard": [0], "n": [0], "keys": [b""], "counts": [b""], "seen": [[int((counts == k).sum()) for k in range(1, 5)] + [len(keys), shard, size]]}
        plain = both != START
        for which in (plain, ~plain):  # the start mark goes to shard 0, in a row of its own
            own, vals, to = both[which], values[:, which], target[which]
            heads = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(own) else []
            for a, b in zip(heads, np.append(heads, len(own))[1:], strict=True):
                body["shard"].append(int(to[a]))
                body["n"].append(int(b - a))
                body["keys"].append(pack_keys(own[a:b]))
                body["counts"].append(pack_counts(vals[:, a:b].ravel()))
                body["seen"].append(None)
        return pa.RecordBatch.from_pydict(body, schema=pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("seen", pa.list_(pa.int64()))]))

    def write_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _merged(batches, by_key):
            out: list[pa.RecordBatch] = []
            sizes: list[int] = []

            def then(_: np.ndarray, keys: np.ndarray, counts: np.ndarray, shard: int = shard, out: list = out, sizes: list = sizes) -> None:
                sizes.append(len(keys))
                if order == 2:
                    out.append(around_words(keys, counts, shard))

            _write_summed(folder, ("bigrams", "bigram_counts"), shard, parts, then)
            yield from out if order == 2 else [pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [sum(sizes)]})]

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model.word_bits
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                number, pair, heads = paired(part.column("text"))
                context = np.append(STARTS, pair[:-1])
                context[heads] = STARTS
                asked, back = np.unique(context, return_inverse=True)
                at = model.positions(asked).astype(np.uint64)
                triples, counts = np.unique(back.astype(np.uint64) << width | number, return_counts=True)
                index = (triples >> width).astype(np.int64)
                shards, bounds = shard_bounds(asked[index], bits)
                yield _blobs(at[index] << width | (triples & ((np.uint64(1) << width) - np.uint64(1))), counts, shards, bounds)

    def write_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _merged(batches, lambda s: lambda n: by_position(s)(n) << model.word_bits):
            followers = {name: Counts() for name in ("once", "twice", "more")}
            seen = np.zeros(5, np.int64)

            def then(ends: np.ndarray, keys: np.ndarray, counts: np.ndarray, followers: dict = followers, seen: np.ndarray = seen) -> None:
                low, high = (ends >> model.word_bits).astype(np.int64)
                at = (keys >> model.word_bits).astype(np.int64) - low
                for name, which in (("once", counts == 1), ("twice", counts == 2), ("more", counts >= 3)):
                    followers[name].add(np.bincount(at[which], minlength=high - low))
                seen[:] += [len(keys), *((counts == k).sum() for k in range(1, 5))]

            _write_summed(folder, ("trigrams", "trigram_counts"), shard, parts, then)
            for name, counts in followers.items():
                counts.write(f"{folder}/pair_{name}/{shard}.bin")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [int(seen[0])], "seen": [seen[1:].tolist()]})

    def by_position(shard: int) -> Callable[[int], np.ndarray]:
        return even_edges(0, int(model.pair_sizes[shard]))

    def count_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the pairs that end the trigrams of a shard, their positions in their own shards and how many words come before."""
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([0], pa.int32()), "keys": [b""], "counts": [b""]})
                keys = model.array("trigrams", shard, np.uint64) if model.triple_sizes[shard] else np.zeros(0, np.uint64)
                for a in range(0, len(keys), CHUNK):
                    part = keys[a : a + CHUNK]
                    middle = unmixed(model.array("bigrams", shard, np.uint64)[(part >> model.word_bits).astype(np.int64)]) & LOW
                    pairs, counts = np.unique(pair_keys(middle, part & ((np.uint64(1) << model.word_bits) - np.uint64(1))), return_counts=True)
                    yield _blobs(model.positions(pairs).astype(np.uint64), counts, *shard_bounds(pairs, bits))

    def write_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _merged(batches, by_position):
            if model.pair_sizes[shard]:
                kept, bigrams = Counts(), model.array("bigrams", shard, np.uint64)
                for ends, at, counts in parts:
                    low, high = ends.astype(np.int64)
                    before = np.bincount(at.astype(np.int64) - low, weights=counts[0], minlength=high - low).astype(np.uint64)
                    kept.add(before)
                    yield around_words(bigrams[low:high], before, shard)
                kept.write(f"{folder}/pair_before/{shard}.bin")

    def write_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.zeros(5, np.int64), []

        def noting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in batch.column("seen").to_pylist():
                    if s is not None:
                        seen[:] += s[:5]
                        sizes.extend(s[5:])
                yield batch

        around, freed = np.zeros(4, np.int64), np.zeros(3, np.int64)
        for shard, parts in _merged(noting(batches), lambda s: even_edges(int(bases[s]), int(bases[s + 1])), len(CONTEXT)):
            kept = {name: Counts() for name in CONTEXT}
            for ends, keys, values in parts:
                start = keys == START
                if start.any():
                    for name, v in zip(CONTEXT[:4], values[:4, start].sum(axis=1), strict=True):
                        write_file(f"{folder}/start_{name}/0.bin", lambda out, v=v: out.write(v.tobytes()))
                low, high = ends.astype(np.int64)
                at = keys[~start].astype(np.int64) - low
                for name, v in zip(CONTEXT, values[:, ~start], strict=True):
                    dense = np.bincount(at, weights=v, minlength=high - low).astype(np.uint64)
                    kept[name].add(dense)
                    if name == "before":
                        around += [(dense == k).sum() for k in range(1, 5)]
                        freed += [(dense == 1).sum(), (dense == 2).sum(), (dense >= 3).sum()]
            for name, counts in kept.items():
                counts.write(f"{folder}/{name}/{shard}.bin")
        names = ("seen", "around", "freed", "sizes")
        yield pa.RecordBatch.from_pydict(dict(zip(names, [[x.tolist()] for x in (seen, around, freed)] + [[sizes]], strict=True)), schema=pa.schema([(k, pa.list_(pa.int64())) for k in names]))

    bigrams = by_shard(texts.mapInArrow(count_bigrams, BLOBS))
    partial = f"{BLOBS}, seen array<long>"
    if order == 2:
        around = bigrams.mapInArrow(write_bigrams, partial)
    else:
        model.pair_sizes = by_number(bigrams.mapInArrow(write_bigrams, "shard int, n long").collect(), "n")
        rows = by_shard(texts.mapInArrow(count_trigrams, BLOBS)).mapInArrow(write_trigrams, "shard int, n long, seen array<long>").collect()
        model.triple_sizes = by_number(rows, "n")
        model.trigram_discounts = discounts(np.sum([r.seen for r in rows], axis=0).tolist())
        around = by_shard(spark.range(0, 1 << bits, 1, 1 << bits).mapInArrow(count_suffixes, BLOBS)).mapInArrow(write_before, partial)
    rows = by_shard(around).mapInArrow(write_context, "seen array<long>, around array<long>, freed array<long>, sizes array<long>").collect()
    seen, around, freed = (np.sum([r[k] for r in rows], axis=0).tolist() for k in range(3))
    sizes = np.array([x for r in rows for x in r.sizes], np.int64).reshape(-1, 2)
    model.pair_sizes = np.zeros(1 << bits, np.int64)
    np.add.at(model.pair_sizes, sizes[:, 0], sizes[:, 1])
    model.bigram_discounts, model.word_discounts, model.pairs = discounts(seen[:4]), discounts(around), seen[4]
    model.freed = sum(d * n for d, n in zip(model.word_discounts, freed, strict=True)) / seen[4]
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document with its scores, base-ten logarithms; perplexity is per token."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n, known, base, score = model.score(part.column("text"))
                columns = [part.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.train_tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(task, SCHEMA)
