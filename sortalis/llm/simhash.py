"""Near-duplicate groups of documents by SimHash fingerprints.

Method: a fingerprint has 64 bits, each the majority of that bit over the XXH64 values of a document's
word shingles.  Fingerprints within the radius of each other are linked.  With radius 3 and five bit
blocks, two linked fingerprints agree on two whole blocks at least, so each of the ten pairs of blocks
is a table of buckets that together miss no link.  A bucket is compared bit-sliced: 64 fingerprints lie
vertically in one machine word per bit plane; differing bits are added for all 64 at once by carry-save
counters, and a word is abandoned once all of its fingerprints exceed the radius.  From each comparison
only a spanning forest comes out, never all pairs.

Skew: exact copies share a fingerprint and count once.  A bucket over ``most_in_cell`` fingerprints is
split into blocks that are compared pair by pair in cells of their own.

Defined cases: a text that is null or has no word has fingerprint zero and is linked like any other;
rows that share a doc_id are kept; component_id is null only if no linked row has a doc_id; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortalis.llm.blobs import find
from sortalis.llm.textcols import ASCII_LOWER, claim, fresh, ranges, slices, text_buffer, words
from sortalis.operators.components import connected_components
from sortalis.sources.shared import exists, mapped, new_folder, write_file, written

SLICE = 1 << 20  # bytes of text that a worker takes at a time
SEED, RADIUS, BLOCKS, HOT = 42, 3, (13, 13, 13, 13, 12), 10_000


def fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """The fingerprints of a text column, unsigned."""
    raw, offsets = text_buffer(column)
    raw = ASCII_LOWER[raw]
    starts, ends, first = words(raw, offsets)
    n_docs, counts = len(offsets) - 1, np.diff(first)
    out = np.zeros(n_docs, np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts + 1  # with the space after the word
    ends_in = np.cumsum(lengths)
    joined = np.full(ends_in[-1], 32, np.uint8)
    body = ranges(starts, lengths - 1)
    joined[body + np.repeat(ends_in - lengths - starts, lengths - 1)] = raw[body]
    begins, stops = ends_in - lengths, ends_in - 1
    shingles = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    head = ranges(first[:-1], shingles)
    tail = head + np.repeat(np.minimum(counts, shingle) - 1, shingles)
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begins[head].tolist(), stops[tail].tolist(), strict=True)), np.uint64, len(head))
    full = np.flatnonzero(shingles)
    bounds = np.cumsum(shingles[full])
    for at in range(0, len(full), 4096):  # bounded memory: the bits of some documents at a time
        part = full[at : at + 4096]
        low = bounds[at] - shingles[part[0]]
        out[part] = _majority(hashes[low : bounds[min(at + 4096, len(full)) - 1]], shingles[part])
    return out


def _majority(hashes: np.ndarray, counts: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """For each run of counts[i] values, the bits set in over half of them."""
    totals = np.zeros((len(counts), 64), np.int64)
    run = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = run[at : at + step]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        totals[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(totals * 2 > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[b][w]: bit b of the values 64 w to 64 w + 63, one value to each bit of the word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of indexes with queries[i] and values[j] at most ``radius`` bits apart, some queries at a time."""
    planes = bit_planes(values)
    width = planes.shape[1]
    size = int(radius).bit_length()
    ahead = (1 << size) - 1 - radius  # the counters start here, so that they overflow just beyond the radius
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(queries), step := max(1, most // max(1, width))):
        some = queries[at : at + step]
        query = np.repeat(np.arange(len(some)), width)
        word = np.tile(np.arange(width), len(some))
        counters = [np.full(len(query), last if ahead >> k & 1 else np.uint64(0)) for k in range(size)]
        over = np.zeros(len(query), np.uint64)
        for b in range(64):
            carry = planes[b][word] ^ (np.uint64(0) - (some[query] >> np.uint64(b) & np.uint64(1)))
            for k in range(size):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                alive = np.flatnonzero(over != last)
                if len(alive) < 0.7 * len(query):
                    query, word, over = query[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(query):
                    break
        found = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, bit = np.nonzero(found)
        j = word[pair] * 64 + bit
        inside = j < len(values)
        yield query[pair][inside] + at, j[inside]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, least value of its group) that connect all of left (and right) as the near pairs do."""
    values = left if right is None else np.concatenate([left, right])
    group = np.arange(len(values))
    shift = 0 if right is None else len(left)
    for i, j in near(left, left if right is None else right, radius):
        j = j + shift
        i, j = i[i != j], j[i != j]
        while len(i):
            low = np.minimum(group[i], group[j])
            high = np.maximum(group[i], group[j])
            apart = low != high
            if not apart.any():
                break
            i, j, low, high = i[apart], j[apart], low[apart], high[apart]
            np.minimum.at(group, high, low)
            while (group[group] != group).any():
                group = group[group]
    moved = np.flatnonzero(group != np.arange(len(values)))
    return values[moved], values[group[moved]]


def _buckets(nodes: DataFrame, blocks: tuple[int, ...], agree: int) -> DataFrame:
    """A row (table, key, fp) for each choice of ``agree`` blocks."""
    shifts = np.cumsum((0, *blocks))
    masks = [((1 << w) - 1) << int(s) for w, s in zip(blocks, shifts, strict=False)]
    tables = [sum(masks[i] for i in c) for c in combinations(range(len(blocks)), agree)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in tables]
    rows = F.array(*[F.struct(F.lit(t).cast("int").alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])
    return nodes.select("fp", F.explode(rows).alias("x")).select("x.table", "x.key", "fp")


def links(nodes: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS, most_in_cell: int = 2048) -> DataFrame:
    """Rows (a, b) of fingerprints that connect what lies within the radius; nodes: distinct ``fp`` longs."""
    rows = _buckets(nodes, blocks, len(blocks) - radius)
    counts = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = counts.select("table", "key", F.ceil(F.col("n") / F.lit(most_in_cell)).cast("int").alias("k"))
    own = rows.join(parts, ["table", "key"]).withColumn("block", F.expr("pmod(xxhash64(fp), k)"))
    cells = own.select("table", "key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cells = cells.select("table", "key", F.least("block", "other").cast("int").alias("low"), F.greatest("block", "other").cast("int").alias("high"), F.expr("block > other").alias("second"), "fp")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, fps, second in _runs(batches):
            left = right = fps
            if cell[2] != cell[3]:
                left, right = fps[~second], fps[second]
                if not len(left) or not len(right):
                    continue
            a, b = forest(left, None if left is right else right, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keys = ["table", "key", "low", "high"]
    # an explicit number of partitions: these rows are few but costly, so they must not be coalesced by size
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(task, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """The rows of each cell, from batches sorted by cell."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        second, fps = batch.column("second").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64)
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            cell = tuple(int(c[a]) for c in columns)
            if cell != current:
                if held:
                    yield current, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                current, held = cell, []
            held.append((fps[a:b], second[a:b]))
    if held:
        yield current, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def fingerprinted(docs: DataFrame, column: str) -> DataFrame:
    """The documents with their fingerprints in another column."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        claim("simhash")
        table = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *[fingerprints(s.column("text")) for s in slices(table, "text", SLICE)]]).view(np.int64))

    return docs.withColumn(column, of(F.col("text").cast("string")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, fingerprint, component_id, root), one for each row of the documents; root is the component's least fp."""
    marked = written(fingerprinted(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "fp").select("doc_id", "fp"), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius))
    linked = written(nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "least"), "linked")
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    linked = _spread(linked.select("fp", "root"), groups, "root")
    classes = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    rows = _spread(marked, written(classes, "classes"), "fp")
    return rows.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def _spread(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The rows with the values of their key; ``values`` has each key once, with the number ``n`` of its rows.

    A key of more than one in HOT of all rows is hot.  There are HOT hot ones at most, so these are broadcast, and no
    task gets the rows of one.
    """
    most, extra = rows.count() // HOT, [c for c in values.columns if c not in (key, "n")]
    hot = values.where(F.col("n") > most).select(key, F.struct(*extra).alias("found"))
    tagged = rows.join(F.broadcast(hot), key, "left")
    cold = tagged.where("found is null").select(*rows.columns).join(values.where(F.col("n") <= most).drop("n"), key)
    return cold.unionByName(tagged.where("found is not null").select(*rows.columns, *[F.col("found").getField(c).alias(c) for c in extra]))


def one_of_each_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents that stay when each group keeps the row with the smallest doc_id, the first of those that repeat.

    The rows are written once with their fingerprint and their place (the number of the part that a task wrote, and
    of the row in it).  Groups are decided on by fingerprints alone; what comes back is a sorted array of the kept
    places of each part, as a file in the shared folder.  So no text is shuffled, and a task maps the arrays of the
    parts it reads only.
    """
    fp, place = fresh("fp", docs.columns), fresh("place", docs.columns)
    marked = written(fingerprinted(docs, fp).withColumn(place, F.monotonically_increasing_id()), "marked", compression="zstd")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(place).alias("place"))
    nodes = marked.select(F.col(fp).alias("fp"), key.alias("k")).groupBy("fp").agg(F.min("k").alias("k"))
    nodes = written(nodes.select("fp", "k"), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius))
    kept = nodes.join(roots, nodes.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("k").alias("k"))
    folder = new_folder(docs.sparkSession, "kept")
    places = kept.select(F.expr("shiftright(k.place, 33)").alias("part"), F.col("k.place").alias("place")).repartition("part").sortWithinPartitions("part", "place")
    places.mapInArrow(lambda batches: _write_places(batches, folder), "part long").count()

    @F.arrow_udf("boolean")
    def stays(places: pa.Array) -> pa.Array:
        claim("simhash", _PLACES.clear)
        own = places.to_numpy()
        out = np.zeros(len(own), dtype=bool)
        part = own >> 33
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            out[at] = find(_kept_places(folder, p), own[at]) >= 0
        return pa.array(out)

    return marked.where(stays(F.col(place))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _write_places(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the kept places of each part, from batches sorted by part and place."""
    current, held = None, []

    def flush() -> None:
        if current is not None:
            write_file(f"{folder}/{current}.i64", lambda out: out.write(np.concatenate(held).tobytes()))

    for batch in batches:
        part, place = batch.column("part").to_numpy(), batch.column("place").to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if part[a] != current:
                    flush()
                    current, held = int(part[a]), []
                held.append(place[a:b])
        yield pa.RecordBatch.from_arrays([batch.column("part")], names=["part"])
    flush()


_PLACES: dict[str, np.ndarray] = {}


def _kept_places(folder: str, part: int) -> np.ndarray:
    """The kept places of a part; a part of which nothing stays has no file."""
    name = f"{folder}/{part}.i64"
    if name not in _PLACES:
        if len(_PLACES) > 64:
            _PLACES.clear()
        _PLACES[name] = mapped(name, np.int64) if exists(name) else np.zeros(0, np.int64)
    return _PLACES[name]
