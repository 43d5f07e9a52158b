import hashlib
import re
from collections import Counter

import pytest

from sortalis.llm import blobs
from sortalis.llm.substring import removed


def brute(rows, window):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("window", [1, 3, 35])
@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_equals_brute_force(name, window, request):
    docs = request.getfixturevalue(name)
    docs = docs[0] if name == "small" else docs
    want = brute(docs.select("doc_id", "text").collect(), window)
    got = removed(docs, window).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == want
    for r in got:
        assert sum(i.end - i.start for i in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False))
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_many_shards_of_one_partition(spark, small, monkeypatch):
    assert blobs.shard_bits(1) == 4 and blobs.shard_bits(200) == 8 and blobs.shard_bits(1, 100 << 30) == 10 and blobs.shard_bits(5000, 1) == 13
    monkeypatch.setattr(blobs, "SHARD_BYTES", 2000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert blobs.bits_for(small[0]) > 6
        got = removed(small[0], 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute(small[0].select("doc_id", "text").collect(), 3)


def test_no_rows(no_docs):
    assert removed(no_docs).count() == 0
