import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sortalis.llm.kneser_ney import discounts, scored, trained, unmixed
from sortalis.llm.textcols import mixed


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(train, rows, order=2):
    words, counts = Counter(), {order: Counter()}
    marked = lambda own: ["<s>"] * (order - 1) + own
    for t in train:
        own = tokens(t)
        words.update(own)
        counts[order].update(tuple(marked(own)[i : i + order]) for i in range(len(own)))
    for k in range(order, 1, -1):
        counts[k - 1] = Counter(g[1:] for g in counts[k])
    n, v = sum(words.values()), len(words)
    by = {k: discounts([sum(x == y for x in c.values()) for y in range(1, 5)]) for k, c in counts.items()}
    followers = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, x in c.items():
            followers[k][g[:-1]].append(x)
    total = {(k, g): sum(own) for k, f in followers.items() for g, own in f.items()}
    freed = {(k, g): sum(by[k][min(c, 3) - 1] for c in own) for k, f in followers.items() for g, own in f.items()}
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0

    def p(*gram):
        if not gram:
            return 1 / (v + 1)
        k, low = len(gram), p(*gram[1:])
        at = k, gram[:-1]
        return (cut(counts[k][gram], by[k]) + freed[at] * low) / total[at] if at in total else low

    out = []
    for doc_id, t in rows:
        own = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((doc_id, len(own), sum(w in words for w in own), n, base, sum(math.log10(p(*marked(own)[i : i + order])) for i in range(len(own)))))
    return out, p, [*words, "never seen"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_scores_equal_brute_force(name, order, request):
    docs = request.getfixturevalue(name)
    docs = docs[0] if name == "small" else docs
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    train = docs.where("coalesce(crc32(cast(doc_id as string)) % 5 <> 1, true)")
    want, p, vocabulary = brute([t for d, t in rows if d is None or not held(d)], rows, order)
    got = scored(docs, trained(train, order)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)
    if name == "small":
        assert sum(p(*("<s>", "the")[2 - order + 1 :], w) for w in vocabulary) == pytest.approx(1)
        out = [g for g in got if held(g[0])]
        assert sum(g.score for g in out) > sum(g.base_score for g in out)


@pytest.mark.parametrize("order", [2, 3])
def test_few_rows_leave_shards_empty(order, spark):
    train = [(1, "a b a c"), (2, "a b a b " * 300), (3, None), (4, "")]
    rows = [*train, (5, "b c b a d a"), (6, "c"), (7, "a b d a b")]
    want = brute([t for _, t in train], rows, order)[0]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got = {r[0]: tuple(r)[:6] for r in scored(frame(rows), trained(frame(train), order)).collect()}
    for w in want:
        assert got[w[0]][:4] == w[:4] and got[w[0]][4:] == pytest.approx(w[4:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_no_rows(order, no_docs, small):
    assert scored(no_docs, trained(small[0], order)).count() == 0
    got = scored(small[0], trained(no_docs, order)).collect()
    assert all(g.score == 0 and g.base_score == 0 and g.n_known == 0 and g.train_tokens == 0 for g in got)


def test_the_finaliser_is_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    assert (unmixed(mixed(x)) == x).all()


def test_other_orders_are_refused(small):
    with pytest.raises(ValueError):
        trained(small[0], 4)


def test_the_setting_of_shuffle_files_is_put_back(spark, small):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(Exception, match="missing"):
        trained(small[0].selectExpr("missing as text"))
    trained(small[0].where("doc_id < 3"), 3)
    assert spark.conf.get(name) == before


def test_counts_beyond_32_bits(tmp_path):
    from sortalis.llm.kneser_ney import Counts, Model

    for values in ([3, 1 << 33, 7], [3, 9, 7], [3, 9, 1 << 34]):
        kept = Counts()
        for part in (values[:2], [], values[2:]):
            kept.add(np.array(part, np.uint64))
        kept.write(f"{tmp_path}/word_counts/0.bin")
        model = Model(str(tmp_path), 4, np.append(0, np.full(16, 3)), 0)
        assert model.of_words("word_counts", np.array([0, 1, 2])).tolist() == values


@pytest.mark.parametrize("order", [2, 3])
def test_many_shards_of_one_partition(order, spark, small, monkeypatch):
    from sortalis.llm import blobs

    score = lambda: sorted((r.doc_id, round(r.score, 9)) for r in scored(small[0], trained(small[0], order)).collect())
    want, before = score(), spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(blobs, "SHARD_BYTES", 2000)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert score() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_join_to_the_whole(monkeypatch):
    from sortalis.llm import blobs
    from sortalis.llm.kneser_ney import _blobs, _merged

    monkeypatch.setattr(blobs, "PART", 37)
    random = np.random.default_rng(6)
    everything, total = random.integers(0, 1 << 64, 500, dtype=np.uint64), Counter()
    batches = []
    for _ in range(9):
        keys = np.unique(random.choice(everything, 200))
        counts = random.choice(np.array([1, 2, 300, 1 << 33], np.uint64), len(keys), p=[0.8, 0.17, 0.02, 0.01])
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        batches.append(_blobs(keys, counts, *blobs.shard_bounds(keys, 2)))
    got, most = {}, 0
    for shard, parts in _merged(iter(batches), lambda s: blobs.shard_edges(s, 2)):
        last = shard << 62
        for (low, high), keys, counts in parts:
            assert int(low) == last and all(low <= k <= high for k in keys)
            last, most = int(high), max(most, len(keys))
            keys, counts = blobs.summed(keys, counts[0])
            got |= dict(zip(keys.tolist(), counts.tolist(), strict=True))
        assert last == min((shard + 1) << 62, (1 << 64) - 1)
    assert got == total and list(got) == sorted(got) and most < 100
