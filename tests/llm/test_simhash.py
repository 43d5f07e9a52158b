import re

import numpy as np
import pytest
import xxhash

from sortalis.llm.simhash import forest, near, near_duplicates, one_of_each_group


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, radius=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_groups_equal_brute_force(name, request):
    docs = request.getfixturevalue(name)
    docs = docs[0] if name == "small" else docs
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r[1]) for r in rows]
    group = components(prints)
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(map(str, ((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group, strict=True))))
    got = near_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(group))
    assert {r.doc_id for r in kept.collect()} >= set(least.values())


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_comparison_is_exact(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    values[100:] = values[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    want = {(i, j) for i in range(70) for j in range(300) if int(values[i] ^ values[j]).bit_count() <= radius}
    got = {(int(i), int(j)) for a, b in near(values[:70], values, radius, most=40) for i, j in zip(a, b, strict=True)}
    assert got == want


def test_chain_in_one_bucket_is_one_group(spark, monkeypatch):
    from sortalis.llm import simhash

    chain, value = [], 0
    for i in range(30):
        chain.append(value)
        value ^= 7 << (i % 12)
    chain = sorted(set(chain))
    nodes = spark.createDataFrame([(v,) for v in chain], "fp long")
    edges = {tuple(r) for r in simhash.links(nodes, most_in_cell=4).collect()}
    group = components(chain)
    parent = {v: v for v in chain}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[find(a)] = find(b)
    assert len({find(v) for v in chain}) == len(set(group))


def test_forest_connects_two_sides():
    a, b = forest(np.array([0xFF, 0xFF << 40], np.uint64), np.array([0xFE, 0x7F << 40], np.uint64))
    assert len(a) == 2


def test_different_texts_under_one_id_all_stay(spark):
    texts = ["a quiet river bank near the old mill", "seven engines wait for coal in winter", "prices of grain fell again last week", "no two stars of that cluster look alike"]
    assert len(set(components([fingerprint(t) for t in texts]))) == 4
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3])]
    kept = one_of_each_group(spark.createDataFrame(rows + rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows))


def test_names_used_inside_may_be_columns(spark):
    rows = [(1, "a b c d", "x", "y", "z"), (2, "a b c d", "p", "q", "r")]
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, fp string, Place string, __fp string"))
    assert [tuple(r) for r in kept.collect()] == rows[:1] and kept.columns == ["doc_id", "text", "fp", "Place", "__fp"]


def test_a_hot_fingerprint_and_a_cold_one(spark, monkeypatch):
    from sortalis.llm import simhash

    monkeypatch.setattr(simhash, "HOT", 4)
    texts = ["same old story told again"] * 40 + [f"a quite different tale number {i} of {i * i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = components([fingerprint(t) for t in texts])
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {i: min(j for j, h in enumerate(group) if h == g) for i, g in enumerate(group)}
    assert sorted(r.doc_id for r in one_of_each_group(docs).collect()) == sorted(set(got.values()))


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert one_of_each_group(no_docs).count() == 0
