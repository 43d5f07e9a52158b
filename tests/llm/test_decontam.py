import random
import re

import numpy as np

from sortalis.llm.decontam import Items, contaminated, decontaminated, myers, normal_words


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best(pattern, text):
    """The least edit distance of the pattern to any run of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(docs, items, rate=0.2, least=5):
    out = []
    for d, t in docs:
        own = words(t)
        vocabulary = set(own)
        for i, x in items:
            item = words(x)
            budget = int(rate * len(item) + 1e-9)
            if len(item) >= least and sum(w in vocabulary for w in item) >= len(item) - budget and (score := best(item, own)) <= budget:
                out.append((d, i, score))
    return sorted(map(str, out))


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        pattern = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 60))]
        row = [0] * (len(text) + 1)
        for i, p in enumerate(pattern, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
            row = new
        assert myers(pattern, text) == row[1:]


def test_small_table(spark, sf_dir, small):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    got = contaminated(small[0], benchmark).collect()
    assert sorted(str((r.doc_id, r.item_id, r.distance)) for r in got) == brute(small[1], items)
    texts, by_id = dict(small[1]), dict(items)
    for r in got:
        assert best(words(by_id[r.item_id]), words(texts[r.doc_id][r.start : r.end])) == r.distance
    kept = decontaminated(small[0], benchmark)
    assert kept.columns == small[0].columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in small[1]} - {r.doc_id for r in got})


def test_edited_items(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 45)))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(80):
        text = rng.choices(vocabulary, k=60)
        own = items[d % 25][1].split()
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
        at = rng.randrange(60)
        docs.append((d, (", ".join(text[:at] + own + text[at:]) + ".").upper()))
    docs += [(100, None), (101, ""), (None, docs[0][1]), docs[0], docs[0]]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 30
    assert sorted(str((r.doc_id, r.item_id, r.distance)) for r in got) == want


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Blue whale sings"), (2, "今天天气很好我们去公园"), (3, "空が青い"), (4, "...")]
    docs = [(1, "There the blue whale sings."), (2, "The blue whale never sings."), (3, "他说今天天气真好我们去公园吧"), (4, "明日も空が青いでしょう"), (5, "明日は空が赤いでしょう"), (6, "nothing")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.error_budget, r.start, r.end) for r in contaminated(*frames).collect())
    assert got == [(1, 1, 0, 0, 10, 26), (3, 2, 1, 2, 2, 13), (4, 3, 0, 0, 3, 7)]
    assert sorted(r.doc_id for r in decontaminated(*frames).collect()) == [2, 5, 6]


def test_blocks_give_the_same(spark, sf_dir, small):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = lambda frame: sorted(map(tuple, frame.collect()))
    assert key(contaminated(small[0], benchmark, most_bytes=3000)) == key(contaminated(small[0], benchmark))
    assert decontaminated(small[0], benchmark, most_bytes=3000).count() == decontaminated(small[0], benchmark).count()


def test_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, "same text again, same text")], "item_id long, text string")
    assert contaminated(edge_docs, none).count() == 0 and decontaminated(edge_docs, none).count() == edge_docs.count()
    assert contaminated(no_docs, items).count() == 0 and decontaminated(no_docs, items).count() == 0
    assert decontaminated(edge_docs, items).count() + contaminated(edge_docs, items).select("doc_id").count() == edge_docs.count()


def test_word_places():
    import pyarrow as pa

    hashes, starts, ends, first = normal_words(pa.array(["Ab, c1!", None, "ÄB", "äb c1"]))
    assert first.tolist() == [0, 2, 2, 3, 5] and starts.tolist() == [0, 4, 0, 0, 3] and ends.tolist() == [2, 6, 2, 2, 5]
    assert hashes[2] == hashes[3] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 3
    assert isinstance(Items([1], pa.array(["a b c d e"])).pieces, dict) and np.all(np.diff(first) >= 0)
