"""The pipeline against brute force: which documents stay after each stage, and what is packed."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests_llm_brute import decontam_brute, secrets_brute, simhash_brute  # noqa: E402


def test_stages(spark, sf_dir, small):
    docs, rows = small
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        if name != "packing":
            assert now.columns == docs.columns
            kept[name] = {r.doc_id: r for r in now.collect()}
            now = spark.createDataFrame(list(kept[name].values()), docs.schema)
    texts = dict(rows)
    assert set(kept["language_id"]) == {d for d, t in rows if any(c.isalpha() for c in t or "")}
    assert set(kept["near_dedup"]) == simhash_brute([(d, texts[d]) for d in kept["language_id"]])
    dirty = decontam_brute([(d, texts[d]) for d in kept["near_dedup"]], benchmark)
    assert set(kept["decontaminate"]) == set(kept["near_dedup"]) - dirty
    for d, r in kept["secret_scan"].items():
        assert (r.text == texts[d]) == (not secrets_brute(texts[d]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for p in now.collect():
        got[p.doc_id].append((p.start, p.length, p.ids_crc32))
    assert set(got) == set(kept["secret_scan"])
    for d, r in kept["secret_scan"].items():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(n for _, n, _ in got[d]) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in got[d])


def test_edges(spark, sf_dir, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs_out = stage(spark, docs, sf_dir)
            assert name == "packing" or docs_out.columns == docs.columns
            docs_out.collect()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "packing"]
