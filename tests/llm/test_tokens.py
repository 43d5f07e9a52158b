import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sortalis.llm.encoder import Encoder
from sortalis.llm.packing import TIERS, Packer, balanced, packed
from sortalis.llm.token_file import TokenFile, read_token_files, write_token_files

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


library_of = functools.cache(Tokenizer.from_file)


def ids_of(path, text):
    return library_of(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("most", [3000, 96 << 20])
def test_cached_ids_equal_the_library(path, most, small):
    coder, library = Encoder(path, most_bytes=most), Tokenizer.from_file(path)
    texts = ["", None, "  a  b\n\nc ", "  foo ́x", "<|endoftext|> hi <|endoftext|>", "don't  'sx \t\r\n x", "Σας ΟΣ İ", "\n", " ", "a  b", "a\x1c b\x85 　c", "﻿ x"]
    texts += [t for _, t in small[1][:60]]
    for _ in range(2):
        ids, first = coder.encode_column(pa.array(texts))
        for d, t in enumerate(texts):
            assert ids[first[d] : first[d + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_of_pieces_equal_the_library_on_random_texts(path):
    coder, library = Encoder(path, most_bytes=20_000), Tokenizer.from_file(path)
    random = np.random.default_rng(5)
    parts = [*"aZéÜß'’.,-_$1\u0662²\n\t\r \x0b\x00\x7f", "  ", "\n\n", "\r\n", "'s", "'S", "'re", "n't", "H\u0331", "I\u0307", "İ", "K", "ſ", "а", "Ж", "ا", "א", "中", "😀", "\u0301", "ab12", "x.y", "word", "\u00b5", "\u02b0", "\u0345", "ʼ", "×", "÷", "ª", "º", "ǅ"]
    texts = ["".join(random.choice(parts, random.integers(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ids, first = coder.encode_column(pa.array(some))
        for d, t in enumerate(some):
            assert ids[first[d] : first[d + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def token_rows(docs, path):
    library = Tokenizer.from_file(path)
    rows = docs.selectExpr("doc_id", "text").collect()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_token_files_read_back(spark, name, request):
    docs = request.getfixturevalue(name)
    docs = docs[0] if name == "small" else docs
    parts = write_token_files(docs, WORD)
    got = [tuple(r)[:4] for r in read_token_files(spark, parts).collect()]
    assert sorted(got, key=lambda r: r[1]) == token_rows(docs, WORD)


def test_token_file_random_access(spark, small, tmp_path):
    parts = write_token_files(small[0], WORD, folder=f"file://{tmp_path}", length=64)
    total = 0
    for path, _, _, n_ids, *_ in parts:
        file = TokenFile(f"{path}.arrow")
        flat = np.concatenate([file.sequence(i) for i in range(-(-n_ids // 64))])
        valid = sum(file.mask(i).true_count for i in range(-(-n_ids // 64)))
        assert valid == n_ids and not flat[n_ids:].any()
        assert (flat[:n_ids] == file.span(0, n_ids)).all()
        assert not file.sequence(0).flags.owndata
        total += n_ids
    assert total == sum(r[2] for r in token_rows(small[0], WORD))


def test_sequence_numbers_follow_the_length_written(spark, small):
    parts = write_token_files(small[0], WORD, length=64)
    rows = sorted((tuple(r) for r in read_token_files(spark, parts).collect()), key=lambda r: r[1])
    ends = np.cumsum([-(-p[3] // 64) for p in parts])
    assert rows[0][4] == 0 and rows[-1][4] < ends[-1] and len(parts) > 0
    assert all(offset < 64 for *_, offset in rows)
    full = sum(p[3] for p in parts[:-1])
    assert [r[4] * 64 + r[5] for r in rows if r[1] < parts[0][3]] == [r[1] for r in rows if r[1] < parts[0][3]]
    assert [r[4] for r in rows if r[1] >= full][0] == (ends[-2] if len(parts) > 1 else 0)


def test_token_files_of_no_rows(spark, no_docs):
    parts = write_token_files(no_docs, WORD)
    assert parts == [] and read_token_files(spark, parts).count() == 0


@pytest.mark.parametrize("name", ["edge_docs", "small"])
def test_packing_keeps_each_id_once(name, request):
    docs = request.getfixturevalue(name)
    docs = docs[0] if name == "small" else docs
    pieces = packed(docs, BYTE).collect()
    want = sorted((*((doc_id if doc_id is not None else -1),), len(ids), crc(ids)) for doc_id, text in docs.select("doc_id", "text").collect() for ids in [[*ids_of(BYTE, text), 0]])
    texts = defaultdict(list)
    for doc_id, text in docs.select("doc_id", "text").collect():
        texts[doc_id].append([*ids_of(BYTE, text), 0])
    assert sum(p.length for p in pieces) == sum(w[1] for w in want)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert any(len(ids) == p.doc_tokens and crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for ids in texts[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length, p.sequence_length))
    for doc_id, own in by_doc.items():
        assert sum(n for _, n in own) == sum(map(len, texts[doc_id]))
        if len(texts[doc_id]) == 1:
            at = 0
            for start, n in sorted(own):
                assert start == at
                at += n
    padding = 0
    for own in by_sequence.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= own[0][2] <= 1024 and own[0][2] in (at, 1024)
        padding += own[0][2] - at
    assert padding <= 1024 * docs.rdd.getNumPartitions()


def test_step_groups_are_balanced(small):
    loads = defaultdict(int)
    for p in packed(small[0], BYTE).collect():
        loads[p.step_group] += p.length
    assert max(loads.values()) <= 8192 + 1024


def test_groups_are_even():
    random = np.random.default_rng(4)
    for n in (1, 7, 300):
        sizes = sorted(random.integers(1, 1025, n).tolist(), reverse=True)
        loads = np.bincount(balanced(sizes, 8192), weights=sizes)
        assert loads.max() - loads.min() <= sizes[0] and len(loads) == -(-sum(sizes) // 8192) and loads.min() > 0


def brute_windows(pool, tiers):
    """The packing by plain lists: longest rest first, then the largest that fits the gap, or a cut of the shortest."""
    out = []
    pool = sorted(pool)
    while pool:
        first = pool.pop()
        tier = min(t for t in tiers if t >= first[0])
        window, gap = [first], tier - first[0]
        while gap and pool:
            fitting = [p for p in pool if p[0] <= gap]
            if fitting:
                piece = max(fitting)
                pool.remove(piece)
            else:
                length, document, start = pool.pop(0)
                piece = (gap, document, start)
                pool = sorted([*pool, (length - gap, document, start + gap)])
            window.append(piece)
            gap -= piece[0]
        out.append((tier, window))
    return out


def test_windows_equal_brute_force():
    random = np.random.default_rng(6)
    for n in (0, 1, 5, 120):
        tokens = random.integers(1, 5000, n).tolist()
        packer, full = Packer(TIERS), 0
        for d, t in enumerate(tokens):
            full += len(packer.add(d, t))
        assert full == sum(t // 1024 for t in tokens)
        want = brute_windows([(t % 1024, d, t // 1024 * 1024) for d, t in enumerate(tokens) if t % 1024], TIERS)
        assert list(packer.windows(last=True)) == want
        assert all(sum(p[0] for p in w) == tier for tier, w in want[:-1])


def test_a_group_has_one_tier(small):
    tiers = defaultdict(set)
    for p in packed(small[0], BYTE).collect():
        tiers[p.step_group].add(p.tier)
    assert all(len(t) == 1 for t in tiers.values()) and len({x for t in tiers.values() for x in t}) > 1


def test_packing_of_no_rows(no_docs):
    assert packed(no_docs, BYTE).count() == 0
