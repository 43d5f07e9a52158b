"""Exact, cached encoding of whole text columns with a public tokenizer file."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from sortalis.llm.textcols import SEPARATORS, claim, ranges, text_buffer

#: White space beyond the ASCII separators: a text with one of these is encoded in one go,
#: since a tokenizer may join it with a separator beside it.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
#: First bytes that rare white space may have in UTF-8.
_RARE_BYTES = np.zeros(256, dtype=bool)
_RARE_BYTES[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Kinds of ASCII bytes: 0 for separators and bytes beyond ASCII, 1 for letters, 2 for digits, 3 for the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = [0 if SEPARATORS[b] else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(128)]
_SPACE, _APOSTROPHE = 32, 39


class Encoder:
    """Ids of whole texts, the same as ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Tokenizers that cut a text into words, numbers, marks and white space before they merge give it the ids
    of these pieces, one after the other.  So each distinct piece is encoded once by the library and kept.
    Cuts are made only where such a tokenizer makes one whatever stands around: before white space, and
    between ASCII letters, digits and marks (a letter after an apostrophe may belong to it).  The cache is
    one byte column of pieces and one array of ids, ``most_bytes`` at most; when it is full, the half that
    was asked for last stays.

    Pieces go to the library in long strings with a special token between them, which the library always
    splits at.  Texts for which a cut is not certain (rare white space, special tokens written out) and
    tokenizers of another kind are encoded by the library directly.
    """

    def __init__(self, path: str, most_bytes: int = 96 << 20, batch: int = 256):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self._tokenizer.to_str())
        self._special = [t["content"] for t in spec.get("added_tokens") or []]
        self._mark = self._special[-1] if self._special else ""
        self._mark_id = self._tokenizer.token_to_id(self._mark) if self._mark else None
        self._special_re = re.compile("|".join(map(re.escape, self._special))) if self._special else None
        byte_level, word_level = self._kinds(spec)
        self._separable = bool(self._mark) and spec["model"]["type"] == "BPE" and (byte_level or word_level)
        self._drops_space = word_level
        normalizer = spec.get("normalizer") or {}
        self._lowers = any(n.get("type") == "Lowercase" for n in normalizer.get("normalizers") or [normalizer])
        self._letters = self._letter_table() if self._separable else np.zeros(0, dtype=bool)
        self.dtype = np.uint16 if self._tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._most, self._batch, self._turn = most_bytes, batch, 0
        self._forget()

    @staticmethod
    def _kinds(spec: dict) -> tuple[bool, bool]:
        """Whether the tokenizer keeps white space (byte level), or drops it around words, and cuts between kinds."""
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or [pre]
        byte_level = len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space") and not spec.get("normalizer")
        word_level = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and r"[^\s\p{L}\p{N}]" in (p.get("pattern") or {}).get("Regex", "") for p in parts)
        return bool(byte_level), word_level

    def _letter_table(self) -> np.ndarray:
        """By code point below 0x800, whether the tokenizer cuts between it and both a mark and a digit after it."""
        normal = self._tokenizer.normalizer.normalize_str if self._tokenizer.normalizer else str
        cut = self._tokenizer.pre_tokenizer.pre_tokenize_str
        out = np.zeros(0x800, dtype=bool)
        for c in range(0x80, 0x800):
            out[c] = all(len(found) > 1 and found[-1][0] == after for after in ",1" for found in [cut(normal(chr(c) + after))])
        return out

    def _forget(self) -> None:
        self._pieces = pa.array([], pa.large_binary())
        self._ids, self._ends, self._seen = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        """The library's own result, text by text."""
        return [np.asarray(e.ids, dtype=self.dtype) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces, from the library."""
        ids, sizes = [], []
        for at in range(0, len(new), self._batch * 16):
            part = new[at : at + self._batch * 16]
            groups = [part[i : i + self._batch] for i in range(0, len(part), self._batch)]
            for group, coded in zip(groups, self._tokenizer.encode_batch_fast(list(map(self._mark.join, groups)), add_special_tokens=False), strict=True):
                own = np.asarray(coded.ids, dtype=self.dtype)
                marks = own == self._mark_id
                cuts = np.flatnonzero(marks)
                if len(cuts) != len(group) - 1:
                    raise RuntimeError("the tokenizer did not keep the marks between pieces apart")
                ids.append(own[~marks])
                sizes.append(np.diff(cuts, prepend=-1, append=len(own)) - 1)
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, begins): the bytes to cut, lower-cased where the tokenizer does it, and where a piece begins."""
        outside = SEPARATORS[raw]
        begins = np.zeros(len(raw), dtype=bool)
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
        kind = _KIND[raw]
        before, now = kind[:-1], kind[1:]
        cut = (before != now) & (before > 0) & (now > 0) & ((raw[:-1] != _APOSTROPHE) | (now != 1))
        at = np.flatnonzero((raw[:-1] >= 0x80) & (now > 1)) + 1  # a mark or digit after a letter of two bytes
        at = at[at >= 2]
        lead = raw[at - 2].astype(np.int64)
        known = (lead >= 0xC2) & (lead < 0xE0)
        cut[at[known] - 1] |= self._letters[(lead[known] & 0x1F) << 6 | raw[at[known] - 1] & 0x3F]
        begins[1:] |= cut
        if self._drops_space:
            begins[1:] |= outside[:-1]
            if self._lowers:  # a mark that combines with the letter must find the letter that it would have found
                raw = np.where((raw >= 65) & (raw <= 90) & (np.append(raw[1:], 0) < 0xCC), raw + 32, raw).astype(np.uint8)
        else:
            begins[1:] |= outside[1:] & ~outside[:-1]
            single = outside[:-1] & ~outside[1:] & (raw[:-1] != _SPACE)  # a line end alone is a piece of its own
            single[1:] &= ~outside[:-2] | begins[1:-1]
            begins[1:] |= single
        return raw, begins

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece in the cache, which learns the new ones."""
        held = len(self._pieces)
        coded = pa.chunked_array([self._pieces, pieces]).dictionary_encode()
        places = coded.chunk(coded.num_chunks - 1).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = coded.chunk(coded.num_chunks - 1).dictionary
        if len(pieces) > held:
            ids, sizes = self._learn(pieces.slice(held).cast(pa.large_string()).to_pylist())
            self._pieces = pieces
            self._ids, self._ends = np.append(self._ids, ids), np.append(self._ends, self._ends[-1] + np.cumsum(sizes))
            self._seen = np.append(self._seen, np.zeros(len(sizes), np.int32))
        self._turn += 1
        self._seen[places] = self._turn
        return places

    def _shrink(self) -> None:
        """Keeps the half of a full cache that was asked for last."""
        if self._pieces.nbytes + self._ids.nbytes + self._ends.nbytes + self._seen.nbytes <= self._most:
            return
        stay = np.sort(np.argsort(-self._seen, kind="stable")[: len(self._seen) // 2])
        sizes = np.diff(self._ends)[stay]
        self._ids = self._ids[ranges(self._ends[stay], sizes)]
        self._ends, self._seen = np.append(0, np.cumsum(sizes)), self._seen[stay]
        self._pieces = self._pieces.take(pa.array(stay))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of a text column; document d has ids first[d] to first[d + 1]; a null counts as empty."""
        raw, offsets = text_buffer(column)
        odd = self._odd_rows(raw, offsets)
        alone: dict[int, np.ndarray] = {}
        if len(odd):
            alone = dict(zip(odd, self.direct([raw[offsets[d] : offsets[d + 1]].tobytes().decode() for d in odd]), strict=True))
            sizes = np.diff(offsets)
            stays = np.ones(len(sizes), dtype=bool)
            stays[odd] = False
            raw, offsets = raw[np.repeat(stays, sizes)], np.append(0, np.cumsum(sizes * stays))
        ids, ends = self._cached(raw, offsets) if len(raw) else (np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64))
        if alone:
            parts = [alone.get(d, ids[a:b]) for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
            ids, ends = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        return ids, ends

    def _cached(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, begins = self._cuts(raw, offsets)
        if self._drops_space:
            inside = ~SEPARATORS[raw]
            begins &= inside
            first = np.searchsorted(np.flatnonzero(begins), offsets)
            raw, begins = raw[inside], begins[inside]
        else:
            first = np.searchsorted(np.flatnonzero(begins), offsets)
        bounds = np.append(np.flatnonzero(begins), len(raw)).astype(np.int64)
        if len(bounds) == 1:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        places = self._places(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]))
        starts, sizes = self._ends[places], np.diff(self._ends)[places]
        ids = self._ids[ranges(starts, sizes)]
        ends = np.append(0, np.cumsum(sizes))[first]
        self._shrink()
        return ids, ends

    def _odd_rows(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The rows that are encoded in one go."""
        if not self._separable:
            return list(range(len(offsets) - 1))
        maybe = np.flatnonzero(_RARE_BYTES[raw])
        text = raw.tobytes()
        places = [maybe]
        for special in self._special:
            coded = special.encode()
            if coded in text:
                places.append(np.array([m.start() for m in re.finditer(re.escape(coded), text)], np.int64))
        rows = np.unique(np.searchsorted(offsets, np.concatenate(places), side="right") - 1).tolist()
        decoded = ((d, text[offsets[d] : offsets[d + 1]].decode()) for d in rows)
        return [d for d, t in decoded if _RARE_SPACE.search(t) or self._special_re.search(t)]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most_bytes: int = 96 << 20) -> Encoder:
    """The encoder of this worker process for a tokenizer file."""
    claim("encoder", _ENCODERS.clear)
    key = (path, most_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, most_bytes)
    return _ENCODERS[key]
