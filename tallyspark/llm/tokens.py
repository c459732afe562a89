"""Token ids of whole texts by a public tokenizer file, with a word cache.

The tokenizer lower-cases a text and cuts it into pre-tokens before anything
else.  Arrow does the same for many texts at once, by the file's own pattern,
and lists the different pre-tokens; each Python worker keeps the ids of those
it has met.  New ones are encoded many at a time in one string joined by
blanks; an id that ends a word (its vocabulary entry ends in ``</w>``) closes
a pre-token, which tells where its ids end.  Texts for which this need not
hold (other alphabets, control characters, special-token strings) are cut at
ASCII white space, and chunks that are odd themselves go through the tokenizer
one by one.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pattern of the tokenizer file's pre-tokenizer (fixed value, must equal the file's).
PRE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Anything but characters on which Python's and the tokenizer's lower-casing, composition and classes agree.
_ODD = re.compile("[^\x20-\x7e\xa1-\u012f\u0131-\u024f]")
_SIGNS = frozenset(".,;:!?|")
#: The same of whole texts, white space allowed, and what stands between runs of letters in PRE, for Arrow's expressions.
_ODD_TEXT = r"[^\t-\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]"
_BETWEEN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\x0b\p{L}\p{N}]+)"
_cache: dict = {}


class WordTokenizer:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes, ``encode_flat`` those of all texts in one array."""

    def __init__(self, path: str, max_cached: int = 300_000, batch_chars: int = 4000):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        pre = spec["pre_tokenizer"].get("pretokenizers", [])
        self.lite = None
        if pre and pre[0].get("pattern", {}).get("Regex") == PRE and spec["model"].get("end_of_word_suffix") == "</w>":
            blank = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            self.lite = Tokenizer.from_str(json.dumps({
                **spec, "normalizer": None, "added_tokens": [],
                "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blank, pre[1]]}}))
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.pre = regex.compile(PRE)
        self.known: dict[str, bytes] = {"": b""}  # ids of lower-cased pre-tokens
        self.met: dict[str, bytes] = {}  # ids of chunks
        self.max_cached, self.batch_chars = max_cached, batch_chars

    def _slow(self, chunk: str) -> bytes:
        return np.array(self.full.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        known, k = self.known, 0
        while k < len(words):
            size, j = 0, k
            while j < len(words) and (j == k or size < self.batch_chars):
                size += len(words[j]) + 1
                j += 1
            flat = np.array(self.lite.encode(" ".join(words[k:j]), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[flat]) + 1
            if len(cuts) == j - k:
                raw, at = flat.tobytes(), 0
                for w, end in zip(words[k:j], (cuts * 4).tolist()):
                    known[w] = raw[at:end]
                    at = end
            else:
                for w in words[k:j]:
                    known[w] = self._slow(w)
            k = j

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks; those of earlier calls are remembered."""
        if len(self.met) > self.max_cached:
            self.met = {}
        ids = list(map(self.met.get, chunks))
        new = [c for c, x in zip(chunks, ids) if x is None]
        if new:
            self.met.update(zip(new, self._new_chunks(new)))
            ids = list(map(self.met.__getitem__, chunks))
        return ids

    def _new_chunks(self, chunks: list[str]) -> list[bytes]:
        if self.lite is None:
            return [self._slow(c) for c in chunks]
        if len(self.known) > self.max_cached:
            self.known = {"": b""}
        known, parts = self.known, []
        text = " ".join(chunks)
        odd = _ODD.search(text) is not None or any(s in text for s in self.specials)
        for c in chunks:
            if odd and (_ODD.search(c) or any(s in c for s in self.specials)):
                parts.append(None)
            elif c.isalpha():
                parts.append((c.lower(),))
            elif c[-1:] in _SIGNS and c[:-1].isalpha():
                parts.append((c[:-1].lower(), c[-1]))
            else:
                parts.append(tuple(self.pre.findall(c.lower())))
        new = {w for p in parts if p for w in p if w not in known}
        if new:
            self._learn(list(new))
        return [self._slow(c) if p is None else known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p])
                for c, p in zip(chunks, parts)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of different pre-tokens in lower case."""
        if len(self.known) > self.max_cached:
            self.known = {"": b""}
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        return list(map(self.known.__getitem__, words))

    @staticmethod
    def _flat(texts: pa.Array, ids_of) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each) where the ids of different parts between white space come from ``ids_of``."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ids = ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        offsets = lists.offsets.to_numpy()
        return flat[np.repeat(first[at] - upto[:-1], n) + np.arange(upto[-1])], np.diff(upto[offsets - offsets[0]])

    def encode_flat(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds: where each text begins, and the end); null: no ids."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD_TEXT) if self.lite is not None else pa.array([True] * len(texts), pa.bool_())
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        plain = pc.replace_substring_regex(pc.utf8_lower(texts.filter(pc.invert(odd))), _BETWEEN, r" \1 ")
        flat, n = self._flat(plain, self._words)
        odd = odd.to_numpy(zero_copy_only=False)
        if odd.any():
            more, m = self._flat(texts.filter(pa.array(odd)), self._chunks)
            sizes, begin = np.zeros(len(odd), np.int64), np.zeros(len(odd), np.int64)
            sizes[~odd], sizes[odd] = n, m
            begin[~odd], begin[odd] = np.cumsum(n) - n, len(flat) + np.cumsum(m) - m
            flat, n = np.concatenate((flat, more)), sizes
            flat = flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return flat, np.concatenate(([0], np.cumsum(n)))

    def encode(self, texts: list[str], step: int = 1024) -> list[bytes]:
        out = []
        for k in range(0, len(texts), step):
            flat, bounds = self.encode_flat(texts[k:k + step])
            raw, cuts = flat.tobytes(), (bounds * 4).tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


def cut_pieces(flat: np.ndarray, bounds: np.ndarray, end_id: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' ids with ``end_id`` after each, cut into pieces of ``size``: (ids, text of each piece, its number there, bounds of the pieces).

    Pieces of a text follow one another, so all pieces together are the ids again.
    """
    n = np.diff(bounds) + 1
    stop = np.cumsum(n)
    ids = np.empty(int(stop[-1]) if len(n) else 0, flat.dtype)
    keep = np.ones(len(ids), bool)
    keep[stop - 1] = False
    ids[keep], ids[~keep] = flat, end_id
    many = -(-n // size)
    text = np.repeat(np.arange(len(n)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = (stop - n)[text] + number * size
    return ids, text, number, np.append(begin, len(ids))


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _cache:
        _cache[path] = WordTokenizer(path)
    return _cache[path]
