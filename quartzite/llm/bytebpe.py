"""Ids of a byte-level BPE vocabulary for many texts at once.

The vocabulary and the library's own rules come from a tokenizer file. Texts of a chunk are cut into
pre-tokens by NumPy over their code points; a pre-token that occurs many times is encoded once.
The ids are those that `tokenizers` gives with add_special_tokens=False: texts that hold a special
token, or characters whose class may differ between versions of Unicode, go to that library whole,
as do pre-tokens of white space or of great length.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .codepoints import CODES, distinct_words, spread
from .textblocks import chunks, text_bytes

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
#: Code points of white space; these are fixed values.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LONG = 200
_SAFE = re.compile(rb"[a-z] [a-z]")


@functools.cache
def _classes() -> np.ndarray:
    old = unicodedata.ucd_3_2_0.category
    kinds = np.full(CODES, OTHER, np.uint8)
    for i, c in enumerate(map(chr, range(CODES))):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Cn":
            known = kind != "Cn" and old(c) == kind
            kinds[i] = (LETTER if kind[0] == "L" else NUMBER) if known else UNSURE
    kinds[WHITE] = SPACE
    return kinds


def pre_tokens(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a pre-token begins, for texts that begin at first (and end at its last entry)."""
    n = len(codes)
    kind = _classes()[codes]
    new = np.zeros(n + 1, bool)
    new[first] = True
    blank, space = kind == SPACE, codes == 32
    begin = new[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin[1:] &= ~(space[:-1] & ~blank[1:] & ~new[1:n])  # a run takes one space before it
    begin[:-1] |= blank[:-1] & ~blank[1:] & ~new[1:n]  # the last of a run of white space stands apart
    mark = np.flatnonzero(codes == 39)
    mark = mark[begin[mark] & ~new[mark + 1]]
    if len(mark):
        c1 = codes[mark + 1]
        c2 = np.where(new[mark + 2] if mark[-1] + 2 <= n else new[np.minimum(mark + 2, n)], 0, codes[np.minimum(mark + 2, n - 1)])
        two = np.isin(c1, [ord(c) for c in "stmd"])
        three = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        begin[mark[two | three] + 1] = False
        after = np.concatenate([mark[two] + 2, mark[three] + 3])
        begin[after[after < n]] = True
    return begin


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
        ranks = {bytes(byte[c] for c in k): v for k, v in vocabulary.items()}
        pattern = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bytes_of = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*ranks.values(), *special.values()])
        self.special = [k.encode() for k in special]
        self.lengths = np.zeros(self.size, np.int64)
        for k, v in ranks.items():
            self.lengths[v] = len(k)
        self.newline = ranks[b"\n"]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _words(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: a pool, and where each one's ids begin in it and how many there are."""
        alone = (_classes()[codes[starts + sizes - 1]] == SPACE) | (sizes > _LONG)
        at = np.flatnonzero(~alone)
        lead = (codes[starts[at]] != 32).astype(np.int64)  # a line break keeps it from the one before
        long = sizes[at] + lead
        ends = np.cumsum(long)
        joined = np.full(int(ends[-1]) if len(ends) else 0, 10, np.uint32)
        joined[spread(ends - sizes[at], sizes[at])] = codes[spread(starts[at], sizes[at])]
        ids = self.bytes_of.encode_to_numpy(joined.tobytes().decode("utf-32-le"), allowed_special=set(), disallowed_special=()).astype(np.int32)
        width = 1 + (joined >= 0x80).astype(np.int64) + (joined >= 0x800) + (joined >= 0x10000)
        byte_ends = np.cumsum(width)[ends - 1] if len(ends) else np.zeros(0, np.int64)
        reached = np.cumsum(self.lengths[ids])
        last = np.searchsorted(reached, byte_ends)
        if len(last) and (last[-1] >= len(ids) or (reached[last] != byte_ends).any()):
            raise AssertionError("a token crosses the end of a pre-token")
        begin = np.zeros(len(starts), np.int64)
        count = np.zeros(len(starts), np.int64)
        begin[at] = np.concatenate([[0], last[:-1] + 1])[: len(at)] + lead
        count[at] = last + 1 - begin[at]
        pool, total = [ids], len(ids)
        for k in np.flatnonzero(alone):
            found = self.whole(codes[starts[k] : starts[k] + sizes[k]].tobytes().decode("utf-32-le"))
            begin[k], count[k] = total, len(found)
            pool.append(found)
            total += len(found)
        return np.concatenate(pool), begin, count

    def _chunk(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and how many each has."""
        docs = len(offsets) - 1
        text = raw.decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(codes) == len(raw):
            first = offsets
        else:
            inside = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
            first = np.concatenate([[0], np.cumsum(~inside)])[offsets]
        if first[-1] != len(codes):  # not UTF-8: one by one, with the replacement character
            parts = [self.whole(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        begin = pre_tokens(codes, first)
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(codes))
        sizes = ends - starts
        _, same, own = distinct_words(codes, starts, sizes)
        pool, at, count = self._words(codes, starts[own], sizes[own])
        place = np.zeros(len(starts), np.int64)
        place[own] = np.arange(len(own))
        word = place[same]
        ids = pool[spread(at[word], count[word])]
        total = np.concatenate([[0], np.cumsum(count[word])])
        counts = np.diff(total[np.searchsorted(starts, first)])
        odd = set(np.searchsorted(offsets, [m.start() for s in self.special for m in re.finditer(re.escape(s), raw)], "right") - 1)
        if len(codes) < len(raw):
            unsure = np.flatnonzero(_classes()[codes] == UNSURE)
            odd |= set(np.searchsorted(first, unsure, "right") - 1)
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in odd:
                parts[k] = self.whole(raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"))
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts

    def _long(self, raw: bytes, most: int) -> np.ndarray:
        """Ids of one text, in pieces between a letter and a space so that no pre-token is cut."""
        if any(s in raw for s in self.special):
            return self.whole(raw.decode("utf-8", "replace"))
        parts, at = [], 0
        while at < len(raw):
            cut = _SAFE.search(raw, at + most)
            end = cut.start() + 1 if cut else len(raw)
            parts.append(self._chunk(raw[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(parts)

    def encode(self, column: pa.Array | pa.ChunkedArray, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts (first, end) of about `most` bytes: their ids, and how many each text has; null counts as empty."""
        data, offsets = text_bytes(column)
        for i, j in chunks(offsets, most):
            raw, local = data[offsets[i] : offsets[j]].tobytes(), offsets[i : j + 1] - offsets[i]
            if len(raw) > 2 * most:
                ids = self._long(raw, most)
                yield i, j, ids, np.array([len(ids)])
            else:
                yield i, j, *self._chunk(raw, local)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
