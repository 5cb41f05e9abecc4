"""Token ids of whole texts, remembered by white-space-separated piece."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: str.split() takes these for white space and the tokenizer's normaliser may not: such texts are encoded in one go.
_ODD = re.compile("[\x1c-\x1f\x85 ᠎ -​    　﻿\xa0]")
_NOT_LATIN = re.compile("[^\x00-\xff]")  #: without these, lower-casing first changes nothing
_MOST = 500_000  #: pieces and words remembered in a Python worker; beyond that the memory starts anew
_MARKS = ".,;:!?"  #: marks at a word's end, which are a token run of their own
#: How byte-level vocabularies write bytes: printable ones as they are, the others from code point 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizer itself.

    For vocabularies whose pre-tokenizer never joins text across white space and which lower-case: a piece has the same ids
    wherever it stands. New words of Latin letters, with or without marks at their end, ask the vocabulary's merges alone, as nothing in them
    is normalised or split further (some words tell whether that holds). Other new pieces are encoded many at a time, with the digit 0
    between them; pieces with that digit go singly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        (self.between,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.merged = self.tokenizer.model.tokenize
        probes = ["word", "Straße", "élan,", "Ünlü?!", "and...", "naïve;", "µ", "a", "internationally."]
        self._letters(probes)
        self.direct = all(self.known.get(x) == ids.tobytes() for x, ids in zip(probes, self._ids(probes)))
        self.known.clear()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, pieces: list[str]) -> list[str]:
        """Learns the pieces that are Latin letters with marks at their end or none, and returns the others."""
        known, merged, others = self.known, self.merged, []
        for piece in pieces:
            low = piece.lower()
            word = low.rstrip(_MARKS)
            if not word.isalpha() or not (plain := low.isascii()) and _NOT_LATIN.search(low):
                others.append(piece)
                continue
            ids = known.get(word)
            if ids is None:
                found = [x.id for x in merged(word if plain else word.encode().decode("latin-1").translate(_BYTES))]
                ids = known[word] = struct.pack(f"<{len(found)}I", *found)
            if len(word) < len(low):
                marks = low[len(word) :]
                if marks not in known:
                    found = [x.id for x in merged(marks)]
                    known[marks] = struct.pack(f"<{len(found)}I", *found)
                ids += known[marks]
            known[piece] = ids
        return others

    def _learn(self, pieces: list[str]) -> None:
        if self.direct:
            pieces = self._letters(pieces)
        single = [x for x in pieces if "0" in x]
        self.known.update(zip(single, (x.tobytes() for x in self._ids(single))))
        rest = [x for x in pieces if "0" not in x]
        blocks = [rest[i : i + 500] for i in range(0, len(rest), 500)]
        for block, ids in zip(blocks, self._ids([" 0 ".join(x) for x in blocks])):
            ends = np.flatnonzero(ids == self.between).tolist()
            raw = ids.tobytes()
            if len(ends) != len(block) - 1:  # a piece has the mark after all
                self.known.update(zip(block, (x.tobytes() for x in self._ids(block))))
                continue
            at = 0
            for piece, end in zip(block, [*ends, ids.size]):
                self.known[piece] = raw[4 * at : 4 * end]
                at = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > _MOST:
            self.known.clear()
        get, split, new = self.known.get, [], set()
        for t in texts:
            t = t or ""
            if _ODD.search(t):
                split.append((t, None, None))
                continue
            pieces = (t if _NOT_LATIN.search(t) else t.lower()).split()
            ids = list(map(get, pieces))
            if None in ids:
                new.update(x for x, y in zip(pieces, ids) if y is None)
                ids = None
            split.append((t, pieces, ids))
        if new:
            self._learn(list(new))
        known = self.known
        return [self._ids([t])[0].tobytes() if p is None else b"".join(map(known.__getitem__, p) if i is None else i) for t, p, i in split]


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
