"""Byte-level BPE ids of whole texts, an Arrow batch at a time.

The pre-tokens of a chunk of texts are found and hashed with numpy; only pre-tokens that this worker has not seen
lately reach the tokenizer. Texts with characters whose class differs between Unicode versions, or with the literal of
an added token, go to the tokenizer whole. The ids equal ``Tokenizer.encode(text, add_special_tokens=False)``.

Defined cases: an empty text has no ids, and no texts give none; a text of any length is encoded whole; a worker keeps
at most ``KEPT`` pre-tokens and then begins anew, which changes no ids; nulls are for the caller to replace.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd

from .textvec import U, _powers, mix

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Endings that the pattern takes with an apostrophe, fixed by the vocabulary's pre-tokenizer.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pre-tokens kept by a worker; beyond it the store starts anew.
KEPT = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Class of each character of the basic plane; what Unicode 3.2 did not know, or knew otherwise, is unsure."""
    out = np.full(0x10000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    white = {0x20, 9, 10, 11, 12, 13, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind != old.category(ch) or kind in ("Cn", "Cs", "Co") or 0x1C <= c <= 0x1F or c in (0x85, 0x180E, 0x200B):
            continue
        out[c] = SPACE if c in white else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that the vocabulary writes for each byte: itself if it can be seen, else one of those from 256 on, in turn."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in seen else next(rest)) for b in range(256)}


class Encoder:
    """``encode(texts)`` gives all ids in a row and each text's number of ids."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or default_path())
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.values = mix(np.arange(1, 0x10001, dtype=np.uint64))
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.seen: dict[int, bytes] = {}

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token, as 32-bit numbers."""
        return array("i", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(texts)
        offs = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offs[1:])
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = np.flatnonzero(cp > 0xFFFF)
        cls = self.classes[cp & 0xFFFF if len(high) else cp]
        cls[high] = UNSURE
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offs, np.flatnonzero(cls == UNSURE), "right") - 1] = True
        for a in self.added:
            if a in text:
                odd |= np.fromiter((a in t for t in texts), bool, len(texts))
        odd = np.flatnonzero(odd)
        ids, counts = self._fast(text, cp, cls, offs, high)
        if len(odd):
            at = np.concatenate([[0], np.cumsum(counts)])
            parts, last = [], 0
            for i, new in zip(odd.tolist(), self._slow([texts[i] for i in odd.tolist()])):
                parts += [ids[last : at[i]], np.array(new, np.int32)]
                last, counts[i] = at[i + 1], len(new)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts

    def _fast(self, text: str, cp: np.ndarray, cls: np.ndarray, offs: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(cp)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[offs] = True
        first = np.empty(n + 1, bool)  # a pre-token begins here
        first[1:-1] = cls[1:] != cls[:-1]
        first |= edge
        first[0] = first[n] = True
        space = cls == SPACE
        # The last of the white space before other characters stands alone, or goes with them if it is a blank.
        last = np.zeros(n + 1, bool)
        last[: n - 1] = space[:-1] & ~space[1:] & ~edge[1:n]
        at = np.flatnonzero(last)
        first[at] = True
        first[at[cp[at] == 0x20] + 1] = False
        # An apostrophe that begins a pre-token takes an ending with it, if the text goes on so far.
        at = np.flatnonzero(cp == 0x27)
        at = at[first[at] & first[at + 1] & ~edge[at + 1]]
        if len(at):
            for e in ENDINGS:
                i = at[~edge[np.minimum(at + len(e), n)] & (at + len(e) < n)] if len(e) > 1 else at
                for k, c in enumerate(e):
                    i = i[cp[i + 1 + k] == ord(c)]
                first[i + 1] = False
                first[i + 1 + len(e)] = True
        cut = np.flatnonzero(first)
        start, end = cut[:-1], cut[1:]
        p, q = _powers(n + 1)
        s = np.zeros(n + 1, np.uint64)
        v = self.values[cp & 0xFFFF if len(high) else cp]
        v[high] = mix(cp[high].astype(np.uint64) + U(1))
        np.cumsum(v * p[:n], out=s[1:])
        h = mix((s[end] - s[start]) * q[start] + (end - start).astype(np.uint64) * U(0xD1B54A32D192ED03))
        code, keys = pd.factorize(h)
        where = np.zeros(len(keys), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]  # the first place of each
        if len(self.seen) > KEPT:
            self.seen.clear()
        seen, keys = self.seen, keys.tolist()
        new = [i for i, k in enumerate(keys) if k not in seen]
        if new:
            a, b = start[where[new]].tolist(), end[where[new]].tolist()
            for i, x, y in zip(new, a, b):
                seen[keys[i]] = self._piece(text[x:y])
        rows = [seen[k] for k in keys]
        size = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        flat = np.frombuffer(b"".join(rows), np.int32)
        begin = np.cumsum(size) - size
        each = size[code]
        stop = np.cumsum(each)
        ids = flat[np.repeat(begin[code] - (stop - each), each) + np.arange(int(stop[-1]))]
        before = np.concatenate([[0], stop])[np.searchsorted(start, offs)]
        return ids, np.diff(before)


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for the vocabulary; the tasks that a worker runs in turn share its store."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def chunks(texts: list[str], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)
