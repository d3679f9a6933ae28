"""Line quality by a linear-chain conditional random field.

Each line with a word gets binary features; Viterbi decoding labels the lines of a text content or boilerplate, and a
text is kept if at least ``MIN_SHARE`` of its words stand in content lines and the plain rules don't fail it.

The weights are trained here, on at most ``TRAIN_DOCS`` labelled documents (those whose hashed ids come first). Labels
are of documents, so those of their lines are found by rounds of fitting and decoding. At first a document's lines are
content, but for those that plainly are not (notices, menus, rows of marks or symbols), if the share of content words
then agrees with the document's label; else all of them have its label. In each round the lines get the labels that the
field decodes, but for the plain ones, as long as that share agrees; else they keep their first ones. So labels change within documents, and
the field learns how. Everything else covers all rows and whole texts.

Defined cases: a key that has several texts is trained on with one of them, that with the least bits; a null or empty text has no words, fails the plain rules and is not kept; without labels all weights
are zero and every line counts as content; a repeated row is judged once for each copy; columns besides the key and
the text pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import SPACE, U, Words, mix, per_text, pieces, window_hashes

#: Bound on the labelled documents that the weights are fitted on.
TRAIN_DOCS = 2000
MIN_SHARE = 0.5
#: Rounds of fitting and decoding, and the lines up to which texts are decoded side by side.
ROUNDS, SIDE = 3, 256
BOILERPLATE, CONTENT = 0, 1
FEATURES = (
    "bias", "words<3", "words<8", "words<20", "words<50", "words>=50", "symbols>0.05", "symbols>0.3", "upper>0.5", "marks>0.3", "bars>0.2", "repeats>0.3",
    "equal to an earlier line", "ends a sentence", "digits>0.3", "first", "last", "notice>0", "notice>0.2", "no sign",
)
#: Signs of boilerplate; a line with none of them has "no sign".
SIGNS = ("symbols>0.05", "upper>0.5", "marks>0.3", "bars>0.2", "repeats>0.3", "notice>0")
#: Features of lines that plainly are no content.
PLAIN = ("symbols>0.3", "marks>0.3", "bars>0.2", "notice>0.2")
#: Words of notices and menus, in small letters, with a capital or in capitals, and with a point or so after them.
NOTICE = (
    "license", "licensed", "licence", "copyright", "rights", "reserved", "trademark", "trademarks", "terms", "privacy", "policy", "cookie", "cookies", "disclaimer",
    "subscribe", "newsletter", "unsubscribe", "login", "logout", "advertisement", "sponsored", "sitemap", "navigation", "warranty", "permission", "released",
)

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _notice() -> np.ndarray:
    forms = [f"{w}{p}" for word in NOTICE for w in (word, word.capitalize(), word.upper()) for p in ("", ".", ",", ":", ";", ")")] + ["©", "(c)", "(C)"]
    data = " ".join(forms).encode()
    return np.sort(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=False).hashes())


_NOTICE = _notice()


@dataclass
class Chunk:
    """Counts of some texts and the features of their lines; ``cut`` has each text's range of lines."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    base_failed: np.ndarray
    cut: np.ndarray
    line_words: np.ndarray
    bits: np.ndarray
    line_no: np.ndarray
    line_start: np.ndarray
    line_end: np.ndarray

    @staticmethod
    def of(buf: np.ndarray, offs: np.ndarray) -> Chunk:
        w = Words(buf, offs, lower=False)
        n = len(offs) - 1
        n_words = w.count
        doc = np.repeat(np.arange(n), n_words)
        # Lines; those without a word are left out.
        nl = np.flatnonzero(buf == 10)
        start = np.sort(np.concatenate([offs[:-1], nl + 1]), kind="stable")
        owner = np.sort(np.concatenate([np.arange(n), np.searchsorted(offs, nl, "right") - 1]), kind="stable")
        end = np.append(start[1:], offs[-1])
        same = np.append(owner[1:] == owner[:-1], False)
        end = np.where(same, end - 1, offs[owner + 1])
        first_word = np.searchsorted(w.start, start)
        words = np.searchsorted(w.start, end) - first_word
        no = np.arange(len(start)) - np.searchsorted(owner, np.arange(n))[owner]
        has = words > 0
        start, end, owner, words, first_word, no = start[has], end[has], owner[has], words[has], first_word[has], no[has]
        h, lines = w.spans([(w.start, w.end), (start, end)])
        salt = mix(np.arange(1, n + 1, dtype=np.uint64))
        # Lines equal to an earlier one of their text.
        code, keys = pd.factorize(lines + salt[owner])
        firsts = np.zeros(len(lines), bool)
        at = np.zeros(len(keys), np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]
        firsts[at] = True
        # Words in windows of three that their text has twice or more.
        covered = np.zeros(len(h), np.int64)
        if len(h) > 2:
            k = np.flatnonzero(doc[2:] == doc[:-2])
            code, keys = pd.factorize(window_hashes(h, 3)[k] + salt[doc[k]])
            k = k[np.bincount(code, minlength=len(keys))[code] > 1]
            covered[k] = covered[k + 1] = covered[k + 2] = 1
        repeats = np.bincount(doc, covered, n).astype(np.int64)

        def of_line(flags: np.ndarray) -> np.ndarray:
            s = np.concatenate([[0], np.cumsum(flags)])
            return s[end] - s[start]

        def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return a / np.maximum(b, 1)

        symbols, alpha, digits = of_line(_SYMBOL[buf]), of_line(_ALPHA[buf]), of_line(_DIGIT[buf])
        s = np.concatenate([[0], np.cumsum(covered)])
        near = np.minimum(np.searchsorted(_NOTICE, h), len(_NOTICE) - 1)
        seen = np.concatenate([[0], np.cumsum(_NOTICE[near] == h)])
        notices = seen[first_word + words] - seen[first_word]
        last_byte = buf[w.end[first_word + words - 1] - 1] if len(start) else np.zeros(0, np.uint8)
        tests = (
            np.ones(len(start), bool), words < 3, (words >= 3) & (words < 8), (words >= 8) & (words < 20), (words >= 20) & (words < 50), words >= 50,
            share(symbols, words) > 0.05, share(symbols, words) > 0.3, share(of_line(_UPPER[buf]), alpha) > 0.5, share(of_line(buf == 33), words) > 0.3,
            share(of_line(buf == 124), words) > 0.2, share(s[first_word + words] - s[first_word], words) > 0.3, ~firsts, np.isin(last_byte, list(b".!?")),
            share(digits, digits + alpha) > 0.3, no == 0, np.append(owner[1:] != owner[:-1], True)[: len(owner)], notices > 0, share(notices, words) > 0.2,
        )
        bits = np.zeros(len(start), np.uint32)
        for i, t in enumerate(tests):
            bits |= t.astype(np.uint32) << np.uint32(i)
        signs = np.uint32(sum(1 << FEATURES.index(f) for f in SIGNS))
        bits |= (bits & signs == 0).astype(np.uint32) << np.uint32(FEATURES.index("no sign"))
        return Chunk(
            n_words=n_words,
            word_chars=per_text(~SPACE[buf] & ((buf & 0xC0) != 0x80), offs),
            n_symbols=per_text(_SYMBOL[buf], offs),
            n_dup_lines=np.bincount(owner, ~firsts, n).astype(np.int64),
            n_repeat_words=repeats,
            base_failed=(n_words < 50) | (100 * repeats > 50 * n_words),
            cut=np.searchsorted(owner, np.arange(n + 1)),
            line_words=words,
            bits=bits,
            line_no=no,
            line_start=start - offs[owner],
            line_end=end - offs[owner],
        )


def expand(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(FEATURES), dtype=np.uint32) & 1).astype(np.float64)


@dataclass
class Model:
    """Scores of each feature for each label, of each label after each, and of each label at the start."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    @staticmethod
    def zero() -> Model:
        return Model(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))

    def viterbi(self, bits: np.ndarray) -> np.ndarray:
        """The best labels of one text's lines; ties go to content."""
        return self.decode(bits, np.array([0, len(bits)]))

    def decode(self, bits: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The best labels of the lines of several texts: short ones side by side, line after line, long ones one by one."""
        kinds, code = np.unique(bits, return_inverse=True)
        e = (expand(kinds) @ self.emit)[code].reshape(-1, 2)
        out = np.empty(len(bits), np.int8)
        size = np.diff(cut)
        self._side(e, cut[:-1], size, np.flatnonzero((size > 0) & (size <= SIDE)), out)
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = self.start.tolist()
        for text in np.flatnonzero(size > SIDE).tolist():
            lo, hi = int(cut[text]), int(cut[text + 1])
            x = e[lo:hi].tolist()
            a, b = s0 + x[0][0], s1 + x[0][1]
            back = []
            for x0, x1 in x[1:]:
                c0, c1 = b + m10 >= a + m00, b + m11 >= a + m01
                a, b = (b + m10 if c0 else a + m00) + x0, (b + m11 if c1 else a + m01) + x1
                back.append((c0, c1))
            y = int(b >= a)
            out[hi - 1] = y
            for i in range(hi - 2, lo - 1, -1):
                y = int(back[i - lo][y])
                out[i] = y
        return out

    def _side(self, e: np.ndarray, first: np.ndarray, size: np.ndarray, texts: np.ndarray, out: np.ndarray) -> None:
        """Labels of the given texts, the longest first, so that at each line those that go on are the first ones."""
        if not len(texts):
            return
        texts = texts[np.argsort(-size[texts], kind="stable")]
        at, n = first[texts], size[texts]
        going = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # texts with so many lines or more
        a, b = self.start[0] + e[at, 0], self.start[1] + e[at, 1]
        back = []
        for t in range(1, int(n[0])):
            k = going[t]
            x, (p, q) = e[at[:k] + t], (a[:k], b[:k])
            c0, c1 = q + self.move[1, 0] >= p + self.move[0, 0], q + self.move[1, 1] >= p + self.move[0, 1]
            new = np.where(c0, q + self.move[1, 0], p + self.move[0, 0]) + x[:, 0], np.where(c1, q + self.move[1, 1], p + self.move[0, 1]) + x[:, 1]
            a[:k], b[:k] = new
            back.append((c0, c1))
        y = (b >= a).astype(np.int8)
        out[at + n - 1] = y
        for t in range(int(n[0]) - 1, 0, -1):
            k = going[t]
            c0, c1 = back[t - 1]
            y[:k] = np.where(y[:k] == 1, c1, c0)
            out[at[:k] + t - 1] = y[:k]


def likelihood(model: Model, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[float, Model]:
    """Log likelihood of padded sequences (x: sequences by lines of features) and its gradient, by forward and backward sums."""
    n, steps = y.shape
    on = np.arange(steps)[None] < size[:, None]
    e = x @ model.emit
    alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    alpha[:, 0] = model.start + e[:, 0]
    for t in range(1, steps):
        z = alpha[:, t - 1, :, None] + model.move
        new = np.logaddexp(z[:, 0], z[:, 1]) + e[:, t]
        alpha[:, t] = np.where(on[:, t, None], new, alpha[:, t - 1])
    norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    for t in range(steps - 2, -1, -1):
        z = model.move + (e[:, t + 1] + beta[:, t + 1])[:, None]
        beta[:, t] = np.where(on[:, t + 1, None], np.logaddexp(z[:, :, 0], z[:, :, 1]), beta[:, t + 1])
    post = np.exp(alpha + beta - norm[:, None, None]) * on[:, :, None]
    true = np.stack([y == 0, y == 1], 2) * on[:, :, None]
    pair = np.zeros((2, 2))
    if steps > 1:
        z = alpha[:, :-1, :, None] + model.move + (e + beta)[:, 1:, None, :]
        live = on[:, 1:, None, None]
        pair = (true[:, :-1, :, None] * true[:, 1:, None, :] * live).sum((0, 1)) - np.where(live, np.exp(z - norm[:, None, None, None]), 0).sum((0, 1))
    score = (true * e).sum() + (true[:, 0] * model.start).sum() + ((true[:, :-1, :, None] * true[:, 1:, None, :]) * model.move).sum() - norm.sum()
    return float(score), Model(np.einsum("ntf,nty->fy", x, true - post), pair, (true[:, 0] - post[:, 0]).sum(0))


def fit(sequences: list[tuple[np.ndarray, int | np.ndarray]], rounds: int = 60, rate: float = 0.2, decay: float = 1e-3, longest: int = 256) -> Model:
    """Adam on the mean log likelihood of labels, one for all lines of a sequence or one for each. A sequence over
    ``longest`` lines counts as several; no line is left out."""
    full = [(b, np.broadcast_to(np.asarray(y, np.int8), len(b))) for b, y in sequences]
    parts = [(b[i : i + longest], y[i : i + longest]) for b, y in full for i in range(0, len(b), longest)]
    parts.sort(key=lambda p: (len(p[0]), p[1].tobytes(), p[0].tobytes()))
    batches = []
    i = 0
    while i < len(parts):
        j = i
        while j < len(parts) and (j - i + 1) * len(parts[j][0]) <= 20_000:
            j += 1
        j = max(j, i + 1)
        size = np.array([len(p[0]) for p in parts[i:j]])
        x, y = np.zeros((j - i, size.max(), len(FEATURES))), np.zeros((j - i, size.max()), np.int8)
        for k, (b, label) in enumerate(parts[i:j]):
            x[k, : len(b)], y[k, : len(b)] = expand(b), label
        batches.append((x, y, size))
        i = j
    model = Model.zero()
    total = sum(b[2].sum() for b in batches)
    if not total:
        return model
    names = ("emit", "move", "start")
    m, v = Model.zero(), Model.zero()
    for r in range(1, rounds + 1):
        grads = [likelihood(model, *b)[1] for b in batches]
        for name in names:
            g = sum(getattr(d, name) for d in grads) / total - decay * getattr(model, name)
            a = 0.9 * getattr(m, name) + 0.1 * g
            b = 0.99 * getattr(v, name) + 0.01 * g * g
            setattr(m, name, a)
            setattr(v, name, b)
            setattr(model, name, getattr(model, name) + rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-9))
    return model


def fit_documents(documents: list[tuple[np.ndarray, np.ndarray, int]], min_share: float = MIN_SHARE, rounds: int = ROUNDS) -> Model:
    """The weights from (bits and words of the lines, label) of documents, whose lines' labels are found on the way."""
    plain = np.uint32(sum(1 << FEATURES.index(f) for f in PLAIN))

    def agrees(y: np.ndarray, words: np.ndarray, label: int) -> bool:
        return bool(words[y == CONTENT].sum() >= min_share * words.sum()) == (label == CONTENT)

    firsts = []
    for bits, words, label in documents:
        y = np.where(bits & plain, BOILERPLATE, CONTENT).astype(np.int8)
        firsts.append(y if agrees(y, words, label) else np.full(len(bits), label, np.int8))
    labels = firsts
    for _ in range(rounds):
        model = fit([(bits, y) for (bits, _, _), y in zip(documents, labels)])
        new = []
        for (bits, words, label), first in zip(documents, firsts):
            y = np.where((bits & plain != 0) & (first == BOILERPLATE), BOILERPLATE, model.viterbi(bits)).astype(np.int8)
            new.append(y if agrees(y, words, label) else first)
        if all(np.array_equal(a, b) for a, b in zip(new, labels)):
            break
        labels = new
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Fits the weights on at most ``most`` documents with a label 0 or 1; the driver holds twelve bytes a line of them."""
    pick = labels.where(F.col(quality).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(quality).cast("int").alias("_y"))
    pick = pick.orderBy(F.xxhash64(key), key).limit(most).select(F.col(key).alias("_k"), "_y")
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(pick), "_k").select("_k", "_y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, k, bits, words = b.column(1).to_numpy(), b.column(0), [], []
            for lo, hi, buf, offs in pieces(b.column(2)):
                c = Chunk.of(buf, offs)
                bits += [c.bits[i:j].tobytes() for i, j in zip(c.cut[:-1], c.cut[1:])]
                words += [c.line_words[i:j].tobytes() for i, j in zip(c.cut[:-1], c.cut[1:])]
            yield pa.RecordBatch.from_arrays([k, pa.array(y, pa.int32()), pa.array(bits, pa.binary()), pa.array(words, pa.binary())], names=["_k", "_y", "bits", "words"])

    got = rows.mapInArrow(run, f"_k {docs.schema[key].dataType.simpleString()}, _y int, bits binary, words binary")
    got = got.groupBy("_k", "_y").agg(F.min(F.struct("bits", "words")).alias("x")).collect()  # a row for each document picked
    got.sort(key=lambda r: (r["_k"], bytes(r["x"]["bits"])))
    return fit_documents([(np.frombuffer(r["x"]["bits"], np.uint32), np.frombuffer(r["x"]["words"], np.int64), r["_y"]) for r in got])


def label_lines(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, byte_start, byte_end, words, content): a row for each line that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in pieces(b.column(1)):
                c = Chunk.of(buf, offs)
                label = model.decode(c.bits, c.cut)
                doc = np.repeat(np.arange(lo, hi), np.diff(c.cut))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), pa.array(c.line_no, pa.int64()), pa.array(c.line_start, pa.int64()), pa.array(c.line_end, pa.int64()), pa.array(c.line_words, pa.int64()), pa.array(label == CONTENT)],
                    names=[key, "line", "byte_start", "byte_end", "words", "content"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, line long, byte_start long, byte_end long, words long, content boolean")


def _judge(c: Chunk, model: Model, min_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content lines, words in them, kept) of each text."""
    content = model.decode(c.bits, c.cut) == CONTENT

    def total(x: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(x)])
        return s[c.cut[1:]] - s[c.cut[:-1]]

    words = total(c.line_words * content)
    return total(content), words, ~c.base_failed & (words >= min_share * c.n_words)


def assess(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The counts, the share of words in content lines and the verdict of each row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in pieces(b.column(1)):
                c = Chunk.of(buf, offs)
                lines, words, kept = _judge(c, model, min_share)
                cols = [pa.array(getattr(c, n), pa.int64()) for n in names] + [pa.array(c.base_failed), pa.array(np.diff(c.cut), pa.int64()), pa.array(lines, pa.int64()), pa.array(words, pa.int64()), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], names=[key, *names, "base_failed", "n_lines", "n_content_lines", "n_content_words", "kept"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, n_lines long, n_content_lines long, n_content_words long, kept boolean")


def keep(df: DataFrame, model: Model, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows whose text is kept, with all their columns."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in pieces(b.column(at)):
                yield b.slice(lo, hi - lo).filter(pa.array(_judge(Chunk.of(buf, offs), model, min_share)[2]))

    return df.mapInArrow(run, df.schema)
