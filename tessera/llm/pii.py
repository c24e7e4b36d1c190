"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions, all in numpy.

Every character of every text goes through the network, in overlapping windows; the scores of overlapping windows are
averaged, weighted by the distance from a window's edge, and a Viterbi pass decides all labels of a text together. No
list of names, places or formats takes part; what is decoded only passes a check of form (an e-mail has its sign, a phone
number 7 to 18 digits, ...).

The pass is cut only at places where every label other than O loses whatever its neighbours are: the best path of the
whole text goes through O there, so the parts have the same labels as the whole.

The network is trained by ``pii_train`` from labelled spans; its weights are a file beside this module.

Scale: one pass over the texts, no shuffle. Texts are taken together up to ``BLOCK`` characters; the network holds
``CHUNK`` windows at a time however long a text is. Results don't depend on which texts are taken together.

Defined results: a null or empty text has no spans; positions are of the original text; repeated ids give the spans of
each row; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.names import _T2S

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
WINDOW, STRIDE, CHUNK = 192, 160, 512
#: Texts are taken together up to this number of characters.
BLOCK = 400_000
MODEL = Path(__file__).with_name("models") / "pii_bilstm_crf.npz"
#: Ids that aren't characters of the vocabulary: padding, then unknown ones by what they are.
PAD, OTHER, HAN, LATIN, DIGIT, N_FIXED = 0, 1, 2, 3, 4, 5


@cache
def _fold_table() -> np.ndarray:
    """Code point -> code point of the one character to which its width or script folds it."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp, ch in _T2S.items():
        table[cp] = ord(ch)
    for lo, hi in ((0xFF01, 0xFF5F), (0x2000, 0x200B), (0x3000, 0x3001), (0x00A0, 0x00A1)):
        for cp in range(lo, hi):
            n = unicodedata.normalize("NFKC", chr(cp))
            if len(n) == 1:
                table[cp] = ord(n)
    return table


def fold_codes(text: str) -> np.ndarray:
    """Code points with width and traditional characters folded; every character keeps its place."""
    return _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def fold_places(text: str) -> str:
    return fold_codes(text).tobytes().decode("utf-32-le", "surrogatepass")


def id_table(vocab: str) -> np.ndarray:
    """Code point -> id; characters outside the vocabulary by what they are."""
    table = np.full(0x110000, OTHER, np.int64)
    table[0x3400:0xA000] = HAN
    table[0x20000:0x32000] = HAN
    for cp in range(0x250):
        if chr(cp).isalpha():
            table[cp] = LATIN
    for cp in range(0x30, 0x3A):
        table[cp] = DIGIT
    for i, ch in enumerate(vocab):
        table[ord(ch)] = N_FIXED + i
    return table


class Tagger:
    """The network and its decoder."""

    def __init__(self, weights: dict[str, np.ndarray]):
        f32 = {k: np.asarray(v, np.float32) for k, v in weights.items() if k != "vocab"}
        self.table = id_table(str(weights["vocab"]))
        h = self.hidden = f32["Uf"].shape[0]
        # sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 2 / (1 + exp(-2 x)) - 1: one exp for all gates, which takes half the time of a
        # tanh; what a gate lets through is divided by its sum, and an infinite sum is right too. Both directions are in one
        # table
        sign = np.repeat(np.array([-1, -1, -2, -1], np.float32), h)
        self.proj = np.concatenate([(f32["E"] @ f32["W" + d] + f32["b" + d]) * sign for d in "fb"])
        self.rec = np.stack([f32["U" + d] * sign for d in "fb"])
        self.out = np.stack([f32["O"][:h], f32["O"][h:]])
        self.room = np.empty(0, np.float32)  # of the states, kept from call to call
        self.out_b, self.trans, self.first = f32["ob"], f32["T"], f32["T0"]
        # what a label other than O may at most gain by its transitions, over O between the same neighbours
        t = self.trans
        inner = t[:, 1:, None] + t[None, 1:, :] - t[:, :1, None] - t[None, :1, :]
        ends = np.concatenate([(t[:, 1:] - t[:, :1]).ravel(), (self.first[1:, None] + t[1:] - self.first[0] - t[:1]).ravel(), self.first[1:] - self.first[0]])
        self.gain = float(max(inner.max(), ends.max())) + 1e-3

    @classmethod
    def load(cls, path: str | Path = MODEL) -> Tagger:
        with np.load(path, allow_pickle=False) as z:
            return cls({k: z[k] for k in z.files})

    def _run(self, ids: np.ndarray) -> np.ndarray:
        """Scores (T, 2, B, labels) of both directions; ids: (T, 2, B), the second one read backwards."""
        t, _, b = ids.shape
        h = self.hidden
        state, cell, tmp = (np.zeros((2, b, h), np.float32) for _ in range(3))
        z, given = np.empty((2, b, 4 * h), np.float32), np.empty((2, b, 4 * h), np.float32)
        let_in, keeps, new, let_out = (z[:, :, k * h : (k + 1) * h] for k in range(4))
        if self.room.size < t * 2 * b * h:
            self.room = np.empty(t * 2 * b * h, np.float32)
        keep = self.room[: t * 2 * b * h].reshape(t, 2, b, h)
        ids = ids + np.array([0, len(self.proj) // 2])[:, None]
        with np.errstate(over="ignore"):
            for k in range(t):
                np.matmul(state, self.rec, out=z)
                self.proj.take(ids[k], axis=0, out=given, mode="clip")
                z += given
                np.exp(z, out=z)
                z += 1
                cell /= keeps
                np.divide(4, new, out=tmp)
                tmp -= 2
                tmp /= let_in
                cell += tmp  # twice the cell: tanh(x) = 1 - 2 / (1 + exp(2 x))
                np.exp(cell, out=tmp)
                tmp += 1
                np.divide(2, tmp, out=tmp)
                state = keep[k]
                np.subtract(1, tmp, out=state)
                state /= let_out
        return np.matmul(keep, self.out)

    def scores(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores (places, labels) of texts that lie one behind the other in ``ids``."""
        acc, weight = np.zeros((len(ids), len(LABELS)), np.float32), np.zeros(len(ids), np.float32)
        n_windows = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
        owner = np.repeat(np.arange(len(size)), n_windows)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        width, begin = np.minimum(WINDOW, size[owner] - k * STRIDE), start[owner] + k * STRIDE
        order = np.argsort(width, kind="stable")
        for at in range(0, len(order), CHUNK):
            rows = order[at : at + CHUNK]
            n, a = width[rows], begin[rows]
            t = np.arange(int(n.max()))[:, None]
            e = self._run(ids[np.stack([a + np.minimum(t, n - 1), a + np.maximum(n - 1 - t, 0)], axis=1)])
            same = n[0] == n[-1]  # all at once where the windows have one width
            both = e[:, 0]
            both += e[::-1, 1] if same else e[np.maximum(n - 1 - t, 0), 1, np.arange(len(n))]
            w = np.minimum(t + 1, n - t).astype(np.float32)  # beyond a window's end nothing is read
            both *= w[:, :1, None] if same else w[:, :, None]
            both, w = np.ascontiguousarray(both.transpose(1, 0, 2)), np.ascontiguousarray(w.T)
            for j, (m, lo) in enumerate(zip(n.tolist(), a.tolist(), strict=True)):
                acc[lo : lo + m] += both[j, :m]
                weight[lo : lo + m] += w[j, :m]
        acc /= weight[:, None]
        acc += self.out_b
        return acc

    def decode(self, scores: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label sequences (T, B) of scores (T, labels, B), each up to its length; ``first``: (labels, B)."""
        t, n, b = scores.shape
        best = np.empty((t, n, b), np.float32)
        best[0] = scores[0] + first
        step = np.empty((n, n, b), np.float32)
        for k in range(1, t):
            np.add(best[k - 1][:, None, :], self.trans[:, :, None], out=step)
            step.max(0, out=best[k])
            best[k] += scores[k]
            if not k % 256:  # long sums would lose their digits
                best[k] -= best[k].max(0)
        rows, out = np.arange(b), np.zeros((t, b), np.int8)
        cur = np.zeros(b, np.int64)
        for k in range(t - 1, -1, -1):
            begins = k == lengths - 1
            came = cur if k == t - 1 else (best[k] + self.trans[:, cur]).argmax(0)
            cur = np.where(begins, best[k].argmax(0), came)
            out[k] = np.where(k < lengths, cur, 0)
        return out

    def labels(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The label of every place of texts that lie one behind the other."""
        out = np.zeros(len(ids), np.int8)
        acc = self.scores(ids, start, size)
        best = acc[:, 1].copy()
        for j in range(2, len(LABELS)):
            np.maximum(best, acc[:, j], out=best)
        doubtful = best - acc[:, 0] > -self.gain
        opens = np.zeros(len(ids) + 1, bool)
        opens[start] = True  # no part goes over from a text to the next one
        before = np.concatenate([[False], doubtful[:-1]]) & ~opens[:-1]
        a = np.flatnonzero(doubtful & ~before)
        after = np.concatenate([doubtful[1:], [False]]) & ~opens[1:]
        lengths = np.flatnonzero(doubtful & ~after) + 1 - a
        at_start, at_end = opens[a], np.isin(a + lengths, start) | (a + lengths == len(ids))
        order, at = np.argsort(lengths, kind="stable"), 0
        while at < len(order):
            n = 1  # as many as fit
            while at + n < len(order) and n < 4 * CHUNK and (n + 1) * lengths[order[at + n]] <= CHUNK * WINDOW:
                n += 1
            rows = order[at : at + n]
            size_, at = lengths[rows], at + n
            t = np.arange(int(size_.max()))[:, None]
            where = a[rows] + np.minimum(t, size_ - 1)
            s = acc[where]
            # the part is followed by O unless the text ends
            s[size_ - 1, np.arange(n)] += np.where(at_end[rows], 0, 1)[:, None] * self.trans[:, 0]
            first = np.where(at_start[rows], self.first[:, None], self.trans[0][:, None])
            lab = self.decode(np.ascontiguousarray(s.transpose(0, 2, 1)), size_, first)
            inside = t < size_
            out[where[inside]] = lab[inside]
        return out

    def tag(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of the spans of each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        group, n = [], 0
        for i, t in enumerate(texts):
            if t:
                group.append(i)
                n += len(t)
            if group and (n >= BLOCK or i == len(texts) - 1):
                self._tag_block(texts, group, out)
                group, n = [], 0
        return out

    def _tag_block(self, texts: list[str], group: list[int], out: list) -> None:
        codes = [fold_codes(texts[i]) for i in group]
        size = np.array([len(c) for c in codes])
        begin = np.cumsum(size) - size
        lab = np.concatenate([self.labels(self.table[np.concatenate(codes)], begin, size), [0]])
        first = np.flatnonzero(lab % 2 == 1)
        goes_on = (lab[1:] > 0) & (lab[1:] % 2 == 0) & ((lab[:-1] == lab[1:]) | (lab[:-1] == lab[1:] - 1))
        goes_on[begin[1:] - 1] = False  # no span goes over from a text to the next one
        stop = np.flatnonzero(~goes_on) + 1
        last = stop[np.searchsorted(stop, first + 1)]
        which = np.searchsorted(begin, first, "right") - 1
        for s, e, w in zip(first.tolist(), last.tolist(), which.tolist(), strict=True):
            i, b = group[w], int(begin[w])
            folded = codes[w]
            span = checked(TYPES[int(lab[s]) // 2], folded, s - b, e - b)
            if span:
                out[i].append(span)


_NUMERALS = "一二三四五六七八九〇零"


def checked(kind: str, codes: np.ndarray, a: int, b: int) -> tuple[str, int, int] | None:
    """The span without blanks and marks at its ends if it has the form of its type; a span that begins within a word or
    number begins with it, one that ends within a Latin word ends with it."""
    lo = max(0, a - 40)
    near = codes[lo : b + 40].tobytes().decode("utf-32-le", "surrogatepass")
    a, b = a - lo, b - lo
    while a < b and near[a] in " \n\t:：,，;；|":
        a += 1
    while b > a and near[b - 1] in " \n\t:：,，;；|":
        b -= 1
    if a >= b:
        return None
    if kind == "PHONE" and near[a] == "(" and ")" not in near[a:b]:
        a += 1
    if kind == "PHONE" and a and near[a - 1] == "(" and 0 < near[a:b].find(")") < 6:
        a -= 1
    inner = {"EMAIL": r"[A-Za-z0-9._%+-]+$", "PHONE": r"\+?\d+$", "ID_NUMBER": r"[A-Za-z0-9]+$", "ADDRESS": r"\d+$", "NAME": r"[A-Za-z]+$"}[kind]
    if near[a].isascii() and near[a].isalnum() and (m := re.search(inner, near[:a])):
        a -= len(m[0])
    if kind in ("NAME", "EMAIL") and near[b - 1].isascii() and near[b - 1].isalpha() and (m := re.match(r"[A-Za-z]+", near[b:])):
        b += len(m[0])
    while kind == "PHONE" and a and near[a] in _NUMERALS and near[a - 1] in _NUMERALS:
        a -= 1
    s = near[a:b]
    digits = sum(ch.isdigit() or ch in _NUMERALS for ch in s)
    if kind == "EMAIL":
        ok = "@" in s or "at" in s.lower()
    elif kind == "PHONE":
        ok = 7 <= digits <= 18 and "*" not in s
    elif kind == "ID_NUMBER":
        ok = 7 <= digits <= 18 and "*" not in s
    elif kind == "ADDRESS":
        ok = digits > 0 and len(s) > 4
    else:
        ok = sum(ch.isalpha() for ch in s) >= 2 and digits <= sum(ch in _NUMERALS for ch in s)
    return (kind, lo + a, lo + b) if ok else None


@cache
def _tagger(path: str) -> Tagger:
    return Tagger.load(path)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, pii_type, char_start, char_end), one row per occurrence; places count from 0 in the original text."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = str(model or MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(path)
        for b in batches:
            rows = [(i, *span) for i, spans in enumerate(tagger.tag(b.column(1).to_pylist())) for span in spans]
            if rows:
                i, t, a, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(t), pa.array(a, pa.int64()), pa.array(e, pa.int64())], [id_col, "pii_type", "char_start", "char_end"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, pii_type string, char_start bigint, char_end bigint")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, clean_text, n_replaced): texts with typed placeholders such as [NAME] in place of what was found."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = str(model or MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            clean, counts = [], []
            for text, spans in zip(texts, tagger.tag(texts), strict=True):
                at, bits = 0, []
                for t, a, e in spans:
                    bits += [text[at : max(at, a)], f"[{t}]"]
                    at = e
                clean.append(None if text is None else "".join(bits) + text[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), pa.array(counts, pa.int32())], [id_col, "clean_text", "n_replaced"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, clean_text string, n_replaced int")


def pii_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n_spans"))
