"""python -m tessera.llm.pii_train DOCUMENTS HOLDERS RANKS OUT: train the tagger of ``pii`` from labelled spans, in numpy alone.

Spans are labelled on a bounded sample (``SAMPLE`` documents, the documented bound) by labelling rules for this kind of
disclosure. So that the network learns what a name, a number or an address is and not which ones there are, most spans are
replaced by invented ones whenever a text is drawn: names of any surname with any characters, foreign names in either
script, other digits, other roads; invented sentences and
runs of ordinary words (``words``; RANKS is a public tokenizer's rank file) are put between the text's own; masked names, organisations'
numbers and words that begin like a surname stand among them unlabelled. A tenth of the sample is held out and reported,
as it is and with its names replaced.
"""

from __future__ import annotations

import multiprocessing as mp
import os
import re
import sys
import time
from collections import Counter
from collections.abc import Iterator

import numpy as np

from tessera.llm.names import _READING, COMPOUND_SURNAMES, parse_person
from tessera.llm.pii import LABELS, N_FIXED, PAD, TYPES, Tagger, checked, fold_codes, fold_places, id_table
from tessera.llm.pii_invent import Inventor
from tessera.llm.words import chinese_words, english_words

SAMPLE = 20_000
EMBED, HIDDEN, WINDOW = 48, 24, 128
#: Transitions stay within these bounds, so that most of a text is surely outside spans (see ``pii``).
BOUND = 1.0
# One-character surnames of the labelling rules.
SURNAMES = "何杜阎邓于宋方范吴贾彭蒋傅丁黄董冯曹程陈林钟朱谢胡高袁郑魏夏廖孙田梁沈徐薛曾苏郭周石任潘汪许马韩罗叶吕唐谭姚萧卢戴余姜蔡王李张刘赵杨"
_LATIN_SURNAMES = frozenset({*(_READING[c] for c in SURNAMES), "ouyang", "shangguan", "situ", "yuchi", "lyu", "lv"})
_SYLLABLES = "|".join(sorted(set(_READING.values()), key=len, reverse=True))
_GIVEN_LATIN = re.compile(rf"(?:{_SYLLABLES})(?:[-\s]?(?:{_SYLLABLES}))?$", re.I)
_WORD = re.compile(r"\b[A-Z][A-Za-z]*(?:-[A-Za-z]+)?\b")
_JOIN = re.compile(r",?\s{1,2}")
_COMPANY = re.compile(r"\s*(?:Co\b|Co\.|Ltd|Inc|LP\b|Chemical|Electronics|Foods|Media|Road|Street|Avenue|Lane)")


def latin_names(text: str) -> Iterator[tuple[int, int]]:
    """Places of a surname beside a given name of one or two words in Latin letters, in either order."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    n, i = len(words), 0
    while i + 1 < n:
        run = [i]
        while len(run) < 3 and run[-1] + 1 < n and _JOIN.fullmatch(text, words[run[-1]][1], words[run[-1] + 1][0]):
            run.append(run[-1] + 1)
        low = [text[words[k][0] : words[k][1]].lower() for k in run]
        for size in (3, 2):
            if len(low) < size:
                continue
            if (low[0] in _LATIN_SURNAMES and _GIVEN_LATIN.match(" ".join(low[1:size]))) or (low[size - 1] in _LATIN_SURNAMES and _GIVEN_LATIN.match(" ".join(low[: size - 1]))):
                yield words[i][0], words[run[size - 1]][1]
                i += size - 1
                break
        i += 1


_UNLABELLED = re.compile(r"400\D|[^\s]{1,2}某")


def squeeze(text: str) -> tuple[str, list[int]]:
    """The text without blanks beside CJK characters and without markup, and the place of each character left."""
    drop = np.zeros(len(text), bool)
    for m in re.finditer(r"</?[a-zA-Z][^<>\n]*>|&nbsp;", text):
        drop[m.start() : m.end()] = True
    for m in re.finditer(r"[ \t]+", text):
        a, b = m.start() - 1, m.end()
        if (a >= 0 and "一" <= text[a] <= "鿿") or (b < len(text) and "一" <= text[b] <= "鿿"):
            drop[m.start() : m.end()] = True
    at = np.flatnonzero(~drop).tolist()
    return "".join(text[i] for i in at), at


class Labeller:
    """Labelling rules. ``given``: characters of given names; ``towns``, ``provinces``, ``districts``: parts of addresses;
    ``roads``: names of roads, those seen behind a district."""

    def __init__(self, given: str, towns: set[str], provinces: set[str], districts: set[str], roads: set[str]):
        alt = lambda xs: "|".join(sorted(map(re.escape, xs), key=len, reverse=True)) or "(?!)"
        one = f"[{SURNAMES}]"
        g = f"[{given}]"
        self.name = re.compile(rf"(?:{alt(COMPOUND_SURNAMES)}|{one})·?{g}(?:·?{g})?")
        self.places = re.compile(rf"(?:{alt(towns | provinces)})(?:市|省|会议|基地|海关|厂区|监管|$)?|{alt(districts)}")
        admin = rf"(?:(?:{alt(provinces)})省)?(?:(?:{alt(towns)})市)?(?:{alt(districts)})?"
        number = r"\d+(?:-\d+)?(?:号|弄|座)?"
        self.address = re.compile(rf"{admin}(?:(?:{alt(roads)}){number}|[一-鿿]{{2,4}}[镇乡][一-鿿]{{2,3}}村(?:\d+组)?\d+号?)(?:[一-鿿]{{2,3}}(?:小区|小區))?(?:\d+[栋幢棟](?:\d+单元)?\d+室?|\d+号\d+室)?")
        self.company = re.compile(r"(?:注册|办公|注冊|辦公)(?:地址|地)\s*[:：]?\s*$")
        # the whole of a number in one shape or another
        self.email = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\s?(?:@|[(\[]\s?at\s?[)\]])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[(\[]\s?dot\s?[)\]])\s?[A-Za-z]{2,})+", re.I)
        mobile = r"(?:(?:\((?:\+|00)?86\)|(?:\+|00)?86)[\s-]?)?1[3-9]\d(?:[\s.-]?\d{4}[\s.-]?\d{4}|\d{3}\s\d{5})"
        land = r"(?:(?:\+|00)86[\s-]?)?(?:\(0\d{2,3}\)\s?|0\d{2,3}[\s-]?|(?<=86-)\d{3}-)\d{3,4}[\s-]?\d{4}(?:转\d{1,5})?"
        self.phone = re.compile(rf"(?<![\d*A-Za-z])(?<!\d[,.])(?:{mobile}|{land}|\+86-\d{{3}}-\d{{7,8}}|\+1\s?\(\d{{3}}\)\s?\d{{3}}-\d{{4}})(?![\d*股]|[,.]\d|万|元)|(?<![一二三四五六七八九〇零])[一二三四五六七八九〇零]{{11}}(?![一二三四五六七八九〇零])")
        self.ident = re.compile(r"(?<![A-Za-z\d])(?:99\d{4}[\s-]?(?:19|20)\d{6}[\s-]?\d{3}[\dXx]|99\d{13}|(?:E[A-Z]?|[GHCMP])\d{7,8})(?![A-Za-z\d])")
        self.flat = re.compile(r"(?:Flat\s[A-Z],\s?\d+/F,\s?|Room\s\d+,\s?(?:No\.?\s?)?|Unit\s\w+,\s?|No\.\s?)?\d+\s(?:[A-Z][a-zA-Z]+\s){1,3}(?:Road|Street|Avenue|Lane|ROAD|STREET|AVENUE|LANE)\b", re.I)
        self.office = re.compile(r"(?:Registered|Principal|Head)\s+(?:office|address)[^.]{0,20}$", re.I)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(type, start, end) in a folded text, not overlapping."""
        s, at = squeeze(text)
        codes = fold_codes(text)
        found = []
        for kind, pattern in (("EMAIL", self.email), ("ID_NUMBER", self.ident), ("PHONE", self.phone), ("ADDRESS", self.address), ("ADDRESS", self.flat)):
            for m in pattern.finditer(s):
                before = s[max(0, m.start() - 40) : m.start()]
                if kind == "ADDRESS" and (self.company.search(before) or self.office.search(before)):
                    found.append(("", m.start(), m.end()))
                    continue
                found.append((kind, m.start(), m.end()))
        for m in self.name.finditer(s):
            tail = s[m.end() : m.end() + 2]
            if re.match(r"[区市县镇乡省街路]", tail) or (s[m.start() - 2 : m.start()] == "对手") or (s[m.start()] == "方" and s[m.start() - 3 : m.start()] in (",对手", "，对手")):
                continue
            if self.places.match(s, m.start()) or self.places.match(s, m.start() + 1) or re.match(r"(?:股权|控股|投资|资产|集团|股份|科技|有限|证券|银行|系客户)", s[m.end() : m.end() + 3]):
                continue
            found.append(("NAME", m.start(), m.end()))
        for a, b in latin_names(s):
            if not _COMPANY.match(s[b:]):
                found.append(("NAME", a, b))
        found.sort(key=lambda x: (x[1], -(x[2] - x[1])))
        out, end = [], 0
        for kind, a, b in found:
            if a >= end:
                end = b
                if kind and (span := checked(kind, codes, at[a], at[b - 1] + 1)) and not _UNLABELLED.match(text, span[1]):
                    out.append(span)
        return out


def build_labeller(texts: list[str], holders: list[str], places: list[str]) -> Labeller:
    given: Counter = Counter()
    for h in holders:
        p = parse_person(h)
        if p and p.han:
            given.update(p.given)
    towns, provinces, districts = set(), set(), set()
    for p in places:
        m = re.match(r"\s*(?:([一-鿿]{2,3})省)?(?:([一-鿿]{2,4}?)市)?([一-鿿]{2,4}(?:区|县))?$", p or "")
        if m:
            provinces |= {m[1]} - {None}
            towns |= {m[2]} - {None}
            districts |= {m[3]} - {None}
    seen: Counter = Counter()
    behind = re.compile(rf"(?:{'|'.join(sorted(districts, key=len, reverse=True))})([一-鿿]{{2,5}}?(?:路|街|大道|巷|里|弄))\d")
    for t in texts:
        seen.update(m[1] for m in behind.finditer(squeeze(t)[0]))
    return Labeller("".join(c for c, n in given.items() if n >= 5), towns, provinces, districts, {r for r, n in seen.items() if n >= 3})


Text = tuple[str, list[tuple[str, int, int]]]


def windows(texts: list[Text], table: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels (windows, WINDOW) of texts, cut at random offsets; of windows without a span some."""
    xs, ys = [], []
    for t, spans in texts:
        ids, lab = table[fold_codes(t)], np.zeros(len(t), np.int8)
        for kind, a, b in spans:
            k = TYPES.index(kind)
            lab[a], lab[a + 1 : b] = 2 * k + 1, 2 * k + 2
        at = 0 if len(t) <= WINDOW else -int(rng.integers(WINDOW // 2))
        for s in range(at, len(t), WINDOW):
            lo, hi = max(0, s), min(len(t), s + WINDOW)
            if lab[lo:hi].any() or rng.random() < 0.4:
                x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int8)
                x[: hi - lo], y[: hi - lo] = ids[lo:hi], lab[lo:hi]
                xs.append(x)
                ys.append(y)
    return (np.stack(xs), np.stack(ys)) if xs else (np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int8))


class Trainer:
    """Parameters and gradients; parameters lie in one array that processes may share."""

    def __init__(self, n_vocab: int, flat: np.ndarray | None = None, seed: int = 0):
        h, n = HIDDEN, len(LABELS)
        shapes = {"E": (n_vocab, EMBED), "O": (2 * h, n), "ob": (n,), "T": (n, n), "T0": (n,)}
        for d in "fb":
            shapes |= {"W" + d: (EMBED, 4 * h), "U" + d: (h, 4 * h), "b" + d: (4 * h,)}
        self.shapes = shapes
        self.flat = np.zeros(sum(map(np.prod, shapes.values())), np.float32) if flat is None else flat
        self.p = self.split(self.flat)
        if flat is None:
            r = np.random.default_rng(seed)
            for k, v in self.p.items():
                if v.ndim == 2 and k != "T":
                    v[:] = r.standard_normal(v.shape) * (0.3 if k == "E" else 1 / np.sqrt(v.shape[0]))
            for d in "fb":
                self.p["b" + d][h : 2 * h] = 1  # remember at first
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def _forward(self, d: str, x: np.ndarray, live: np.ndarray):
        """x: (T, B, EMBED); keeps what the backward pass needs."""
        t, b, _ = x.shape
        h = HIDDEN
        z_in = x @ self.p["W" + d] + self.p["b" + d]
        hs, cs, gates = np.zeros((t, b, h), np.float32), np.zeros((t, b, h), np.float32), np.zeros((t, b, 4 * h), np.float32)
        state = cell = np.zeros((b, h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[k] + state @ self.p["U" + d]
            z[:, : 2 * h] = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 2 * h])
            z[:, 2 * h : 3 * h] = np.tanh(z[:, 2 * h : 3 * h])
            z[:, 3 * h :] = 0.5 + 0.5 * np.tanh(0.5 * z[:, 3 * h :])
            cell = (z[:, h : 2 * h] * cell + z[:, :h] * z[:, 2 * h : 3 * h]) * live[k]
            state = z[:, 3 * h :] * np.tanh(cell) * live[k]
            gates[k], hs[k], cs[k] = z, state, cell
        return hs, cs, gates

    def _backward(self, d: str, x, live, hs, cs, gates, dh_out, grad):
        t, b, _ = x.shape
        h = HIDDEN
        u = self.p["U" + d]
        dz_all = np.zeros((t, b, 4 * h), np.float32)
        dh = dc = np.zeros((b, h), np.float32)
        zero = np.zeros((b, h), np.float32)
        for k in range(t - 1, -1, -1) if d == "f" else range(t):
            prev = k - 1 if d == "f" else k + 1
            c_prev = cs[prev] if 0 <= prev < t else zero
            z = gates[k]
            i, f, g, o = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            tc = np.tanh(cs[k])
            dh = (dh + dh_out[k]) * live[k]
            dc = (dc + dh * o * (1 - tc * tc)) * live[k]
            dz = dz_all[k]
            dz[:, :h] = dc * g * i * (1 - i)
            dz[:, h : 2 * h] = dc * c_prev * f * (1 - f)
            dz[:, 2 * h : 3 * h] = dc * i * (1 - g * g)
            dz[:, 3 * h :] = dh * tc * o * (1 - o)
            dh, dc = dz @ u.T, dc * f
        h_prev = np.concatenate([np.zeros((1, b, h), np.float32), hs[:-1]]) if d == "f" else np.concatenate([hs[1:], np.zeros((1, b, h), np.float32)])
        flat = dz_all.reshape(-1, 4 * h)
        grad["W" + d] = x.reshape(-1, EMBED).T @ flat
        grad["U" + d] = h_prev.reshape(-1, h).T @ flat
        grad["b" + d] = flat.sum(0)
        return (flat @ self.p["W" + d].T).reshape(t, b, EMBED)

    def gradient(self, ids: np.ndarray, labels: np.ndarray, out: np.ndarray) -> tuple[float, float]:
        """Summed loss and number of characters of a batch (B, T); the summed gradient goes to ``out``."""
        ids, labels = ids.T, labels.T.astype(np.int64)
        t, b = ids.shape
        live = (ids > PAD).astype(np.float32)[:, :, None]
        x = self.p["E"][ids]
        keep = {d: self._forward(d, x, live) for d in "fb"}
        hid = np.concatenate([keep["f"][0], keep["b"][0]], axis=2)
        scores = hid @ self.p["O"] + self.p["ob"]
        loss, d_scores, grad = self._crf(scores, labels, live[:, :, 0])
        flat = d_scores.reshape(-1, d_scores.shape[2])
        grad["O"], grad["ob"] = hid.reshape(-1, hid.shape[2]).T @ flat, flat.sum(0)
        d_hid = d_scores @ self.p["O"].T
        dx = self._backward("f", x, live, *keep["f"], np.ascontiguousarray(d_hid[:, :, :HIDDEN]), grad) + self._backward("b", x, live, *keep["b"], np.ascontiguousarray(d_hid[:, :, HIDDEN:]), grad)
        g = self.split(out)
        g["E"][:] = 0
        np.add.at(g["E"], ids.ravel(), dx.reshape(-1, EMBED))
        for k in g:
            if k != "E":
                g[k][:] = grad[k]
        return loss, float(live.sum())

    def _crf(self, scores, labels, live):
        """Negative log likelihood of the label paths and its gradients; padding stands at the end."""
        t, b, n = scores.shape
        trans, first = self.p["T"], self.p["T0"]
        lse = lambda a, ax: (m := a.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(ax))
        alpha, beta = np.zeros((t, b, n), np.float32), np.zeros((t, b, n), np.float32)
        alpha[0] = first + scores[0]
        for k in range(1, t):
            new = lse(alpha[k - 1][:, :, None] + trans, 1) + scores[k]
            alpha[k] = np.where(live[k][:, None] > 0, new, alpha[k - 1])
        for k in range(t - 2, -1, -1):
            new = lse(trans + (scores[k + 1] + beta[k + 1])[:, None, :], 2)
            beta[k] = np.where(live[k + 1][:, None] > 0, new, 0)
        z = lse(alpha[-1], 1)
        rows = np.arange(b)
        d = np.exp(alpha + beta - z[:, None]) * live[:, :, None]
        gold = first[labels[0]] + scores[0, rows, labels[0]]
        d_first = d[0].sum(0)
        np.subtract.at(d_first, labels[0], 1)
        d_trans = np.zeros_like(trans)
        for k in range(1, t):
            on = live[k] > 0
            if not on.any():
                break
            pair = np.exp(alpha[k - 1][on][:, :, None] + trans + (scores[k] + beta[k])[on][:, None, :] - z[on][:, None, None])
            d_trans += pair.sum(0)
            np.subtract.at(d_trans, (labels[k - 1][on], labels[k][on]), 1)
            gold[on] += trans[labels[k - 1][on], labels[k][on]] + scores[k, rows[on], labels[k][on]]
        for k in range(t):
            d[k, rows, labels[k]] -= live[k]
        return float((z - gold).sum()), d, {"T": d_trans, "T0": d_first}

    def adam(self, g: np.ndarray, rate: float, b1: float = 0.9, b2: float = 0.999) -> None:
        g = g * min(1.0, 1.0 / (float(np.sqrt((g * g).sum())) + 1e-9))
        self.t += 1
        self.m += (1 - b1) * (g - self.m)
        self.v += (1 - b2) * (g * g - self.v)
        self.flat -= rate * (self.m / (1 - b1**self.t)) / (np.sqrt(self.v / (1 - b2**self.t)) + 1e-8)


def evaluate(tagger: Tagger, texts: list[Text]) -> dict[str, tuple[int, int, int]]:
    """By type: labelled starts, found starts, those in both."""
    out = {t: [0, 0, 0] for t in TYPES}
    for (_, want), got in zip(texts, tagger.tag([t for t, _ in texts]), strict=True):
        for k in TYPES:
            w, h = {a for kind, a, _ in want if kind == k}, {a for kind, a, _ in got if kind == k}
            out[k] = [out[k][0] + len(w), out[k][1] + len(h), out[k][2] + len(w & h)]
    return {k: tuple(v) for k, v in out.items()}


def _work(rank: int, texts: list[Text], table, n_vocab: int, params, grads, sums, barrier, stop, batch: int, seed: int) -> None:
    rng = np.random.default_rng([seed, rank])
    invent = Inventor(rng, *ordinary)
    t = Trainer(n_vocab, np.frombuffer(params, np.float32))
    out = np.frombuffer(grads, np.float32).reshape(-1, len(t.flat))[rank]
    x, y = np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int8)
    while True:
        while len(x) < 8 * batch:  # windows of many texts, mixed
            a, b = windows([invent.vary(*texts[i]) for i in rng.integers(0, len(texts), 40)], table, rng)
            x, y = np.concatenate([x, a]), np.concatenate([y, b])
        rows = rng.permutation(len(x))
        used = rows[:batch]
        ids = x[used].copy()
        # any character may be one that was never seen
        blind = (rng.random(ids.shape) < 0.02) & (ids >= N_FIXED)
        ids[blind] = t_kind[ids[blind]]
        longest = int((ids > PAD).sum(1).max())
        sums[2 * rank], sums[2 * rank + 1] = t.gradient(ids[:, :longest], y[used][:, :longest], out)
        x, y = x[rows[batch:]], y[rows[batch:]]
        barrier.wait()  # gradients are there
        barrier.wait()  # parameters are new
        if stop.value:
            return


t_kind = np.zeros(0, np.int64)  # id -> id of an unknown character of its kind
ordinary: tuple = ()  # Chinese and English words


def train(texts: list[Text], out: str, *, ranks: str, seconds: float = 400, batch: int = 96, rate: float = 1e-2, workers: int = 8, seed: int = 0) -> None:
    global t_kind, ordinary
    ordinary = (chinese_words(), english_words(ranks))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, used = [texts[i] for i in order[: len(texts) // 10]], [texts[i] for i in order[len(texts) // 10 :]]
    invent = Inventor(rng, *ordinary)
    counts = Counter(ch for t, _ in used for ch in t)
    counts.update({ch: 5 for ch in invent.characters()})
    counts.update({ch: 5 for w in invent.chinese for ch in w})
    vocab = "".join(sorted(ch for ch, n in counts.items() if n >= 5 and not 0xD800 <= ord(ch) < 0xE000))
    table, plain = id_table(vocab), id_table("")
    n_ids = N_FIXED + len(vocab)
    t_kind = np.concatenate([np.arange(N_FIXED), plain[[ord(c) for c in vocab]]])
    varied = [invent.vary(*x) for x in held]
    first = Trainer(n_ids, seed=seed)
    params, grads = mp.RawArray("f", len(first.flat)), mp.RawArray("f", len(first.flat) * workers)
    sums, barrier, stop = mp.RawArray("d", 2 * workers), mp.Barrier(workers + 1), mp.RawValue("i", 0)
    flat = np.frombuffer(params, np.float32)
    flat[:] = first.flat
    t = Trainer(n_ids, flat)
    g = np.frombuffer(grads, np.float32).reshape(workers, -1)
    pool = [mp.Process(target=_work, args=(r, used, table, n_ids, params, grads, sums, barrier, stop, batch, seed), daemon=True) for r in range(workers)]
    for p in pool:
        p.start()
    began, n, losses = time.time(), 0, []
    while not stop.value:
        barrier.wait()
        s = np.array(sums[:])
        spent = (time.time() - began) / seconds
        t.adam(g.sum(0) / s[1::2].sum(), rate * max(0.01, min(1.0, n / 50, 1.02 - spent)))
        np.clip(t.p["T"], -BOUND, BOUND, out=t.p["T"])
        losses.append(s[::2].sum() / s[1::2].sum())
        n += 1
        stop.value = int(spent >= 1)
        barrier.wait()
        if not n % 500:
            print(f"step {n}: loss {np.mean(losses[-500:]):.5f}, {time.time() - began:.0f} s", flush=True)
    for p in pool:
        p.join()
    weights = {k: v.astype(np.float16) for k, v in t.p.items()}
    np.savez_compressed(out, vocab=np.array(vocab), **weights)
    tagger = Tagger.load(out)
    print("as it is", evaluate(tagger, held), flush=True)
    print("invented", evaluate(tagger, varied), flush=True)


def main() -> None:
    import pyarrow.parquet as pq

    documents, holders, ranks, out = sys.argv[1:5]
    texts = [t for d in documents.split(",") for t in pq.read_table(d, columns=["text"]).column("text").to_pylist()][:SAMPLE]
    h = pq.read_table(holders, columns=["name", "entity_type", "registered_place"])
    people = [n for n, k in zip(h.column("name").to_pylist(), h.column("entity_type").to_pylist(), strict=True) if k == "PERSON"]
    folded = [fold_places(t or "") for t in texts]
    labeller = build_labeller(folded, people, h.column("registered_place").to_pylist())
    train([(t, labeller.spans(t)) for t in folded], out, ranks=ranks, seconds=float(os.environ.get("SECONDS_TO_TRAIN", "400")))


if __name__ == "__main__":
    main()
