"""Evaluation texts leaking into training text.

Held-out items are cut into units: the question and each full sentence of the passage (one shorter than a window goes with
the next one). Windows of ``GRAM`` normalised characters of the units form a hash set that every task gets; the corpus is
scanned once, window by window. A window that stands in the set proposes a place; proposals are verified by edit distance
over the whole unit, and by every stretch of ``RUN`` characters of the passage that doesn't stand within units found. What
passes is reported at every place of a text, with its place in the original text, so that spans or whole documents can be
removed: a unit wherever it stands (equally good ones on end are one row), and as many stretches of a passage as cover all
of it that stands in the text.

Which windows are in the set. A unit that may have e edits is cut into e + 1 parts: one of them is untouched in any match, so
the rarest window of each part is enough, however many units share the others. A stretch of 40 (60) characters with fewer
than a tenth of edits has ten untouched characters on end, thus four windows on end: of any four windows of a passage the
rarest one is in the set. Before a stretch is compared its windows are counted: e edits leave all but ``GRAM`` e of them.
Nothing is capped, and nothing depends on how the items are dealt to blocks.

No case: sentences of several items' passages, and sentences that stand in more different texts than ``stock_share`` of the
number of documents (copies of one text count once), are stock wording; ``stock_wording`` lists what was left out for that. A
question, or a passage of one sentence, is never stock. Like wording with other facts fails the edit distance, differs
in more than ``fact_edits`` digits, or stands where another item fits with fewer edits.

Size bound: the items are read in blocks of ``block_chars`` characters; each block is one scan with a broadcast of some
40 bytes a character. A held-out set beyond one block costs further scans, never a larger broadcast.

Defined results: null and empty texts, items or passages match nothing; repeated document ids are scanned each and give
one row per id and item in ``leaked_documents``; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textnorm import normalise
from tessera.session import materialize

GRAM = 7
#: Units of fewer normalised characters are matched exactly: an edit may leave no whole window of them.
LEAST_EDITED = 14
#: The least length of a stretch across sentences: CJK and alphabetic.
RUN = {"cjk": 40, "alpha": 60}
_SENTENCES = re.compile(r"[^。！!]+[。！!]?")
_ALPHA_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _is_cjk(folded: np.ndarray) -> bool:
    return bool(np.mean((folded >= 0x3400) & (folded < 0xA000)) > 0.3) if len(folded) else False


def sentences(passage: str) -> list[str]:
    """Full sentences; a question and its answer are one."""
    if _is_cjk(normalise(passage)[0]):
        return [s for s in _SENTENCES.findall(passage) if s.strip()]
    return [s for s in _ALPHA_SENTENCES.split(passage) if s.strip()]


def gram_hashes(folded: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the n characters from each position."""
    if len(folded) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(folded) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h + folded[k : len(folded) - n + 1 + k].astype(np.uint64)) * _MUL
            h ^= h >> np.uint64(29)
    return h


def _edits_allowed(length: int) -> int:
    return (length - 1) // 10 if length >= LEAST_EDITED else 0


def units_of(passage: str) -> list[np.ndarray]:
    """Normalised full sentences; what is shorter than a window goes with the next one, at the end with the last one."""
    out: list[np.ndarray] = []
    held = np.zeros(0, np.uint32)
    for s in sentences(passage):
        held = np.concatenate([held, normalise(s)[0]])
        if len(held) >= GRAM:
            out.append(held)
            held = held[:0]
    if len(held) and out:
        out[-1] = np.concatenate([out[-1], held])
    elif len(held):
        out.append(held)
    return out


@dataclass
class HeldOut:
    """Units of a block of items and the hash set of their windows. items: (id, question, passage, normalised sentences of
    the passage that other items have too)."""

    items: list[tuple]
    units: list[np.ndarray] = field(default_factory=list)
    item_of: list[int] = field(default_factory=list)
    never_stock: list[bool] = field(default_factory=list)
    passages: list[np.ndarray] = field(default_factory=list)
    passage_item: list[int] = field(default_factory=list)
    run_of: list[int] = field(default_factory=list)  # the least stretch of a passage that counts
    sentence_at: list[np.ndarray] = field(default_factory=list)  # the sentence of each character of a passage
    sentence_text: list[list[np.ndarray]] = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)  # how many characters before a place aren't of shared sentences
    tiny: dict[int, dict[bytes, set[int]]] = field(default_factory=dict)  # questions and passages shorter than a window

    def __post_init__(self) -> None:
        for item, question, passage, shared in self.items:
            shared = set(shared or ())
            parts = units_of(passage) if passage else []
            named = [(normalise(question)[0], True)] if question else []
            named += [(u, len(parts) == 1) for u in parts if _unit_text(u) not in shared]
            for u, never in named:
                if len(u) >= GRAM:
                    self.units.append(u)
                    self.item_of.append(item)
                    self.never_stock.append(never)
                elif len(u):
                    self.tiny.setdefault(len(u), {}).setdefault(u.tobytes(), set()).add(item)
            if parts:
                whole = np.concatenate(parts)
                self.passages.append(whole)
                self.passage_item.append(item)
                self.run_of.append(RUN["cjk" if _is_cjk(whole) else "alpha"])
                self.sentence_at.append(np.repeat(np.arange(len(parts)), [len(u) for u in parts]))
                self.sentence_text.append(parts)
                mine = np.repeat([_unit_text(u) not in shared for u in parts], [len(u) for u in parts])
                self.own.append(np.concatenate([[0], np.cumsum(mine)]))
        self.hashes_of_passage = [gram_hashes(p) for p in self.passages]
        of_unit = [gram_hashes(u) for u in self.units]
        every = np.concatenate([np.zeros(0, np.uint64), *of_unit, *self.hashes_of_passage])
        known, n_known = np.unique(every, return_counts=True)
        rare = lambda h: n_known[np.searchsorted(known, h)]
        posts = []  # (hash, unit or ~passage, place)
        for k, (u, h) in enumerate(zip(self.units, of_unit, strict=True)):
            cuts = np.linspace(0, len(u), _edits_allowed(len(u)) + 2).astype(int)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = lo + int(np.argmin(rare(h[lo : hi - GRAM + 1])))
                posts.append((h[at], k, at))
        for k, h in enumerate(self.hashes_of_passage):
            if len(self.passages[k]) >= self.run_of[k]:
                n = rare(h)
                places = {at + int(np.argmin(n[at : at + 4])) for at in range(len(h) - 3)}
                # stretches mostly of shared sentences are no case: places that only such ones hold propose nothing
                run, own = self.run_of[k], self.own[k]
                good = np.concatenate([[0], np.cumsum(2 * (own[run:] - own[:-run]) >= run)])  # stretches that begin before
                lo, hi = np.maximum(np.arange(len(h)) - run + GRAM, 0), np.minimum(np.arange(len(h)) + 1, len(good) - 1)
                posts += [(h[at], ~k, at) for at in sorted(places) if good[hi[at]] > good[min(lo[at], len(good) - 1)]]
        flat = np.array([p[0] for p in posts], np.uint64)
        order = np.argsort(flat, kind="stable")
        self.post_unit, self.post_at = (np.array([p[i] for p in posts], np.int64)[order] for i in (1, 2))
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def proposals(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, unit or ~passage, place in it) of every window that stands in the set."""
        pos = np.flatnonzero(self.bits[(hashes >> np.uint64(42)).astype(np.int64)])
        if not len(pos) or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.grams, hashes[pos]), len(self.grams) - 1)
        hit = self.grams[at] == hashes[pos]
        pos, at = pos[hit], at[hit]
        n = self.count[at]
        starts = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        return np.repeat(pos, n), self.post_unit[starts], self.post_at[starts]


def edit_distances(patterns: np.ndarray, regions: np.ndarray, most: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to any stretch of its region, and the end of that stretch.

    patterns: (n, L); regions: (n, R). Distances up to ``most`` are exact; greater ones are only known to be greater, since
    insertions are carried on that far by doubling steps. ``anchored``: stretches begin at the region's start.
    """
    n, width = regions.shape
    pats, text = np.ascontiguousarray(patterns.T), np.ascontiguousarray(regions.T)  # steps run along the first axis, all rows at once
    steps = np.arange(width + 1, dtype=np.int16)[:, None]
    prev = np.broadcast_to(steps, (width + 1, n)).copy() if anchored else np.zeros((width + 1, n), np.int16)
    cur = np.empty_like(prev)
    for i in range(len(pats)):
        cur[0] = i + 1
        np.minimum(prev[:-1] + (text != pats[i]), prev[1:] + 1, out=cur[1:])
        k = 1
        while k <= most:
            np.minimum(cur[k:], cur[:-k] + np.int16(k), out=cur[k:])
            k *= 2
        prev, cur = cur, prev
    end = np.argmin(prev, axis=0)
    return prev[end, np.arange(n)], end


def _regions(folded: np.ndarray, starts: np.ndarray, width: int, least: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Stretches of a fixed width; what lies outside of ``least`` to ``stop`` is 0xFFFFFFFF, which no pattern has."""
    at = starts[:, None] + np.arange(width)
    inside = (at >= least[:, None]) & (at < stop[:, None])
    return np.where(inside, folded[np.clip(at, 0, max(0, len(folded) - 1))], np.uint32(0xFFFFFFFF))


def _digits(x: np.ndarray) -> list[int]:
    return [c for c in x.tolist() if 48 <= c < 58]


def _digit_edits(a: np.ndarray, b: np.ndarray) -> int:
    x, y = _digits(a), _digits(b)
    if x == y:
        return 0
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def _places(spots: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The places of a unit among (edits, digits among them, start, end): what mostly stands within one of fewer edits is the
    same place, equally good ones on end are one."""
    if len(spots) == 1:
        return list(spots)
    out: list[tuple[int, int, int, int]] = []
    by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for x in spots:
        by[x[0]].append(x)
    for dist in sorted(by):
        starts, ends = _union([x[2:] for x in out])
        joined: dict[int, tuple[int, int, int, int]] = {}  # the last one of each number of digits
        for x in sorted(by[dist], key=lambda x: x[2:]):
            lo, hi = x[2:]
            if len(starts):
                a, b = max(0, int(np.searchsorted(ends, lo, "right"))), int(np.searchsorted(starts, hi))
                if 2 * max((min(hi, ends[j]) - max(lo, starts[j]) for j in range(a, b)), default=0) > hi - lo:
                    continue
            last = joined.get(x[1])
            if last and lo <= last[3]:
                joined[x[1]] = (*last[:3], max(hi, last[3]))
                continue
            if last:
                out.append(last)
            joined[x[1]] = x
        out += joined.values()
    return out


def _union(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what spans cover, in order."""
    starts, ends = [], []
    for lo, hi in sorted(spans):
        if ends and lo <= ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            starts.append(lo)
            ends.append(hi)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _within(lo: np.ndarray, hi: np.ndarray, union: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    starts, ends = union
    at = np.searchsorted(starts, lo, "right") - 1
    return (at >= 0) & (hi <= ends[np.maximum(at, 0)])


def _cover(spots: list[tuple[int, int, int, int, int]]) -> set[tuple[int, int, int, int, int]]:
    """As few as cover all (edits, digits among them, start, end, place in the passage), and the best one."""
    out, best, end = {min(spots, key=lambda x: (x[0], x[4], x[2]))}, None, -1
    for x in sorted(spots, key=lambda x: (x[2], -x[3], x[0], x[4])):
        if best and x[2] > end:  # nothing further reaches back to what is covered
            out.add(best)
            best, end = None, best[3]
        if x[3] > (best[3] if best else end):
            if x[2] > end:
                out.add(x)
                end = x[3]
            else:
                best = x
    if best:
        out.add(best)
    return out


class Scanner:
    """Finds the leaked stretches in a batch of texts."""

    def __init__(self, held: HeldOut, fact_edits: int):
        self.held, self.fact_edits = held, fact_edits

    def _verify(self, folded: np.ndarray, unit: np.ndarray, where: np.ndarray, doc: np.ndarray, bounds: np.ndarray, patterns: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(proposal, edits, digits among them, start, end) of the proposals whose pattern stands near ``where`` in their text."""
        least, last = bounds[doc], bounds[doc + 1] - 1
        out = []
        lengths = np.array([len(p) for p in patterns])[unit] if len(unit) else unit
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            e = _edits_allowed(int(length))
            for part in np.array_split(rows, -(-len(rows) // 2_000)):
                pats = np.stack([patterns[u] for u in unit[part]])
                begin = where[part] - 2 * e
                d, end = edit_distances(pats, _regions(folded, begin, int(length) + 4 * e, least[part], last[part]), e)
                ok = np.flatnonzero(d <= e)
                if not len(ok):
                    continue
                stop = begin[ok] + end[ok]
                width = int(length) + e
                back = _regions(folded, stop - width, width, least[part[ok]], last[part[ok]])[:, ::-1]
                _, size = edit_distances(pats[ok][:, ::-1], back, e, anchored=True)
                for k, dist, s, n in zip(part[ok], d[ok], stop, size, strict=True):
                    lo, hi = max(0, int(s - n)), int(s)
                    facts = _digit_edits(patterns[unit[k]], folded[lo:hi])
                    if facts <= self.fact_edits:
                        out.append((int(k), int(dist), facts, lo, hi))
        return out

    def scan(self, texts: list[str]) -> list[tuple]:
        """(text, item, unit as normalised bytes, whether it may be stock, edits, digits among them, start, end) with places
        in the original text."""
        held = self.held
        parts, places, bounds, n = [], [], [0], 0
        sep = np.array([0xFFFFFFFE], np.uint32)
        for t in texts:
            f, at = normalise(t or "")
            parts += [f, sep]
            places.append(at)
            n += len(f) + 1
            bounds.append(n)
        if not parts:
            return []
        folded, bounds = np.concatenate(parts), np.array(bounds)
        hashes = gram_hashes(folded)
        pos, unit, at = held.proposals(hashes)
        spots = self._tiny(folded, bounds)
        whole = unit >= 0
        if whole.any():
            doc_of = np.searchsorted(bounds, pos[whole], "right") - 1
            u, w, d = np.unique(np.stack([unit[whole], (pos - at)[whole], doc_of]), axis=1)
            for k, dist, facts, lo, hi in self._verify(folded, u, w, d, bounds, held.units):
                spots[int(d[k]), held.item_of[u[k]], held.units[u[k]].tobytes(), not held.never_stock[u[k]]].add((dist, facts, lo, hi))
        found = [(name, x) for name, several in spots.items() for x in _places(several)]
        spans = defaultdict(list)
        for (doc, item, *_), (_, _, lo, hi) in found:
            spans[doc, item].append((lo, hi))
        found += self._runs(folded, hashes, bounds, pos[~whole], ~unit[~whole], at[~whole], {k: _union(x) for k, x in spans.items()})
        out = []
        for (doc, item, name, may), (dist, facts, lo, hi) in found:
            at = places[doc]
            out.append((doc, item, name, may, dist, facts, int(at[lo - bounds[doc]]), int(at[hi - 1 - bounds[doc]]) + 1))
        return out

    def _tiny(self, folded, bounds) -> dict:
        """The places of each question or passage shorter than a window in a text."""
        found = defaultdict(set)
        for n, units in self.held.tiny.items():
            wanted = gram_hashes(np.concatenate([np.frombuffer(u, folded.dtype) for u in units]), n)[::n]
            for lo in np.flatnonzero(np.isin(gram_hashes(folded, n), wanted)).tolist():
                name = folded[lo : lo + n].tobytes()
                for item in units.get(name, ()):
                    found[int(np.searchsorted(bounds, lo, "right") - 1), item, name, False].add((0, 0, lo, lo + n))
        return found

    def _runs(self, folded, hashes, bounds, pos, passage, at, spans) -> list:
        """Stretches of passages in a text, across or within sentences, that cover all such beside the units found."""
        held = self.held
        tries: list[np.ndarray] = []  # (passage, text, place in the passage, place) of the stretches to verify
        if len(pos):
            # of hits on one diagonal the first and the last within the length of a stretch see all stretches the others see
            length = np.array(held.run_of)[passage] - GRAM + 1
            order = np.lexsort((at, at // length, pos - at, passage))
            pos, passage, at, length = pos[order], passage[order], at[order], length[order]
            new = np.any(np.diff(np.stack([passage, pos - at, at // length]), axis=1) != 0, axis=0)
            edge = np.concatenate([[True], new]) | np.concatenate([new, [True]])
            pos, passage, at = pos[edge], passage[edge], at[edge]
        doc_of = np.searchsorted(bounds, pos, "right") - 1
        margin = max(RUN.values())
        around = np.concatenate([np.full(margin, 1, np.uint64), hashes, np.full(margin, 1, np.uint64)])
        for k in np.unique(passage):
            rows = np.flatnonzero(passage == k)
            item, run = held.passage_item[k], held.run_of[k]
            e, grams = _edits_allowed(run), held.hashes_of_passage[k]
            n = run - GRAM + 1  # windows of a stretch
            least = n - GRAM * e
            # windows around the hit that stand on nearly its diagonal
            p = at[rows][:, None] + np.arange(-n + 1, n)
            wanted = np.where((p >= 0) & (p < len(grams)), grams[np.clip(p, 0, len(grams) - 1)], np.uint64(0))
            there = around[pos[rows][:, None] + np.arange(margin - n + 1 - e, margin + n + e)]
            same = np.zeros(p.shape, bool)
            for shift in range(2 * e + 1):
                same |= there[:, shift : shift + p.shape[1]] == wanted
            total = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            counts = total[:, n:] - total[:, :-n]  # of the stretch that begins at the hit's place - n + 1 + column
            begin = at[rows][:, None] - n + 1 + np.arange(n)
            fits = (counts >= least) & (begin >= 0) & (begin + run <= len(held.passages[k]))
            mine = held.own[k]
            fits &= 2 * (mine[np.clip(begin + run, 0, len(mine) - 1)] - mine[np.clip(begin, 0, len(mine) - 1)]) >= run
            r, c = np.nonzero(fits)
            a = begin[r, c]
            doc, where = doc_of[rows[r]], (pos - at)[rows[r]] + a
            out = np.ones(len(a), bool)
            for d in np.unique(doc).tolist():
                if (d, item) in spans:
                    mine = np.flatnonzero(doc == d)
                    out[mine] = ~_within(where[mine], where[mine] + run, spans[d, item])
            tries.append(np.stack([np.full(len(a), k), doc, a, where])[:, out])
        if not sum(x.shape[1] for x in tries):
            return []
        passage, doc, place, where = np.unique(np.concatenate(tries, axis=1), axis=1)
        patterns = [held.passages[k][a : a + held.run_of[k]] for k, a in zip(passage.tolist(), place.tolist(), strict=True)]
        stretches = defaultdict(list)
        for i, dist, facts, lo, hi in self._verify(folded, np.arange(len(patterns)), where, doc, bounds, patterns):
            stretches[int(doc[i]), int(passage[i])].append((dist, facts, lo, hi, int(place[i])))
        found = []
        for (doc, k), several in stretches.items():
            item = held.passage_item[k]
            if (doc, item) in spans:
                lo, hi = np.array([x[2:4] for x in several]).T
                several = [x for x, inside in zip(several, _within(lo, hi, spans[doc, item]), strict=True) if not inside]
            for dist, facts, lo, hi, a in sorted(_cover(several)) if several else ():
                # a stretch goes by the sentence it mostly stands in
                inside = np.bincount(held.sentence_at[k][a : a + held.run_of[k]])
                most = int(np.argmax(inside))
                sentence = held.sentence_text[k][most]
                within = 2 * inside[most] >= held.run_of[k]
                name = sentence.tobytes() if within else held.passages[k][a : a + held.run_of[k]].tobytes()
                found.append(((doc, item, name, len(held.sentence_text[k]) > 1), (dist, facts, lo, hi)))
        return found


_OUT = "item_id bigint, unit string, may_be_stock boolean, edits int, facts int, char_start int, char_end int, text_key bigint"


def scanned(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    fact_edits: int = 2,
    stock_share: float = 0.005,
    stock_least: int = 25,
    block_chars: int = 5_000_000,
) -> DataFrame:
    """(id, item_id, unit, edits, char_start, char_end, stock): each stretch of each document that passes, those of frequent
    sentences marked as stock."""
    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("passage"), F.lit(0))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    wanted = items.select("item_id", "question", "passage").distinct()
    # an item knows which of its sentences others have, whatever block they are in
    known = wanted.join(_shared_units(wanted), "item_id", "left").select("item_id", "question", "passage", "shared")
    out = None
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held = HeldOut(sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1] or "", r[2] or "")))
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value, fact_edits)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                step = 2_000  # texts at a time, to bound the arrays
                for s in range(0, len(texts), step):
                    rows = scanner.scan(texts[s : s + step])
                    if not rows:
                        continue
                    d, item, unit, may, edits, facts, lo, hi = zip(*rows, strict=True)
                    keys = {i: int(gram_hashes(np.append(normalise(texts[s + i])[0], np.zeros(GRAM, np.uint32)))[::7].sum(dtype=np.uint64).astype(np.int64)) for i in set(d)}
                    columns = [pa.array(item, pa.int64()), pa.array([_unit_text(np.frombuffer(x, np.uint32)) for x in unit], pa.string()), pa.array(may, pa.bool_()), pa.array(edits, pa.int32()), pa.array(facts, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array([keys[i] for i in d], pa.int64())]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([s + i for i in d])), *columns], [id_col, "item_id", "unit", "may_be_stock", "edits", "facts", "char_start", "char_end", "text_key"])

        one = docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, {_OUT}")
        out = one if out is None else out.unionByName(one)
    # The hits are read several times, the corpus is scanned once. Stock wording: as few counts as there are held-out units.
    out = materialize(out)
    n_docs = docs.count()
    frequent = out.where("may_be_stock").groupBy("unit").agg(F.count_distinct("text_key").alias("n_texts")).where(F.col("n_texts") > F.lit(max(stock_least, stock_share * n_docs)))
    marked = out.join(frequent.select("unit", F.lit(True).alias("frequent")), "unit", "left").withColumn("stock", F.col("may_be_stock") & F.coalesce("frequent", F.lit(False)))
    # where another item fits the same place of the same text better, other facts were meant
    place = ["text_key", "item_id", "edits", "char_start", "char_end"]
    better = out.select(*[F.col(c).alias("o_" + c) for c in place]).distinct()
    same = (F.col("text_key") == F.col("o_text_key")) & (F.col("item_id") != F.col("o_item_id")) & (F.col("o_edits") < F.col("edits")) & (F.col("o_char_start") < F.col("char_end")) & (F.col("o_char_end") > F.col("char_start")) & (F.col("facts") > 0)
    kept = marked.join(better, same, "left_anti")
    return kept.select(id_col, "item_id", "unit", "edits", "char_start", "char_end", "stock")


def leaked_spans(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(id, item_id, unit, edits, char_start, char_end): each leaked stretch of each document; options as of ``scanned``."""
    return scanned(docs, items, **options).where("NOT stock").drop("stock")


def stock_wording(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(unit, n_items, n_docs): sentences of held-out passages that were left out because so many texts have them."""
    return scanned(docs, items, id_col=id_col, **options).where("stock").groupBy("unit").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct(id_col).alias("n_docs"))


def _unit_text(folded: np.ndarray) -> str:
    return folded.astype("<u4").tobytes().decode("utf-32-le")


def _shared_units(items: DataFrame) -> DataFrame:
    """(item_id, shared): the sentences of an item's passage that stand in the passages of other items too."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, _unit_text(u)) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if p for u in units_of(p)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["item_id", "unit"])

    per = items.select(F.col("item_id").cast("bigint"), "passage").mapInArrow(units, "item_id bigint, unit string").distinct()
    several = per.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit")
    return per.join(several, "unit").groupBy("item_id").agg(F.collect_set("unit").alias("shared"))


def leaked_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id) pairs."""
    return leaked_spans(docs, items, id_col=id_col, text_col=text_col, **options).select(id_col, "item_id").distinct()


def remove_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """(id, n_items, n_removed_chars, dropped, clean_text) of the documents that leak: spans are cut out, and the text is
    dropped (null) where they make up more than ``drop_share`` of it. Ids are expected to be unique."""
    spans = leaked_spans(docs, items, id_col=id_col, text_col=text_col, **options)
    per_doc = spans.groupBy(id_col).agg(F.count_distinct("item_id").alias("n_items"), F.sort_array(F.collect_set(F.struct("char_start", "char_end"))).alias("spans"))
    joined = per_doc.join(docs.select(id_col, text_col), id_col)
    merged = F.aggregate(
        "spans",
        F.expr("array(struct(-1 AS char_start, -1 AS char_end))"),
        lambda acc, x: F.when(
            x["char_start"] <= F.element_at(acc, -1)["char_end"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["char_start"].alias("char_start"), F.greatest(F.element_at(acc, -1)["char_end"], x["char_end"]).alias("char_end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["char_start"].alias("char_start"), x["char_end"].alias("char_end"))))),
    )
    spans_ = F.slice(F.col("__m"), 2, F.size("__m"))
    removed = F.aggregate(spans_, F.lit(0), lambda acc, x: acc + x["char_end"] - x["char_start"])
    kept = F.aggregate(
        spans_,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, x["char_start"] - acc["at"])).alias("text"), x["char_end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    out = joined.withColumn("__m", merged).select(id_col, "n_items", removed.alias("n_removed_chars"), (removed > F.lit(drop_share) * F.length(text_col)).alias("dropped"), kept.alias("clean_text"))
    return out.withColumn("clean_text", F.when(~F.col("dropped"), F.col("clean_text")))
