"""Words of organisations' names, learned from the names themselves.

What a company does stands between its brand and its legal form. A word there is one that many different beginnings are
followed by and that isn't the end of a longer such word: from the end of a name it is extended to the left as long as a
fifth of its beginnings share the next character. Product lines of funds are found in the same way before a product's
number. Short and English forms come from entities that go by a full name and by another one with the same brand.

Scale: names are aggregated as distinct (ending, beginning) pairs; what reaches the driver are endings with at least
``SHARE`` of all beginnings, so at most some 1 / ``SHARE`` per length however many names there are.

Defined results: null and blank names say nothing; repeated names count once; an empty table gives the places and the
common words alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import _BRACKETS, _GENERAL, _HAN, _KIND_WORDS, _LEGAL_TAIL, _OWN_FUNDS, _STOP, HAN_ONLY, INDUSTRIES, Lexicon, _take_place, fold, parse_organisation

#: Least number of different beginnings, and their least share of all, for a word; least number of entities for a form, of
#: which at least half must be of one industry.
LEAST, SHARE, LEAST_FORMS = 3, 0.0005, 2
LONGEST = 6
_LEGAL_WORDS = re.compile(r"\b(?:co|ltd|inc|limited|company|corp|corporation|plc|lp|llc|holdings?|group)\b")


def _endings(name: str, places: frozenset[str]) -> tuple[str, str] | None:
    """('industry' or 'series', text whose ending may be a word) of a name that has one."""
    s = _OWN_FUNDS.sub("", re.sub(r"\s", "", fold(name)))
    product = re.search(r"([一-鿿]+?)\d+号", s)
    if product:
        return "series", product[1]
    s = _take_place(_BRACKETS.sub("", s), places)[1]
    core = _LEGAL_TAIL.sub("", s)
    if core == s or not HAN_ONLY.match(core) or any(w in core for _, ws in _KIND_WORDS for w in ws) or "公司" in core:
        return None
    return "industry", core.removesuffix("股份")


def learned_words(counts: list[tuple[str, int]], total: int) -> set[str]:
    """Words among endings with their numbers of beginnings."""
    n = {e: k for e, k in counts if k >= max(LEAST, SHARE * total)}
    longer: dict[str, list[str]] = {}
    for e in n:
        if len(e) > 2 and e[1:] in n and n[e] >= 0.2 * n[e[1:]]:
            longer.setdefault(e[1:], []).append(e)
    words, todo = set(), [e for e in n if len(e) == 2]
    while todo:
        e = todo.pop()
        if n[e] - sum(n[x] for x in longer.get(e, [])) >= 0.2 * n[e]:
            words.add(e)
        todo += longer.get(e, [])
    return words


def learn(names: DataFrame, places: frozenset[str]) -> Lexicon:
    """names: (id, name) of organisations, all names that an id goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for name in b.column(0).to_pylist():
                got = _endings(name, places) if name else None
                if got:
                    kind, s = got
                    rows |= {(kind, s[i:], s[:i]) for i in range(max(1, len(s) - LONGEST), len(s) - 1)}
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["kind", "ending", "beginning"])

    text = names.select(names.columns[1]).distinct()
    seen = text.mapInArrow(run, "kind string, ending string, beginning string").distinct().groupBy("kind", "ending").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    total = F.sum("n").over(Window.partitionBy("kind", F.length("ending")))
    rows = [(r.kind, r.ending, r.n, r.total) for r in seen.withColumn("total", total).where(F.col("n") >= SHARE * F.col("total")).collect()]
    said = lambda e: any(w in e or e in w for w in (*_STOP, *_GENERAL))
    words = {k: learned_words([(e, n) for kind, e, n, _ in rows if kind == k and not said(e)], max((t for kind, _, _, t in rows if kind == k), default=0)) for k in ("industry", "series")}
    plain = Lexicon(places, frozenset(INDUSTRIES) | frozenset(words["industry"]), series=frozenset(words["series"]))
    short, english = _forms(names, plain)
    # a form of a longer word is no word of its own
    return Lexicon(places, plain.industries - {w for w, industry in short if industry.startswith(w) or w not in INDUSTRIES}, frozenset(short), frozenset(english), plain.series)


def _forms(names: DataFrame, lexicon: Lexicon) -> tuple[set, set]:
    """Short and English forms of industries: (form, industry) that several entities have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = re.sub(r"\s+", " ", fold(name)) if name else ""
                if not s or i is None:
                    continue
                if not _HAN.search(s):
                    words = re.sub(r"[.,&]", " ", re.sub(r"\([^)]*\)", " ", s.lower())).split()
                    tail = " ".join(_LEGAL_WORDS.sub(" ", " ".join(words[1:])).split())
                    if words and tail:
                        rows.append((i, "english", words[0], tail))
                    continue
                o = parse_organisation(name, lexicon)
                if o and o.kind == "core" and o.industry and "公司" in s:
                    rows += [(i, "full", o.brand, o.industry), (i, "full", o.sound, o.industry)]
                elif HAN_ONLY.match(s) and len(s) <= 8 and "公司" not in s:
                    rows += [(i, "short", s[:k], s[k:]) for k in range(2, len(s) - 1)]
            rows = sorted(set(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["id", "kind", "brand", "word"])

    two = names.select(F.col(names.columns[0]).cast("string").alias("id"), F.col(names.columns[1]).alias("name")).distinct()
    parts = two.mapInArrow(run, "id string, kind string, brand string, word string").distinct()
    full = parts.where("kind = 'full'").select("id", "brand", F.col("word").alias("industry"))
    met = parts.where("kind <> 'full'").join(full, ["id", "brand"]).where("word <> industry").groupBy("kind", "word", "industry").agg(F.count_distinct("id").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("kind", "word"))
    found = met.withColumn("share", share).where((F.col("n") >= LEAST_FORMS) & (F.col("share") > 0.5)).collect()
    keep = [r for r in found if not any(w in r.word for w in (*_STOP, *_GENERAL, *(lexicon.industries - {r.word})))]
    return {(r.word, r.industry) for r in keep if r.kind == "short"}, {(r.word, r.industry) for r in keep if r.kind == "english"}
