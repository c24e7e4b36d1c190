"""Functions that need Python, as Arrow-batched Pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags whose content is not text, and tags that end a line.
SILENT_TAGS = {"script", "style", "noscript", "svg"}
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "ol", "p", "section", "table", "td", "th", "tr", "ul"}
# Labels of the sections of a research report.
SECTION_LABELS = ("盈利预测与投资评级", "事件概述", "投资要点", "主要观点", "核心观点", "分析判断", "盈利预测", "投资建议", "风险提示", "事件")
#: A label at a section's head, whatever stands before it.
SECTION_HEAD = "(" + "|".join(SECTION_LABELS) + r")\s*[：:]"
# what stands in angle brackets: a comment, or a tag with its name; a bracket before anything else is text
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>""", re.S)
_BLANKS = re.compile(r"[^\S\n]+|\n\s*")


def visible_text(html: str | None) -> str | None:
    """Visible text of a page: one line per block, blanks collapsed, empty lines dropped."""
    if html is None:
        return None
    kept, at, hidden = [], 0, ""
    for m in _MARKUP.finditer(html):
        tag = (m[2] or "").lower()
        if not hidden:
            # line breaks of the source are blanks, except those that blocks make
            kept.append(unescape(html[at : m.start()]))
            if tag in BLOCK_TAGS:
                kept.append("\n")
            elif tag in SILENT_TAGS and not m[1] and not m[3].endswith("/"):
                hidden = tag
        elif tag == hidden and m[1]:
            hidden = ""
        at = m.end()
    if not hidden:
        kept.append(unescape(html[at:]))
    return _BLANKS.sub(lambda m: "\n" if "\n" in m[0] else " ", "".join(kept)).strip().replace(" \n", "\n")


def _title_key(s: str) -> str:
    return re.sub(r"[：:。.！!？?；;，,]+$", "", re.sub(r"\s", "", unicodedata.normalize("NFKC", s)))


def without_title_lines(text: str | None, title: str | None) -> str | None:
    """The text without leading lines that repeat the title; the whole text if nothing else is there."""
    if not text or not title or not _title_key(title):
        return text
    lines, key, i = text.split("\n"), _title_key(title), 0
    while i < len(lines) and (not lines[i].strip() or _title_key(lines[i]) == key):
        i += 1
    rest = "\n".join(lines[i:]).strip()
    return rest if rest and any(_title_key(x) == key for x in lines[:i]) else text


def sections(text: Column) -> Column:
    """Label -> text up to the next label; the first non-empty one of a label counts. Null text has no sections."""
    # cut before each label; what stands before the first one belongs to none
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SECTION_HEAD, "\x01$1\x02"), "\x01")
    parts = F.slice(parts, 2, F.size(parts))
    pair = lambda x: F.struct(F.substring_index(x, "\x02", 1).alias("label"), F.regexp_replace(F.substring_index(x, "\x02", -1), r"(?U)^\s+|\s+$", "").alias("body"))
    filled = F.filter(F.transform(parts, pair), lambda x: x["body"] != "")
    return F.map_from_entries(F.filter(filled, lambda x, i: F.array_position(F.transform(filled, lambda y: y["label"]), x["label"]) == i + 1))


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(visible_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def remove_title_lines(text: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([without_title_lines(a, b) for a, b in zip(text, title, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; null where a side is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
