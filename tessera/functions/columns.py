"""Scalar functions as Column expressions: all of them stay inside code generation or built-in array functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"


# --- text ---------------------------------------------------------------------------------------------------------

def grams(text: Column, n: int = 2) -> Column:
    """Overlapping n-grams; a shorter text is one gram, an empty one has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: text.substr(i, F.lit(n))))


def tokenize(text: Column) -> Column:
    """Lower-case tokens in order, repeats kept: Latin or digit runs whole, CJK runs as bigrams, a lone CJK character as it is."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([a-z0-9_.]+|[{CJK}]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{CJK}]"), grams(r)).otherwise(F.array(r))))


def clean_text(text: Column) -> Column:
    """BOM and control characters out, line ends unified, blanks collapsed, lines trimmed, at most one empty line on end."""
    t = F.regexp_replace(text, r"\x{FEFF}", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"[ \t\x{00A0}\x{3000}]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean_tags(tags: Column) -> Column:
    """Cleaned tags without empty ones and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(tags, clean_text), lambda x: x.isNotNull() & (x != "")))


# Marks dropped from names, legal suffixes (longest first).
NAME_MARKS = "·•・,，。.:：;；()（）[]【】"
LEGAL_SUFFIXES = ("集团股份有限公司", "股份有限公司", "集团有限公司", "有限责任公司", "有限公司", "股份公司")


def normalize_name(name: Column) -> Column:
    """Upper case without blanks and marks; full-width letters, digits and blanks fold first."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    folded = F.upper(F.translate(F.coalesce(name, F.lit("")), wide + "　", narrow + " "))
    return F.translate(F.regexp_replace(folded, r"\s", ""), NAME_MARKS, "")


def legal_core_name(name: Column) -> Column:
    """The normalized name without its legal suffix if something is left."""
    n = normalize_name(name)
    return F.when(n.rlike(f".(?:{'|'.join(LEGAL_SUFFIXES)})$"), F.regexp_replace(n, f"(?<=.)(?:{'|'.join(LEGAL_SUFFIXES)})$", "")).otherwise(n)


def normalize_alias(alias: Column) -> Column:
    return F.upper(F.regexp_replace(alias, r"\s", ""))


def canonical_company_id(code: Column) -> Column:
    """A bare six-digit code gets its exchange; a code with one is upper-cased; all else is null."""
    c = F.upper(F.trim(code))
    bare = c.rlike(r"^\d{6}$")
    by_digit = F.when(c.startswith("6"), F.concat(c, F.lit(".SH"))).when(c.rlike("^[03]"), F.concat(c, F.lit(".SZ"))).when(c.rlike("^[489]"), F.concat(c, F.lit(".BJ")))
    return F.when(bare, by_digit).when(c.rlike(r"^\d{6}\.(SH|SZ|BJ)$"), c)


def classify_company_code(code: Column) -> Column:
    """a_share, exchange_mismatch (code and exchange disagree) or nonstandard."""
    c = F.upper(F.trim(code))
    fits = (c.rlike(r"^6\d{5}\.SH$")) | (c.rlike(r"^[03]\d{5}\.SZ$")) | (c.rlike(r"^[489]\d{5}\.BJ$"))
    return F.when(fits, "a_share").when(c.rlike(r"^\d{6}\.(SH|SZ|BJ)$"), "exchange_mismatch").otherwise("nonstandard")


def title_prefix_alias(title: Column) -> Column:
    """What stands before the first colon if it has 2 to 12 characters with a CJK one; else null."""
    head = F.trim(F.regexp_extract(title, r"^([^:：]*)[:：]", 1))
    return F.when((F.length(head) >= 2) & (F.length(head) <= 12) & head.rlike(f"[{CJK}]"), head)


def first_label(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str | None = None) -> Column:
    """The label of the first rule one of whose words the text contains."""
    def any_of(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    out = None
    for label, words in rules:
        out = F.when(any_of(words), label) if out is None else out.when(any_of(words), label)
    return out.otherwise(F.lit(default)) if default is not None else out


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def extract_distinct(text: Column, *patterns: str) -> Column:
    """First groups of all matches of each pattern in turn, trimmed, without repeats."""
    return F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.trim) for p in patterns]))


def split_items(text: Column, pattern: str, least: int = 1, most: int = 1_000_000, strip: str = r"^[\s]+|[\s]+$") -> Column:
    """Trimmed parts between the separators whose length is in bounds."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: F.regexp_replace(x, strip, ""))
    return F.filter(parts, lambda x: (F.length(x) >= least) & (F.length(x) <= most))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def is_structural_fragment(text: Column) -> Column:
    """Nothing but numbering, blanks and marks."""
    return F.regexp_replace(text, "&[gl]t;|&nbsp;", "").rlike(r"^[\s\p{Punct}：；，。、…·—（）【】！？0-9一二三四五六七八九十百①-⑩]*$")


def sanitize_filename(name: Column, mark: str = "_") -> Column:
    return F.regexp_replace(name, rf"[^\w{CJK}.-]+", mark)


def answer_text(raw: Column) -> Column:
    """The field answer of a JSON text, else the text itself."""
    return F.coalesce(F.get_json_object(raw, "$.answer"), raw)


def ilike_any(columns: list[Column], words: list[str]) -> Column:
    """Any word in any column, letter case aside; % and _ are plain characters."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(w.lower()) for w in words for c in columns])


# --- sets and vectors ---------------------------------------------------------------------------------------------

def jaccard(a: Column, b: Column) -> Column:
    """0 where one side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x / norm))


# --- dates --------------------------------------------------------------------------------------------------------

def normalize_date(value: Column) -> Column:
    """ISO text of 8 digits, 14 digits (with time), ISO dates or spreadsheet serials (20000 to 80000); else the text itself."""
    v = F.trim(value.cast("string"))
    eight = F.date_format(F.try_to_date(v, "yyyyMMdd"), "yyyy-MM-dd")
    stamp = F.date_format(F.try_to_timestamp(v, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss")
    serial = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.expr("cast(0 as int)") + F.floor(v.try_cast("double")).cast("int")), "yyyy-MM-dd")
    iso = F.date_format(F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")
    number = v.try_cast("double")
    return F.when(v.rlike(r"^\d{8}$"), F.coalesce(eight, v)).when(v.rlike(r"^\d{14}$"), F.coalesce(stamp, v)).when((number >= 20000) & (number <= 80000), serial).otherwise(F.coalesce(iso, v))


def period_type(day: Column) -> Column:
    md = F.date_format(day, "MM-dd")
    return F.when(md == "03-31", "Q1").when(md == "06-30", "H1").when(md == "09-30", "Q3_YTD").when(md == "12-31", "FY").otherwise("NON_STANDARD")


def day_distance(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def last_year_end(day: Column) -> Column:
    return F.make_date(F.year(day) - 1, F.lit(12), F.lit(31))


# --- numbers and ids ----------------------------------------------------------------------------------------------

def growth(current: Column, previous: Column) -> Column:
    """(current - previous) / |previous|; null where previous is 0 or a side is null."""
    return F.when(previous != 0, (current - previous) / F.abs(previous))


def hash_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix + the first characters of the upper-case SHA-256 over the parts; a null part reads None."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(text, 256), 1, length)))


def short_sha1(text: Column, length: int = 12) -> Column:
    return F.upper(F.substring(F.sha1(text), 1, length))


# --- questions ----------------------------------------------------------------------------------------------------

def mentioned_periods(text: Column) -> Column:
    """Distinct report periods a text names, in order of kind: ISO dates, dates like 2023年6月30日, and years with a report
    (年报 or 年度, 半年报, 一季报, 三季报). Digits on either side of a date make it none."""
    t = F.coalesce(text, F.lit(""))
    iso = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    han = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)(\d{4}年\d{1,2}月\d{1,2}日)"), F.lit(1)), lambda x: F.try_to_date(x, "yyyy年M月d日"))
    kinds = [(r"(?<!\d)(\d{4})年?(?:年报|年度报告|年度)", 12, 31), (r"(?<!\d)(\d{4})年?(?:半年报|半年度|中报)", 6, 30), (r"(?<!\d)(\d{4})年?(?:一季报|第一季度)", 3, 31), (r"(?<!\d)(\d{4})年?(?:三季报|前三季度)", 9, 30)]

    def ends(pattern: str, month: int, day: int) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda y: F.make_date(y.cast("int"), F.lit(month), F.lit(day)))

    years = [ends(*k) for k in kinds]
    return F.array_distinct(F.array_compact(F.concat(iso, han, *years)))


def mentioned_words(text: Column, words: dict[str, str]) -> Column:
    """Labels of the words a text contains; a word inside a longer one that is there doesn't count."""
    rest, out = F.coalesce(text, F.lit("")), []
    for word in sorted(words, key=len, reverse=True):
        out.append(F.when(rest.contains(word), F.lit(words[word])))
        rest = F.replace(rest, F.lit(word), F.lit("\x00"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*out))))
