"""Names of persons and organisations: spelling folds, phonetic codes, and the parts a name consists of."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from pathlib import Path

# How characters are read in names where that isn't their commonest reading.
NAME_READINGS = {"曾": "zeng", "晟": "sheng", "拓": "tuo", "隽": "jun", "鹄": "hu", "峤": "qiao", "重": "chong", "长": "chang", "都": "du", "行": "hang"}
#: The same for surnames alone.
SURNAME_READINGS = {"单": "shan", "解": "xie", "查": "zha", "翟": "zhai", "覃": "qin", "缪": "miao", "朴": "piao", "仇": "qiu", "区": "ou", "卜": "bu", "盖": "ge", "尉迟": "yuchi", "万俟": "moqi"}


def _tables() -> tuple[dict[str, str], dict[int, str]]:
    """Readings and simplified forms of all characters of the basic block, as ``han_build`` wrote them."""
    readings, simple = {}, {}
    for line in Path(__file__).with_name("models").joinpath("han.txt").read_text(encoding="utf-8").splitlines():
        sound, _, chars = line.partition(" ")
        if sound == "=":
            simple = {ord(chars[i]): chars[i + 1] for i in range(0, len(chars), 2)}
        else:
            readings |= dict.fromkeys(chars, sound)
    return readings | NAME_READINGS, simple | {ord("滙"): "汇"}


_READING, _T2S = _tables()

COMPOUND_SURNAMES = ("欧阳", "上官", "司徒", "尉迟", "诸葛", "司马", "东方", "夏侯", "皇甫", "令狐", "慕容", "公孙", "长孙", "宇文")
_COMPOUND_LATIN = {"ouyang", "shangguan", "situ", "yuchi", "zhuge", "sima", "dongfang", "xiahou", "huangfu", "linghu", "murong", "gongsun", "zhangsun", "yuwen"}
#: Prefixes that make a nickname of one character of the given name.
NICKNAME_PREFIXES = "老小阿"
_TITLES = re.compile(r"(?:女士|先生|小姐|同志|教授|博士)$")
_BRACKETS = re.compile(r"[（(\[【〔][^（()）\]】〕]*[）)\]】〕]")
_HAN = re.compile(r"[一-鿿]")
HAN_ONLY = re.compile(r"[一-鿿]+$")


def fold(name: str) -> str:
    """Width, case of letters and traditional characters folded; spaces between letters kept single."""
    s = unicodedata.normalize("NFKC", name).translate(_T2S)
    return re.sub(r"\s+", " ", s).strip()


def reading(text: str) -> str:
    """Latin letters as they are, characters by their reading; those without one stand for themselves."""
    return "".join(_READING.get(ch, ch) for ch in text.lower())


def surname_reading(surname: str) -> str:
    return SURNAME_READINGS.get(surname) or reading(surname)


def syllables(text: str) -> list[str]:
    return [_READING.get(ch, ch) for ch in text.lower()]


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """Jaro-Winkler similarity; two empty strings are equal."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used, ma = [False] * lb, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                ma.append(ch)
                break
    m = len(ma)
    if not m:
        return 0.0
    mb = [b[j] for j in range(lb) if used[j]]
    t = sum(x != y for x, y in zip(ma, mb, strict=True)) / 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    p = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        p += 1
    return jaro + p * prefix_weight * (1 - jaro)


def one_edit(a: str, b: str) -> bool:
    """Equal, or one character replaced, left out, put in, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


@dataclass(frozen=True)
class Person:
    surname: str = ""  # characters, or Latin letters in lower case
    given: str = ""
    initials: str = ""  # of the given name, where only these are known
    han: bool = False

    @property
    def name(self) -> str:
        return self.surname + self.given

    @property
    def sound(self) -> str:
        """Phonetic code of the sorted tokens: the same for every order of surname and given name."""
        return "|".join(sorted((surname_reading(self.surname), reading(self.given))))

    @property
    def sound_initials(self) -> str:
        first = "".join(s[0] for s in syllables(self.given)) if self.han else self.initials
        return surname_reading(self.surname) + "|" + first


def _lu(surname: str) -> str:
    """One spelling for the surname that is written lu, lv or lyu."""
    return "lu" if surname in ("lv", "lyu", "lue") else surname


def _split_han(s: str) -> tuple[str, str]:
    n = 2 if s[:2] in COMPOUND_SURNAMES and len(s) > 2 else 1
    return s[:n], s[n:]


@lru_cache(maxsize=100_000)
def parse_person(name: str | None) -> Person | None:
    """A person's name without titles, brackets and marks; nicknames with a masked full name are resolved."""
    if not name or not name.strip():
        return None
    s = fold(name)
    m = re.fullmatch(rf"[{NICKNAME_PREFIXES}](.)[（(](.+?)某[)）]", s.replace(" ", ""))
    if m:  # the nickname has the character that the mask hides
        surname, given = _split_han(m[2] + m[1])
        return Person(surname, given, han=True)
    s = _BRACKETS.sub("", s)
    if _HAN.search(s):
        s = _TITLES.sub("", re.sub(r"[^一-鿿]", "", s))
        return Person(*_split_han(s), han=True) if len(s) > 1 else None
    s = s.lower().replace("-", "").replace("'", "")
    if "," in s:
        surname, _, given = s.partition(",")
        surname, given = re.sub(r"[^a-z]", "", surname), re.sub(r"[^a-z]", "", given)
        return Person(_lu(surname), given) if surname and given else None
    tokens = re.findall(r"[a-z]+\.?", s)
    marks = [t for t in tokens if len(t.rstrip(".")) == 1]
    words = [t.rstrip(".") for t in tokens if len(t.rstrip(".")) > 1]
    if marks and len(words) == 1:
        return Person(_lu(words[0]), initials="".join(t[0] for t in marks))
    if len(words) < 2:
        return None
    first = words[0] in _COMPOUND_LATIN or (words[-1] not in _COMPOUND_LATIN and fold(name).split(" ")[0].isupper() and len(words) == 2)
    if first:  # capitals give the surname first; the sound doesn't depend on it
        return Person(_lu(words[0]), "".join(words[1:]))
    return Person(_lu(words[-1]), "".join(words[:-1]))


# Common words for what a company does, none the end of another; the tables' own words are learned (``lexicon``).
INDUSTRIES = (
    "电子科技 智能装备 新能源 新材料 化工 软件 半导体 港口 农牧 环保科技 文化传媒 精密机械 医疗器械 矿业 物流 食品 纺织 生物制药 汽车 电池 光伏 风电 电力 钢铁 有色金属 水泥 建材 玻璃 造纸 塑料 橡胶 化纤 化肥 农药 医药 "
    "生物技术 生物科技 健康 教育 影视 旅游 酒店 餐饮 酒业 乳业 饮料 粮油 种业 渔业 养殖 航空 航运 铁路 公路 地产 置业 建设 建筑 工程 装饰 家居 家具 家电 电器 电气 电机 电缆 通信 网络 信息技术 数据 互联网 人工智能 机器人 "
    "仪器 仪表 光电 光学 激光 芯片 微电子 集成电路 重工 机床 轴承 船舶 零部件 轮胎 服饰 服装 鞋业 珠宝 百货 超市 零售 商贸 供应链 租赁 保险 期货 环境 水务 燃气 热力 石油 石化 天然气 煤炭 煤业 黄金 稀土"
).split()
_KIND_WORDS = [
    ("lp", ("股权投资合伙", "创业投资合伙", "产业投资合伙", "投资合伙", "合伙企业", "合伙")),
    ("soe", ("国有资本", "国资")),
    ("manager", ("私募基金管理", "基金管理")),
    ("invmanage", ("投资管理",)),
    ("invdevelop", ("投资发展",)),
    ("asset", ("资产管理",)),
    ("holding", ("控股集团", "控股")),
    ("invgroup", ("投资集团",)),
    ("sales", ("销售", "贸易")),
]
_LP_TYPES = ("股权投资", "创业投资", "产业投资")
_STOP = tuple(w for _, ws in _KIND_WORDS for w in ws) + _LP_TYPES + ("股份", "集团", "投资", "私募", "基金", "混合", "有限", "公司", "运营", "证券", "银行", "企业", "年金", "号", "（")
#: Words that end a brand but are too general to be what a company does.
_GENERAL = ("科技",)


@dataclass(frozen=True)
class Lexicon:
    """What the parts of organisations' names are told by. ``places``: names of towns without their rank, of provinces with
    and without it. ``short`` and ``english``: (form, industry). ``series``: product lines of funds."""

    places: frozenset[str] = frozenset()
    industries: frozenset[str] = frozenset(INDUSTRIES)
    short: frozenset[tuple[str, str]] = frozenset()
    english: frozenset[tuple[str, str]] = frozenset()
    series: frozenset[str] = frozenset()

    @cached_property
    def by_length(self) -> list[str]:
        return sorted(self.industries, key=lambda w: (-len(w), w))

    @cached_property
    def by_series(self) -> list[str]:
        return sorted(self.series, key=lambda w: (-len(w), w))

    @cached_property
    def short_forms(self) -> dict[str, str]:
        return dict(sorted(self.short, key=lambda x: (-len(x[0]), x)))

    @cached_property
    def english_forms(self) -> dict[str, str]:
        return dict(sorted(self.english, key=lambda x: (-len(x[0]), x)))

    @cached_property
    def stop(self) -> re.Pattern:
        words = {*_STOP, *_GENERAL, *self.industries, *(s for s, _ in self.short), *self.series}
        return re.compile("|".join(sorted((re.escape(w) for w in words), key=lambda w: (-len(w), w))))


_OWN_FUNDS = re.compile(r"-(?:自有资金|自营|自有|自营账户)$")
_LEGAL_TAIL = re.compile(r"(?:股份有限公司|有限责任公司|股份公司|有限公司|股份有限公|有限公|公司|股份)$")


@dataclass(frozen=True)
class Organisation:
    """Parts of an organisation's name. Empty where the name doesn't say."""

    kind: str = ""  # core, lp, fund, plan, sub, holding, ... ; short where it is open
    brand: str = ""
    han: bool = True
    industry: str = ""
    place: str = ""  # reading of the place in front or in brackets
    detail: str = ""  # series and number of a product, period of a plan, type of a partnership, place of a subsidiary
    manager: str = ""  # brand of the manager where a product has one
    joint_stock: bool = False
    plain: str = ""  # the folded name

    @property
    def sound(self) -> str:
        return reading(self.brand)

    @property
    def key(self) -> str:
        return "|".join((self.kind, self.brand if self.han else "~" + self.brand, self.industry, self.detail))


def _take_place(s: str, places: frozenset[str]) -> tuple[str, str]:
    for n in (4, 3, 2):
        if s[:n] in places and len(s) > n:
            rest = s[n:]
            if rest[0] in "市省" and len(rest) > 1:
                rest = rest[1:]
            # a province says too little: any of its towns may stand in another spelling
            return ("" if s[:n] + "省" in places else s[:n]), rest
    return "", s


def _brand(s: str, lex: Lexicon) -> tuple[str, str]:
    m = lex.stop.search(s, 1) if len(s) > 1 else None
    return (s[: m.start()], s[m.start() :]) if m else (s, "")


def _industry(rest: str, lex: Lexicon) -> str:
    for full in lex.by_length:
        if full in rest:
            return full
    for short, full in lex.short_forms.items():
        if rest.startswith(short):
            return full
    return ""


def _english(s: str, lex: Lexicon) -> Organisation:
    low = re.sub(r"[.,]", " ", s.lower())
    place = ""
    m = re.search(r"\(([a-z' -]+)\)", low)
    if m:
        place = re.sub(r"[^a-z]", "", m[1])
        low = low[: m.start()] + " " + low[m.end() :]
    words = low.split()
    tail = " ".join(words[1:])
    industry = next((full for eng, full in lex.english_forms.items() if eng in tail), "")
    kind = "lp" if re.search(r"\blp\b", tail) else "holding" if "holding" in tail else "core" if industry else "short"
    return Organisation(kind, words[0] if words else "", False, industry, place, "", "", "ltd" in tail, low.strip())


@lru_cache(maxsize=4)
def _of_places(places: frozenset[str]) -> Lexicon:
    return Lexicon(places)


def parse_organisation(name: str | None, lexicon: Lexicon | frozenset[str]) -> Organisation | None:
    """The parts of a name; with places alone the lexicon has the common industries only."""
    return _parse_organisation(name, lexicon if isinstance(lexicon, Lexicon) else _of_places(lexicon))


@lru_cache(maxsize=200_000)
def _parse_organisation(name: str | None, lex: Lexicon) -> Organisation | None:
    places = lex.places
    if not name or not name.strip():
        return None
    raw = fold(name)
    if not _HAN.search(raw):
        return _english(raw, lex) if re.search(r"[A-Za-z]{3}", raw) and not re.fullmatch(r"\d{6}\.[A-Za-z]{2}", raw) else None
    s = re.sub(r"\s", "", raw).replace("(", "（").replace(")", "）").lstrip("*")
    s = re.sub(r"^(?:st)(?=[一-鿿])", "", s, flags=re.I)
    s = re.sub(r"[-－—–－·]+", "-", s).strip("-.。．")
    plain = s
    s = _OWN_FUNDS.sub("", s)
    head, _, tail = s.partition("-")
    if "持股计划" in s or "年金" in s or "资产管理计划" in s or "信托" in s:
        place, body = _take_place(head, places)
        brand, rest = _brand(body, lex)
        m = re.search(r"第(.+?)期", s)
        what = "持股" if "持股" in s else "年金" if "年金" in s else "计划"
        return Organisation("plan", brand, True, _industry(rest, lex), reading(place), what + (m[1] if m else ""), "", False, plain)
    num = re.search(r"(\d+)号", tail or head)
    if num or (("基金" in (tail or head)) and "管理" not in (tail or head)):
        product = tail or head
        series = next((x for x in lex.by_series if x in product), "")
        place, body = _take_place(head, places)
        manager = _brand(body, lex)[0] if tail and "银行" not in head else ""
        own = _brand(product, lex)[0] if not any(product.startswith(x) for x in lex.by_series) else ""
        detail = f"{series}{num[1]}" if num else f"{series}*"
        return Organisation("fund", own or manager, True, "", reading(place) if "银行" not in head else "", detail, manager, False, plain)
    place, body = _take_place(head, places)
    inner = ""
    m = re.search(r"（([^（）]*)）", body)
    if m:
        if m[1] in places or m[1].rstrip("市") in places:
            inner = m[1].rstrip("市")
        body = body[: m.start()] + body[m.end() :]
    kind = ""
    if re.match(r"国有资本", body):
        body, kind = re.sub(r"^国有资本", "", body), "soe"
    brand, rest = _brand(body, lex)
    industry = _industry(rest, lex)
    joint = "股份" in rest
    detail = ""
    if not kind:
        kind = next((k for k, ws in _KIND_WORDS if any(w in rest for w in ws)), "")
    if kind == "lp":
        detail = next((t for t in _LP_TYPES if t in rest), "")
        industry = ""
    elif kind == "sales":
        detail = reading(place or inner)
    elif not kind:
        if inner and not joint:
            kind, detail = "sub", reading(inner)
        elif industry and (joint or "公司" in rest or rest.startswith(industry)):
            kind = "core"
        else:
            kind = "short"
    return Organisation(kind, brand, True, industry, reading(place or inner), detail, "", joint, plain)


def keyword_error(x, y) -> bool:
    """One error in the word for what a company does (or beside it): the names differ by one edit, and one is read to
    have another industry and, unless the brands are equal, a long brand that has swallowed the word. Takes parsed names or rows of their parts."""
    get = (lambda o, k: o[k]) if isinstance(x, dict) else getattr
    x, y = sorted((x, y), key=lambda o: len(get(o, "brand")))
    open_ = ("short", "core")
    if get(y, "kind") not in open_ or not (get(x, "han") and get(y, "han")):
        return False
    if get(x, "brand") == get(y, "brand"):
        swallowed = get(x, "kind") in open_ and get(x, "industry") != get(y, "industry")
    else:
        swallowed = len(get(y, "brand")) > 4 and (get(x, "kind") not in open_ or get(x, "industry") != get(y, "industry"))
    return swallowed and len(get(y, "plain")) > 6 and one_edit(get(x, "plain"), get(y, "plain"))


def person_key(p: Person | None) -> str:
    return "" if p is None else ("" if p.han else "~") + (p.name if p.han else p.sound)
