"""Invented personal information for the training of ``pii``: spans are replaced, sentences put in, and like-looking words
that aren't personal stand among them."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from tessera.llm.names import COMPOUND_SURNAMES, reading
from tessera.llm.pii import fold_places

# Frequent one-character surnames.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷"
    "黎史龙陶贺顾毛郝龚邵万钱严赖覃洪武莫孔汤向常温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆"
)
# Characters frequent in given names.
GIVEN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂华建国志文红玉梅春生海燕辉鹏飞宇浩然子轩梓涵欣怡佳雨晨思远俊凯峰波斌健林光荣德成庆宝永福天龙云雪慧玲琴凤莲珍美新民东义和安胜利长江山立中学亮晓小丹青"
# Frequent given names and surnames in Latin letters.
WESTERN_GIVEN = "James Mary John Linda Robert Susan Michael Karen David Nancy William Lisa Richard Helen Thomas Sarah Charles Laura Daniel Emma Matthew Anna Mark Julia Paul Sophie Steven Claire Andrew Alice Kevin Rachel Brian Diana George Elena Peter Maria Henry Ingrid Carlos Yuki Hans Fatima Pierre Olga Ahmed Priya Lars Chloe Victor Nina Oscar Grace Simon Ruth Martin Kate".split()
WESTERN_SURNAMES = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Clark Lewis Walker Hall Young King Wright Scott Green Baker Adams Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Morgan Cooper Peterson Reed Bailey Kelly Howard Ward Watson Brooks Bennett Gray Hughes Foster Müller Schmidt Dubois Rossi Tanaka Suzuki Kim Singh Khan Ivanov Kowalski Larsen O'Brien McDonald Fitzgerald".split()
# Characters with which foreign names are written.
FOREIGN = "阿埃艾安奥巴贝本比伯布查达戴德迪杜恩尔法菲弗福戈格古哈海赫亨霍基吉加杰卡凯科克拉莱兰劳雷里利琳卢路罗洛马玛迈曼梅米莫姆娜内尼诺帕佩皮普奇乔琼萨塞桑沙史斯苏索塔泰汤特托瓦威韦维沃西希夏雅叶伊尤约泽詹朱"
# Words that begin like a name and are none.
NO_NAMES = "张家港 王府井 周口店 马鞍山 石家庄 许昌 成都 江苏 安徽 金额 余额 方案 方式 任务 任何 高度 高管 程序 周期 周边 马上 石油 金融 白银 黄金 黄山 温州 温度 常州 常见 康复 文件 文化 牛市 武汉 洪水 万元 万股 钱款 毛利 毛利率 严格 史上 雷达 段落 江西 江河 陆续 陆运 汪洋 范围 范本 于是 叶片 余下 杜绝 程度 丁类 沈阳 任期 钟表 姜黄 戴帽 贾汪区 夏季 方面 侯马市 熊市 秦皇岛 孔径 汤加 向上 向好 施工 易于 安全 安排 齐全 庄园 章程 鲁中 岳阳 关于 关联方 左右 包装 宁波 尚未 符合 舒适 成本 谷物 盛产 曲线 单位 单价 季度 林业 高新区 全体 东方 上官桥 金山 华东 华南 平安 建设 国际 建国门 中山路 和平 光明 长江 大连 天津 海南 龙头 宝山 新华 明确 文明 利润 成立 民生 学习".split()
# Capitalised words that are no names.
NO_LATIN = "Annual Report|Board Meeting|Hong Kong|New York|Stock Exchange|Audit Committee|Gross Margin|Two of 17|Chief Executive|Net Profit|South China|General Meeting|Share Capital|Fixed Assets|Deutsche Bank|Morgan Stanley|Johnson Controls Inc|Baker Hughes Co|First Quarter|Order Backlog|Page Two|Dear Sirs|Third Party|Yangtze River|United Kingdom|Item Three|Cash Flow|West Lake|Central Bank|Supply Chain".split("|")
# Frames in which invented spans stand; N name, P phone, E mail, I identity number, A address, X no span.
FRAMES = """{N}表示，公司经营正常。|会议由{N}主持。|联系人：{N}，电话：{P}|{N}先生，{P}|经办人{N}（身份证号{I}）|住址：{A}|由{N}、{N}和{N}组成工作组|{N}与{N}签署了协议。|投资者{N}来电（{P}）询问|收件人{N}，地址{A}，电话{P}
姓名：{N}　证件号码：{I}|请发邮件至{E}|{N}于2021年出生|公司聘任{N}为副总经理|据{N}介绍，{X}项目进展顺利|{N}、{X}|{X}，{N}|{N}持有公司股份|分析师 {N} {E}|独立董事{N}女士|护照号{I}|{N}的配偶{N}|联系 {P} 或 {E}
寄往{A}{N}收|家住{A}的{N}|{N}说：“{X}。”|昨天{N}在{X}会上发言|{N}（{X}）|感谢{N}教授的意见|{N}同志任职|主办人员：{N} {N}|签字注册会计师：{N}、{N}|法定代表人：{N}|{N}: {E}|手机{P}，微信同号|{X}{X}{X}，{X}|{N}辞去职务
{N} said the plan was on track.|Please contact {N} at {E}.|Call {N} on {P}.|Dear {N},|{N} and {N} voted against.|chaired by {N}|Signed: {N}|Prepared by {N}, {N}|Passport No. {I}|{N}, chief financial officer, resigned.|Analyst: {N}|lives at {A}|{X} and {X}|{X} met {N}
Yesterday {N} told reporters about the {X}.|Mr. {N}|Ms {N} owns shares|{N} ({E})|The letter was addressed to {N}, {A}.|{X}, {X}, {N}|{N}；{N}；{N}|出席：{N} {N} {N}|被告{N}，住{A}，身份证{I}|客户热线{H}|服务电话：{H}|统一社会信用代码{C}|合同编号{C}|{M}表示满意|投资者{M}提问""".replace("\n", "|").split("|")


@cache
def common_characters() -> str:
    """The 3,755 characters of the first level of GB 2312."""
    return "".join(bytes((row, cell)).decode("gb2312") for row in range(0xB0, 0xD8) for cell in range(0xA1, 0xFF) if not (row == 0xD7 and cell > 0xF9))


class Inventor:
    def __init__(self, rng: np.random.Generator, chinese: list[str] = NO_NAMES, english: list[str] = NO_LATIN):
        """``chinese``, ``english``: ordinary words, the frequent ones first."""
        self.rng = rng
        self.common = fold_places(common_characters())
        # what may be a person's name is no word here
        self.chinese = [w for w in map(fold_places, chinese) if not (len(w) == 3 and w[0] in SURNAMES) and w[:2] not in COMPOUND_SURNAMES]
        self.english = english

    def characters(self) -> str:
        return self.common + FOREIGN

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def han_name(self) -> str:
        surname = self.pick(COMPOUND_SURNAMES) if self.chance(0.12) else self.pick(SURNAMES)
        given = "".join(self.pick(GIVEN if self.chance(0.45) else self.common) for _ in range(1 + self.chance(0.72)))
        return surname + given

    def foreign_name(self) -> str:
        parts = ["".join(self.pick(FOREIGN) for _ in range(int(self.rng.integers(2, 5)))) for _ in range(1 + self.chance(0.9))]
        return "·".join(parts)

    def latin_name(self) -> str:
        r = self.rng.random()
        if r < 0.5:
            g, s = self.pick(WESTERN_GIVEN), self.pick(WESTERN_SURNAMES)
            if self.chance(0.35):  # a name that is in no list
                s = "".join(self.pick(("ba", "der", "lin", "mo", "ton", "ves", "kar", "is", "el", "gar", "wood", "ski", "han", "ros", "ti", "ov")) for _ in range(int(self.rng.integers(2, 4)))).capitalize()
            if self.chance(0.2):
                g = "".join(self.pick(("a", "be", "le", "ri", "na", "jo", "mi", "ka", "so", "el", "an", "th")) for _ in range(int(self.rng.integers(2, 4)))).capitalize()
            middle = f" {self.pick('ABCDEFGHJKLMPRSTW')}." if self.chance(0.2) else ""
            return self.pick((f"{g}{middle} {s}", f"{g}{middle} {s}", f"{g}{middle} {s}", f"{s}, {g}", f"{g} {s.upper()}", f"{g[0]}. {s}"))
        han = self.han_name()
        n = 2 if han[:2] in COMPOUND_SURNAMES else 1
        s = reading(han[:n]).capitalize()
        parts = [reading(c) for c in han[n:]]
        g = self.pick(("".join, "-".join, " ".join))(parts).capitalize()
        if "-" in g or " " in g:
            g = g.title() if self.chance(0.5) else g
        return self.pick((f"{s} {g}", f"{g} {s}", f"{s.upper()} {g}", f"{s}, {g}", f"{g} {s.upper()}"))

    def name(self, latin: float) -> str:
        if self.chance(latin):
            return self.latin_name()
        return self.foreign_name() if self.chance(0.1) else self.han_name()

    def phone(self) -> str:
        d, m = self.digits, "1" + self.pick("3456789") + self.digits(9)
        sep = self.pick(("-", " ", ""))
        return self.pick((m, m, f"{m[:3]}{sep}{m[3:7]}{sep}{m[7:]}", f"+86 {m}", f"+86-{m}", f"0{d(2)}-{d(8)}", f"0{d(3)}-{d(7)}", f"(0{d(2)}){d(8)}", f"(0{d(3)}) {d(7)}", f"+44 20 {d(4)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+852 {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}-{d(8)}转{d(3)}", "".join(self.pick("一二三四五六七八九〇") for _ in range(11))))

    def ident(self) -> str:
        y = f"{int(self.rng.integers(1940, 2010))}{int(self.rng.integers(1, 13)):02d}{int(self.rng.integers(1, 29)):02d}"
        card = f"{self.pick('123456799')}{self.digits(5)}{y}{self.digits(3)}{self.pick('0123456789X')}"
        return self.pick((card, card, card, f"{card[:6]} {card[6:14]} {card[14:]}", f"{self.pick('EGPMHCK')}{self.digits(8)}", f"E{self.pick('ABCDEF')}{self.digits(7)}", f"{self.pick('HM')}{self.digits(8)}"))

    def mail(self) -> str:
        w = lambda n: "".join(self.pick("abcdefghijklmnoprstuvwxyz") for _ in range(int(self.rng.integers(1, n))))
        at = self.pick(("@", "@", "@", "@", " (at) ", "[at]"))
        local = self.pick((w(8), w(6) + "." + w(8), w(5) + self.digits(2), w(2) + "_" + w(6), self.digits(8)))
        return f"{local}{at}{self.pick((w(9), w(6) + '-' + w(5)))}.{self.pick(('com', 'cn', 'com.cn', 'example', 'org', 'net', 'co.uk'))}"

    def han(self, lo: int, hi: int) -> str:
        return "".join(self.pick(self.common) for _ in range(int(self.rng.integers(lo, hi + 1))))

    def address(self, latin: float) -> str:
        n = lambda hi: str(int(self.rng.integers(1, hi)))
        if self.chance(latin):
            street = self.pick(WESTERN_SURNAMES) + " " + self.pick(("Road", "Street", "Avenue", "Lane", "Drive"))
            return self.pick((f"{n(900)} {street}", f"Flat {self.pick('ABCD')}, {n(40)}/F, {n(300)} {street}", f"Room {n(2000)}, No. {n(99)} {street}", f"Unit {n(50)}, {n(400)} {street}"))
        road = f"{self.han(2, 3)}{self.pick(('路', '街', '大道', '巷', '弄', '里'))}{n(999)}号"
        road += self.pick(("", "", f"{n(30)}栋{n(9)}单元{n(999)}室", f"{self.han(2, 2)}小区{n(20)}幢{n(900)}", f"{n(30)}号楼{n(2000)}室"))
        if self.chance(0.15):
            road = f"{self.han(2, 2)}镇{self.han(2, 2)}村{n(20)}组{n(99)}号"
        return (f"{self.han(2, 2)}省" if self.chance(0.3) else "") + (f"{self.han(2, 3)}市" if self.chance(0.6) else "") + (f"{self.han(2, 2)}{self.pick('区县')}" if self.chance(0.5) else "") + road

    def masked(self) -> str:
        s = self.pick(SURNAMES)
        return self.pick((f"{s}某", f"{s}某某", f"{s}先生", f"{s}女士", f"{s}**", f"{s}*{self.pick(GIVEN)}", f"{s}总", f"{s}经理", f"老{s}"))

    def sentence(self) -> tuple[str, list[tuple[str, int, int]]]:
        frame = self.pick(FRAMES)
        latin = 0.95 if frame.isascii() else 0.15
        text, spans = "", []
        for k, part in enumerate(re.split(r"\{(\w)\}", frame)):
            if k % 2 == 0:
                text += part
                continue
            kind, what = {"N": ("NAME", lambda: self.name(latin)), "P": ("PHONE", self.phone), "E": ("EMAIL", self.mail), "I": ("ID_NUMBER", self.ident), "A": ("ADDRESS", lambda: self.address(latin)), "X": ("", lambda: self.pick(NO_LATIN if latin > 0.5 else NO_NAMES)), "H": ("", lambda: self.pick((f"400-{self.digits(3)}-{self.digits(4)}", f"400{self.digits(7)}", "95" + self.digits(3)))), "C": ("", lambda: self.pick((f"91{self.digits(6)}MA{self.digits(5)}XK{self.digits(1)}", f"HT-{self.digits(10)}", f"No.{self.digits(8)}"))), "M": ("", self.masked)}[part]
            s = what()
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s
        return text, spans

    def word(self, latin: bool) -> str:
        words = self.english if latin else self.chinese
        return words[int(len(words) * self.rng.random() ** 2)]

    def prose(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A run of ordinary words with a few spans among them."""
        latin = self.chance(0.3)
        text, spans = "", []
        n = int(self.rng.integers(6, 30))
        for k in range(n):
            if self.chance(0.1):
                kind, make = self.pick((("NAME", lambda: self.name(0.97 if latin else 0.06)),) * 8 + (("PHONE", self.phone), ("EMAIL", self.mail), ("ID_NUMBER", self.ident), ("ADDRESS", lambda: self.address(float(latin))), ("", self.masked)))
                s = make()
                if kind:
                    spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                w = self.pick(NO_LATIN) if latin and self.chance(0.08) else self.word(latin)
                text += w.capitalize() if latin and (not text or text[-2:] == ". " or self.chance(0.08)) else w
            if latin:
                text += self.pick((" ", " ", " ", " ", " ", " ", ", ", ". ", " of ", " to the ", " and ", "'s ", ": "))
            elif self.chance(0.45):
                text += self.pick("的了在是和与对为从到被把，，，。、及由给让向说又也将已：；（）“” 一这其并有不")
        return text + self.pick(("。", "\n", ". ", "")), spans

    def instead(self, kind: str, old: str) -> tuple[str, str]:
        """(kind or '', text) of what stands in the place of a span."""
        if kind == "NAME":
            if self.chance(0.06):
                return "", self.masked()
            return kind, self.name(0.85 if old.isascii() else 0.08)
        if kind == "ADDRESS":
            if old.isascii() or self.chance(0.4):
                return kind, self.address(1.0 if old.isascii() else 0.0)
            return kind, re.sub(r"[一-鿿]{2,4}(?=[省市区县镇乡村路街巷里弄])", lambda m: self.han(len(m[0]), len(m[0])), re.sub(r"\d", lambda m: self.digits(1), old))
        if self.chance(0.4):
            return kind, {"PHONE": self.phone, "ID_NUMBER": self.ident, "EMAIL": self.mail}[kind]()
        return kind, re.sub(r"(?<=\d)\d", lambda m: self.digits(1), old)

    def vary(self, text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with most of its spans replaced and invented sentences put in; both are folded."""
        edits = []  # (start, end, new text, spans within it)
        if self.chance(0.12):  # another text altogether
            text, spans, whole = "", [], [self.prose() for _ in range(int(self.rng.integers(1, 6)))]
            for t, inner in whole:
                spans += [(k, len(text) + a, len(text) + b) for k, a, b in inner]
                text += t
            return fold_places(text), spans
        plain = self.chance(0.2)  # some texts stay as they are
        for kind, a, b in spans:
            if plain or self.chance(0.35):
                edits.append((a, b, text[a:b], [(kind, 0, b - a)]))
            else:
                k, s = self.instead(kind, text[a:b])
                edits.append((a, b, s, [(k, 0, len(s))] if k else []))
        if not plain and self.chance(0.5):
            free = [m.end() for m in re.finditer(r"[。；;\n]|\. ", text)] or [len(text)]
            for _ in range(1 + int(self.rng.integers(3))):
                at = self.pick(free)
                if not any(a < at < b for _, a, b in spans):
                    s, inner = self.prose() if self.chance(0.4) else self.sentence()
                    edits.append((at, at, s + self.pick(("", "\n", " ")), inner))
        if not plain and self.chance(0.25) and text:  # a name between any two characters
            at = int(self.rng.integers(len(text)))
            if not any(a - 1 <= at <= b for _, a, b in spans) and not (text[at - 1 : at + 1].isascii() and text[at - 1 : at + 1].isalnum()):
                s = self.name(0.8 if text[max(0, at - 20) : at + 20].isascii() else 0.05)
                edits.append((at, at, s, [("NAME", 0, len(s))]))
        edits.sort(key=lambda e: (e[0], e[1]))
        out, found, at, n = [], [], 0, 0
        for a, b, s, inner in edits:
            if a < at:
                continue
            out += [text[at:a], s]
            n += a - at
            found += [(k, n + x, n + y) for k, x, y in inner]
            n += len(s)
            at = b
        return fold_places("".join(out) + text[at:]), found
