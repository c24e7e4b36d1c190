"""Names, variants, components and matching."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


from tessera.llm.components import connected_components
from tessera.llm.matching import accepted, date_state, pair_evidence, place_town, propagate
from tessera.llm.names import Lexicon, fold, keyword_error, jaro_winkler, one_edit, parse_organisation, parse_person, reading
from tessera.llm import variants
from tessera.llm.variants import fine_codes, gazetteer, link_variants, variant_pairs

PLACES = frozenset({"晏河", "襄陵口", "栖桐"})
LEXICON = Lexicon(PLACES, short=frozenset({("半导", "半导体"), ("环科", "环保科技"), ("电子", "电子科技")}), english=frozenset({("electronics", "电子科技"), ("semiconductor", "半导体"), ("environmental", "环保科技")}), series=frozenset({"价值成长", "稳健", "进取"}))


@pytest.mark.parametrize(("a", "b", "value"), [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, value):
    assert abs(jaro_winkler(a, b) - value) < 1e-4


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit_against_brute_force(a, b):
    near = {a} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert one_edit(a, b) == (b in near)


@pytest.mark.parametrize(
    ("typed", "plain"),
    [("钟 韬漳", "钟韬漳"), ("鐘韜漳", "钟韬漳"), ("钟·韬·漳", "钟韬漳"), ("钟韬漳女士", "钟韬漳"), ("钟韬漳(董事)", "钟韬漳"), ("钟韬漳．", "钟韬漳"), ("老漳（钟韬某）", "钟韬漳"), ("阿漳（钟韬某）", "钟韬漳")],
)
def test_person_spellings(typed, plain):
    assert parse_person(typed).name == plain


def test_latin_names_sound_like_their_characters():
    han = parse_person("罗晶晖") or parse_person("罗景晖")
    for s in ("Luo, Jing-Hui", "Jinghui Luo", "LUO JINGHUI", "Luo, Jing Hui"):
        assert parse_person(s).sound == "|".join(sorted(("jinghui", "luo")))
    assert han is not None and parse_person("J. H. Luo").sound_initials == "luo|jh" == parse_person("罗璟晖").sound_initials
    assert parse_person("尉迟轶").sound == parse_person("YUCHI YI").sound
    assert parse_person(None) is None and parse_person("  ") is None and parse_person("１２") is None


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("晏河市韬堃澈半导体股份有限公司", "韬堃澈（晏河）半导体股份有限公司", True),
        ("晏河市韬堃澈半导体股份有限公司－自有资金", "晏河市韜堃澈半導體股份有限公司", True),
        ("晏河璇渊珩私募基金管理有限公司－璇渊珩进取12号私募证券投资基金", "璇渊珩私募－进取12号", True),
        ("璇渊珩私募－进取12号", "璇渊珩私募－进取13号", False),
        ("韬堃澈控股集团有限公司", "晏河市韬堃澈半导体股份有限公司", False),
        ("韬堃澈半导体（栖桐）有限公司", "晏河市韬堃澈半导体股份有限公司", False),
        ("晏河市韬堃澈半导体股份有限公司－第二期员工持股计划", "晏河市韬堃澈半导体股份有限公司", False),
    ],
)
def test_organisation_keys(a, b, same):
    assert (parse_organisation(a, LEXICON).key == parse_organisation(b, LEXICON).key) == same


def test_english_organisation():
    o = parse_organisation("Tuolunman Investment (Yanhe) LP", LEXICON)
    assert (o.kind, o.brand, o.place, o.han) == ("lp", "tuolunman", "yanhe", False)
    assert reading("拓纶缦") == "tuolunman" and fold("ＡＢ　c") == "AB c"


R = "target string, list date, ann date, id string, name string, aname string, kind string, ratio double, scope string, key string"


def _pairs(spark, rows, aliases=None, coded=None):
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], R)
    al = spark.createDataFrame(aliases, "id string, alias string") if aliases else None
    c = link_variants(df, id_col="id", name_cols=["name", "aname"], person="kind = 'PERSON'", scope="target", list_cols=["list", "ann"], ratio="ratio", lexicon=LEXICON, aliases=al, coded=coded)
    return {(r[0], r[1]) for r in variant_pairs(c).collect()}


def test_variants(spark):
    d = [dt.date(2020, m, 1) for m in range(1, 7)]
    row = lambda i, ident, name, kind="PERSON", t="T", ratio=0.1, aname=None: (t, d[i], d[i], ident, name, aname, kind, ratio)
    rows = [
        row(0, "p1", "钟韬漳", ratio=0.5), row(1, "p2", "鐘韜漳", ratio=0.5), row(2, "p3", "ZHONG TAOZHANG", ratio=0.5), row(3, "p4", "钟漳韬", ratio=0.5),
        # brothers: in one list
        row(0, "b1", "方岫洋", ratio=0.2), row(0, "b2", "方岫纶", ratio=0.21),
        # a typing error beside an equal ratio; the same without one
        row(0, "t1", "卢瑾谌", ratio=0.3), row(1, "t2", "卢擎谌", ratio=0.3), row(0, "u1", "高弈漪", ratio=0.4), row(1, "u2", "高弈晟", ratio=0.07),
        # a namesake elsewhere
        row(0, "n1", "钟韬漳", t="S"),
        # organisations match across companies
        row(0, "o1", "晏河市隽渊笙投资管理有限公司", "COMPANY"), row(1, "o2", "晏河市雋淵笙投資管理有限公司", "COMPANY", t="S"), row(2, "o3", "璇渊珩私募－进取12号", "COMPANY"), row(3, "o4", "璇渊珩私募－进取13号", "COMPANY"),
        row(4, "e1", None), row(4, "e2", " "), row(4, "e3", "．．", "COMPANY"), (None, d[0], d[0], "e4", "钟韬漳", None, "PERSON", 0.1),
    ]
    got = _pairs(spark, [*rows, *rows[:4]])
    assert got == {("p1", "p2"), ("p1", "p3"), ("p2", "p3"), ("p1", "p4"), ("p2", "p4"), ("p3", "p4"), ("t1", "t2"), ("o1", "o2")}
    assert _pairs(spark, []) == set()


@settings(max_examples=200, deadline=None)
@given(st.text("甲乙丙", min_size=1, max_size=4), st.text("甲乙丙", min_size=1, max_size=4))
def test_names_within_one_edit_share_a_fine_code(a, b):
    assert not one_edit(a, b) or set(fine_codes(a, True)) & set(fine_codes(b, True))


def test_crowded_blocks_give_the_same_pairs(spark, monkeypatch):
    rnd = random.Random(6)
    day = dt.date(2020, 1, 1)
    rows = [("T", day + dt.timedelta(days=i), day, f"c{i:03d}", "晏河市" + "".join(rnd.choice("隽渊笙璇珩") for _ in range(3)) + "投资管理有限公司", None, "COMPANY", 0.1) for i in range(60)]
    whole = _pairs(spark, rows)
    monkeypatch.setattr(variants, "MAX_BLOCK", 3)
    assert whole and _pairs(spark, rows) == whole


@pytest.mark.parametrize("crowd", [["晏河市蕴雍澈电字科技股份有限公司", "晏河市蕴雍澈电子科技股份有限公司"], ["Yunyongche Electronics (Yanhe) Co., Ltd.", "晏河市蕴雍澈电子科技股份有限公司"], ["蕴雍澈电子", "晏河市筠勇澈电子科技股份有限公司"], ["J. H. Luo", "罗璟晖"], ["LUO JINGHUI", "罗璟晖"]])
def test_crowded_blocks_keep_pairs_without_a_common_brand(spark, monkeypatch, crowd):
    day = dt.date(2020, 1, 1)
    kind = "PERSON" if "罗" in crowd[1] else "COMPANY"
    rows = [("T", day + dt.timedelta(days=i), day, f"c{i:03d}", n, None, kind, 0.1) for i, n in enumerate(crowd)]
    whole = _pairs(spark, rows)
    monkeypatch.setattr(variants, "MAX_BLOCK", 1)
    assert whole == {("c000", "c001")} and _pairs(spark, rows) == whole


@pytest.mark.parametrize("name", ["蕴雍澈电字科技", "甲甲乙", "甲"])
def test_fine_codes_as_a_column(spark, name):
    got = spark.createDataFrame([(name,)], "n string").select(variants._fine_codes_of(F.col("n")).alias("c")).first().c
    assert sorted(got) == fine_codes(name, True)


def test_aliases_join_ids_but_not_against_one_list(spark):
    d = [dt.date(2020, m, 1) for m in range(1, 4)]
    rows = [("T", d[0], d[0], "a", "甲骁原贸易行", "乙棠州商社", "COMPANY", 0.1), ("T", d[1], d[1], "b", "乙棠州商社", None, "COMPANY", 0.2)]
    assert _pairs(spark, rows) == {("a", "b")}
    assert _pairs(spark, [*rows, ("T", d[1], d[1], "a", "甲骁原贸易行", None, "COMPANY", 0.1)]) == set()


def test_two_registered_ids_are_two_entities(spark):
    d = dt.date(2020, 1, 1)
    rows = [("T", d, d, "C:1", "晏河市隽渊笙投资管理有限公司", None, "COMPANY", 0.1), ("S", d, d, "C:2", "晏河市隽媛笙投资管理有限公司", None, "COMPANY", 0.2), ("U", d, d, "u", "晏河隽渊笙投资管理公司", None, "COMPANY", 0.2)]
    assert _pairs(spark, rows) == {("C:1", "C:2"), ("C:1", "u"), ("C:2", "u")}
    assert _pairs(spark, rows, coded="startswith(id, 'C:')") == {("C:1", "u")}
    both = [*rows, ("V", d, d, "C:1", "Junyuansheng Foods Co., Ltd.", None, "COMPANY", 0.3), ("W", d, d, "C:2", "Junyuansheng Foods Co., Ltd.", None, "COMPANY", 0.4), ("X", d, d, "v", "Junyuansheng Foods Co., Ltd.", None, "COMPANY", 0.4)]
    assert _pairs(spark, both, coded="startswith(id, 'C:')") == {("C:1", "u")}


def test_gazetteer(spark):
    df = spark.createDataFrame([("岚南省晏河市",), (" 晏河市高岫区",), ("岚南省棠州市",), ("Yanhe",), (None,)], "p string")
    assert gazetteer(df) == {"晏河", "棠州", "岚南", "岚南省"}


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dates_and_places():
    d = dt.date
    assert [date_state(d(2012, 3, 7), x) for x in (d(2012, 3, 7), d(2012, 1, 1), d(2012, 7, 3), d(2012, 9, 20), d(2013, 9, 7), None)] == ["same", "near", "turned", "year", "other", ""]
    assert {place_town(x) for x in ("岚南省晏河市", " 晏河市高岫区", "晏河", "Yanhe", "晏河市")} == {"yanhe"}
    assert place_town(None) == ""


def test_pair_evidence():
    c = {"names": ["晏河市韬堃澈半导体股份有限公司"], "place": "晏河市", "since": dt.date(2007, 9, 15), "person": "石 弈朔"}
    same = {"names": ["韜堃澈（晏河）半導體股份有限公司"], "place": "Yanhe", "since": None, "person": "SHI YISHUO"}
    assert pair_evidence(c, same, LEXICON).score() > 3
    for name in ("韬堃澈控股集团有限公司", "韬堃澈半导体（栖桐）有限公司", "晏河市韬堃澈半导体股份有限公司企业年金计划"):
        assert pair_evidence(c, same | {"names": [name]}, LEXICON) is None
    assert pair_evidence(c, {"names": ["晏河市韬堃澈半导体股份有限公司"], "place": None, "since": None, "person": None}, LEXICON).score() > 0
    assert pair_evidence(c, same | {"since": dt.date(1999, 1, 5), "place": "栖桐市", "person": "x y"}, LEXICON).score() < 0


def _exact_marginals(rows):
    """By enumeration of all assignments that keep both rules."""
    total, on = 0.0, [0.0] * len(rows)
    import itertools
    import math

    for bits in itertools.product((0, 1), repeat=len(rows)):
        chosen = [r for r, b in zip(rows, bits, strict=True) if b]
        hs = [r[1] for r in chosen]
        units = {}
        for c, _, u, _ in chosen:
            units.setdefault(c, set()).add(u)
        if len(hs) != len(set(hs)) or any(len(v) > 1 for v in units.values()):
            continue
        w = math.exp(sum(r[3] for r in chosen))
        total += w
        for i, b in enumerate(bits):
            on[i] += w * b
    return [x / total for x in on]


def test_one_registered_holder_a_company(spark):
    m = spark.createDataFrame([("c", "R:1", 0.9), ("c", "R:2", 0.8), ("c", "u", 0.7), ("c", "v", 0.4), ("d", "u2", 0.6)], "company_id string, holder_entity_id string, confidence double")
    assert {r.holder_entity_id for r in accepted(m, "startswith(holder_entity_id, 'R:')").collect()} == {"R:1", "u", "u2"}
    assert accepted(m.where("false"), "true").count() == 0


def test_propagation_is_exact_on_trees_and_close_on_loops(spark):
    tree = [("c1", "h1", "u1", 2.0), ("c1", "h2", "u2", 1.0), ("c2", "h2", "u2", 0.5)]
    loop = [*tree, ("c2", "h1", "u1", -1.0)]
    for rows, tol in ((tree, 2e-3), (loop, 0.05)):
        df = spark.createDataFrame(rows, "c string, h string, unit string, score double")
        got = {(r.c, r.h): r.confidence for r in propagate(df).collect()}
        for r, p in zip(rows, _exact_marginals(rows), strict=True):
            assert abs(got[r[0], r[1]] - p) < tol
    assert propagate(spark.createDataFrame([], "c string, h string, unit string, score double")).count() == 0


def test_ids_of_one_holder_do_not_compete(spark):
    rows = [("c", f"h{i}", "=", 3.0) for i in range(5)] + [("c", "x", "other", 1.0)]
    got = {r.h: r.confidence for r in propagate(spark.createDataFrame(rows, "c string, h string, unit string, score double")).collect()}
    assert all(got[f"h{i}"] > 0.8 for i in range(5)) and got["x"] < 0.2


def test_ties_carry_evidence_between_ids(spark):
    """An id of which nothing is known follows the others of exactly its name, through messages."""
    cols = "c string, h string, unit string, same string, score double"
    alone = {r.h: r.confidence for r in propagate(spark.createDataFrame([("c", "h1", "=", "h1", 3.0), ("c", "h2", "=", "h2", -1.0)], cols)).collect()}
    tied = {r.h: r.confidence for r in propagate(spark.createDataFrame([("c", "h1", "=", "=", 3.0), ("c", "h2", "=", "=", -1.0)], cols)).collect()}
    against = {r.h: r.confidence for r in propagate(spark.createDataFrame([("c", "h1", "=", "=", -6.0), ("c", "h2", "=", "=", 1.0)], cols)).collect()}
    assert alone["h2"] < 0.3 and tied["h2"] > 0.7 and against["h2"] < 0.3


def test_messages_decide_between_competing_companies(spark):
    """Both companies accept the holder by their own scores; only the likelier one keeps it, and what it gives up can go on."""
    rows = [("c1", "h1", "=", 2.0), ("c2", "h1", "=", 0.5), ("c2", "h2", "other", 0.2)]
    df = spark.createDataFrame(rows, "c string, h string, unit string, score double")
    got = {(r.c, r.h): r.confidence for r in propagate(df).collect()}
    alone = {(c, h) for c, h, _, x in rows if x > 0}
    assert {k for k, v in got.items() if v > 0.5} == {("c1", "h1"), ("c2", "h2")} != alone
    with pytest.raises(RuntimeError):
        propagate(df, rounds=1)


def test_weights_are_estimated_from_patterns():
    from tessera.llm.matching import WEIGHTS, Evidence, estimate_weights

    assert estimate_weights([]) == WEIGHTS
    patterns = [("exact", "same", "same", "same", 5000), ("exact", "same", "", "other", 2000), ("typo", "other", "other", "other", 9000), ("sound", "other", "", "other", 3000)]
    w = estimate_weights(patterns)
    # in these pairs the representative says little, as matches often have another one
    assert w["person_other"] > -1.5 and w["name_exact"] > WEIGHTS["name_exact"] and w["place_other"] < -4
    assert Evidence("exact", "half", "", "", True).score(w) == pytest.approx(w["prior"] + w["name_exact"] + w["place_same"] / 2)


def test_words_are_learned_from_names(spark):
    from tessera.llm.lexicon import learn

    brands = ["甲乙", "丙丁戊", "己庚", "辛壬癸", "子丑", "寅卯辰", "巳午", "未申酉"]
    rows = [(f"c{i}", f"晏河市{b}卫星遥感股份有限公司") for i, b in enumerate(brands)] + [(f"c{i}", b + "卫遥") for i, b in enumerate(brands[:4])]
    rows += [(f"c{i}", f"{reading(b).capitalize()} Remote Sensing Co., Ltd.") for i, b in enumerate(brands[:4])]
    rows += [(f"f{i}", f"{b}投资－{b}磐石{i}号") for i, b in enumerate(brands)] + [("x", None), (None, " ")]
    lex = learn(spark.createDataFrame(rows, "id string, name string"), PLACES)
    assert "卫星遥感" in lex.industries and "遥感" not in lex.industries and "乙卫星遥感" not in lex.industries
    assert ("卫遥", "卫星遥感") in lex.short and ("remote sensing", "卫星遥感") in lex.english and "磐石" in lex.series
    a, b, c = (parse_organisation(n, lex) for n in ("晏河市庚辛卫星遥感有限公司", "庚辛卫遥", "Gengxin Remote Sensing Co., Ltd."))
    assert a.brand == b.brand == "庚辛" and a.industry == b.industry == c.industry == "卫星遥感" and a.sound == c.sound
    assert learn(spark.createDataFrame([], "id string, name string"), PLACES) == Lexicon(PLACES)


def test_characters_outside_the_tables_share_a_sound():
    assert reading("建国") == reading("健国") == "jianguo" and fold("比亞迪") == "比亚迪"
    assert parse_person("单雄信").sound == "shan|xiongxin" and parse_person("Shan Xiongxin").sound == "shan|xiongxin"
    a, b = (parse_organisation(n, LEXICON) for n in ("比亚迪汽车股份有限公司", "比亞迪汽車股份有限公司"))
    assert a.key == b.key and a.brand == "比亚迪" and a.industry == "汽车"
    x, y = (parse_organisation(n, LEXICON) for n in ("比亚迪汽车股份有限公司", "比亚迪气车股份有限公司"))
    assert keyword_error(x, y) and not keyword_error(x, parse_organisation("比亚迪汽车有限公司", LEXICON))
