"""Scalar functions against values worked out by hand or by plain Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.functions.udfs import sections, visible_text, without_title_lines
from tessera.operators.chunking import Sizes, chunk, chunk_pages, heading_level, regions


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("", []), (None, []), ("Ab-1.2_c 你", ["ab", "1.2_c", "你"]), ("营业收入up", ["营业", "业收", "收入", "up"]), ("收入收入", ["收入", "入收", "收入"])],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, c.tokenize) == tokens


def test_clean_text(spark):
    assert one(spark, "﻿ a\t b \r\n\r\n\r\n\r\nc\x07　d ", c.clean_text) == "a b\n\nc d"
    assert one(spark, None, c.clean_text) is None


def test_names(spark):
    assert one(spark, "Ａ·b （集团） 有限公司", c.normalize_name) == "AB集团有限公司"
    assert one(spark, "甲乙股份有限公司", c.legal_core_name) == "甲乙"
    assert one(spark, "有限公司", c.legal_core_name) == "有限公司"
    assert [one(spark, x, c.canonical_company_id) for x in ("600000", "000001", "830001", "600000.sh", "x", None)] == ["600000.SH", "000001.SZ", "830001.BJ", "600000.SH", None, None]
    assert [one(spark, x, c.classify_company_code) for x in ("600000.SH", "600000.SZ", "abc")] == ["a_share", "exchange_mismatch", "nonstandard"]
    assert one(spark, "平安股份：关于x", c.title_prefix_alias) == "平安股份"
    assert one(spark, "no cjk: x", c.title_prefix_alias) is None


@pytest.mark.parametrize(("raw", "iso"), [("20240131", "2024-01-31"), ("20240131235959", "2024-01-31T23:59:59"), ("45322", "2024-01-31"), ("2024-01-31", "2024-01-31"), ("soon", "soon"), ("20241399", "20241399"), (None, None)])
def test_normalize_date(spark, raw, iso):
    assert one(spark, raw, c.normalize_date) == iso


def test_growth_and_ids(spark):
    df = spark.createDataFrame([(3.0, -2.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r.g for r in df.select(c.growth(F.col("a"), F.col("b")).alias("g")).collect()] == [2.5, None, None]
    want = "X-" + hashlib.sha256(b"a|None|1").hexdigest()[:24].upper()
    assert spark.range(1).select(c.hash_id("X-", 24, F.lit("a"), F.lit(None), F.lit(1)).alias("h")).first().h == want


def test_vectors_and_sets(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(c.l2_normalize(F.col("a")).alias("n"), c.l2_normalize(F.col("b")).alias("z"), c.inner_product(F.col("a"), F.col("a")).alias("p")).first()
    assert r.n == [0.6, 0.8] and r.z == [0.0, 0.0] and math.isclose(r.p, 25)
    s = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>")
    assert s.select(c.jaccard(F.col("a"), F.col("b")).alias("j"), c.dice(F.col("a"), F.col("b")).alias("d"), c.jaccard(F.col("a"), F.col("e")).alias("z")).first() == (1 / 3, 0.5, 0.0)


def test_ilike_takes_marks_as_they_are(spark):
    df = spark.createDataFrame([("100% Sure",), ("1000 sure",)], "t string")
    assert [r.t for r in df.where(c.ilike_any([F.col("t")], ["100%"])).collect()] == ["100% Sure"]


def test_html():
    assert visible_text("<p>a &lt;b&gt; c</p><!-- x --> d <b>e</b>\n f") == "a <b> c\nd e\nf"
    assert visible_text("x < y <a href='q>r'>z</a><style>q</style><svg/>1") == "x < y z1"
    assert visible_text("<p>a&nbsp;b</p><script>x</script><div>c<br>d</div>") == "a b\nc\nd"
    assert visible_text(None) is None and visible_text("") == ""


def test_title_lines():
    assert without_title_lines("标题：\n标 题\n正文", "标题") == "正文"
    assert without_title_lines("标题", "标题") == "标题"
    assert without_title_lines("正文", None) == "正文"


def test_sections(spark):
    rows = ["事件：甲。风险提示：乙", None, "no label", "事件概述：\n一\n事件概述：二 风险提示 : ", "重大事件：丙"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in rows], "t string").select(sections(F.col("t")).alias("s")).collect()]
    assert got == [{"事件": "甲。", "风险提示": "乙"}, {}, {}, {"事件概述": "一"}, {"事件": "丙"}]


def test_headings_and_regions():
    text = "前言\n一、概述\n（一）背景\n正文甲。\n1.2 细节\n正文乙。\n2023年正文。\n二、\n三、结论\n风险提示：\n&nbsp;"
    got = [(t, text[a:b][:6]) for a, b, t in regions(text, "announcement", Sizes(1, 10, 20, 30))]
    assert got == [(None, "前言"), ("一、概述 / （一）背景", "一、概述\n（"), ("一、概述 / （一）背景 / 1.2 细节", "1.2 细节")]
    assert heading_level("12 个月内") is None and heading_level("1、事项；") is None and heading_level("①甲") == 3 and heading_level("风险提示：") == 1
    assert regions("一、甲\n二、", None, Sizes(1, 10, 20, 30))[0][0] == 0


def test_chunks_cover_the_text_within_limits():
    text = "一、概述\n" + "甲乙丙丁，戊己庚辛。" * 300 + "\n\n（一）细节\n" + "x" * 5000 + "\n二、结论\n短"
    pieces = chunk(text, "announcement")
    end = 0
    for _, at, part in pieces:
        assert at >= end and text[at : at + len(part)] == part and len(part) <= 1200
        end = at + len(part)
    assert re.sub(r"\s", "", "".join(p for _, _, p in pieces)) == re.sub(r"\s", "", text)
    assert pieces[0][0] == "一、概述" and any(t == "一、概述 / （一）细节" for t, _, _ in pieces)
    assert chunk(None) == [] and chunk(" \n ") == []
    with pytest.raises(ValueError):
        Sizes(300, 200)


def test_chunk_pages_overlap():
    out = chunk_pages([(1, "一、标题\n" + "a" * 2000), (2, "b" * 10)])
    assert [len(t) for _, _, t in out] == [900, 900, 440, 10] and out[0][1] == "一、标题" and out[3][0] == 2
