"""Variant spellings of names typed by people.

Names are folded and parsed (``names``); distinct names of a scope become nodes. Candidate pairs of names come
from blocks of phonetic codes of their sorted tokens, whole and with one token left out; pairs are compared by
Jaro-Winkler and single edits, nicknames by their table of prefixes. Accepted pairs, names stated side by side in one
row, and typed names of one id are the edges of a graph whose connected components are the entities.

Persons are compared within their scope (the target company), organisations everywhere.

Exact checks after the comparison: a holder stands once in a list, so two names that stand in one announced list are
never joined; a name that differs in the last character, where relatives differ, needs a list of the same company in
which its holder has the very ratio of the other; names of two ids that a register gave are never joined, and a name
that several of them go by joins nothing; short and Latin names are joined only where one full name fits.

Scale: blocks hold distinct names, not rows; a name's rows are only met through the rarer name of a candidate pair, so a
name that has a third of all rows is never expanded unless its partner is as frequent. Ids are tied to names as stars,
not as pairs.

Defined results: null or blank names and names without letters tie nothing; repeated rows count once; a null scope
leaves a person out; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.names import Lexicon, jaro_winkler, keyword_error, one_edit, parse_organisation, parse_person, person_key, reading, surname_reading, syllables
from tessera.session import materialize

MIN_SIMILARITY = 0.8
#: A block of more names is split without losing pairs, see ``_pairs_of``.
MAX_BLOCK = 1_000

_PARSED = pa.schema([("person", pa.bool_()), ("name", pa.string()), ("key", pa.string()), ("kind", pa.string()), ("brand", pa.string()), ("sound", pa.string()), ("han", pa.bool_()), ("industry", pa.string()), ("place", pa.string()), ("detail", pa.string()), ("manager", pa.string()), ("plain", pa.string()), ("blocks", pa.list_(pa.string())), ("fine", pa.list_(pa.string()))])
_PARSED_DDL = "person boolean, name string, key string, kind string, brand string, sound string, han boolean, industry string, place string, detail string, manager string, plain string, blocks array<string>, fine array<string>"
#: Kinds a short name may stand for.
_SHORT_FOR = {"lp", "invmanage", "core", "asset", "invgroup", "manager"}


def gazetteer(*columns: DataFrame) -> frozenset[str]:
    """Names of towns and provinces in columns of registered places; a province also stands with its rank. As many as
    geography has: two to four characters before the word for a town or province."""
    text = columns[0]
    for c in columns[1:]:
        text = text.union(c)
    p = F.col(text.columns[0])
    town, province = F.regexp_extract(p, r"(?:^|省)\s*([\x{4e00}-\x{9fff}]{2,4})市", 1), F.regexp_extract(p, r"^\s*([\x{4e00}-\x{9fff}]{2,4})省", 1)
    with_rank = F.when(province != "", F.concat(province, F.lit("省"))).otherwise("")
    found = text.where(p.isNotNull()).select(F.explode(F.array(town, province, with_rank)).alias("place")).where("place <> ''")
    return frozenset(r[0] for r in found.distinct().collect())


def fine_codes(name: str, han: bool) -> list[str]:
    """Sorted characters of a name, whole and with one left out: names within one edit have one of them in common."""
    if not han:
        return ["~" + name]
    return sorted({"".join(sorted(name))} | {"".join(sorted(name[:i] + name[i + 1 :])) for i in range(len(name))})


def _person_row(name: str):
    p = parse_person(name)
    if p is None or (not p.given and not p.initials):
        return None
    s = surname_reading(p.surname)
    if p.initials:
        return (f"p|~{s}|{p.initials}", "initials", p.initials, p.sound_initials, False, [f"i|{p.sound_initials}"], p.name)
    blocks = [f"s|{p.sound}"]
    if p.han:
        given = syllables(p.given)
        blocks += sorted({f"d|{s}|{g}" for g in given} | {f"i|{p.sound_initials}"})
    return ("p|" + person_key(p), "full", p.name, p.sound, p.han, blocks, p.name)


def organisation_blocks(o) -> list[str]:
    """Codes of the sorted brand tokens with the parts that must agree."""
    fixed = f"{o.kind}|{o.detail if o.kind in ('fund', 'plan', 'sub', 'sales') else ''}"
    if not o.han:
        return [f"s|{o.kind}|{o.brand}", f"b|{o.brand}"]
    tokens = syllables(o.brand)
    out = {f"s|{o.kind}|{reading(o.brand)}", f"b|{reading(o.brand)}"}
    if len(tokens) > 1:
        out.add(f"d|{fixed}|" + " ".join(sorted(tokens)))
        if len(tokens) > 2:
            out |= {f"d|{fixed}|" + " ".join(sorted(tokens[:i] + tokens[i + 1 :])) for i in range(len(tokens))}
    if o.kind == "fund" and o.manager and o.manager != o.brand:
        m = syllables(o.manager)
        out.add(f"d|{fixed}|" + " ".join(sorted(m)))
    if len(o.plain) > 6 and len(o.brand) > 1:
        out.add("w|" + reading(o.brand[:2]))
    return sorted(out)


def _organisation_row(name: str, lexicon: Lexicon):
    o = parse_organisation(name, lexicon)
    if o is None or not o.brand:
        return None
    return o, (f"o|{o.key}|{o.place}", o.kind, o.brand, o.sound, o.han, organisation_blocks(o), o.plain)


def parse_names(names: DataFrame, lexicon: Lexicon | frozenset[str]) -> DataFrame:
    """names: (person boolean, name) distinct. Names that say nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for person, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if person:
                    row = _person_row(name)
                    if row:
                        key, kind, brand, sound, han, blocks, plain = row
                        out.append((True, name, key, kind, brand, sound, han, "", "", "", "", plain, blocks, fine_codes(brand if han else sound, han)))
                else:
                    got = _organisation_row(name, lexicon)
                    if got:
                        o, (key, kind, brand, sound, han, blocks, plain) = got
                        out.append((False, name, key, kind, brand, sound, han, o.industry, o.place, o.detail, o.manager, plain, blocks, fine_codes(brand if han else sound, han)))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in _PARSED]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _PARSED, strict=True)], schema=_PARSED)

    return names.mapInArrow(run, _PARSED_DDL)


def _agrees(a: str, b: str) -> bool:
    return not a or not b or a == b


def judge_persons(x: dict, y: dict) -> str:
    """'sure', 'weak' (needs evidence), 'one' (needs to be the only one), 'one weak' (either will do) or ''."""
    if x["kind"] == "initials" or y["kind"] == "initials":
        return "one" if x["kind"] != y["kind"] else ""
    if x["han"] and y["han"]:
        a, b = x["brand"], y["brand"]
        like = max(jaro_winkler(a, b), jaro_winkler(x["sound"], y["sound"]))
        if like < MIN_SIMILARITY - 1e-9:
            return ""
        if sorted(a) == sorted(b) and a[0] == b[0]:
            return "sure"
        if not one_edit(a, b) or a[0] != b[0]:
            return ""
        # relatives share the first character of the given name and differ in the last
        return "sure" if len(a) == len(b) and a[-1] == b[-1] else "weak"
    return "one" if x["sound"] == y["sound"] else ""


def judge_organisations(x: dict, y: dict) -> str:
    if keyword_error(x, y):
        return "sure"
    if x["kind"] == "short" or y["kind"] == "short":
        s, f = (x, y) if x["kind"] == "short" else (y, x)
        if f["kind"] == "short":
            if s["brand"] == f["brand"]:
                return "sure" if s["industry"] == f["industry"] and _agrees(s["place"], f["place"]) and s["plain"][-2:] == f["plain"][-2:] else ""
            # two full names without a known word for what the company does
            full = s["plain"].endswith("公司") and f["plain"].endswith("公司") and one_edit(s["plain"], f["plain"])
            return ("one weak" if s["sound"] == f["sound"] else "weak") if full else ""
        if len(s["brand"]) > 4:
            return ""
        if s["sound"] != f["sound"] or f["kind"] not in _SHORT_FOR or not _agrees(s["place"], f["place"]) or not _agrees(s["industry"], f["industry"]):
            return ""
        invest = "投资" in s["plain"]
        return "one" if invest == (f["kind"] != "core") else ""
    if x["kind"] != y["kind"] or not _agrees(x["place"], y["place"]):
        return ""
    if x["han"] != y["han"]:
        return "one" if x["sound"] == y["sound"] and _agrees(x["industry"], y["industry"]) else ""
    if x["industry"] != y["industry"]:
        return ""
    if x["detail"] != y["detail"]:
        series = x["kind"] == "fund" and (x["detail"][:-1] if x["detail"].endswith("*") else y["detail"][:-1] if y["detail"].endswith("*") else None)
        if series is not None and series is not False and x["brand"] == y["brand"] and (series == "" or (x["detail"] + y["detail"]).count(series) > 1):
            return "one"
        return "one" if x["kind"] == "lp" and (not x["detail"] or not y["detail"]) and x["brand"] == y["brand"] else ""
    a, b = x["brand"], y["brand"]
    if a == b:
        return "sure" if x["place"] == y["place"] else "one"
    if max(jaro_winkler(a, b), jaro_winkler(x["sound"], y["sound"])) < 0.7:
        return ""
    if x["kind"] == "fund" and (x["manager"] == b or y["manager"] == a) and one_edit(a, b):
        return "sure"
    if not one_edit(a, b) or len(a) < 2 or len(b) < 2:
        return ""
    placed = bool(x["place"]) and x["place"] == y["place"]
    if x["sound"] == y["sound"]:
        return "sure" if placed or x["kind"] in ("fund", "plan", "sub", "sales") else "one weak"
    if placed and sorted(a) == sorted(b):
        return "sure"
    # a brand with a character left out may come from several
    return "one weak" if placed and len(a) != len(b) else "weak"


def _judge(pairs: DataFrame) -> DataFrame:
    """Adds the verdict; pairs: scope, block, person, l (struct), r (struct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scope, person, left, right = (b.column(i).to_pylist() for i in range(4))
            out = [(s, x["key"], y["key"], v, p, x["han"], y["han"], x["kind"], y["kind"]) for s, p, x, y in zip(scope, person, left, right, strict=True) if (v := judge_persons(x, y) if p else judge_organisations(x, y))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            types = [pa.string()] * 4 + [pa.bool_()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["scope", "ka", "kb", "verdict", "person", "ha", "hb", "kinda", "kindb"])

    return pairs.select("scope", "person", "l", "r").mapInArrow(run, "scope string, ka string, kb string, verdict string, person boolean, ha boolean, hb boolean, kinda string, kindb string")


def link_variants(
    records: DataFrame,
    *,
    id_col: str,
    name_cols: list[str],
    person: str,
    scope: str,
    list_cols: list[str],
    ratio: str,
    lexicon: Lexicon | frozenset[str],
    aliases: DataFrame | None = None,
    coded: str | None = None,
) -> DataFrame:
    """(scope, id, component): the entity of each id, by scope for persons and with scope '' for organisations.

    ``person``: a boolean expression. ``list_cols``: what identifies an announced list beside the scope. ``aliases``:
    (id, name) stated elsewhere. ``coded``: a boolean expression over ``id``, true where the id comes from a register; two
    such ids are two entities, so names of one such id each are never joined.
    """
    main = name_cols[0]
    base = records.select(F.expr(f"CASE WHEN {person} THEN {scope} ELSE '' END").alias("scope"), F.expr(person).alias("person"), F.col(id_col).alias("id"), F.col(main).alias("name"), F.array_distinct(F.array_compact(F.array(*name_cols[1:]))).alias("others") if name_cols[1:] else F.array().cast("array<string>").alias("others"), F.xxhash64(scope, *list_cols).alias("list"), F.when(F.col(ratio).isNotNull(), F.xxhash64(scope, ratio)).alias("stake"))
    base = base.where("scope IS NOT NULL AND person IS NOT NULL AND id IS NOT NULL")
    # names first: as many as there are spellings, not rows
    typed = materialize(base.where("name IS NOT NULL").groupBy("scope", "person", "id", "name").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")))
    stated = typed.select("scope", "person", "id", "name", F.explode("others").alias("other"))
    if aliases is not None:
        extra = typed.select("scope", "person", "id", "name").join(aliases.select(F.col(aliases.columns[0]).alias("id"), F.col(aliases.columns[1]).alias("other")).where("other IS NOT NULL").distinct(), "id")
        stated = stated.unionByName(extra.select("scope", "person", "id", "name", "other"))
    names = typed.select("person", "name").unionByName(stated.select("person", F.col("other").alias("name"))).distinct()
    parsed = materialize(parse_names(names, lexicon))
    key_of = parsed.select("person", "name", "key")
    # what is used several times is written out: each query's plan stays small, and so does the driver
    named = materialize(typed.join(key_of, ["person", "name"]).select("scope", "person", "id", "name", "key"))
    ids = materialize(named.select("scope", "person", "id", "key").distinct())
    side = materialize(stated.join(key_of, ["person", "name"]).join(key_of.select("person", F.col("name").alias("other"), F.col("key").alias("other_key")), ["person", "other"]).where("key <> other_key").select("scope", "person", F.col("key").alias("ka"), F.col("other_key").alias("kb")).distinct())
    nodes = materialize(ids.select("scope", "person", "key").unionByName(side.select("scope", "person", F.col("kb").alias("key"))).distinct())
    # one parse of each key: its names differ in what the fold drops
    parts = parsed.groupBy("person", "key").agg(F.min(F.struct("kind", "brand", "sound", "han", "industry", "place", "detail", "manager", "plain", "blocks", "fine")).alias("p"))
    known = nodes.join(parts, ["person", "key"]).select("scope", "person", "key", "p.*")
    known = materialize(known.withColumn("k", F.xxhash64("scope", "key")))
    # blocks meet as hashes; what the names say is joined to the pairs that come out
    short = F.col("kind") == "short"
    # whole-name blocks are for names with an error in a keyword; such a name has to be one of the two
    odd = F.col("kind").isin("short", "core") & (F.length("brand") > 4)
    met = _pairs_of(known.withColumn("odd", odd).withColumn("short", short))
    item = F.struct("key", "kind", "brand", "sound", "han", "industry", "place", "detail", "manager", "plain")
    pairs = met.join(known.select(F.col("k").alias("kl"), "scope", "person", item.alias("l")), "kl").join(known.select(F.col("k").alias("kr"), item.alias("r")), "kr").select("scope", "person", "l", "r")
    judged = materialize(_judge(pairs).distinct())
    one = materialize(_turned(judged.where("startswith(verdict, 'one')")))
    agreed = judged.where("verdict <> 'one'").select("scope", "ka", "kb", F.col("verdict").endswith("weak").alias("weak")).unionByName(side.select("scope", "ka", "kb", F.lit(False).alias("weak")))
    every = agreed.withColumn("sole", F.lit(False)).unionByName(one.select("scope", F.col("less").alias("ka"), F.col("full").alias("kb"), F.lit(False).alias("weak"), F.lit(True).alias("sole")))
    edges = materialize(every.select("scope", F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"), "weak", "sole").groupBy("scope", "ka", "kb", "sole").agg(F.min("weak").alias("weak")))
    shared = None
    if coded:
        code = materialize(ids.where(F.expr(coded)).groupBy("scope", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
        shared = code.where("lo < hi").select("scope", "key")
        edges = _one_code(edges, code)
    passed = materialize(_checked(edges, base, named.select("scope", "person", "name", "key").distinct()))
    firm = passed.where("NOT sole").select("scope", "ka", "kb")
    open_ = materialize(one.join(passed.where("sole").select("scope", "ka", "kb"), ["scope", "ka", "kb"], "left_semi"))
    edges = firm.unionByName(_sole_names(open_, firm)).distinct()
    # names alone are nodes: the names of one id hang on its least name, and an id is where that name is
    node = lambda key: F.xxhash64("scope", key)
    typed_as = ids.select("scope", "person", "id", node("key").alias("k"))
    if shared is not None:
        # a name that several registered ids go by joins none of them
        typed_as = ids.join(shared.withColumn("many", F.lit(True)), ["scope", "key"], "left").select("scope", "person", "id", F.when(F.col("many"), F.xxhash64(F.lit("id"), "scope", "id")).otherwise(node("key")).alias("k"))
    first = typed_as.groupBy("scope", "person", "id").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    several = typed_as.join(first.where("first < last").select("scope", "id", "first"), ["scope", "id"]).where("k <> first").select(F.col("k").alias("a"), F.col("first").alias("b"))
    links = edges.select(node("ka").alias("a"), node("kb").alias("b"))
    found = connected_components(links.unionByName(several))
    return first.join(found.withColumnRenamed("node", "first"), "first", "left").select("scope", "person", "id", F.coalesce("component", "first").alias("component"))


def _one_code(edges: DataFrame, code: DataFrame) -> DataFrame:
    """Edges without those of a name that several registered ids go by, and between names of two different ones.
    code: (scope, key, lo, hi), the least and greatest registered id of a name."""
    side = lambda k: code.select("scope", F.col("key").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}"))
    both = edges.join(side("ka"), ["scope", "ka"], "left").join(side("kb"), ["scope", "kb"], "left")
    many = F.coalesce(F.col("lo_ka") < F.col("hi_ka"), F.lit(False)) | F.coalesce(F.col("lo_kb") < F.col("hi_kb"), F.lit(False))
    return materialize(both.where(~many & F.coalesce(F.col("lo_ka") == F.col("lo_kb"), F.lit(True))).select(*edges.columns))


def _pairs_of(known: DataFrame) -> DataFrame:
    """(kl, kr), kl < kr: names that share a block. known: k, scope, blocks, fine, short, odd.

    A block of more than ``MAX_BLOCK`` names is split so that every pair ``judge_persons`` and ``judge_organisations`` accept
    still meets. Written-out names of a pair are within one edit: they meet by ``fine_codes``, those of whole-name blocks by
    the same codes of the plain name. Latin names, initials and short names need the reading or initials of the block alone,
    whatever the characters are: each of them meets the whole block, written-out names don't meet each other there.
    """
    kind = F.substring("block", 1, 1)
    lean = known.select("k", F.explode("blocks").alias("block"), "scope", "short", "odd").select("k", F.xxhash64("scope", "block").alias("h"), kind.alias("t"), F.when(kind == "w", F.col("odd")).when(kind == "b", F.col("short")).otherwise(F.lit(True)).alias("may"))

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.alias("x").join(rows.alias("y"), "h").where("x.k < y.k AND (x.may OR y.may)").select(F.col("x.k").alias("kl"), F.col("y.k").alias("kr"))

    def pairs_of_few(rows: DataFrame) -> DataFrame:
        """The same where few rows may open a pair: only these are met with the others."""
        met = rows.where("may").alias("x").join(rows.alias("y"), "h").where("x.k <> y.k AND (NOT y.may OR x.k < y.k)")
        return met.select(F.least("x.k", "y.k").alias("kl"), F.greatest("x.k", "y.k").alias("kr"))

    big = materialize(lean.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_BLOCK).select("h"))
    if not big.limit(1).count():
        return pairs(lean).distinct()
    crowded = lean.join(big, "h", "left_semi").join(known.select("k", "fine", "han", "plain"), "k")
    part = lambda f, may: F.struct(f.alias("f"), may.alias("may"))
    fine = lambda codes: F.transform(codes, lambda c: part(c, F.col("may")))
    whole = lambda may: F.array(part(F.lit("*"), may))
    parts = F.when(F.col("t") == "w", fine(_fine_codes_of(F.col("plain")))).when(F.col("t") == "b", whole(F.col("may"))).when(F.col("t") == "d", fine(F.col("fine"))).otherwise(F.concat(fine(F.col("fine")), whole(~F.col("han"))))
    crowded = crowded.select("k", "h", F.explode(parts).alias("p")).select("k", F.xxhash64("h", "p.f").alias("h"), "p.may")
    return pairs(lean.join(big, "h", "left_anti")).unionByName(pairs_of_few(crowded)).distinct()


def _fine_codes_of(name: Column) -> Column:
    """``fine_codes`` of a name in characters, as a Column."""
    chars = F.split(name, "")
    code = lambda c: F.array_join(F.array_sort(c), "")
    return F.array_distinct(F.array_append(F.transform(chars, lambda _, i: code(F.filter(chars, lambda _, j: j != i))), code(chars)))


def _turned(pairs: DataFrame) -> DataFrame:
    """(scope, ka, kb, less, full, family, place): pairs of an abbreviated and a full name; the family of a full name is the
    name without its place."""
    key_a = (F.col("kinda").isin("short", "initials")) | (~F.col("ha") & F.col("hb"))
    key_b = (F.col("kindb").isin("short", "initials")) | (~F.col("hb") & F.col("ha"))
    # without an abbreviation the one that says less (no place, no detail) is the shorter key
    a_less = key_a | (~key_b & (F.length("ka") < F.length("kb")))
    t = pairs.select("scope", F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"), F.when(a_less, F.col("ka")).otherwise(F.col("kb")).alias("less"), F.when(a_less, F.col("kb")).otherwise(F.col("ka")).alias("full"), "person")
    family = F.when(F.col("person"), F.col("full")).otherwise(F.regexp_replace("full", r"\|[^|]*$", ""))
    place = F.when(F.col("person"), F.lit("")).otherwise(F.regexp_extract("full", r"\|([^|]*)$", 1))
    return t.select("scope", "ka", "kb", "less", "full", family.alias("family"), F.nullif(place, F.lit("")).alias("place")).distinct()


def _sole_names(turned: DataFrame, firm: DataFrame) -> DataFrame:
    """(scope, ka, kb) of the pairs whose abbreviation has one full name only: one family, or several that are joined with
    each other already, and no two places."""
    counted = turned.groupBy("scope", "less").agg(F.count_distinct("family").alias("families"), F.count_distinct("place").alias("places"))
    single = counted.where("families = 1 AND places <= 1").select("scope", "less")
    several = turned.join(counted.where("families > 1 AND places <= 1").select("scope", "less", "families"), ["scope", "less"])
    ends = firm.select("scope", F.col("ka").alias("full"), F.col("kb").alias("other")).unionByName(firm.select("scope", F.col("kb").alias("full"), F.col("ka").alias("other")))
    other = several.select("scope", "less", F.col("full").alias("other"), F.col("family").alias("other_family"))
    # each edge between families of one abbreviation; a tree over n families has n - 1 of them
    tied = several.join(ends, ["scope", "full"]).join(other, ["scope", "less", "other"]).where("family < other_family").select("scope", "less", "families", "family", "other_family").distinct()
    joined = tied.groupBy("scope", "less", "families").agg(F.count(F.lit(1)).alias("ties")).where("ties >= families - 1").select("scope", "less")
    return turned.join(single.unionByName(joined), ["scope", "less"], "left_semi").select("scope", "ka", "kb").distinct()


def _checked(edges: DataFrame, base: DataFrame, key_of: DataFrame) -> DataFrame:
    """Edges without those whose names stand in one list, and of the weak ones those with a stake in common.

    key_of: (scope, person, name, key). Names and keys are compared as hashes of scope and text; only rows whose name is in
    an edge are shuffled further.
    """
    e = edges.select("scope", "ka", "kb", "weak", "sole", F.xxhash64("scope", "ka").alias("a"), F.xxhash64("scope", "kb").alias("b"))
    wanted = e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct()
    names = key_of.select(F.xxhash64("scope", "name").alias("n"), F.xxhash64("scope", "key").alias("a")).join(wanted, "a", "left_semi").distinct()
    rows = materialize(base.select(F.xxhash64("scope", "name").alias("n"), "list", "stake").join(names, "n").select("a", "list", "stake"))
    n = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    sized = e.select("a", "b", "weak").join(n.withColumnRenamed("n", "na"), "a", "left").join(n.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b", "left")
    a_rarer = F.coalesce("na", F.lit(0)) <= F.coalesce("nb", F.lit(0))
    sized = materialize(sized.select("weak", "a", "b", F.when(a_rarer, F.col("a")).otherwise(F.col("b")).alias("key"), F.when(a_rarer, F.col("b")).otherwise(F.col("a")).alias("other")))
    met = sized.join(rows.withColumnRenamed("a", "key"), "key")
    lists, stakes = rows.select(F.col("a").alias("other"), "list"), rows.where("stake IS NOT NULL").select(F.col("a").alias("other"), "stake")
    clash = met.join(lists, ["other", "list"], "left_semi").select("a", "b").distinct()
    backed = met.where("weak").join(stakes, ["other", "stake"], "left_semi").select("a", "b").distinct()
    free = e.join(clash, ["a", "b"], "left_anti")
    return free.where("NOT weak").select("scope", "ka", "kb", "sole").unionByName(free.where("weak").join(backed, ["a", "b"], "left_semi").select("scope", "ka", "kb", "sole"))


def variant_pairs(components: DataFrame) -> DataFrame:
    """(holder_entity_id_a, holder_entity_id_b), a < b, of the ids of one entity within one scope."""
    c = components.select("scope", "component", "id").distinct()
    return c.alias("x").join(c.alias("y"), ["scope", "component"]).where("x.id < y.id").select(F.col("x.id").alias("holder_entity_id_a"), F.col("y.id").alias("holder_entity_id_b")).distinct()
