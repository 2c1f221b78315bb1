"""Chemical formulas as column expressions.

A formula is parsed from right to left by one aggregate over its tokens with a
stack of multipliers, so nested groups need no user-defined function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import gcd

_TOKEN = r"([A-Z][a-z]?|[()\[\]]|\d+\.?\d*)"


def composition(formula: Column) -> Column:
    """map<string,double> of element amounts; groups in ( ) or [ ] are multiplied out, repeated elements add up."""
    start = F.struct(F.lit(None).cast("double").alias("n"), F.array(F.lit(1.0)).alias("stack"), F.array().cast("array<struct<e:string,n:double>>").alias("out"))
    none = F.lit(None).cast("double")

    def step(s, t):
        top, n = F.element_at(s["stack"], -1), F.coalesce(s["n"], F.lit(1.0))
        pop = F.when(F.size(s["stack"]) > 1, F.slice(s["stack"], 1, F.size(s["stack"]) - 1)).otherwise(s["stack"])
        return (
            F.when(t.rlike(r"^\d"), F.struct(t.try_cast("double").alias("n"), s["stack"].alias("stack"), s["out"].alias("out")))
            .when(t.isin(")", "]"), F.struct(none.alias("n"), F.concat(s["stack"], F.array(top * n)).alias("stack"), s["out"].alias("out")))
            .when(t.isin("(", "["), F.struct(none.alias("n"), pop.alias("stack"), s["out"].alias("out")))
            .otherwise(F.struct(none.alias("n"), s["stack"].alias("stack"), F.concat(s["out"], F.array(F.struct(t.alias("e"), (top * n).alias("n")))).alias("out")))
        )

    tokens = F.reverse(F.regexp_extract_all(formula, F.lit(_TOKEN), F.lit(1)))
    found = F.aggregate(tokens, start, step, lambda s: s["out"])
    names = F.array_distinct(F.transform(found, lambda x: x["e"]))
    total = lambda e: F.aggregate(F.filter(found, lambda x: x["e"] == e), F.lit(0.0), lambda s, x: s + x["n"])
    return F.map_from_arrays(names, F.transform(names, total))


def reduced(amounts: Column) -> Column:
    """map<string,bigint>: amounts rounded to whole numbers, 1 at least, divided by their greatest common divisor."""
    whole = F.transform_values(amounts, lambda _, n: F.greatest(F.rint(n).cast("long"), F.lit(1).cast("long")))
    g = F.greatest(gcd(F.map_values(whole)), F.lit(1))
    return F.transform_values(whole, lambda _, n: (n / g).cast("long"))


def ratio(counts: Column) -> Column:
    """Sorted reduced counts: '1-1-3'."""
    return F.array_join(F.transform(F.array_sort(F.map_values(counts)), lambda n: n.cast("string")), "-")


def formula_key(counts: Column) -> Column:
    """Elements by name with their counts: 'Ca1O3Ti1'."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], e["value"].cast("string"))), "")


def has_element(counts: Column, symbol: str) -> Column:
    return F.map_contains_key(counts, symbol.strip().capitalize())


def is_abo3(counts: Column) -> Column:
    """Three elements as 1:1:3, oxygen being the three."""
    return (ratio(counts) == "1-1-3") & (F.coalesce(F.try_element_at(counts, F.lit("O")), F.lit(0)) == 3)


def atoms_per_unit(counts: Column) -> Column:
    """Atoms of one formula unit, from whole-cell counts."""
    values = F.transform(F.map_values(counts), lambda n: n.cast("long"))
    return (F.aggregate(values, F.lit(0).cast("long"), lambda s, n: s + n) / F.greatest(gcd(values), F.lit(1))).cast("long")


def symbol(name: Column) -> Column:
    return F.initcap(F.trim(name))


def parse_ratio(text: str) -> tuple[str, dict[str, int]]:
    """A ratio argument: '214', '2:1:4' or '1-1-O3' as the sorted reduced ratio, and counts demanded of elements."""
    import math
    import re

    parts = re.split(r"[:\-]", text.strip()) if re.search(r"[:\-]", text) else list(text.strip())
    counts, named = [], {}
    for p in parts:
        m = re.fullmatch(r"([A-Z][a-z]?)?(\d*)", p)
        if not m or not p:
            raise ValueError(f"not a ratio: {text}")
        n = int(m[2] or 1)
        counts.append(n)
        if m[1]:
            named[m[1]] = n
    g = reduce(math.gcd, counts)
    return "-".join(str(n // g) for n in sorted(counts)), {k: n // g for k, n in named.items()}


def matches_ratio(counts: Column, text: str) -> Column:
    wanted, named = parse_ratio(text)
    out = ratio(counts) == wanted
    for e, n in named.items():
        out = out & (F.coalesce(F.try_element_at(counts, F.lit(e)), F.lit(0)) == n)
    return out


# Lexemes of a mineral formula: hydrate water, valence, element, number, sign of a charge, bracket, separator.
_LEXEME = r"([·•]\s*[\d.]*\s*H2O|\([IVX]+\)|[A-Z][a-z]?|\d+(?:\.\d+)?|[+−-]|[()]|[,;/])"


def ima_formula(text: Column) -> Column:
    """A mineral formula without hydrate water, charges, vacancies and valences; of a solid solution the first element.

    One pass over the lexemes: a sign takes the numbers at both its sides with
    it; a separator after the first element of a group drops the rest of the
    group and its brackets; one outside of any group ends the formula.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("mode"))

    def step(s, t):
        out, depth, mode = s["out"], s["depth"], s["mode"]
        state = lambda o, d=depth, m=F.lit(""): F.struct(o.alias("out"), d.alias("depth"), m.alias("mode"))
        last = lambda k: F.coalesce(F.try_element_at(out, F.lit(-k)), F.lit(""))
        drop = lambda k: F.slice(out, 1, F.greatest(F.size(out) - k, F.lit(0)))
        element, number = t.rlike("^[A-Z][a-z]?$"), t.rlike(r"^\d")
        return (
            F.when(mode == "ended", s)
            # The rest of a solid solution, up to the bracket that closes it; only its element stays.
            .when(mode == "rest", F.when(t == ")", state(F.concat(drop(2), F.array(last(1))), depth - 1)).otherwise(s))
            .when(t.rlike("^[·•]") | t.rlike(r"^\([IVX]+\)$"), state(out))
            .when(t.rlike("^[+−-]$"), state(F.when(last(1).rlike(r"^\d"), drop(1)).otherwise(out), depth, F.lit("charge")))
            .when(number & (mode == "charge"), state(out))
            .when(t.rlike("^[,;/]$"), F.when(depth == 0, state(out, depth, F.lit("ended"))).when(last(1).rlike("^[A-Z]") & (last(2) == "("), state(out, depth, F.lit("rest"))).otherwise(state(out)))
            .when(element | number, state(F.concat(out, F.array(t))))
            .when(t == "(", state(F.concat(out, F.array(t)), depth + 1))
            .otherwise(state(F.concat(out, F.array(t)), F.greatest(depth - 1, F.lit(0))))
        )

    return F.aggregate(F.regexp_extract_all(text, F.lit(_LEXEME), F.lit(1)), start, step, lambda s: F.array_join(s["out"], ""))


def rruff_formula(text: Column) -> Column:
    """The same for formulas with charges between carets, subscripts between underscores (rounded to whole numbers, 1 at least) and tags."""
    # Parts between marks alternate: outside, inside, outside, ...
    parts = lambda c, mark, inside: F.array_join(F.transform(F.split(c, mark), lambda x, i: F.when(i % 2 == 0, x).otherwise(inside(x))), "")
    plain = F.regexp_replace(parts(text, r"\^", lambda _: F.lit("")), "<[^>]+>", "")
    whole = lambda x: F.when(x.rlike(r"^\d+(\.\d*)?$"), F.greatest(F.rint(x.try_cast("double")).cast("long"), F.lit(1)).cast("string")).otherwise(x)
    return ima_formula(parts(plain, "_", whole))


def crystal_system(number: Column) -> Column:
    """Of a space-group number from 1 to 230; null outside."""
    bounds = ((2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic"))
    out = F.when(number < 1, None)
    for most, name in bounds:
        out = out.when(number <= most, name)
    return out


def symbol_system(hm: Column) -> Column:
    """Crystal system of a Hermann-Mauguin symbol by its symmetry places; orthorhombic unless another rule fits.

    Cubic symbols have a 3 at the second place, which a screw axis at the first
    (P4_3, P4_322) is not; both spellings of subscripts are taken.
    """
    s = F.regexp_replace(F.trim(hm), r"\s+", "")
    return (
        F.when(s.rlike(r"^[PABCFI]-?1$"), "triclinic")
        .when(s.rlike(r"^R"), "trigonal")
        .when(s.rlike(r"^P-?3"), "trigonal")
        .when(s.rlike(r"^P-?6"), "hexagonal")
        .when(s.rlike(r"^[PFI](4(_?[123])?32|-43[mncd]|(2(_?1)?|[mnad])-?3[mncd]?)$"), "cubic")
        .when(s.rlike(r"^[PI]-?4"), "tetragonal")
        .when(s.rlike(r"^[PABCI](2|2_1|m|c|n|a)(/[mcna])?$"), "monoclinic")
        .otherwise("orthorhombic")
    )


def clean_symbol(hm: Column) -> Column:
    """A space-group symbol for lookups: no spaces, ASCII bars and subscripts without underscores."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(hm, r"\s+", ""), "[−–‐]", "-"), "_", "")


def material_id(path: Column) -> Column:
    return F.regexp_extract(path, r"((?:mp|mvc|np)-\d+)", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(\.[A-Za-z0-9]+)?$", 1)


def formula_part(stem_column: Column) -> Column:
    """What stands before the database id of a stem."""
    return F.regexp_extract(stem_column, r"^(.*?)(?:_(?:mp|icsd|cod)-.*)?$", 1)


def safe_map(text: Column) -> Column:
    """map<string,double> of JSON text; what is not numeric is dropped, what can't be parsed is empty."""
    raw = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_filter(F.transform_values(raw, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "y", "t"), F.lit(False))


def slug(text: str, prefix: str = "topo_") -> str:
    import re

    return prefix + re.sub(r"[^0-9A-Za-z]+", "_", text.strip()).strip("_")
