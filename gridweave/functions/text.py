"""Expressions over drawing text: categories, component ids, values, cables, terminals, references."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def _any(regexes) -> str:
    return "|".join(f"(?:{r})" for r in regexes)


COMPONENT = _any(p.regex for p in P.CATALOGUE if p.in_label)


def all_of(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def label_category(text: Column) -> Column:
    """Of a positioned word: component, value, cable, reference, terminal, note, title, signal or text."""
    upper = F.trim(F.upper(text))
    signal = _any(rf"\b{w}\b" for w in P.SIGNAL_WORDS)
    title = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(w)) for w in P.TITLE_WORDS])
    return (
        F.when(upper.rlike(COMPONENT), "component")
        .when(upper.rlike(P.VOLTAGE) | upper.rlike(P.CURRENT), "value")
        .when(text.rlike(P.CABLE) | upper.rlike(P.PAIRS), "cable")
        .when(text.rlike(P.DRAWING_REF), "reference")
        .when(text.rlike(P.TERMINAL), "terminal")
        .when(upper.startswith("NOTE") | upper.startswith("REV"), "note")
        .when(title, "title")
        .when(upper.rlike(signal), "signal")
        .otherwise("text")
    )


def entity_category(text: Column) -> Column:
    """Of a CAD text: the shorter list."""
    upper = F.trim(F.upper(text))
    return (
        F.when(upper.rlike(COMPONENT), "component")
        .when(upper.rlike(P.VOLTAGE) | upper.rlike(P.CURRENT), "value")
        .when(text.rlike(P.CABLE), "cable")
        .when(text.rlike(P.DRAWING_REF), "reference")
        .when(text.rlike(P.TERMINAL), "terminal")
        .otherwise("text")
    )




def cell_category(text: Column, header: Column) -> Column:
    """Of a sheet cell: by its text, else by the words of its column's header; null header: text."""
    upper = F.upper(F.coalesce(header, F.lit("")))
    return (
        F.when(text.rlike(P.CELL_COMPONENT), "component")
        .when(text.rlike(P.CELL_VALUE), "value")
        .when(text.rlike(P.CELL_CABLE), "cable")
        .when(upper.rlike("DRAWING|DWG|NUMBER"), "reference")
        .when(upper.rlike("DESCRIPTION|NAME|TITLE|MATERIAL"), "description")
        .when(upper.rlike("QTY|QUANTITY|COUNT"), "quantity")
        .when(upper.rlike("CATALOG|PART"), "reference")
        .otherwise("text")
    )


def _hit(prio: int, p: P.Pattern):
    def make(x: Column, i: Column) -> Column:
        return F.struct(F.lit(prio).alias("prio"), i.alias("at"), _named(p, F.trim(x)).alias("component_id"), F.lit(p.kind).alias("component_type"))

    return make


def found_components(text: Column, source: str = "p") -> Column:
    """Array of (prio, at, component_id, component_type) of every catalogue hit in a text unit, in no order.

    One search gives the beginnings of words that a hit of some pattern begins with, and only
    the patterns of these are tried; the few that don't begin so are tried behind a plain
    test for a part that all their hits have.
    """
    own = [(prio, p) for prio, p in enumerate(P.CATALOGUE, 1) if source in p.sources]
    none = F.array().cast("array<struct<prio:int,at:int,component_id:string,component_type:string>>")
    heads, rest = {}, []
    for prio, p in own:
        hit, part = F.transform(all_of(text, p.regex), _hit(prio, p)), literal_part(p.regex)
        behind = lambda x, hit=hit: F.when(F.contains(text, F.lit(x)), hit).otherwise(none) if x else hit
        if headed(p.regex):
            heads.setdefault(part[:2], []).append(behind(part) if len(part) > 2 else hit)
        else:
            rest.append(behind(part if len(part) > 1 else inner_part(p.regex)))
    first = sorted({h[0] for h in heads})
    some = all_of(text, rf"(?=[{''.join(first)}])\b((?:{'|'.join(f + '[' + ''.join(sorted(h[1] for h in heads if h[0] == f)) + ']' for f in first)}))")

    def tried(head: Column) -> Column:
        cases = [(head == h, F.flatten(F.array(*hits)) if len(hits) > 1 else hits[0]) for h, hits in sorted(heads.items())]
        return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])).otherwise(none)

    return F.coalesce(F.flatten(F.concat(F.transform(F.array_distinct(some), tried), F.array(*rest))), none)


def headed(regex: str) -> bool:
    """Whether every hit of a pattern begins at the beginning of a word with the same two letters or digits."""
    return regex.startswith(r"\b") and re.match("[A-Z0-9]{2}", literal_part(regex)) is not None


def inner_part(regex: str) -> str:
    """The longest run of characters that every hit of a pattern has, if one can be read off its text; else empty."""
    body, before = regex, ""
    while body != before:  # groups that aren't captured, from within
        before, body = body, re.sub(r"\(\?:[^()]*\)(?:[?*+]|\{[^}]*\})?", " ", body)
    if re.search(r"\)[?*{]|\(\?", body):
        return ""
    body = re.sub(r"\[[^\]]*\]|\\.", " ", body)
    body = re.sub(r".(?:[?*]|\{[^}]*\})", " ", body)
    return "" if "|" in body else max(re.findall("[A-Z0-9-]+", body), key=len, default="")


def literal_part(regex: str) -> str:
    """Characters that every hit of a pattern begins with, if they can be read off its text; else empty."""
    body = re.sub(r"^(?:\\b|\(\?:|\()*", "", regex)
    plain = re.match(r"[A-Z0-9-]*", body)[0]
    rest = body[len(plain) :]
    # a character that may be left out, or one branch of several, isn't in every hit
    if re.match(r"[?*{]", rest):
        plain = plain[:-1]
    depth = 0
    for ch in re.sub(r"\[[^\]]*\]|\\.", "", body):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth <= 0:
            return ""
    return "" if regex.startswith(r"\b((?:") or "(?i)" in regex else plain


def extract_components(units: DataFrame, source: str = "p", text_col: str = "text", order_col: str = "page") -> DataFrame:
    """drawing_id, component_id, component_type, first_seen: one row for each id of a drawing.

    ``units`` has one text for each drawing_id and order (page, row).  The first hit decides
    the type: earlier units first, then the catalogue's order, then the place in the text.
    One pass over the text and one grouping, whose order is one number: unit, pattern and
    place, so that Spark can add it up in its hash table.  The pattern says the type.
    """
    hits = units.select("drawing_id", F.col(order_col).cast("long").alias("unit"), F.explode(found_components(F.col(text_col), source)).alias("h"))
    order = F.shiftleft(F.shiftleft("unit", 8) + F.col("h.prio"), 20) + F.least("h.at", F.lit((1 << 20) - 1))
    first = hits.groupBy("drawing_id", F.col("h.component_id").alias("component_id")).agg(F.min(order).alias("o"))
    kinds = F.array(*[F.lit(p.kind) for p in P.CATALOGUE])
    prio = F.shiftright("o", 20).bitwiseAND(F.lit(255)).cast("int")
    seen = F.struct(F.shiftright("o", 28).alias("unit"), prio.alias("prio"), F.col("o").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("at"))
    return first.select("drawing_id", "component_id", F.element_at(kinds, prio).alias("component_type"), seen.alias("first_seen"))


def in_table(components: DataFrame, table_rows: DataFrame) -> DataFrame:
    """X11: ``components`` with in_table: whether a row of a table of the drawing names the component.

    table_rows: drawing_id, page, table_no, row_no, row_text.  Ids in tables that are no
    components of the drawing make none.
    """
    named = extract_components(table_rows, text_col="row_text").select("drawing_id", "component_id", F.lit(True).alias("in_table"))
    return components.drop("in_table").join(named, ["drawing_id", "component_id"], "left").fillna(False, ["in_table"])


def drop_noise(components: DataFrame) -> DataFrame:
    """Without ids that are blank, only digits, or shorter than two characters."""
    return components.filter((F.length(F.trim("component_id")) >= 2) & ~F.col("component_id").rlike(r"^\d+$"))


def electrical_values(text: Column, *only: str) -> Column:
    """Array of (at, parameter, value, unit, numeric_value): voltages, currents, impedances, powers, ratios, in that order.

    Voltages are in kV; powers and ratios have no number.  ``only``: the parameters that are looked for; all without.
    """
    none = F.lit(None).cast("double")
    kinds = {
        "voltage_rating": lambda: voltages(text),
        "current_rating": lambda: _valued(2, "current_rating", P.CURRENT, text, lambda w, a, u: F.concat(a, u), lambda a, u: u, lambda a, u: a.cast("double")),
        "impedance": lambda: _valued(2, "impedance", P.IMPEDANCE, text, lambda w, a, u: w, lambda a, u: u, lambda a, u: a.cast("double"), parts=("%", "hm", "hM", "Hm", "HM", "Ω")),
        "power_rating": lambda: _valued(2, "power_rating", P.POWER, text, lambda w, a, u: F.concat(a, u), lambda a, u: u, lambda a, u: none, parts=("VA",)),
        "ratio": lambda: _valued(1, "ratio", P.RATIO, text, lambda w, a: a, lambda a: F.lit(""), lambda a: none, parts=(":",)),
    }
    return F.concat(*(make() for name, make in kinds.items() if not only or name in only))


def voltages(text: Column) -> Column:
    """The voltages among ``electrical_values``."""
    return _valued(3, "voltage_rating", P.VOLTAGE, text, lambda w, a, u, k: F.rtrim(F.concat(a, u, F.lit(" "), k)), lambda a, u, k: u, lambda a, u, k: F.when(F.upper(u) == "KV", a.cast("double")).otherwise(a.cast("double") / 1000))


def _valued(n: int, parameter: str, regex: str, text: Column, value, unit, number, parts: tuple[str, ...] = ()) -> Column:
    """Values by one search of the text; a hit's ``n`` groups are read off the hit, as no pattern looks beyond it but for a word's end.

    ``parts``: every hit has one of them, so texts without aren't searched.
    """

    def made(w: Column) -> Column:
        g = [F.regexp_extract(w, regex, i) for i in range(1, n + 1)]
        return F.struct(F.lit(parameter).alias("parameter"), value(w, *g).alias("value"), unit(*g).alias("unit"), number(*g).alias("numeric_value"))

    found = all_of(text, regex, 0)
    if parts:
        found = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in parts]), found).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.transform(found, made)


def cable_specs(text: Column) -> Column:
    """Distinct cable specifications, in the order of the kinds and of the text."""
    named = F.transform(all_of(text, P.NAMED_CABLE), lambda x: F.upper(x))
    return F.array_distinct(F.concat(all_of(text, P.CABLE), named, all_of(text, P.CABLE_LABEL), all_of(text, P.PAIRS)))


def terminal_pairs(text: Column) -> Column:
    """Array of (block, terminal) of TBn-m and TSn-m; strips have the key TS-TSn."""
    def pairs(regex: str, before: str):
        return F.transform(all_of(text, regex, 0), lambda w: F.struct(F.concat(F.lit(before), F.regexp_extract(w, regex, 1)).alias("block"), F.regexp_extract(w, regex, 2).alias("terminal")))

    return F.array_distinct(F.concat(pairs(P.BLOCK_TERMINAL, "TB"), pairs(P.STRIP_TERMINAL, "TS-TS")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def terminal_blocks(text: Column) -> Column:
    """Map of block to its terminals, in the order of the text."""
    of = lambda pairs, b: F.transform(F.filter(pairs, lambda p: p["block"] == b), lambda p: p["terminal"])
    blocks = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: p["block"]))
    return let(terminal_pairs(text), lambda pairs: F.map_from_entries(F.transform(blocks(pairs), lambda b: F.struct(b.alias("key"), of(pairs, b).alias("value")))))


def cross_references(text: Column, own_id: Column, sheet: bool = False) -> Column:
    """Sorted references to drawings, without the own one; sheets also take the long form and keep their own."""
    refs = all_of(text, P.DRAWING_REF)
    if sheet:
        return F.array_sort(F.array_distinct(F.concat(refs, all_of(text, P.SHEET_REF))))
    return F.array_sort(F.array_remove(F.array_distinct(refs), F.replace(own_id, F.lit("NRE-"), F.lit(""))))


def title_fields(text: Column) -> Column:
    """project, drawn_by and designed_by: what follows the words, the last time they come; empty where they don't."""
    rest = lambda words: F.coalesce(F.try_element_at(F.filter(F.transform(all_of(text, rf"(?i){words}[: \t]*([^\n]*)"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(-1)), F.lit(""))
    return F.struct(rest("PROJECT").alias("project"), rest("DRAWN BY").alias("drawn_by"), rest("DESIGNED BY").alias("designed_by"))


def notes(text: Column) -> Column:
    """Numbered notes above 10 characters, with their indented lines, then lines above 5 of the first NOTES section; each once."""
    numbered = F.filter(F.transform(all_of(text, r"(\d+\.\s+[^\n]+(?:\n[ \t]+[^\n]+)*)"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    section = F.regexp_extract(text, r"(?is)NOTES?\s*:\s*\n(.*?)(?:\n\s*\n|\z)", 1)
    lines = F.filter(F.transform(F.split(section, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    return F.array_distinct(F.concat(numbered, lines))


def voltage_levels(text: Column) -> Column:
    """Distinct kV levels and AC / DC supplies, sorted as strings."""
    kv = F.transform(all_of(text, r"(\d+\.?\d*)\s*(?:kV|KV)"), lambda x: F.concat(x, F.lit("kV")))
    v, k = all_of(text, r"(\d+)\s*V\s*(AC|DC)", 1), all_of(text, r"(\d+)\s*V\s*(AC|DC)", 2)
    return F.array_sort(F.array_distinct(F.concat(kv, F.transform(v, lambda x, i: F.concat(x, F.lit("V "), F.get(k, i))))))


_LATE = ("DPAC", "DFR", "FPP")  # patterns whose ids are put into a normal form are tried last


def _named(p: P.Pattern, hit: Column) -> Column:
    before, after = p.name.split("{}")
    return F.concat(F.lit(before), hit, F.lit(after)) if before or after else hit


def id_from_name(name: Column) -> Column:
    """The first component id in a block's name; empty if there is none."""
    own = [p for p in P.CATALOGUE if p.in_label]
    ordered = [p for p in own if not p.name.startswith(_LATE)] + [p for p in own if p.name.startswith(_LATE)]
    out = F.lit("")
    for p in reversed(ordered):
        out = F.when(name.rlike(p.regex), _named(p, F.regexp_extract(name, p.regex, 1))).otherwise(out)
    return out


def type_from_id(name: Column) -> Column:
    """Component type by the first pattern that matches at the beginning of an id."""
    own = [p for p in P.CATALOGUE if p.in_label or p.kind == "TB"]
    # one kind of pattern after the other: neighbours with the same type are one test
    tests: list[tuple[str, list[str]]] = []
    for p in own:
        if tests and tests[-1][0] == p.kind:
            tests[-1][1].append(p.regex)
        else:
            tests.append((p.kind, [p.regex]))
    out = F.lit("UNKNOWN")
    for kind, regexes in reversed(tests):
        out = F.when(name.rlike(f"^(?:{_any(regexes)})"), kind).otherwise(out)
    return out


def describe(kind: Column, name: Column) -> Column:
    """A sentence for a component."""
    out = F.concat(kind, F.lit(" "), name)
    for code, words in P.DESCRIPTIONS.items():
        out = F.when(kind == code, F.concat(F.lit(f"{words} "), name)).otherwise(out)
    return out
