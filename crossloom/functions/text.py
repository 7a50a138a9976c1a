"""Text column functions. All of them stay on the JVM side."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossloom import constants as C


# fixed values: the white space characters that are stripped and split at
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (plain ``trim`` only knows blanks)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalise(c: Column) -> Column:
    """Comparison form: stripped and lower-cased."""
    return F.lower(strip(c))


def alnum_tokens(c: Column) -> Column:
    """Lower-case ASCII letter/digit runs, repeated tokens kept."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def normalise_answer(c: Column) -> Column:
    """Lower case without punctuation and articles, single blanks between words."""
    # fixed values: the punctuation that separates words, and the articles that are dropped
    marks = string.punctuation + "‘’´`"
    blanked = F.translate(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), marks, " " * len(marks))
    no_articles = F.regexp_replace(blanked, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(no_articles, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """White-space separated words; a blank text has none."""
    return F.filter(F.split(c, f"[{WHITE_SPACE}]+"), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def contained_either_way(a: Column, b: Column) -> Column:
    """An empty text is contained in every text."""
    return F.contains(a, b) | F.contains(b, a)


def first_answer_line(c: Column) -> Column:
    """First line of a model answer without a leading ``Output:``."""
    line = strip(F.split_part(strip(c), F.lit("\n"), F.lit(1)))
    return F.regexp_replace(line, r"(?i)^Output:\s*", "")


def strip_special_tokens(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"</?s>", ""))


def after_marker(c: Column, marker: str = C.RESPONSE_MARKER) -> Column:
    """Text between the first marker and the next one; empty without a marker."""
    return strip(F.split_part(c, F.lit(marker), F.lit(2)))


def _stripped_values(a: Column) -> Column:
    return F.filter(F.transform(a, strip), lambda v: v.isNotNull() & (v != ""))


def _comma_values(inner: Column) -> Column:
    parts = F.filter(F.transform(F.split(inner, ","), strip), lambda v: v != "")
    unquoted = F.transform(parts, lambda v: F.regexp_replace(v, r'^"+|"+$', ""))
    return F.transform(unquoted, lambda v: F.regexp_replace(v, r"^'+|'+$", ""))


def loose_list(c: Column, strip_unquoted: bool = False) -> Column:
    """A JSON list, else the first bracketed JSON list in the text, else its comma separated values.

    ``strip_unquoted`` also strips the separated values once their quotes are off.
    """
    text = F.coalesce(c, F.lit(""))
    whole = F.when(F.startswith(strip(text), F.lit("[")) & F.endswith(strip(text), F.lit("]")),
                   F.from_json(text, "array<string>"))
    inner = F.regexp_extract(text, r"(?s)\[(.*?)\]", 1)
    bracketed = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>")
    found = F.regexp_like(text, F.lit(r"(?s)\[.*?\]"))
    separated = _comma_values(inner)
    return F.coalesce(
        _stripped_values(whole),
        F.when(found, F.coalesce(_stripped_values(bracketed), F.transform(separated, strip) if strip_unquoted else separated)),
        F.array().cast("array<string>"),
    )


def attribute_answer(c: Column) -> Column:
    """``struct(intro, attributes)`` from an answer to an attribute prompt."""
    text = F.coalesce(c, F.lit(""))
    # fixed values: the labels an answer may carry
    lists = [r"(?s)ATTRIBUTES:\s*(\[.*?\])", r"(?s)属性:\s*(\[.*?\])", r"(?s)(\[[\"'][^]]*[\"']\])"]
    intros = [r"(?s)INTRODUCTION:\s*(.*?)(?=ATTRIBUTES:|$)", r"(?s)介绍:\s*(.*?)(?=属性:|$)"]
    labelled = [F.transform(F.from_json(F.regexp_extract(text, p, 1), "array<string>"), strip) for p in lists]
    attributes = F.coalesce(*[F.when(F.size(a) > 0, a) for a in labelled], loose_list(text, strip_unquoted=True))
    intro = F.coalesce(*[F.when(F.regexp_like(text, F.lit(p)), strip(F.regexp_extract(text, p, 1))) for p in intros],
                       F.lit(""))
    return F.struct(intro.alias("intro"), attributes.alias("attributes"))


def fill(template: str, **columns: Column | str) -> Column:
    """Fill named places of a template; ``{{`` and ``}}`` stand for braces."""
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = columns[name]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)


def percent(c: Column) -> Column:
    """One digit after the point, with a percent sign."""
    return F.format_string("%.1f%%", c.cast("double") * 100)


def list_text(values: Column, top: int = 10) -> Column:
    """Texts joined by comma and blank; ``None`` for an empty list."""
    joined = F.concat_ws(", ", F.slice(values, 1, top))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, joined).otherwise("None")


def counted_text(values: Column, top: int = 10) -> Column:
    """``value(count)`` for an array of ``struct(value, n)``."""
    return list_text(F.transform(values, lambda v: F.concat(v["value"], F.lit("("), v["n"].cast("string"), F.lit(")"))), top)


def normalise_domain(c: Column) -> Column:
    """Known aliases to their label, everything else capitalised."""
    d = normalise(c)
    aliases = F.create_map(*[F.lit(v) for pair in C.DOMAIN_ALIASES.items() for v in pair])
    capitalised = F.concat(F.upper(F.substring(d, 1, 1)), F.substring(d, F.lit(2), F.length(d)))
    return F.coalesce(F.try_element_at(aliases, d), capitalised)


def domain_axis(c: Column, x_names=("x", "art", "entertainment"), y_names=("y", "office", "education")) -> Column:
    """X or Y for a domain alias; unknown names count as X."""
    d = normalise(F.coalesce(c, F.lit("")))
    return F.when(d.isin(*y_names), "Y").otherwise("X")


def domain_label(c: Column, fallback: str | None = None) -> Column:
    """Display label of a domain; with a fallback also for empty or missing names."""
    out = c
    for name, label in C.DOMAIN_LABELS.items():
        out = F.when(c == name, label).otherwise(out)
    if fallback is not None:
        out = F.when(c.isNull() | (c == ""), fallback).otherwise(out)
    return out


def history_events(c: Column) -> Column:
    """``array<struct(pos, domain, title)>`` from the history section of a prompt."""
    # fixed values: the marks that open and close the history section of a prompt
    opened = F.split_part(c, F.lit("Interaction History"), F.lit(2))
    body = F.regexp_replace(opened, r"(?s)^[^\n]*\n?", "")
    section = F.regexp_replace(body, r"(?s)(^|\n)(\s*=== |[^\n]*Preference Summary).*$", "")
    lines = F.filter(F.split(section, "\n"), lambda v: F.regexp_like(v, F.lit(r"^\s*\[\w+\]\s*.+")))
    return F.transform(
        lines,
        lambda v, i: F.struct(
            (i + 1).alias("pos"),
            F.regexp_extract(v, r"^\s*\[(\w+)\]\s*(.+)", 1).alias("domain"),
            strip(F.regexp_extract(v, r"^\s*\[(\w+)\]\s*(.+)", 2)).alias("title"),
        ),
    )
