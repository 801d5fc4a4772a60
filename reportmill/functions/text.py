"""Text cleaning as Column expressions: sections, blocks and lines are judged within one projection, in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DEFAULT, Rules

#: White space of any script, as a character class that Java and RE2 read alike.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters, one by one.
BLANKS = "".join(chr(i) for i in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
HANGUL = "[가-힣]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def hangul(c: Column) -> Column:
    return F.when(~beyond_ascii(c), 0).otherwise(F.regexp_count(c, F.lit(HANGUL)))


def any_of(patterns: Iterable[str], flags: str = "") -> str:
    """A pattern for any of them. Where each alternative is anchored, so is the whole: it is tried at the beginning only."""
    patterns = tuple(patterns)
    outer = [re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", p) for p in patterns]  # without escapes, classes and groups
    anchor = "^" if all(a.startswith("^") for o in outer for a in o.split("|")) and not any(set("()[") & set(o) for o in outer) else ""
    return f"{flags}{anchor}(?:{'|'.join(f'(?:{p})' for p in patterns)})"


def contains_any(c: Column, phrases: Iterable[str], korean: Column | None = None) -> Column:
    """Whether c has one of the phrases; those beyond ASCII are looked for only in such texts, with the number of c's
    Korean letters given, those with any only where there are some."""
    plain, other, letters = F.lit(False), F.lit(False), F.lit(False)
    for p in phrases:
        if p.isascii():
            plain |= c.contains(p)
        elif korean is not None and re.search(HANGUL, p):
            letters |= c.contains(p)
        else:
            other |= c.contains(p)
    out = plain | (beyond_ascii(c) & other)
    return out if korean is None else out | ((korean > 0) & letters)


def once(c: Column, *steps) -> Column:
    """steps applied to c one after the other, each to the value of the one before: in a plain expression, what is used
    several times would be evaluated as often."""
    out = F.array(c)
    for step in steps:
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def cut_section(text: Column, markers: Iterable[str] = DEFAULT.cut_markers) -> Column:
    """The text before the earliest marker, without white space at its end.

    Only the first occurrence of each marker counts, and not if the text begins with it.
    """
    markers = tuple(markers)

    def found(some: Iterable[str]) -> Column:
        return F.array(F.lit(0), *(F.when(text.contains(m), F.locate(m, text)) for m in some))

    plain, other = found(m for m in markers if m.isascii()), found(m for m in markers if not m.isascii())
    places = F.filter(F.concat(plain, F.when(beyond_ascii(text), other).otherwise(F.array(F.lit(0)))), lambda i: i > 1)
    return rstrip(text.substr(F.lit(1), F.coalesce(F.array_min(places) - 1, F.length(text))))


def sidebar_block(block: Column, rules: Rules = DEFAULT) -> Column:
    def labels(lines: Column) -> Column:
        short = F.filter(lines, lambda x: (F.length(x) < 25) & hangul(x).between(2, 9))
        return (F.size(lines) >= 6) & (F.size(short) >= 0.75 * F.size(lines))

    lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
    return (
        contains_any(block, rules.sidebar_markers)
        | ((F.length(block) < 300) & contains_any(block, rules.sidebar_terms))
        | (beyond_ascii(block) & once(lines, labels))
    )


def numeric_share(line: Column, rules: Rules = DEFAULT) -> Column:
    numeric = any_of(rules.numeric, "(?U)")

    def share(tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: t.rlike(numeric))) / F.size(tokens)).otherwise(0.0)

    def tokens(x: Column) -> Column:
        single = ~beyond_ascii(x) & ~contains_any(x, [b for b in BLANKS if b.isascii() and b != " "])
        return F.filter(F.when(single, F.split(x, " ")).otherwise(F.split(x, f"{SPACE}+")), lambda t: t != "")

    return once(line, tokens, share)


def noise_line(line: Column, rules: Rules = DEFAULT) -> Column:
    """Whether a line goes. The first rule that applies decides; a blank line stays."""

    def judged(x: Column) -> Column:
        s, n, korean = x["s"], x["n"], x["korean"]
        return (
            F.when(n == 0, False)
            .when(contains_any(s, rules.disclaimers, korean), True)
            .when(s.rlike(any_of(rules.captions, "(?iuU)")), True)
            .when(s.isin(*rules.labels), True)
            .when((n < 35) & (korean < 14) & s.rlike(any_of(rules.row_labels, "(?U)")), True)
            .when(korean >= 13, False)
            .when((n < 20) & (korean <= 6), True)
            .otherwise(numeric_share(s, rules) >= 0.5)
        )

    return once(line, strip, lambda s: F.struct(s.alias("s"), F.length(s).alias("n"), hangul(s).alias("korean")), judged)


def clean_block(block: Column, rules: Rules = DEFAULT) -> Column:
    return strip(F.array_join(F.filter(F.split(block, "\n"), lambda x: ~noise_line(x, rules)), "\n"))


def clean_document(text: Column, rules: Rules = DEFAULT, separator: str = "\n\n") -> Column:
    """The text up to its closing section, without sidebar blocks, noise lines and blocks that they leave empty."""
    blocks = F.filter(F.split(cut_section(text, rules.cut_markers), separator), lambda b: ~sidebar_block(b, rules))
    return F.array_join(F.filter(F.transform(blocks, lambda b: clean_block(b, rules)), lambda b: b != ""), separator)


def cleaning_error(text: Column, cleaned: Column) -> Column:
    return F.when(F.coalesce(strip(text), F.lit("")) == "", "no text").when(strip(cleaned) == "", "nothing left after cleaning")


def sanitize(c: Column) -> Column:
    """Without the nine characters that Windows forbids in file names, and without white space around."""
    return strip(F.regexp_replace(c, r'[\\/:*?"<>|]', ""))


def shorten(c: Column, size: int = 50) -> Column:
    return F.when(F.length(c) > size, F.concat(c.substr(1, size), F.lit("..."))).otherwise(c)


def short_year_date(c: Column) -> Column:
    """A date from yy.M.d; years from 69 on are of the twentieth century; null where it is no date."""
    ok = F.when(c.rlike(r"^\d{2}\.\d{1,2}\.\d{1,2}$"), c)
    century = F.when(F.substring(ok, 1, 2).cast("int") >= 69, "19").otherwise("20")
    return F.try_to_date(F.concat(century, ok), "yyyy.M.d")


def fill(template: str, **values: Column) -> Column:
    """A prompt with {name} replaced by the values."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def without_fences(c: Column) -> Column:
    return strip(F.regexp_replace(c, "```(sql)?", ""))


def joined_parts(parts: Column) -> Column:
    """The texts of multi-part content, end to end."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
