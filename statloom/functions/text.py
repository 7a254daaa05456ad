"""Text functions as Spark columns."""

from __future__ import annotations

import json
import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(letter: str) -> str:
    """A letter's compatibility decomposition without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(x))


#: Letters of the first plane that fold to one other, and those that they fold to, in the same order.
_FOLDS = [(chr(k), b) for k in range(0x80, 0x10000) if not 0xD800 <= k < 0xE000 for b in [_bare(chr(k))] if len(b) == 1 and b != chr(k)]
ACCENTED, PLAIN = ("".join(x) for x in zip(*_FOLDS, strict=True))
STOP_WORDS = ("the", "and", "for", "are", "was", "with", "that", "this", "from", "not", "but", "have", "has", "les", "des", "une", "dans", "pour", "que", "qui", "par", "sur", "aux", "est")
#: Named references with what they stand for, and numbers that stand for another character or for none.
_NAMED = json.dumps(html5)
_OTHER = json.dumps({"0": "\ufffd"} | {str(k): bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)})
CAUSAL = r"(?i)\b(because of|due to|caused by|causes|leads to|results in|the effect of|the impact of|thanks to)\b"
INJECTION = r"(?i)(ignore (all )?(the )?(previous|above) (instructions|rules)|disregard (the )?(previous|above)|system prompt|you are now|act as (a|an) )"


def fold(c: Column) -> Column:
    """Lower case without accents: letters that decompose to one base letter become it, and combining marks go."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{Mn}+", "")


def decoded(c: Column) -> Column:
    """The text with its character references replaced, as browsers do: numeric ones, and named ones with or without a
    semicolon, the longest name first. One pass from left to right, so what a reference yields isn't decoded again."""
    named, other = F.from_json(F.lit(_NAMED), "map<string,string>"), F.from_json(F.lit(_OTHER), "map<string,string>")
    pieces = F.regexp_extract_all(c, F.lit(r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&)"), F.lit(1))

    def numeric(piece: Column) -> Column:
        digits, base_16 = F.regexp_extract(piece, "([0-9a-fA-F]+);?$", 1), F.substring(F.lower(piece), 3, 1) == "x"
        code = F.when(base_16, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("decimal(20,0)")
        low = code % 65_536
        none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.coalesce(other[code.cast("string")], F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(none, "").otherwise(char))

    def by_name(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        known = F.filter(F.sequence(F.length(name), F.lit(2), F.lit(-1)), lambda n: named[F.substr(name, F.lit(1), n)].isNotNull())
        return F.when(F.size(known) > 0, F.concat(named[F.substr(name, F.lit(1), known[0])], F.substr(name, known[0] + 1))).otherwise(piece)

    one = lambda p: F.when(~p.startswith("&") | (F.length(p) < 3), p).when(F.substring(p, 2, 1) == "#", numeric(p)).otherwise(by_name(p))
    return F.when(F.instr(c, "&") == 0, c).otherwise(F.array_join(F.transform(pieces, one), ""))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def strip_tags(c: Column) -> Column:
    """The text between tags, references decoded, white space as single spaces."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(c, "<[^>]+>", " ")), r"[ \t\n\r\u00a0]+", " "))


def sentences(c: Column, shortest: int = 20) -> Column:
    """Sentences longer than `shortest` characters, without spaces at their ends."""
    trimmed = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s))  # F.trim itself would take each one's place as what to trim
    return F.filter(trimmed, lambda s: F.length(s) > shortest)


def tokens(c: Column) -> Column:
    """Distinct folded words of more than two letters that are no stop words."""
    words = F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def shorten(c: Column, n: int = 260) -> Column:
    """At most n characters, cut at a space, with an ellipsis where something went."""
    cut = F.regexp_extract(F.substring(c, 1, n), r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(c, 1, n)), F.lit("…")))


#: A written number, once its parts stand apart, with the letters, digits and marks that follow it: groups of three digits
#: after spaces, or a run that begins with a digit. None begins within a run.
_RUN = r"(?=[-−0-9])(?<![\p{L}\p{N}_.,])(?:[-−]?[0-9]{1,3}(?:\p{Zs}[0-9]{3}\b)+[\p{L}\p{N}_.,]*|[-−]?[0-9][\p{L}\p{N}_.,]*)"
_NUMBER = r"^[-−]?[0-9]+([.,][0-9]+)?$"


def number_texts(c: Column) -> Column:
    """The numbers of a text as they are written, without spaces.

    A hyphen after a letter, digit or mark is no sign, and a mark before a letter ends a number; so both become bars.
    Runs of letters, digits and marks are numbers if they are digits with at most one decimal mark.
    """
    apart = F.regexp_replace(c, r"[-−](?<=[\p{L}\p{N}_.,][-−])", "|")
    apart = F.regexp_replace(apart, r"[.,](?<=[0-9].)(?=\p{L})", "|")
    runs = F.regexp_extract_all(apart, F.lit(_RUN), F.lit(0))
    bare = F.transform(runs, lambda x: F.regexp_replace(F.regexp_replace(x, r"\p{Zs}", ""), "[.,]+$", ""))
    return F.filter(bare, lambda x: x.rlike(_NUMBER))


def number_value(x: Column) -> Column:
    """A number of number_texts() as a double: a decimal comma or point, a sign."""
    return F.translate(x, ",−", ".-").try_cast("double")


def number_decimals(x: Column) -> Column:
    """How many decimals a number of number_texts() is written with."""
    return F.length(F.regexp_extract(x, "[.,]([0-9]+)$", 1))


def numbers(c: Column) -> Column:
    """The numbers of a text as doubles: digits with spaces between thousands, a decimal comma or point, a sign."""
    return F.transform(number_texts(c), lambda x: number_value(x))


def decimals(c: Column) -> Column:
    """How many decimals each number of numbers() is written with."""
    return F.transform(number_texts(c), lambda x: number_decimals(x))


def clean_markdown(c: Column) -> Column:
    """Paragraphs without headings, whose whole lines go, and without marks of lists and of emphasis."""
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: ~x.startswith("#"))
    bare = F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[-*•]\s+", ""), r"\*\*", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(bare, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def citations(c: Column) -> Column:
    """name and year of citations such as (Name, 2020) and Name (2020)."""
    inside = F.regexp_extract_all(c, F.lit(r"\(([^()]*\d{4}[a-z]?)\)"), F.lit(1))
    entries = F.flatten(F.transform(inside, lambda x: F.split(x, ";")))
    name = r"^\s*(\p{Lu}[\p{L}'-]+).*?(\d{4})[a-z]?\s*$"
    listed = F.transform(entries, lambda x: F.struct(F.regexp_extract(x, name, 1).alias("name"), F.regexp_extract(x, name, 2).alias("year")))
    told = r"(\p{Lu}[\p{L}'-]+)(?: et al\.?| and \p{Lu}[\p{L}'-]+)? \((\d{4})[a-z]?\)"
    whole = F.regexp_extract_all(c, F.lit(told), F.lit(0))
    narrative = F.transform(whole, lambda x: F.struct(F.regexp_extract(x, told, 1).alias("name"), F.regexp_extract(x, told, 2).alias("year")))
    return F.array_distinct(F.filter(F.concat(listed, narrative), lambda s: s["name"] != ""))


def is_causal(c: Column) -> Column:
    return c.rlike(CAUSAL)


def is_injection(c: Column) -> Column:
    return c.rlike(INJECTION)


def initials(given: Column) -> Column:
    parts = F.filter(F.split(given, r"[\s-]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")


def short_citation(surnames: Column, year: Column) -> Column:
    """One name, two joined by and, or the first with et al., and the year."""
    n = F.size(surnames)
    names = F.when(n == 1, surnames[0]).when(n == 2, F.concat(surnames[0], F.lit(" and "), surnames[1])).when(n > 2, F.concat(surnames[0], F.lit(" et al."))).otherwise("Anonymous")
    return F.concat(names, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def inverted_text(index: Column) -> Column:
    """The text of a map from words to their positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(places), lambda s: s["word"]), " ")


def within_budget(parts: Column, longest: int) -> Column:
    """Whole sentences, in order, as long as their text stays within `longest` characters."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(state: Column, s: Column) -> Column:
        joined = F.when(state["text"] == "", s).otherwise(F.concat(state["text"], F.lit(" "), s))
        fits = state["open"] & (F.length(joined) <= longest)
        return F.struct(F.when(fits, joined).otherwise(state["text"]).alias("text"), fits.alias("open"))

    return F.aggregate(parts, start, add)["text"]


#: Openers and closers of what a cut leaves whole, and what marks brackets as technical.
OPENERS, CLOSERS = "(«", ")»"
TECHNICAL = r"\b(?:CI|IC|OR|HR)\b|\bp\s?[<=≤]|χ²|chi-square|khi-deux"


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def cut_at_comma(c: Column, limit: int = 170) -> Column:
    """The text, or, if it is longer than limit, its part before the last comma within limit that stands outside brackets
    and quotes and before a space, with a full stop; whole if that comma comes in the first half."""
    letters = _letters(F.substring(c, 1, limit + 1))
    places = F.sequence(F.lit(0), F.least(F.size(letters), F.lit(limit)) - 1)

    def step(state: Column, i: Column) -> Column:
        x = letters[i]
        depth = F.when(F.instr(F.lit(OPENERS), x) > 0, state["depth"] + 1).when(F.instr(F.lit(CLOSERS), x) > 0, F.greatest(F.lit(0), state["depth"] - 1)).otherwise(state["depth"])
        here = (x == ",") & (state["depth"] == 0) & (F.get(letters, i + 1) == " ")
        return F.struct(depth.alias("depth"), F.when(here, i).otherwise(state["cut"]).alias("cut"))

    cut = F.aggregate(places, F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("cut")), step)["cut"]
    return F.when((F.length(c) > limit) & (cut > limit // 2), F.concat(F.substr(c, F.lit(1), cut), F.lit("."))).otherwise(c)


def without_technical_brackets(c: Column, technical: str = TECHNICAL) -> Column:
    """The text without the outermost brackets that hold a technical mark, at whatever depth, and without the spaces that
    they leave. Brackets that don't close stay."""

    def step(state: Column, x: Column) -> Column:
        depth = F.when(x == "(", state["depth"] + 1).when((x == ")") & (state["depth"] > 0), state["depth"] - 1).otherwise(state["depth"])
        held = F.concat(state["held"], x)
        inside = (state["depth"] > 0) | (x == "(")
        closed = inside & (depth == 0)
        out = F.when(~inside, F.concat(state["out"], x)).when(closed & ~F.regexp_like(held, F.lit(technical)), F.concat(state["out"], held)).otherwise(state["out"])
        return F.struct(depth.alias("depth"), F.when(inside & ~closed, held).otherwise(F.lit("")).alias("held"), out.alias("out"))

    end = F.aggregate(_letters(c), F.struct(F.lit(0).alias("depth"), F.lit("").alias("held"), F.lit("").alias("out")), step)
    plain = F.regexp_replace(F.concat(end["out"], end["held"]), r"\s{2,}", " ")
    return F.when(F.instr(c, "(") == 0, c).otherwise(F.trim(F.regexp_replace(plain, r"\s+([.,;:])", "$1")))
