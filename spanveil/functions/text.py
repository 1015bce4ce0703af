"""Text primitives as column expressions. Offsets are code points from 0, half-open; byte offsets are derived."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the ends of a span never keep.
TRIMMED = " \t\r\n .,;:!?\"'«»()[]{}<>№#-–—/\\"
# Latin letters and the Cyrillic ones they are taken for; the wider map is for document series.
ALIKE_LATIN, ALIKE_CYRILLIC = "aeopcyxAEOPCYX", "аеорсухАЕОРСУХ"
SERIES_LATIN, SERIES_CYRILLIC = "abcehkmoptxy", "авсенкмортху"
# Spelled-out numbers by value.
NUMBER_WORDS = {
    "один": 1, "первое": 1, "два": 2, "две": 2, "второе": 2, "три": 3, "третье": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9, "десять": 10,
    "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15, "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19,
    "двадцать": 20, "тридцать": 30, "сорок": 40, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90, "сто": 100, "двести": 200,
    "триста": 300, "четыреста": 400, "пятьсот": 500, "шестьсот": 600, "семьсот": 700, "восемьсот": 800, "девятьсот": 900,
}
STEM_ENDINGS = ("иями", "ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими", "ая", "яя", "ой", "ей", "ую", "юю", "ый", "ий", "ое", "ее", "ые", "ие", "ых", "их", "ым", "им", "ом", "ем", "ам", "ям", "ах", "ях", "ов", "ев", "а", "я", "о", "е", "у", "ю", "ы", "и", "ь")


def quoted(words: Iterable[str]) -> str:
    """An alternation for Java regular expressions, longest word first."""
    return "|".join(f"\\Q{w}\\E" for w in sorted(words, key=lambda w: (-len(w), w)))


def char_class(c: Column) -> Column:
    """space, digit, cyrillic, latin, sign or other, of one character."""
    return (
        F.when(c.rlike(r"^[\s   ]"), "space").when(c.rlike("^[0-9]"), "digit").when(c.rlike(r"^\p{IsCyrillic}"), "cyrillic")
        .when(c.rlike(r"^\p{IsLatin}"), "latin").when(c.rlike(r"^[\p{P}\p{S}]"), "sign").otherwise("other")
    )


TOKEN = r"[0-9]+|\p{IsCyrillic}+|\p{IsLatin}+|[\p{P}\p{S}]+|\s+|[^0-9\p{IsCyrillic}\p{IsLatin}\p{P}\p{S}\s]+"


def tokens(text: Column) -> Column:
    """Maximal runs of one character class."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lower_same_width(text: Column) -> Column:
    """Lower case with every character kept at its width in bytes, so offsets hold for both forms."""
    low = F.lower(text)
    careful = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(F.lower(c)) == F.octet_length(c), F.lower(c)).otherwise(c)), "")
    return F.when((F.octet_length(low) == F.octet_length(text)) & (F.length(low) == F.length(text)), low).otherwise(careful)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with both ends clamped."""
    a = F.greatest(start, F.lit(0))
    return F.substring(text, a + 1, F.greatest(end - a, F.lit(0)))


def byte_offset(text: Column, chars: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), chars)).cast("int")


def window(low: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The span with so many code points around it."""
    return cut(low, start - before, end + after)


def longest_anchor(win: Column, anchors: Iterable[str]) -> Column:
    """The longest anchor contained in a window, or NULL; of equal lengths the first by letters."""
    words = F.array(*[F.lit(a) for a in sorted(anchors, key=lambda a: (-len(a), a))])
    return F.get(F.filter(words, lambda a: F.contains(win, a)), F.lit(0))


def contains_any(win: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is in the window: plain byte searches, far cheaper than one regular expression."""
    kept = [w for w in words]
    kept = [w for w in dict.fromkeys(kept) if not any(o in w and o != w for o in kept)]
    # One folded literal instead of a long disjunction: the plan stays small, and small plans are optimised fast.
    return F.exists(F.array(*[F.lit(w) for w in kept]), lambda w: F.contains(win, w)) if kept else F.lit(False)


def anchor_before(low: Column, start: Column, anchors: Iterable[str], reach: int) -> Column:
    """Whether an anchor stands to the left with no digit between it and the value; spaces inside it do not count."""
    left = F.regexp_extract(cut(low, start - reach, start), "([^0-9]*)$", 1)
    return let(left, lambda x: contains_any(x, anchors) | contains_any(F.translate(x, " \t\u00a0", ""), [a.replace(" ", "") for a in anchors]))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda p: F.trim(p) != "")


def sentences(text: Column) -> Column:
    """Sentence texts: an end mark followed by a blank, a line break or the end closes one."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])(?=\s)|\n"), lambda s: F.regexp_replace(s, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")), lambda s: s != "")


def trimmed(value: Column) -> Column:
    """The value without blanks and punctuation at its ends; plus, at and percent signs stay."""
    return F.trim(value, F.lit(TRIMMED))


def trim_ends(text: Column, start: Column, end: Column) -> Column:
    """(start, end) moved inwards past trimmed characters."""
    value = cut(text, start, end)
    a = start + F.length(value) - F.length(F.ltrim(value, F.lit(TRIMMED)))
    return F.struct(a.alias("start"), F.greatest(a, end - (F.length(value) - F.length(F.rtrim(value, F.lit(TRIMMED))))).alias("end"))


def fold_alike(text: Column) -> Column:
    return F.translate(text, ALIKE_LATIN, ALIKE_CYRILLIC)


def fold_series(text: Column) -> Column:
    return F.translate(text, SERIES_LATIN + SERIES_LATIN.upper(), SERIES_CYRILLIC + SERIES_CYRILLIC.upper())


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def plain(value: Column) -> Column:
    """Trimmed lower case with yo as ye and single blanks: the key under which values are compared."""
    return F.regexp_replace(F.translate(F.lower(F.trim(value)), "ё", "е"), r"\s+", " ")


def stem(word: Column) -> Column:
    """The word without its case ending; at least three letters stay."""
    return F.regexp_replace(F.translate(F.lower(word), "ё", "е"), f"(?<=^.{{3,40}})(?:{'|'.join(STEM_ENDINGS)})$", "")


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{IsCyrillic}\p{IsLatin}]+"), F.lit(0))


def has_life_years(text: Column) -> Column:
    return text.rlike(r"\(\s*[12][0-9]{3}(?![0-9])[^0-9]{1,8}[12][0-9]{3}(?![0-9])\s*\)")


def spelled_number(text: Column) -> Column:
    """The number that words spell, NULL without any; a thousand multiplies what stands before it."""
    words = F.filter(letter_words(F.lower(text)), lambda w: w.isin([*NUMBER_WORDS, "тысяча", "тысячи", "тысяч"]))
    value = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("part"))

    def step(acc, w):
        thousand = w.startswith("тысяч")
        return F.when(thousand, F.struct((acc["sum"] + 1000 * F.greatest(acc["part"], F.lit(1))).alias("sum"), F.lit(0).alias("part"))).otherwise(F.struct(acc["sum"].alias("sum"), (acc["part"] + F.coalesce(value[w], F.lit(0))).alias("part")))

    return F.when(F.size(words) > 0, F.aggregate(words, zero, step, lambda a: a["sum"] + a["part"]))


def estimated_tokens(text: Column) -> Column:
    return F.octet_length(text) / 2.8


def core_millis(n_bytes: Column) -> Column:
    """Cost model: a floor, a rate for each KiB, and dearer long texts."""
    return (0.57 + 1.56 * n_bytes / 1024) * F.when(n_bytes > 2048, 1.8).otherwise(1.0)


def inflated(text: Column, size: Column) -> Column:
    """The text repeated up to so many characters."""
    return F.substring(F.repeat(text, F.ceil(size / F.greatest(F.length(text), F.lit(1))).cast("int")), F.lit(1), size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row: inside a lambda, a plain expression would be computed again
    for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Matches whose places are summed up in one go; the sums of the blocks are then carried over.
BLOCK = 64
MARK = "\x01"


def matches(text: Column, pattern: str) -> Column:
    """Each match of a pattern that takes at least one character, as (start, end, value), by place. Places come from
    the lengths of what stands between, so all of it stays inside the JVM. They are summed up in blocks, so that the cost
    stays in proportion to the number of matches."""
    span = "struct<start:int,end:int,value:string>"
    none = F.array().cast(f"array<{span}>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def block(pairs):
        return lambda i: F.aggregate(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def carried(acc, b):
        moved = F.transform(b["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(pieces):
        # Gap, value, gap, value, ..., gap.
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1), lambda i: F.struct(F.get(pieces, 2 * i).alias("gap"), F.get(pieces, 2 * i + 1).alias("value")))
        blocks = let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), block(p)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out"))
        return F.when(F.size(pieces) > 1, F.flatten(F.aggregate(blocks, zero, carried, lambda a: a["out"]))).otherwise(none)

    # One pass of the pattern: matches are put between marks, which no text holds after the first step.
    marked = F.regexp_replace(F.translate(text, MARK, "\x02"), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return let(F.split(marked, MARK, -1), placed)


# What may stand between the digit groups of one number.
SEPARATORS = r" \t\x{a0}\x{202f}\-\x{2013}\x{2014}\x{2011}./()\\№#"
#: Possessive, so that the loop neither recurses nor goes back: any number of groups is safe.
RUN = rf"(?<=[\p{{IsLatin}}\p{{IsCyrillic}}])[0-9]++|\+?[0-9]++(?:[{SEPARATORS}]{{1,3}}+[0-9]++)*+"


def digit_runs(text: Column) -> Column:
    """Numbers of a text: groups of digits glued by up to three separators. A group right behind a letter stands
    alone, without the letter. (start, end, value, digits, pattern, seps, plus)."""

    def run(m):
        value = m["value"]
        groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
        seps = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(F.regexp_replace(value, r"^\+", ""), "[0-9]", ""), ""))), "")
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), value.alias("value"), digits_only(value).alias("digits"),
            F.array_join(F.transform(groups, lambda g: F.length(g).cast("string")), "-").alias("pattern"), seps.alias("seps"), value.startswith("+").alias("plus"),
        )

    return F.transform(matches(text, RUN), run)
