"""One consistent form for texts that look the same but consist of other characters.

Method. A quick check on each text (character properties only, as one regular expression that the JVM evaluates)
finds texts that need no work; in the rest, only the unstable segments, taken with the starter before a combining
mark or the whole word around a foreign letter, are normalised, and the results are spliced into the unchanged text.

What is brought together: full-width and half-width forms, ligatures and letters in mathematical or positional forms,
composed and combining accents, invisible characters, fixed blanks, and letters of Cyrillic, Greek and Latin that are
drawn alike. What stays apart, being visible: letter
case, wording, punctuation, yo and ye, and the number or kind of ordinary blanks, tabs and line breaks.

Defined results: NULL gives NULL, an empty text or one made of invisible characters only gives an empty text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.runtime import attach, digest, durable, spread

# Letters drawn alike. Each row is Latin letter, then the Cyrillic, Greek and further Latin letters of the
# same shape.
ALIKE = """
A А Α
B В Β
C С
E Е Ε
H Н Η
I І Ι Ӏ
J Ј
K К Κ
M М Μ
N Ν
O О Ο
P Р Ρ
S Ѕ
T Т Τ
X Х Χ
Y У Υ
Z Ζ
a а α
c с
d ԁ
e е
h һ
i і ι
j ј ϳ
l ӏ
o о ο
p р ρ
q ԛ
s ѕ
u υ
v ν
w ԝ
x х
y у γ
"""
# Cyrillic letters and the Greek ones drawn alike, where no Latin letter is.
ALIKE_GREEK = "ГΓ ПΠ ФΦ кκ"

_TO_LATIN = {ord(o): ord(row.split()[0]) for row in ALIKE.strip().splitlines() for o in row.split()[1:]}
_TO_LATIN |= {ord(pair[1]): ord(pair[0]) for pair in ALIKE_GREEK.split()}
_TO_CYRILLIC = {ord(row.split()[0]): ord(o) for row in ALIKE.strip().splitlines() for o in row.split()[1:] if "CYRILLIC" in unicodedata.name(o) and ord(o) not in (0x4C0, 0x4CF)}
_ALIKE_LATIN = "".join(map(chr, sorted(set(_TO_LATIN.values()))))
#: Format characters that are drawn, so they are not invisible.
_DRAWN_FORMAT = set(range(0x600, 0x606)) | {0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


# Further Latin letters that are another one drawn otherwise.
SMALL_LATIN = {0x251: "a", 0x261: "g"}
#: Kinds of compatibility forms that are the same letters drawn together, in another style, or by position.
_SHAPED = ("<font", "<compat", "<initial", "<medial", "<final", "<isolated")


@lru_cache(1)
def tables() -> tuple[dict[int, object], str, str]:
    """By rule from the character database: the translation of single characters, and two character classes for
    regular expressions, of characters that always change and of those that may change with their neighbours."""
    out: dict[int, object] = {}
    marks = []
    # Second parts of canonical compositions: most are combining marks, some (vowel signs) are not.
    pairs = (unicodedata.decomposition(chr(cp)).split() for cp in range(0x80, 0x30000))
    second = {int(x[1], 16) for x in pairs if len(x) == 2 and x[0][0] != "<"}
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co"):
            continue
        kind = unicodedata.decomposition(ch).partition(">")[0]
        if cat == "Cf" and cp not in _DRAWN_FORMAT or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out[cp] = None
        elif cat == "Zs":
            out[cp] = " "
        elif kind in ("<wide", "<narrow", "<noBreak"):
            out[cp] = unicodedata.normalize("NFKC", ch)
        elif kind in _SHAPED and cat[0] in "LN" and cp not in (0x17F, 0xFB05) and all(c.isalnum() for c in unicodedata.normalize("NFKC", ch)):
            out[cp] = unicodedata.normalize("NFKC", ch)
        if unicodedata.combining(ch) or cp in second or unicodedata.normalize("NFC", ch) != ch and cp not in out or 0x1160 < cp < 0x1200:
            marks.append(cp)
    for cp in range(0xE0000, 0xE0200):
        out[cp] = None
    # Letters composed of one that changes: without its accent it would change, too.
    for cp in range(0x80, 0x30000):
        first = unicodedata.normalize("NFD", chr(cp))
        if cp not in out and len(first) > 1 and ord(first[0]) in out:
            out[cp] = unicodedata.normalize("NFC", first.translate(out))
    out |= SMALL_LATIN

    return out, _ranges(out), _ranges(marks)


def _ranges(cps: Iterable[int]) -> str:
    """Code points as the inside of a character class; none of them may be special there."""
    runs: list[list[int]] = []
    for cp in sorted(cps):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


_CYR = r"Ѐ-ԯ"
_GRE = r"Ͱ-Ͽ"
_LAT = r"A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
_WORD = re.compile(f"[{_CYR}{_GRE}{_LAT}̀-ͯ]+")


@lru_cache(1)
def compiled() -> tuple[dict[int, object], re.Pattern, re.Pattern]:
    """The translation of `tables` and its two classes as compiled expressions."""
    out, always, marks = tables()
    return out, re.compile(f"[{always}]+"), re.compile(f".?[{marks}]+", re.S)


_OWN_LAT = re.compile(f"[{_LAT}]")


def _own_scripts() -> tuple[re.Pattern, re.Pattern]:
    cyr = _ranges(c for c in range(0x400, 0x530) if c not in _TO_LATIN)
    lat = _ranges(c for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if chr(c) not in _ALIKE_LATIN and chr(c).isalpha())
    gre = _ranges(c for c in range(0x370, 0x400) if c not in _TO_LATIN)
    return re.compile(f"[{cyr}]"), re.compile(f"[{lat}{gre}]")


_ONLY_CYR, _ONLY_LAT = _own_scripts()
_GREEK = re.compile(f"[{_GRE}]")
_FOREIGN = re.compile(f"[{_CYR}{_GRE}]")


def canonical(text: str | None) -> str | None:
    """The consistent form of one text; equal for two texts exactly if they look the same.

    Words take the script of their own unmistakable letters; a word of look-alike letters alone takes that of the
    word before it (at the start, of the first decided word; Latin if there is none), so the result depends on the
    look alone and stays readable text of its language.
    """
    if text is None or text.isascii():
        return text
    out, always, marks = compiled()
    text = always.sub(lambda m: m[0].translate(out), text)
    if marks.search(text):
        # Boundary context: the starter before the marks goes with them.
        text = marks.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
    if not _FOREIGN.search(text):
        return text
    if _ONLY_CYR.search(text) and not _OWN_LAT.search(text) and not _GREEK.search(text) and not MARKED.search(text):
        return text  # one script throughout: stable
    return canonical_words(text)


MARKED = re.compile("[̀-ͯ]")


def canonical_words(text: str, same_length: bool = False) -> str:
    """The words of a text, each in one script. With `same_length`, words whose length would change stay."""
    if not _FOREIGN.search(text):
        return text
    parts: list[str] = []
    at, script, waiting = 0, None, []
    for m in _WORD.finditer(text):
        word = m[0]
        parts.append(text[at : m.start()])
        at = m.end()
        if _ONLY_CYR.search(word):
            own = "c"
        elif _ONLY_LAT.search(word):
            own = "l"
        else:
            own = script
        if own is None:
            waiting.append(len(parts))
            parts.append(word)
            continue
        if script is None:
            script = own
            for i in waiting:
                parts[i] = _cast(parts[i], own, same_length)
        script = own
        parts.append(_cast(word, own, same_length))
    for i in waiting if script is None else ():
        parts[i] = _cast(parts[i], "l", same_length)
    parts.append(text[at:])
    return "".join(parts)


def _cast(word: str, script: str, same_length: bool) -> str:
    """A word with its look-alike letters drawn from one script. Letters with an accent are taken apart first, as
    the accent does not change which script their base could be of."""
    plain = unicodedata.normalize("NFD", word)
    plain = plain.translate(_TO_LATIN)
    if script == "c":
        plain = plain.translate(_TO_CYRILLIC)
    plain = unicodedata.normalize("NFC", plain)
    return word if same_length and len(plain) != len(word) else plain


#: Characters that no rule of `tables` touches: ASCII, composed Latin, Cyrillic, drawn punctuation, signs, emoji. A text
#: of these alone can only be unstable by mixed scripts. The class is short, as Java tries its ranges one by one.
SAFE = "\x00-\x7f\xa1-\xac\xae-\xb4\xb6-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u01c3\u01cd-\u01f0\u01f4-\u024f\u0400-\u0482\u048a-\u052f\u2010\u2012-\u2027\u2030-\u205e\u20a0-\u20bf\u2116\u2122\U0001f300-\U0001faff"


def needs_work(text: Column) -> Column:
    """The quick check, inside the JVM: False promises that `canonical` returns the text unchanged."""
    cyr, foreign, lat = "[Ѐ-ԯ]", f"[{_GRE}]", f"[{_LAT}]"
    own = f"[{_ranges(c for c in range(0x400, 0x530) if c not in _TO_LATIN)}]"
    mixed = text.rlike(cyr) & (text.rlike(lat) | ~text.rlike(own))
    return text.rlike(f"[^{SAFE}]") | text.rlike(foreign) | mixed


@F.pandas_udf(T.StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore")


def consistent(text: Column) -> Column:
    """Column form of `canonical`; stable texts never leave the JVM (the Python side receives NULL for them)."""
    return F.coalesce(_canonical_udf(F.when(needs_work(text), text)), text)


def consistent_texts(df: DataFrame, text: str, into: str = "form") -> DataFrame:
    """`df` with the consistent form of a text column beside it. An existing column named `into` is replaced."""
    return df.withColumn(into, consistent(F.col(text)))


#: Pairs of one class are made in parts of so many distinct texts.
PART = 1000


def _variants(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """look_key, raw_key, first_id, n_rows of each distinct text that looks like another one, with n_variants, the number
    of distinct texts of its class."""
    texts = spread(df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("id"), F.col(text).alias("t")))
    shaped = texts.select("id", digest(F.col("t")).alias("raw_key"), digest(consistent(F.col("t"))).alias("look_key"))
    variants = durable(shaped.groupBy("look_key", "raw_key").agg(F.min("id").alias("first_id"), F.count("*").alias("n_rows")))
    several = variants.groupBy("look_key").agg(F.count("*").alias("n_variants"), F.min("first_id").alias("class_id")).where("n_variants > 1")
    # A class that holds a great part of all distinct texts is one key of many rows here.
    return durable(attach(variants, several, "look_key", "n_variants", keep_weight=True))


def look_alike_classes(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """row_id, class_id, n_variants: one row for each row whose text looks like another distinct text of `df`. class_id is
    the smallest row id of the class. This form is linear in the rows however large a class is. NULL texts have none."""
    variants = _variants(df, row_id, text)
    rows = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), digest(F.col(text)).alias("raw_key"))
    return attach(rows, variants.select("raw_key", "class_id", "n_variants", "n_rows"), "raw_key", "n_rows").select("row_id", "class_id", "n_variants")


def look_alike_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """left_id < right_id for rows whose texts look the same yet differ.

    Every row is linked with the first row of each other distinct text of its class, so no link between different
    texts is lost; two texts with many exact copies each are not expanded into all pairs of copies. The pairs of a class
    with many distinct texts are made in parts of PART texts, each its own key of the join. `look_alike_classes` says the
    same in linear size. NULL is no case; repeated rows (one id twice) give one pair. Empty table: no rows.
    """
    variants = _variants(df, row_id, text)
    rows = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("id"), digest(F.col(text)).alias("raw_key"))
    parts = F.ceil(F.col("n_variants") / F.lit(PART)).cast("int")
    members = attach(rows, variants.select("raw_key", "look_key", "n_variants", "n_rows"), "raw_key", "n_rows")
    members = members.withColumn("part", F.pmod(F.xxhash64("raw_key"), parts).cast("int"))
    others = variants.select("look_key", F.col("raw_key").alias("other_key"), F.col("first_id").alias("other_id"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = members.join(others, ["look_key", "part"]).where("raw_key <> other_key and id <> other_id")
    return pairs.select(F.least("id", "other_id").alias("left_id"), F.greatest("id", "other_id").alias("right_id")).distinct()


#: Known values are broadcast up to this many rows, each an id and two digests (under 100 bytes); beyond it, a shuffle.
BROADCAST_ROWS = 200_000


def known_value_matches(known: DataFrame, rows: DataFrame, known_id: str, row_id: str, value: str) -> DataFrame:
    """left_id (known) and right_id (row) for values that look the same yet differ. The known side is broadcast only
    while it has at most BROADCAST_ROWS rows; beyond, it is looked up by a join that splits off hot values."""

    def keyed(df, key, name, raw):
        values = spread(df.where(F.col(value).isNotNull()).select(F.col(key).alias(name), F.col(value).alias("t")))
        return values.select(name, digest(F.col("t")).alias(raw), digest(consistent(F.col("t"))).alias("look_key"))

    left, right = keyed(known, known_id, "left_id", "known_key"), keyed(rows, row_id, "right_id", "row_key")
    if left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = right.join(F.broadcast(left), "look_key")
    else:
        right = durable(right)
        lists = left.groupBy("look_key").agg(F.collect_list(F.struct("left_id", "known_key")).alias("known"))
        lists = durable(lists.join(right.groupBy("look_key").agg(F.count("*").alias("n_rows")), "look_key"))
        both = attach(right, lists, "look_key", "n_rows").select("right_id", "row_key", F.inline("known"))
    return both.where("known_key <> row_key").select("left_id", "right_id").distinct()
