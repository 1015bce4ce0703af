"""The number rules as DuckDB SQL, from the same word lists: the twin of `d_numbers`.

It is written as a set query (one row for each number, one CASE for the cascade), so it checks the readers by another
way of computing, not by the same code.
"""

from __future__ import annotations

from spanveil.functions import text as t
from spanveil.operators import numeric as n
from spanveil.operators import patterns as p
from spanveil.operators.scan import folded

_LETTERS = "A-Za-zÀ-ɏḀ-ỿЀ-ԯ"
_SEPARATORS = r" \t\x{a0}\x{202f}\-\x{2013}\x{2014}\x{2011}./()\\№#"
RUN = rf"[{_LETTERS}][0-9]+|\+?[0-9]+(?:[{_SEPARATORS}]{{1,3}}[0-9]+)*"
#: Letters as single bytes, as the distance function counts bytes.
_FROM, _TO = "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(window: str, words) -> str:
    return f"list_bool_or(list_transform({_list(words)}, lambda w: contains({window}, w)))"


def _at(words) -> str:
    return _any("around", folded(words)[0])


def _after(words) -> str:
    return _any("after_fold", folded(words)[0])


def _last(window: str, words) -> str:
    """Where the last of the words in a window ends, NULL without one."""
    return f"list_max(list_transform({_list(words)}, lambda w: CASE WHEN contains({window}, w) THEN length({window}) - instr(reverse({window}), reverse(w)) + 1 END))"


def _near(left: str, words) -> str:
    plain, squeezed = folded(words)
    compact = f"translate({left}, ' ' || chr(9) || chr(160), '')"
    longest = f"list_filter({_list(squeezed)}, lambda w: contains({compact}, w))"
    longest = f"list_filter({longest}, lambda w: length(w) = list_max(list_transform({longest}, lambda x: length(x))))[1]"
    rest = f"substring({compact}, length({compact}) - instr(reverse({compact}), reverse({longest})) + 2)"
    return (
        f"CASE WHEN {_last(left, plain)} IS NOT NULL THEN NOT regexp_matches(substring({left}, ({_last(left, plain)} + 1)::INT), '[0-9]')"
        f" WHEN {longest} IS NOT NULL THEN NOT regexp_matches({rest}, '[0-9]') ELSE false END"
    )


def _typo(window: str, words, least: int = 7) -> str:
    long = [w for w in folded(words)[0] if len(w) >= least]
    code = lambda w: f"translate({w}, '{_FROM}', '{_TO}')"
    coded = _list([w.translate(str.maketrans(_FROM, _TO)) for w in long])
    found = f"list_bool_or(list_transform(list_filter(regexp_extract_all({window}, '[{_LETTERS}]+'), lambda x: length(x) >= {least - 1}), lambda x: list_bool_or(list_transform({coded}, lambda a: damerau_levenshtein({code('x')}, a) <= 1))))"
    compact = f"translate({window}, ' ' || chr(9) || chr(160), '')"
    return f"(coalesce({found}, false) OR {_any(compact, long)})"


_LUHN = (
    "(n BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, n), lambda i: CASE WHEN (n - i) % 2 = 0 THEN digits[i]::INT"
    " WHEN digits[i]::INT * 2 > 9 THEN digits[i]::INT * 2 - 9 ELSE digits[i]::INT * 2 END)) % 10 = 0)"
)
_INN = (
    "CASE n WHEN 10 THEN list_sum(list_transform(generate_series(1, 9), lambda i: digits[i]::INT * [2,4,10,3,5,9,4,6,8][i])) % 11 % 10 = digits[10]::INT"
    " WHEN 12 THEN list_sum(list_transform(generate_series(1, 10), lambda i: digits[i]::INT * [7,2,4,10,3,5,9,4,6,8][i])) % 11 % 10 = digits[11]::INT"
    " AND list_sum(list_transform(generate_series(1, 11), lambda i: digits[i]::INT * [3,7,2,4,10,3,5,9,4,6,8][i])) % 11 % 10 = digits[12]::INT ELSE false END"
)
_SNILS = "(n = 11 AND list_sum(list_transform(generate_series(1, 9), lambda i: digits[i]::INT * (10 - i))) % 101 % 100 = digits[10:11]::INT)"


def rules() -> list[tuple[str, str, float, str, str]]:
    """(condition, type, confidence, reason, part) in the order of the cascade. The part is the whole number, or the first
    or last department code in it; a NULL type ends the cascade."""
    passport = "(n = 10 AND pattern IN ('4-6', '2-2-6', '10', '4-2-4') AND NOT service)"
    dept = "(pattern IN ('3-3', '6') OR n IN (5, 6) OR first_part <> '' OR last_part <> '')"
    other = _any("head", n.OTHER_DOCUMENT)
    not_passport = f"({_any('head', n.NOT_PASSPORT)} OR {other})"
    shape = "pattern IN ('4-6', '2-2-6')"
    return [
        ("n < 2 OR n_groups >= 4 AND seps = '.' AND n <= 12", "", 0, "", ""),
        (f"phone_shape AND {_at(n.PHONE)}", "PHONE", 0.9, "phone:anchor", ""),
        ("phone_shape AND (plus OR digits[1] IN ('7', '8'))", "PHONE", 0.9, "phone:shape", ""),
        (f"phone_shape AND {_typo('around', n.TYPO_PHONE)}", "PHONE", 0.9, "phone:anchor_typo", ""),
        (f"n BETWEEN 13 AND 19 AND {_at(n.CARD)} AND {_LUHN}", "CARD", 0.9, "card:luhn+anchor", ""),
        (f"n BETWEEN 13 AND 19 AND {_at(n.CARD)}", "CARD", 0.9, "card:shape+anchor", ""),
        (f"n BETWEEN 13 AND 19 AND NOT service AND NOT money AND {_LUHN}", "CARD", 0.9, "card:luhn", ""),
        ("pattern = '4-4-4-4' AND NOT service AND NOT money", "CARD", 0.6, "card:shape", ""),
        (f"n = 11 AND {_at(n.SNILS)}", "SNILS", 0.9, "snils:anchor", ""),
        (f"n IN (10, 12) AND {_at(n.SNILS)}", "SNILS", 0.75, "snils:anchor_typo_digits", ""),
        (f"pattern = '3-3-3-2' AND {_SNILS}", "SNILS", 0.75, "snils:checksum", ""),
        (f"n IN (11, 13) AND {_at(n.INN)}", "INN", 0.75, "inn:anchor_typo_digits", ""),
        (f"n IN (10, 12) AND {_at(n.INN)} AND NOT (n = 10 AND contains(regexp_extract(after, '^[^.!?\\n\\r]*'), 'кпп'))", "INN", 0.75, "inn:anchor", ""),
        (f"n IN (10, 12) AND NOT {_at(n.INN)} AND NOT ({shape} AND {_at(n.PASSPORT)}) AND {_INN} AND NOT money AND NOT service", "INN", 0.6, "inn:checksum", ""),
        (f"pattern IN ('2-2-6', '10') AND {_at(n.DRIVER)}", "DRIVER_LICENSE", 0.9, "driver:anchor", ""),
        (f"{passport} AND {_at(n.PASSPORT)} AND NOT {other}", "PASSPORT", 0.9, "passport:anchor", ""),
        (f"{passport} AND NOT {_at(n.PASSPORT)} AND {_typo('around', n.TYPO_PASSPORT)}", "PASSPORT", 0.9, "passport:anchor_typo", ""),
        (f"{passport} AND NOT {_at(n.PASSPORT)} AND NOT {not_passport} AND {shape}", "PASSPORT", 0.75, "passport:shape", ""),
        (f"{passport} AND NOT {_at(n.PASSPORT)} AND NOT {not_passport} AND pattern = '10' AND NOT money AND regexp_matches(around_low, '[{_LETTERS}]')", "PASSPORT", 0.75, "passport:shape_solid", ""),
        (f"n BETWEEN 9 AND 11 AND NOT service AND {_near('left24', n.PASSPORT_STRICT)}", "PASSPORT", 0.75, "passport:anchor_typo_digits", ""),
        (f"{dept} AND {_near('left24', n.DEPT)}", "DEPT_CODE", 0.9, "dept:anchor", "first"),
        (f"{dept} AND {_near('left40', n.DEPT_WIDE)}", "DEPT_CODE", 0.9, "dept:anchor_wide", "first"),
        (f"{dept} AND {_after(n.DEPT)}", "DEPT_CODE", 0.9, "dept:anchor_after", "last"),
        (f"{dept} AND {_typo('left24', n.TYPO_DEPT)}", "DEPT_CODE", 0.9, "dept:anchor_typo", "first"),
        (
            f"pattern = '3-3' AND ({_at(n.PASSPORT)} OR regexp_matches(wide, '^[^№]*[0-9]{{4}}[ \\t]*№[ \\t]*[0-9]{{6}}')"
            " OR contains(wide, 'с.') AND regexp_matches(substring(wide, instr(wide, 'с.') + 2), '^[ \\t]*[0-9]{4}[ \\t]*н\\.[ \\t]*[0-9]{6}'))",
            "DEPT_CODE", 0.75, "dept:passport_context", "first",
        ),
        (f"n = 6 AND ({_near('left24', n.POSTCODE)} OR {_after(n.POSTCODE)})", "POSTCODE", 0.9, "postcode:anchor", ""),
        (f"n = 6 AND {_near('left24', n.ADDRESS_LEAD)}", "POSTCODE", 0.75, "postcode:address_lead", ""),
        (f"n = 6 AND regexp_matches(tail, ',[ \\t]*$') AND {_any('tail', n.ADDRESS_WORD)}", "POSTCODE", 0.75, "postcode:address_tail", ""),
        (f"n = 6 AND {_typo('left24', n.POSTCODE, 6)}", "POSTCODE", 0.75, "postcode:anchor_typo", ""),
        (f"n BETWEEN 2 AND 5 AND ({_near('left24', n.PIN)} OR {_after(n.PIN)})", "PIN", 0.9, "pin:anchor", ""),
        (f"n BETWEEN 3 AND 5 AND ({_near('left24', n.CVV)} OR {_after(n.CVV)})", "CVV", 0.9, "cvv:anchor", ""),
        (f"n BETWEEN 3 AND 5 AND {_typo('left24', n.CVV, 5)}", "CVV", 0.75, "cvv:anchor_typo", ""),
        (f"n BETWEEN 3 AND 5 AND {_typo('left24', n.PIN, 3)}", "PIN", 0.75, "pin:anchor_typo", ""),
    ]


def runs_sql(source: str, key: str, text: str) -> str:
    """CTEs up to `run`: one row for each number of a text with its place, groups and windows."""
    cut = lambda c, a, b: f"substring({c}, (greatest({a}, 0) + 1)::INT, greatest({b} - greatest({a}, 0), 0)::INT)"
    return rf"""
m AS (SELECT {key}, {text} AS text, lower({text}) AS low, regexp_extract_all({text}, '{RUN}') AS vals, string_split_regex({text}, '{RUN}') AS gaps FROM {source} WHERE {text} IS NOT NULL),
i AS (SELECT {key}, low, vals, gaps, unnest(generate_series(1, len(vals))) AS i FROM m),
p AS (SELECT {key}, low, vals[i] AS v, regexp_matches(vals[i], '^[{_LETTERS}]')::INT AS led,
  coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(vals[1:i - 1], lambda x: length(x))), 0) AS pos FROM i),
r AS (SELECT {key}, low, translate(low, '{t.ALIKE_LATIN}', '{t.ALIKE_CYRILLIC}') AS fold, substring(v, led + 1) AS v, (pos + led)::INT AS s, (pos + length(v))::INT AS e FROM p),
g AS (SELECT *, regexp_extract_all(v, '[0-9]+') AS parts, regexp_replace(v, '[^0-9]', '', 'g') AS digits, v[1] = '+' AS plus FROM r),
w AS (SELECT *, length(digits)::INT AS n, len(parts) AS n_groups, array_to_string(list_transform(parts, lambda x: length(x)::VARCHAR), '-') AS pattern,
  array_to_string(list_sort(list_distinct(string_split(regexp_replace(regexp_replace(v, '^\+', ''), '[0-9]', '', 'g'), ''))), '') AS seps,
  {cut('fold', 's - 40', 'e + 20')} AS around, {cut('low', 's - 40', 'e + 20')} AS around_low, {cut('low', 's - 40', 'e + 10')} AS close, {cut('low', 's - 40', 'e + 40')} AS wide,
  {cut('fold', 's - 24', 's')} AS left24, {cut('fold', 's - 40', 's')} AS left40, {cut('low', 'e', 'e + 24')} AS after, {cut('fold', 'e', 'e + 24')} AS after_fold,
  {cut('low', 's - 60', 's')} AS left60, {cut('fold', 's - 60', 's')} AS fold60, regexp_extract({cut('low', 's - 70', 's')}, '[^\n\r]*$') AS tail, regexp_extract({cut('low', 's - 60', 's')}, '[^.!?;\n\r]*$') AS head,
  regexp_extract(v, '^\+?([0-9]{{3}}[^0-9]+[0-9]{{3}})(?:[^0-9]|$)', 1) AS first_part,
  CASE WHEN regexp_matches(v, '(?:^|[^0-9])[0-9]{{3}}[^0-9]+[0-9]{{3}}(?:[^0-9]|$)') THEN regexp_extract(v, '^(?:.*[^0-9])?([0-9]{{3}}[^0-9]+[0-9]{{3}})(?:[^0-9].*)?$', 1)
       WHEN len(parts) > 1 THEN regexp_extract(v, '^(?:.*[^0-9])?([0-9]{{6}})(?:[^0-9].*)?$', 1) ELSE '' END AS last_part,
  CASE WHEN regexp_matches(v, '(?:^|[^0-9])[0-9]{{3}}[^0-9]+[0-9]{{3}}(?:[^0-9]|$)') THEN length(regexp_extract(v, '^((?:.*[^0-9])?)[0-9]{{3}}[^0-9]+[0-9]{{3}}(?:[^0-9].*)?$', 1))
       ELSE length(regexp_extract(v, '^((?:.*[^0-9])?)[0-9]{{6}}(?:[^0-9].*)?$', 1)) END AS last_at
  FROM g),
run AS (SELECT *, {_any('close', n.MONEY)} AS money,
  {_last('head', n.SERVICE)} IS NOT NULL AND NOT {_any(f"substring(head, ({_last('head', n.SERVICE)} + 1)::INT)", n.STRONG)} AND NOT {_any('left60', n.PASSPORT_STRICT)} AS service,
  (plus AND n BETWEEN 10 AND 15 OR n = 11 AND digits[1] IN ('7', '8') OR n = 10 AND n_groups >= 3) AND NOT (n = 11 AND regexp_matches(digits, '^[78]80[034]')) AS phone_shape
  FROM w)"""


def number_sql(source: str, key: str, text: str) -> str:
    k = " ".join(f"WHEN {c} THEN {i}" for i, (c, *_) in enumerate(rules()))
    table = ", ".join(f"({i}, '{kind}', {conf}, '{reason}', '{part}')" for i, (_, kind, conf, reason, part) in enumerate(rules()))
    first, last = "b.part = 'first' AND a.first_part <> ''", "b.part = 'last' AND a.last_part <> ''"
    return f"""WITH {runs_sql(source, key, text)},
ruled AS (SELECT *, CASE {k} END AS k FROM run)
SELECT a.{key}, (CASE WHEN {first} THEN a.s + a.plus::INT WHEN {last} THEN a.s + a.last_at ELSE a.s END)::INT AS start,
  (CASE WHEN {first} THEN a.s + a.plus::INT + length(a.first_part) WHEN {last} THEN a.s + a.last_at + length(a.last_part) ELSE a.e END)::INT AS "end",
  b.type, b.conf::DOUBLE AS conf, b.reason
FROM ruled a JOIN (VALUES {table}) b(k, type, conf, reason, part) ON a.k = b.k WHERE b.type <> ''"""


def document_sql(source: str, key: str, text: str) -> str:
    """Accounts, insurance numbers and documents that are told by a number with an anchor before it."""
    kinds = [
        (f"n = 20 AND regexp_matches(digits, '^(408|423|426)') AND {_near('left40', p.ACCOUNT)}", "ACCOUNT", "'account:anchor'"),
        (f"n = 16 AND {_near('left40', p.OMS)}", "OMS", f"CASE WHEN {_LUHN} THEN 'oms:anchor_luhn' ELSE 'oms:anchor' END"),
        (f"n = 11 AND {_near('fold60', p.SNILS_EXTRA)}", "SNILS", "'snils:extra_anchor'"),
        (f"pattern IN ('9', '2-7') AND {_near('fold60', p.FOREIGN)}", "FOREIGN_PASSPORT", "'foreign_passport:anchor'"),
        (f"n BETWEEN 6 AND 12 AND {_near('fold60', p.PERMIT)}", "RESIDENCE_PERMIT", "'residence_permit:anchor'"),
    ]
    parts = " UNION ALL ".join(f"SELECT {key}, s AS start, e AS \"end\", '{kind}' AS type, 0.9::DOUBLE AS conf, {reason} AS reason FROM run WHERE {c}" for c, kind, reason in kinds)
    return f"WITH {runs_sql(source, key, text)} {parts}"
