"""Row-wise transforms: numbers, comparisons, dates, text, addresses, places."""

from __future__ import annotations

import re
import string as strings
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.aggregates import d
from tallyloom.functions.base import (
    ANY, BOOL, LATLONG, NUM, ORDINAL, R_BOOL, R_CAT, R_DOUBLE, R_INT, R_NUM, R_ORD, TEXT, TIME, Ctx, in_unit, micros, safe_div, seconds_between, transform,
)
from tallyloom.functions.wordlists import VOCABULARIES, common_words, names
from tallyloom.types import column_schema, template

INF = float("inf")

# numbers
transform("Absolute", [NUM], R_NUM, lambda p, v, x: F.abs(v[0]))
transform("Negate", [NUM], R_NUM, lambda p, v, x: -v[0], named=lambda p, n: f"-({n[0]})")
transform("Sine", [NUM], R_DOUBLE, lambda p, v, x: F.sin(v[0]))
transform("Cosine", [NUM], R_DOUBLE, lambda p, v, x: F.cos(v[0]))
transform("Tangent", [NUM], R_DOUBLE, lambda p, v, x: F.tan(v[0]))
transform("SquareRoot", [NUM], R_DOUBLE, lambda p, v, x: F.when(v[0] >= 0, F.sqrt(v[0])))
transform("NaturalLogarithm", [NUM], R_DOUBLE, lambda p, v, x: F.when(v[0] == 0, F.lit(-INF)).when(v[0] > 0, F.ln(v[0])))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a divisor of 0."""
    a, b = d(a), d(b)
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


_two = {
    "AddNumeric": ("+", lambda a, b: a + b, True), "SubtractNumeric": ("-", lambda a, b: a - b, True), "MultiplyNumeric": ("*", lambda a, b: a * b, True),
    "DivideNumeric": ("/", safe_div, False), "ModuloNumeric": ("%", modulo, False),
}
for _name, (_sign, _fn, _comm) in _two.items():
    transform(_name, [NUM, NUM], R_NUM, lambda p, v, x, f=_fn: f(v[0], v[1]), commutative=_comm, named=lambda p, n, s=_sign: f"{n[0]} {s} {n[1]}",
              params={"commutative": _comm} if _name in ("SubtractNumeric", "DivideNumeric") else {})
    transform(f"{_name}Scalar", [NUM], R_NUM, lambda p, v, x, f=_fn: f(v[0], F.lit(p.value)), params={"value": 0 if _sign in "+-" else 1},
              named=lambda p, n, s=_sign: f"{n[0]} {s} {p.value}")
for _name, _sign, _fn, _value in [
    ("ScalarSubtractNumericFeature", "-", lambda a, b: a - b, 0), ("DivideByFeature", "/", safe_div, 1), ("ModuloByFeature", "%", modulo, 1),
]:
    transform(_name, [NUM], R_NUM, lambda p, v, x, f=_fn: f(F.lit(p.value), v[0]), params={"value": _value}, named=lambda p, n, s=_sign: f"{p.value} {s} {n[0]}")

# comparisons


def _ranks(v: list[Column], x: Ctx):
    """Ordinal columns compare by the place of their level; different levels compare to null."""
    if not x.schemas or not any(s.logical == "Ordinal" for s in x.schemas):
        return v
    if any(s.logical != "Ordinal" for s in x.schemas) or x.orders[0] != x.orders[1]:
        return [F.lit(None).cast("int")] * 2
    levels = x.orders[0]
    if not levels:
        return v
    return [F.nullif(F.array_position(F.array(*[F.lit(e) for e in levels]), c), F.lit(0)) for c in v]


_order_inputs = [[NUM, NUM], [TIME, TIME], [ORDINAL, ORDINAL]]
for _name, _sign, _fn in [
    ("GreaterThan", ">", lambda a, b: a > b), ("GreaterThanEqualTo", ">=", lambda a, b: a >= b), ("LessThan", "<", lambda a, b: a < b), ("LessThanEqualTo", "<=", lambda a, b: a <= b),
]:
    transform(_name, _order_inputs, R_BOOL, lambda p, v, x, f=_fn: f(*_ranks(v, x)), named=lambda p, n, s=_sign: f"{n[0]} {s} {n[1]}")
    transform(f"{_name}Scalar", [NUM], R_BOOL, lambda p, v, x, f=_fn: F.coalesce(f(v[0], F.lit(p.value)), F.lit(False)), params={"value": 0},
              named=lambda p, n, s=_sign: f"{n[0]} {s} {p.value}")
transform("Equal", [ANY, ANY], R_BOOL, lambda p, v, x: F.coalesce(v[0] == v[1], F.lit(False)), commutative=True, named=lambda p, n: f"{n[0]} = {n[1]}")
transform("NotEqual", [ANY, ANY], R_BOOL, lambda p, v, x: F.coalesce(v[0] != v[1], F.lit(True)), commutative=True, named=lambda p, n: f"{n[0]} != {n[1]}")
transform("EqualScalar", [ANY], R_BOOL, lambda p, v, x: F.coalesce(v[0] == F.lit(p.value), F.lit(False)), params={"value": None}, named=lambda p, n: f"{n[0]} = {p.value}")
transform("NotEqualScalar", [ANY], R_BOOL, lambda p, v, x: F.coalesce(v[0] != F.lit(p.value), F.lit(True)), params={"value": None}, named=lambda p, n: f"{n[0]} != {p.value}")
transform("IsIn", [ANY], R_BOOL, lambda p, v, x: F.coalesce(v[0].isin(list(p.list_of_outputs or [])), F.lit(False)), params={"list_of_outputs": None}, name="isin",
          named=lambda p, n: f"{n[0]}.isin({p.list_of_outputs})")
transform("IsNull", [ANY], R_BOOL, lambda p, v, x: v[0].isNull())

# booleans
_bb = {"commutative": True}
transform("And", [BOOL, BOOL], R_BOOL, lambda p, v, x: v[0] & v[1], named=lambda p, n: f"AND({n[0]}, {n[1]})", **_bb)
transform("Or", [BOOL, BOOL], R_BOOL, lambda p, v, x: v[0] | v[1], named=lambda p, n: f"OR({n[0]}, {n[1]})", **_bb)
transform("Not", [BOOL], R_BOOL, lambda p, v, x: ~v[0], named=lambda p, n: f"NOT({n[0]})")
transform("MultiplyBoolean", [BOOL, BOOL], R_BOOL, lambda p, v, x: v[0] & v[1], named=lambda p, n: f"{n[0]} * {n[1]}", **_bb)


def _times_flag(p, v, x):
    first = bool(x.schemas) and x.schemas[0].logical == "Boolean"
    flag, number = (v[0], v[1]) if first else (v[1], v[0])
    return number * flag.cast("int")


transform("MultiplyNumericBoolean", [[NUM, BOOL], [BOOL, NUM]], R_NUM, _times_flag, named=lambda p, n: f"{n[0]} * {n[1]}", **_bb)

# dates
for _name, _fn in {
    "Day": F.dayofmonth, "DayOfYear": F.dayofyear, "DaysInMonth": lambda t: F.dayofmonth(F.last_day(t)), "Hour": F.hour, "Minute": F.minute, "Month": F.month,
    "Quarter": F.quarter, "Second": F.second, "Week": F.weekofyear, "Weekday": F.weekday, "Year": F.year,
}.items():
    transform(_name, [TIME], R_ORD, lambda p, v, x, f=_fn: f(v[0]))


def _nth_week(t: Column) -> Column:
    return F.ceil((F.dayofmonth(t) + F.dayofweek(F.trunc(t, "month")) - 1) / 7)


for _name, _fn in {
    "IsLeapYear": lambda t: F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))) == 366,
    "IsMonthStart": lambda t: F.dayofmonth(t) == 1, "IsMonthEnd": lambda t: F.to_date(t) == F.last_day(t),
    "IsQuarterStart": lambda t: F.to_date(t) == F.trunc(t, "quarter"), "IsQuarterEnd": lambda t: F.to_date(t) == F.last_day(F.add_months(F.trunc(t, "quarter"), 2)),
    "IsYearStart": lambda t: F.dayofyear(t) == 1, "IsYearEnd": lambda t: (F.month(t) == 12) & (F.dayofmonth(t) == 31),
    "IsWeekend": lambda t: F.weekday(t) > 4, "IsFirstWeekOfMonth": lambda t: _nth_week(t) == 1,
}.items():
    transform(_name, [TIME], R_BOOL, lambda p, v, x, f=_fn: f(v[0]))
transform("IsLunchTime", [TIME], R_BOOL, lambda p, v, x: F.hour(v[0]) == p.lunch_hour, params={"lunch_hour": 12})
transform("IsWorkingHours", [TIME], R_BOOL, lambda p, v, x: F.hour(v[0]).between(p.start_hour, p.end_hour), params={"start_hour": 8, "end_hour": 18})
transform("NthWeekOfMonth", [TIME], R_DOUBLE, lambda p, v, x: d(_nth_week(v[0])))
transform("TimeSince", [TIME], R_NUM, lambda p, v, x: in_unit(seconds_between(x.cutoff, v[0]), p.unit), params={"unit": "seconds"}, uses_calc_time=True)
transform("Age", [template("Datetime", "date_of_birth")], column_schema("AgeFractional"), lambda p, v, x: F.floor(seconds_between(x.cutoff, v[0]) / 86400) / F.lit(365.0), uses_calc_time=True)


def _time_zone(p, v, x):
    """The zone that a timestamp is read in: that of the session, or the given one; a timestamp without zone has none unless one is given."""
    own = F.when(F.typeof(v[0]) == "timestamp", F.current_timezone()) if p.zone is None else F.lit(p.zone)
    return F.when(v[0].isNotNull(), own)


transform("DateToTimeZone", [TIME], R_CAT, _time_zone, params={"zone": None})


def _part_of_day(p, v, x):
    h = F.hour(v[0])
    # fixed values: first hour of each part
    out = F.when(h.isNull(), F.lit(None))
    for last, name in [(3, "midnight"), (5, "dawn"), (7, "early morning"), (10, "late morning"), (13, "noon"), (16, "afternoon"), (19, "evening"), (22, "night")]:
        out = out.when(h <= last, F.lit(name))
    return out.otherwise(F.lit("midnight"))


transform("PartOfDay", [TIME], R_CAT, _part_of_day)


def _season(p, v, x):
    m = F.month(v[0]) * 100 + F.dayofmonth(v[0])
    return F.when(m.isNull(), F.lit(None)).when(m < 321, "winter").when(m < 621, "spring").when(m < 923, "summer").when(m < 1221, "fall").otherwise("winter")


transform("Season", [TIME], R_CAT, _season)

# holidays: the United States' federal calendar by rule, as expressions of a year


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th given weekday (Monday 0) of a month; n = 0 is the last."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n:
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def _fixed(month: int, day: int):
    return lambda y: F.make_date(y, F.lit(month), F.lit(day))


#: Name, date in a year, first year, whether it moves off weekends.
HOLIDAYS = {
    "New Year's Day": (_fixed(1, 1), 1950, True),
    "Martin Luther King Jr. Day": (lambda y: _nth(y, 1, 0, 3), 1986, False),
    "Washington's Birthday": (lambda y: F.when(y < 1971, F.make_date(y, F.lit(2), F.lit(22))).otherwise(_nth(y, 2, 0, 3)), 1950, False),
    "Memorial Day": (lambda y: F.when(y < 1971, F.make_date(y, F.lit(5), F.lit(30))).otherwise(_nth(y, 5, 0, 0)), 1950, False),
    "Juneteenth National Independence Day": (_fixed(6, 19), 2021, True),
    "Independence Day": (_fixed(7, 4), 1950, True),
    "Labor Day": (lambda y: _nth(y, 9, 0, 1), 1950, False),
    "Columbus Day": (lambda y: F.when(y < 1971, F.make_date(y, F.lit(10), F.lit(12))).otherwise(_nth(y, 10, 0, 2)), 1950, False),
    "Veterans Day": (lambda y: F.when((y > 1970) & (y < 1978), _nth(y, 10, 0, 4)).otherwise(F.make_date(y, F.lit(11), F.lit(11))), 1950, True),
    "Thanksgiving Day": (lambda y: _nth(y, 11, 3, 4), 1950, False),
    "Christmas Day": (_fixed(12, 25), 1950, True),
}
LAST_YEAR = 2074


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar, by the anonymous algorithm."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    rest = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    month, day = divmod(h + rest - 7 * ((a + 11 * h + 22 * rest) // 451) + 114, 31)
    return date(year, month, day + 1)


def _from_easter(days: int):
    return lambda y: easter(y) + timedelta(days)


def _every(month: int, day: int, since: int = 0):
    return lambda y: date(y, month, day) if y >= since else None


#: The national holidays of other countries by name, as rules from a year to a date; ``add_calendar`` adds more.
CALENDARS: dict[str, dict] = {
    "DE": {
        "Neujahr": _every(1, 1), "Karfreitag": _from_easter(-2), "Ostermontag": _from_easter(1), "Erster Mai": _every(5, 1), "Christi Himmelfahrt": _from_easter(39),
        "Pfingstmontag": _from_easter(50), "Tag der Deutschen Einheit": _every(10, 3, 1990), "Erster Weihnachtstag": _every(12, 25), "Zweiter Weihnachtstag": _every(12, 26),
    },
    "FR": {
        "Jour de l'an": _every(1, 1), "Lundi de Pâques": _from_easter(1), "Fête du Travail": _every(5, 1), "Fête de la Victoire": _every(5, 8), "Ascension": _from_easter(39),
        "Lundi de Pentecôte": _from_easter(50), "Fête nationale": _every(7, 14), "Assomption": _every(8, 15), "Toussaint": _every(11, 1), "Armistice": _every(11, 11), "Noël": _every(12, 25),
    },
}


def add_calendar(country: str, rules: dict) -> None:
    """Make a country's holidays known: name -> function from a year to a date, or to None in years without it."""
    CALENDARS[country] = dict(rules)


def _countries() -> list[str]:
    return ["US", *CALENDARS]


def _dates(rule) -> list[date]:
    return [d_ for y in range(1950, LAST_YEAR + 1) if (d_ := rule(y)) is not None]


def holiday_name(t: Column, country: str = "US") -> Column:
    """Name of the holiday a date falls on; in the United States those moved to the Friday or Monday beside a weekend included."""
    day, y = F.to_date(t), F.year(t)
    out = F.when(day.isNull(), F.lit(None).cast("string"))
    if country in CALENDARS:
        for name, rule in CALENDARS[country].items():
            out = out.when(day.isin(_dates(rule)), F.lit(name))
        return out
    if country != "US":
        raise ValueError(f"must be one of the available countries: {', '.join(_countries())}")
    known = lambda since: (y >= since) & (y <= LAST_YEAR)
    for name, (when, since, _) in HOLIDAYS.items():
        out = out.when(known(since) & (day == when(y)), F.lit(name))
    for name, (when, since, moves) in HOLIDAYS.items():
        if moves:
            near = F.when(F.weekday(day) == 0, F.date_sub(day, 1)).when(F.weekday(day) == 4, F.date_add(day, 1))
            out = out.when((F.year(near) >= since) & (F.year(near) <= LAST_YEAR) & (near == when(F.year(near))), F.lit(f"{name} (observed)"))
    return out


def _holiday_distance(p, v, x):
    day = F.to_date(v[0])
    if p.country in CALENDARS:
        if p.holiday not in CALENDARS[p.country]:
            raise ValueError(f"must be one of the available holidays: {list(CALENDARS[p.country])}")
        near = F.transform(F.array(*[F.lit(x) for x in _dates(CALENDARS[p.country][p.holiday])]), lambda h: F.datediff(h, day))
    else:
        if p.country != "US":
            raise ValueError(f"must be one of the available countries: {', '.join(_countries())}")
        if p.holiday not in HOLIDAYS:
            raise ValueError(f"must be one of the available holidays: {list(HOLIDAYS)}")
        when, since, _ = HOLIDAYS[p.holiday]
        near = F.array(*[
            F.when((F.year(day) + k >= since) & (F.year(day) + k <= LAST_YEAR), F.datediff(when(F.year(day) + F.lit(k)), day)) for k in (-1, 0, 1)
        ])
    best = F.array_min(F.transform(F.filter(near, lambda n: F.abs(n) <= 365), lambda n: F.struct(F.abs(n).alias("a"), n.alias("n"))))
    return best.getField("n")


def _holiday(p, v, x):
    return holiday_name(v[0], p.country)


def _is_holiday(p, v, x):
    return F.when(v[0].isNotNull(), holiday_name(v[0], p.country).isNotNull())


transform("DateToHoliday", [TIME], R_CAT, _holiday, params={"country": "US"})
transform("IsFederalHoliday", [TIME], R_BOOL, _is_holiday, params={"country": "US"})
transform("DistanceToHoliday", [TIME], R_NUM, _holiday_distance, params={"holiday": "New Year's Day", "country": "US"}, default=0)

# text
PUNCTUATION = strings.punctuation
_punct = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
_counted = {"default": 0}
SPLIT = "[ \n\t]"
#: What counts as a word's character, a character of it that is no digit, and blank.
WORD, LETTER, BLANK = r"[\p{L}\p{N}_]", r"[\p{L}\p{Nl}\p{No}_]", r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WORD = WORD.replace("[", "[^", 1)
#: The rest of the code points, those met most often first: a class is tried range by range.
NOT_BLANK = r"[!-\x{84}\x{3001}-\x{10ffff}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{86}-\x{9f}\x{00}-\x{08}\x{0e}-\x{1b}]"


def stripped(w: Column) -> Column:
    return F.btrim(w, F.lit(PUNCTUATION))


def words(t: Column, pattern: str = SPLIT) -> Column:
    return F.split(t, pattern)


def let(value: Column, use, where: Column) -> Column:
    """``use`` of a value that is worked out once, where the condition holds."""
    return F.when(where, F.get(F.transform(F.array(value), use), F.lit(0)))


def count_of(pattern: str):
    return lambda p, v, x: F.regexp_count(v[0], F.lit(pattern)).cast("long")


def _count_string(p, v, x):
    clean = lambda s: re.sub("[^0-9a-zA-Z ]+", "", s) if p.ignore_non_alphanumeric else s
    text = F.regexp_replace(v[0], "[^0-9a-zA-Z ]+", "") if p.ignore_non_alphanumeric else v[0]
    text = F.lower(text) if p.ignore_case else text
    lowered = (lambda s: s.lower()) if p.ignore_case else (lambda s: s)
    pattern = lowered(p.string) if p.is_regex else "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in lowered(clean(p.string)))
    if p.match_whole_words_only:
        pattern = f"\\b{pattern}\\b"
    flags = "(?U)" if p.is_regex or p.match_whole_words_only else ""
    return F.regexp_count(text, F.lit(flags + pattern)).cast("long")


transform("CountString", [TEXT], R_INT, _count_string,
          params={"string": "the", "ignore_case": True, "ignore_non_alphanumeric": False, "is_regex": False, "match_whole_words_only": False})


def _mean_length(p, v, x):
    """Characters that are not blank over runs of them, once signs at the ends of words are gone; two passes over the text, no list of words."""
    clean = F.regexp_replace(v[0], r"[!,.:;?]+(?:\z|[ \n])", " ")
    return let(clean, lambda t: F.coalesce(F.try_divide(d(F.char_length(t) - F.char_length(F.regexp_replace(t, NOT_BLANK + "+", ""))), F.regexp_count(t, F.lit(NOT_BLANK + "+"))), F.lit(0.0)), v[0].isNotNull())


transform("MeanCharactersPerWord", [TEXT], R_DOUBLE, _mean_length, **_counted)


def _median_length(p, v, x):
    lengths = F.sort_array(F.transform(F.filter(F.split(v[0], p.delimiters_regex), lambda w: w != ""), F.char_length))
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2.0
    return let(lengths, lambda a: F.when(F.size(a) > 0, middle(a)), v[0].isNotNull())


transform("MedianWordLength", [TEXT], R_DOUBLE, _median_length, params={"delimiters_regex": SPLIT}, **_counted)
transform("NumCharacters", [TEXT], R_INT, lambda p, v, x: F.char_length(v[0]).cast("long"))
#: Separators of natural language.
SEPARATORS = [" ", ".", ",", "!", "?", ";", "\n"]
transform("NumUniqueSeparators", [TEXT], R_INT,
          lambda p, v, x: F.when(v[0].isNotNull(), sum((F.contains(v[0], F.lit(s)).cast("long") for s in p.separators), F.lit(0).cast("long"))), params={"separators": SEPARATORS})
transform("NumWords", [TEXT], R_INT, lambda p, v, x: F.when(v[0].isNotNull(), F.size(F.filter(words(v[0]), lambda w: stripped(w) != ""))).cast("long"))
def _common(p, v, x):
    known = sorted(common_words(p.vocabularies, p.most_words) if p.word_set is None else p.word_set)
    return F.when(v[0].isNotNull(), F.size(F.filter(F.split(F.lower(v[0]), p.delimiters_regex), lambda w: stripped(w).isin(known)))).cast("long")


transform("NumberOfCommonWords", [TEXT], R_INT, _common,
          params={"word_set": None, "delimiters_regex": SPLIT, "vocabularies": VOCABULARIES, "most_words": 1_000}, **_counted)

_no_at = "".join("\\" + c for c in PUNCTUATION if c != "@")
#: Patterns of a hashtag, of a mention, of a title word, and of what two quotation marks enclose.
HASHTAG = rf"#(?<!{NOT_BLANK}#){WORD}*{LETTER}{WORD}*(?!#|{WORD})"
MENTION = rf"@(?<!{NOT_BLANK}@){WORD}+(?={BLANK}|$|[{_no_at}])"
TITLE = rf"[A-Z]{NOT_BLANK}*"
QUOTED = {"double": rf'(?:^|{NOT_WORD})".*?"(?!{WORD})', "single": rf"(?:^|{NOT_WORD})'.*?'(?!{WORD})"}
transform("NumberOfHashtags", [TEXT], R_INT, count_of(HASHTAG), **_counted)
transform("NumberOfMentions", [TEXT], R_INT, count_of(MENTION), **_counted)


def _unique_words(p, v, x):
    text = F.lower(v[0]) if p.case_insensitive else v[0]
    ws = F.filter(F.transform(F.regexp_extract_all(text, F.lit(NOT_BLANK + "+"), 0), stripped), lambda w: w != "")
    return F.when(v[0].isNotNull(), F.size(F.array_distinct(ws))).cast("long")


transform("NumberOfUniqueWords", [TEXT], R_INT, _unique_words, params={"case_insensitive": False}, **_counted)


def _quoted(p, v, x):
    kinds = {"both": ["single", "double"], "single": ["single"], "double": ["double"]}
    if p.quote_type not in kinds:
        raise ValueError(f"{p.quote_type} is not a valid quote_type. Specify 'both', 'single', or 'double'")
    found = F.regexp_extract_all(v[0], F.lit("(?s)" + "|".join(QUOTED[k] for k in kinds[p.quote_type])), 0)
    n = F.aggregate(
        found, F.lit(0), lambda a, m: a + F.size(F.filter(words(m), lambda w: F.btrim(w, F.lit(PUNCTUATION + " ")) != ""))
    )
    return F.when(v[0].isNotNull(), n).cast("long")


transform("NumberOfWordsInQuotes", [TEXT], R_INT, _quoted, params={"quote_type": "both"}, **_counted)
transform("PunctuationCount", [TEXT], R_INT, count_of(_punct), **_counted)
transform("TitleWordCount", [TEXT], R_INT, count_of(TITLE), **_counted)
_not_counted = "[" + "".join("\\" + c for c in PUNCTUATION if c != "\\") + "\n\t ]"
transform("TotalWordLength", [TEXT], R_INT, lambda p, v, x: (F.char_length(v[0]) - F.regexp_count(v[0], F.lit(p.do_not_count))).cast("long"),
          params={"do_not_count": _not_counted}, **_counted)
transform("UpperCaseCount", [TEXT], R_INT, count_of("[A-Z]"), **_counted)
transform("UpperCaseWordCount", [TEXT], R_INT,
          lambda p, v, x: F.when(v[0].isNotNull(), F.size(F.filter(words(v[0]), lambda w: (stripped(w) != "") & (F.upper(w) == w)))).cast("long"), **_counted)
transform("WhitespaceCount", [TEXT], R_INT, count_of(" "), **_counted)


# names, files, addresses
def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or null: the extraction gives an empty text for none."""
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


_name_in = [template("PersonFullName")]


#: Patterns that tell the parts of a full name, of a path, and of a URL.
TITLE_AND_LAST = r"^[A-Z][a-z]+\. [A-Z][a-z]+$"
TITLE_DOT = r"([A-Z][a-z]+)\. "
FIRST_NAME = r"([A-Z][a-z]+ |, [A-Z][a-z]+$|^[A-Z][a-z]+$)"
LAST_NAME = r"(^.+?,|^[A-Z][a-z]+\. [A-Z][a-z]+$| [A-Z][a-z]+$| [A-Z][a-z]+[/-][A-Z][a-z]+$)"
EXTENSION = r"(\.[a-z|A-Z]+$)"
HOST = r"^(?:https?:\/\/)?(?:[^@\/\n]+@)?(?:www\.)?([^:\/?\n]+)"
PROTOCOL = r"^(https|http)(?:\:)"


def _first_name(p, v, x):
    s = F.regexp_replace(F.regexp_replace(v[0], TITLE_AND_LAST, ""), TITLE_DOT, "")
    return F.trim(F.regexp_replace(first_match(s, FIRST_NAME), ",", ""))


def _last_name(p, v, x):
    return F.trim(F.regexp_replace(F.regexp_replace(first_match(v[0], LAST_NAME), TITLE_DOT, ""), ",", ""))


transform("FullNameToFirstName", _name_in, R_CAT, _first_name)
transform("FullNameToLastName", _name_in, R_CAT, _last_name)
transform("FullNameToTitle", _name_in, R_CAT, lambda p, v, x: first_match(v[0], TITLE_DOT))
transform("FileExtension", [template("Filepath")], R_CAT, lambda p, v, x: F.lower(first_match(v[0], EXTENSION)))


def domain_of(email: Column) -> Column:
    return F.get(F.split(F.trim(email), "@"), 1)


#: Well-known free mail domains, the default; give domains, a list or the path of a text file, for another list.
FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "live.com", "msn.com", "mail.com", "gmx.com", "gmx.de", "web.de", "protonmail.com", "yandex.com", "zoho.com"]
transform("EmailAddressToDomain", [template("EmailAddress")], R_CAT, lambda p, v, x: domain_of(v[0]))
transform("IsFreeEmailDomain", [template("EmailAddress")], R_BOOL, lambda p, v, x: domain_of(v[0]).isin(names(p.domains)), params={"domains": FREE_DOMAINS})
transform("URLToDomain", [template("URL")], R_CAT, lambda p, v, x: first_match(v[0], HOST), name="url_to_domain")
transform("URLToProtocol", [template("URL")], R_CAT, lambda p, v, x: first_match(v[0], PROTOCOL), name="url_to_protocol")


def _tld(p, v, x):
    """The last label of the host if it is made of letters; or the longest ending of the host in ``tlds``, a list or the path of a text file."""
    host = first_match(v[0], HOST)
    if p.tlds is None:
        return first_match(host, r"\.([A-Za-z]{2,})\.?$")
    labels = F.split(F.btrim(host, F.lit(".")), r"\.")
    endings = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.get(F.filter(endings, lambda e: F.lower(e).isin(names(p.tlds))), 0)


transform("URLToTLD", [template("URL")], R_CAT, _tld, name="url_to_tld", params={"tlds": None})
transform("OneDigitPostalCode", [template("PostalCode")], R_CAT, lambda p, v, x: F.substring(v[0].cast("string"), 1, 1))
transform("TwoDigitPostalCode", [template("PostalCode")], R_CAT, lambda p, v, x: F.substring(v[0].cast("string"), 1, 2))

# places
EARTH = {"miles": 3958.7613, "kilometers": 6371.0088}


def haversine(lat1, lon1, lat2, lon2, unit: str) -> Column:
    if unit not in EARTH:
        raise ValueError("Invalid unit given. Specify 'miles' or 'kilometers'")
    r = F.radians
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH[unit])


def _lat(c: Column) -> Column:
    return c.getField("lat")


def _lon(c: Column) -> Column:
    return c.getField("lon")


_geo = {"params": {"unit": "miles"}, "commutative": True}
transform("Haversine", [LATLONG, LATLONG], R_NUM, lambda p, v, x: haversine(_lat(v[0]), _lon(v[0]), _lat(v[1]), _lon(v[1]), p.unit), **_geo)
transform("CityblockDistance", [LATLONG, LATLONG], R_DOUBLE,
          lambda p, v, x: haversine(_lat(v[0]), _lon(v[0]), _lat(v[0]), _lon(v[1]), p.unit) + haversine(_lat(v[0]), _lon(v[0]), _lat(v[1]), _lon(v[0]), p.unit), **_geo)
transform("GeoMidpoint", [LATLONG, LATLONG], column_schema("LatLong"),
          lambda p, v, x: F.when(v[0].isNotNull() & v[1].isNotNull(), F.struct(((_lat(v[0]) + _lat(v[1])) / 2).alias("lat"), ((_lon(v[0]) + _lon(v[1])) / 2).alias("lon"))),
          name="geomidpoint", commutative=True)


def _in_box(p, v, x):
    (a, b), (c, e) = p.point1, p.point2
    return F.coalesce(_lat(v[0]).between(min(a, c), max(a, c)) & _lon(v[0]).between(min(b, e), max(b, e)), F.lit(False))


transform("IsInGeoBox", [LATLONG], R_BOOL, _in_box, params={"point1": (0, 0), "point2": (0, 0)}, name="is_in_geobox")
transform("Latitude", [LATLONG], R_NUM, lambda p, v, x: _lat(v[0]))
transform("Longitude", [LATLONG], R_NUM, lambda p, v, x: _lon(v[0]))

DEFAULT_TRANSFORMS = ["age", "day", "year", "month", "weekday", "haversine", "num_words", "num_characters"]
__all__ = ["DEFAULT_TRANSFORMS", "micros"]
