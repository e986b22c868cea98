"""Measurements as spoken words, with every number kept as it is written.

A text is cut into tokens (numbers, dashes, degree signs, runs of letters, single marks), each knowing whether a gap stood
before it. Tokens are rendered one by one from themselves and their neighbours: a dash between two numbers is the word of a
range, a known unit is its name, the rest stays. There is no rewriting of the text as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidemark.functions.text import SIGNED, numbers

# fixed values: spoken singular and plural of each unit symbol
UNITS = {
    "en": {"m": ("metre", "metres"), "km": ("kilometre", "kilometres"), "m/s": ("metre per second", "metres per second"), "km/h": ("kilometre per hour", "kilometres per hour"), "kn": ("knot", "knots"), "s": ("second", "seconds"), "h": ("hour", "hours"), "min": ("minute", "minutes"), "degC": ("degree Celsius", "degrees Celsius"), "deg": ("degree", "degrees"), "%": ("percent", "percent"), "hPa": ("hectopascal", "hectopascals"), "nmi": ("nautical mile", "nautical miles")},
    "ta": {"m": ("மீட்டர்", "மீட்டர்"), "km": ("கிலோமீட்டர்", "கிலோமீட்டர்"), "m/s": ("மீட்டர் பெர் செகண்ட்", "மீட்டர் பெர் செகண்ட்"), "km/h": ("மணிக்கு கிலோமீட்டர்", "மணிக்கு கிலோமீட்டர்"), "kn": ("நாட்", "நாட்"), "s": ("செகண்ட்", "செகண்ட்"), "h": ("மணி நேரம்", "மணி நேரம்"), "min": ("நிமிடம்", "நிமிடம்"), "degC": ("டிகிரி செல்சியஸ்", "டிகிரி செல்சியஸ்"), "deg": ("டிகிரி", "டிகிரி"), "%": ("சதவீதம்", "சதவீதம்"), "hPa": ("ஹெக்டோபாஸ்கல்", "ஹெக்டோபாஸ்கல்"), "nmi": ("கடல் மைல்", "கடல் மைல்")},
    "hi": {"m": ("मीटर", "मीटर"), "km": ("किलोमीटर", "किलोमीटर"), "m/s": ("मीटर प्रति सेकंड", "मीटर प्रति सेकंड"), "km/h": ("किलोमीटर प्रति घंटा", "किलोमीटर प्रति घंटा"), "kn": ("नॉट", "नॉट"), "s": ("सेकंड", "सेकंड"), "h": ("घंटा", "घंटे"), "min": ("मिनट", "मिनट"), "degC": ("डिग्री सेल्सियस", "डिग्री सेल्सियस"), "deg": ("डिग्री", "डिग्री"), "%": ("प्रतिशत", "प्रतिशत"), "hPa": ("हेक्टोपास्कल", "हेक्टोपास्कल"), "nmi": ("समुद्री मील", "समुद्री मील")},
}
# fixed values: degree signs, the word between the ends of a range, the word for a decimal point
SIGNS = {"°C": "degC", "℃": "degC", "°": "deg"}
RANGE = {"en": "to", "ta": "முதல்", "hi": "से"}
POINT = {"en": "point", "ta": "புள்ளி", "hi": "दशमलव"}
DASHES, CLOSING = "-–—", ".,;:!?।॥"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
TOKEN = rf"\s*(?:{NUMBER}|°C|[\p{{L}}\p{{M}}%/]+|\S)"


def unit_name(symbol: Column, value: Column, language: str = "en") -> Column:
    """A unit's name: the singular for a value of 1 or -1, the plural else and for null; null for an unknown symbol."""
    table = UNITS[language]
    forms = lambda i: F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])])
    return F.when(F.abs(value) == 1, forms(0)[symbol]).otherwise(forms(1)[symbol])


def tokens_of(text: Column) -> Column:
    """array<struct<t, gap, unit>>: tokens, whether white space stood before, and the symbol of degree signs."""
    signs = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    one = lambda raw: F.struct(F.trim(F.regexp_replace(raw, r"^\s+", "")).alias("t"), raw.rlike(r"^\s").alias("gap"), signs[F.regexp_replace(raw, r"^\s+", "")].alias("sign"))
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), one)


def spoken(text: Column, language: str = "en", point_as_word: bool = False) -> Column:
    """struct(text, numbers, units, drifted): the text with ranges and known units in words.

    numbers are those of the given text, drifted says that the made text doesn't hold the same ones in the same order:
    such a row must not be read out. Symbols without a name stay. Null text gives nulls.
    """
    return bound(tokens_of(text), lambda tokens: bound(_pieces(tokens, language, point_as_word), lambda made: _said(text, made, language, point_as_word)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: within, it is a variable instead of a copy of its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(tokens: Column, language: str, point_as_word: bool) -> Column:
    """array<struct<piece, unit>>: what is said for each token, with its gap, and the symbol of a unit."""
    is_number = lambda x: F.coalesce(x["t"].rlike(rf"^{NUMBER}$"), F.lit(False))
    ends = lambda x: x["t"].isNull() | x["gap"] | x["t"].isin(*CLOSING) | x["t"].isin(*DASHES)

    def put(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tokens, i - 1))
        after = F.get(tokens, i + 1)
        stretch = x["t"].isin(*DASHES) & is_number(before) & is_number(after)
        alone = (before["t"].isNull() | x["gap"] | is_number(before) | x["sign"].isNotNull()) & ends(after)
        symbol = F.when(alone, F.coalesce(x["sign"], x["t"]))
        name = unit_name(symbol, F.when(is_number(before), before["t"]).cast("double"), language)
        from_range = F.coalesce(before["t"].isin(*DASHES), F.lit(False)) & is_number(x) & is_number(F.when(i > 1, F.get(tokens, i - 2)))
        said = F.when(stretch, F.lit(RANGE[language])).otherwise(F.coalesce(name, x["t"]))
        if point_as_word:
            said = F.when(is_number(x), F.replace(x["t"], F.lit("."), F.lit(f" {POINT[language]} "))).otherwise(said)
        apart = x["gap"] | stretch | name.isNotNull() | from_range
        return F.struct(F.concat(F.when(apart & (i > 0), " ").otherwise(""), said).alias("piece"), F.when(name.isNotNull(), symbol).alias("unit"))

    return F.transform(tokens, put)


def _said(text: Column, made: Column, language: str, point_as_word: bool) -> Column:
    out = F.array_join(F.transform(made, lambda y: y["piece"]), "")
    heard = F.regexp_replace(out, rf"([0-9]) {POINT[language]} ([0-9])", "$1.$2") if point_as_word else out
    units = F.filter(F.transform(made, lambda y: y["unit"]), lambda u: u.isNotNull())
    return F.struct(out.alias("text"), numbers(text).alias("numbers"), units.alias("units"), (~numbers(text).eqNullSafe(numbers(heard))).alias("drifted"))


# where a text changes: a dash between two numbers, and a symbol that stands alone (after a gap or a number, or a degree sign,
# and before an end). Digits stand in numbers only, and symbols are whole runs there, so neighbours tell as tokens would.
_STOP = "[ " + re.escape(CLOSING + DASHES) + "]"
_SYMBOLS = "|".join(re.escape(x) for x in sorted(UNITS["en"], key=len, reverse=True))
_CHANGES = re.compile(rf"(?<=[0-9]) ?[{re.escape(DASHES)}] ?(?=[0-9])|(?P<gap> |^|(?<=[0-9]))(?P<unit>{_SYMBOLS})(?={_STOP}|\Z)|(?P<room> ?)(?P<sign>{'|'.join(SIGNS)})(?={_STOP}|\Z)")
_SPACE, _NUMBER, _SIGNED = re.compile(r"\s+", re.ASCII), re.compile(NUMBER), re.compile(SIGNED)


def said(text: str, language: str) -> tuple[str, bool]:
    """text and drifted of spoken(), without looking at tokens that stay as they are."""
    tidy = _SPACE.sub(" ", text).strip(" ")
    names, stretch = UNITS[language], f" {RANGE[language]} "

    def put(m: re.Match) -> str:
        symbol = m["unit"] or SIGNS.get(m["sign"])
        if symbol is None:
            return stretch
        one, more = names[symbol]
        if one != more:
            first = m.start()
            while first and tidy[first - 1] in "0123456789.":
                first -= 1
            if first < m.start() and tidy[m.start() - 1] != "." and float(_NUMBER.findall(tidy, first, m.start())[-1]) == 1:
                more = one
        return f" {more}" if m.start() else more

    out = _CHANGES.sub(put, tidy)
    return out, _SIGNED.findall(text) != _SIGNED.findall(out)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("drifted", BooleanType())]))
def read_out(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
    """spoken() in each text's own language, for many long texts; null without a text or in a language without names."""
    made = [said(t, x) if t is not None and x in UNITS else (None, None) for t, x in zip(texts, languages)]
    return pd.DataFrame(made, columns=["text", "drifted"])
