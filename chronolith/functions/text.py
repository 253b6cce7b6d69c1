"""Names: tokens, normal forms, simplified forms, and parts of addresses.  All are column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations of words in thoroughfare names (a closing point is optional)
THOROUGHFARE_WORDS = {
    "pl": "place", "pla": "place", "av": "avenue", "bd": "boulevard", "blvd": "boulevard", "boul": "boulevard",
    "bre": "barrière", "crs": "cours", "r": "rue", "rle": "ruelle", "rlle": "ruelle", "rte": "route",
    "pas": "passage", "pass": "passage", "all": "allée", "allee": "allée", "imp": "impasse", "mte": "montée",
    "res": "résidence", "rés": "résidence", "residence": "résidence", "résidence": "résidence",
    "s": "saint", "st": "saint", "ste": "sainte", "sts": "saints", "stes": "saintes",
    "mlle": "mademoiselle", "mme": "madame", "fg": "faubourg", "rpt": "rond-point",
    "gd": "grand", "gds": "grands", "gde": "grande", "gdes": "grandes",
    "pt": "petit", "pte": "petite", "pts": "petits", "vx": "vieux",
}
# fixed values: other whole words of thoroughfare names
THOROUGHFARE_EXACT = {
    "barriere": "barrière",
    "0": "zéro", "1": "un", "2": "deux", "3": "trois", "4": "quatre", "5": "cinq", "6": "six", "7": "sept", "8": "huit", "9": "neuf",
    "10": "dix", "11": "onze", "12": "douze", "13": "treize", "14": "quatorze", "15": "quinze", "16": "seize", "17": "dix-sept", "18": "dix-huit", "19": "dix-neuf",
    "20": "vingt", "30": "trente", "40": "quarante", "50": "cinquante", "60": "soixante", "70": "soixante-dix", "80": "quatre-vingts", "90": "quatre-vingt-dix",
    "100": "cent", "1000": "mille",
}
# fixed values: words that stay in lower case in thoroughfare names
THOROUGHFARE_LOWER = ["&", "a", "à", "au", "aux", "d", "de", "des", "du", "en", "ès", "es", "et", "l", "la", "le", "les", "lès", "ou", "sous", "sur"]
# fixed values: abbreviations in names of communes (a closing point is optional for the first five)
COMMUNE_WORDS = {"st": "saint", "ste": "sainte", "sts": "saints", "stes": "saintes", "chap": "chapelle"}
COMMUNE_EXACT = {"gd": "grand", "pt": "petit", "vx": "vieux"}
# fixed values: words that stay in lower case in names of communes
COMMUNE_LOWER = ["à", "au", "aux", "chez", "d", "de", "derrière", "des", "dessous", "dessus", "deux", "devant", "du", "en", "entre", "ès", "et", "l", "la", "le", "les", "lès", "près", "sous", "sur"]
# fixed values: words without weight, and old spellings
STOP_WORDS = ["&", "a", "à", "au", "aux", "d", "de", "des", "du", "en", "ès", "es", "et", "l", "la", "le", "les", "lès", "ou"]
OLD_SPELLINGS = {"boulevart": "boulevard", "quay": "quai", "enfans": "enfants", "fauxbourg": "faubourg"}
# fixed values: number suffixes and separators
NUMBER_SUFFIXES = {"bis": "b", "ter": "c", "quater": "d", "quinquies": "e", "sexies": "f", "septies": "g", "octies": "h", "nonies": "i", "decies": "j"}
NUMBER_MARKS = {";": "-", "/": "-"}

ELISIONS = ["d", "l"]
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def with_points(words: dict[str, str]) -> dict[str, str]:
    return words | {f"{k}.": v for k, v in words.items()}


def lookup(word: Column, table: dict[str, str]) -> Column:
    """The word's replacement, or the word."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[word], word)


def without_spaces(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def split_cell(cell: Column, sep: str = ",", trim: bool = True) -> Column:
    """Elements of a cell, blanks around them removed; none for an empty or null cell."""
    parts = F.split(cell, f"\\Q{sep}\\E", -1)
    parts = F.transform(parts, lambda x: F.trim(x)) if trim else parts
    return F.when(cell.isNull() | (cell == ""), F.array().cast("array<string>")).otherwise(parts)


def replaced_in_order(value: Column, patterns: dict[str, str], whole: bool = False) -> Column:
    """Regular expressions replaced one after another."""
    return reduce(lambda v, p: F.regexp_replace(v, f"^(?:{p[0]})$" if whole else p[0], p[1]), patterns.items(), value)


def words(label: Column, case: str | None = None) -> Column:
    """Words of a label: hyphens and blanks part them, and so does the apostrophe of a one-letter elision."""
    text = F.regexp_replace(label, "[’ʼ]", "'")
    text = F.regexp_replace(text, "[- ]+", " ")
    text = F.regexp_replace(text, "(?i)(^| )([a-z])'+", "$1$2 ")
    change = {None: lambda c: c, "lower": F.lower, "upper": F.upper, "title": F.initcap, "capitalize": capitalised}[case]
    return F.split(change(text), " ", -1)


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))


def folded(value: Column) -> Column:
    """Lower case without diacritics or ligatures."""
    low = F.lower(value)
    return F.translate(F.replace(F.replace(low, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")), ACCENTED, PLAIN)


def normal_commune(name: Column) -> Column:
    table = with_points(COMMUNE_WORDS) | COMMUNE_EXACT
    low = F.array(*[F.lit(x) for x in COMMUNE_LOWER])
    tokens = words(name, "lower")

    def joiner(w: Column, i: Column) -> Column:
        return F.when(i == F.size(tokens) - 1, "").when(w.isin(ELISIONS), "'").when((i == 0) & F.array_contains(low, w), " ").otherwise("-")

    def one(w: Column, i: Column) -> Column:
        before = joiner(F.get(tokens, i - 1), i - 1)
        raised = ~F.array_contains(low, w) | (i == 0) | (before == " ")
        return F.concat(F.when(raised, capitalised(lookup(w, table))).otherwise(w), joiner(w, i))

    return F.array_join(F.transform(tokens, one), "")


def normal_thoroughfare(name: Column) -> Column:
    table = with_points(THOROUGHFARE_WORDS) | THOROUGHFARE_EXACT
    low = F.array(*[F.lit(x) for x in THOROUGHFARE_LOWER])

    def one(w: Column) -> Column:
        word = lookup(w, table)
        word = F.when(F.array_contains(low, word), word).otherwise(capitalised(word))
        return F.when(F.lower(word).isin(ELISIONS), F.concat(word, F.lit("'"))).otherwise(word)

    return F.replace(F.array_join(F.transform(words(name, "lower"), one), " "), F.lit("' "), F.lit("'"))


def normal_number(name: Column, compat: bool = False) -> Column:
    """Lower case without blanks; suffix words become letters.  compat: suffixes in the listed order, so that "quater" is hit by "ter", and only the first three."""
    order = list(NUMBER_SUFFIXES.items())
    order = order[:3] if compat else sorted(order, key=lambda x: -len(x[0]))
    return replaced_in_order(F.replace(F.lower(name), F.lit(" "), F.lit("")), dict(order) | NUMBER_MARKS)


def simplified_landmark(name: Column, keep_spaces: bool = True, keep_diacritics: bool = True, sort_characters: bool = False) -> Column:
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    tokens = F.transform(words(name, "lower"), lambda w: F.replace(w, F.lit("'"), F.lit("")))
    tokens = F.filter(tokens, lambda w: ~F.array_contains(stop, w))
    if not keep_diacritics:
        tokens = F.transform(tokens, folded)
    out = F.array_join(F.transform(tokens, lambda w: lookup(w, OLD_SPELLINGS)), " " if keep_spaces else "")
    return F.array_join(F.array_sort(F.split(out, "")), "") if sort_characters else out


def normal_name(name: Column, kind: Column, lang: Column, compat: bool = False) -> Column:
    """By language and kind (number, thoroughfare, area); null where there is no rule."""
    french = F.when(kind == "number", F.lower(name)).when(kind == "thoroughfare", normal_thoroughfare(name)).when(kind == "area", normal_commune(name))
    return F.when(lang.isNull() & (kind == "number"), normal_number(name, compat)).when(lang == "fr", french)


def simplified_name(name: Column, kind: Column, lang: Column) -> Column:
    french = F.when(kind == "number", without_spaces(name)).when(kind.isin("thoroughfare", "area"), simplified_landmark(name, False, False))
    return F.when(lang.isNull() & (kind == "number"), without_spaces(name)).when(lang == "fr", french)


def split_address(address: Column) -> tuple[Column, Column]:
    """(number or null, street) of a French address."""
    pattern = r"(?i)^(\d+\s*(?:[A-Za-z]|bis|ter|quater)?)\s+(.*)"
    number = F.trim(F.regexp_extract(address, pattern, 1))
    return F.when(number != "", number), F.trim(F.when(number != "", F.regexp_extract(address, pattern, 2)).otherwise(address))


def kind_of_name(landmark_type: Column) -> Column:
    return (
        F.when(landmark_type == "Thoroughfare", "thoroughfare")
        .when(landmark_type.isin("Municipality", "District", "PostalCodeArea"), "area")
        .when(landmark_type.isin("HouseNumber", "StreetNumber", "DistrictNumber"), "number")
    )


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length (an approximation of block matching, native)."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def block_ratio():
    """A pandas UDF for the ratio of matching blocks of two texts; no built-in expresses its recursion."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio
