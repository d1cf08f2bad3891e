"""Column expressions over messy text: names, numbers in cells, codes, units."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining marks. Spark has no such built-in."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalise_name(c: Column, marks: bool = True) -> Column:
    """Lower case without marks, the word for the unit, punctuation and repeated blanks; hyphens and underscores are blanks."""
    x = F.lower(F.trim(strip_marks(c) if marks else c))
    for word in (" district", " dist.", " dist"):
        x = F.replace(x, F.lit(word), F.lit(""))
    x = F.translate(x, "-_", "  ")
    return F.trim(F.regexp_replace(F.translate(x, ".,", ""), r"\s+", " "))


def alnum_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def numeric_cell(c: Column) -> Column:
    """A number in a table cell: leading letters and thousands separators go; NA, '-' and blank are null."""
    x = F.regexp_replace(F.regexp_replace(F.trim(c), "^[A-Za-z]+", ""), ",", "")
    return F.when(F.upper(F.trim(c)).isin("NA", "N/A", "-", ""), F.lit(None).cast("double")).otherwise(x.try_cast("double"))


def digits_number(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("double")


def code(c: Column, pattern: str = r"\b(\d{6})\b", group: int = 1) -> Column:
    """The first match of a code, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), F.lit(-1)).try_cast("double")


def unit_value(c: Column, unit: str = r"\(%\)|Rs\.") -> Column:
    """The number after the unit, or the last one of the line; '*' and 'na' are null."""
    after = F.regexp_extract(c, rf"(?:{unit})\s*\(?([0-9,]+(?:\.[0-9]+)?|\*|na)", 1)
    return F.when(after != "", F.replace(after, F.lit(","), F.lit("")).try_cast("double")).otherwise(last_number(c))


def _printed(token: Column, none: list[str]) -> Column:
    """struct(said, value) of one printed token: whether it is a number (marks around and inside it do not count) or a sign for none, and its value."""
    bare = F.translate(token, "(),", "")
    digits = (F.translate(bare, "0123456789.", "") == "") & (F.translate(bare, ".", "") != "")
    value = F.when(digits, bare.try_cast("double"))
    return F.struct((value.isNotNull() | F.lower(token).isin([n.lower() for n in none])).alias("said"), value.alias("value"))


def unit_values(c: Column, units: list[str] = ("%", "Rs."), none: list[str] = ("*", "na")) -> Column:
    """struct(now, before): the two values that follow a unit in parentheses.

    The unit is the first parenthesis whose content begins with one of ``units``, in any case. What follows it is split on blanks: the first token is the value, the second the earlier one, if
    they are numbers or signs for none (which are null). Without a unit, or without a value right after it: the last number of the line, and null.
    """
    closed = F.split(c, r"\)")  # every piece but the last ends at a closing parenthesis
    inside = F.transform(closed, lambda p: F.lower(F.trim(F.when(F.contains(p, F.lit("(")), F.substring_index(p, "(", -1)))))
    is_unit = lambda p: F.coalesce(F.array_contains(F.transform(F.array(*[F.lit(u.lower()) for u in units]), lambda u: F.startswith(p, u)), True), F.lit(False))
    at = F.array_position(F.transform(F.slice(inside, F.lit(1), F.greatest(F.size(inside) - 1, F.lit(0))), is_unit), True).cast("int")
    after = F.trim(F.array_join(F.slice(closed, at + 1, F.size(closed)), ")"))
    tokens = F.split(after, r"\s+")
    first, second = (_printed(F.try_element_at(tokens, F.lit(k)), list(none)) for k in (1, 2))
    hit = (at > 0) & F.coalesce(first["said"], F.lit(False))
    numbers = F.filter(F.transform(F.split(F.translate(c, ",", ""), r"[^0-9.]+"), lambda t: F.rtrim(t, F.lit(".")).try_cast("double")), lambda v: v.isNotNull())
    return F.struct(F.when(hit, first["value"]).otherwise(F.try_element_at(numbers, F.lit(-1))).alias("now"), F.when(hit & second["said"], second["value"]).alias("before"))


def trailing_number(c: Column) -> Column:
    """The last number of a line whose item number, as in '12.' or '12)', is no value."""
    return last_number(F.regexp_replace(c, r"^\s*[0-9]+[.)]\s+", ""))


def header_names(lines: Column, path: Column, title: str, titles: list[str], prefix: str, depth: int = 15) -> Column:
    """struct(name, grp) from a document's first ``depth`` lines, or from its file's name.

    The heading is the first line that holds ``title``, blanks and case aside (words that were torn apart pass). Below it stand the name and the group, unless the line right below is empty or has one
    of the words ``titles``, which only other headings have. Else the file's name says them: after ``prefix``, the group up to the next underscore, then the name up to a double underscore or the end.
    """
    flat = lambda x: F.lower(F.translate(x, " \t\u00a0", ""))
    at = F.array_position(F.transform(F.slice(lines, 1, depth), lambda x: F.contains(flat(x), flat(F.lit(title)))), True).cast("int")
    below = lambda k: F.nullif(F.trim(F.try_element_at(lines, F.nullif(at, F.lit(0)) + k)), F.lit(""))
    other = F.array_contains(F.transform(F.array(*[F.lit(w.lower()) for w in titles]), lambda w: F.contains(F.lower(below(1)), w)), True)
    headed = below(1).isNotNull() & ~F.coalesce(other, F.lit(False))
    file = F.substring_index(path, "/", -1)
    stem = F.when(F.contains(file, F.lit(".")), F.substring(file, F.lit(1), F.length(file) - F.length(F.substring_index(file, ".", -1)) - 1)).otherwise(file)
    said = F.when(F.contains(stem, F.lit(prefix)), F.substring_index(F.substring_index(stem, prefix, -1), "__", 1))
    grp = F.substring_index(said, "_", 1)
    of_file = F.struct(F.nullif(F.trim(F.substring(said, F.length(grp) + 2, F.length(said))), F.lit("")).alias("name"), F.nullif(F.trim(grp), F.lit("")).alias("grp"))
    both = of_file["name"].isNotNull() & of_file["grp"].isNotNull()
    return F.struct(F.when(headed, below(1)).when(both, of_file["name"]).alias("name"), F.when(headed, below(2)).when(both, of_file["grp"]).alias("grp"))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return F.coalesce(c.rlike("^(" + "|".join(prefixes) + ")"), F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))


def matches_except(c: Column, pattern: str, exclusion: str | None) -> Column:
    hit = F.coalesce(c.rlike(pattern), F.lit(False))
    return hit if exclusion is None else hit & ~F.coalesce(c.rlike(exclusion), F.lit(False))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length."""
    return 1.0 - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)).cast("double"), F.lit(0.0))


def both_ways(a: Column, b: Column) -> Column:
    """Whether either name contains the other; a missing hint passes."""
    return a.isNull() | (a == "") | a.contains(b) | b.contains(a)
