"""Text functions: name normalisation and the grammars of listing texts, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters with marks of Central European languages, and the same letters without.
MARKED = "áäčďéěëíľĺňóôöőřŕšťúůüűýžàâçèêîïñûùÁÄČĎÉĚËÍĽĹŇÓÔÖŐŘŔŠŤÚŮÜŰÝŽÀÂÇÈÊÎÏÑÛÙ"
PLAIN = "aacdeeeillnoooorrstuuuuyzaaceeiinuuAACDEEEILLNOOOORRSTUUUUYZAACEEIINUU"

# The grammars of listing texts: living area, plot, number with entrance, layout, and what separates address parts.
SIZE = r"(\d+)\s*m[2²]"
PLOT = r"(?i)pozemek\s+([\d\s\u00a0]+)\s*m[2²]"
NUMBER_AND_ENTRANCE = r"(\d+[a-zA-Z]?)\s*/\s*(\d+[a-zA-Z]?)$"
LAYOUT = r"^([1-9])\s*\+\s*(kk|1)$"
PART_DASH = r"\s+[-–]\s+"
# Fixed value: a house number in a normalised name.
HOUSE_NUMBER = r"\b\d+[a-z]?(\s*/\s*\d+[a-z]?)?\b"


def collapse(text: Column) -> Column:
    """Runs of white space (no-break spaces too) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def normalize_name(text: Column) -> Column:
    """Lower case, no marks, single spaces; null stays null."""
    return F.lower(F.translate(collapse(text), MARKED, PLAIN))


@F.pandas_udf(StringType())
def normalize_name_exact(names: pd.Series) -> pd.Series:
    """The same for all of Unicode: case folding, decomposition, no combining marks."""

    def one(name):
        if name is None:
            return None
        parts = unicodedata.normalize("NFD", " ".join(name.split()).casefold())
        return "".join(c for c in parts if unicodedata.category(c) != "Mn")

    return names.map(one)


def slug(text: Column) -> Column:
    return F.replace(normalize_name(text), F.lit(" "), F.lit("-"))


def candidate_names(names: Column) -> Column:
    """Each name, and the name without the house numbers in it, normalised; in order, without repeats or blanks."""
    own = lambda n: F.array(normalize_name(n), collapse(F.regexp_replace(normalize_name(n), HOUSE_NUMBER, " ")))
    return F.array_distinct(F.filter(F.flatten(F.transform(names, own)), lambda n: n != ""))


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def size_m2(text: Column) -> Column:
    """The first number before m² or m2."""
    return _number(F.regexp_extract(text, SIZE, 1))


def land_m2(text: Column) -> Column:
    """The number after the word for a plot, its thousands grouped by spaces."""
    return _number(F.regexp_replace(F.regexp_extract(text, PLOT, 1), r"[\s ]", ""))


def house_numbers(text: Column) -> Column:
    """number and entrance of an address that ends in a/b; a repeated number is the number alone."""
    first, second = (F.nullif(F.regexp_extract(text, NUMBER_AND_ENTRANCE, k), F.lit("")) for k in (1, 2))
    return F.struct(first.alias("number"), F.when(first != second, second).alias("entrance"))


def layout_code(text: Column) -> Column:
    """Canonical layout: 'n+kk', 'n+1' or 'atypical'; null if the text is none."""
    name = normalize_name(text)
    rooms, kitchen = (F.regexp_extract(name, LAYOUT, k) for k in (1, 2))
    return F.when(name.isin("garsoniera", "garsonka"), "1+kk").when(name == "atypicky", "atypical").when(rooms != "", F.concat(rooms, F.lit("+"), kitchen))


def split_address(text: Column) -> Column:
    """names (distinct, in order) and district of a free-text address: parts between commas and spaced dashes; 'okres X' names the
    district, the last one if there are several."""
    parts = F.filter(F.transform(F.flatten(F.transform(F.split(text, ","), lambda p: F.split(p, PART_DASH))), collapse), lambda p: p != "")
    stated = lambda p: F.lower(p).startswith("okres ")
    last = F.try_element_at(F.filter(parts, stated), F.lit(-1))
    district = F.trim(F.substring(last, F.lit(7), F.char_length(last)))
    return F.struct(F.array_distinct(F.filter(parts, lambda p: ~stated(p))).alias("names"), district.alias("district"))


def capitalized(text: Column) -> Column:
    text = collapse(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.char_length(text)))


def joined(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, with the separator between them."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def display_place(*finest_first: Column) -> Column:
    """The two finest distinct names, with a comma between them; null without a name."""
    names = F.array_distinct(F.array_compact(F.array(*finest_first)))
    return F.nullif(F.array_join(F.slice(names, 1, 2), ", "), F.lit(""))
