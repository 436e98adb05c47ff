"""Fields of listings as the portals write them: areas, prices, layouts and addresses, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import house_numbers

# Grammars of areas (thousands grouped by no-break spaces only), and layouts by their code.
AREA = "(\\d{1,3}(?: \\d{3})*) ?m²"
PLOT = "s pozemkem (\\d{1,3}(?: \\d{3})*) ?m²"
LAYOUTS = {f"DISP_{n}_{k}": f"{n}+{'kk' if k == 'KK' else 1}" for n in range(1, 6) for k in ("KK", "1")} | {"DISP_6": "6+", "DISP_OTHER": "atypicky", "GARSONIERA": "garsoniéra"}
PRAHA = "hlavní město praha"


def _whole(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, " ", ""), F.lit("")).try_cast("int")


def grouped_area(text: Column) -> Column:
    """The first area of a title; '3+1 120 m²' is 120, '1 120 m²' with a no-break space is 1120."""
    return _whole(F.regexp_extract(text, AREA, 1))


def grouped_plot(text: Column) -> Column:
    return _whole(F.regexp_extract(text, PLOT, 1))


def layout_of_code(code: Column) -> Column:
    """The layout that a code stands for; an unknown code as it is, none for an empty one."""
    known = F.create_map(*(F.lit(x) for kv in LAYOUTS.items() for x in kv))
    return F.when(code == "UNDEFINED", None).otherwise(F.coalesce(known[code], F.nullif(code, F.lit(""))))


def _amount(text: Column) -> tuple[Column, Column, Column]:
    """The digits before the currency, whether it is there, and the unit after it."""
    at = F.instr(text, "Kč")
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    unit = F.when(at > 0, F.substring(text, at + 2, F.char_length(text))).otherwise("")
    return F.nullif(F.regexp_replace(before, r"\D", ""), F.lit("")).try_cast("long"), at > 0, unit


def card_price(text: Column, area: Column) -> Column:
    """The price of a card in full: a price per m² times the area; 0 for a yearly one, and where none is stated."""
    digits, _, unit = _amount(text)
    return F.when(digits.isNull(), 0).when(unit.contains("za m²"), F.coalesce(digits * area, F.lit(0))).when(unit.contains("za rok"), 0).otherwise(digits).cast("long")


def monthly_price(text: Column) -> Column:
    """The price if it is stated as a whole or by the month, else null."""
    digits, currency, unit = _amount(text)
    return F.when(currency & F.trim(unit).isin("", "/měsíc"), digits)


def typed_number(text: Column) -> Column:
    """A whole number as typed, thousands grouped by spaces or commas; null for anything else."""
    digits = F.regexp_replace(text, r"[\s ,]", "")
    return F.when(digits.rlike(r"^\d+$"), digits.try_cast("long"))


def acceptable(price: Column, currency: Column, reserved: Column, id_: Column) -> Column:
    """Whether a row states a real price: above 1, in crowns, not reserved, with an id."""
    no = F.lit(False)
    return F.coalesce(price > 1, no) & F.coalesce(currency == "CZK", no) & ~F.coalesce(reserved, no) & id_.isNotNull()


def slot_address(location: Column, title: Column) -> Column:
    """names, district, number and entrance of an address in slots, the region last.

    The last slot before the region without a digit is the district, but in Praha; dashes part names within a slot; the town
    stands at the end of the title, and if it is the district too, the district says nothing more.
    """
    trimmed = F.filter(F.transform(F.split(location, ","), lambda s: F.trim(s)), lambda s: s != "")
    in_praha = F.exists(trimmed, lambda s: F.lower(s) == PRAHA)
    slots = F.filter(trimmed, lambda s: F.lower(s) != PRAHA)
    region = lambda s: F.lower(s).endswith("kraj") | F.lower(s).startswith("kraj ")
    digit = lambda s: s.rlike(r"\d")
    parts = lambda s: F.transform(F.split(s, r"\s+[-–]\s+"), lambda x: F.trim(x))
    last = lambda i: (i == F.size(slots) - 1) | F.coalesce(region(F.try_element_at(slots, (i + 2).cast("int"))), F.lit(False))
    kept = F.transform(slots, lambda s, i: F.struct(parts(s).alias("p"), region(s).alias("region"), last(i).alias("last")))
    kept = F.filter(kept, lambda s: ~s["region"])
    states = lambda s: s["last"] & ~in_praha & (s["p"][0] != "Praha") & ~digit(s["p"][0])
    first = F.array_position(F.transform(kept, states), True)
    district = F.when(first > 0, F.element_at(kept, F.greatest(first, F.lit(1)).cast("int"))["p"][0])
    names = F.flatten(F.transform(kept, lambda s, i: F.when(i == first - 1, F.slice(s["p"], F.lit(2), F.size(s["p"]))).otherwise(s["p"])))
    town = F.when(title.contains(","), F.nullif(F.trim(F.substring_index(title, ",", -1)), F.lit("")))
    town = F.when(~digit(town), town)
    names = F.array_distinct(F.filter(F.concat(names, F.when(town.isNotNull(), F.array(town)).otherwise(F.array().cast("array<string>"))), lambda n: n != ""))
    same = F.coalesce(F.lower(town) == F.lower(district), F.lit(False))
    numbers = house_numbers(F.coalesce(F.try_element_at(slots, F.lit(1)), F.lit("")))
    return F.struct(names.alias("names"), F.when(~same, district).alias("district"), numbers["number"].alias("number"), numbers["entrance"].alias("entrance"))


def composed(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty (null if there are none)."""
    return F.nullif(F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def finest(units: dict[str, Column]) -> Column:
    """kind and code of the finest known unit; units come from the finest."""
    pick = reduce(lambda done, kv: done.when(kv[1].isNotNull(), F.struct(F.lit(kv[0]).alias("kind"), kv[1].alias("code"))), list(units.items())[1:], F.when(list(units.values())[0].isNotNull(), F.struct(F.lit(list(units)[0]).alias("kind"), list(units.values())[0].alias("code"))))
    return pick
