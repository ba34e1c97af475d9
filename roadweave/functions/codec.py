"""Text codecs: delimited parallel lists, yearly records, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even, number, whole

# Weight of each road class; any other class weighs 1.
CLASS_WEIGHTS = {
    "Autoroute": 4,
    "Nationale": 3,
    "Régionale": 2,
    "Collectrice": 2,
    "Accès aux ressources": 1,
    "Accès aux ressources et aux localités isolées": 1,
    "Sans classe": 1,
    "Local 1": 1,
    "Local 2": 1,
    "Local 3": 1,
}
# The classes that have a feature of their own; others count as the last.
ROAD_CLASSES = ["Autoroute", "Nationale", "Régionale", "Collectrice", "Autre"]


def lookup(key: Column, table: dict, default) -> Column:
    """Value of ``key`` in a small literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default)) if pairs else F.lit(default)


def encode_list(values: Column, sep: str = "|") -> Column:
    """Join an array's values; nulls are written as None, an empty array is null."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: v.cast("string")), sep, "None"))


def encode_value_year(value: Column, year: Column) -> Column:
    """``value@year`` with the value cut to an integer; ``?`` without year, ``NA`` without value."""
    return F.coalesce(F.concat(value.cast("bigint").cast("string"), F.lit("@"), F.coalesce(year.cast("bigint").cast("string"), F.lit("?"))), F.lit("NA"))


def _tokens(text: Column, sep: str) -> Column:
    """Trimmed tokens; of null or empty text none."""
    split = F.transform(F.split(text, "\\" + sep, -1), lambda t: F.trim(t))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(split)


def _value(token: Column) -> Column:
    missing = (token == "") | (F.upper(token) == "NA")
    return F.when(~missing, number(F.substring_index(token, "@", 1)))


def parse_values(text: Column, sep: str = "|") -> Column:
    """Numbers of ``value@year`` tokens; NA, empty and unreadable tokens are skipped."""
    return F.filter(F.transform(_tokens(text, sep), _value), lambda v: v.isNotNull())


def _parallel(text: Column, other: Column, sep: str) -> tuple[Column, Column]:
    """The tokens of both texts, to the shorter; (tokens of the first, none) where the second is absent.

    Only whole arrays are made of the texts: a term that splits them must never stand inside a lambda, where every element would split anew.
    """
    first, second = _tokens(text, sep), _tokens(other, sep)
    absent = other.isNull() | (other == "")
    n = F.when(absent, F.size(first)).otherwise(F.least(F.size(first), F.size(second)))
    return F.slice(first, F.lit(1), n), F.slice(second, F.lit(1), n)


def parse_pairs(text: Column, other: Column, sep: str = "|") -> Column:
    """array<struct<pos, value, paired>>: two lists read in parallel to the shorter; rows without value are skipped.

    A missing second list pairs every value with null.
    """
    both = F.zip_with(*_parallel(text, other, sep), lambda a, b: F.struct(_value(a).alias("value"), _value(b).alias("paired")))
    rows = F.transform(both, lambda r, i: F.struct((i + 1).alias("pos"), r["value"].alias("value"), r["paired"].alias("paired")))
    return F.filter(rows, lambda r: r["value"].isNotNull())


def parse_weighted(text: Column, classes: Column, weights: dict = CLASS_WEIGHTS, sep: str = "|") -> Column:
    """array<struct<value, weight>>: a value list zipped, to the shorter, with a class list turned into weights."""
    both = F.zip_with(*_parallel(text, classes, sep), lambda a, b: F.struct(_value(a).alias("value"), lookup(F.coalesce(b, F.lit("")), weights, 1).alias("weight")))
    return F.filter(both, lambda r: r["value"].isNotNull())


def component(text: Column, key: str) -> Column:
    """What stands after ``key:`` up to the next slash, trimmed; empty if absent."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in key)
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), quoted + ":([^/]*)", 1))


def leading_year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{4})", 1)


def year_record(text: Column, djma: Column, cam: Column, first: bool) -> Column:
    """The yearly record rebuilt with a completed count and truck share; its other parts are kept, ``30e h`` in slot 1 only."""
    count = F.coalesce(whole(djma).cast("string"), F.lit(""))
    share = F.when(cam.isNull(), "").otherwise(F.format_string("%.1f", half_even(cam, 1)))
    parts = [leading_year(text), F.lit(" DJMA:"), count, F.lit(" / DJME:"), component(text, "DJME"), F.lit(" / DJMH:"), component(text, "DJMH"), F.lit(" / %cam:"), share]
    return F.concat(*parts, *([F.lit(" / 30e h:"), component(text, "30e h")] if first else []))


def migrate_prefix(text: Column, rules: dict[str, str]) -> Column:
    """Replace a leading prefix by the first rule that fits; what follows is kept."""
    out = text
    for old, new in reversed(rules.items()):
        out = F.when(F.startswith(text, F.lit(old)), F.concat(F.lit(new), F.substring(text, F.lit(len(old) + 1), F.length(text)))).otherwise(out)
    return out


def relabel(name: Column, labels: dict[str, str]) -> Column:
    """Exact names replaced by a small map, others kept."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name


def one_hot(name: Column, classes: list[str], prefix: str = "route_") -> dict[str, Column]:
    """A 0/1 DOUBLE column for each class; unknown and null names count as the last."""
    known = F.when(name.isin(classes), name).otherwise(F.lit(classes[-1]))
    return {prefix + c: (known == c).cast("double") for c in classes}


def one_hot_decode(columns: list[str], prefix: str = "route_") -> Column:
    """The class whose column is largest, the first of equals."""
    values = F.array(*columns)
    names = F.array(*[F.lit(c.removeprefix(prefix)) for c in columns])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def completeness(n: Column, slots: int = 10) -> Column:
    """Vide, Partiel or Complet by the number of known slots."""
    return F.when(n == 0, "Vide").when(n >= slots, "Complet").otherwise("Partiel")


def segment_class(n: Column) -> Column:
    """Right-closed classes of a count; null below 1."""
    return F.when(n <= 0, None).when(n <= 3, "1–3").when(n <= 6, "4–6").when(n <= 10, "7–10").when(n <= 18, "11–18").when(n > 18, "19+")
