"""What a model's profile (a YAML text) says, found by its lines.

Lines are compared without the white space around them; nothing but what is
asked for is read.  A null text says nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The key of the list of symbols, and how many there may be.
DICTIONARY = "character_dict:"
MAX_SYMBOLS = 436
# White space.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """What ``f`` makes of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; what follows the last line feed is one unless it is empty."""
    whole = lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    last = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(_once(F.split(text, "\n", -1), last), whole)


def has_key(text: Column, key: str) -> Column:
    """Whether a line is the key alone."""
    return F.coalesce(F.exists(lines(text), lambda x: _trimmed(x) == f"{key}:"), F.lit(False))


def values(text: Column, key: str) -> Column:
    """What stands after the key, for each line that begins with it."""
    found = F.filter(F.transform(lines(text), _trimmed), lambda x: x.startswith(f"{key}:"))
    return F.transform(found, lambda x: _trimmed(F.substring(x, F.lit(len(key) + 2), F.length(x))))


def has_value(text: Column, key: str, value: str) -> Column:
    return F.coalesce(F.array_contains(values(text, key), value), F.lit(False))


def optional_true(text: Column, key: str) -> Column:
    """Whether the key is left out, or there once with true."""
    fine = lambda v: (F.size(v) == 0) | ((F.size(v) == 1) & (F.get(v, F.lit(0)) == "true"))
    return F.coalesce(_once(values(text, key), fine), F.lit(False))


def numbers(text: Column) -> Column:
    """The list items that are whole numbers of 32 bits, in their order, whatever list they are in; an item may itself begin with a dash."""
    items = F.filter(F.transform(lines(text), _trimmed), lambda x: x.startswith("- "))
    items = F.transform(items, lambda x: F.regexp_replace(F.substring(x, F.lit(3), F.length(x)), r"\A- ", ""))
    whole = F.filter(items, lambda x: x.rlike(r"\A\+?[0-9]+\z"))
    return F.filter(F.transform(whole, lambda x: x.try_cast("decimal(38,0)").try_cast("bigint")), lambda x: x.isNotNull() & (x < 1 << 32))


def has_sequence(text: Column, wanted: list[int]) -> Column:
    """Whether the numbers have these in a row."""
    want = F.array(*(F.lit(x).cast("bigint") for x in wanted))

    def found(n: Column) -> Column:
        starts = F.when(F.size(n) >= len(wanted), F.sequence(F.lit(1), F.size(n) - len(wanted) + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: F.slice(n, i, F.lit(len(wanted))) == want)

    return F.coalesce(_once(numbers(text), found), F.lit(False))


def _symbol(item: Column) -> Column:
    """The text of a list item: quoted either way or plain; null where it is empty, a comment or badly quoted."""
    quoted = _once(F.try_parse_json(item), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    single = F.replace(F.substring(item, F.lit(2), F.length(item) - 2), F.lit("''"), F.lit("'"))
    return (
        F.when(item.startswith('"'), quoted)
        .when(item.startswith("'") & item.endswith("'") & (F.length(item) >= 2), single)
        .when((item == "") | item.startswith("#"), F.lit(None))
        .otherwise(item)
    )


def _indent(x: Column) -> Column:
    return F.length(x) - F.length(F.ltrim(x))


def dictionary(text: Column) -> Column:
    """The symbols of the list under ``character_dict``, in their order; null for a profile that isn't as it has to be.

    The list ends with the first line that is indented less than its key or is no
    item; blank lines don't count.  Without the key, with a tab in the key's line
    or in one up to that end, a bad item or more than 436, it is null.
    """

    def of_lines(all_: Column, at: Column) -> Column:
        head = F.get(all_, at - 1)
        rest = F.transform(F.slice(all_, at + 1, F.greatest(F.size(all_) - at, F.lit(0))), lambda x: F.struct(x.alias("line"), _trimmed(x).alias("bare")))
        return F.when((at > 0) & ~head.contains("\t"), _once(_indent(head), lambda least: _once(F.filter(rest, lambda x: x["bare"] != ""), lambda r: of_rest(r, least))))

    def of_rest(rest: Column, least: Column) -> Column:
        kind = lambda x: F.when(x["line"].contains("\t"), "tab").when((_indent(x["line"]) < least) | ~x["bare"].startswith("- "), "end").otherwise("item")
        # Where the list ends: the first that is no item, and whether that is a tab.
        ends = F.filter(F.transform(rest, lambda x, i: F.struct(i.alias("at"), kind(x).alias("kind"))), lambda z: z["kind"] != "item")
        return _once(F.get(ends, F.lit(0)), lambda end: F.when(~F.coalesce(end["kind"] == "tab", F.lit(False)), _once(F.coalesce(end["at"], F.size(rest)), lambda n: of_items(rest, n))))

    def of_items(rest: Column, n: Column) -> Column:
        item = lambda x: _trimmed(F.substring(x["bare"], F.lit(3), F.length(x["bare"])))
        symbols = F.transform(F.slice(rest, F.lit(1), n), lambda x: _once(item(x), _symbol))
        return F.when(n <= MAX_SYMBOLS, _once(symbols, lambda s: F.when(F.forall(s, lambda x: x.isNotNull()), s)))

    return _once(lines(text), lambda all_: _once(F.array_position(F.transform(all_, _trimmed), DICTIONARY).cast("int"), lambda at: of_lines(all_, at)))
