"""Expressions over JSON documents: typed reads, truth tests and edits that keep unknown fields."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

_FIELDS = "map<string,variant>"


# ---- parsing ---------------------------------------------------------------------------------

def parsed(text: Column) -> Column:
    """VARIANT of a JSON text; null where the text is no JSON."""
    return F.try_parse_json(text)


# Type names of parsed JSON values.
_KINDS = {
    "STRING": "text", "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "array", "OBJECT": "object",
    "TINYINT": "number", "SMALLINT": "number", "INT": "number", "BIGINT": "number",
    "DECIMAL": "number", "FLOAT": "number", "DOUBLE": "number",
}
_FALSY = r'^(null|false|""|-?0(\.0+)?([eE][+-]?[0-9]+)?)$'


def kind_of(value: Column) -> Column:
    """One of text, number, boolean, array, object, null; null for an absent value."""
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_truthy(value: Column) -> Column:
    """False for absent, null, false, 0 and the empty text; `{}` and `[]` count as present."""
    return F.coalesce(~F.to_json(value).rlike(_FALSY), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def truthy_non_text(value: Column) -> Column:
    """A present value that text functions cannot be applied to."""
    return F.when(is_text(value), F.lit(False)).otherwise(is_truthy(value))


def present_text(value: Column) -> Column:
    """Text of a truthy value, null for any other."""
    return F.when(is_text(value) | is_truthy(value), blank_to_null(text_of(value)))


def text_or_blank(value: Column) -> Column:
    return F.when(is_text(value), text_of(value)).otherwise(F.lit(""))


# ---- lists of name/value pairs ---------------------------------------------------------------

def first_of(names: Column, values: Column, name: str) -> Column:
    """The value at the first place of `name`, null where there is none."""
    at = F.nullif(F.array_position(names, F.lit(name)), F.lit(0))
    return F.try_element_at(values, at.cast("int"))


def kv_pivot(pairs: Column, name: str) -> Column:
    """Value of the last pair called `name`."""
    return first_of(F.reverse(pairs["name"]), F.reverse(pairs["value"]), name)


# ---- numbers ---------------------------------------------------------------------------------

def number_text(value: Column) -> Column:
    """Shortest decimal text of a double, without exponent in the usual range."""
    java = value.cast("string")
    whole = F.regexp_replace(java, r"\.0$", "")
    plain = F.when(
        F.abs(value) >= 1, java.try_cast("decimal(38,16)").cast("string")
    ).otherwise(F.format_string("%s", java.try_cast("decimal(38,30)")))
    stripped = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.regexp_replace(
        F.regexp_replace(F.lower(java), r"\.0e", "e"), r"e(\d)", "e+$1"
    )
    usual = (F.abs(value) >= 1e-6) & (F.abs(value) < 1e21)
    return (
        F.when(~java.contains("E"), whole)
        .when(usual, F.coalesce(stripped, scientific))
        .otherwise(scientific)
    )


def positive_price_text(price: Column) -> Column:
    """Text of a JSON number above zero; empty for anything else, quoted numbers included."""
    amount = F.when(kind_of(price) == "number", F.try_variant_get(price, "$", "double"))
    # The amount is bound to a variable, since its text is put together from several of its forms.
    texts = F.transform(F.array(amount), lambda a: F.when(a > 0, number_text(a)))
    return F.coalesce(texts[0], F.lit(""))


# ---- small rules on decoded fields -----------------------------------------------------------

def default_on_flag(flag: Column) -> Column:
    """A switch is on unless it is the JSON value false."""
    return F.coalesce(flag, F.lit(True))


def is_booked(date: Column, fitter: Column) -> Column:
    return blank_to_null(date).isNotNull() & blank_to_null(fitter).isNotNull()


def is_install_booked(date: Column, fitters: Column) -> Column:
    return blank_to_null(date).isNotNull() & (F.coalesce(F.size(fitters), F.lit(0)) > 0)


def is_sent(mark: Column) -> Column:
    return F.coalesce(mark["status"] == "sent", F.lit(False))


def derive_stage(price_text: Column) -> Column:
    return F.when(blank_to_null(price_text).isNotNull(), "Quoted").otherwise("New Enquiry")


def redact_map(secrets: Column, viewer_role: Column) -> Column:
    """For every viewer but the office: whether a secret is set, as `true` or empty text."""
    hidden = F.transform_values(
        secrets, lambda _, v: F.when(F.coalesce(v, F.lit("")) != "", "true").otherwise("")
    )
    return F.when(F.coalesce(viewer_role == "office", F.lit(False)), secrets).otherwise(hidden)


# ---- edits -----------------------------------------------------------------------------------

def fields_of(document: Column) -> Column:
    """Top-level fields; an empty map where the value is no object."""
    return F.coalesce(document.try_cast(_FIELDS), F.map_from_arrays(F.array(), F.array()).cast(_FIELDS))


def with_fields(document: Column, changes: dict[str, Column]) -> Column:
    """The object with some top-level fields replaced; all other fields are kept as they are."""
    names = list(changes)
    kept = F.map_filter(fields_of(document), lambda k, _: ~k.isin(names))
    new = F.create_map(*[c for n in names for c in (F.lit(n), changes[n])])
    return F.to_variant_object(F.map_concat(kept, new))


def with_nonempty_fields(document: Column, texts: dict[str, Column]) -> Column:
    """The object with top-level text fields replaced where the new text is not empty."""
    new = F.map_filter(
        F.create_map(*[c for n, t in texts.items()
                       for c in (F.lit(n), blank_to_null(t).cast("variant"))]),
        lambda _, v: v.isNotNull(),
    )
    kept = F.map_filter(fields_of(document), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.to_variant_object(F.map_concat(kept, new))


def with_path(document: Column, path: list[str], value: Column) -> Column:
    """The object with the value at a nested path replaced; missing parents are created."""
    head, rest = path[0], path[1:]
    if rest:
        value = with_path(F.try_variant_get(document, f"$.{head}", "variant"), rest, value)
    return with_fields(document, {head: value})


def with_marked_paths(document: Column, changes: list[tuple[list[str], Column, Column]]) -> Column:
    """`with_path` for every `(path, flag, value)` whose flag is set (it is not null), each object rebuilt once.

    No path may begin another one.
    """
    below: dict[str, list[tuple[list[str], Column, Column]]] = {}
    for path, flag, value in changes:
        below.setdefault(path[0], []).append((path[1:], flag, value))
    replaced, entries = [], []
    for head, found in below.items():
        flag = reduce(or_, [f for _, f, _ in found])
        if found[0][0]:
            value = with_marked_paths(F.try_variant_get(document, f"$.{head}", "variant"), found)
        else:
            value = found[0][2]
        replaced.append((head, flag))
        entries.append(F.when(flag, F.struct(F.lit(head).alias("key"), value.alias("value"))))
    kept = F.map_filter(fields_of(document), lambda k, _: ~reduce(or_, [(k == h) & flag for h, flag in replaced]))
    return F.to_variant_object(F.map_concat(kept, F.map_from_entries(F.array_compact(F.array(*entries)))))


def text_value(text: Column) -> Column:
    """VARIANT holding a text."""
    return text.cast("variant")
