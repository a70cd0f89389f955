"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text, and the shape of a fee.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
FEE_PATTERN = "\u00a3[" + WHITE_SPACE + "]*([\\d,]+(?:\\.\\d+)?)"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))


def norm_text(text: Column) -> Column:
    """Key used to compare references, e-mails and phones: no outer white space, lower case."""
    return F.lower(trimmed(text))


def norm_key(text: Column) -> Column:
    """`norm_text`, with null where nothing is left, so that blanks never join."""
    return blank_to_null(norm_text(text))


def tenant_key(tenant: Column, text: Column) -> Column:
    """`norm_key` within a tenant; null where the text gives no key."""
    return F.concat(F.coalesce(tenant.cast("string"), F.lit("")), F.lit(":"), norm_key(text))


def first_nonempty(*texts: Column) -> Column:
    return F.coalesce(*[blank_to_null(t) for t in texts], F.lit(""))


def join_nonempty(separator: str, *texts: Column) -> Column:
    return F.concat_ws(separator, *[blank_to_null(t) for t in texts])


def join_names(names: Column) -> Column:
    return F.coalesce(F.array_join(names, ", ", ""), F.lit(""))


def parse_fee(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), FEE_PATTERN, 1)
    return F.replace(found, F.lit(","), F.lit(""))


def text_excerpt(text: Column, length: int = 2000) -> Column:
    return F.left(text, F.lit(length))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace every `{{key}}` literally, in the order of `values`; unknown keys stay."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(value, F.lit("")))
    return template


def recipient_list(email: Column, email2: Column, override: str | None = None) -> Column:
    if override:
        return F.array(F.lit(override))
    return F.array_compact(F.array(blank_to_null(email), blank_to_null(email2)))


def bcc_of_template(bcc: Column) -> Column:
    return blank_to_null(trimmed(bcc))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(first_nonempty(name, F.lit("file")), "[^a-zA-Z0-9._-]", "_")
