"""Reads over entity tables: listing, lookup, decoding, overlay, singletons and blob arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import kind_of, parsed
from ..functions.text import text_excerpt
from .prefix import ranged_rank

# Columns that overrule the document field of the given name.
CUSTOMER_COLUMNS = {"id": "id", "name": "name", "stage": "stage", "createdAt": "created_at"}
JOB_COLUMNS = {
    "id": "id", "customerId": "customer_id", "title": "title", "status": "status",
    "createdAt": "created_at",
}


def list_entities(df: DataFrame, tenant_id: int) -> DataFrame:
    """Rows of a tenant, newest first (range-partitioned sort, no single-task step)."""
    return df.filter(F.col("tenant_id") == tenant_id).orderBy(
        F.col("created_at").desc(), F.col("id").desc()
    )


def rank_entities(df: DataFrame) -> DataFrame:
    """Position of every row in its tenant's newest-first list, for all tenants at once."""
    newest, id_desc = -F.unix_micros("created_at"), -F.col("id")
    return ranged_rank(df, ["tenant_id"], [newest, id_desc], "position")


def get_entities(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Bulk lookup of `(id, tenant_id)` requests; `found` is false where there is no such row."""
    hit = df.withColumn("found", F.lit(True))
    return requests.join(hit, ["id", "tenant_id"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def decode_entity(
    df: DataFrame, doc_schema: str, columns: dict[str, str] | None = None, keep: tuple = ()
) -> DataFrame:
    """Document fields as columns.

    With `columns` (document field -> table column) the table columns overrule the document;
    without, the document alone speaks. `keep` names table columns to carry along; they must not
    share a name with a document field.
    """
    overlay = columns or {}
    doc = F.from_json("data_json", doc_schema)
    parsed_df = df.withColumn("_doc", doc)
    fields = parsed_df.schema["_doc"].dataType.fieldNames()
    shown = [F.col(f"_doc.{f}").alias(f) for f in fields if f not in overlay]
    shown += [F.col(c).alias(f) for f, c in overlay.items()]
    return parsed_df.select(*[F.col(k) for k in keep], *shown, F.col("data_json").alias("raw"))


def scan_jobs_pruned(df: DataFrame) -> DataFrame:
    return df.select("id", "data_json")


def split_json(df: DataFrame, column: str = "data_json") -> tuple[DataFrame, DataFrame]:
    """Rows whose document can be read, and the others with a reason and an excerpt."""
    document = parsed(F.col(column))
    reason = F.when(document.isNull(), "not json").when(kind_of(document) == "null", "json null")
    marked = df.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).drop("reason")
    rejects = marked.filter(F.col("reason").isNotNull()).withColumn(
        "excerpt", text_excerpt(F.col(column))
    )
    return good, rejects


def get_singleton(tenants: DataFrame, singletons: DataFrame, default: str | None) -> DataFrame:
    """Document of each tenant, or the default (`[]`, or null) where it has none."""
    found = singletons.select("tenant_id", F.col("data_json").alias("doc"))
    return tenants.select("tenant_id").join(found, "tenant_id", "left").withColumn(
        "doc", F.coalesce("doc", F.lit(default).cast("string"))
    )


def explode_blob_array(df: DataFrame, element_array: str, outer: bool = False) -> DataFrame:
    """One row per element of the array documents, with its position."""
    explode = F.posexplode_outer if outer else F.posexplode
    other = [c for c in df.columns if c != "data_json"]
    entries = df.select(*other, explode(F.from_json("data_json", element_array)).alias("pos", "_e"))
    return entries.select(*other, "pos", "_e.*")


def filter_by(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The promoted columns are real columns, so this filter reaches the Parquet scan."""
    return df.filter(F.col(column).isin(values))
