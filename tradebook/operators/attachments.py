"""Manifest of uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, safe_file_name


def attachment_manifest(uploads: DataFrame, keep: tuple = ()) -> DataFrame:
    """Container, stored name, content type and size of each upload, without its body."""
    return uploads.select(
        *keep,
        F.when(F.col("container") == "photos", "photos").otherwise("documents").alias("container"),
        F.concat(F.unix_millis("received_at").cast("string"), F.lit("-"),
                 safe_file_name(F.col("filename"))).alias("blob_name"),
        first_nonempty(F.col("content_type"), F.lit("application/octet-stream"))
        .alias("content_type"),
        F.octet_length(F.unbase64("data_base64")).cast("long").alias("size"),
    )
