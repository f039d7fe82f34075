"""Exports as bundles of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Tables, query
from ..sources import bundle
from ..sources.staging import shared_folder


@query("document_bundle", "SNK-05", oracle="SELECT 'documents/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.txt' AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def document_bundle(t: Tables) -> DataFrame:
    """Every document as a file of a bundle that was written, and read back from it."""
    path = F.concat(F.lit("documents/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".txt"))
    files = t("documents").select(path.alias("path"), F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("content"))
    folder = f"{shared_folder(t.spark)}/lakeloom-{uuid.uuid4().hex}/bundle"
    bundle.write(files, folder, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return bundle.contents(t.spark, folder).select("path", "size", "sha256")
