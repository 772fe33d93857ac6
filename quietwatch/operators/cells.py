"""Cell priors: a volunteer-built layer that can add context and never a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_KEY = ("mcc", "mnc", "lac", "cell_id")


def lookup_cells(rows: DataFrame, layer: DataFrame | None) -> DataFrame:
    """Add ``cell_status`` (found, no_record, layer_disabled) and ``cell_evidence``.

    A found record is always weak; a missing record is no evidence at all, not negative evidence.
    ``layer``: the cell key, range_m, samples, snapshot_id.  A key with NULL parts matches nothing.
    """
    evidence = "struct<family:string,band:string,summary:string>"
    if layer is None:
        return rows.withColumns(
            {
                "cell_status": F.lit("layer_disabled"),
                "range_m": F.lit(None).cast("double"),
                "cell_evidence": F.lit(None).cast(evidence),
            }
        )
    known = layer.select(*CELL_KEY, "range_m", F.lit(True).alias("_hit"))
    joined = rows.join(known, list(CELL_KEY), "left")
    hit = F.col("_hit").isNotNull()
    summary = F.concat(
        F.lit("serving cell has a community-contributed location prior within "),
        F.coalesce(F.col("range_m").cast("bigint").cast("string"), F.lit("an unstated")),
        F.lit(" m, averaged from reception measurements"),
    )
    return joined.withColumns(
        {
            "cell_status": F.when(hit, F.lit("found")).otherwise(F.lit("no_record")),
            "cell_evidence": F.when(
                hit,
                F.struct(
                    F.lit("cell_prior").alias("family"),
                    F.lit("weak").alias("band"),
                    summary.alias("summary"),
                ),
            ),
        }
    ).drop("_hit")
