"""Tables whose schema has grown over time, read as one.

Every version of a table lies in its own folder, as it was written then. A version may add columns; for rows of earlier versions a rule says what they hold. Stored files are never
rewritten: rules are expressions that the scan's projection evaluates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Version = tuple[int, str, str, Mapping[str, Column]]


def read_versions(spark: SparkSession, versions: Sequence[Version], keys: Sequence[str] = ()) -> DataFrame:
    """All rows in the schema of the newest version, with `schema_version`. versions: (number, path, schema, rules), rules by column that the version adds, over the columns before it; one
    without a rule is null in earlier rows. Rules of later versions see what those of earlier ones filled in. A version may change the type of a column to one it can be cast to.

    With keys, of rows in several versions the newest version's counts. An empty folder gives no rows, and versions may be given in any order.
    """
    ordered = sorted(versions, key=lambda v: v[0])
    if len({v[0] for v in ordered}) < len(ordered):
        raise ValueError("two versions of one number")
    out = None
    for at, (number, path, schema, _) in enumerate(ordered):
        rows = spark.read.schema(schema).parquet(path)
        for _, _, later, rules in ordered[at + 1 :]:
            kinds = spark.createDataFrame([], later).schema
            gone = set(rows.columns) - set(kinds.names)
            if gone:
                raise ValueError(f"a later version lacks {', '.join(sorted(gone))}")
            filled = [(F.col(f.name) if f.name in rows.columns else rules.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in kinds]
            rows = rows.select(*filled)
        rows = rows.withColumn("schema_version", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    if not keys:
        return out
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "schema_version").alias("_r")).select(*keys, "_r.*")
