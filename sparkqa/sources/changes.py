"""Change data feed between two versions of a keyed table (op 11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def change_feed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between ``old`` and ``new`` with ``_change_type`` in
    insert / delete / update_preimage / update_postimage. Unchanged rows are left out.

    Whole rows never shuffle for unchanged keys: first only ``(key, sha-256 of the row)``
    of both versions meet in a full outer join, which names the candidate keys (new, gone,
    or a different digest). Full rows are semi-joined to those keys (a small candidate set
    is broadcast by the planner's size check, so the filter runs map-side), and the candidates go through the
    exact comparison: a row counts as changed when any non-key column differs null-safely,
    so the digest only narrows, never decides. Rows with a null key never match, as in a
    plain join. Pre/post images come from one ``explode`` of a two-element array."""
    cols = [c for c in old.columns if c not in keys]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))
    od = old.select(*keys, digest.alias("_ho"))
    nd = new.select(*keys, digest.alias("_hn"))
    cand = (od.join(nd, keys, "full_outer").filter(~F.col("_ho").eqNullSafe(F.col("_hn")))
            .select(*keys).filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])))
    # written once: both versions read it, and the planner sees its real size, so it is
    # broadcast only while under autoBroadcastJoinThreshold (sort-merge join beyond)
    cand = materialize(cand, "changed-keys")
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])

    def candidates(df: DataFrame) -> DataFrame:
        return df.join(cand, keys, "left_semi").unionByName(df.filter(any_null))

    o = candidates(old).select(*keys, F.struct(*cols).alias("_o"))
    n = candidates(new).select(*keys, F.struct(*cols).alias("_n"))
    j = o.join(n, keys, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col("_o")[c].eqNullSafe(F.col("_n")[c]) for c in cols], F.lit(True))
    kind = (F.when(F.col("_o").isNull(), F.lit("insert"))
            .when(F.col("_n").isNull(), F.lit("delete"))
            .when(~same, F.lit("update")))
    j = j.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    images = F.when(F.col("_kind") == "insert", F.array(F.struct(F.lit("insert").alias("t"), F.col("_n").alias("r"))))
    images = images.when(F.col("_kind") == "delete",
                         F.array(F.struct(F.lit("delete").alias("t"), F.col("_o").alias("r"))))
    images = images.otherwise(F.array(F.struct(F.lit("update_preimage").alias("t"), F.col("_o").alias("r")),
                                      F.struct(F.lit("update_postimage").alias("t"), F.col("_n").alias("r"))))
    x = j.select(*keys, F.explode(images).alias("_img"))
    return x.select(*keys, *[F.col("_img.r")[c].alias(c) for c in cols], F.col("_img.t").alias("_change_type"))
