"""Which member of a group to keep, and the actions that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinsift.functions.paths import copy_bases, has_marker, normalized_stem


def copy_names(members: DataFrame, group: str = "group_id", candidate: str | None = None) -> DataFrame:
    """members with `is_copy_name`: whether the name is that of a copy of another candidate's.

    members: id, group, name_cf. candidate: a boolean column; only candidates' stems count, and only they
    are looked at. Stems know neither folders nor extensions. A group's stems are joined, not gathered.
    """
    chosen = members if candidate is None else members.where(candidate)
    named = chosen.select("id", F.col(group).alias("_g"), normalized_stem(F.col("name_cf")).alias("_stem"))
    stems = named.select("_g", "_stem").distinct()
    bases = named.select("id", "_g", F.explode(copy_bases(F.col("_stem"))).alias("_base"))
    copies = bases.join(stems, (bases["_g"] == stems["_g"]) & (F.col("_base") == F.col("_stem"))).select("id").distinct().withColumn("_copy", F.lit(True))
    return members.join(copies, "id", "left").withColumn("is_copy_name", F.coalesce("_copy", F.lit(False))).drop("_copy")


def keepers(members: DataFrame, markers: tuple[str, ...], root: str | None = None, group: str = "group_id") -> DataFrame:
    """members with `is_keeper`: the best of each group, or with root the best of those in it where there are any.

    Better is: a marker in the path; not a copy's name; larger; later; a shorter path; the later path by
    order. Of full ties the first by pos. Members that are deleted already are ranked like any. The best is
    found by an aggregate, so that a group of any size is combined on the map side.
    """
    rows = members.withColumn("_in", F.lit(True) if root is None else F.array_contains("roots", root))
    if root is None:
        rows = rows.withColumn("_chosen", F.col("_in"))
    else:
        having = rows.where("_in").select((F.col(group) + F.lit(0)).alias("_h")).distinct().withColumn("_any", F.lit(True))
        rows = rows.join(having, rows[group] == having["_h"], "left").withColumn("_chosen", F.col("_in") | F.col("_any").isNull()).drop("_h", "_any")
    rows = copy_names(rows, group, "_chosen")
    rank = F.struct(
        "_chosen", has_marker(F.col("path"), markers).alias("m"), (~F.col("is_copy_name")).alias("c"), "size", "mtime",
        (-F.length("path")).alias("l"), "path_cf", (-F.col("pos")).alias("p"),
    )
    best = rows.groupBy(group).agg(F.max_by("id", rank).alias("_best"))
    best = best.select((F.col(group) + F.lit(0)).alias("_g"), "_best")
    return rows.join(best, rows[group] == best["_g"]).withColumn("is_keeper", F.col("id") == F.col("_best")).drop("_in", "_chosen", "_best", "_g")


def recommended(members: DataFrame, markers: tuple[str, ...], root: str | None = None) -> DataFrame:
    """members with `action`: KEEP for each group's best, DELETE for the others."""
    rows = keepers(members, markers, root)
    return rows.withColumn("action", F.when(F.col("is_keeper"), "KEEP").otherwise("DELETE"))
