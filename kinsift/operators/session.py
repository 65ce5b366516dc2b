"""The state of a review: actions of members, as DataFrames.

The state is a table of overrides (id, action) over KEEP, and a table of deleted ids that nothing takes
back. A change that looks at all members writes a new table of overrides. What is said of single records
(set_action, toggle) is a note of one id that the driver holds, one for each id that somebody named, and is
laid over the table when rows are asked for; the next change of all members takes the notes in. So an edit
costs a look at one record and writes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from kinsift.operators.keeper import recommended
from kinsift.storage import materialize

ACTIONS = ("KEEP", "DELETE", "DELETED")


class UnsafeGroups(RuntimeError):
    """A plan would leave a group without a member."""

    def __init__(self, group_ids: list[int]) -> None:
        super().__init__(f"nothing would be left of groups {', '.join(map(str, group_ids))}")
        self.group_ids = group_ids


class Session:
    """members: group_id, pos, id, path, path_cf, name_cf, roots, size, mtime. groups: as from build_groups()."""

    def __init__(self, members: DataFrame, groups: DataFrame, markers: tuple[str, ...]) -> None:
        self.spark = members.sparkSession
        self.members, self.groups, self.markers = members, groups, markers
        self.deleted = self.spark.createDataFrame([], "id long")
        self.actions = self.spark.createDataFrame([], "id long, action string")
        self.notes: dict[int, str] = {}
        self.apply_recommended_to_all(markers)

    def _noted(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.notes.items()), "id long, noted string")

    def with_actions(self) -> DataFrame:
        """members with `action`; what is deleted is DELETED, what has no action is KEEP."""
        gone = self.deleted.withColumn("_gone", F.lit(True))
        rows = self.members.join(self.actions, "id", "left").join(gone, "id", "left")
        action = F.coalesce("action", F.lit("KEEP"))
        if self.notes:
            rows, action = rows.join(self._noted(), "id", "left"), F.coalesce("noted", action)
        return rows.withColumn("action", F.when(F.col("_gone"), "DELETED").otherwise(action)).drop("_gone", "noted")

    def rows(self) -> DataFrame:
        """A row for each member with its group's kind, score and, if it has one, group_hash; in the order of group_id and pos."""
        named = self.groups.select("group_id", "kind", "score", "n_members", *(c for c in self.groups.columns if c == "group_hash"))
        return self.with_actions().join(named, "group_id").orderBy("group_id", "pos")

    def action_for(self, record_id: int) -> str:
        row = self.with_actions().where(F.col("id") == record_id).select("action").first()
        return row.action if row else "KEEP"

    def _fold(self) -> None:
        """Take the notes into the tables."""
        if self.notes:
            notes, self.notes = self._noted().withColumnRenamed("noted", "action"), {}
            self._delete(notes.where("action = 'DELETED'").select("id"))
            self._override(notes)

    def _override(self, changes: DataFrame) -> None:
        """changes: id, action; the deleted keep theirs."""
        self._fold()
        changes = changes.join(self.deleted, "id", "left_anti")
        rest = self.actions.join(changes, "id", "left_anti")
        self.actions = materialize(rest.unionByName(changes), "actions")  # older tables stay: rows handed out before still read them

    def _delete(self, ids: DataFrame) -> None:
        self.deleted = materialize(self.deleted.unionByName(ids).distinct(), "deleted")

    def set_action(self, record_id: int, action: str) -> None:
        """Nothing happens to a deleted record. DELETED is for good."""
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}")
        if self.notes.get(record_id) != "DELETED":
            self.notes[record_id] = action

    def toggle(self, record_id: int) -> None:
        """From KEEP to DELETE, from anything else to KEEP; a deleted or unknown record stays as it is."""
        row = self.with_actions().where(F.col("id") == record_id).select("action").first()
        if row and row.action != "DELETED":
            self.notes[record_id] = "DELETE" if row.action == "KEEP" else "KEEP"

    def apply_recommended_to_all(self, markers: tuple[str, ...]) -> None:
        self._fold()
        self.actions = self.spark.createDataFrame([], "id long, action string")
        self._override(recommended(self.members, markers).select("id", "action"))

    def apply_recommended_to_group(self, group_id: int, markers: tuple[str, ...]) -> None:
        """The best of the group stays; it is chosen among all members, deleted ones included."""
        self._override(recommended(self.group(group_id), markers).select("id", "action"))

    def keep_root(self, root: str, markers: tuple[str, ...]) -> None:
        """In each group the best of the root's members stays, or the best of all where the root has none."""
        self._override(recommended(self.members, markers, root).select("id", "action"))

    def group(self, group_id: int) -> DataFrame:
        return self.members.where(F.col("group_id") == group_id)

    def delete_candidates(self) -> DataFrame:
        return self.with_actions().where("action = 'DELETE'")

    def unsafe_groups(self) -> DataFrame:
        """(group_id) of groups none of whose members stays."""
        return unsafe_groups(self.with_actions())

    def mark_deleted_paths(self, paths: DataFrame | Iterable[str]) -> None:
        """paths: a table with a column `path`, or strings; compared as they are written."""
        if not isinstance(paths, DataFrame):
            paths = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self._fold()
        self._delete(self.members.join(paths.select("path").distinct(), "path", "left_semi").select("id"))

    def totals(self) -> DataFrame:
        """One row: duplicate_file_count and duplicate_byte_count (kept ones too), delete_count and delete_bytes."""
        return session_totals(self.with_actions())

    def delete_plan(self) -> DataFrame:
        """(path): what would be deleted, distinct and in order. Raises UnsafeGroups if a group would lose all members; deletes nothing."""
        unsafe = [r.group_id for r in self.unsafe_groups().orderBy("group_id").limit(8).collect()]
        if unsafe:
            raise UnsafeGroups(unsafe)
        return self.delete_candidates().select("path").distinct().orderBy("path")


def unsafe_groups(rows: DataFrame) -> DataFrame:
    every = rows.groupBy("group_id").agg(F.bool_and(F.col("action").isin("DELETE", "DELETED")).alias("_all"))
    return every.where("_all").select("group_id")


def session_totals(rows: DataFrame) -> DataFrame:
    marked = F.col("action") == "DELETE"
    return rows.agg(
        F.count("*").alias("duplicate_file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("duplicate_byte_count"),
        F.count_if(marked).alias("delete_count"),
        F.coalesce(F.sum(F.when(marked, F.col("size"))), F.lit(0)).alias("delete_bytes"),
    )


def action_counts(rows: DataFrame) -> DataFrame:
    """(group_id, keep, delete, deleted)."""
    count = lambda a: F.count_if(F.col("action") == a)
    return rows.groupBy("group_id").agg(count("KEEP").alias("keep"), count("DELETE").alias("delete"), count("DELETED").alias("deleted"))
