"""Orders, texts and logs of a review as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinsift.functions.measures import action_rank, format_bytes, format_time
from kinsift.functions.paths import base_name, fit, root_label, strip
from kinsift.operators.groups import numbered
from kinsift.storage import discard, materialize

#: Lines of a log that are kept.
LOG_LINES = 500


def _keys() -> dict[str, list[Column]]:
    group, path = F.col("group_id"), F.col("path_cf")
    return {
        "group": [group, path],
        "action": [action_rank(F.col("action")), group, path],
        "kind": [F.col("kind"), group, path],
        "score": [F.col("score"), group, path],
        "size": [F.col("size"), group, path],
        "name": [F.col("name_cf"), group],
        "root": [root_label(F.col("roots")), group, path],
        "mtime": [F.col("mtime"), group, path],
        "path": [path],
    }


SORT_MODES = ("group", "action", "kind", "score", "size", "name", "root", "mtime", "path")


def sort_order(mode: str, descending: bool = False) -> list[Column]:
    """Order of a session's rows. Reversing turns all keys round; rows that tie stay in the order of group and position."""
    keys = _keys()[mode]
    return [k.desc() if descending else k.asc() for k in keys] + [F.col("group_id").asc(), F.col("pos").asc()]


def page(rows: DataFrame, mode: str = "group", descending: bool = False, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of a session's rows."""
    return rows.orderBy(*sort_order(mode, descending)).offset(offset).limit(limit)


def row_lines(rows: DataFrame, name_width: int = 40, marked: bool = True) -> DataFrame:
    """(group_id, pos, line): each row as a line of a table. marked: a text that is cut ends in "...", and widths count cells; otherwise it keeps its first characters."""
    cut = fit if marked else lambda text, width: F.rpad(text, width, " ")
    shown = [
        (F.col("action"), 8), (F.col("group_id").cast("string"), 5), (F.when(F.col("group_hash") == "", "-").otherwise(F.coalesce("group_hash", F.lit("-"))), 12),
        (F.col("kind"), 12), (F.col("score").cast("string"), 5), (root_label(F.col("roots")), 5), (format_bytes(F.col("size")), 11),
        (format_time(F.col("mtime")), 16), (base_name(F.col("path")), name_width),
    ]
    return rows.select("group_id", "pos", F.concat_ws(" ", *(cut(c, w) for c, w in shown)).alias("line"))


def group_details(rows: DataFrame) -> DataFrame:
    """(group_id, detail): size, key, kind, score and actions of each group in a line."""
    count = lambda a: F.count_if(F.col("action") == a).cast("string")
    facts = rows.groupBy("group_id").agg(
        F.count("*").cast("string").alias("n"), F.first("group_hash").alias("key"), F.first("kind").alias("kind"), F.first("score").cast("string").alias("score"),
        count("KEEP").alias("keep"), count("DELETE").alias("delete"), count("DELETED").alias("deleted"),
    )
    parts = [F.concat(F.lit(f"{label}="), F.col(c)) for label, c in (("files", "n"), ("key", "key"), ("kind", "kind"), ("score", "score"), ("keep", "keep"), ("delete", "delete"), ("deleted", "deleted"))]
    return facts.select("group_id", F.concat(F.lit("Group "), F.col("group_id").cast("string"), F.lit(": "), F.concat_ws(" ", *parts)).alias("detail"))


def preview(lines: DataFrame, column: str, most: int) -> list[str]:
    """The first lines by order, and how many more there are. What makes the lines is run once."""
    held = materialize(lines.select(column), "preview")
    first = [r[0] for r in held.orderBy(column).limit(most).collect()]
    rest = held.count() - len(first)
    discard(held)
    return [*first, f"... {rest:,} more"] if rest > 0 else first


def log_lines(messages: DataFrame, keys: list[str] = [], order: list[str] = ["seq"], most: int | None = LOG_LINES) -> DataFrame:  # noqa: B006
    """Messages without line breaks, empty ones and repetitions of the one before; the last `most` of each log.

    messages: keys (a log each), order, message. An empty message doesn't come between two equal ones. Of
    messages that tie in order, any comes first. Without keys all messages are one log, whose places come
    from a sort over all tasks rather than from a window in one.
    """
    flat = strip(F.regexp_replace("message", r"\R", " "))
    rows = messages.withColumn("message", flat).where("message <> ''")
    if not keys:
        placed = numbered(rows, [F.asc(c) for c in order], "_at")
        before = placed.select((F.col("_at") + 1).alias("_next"), F.col("message").alias("_last"))
        told = placed.join(before, F.col("_at") == F.col("_next"), "left").where("_last IS NULL OR _last <> message")
        told = told if most is None else told.orderBy(F.desc("_at")).limit(most)
        return told.drop("_at", "_next", "_last")
    w = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_last", F.lag("message").over(w)).where("_last IS NULL OR _last <> message").drop("_last")
    if most is None:
        return rows
    back = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= most).drop("_n")


def summary(files: DataFrame, groups: DataFrame, rows: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(summary): one line about a scan and its session's rows."""
    count = lambda n: F.format_number(n, 0)
    marked = F.col("action") == "DELETE"
    session = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count_if(marked).alias("dn"), F.coalesce(F.sum(F.when(marked, F.col("size"))), F.lit(0)).alias("db"))
    scanned, found = files.agg(F.count("*").alias("f")), groups.agg(F.count("*").alias("g"))
    told = (files.limit(0) if warnings is None else warnings).agg(F.count("*").alias("w"))
    facts = session
    for one in (scanned, found, told):
        facts = facts.unionByName(one, allowMissingColumns=True)
    one = facts.agg(*(F.max(c).alias(c) for c in facts.columns))
    parts = [
        F.lit("scanned="), count("f"), F.lit(" groups="), count("g"), F.lit(" candidates="), count("n"), F.lit(" bytes="), format_bytes(F.col("b")),
        F.when(F.col("w") > 0, F.concat(F.lit(" warnings="), count("w"))).otherwise(""), F.lit(" delete="), count("dn"), F.lit(" ("), format_bytes(F.col("db")), F.lit(")"),
    ]
    return one.select(F.concat(*parts).alias("summary"))
