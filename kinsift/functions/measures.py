"""Distances, scores and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Units of sizes.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two longs; the sign doesn't matter."""
    return F.bit_count(left.bitwiseXOR(right))


def dhash(pixels: Column, columns: int = 9, rows: int = 8) -> Column:
    """A bit for each pixel and its right neighbour, 1 where the left one is larger; row by row, first bit highest."""
    inner = columns - 1
    place = F.transform(F.sequence(F.lit(0), F.lit(rows * inner - 1)), lambda k: (F.floor(k / inner) * columns + k % inner).cast("int"))
    bits = F.transform(place, lambda p: F.when(F.get(pixels, p) > F.get(pixels, p + 1), F.lit(1)).otherwise(0).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def similarity_score(distance: Column, threshold: int) -> Column:
    """100 less a fifth of the threshold's share that the distance takes, rounded half to even."""
    if threshold <= 0:
        return F.when(distance == 0, 100).otherwise(0).cast("int")
    loss = F.bround(distance / F.lit(float(threshold)) * 20, 0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - loss)).cast("int")


def durations_match(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= F.greatest(F.lit(0.5), F.greatest(left, right) * 0.01)


def difference_sum(left: Column, right: Column) -> Column:
    """Sum of the absolute differences of two arrays."""
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.abs(a - b).cast("double")), zero, lambda acc, d: acc + d)


def mean_difference(left: Column, right: Column) -> Column:
    """Mean absolute difference; infinite for arrays of unequal length or none."""
    odd = (F.size(left) != F.size(right)) | (F.size(left) <= 0)
    return F.when(odd, F.lit(float("inf"))).otherwise(difference_sum(left, right) / F.size(left))


def frame_distances(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b)))


def total(distances: Column) -> Column:
    return F.aggregate(distances, F.lit(0), lambda acc, d: acc + d)


def sample_ratios(count: int) -> list[float]:
    """Where frames are taken: from a tenth to nine tenths of the duration, evenly (fixed values)."""
    if count <= 1:
        return [0.5]
    step = 0.8 / (count - 1)
    return [0.1 + step * i for i in range(count)]


def sample_positions(duration: Column, count: int) -> Column:
    """Seconds of the frames; all 0 in videos of at most a second."""
    ratios = F.array(*map(F.lit, sample_ratios(count)))
    return F.when(duration > 1, F.transform(ratios, lambda r: F.greatest(F.lit(0.0), duration * r))).otherwise(F.array_repeat(F.lit(0.0), count))


def pad_frames(hashes: Column, count: int) -> Column:
    """The first `count` hashes, the last one repeated where there are fewer; null for none."""
    filled = F.concat(hashes, F.array_repeat(F.element_at(hashes, -1), count))
    return F.when(F.size(hashes) > 0, F.slice(filled, 1, count))


def format_bytes(size: Column) -> Column:
    out = F.concat(F.format_number(size / float(1024 ** (len(UNITS) - 1)), 2), F.lit(" " + UNITS[-1]))
    for i in range(len(UNITS) - 2, 0, -1):
        scaled = size / float(1024**i)
        out = F.when(scaled < 1024, F.concat(F.format_number(scaled, 2), F.lit(" " + UNITS[i]))).otherwise(out)
    return F.when(size < 1024, F.concat(F.format_number(size, 0), F.lit(" B"))).otherwise(out)


def format_time(mtime: Column) -> Column:
    return F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd HH:mm")


def probe_value(output: Column, key: str) -> Column:
    """The value of the first line `key=value` of a text; null without one."""
    lines = F.filter(F.split(output, r"\R", -1), lambda x: F.contains(x, F.lit("=")) & (F.trim(F.substring_index(x, "=", 1)) == key))
    return F.trim(F.regexp_replace(F.get(lines, 0), r"^[^=]*=", ""))


def action_rank(action: Column) -> Column:
    return F.when(action == "DELETE", 0).when(action == "KEEP", 1).when(action == "DELETED", 2).otherwise(3)
