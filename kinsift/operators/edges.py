"""Candidate filters and the edges (src, dst, reason, score) between equal and similar items; src < dst.

Copies are contracted: the members of a class of equal content are linked to their first member only,
and similarity is looked for among first members. Groups, reasons and scores are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinsift.functions import measures as M
from kinsift.operators.tiles import Rule, close_pairs
from kinsift.options import IMAGE_EXTENSIONS, THUMBNAIL_MEAN, VIDEO_EXTENSIONS, ScanOptions
from kinsift.storage import materialize

#: Blocks in which close hashes are made to agree, at the most.
MOST_BLOCKS = 4


def same_size(files: DataFrame) -> DataFrame:
    """Files whose size another file has too. Sizes are counted on the map side."""
    common = files.groupBy("size").agg(F.count("*").alias("_n")).where("_n > 1").select((F.col("size") + F.lit(0)).alias("_s"))
    return files.join(common, files["size"] == common["_s"], "left_semi")


def image_candidates(files: DataFrame, options: ScanOptions) -> DataFrame:
    return files.where(F.col("extension").isin(*IMAGE_EXTENSIONS) & (F.col("size") >= options.min_similar_size))


def video_candidates(files: DataFrame, options: ScanOptions) -> DataFrame:
    return files.where(F.col("extension").isin(*VIDEO_EXTENSIONS) & (F.col("size") >= options.min_similar_size))


def star(items: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Edges from the smallest id of each key to the others. The minimum is combined on the map side; null keys link nothing.

    The last key is a string. It is joined as an expression, so that both sides are exchanged for the join
    and adaptive execution can split the partition of a key that many items share.
    """
    known = items.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select("id", *keys)
    least = known.groupBy(*keys).agg(F.min("id").alias("src"), F.count("*").alias("_n")).where("_n > 1")
    least = least.select("src", *keys[:-1], F.concat(keys[-1], F.lit("")).alias("_k"))
    pairs = known.withColumn("_k", F.concat(keys[-1], F.lit(""))).drop(keys[-1]).join(least, [*keys[:-1], "_k"])
    return pairs.where("id <> src").select("src", F.col("id").alias("dst"), F.lit(reason).alias("reason"), F.lit(100).alias("score"))


def exact_edges(hashed: DataFrame) -> DataFrame:
    return star(hashed, ["exact_hash"], "exact")


class Bands:
    """Keys of which two hashes within a threshold share one, whatever their bits.

    A hash of `bits` bits is cut into threshold + c blocks. Two hashes within the threshold agree in at least
    c of them, so each choice of c blocks is a key. More blocks make keys longer and more in number; c is the
    one for which `items` hashes make the fewest rows and candidates, if bits are evenly spread.
    """

    def __init__(self, threshold: int, bits: int, items: float = 0) -> None:
        if threshold >= bits:
            raise ValueError("every pair is within this threshold")
        t = max(threshold, 0)
        chosen = min(range(1, min(MOST_BLOCKS, bits - t) + 1), key=lambda c: self.cost(t, c, bits, items))
        n = t + chosen
        self.cuts = [round(i * bits / n) for i in range(n + 1)]
        blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(self.cuts, self.cuts[1:])]
        self.blocks, self.agree = blocks, chosen
        self.choices = [sum(1 << i for i in some) for some in combinations(range(n), chosen)]
        #: Bits of the shortest key.
        self.width = min(sum(blocks[i].bit_count() for i in range(n) if some >> i & 1) for some in self.choices)

    @staticmethod
    def cost(threshold: int, agree: int, bits: int, items: float) -> float:
        keys = comb(threshold + agree, agree)
        return items * keys + items * items / 2 * keys / 2 ** (bits * agree // (threshold + agree)) + keys

    def key(self, dhash: Column, choice: int) -> Column:
        mask = sum(m for i, m in enumerate(self.blocks) if choice >> i & 1)
        return dhash.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))

    def cut(self, items: DataFrame, keys: list[str], names: list[str], side: str) -> DataFrame:
        """keys, band, value and side_X of names and `others`: a row for each key of each item with a hash. others: the blocks before a key's last that aren't in it."""
        one = lambda c: F.struct(F.lit(c).cast("long").alias("band"), self.key(F.col("dhash"), c).alias("value"), F.lit((1 << c.bit_length() - 1) - 1 & ~c).cast("long").alias("others"))
        rows = items.where("dhash IS NOT NULL").select(*keys, *names, F.explode(F.array(*map(one, self.choices))).alias("_b"))
        return rows.select(*keys, "_b.band", "_b.value", F.col("_b.others").alias(f"{side}_others"), *(F.col(c).alias(f"{side}_{c}") for c in names))

    def first(self, xor: Column) -> Column:
        """Whether a pair that shares a key comes from it: no block before the key's last agrees but those of the key."""
        agreed = F.lit(0).cast("long")
        for i in range(len(self.blocks)):
            agreed += F.when(self.key(xor, 1 << i) == 0, 1 << i).otherwise(0)
        return agreed.bitwiseAND(F.col("l_others")) == 0


def hamming_pairs(items: DataFrame, keys: list[str], threshold: int, keep: list[str], bits: int = 64, duration: str | None = None) -> DataFrame:
    """(src, dst, distance and l_/r_ columns of `keep`) of items with equal keys whose dhash differs in at most threshold bits.

    duration: a column of which only matching values are paired. A pair comes once. A negative threshold pairs
    nothing; bits is the length of the hashes. Null keys and hashes pair nothing.
    """
    if threshold >= bits:
        raise ValueError("every pair is within this threshold")
    rule = Rule(threshold, reach=_reach, near=_durations) if duration else Rule(threshold)
    return close_pairs(items.withColumn("_hashes", F.when(F.col("dhash").isNotNull() & F.lit(threshold >= 0), F.array("dhash"))), keys, rule, "_hashes", duration, None, keep)


def hamming_search(items: DataFrame, queries: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """(query_id, id, distance): the items within threshold bits of each query, itself included if it is one. Both: id, dhash."""
    bands = Bands(threshold, bits, items.count())
    left, right = bands.cut(queries, [], ["id", "dhash"], "l"), bands.cut(items, [], ["id", "dhash"], "r")
    xor = F.col("l_dhash").bitwiseXOR(F.col("r_dhash"))
    near = left.join(right, ["band", "value"]).where((F.bit_count(xor) <= threshold) & bands.first(xor))
    return near.select(F.col("l_id").alias("query_id"), F.col("r_id").alias("id"), F.bit_count(xor).alias("distance"))


def image_match(left: Column, right: Column, threshold: int, mean: float = THUMBNAIL_MEAN) -> Column:
    """struct(reason, score) for two structs of picture prints that match, else null."""
    distance = M.hamming(left["dhash"], right["dhash"])
    same = (left["width"] == right["width"]) & (left["height"] == right["height"])
    alike = (distance <= threshold) & (M.mean_difference(left["thumbnail"], right["thumbnail"]) <= mean)
    equal = F.struct(F.lit("image-content").alias("reason"), F.lit(100).alias("score"))
    near = F.struct(F.lit("image").alias("reason"), M.similarity_score(distance, threshold).alias("score"))
    return F.when(same & (left["content_hash"] == right["content_hash"]), equal).when(same & alike, near)


def _frames_match(distances: Column, options: ScanOptions) -> Column:
    hits = F.size(F.filter(distances, lambda d: d <= options.video_frame_threshold))
    return (hits >= options.video_min_matching_frames) & (M.total(distances) <= options.video_threshold)


def video_match(left: Column, right: Column, options: ScanOptions) -> Column:
    """struct(reason, score) for two structs of video prints that match, else null."""
    a, b = left["frame_hashes"], right["frame_hashes"]
    distances = M.frame_distances(a, b)
    same = (left["width"] == right["width"]) & (left["height"] == right["height"]) & M.durations_match(left["duration"], right["duration"])
    score = M.similarity_score(M.total(distances), options.video_threshold)
    fits = same & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & _frames_match(distances, options), F.struct(F.lit("video").alias("reason"), score.alias("score")))


def image_edges(prints: DataFrame, threshold: int, bits: int = 64, mean: float = THUMBNAIL_MEAN, forest: bool = False) -> DataFrame:
    """prints: id, width, height, content_hash, dhash, thumbnail (array of channel values). Equal sizes only.

    Pictures of equal content are one star; among first members those of equal hash and thumbnail (blank
    pages, say) are one star again; what is left is compared in tiles, along the sums of their thumbnails.
    forest: links that connect the same pictures and have the same lowest scores, instead of all pairs.
    """
    if threshold < 0:
        return prints.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("image").alias("reason"), F.lit(100).alias("score")).limit(0)
    known = prints.where("content_hash IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    content = star(known, ["width", "height", "content_hash"], "image-content")
    firsts = known.groupBy("width", "height", "content_hash").agg(F.min_by(F.struct("id", "dhash", "thumbnail"), "id").alias("f"))
    look = F.sha2(F.concat_ws(",", F.col("thumbnail").cast("array<string>")).cast("binary"), 256)
    firsts = firsts.select("width", "height", "f.*").withColumn("look", F.when(F.size("thumbnail") > 0, look))
    same = star(firsts, ["width", "height", "dhash", "look"], "image")
    single = firsts.where("look IS NULL OR dhash IS NULL").select("width", "height", "id", "dhash", "thumbnail")
    looks = firsts.where("look IS NOT NULL AND dhash IS NOT NULL").groupBy("width", "height", "dhash", "look").agg(F.min_by(F.struct("id", "thumbnail"), "id").alias("f"))
    apart = materialize(looks.select("width", "height", "f.id", "dhash", "f.thumbnail").unionByName(single), "apart")
    apart = apart.withColumn("_hashes", F.array("dhash")).withColumn("_sum", F.aggregate("thumbnail", F.lit(0.0), lambda n, x: n + x.cast("double")))
    rule = Rule(threshold, reach=lambda place, size: place + mean * size + 1e-9 * np.abs(place), mean=mean)
    pairs = close_pairs(apart, ["width", "height"], rule, "_hashes", "_sum", "thumbnail", forest=forest)
    similar = pairs.select("src", "dst", F.lit("image").alias("reason"), M.similarity_score(F.col("distance"), threshold).alias("score"))
    return content.unionByName(same).unionByName(similar)


def _bucket(duration: Column) -> Column:
    """A bucket on a scale on which matching durations are at most 1.05 buckets apart."""
    scale = F.when(duration <= 50, duration / 0.5).otherwise(100 + F.log(duration / 50) / 0.01005034)
    return F.floor(scale / 1.05)


def _durations(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """measures.durations_match for arrays."""
    return np.abs(left - right) <= np.maximum(0.5, np.maximum(left, right) * 0.01)


def _reach(duration: np.ndarray, size: int) -> np.ndarray:
    """The longest duration that may match, or a little more."""
    return np.maximum(duration + 0.5, duration / 0.99) + 1e-9 * np.abs(duration)


def _near(bucket: Column) -> Column:
    return F.explode(F.array(bucket - 1, bucket, bucket + 1))


def _complete(videos: DataFrame) -> DataFrame:
    return videos.where("width IS NOT NULL AND height IS NOT NULL AND duration IS NOT NULL")


def video_metadata_candidates(videos: DataFrame) -> DataFrame:
    """videos: id, width, height, duration. Those with a partner of equal resolution and matching duration.

    A duration's best partner is its neighbour in order, so no pairs are made: distinct durations are
    ordered within buckets, each with those of the buckets beside it.
    """
    times = _complete(videos).groupBy("width", "height", "duration").agg(F.count("*").alias("_n")).withColumn("_b", _bucket(F.col("duration")))
    beside = times.withColumn("_k", _near(F.col("_b")))
    w = W.partitionBy("width", "height", "_k").orderBy("duration")
    match = lambda other: F.coalesce(M.durations_match(F.col("duration"), other), F.lit(False))
    paired = (F.col("_n") > 1) | match(F.lag("duration").over(w)) | match(F.lead("duration").over(w))
    keys = beside.withColumn("_ok", paired).where("_k = _b AND _ok").select(*((F.col(c) + F.lit(0)).alias(f"_{c}") for c in ("width", "height", "duration")))
    same = [videos[c] == keys[f"_{c}"] for c in ("width", "height", "duration")]
    return videos.join(keys, same, "left_semi")


def _frame_pairs(videos: DataFrame, options: ScanOptions, need: Callable[[int], int], forest: bool = False) -> DataFrame:
    """(src, dst, distance) of videos of equal resolution, matching duration and equally many frames, of which need(their number) are near; distance: the sum over all frames."""
    rule = Rule(options.video_threshold, options.video_frame_threshold, need, _reach, _durations)
    return close_pairs(_complete(videos), ["width", "height"], rule, "frame_hashes", "duration", forest=forest)


def _looks(videos: DataFrame) -> DataFrame:
    """videos with `_look`, which names their resolution, duration and frames."""
    parts = [F.col(c).cast("string") for c in ("width", "height", "duration")]
    return videos.withColumn("_look", F.sha2(F.concat_ws(",", *parts, F.col("frame_hashes").cast("array<string>")).cast("binary"), 256))


def _firsts(looks: DataFrame) -> DataFrame:
    return looks.groupBy("_look").agg(F.min_by(F.struct("id", "width", "height", "duration", "frame_hashes"), "id").alias("f")).select("_look", "f.*")


def video_frame_candidates(videos: DataFrame, options: ScanOptions, bits: int = 64) -> DataFrame:
    """videos: also frame_hashes of the preliminary samples. Those with a partner that the full samples could still match. Videos that are alike in all of it are compared as one."""
    looks = _looks(_complete(videos).where("frame_hashes IS NOT NULL"))
    firsts = materialize(_firsts(looks), "firsts")
    # A frame that isn't near is one that the full samples miss too.
    need = lambda frames: options.video_min_matching_frames - options.video_sample_count + frames
    pairs = _frame_pairs(firsts, options, need, forest=True)
    named = pairs.select(F.explode(F.array("src", "dst")).alias("i")).distinct()
    found = firsts.join(named, firsts["id"] == named["i"], "left_semi").select(F.concat("_look", F.lit("")).alias("_l"))
    if options.video_threshold >= 0 and options.video_sample_count >= options.video_min_matching_frames:
        found = found.unionByName(looks.groupBy("_look").agg(F.count("*").alias("n")).where("n > 1").select(F.concat("_look", F.lit("")).alias("_l")))
    return looks.join(found.distinct(), F.col("_look") == F.col("_l"), "left_semi").select(*videos.columns)


def video_edges(videos: DataFrame, options: ScanOptions, bits: int = 64, forest: bool = False) -> DataFrame:
    """videos: id, width, height, duration, frame_hashes (array of longs). Videos that are alike in all but the id are a star, and only its first is compared with others.

    forest: links that connect the same videos and have the same lowest scores, instead of all pairs.
    """
    known = materialize(_looks(_complete(videos).where("frame_hashes IS NOT NULL AND size(frame_hashes) > 0")), "videos")
    pairs = _frame_pairs(_firsts(known), options, lambda frames: options.video_min_matching_frames, forest)
    near = pairs.select("src", "dst", F.lit("video").alias("reason"), M.similarity_score(F.col("distance"), options.video_threshold).alias("score"))
    alike = known.where((F.size("frame_hashes") >= options.video_min_matching_frames) & F.lit(options.video_threshold >= 0 and options.video_frame_threshold >= 0))
    return near.unionByName(star(alike, ["_look"], "video"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair and reason, whichever way round it came."""
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "reason", "score").where("src <> dst")
    return ends.groupBy("src", "dst", "reason").agg(F.min("score").alias("score"))
