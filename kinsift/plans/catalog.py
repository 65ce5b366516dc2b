"""The queries of the duplicate engine over the driver's tables, and their oracle SQL.

The SQL is written independently of the plans: it compares all with all where the plans use bands and
buckets, and closes graphs by recursion where the plans use stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.functions import measures as M, paths as P
from kinsift.operators import edges as E, groups as G, keeper as K, session as S, views as V
from kinsift.operators.components import connected_components
from kinsift.options import ScanOptions
from kinsift.sources import tables as T
from kinsift.storage import materialize

MARKERS = ("/src1/",)
VIDEO = ScanOptions(video_threshold=60, video_frame_threshold=14)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "documents")


FILES = """files AS (
  SELECT doc_id AS id,
    '/' || source || '/' || lang || '/' || doc_id || '/d' || (doc_id % 97)
      || CASE doc_id % 5 WHEN 0 THEN ' (1)' WHEN 1 THEN '-02' WHEN 2 THEN ' copy' ELSE '' END || '.txt' AS path,
    CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS root,
    CAST(strlen(text) AS BIGINT) AS size, CAST(doc_id % 1000 AS DOUBLE) AS mtime, sha256(text) AS sha,
    count(*) OVER (PARTITION BY strlen(text)) AS n_size, text
  FROM documents
), hashed AS (
  SELECT *, CASE WHEN n_size > 1 THEN sha END AS exact_hash, regexp_extract(path, '[^/]*$') AS name FROM files
)"""

EXACT = f"""{FILES}, classed AS (
  SELECT *, min(id) OVER (PARTITION BY exact_hash) AS component, count(*) OVER (PARTITION BY exact_hash) AS n
  FROM hashed WHERE exact_hash IS NOT NULL
), members0 AS (SELECT * FROM classed WHERE n > 1),
grouped AS (
  SELECT component, count(*) AS n_members, sum(size) AS n_bytes, min(path) AS first_path, 'exact' AS kind, 100 AS score
  FROM members0 GROUP BY component
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY n_members DESC, kind, first_path, component) AS group_id FROM grouped
), members AS (
  SELECT m.*, g.group_id, g.n_members, row_number() OVER (PARTITION BY g.group_id ORDER BY m.path, m.id) AS pos
  FROM members0 m JOIN numbered g USING (component)
)"""

#: Names that could be copies, and the order of what to keep, for candidates in `cand` (group_id, id, name, path, size, mtime, pos).
STEMS = r"""stems AS (SELECT *, trim(regexp_replace(name, '\.[^.]*$', '')) AS stem FROM cand),
bases AS (
  SELECT *, [trim(regexp_extract(stem, '^(.+?)\s*[\((]\s*\d{1,3}\s*[\))]$', 1)),
    trim(regexp_extract(stem, '^(.+?)[\s._-]+\d{1,2}$', 1)),
    trim(regexp_extract(stem, '^(.+?)[\s._-]+copy([\s._-]*\d{1,3})?$', 1))] AS base,
    list(stem) OVER (PARTITION BY group_id) AS all_stems
  FROM stems
), flagged AS (
  SELECT *, len(list_filter(base, lambda b: b <> '' AND list_contains(all_stems, b))) > 0 AS is_copy_name FROM bases
), best AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY contains(path, '/src1/') DESC, is_copy_name, size DESC, mtime DESC,
    length(path), path DESC, pos) = 1 AS is_keeper FROM flagged
)"""

ACTED = f"""{EXACT}, cand AS (SELECT * FROM members), {STEMS},
acted AS (SELECT *, CASE WHEN is_keeper THEN 'KEEP' ELSE 'DELETE' END AS action FROM best)"""

COUNTS = """chars AS (
  SELECT id, unicode(c) % 64 AS bin, count(*) AS n FROM (SELECT {id} AS id, unnest(string_split({text}, '')) AS c FROM {source}) WHERE c <> '' GROUP BY ALL
), grid AS (
  SELECT i.id, b.bin, coalesce(n, 0) AS n FROM (SELECT {id} AS id FROM {source}) i CROSS JOIN (SELECT unnest(range(64)) AS bin) b LEFT JOIN chars c ON c.id = i.id AND c.bin = b.bin
), hashes AS (
  SELECT id, CAST(sum(CASE WHEN n > nxt THEN CAST(1 AS HUGEINT) << (62 - bin)::INT ELSE 0 END) AS BIGINT) AS dhash, list(n ORDER BY bin) AS thumbnail
  FROM (SELECT *, lead(n) OVER (PARTITION BY id ORDER BY bin) AS nxt FROM grid) GROUP BY id
)"""

PRINTS = COUNTS.format(id="doc_id", text="text", source="documents") + """, prints AS (
  SELECT d.doc_id AS id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS width, CAST(length(lang) AS INT) AS height,
    sha256(text) AS content_hash, dhash, thumbnail, CAST(n_chars AS DOUBLE) AS duration
  FROM documents d JOIN hashes h ON h.id = d.doc_id
)"""

IMAGE = f"""{PRINTS}, content AS (
  SELECT *, min(id) OVER (PARTITION BY width, height, content_hash) AS first FROM prints
), looks AS (
  SELECT *, min(id) OVER (PARTITION BY width, height, dhash, thumbnail) AS look FROM content WHERE id = first
), image_edges AS (
  SELECT first AS src, id AS dst, 'image-content' AS reason, 100 AS score FROM content WHERE id <> first
  UNION ALL
  SELECT look, id, 'image', 100 FROM looks WHERE id <> look
  UNION ALL
  SELECT l.id, r.id, 'image', CAST(greatest(0, least(100, 100 - round_even(bit_count(xor(l.dhash, r.dhash)) / 4.0 * 20, 0))) AS INT)
  FROM looks l JOIN looks r ON l.width = r.width AND l.height = r.height AND l.id < r.id
  WHERE l.id = l.look AND r.id = r.look AND bit_count(xor(l.dhash, r.dhash)) <= 4
    AND list_sum(list_transform(list_zip(l.thumbnail, r.thumbnail), lambda x: abs(x[1] - x[2]))) / 64.0 <= 6.0
)"""

MIXED = f"""{FILES}, {IMAGE}, exact_edges AS (
  SELECT first AS src, id AS dst, 'exact' AS reason, 100 AS score
  FROM (SELECT id, min(id) OVER (PARTITION BY exact_hash) AS first FROM hashed WHERE exact_hash IS NOT NULL) WHERE id <> first
), edges AS (SELECT * FROM exact_edges UNION ALL SELECT * FROM image_edges),
walk AS (
  SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges
), reach(a, b) AS (
  SELECT a, b FROM walk UNION SELECT r.a, w.b FROM reach r JOIN walk w ON r.b = w.a
), labels AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
evidence AS (SELECT component, list_sort(list(DISTINCT reason)) AS reasons, min(score) AS score FROM edges JOIN labels ON src = node GROUP BY component),
mixed AS (
  SELECT l.component, array_to_string(reasons, '+') AS kind, score, count(*) AS n_members, sum(size) AS n_bytes, min(path) AS first_path
  FROM labels l JOIN hashed f ON f.id = l.node JOIN evidence e ON e.component = l.component GROUP BY ALL
)"""


def recursive(sql: str) -> str:
    return f"WITH RECURSIVE {sql}"


def exact(spark: SparkSession, sf: str, with_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members and groups of exact copies. Their classes are their components, so no graph is walked."""
    hashed = materialize(T.hashed_documents(docs(spark, sf)), "hashed")
    edges = E.exact_edges(hashed)
    labels = edges.select(F.col("dst").alias("node"), F.col("src").alias("component")).unionByName(edges.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct())
    return G.build_groups(hashed, edges, labels, with_hash)


def mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    hashed = materialize(T.hashed_documents(docs(spark, sf)), "hashed")
    prints = materialize(T.document_prints(docs(spark, sf)), "prints")
    return G.build_groups(hashed, E.distinct_edges(E.exact_edges(hashed).unionByName(E.image_edges(prints, 4, 63, forest=True))), with_hash=False)


@query("scan_inventory", f"WITH {FILES} SELECT count(*) AS files_scanned, CAST(sum(size) AS BIGINT) AS bytes_scanned FROM files")
def scan_inventory(spark, sf):
    return G.scan_totals(T.document_files(docs(spark, sf)))


@query("same_size_candidates", f"WITH {FILES} SELECT id, size FROM files WHERE n_size > 1")
def same_size_candidates(spark, sf):
    return E.same_size(T.document_files(docs(spark, sf)).select("id", "size"))


@query("exact_edges", f"WITH {EXACT} SELECT component AS src, id AS dst, 'exact' AS reason, 100 AS score FROM members0 WHERE id <> component")
def exact_edges(spark, sf):
    return E.exact_edges(T.hashed_documents(docs(spark, sf)))


@query("exact_groups", f"WITH {EXACT} SELECT CAST(group_id AS BIGINT) AS group_id, kind, score, n_members, CAST(n_bytes AS BIGINT) AS n_bytes, first_path FROM numbered")
def exact_groups(spark, sf):
    return exact(spark, sf)[1].select("group_id", "kind", "score", "n_members", "n_bytes", F.col("first_path_cf").alias("first_path"))


@query(
    "cross_root_groups",
    f"""WITH {EXACT} SELECT CAST(group_id AS BIGINT) AS group_id, array_to_string(list_sort(list(DISTINCT root)), ',') AS roots, count(*) AS n
    FROM members GROUP BY group_id HAVING count(DISTINCT root) = 2""",
)
def cross_root_groups(spark, sf):
    rows = exact(spark, sf)[0].select("group_id", F.explode("roots").alias("root"))
    both = rows.groupBy("group_id").agg(F.collect_set("root").alias("r"), F.count("*").alias("n"))
    return both.where(F.array_contains("r", "A") & F.array_contains("r", "B")).select("group_id", P.root_label(F.col("r")).alias("roots"), "n")


@query(
    "group_hash",
    f"""WITH {EXACT} SELECT CAST(group_id AS BIGINT) AS group_id,
    substr(sha256('kind' || chr(0) || 'exact' || chr(0) || 'score' || chr(0) || '100' || chr(0) || 'reason' || chr(0) || 'exact' || chr(0)
      || string_agg('record' || chr(0) || path || chr(0) || root || chr(0) || size || chr(0) || exact_hash || chr(0), '' ORDER BY path, id)), 1, 12) AS group_hash
    FROM members GROUP BY group_id""",
)
def group_hash(spark, sf):
    return exact(spark, sf, True)[1].select("group_id", "group_hash")


@query("group_members", f"WITH {EXACT} SELECT CAST(group_id AS BIGINT) AS group_id, CAST(pos AS BIGINT) AS pos, id, path FROM members")
def group_members(spark, sf):
    return exact(spark, sf)[0].select("group_id", "pos", "id", "path")


@query(
    "duplicate_totals",
    f"""WITH {ACTED} SELECT count(*) AS duplicate_file_count, CAST(sum(size) AS BIGINT) AS duplicate_byte_count,
    count(*) FILTER (action = 'DELETE') AS delete_count, CAST(sum(size) FILTER (action = 'DELETE') AS BIGINT) AS delete_bytes FROM acted""",
)
def duplicate_totals(spark, sf):
    return S.session_totals(K.recommended(exact(spark, sf)[0], MARKERS))


@query(
    "formatted_sizes",
    f"""WITH {FILES} SELECT id, CASE WHEN size < 1024 THEN format('{{:,}}', size) || ' B' WHEN size / 1024.0 < 1024 THEN format('{{:,.2f}}', size / 1024.0::DOUBLE) || ' KB'
    ELSE format('{{:,.2f}}', size / 1048576.0::DOUBLE) || ' MB' END AS shown FROM files""",
)
def formatted_sizes(spark, sf):
    return T.document_files(docs(spark, sf)).select("id", M.format_bytes(F.col("size")).alias("shown"))


@query("duplicate_name_flags", f"WITH {EXACT}, cand AS (SELECT * FROM members), {STEMS} SELECT id, is_copy_name FROM flagged")
def duplicate_name_flags(spark, sf):
    return K.copy_names(exact(spark, sf)[0]).select("id", "is_copy_name")


@query("recommended_actions", f"WITH {ACTED} SELECT CAST(group_id AS BIGINT) AS group_id, id, action FROM acted")
def recommended_actions(spark, sf):
    return K.recommended(exact(spark, sf)[0], MARKERS).select("group_id", "id", "action")


def _keep_root_sql(root: str) -> str:
    chosen = f"SELECT * FROM (SELECT *, max(root = '{root}') OVER (PARTITION BY group_id) AS any_in FROM members) WHERE root = '{root}' OR NOT any_in"
    return f"""WITH {EXACT}, cand AS ({chosen}), {STEMS}
    SELECT CAST(m.group_id AS BIGINT) AS group_id, m.id, CASE WHEN b.is_keeper THEN 'KEEP' ELSE 'DELETE' END AS action FROM members m LEFT JOIN best b ON b.id = m.id"""


def _keep_root(root: str):
    return lambda spark, sf: K.recommended(exact(spark, sf)[0], MARKERS, root).select("group_id", "id", "action")


for _root in "AB":
    query(f"keep_root_{_root.lower()}", _keep_root_sql(_root))(_keep_root(_root))


@query("delete_candidates", f"WITH {ACTED} SELECT DISTINCT path FROM acted WHERE action = 'DELETE'")
def delete_candidates(spark, sf):
    members, groups = exact(spark, sf)
    return S.Session(members, groups, MARKERS).delete_plan()


@query(
    "action_counts",
    f"""WITH {ACTED} SELECT CAST(group_id AS BIGINT) AS group_id, count(*) FILTER (action = 'KEEP') AS keep, count(*) FILTER (action = 'DELETE') AS "delete",
    CAST(0 AS BIGINT) AS deleted FROM acted GROUP BY group_id""",
)
def action_counts(spark, sf):
    return S.action_counts(K.recommended(exact(spark, sf)[0], MARKERS))


@query(
    "unsafe_groups",
    f"""WITH {ACTED} SELECT CAST(group_id AS BIGINT) AS group_id FROM (SELECT group_id, CASE WHEN is_keeper AND group_id % 3 = 0 THEN 'DELETE' ELSE action END AS a FROM acted)
    GROUP BY group_id HAVING bool_and(a IN ('DELETE', 'DELETED'))""",
)
def unsafe_groups(spark, sf):
    """Every third group's keeper is marked too."""
    rows = K.recommended(exact(spark, sf)[0], MARKERS)
    return S.unsafe_groups(rows.withColumn("action", F.when(F.col("is_keeper") & (F.col("group_id") % 3 == 0), "DELETE").otherwise(F.col("action"))))


@query(
    "deleted_session",
    f"""WITH {ACTED} SELECT CAST(group_id AS BIGINT) AS group_id, id,
    CASE WHEN action = 'DELETE' AND id % 2 = 0 THEN 'DELETED' ELSE CASE WHEN is_keeper THEN 'KEEP' ELSE 'DELETE' END END AS action FROM acted""",
)
def deleted_session(spark, sf):
    """The even ones of what is marked are deleted, then all groups are recommended again."""
    members, groups = exact(spark, sf)
    session = S.Session(members, groups, MARKERS)
    session.mark_deleted_paths(session.delete_candidates().where("id % 2 = 0"))
    session.apply_recommended_to_all(MARKERS)
    return session.with_actions().select("group_id", "id", "action")


_MODES_SQL = {
    "group": "group_id {d}, path {d}",
    "action": "CASE action WHEN 'DELETE' THEN 0 WHEN 'KEEP' THEN 1 ELSE 2 END {d}, group_id {d}, path {d}",
    "kind": "group_id {d}, path {d}",
    "score": "group_id {d}, path {d}",
    "size": "size {d}, group_id {d}, path {d}",
    "name": "name {d}, group_id {d}",
    "root": "root {d}, group_id {d}, path {d}",
    "mtime": "mtime {d}, group_id {d}, path {d}",
    "path": "path {d}",
}


def _ranks_sql() -> str:
    ranks = [f"CAST(row_number() OVER (ORDER BY {keys.format(d=d)}, group_id, pos) AS BIGINT) AS {mode}_{d.lower()}" for mode, keys in _MODES_SQL.items() for d in ("ASC", "DESC")]
    return f"WITH {ACTED} SELECT id, {', '.join(ranks)} FROM acted"


@query("session_rows_by_mode", _ranks_sql())
def session_rows_by_mode(spark, sf):
    """Every row's place in each order of a session's rows, ascending and descending."""
    members, groups = exact(spark, sf)
    rows = materialize(S.Session(members, groups, MARKERS).rows(), "rows")
    out = rows.select("id")
    for mode in V.SORT_MODES:
        for name, down in (("asc", False), ("desc", True)):
            place = G.numbered(rows, V.sort_order(mode, down), "_at").select("id", F.col("_at").alias(f"{mode}_{name}"))
            out = out.join(place, "id")
    return out


@query(
    "group_details",
    f"""WITH {ACTED}, h AS (SELECT group_id, substr(sha256('kind' || chr(0) || 'exact' || chr(0) || 'score' || chr(0) || '100' || chr(0) || 'reason' || chr(0) || 'exact' || chr(0)
      || string_agg('record' || chr(0) || path || chr(0) || root || chr(0) || size || chr(0) || exact_hash || chr(0), '' ORDER BY path, id)), 1, 12) AS k FROM members GROUP BY group_id)
    SELECT CAST(group_id AS BIGINT) AS group_id, 'Group ' || group_id || ': files=' || count(*) || ' key=' || any_value(k) || ' kind=exact score=100 keep=' || count(*) FILTER (action = 'KEEP')
      || ' delete=' || count(*) FILTER (action = 'DELETE') || ' deleted=0' AS detail FROM acted JOIN h USING (group_id) GROUP BY group_id""",
)
def group_details(spark, sf):
    members, groups = exact(spark, sf, True)
    return V.group_details(S.Session(members, groups, MARKERS).rows())


def _bytes_sql(x: str) -> str:
    return f"CASE WHEN {x} < 1024 THEN format('{{:,}}', {x}::BIGINT) || ' B' WHEN {x} < 1048576 THEN format('{{:,.2f}}', {x} / 1024.0::DOUBLE) || ' KB' ELSE format('{{:,.2f}}', {x} / 1048576.0::DOUBLE) || ' MB' END"


@query(
    "session_summary",
    f"""WITH {ACTED}, t AS (SELECT count(*) AS n, sum(size) AS b, count(*) FILTER (action = 'DELETE') AS dn, sum(size) FILTER (action = 'DELETE') AS db, count(DISTINCT group_id) AS g FROM acted)
    SELECT 'scanned=' || format('{{:,}}', (SELECT count(*) FROM documents)) || ' groups=' || format('{{:,}}', g) || ' candidates=' || format('{{:,}}', n) || ' bytes=' || {_bytes_sql("b")}
      || ' delete=' || format('{{:,}}', dn) || ' (' || {_bytes_sql("db")} || ')' AS summary FROM t""",
)
def session_summary(spark, sf):
    members, groups = exact(spark, sf)
    return V.summary(T.document_files(docs(spark, sf)), groups, S.Session(members, groups, MARKERS).with_actions())


@query(
    "hamming_search",
    f"""WITH {PRINTS} SELECT q.id AS query_id, p.id, CAST(bit_count(xor(q.dhash, p.dhash)) AS INT) AS distance FROM prints q JOIN prints p ON q.id % 100 = 0 WHERE bit_count(xor(q.dhash, p.dhash)) <= 4""",
)
def hamming_search(spark, sf):
    """Every hundredth document against all."""
    prints = materialize(T.document_prints(docs(spark, sf)).select("id", "dhash"), "prints")
    return E.hamming_search(prints, prints.where("id % 100 = 0"), 4, 63)


@query("dhash_fingerprints", f"WITH {PRINTS} SELECT id, width, height, content_hash, dhash FROM prints")
def dhash_fingerprints(spark, sf):
    return T.document_prints(docs(spark, sf)).select("id", "width", "height", "content_hash", "dhash")


@query(
    "hamming_pairs",
    f"""WITH {PRINTS} SELECT l.id AS src, r.id AS dst, CAST(bit_count(xor(l.dhash, r.dhash)) AS INT) AS distance FROM prints l JOIN prints r ON l.id < r.id
    WHERE bit_count(xor(l.dhash, r.dhash)) <= 4 AND abs(l.duration - r.duration) <= greatest(0.5, greatest(l.duration, r.duration) * 0.01)""",
)
def hamming_pairs(spark, sf):
    """Pairs of hashes with at most four differing bits whose lengths match."""
    prints = T.document_prints(docs(spark, sf)).select("id", "dhash", "duration")
    return E.hamming_pairs(prints, [], 4, [], 63, "duration")


@query("image_edges", f"WITH {IMAGE} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, reason, score FROM image_edges")
def image_edges(spark, sf):
    return E.image_edges(materialize(T.document_prints(docs(spark, sf)), "prints"), 4, 63)


@query(
    "similarity_scores",
    """SELECT t AS threshold, d AS distance, CAST(CASE WHEN t <= 0 THEN CASE WHEN d = 0 THEN 100 ELSE 0 END
    ELSE greatest(0, least(100, 100 - round_even(d / t::DOUBLE * 20, 0))) END AS INT) AS score FROM (SELECT unnest(range(0, 17)) AS t) CROSS JOIN (SELECT unnest(range(0, 65)) AS d)""",
)
def similarity_scores(spark, sf):
    grid = spark.range(65).select(F.col("id").alias("distance"))
    parts = [grid.select(F.lit(t).cast("long").alias("threshold"), "distance", M.similarity_score(F.col("distance"), t).alias("score")) for t in range(17)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("components", recursive(f"{MIXED} SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM labels"))
def components(spark, sf):
    prints = materialize(T.document_prints(docs(spark, sf)), "prints")
    return connected_components(E.exact_edges(T.hashed_documents(docs(spark, sf))).unionByName(E.image_edges(prints, 4, 63, forest=True)))


@query(
    "mixed_groups",
    recursive(f"""{MIXED} SELECT CAST(row_number() OVER (ORDER BY n_members DESC, kind, first_path, component) AS BIGINT) AS group_id, kind, score, n_members,
    CAST(n_bytes AS BIGINT) AS n_bytes, first_path FROM mixed"""),
)
def mixed_groups(spark, sf):
    return mixed(spark, sf)[1].select("group_id", "kind", "score", "n_members", "n_bytes", F.col("first_path_cf").alias("first_path"))


@query(
    "embedding_hamming_pairs",
    """WITH e AS (SELECT vec_id AS id, embedding, generate_subscripts(embedding, 1) AS k, unnest(embedding) AS x FROM embeddings),
    h AS (SELECT id, CAST(sum(CASE WHEN x > nxt THEN CAST(1 AS HUGEINT) << (63 - k)::INT ELSE 0 END) AS BIGINT) AS dhash
      FROM (SELECT *, lead(x) OVER (PARTITION BY id ORDER BY k) AS nxt FROM e) GROUP BY id)
    SELECT l.id AS src, r.id AS dst, CAST(bit_count(xor(l.dhash, r.dhash)) AS INT) AS distance FROM h l JOIN h r ON l.id < r.id WHERE bit_count(xor(l.dhash, r.dhash)) <= 14""",
)
def embedding_hamming_pairs(spark, sf):
    prints = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), M.dhash(F.col("embedding"), 64, 1).alias("dhash"))
    return E.hamming_pairs(prints, [], 14, [], 63)


@query(
    "thumbnail_difference",
    f"""WITH {COUNTS.format(id="doc_id", text="text", source="documents")} SELECT l.id AS src, r.id AS dst,
    round(list_sum(list_transform(list_zip(l.thumbnail, r.thumbnail), lambda x: abs(x[1] - x[2]))) / 64.0::DOUBLE, 6) AS difference FROM hashes l JOIN hashes r ON r.id = l.id + 1""",
)
def thumbnail_difference(spark, sf):
    """The mean difference of each document's histogram and the next one's."""
    prints = materialize(T.document_prints(docs(spark, sf)).select("id", "thumbnail"), "thumbnails")
    left, right = prints.select(F.col("id").alias("src"), F.col("thumbnail").alias("a")), prints.select(F.col("id").alias("dst"), F.col("thumbnail").alias("b"))
    return left.join(right, left.src + 1 == right.dst).select("src", "dst", F.round(M.mean_difference(F.col("a"), F.col("b")), 6).alias("difference"))


DURATION = "l.width = r.width AND l.height = r.height AND l.id < r.id AND abs(l.duration - r.duration) <= greatest(0.5, greatest(l.duration, r.duration) * 0.01)"


def _video_sql(frames: int, side: str) -> str:
    cuts = " UNION ALL ".join(
        f"SELECT doc_id * 10 + {i} AS id, substr(text, CAST(floor(n_chars * {r!r}::DOUBLE) + 1 AS BIGINT), 200) AS text FROM documents" for i, r in enumerate(M.sample_ratios(frames))
    )
    return f"""cuts AS ({cuts}), {COUNTS.format(id="id", text="text", source="cuts")}, videos AS (
      SELECT d.doc_id AS id, length(lang) AS width, 1 AS height, CAST(n_chars AS DOUBLE) AS duration, list(dhash ORDER BY h.id) AS frames
      FROM documents d JOIN hashes h ON h.id // 10 = d.doc_id GROUP BY ALL
    ), looks AS (SELECT *, min(id) OVER (PARTITION BY width, height, duration, frames) AS look FROM videos), pairs AS (
      SELECT l.id AS src, r.id AS dst, list_transform(list_zip(l.frames, r.frames), lambda x: bit_count(xor(x[1], x[2]))) AS d FROM {side} l JOIN {side} r ON {DURATION}
    )"""


@query(
    "duration_compatible",
    f"""WITH v AS (SELECT doc_id AS id, length(lang) AS width, length(source) AS height, CAST(n_chars AS DOUBLE) AS duration FROM documents)
    SELECT DISTINCT id FROM (SELECT unnest([l.id, r.id]) AS id FROM v l JOIN v r ON {DURATION})""",
)
def duration_compatible(spark, sf):
    videos = docs(spark, sf).select(F.col("doc_id").alias("id"), F.length("lang").alias("width"), F.length("source").alias("height"), F.col("n_chars").cast("double").alias("duration"))
    return E.video_metadata_candidates(videos).select("id")


@query(
    "frame_pairs",
    f"""WITH {_video_sql(5, "(SELECT * FROM looks WHERE id = look)")} SELECT src, dst, 'video' AS reason, CAST(greatest(0, least(100, 100 - round_even(list_sum(d) / 60.0::DOUBLE * 20, 0))) AS INT) AS score
    FROM pairs WHERE list_sum(d) <= 60 AND len(list_filter(d, lambda x: x <= 14)) >= 4 UNION ALL SELECT look, id, 'video', 100 FROM looks WHERE id <> look""",
)
def frame_pairs(spark, sf):
    return E.video_edges(T.document_videos(docs(spark, sf), 5), VIDEO, 63)


@query(
    "prelim_bound",
    f"""WITH {_video_sql(2, "videos")} SELECT DISTINCT id FROM (SELECT unnest([src, dst]) AS id FROM pairs WHERE list_sum(d) <= 60 AND 5 - len(list_filter(d, lambda x: x > 14)) >= 4)""",
)
def prelim_bound(spark, sf):
    return E.video_frame_candidates(materialize(T.document_videos(docs(spark, sf), 2), "videos"), VIDEO, 63).select("id")


@query(
    "sample_positions",
    """SELECT doc_id AS id, array_to_string([printf('%.3f', CASE WHEN n_chars / 100.0::DOUBLE > 1 THEN greatest(0.0::DOUBLE, n_chars / 100.0::DOUBLE * (0.1::DOUBLE + 0.8::DOUBLE / 4 * i)) ELSE 0.0::DOUBLE END)
    FOR i IN range(5)], ' ') AS positions FROM documents""",
)
def sample_positions(spark, sf):
    places = F.transform(M.sample_positions(F.col("n_chars") / 100.0, 5), lambda p: F.format_string("%.3f", p))
    return docs(spark, sf).select(F.col("doc_id").alias("id"), F.array_join(places, " ").alias("positions"))


@query(
    "log_dedupe",
    """SELECT user_id, event_id, event_type AS message FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type <> ''
      ) WHERE before IS NULL OR before <> event_type
    ) WHERE n <= 5""",
)
def log_dedupe(spark, sf):
    """Each user's events as a log: runs of one type count once, and the last five lines stay."""
    events = T.read(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("message"))
    return V.log_lines(events, ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "message")


@query(
    "probe_output_parse",
    """SELECT doc_id AS id, CAST(100 + doc_id % 7 AS INT) AS width, CAST(200 + doc_id % 5 AS INT) AS height, n_chars / 8.0::DOUBLE AS duration FROM documents WHERE doc_id % 3 <> 0""",
)
def probe_output_parse(spark, sf):
    """Values from lines key=value, of which the first of a key counts; texts without all three give nothing."""
    output = F.concat(
        F.lit("noise\nwidth= "), (100 + F.col("doc_id") % 7).cast("string"), F.lit("\r\nheight ="), (200 + F.col("doc_id") % 5).cast("string"), F.lit("\nwidth=9\n"),
        F.when(F.col("doc_id") % 3 == 0, "duration=N/A").otherwise(F.concat(F.lit("duration="), (F.col("n_chars") / 8).cast("string"))),
    )
    rows = docs(spark, sf).select(F.col("doc_id").alias("id"), output.alias("o"))
    cast = lambda key, kind: M.probe_value(F.col("o"), key).try_cast(kind).alias(key)
    return rows.select("id", cast("width", "int"), cast("height", "int"), cast("duration", "double")).dropna()


@query("page_names", r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_extract(regexp_extract(url, '[^/]*$'), '^\.*[^.].*?(\.[^.]*)$', 1) AS extension FROM pages""")
def page_names(spark, sf):
    name = P.base_name(F.col("url"))
    return T.read(spark, sf, "pages").select("page_id", name.alias("name"), P.extension(name).alias("extension"))
