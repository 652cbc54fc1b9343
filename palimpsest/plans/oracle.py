"""The registered queries as DuckDB SQL."""

from __future__ import annotations

_HEAD = r"""
WITH RECURSIVE raw AS (
 SELECT doc_id, v, 'F' || (doc_id % 3) || '/S' || v AS snapshot_id,
  CASE WHEN (doc_id + v) % 11 = 0 THEN 'moved/' || doc_id || '.txt' WHEN (doc_id + v) % 7 = 0 THEN 'p' || (doc_id % 5) || '/' || doc_id || '_r.txt'
       ELSE 'p' || (doc_id % 5) || '/' || doc_id || '.txt' END AS path,
  CASE WHEN doc_id % 17 = v THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 5 = 0 AND v >= doc_id % 6 THEN text || ' v' || v ELSE text END AS content
 FROM documents, range(0, 6) AS t(v) WHERE (doc_id + 3 * v) % 13 <> 0
 UNION ALL SELECT doc_id, v, 'F' || (doc_id % 3) || '/S' || v, 'copy/' || doc_id || '.txt', text FROM documents, range(3, 6) AS t(v) WHERE doc_id % 19 = 0),
files AS MATERIALIZED (SELECT snapshot_id, path, strlen(content)::BIGINT AS size, (33188 + (doc_id + v) % 2 * 73)::INT AS mode,
  ((1700000000 + doc_id * 60 + v * 7200) * 1000000000)::BIGINT AS mtime_ns, sha256(content) AS raw_hash, sha256(replace(content, chr(13) || chr(10), chr(10))) AS norm_hash,
  md5(content) AS fast_hash, content FROM raw),
snaps AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) - 1 AS snapshot_idx,
  (1700000000 + substr(snapshot_id, 2, 1)::INT * 20000 + substr(snapshot_id, 5, 1)::INT ** 2 * 900)::DOUBLE AS timestamp, CASE WHEN substr(snapshot_id, 5, 1)::INT < 3 THEN '/data/' ELSE '/mnt/' END || substr(snapshot_id, 1, 2) AS source_path
  FROM (SELECT DISTINCT snapshot_id FROM files))"""
_DOCS = r"""
WITH RECURSIVE files AS (SELECT source AS snapshot_id, lang || '/' || (doc_id // 20) || '.txt' AS path, sha256(text) AS raw_hash,
  sha256(replace(text, chr(13) || chr(10), chr(10))) AS norm_hash, strlen(text)::BIGINT AS size FROM documents)"""
_CLUSTERS = r""",
e AS (SELECT DISTINCT a.path AS p, b.path AS q FROM (SELECT DISTINCT path, raw_hash FROM files) a
      JOIN (SELECT raw_hash, min(path) AS path FROM files GROUP BY 1) b USING (raw_hash)),
e2 AS (SELECT p, q FROM e UNION SELECT q, p FROM e),
reach(p, q) AS (SELECT p, q FROM e2 UNION SELECT r.p, e2.q FROM reach r JOIN e2 ON r.q = e2.p),
cl AS MATERIALIZED (SELECT p AS path, 'default:' || min(q) AS cluster_uid FROM reach GROUP BY p),
obs AS MATERIALIZED (SELECT cluster_uid, snapshot_id, snapshot_idx, path, raw_hash, norm_hash FROM files JOIN cl USING (path) JOIN snaps USING (snapshot_id))"""
_CHANGE = "CASE WHEN regexp_extract({0}, '[^/]*$') = regexp_extract({1}, '[^/]*$') AND regexp_extract({0}, '^(.*)/[^/]*$', 1) <> regexp_extract({1}, '^(.*)/[^/]*$', 1) THEN 'move' ELSE 'rename' END"
_OPS = (
    _CLUSTERS
    + r""",
h AS (SELECT cluster_uid, snapshot_idx, list(path ORDER BY path) AS ps FROM obs GROUP BY ALL),
pairs AS (SELECT coalesce(a.cluster_uid, b.cluster_uid) AS c, coalesce(a.snapshot_idx, b.snapshot_idx - 1) AS i, coalesce(a.ps, []) AS pa, coalesce(b.ps, []) AS pb,
   list_min(list_intersect(a.ps, b.ps)) AS m
  FROM (SELECT * FROM h WHERE snapshot_idx < (SELECT max(snapshot_idx) FROM snaps)) a
  FULL OUTER JOIN (SELECT * FROM h WHERE snapshot_idx > 0) b ON a.cluster_uid = b.cluster_uid AND b.snapshot_idx = a.snapshot_idx + 1),
pk AS (SELECT *, coalesce(m, list_min(pa)) AS x, coalesce(m, list_min(pb)) AS y FROM pairs),
fi AS (SELECT path, snapshot_idx, raw_hash, norm_hash FROM files JOIN snaps USING (snapshot_id)),
pr AS (SELECT pk.*, fa.raw_hash AS rx, fb.raw_hash AS ry, fa.norm_hash AS nx, fb.norm_hash AS ny FROM pk
  LEFT JOIN fi fa ON fa.path = x AND fa.snapshot_idx = i LEFT JOIN fi fb ON fb.path = y AND fb.snapshot_idx = i + 1),
main AS (
 SELECT i, 'delete' AS t, x AS s, NULL AS d, rx AS o, NULL AS n, 1.0::DOUBLE AS cf FROM pr WHERE len(pa) > 0 AND (len(pb) = 0 OR (x <> y AND rx <> ry AND nx <> ny))
 UNION ALL SELECT i, 'create', NULL, y, NULL, ry, 1.0 FROM pr WHERE len(pb) > 0 AND (len(pa) = 0 OR (x <> y AND rx <> ry AND nx <> ny))
 UNION ALL SELECT i, 'modify', x, x, rx, ry, 1.0 FROM pr WHERE x = y AND rx <> ry
 UNION ALL SELECT i, """
    + _CHANGE.format("x", "y")
    + r""", x, y, rx, ry, CASE WHEN rx = ry THEN 1.0 ELSE 0.8 END FROM pr WHERE x <> y AND (rx = ry OR nx = ny)),
ex AS (SELECT i, pa, unnest(pb) AS d, y FROM pr WHERE len(pa) > 0 AND len(pb) > 0),
ex2 AS (SELECT ex.i, ex.d, f.raw_hash AS hh, (SELECT min(g.path) FROM fi g WHERE g.snapshot_idx = ex.i AND g.raw_hash = f.raw_hash AND list_contains(ex.pa, g.path)) AS own,
   (SELECT min(g.path) FROM fi g WHERE g.snapshot_idx = ex.i AND g.raw_hash = f.raw_hash) AS anyp
  FROM ex JOIN fi f ON f.path = ex.d AND f.snapshot_idx = ex.i + 1 WHERE NOT list_contains(pa, d) AND d <> y),
ops AS (SELECT i, t, s, d, o, n, cf FROM main
 UNION ALL SELECT i, CASE WHEN anyp IS NULL THEN 'create' ELSE 'copy' END, coalesce(own, anyp), d, CASE WHEN anyp IS NOT NULL THEN hh END, hh, 1.0 FROM ex2),
operations AS (SELECT i::INT AS pair_idx, a.snapshot_id AS from_id, b.snapshot_id AS to_id, t AS op_type, coalesce(s, d) AS file_id, s AS source_path, d AS target_path, o AS old_hash, n AS new_hash, cf AS confidence
 FROM ops JOIN snaps a ON a.snapshot_idx = i JOIN snaps b ON b.snapshot_idx = i + 1)"""
)
_INDEX = ", ix AS (SELECT snapshot_id, path, coalesce(norm_hash, raw_hash) AS hash FROM files), fr AS (SELECT hash, count(DISTINCT snapshot_id) AS freq FROM ix GROUP BY hash)"


def _jaccard(head: str, where: str) -> str:
    return head + _INDEX + f""",
k AS (SELECT DISTINCT snapshot_id, hash FROM ix JOIN fr USING (hash) WHERE {where}), n AS (SELECT snapshot_id, count(*) AS c FROM k GROUP BY 1),
j AS (SELECT a.snapshot_id AS a, b.snapshot_id AS b, count(*) AS shared FROM k a JOIN k b ON a.hash = b.hash AND a.snapshot_id < b.snapshot_id GROUP BY ALL)
SELECT a, b, shared, x.c AS n_a, y.c AS n_b, shared / (x.c + y.c - shared) AS jaccard FROM j JOIN n x ON x.snapshot_id = a JOIN n y ON y.snapshot_id = b"""


_RARE = "freq * freq < (SELECT count(DISTINCT snapshot_id) FROM files)"
_MATCH = ", k AS (SELECT snapshot_idx AS i, raw_hash AS hash, min(path) AS low FROM files JOIN snaps USING (snapshot_id) GROUP BY ALL) SELECT a.i::INT AS idx_a, b.i::INT AS idx_b, a.hash, least(a.low, b.low) AS path FROM k a JOIN k b ON a.hash = b.hash AND "
_SIDES = ", a AS (SELECT * FROM files WHERE snapshot_id = 'F0/S1'), b AS (SELECT * FROM files WHERE snapshot_id = 'F0/S2')"
_CONTENT = "CASE WHEN a.size <> b.size THEN 1.0 WHEN a.raw_hash = b.raw_hash THEN 0.0 WHEN a.fast_hash = b.fast_hash THEN 0.3 ELSE 0.6 END"
_META = "((CASE WHEN abs(a.mtime_ns - b.mtime_ns) < 3600000000000 THEN 0.0 WHEN abs(a.mtime_ns - b.mtime_ns) < 86400000000000 THEN 0.5 ELSE 1.0 END) + (CASE WHEN a.mode & 4095 = b.mode & 4095 THEN 0.0 ELSE 0.5 END)) / 2"
_KB = ", kb AS (SELECT raw_hash AS hash, 'known-' || min(path) AS cluster_uid FROM files WHERE snapshot_id = 'F0/S0' GROUP BY 1)"

SQL: dict[str, str] = {
    "history_operations": _HEAD + _OPS + " SELECT * FROM operations",
    "op_counts_by_pair": _HEAD + _OPS + " SELECT pair_idx, op_type, count(*) AS n, count(DISTINCT file_id) AS files FROM operations GROUP BY ALL",
    "subtree_filter": _HEAD
    + _OPS
    + """ SELECT pair_idx, op_type, file_id, CASE WHEN starts_with(source_path, 'p1/') THEN substr(source_path, 4) ELSE source_path END AS source_path,
 CASE WHEN starts_with(target_path, 'p1/') THEN substr(target_path, 4) ELSE target_path END AS target_path FROM operations
 WHERE coalesce(starts_with(source_path, 'p1/'), false) OR coalesce(starts_with(target_path, 'p1/'), false)""",
    "duplicate_file_ids": _HEAD + _OPS + " SELECT pair_idx, file_id, count(*) - 1 AS repeats FROM operations GROUP BY ALL HAVING count(*) > 1",
    "identity_exact": _HEAD + _CLUSTERS + " SELECT cluster_uid, snapshot_id, path FROM obs",
    "identity_blocking": _HEAD + _CLUSTERS + " SELECT cluster_uid, snapshot_id, path FROM obs",
    "identity_canonical_path": _HEAD
    + _CLUSTERS
    + """, s AS (SELECT cluster_uid, path, count(DISTINCT snapshot_id) AS n, min(snapshot_id) AS f FROM obs GROUP BY ALL)
 SELECT cluster_uid, path AS canonical_path, n FROM s QUALIFY row_number() OVER (PARTITION BY cluster_uid ORDER BY n DESC, f, path) = 1""",
    "match_consecutive": _HEAD + _MATCH + "b.i = a.i + 1",
    "match_all_pairs": _HEAD + _MATCH + "a.i < b.i",
    "inverted_index": _DOCS + " SELECT coalesce(norm_hash, raw_hash) AS hash, snapshot_id, path FROM files",
    "hash_frequency": _DOCS + _INDEX + " SELECT hash, freq FROM fr",
    "idf_jaccard_pairs": _jaccard(_HEAD, _RARE),
    "plain_jaccard_pairs": _jaccard(_DOCS, "true"),
    "weighted_jaccard_pairs": _DOCS
    + _INDEX
    + """, w AS (SELECT snapshot_id AS id, hash, count(*)::DOUBLE AS weight FROM ix GROUP BY ALL), s AS (SELECT id, sum(weight) AS t FROM w GROUP BY id),
 l AS (SELECT a.id AS a, b.id AS b, sum(least(a.weight, b.weight)) AS low FROM w a JOIN w b ON a.hash = b.hash AND a.id < b.id GROUP BY ALL)
 SELECT a, b, low / (x.t + y.t - low) AS jaccard FROM l JOIN s x ON x.id = a JOIN s y ON y.id = b""",
    "project_groups": _jaccard(_HEAD, _RARE).replace("SELECT a, b, shared, x.c", ", jp AS (SELECT a, b, shared, x.c").replace("\n, jp", ", jp")
    + """ WHERE shared / (x.c + y.c - shared) > 0.5), je AS (SELECT a AS p, b AS q FROM jp UNION SELECT b, a FROM jp UNION SELECT DISTINCT snapshot_id, snapshot_id FROM files),
 jr(p, q) AS (SELECT p, q FROM je UNION SELECT jr.p, je.q FROM jr JOIN je ON jr.q = je.p) SELECT min(q) AS project_uid, p AS snapshot_id FROM jr GROUP BY p""",
    "project_fingerprint": _DOCS + " SELECT snapshot_id, sha256(string_agg(coalesce(norm_hash, raw_hash), '' ORDER BY coalesce(norm_hash, raw_hash))) AS fingerprint FROM files GROUP BY 1",
    "content_probe": _HEAD
    + """, r AS (SELECT DISTINCT norm_hash AS h FROM files WHERE snapshot_id = 'F0/S0' AND path LIKE 'p1/%'),
 d AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root, r.h FROM files f LEFT JOIN r ON r.h = f.norm_hash WHERE snapshot_id = 'F0/S1'),
 s AS (SELECT root, count(h) / count(*) AS score FROM d GROUP BY root) SELECT root, score FROM s WHERE score >= 0.3 ORDER BY score DESC, root LIMIT 1""",
    "rebase_paths": _HEAD + " SELECT snapshot_id, CASE WHEN snapshot_id LIKE 'F1/%' AND starts_with(path, 'p2/') THEN substr(path, 4) ELSE path END AS path, raw_hash FROM files",
    "line_ending_class": _HEAD
    + """, c AS (SELECT snapshot_id, path, substr(content, 1, 8192) AS c FROM files)
 SELECT snapshot_id, path, CASE WHEN contains(c, chr(13) || chr(10)) THEN CASE WHEN contains(replace(c, chr(13) || chr(10), ''), chr(10)) THEN 'mixed' ELSE 'crlf' END ELSE 'lf' END AS line_ending FROM c""",
    "normalized_hash": _HEAD + " SELECT snapshot_id, path, norm_hash, norm_hash <> raw_hash AS differs FROM files",
    "path_change_class": _HEAD
    + ", p AS (SELECT DISTINCT raw_hash, path FROM files) SELECT a.path AS old, b.path AS new, "
    + _CHANGE.format("a.path", "b.path")
    + " AS kind, count(*) AS n FROM p a JOIN p b ON a.raw_hash = b.raw_hash AND a.path < b.path GROUP BY ALL",
    "content_cost": _HEAD + _SIDES + f" SELECT a.path, ({_CONTENT})::DOUBLE AS cost FROM a JOIN b USING (path)",
    "metadata_cost": _HEAD + _SIDES + f" SELECT a.path, ({_META})::DOUBLE AS cost FROM a JOIN b USING (path)",
    "path_cost": _HEAD + _SIDES + " SELECT a.path AS path_a, b.path AS path_b, round(1 - jaro_winkler_similarity(a.path, b.path), 6) AS cost FROM a JOIN b USING (norm_hash)",
    "fused_matches": _HEAD
    + _SIDES
    + f", p AS (SELECT a.path AS path_a, b.path AS path_b, ({_CONTENT}) * 0.6 + (1 - jaro_winkler_similarity(a.path, b.path)) * 0.3 + ({_META}) * 0.1 AS cost FROM a JOIN b ON a.size = b.size) SELECT path_a, path_b, round(cost, 6) AS cost FROM p WHERE cost < 0.5",
    "root_changes": _HEAD + ", l AS (SELECT snapshot_id, source_path, lag(source_path) OVER (ORDER BY snapshot_idx) AS f FROM snaps) SELECT snapshot_id, f AS from_root, source_path AS to_root FROM l WHERE f <> source_path",
    "timeline_parent": _HEAD
    + _OPS
    + """, o AS (SELECT pair_idx + 1 AS snapshot_idx, count(*) AS k FROM operations GROUP BY 1)
 SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY s.snapshot_idx) AS parent_id, coalesce(k, 0) AS n_ops FROM snaps s LEFT JOIN o ON o.snapshot_idx = s.snapshot_idx""",
    "temporal_groups": """WITH e AS (SELECT event_id, user_id, epoch(ts) AS t FROM events),
 s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS st FROM e)
 SELECT event_id, user_id, (sum(st) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS group_no FROM s""",
    "dag_roots_leaves": """WITH e AS (SELECT 'n' || doc_id AS c, 'n' || (doc_id // 2) AS p FROM documents WHERE doc_id > 0), i AS (SELECT c AS id FROM e UNION SELECT p FROM e)
 SELECT id AS snapshot_id, id NOT IN (SELECT c FROM e) AS is_root, id NOT IN (SELECT p FROM e) AS is_leaf FROM i""",
    "dag_fork_merge": """WITH e AS (SELECT 'n' || doc_id AS c, 'n' || (doc_id // 2) AS p FROM documents WHERE doc_id > 0), i AS (SELECT c AS id FROM e UNION SELECT p FROM e)
 SELECT id AS snapshot_id, (SELECT count(DISTINCT c) FROM e WHERE p = id) > 1 AS is_fork, (SELECT count(DISTINCT p) FROM e WHERE c = id) > 1 AS is_merge FROM i""",
    "coverage_antijoin": _HEAD + " SELECT snapshot_id, path, raw_hash AS hash FROM files WHERE NOT starts_with(path, 'p')",
    "path_discontinuity": _HEAD
    + " SELECT path, count(DISTINCT source_path) AS roots, min(source_path) AS first_root FROM files JOIN snaps USING (snapshot_id) GROUP BY path HAVING count(DISTINCT source_path) > 1",
    "temporal_overlap": _HEAD + " SELECT a.source_path AS source, b.source_path AS target FROM snaps a JOIN snaps b ON abs(a.timestamp - b.timestamp) < 1.0 AND a.snapshot_id <= b.snapshot_id",
    "hash_multi_path": _HEAD + " SELECT raw_hash AS hash, count(DISTINCT path) AS paths, min(path) AS first_path FROM files GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "kb_probe": _HEAD + _KB + " SELECT snapshot_id, path, cluster_uid FROM files LEFT JOIN kb ON kb.hash = raw_hash",
    "kb_frequencies": _HEAD + " SELECT norm_hash AS hash, count(*) AS freq FROM files GROUP BY 1",
    "kb_identities_update": _HEAD
    + _KB
    + ", f AS (SELECT raw_hash AS hash, count(*) AS freq FROM files GROUP BY 1) SELECT hash, cluster_uid, least(1.0, freq * 0.1)::DOUBLE AS confidence FROM kb JOIN f USING (hash) WHERE freq * 0.1 >= 0.3",
    "kb_projects_update": _HEAD
    + """, n AS (SELECT substr(snapshot_id, 1, 2) AS uid, norm_hash AS hash, 1.0 AS x FROM files WHERE snapshot_id LIKE '%S1' GROUP BY ALL),
 k AS (SELECT substr(snapshot_id, 1, 2) AS uid, norm_hash AS hash, 1.0 AS y FROM files WHERE snapshot_id LIKE '%S0' GROUP BY ALL),
 j AS (SELECT coalesce(n.uid, k.uid) AS uid, sum(least(coalesce(x, 0), coalesce(y, 0))) / sum(greatest(coalesce(x, 0), coalesce(y, 0))) AS jaccard FROM n FULL JOIN k ON n.uid = k.uid AND n.hash = k.hash GROUP BY 1)
 SELECT uid, jaccard::DOUBLE AS jaccard FROM j WHERE jaccard >= 0.7""",
    "contradiction_resolution": _HEAD
    + _KB
    + """, f AS (SELECT raw_hash AS hash, count(*) AS freq FROM files GROUP BY 1),
 c AS (SELECT raw_hash AS hash, 'known-' || min(path) AS a, CASE WHEN count(DISTINCT path) > 1 THEN max(path) ELSE 'known-' || min(path) END AS b FROM files GROUP BY 1),
 r AS (SELECT c.hash, a, b, kb.cluster_uid AS cur, coalesce(freq, 0) AS freq FROM c LEFT JOIN kb USING (hash) LEFT JOIN f USING (hash))
 SELECT hash, CASE WHEN a <> b AND cur IS NOT NULL AND cur <> a AND cur <> b AND freq > 0 THEN 'EVIDENCE_WEIGHT' ELSE 'CONFIDENCE_WEIGHT' END AS strategy,
  (CASE WHEN a = b THEN 1.0 WHEN cur = a OR cur = b THEN least(0.5 + freq * 0.1, 0.95) WHEN freq > 0 AND cur IS NOT NULL THEN least(0.5 + freq * 0.05, 0.85) ELSE 0.5 END)::DOUBLE AS confidence FROM r""",
    "igs": _HEAD
    + """, c AS (SELECT min(path) AS a, max(path) AS b FROM files GROUP BY raw_hash HAVING count(DISTINCT path) > 1)
 SELECT 1 - (SELECT count(*) FROM c) / (SELECT count(DISTINCT u) FROM (SELECT a AS u FROM c UNION ALL SELECT b FROM c)) AS igs""",
    "discovery_classify": _HEAD
    + """, t AS (SELECT snapshot_id || '/' || path AS p FROM files),
 d AS (SELECT regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, true AS f, false AS s FROM t UNION ALL SELECT snapshot_id, false, true FROM files UNION ALL SELECT substr(snapshot_id, 1, 2), false, true FROM files)
 SELECT dir, CASE WHEN bool_or(f) AND bool_or(s) THEN 'mixed' WHEN bool_or(f) THEN 'files_only' ELSE 'dirs_only' END AS kind FROM d GROUP BY dir""",
}
SQL["diff_two_snapshots"] = SQL["history_operations"].replace("content FROM raw)", "content FROM raw WHERE snapshot_id IN ('F0/S1', 'F0/S2'))", 1)

_NEIGHBOURS = ", n AS (SELECT files.*, snapshot_idx FROM files JOIN snaps USING (snapshot_id)), a AS (SELECT *, snapshot_idx::INT AS pair_idx FROM n), b AS (SELECT *, (snapshot_idx - 1)::INT AS pair_idx FROM n)"
SQL["content_cost_consecutive"] = _HEAD + _NEIGHBOURS + f" SELECT a.pair_idx, a.path, ({_CONTENT})::DOUBLE AS cost FROM a JOIN b USING (pair_idx, path)"
SQL["metadata_cost_consecutive"] = _HEAD + _NEIGHBOURS + f" SELECT a.pair_idx, a.path, ({_META})::DOUBLE AS cost FROM a JOIN b USING (pair_idx, path)"
SQL["path_cost_consecutive"] = _HEAD + _NEIGHBOURS + " SELECT a.pair_idx, a.path AS path_a, b.path AS path_b, round(1 - jaro_winkler_similarity(a.path, b.path), 6) AS cost FROM a JOIN b USING (pair_idx, norm_hash)"
SQL["fused_matches_consecutive"] = (
    _HEAD
    + _NEIGHBOURS
    + f", p AS (SELECT a.pair_idx, a.path AS path_a, b.path AS path_b, ({_CONTENT}) * 0.6 + (1 - jaro_winkler_similarity(a.path, b.path)) * 0.3 + ({_META}) * 0.1 AS cost FROM a JOIN b ON a.pair_idx = b.pair_idx AND a.size = b.size) SELECT pair_idx, path_a, path_b, round(cost, 6) AS cost FROM p WHERE cost < 0.5"
)
