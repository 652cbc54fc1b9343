"""The queries of `checks` as DuckDB SQL."""

from __future__ import annotations

from palimpsest.plans.oracle import _CLUSTERS, _DOCS, _HEAD, _INDEX, _KB, _OPS, _RARE, _jaccard

_FORGED = ", fo AS (SELECT * REPLACE (CASE WHEN op_type = 'copy' AND pair_idx % 5 = 0 THEN 'teleport' ELSE op_type END AS op_type) FROM operations)"
_INVALID = """, iv AS (
 SELECT coalesce(nullif(old_hash, ''), new_hash, '') AS hash, coalesce(source_path, '') AS source, coalesce(target_path, '') AS target, 'path_mismatch' AS conflict_type, confidence AS confidence_a
  FROM fo WHERE op_type NOT IN ('create', 'delete', 'modify', 'rename', 'move', 'copy')
 UNION ALL SELECT coalesce(nullif(old_hash, ''), new_hash, ''), coalesce(source_path, ''), coalesce(target_path, ''), 'temporal_overlap', confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_idx, file_id ORDER BY op_type, source_path NULLS FIRST, target_path NULLS FIRST) AS k FROM fo) WHERE k > 1)"""
_UNSEEN = """, un AS (
 SELECT '' AS hash, cluster_uid AS source, NULL::VARCHAR AS target, 'identity_mismatch' AS conflict_type, 0.0::DOUBLE AS confidence_a FROM obs GROUP BY cluster_uid HAVING NOT bool_or(path LIKE 'p%')
 UNION ALL SELECT raw_hash, path, NULL, 'identity_mismatch', 0.0 FROM files WHERE path NOT LIKE 'p%')"""
_ANCHORS = r""",
e AS (SELECT DISTINCT '1' || f.path AS p, '1' || b.path AS q FROM files f JOIN (SELECT raw_hash, min(path) AS path FROM files GROUP BY 1) b USING (raw_hash)
      UNION SELECT '1' || path, '0' || cluster_uid FROM files JOIN kb ON kb.hash = raw_hash),
e2 AS (SELECT p, q FROM e UNION SELECT q, p FROM e),
reach(p, q) AS (SELECT p, q FROM e2 UNION SELECT r.p, e2.q FROM reach r JOIN e2 ON r.q = e2.p),
low AS (SELECT p, min(q) AS q FROM reach GROUP BY p)"""
_PROJECTS = """, fp AS (SELECT snapshot_id, sha256(string_agg(coalesce(norm_hash, raw_hash), '' ORDER BY coalesce(norm_hash, raw_hash))) AS uid FROM files GROUP BY 1),
 kp AS (SELECT DISTINCT uid, snapshot_id, coalesce(norm_hash, raw_hash) AS hash FROM files JOIN fp USING (snapshot_id)
  WHERE snapshot_id = 'F0/S0' OR (snapshot_id = 'F1/S0' AND ascii(coalesce(norm_hash, raw_hash)) % 2 = 0)),
 km AS (SELECT f.uid, f.snapshot_id, count(k.hash) AS common, (SELECT count(DISTINCT k2.hash) FROM kp k2 WHERE k2.uid = f.uid) AS m,
   (SELECT count(DISTINCT coalesce(norm_hash, raw_hash)) FROM files x WHERE x.snapshot_id = f.snapshot_id) AS n
  FROM fp f JOIN (SELECT DISTINCT snapshot_id, coalesce(norm_hash, raw_hash) AS hash FROM files) o USING (snapshot_id) JOIN kp k ON k.uid = f.uid AND k.hash = o.hash GROUP BY ALL),
 matched AS (SELECT uid AS project_uid, snapshot_id FROM km WHERE common / (n + m - common) >= 0.7)"""
_LISTED = """, t AS (SELECT snapshot_id || '/' || path AS p FROM files{0}),
 d0 AS (SELECT regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir FROM t),
 up AS (SELECT DISTINCT array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') AS child FROM d0, range(1, 9) AS r(n) WHERE dir <> '' AND n <= len(string_split(dir, '/'))),
 li AS (SELECT dir, true AS f, false AS s FROM d0 UNION ALL SELECT regexp_extract(child, '^(.*)/[^/]*$', 1), false, true FROM up UNION ALL SELECT 'bare', false, false),
 ki AS (SELECT dir, CASE WHEN bool_or(f) AND bool_or(s) THEN 'mixed' WHEN bool_or(f) THEN 'files_only' WHEN bool_or(s) THEN 'dirs_only' ELSE 'empty' END AS kind FROM li GROUP BY dir)"""
_MERGES = """WITH d AS (SELECT doc_id FROM documents WHERE doc_id > 3),
 e AS (SELECT DISTINCT 'n' || p AS p, 'n' || doc_id AS c FROM (SELECT doc_id, doc_id // 2 AS p FROM d UNION ALL SELECT doc_id, doc_id // 3 FROM d WHERE doc_id % 7 = 0)),
 i AS (SELECT c AS id FROM e UNION SELECT p FROM e),
 n AS (SELECT id, (SELECT count(*) FROM e WHERE c = id) AS n_parents, (SELECT count(*) FROM e WHERE p = id) AS n_children FROM i)"""
_TEXT = "CASE WHEN doc_id % 10 = 0 THEN chr(0) || text WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 3 = 1 THEN chr(13) || chr(10) || text || chr(10) || chr(13) ELSE text END"

SQL: dict[str, str] = {
    "components_long_chain": """WITH e AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 97 <> 0),
 v AS (SELECT doc_id FROM e UNION SELECT doc_id - 1 FROM e),
 s AS (SELECT doc_id, sum(CASE WHEN doc_id IN (SELECT doc_id FROM e) THEN 0 ELSE 1 END) OVER (ORDER BY doc_id) AS part FROM v)
 SELECT md5(doc_id::VARCHAR) AS node, min(md5(doc_id::VARCHAR)) OVER (PARTITION BY part) AS component FROM s""",
    "identity_known": _HEAD
    + _KB
    + _ANCHORS
    + """ SELECT CASE WHEN q[1] = '0' THEN q[2:] ELSE 'default:' || q[2:] END AS cluster_uid, q[1] = '0' AS anchored, snapshot_id, path FROM files JOIN low ON p = '1' || path""",
    "identity_blocking_forged": _HEAD
    + """, g AS (SELECT path, raw_hash, size + CASE WHEN path LIKE 'copy/%' THEN 1 ELSE 0 END AS size FROM files),
e AS (SELECT DISTINCT g.path AS p, b.path AS q FROM g JOIN (SELECT raw_hash, size, min(path) AS path FROM g GROUP BY ALL) b USING (raw_hash, size)),
e2 AS (SELECT p, q FROM e UNION SELECT q, p FROM e), reach(p, q) AS (SELECT p, q FROM e2 UNION SELECT r.p, e2.q FROM reach r JOIN e2 ON r.q = e2.p),
cl AS (SELECT p AS path, 'default:' || min(q) AS cluster_uid FROM reach GROUP BY p) SELECT cluster_uid, snapshot_id, path FROM files JOIN cl USING (path)""",
    "cluster_of_path": _HEAD
    + _CLUSTERS
    + """, w AS (SELECT snapshot_id, path || CASE WHEN size % 2 = 0 THEN '' ELSE '~' END AS path FROM files WHERE size % 3 = 0)
 SELECT w.snapshot_id, w.path, (SELECT min(cluster_uid) FROM obs o WHERE o.snapshot_id = w.snapshot_id AND o.path = w.path) AS cluster_uid FROM w""",
    "project_groups_known": _jaccard(_HEAD + _PROJECTS, _RARE).replace("SELECT a, b, shared, x.c", ", jp AS (SELECT a, b, shared, x.c").replace("\n, jp", ", jp")
    + """ WHERE shared / (x.c + y.c - shared) > 0.5 AND a NOT IN (SELECT snapshot_id FROM matched) AND b NOT IN (SELECT snapshot_id FROM matched)),
 je AS (SELECT a AS p, b AS q FROM jp UNION SELECT b, a FROM jp UNION SELECT DISTINCT snapshot_id, snapshot_id FROM files WHERE snapshot_id NOT IN (SELECT snapshot_id FROM matched)),
 jr(p, q) AS (SELECT p, q FROM je UNION SELECT jr.p, je.q FROM jr JOIN je ON jr.q = je.p)
 SELECT min(q) AS project_uid, p AS snapshot_id FROM jr GROUP BY p UNION ALL SELECT project_uid, snapshot_id FROM matched""",
    "project_groups_delta": _HEAD + _PROJECTS + " SELECT project_uid, snapshot_id FROM matched",
    "plain_jaccard_with_empty": _jaccard(_DOCS, "true")
    + """ UNION ALL SELECT a, b, 0, 0, 0, 1.0 FROM (SELECT DISTINCT lang AS a FROM documents) JOIN (SELECT DISTINCT lang AS b FROM documents) ON a < b""",
    "empty_clusters": _HEAD + _CLUSTERS + _UNSEEN + " SELECT source AS cluster_uid, conflict_type, confidence_a FROM un WHERE hash = ''",
    "invalid_operations": _HEAD + _OPS + _FORGED + _INVALID + " SELECT * FROM iv",
    "consistency_report": _HEAD + _OPS + _FORGED + _INVALID + _UNSEEN + " SELECT *, false AS passes FROM (SELECT * FROM iv UNION ALL SELECT * FROM un)",
    "consistency_relaxed": _HEAD + _OPS + _FORGED + _INVALID + " SELECT *, false AS passes, 2 AS iterations FROM iv WHERE confidence_a >= 0.9",
    "cross_location": _HEAD
    + """, pr AS (SELECT DISTINCT a.snapshot_idx AS i FROM (SELECT * FROM files JOIN snaps USING (snapshot_id)) a JOIN (SELECT * FROM files JOIN snaps USING (snapshot_id)) b
   ON a.raw_hash = b.raw_hash AND b.snapshot_idx = a.snapshot_idx + 1),
 mt AS (SELECT i AS x, i + 1 AS y FROM pr UNION ALL SELECT snapshot_idx, snapshot_idx FROM snaps)
 SELECT '' AS hash, min(source_path) AS source, path AS target, 'path_mismatch' AS conflict_type, 0.5::DOUBLE AS confidence_a FROM files JOIN snaps USING (snapshot_id) GROUP BY path HAVING count(DISTINCT source_path) > 1
 UNION ALL SELECT '', a.source_path, b.source_path, 'temporal_overlap', 0.3 FROM mt JOIN snaps a ON a.snapshot_idx = x JOIN snaps b ON b.snapshot_idx = y WHERE abs(a.timestamp - b.timestamp) < 1
 UNION ALL SELECT raw_hash, NULL, min(path), 'identity_mismatch', 0.7 FROM files GROUP BY raw_hash HAVING count(DISTINCT path) > 1""",
    "kb_added_frequencies": _HEAD + " SELECT raw_hash AS hash, count(*) AS freq FROM files GROUP BY 1",
    "kb_records": _HEAD
    + """ SELECT min(raw_hash) AS hash, 'second' AS identity, NULL::VARCHAR AS other, 1 + count(*) FILTER (raw_hash = (SELECT min(raw_hash) FROM files)) AS freq,
 2.0::DOUBLE AS weight, 1 AS contradictions FROM files""",
    "kb_contradiction_candidates": _HEAD
    + _KB
    + _CLUSTERS
    + """, c AS (SELECT raw_hash AS hash FROM files GROUP BY 1 HAVING count(DISTINCT path) > 1),
 u AS (SELECT DISTINCT c.hash, o.cluster_uid FROM c JOIN files f ON f.raw_hash = c.hash JOIN cl o ON o.path = f.path AND o.path NOT LIKE 'moved/%'
  UNION SELECT c.hash, kb.cluster_uid FROM c JOIN kb USING (hash))
 SELECT c.hash, coalesce(l[1], 'unknown') AS identity_a, coalesce(l[2], 'unknown') AS identity_b FROM c LEFT JOIN (SELECT hash, list(cluster_uid ORDER BY cluster_uid) AS l FROM u GROUP BY hash) USING (hash)""",
    "kb_feedback": _HEAD
    + _CLUSTERS
    + """, c AS (SELECT raw_hash AS hash FROM files GROUP BY 1 HAVING count(DISTINCT path) > 1),
 u AS (SELECT DISTINCT c.hash, o.cluster_uid FROM c JOIN files f ON f.raw_hash = c.hash JOIN cl o ON o.path = f.path),
 w AS (SELECT hash, l[1] AS a, coalesce(l[2], 'unknown') AS b FROM (SELECT hash, list(cluster_uid ORDER BY cluster_uid) AS l FROM u GROUP BY hash))
 SELECT (SELECT count(*) FROM obs WHERE path LIKE 'p1/%') AS identities, (SELECT count(*) FROM snaps) AS projects, (SELECT count(*) FROM c) AS contradictions,
  1 - (SELECT count(*) FROM w) / (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM w UNION ALL SELECT b FROM w)) AS igs""",
    "discovery_depths": _HEAD
    + _LISTED.format(" UNION ALL VALUES ('readme.txt'), ('F0/notes.txt'), ('old/a/b/c.txt')")
    + """, fu AS (SELECT dir, len(string_split(dir, '/')) AS n FROM ki WHERE dir <> '' AND kind IN ('files_only', 'mixed'))
 SELECT 0 AS depth, '.' AS snapshot_dir FROM ki WHERE dir = '' AND kind IN ('files_only', 'mixed')
 UNION ALL SELECT 1, dir FROM ki WHERE dir <> '' AND NOT contains(dir, '/')
 UNION ALL SELECT 2, dir FROM fu WHERE n <= 2 AND NOT EXISTS (SELECT 1 FROM fu o WHERE o.n <= 2 AND starts_with(fu.dir, o.dir || '/'))
 UNION ALL SELECT -1, dir FROM fu WHERE NOT EXISTS (SELECT 1 FROM fu o WHERE starts_with(fu.dir, o.dir || '/'))""",
    "discovery_kinds": _HEAD + _LISTED.format("") + " SELECT dir, kind FROM ki",
    "content_hashes": f"""WITH x AS (SELECT doc_id, {_TEXT} AS t FROM documents WHERE text IS NOT NULL),
 y AS (SELECT doc_id, t, substr(t, 1, 8192) AS h, contains(substr(t, 1, 512), chr(0)) AS b FROM x)
 SELECT doc_id, CASE WHEN NOT b THEN sha256(replace(t, chr(13) || chr(10), chr(10))) END AS hash,
  CASE WHEN b THEN 'binary' WHEN contains(h, chr(13) || chr(10)) THEN CASE WHEN contains(replace(h, chr(13) || chr(10), ''), chr(10)) THEN 'mixed' ELSE 'crlf' END ELSE 'lf' END AS ending FROM y""",
    "temporal_groups_untimed": """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 10 <> 0 THEN epoch(ts) END AS t FROM events),
 s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t NULLS LAST, event_id) > 3600 THEN 1 ELSE 0 END AS st FROM e)
 SELECT event_id, user_id, (sum(st) OVER (PARTITION BY user_id ORDER BY t NULLS LAST, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS group_no FROM s""",
    "dag_merges": _MERGES
    + """, o AS (SELECT 'n' || doc_id AS id, sum((doc_id % 4 + 1) * CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END)::BIGINT AS operations FROM d GROUP BY 1)
 SELECT id AS snapshot_id, n_parents, n_children, n_parents = 0 AS is_root, n_children = 0 AS is_leaf, n_children > 1 AS is_fork, n_parents > 1 AS is_merge, coalesce(operations, 0) AS operations FROM n LEFT JOIN o USING (id)""",
    "dag_ordered_ends": _MERGES
    + """, k AS (SELECT id, 'root' AS kind FROM n WHERE n_parents = 0 UNION ALL SELECT id, 'leaf' FROM n WHERE n_children = 0),
 o AS (SELECT 'n' || doc_id AS id, max(-doc_id) AS pos FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1)
 SELECT kind, id AS snapshot_id, (row_number() OVER (PARTITION BY kind ORDER BY pos NULLS LAST, id) - 1)::INT AS place FROM k LEFT JOIN o USING (id)""",
}
