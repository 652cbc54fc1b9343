"""Schemas of the data model. Nanoseconds are LONG: TimestampType holds microseconds only."""

from __future__ import annotations

FILES = "snapshot_id string, path string, size long, mode int, mtime_ns long, ctime_ns long, raw_hash string, norm_hash string, line_ending string, fast_hash string, is_symlink boolean, target_path string"
SNAPSHOTS = "snapshot_id string, snapshot_idx int, timestamp double, source_path string"
OPERATIONS = "pair_idx int, from_id string, to_id string, op_type string, file_id string, source_path string, target_path string, old_hash string, new_hash string, confidence double"
CONFLICTS = "hash string, source_paths array<string>, target_paths array<string>, conflict_type string, confidence_a double, confidence_b double"
MANIFEST = (
    "id string, timestamp double, source_path string, files array<struct<path:string,size:bigint,mode:int,mtime_ns:bigint,ctime_ns:bigint,raw_hash:string,"
    "norm_hash:string,line_ending:string,fast_hash:string,is_symlink:boolean,target_path:string>>"
)
#: The kinds of operation and of line ending.
OP_TYPES = ("create", "delete", "modify", "rename", "move", "copy")
LINE_ENDINGS = ("crlf", "lf", "mixed", "binary", "unknown")
