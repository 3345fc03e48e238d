"""Schemas of the change log and what belongs to it."""

from __future__ import annotations

#: One row per change; `sig` is optional.
LOG = (
    "id string, site_id string, lamport long, seq long, ts long, file_id string, kind string, merge_class string, parent string, "
    "base_hash string, result_hash string, path string, branch_id string, merge_parent string, sig binary"
)
FILES = "file_id string, path string, result_hash string, merge_class string, deleted boolean, lamport long, site_id string, conflict boolean"
BRANCH_RECORD = (
    "branch_id string, name string, parent string, fork_vv map<string, bigint>, created_lamport bigint, created_ts bigint, deleted boolean"
)
TAG_RECORD = (
    "tag_id string, name string, at_ts bigint, at_lamport bigint, branch_id string, created_lamport bigint, created_ts bigint, deleted boolean"
)
#: Rows of these kinds never change a file.
META_KINDS = ("branch", "tag")
NO_FILE_KINDS = ("merge", "branch", "tag")
ORDER_KEY = ("lamport", "site_id", "id")
MAIN = "main"
