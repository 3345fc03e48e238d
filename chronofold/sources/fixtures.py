"""Change-log tables derived from the event stream, in SQL that Spark and DuckDB both run.

`«x»` stands for the hex SHA-256 of a string and SECS(x) for unix seconds of a zone-less timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from chronofold.sources.tables import stored

LOG = """
SELECT h.id, concat('s', cast(h.event_id % 5 AS string)) AS site_id, h.event_id + 1 AS lamport, h.seq,
       h.tsec AS ts, concat('f', cast(h.user_id AS string)) AS file_id, h.kind,
       CASE WHEN h.user_id % 4 = 0 OR h.kind = 'reclass' THEN 'code' ELSE 'text' END AS merge_class,
       CASE WHEN c.event_id % 11 = 0 AND c.p2 IS NOT NULL THEN c.p2 ELSE c.p1 END AS parent,
       CASE WHEN h.kind = 'create' THEN NULL WHEN c.event_id % 11 = 0 AND c.h2 IS NOT NULL THEN c.h2 ELSE c.h1 END AS base_hash,
       h.rh AS result_hash,
       CASE WHEN h.kind = 'create' THEN concat('d', cast(h.user_id % 7 AS string), '/note-', cast(h.user_id % 50 AS string), '.md')
            WHEN h.kind = 'rename' THEN concat('d', cast(h.user_id % 7 AS string), '/moved-', cast(h.event_id % 50 AS string), '.md') END AS path,
       CASE WHEN h.event_id % 13 = 0 THEN 'b1' WHEN h.event_id % 17 = 0 THEN 'b2' ELSE 'main' END AS branch_id
FROM (SELECT *, concat('r', cast(event_id AS string)) AS id,
             CASE WHEN kind IN ('create','edit') THEN «concat(cast(user_id AS string), ':', cast(event_id AS string))» END AS rh
      FROM (SELECT *, CASE WHEN rn = 1 OR event_id % 37 = 0 THEN 'create'
                     WHEN event_type = 'error'    AND event_id % 29 = 0 THEN 'delete'
                     WHEN event_type = 'purchase' AND event_id % 31 = 0 THEN 'reclass'
                     WHEN event_type = 'signup'   AND event_id % 3  = 0 THEN 'rename'
                     ELSE 'edit' END AS kind
            FROM (SELECT event_id, SECS(ts) AS tsec, user_id, event_type,
                         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
                         row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) - 1 AS seq
                  FROM {events}) e) k) h
LEFT JOIN (SELECT event_id, lag(rh, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS h1,
             lag(rh, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS h2,
             lag(id, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS p1,
             lag(id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS p2
           FROM (SELECT *, concat('r', cast(event_id AS string)) AS id,
                        «concat(cast(user_id AS string), ':', cast(event_id AS string))» AS rh
                 FROM (SELECT *, CASE WHEN rn = 1 OR event_id % 37 = 0 THEN 'create'
                     WHEN event_type = 'error'    AND event_id % 29 = 0 THEN 'delete'
                     WHEN event_type = 'purchase' AND event_id % 31 = 0 THEN 'reclass'
                     WHEN event_type = 'signup'   AND event_id % 3  = 0 THEN 'rename'
                     ELSE 'edit' END AS kind
                       FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
                             FROM {events}) e) k
                 WHERE kind IN ('create','edit')) g) c ON h.event_id = c.event_id
"""

#: The same without stale bases: no file then needs a merge.
LINEAR_LOG = LOG.replace("CASE WHEN c.event_id % 11 = 0 AND c.p2 IS NOT NULL THEN c.p2 ELSE c.p1 END", "c.p1").replace(
    "WHEN c.event_id % 11 = 0 AND c.h2 IS NOT NULL THEN c.h2 ELSE c.h1 END", "ELSE c.h1 END"
)

#: Contents of the log's hashes: the hashed string itself.
BLOBS = """
SELECT DISTINCT «concat(cast(user_id AS string), ':', cast(event_id AS string))» AS content_hash,
       concat(cast(user_id AS string), ':', cast(event_id AS string)) AS text
FROM {events}
"""

#: Records of branches and tags: one metadata row per 40th event, some without a readable record.
META = """
SELECT concat('m', cast(event_id AS string)) AS id, concat('s', cast(event_id % 5 AS string)) AS site_id, event_id + 1 AS lamport,
       CASE WHEN event_id % 80 = 0 THEN 'branch' ELSE 'tag' END AS kind,
       concat(CASE WHEN event_id % 80 = 0 THEN 'b' ELSE 't' END, cast(user_id % 9 AS string)) AS file_id,
       «record» AS result_hash, record
FROM (SELECT *, CASE WHEN event_id % 400 = 0 THEN 'not json'
        WHEN event_id % 80 = 0 THEN concat('{{"branch_id":"b', cast(user_id % 9 AS string), '","name":"n', cast(event_id % 3 AS string),
             '","parent":"', CASE WHEN user_id % 9 > 2 THEN concat('b', cast(user_id % 9 - 2 AS string)) ELSE 'main' END,
             '","fork_vv":{{"s0":', cast(event_id % 97 * 10 AS string), ',"s1":', cast(event_id % 89 * 10 AS string), '}},"created_lamport":', cast(event_id AS string), ',"created_ts":', cast(event_id * 2 AS string), ',"deleted":',
             CASE WHEN event_id % 7 = 0 THEN 'true' ELSE 'false' END, '}}')
        ELSE concat('{{"tag_id":"t', cast(user_id % 9 AS string), '","name":"v', cast(event_id % 5 AS string), '","at_ts":', cast(tsec AS string),
             ',"branch_id":"', CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'b1' END, '"}}') END AS record
      FROM (SELECT event_id, user_id, SECS(ts) AS tsec FROM {events}) e WHERE event_id % 40 = 0) x
"""

#: Branches as the branch operators take them, a cycle and a dangling parent among them.
BRANCHES = """
SELECT * FROM (VALUES ('b1', 'feature', 'main', 500, 1200), ('b2', 'fix', 'b1', 300, 2400), ('b3', 'loop', 'b4', 100, 10),
                      ('b4', 'loop2', 'b3', 100, 20), ('b5', 'lost', 'nowhere', 50, 30)) AS v(branch_id, name, parent, cap, created_lamport)
"""


def portable(sql: str, spark: bool) -> str:
    """The template in one engine's words."""
    if spark:
        sql = sql.replace("«", "sha2(").replace("»", ", 256)")
        return re.sub(r"SECS\((\w+)\)", r"unix_seconds(cast(\1 AS timestamp))", sql)
    sql = sql.replace("«", "sha256(").replace("»", ")").replace("{{", "{").replace("}}", "}")
    return re.sub(r"SECS\((\w+)\)", r"cast(floor(epoch(\1)) AS bigint)", sql).replace("{events}", "events")


def derived(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    sql = portable(template, spark=True)
    if "{events}" not in sql:
        return spark.sql(sql)
    return spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


#: Derived tables that this session has written: (application, folder, template) -> table.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """A derived table, written once per session and folder: queries that share it read it."""
    key = (spark.sparkContext.applicationId, sf_dir, template)
    if key not in _WRITTEN:
        _WRITTEN[key] = stored(derived(spark, sf_dir, template))
    return _WRITTEN[key]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, LOG)


def linear_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, LINEAR_LOG)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, BLOBS)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, META)


def branches(spark: SparkSession) -> DataFrame:
    """BRANCHES with their fork vectors: the same bound on each of five sites."""
    rows = derived(spark, "", BRANCHES)
    return rows.selectExpr(
        "branch_id", "name", "parent", "map_from_entries(transform(sequence(0, 4), i -> struct(concat('s', i), cast(cap as bigint)))) as fork_vv",
        "cast(created_lamport as bigint) as created_lamport", "cast(0 as bigint) as created_ts", "false as deleted",
    )
