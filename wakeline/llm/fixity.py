"""Merkle fixity audit of WARC replicas.

A replica is a table of records (file, offset, payload).  Each record's payload
is hashed; a leaf node covers the records whose offsets fall into one range of
``LEAF_BYTES`` bytes of a file and hashes their (offset, digest) list, and each node above
covers ``FANOUT`` neighbouring ranges, up to one root per file.  The audit compares
roots, then the children of nodes that differ, level by level, and at last the records of
differing leaves.  A range holds a bounded number of bytes, so however many records a
file has, no node gathers more than one range or ``FANOUT`` digests.

Defined results: a null payload is a record without content; null files are a
file of their own; records at one file and offset (repeated rows) are one node entry as a sorted list
of digests, so an extra copy in one replica shows; empty replicas have no
nodes and all records of the other are missing or extra; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.shared import cut

LEAF_BYTES = 1 << 18  # bytes of a file that one leaf covers
FANOUT = 16  # children of a node
FILE_PAGES = 4096  # page ids that one archive file of the query covers


def warc_record(url: Column, html: Column) -> Column:
    """The bytes of a response record: header block, blank line, payload, two line ends."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n")
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Pages as records of archive files: file, offset, page_id, digest, in page_id order within files of FILE_PAGES ids.

    Offsets are running sums of record lengths, taken file by file over lengths only, unless the bytes (payload) are asked for.
    """
    record = warc_record(F.col("url"), F.col("html"))
    slim = pages.select("page_id", F.length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"), *([record.alias("payload")] if with_bytes else []))
    # Pages without an id are dealt to files by their digests, however many there are.
    unnamed = -1 - F.conv(F.substring("digest", 1, 6), 16, 10).cast("long")
    slim = slim.withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), unnamed))
    w = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return slim.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def leaves(records: DataFrame) -> DataFrame:
    """Leaf nodes (file, node, digest) of records (file, offset, digest)."""
    entries = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), "digest")))
    return (
        records.groupBy("file", F.floor(F.col("offset") / LEAF_BYTES).alias("node"))
        .agg(F.sha2(F.concat_ws(",", entries), 256).alias("digest"))
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: each node hashes the (place, digest) list of its children."""
    entries = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad((F.col("node") % FANOUT).cast("string"), 4, "0"), "digest")))
    return nodes.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sha2(F.concat_ws(",", entries), 256).alias("digest"))


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of a replica's trees, leaves first, each computed once."""
    levels = [cut(leaves(records))]
    for _ in range(depth):
        levels.append(cut(parents(levels[-1])))
    return levels


def depth_of(*replicas: DataFrame) -> int:
    """Levels above the leaves until every file has one node."""
    most = max(r.agg(F.max("offset")).first()[0] or 0 for r in replicas) // LEAF_BYTES
    depth = 0
    while most:
        most //= FANOUT
        depth += 1
    return depth


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that only one side has."""
    left, right = a.alias("a"), b.alias("b")
    same_key = F.lit(True)
    for k in keys:
        same_key &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return (
        left.join(right, same_key, "full_outer")
        .where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        .select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.col("a.digest").alias("digest_a"), F.col("b.digest").alias("digest_b"))
    )


def hashed(records: DataFrame) -> DataFrame:
    """(file, offset, digest) of records that have a payload, else a digest; payloads are hashed once."""
    if "payload" not in records.columns:
        return records.select("file", "offset", "digest")
    return cut(records.select("file", "offset", F.sha2("payload", 256).alias("digest")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two replicas (file, offset, payload or digest) differ: file, offset, state, digest_a, digest_b.

    state: ``corrupt`` (both have it, digests differ), ``missing`` (only a) or ``extra`` (only b).
    """
    a, b = hashed(a), hashed(b)
    depth = depth_of(a, b)
    trees = [tree(a, depth), tree(b, depth)]
    bad = _differing(trees[0][depth], trees[1][depth], ["file", "node"]).select("file", "node")
    for level in range(depth - 1, -1, -1):
        parent = F.floor(F.col("n.node") / FANOUT)
        below = [
            t[level].alias("n").join(bad.alias("p"), F.col("n.file").eqNullSafe(F.col("p.file")) & (parent == F.col("p.node")), "left_semi") for t in trees
        ]
        bad = cut(_differing(*below, ["file", "node"]).select("file", "node"))
    in_range = F.floor(F.col("r.offset") / LEAF_BYTES) == F.col("p.node")
    suspects = [
        r.alias("r").join(bad.alias("p"), F.col("r.file").eqNullSafe(F.col("p.file")) & in_range, "left_semi")
        .groupBy("file", "offset").agg(F.concat_ws(",", F.array_sort(F.collect_list("digest"))).alias("digest"))
        for r in (a, b)
    ]
    state = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return _differing(*suspects, ["file", "offset"]).select("file", "offset", state.alias("state"), "digest_a", "digest_b")


def replica(pages: DataFrame) -> DataFrame:
    """Records (file, offset, payload) of a damaged copy: without page ids that leave 7 modulo 1009, flipped where they leave 5 modulo 97."""
    rotten = F.when(F.col("page_id") % 97 == 5, F.concat(F.encode(F.lit("X"), "UTF-8"), F.col("payload"))).otherwise(F.col("payload"))
    kept = archive(pages, with_bytes=True).where(F.coalesce(F.col("page_id") % 1009 != 7, F.lit(True)))
    return kept.select("file", "offset", rotten.alias("payload"))


def op1_fixity(spark, sf_dir: str) -> DataFrame:
    """Audit the archive of all pages against a replica with planted damage, both by the bytes of all their records.

    The replica has lost the records of page ids that leave 7 modulo 1009 and holds flipped bytes in those that
    leave 5 modulo 97; its other records are equal.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(cut(archive(pages)), replica(pages))


OP1_SQL = """
WITH r AS (
  SELECT page_id,
         encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
           || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)
           || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS bytes
  FROM pages
), f AS (
  SELECT *, coalesce(floor(page_id / 4096)::BIGINT, -1 - ('0x' || substr(sha256(bytes), 1, 6))::BIGINT) AS file FROM r
), o AS (
  SELECT *, sha256(bytes) AS digest,
         coalesce(sum(octet_length(bytes)) OVER (PARTITION BY file ORDER BY page_id, sha256(bytes) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM f
)
SELECT file, "offset", CASE WHEN page_id % 1009 = 7 THEN 'missing' ELSE 'corrupt' END AS state, digest AS digest_a,
       CASE WHEN page_id % 1009 = 7 THEN NULL ELSE sha256(encode('X') || bytes) END AS digest_b
FROM o WHERE page_id % 1009 = 7 OR page_id % 97 = 5
"""
