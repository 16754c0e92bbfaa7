"""Removal of repeated passages by content-defined chunks of lines.

A rolling hash runs over each pair of neighbouring lines.  A pair that stands once in all texts is a boundary, so what is
left between boundaries, a run, is text that is repeated somewhere and starts and ends where the repetition does, whatever stands
around it.  Inside a run the rolling hash chooses more boundaries: a chunk ends where the hash leaves 0 modulo
``DIVISOR`` and the one before does not.  These depend on three lines only, so runs of which one has more
lines than the other still share chunks.  Every chunk has two lines at least.  Chunks that occur more than once over all texts are
compared byte for byte, and every occurrence but the first (by id, then text digest and place) is removed.

Only DataFrame functions are used.  Pairs leave their row as hashes and places; only texts with a run are cut,
and only their chunks are sent on with their bytes.  Tables that may hold a very common key on the other side are written first, so that
adaptive execution can split that key's rows over many tasks.

Defined results: a null text stays null and an empty one empty; rows with the same id and text
are one document listed twice, alike in result; single lines and pairs of white space
never go; a text may lose all its lines and is then empty; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.shared import cut, release

DIVISOR = 2  # one pair of lines in so many can end a chunk
_BASE, _MODULUS = 257, 2147483647


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, place, key): each pair of neighbouring lines that are not both blank, by hashes of its document and its lines."""
    own = docs.select(F.xxhash64(id_col, F.md5(text_col)).alias("doc"), F.split(text_col, "\n", -1).alias("lines")).where(F.instr(text_col, "\n") > 0)
    both = F.zip_with(F.slice("lines", 1, F.size("lines") - 1), F.slice("lines", 2, F.size("lines")), lambda a, b: F.when(F.concat(a, b).rlike(r"[^ \t\r\n]"), F.xxhash64(a, b)))
    # The outer form: for the other one the optimiser adds a filter that would compute the pairs anew.
    return own.select("doc", F.posexplode_outer(both).alias("place", "key")).where(F.col("key").isNotNull())


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, runs): the runs of lines, as (start, n), of which each pair of neighbours stands elsewhere too."""
    found = pairs(docs, id_col, text_col)
    place = F.xxhash64("doc", "place")
    often = cut(found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key"))
    again = found.join(often, "key", "left_semi").select("doc", "place").distinct()  # documents may be listed twice
    island = F.col("place") - F.row_number().over(Window.partitionBy("doc").orderBy("place"))
    own = again.withColumn("island", island).groupBy("doc", "island").agg(F.min("place").alias("start"), (F.count("*") + 1).cast("int").alias("n"))
    return own.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def cut_lines(lines: Column) -> Column:
    """(start, n) of each chunk of an array of two lines or more."""
    n = F.size(lines)
    hashes = F.transform(lines, _line_hash)
    hit = F.zip_with(F.slice(hashes, 1, n - 1), F.slice(hashes, 2, n), lambda a, b: (a * _BASE % _MODULUS + b) % _MODULUS % DIVISOR == 0)
    # hit[i] is about lines i and i + 1; a chunk may end behind line i + 1 if two lines at least are left.
    ends = F.zip_with(hit, F.concat(F.array(F.lit(False)), hit), lambda h, before: h & ~F.coalesce(before, F.lit(True)))
    ends = F.transform(F.slice(ends, 1, F.greatest(n - 3, F.lit(0))), lambda end, i: F.when(end, i + 2))
    ends = F.concat(F.filter(ends, lambda e: e.isNotNull()), F.array(n))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("n")))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, whole, start, n, chunk): the chunks of all runs; start and n are in lines of the text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.instr("text", "\n") > 0).withColumn("whole", F.md5("text"))
    own = own.withColumn("doc", F.xxhash64("id", "whole")).join(runs(docs, id_col, text_col), "doc")
    # Each array is a column of its own that the next step names more than once, so that the optimiser keeps it as a column.
    own = own.select("id", "whole", "runs", F.split("text", "\n", -1).alias("lines"))
    parts = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), F.slice("lines", r["start"] + 1, r["n"]).alias("lines")))
    run = own.select("id", "whole", F.explode_outer(parts).alias("run")).select("id", "whole", F.col("run.start").alias("from"), F.col("run.lines").alias("lines"))
    placed = run.select("id", "whole", "from", "lines", F.explode_outer(cut_lines(F.col("lines"))).alias("c"))
    return placed.select("id", "whole", (F.col("from") + F.col("c.start")).alias("start"), F.col("c.n").alias("n"), F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.n")), "\n").alias("chunk"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, whole, gone): the chunks of each text, as (start, n), that occur earlier, confirmed byte by byte."""
    release(docs.sparkSession)
    found = cut(chunks(docs, id_col, text_col).withColumn("key", F.xxhash64("chunk")))  # repeated text only, which two steps read
    at = F.struct("id", "whole", "start")
    firsts = cut(found.groupBy("key", "chunk").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    release(docs.sparkSession)
    later = found.join(firsts, ["key", "chunk"]).where(~F.struct("id", "whole", "start").eqNullSafe(F.col("first")))
    return later.groupBy("id", "whole").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("gone"))


def stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_chunks): each row's own columns, its text without repeated chunks, and the numbers that went."""
    gone = repeats(docs, id_col, text_col)
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row")[text_col]
    joined = packed.join(gone, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.md5(text) == F.col("whole")), "left")
    # Only texts that lose something are cut again.
    lines = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(text, "\n", -1)))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["start"] + g["n"]))
    ends = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    out = lines.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    return out.select(
        "row",
        F.when(F.col("gone").isNotNull(), F.array_join("kept", "\n")).otherwise(text).alias("text"),
        F.when(F.col("gone").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0).alias("n_lines"),
        F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).alias("n_chunks"),
    )


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows as they came but with repeated chunks gone from the text, and columns n_lines_removed and n_chunks_removed (in place of such columns of the input)."""
    counts = {"n_lines_removed": "n_lines", "n_chunks_removed": "n_chunks"}
    own = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in counts]
    return stripped(docs, id_col, text_col).select(*own, *[F.col(c).alias(n) for n, c in counts.items()])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines and chunks that each document loses, and the digest of what it keeps; odd rows as the module says."""
    done = strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines_removed", "n_chunks_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Chunks of documents that occur earlier, and the texts without them; `docs(doc_id, text)` precedes it.
LINE_DEDUP_CTE = """
lines AS (
  SELECT doc_id, md5(text) AS whole, string_split(text, chr(10)) AS l FROM (SELECT DISTINCT doc_id, text FROM docs WHERE contains(text, chr(10)))
), pairs AS (
  SELECT doc_id, whole, place, l[place] AS a, l[place + 1] AS b FROM (SELECT *, unnest(range(1, len(l))) AS place FROM lines)
), often AS (
  SELECT *, count(*) OVER (PARTITION BY a, b) AS n FROM pairs WHERE regexp_matches(a || b, '[^ \\t\\r\\n]')
), islands AS (
  SELECT doc_id, whole, place, place - row_number() OVER (PARTITION BY doc_id, whole ORDER BY place) AS island FROM often WHERE n > 1
), runs AS (
  SELECT doc_id, whole, min(place) AS first, max(place) + 1 AS last FROM islands GROUP BY doc_id, whole, island
), hashed AS (
  SELECT r.*, l[first:last] AS l, list_transform(l[first:last], lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h
  FROM runs r JOIN lines d ON r.doc_id IS NOT DISTINCT FROM d.doc_id AND r.whole = d.whole
), hits AS (
  SELECT *, list_transform(range(1, len(h) + 1), lambda i: i > 1 AND (h[i - 1] * 257 % 2147483647 + h[i]) % 2147483647 % 2 = 0) AS hit FROM hashed
), ended AS (
  SELECT *, list_filter(range(1, len(h) + 1), lambda i: i = len(h) OR (i > 1 AND i < len(h) - 1 AND hit[i] AND NOT hit[i - 1])) AS ends FROM hits
), chunked AS (
  SELECT doc_id, whole, first + begin AS place, l[begin + 1:ends[k]] AS part
  FROM (SELECT *, CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END AS begin FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS k FROM ended))
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, whole, place) > 1 AS gone FROM chunked
), covered AS (
  SELECT doc_id, whole, unnest(range(place, place + len(part))) AS place FROM ordered WHERE gone
), parts AS (
  SELECT doc_id, whole, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS place FROM lines
), stripped AS (
  SELECT p.doc_id, p.whole, coalesce(string_agg(line, chr(10) ORDER BY p.place) FILTER (c.place IS NULL), '') AS kept, count(c.place)::INT AS n_lines_removed,
         (SELECT count(*) FROM ordered o WHERE gone AND o.doc_id IS NOT DISTINCT FROM p.doc_id AND o.whole = p.whole)::INT AS n_chunks_removed
  FROM parts p LEFT JOIN covered c ON p.doc_id IS NOT DISTINCT FROM c.doc_id AND p.whole = c.whole AND p.place = c.place GROUP BY p.doc_id, p.whole
)
"""

OP8_SQL = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {LINE_DEDUP_CTE}
SELECT d.doc_id, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_chunks_removed, 0) AS n_chunks_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept, d.text)) END AS kept_sha256
FROM docs d LEFT JOIN stripped s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND md5(d.text) = s.whole
"""
