"""Operator 5: pages as WARC archives, read back by verifying the chain of record boundaries.

Writing: a page is one row of a text data set whose separator is the record terminator, so any number of tasks write gzipped
archives to any store. A page whose payload another page of smaller id holds (at 100 bytes or more) becomes a revisit.

Reading: the archives are cut at the record magic, wherever it stands. Each piece is a candidate record with an offset and, by its
Content-Length, a successor. Inside a segment of a file candidates are resolved to the offset where their chain leaves it; pointer jumping
from offset 0 then finds the segments' true entries, and only records on the chain are kept, so a magic inside a payload starts
no record. Records cut by such a magic are put together again from their pieces, which a second read finds by their content: their places
in that read may differ, as files are dealt to tasks by the number of cores. A piece that is not found fails the job.

Defined results: a null html is an empty payload; a page without url has no target; line breaks in a url are percent-encoded; a null
page_id is left out, as a record needs its id; rows that share page_id and payload are all responses if the id is the smallest; an
empty table gives empty archives and no rows. A damaged chain ends the records of its file. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minim.session import Scratch, share_package

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 100
SEGMENT = 64 << 20
_ID = "urn:x-page:"
_DATE = "2000-01-01T00:00:00Z"


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """`page_id, url, payload, digest, bytes, refers_to`: which page is stored and which refers to another."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.where(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("payload"),
        F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("bigint").alias("bytes"))
    # Only digests of several pages travel on; counts are combined before the shuffle.
    shared = (rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
              .where("_first < _last").select("digest", "_first"))
    return (rows.join(shared, "digest", "left")
            .select("page_id", "url", "payload", "digest", "bytes",
                    F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to")))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    """Write one record per page under `path`."""
    records = page_records(pages)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Record-ID: <{_ID}"), F.col("page_id").cast("string"), F.lit(f">\r\nWARC-Date: {_DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Refers-To: <{_ID}"), F.col("refers_to").cast("string"),
            F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    (records.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic, in file order by (block, row)."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"), "value"))


def _content():
    """What a piece is known by in any read of the archives."""
    return F.sha2(F.col("value").cast("binary"), 256)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row per piece: its place, its successor, and its record's fields if the piece holds it whole."""
    raw = _pieces(spark, path).withColumn("size", F.octet_length("value").cast("bigint")).withColumn("content", _content())
    raw = raw.withColumn("head", F.substring_index("value", END, 1))
    return _fields(raw).drop("value", "head", "body")


def _fields(raw: DataFrame) -> DataFrame:
    """Adds the record's fields to rows with `value`, `size` and `head`."""
    def field(name: str):
        return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: *<?([^\r\n>]+)", 1), F.lit(""))

    raw = raw.withColumn("start", F.octet_length("head").cast("bigint") + len(END)).withColumn("length", field("Content-Length").try_cast("bigint"))
    raw = raw.withColumn("whole", F.coalesce(F.col("size") >= F.col("start") + F.col("length"), F.lit(False)))
    body = F.substring(F.col("value").cast("binary"), F.col("start").cast("int") + 1, F.col("length").cast("int"))
    raw = raw.withColumn("body", F.when(F.col("whole"), body))
    http = F.substring_index(F.col("body").cast("string"), END, 1)
    payload = F.substring(F.col("body"), F.octet_length(http) + len(END) + 1, F.col("length").cast("int"))
    response = field("WARC-Type") == "response"
    return raw.select(
        "*", field("WARC-Type").alias("record_type"), F.regexp_extract("head", rf"WARC-Record-ID: <{_ID}(-?\d+)>", 1).try_cast("bigint").alias("page_id"),
        F.regexp_extract("head", rf"WARC-Refers-To: <{_ID}(-?\d+)>", 1).try_cast("bigint").alias("refers_to"),
        F.when(response, F.octet_length(payload).cast("bigint"))
        .otherwise(F.regexp_extract(http, r"Content-Length: *(\d+)", 1).try_cast("bigint")).alias("payload_bytes"),
        F.when(response, F.sha2(payload, 256)).otherwise(F.regexp_extract("head", r"WARC-Payload-Digest: sha256:([0-9a-f]+)", 1)).alias("payload_digest"))


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds `at`, the offset of the candidate's magic, and `succ`, where the next record would start.

    Every byte is in one piece or one magic, so offsets are running sums of sizes: over the blocks of a file,
    then over the pieces of a block. A file's first piece stands before its first magic and is no candidate.
    """
    step = F.col("size") + len(MAGIC)
    blocks = pieces.groupBy("file", "block").agg(F.sum(step).alias("_bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (pieces.withColumn("_inside", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(blocks, ["file", "block"])
              .withColumn("at", F.col("_base") + F.col("_inside") - len(MAGIC)).drop("_base", "_inside"))
    return placed.withColumn("succ", F.col("at") + len(MAGIC) + F.col("start") + F.col("length") + len(END))


def _exits(group: pd.DataFrame, segment: int) -> pd.DataFrame:
    """For each candidate of a segment, the first offset of its chain that is outside the segment (or nowhere)."""
    group = group.sort_values("at")
    at, succ = group["at"].to_numpy(), group["succ"].to_numpy()
    last = (int(at[0]) // segment + 1) * segment
    place = np.searchsorted(at, succ)
    inside = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == succ)
    leave = succ.copy()
    for i in range(len(at) - 1, -1, -1):
        if succ[i] < last:
            leave[i] = leave[place[i]] if inside[i] else -1
    return pd.DataFrame({"file": group["file"].to_numpy(), "at": at, "leave": leave})


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """The records of a segment on the chain from its entry."""
    group = group.sort_values("at")
    at, succ = group["at"].to_numpy(), group["succ"].to_numpy()
    now, kept = int(group["entry"].iloc[0]), []
    while True:
        i = int(np.searchsorted(at, now))
        if i == len(at) or at[i] != now:
            break
        kept.append(now)
        now = int(succ[i])
    return pd.DataFrame({"file": group["file"].iloc[0], "at": np.array(kept, np.int64)})


def reachable(links: DataFrame, scratch: Scratch, segment: int = SEGMENT) -> DataFrame:
    """`file, at` of the records on the chain from offset 0, for `links` of `file, at, succ`."""
    links = links.withColumn("segment", F.floor(F.col("at") / segment))
    jump = scratch.save(links.groupBy("file", "segment")
                        .applyInPandas(lambda g: _exits(g, segment), "file string, at long, leave long").where("leave >= 0"))
    # Only starts and exits can be entries; the tables of the loop have a few rows per segment.
    starts = links.where("at = 0").select("file", "at").distinct()
    targets = jump.select("file", F.col("leave").alias("at")).union(starts).distinct()
    jump = scratch.save(jump.join(targets, ["file", "at"], "left_semi"))
    reached = scratch.save(starts)
    known = reached.count()
    while True:
        # Twice as many hops each round.
        further = reached.join(jump, ["file", "at"]).select("file", F.col("leave").alias("at"))
        reached = scratch.save(reached.union(further).distinct())
        count = reached.count()
        if count == known:
            break
        known = count
        onward = jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("_next"))
        jump = scratch.save(jump.join(onward, ["file", "leave"]).select("file", "at", F.col("_next").alias("leave"))
                            .union(jump.join(onward, ["file", "leave"], "left_anti").select("file", "at", "leave")))
    entries = reached.select("file", F.floor(F.col("at") / segment).alias("segment"), F.col("at").alias("entry"))
    return links.join(entries, ["file", "segment"]).groupBy("file", "segment").applyInPandas(_walk, "file string, at long")


def read_archives(spark: SparkSession, path: str, segment: int = SEGMENT) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of every record on a chain.

    A response's length and digest are those of the payload read; a revisit has them from its headers.
    """
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    share_package(spark)
    scratch = Scratch(spark, "warc-read")
    pieces = scratch.save(with_offsets(candidates(spark, path)))
    chain = scratch.save(reachable(pieces.where("at >= 0 and succ is not null").select("file", "at", "succ"), scratch, segment))
    records = pieces.join(chain, ["file", "at"])
    whole = records.where("whole").select(*columns)
    cut = records.where("not whole")
    if cut.isEmpty():
        return whole
    # A record cut by a magic in its payload: its pieces are the rows up to the next record, read once more.
    # A file holds `records_per_file` records at most, so its narrow rows fit one task.
    begins = F.last(F.when(F.col("_on"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    owned = (pieces.join(cut.select("file").distinct(), "file").join(chain.withColumn("_on", F.lit(True)), ["file", "at"], "left")
             .withColumn("record", begins))
    parts = scratch.save(owned.join(cut.select("file", F.col("at").alias("record")), ["file", "record"]).select("file", "record", "at", "content"))
    # One text per content that a cut record needs; equal pieces of many records are sent once.
    needed = parts.groupBy("content").agg(F.count(F.lit(1)).alias("times"))
    values = (_pieces(spark, path).select(_content().alias("content"), "value").join(needed, "content", "left_semi")
              .groupBy("content").agg(F.first("value").alias("value")))
    lost = F.raise_error(F.concat(F.lit("a piece of a cut record was not found again: "), F.col("file"), F.lit(" at "), F.col("at").cast("string")))
    glued = (parts.join(values, "content", "left").withColumn("value", F.coalesce("value", lost.cast("string"))).groupBy("file", "record")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), MAGIC).alias("value")))
    glued = glued.withColumn("size", F.octet_length("value").cast("bigint")).withColumn("head", F.substring_index("value", END, 1))
    return whole.unionByName(_fields(glued).where("whole").select(*columns))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` as archives in the scratch folder and read them back."""
    path = Scratch(pages.sparkSession, "warc").path
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
