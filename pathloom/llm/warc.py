"""WARC archives: written by Spark's text writer, read back in splits with the chain of record boundaries verified.

A record ends in two line ends, which is the writer's line separator. The reader cuts the files at the magic that
begins each record; payloads may hold the magic too, so every piece is only a candidate: its headers name the offset
of its successor, and only candidates that the chain from the file's start reaches are records. Within a split the
chain is followed in the task, which gives each candidate the first offset beyond the split; across splits, pointer
jumping doubles the steps in each round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.operators.components import shared_folder

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
EMPTY_SHA1 = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
#: Digests of repeated payloads up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def plan_records(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = 0) -> DataFrame:
    """``(id, url, payload, bytes, digest, refers_to)``: of equal payloads of at least ``least`` bytes the row with the
    largest id is written whole, and the others refer to it; smaller payloads are all written.

    A null payload is empty. Rows that share the largest id are all written whole; a row with a null id refers to that
    with the largest, and is written whole where no row of its payload has an id. No rows give no records. Columns
    other than the three do not matter."""
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    repeated = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = repeated.checkpoint()
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    found = rows.join(repeated, ["digest", "bytes"], "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))  # of null ids only, none is the first
    return found.select("id", "url", "payload", "bytes", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Rows of :func:`plan_records` as uncompressed WARC 1.1 files, one for each partition."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))  # noqa: E731  none if null
    uri = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", uri(F.col("id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _one_line(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""), line("WARC-Refers-To", uri(F.col("refers_to"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), line("Content-Length", F.octet_length("_block").cast("string")), F.lit("\r\n"),
    )
    records.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value")).write.option("lineSep", END).text(folder)


def _field(name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: {pattern}", 1), F.lit(""))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    scan = spark.read.option("lineSep", MAGIC).text(folder)
    return scan.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), F.octet_length("value").cast("long").alias("size"))


def _offsets(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``at``, the offset in the file of the magic before each; what precedes the first magic goes."""
    step = F.col("size") + len(MAGIC)
    before = F.coalesce(F.sum(step).over(Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = pieces.groupBy("file", "split").agg(F.sum(step).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("file", "split", earlier.alias("base"))
    return pieces.withColumn("before", before).join(base, ["file", "split"]).withColumn("at", F.col("base") + F.col("before") - len(MAGIC)).where("at >= 0").drop("before", "base")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece that the magic begins, with its place in its split, its headers, and how long they say it is."""
    pieces = _pieces(spark, folder).withColumn("head", F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1)))
    pieces = pieces.withColumn("head_bytes", F.octet_length("head") + 4).withColumn("content", F.try_to_number(_field("Content-Length", r"(\d{1,18})\r?(?:\n|$)"), F.lit("9" * 18)).cast("long"))
    whole = F.coalesce(F.col("size") == F.col("head_bytes") + F.col("content") + 4, F.lit(False))
    payload_from = F.octet_length(F.substring_index("value", END, 2)) + 4
    pieces = pieces.withColumn("whole", whole).withColumn("skip", F.when(whole, payload_from).cast("int"))
    own = F.col("value").cast("binary").substr(F.col("skip") + 1, (F.col("size") - F.col("skip") - 4).cast("int"))
    return pieces.select(
        "file", "split", "nth", "size", (F.col("head_bytes") + F.col("content") + 4).alias("span"), "whole",
        _field("WARC-Type", r"(\w+)").alias("record_type"), _field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"), _field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        _field("WARC-Target-URI", r"([^\r\n]*)").alias("url"), _field("WARC-Payload-Digest", r"sha1:(\w+)").alias("digest"), _field("X-Payload-Length", r"(\d+)").cast("long").alias("bytes"),
        F.when(whole, base32_sha1(own)).alias("own_digest"), F.when(whole, F.col("size") - F.col("skip") - 4).alias("own_bytes"),
    )


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where its chain leaves the split."""
    pdf = pdf.sort_values("at", ascending=False)
    leaves: dict[int, int] = {}
    for at, follow in zip(pdf["at"].tolist(), pdf["follow"].tolist()):
        leaves[at] = leaves.get(follow, follow)
    return pd.DataFrame({"file": pdf["file"].iloc[0], "at": list(leaves), "leave": list(leaves.values())})


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which candidates of a split its entries' chains pass."""
    pdf = pdf.sort_values("at")
    seen: set[int] = set()
    real = []
    for at, follow, entry in zip(pdf["at"].tolist(), pdf["follow"].tolist(), pdf["entry"].tolist()):
        real.append(entry or at in seen)
        if real[-1]:
            seen.add(follow)
    return pdf[["file", "split", "nth", "at"]].assign(real=real)


def chain(pieces: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(file, split, nth, at, real)`` of every candidate: is it a record that the chain from its file's start reaches?

    A chain that breaks, at a piece without a length or a successor that no candidate starts at, ends there; what lies
    behind is not reached. Work in a task is one split's offsets; the rounds run over the offsets where chains enter
    splits.
    """
    placed = _offsets(pieces.select("file", "split", "nth", "size", "span"))
    placed = placed.withColumn("follow", F.coalesce(F.col("at") + len(MAGIC) + F.col("span"), F.lit(-1))).select("file", "split", "nth", "at", "follow").checkpoint()
    leaves = placed.groupBy("file", "split").applyInPandas(_exits, "file string, at long, leave long").checkpoint()
    first = placed.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    nodes = leaves.select("file", F.col("leave").alias("at")).unionByName(first).distinct()
    jump = leaves.join(nodes, ["file", "at"]).checkpoint()
    reach, n = first, -1
    for _ in range(max_rounds):
        reach = reach.unionByName(jump.join(reach, ["file", "at"], "left_semi").select("file", F.col("leave").alias("at"))).distinct().checkpoint()
        if (now := reach.count()) == n:
            break
        n = now
        there = jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("further"))
        jump = jump.join(there, ["file", "leave"], "left").select("file", "at", F.coalesce("further", "leave").alias("leave")).checkpoint()
    else:
        raise RuntimeError(f"the chains did not settle in {max_rounds} rounds")
    marked = placed.join(reach.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "split").applyInPandas(_reached, "file string, split long, nth long, at long, real boolean")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact)`` of every record of the archives.

    A response's bytes and digest are counted from its payload as read, and ``intact`` says whether its headers agree;
    a revisit has those of the payload that it refers to from its headers. A record without an id of this library has a
    null one. A folder without records gives no rows.
    """
    shared_folder(spark)
    pieces = candidates(spark, folder).checkpoint()
    placed = chain(pieces).checkpoint()
    records = pieces.join(placed.where("real"), ["file", "split", "nth"])
    fields = ["page_id", "url", "record_type", "refers_to", "bytes", "digest", "own_bytes", "own_digest"]
    done, broken = records.where("whole").select(*fields), records.where("not whole")
    if not broken.isEmpty():
        done = done.unionByName(_stitched(_offsets(_pieces(spark, folder)), placed, broken).select(*fields))
    whole = F.col("record_type") == "response"
    return done.select(
        "page_id", "url", "record_type", "refers_to", F.when(whole, F.col("own_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(whole, F.col("own_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        (~whole | (F.col("own_bytes").eqNullSafe(F.col("bytes")) & F.col("own_digest").eqNullSafe(F.col("digest")))).alias("intact"),
    )


def _stitched(texts: DataFrame, placed: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: the pieces up to the next record joined again."""
    along = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = placed.select("file", "at", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(along).alias("owner"))
    heads = broken.drop("own_bytes", "own_digest", "size", "nth", "split", "real", "whole").withColumnRenamed("at", "owner")
    parts = owned.join(heads.select("file", "owner"), ["file", "owner"]).join(texts.select("file", "at", "value"), ["file", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC)
    whole = parts.groupBy("file", "owner").agg(text.alias("text")).join(heads, ["file", "owner"])
    skip = (F.octet_length(F.substring_index("text", END, 2)) + 4).cast("int")
    payload = F.col("text").cast("binary").substr(skip + 1, (F.col("span") - 4 - skip).cast("int"))
    return whole.withColumn("own_bytes", F.octet_length(payload).cast("long")).withColumn("own_digest", base32_sha1(payload))
