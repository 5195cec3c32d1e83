"""WARC archives written by the text sink and read back with a verified chain of record boundaries.

A record may carry the record magic inside its payload, so finding the magic proves nothing. Every task therefore
emits candidates only: the offset of each magic string and the offset where the record that would start there ends.
A record is real exactly if it can be reached from the start of its file by following those links. Candidates whose
link leads to the very next candidate are first joined into runs (windows inside one split); pointer jumping then
doubles over runs, so the rounds grow with the logarithm of the runs in a chain, not of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.session import materialize, work_path

#: Fixed values of the format.
MAGIC = "WARC/1."
VERSION = "WARC/1.1"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are never written as revisits.
MIN_REVISIT_BYTES = 100


def _octets(text: Column) -> Column:
    return F.octet_length(text)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which pages repeat an earlier payload.

    Only (digest, page_id) pairs are grouped, so a hot payload is reduced before the shuffle.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.filter(_octets(F.col("payload")) >= min_bytes)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    # written, so that the join has two plain sides and a hot digest can be split
    first = materialize(first.select(F.col("digest").alias("first_digest"), "first_id"), "responses")
    joined = rows.join(first, F.col("digest") == F.col("first_digest"), "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def record_text(page_id: Column, url: Column, payload: Column, sha: Column, refers_to: Column) -> Column:
    """One record up to, but without, the two line ends after its block."""
    revisit = refers_to.isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(payload))
    uri = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", uri(page_id)),
        field("WARC-Target-URI", F.regexp_replace(url, "[\\r\\n]", "")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), sha)),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", uri(refers_to))))
        .otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", _octets(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row of (page_id, url, html) to archives below ``path``, a file per task.

    Equal payloads of at least ``min_bytes`` are written once, with the smallest page_id; the rest are revisits. Null
    html and url count as empty; a null page_id gets an empty name. A page_id should not repeat: a repeated row with
    the smallest id of its payload is a response as well. Other columns are not written. An empty table gives
    archives without records.
    """
    planned = plan_records(pages, min_bytes)
    record = record_text(*(F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to")))
    planned.select(record.alias("value")).write.option("lineSep", END).text(path)


def pinned_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which files are always cut and dealt alike.

    How Spark plans splits follows from settings that may change between two reads, and from the number of cores at that
    moment. Here both are fixed at their present values, for as long as tables read by this session are used.
    """
    pinned = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.session.timeZone"):
        pinned.conf.set(name, spark.conf.get(name))
    cores = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism
    pinned.conf.set("spark.sql.files.minPartitionNum", str(cores))
    return pinned


def chunks(pinned: SparkSession, path: str) -> DataFrame:
    """(file, split, order, chunk): the archives cut at every magic string, in parallel and across split borders.

    Two reads of the same files by one :func:`pinned_session` cut and number them alike.
    """
    return pinned.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("order"),
        F.col("value").cast("binary").alias("chunk"),
    )


def candidates(spark: SparkSession, source: DataFrame) -> DataFrame:
    """(file, split, order, at, size, head, length, next): each magic string, and where its record would end.

    Byte offsets follow from the lengths of the chunks before: inside a split by a running sum, across the splits of
    a file by their totals. ``head`` is the length of the header, ``length`` that of the block, ``size`` that of the
    chunk up to the next magic string. ``source`` is the output of :func:`chunks`.
    """
    text = F.col("chunk").cast("string")
    head_end = F.instr(text, END)
    head = F.substring(text, F.lit(1), head_end + 3)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1)
    rows = source.select(
        "file", "split", "order",
        F.octet_length("chunk").cast("bigint").alias("size"),
        F.when(head_end > 0, F.octet_length(head)).cast("bigint").alias("head"),
        F.when(length != "", length.cast("bigint")).alias("length"),
    )
    written = work_path(spark, "chunks")
    rows.write.parquet(written)
    rows = spark.read.schema(rows.schema).parquet(written)  # by the caller's session from here on
    step = F.lit(len(MAGIC))
    totals = rows.groupBy("file", "split").agg(F.sum(F.col("size") + step).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("split_at"))
    inside = Window.partitionBy("file", "split").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") + step).over(inside), F.lit(0)))
    placed = placed.join(starts, ["file", "split"]).withColumn("at", F.col("split_at") + F.col("inside") - step)
    end = F.col("at") + step + F.col("head") + F.col("length") + len(END)
    return placed.select("file", "split", "order", "at", "size", "head", "length", end.alias("next")).filter("at >= 0")


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the candidates that the chain from the start of their file reaches.

    ``links`` has (file, split, at, next). A link that leads to no candidate ends its chain.
    """
    spark = links.sparkSession
    ordered = Window.partitionBy("file", "split").orderBy("at")
    previous = F.lag("next").over(ordered)
    runs = links.filter("at >= 0 AND next IS NOT NULL").withColumn("breaks", (~previous.eqNullSafe(F.col("at"))).cast("int"))
    runs = runs.withColumn("run", F.max(F.when(F.col("breaks") == 1, F.col("at"))).over(ordered))
    runs = materialize(runs.select("file", "at", "run", "next"), "runs")
    tails = runs.groupBy("file", "run").agg(F.max(F.struct("at", "next")).alias("tail"))
    # where a run's last link lands: in which run, and at which of its records
    landing = runs.select("file", F.col("at").alias("entry"), F.col("run").alias("to"))
    tails = tails.select("file", "run", F.col("tail.next").alias("entry"))
    jumps = materialize(tails.join(landing, ["file", "entry"]).select("file", "run", "to", "entry"), "jumps")
    reached = materialize(
        runs.filter("at = 0").select("file", "run", F.lit(0).cast("bigint").alias("entry")), "reached"
    )
    hops = jumps.select("file", "run", "to", "entry")
    count = reached.count()
    while count:
        ahead = reached.select("file", "run").join(hops, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        grown = materialize(reached.unionByName(ahead).distinct(), "reached")
        now = grown.count()
        if now == count:
            break
        reached, count = grown, now
        onward = hops.select("file", F.col("run").alias("to"), F.col("to").alias("last"), F.col("entry").alias("last_entry"))
        doubled = hops.select("file", "run", "to").join(onward, ["file", "to"])
        hops = materialize(doubled.select("file", "run", F.col("last").alias("to"), F.col("last_entry").alias("entry")), "hops")
    real = runs.join(reached, ["file", "run"]).filter("at >= entry")
    return real.select("file", "at")


def _owned(links: DataFrame, real: DataFrame) -> DataFrame:
    """``links`` with ``real`` and ``owner``: the last real record at or before each candidate of the same file."""
    marked = links.join(real.withColumn("real", F.lit(True)), ["file", "at"], "left")
    marked = marked.withColumn("real", F.coalesce("real", F.lit(False)))
    here = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("owner", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(here))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    last = marked.groupBy("file", "split").agg(F.max("owner").alias("last"))
    last = last.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("carried"))
    owned = marked.join(last, ["file", "split"]).withColumn("owner", F.coalesce("owner", "carried"))
    return owned.select("file", "split", "order", "at", "size", "head", "length", "real", "owner").filter("owner IS NOT NULL")


def _cut(chunk: Column, project) -> list[Column]:
    head, length = F.col("head").cast("int"), F.col("length").cast("int")
    header = F.concat(F.lit(MAGIC), F.substring(chunk, F.lit(1), head).cast("string"))
    return ["file", "at", *project(header, F.substring(chunk, head + 1, length))]


def read_warc(spark: SparkSession, path: str, project=lambda header, block: [header.alias("header"), block.alias("block")]) -> DataFrame:
    """(file, at, projected columns) of every real record of the archives below ``path``.

    ``project(header, block)`` gives the columns to return from the header (text) and block (binary); it is applied
    before any shuffle, so blocks move only if they are asked for. A record whose payload holds the magic is put
    together from its chunks first. Records that the chain of their file does not reach are left out: what follows
    a damaged or cut record, and that record. The result is written, and the job fails if it does not have every record
    of the chains that is whole. Blocks of any length come back whole; a task holds one. No archive, or archives without
    records, give no rows.
    """
    source = chunks(pinned_session(spark), path)
    links = materialize(candidates(spark, source), "links")
    owned = materialize(_owned(links, reachable(links)), "owned")
    records = materialize(_records(source, owned, project), "warc-records")
    available = owned.groupBy("file", "owner").agg(
        (F.sum(F.col("size") + len(MAGIC)) - len(MAGIC)).alias("bytes"),
        F.max(F.when(F.col("real"), F.col("head") + F.col("length"))).alias("wanted"),
    )
    whole, found = available.filter("wanted <= bytes").count(), records.count()
    if whole != found:
        raise RuntimeError(f"{found} of {whole} records came back from {path}: the archives changed while they were read")
    return records


def _records(source: DataFrame, owned: DataFrame, project) -> DataFrame:
    # written apart: its size is then known to the planner, and the archives are not shuffled for a few long records
    complete = F.col("real") & (F.col("head") + F.col("length") <= F.col("size"))
    keys = ["file", "split", "order"]
    text = F.col("chunk").cast("string")
    inline = source.withColumn("head", F.octet_length(F.substring(text, F.lit(1), F.instr(text, END) + 3)))
    length = F.regexp_extract(F.substring(text, F.lit(1), F.instr(text, END) + 3), r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1)
    inline = inline.withColumn("length", F.when(length != "", length.cast("bigint"))).withColumn("at", F.lit(None).cast("bigint"))
    whole = inline.select("split", "order", *_cut(F.col("chunk"), project)).drop("at")
    # the caller's session plans the joins, so its tables stand on the left
    names = [c for c in whole.columns if c not in keys]
    whole = owned.filter(complete).select(*keys, "at").join(whole, keys).select("file", "at", *names)
    parts = materialize(owned.filter(~complete), "cut").join(source, keys).groupBy("file", F.col("owner").alias("at")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("at").alias("place"), "chunk"))).alias("parts"),
        F.max(F.when(F.col("real"), F.col("head"))).alias("head"),
        F.max(F.when(F.col("real"), F.col("length"))).alias("length"),
    )
    magic = F.lit(MAGIC).cast("binary")
    rest = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    glued = F.aggregate(rest, F.col("parts")[0]["chunk"], lambda whole, part: F.concat(whole, magic, part["chunk"]))
    parts = parts.filter("head IS NOT NULL").withColumn("bytes", glued).filter("head + length <= octet_length(bytes)")
    return whole.unionByName(parts.select(*_cut(F.col("bytes"), project)))


def header_field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _page_fields(header: Column, block: Column) -> list[Column]:
    payload = F.substring(block, F.octet_length(F.lit(HTTP)) + 1, F.octet_length(block))
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    return [
        number(header_field(header, "WARC-Record-ID")).alias("page_id"),
        header_field(header, "WARC-Type").alias("record_type"),
        number(header_field(header, "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(header, "(?im)^WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("named"),
        F.octet_length(payload).cast("bigint").alias("bytes"),
        F.sha2(payload, 256).alias("digest"),
    ]


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives made by :func:`write_warc`.

    A revisit has no payload of its own: its size is that of the response it refers to, its digest the one named.
    """
    rows = read_warc(spark, path, _page_fields)
    responses = rows.filter("record_type = 'response'")
    revisits = rows.filter("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("response_id")).distinct()
    sizes = responses.select(F.col("page_id").alias("response_id"), F.col("bytes").alias("full_bytes"))
    # written, so that the join has two plain sides and a hot response can be split
    sizes = materialize(sizes.join(wanted, "response_id", "left_semi"), "referred")
    revisits = revisits.join(sizes, F.col("refers_to") == F.col("response_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = responses.withColumns({"payload_bytes": F.col("bytes"), "payload_digest": F.col("digest")})
    named = revisits.withColumns({"payload_bytes": F.col("full_bytes"), "payload_digest": F.col("named")})
    return own.select(columns).unionByName(named.select(columns))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_records(spark, path)


OP3_SQL = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM hashed
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""
