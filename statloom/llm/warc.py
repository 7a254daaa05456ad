"""Content-addressed web archive.

Payload bytes lie once in a table keyed by their SHA-256 digest; the exact header bytes of every record, with the HTTP
header that its block begins with, lie in another. A record is rebuilt by joining the two. Records whose payload another
record already holds are revisits. Rebuilt records can be written as WARC files, which other tools read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.base import MOST_HOT, drop, join_hot, new_path, stash

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Payloads below this many bytes are always written as responses.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: 160 bits, so 32 characters of five bits."""
    digest = F.sha1(payload)
    chunks = [F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("int") for k in range(8)]
    letters = F.split(F.lit(BASE32), "")
    return F.concat(*[F.element_at(letters, F.shiftright(c, 5 * (3 - j)).bitwiseAND(31) + 1) for c in chunks for j in range(4)])


def _one_line(value: Column) -> Column:
    """A header's value may not hold line ends."""
    return F.replace(F.replace(F.regexp_replace(value, "%", "%25"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_BYTES, id_column: str = "page_id") -> None:
    """Write one record per row of (page_id, url, html) to path/headers and path/payloads.

    Of the rows with one payload of at least `least` bytes, those with the smallest page_id are responses, the others
    revisits of it; a null page_id counts as the largest. Rows that repeat a page_id and its payload are all responses
    or all revisits. A null html is an empty payload; a null url leaves WARC-Target-URI out. Digests are verified: if
    two payloads of one SHA-256 differ in length, SHA-1 or XXH64, nothing is written and the job fails.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keys = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"), F.xxhash64("payload").alias("check"))
    keys, keys_path = stash(keys, "keys")  # small, and the digests are taken once
    order = F.struct(F.col("page_id").isNull(), "page_id")
    both = [F.struct("payload_bytes", "sha1", "check")]
    first = keys.groupBy("digest").agg(F.min(order)["page_id"].alias("first_id"), F.min(*both).alias("low"), F.max(*both).alias("high"), F.count("*").alias("records"))
    first = first.select("digest", "records", F.when(F.col("low") == F.col("high"), F.col("first_id")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest"))).alias("first_id"))
    joined = join_hot(keys, first.withColumn("n", F.col("records")), "digest", "n", keys.count())
    revisit = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", _one_line(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
        http,
    )
    joined.select("page_id", F.encode(head, "UTF-8").alias("header"), "digest", "records").write.parquet(f"{path}/headers", compression="zstd")
    # an id that is never null, so that join and removal of repeats deal the payloads out alike, in one shuffle
    own = lambda c: F.when(F.col(c).isNull(), "none").otherwise(F.concat(F.lit("id "), F.col(c).cast("string"))).alias("own")
    owners = first.select("digest", own("first_id"), "records")
    filed = rows.select(F.sha2("payload", 256).alias("digest"), own("page_id"), "payload").join(owners.hint("merge"), ["digest", "own"])
    filed.dropDuplicates(["digest", "own"]).select("digest", "payload", "records").write.parquet(f"{path}/payloads", compression="zstd")
    drop(pages.sparkSession, keys_path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the archive alone: page_id, url, record_type, refers_to, payload digest and length.

    Every stored payload is read and must have the digest that it is filed under; a header whose payload is missing or
    whose SHA-1 differs fails the job.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads").select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"), F.col("records").alias("n"))
    stored, _ = stash(stored, "stored")  # small, and every payload is read and hashed once
    told_of = join_hot(headers.drop("records"), stored, "digest", "n", headers.count())
    missing = headers.drop("records").join(stored.select("digest"), "digest", "left_anti").select("*", F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("sha1"))
    kind = headers.schema["page_id"].dataType
    told = F.substring_index(_header("WARC-Payload-Digest"), "sha1:", -1)
    refers = F.regexp_extract(_header("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1)
    return (
        told_of.unionByName(missing)
        .select(
            "page_id",
            _header("WARC-Target-URI").alias("url"),
            F.coalesce("payload_bytes", F.raise_error(F.lit("a payload is missing")).cast("long")).alias("payload_bytes"),
            F.when(F.col("sha1") == told, F.col("sha1")).otherwise(F.raise_error(F.lit("a payload differs from its record"))).alias("payload_digest"),
            _header("WARC-Type").alias("record_type"),
            F.when(refers != "", refers).cast(kind).alias("refers_to"),
        )
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the full record bytes: headers, payload (none for revisits) and the closing line ends.

    `payload` has the full payload of revisits as well. Records with a payload that many share are spread over as many
    copies of it as they are 1/MOST_HOT of all records, so that no task gathers them.
    """
    headers = spark.read.parquet(f"{path}/headers")
    parts = F.greatest(F.lit(1), F.ceil(F.col("records") * F.lit(float(MOST_HOT)) / max(headers.count(), 1))).cast("int")
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = headers.withColumn("part", F.pmod(F.xxhash64("page_id", "header"), parts).cast("int"))
    block = F.when(_header("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return dealt.join(stored, ["digest", "part"]).select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def write_warc(records: DataFrame, path: str) -> None:
    """Write rebuilt records one after another as gzipped WARC files below path. Records of read_records() are UTF-8."""
    text = F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "UTF-8")
    records.select(text.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as an archive (below spark.checkpoint.dir without a path), and read its index back.

    Any nulls, empty and repeated payloads and an empty table are handled as write_archive() states; further columns of
    pages are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archive(pages, path)
    return read_index(spark, path)


def delete_archive(spark: SparkSession, path: str) -> None:
    drop(spark, path)
