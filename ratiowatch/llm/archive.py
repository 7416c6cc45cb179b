"""A content-addressed archive of web records, with built-in column functions alone.

Two tables make an archive. ``payloads`` holds every distinct payload once, under its
SHA-256. ``records`` holds, per page, the exact header bytes of its WARC record and the
digest of its payload. Records are put together again by a join on the digest, and every
payload is verified against it on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The digits of hexadecimal-to-base-32 conversion and the alphabet of RFC 4648.
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes: 5 hexadecimal digits make 4 letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * n, 5), 16, 32), 4, "0") for n in range(8)]
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    """Header lines; a field without a value is left out."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("") for name, value in pairs]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"))


def write_archive(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                  least_shared: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per row. Of equal payloads of at least ``least_shared`` bytes, the row
    with the smallest id is the response and the others revisit it.

    A null payload is empty; a null url has no target line, and line breaks in a url are
    escaped. Rows that repeat the smallest id are responses too. A null id is never referred
    to while another row has the payload. Other columns are ignored, and an empty table makes
    an archive without records. Payloads meet on their digest after each task has folded its
    own copies, so a payload of a third of all pages is stored and moved once per task.
    """
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    (rows.groupBy("digest").agg(F.first("payload").alias("payload"))
     .write.option("compression", "zstd").parquet(f"{folder}/payloads"))
    heads = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("size"),
                        base32_sha1(F.col("payload")).alias("sha1"))
    firsts = rows.select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first_id"))
    heads = heads.join(firsts, "digest")
    revisit = (F.col("size") >= least_shared) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)) & F.col("first_id").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    clean_url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    heads = heads.withColumns({"revisit": revisit, "http": http}).withColumn("header", F.concat(_fields([
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", name),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", clean_url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))).cast("string")),
    ]), F.col("http")))
    heads.select("page_id", "digest", F.col("header").cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Per record: page_id, header (bytes), payload (bytes), and from the header the fields
    record_type, payload_digest and refers_to. A payload that does not have its digest is an error.
    """
    heads = spark.read.parquet(f"{folder}/records")
    payloads = spark.read.parquet(f"{folder}/payloads")
    text = F.col("header").cast("string")
    joined = heads.join(payloads, "digest")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload without its digest: "), F.col("digest"))).cast("binary"))
    reference = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n", 1)
    return joined.select(
        "page_id", "header", checked.alias("payload"),
        F.regexp_extract(text, r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n", 1).alias("payload_digest"),
        F.when(reference != "", reference).cast("bigint").alias("refers_to"))


def warc_records(archive: DataFrame) -> DataFrame:
    """page_id and the exact bytes of each WARC record; a revisit has no payload block."""
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def export_warc(archive: DataFrame, folder: str) -> None:
    """Plain WARC files, one per task, for other tools. Payloads must be UTF-8 text."""
    records = warc_records(archive).select(F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").text(folder)
