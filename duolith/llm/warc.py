"""WARC: a content-addressed archive of web pages.

Payload bytes are stored once under their SHA-256, which is computed again and
compared when they are read. The exact bytes of each record's header are kept
apart, with the key of its payload; joins give the records back, headers and
payloads as they were. Of equal payloads the first is a response record, the
others are revisit records that refer to it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.settle import shared_folder
from .common import cut, read

DATE = "2024-01-01T00:00:00Z"
#: Payloads with fewer bytes are stored once, too, but each of their records is a response.
MIN_BYTES = 0
# Fixed value of the format: the profile of revisits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in base 32, 10 hexadecimal digits to 8 at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def record_id(*key: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def escaped(value: Column) -> Column:
    """Without line ends, which would end a header field."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ESCAPES, value.cast("string"))


def unescaped(value: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(_ESCAPES), value)


def header(date: str) -> Column:
    """The bytes of a record's header, without the empty line after it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))  # noqa: E731  null without a value
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, line("WARC-Refers-To", F.col("refers_to_record"))),
        F.when(revisit, line("X-Refers-To-Page", escaped(F.col("refers_to")))),
        line("X-Page", escaped(F.col("page_id"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n")), "UTF-8")


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write the tables path/payloads (sha256, payload) and path/headers (page_id, header, sha256).

    A null html is an empty payload, a null url gives a record without target. Of equal payloads the record of the smallest
    page_id is the response (null last, and of rows that repeat an id one); the others are revisits. An empty table gives an
    empty archive. Other columns are ignored.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha2("payload", 256))
    index = cut(rows.select("page_id", "url", key.alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")))
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("row"), F.col("url"))
    firsts = index.groupBy("sha256").agg(F.min(rank).alias("first"))
    # equal payloads may be a large share of all rows: the other side has each key once, so that such a join can be split
    of = index.join(firsts, "sha256")
    response = (F.col("row") == F.col("first.row")) | (F.col("bytes") < min_bytes)
    me, it = (record_id(F.col(f"{p}page_id"), F.col(f"{p}url"), F.col(f"{p}row"), F.col("sha1")) for p in ("", "first."))
    typed = of.withColumn("record_type", F.when(response, "response").otherwise("revisit")).withColumn("record_id", me).withColumn("refers_to_record", it).withColumn("refers_to", F.col("first.page_id"))
    typed.select("page_id", header(date).alias("header"), "sha256").write.parquet(f"{path}/headers")
    # the rows of the firsts alone; of rows that repeat an id with its payload one. The join and the window have the same
    # keys, so payloads are shuffled once
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stored = rows.select(key.alias("sha256"), name("page_id").alias("id"), "url", "payload").join(firsts.select("sha256", name("first.page_id").alias("id")), ["sha256", "id"], "left_semi")
    one = F.row_number().over(Window.partitionBy("sha256", "id").orderBy("url"))
    stored.withColumn("one", one).where("one = 1").select("sha256", "payload").write.parquet(f"{path}/payloads")


def field(name: str) -> Column:
    """The value of a header's field; null without the field."""
    text = F.decode("header", "UTF-8")
    return F.when(F.instr(text, f"\r\n{name}: ") > 0, F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1))


def verified(payload: Column, sha256: Column) -> Column:
    """The payload, or an error if it isn't what was stored."""
    return F.when(F.unhex(F.sha2(payload, 256)) == sha256, payload).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex(sha256))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest and payload_bytes of each record, from its header and its verified payload."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("payload", verified(F.col("payload"), F.col("sha256")))
    facts = payloads.select("sha256", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("actual"))
    kind = dict(headers.dtypes)["page_id"]
    parsed = headers.select(
        unescaped(field("X-Page")).cast(kind).alias("page_id"), field("WARC-Type").alias("record_type"), unescaped(field("X-Refers-To-Page")).cast(kind).alias("refers_to"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"), "sha256",
    )
    sure = F.when(F.col("payload_digest") == F.col("actual"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest isn't its payload's")))
    return parsed.join(facts, "sha256").select("page_id", "payload_bytes", sure.alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the bytes of the whole WARC record) and payload (also of revisits), joined from headers and payloads."""
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("payload", verified(F.col("payload"), F.col("sha256")))
    joined = spark.read.parquet(f"{path}/headers").join(payloads, "sha256")
    end = F.encode(F.lit("\r\n"), "UTF-8")
    block = F.when(field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return joined.select("page_id", F.concat("header", end, block, end, end).alias("record"), "payload")


def parse_records(records: DataFrame) -> DataFrame:
    """The columns of read_records, from the rows of reconstruct: the header in each whole record, and its payload."""
    # URLs have no line ends here, so the first empty line ends the header
    header = F.encode(F.concat(F.substring_index(F.decode("record", "UTF-8"), "\r\n\r\n", 1), F.lit("\r\n")), "UTF-8")
    kind = dict(records.dtypes)["page_id"]
    parsed = records.select(header.alias("header"), "payload").select(
        unescaped(field("X-Page")).cast(kind).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"), unescaped(field("X-Refers-To-Page")).cast(kind).alias("refers_to"), base32_sha1(F.col("payload")).alias("actual"),
    )
    sure = F.when(F.col("payload_digest") == F.col("actual"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest isn't its payload's")))
    return parsed.select("page_id", "payload_bytes", sure.alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(read(spark, sf_dir, "pages"), path)
    return parse_records(reconstruct(spark, path))


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
