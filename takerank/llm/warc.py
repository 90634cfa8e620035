"""Content-addressed WARC archive: payloads once, record headers apart, records through joins.

An archive is a folder with two Parquet tables: ``payloads`` (sha256, sha1, n_bytes, payload), a row
for each distinct payload, and ``records`` (page_id, url, record_type, refers_to, sha256, header), a
row for each record with its exact header bytes. Payloads are addressed by SHA-256, which is
recomputed from the bytes when an archive is read; the SHA-1 digest is for the WARC header. Of the
records with equal payloads of at least ``least_bytes`` bytes that with the smallest page_id is a
response and the others are revisits of it, whose records end with their header. A record names
itself by a URN whose fragment is its page id, and a revisit names its response by ``WARC-Refers-To``.

Rows that share the smallest page_id and the payload are all responses. A null page_id is never
the smallest unless all are null; a null payload counts as empty, a null url as an empty URI. In the
header, control characters, blanks and what else a URI may not hold are percent-encoded, so that a url
cannot write header lines; the column url keeps it as it is. Other columns are not read, an empty table gives
an empty archive. Writing goes to a fresh folder, so a lost task or job leaves no half-written archive
behind a finished one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takerank.llm.cluster import join_spread, scratch, stored

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # the tables have no time of capture
# The base 32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a digest in hex whose bits are a multiple of 40, as SHA-1's are."""
    groups = F.transform(F.sequence(F.lit(1), F.length(digest), F.lit(10)), lambda i: F.conv(F.substr(digest, i, F.lit(10)), 16, 10).cast("bigint"))
    letters = F.transform(groups, lambda g: F.concat(*[F.substr(F.lit(BASE32), (F.shiftright(g, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(7, -1, -1)]))
    return F.array_join(letters, "")


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def _http(n_bytes: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(CRLF + CRLF))


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name for the record of a page and payload; the fragment is the page id; a null one gives none."""
    h = F.sha2(F.concat_ws("|", F.lit("record"), page_id.cast("string"), digest), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.coalesce(F.concat(F.lit("#"), F.url_encode(page_id.cast("string"))), F.lit("")), F.lit(">"))


def _uri(url: Column) -> Column:
    """A url fit for a header line."""
    odd = r"[^!#-;=?-Z\[\]_a-z~]"  # all but the characters of a URI and the percent sign
    chars = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(odd), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(url.rlike(odd), F.array_join(chars, "")).otherwise(url)


def _header() -> Column:
    """The bytes of a record before its payload: WARC header and HTTP header."""
    http = _http(F.col("n_bytes"))
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("sha1"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("sha1")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {DATE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http), "UTF-8")


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive pages (page_id, url, html) in a fresh folder."""
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), _payload(F.col("html")).alias("payload"))
    rows = rows.select("page_id", "url", F.unhex(F.sha2("payload", 256)).alias("sha256"), "payload")
    # the first writer of a digest stores the bytes; all equal rows have the same
    distinct = rows.groupBy("sha256").agg(F.any_value("payload").alias("payload"))
    distinct.select("sha256", base32_of_hex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), "payload").write.parquet(f"{path}/payloads")
    digests = spark.read.parquet(f"{path}/payloads").select("sha256", "sha1", "n_bytes")
    keys = stored(rows.select("page_id", "url", "sha256"), "warc-keys")
    known = keys.groupBy("sha256").agg(F.min("page_id").alias("smallest")).join(digests, "sha256")
    records = join_spread(keys, known, "sha256")
    first = (F.col("n_bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("smallest"))
    records = records.withColumn("record_type", F.when(first, "response").otherwise("revisit")).withColumn("refers_to", F.when(~first, F.col("smallest")))
    records.select("page_id", "url", "record_type", "refers_to", "sha256", _header().alias("header")).write.parquet(f"{path}/records")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, url, record_type, refers_to, sha256 and the exact bytes as record.

    Responses are joined with their payloads, each of which is verified against its address (a mismatch
    is an error); revisits hold no payload, so copies of one payload do not meet in a join.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    payloads = payloads.withColumn("payload", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary")))
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    names = ["page_id", "url", "record_type", "refers_to", "sha256"]
    responses = records.where("record_type = 'response'").join(payloads, "sha256").select(*names, F.concat("header", "payload", end).alias("record"))
    revisits = records.where("record_type != 'response'").select(*names, F.concat("header", end).alias("record"))
    return responses.unionByName(revisits)


def parsed(records: DataFrame) -> DataFrame:
    """records with header (the WARC fields as text), http (the fields of the HTTP header) and body (the bytes after both), from the record bytes.

    The length that the header states must be that of the block, or it is an error.
    """
    blank = CRLF + CRLF
    text = F.decode("record", "ISO-8859-1")  # a character a byte
    cut = F.instr(text, blank)
    df = records.withColumns({"_cut": cut, "header": F.decode(F.substr("record", F.lit(1), cut + 1), "UTF-8")})
    df = df.withColumn("_http", F.position(F.lit(blank), F.decode("record", "ISO-8859-1"), F.col("_cut") + 4))
    block = F.octet_length("record") - F.col("_cut") - 3 - 4
    length = field("header", "Content-Length").cast("long")
    body = F.substr("record", F.col("_http") + 4, F.octet_length("record") - F.col("_http") - 3 - 4)
    http = F.decode(F.substr("record", F.col("_cut") + 4, F.col("_http") - F.col("_cut") - 2), "UTF-8")
    return df.withColumns({"http": http, "body": F.when(length == block, body).otherwise(F.raise_error(F.lit("record has another length than its header states")).cast("binary"))}).drop("_cut", "_http")


def field(header: str, name: str) -> Column:
    """The value of a header field; null if there is none."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("\n"), F.col(header)), rf"\n{name}: ([^\r\n]*)", 1), F.lit(""))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive pages and read them back: page_id, payload_bytes, payload_digest, record_type and refers_to, all from the rebuilt record bytes.

    Size and digest of a response are those of its body, and must be what its headers state.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, least_bytes)
    found = parsed(read(spark, path))
    kind = dict(found.dtypes)["refers_to"]
    stated = F.regexp_replace(field("header", "WARC-Payload-Digest"), "^sha1:", "")
    size = field("http", "Content-Length").cast("long")
    response = F.col("type") == "response"
    agree = ~response | ((F.col("digest") == F.col("stated")) & (F.octet_length("body") == F.col("size")))
    page = lambda name: F.when(field("header", name).contains("#"), F.url_decode(F.regexp_extract(field("header", name), "#([^>]*)>", 1))).cast(kind)
    found = found.select(page("WARC-Record-ID").alias("page_id"), "body", size.alias("size"), stated.alias("stated"), field("header", "WARC-Type").alias("type"), page("WARC-Refers-To").alias("refers_to"))
    found = found.withColumn("digest", F.when(response, base32_of_hex(F.sha1("body"))))
    checked = F.when(agree, F.col("stated")).otherwise(F.raise_error(F.lit("header and payload disagree")))
    return found.select("page_id", F.col("size").alias("payload_bytes"), checked.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
