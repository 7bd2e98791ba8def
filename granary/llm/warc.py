"""WARC archives compressed with Zstandard: writing them from a table of pages and reading them back.

An archive is a file whose first frame is a skippable one that holds the dictionary (itself compressed), followed by
one Zstandard frame per record, as the public .warc.zst convention lays down. Files are written by Spark's own text
writer, so every file system and commit protocol that Spark knows works, tasks can be retried, and nothing passes
through the driver: each row is one frame, and the "line separator" is an empty skippable frame, which readers skip.
Payloads that occur more than once are stored once: the record with the largest page_id is the response, all others
are revisit records that refer to it.

A payload may be that of a third of all pages (an error page): joins by payload and by what is referred to are dealt
over `SALTS` tasks, and are between ids and digests only.

Defined results: a null html is an empty payload; a null url gives a record without target; equal payloads (by SHA-1
and length) below `min_bytes` all stay responses; rows that repeat a page_id are judged each by itself; rows without one
are responses, and never what others refer to; an empty table gives an empty archive set. A record is named by its page
and payload, since pages with different payloads may share a page_id; of rows that repeat both, all but the first have a
number besides. Records whose header, length or digest is wrong raise ValueError with the file's name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import scratch_path, stored, table

#: Skippable frames begin with one of sixteen magic numbers; the dictionary's is the last but two of them.
DICTIONARY_MAGIC, EMPTY_MAGIC = 0x184D2A5D, 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; eight ASCII bytes.
SEPARATOR = struct.pack("<II", EMPTY_MAGIC, 0)
ARCHIVE_BYTES = 8 << 20
#: The dictionary is made of the first DICTIONARY_CHARS characters of about DICTIONARY_PAGES pages.
DICTIONARY_BYTES, DICTIONARY_PAGES, DICTIONARY_CHARS = 64 << 10, 400, 2000
SALTS = 16
RECORD_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode("ascii")


def record_uri(page_id: int | str | None, digest: str, nth: int = 0) -> str:
    """The record's id: its page (empty for rows without a page_id), payload, and number among equal ones."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{f':{nth}' if nth else ''}>"


def page_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").partition(":")[0]
    return int(number) if number else None


def make_record(page_id: int | str | None, url: str | None, html: str | None, refers_to: int | str | None, digest: str, nth: int = 0) -> bytes:
    """One record. A revisit has the response's HTTP head but no payload."""
    payload = b"" if refers_to is not None or html is None else html.encode("utf-8")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id, digest, nth)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block; raises ValueError unless version, lengths and block digest hold."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"the header {name} is missing")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, but the block has {len(rest) - 4} bytes")
    block = rest[:n]
    told = headers.get("warc-block-digest")
    if told and told != f"sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}":
        raise ValueError("the block's digest differs")
    return headers, block


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame ends that begins at a place, from its block headers."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError("a frame is cut off")
        header = int.from_bytes(data[end : end + 3], "little")
        last, run_length = bool(header & 1), (header >> 1) & 3 == 1
        end += 3 + (1 if run_length else header >> 3)
    end += 4 * bool(data[at + 4] & 4)
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, content) of each frame: decompressed records, and the content of skippable frames but empty ones.

    The dictionary is taken from the leading skippable frame if there is one.
    """
    at, dictionary, reader = 0, None, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            content = data[at + 8 : at + 8 + size]
            if len(content) < size:
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = zstandard.ZstdDecompressor().decompress(content) if content[:4] == struct.pack("<I", FRAME_MAGIC) else content
                dictionary = zstandard.ZstdCompressionDict(raw)
                reader = zstandard.ZstdDecompressor(dict_data=dictionary)
                yield magic, raw
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            step = reader.decompressobj()
            content = step.decompress(data[at:end])
            if not step.eof or step.unused_data:
                raise ValueError("a frame is cut off")
            yield magic, content
            at = end
        else:
            raise ValueError(f"no frame begins with {magic:#x}")


def train_dictionary(pages: DataFrame, n_pages: int = DICTIONARY_PAGES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of raw content from a bounded sample: beginnings of the n_pages pages with the smallest hashes.

    A hash bound leaves about twice as many rows before they are sorted, so that no task sends a full sample.
    """
    share = min(1.0, 2 * n_pages / max(1, pages.count()))
    hashed = pages.where("html <> ''").select(F.substring("html", 1, DICTIONARY_CHARS).alias("h"), F.xxhash64("page_id", "url").alias("o"))
    sample = hashed.where(F.col("o") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).orderBy("o", "h").limit(n_pages)
    return b"".join(r.h.encode("utf-8") for r in sample.select("h").collect())[:size]


def salted(df: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def salt_of(page_id: Column) -> Column:
    return F.pmod(F.xxhash64(page_id), F.lit(SALTS)).cast("int")


def refer(pages: DataFrame, parts: int, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), digest (hexadecimal) and refers_to, dealt by page_id to so many partitions.

    What refers to what is worked out on ids and digests; the html itself is shuffled once.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    kept = light.groupBy("digest", "size").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    dealt = light.where(F.col("size") >= min_bytes).withColumn("salt", salt_of(F.col("page_id")))
    refs = dealt.join(salted(kept), ["digest", "size", "salt"]).where(F.col("page_id") != F.col("kept_id")).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "kept_id").distinct()
    own = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest")).repartition(parts, "page_id", "digest")
    joined = own.join(refs.repartition(parts, "r_id", "r_digest"), (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    return joined.select("page_id", "url", F.when(F.col("kept_id").isNull(), F.col("html")).alias("html"), F.col("kept_id").alias("refers_to"), "digest")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One archive per partition of about archive_bytes of payload; every archive begins with the dictionary's frame."""
    raw = train_dictionary(pages)
    leading = dictionary_frame(raw)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    rows = refer(pages, max(1, -(-total // archive_bytes)), min_bytes)

    def frames_of(batches):
        packer, first = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True), True
        # rows of one page and payload are in one archive
        written = Counter()
        for pdf in batches:
            made = [leading] if first else []
            first = False
            for page_id, url, html, refers_to, digest in zip(pdf.page_id, pdf.url, pdf.html, pdf.refers_to, pdf.digest):
                made.append(packer.compress(make_record(page_id, url, html, refers_to, base32_sha1(digest), written[page_id, digest])))
                written[page_id, digest] += 1
            yield type(pdf)({"frame": made})

    # ids go as text, which pandas keeps exact beside nulls
    out = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string")).mapInPandas(frames_of, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.option("lineSep", SEPARATOR.decode("ascii")).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under a path: RECORD_FIELDS, and html for responses.

    Size and digest of a response are those of the payload that was read; those of a revisit come from the response
    that it refers to.
    """

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                rows = []
                for magic, data in frames(bytes(content)):
                    if magic != FRAME_MAGIC:
                        continue
                    try:
                        headers, block = parse_record(data)
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = "sha1:" + base32_sha1(hashlib.sha1(payload).hexdigest())
                        if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != digest:
                            raise ValueError("the payload's digest differs")
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from None
                    whole = headers["warc-type"] == "response"
                    rows.append((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], page_of(headers.get("warc-refers-to")), len(payload) if whole else None, headers["warc-payload-digest"].removeprefix("sha1:"), payload.decode("utf-8") if whole else None))
                names = [f.split(" ")[0] for f in (RECORD_FIELDS + ", html string").split(", ")]
                columns = zip(*rows) if rows else [[] for _ in names]
                # whole numbers beside nulls: pandas would take them for floats, which aren't exact
                out = pd.DataFrame({c: pd.array(list(v), dtype="Int64") if c in ("page_id", "refers_to", "payload_bytes") else pd.Series(list(v), dtype=object) for c, v in zip(names, columns)})
                yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    records = files.mapInPandas(parse, RECORD_FIELDS + ", html string")
    return records


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size of what they refer to; html is left out."""
    flat = stored(records.drop("html"), "records")
    revisits = flat.where("refers_to IS NOT NULL")
    wanted = revisits.select(F.col("refers_to").alias("to_id"), F.col("payload_digest").alias("to_digest")).distinct()
    target = (F.col("page_id") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest"))
    sizes = flat.where("record_type = 'response'").join(wanted, target).groupBy("to_id", "to_digest").agg(F.max("payload_bytes").alias("to_bytes"))
    dealt = revisits.withColumn("salt", salt_of(F.col("page_id")))
    joined = dealt.join(salted(sizes.withColumnsRenamed({"to_id": "refers_to", "to_digest": "payload_digest"})), ["refers_to", "payload_digest", "salt"], "left")
    return flat.where("refers_to IS NULL").unionByName(joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "to_bytes")).select(flat.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    got = resolved(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return got


def oracle() -> str:
    """DuckDB has sha1 in hexadecimal but no base32; the digest is spelt out from its bits."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex,
        max(page_id) OVER (PARTITION BY h) AS kept_id FROM p),
b AS (SELECT *, list_reduce(list_transform(generate_series(1, 40), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM s)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(generate_series(0, 31), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(generate_series(1, 5), lambda j: CAST(bits[5 * k + j] AS INTEGER) * (1 << (5 - j))))::INTEGER]), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = kept_id THEN NULL ELSE kept_id END AS refers_to
FROM b"""
