"""Web archives: pages written as WARC records with revisits, and read back by a verified chain of boundaries.

Writing. Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest (page_id, url)
is the response record; the others are revisit records without payload, which name it. Only digests are
grouped, and copies are joined from a table that holds groups of two or more alone, so pages stay
where they are read as long as few are copies. Spark's text sink writes the records, uncompressed,
which keeps files of any size splittable.

Reading. A file is read in splits of lines that end at the version line, the magic. Every line is a candidate
record and names its successor by its own Content-Length; a payload that holds the magic, or a whole record,
yields false candidates. Positions in a split become offsets through the sizes of the splits before it.
A task follows its split's candidates to the first offset beyond it; between splits, pointer jumping from the
start of the file doubles the distance in each round, until the one entry of each split is known. What the chain
reaches from there is a record, everything else is payload. A record without the magic in its payload is read
whole in the first pass; the others are put together from their lines in a second one.

Defined cases: null html is an empty payload; a null page_id comes after all others and gives no page
header; control characters of a url are escaped; of rows that repeat the first page of a group, one is the
response; payloads below ``min_bytes`` are always responses; bytes before the first magic, after a broken
successor and a record cut off by the end of its file are left out; a revisit whose response is missing has
null payload columns; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopmetrics.sources.staging import stage

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Equal payloads of at least so many bytes are archived once.
MIN_BYTES = 0

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = "record_id string, record_type string, page_id long, url string, refers string, payload_bytes long, payload_digest string, digest_ok boolean"
LINES = f"file string, block long, at long, size long, start long, next long, leave long, whole boolean, {FIELDS}"
_FIELD_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 160 bits given in hexadecimal: five digits make four characters."""

    def character(k: Column) -> Column:
        bits = F.conv(F.substring(digest, F.call_function("div", k, F.lit(4)).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.substring(F.lit(BASE32), F.call_function("shiftright", bits, 15 - k % 4 * 5).bitwiseAND(31) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), character), "")


def _id(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(date: str) -> Column:
    """A record without its end, from page_id, url, digest, size, payload, own id ``own`` and, of a revisit, ``refers``."""
    revisit = F.col("refers").isNotNull()
    uri = F.transform(F.split("url", ""), lambda c: F.when(c < " ", F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    uri = F.when(F.col("url").rlike("[\\x00-\\x1F]"), F.array_join(uri, "")).otherwise(F.col("url"))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    return F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("own"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", urn(F.col("refers"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.when(revisit, 0).otherwise(F.col("size")) + len(HTTP)).cast("string")),
        F.lit("\r\n" + HTTP),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as WARC files into the new folder ``path``."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})

    # Groups of equal payloads with their first page and the number of its rows.
    order = [F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "times"]
    times = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size", "page_id", "url").agg(F.count("*").alias("times"))
    first = times.groupBy("digest", "size").agg(F.min(F.struct(*order)).alias("lead"), F.sum("times").alias("rows")).where("rows > 1")
    first = stage(first.select("digest", "size", "lead"), "warc-copies")

    lead_id = _id(F.col("digest"), F.col("size"), F.col("lead.page_id"), F.col("lead.url"))
    leads = F.col("page_id").eqNullSafe(F.col("lead.page_id")) & F.col("url").eqNullSafe(F.col("lead.url"))
    follows = F.col("lead").isNotNull() & ~leads
    known = rows.join(first, ["digest", "size"], "left")
    columns = ["page_id", "url", "digest", "size", "payload", "own", "refers"]
    single = known.where(F.col("lead").isNull() | ~leads | (F.col("lead.times") == 1)).select(
        "page_id", "url", "digest", "size", "payload",
        F.when(leads, lead_id).otherwise(F.uuid()).alias("own"),
        F.when(follows, lead_id).alias("refers"),
    )
    # A first page that repeats: one payload, combined before the shuffle, and a revisit for each further row.
    repeated = first.where("lead.times > 1")
    one = rows.join(repeated, ["digest", "size"]).where(leads).groupBy("digest", "size", "lead").agg(F.first("payload").alias("payload"))
    one = one.withColumns({"own": lead_id, "refers": F.lit(None).cast("string")})
    more = repeated.withColumn("k", F.explode(F.sequence(F.lit(2).cast("long"), "lead.times")))
    more = more.withColumns({"payload": F.lit(""), "own": F.uuid(), "refers": lead_id})
    again = one.drop("k").unionByName(more.drop("k")).select("lead.page_id", "lead.url", *columns[2:])
    records = single.select(columns).union(again.select(columns))
    records.select(_record(date)).write.option("lineSep", END).text(path)


def parse(line: bytes) -> tuple[int, int, dict] | None:
    """(bytes of the header, bytes of the block, header fields) of what follows a magic, None if it is no header."""
    end = line.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in line[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return (end + 4, int(length), fields) if length.isascii() and length.isdigit() and len(length) < 19 else None


def described(line: bytes, head: int, length: int, fields: dict) -> tuple:
    """Values of FIELDS from a record whose block is whole."""
    block = memoryview(line)[head : head + length]
    start = line.find(b"\r\n\r\n", head, head + length)
    payload = block[start - head + 4 :] if start >= 0 else block[length:]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = fields.get("warc-type", "")
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    page = fields.get("warc-page-id")
    urn = lambda name: fields[name].removeprefix("<urn:uuid:").removesuffix(">") if name in fields else None
    return (
        urn("warc-record-id"), kind, int(page) if page else None, fields.get("warc-target-uri"), urn("warc-refers-to"),
        len(payload) if kind == "response" else None, digest if kind == "response" else declared,
        digest == declared if kind == "response" else None,
    )


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _split_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, position in the split, line) in order; positions count the magic after each line."""
    here, at = None, 0
    for batch in batches:
        for file, block, line in zip(*[batch.column(c) for c in ("file", "block", "line")], strict=True):
            key = (file.as_py(), block.as_py())
            if key != here:
                here, at = key, 0
            line = line.as_py()
            yield *key, at, line
            at += len(line) + len(MAGIC)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line of a split; ``leave`` is the first offset beyond the split that its successors lead to."""
    schema = _schema(LINES)
    rows: list[list] = []
    here = None

    def flushed() -> pa.RecordBatch:
        leave: dict[int, int] = {}
        for row in reversed(rows):
            if row[5] is not None:
                row[6] = leave[row[4]] = leave.get(row[5], row[5])
        out = _batch(rows, schema)
        rows.clear()
        return out

    for file, block, at, line in _split_lines(batches):
        if here not in (None, (file, block)):
            yield flushed()
        here = (file, block)
        found = parse(line) if block or at else None  # what precedes the first magic of a file is no record
        row = [file, block, at, len(line), at - len(MAGIC), None, None, False] + [None] * len(_FIELD_NAMES)
        if found:
            head, length, fields = found
            row[5] = at + head + length + len(END)
            row[7] = head + length <= len(line)
            if row[7]:
                row[8:] = described(line, head, length, fields)
        rows.append(row)
    if rows:
        yield flushed()


def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted lines the start of the record that they belong to, followed from the entry of their split."""
    here = record = expected = None
    for batch in batches:
        out = []
        names = ("file", "block", "entry", "start", "next")
        for file, block, entry, start, successor in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if (file, block) != here:
                here, record, expected = (file, block), None, entry
            if start == expected and successor is not None:
                record, expected = start, successor
            out.append(record)
        yield batch.append_column("record", pa.array(out, pa.int64()))


def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema("file string, block long, at long, line binary")
    for row in _split_lines(batches):
        yield _batch([row], schema)


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records put together from their lines, in order; those cut off by the end of the file are left out."""
    schema = _schema(f"file string, start long, {FIELDS}")
    for batch in batches:
        for file, start, lines in zip(*[batch.column(c) for c in ("file", "record", "lines")], strict=True):
            whole = MAGIC.encode().join(x["line"] for x in lines.as_py())
            head, length, fields = parse(whole)
            if head + length <= len(whole):
                yield _batch([(file.as_py(), start.as_py(), *described(whole, head, length, fields))], schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives in ``path``: file, start and FIELDS; payload columns of a revisit are as declared."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    block = F.col("_metadata.file_block_start").alias("block")
    text = text.select(F.col("_metadata.file_path").alias("file"), block, F.col("value").cast("binary").alias("line"))
    lines = stage(text.mapInArrow(candidates, LINES), "warc-lines")

    # Offsets: a split starts where the one before it ends.
    per_file = Window.partitionBy("file").orderBy("block")
    blocks = lines.groupBy("file", "block").agg((F.max(F.col("at") + F.col("size")) + len(MAGIC)).alias("span"))
    before = F.coalesce(F.sum("span").over(per_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stage(blocks.select("file", "block", before.alias("base")), "warc-blocks")
    placed = lines.join(blocks, ["file", "block"])
    placed = placed.withColumns({c: F.col(c) + F.col("base") for c in ("start", "next", "leave")})

    # Pointer jumping over the offsets where chains enter a split.
    nodes = placed.where("next is not null").select("file", "start", "leave")
    targets = nodes.select("file", F.col("leave").alias("start")).union(blocks.where("base = 0").select("file", "base")).distinct()
    jumps = stage(nodes.join(targets, ["file", "start"], "left_semi"), "warc-jumps")
    known = jumps.where("start = 0").select("file", "start")
    splits = blocks.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(max(0, splits - 1).bit_length()):
        ahead = known.join(jumps, ["file", "start"]).select("file", F.col("leave").alias("start"))
        known = stage(known.union(ahead).distinct(), "warc-known")
        onward = jumps.select("file", F.col("start").alias("leave"), F.col("leave").alias("further"))
        jumps = jumps.join(onward, ["file", "leave"], "left")
        jumps = stage(jumps.select("file", "start", F.coalesce("further", "leave").alias("leave")), "warc-jumps")

    entry = placed.where("next is not null").select("file", "block", "start").join(known, ["file", "start"])
    entry = entry.groupBy("file", "block").agg(F.min("start").alias("entry"))
    marked = placed.join(entry, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "at")
    marked = stage(marked.mapInArrow(reached, f"{_ddl(marked)}, record long"), "warc-marked")
    complete = marked.where("record = start and whole").select("file", "start", *_FIELD_NAMES)

    # Records with the magic in their payload: all lines from the record's start to its successor's.
    parted = marked.where("record = start and not whole").select("file", "record", F.col("next").alias("until"))
    if parted.isEmpty():
        return complete
    last = marked.groupBy("file", "block").agg(F.max("record").alias("last"))
    carried = F.max("last").over(per_file.rowsBetween(Window.unboundedPreceding, -1))
    last = last.select("file", "block", carried.alias("carried"))
    owned = marked.join(last, ["file", "block"], "left").withColumn("record", F.coalesce("record", "carried"))
    owned = owned.join(parted, ["file", "record"]).where("start < until").select("file", "block", "at", "start", "record")
    content = text.mapInArrow(lines_of, "file string, block long, at long, line binary")
    pieces = content.join(owned, ["file", "block", "at"]).groupBy("file", "record")
    pieces = pieces.agg(F.array_sort(F.collect_list(F.struct("start", "line"))).alias("lines"))
    return complete.union(pieces.mapInArrow(assembled, f"file string, start long, {FIELDS}"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok); a revisit has its response's payload."""
    records = stage(records, "warc-records")
    payload = ["payload_bytes", "payload_digest"]
    revisits = records.where("record_type = 'revisit'").select("page_id", "url", "record_type", F.col("refers").alias("record_id"))
    responses = records.where("record_type = 'response'")
    kept = responses.select("record_id", *payload, F.col("page_id").alias("refers_to"), "digest_ok")
    columns = ["page_id", "url", *payload, "record_type", "refers_to", "digest_ok"]
    found = revisits.join(kept, "record_id", "left").select(columns)
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(found)
