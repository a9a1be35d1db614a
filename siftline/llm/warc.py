"""WARC archives: written by Spark's text writer, read back through a verified chain of boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.files import opened
from siftline.session import drop_stored, stored

#: Bytes of an archive that one task scans, of a header read at once, and of payloads sent at once.
BLOCK, HEADER, SENT = 16 << 20, 1 << 12, 8 << 20
END = b"\r\n\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n)", re.IGNORECASE)


def _one_line(column: Column) -> Column:
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"[\x00-\x1f\x7f]+", " ")


def write_archives(df: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str) -> None:
    """Write a record for each row to WARC 1.1 files below ``folder``, a file for each partition of ``df``.

    A text payload is written as UTF-8, a binary one as it is, a null one as no bytes. The id goes
    to the record id (null: no id), control characters of the URI become spaces. Nothing in a
    payload is escaped. The two line ends after a record are the writer's line separator.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"),
        _one_line(F.col(id_col)),
        F.lit(">\r\nWARC-Target-URI: "),
        _one_line(F.col(uri_col)),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(header.cast("binary"), payload).cast("string").alias("value")
    df.select(record).write.option("lineSep", END.decode()).text(folder)


def _header_end(stream, held: bytes, at: int, base: int, size: int) -> tuple[int, bytes]:
    """Where the header from ``at`` ends, reading on behind ``held`` as far as needed; -1 if nowhere."""
    searched = at
    while (end := held.find(END, searched)) < 0 and base + len(held) < size:
        searched = max(at, len(held) - 3)
        stream.seek(base + len(held))
        held += stream.read(max(HEADER, len(held) - at))
    return end, held


def _successor(stream, held: bytes, at: int, base: int, size: int) -> int:
    """Where the record that seems to start at ``at`` ends, -1 if that can't be a record's start."""
    end, held = _header_end(stream, held, at, base, size)
    length = _LENGTH.search(held, at, end + 2) if end >= 0 else None
    if not length:
        return -1
    after = base + end + 2 * len(END) + int(length[1])
    return after if after <= size else -1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block the candidates in it: offset, successor, and the first place that their chain has outside."""
    for batch in batches:
        for row in batch.to_pylist():
            path, start, size, stop = row["path"], row["start"], row["size"], row["start"] + row["block"]
            base = max(0, start - len(END))
            with opened(path) as stream:
                stream.seek(base)
                held = stream.read(stop - base + HEADER)
                found = {}
                for match in _MAGIC.finditer(held):
                    at = match.start()
                    if not start <= base + at < stop:
                        continue
                    if base + at and held[at - len(END) : at] != END:
                        continue
                    if (after := _successor(stream, held, at, base, size)) >= 0:
                        found[base + at] = after
            leaves: dict[int, int] = {}
            for offset in sorted(found, reverse=True):
                after = found[offset]
                inside = start <= after < min(stop, size)
                leaves[offset] = leaves.get(after, -1) if inside else after
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(leaves), pa.string()),
                    pa.array([size] * len(leaves), pa.int64()),
                    pa.array(leaves.keys(), pa.int64()),
                    pa.array([found[x] for x in leaves], pa.int64()),
                    pa.array(leaves.values(), pa.int64()),
                ],
                ["path", "size", "at", "successor", "leaves"],
            )


def candidates(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """``(path, size, at, successor, leaves)`` of everything that looks like a record, found block by block."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    files = files.select("path", F.col("length").alias("size"))
    blocks = files.withColumn("block", F.lit(block).cast("long")).withColumn(
        "start", F.explode(F.expr("sequence(0L, size - 1, block)"))
    )
    count = files.agg(F.sum(F.ceil(F.col("size") / block))).first()[0] or 1
    return blocks.repartition(int(count), "path", "start").mapInArrow(
        _scan, "path string, size long, at long, successor long, leaves long"
    )


def reachable(found: DataFrame) -> DataFrame:
    """``(path, at, leaves)``: where the true chain of each file enters its blocks, by pointer jumping.

    A chain goes up, so it enters a block at most once. Only places where a chain from elsewhere
    comes in can be such entries; of them, those reached from the file's start are kept. In each
    round the reached ones jump, and the jumps double: the rounds grow with the logarithm of a
    file's blocks.
    """
    entries = (
        found.select("path", F.col("leaves").alias("at")).unionByName(
            found.select("path", F.lit(0).cast("long").alias("at"))
        )
    ).distinct()
    steps = stored(found.join(entries, ["path", "at"], "left_semi").select("path", "at", "leaves"), "entries")
    jumps = steps.select("path", F.col("at").alias("start"), F.col("leaves").alias("to"))
    reached = stored(jumps.where("start = 0").select("path", F.col("start").alias("at")), "reached")
    count, before = reached.count(), 0
    while count > before:
        moved = reached.join(jumps, (reached.path == jumps.path) & (reached.at == jumps.start)).select(
            reached.path, F.col("to").alias("at")
        )
        known = steps.select("path", "at")
        new = stored(reached.unionByName(moved).distinct().join(known, ["path", "at"], "left_semi"), "reached")
        far = jumps.select("path", F.col("start").alias("to"), F.col("to").alias("next"))
        jumps = stored(jumps.join(far, ["path", "to"]).select("path", "start", F.col("next").alias("to")), "jumps")
        drop_stored(reached)
        reached, before, count = new, count, new.count()
    return steps.join(reached, ["path", "at"], "left_semi")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("archive", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()),
         ("uri", pa.string()), ("payload", pa.binary())]
    )
    for batch in batches:
        for row in batch.to_pylist():
            rows, held = [], 0
            for record in _walk(row["path"], row["at"], row["size"], row["block"]):
                rows.append(record)
                held += len(record["payload"])
                if held >= SENT:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def _walk(path: str, at: int, size: int, block: int) -> Iterator[dict]:
    """The records of the true chain from ``at`` to the end of the block that holds it."""
    stop = min(size, at - at % block + block)
    with opened(path) as stream:
        base, held = at, b""
        while at < stop:
            if at + HEADER > base + len(held):
                stream.seek(at)
                base, held = at, stream.read(max(HEADER, stop - at))
            end, held = _header_end(stream, held, at - base, base, size)
            header = held[at - base : end + 2]
            first, length = base + end + len(END), int(_LENGTH.search(header)[1])
            if first + length > base + len(held):
                stream.seek(first)
                base, held = first, stream.read(length + len(END))
            payload = held[first - base : first - base + length]
            fields = dict(re.findall(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)", header))
            text = {k.lower().decode("latin-1"): v.decode("utf-8", "replace") for k, v in fields.items()}
            yield {
                "archive": path,
                "offset": at,
                "warc_type": text.get("warc-type"),
                "record_id": text.get("warc-record-id"),
                "uri": text.get("warc-target-uri"),
                "payload": payload,
            }
            at = first + length + len(END)


def read_archives(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """``(archive, offset, warc_type, record_id, uri, payload)`` of every record of the files below ``folder``.

    Tasks scan blocks of ``block`` bytes for what looks like a record and where it would end. From the start of each
    file the chain of ends is followed; what it doesn't reach is a payload's content, whatever it
    looks like. Then each block is read once more from where the chain enters it, so payloads are
    not shuffled. A file whose chain doesn't end at its end is damaged, and an error. Empty files
    hold no records. Files must open with pyarrow (see ``files.opened``).
    """
    found = stored(candidates(spark, folder, block), "candidates")
    entries = stored(reachable(found.select("path", "at", "leaves")), "chain")
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "length")
    whole = entries.select("path", F.col("leaves").alias("length"))
    damaged = files.join(whole, ["path", "length"], "left_anti").limit(3).collect()
    if damaged:
        raise ValueError(f"the records of {[row.path for row in damaged]} don't reach the end of the file")
    sized = entries.select("path", "at", F.lit(block).cast("long").alias("block")).join(
        files.withColumnRenamed("length", "size"), "path"
    )
    blocks = max(1, entries.count())
    return sized.repartition(blocks, "path", "at").mapInArrow(
        _records,
        "archive string, offset long, warc_type string, record_id string, uri string, payload binary",
    )


def revisits(
    rows: DataFrame, id_col: str, digest_col: str = "payload_digest", bytes_col: str = "payload_bytes", least: int = 100
) -> DataFrame:
    """Add ``record_type`` and ``refers_to``: of equal payloads of ``least`` bytes or more the smallest id is the response.

    Payloads are equal if digest and size are. The others of a group are revisits of it. Rows that
    repeat the smallest id are all responses; a null id is a response only if its group has no
    other. Groups are counted before they are shuffled, and only those with more than one row are
    joined.
    """
    groups = rows.where(F.col(bytes_col) >= least).groupBy(digest_col, bytes_col)
    first = groups.agg(F.min(id_col).alias("_first"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(id_col))
    return (
        rows.join(first, [digest_col, bytes_col], "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("_first")))
        .drop("_first")
    )


def page_records(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ``folder``, read it back, and tell responses from revisits."""
    write_archives(pages, folder, "page_id", "url", "html")
    records = read_archives(pages.sparkSession, folder)
    light = stored(
        records.select(
            F.expr("try_cast(regexp_extract(record_id, '^<urn:record:(-?[0-9]+)>$', 1) AS bigint)").alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        ),
        "payloads",
    )
    return revisits(light, "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
