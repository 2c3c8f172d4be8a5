"""WARC archives of captures, and their globally ordered index.

An archive is one gzip member a record, so a record can be read by its offset and length alone. Tasks
pack members into blocks of about a megabyte and Spark's text writer lays the blocks out as files, so
any file system that Spark reaches will do: a gzip member ends in the top byte of its length, zero
below 16 MiB, and that zero is the writer's line separator. Reading unpacks one member at a time.

Each archive is one capture run, sorted by URL key and timestamp where it is read and written to the
shared folder; a loser tree then merges the runs' segments of each key range.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import new_folder, stage

END = "\r\n\r\n"
HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
RECORD = "page_id long, record_type string, refers_to long, url string, warc_date string, payload_bytes long, payload_digest string, declared_digest string, archive string, record_offset long, record_bytes long, url_key string"
NAMES = [c.strip().split()[0] for c in RECORD.split(",")]
WHOLE = ["page_id", "refers_to", "payload_bytes", "record_offset", "record_bytes"]
INDEX = RECORD + ", history_no long, range_no long"
#: Total order of the index; the last two tell repeated captures apart.
ORDER = ["url_key", "warc_date", "page_id", "archive", "record_offset"]
#: Rows of one digest or original are dealt over so many keys where they meet it.
SALTS = 16


def salted(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Left join of many `rows` with at most one row of `few` for a key: keys are salted, so that one held by many rows meets in several tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return dealt.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], "left").drop("_salt")


def mark_duplicates(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Adds payload_sha1 and refers_to: of equal payloads of at least `min_bytes` the largest id is the original.

    Only digests and ids are grouped, with partial maxima. Smaller payloads and originals refer to
    nothing; in the join, smaller ones have a key of their own, so they spread evenly.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.withColumn("payload_sha1", F.sha1(body))
    large = F.octet_length("html") >= min_bytes
    keyed = hashed.withColumn("_key", F.when(large, F.col("payload_sha1")).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id").cast("string"))))
    originals = hashed.where(large).groupBy(F.col("payload_sha1").alias("_key")).agg(F.max("page_id").alias("_original"), F.count("*").alias("_n")).where("_n > 1")
    joined = salted(keyed, originals.select("_key", "_original"), ["_key"])
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("_original"), F.col("_original"))).drop("_key", "_original")


def record_id(page_id: Column) -> Column:
    """A URN whose last digits are the page's id."""
    h = F.lpad(F.lower(F.hex(page_id)), 32, "0")
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def render(marked: DataFrame) -> DataFrame:
    """One WARC/1.1 record a row, closing blank lines included: a response holds its payload, a revisit none."""
    revisit = F.col("refers_to").isNotNull()
    payload = F.coalesce("html", F.lit(""))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), F.col("warc_date"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), target)).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_sha1"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.octet_length(payload).cast("string")), F.lit(END),
    )
    return marked.select(F.concat(head, F.when(revisit, "").otherwise(payload), F.lit(END)).alias("value"))


def member(data: bytes) -> bytes:
    """One gzip member; equal data gives equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, path: str, min_bytes: int = 1000, block_bytes: int = 1 << 20, blocks_per_archive: int = 32) -> None:
    """Archives under `path`, each of at most `blocks_per_archive` blocks; a block is closed once it has `block_bytes` packed bytes.

    An archive thus holds 32 MB, or more only where single records are larger than a block.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def block() -> pd.DataFrame:
            if held[-1][-1]:  # a record of 16 MiB or more: an empty member brings the closing zero
                held.append(member(b""))
            return pd.DataFrame({"block": [b"".join(held)[:-1]]})

        for batch in batches:
            for value in batch["value"]:
                held.append(member(value.encode("utf-8")))
                size += len(held[-1])
                if size >= block_bytes:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    blocks = render(mark_duplicates(pages, min_bytes)).mapInPandas(pack, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", blocks_per_archive).text(path)


def members(content: bytes, archive: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, unpacked bytes) of each gzip member that holds anything."""
    view, at = memoryview(content), 0
    while at < len(view):
        packed, parts, fed = zlib.decompressobj(31), [], at
        while not packed.eof:
            piece = view[fed : fed + 16_384]
            if not piece:
                raise ValueError(f"{archive}: member at byte {at} has no end")
            try:
                parts.append(packed.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"{archive}: no member at byte {at}") from e
            fed += len(piece)
        end = fed - len(packed.unused_data)
        if data := b"".join(parts):
            yield at, end - at, data
        at = end


def _page(urn: str) -> int:
    value = int(re.sub(r"[^0-9a-f]", "", urn.removeprefix("<urn:uuid:")), 16)
    return value - (1 << 64) if value >> 63 & 1 else value


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then what follows the host; empty for null."""
    if url is None:
        return ""
    rest = url.partition("://")[2]
    place = re.match(r"[^/?#]*", rest)[0]
    host = re.sub(r"^www\d*\.", "", place.partition(":")[0].lower())
    return ",".join(x for x in reversed(host.split(".")) if x) + ")" + rest[len(place) :].lower()


def parse(record: bytes, archive: str, at: int, size: int) -> tuple:
    """One record as a RECORD row. A digest is taken of what was read, not of what the header says."""
    body = record.find(b"\r\n\r\n") + 4
    if body < 4 or not record.startswith(b"WARC/"):
        raise ValueError(f"{archive}: no record at byte {at}")
    fields = {k.strip().lower().decode(): v.decode("utf-8") for k, v in HEADER.findall(record, record.index(b"\r\n"), body)}
    n = int(fields["content-length"])
    if len(record) != body + n + 4 or not record.endswith(b"\r\n\r\n"):
        raise ValueError(f"{archive}: record at byte {at} doesn't end where it says")
    kind, declared, url = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-target-uri")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    digest, held = (hashlib.sha1(record[body : body + n]).hexdigest(), n) if kind == "response" else (None, None)
    return _page(fields["warc-record-id"]), kind, refers, url, fields["warc-date"], held, digest, declared, archive, at, size, url_key(url)


PLACE = [NAMES.index(c) for c in ORDER]


def sort_key(row: tuple) -> tuple:
    return tuple(row[i] for i in PLACE)


def as_frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names if c in WHOLE})


def read(spark, path: str) -> DataFrame:
    """All records of the archives under `path`, each archive's sorted by key: its run. Revisits have no payload columns of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, name in zip(batch["content"], batch["path"], strict=True):
                archive = name.rsplit("/", 1)[-1]
                rows = sorted((parse(data, archive, at, n) for at, n, data in members(content, archive)), key=sort_key)
                if rows:
                    yield as_frame(rows, NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(run, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Gives each revisit the payload size and digest of the record that it refers to.

    An original is told by id and digest and counts once, however often it was captured. Revisits of
    one original may be many: they are dealt over several keys.
    """
    at = {"_id": F.col("refers_to"), "_declared": F.col("declared_digest")}
    wanted = records.where("record_type = 'revisit'").select(*[c.alias(n) for n, c in at.items()]).distinct()
    own = records.where("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_declared"), "payload_bytes")
    source = own.join(wanted, ["_id", "_declared"], "left_semi").groupBy("_id", "_declared").agg(F.max("payload_bytes").alias("_bytes"))
    # responses have keys of their own, so that they spread evenly
    keyed = records.withColumns({"_id": F.coalesce("refers_to", "page_id"), "_declared": F.when(F.col("record_type") == "revisit", F.col("declared_digest")).otherwise("response")})
    filled = salted(keyed, source, ["_id", "_declared"])
    digest = F.when(F.col("_bytes").isNotNull(), F.col("_declared"))
    return filled.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_bytes"), "payload_digest": F.coalesce("payload_digest", digest)}).select(*records.columns)


class LoserTree:
    """Merges sorted runs of (key, row): inner nodes keep the loser of each match, so a step costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = 1
        while k < len(runs):
            k *= 2
        self.k = k
        self.loser = [-1] * k
        self.winner = self._play(1) if runs else -1

    def _head(self, r: int):
        """None sorts last: the run is used up."""
        return self.heads[r] if r < len(self.heads) else None

    def _less(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and x is not None
        return (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (b, a) if self._less(b, a) else (a, b)
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and (head := self._head(self.winner)) is not None:
            yield head
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node >= 1:
                if self._less(self.loser[node], w):
                    self.loser[node], w = w, self.loser[node]
                node //= 2
            self.winner = w


def merged_index(records: DataFrame, rows_per_range: int = 20_000) -> DataFrame:
    """The records with range_no and history_no, ordered by ORDER over all runs.

    Ranges of the full sort key are dealt out from a sample and hold about `rows_per_range` records
    however large the table: captures of one hot URL spread over several ranges by time. In each
    range the segments of the archives' runs are merged by a loser tree, which gives rows out as it
    goes. history_no counts the captures of a URL in their order from 0; a URL's history may cross
    ranges, so counts by range (a row each) give what came before. Rows are written in range order.
    """
    ranges = max(1, -(-records.count() // rows_per_range))
    dealt = records.repartitionByRange(ranges, *ORDER).sortWithinPartitions("archive", *ORDER)
    at = NAMES.index("archive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                runs.setdefault(row[at], []).append(row)
        merged = LoserTree([((sort_key(row), row) for row in own) for own in runs.values()])
        names, partition = [*NAMES, "history_no", "range_no"], TaskContext.get().partitionId()
        out, last, no = [], None, 0
        for key, row in merged:
            no = no + 1 if key[0] == last else 0
            last = key[0]
            out.append((*row, no, partition))
            if len(out) == 5000:
                yield as_frame(out, names)
                out = []
        if out:
            yield as_frame(out, names)

    merged = stage(dealt.select(*NAMES).mapInPandas(run, INDEX), "warc-index")
    ahead = Window.partitionBy("url_key").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = merged.groupBy("url_key", "range_no").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(ahead)).where("before > 0").select("url_key", "range_no", "before")
    return merged.join(before, ["url_key", "range_no"], "left").withColumn("history_no", F.col("history_no") + F.coalesce("before", F.lit(0))).select(*merged.columns)


def archive(pages: DataFrame, min_bytes: int = 1000, block_bytes: int = 1 << 20, blocks_per_archive: int = 32, rows_per_range: int = 20_000) -> DataFrame:
    """Writes every page into archives in the shared folder, reads them back and gives the merged index, revisits resolved.

    `pages` has page_id, url, html and warc_date; further columns are ignored, whatever their names.
    A null html is an empty payload, a null url leaves the target out and sorts first, a null date is
    the epoch's, and a row without an id, which nothing could refer to, gets no record. Repeated rows
    and repeated page ids each get a record, also where they are originals. Texts of any length that
    Spark can hold are one record. An empty table gives an empty index. Records are text in UTF-8, as
    html is.
    """
    path = new_folder(pages.sparkSession, "warc")
    own = pages.where("page_id is not null").select("page_id", "url", "html", F.coalesce("warc_date", F.lit("1970-01-01T00:00:00Z")).alias("warc_date"))
    write(own, path, min_bytes, block_bytes, blocks_per_archive)
    records = stage(read(pages.sparkSession, path), "warc-records")
    return resolve(merged_index(records, rows_per_range))
