"""Files as rows: folder scans, type detection, text decoding, archive inventory, and the content-addressed store."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by category.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx docm", "xlsx": "xlsx xlsm", "pptx": "pptx", "office_legacy": "doc xls ppt rtf odt ods odp", "image": "png jpg jpeg tif tiff bmp gif webp", "audio": "wav mp3 m4a flac ogg opus wma aac",
    "video": "mp4 mov avi mkv webm wmv m4v mpg mpeg", "zip": "zip", "tar": "tar tgz gz bz2 xz", "archive_other": "7z rar", "text": "txt md csv tsv json xml html htm log ini yaml yml rst",
}
#: First bytes, in hexadecimal, that decide before the extension does.
MAGIC = (("25504446", "pdf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("494433", "audio"), ("664C6143", "audio"), ("4F676753", "audio"), ("1A45DFA3", "video"))


def scan(spark: SparkSession, folder: str, content: bool = True, settled_seconds: int = 2) -> DataFrame:
    """``(path, name, size, modified[, content])`` of a folder's files, without hidden and temporary names and files just written."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kept = f.withColumn("name", name).filter(~F.regexp_like("name", F.lit("^(\\.|~\\$)|\\.(tmp|part|crdownload)$")))
    kept = kept.filter(F.col("modificationTime") <= F.current_timestamp() - F.make_interval(secs=F.lit(settled_seconds)))
    return kept.select("path", "name", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def detect(name: Column, content: Column) -> Column:
    """Category of a file: PDF and media by their first bytes, then the extension, then whether the start is text."""
    ext = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    start = F.hex(F.substring(content, 1, 16))
    known = lambda c: ext.isin(*EXTENSIONS[c].split())
    out = F.when(start.startswith("25504446") | known("pdf"), "pdf")
    for c in ("docx", "xlsx", "pptx", "office_legacy"):
        out = out.when(known(c), c)
    for c in ("image", "audio", "video"):
        bytes_ = [start.startswith(h) for h, k in MAGIC if k == c]
        hit = known(c)
        for b in bytes_:
            hit = hit | b
        out = out.when(hit, c)
    out = out.when(known("zip") | (start.startswith("504B0304") & ~known("tar") & ~known("archive_other")), "zip").when(known("tar"), "tar").when(known("archive_other"), "archive_other")
    head = F.substring(content, 1, 4096)
    readable = F.try_validate_utf8(head.cast("string")).isNotNull() & (F.instr(head.cast("string"), "\u0000") == 0) & (F.length(content) > 0)
    return out.when(known("text") | readable, "text").otherwise("unknown")


def decode_bytes(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8, then the Turkish Windows code page, then Latin-1."""
    tries = (["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []) + ["utf-8-sig", "cp1254"]
    for encoding in tries:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text``: the decoded bytes; other columns stay, the bytes go."""
    keep = [c for c in files.columns if c != content]
    fields = ", ".join(f"`{c}` {t}" for c, t in files.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([None if x is None else decode_bytes(x) for x in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), text], names=[*keep, "text"])

    return files.select(*keep, content).mapInArrow(run, f"{fields}, text string" if fields else "text string")


def unescape(pages: DataFrame, column: str) -> DataFrame:
    """Every HTML entity of a column as its character; the built-in ``strip_html`` handles the common ones without this."""
    fields = pages.schema
    k = pages.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[k] = pa.array([None if x is None else html.unescape(x) for x in cols[k].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return pages.mapInArrow(run, fields)


# ------------------------------------------------------------------ archives

MEMBER_BYTES, TOTAL_BYTES, RATIO, MEMBERS = 200 << 20, 1 << 30, 200, 5000


def archive_members(members: DataFrame) -> DataFrame:
    """``members(archive, ord, name, size, packed, is_link, is_dir)`` with ``status`` and ``reason``.

    Unsafe members are blocked; of the others, those are extracted whose sizes,
    summed in order over the extracted ones only, stay within the total.  An
    archive of more than MEMBERS members is refused: all of them are blocked.
    """
    n = F.col("name")
    unsafe = (
        F.when(n.rlike("^([/\\\\]|[A-Za-z]:)"), "absolute_path").when(n.rlike("(^|[/\\\\])\\.\\.([/\\\\]|$)"), "parent_path").when(F.col("is_link"), "link").when(F.col("size") > MEMBER_BYTES, "too_large")
        .when((F.col("packed") > 0) & (F.col("size") / F.col("packed") > RATIO), "ratio").when(F.lower(n).rlike("\\.(zip|tar|tgz|gz|7z|rar|bz2|xz)$"), "nested_archive")
    )
    known = F.lower(n).rlike("\\.(" + "|".join(x for c in ("pdf", "docx", "xlsx", "pptx", "text", "image") for x in EXTENSIONS[c].split()) + ")$")
    rows = members.withColumn("reason", unsafe).withColumn("usable", F.col("reason").isNull() & ~F.col("is_dir") & known)
    counts = rows.groupBy("archive").agg((F.count("*") > MEMBERS).alias("refused"))
    rows = rows.join(counts, "archive")
    refused = rows.filter("refused").select("archive", "name", F.lit("blocked").alias("status"), F.lit("too_many_members").alias("reason"))
    listed = rows.filter("not refused").groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "size", "is_dir", "reason", "usable"))).alias("m"))  # at most MEMBERS of an archive
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<name:string,status:string,reason:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["usable"] & (acc["total"] + x["size"] <= TOTAL_BYTES)
        status = F.when(x["reason"].isNotNull(), "blocked").when(x["is_dir"], "skipped").when(fits, "extracted").when(x["usable"], "blocked").otherwise("catalogued")
        item = F.struct(x["name"].alias("name"), status.alias("status"), F.coalesce(x["reason"], F.when(x["usable"] & ~fits, "total_size")).alias("reason"))
        return F.struct((acc["total"] + F.when(fits, x["size"]).otherwise(0)).cast("long").alias("total"), F.concat(acc["out"], F.array(item)).alias("out"))

    return listed.select("archive", F.explode(F.aggregate("m", start, step, lambda a: a["out"])).alias("x")).select("archive", "x.*").unionByName(refused)


# ------------------------------------------------------------------ store


def stored_path(doc_id: Column, version: Column, sha: Column, name: Column) -> Column:
    """Where a version's bytes lie: by document, version number and the start of their hash."""
    ext = F.lower(F.regexp_extract(name, "(\\.[A-Za-z0-9]{1,8})$", 1))
    return F.concat(F.lit("document-versions/"), doc_id.cast("string"), F.lit("/v"), F.lpad(version.cast("string"), 4, "0"), F.lit("_"), F.substring(sha, 1, 12), ext)


def manifests(versions: DataFrame) -> DataFrame:
    """``(doc_id, manifest)``: the versions of each document as JSON, in order."""
    fields = F.struct("version", "sha", "name", stored_path(F.col("doc_id"), F.col("version"), F.col("sha"), F.col("name")).alias("path"))
    return versions.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("manifest"))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose hash and page a parser's cache doesn't have."""
    return files.join(cache.select("sha", "page"), ["sha", "page"], "left_anti")
