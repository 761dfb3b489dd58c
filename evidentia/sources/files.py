"""File sources: content-addressed scans, JSON and Markdown with issues instead of errors, ZIP members."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text

try:
    import yaml
except ImportError:
    yaml = None


#: Bytes of unpacked members that are held before they are handed on.
BATCH_BYTES = 8 << 20


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, sha256, content) of files below `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def snapshots(files: DataFrame) -> DataFrame:
    """One row for each content, its object name and first path."""
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.min("size").alias("size"), F.count("*").alias("n_files")).withColumn("object", F.concat("sha256", F.lit(".pdf")))


def integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (sha256, size) with their state in the store: OK, MISSING, or CORRUPT where the size differs."""
    held = files.groupBy("sha256").agg(F.max("size").alias("found_size"))
    state = F.when(F.col("found_size").isNull(), "MISSING").when(F.col("found_size") != F.col("size"), "CORRUPT").otherwise("OK")
    return manifest.join(held, "sha256", "left").withColumn("state", state)


def directory_hash(files: DataFrame, root: str) -> DataFrame:
    """(directory_sha256, n_files) over relative names and contents in name order."""
    name = F.regexp_replace("path", rf"^(?:file:)?/*{root.strip('/')}/", "")
    listed = F.array_sort(F.collect_list(F.struct(name.alias("name"), "sha256")))
    joined = F.array_join(F.transform(listed, lambda f: F.concat(f["name"], F.lit("\0"), f["sha256"])), "\0")
    return files.agg(F.sha2(joined, 256).alias("directory_sha256"), F.count("*").alias("n_files"))


def json_objects(files: DataFrame) -> DataFrame:
    """Files as (path, sha256, payload variant, issue): NOT_UTF8, INVALID_JSON or NOT_AN_OBJECT, else null."""
    body = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    rows = files.select("path", "sha256", body.alias("body")).withColumn("payload", F.expr("try_parse_json(body)"))
    kind = F.expr("schema_of_variant(payload)")
    issue = F.when(F.col("body").isNull(), "NOT_UTF8").when(F.col("payload").isNull(), "INVALID_JSON").when(~kind.startswith("OBJECT"), "NOT_AN_OBJECT")
    return rows.withColumn("issue", issue).drop("body")


def documents(files: DataFrame) -> DataFrame:
    """UTF-8 texts that aren't blank, with the hash of their bytes; others have an issue."""
    valid = F.expr("is_valid_utf8(cast(content as string))")
    body = F.when(valid, F.col("content").cast("string"))
    issue = F.when(~valid, "NOT_UTF8").when(text.strip(body) == "", "BLANK")
    return files.select("path", "sha256", body.alias("text"), issue.alias("issue"))


def normal_newlines(body: Column) -> Column:
    """Text without a byte order mark, with LF line ends."""
    return F.regexp_replace(F.regexp_replace(body, r"^\x{FEFF}+", ""), "\r\n?", "\n")


def frontmatter(notes: DataFrame) -> DataFrame:
    """Notes (…, text) with frontmatter (JSON text of the mapping), body, and issue.

    Issues: MISSING_FENCE, INVALID_YAML, NOT_A_MAPPING. Without a YAML library only flat
    `key: value` and `key: [a, b]` lines are understood.
    """
    clean = normal_newlines(F.col("text"))
    rows = notes.withColumns({"head": F.regexp_extract(clean, r"\A---\n([\s\S]*?)\n---\n", 1), "fenced": clean.rlike(r"\A---\n[\s\S]*?\n---\n"), "body": F.regexp_replace(clean, r"\A---\n[\s\S]*?\n---\n", "")})

    @F.pandas_udf("string")
    def parse(heads: pd.Series) -> pd.Series:
        return heads.map(_parse)

    rows = rows.withColumn("parsed", parse("head"))
    issue = F.when(~F.col("fenced"), "MISSING_FENCE").when(F.col("parsed") == "!", "INVALID_YAML").when(F.col("parsed") == "?", "NOT_A_MAPPING")
    return rows.withColumns({"issue": issue, "frontmatter": F.when(issue.isNull(), F.col("parsed"))}).drop("head", "fenced", "parsed")


def _parse(head: str) -> str:
    if yaml is not None:
        try:
            value = yaml.safe_load(head) or {}
        except yaml.YAMLError:
            return "!"
        return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str) if isinstance(value, dict) else "?"
    found = {}
    for line in head.split("\n"):
        if not line.strip():
            continue
        key, colon, value = line.partition(":")
        if not colon:
            return "?"
        value = value.strip()
        items = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()]
        found[key.strip()] = items if value.startswith("[") and value.endswith("]") else value.strip("\"'")
    return json.dumps(found, ensure_ascii=False, sort_keys=True)


def patterns(notes: DataFrame, kind: str, subject: str | None = None) -> DataFrame:
    """(note_id, title, aliases, subject, body, conflicting) of notes of a type with id, title and body.

    Equal copies of an id are one; different ones are conflicting.
    """
    field = lambda name: F.nullif(F.trim(F.get_json_object("frontmatter", f"$.{name}")), F.lit(""))
    listed = F.from_json(F.get_json_object("frontmatter", "$.aliases"), "array<string>")
    single = F.when(field("aliases").isNotNull(), F.array(field("aliases")))
    rows = frontmatter(notes).where(F.col("issue").isNull()).select(
        field("pattern_id").alias("note_id"), field("title").alias("title"), F.coalesce(listed, single, F.array().cast("array<string>")).alias("aliases"), field("subject").alias("subject"), field("type").alias("type"), "body"
    )
    rows = rows.where((F.col("type") == kind) & F.col("note_id").isNotNull() & F.col("title").isNotNull() & (text.strip(F.col("body")) != ""))
    rows = rows if subject is None else rows.where(F.col("subject") == subject)
    names = ("title", "aliases", "subject", "body")
    return rows.groupBy("note_id").agg(*[F.first(n).alias(n) for n in names], (F.countDistinct(F.to_json(F.struct(*names))) > 1).alias("conflicting"))


def zip_members(files: DataFrame, content: bool = True) -> DataFrame:
    """(path, member, member_sha256, member_size, safe, content) of ZIP files; a broken archive gives a row without member.

    Members go out as they are read, about `BATCH_BYTES` at a time, however many archives come at once; without
    `content` that column is left out and members are hashed in pieces.
    """
    names = ["path", "member", "member_sha256", "member_size", "safe"] + ["content"] * content
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    def read(path: str, data: pa.Scalar) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                for info in z.infolist():
                    safe = not info.filename.startswith(("/", "\\")) and ".." not in info.filename.replace("\\", "/").split("/") and ":" not in info.filename
                    digest, size, pieces = hashlib.sha256(), 0, []
                    with z.open(info) as member:
                        while piece := member.read(1 << 20):
                            digest.update(piece)
                            size += len(piece)
                            pieces += [piece] * content
                    yield (path, info.filename, digest.hexdigest(), size, safe, *[b"".join(pieces)] * content)
        except zipfile.BadZipFile:
            yield (path, None, None, None, False, *[None] * content)

    def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for part in parts:
            for path, data in zip(part["path"], part["content"], strict=True):
                for row in read(path.as_py(), data):
                    out.append(row)
                    held += 100 + (row[3] or 0) * content
                    if held >= BATCH_BYTES:
                        yield batch(out)
                        out, held = [], 0
        yield batch(out)

    shape = "path string, member string, member_sha256 string, member_size long, safe boolean" + ", content binary" * content
    return files.select("path", "content").mapInArrow(unpack, shape)


def packet_checks(members: DataFrame, required: list[str]) -> DataFrame:
    """(path, check, passed) rows: archive reads, names are safe and unique, required members are there."""
    rows = members.groupBy("path").agg(
        F.bool_and(F.col("member").isNotNull()).alias("archive_reads"),
        F.bool_and("safe").alias("names_are_safe"),
        (F.countDistinct("member") == F.count("member")).alias("names_are_unique"),
        (F.size(F.array_except(F.array(*map(F.lit, required)), F.collect_set("member"))) == 0).alias("required_members_present"),
    )
    checks = ("archive_reads", "names_are_safe", "names_are_unique", "required_members_present")
    return rows.select("path", F.explode(F.create_map(*[x for c in checks for x in (F.lit(c), F.col(c))])).alias("check", "passed"))


def html_text(html: Column) -> Column:
    """Readable text of a web page: no scripts, styles, comments or tags; named entities of markup decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
