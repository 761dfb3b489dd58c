"""Hashes of texts and of canonical payloads, and guards on them and on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of UTF-8 text or bytes."""
    return F.sha2(text, 256)


def payload_hash(**fields: Column) -> Column:
    """Hash of fields as JSON with sorted keys, nulls kept."""
    payload = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return text_hash(F.to_json(payload, {"ignoreNullFields": "false"}))


def chained_hash(*values: Column) -> Column:
    """Hash of values joined by NUL; null counts as empty."""
    return text_hash(F.array_join(F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values]), "\0"))


def run_input_hash(source_sha: Column, subject: Column, question: Column, pages: Column, config: Column) -> Column:
    """Hash of what a run depends on; the page list is sorted and distinct, null for all pages."""
    chosen = F.array_sort(F.array_distinct(pages))
    return payload_hash(source=source_sha, subject=subject, question=question, pages=chosen, config=config)


def image_payload(images: Column) -> Column:
    """Images (digest, bbox, width_px, height_px) in an order that doesn't depend on extraction, as JSON texts."""
    rounded = F.transform(
        images,
        lambda i: F.to_json(
            F.struct(
                F.transform(i["bbox"], lambda v: F.round(v, 3)).alias("bbox"),
                i["digest"].alias("digest"),
                i["height_px"].alias("height"),
                i["width_px"].alias("width"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )
    return F.array_sort(rounded)


def checked(condition: Column, value: Column, message: str) -> Column:
    """`value`, or an error where the condition isn't true."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def is_relative(path: Column) -> Column:
    """Whether a path stays below its root on any platform: not absolute, no drive, no `..` part."""
    absolute = path.rlike(r"^([/\\]|[A-Za-z]:)")
    return F.coalesce((F.length(path) > 0) & ~absolute & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def relative_to(path: Column, root: Column) -> Column:
    """POSIX path below `root`, null if it isn't below."""
    unix, base = F.replace(path, F.lit("\\"), F.lit("/")), F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/"))), F.lit("/"))
    return F.when(F.startswith(unix, base), F.substr(unix, F.length(base) + 1))


def run_directory(subject: Column, question: Column, source_sha: Column, input_hash: Column) -> Column:
    """<subject>/<question>-<12 of source>-<12 of input>."""
    return F.concat(subject, F.lit("/"), F.concat_ws("-", question, F.left(source_sha, F.lit(12)), F.left(input_hash, F.lit(12))))


def has_offset(text: Column) -> Column:
    """Whether an ISO timestamp parses and says its offset from UTC."""
    return F.coalesce(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & F.try_to_timestamp(text).isNotNull(), F.lit(False))
