"""Path expressions on '/'-separated strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Text before the last '/'; the root for a top-level entry."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).when(cut == 0, F.lit("/"))


def depth(path: Column) -> Column:
    """Number of '/' in the path."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """The path and all its parents, root first. Positions therefore grow with depth."""
    parts = F.split(path, "/")
    joined = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.array_distinct(F.transform(joined, lambda p: F.when(p == "", F.lit("/")).otherwise(p)))


def is_under(path: Column, folder: Column) -> Column:
    """Whole-component test: '/a/b' is under '/a' and itself, '/a/bc' is not under '/a/b'."""
    return (path == folder) | (folder == "/") | path.startswith(F.concat(folder, F.lit("/")))


def clean_path(path: Column) -> Column:
    """Lexical normal form: no trailing or doubled '/', no '.' or '..' parts. Blank stays blank."""
    kept = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        kept, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))))
    lead = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path == "", path).otherwise(F.concat(lead, F.array_join(walked, "/")))


def report_slug(path: Column, shorten: bool = False) -> Column:
    """File name of a folder's report: every '/' becomes '+', plus '.csv'.

    A name that is too long for a file keeps its start and its end, and the digest of the whole path
    between them keeps different folders apart.
    """
    slug = F.concat(F.translate(path, "/", "+"), F.lit(".csv"))
    if not shorten:
        return slug
    short = F.concat(F.left(slug, F.lit(25)), F.lit(".."), F.md5(path), F.lit(".."), F.right(slug, F.lit(190)))
    return F.when(F.length(slug) > 255, short).otherwise(slug)


_DESTINATION = r"^(?::s3:)?([^/]*)/(.*)$"


def destination_bucket(uri: Column) -> Column:
    return F.regexp_extract(uri, _DESTINATION, 1)


def destination_prefix(uri: Column) -> Column:
    return F.regexp_extract(uri, _DESTINATION, 2)


def build_destination(bucket: Column, archive_dir: Column, folder: Column) -> Column:
    """':s3:bucket/dir/folder' with the folder's leading '/' removed."""
    return F.concat(F.lit(":s3:"), F.concat_ws("/", bucket, archive_dir, F.ltrim(folder, F.lit("/"))))


def rebase(path: Column, old_root: Column, new_root: Column) -> Column:
    """Replace the leading ``old_root`` of ``path``; only the first occurrence is touched."""
    rest = F.substring(path, F.length(old_root) + 1, F.length(path))
    return F.concat(new_root, rest)
