"""Explicit schemas of every table that is read from files."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _i = T.StringType(), T.LongType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CRAWL = _struct(
    ("filename", _s), ("UID", _l), ("GID", _l), ("st_atime", _l), ("st_mtime", _l),
    ("pw_fcount", _l), ("pw_dirsum", _l), ("st_size", _l), ("st_mode", _i),
    ("type", _s), ("root", _s),
)

HOTSPOTS = _struct(
    ("User", _s), ("AccD", _l), ("ModD", _l), ("GiB", _l), ("MiBAvg", _l),
    ("Folder", _s), ("Group", _s), ("TiB", _l), ("FileCount", _l), ("DirSize", _l),
)

MANIFEST = _struct(
    ("File", _s), ("Size(bytes)", _l), ("Date-Modified", _s), ("Date-Accessed", _s),
    ("Owner", _s), ("Group", _s), ("Permissions", _s), ("Tarred", _s),
)

ARCHIVE_RECORD = _struct(
    ("local_folder", _s), ("archive_folder", _s), ("s3_storage_class", _s), ("profile", _s),
    ("provider", _s), ("endpoint", _s), ("archive_mode", _s), ("timestamp", _s),
    ("timestamp_archive", _s), ("user", _s), ("nih_project", _s),
)

TRANSFER_LINE = _struct(
    ("source", _s), ("level", _s), ("msg", _s),
    ("stats", _struct(("bytes", _l), ("errors", _l), ("lastError", _s))),
)

GRANT = _struct(
    ("core_project_num", _s), ("project_start_date", _s), ("project_end_date", _s),
    ("contact_pi_name", _s), ("project_title", _s),
    ("organization", _struct(("org_name", _s))), ("project_detail_url", _s),
    ("principal_investigators", T.ArrayType(
        _struct(("profile_id", _l), ("is_contact_pi", T.BooleanType())))),
)
