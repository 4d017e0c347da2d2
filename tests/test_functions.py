from __future__ import annotations

import pathlib
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coldledger.constants import META
from coldledger.functions import paths, units
from coldledger.functions.objects import restore_class
from coldledger.functions.text import clean_search, has_all_words, is_number, search_words
from coldledger.operators.capacity import best_fit_capacity


def apply(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] if len(exprs) == 1 else tuple(r) for r in df.orderBy("i").select(*exprs).collect()]


def test_human_size(spark):
    sizes = [0, 1, 1023, 1024, 1088, 1048575, 1048576, 3 * 2**39, 2**60, None]
    assert apply(spark, sizes, "bigint", units.human_size(F.col("x"))) == [
        "0B", "1.0 B", "1023.0 B", "1.0 KiB", "1.062 KiB", "1023.999 KiB", "1.0 MiB", "1.5 TiB", "1.0 EiB", None]


def test_days_ago_counts_whole_days(spark):
    now = datetime(2024, 1, 31)
    times = [None, datetime(1970, 1, 1), now - timedelta(hours=23, minutes=59), now - timedelta(hours=24),
             now + timedelta(hours=1)]
    assert apply(spark, times, "timestamp_ntz", units.days_ago(F.col("x"), "2024-01-31 00:00:00")) == [0, 0, 0, 1, -1]
    assert apply(spark, [0, None, 1706572800], "bigint", units.epoch_days_ago(F.col("x"), "2024-01-31")) == [0, 0, 1]


def test_octal_mode(spark):
    modes = [33188, 33261, 16877, 41471]
    assert apply(spark, modes, "int", units.octal_mode(F.col("x"))) == [oct(m) for m in modes]


PATHS = ["/a/b/c", "/a", "/", "/a/b/", "//a//b", "/a/./b/../c", "/../a", "x/y", ""]


def test_clean_path(spark):
    import posixpath

    want = [p if p == "" else posixpath.normpath(p).replace("//", "/") for p in PATHS]
    assert apply(spark, PATHS, "string", paths.clean_path(F.col("x"))) == want


def test_ancestors_match_pathlib(spark):
    plain = ["/a/b/c", "/a", "/", "/x y/é/z"]
    got = apply(spark, plain, "string", paths.ancestors(F.col("x")))
    for p, chain in zip(plain, got):
        assert chain == [*[str(q) for q in reversed(pathlib.PurePosixPath(p).parents)], p][-len(chain):]
        assert chain[-1] == p and chain[0] == "/"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ab.é ", min_size=1, max_size=4), min_size=1, max_size=5))
def test_parent_and_basename_rebuild_the_path(spark, parts):
    path = "/" + "/".join(parts)
    x = F.col("x")
    base, parent, depth = apply(spark, [path], "string", paths.basename(x), paths.parent(x), paths.depth(x))[0]
    assert depth == path.count("/") and base == parts[-1]
    assert (parent if parent != "/" else "") + "/" + base == path


def test_slug_is_shortened_only_when_long(spark):
    x = F.col("x")
    short, long = "/a/b", "/" + "d/" * 200
    assert apply(spark, [short], "string", paths.report_slug(x, True)) == ["+a+b.csv"]
    slug = long.replace("/", "+") + ".csv"
    names = apply(spark, [long, "/d" * 60 + "/e" + "/d" * 140], "string", paths.report_slug(x, True))
    assert all(len(n) <= 255 and n.startswith(slug[:25]) and n.endswith(".csv") for n in names) and len(set(names)) == 2
    assert apply(spark, [long], "string", paths.report_slug(x)) == [slug]


def test_destinations(spark):
    x = F.col("x")
    uri = [":s3:bkt/arch/a/b", "bkt/x"]
    assert apply(spark, uri, "string", paths.destination_bucket(x), paths.destination_prefix(x)) == [
        ("bkt", "arch/a/b"), ("bkt", "x")]
    assert apply(spark, ["/a/b"], "string", paths.build_destination(F.lit("k"), F.lit("d"), x)) == [":s3:k/d/a/b"]
    # Only the leading part is replaced, not later copies of it.
    assert apply(spark, ["/a/x/a/x"], "string", paths.rebase(x, F.lit("/a"), F.lit("D"))) == ["D/x/a/x"]


def test_is_number_follows_float_notation(spark):
    words = ["1", "-1.5e3", ".5", "5.", "1_000", "nan", "inf", "Infinity", " 7 ", "1d", "1f", "abc", "", "1_", "0x1"]

    def parses(w):
        try:
            float(w)
            return True
        except ValueError:
            return False
    assert apply(spark, words, "string", is_number(F.col("x"))) == [parses(w) for w in words]


def test_search_text(spark):
    x = F.col("x")
    assert apply(spark, ["a,b:c[d]\"e\\f"], "string", clean_search(x)) == ["a b c d  e f"]
    john = search_words("john,  SMITH")
    assert john == ["john", "smith"] and search_words(" ?") == []
    assert apply(spark, ["Smith, John", "Smithson", None], "string", has_all_words(x, john)) == [True, False, False]
    assert apply(spark, ["x"], "string", has_all_words(x, [])) == [False]


@pytest.mark.parametrize("row, want", [
    ((None, None, "k", "Bulk"), "ignored"),
    (("GLACIER", 'ongoing-request="true"', "k", "Bulk"), "restoring"),
    (("STANDARD_IA", 'ongoing-request="false", expiry-date="x"', "k", "Bulk"), "restored"),
    (("STANDARD_IA", None, "k", "Bulk"), "not_glacier"),
    (("STANDARD_IA", None, "p/" + META.manifest, "Bulk"), "ignored"),
    (("DEEP_ARCHIVE", None, "k", "Expedited"), "unsupported"),
    (("DEEP_ARCHIVE", None, "k", "Bulk"), "triggered"),
    (("GLACIER", None, "k", "Expedited"), "triggered"),
])
def test_restore_class(spark, row, want):
    cls, restore, key, option = row
    lit = lambda v: F.lit(v).cast("string")
    assert spark.range(1).select(restore_class(lit(cls), lit(restore), lit(key), option)).first()[0] == want


def test_capacity(spark):
    needs = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.1, 45.0, 50000.0)], "need double")
    got = {r.need: r.machine for r in best_fit_capacity(needs).collect()}
    assert got == {0.5: "t3a.micro", 1.0: "t3a.micro", 1.1: "c5ad.large", 45.0: "i3en.large", 50000.0: None}
