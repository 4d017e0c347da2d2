"""Manifests, batches, deletion notes, costs and log summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldledger.functions.units import octal_mode, time_text
from coldledger.operators.bundle import classify_small, even_part
from coldledger.operators.inventory import non_meta
from coldledger.operators.ownership import resolve_owner
from coldledger.constants import META

BATCH_FOLDERS = 500


def file_manifest(files: DataFrame, users: DataFrame, groups: DataFrame, kib: int | None = None,
                  tar: bool = True) -> DataFrame:
    """One row per direct file of each folder, with names, times and mode as text."""
    named = resolve_owner(non_meta(files, (META.manifest,)), users, groups)
    return classify_small(named, kib, tar).select(
        "folder", F.col("name").alias("File"), F.col("size").alias("Size(bytes)"),
        time_text(F.col("mtime")).alias("Date-Modified"), time_text(F.col("atime")).alias("Date-Accessed"),
        F.col("owner").alias("Owner"), F.col("group_name").alias("Group"),
        octal_mode(F.col("mode")).alias("Permissions"), F.col("tarred").alias("Tarred"))


def archive_batch(selection: DataFrame, command: str, per_batch: int = BATCH_FOLDERS) -> DataFrame:
    """Commands over all selected folders, about ``per_batch`` each, with their space.

    A command line has a bounded length, so a large selection becomes several commands and
    no task gathers all of it. One more row without a batch number has the grand total.
    """
    n = selection.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(per_batch)), F.lit(1)).cast("long").alias("n"))
    quoted = F.concat(F.lit('"'), F.col("folder"), F.lit('"'))
    batches = (selection.withColumn("batch", even_part(F.col("folder"), n.scalar()))
               .groupBy("batch").agg(
                   F.count(F.lit(1)).alias("folders"), F.sum("dirsum").alias("bytes"), F.sum("gib").alias("gib"),
                   F.concat_ws(" ", F.lit(command), F.array_sort(F.collect_list(quoted))).alias("command")))
    total = selection.agg(
        F.lit(None).cast("long").alias("batch"), F.count(F.lit(1)).alias("folders"),
        F.coalesce(F.sum("dirsum"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("gib"), F.lit(0)).alias("gib"),
        F.lit("total").alias("command"))
    return batches.unionByName(total)


def first_names(files: DataFrame, n: int = 10) -> DataFrame:
    """The first n names per folder, in name order, as one text.

    The rank limit is applied before the shuffle as well, so a huge folder sends n rows per task.
    """
    rank = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    return (files.select("folder", "name").withColumn("_rank", rank).where(F.col("_rank") <= n)
            .groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("first_files")))


def deletion_report(plan: DataFrame, files: DataFrame, command: str, n: int = 10) -> DataFrame:
    """What is left behind in each folder that a delete plan clears: one row of facts per folder.

    The names are reduced to ``n`` per folder before they meet the plan; ``more_files`` says how many
    others there are. ``note_text`` turns a row into the note.
    """
    cleared = plan.where(F.col("decision") == "delete")
    restore = F.concat(F.lit(f'{command} "'), F.col("folder"), F.lit('"'))
    return (cleared.join(first_names(non_meta(files), n), "folder", "left").select(
        "folder", "destination", "s3_storage_class", F.col("user").alias("archived_by"), restore.alias("restore"),
        "files", "bytes", F.coalesce("first_files", F.lit("")).alias("first_files"),
        F.greatest(F.col("files") - n, F.lit(0)).cast("long").alias("more_files")))


def note_text(columns: Sequence[str]) -> Column:
    """A note as lines 'name: value' of the given columns."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c.replace('_', ' ')}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")))
                               for c in columns])


def cost_report(lines: DataFrame, as_of: date, root: str = "root", service: str | None = None) -> DataFrame:
    """Month-to-date and last-day cost: whole account, per owner, machine type and service.

    Amounts of different units are never added: the unit is part of every sum. Periods are half open and
    end before ``as_of``. The root owner stands for the account. ``lines`` has day, owner, instance_type,
    service, unit, amount; ``service`` keeps the lines of one service only.
    """
    from datetime import timedelta

    month, yesterday = as_of.replace(day=1), as_of - timedelta(days=1)
    lit = lambda d: F.lit(d.isoformat()).cast("date")
    day, amount = F.col("day").cast("date"), F.col("amount").cast("decimal(18,4)")
    wanted = lines.where((day >= lit(min(month, yesterday))) & (day < lit(as_of)))
    if service is not None:
        wanted = wanted.where(F.col("service") == service)
    scopes = ("owner", "instance_type", "service")
    measured = wanted.select(
        "unit", *[F.col(c).cast("string").alias(c) for c in scopes],
        F.when(day >= lit(month), amount).alias("_month"), F.when(day >= lit(yesterday), amount).alias("_day"))
    unit = F.col("unit")
    sums = measured.groupingSets(
        [[unit], *[[unit, F.col(c)] for c in scopes]], unit, *[F.col(c) for c in scopes]).agg(
        *[F.grouping(c).alias(f"_no_{c}") for c in scopes],
        F.sum("_month").alias("_m"), F.sum("_day").alias("_d"))
    scope, name = F.lit("account"), F.lit(root)
    for c in scopes:
        scope = F.when(F.col(f"_no_{c}") == 0, F.lit(c)).otherwise(scope)
        name = F.when(F.col(f"_no_{c}") == 0, F.col(c)).otherwise(name)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return sums.select(scope.alias("scope"), name.alias("name"), "unit",
                       zero("_m").alias("month_to_date"), zero("_d").alias("last_day"))


def transfer_errors(log: DataFrame, by: str = "log", order: str = "pos") -> DataFrame:
    """First error per transfer log and the number of its statistics lines."""
    error = F.col("stats.lastError")
    stats = log.where(F.col("kind") == "stats")
    first = F.min_by(error, F.when(error.isNotNull(), F.col(order)))
    return stats.groupBy(by).agg(
        F.count(F.lit(1)).alias("stats_lines"), F.max("stats.bytes").alias("bytes"),
        F.when(F.count(error) > 0, first).alias("first_error"))
