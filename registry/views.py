"""Inventory tables expressed over the given star schema (see FIXTURES.md, section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldledger.constants import META
from coldledger.sinks.listing import store_listing
from coldledger.skew import ordered_running_sum

AS_OF = "2002-01-01 00:00:00"


# Schemas of the given tables; stated, so that no job has to look into the files first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf.rstrip('/')}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """The largest table; the scan decides how it is split."""
    return table(spark, sf, "lineitem")


def supplier_places(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their nation and region: the three levels of the folder tree."""
    return (table(spark, sf, "supplier")
            .join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
            .join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey")))


FILE_COLUMNS = (
    "CASE l_returnflag WHEN 'R' THEN concat('/', r_name) "
    "WHEN 'N' THEN concat('/', r_name, '/', n_name) "
    "ELSE concat('/', r_name, '/', n_name, '/', s_name) END AS folder",
    "concat(concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(round(l_extendedprice * 100) AS BIGINT)), '.dat') AS name",
    "CAST(round(l_extendedprice * 1000) AS BIGINT) AS size",
    "l_shipdate AS mtime",
    "greatest(l_shipdate, o_orderdate) AS atime",
    "l_partkey AS uid",
    "l_suppkey % 30 AS gid",
    "CASE l_linenumber % 4 WHEN 0 THEN 33188 WHEN 1 THEN 33206 WHEN 2 THEN 33152 ELSE 33056 END AS mode",
    "CASE WHEN l_quantity = 1 THEN 'l' ELSE 'f' END AS type",
    "l_quantity AS qty", "s_acctbal AS bal", "l_returnflag AS flag")


def joined_files(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    # Joined one table at a time. Files and orders grow alike, so theirs is the same shuffled join at every size, and
    # hashing the few columns of an order spares sorting the files; for the others their own size decides.
    return (rows.join(orders.hint("shuffle_hash"), F.expr("l_orderkey = o_orderkey"))
            .join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
            .join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
            .join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr(*FILE_COLUMNS))


def all_files(spark: SparkSession, sf: str) -> DataFrame:
    return joined_files(lineitem(spark, sf), spark, sf)


def files(spark: SparkSession, sf: str) -> DataFrame:
    return all_files(spark, sf).drop("qty", "bal", "flag")


def supplier_folders(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_places(spark, sf).selectExpr(
        "concat('/', r_name, '/', n_name, '/', s_name) AS folder", "s_acctbal AS bal", "s_suppkey")


def folders(spark: SparkSession, sf: str, least: float | None = None) -> DataFrame:
    """Every folder of the tree, or without those of suppliers poorer than ``least``."""
    places = supplier_places(spark, sf)
    leaves = supplier_folders(spark, sf)
    return ((leaves if least is None else leaves.where(F.col("bal") >= least)).select("folder")
            .unionByName(places.selectExpr("concat('/', r_name, '/', n_name) AS folder").distinct())
            .unionByName(places.selectExpr("concat('/', r_name) AS folder").distinct()))


def local_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files still on disk: archives of rich suppliers were deleted, metadata was left behind."""
    on_disk = all_files(spark, sf).where("NOT (flag = 'A' AND bal > 8000)").drop("qty", "bal", "flag")
    left = supplier_folders(spark, sf).where("bal >= 1000").select(
        "folder", F.explode(F.expr(
            f"CASE WHEN bal > 8000 THEN array('{META.md5}', '{META.manifest}', '{META.moved_note}') "
            f"ELSE array('{META.md5}') END")).alias("name"))
    meta = left.selectExpr(
        "folder", "name", "1000L AS size", "timestamp_ntz'2001-12-31 00:00:00' AS mtime",
        "timestamp_ntz'2001-12-31 00:00:00' AS atime", "0L AS uid", "0L AS gid", "33188 AS mode", "'f' AS type")
    return on_disk.unionByName(meta)


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    found = files(spark, sf)
    file_rows = found.selectExpr(
        "concat(folder, '/', name) AS filename", "uid AS UID", "gid AS GID",
        "unix_seconds(CAST(atime AS TIMESTAMP)) AS st_atime", "unix_seconds(CAST(mtime AS TIMESTAMP)) AS st_mtime",
        "-1L AS pw_fcount", "0L AS pw_dirsum", "size AS st_size", "mode AS st_mode", "type",
        "concat('/', split_part(folder, '/', 2)) AS root")
    folder_rows = found.groupBy("folder").agg(
        F.min("uid").alias("uid"), F.min("gid").alias("gid"), F.min("atime").alias("atime"),
        F.min("mtime").alias("mtime"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"),
    ).selectExpr(
        "folder AS filename", "uid AS UID", "gid AS GID",
        "unix_seconds(CAST(atime AS TIMESTAMP)) AS st_atime", "unix_seconds(CAST(mtime AS TIMESTAMP)) AS st_mtime",
        "n AS pw_fcount", "b AS pw_dirsum", "4096L AS st_size",
        "CASE n % 3 WHEN 0 THEN 16895 WHEN 1 THEN 16877 ELSE 16832 END AS st_mode", "'d' AS type",
        "concat('/', split_part(folder, '/', 2)) AS root")
    return file_rows.unionByName(folder_rows)


def crawl_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What a crawl wrote to its error output: locked supplier and nation folders among other lines."""
    places = supplier_places(spark, sf)
    locked = places.where("s_suppkey % 7 = 3").selectExpr("concat('/', r_name, '/', n_name, '/', s_name) AS path").unionByName(
        places.where("n_nationkey IN (4, 11)").selectExpr("concat('/', r_name, '/', n_name, '/') AS path"))
    return locked.selectExpr("'crawl' AS source", "xxhash64(path) AS pos", "concat('Locked Dir: ', path) AS line").unionByName(
        places.selectExpr("'crawl' AS source", "s_suppkey AS pos", "concat('Permission denied: ', s_name) AS line"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey AS uid", "c_name AS user")


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS gid", "n_name AS group_name")


_TIME = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")"


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    places = supplier_places(spark, sf)
    record = [
        "folder AS folder_key", "folder AS local_folder", "archive_folder",
        "s3_storage_class", "'default' AS profile", "'AWS' AS provider", "'' AS endpoint", "archive_mode",
        "ts AS timestamp", "ts AS timestamp_archive", "user", "CAST(NULL AS STRING) AS nih_project"]
    suppliers = places.where("s_acctbal >= 3000").selectExpr(
        "concat('/', r_name, '/', n_name, '/', s_name) AS folder",
        "concat(':s3:bkt/arch/', r_name, '/', n_name, '/', s_name) AS archive_folder",
        "CASE WHEN s_acctbal < 5000 THEN 'DEEP_ARCHIVE' WHEN s_acctbal < 7500 THEN 'GLACIER' "
        "ELSE 'STANDARD_IA' END AS s3_storage_class", "'Single' AS archive_mode",
        _TIME.format("timestampadd(MINUTE, s_suppkey * 37, timestamp'2000-01-01 00:00:00')") + " AS ts",
        "concat('user', s_nationkey) AS user")
    by_region = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    nations = by_region.where("r_name IN ('AFRICA', 'ASIA')").selectExpr(
        "concat('/', r_name, '/', n_name) AS folder",
        "CASE r_name WHEN 'AFRICA' THEN 'DEEP_ARCHIVE' ELSE 'INTELLIGENT_TIERING' END AS s3_storage_class",
        "CASE r_name WHEN 'ASIA' THEN concat(':s3:cold/vault/', n_name) ELSE concat(':s3:bkt/arch/', r_name, '/', n_name) "
        "END AS archive_folder", "'Recursive' AS archive_mode",
        _TIME.format("timestampadd(HOUR, n_nationkey, timestamp'2021-01-01 00:00:00')") + " AS ts",
        "'admin' AS user")
    regions = table(spark, sf, "region").where("r_name IN ('AFRICA', 'AMERICA', 'EUROPE')").selectExpr(
        "concat('/', r_name) AS folder", "concat(':s3:bkt/arch/', r_name) AS archive_folder",
        "CASE r_name WHEN 'AMERICA' THEN 'GLACIER' ELSE 'GLACIER_IR' END AS s3_storage_class",
        "CASE r_name WHEN 'EUROPE' THEN 'Single' ELSE 'Recursive' END AS archive_mode",
        _TIME.format("timestampadd(DAY, r_regionkey, timestamp'2022-01-01 00:00:00')") + " AS ts",
        "'admin' AS user")
    return suppliers.unionByName(nations).unionByName(regions).selectExpr(*record)


_SHAKY = "bal >= 1000 AND bal < 4000"


def src_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Checksums taken before archiving; poor suppliers have none and some files came later."""
    hashed = all_files(spark, sf).where(
        f"NOT (flag = 'A' AND bal < 1000) AND NOT ({_SHAKY} AND qty = 50)")
    rows = hashed.selectExpr("folder", "name", "md5(concat(folder, '/', name, ':', size)) AS md5")
    lists = folders(spark, sf, 1000).selectExpr("folder", f"'{META.manifest}' AS name", "md5(folder) AS md5")
    return rows.unionByName(lists)


# Where the objects of a folder lie: most under bkt/arch, those of ASIA's nations in another bucket under
# another root, and some rich suppliers' where no catalogue entry looks for them.
_OWN = "(bal IS NOT NULL AND bal >= 3000)"
BUCKET = (f"CASE WHEN {_OWN} AND supplier % 10 = 3 THEN 'elsewhere' "
          f"WHEN startswith(folder, '/ASIA/') AND NOT {_OWN} THEN 'cold' ELSE 'bkt' END")
KEY_PREFIX = (f"CASE WHEN startswith(folder, '/ASIA/') AND NOT {_OWN} THEN concat('vault', substr(folder, 6)) "
              "ELSE concat('arch', folder) END")


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Archived objects; uploads of shaky suppliers are partly missing or altered."""
    stored = all_files(spark, sf).where(
        f"NOT (flag = 'A' AND bal < 0) AND NOT ({_SHAKY} AND qty = 49)")
    rows = stored.selectExpr(
        "folder", "name", "size",
        "CASE WHEN qty = 2 THEN NULL WHEN qty IN (3, 4) THEN 'STANDARD_IA' "
        "WHEN qty < 25 THEN 'GLACIER' ELSE 'DEEP_ARCHIVE' END AS storage_class",
        "CASE WHEN bal >= 9000 THEN 'ongoing-request=\"false\", expiry-date=\"x\"' "
        "WHEN bal >= 8000 THEN 'ongoing-request=\"true\"' END AS restore",
        f"md5(concat(folder, '/', name, ':', size, CASE WHEN {_SHAKY} AND qty = 13 THEN '!' ELSE '' END)) AS md5",
        "CASE WHEN flag = 'A' THEN bal END AS bal", "gid AS supplier")
    leaves = supplier_folders(spark, sf).where("bal >= 0").selectExpr("folder", "bal", "s_suppkey AS supplier")
    upper = folders(spark, sf, float("inf")).selectExpr("folder", "CAST(NULL AS DOUBLE) AS bal", "0L AS supplier")
    lists = leaves.unionByName(upper).selectExpr(
        "folder", f"'{META.manifest}' AS name", "100L * length(folder) AS size", "'INTELLIGENT_TIERING' AS storage_class",
        "CAST(NULL AS STRING) AS restore", "md5(folder) AS md5", "bal", "supplier")
    return rows.unionByName(lists).selectExpr(
        f"{BUCKET} AS bucket", f"concat({KEY_PREFIX}, '/', name) AS key", "size", "storage_class", "restore", "md5")


_stored: dict[tuple[str, str], str] = {}


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """The objects as a stored listing, written by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _stored:
        _stored[key] = f"listing_{len(_stored)}"
        store_listing(objects(spark, sf), _stored[key])
    return spark.table(_stored[key])


def content_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "concat('/', lang, '/', source) AS folder", "concat(doc_id, '.txt') AS name",
        "CAST(octet_length(text) AS BIGINT) AS size", "text AS content")


URL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)"


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr("page_id", f"{URL_PATH} AS path")


def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return heartbeats_of(table(spark, sf, "events"))


def heartbeats_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id AS host", "ts", "event_id AS seq", "CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS idle")


def samples_of(events: DataFrame) -> DataFrame:
    """Byte deltas per host."""
    return events.selectExpr(
        "user_id AS host", "ts", "event_id AS seq", "CAST(round(value * 1000000) AS BIGINT) AS write_bytes",
        "CAST(round(value * 1000) AS BIGINT) AS sent_bytes", "CAST(round(value * 2000) AS BIGINT) AS recv_bytes")


def io_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Running byte counters per host."""
    deltas = samples_of(table(spark, sf, "events")).selectExpr(
        "host", "ts", "seq", "write_bytes AS w", "sent_bytes AS s", "recv_bytes AS r")
    return ordered_running_sum(
        deltas, "host", ["ts", "seq"], {"w": "write_bytes", "s": "sent_bytes", "r": "recv_bytes"}).drop("w", "s", "r")


def restore_events_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "CAST(user_id AS STRING) AS folder", "get_json_object(props, '$.k') AS name", "ts", "event_id AS seq",
        "CASE event_type WHEN 'click' THEN 'triggered' WHEN 'view' THEN 'restoring' "
        "WHEN 'purchase' THEN 'restored' WHEN 'signup' THEN 'not_glacier' ELSE 'ignored' END AS state")


def cost_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderdate AS day", "o_custkey AS owner", "o_orderpriority AS instance_type", "o_totalprice AS amount",
        "concat('service-', o_orderstatus) AS service", "CASE o_orderkey % 4 WHEN 3 THEN 'EUR' ELSE 'USD' END AS unit")


def grant_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Nested grant records as JSON lines."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.selectExpr(
        "doc_id AS seq", "text",
        "to_json(named_struct("
        "'core_project_num', concat(' ', lang, '-', source, '-', n_chars div 200, ' '), "
        "'project_start_date', '2020-01-01T12:00:00Z', 'project_end_date', '2024-12-31T12:00:00Z', "
        "'contact_pi_name', concat(upper(source), ', ', lang), 'project_title', concat('Study ', doc_id), "
        "'organization', named_struct('org_name', CASE WHEN lang <> 'es' THEN concat(lang, ' institute') END), "
        "'project_detail_url', concat('https://example.org/', doc_id), "
        "'principal_investigators', array("
        "named_struct('profile_id', doc_id, 'is_contact_pi', coalesce(quality = 1, false)), "
        "named_struct('profile_id', doc_id + 1000000, 'is_contact_pi', coalesce(toxic = 1, false))))) AS line")


def principals(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "customer")
            .join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
            .join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr("c_custkey AS principal", "c_mktsegment AS account", "array(n_name, r_name) AS groups",
                        "CASE WHEN c_acctbal > 0 THEN array('normal', 'short', 'long') ELSE array('normal') END AS options"))


def policies(spark: SparkSession, sf: str) -> DataFrame:
    """One policy per nation, so that every rule branch occurs."""
    empty = "CAST(array() AS ARRAY<STRING>)"
    return (table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr(
                "n_name AS resource", "CASE WHEN n_nationkey % 9 = 8 THEN 'DOWN' ELSE 'UP' END AS state",
                f"CASE WHEN n_nationkey % 6 = 5 THEN array('NATION_3', 'EUROPE') ELSE {empty} END AS deny_groups",
                f"CASE WHEN n_nationkey % 7 = 3 THEN array('HOUSEHOLD') ELSE {empty} END AS deny_accounts",
                "CASE WHEN n_nationkey % 4 = 0 THEN array('BUILDING', 'MACHINERY') "
                f"WHEN n_nationkey % 12 = 9 THEN array('ALL') ELSE {empty} END AS allow_accounts",
                "CASE WHEN n_nationkey % 4 = 2 THEN array('ALL') WHEN n_nationkey % 4 = 3 THEN array(r_name) "
                "ELSE array(n_name) END AS allow_groups",
                f"CASE WHEN n_nationkey % 3 = 0 THEN array('long') ELSE {empty} END AS deny_options",
                "CASE WHEN n_nationkey % 3 = 1 THEN array('ALL') WHEN n_nationkey % 6 = 2 THEN array('short', 'long') "
                f"ELSE {empty} END AS allow_options"))


def transfer_lines_of(events: DataFrame) -> DataFrame:
    """Lines of transfer logs: statistics, operations, plain text and cut-off JSON."""
    return events.selectExpr(
        "user_id AS log", "event_id AS pos",
        "CASE event_type "
        "WHEN 'click' THEN to_json(named_struct('level', 'info', 'msg', 'progress', 'source', "
        "'accounting/stats.go:482', 'stats', named_struct('bytes', event_id * 10, 'errors', 0))) "
        "WHEN 'error' THEN to_json(named_struct('level', 'error', 'msg', 'progress', 'source', "
        "'accounting/stats.go:482', 'stats', named_struct('bytes', event_id * 10, 'errors', 1, "
        "'lastError', concat('failed ', props)))) "
        "WHEN 'view' THEN to_json(named_struct('level', 'info', 'msg', concat('Copied ', event_id), 'source', "
        "'operations/operations.go:2740')) "
        "WHEN 'purchase' THEN concat('NOTICE ', event_id) "
        "ELSE '{\"source\": \"accounting/st' END AS line")
