"""SQL that yields the same rows as the registered queries, from the given tables."""

from __future__ import annotations

from coldledger.constants import META, SEARCH_PUNCTUATION

_DAY = "CAST(floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us({ts})) / 86400000000) AS BIGINT)"


def _days(ts: str, as_of: str = "2002-01-01 00:00:00") -> str:
    return _DAY.format(ts=ts, as_of=as_of)


_SHAKY = "bal >= 1000 AND bal < 4000"

# Common table expressions by name; each lists the ones it needs.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "places": ((), """
        SELECT s_suppkey, s_name, s_acctbal, s_nationkey, n_name, r_name, r_regionkey,
               '/' || r_name AS lvl1, '/' || r_name || '/' || n_name AS lvl2,
               '/' || r_name || '/' || n_name || '/' || s_name AS lvl3
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "all_files": (("places",), """
        SELECT CASE l_returnflag WHEN 'R' THEN lvl1 WHEN 'N' THEN lvl2 ELSE lvl3 END AS folder,
               l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' ||
                 CAST(round(l_extendedprice * 100) AS BIGINT) || '.dat' AS name,
               CAST(round(l_extendedprice * 1000) AS BIGINT) AS size,
               l_shipdate AS mtime, greatest(l_shipdate, o_orderdate) AS atime,
               l_partkey AS uid, l_suppkey % 30 AS gid,
               CASE l_linenumber % 4 WHEN 0 THEN 33188 WHEN 1 THEN 33206 WHEN 2 THEN 33152 ELSE 33056 END AS mode,
               CASE WHEN l_quantity = 1 THEN 'l' ELSE 'f' END AS type,
               l_quantity AS qty, s_acctbal AS bal, l_returnflag AS flag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN places ON l_suppkey = s_suppkey"""),
    "folders": (("places",), """
        SELECT lvl3 AS folder FROM places UNION SELECT lvl2 FROM places UNION SELECT lvl1 FROM places"""),
    "rollup": (("all_files",), """
        SELECT folder, count(*) AS fcount, CAST(sum(size) AS BIGINT) AS dirsum, max(atime) AS atime,
               max(mtime) AS mtime, min(uid) AS uid, min(gid) AS gid, min(atime) AS first_atime, min(mtime) AS first_mtime
        FROM all_files GROUP BY folder"""),
    "units": (("rollup",), """
        SELECT *, dirsum / 1073741824 AS gibf, dirsum / 1099511627776 AS tibf, dirsum / 1048576 / fcount AS mibf
        FROM rollup"""),
    "hot": (("units",), f"""
        SELECT folder, fcount, dirsum, CAST(trunc(gibf) AS BIGINT) AS gib, CAST(trunc(tibf) AS BIGINT) AS tib,
               CAST(trunc(mibf) AS BIGINT) AS mib_avg, {_days('atime')} AS accd, {_days('mtime')} AS modd
        FROM units WHERE gibf >= 1 AND mibf >= 10"""),
    "aged": (("units",), f"""
        SELECT CAST(days AS INTEGER) AS days,
               CAST(coalesce(sum(dirsum) FILTER (accd > days), 0) AS BIGINT) AS bytes
        FROM (SELECT dirsum, {_days('atime', '2011-10-26 00:00:00')} AS accd FROM units
              WHERE gibf >= 1 AND mibf >= 10),
             (SELECT unnest([5475, 3650, 1825, 1095, 730, 365, 90, 30]) AS days)
        GROUP BY days"""),
    "local_files": (("all_files", "places"), f"""
        SELECT folder, name, size, mtime, atime, uid, gid, mode, type FROM all_files
        WHERE NOT (flag = 'A' AND bal > 8000)
        UNION ALL
        SELECT lvl3, m.name, 1000, TIMESTAMP '2001-12-31', TIMESTAMP '2001-12-31', 0, 0, 33188, 'f'
        FROM places JOIN (VALUES ('{META.md5}', 1000), ('{META.manifest}', 8001), ('{META.moved_note}', 8001)) m(name, k)
          ON (k = 1000 AND s_acctbal >= 1000) OR (k = 8001 AND s_acctbal > 8000)"""),
    "own_files": (("local_files",), f"""
        SELECT * FROM local_files
        WHERE name NOT IN ('{META.manifest}', '{META.md5}', '{META.md5_restored}', '{META.moved_note}')"""),
    "catalogue": (("places",), """
        SELECT lvl3 AS folder_key, CASE WHEN s_acctbal < 5000 THEN 'DEEP_ARCHIVE' WHEN s_acctbal < 7500 THEN 'GLACIER'
                 ELSE 'STANDARD_IA' END AS s3_storage_class, 'Single' AS archive_mode,
               strftime(TIMESTAMP '2000-01-01' + to_minutes(CAST(s_suppkey * 37 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS timestamp,
               'user' || s_nationkey AS user, ':s3:bkt/arch' || lvl3 AS archive_folder
        FROM places WHERE s_acctbal >= 3000
        UNION ALL
        SELECT '/' || r_name || '/' || n_name, CASE r_name WHEN 'AFRICA' THEN 'DEEP_ARCHIVE' ELSE 'INTELLIGENT_TIERING' END,
               'Recursive', strftime(TIMESTAMP '2021-01-01' + to_hours(n_nationkey), '%Y-%m-%dT%H:%M:%S'), 'admin',
               CASE r_name WHEN 'ASIA' THEN ':s3:cold/vault/' || n_name ELSE ':s3:bkt/arch/' || r_name || '/' || n_name END
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')
        UNION ALL
        SELECT '/' || r_name, CASE r_name WHEN 'AMERICA' THEN 'GLACIER' ELSE 'GLACIER_IR' END,
               CASE r_name WHEN 'EUROPE' THEN 'Single' ELSE 'Recursive' END,
               strftime(TIMESTAMP '2022-01-01' + to_days(r_regionkey), '%Y-%m-%dT%H:%M:%S'), 'admin', ':s3:bkt/arch/' || r_name
        FROM region WHERE r_name IN ('AFRICA', 'AMERICA', 'EUROPE')"""),
    "looked_up": (("folders", "catalogue"), """
        SELECT f.folder, m.folder_key AS matched_folder,
               CASE WHEN m.folder_key IS NULL THEN 'none' WHEN m.folder_key = f.folder THEN 'exact' ELSE 'ancestor' END AS match,
               m.archive_mode, m.s3_storage_class, m.archive_folder, m.user,
               m.archive_folder || substr(f.folder, length(m.folder_key) + 1) AS dest
        FROM folders f LEFT JOIN (
          SELECT folder, c.*, row_number() OVER (PARTITION BY folder ORDER BY length(folder_key) DESC) AS rn
          FROM folders JOIN catalogue c
            ON folder = folder_key OR (archive_mode = 'Recursive' AND starts_with(folder, folder_key || '/'))) m
        ON f.folder = m.folder AND rn = 1"""),
    "src": (("all_files", "folders"), f"""
        SELECT folder, name, md5(folder || '/' || name || ':' || size) AS md5 FROM all_files
        WHERE NOT (flag = 'A' AND bal < 1000) AND NOT ({_SHAKY} AND qty = 50)
        UNION ALL
        SELECT folder, '{META.manifest}', md5(folder) FROM folders
        WHERE folder NOT IN (SELECT lvl3 FROM places WHERE s_acctbal < 1000)"""),
    "stored": (("all_files", "folders"), f"""
        SELECT folder, name, size,
               CASE WHEN qty = 2 THEN NULL WHEN qty IN (3, 4) THEN 'STANDARD_IA' WHEN qty < 25 THEN 'GLACIER'
                    ELSE 'DEEP_ARCHIVE' END AS storage_class,
               CASE WHEN bal >= 9000 THEN 'false' WHEN bal >= 8000 THEN 'true' END AS ongoing,
               md5(folder || '/' || name || ':' || size || CASE WHEN {_SHAKY} AND qty = 13 THEN '!' ELSE '' END) AS md5,
               flag = 'A' AND bal >= 3000 AS rich, gid AS supplier
        FROM all_files WHERE NOT (flag = 'A' AND bal < 0) AND NOT ({_SHAKY} AND qty = 49)
        UNION ALL
        SELECT folder, '{META.manifest}', length(folder) * 100, 'INTELLIGENT_TIERING', NULL, md5(folder),
               coalesce(s_acctbal >= 3000, false), s_suppkey
        FROM folders LEFT JOIN places ON folder = lvl3 WHERE coalesce(s_acctbal >= 0, true)"""),
    "objects": (("stored",), """
        SELECT *, ':s3:' || bucket || '/' || dir AS location, dir || '/' || name AS key
        FROM (SELECT *, CASE WHEN rich AND supplier % 10 = 3 THEN 'elsewhere'
                          WHEN starts_with(folder, '/ASIA/') AND NOT rich THEN 'cold' ELSE 'bkt' END AS bucket,
                     CASE WHEN starts_with(folder, '/ASIA/') AND NOT rich THEN 'vault' || substr(folder, 6)
                       ELSE 'arch' || folder END AS dir FROM stored)"""),
    "found": (("objects", "looked_up"), """
        SELECT l.folder, o.name, o.md5 FROM objects o JOIN looked_up l ON o.location = l.dest"""),
    "verified": (("src", "found"), """
        SELECT folder, name, CASE WHEN o.md5 IS NULL THEN 'missing_on_dst' WHEN s.md5 IS NULL THEN 'missing_on_src'
                 WHEN s.md5 = o.md5 THEN 'match' ELSE 'differ' END AS status
        FROM src s FULL JOIN found o USING (folder, name)"""),
    "checked": (("verified",), """
        SELECT folder, count(*) AS checked, count(*) FILTER (status <> 'missing_on_src') AS listed,
               count(*) FILTER (status <> 'match') AS failed, bool_and(status = 'match') AS ok
        FROM verified GROUP BY folder"""),
    "states": (("looked_up", "src", "checked"), """
        SELECT l.folder, match, CASE WHEN l.folder NOT IN (SELECT folder FROM src) THEN 'new'
                 WHEN match = 'none' THEN 'leftover' WHEN coalesce(ok, false) THEN 'archived' ELSE 'mismatch' END AS state
        FROM looked_up l LEFT JOIN checked c ON l.folder = c.folder"""),
    "del_src": (("src", "all_files"), """
        SELECT folder, name, md5 FROM src
        UNION ALL
        SELECT folder, name, md5(folder || '/' || name || ':' || size) FROM all_files
        WHERE flag = 'A' AND bal >= 500 AND bal < 1000 AND folder NOT IN (SELECT folder FROM src)"""),
    "deletions": (("looked_up", "del_src", "found", "local_files", "own_files"), f"""
        SELECT l.*,
               CASE WHEN l.folder IN (SELECT folder FROM local_files WHERE name = '{META.moved_note}') THEN 'already_deleted'
                 WHEN match = 'none' THEN 'not_archived'
                 WHEN l.folder NOT IN (SELECT folder FROM del_src) THEN 'no_manifest'
                 WHEN NOT coalesce(v.ok, false) THEN 'checksum_mismatch' ELSE 'delete' END AS decision,
               CAST(coalesce(n.files, 0) AS BIGINT) AS files, CAST(coalesce(n.bytes, 0) AS BIGINT) AS bytes
        FROM looked_up l
        LEFT JOIN (SELECT folder, bool_and(coalesce(s.md5 = o.md5, false)) AS ok
                   FROM del_src s FULL JOIN found o USING (folder, name) GROUP BY folder) v ON l.folder = v.folder
        LEFT JOIN (SELECT folder, count(*) AS files, sum(size) AS bytes FROM own_files GROUP BY folder) n
          ON l.folder = n.folder"""),
    "dirs": (("objects",), f"""
        SELECT location, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes,
               count(*) FILTER (name = '{META.manifest}') AS kept
        FROM objects GROUP BY location"""),
    "subtrees": (("folders", "dirs"), """
        SELECT p.location, CAST(sum(objects) AS BIGINT) AS objects,
               CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(kept) AS BIGINT) AS kept
        FROM (SELECT ':s3:bkt/arch' || folder AS location FROM folders) p
        JOIN dirs d ON d.location = p.location OR starts_with(d.location, p.location || '/') GROUP BY p.location"""),
    "nearest": (("objects", "catalogue"), f"""
        SELECT archive, count(*) AS o, count(*) FILTER (name = '{META.manifest}') AS k, CAST(sum(size) AS BIGINT) AS b
        FROM (SELECT location, arg_max(archive_folder, length(archive_folder)) AS archive
              FROM (SELECT DISTINCT location FROM objects) JOIN catalogue
                ON location = archive_folder OR (archive_mode = 'Recursive' AND starts_with(location, archive_folder || '/'))
              GROUP BY location) JOIN objects USING (location) GROUP BY archive"""),
    "tier_plan": (("looked_up", "nearest"), """
        SELECT a.*, CASE decision WHEN 'change' THEN coalesce(o, 0) ELSE 0 END AS total,
               CASE decision WHEN 'change' THEN coalesce(o - k, 0) ELSE 0 END AS changed,
               CASE decision WHEN 'change' THEN coalesce(k, 0) ELSE 0 END AS skipped,
               CASE decision WHEN 'change' THEN coalesce(b, 0) ELSE 0 END AS bytes
        FROM (SELECT coalesce(matched_folder, folder) AS archive, archive_folder AS location, s3_storage_class AS old_class,
                     'GLACIER_IR' AS new_class, count(*) AS folders,
                     CASE WHEN archive_folder IS NULL THEN 'not_archived'
                       WHEN s3_storage_class IN ('GLACIER', 'DEEP_ARCHIVE') THEN 'rejected' ELSE 'change' END AS decision
              FROM looked_up GROUP BY ALL) a LEFT JOIN nearest ON a.location = nearest.archive"""),
    "tiers": ((), """
        SELECT * FROM (VALUES ('INTELLIGENT_TIERING', 2.5, 23.0, 0.0), ('STANDARD_IA', 12.5, 12.5, 10.0),
          ('ONEZONE_IA', 10.0, 10.0, 10.0), ('GLACIER_IR', 4.0, 4.0, 10.0), ('GLACIER', 3.6, 3.6, 10.0),
          ('DEEP_ARCHIVE', 1.0, 1.0, 2.5)) t(storage_class, lo, hi, retrieval)"""),
    "grants": ((), """
        SELECT d.doc_id AS seq, d.text, lang || '-' || source || '-' || (n_chars // 200) AS project_num,
               '2020-01-01' AS start, '2024-12-31' AS "end", upper(source) || ', ' || lang AS contact_pi_name,
               'Study ' || d.doc_id AS project_title, CASE WHEN lang <> 'es' THEN lang || ' institute' ELSE '' END AS org_name,
               'https://example.org/' || d.doc_id AS project_detail_url,
               concat_ws(',', CASE WHEN quality = 1 THEN d.doc_id END, CASE WHEN toxic = 1 THEN d.doc_id + 1000000 END)
                 AS pi_profile_ids
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "index_rows": (("units",), f"""
        SELECT coalesce(c_name, CAST(uid AS VARCHAR)) AS "User", {_days('atime')} AS "AccD", {_days('mtime')} AS "ModD",
               CAST(trunc(gibf) AS BIGINT) AS "GiB", CAST(trunc(mibf) AS BIGINT) AS "MiBAvg", folder AS "Folder",
               coalesce(n_name, CAST(gid AS VARCHAR)) AS "Group", CAST(trunc(tibf) AS BIGINT) AS "TiB",
               fcount AS "FileCount", dirsum AS "DirSize"
        FROM units LEFT JOIN customer ON uid = c_custkey LEFT JOIN nation ON gid = n_nationkey
        WHERE gibf >= 1 AND mibf >= 10"""),
    "stats": (("rollup",), """
        SELECT folder, CASE fcount % 3 WHEN 0 THEN 16895 WHEN 1 THEN 16877 ELSE 16832 END AS mode, uid, gid
        FROM rollup WHERE split_part(folder, '/', 2) <> 'ASIA'"""),
    "can_write": (("stats",), """
        SELECT folder FROM stats WHERE (uid = 7 AND mode & 128 <> 0) OR (gid IN (1, 2, 3, 4, 5) AND mode & 16 <> 0)
          OR mode & 438 = 438"""),
    "manifest_rows": (("local_files",), f"""
        SELECT folder, name AS "File", size AS "Size(bytes)", strftime(mtime, '%Y-%m-%d %H:%M:%S') AS "Date-Modified",
               strftime(atime, '%Y-%m-%d %H:%M:%S') AS "Date-Accessed", coalesce(c_name, CAST(uid AS VARCHAR)) AS "Owner",
               coalesce(n_name, CAST(gid AS VARCHAR)) AS "Group",
               CASE mode WHEN 33188 THEN '0o100644' WHEN 33206 THEN '0o100666' WHEN 33152 THEN '0o100600'
                 ELSE '0o100440' END AS "Permissions",
               CASE WHEN size < 1048576 THEN 'Yes' ELSE 'No' END AS "Tarred"
        FROM local_files LEFT JOIN customer ON uid = c_custkey LEFT JOIN nation ON gid = n_nationkey
        WHERE name <> '{META.manifest}'"""),
    "content_files": ((), """
        SELECT '/' || lang || '/' || source AS folder, doc_id || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size,
               text AS content FROM documents"""),
    "page_paths": ((), """
        SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages"""),
    "beats": ((), """
        SELECT user_id AS host, ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS idle FROM events"""),
    "streaks": (("beats",), """
        SELECT host, CAST(count(*) AS BIGINT) AS runs, CAST(sum(CASE WHEN busy_after = 0 THEN 1 ELSE 0 END) AS BIGINT) AS streak
        FROM (SELECT *, sum(1 - idle) OVER (PARTITION BY host ORDER BY ts DESC, seq DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS busy_after FROM beats) GROUP BY host"""),
    "deltas": ((), """
        SELECT user_id AS host, ts, event_id AS seq, CAST(round(value * 1000000) AS BIGINT) AS w,
               CAST(round(value * 1000) AS BIGINT) AS s, CAST(round(value * 2000) AS BIGINT) AS r FROM events"""),
    "tumbling": (("deltas",), """
        SELECT host, time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, CAST(sum(w) AS BIGINT) AS write_bytes,
               CAST(sum(s) AS BIGINT) AS sent_bytes, CAST(sum(r) AS BIGINT) AS recv_bytes,
               sum(w) > 6000000 OR sum(s) > 60000 OR sum(r) > 60000 AS is_busy
        FROM deltas GROUP BY host, window_start"""),
    "progress": ((), """
        SELECT folder, count(*) AS objects, count(*) FILTER (state IN ('click', 'view')) AS open,
               count(*) FILTER (state IN ('click', 'view')) > 0 AS pending
        FROM (SELECT CAST(user_id AS VARCHAR) AS folder, regexp_extract(props, '([0-9]+)', 1) AS name,
                     arg_max(event_type, (ts, event_id)) AS state
              FROM events GROUP BY 1, 2) GROUP BY folder"""),
    "log_lines": ((), """
        SELECT user_id AS log, event_id AS pos, CASE event_type WHEN 'view' THEN 'operations' ELSE 'stats' END AS kind,
               CASE event_type WHEN 'view' THEN 'Copied ' || event_id ELSE 'progress' END AS msg,
               CASE WHEN event_type <> 'view' THEN event_id * 10 END AS bytes,
               CASE event_type WHEN 'error' THEN 'failed ' || props END AS last_error
        FROM events WHERE event_type IN ('click', 'error', 'view')"""),
    "upserted": (("catalogue", "places"), """
        SELECT folder_key, archive_folder, CASE s3_storage_class WHEN 'GLACIER' THEN 'STANDARD_IA' ELSE s3_storage_class END
                 AS s3_storage_class, archive_mode,
               CASE s3_storage_class WHEN 'GLACIER' THEN '2023-01-01T00:00:00' ELSE timestamp END AS timestamp, user
        FROM catalogue
        UNION ALL
        SELECT lvl3, ':s3:bkt/arch' || lvl3, 'DEEP_ARCHIVE', 'Single', '2023-02-01T00:00:00', 'me'
        FROM places WHERE s_acctbal < 3000"""),
    "bundle_parts": (("content_files",), """
        SELECT f.*, CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % parts AS bundle
        FROM content_files f JOIN (SELECT folder, greatest(CAST(ceil(sum(size) / 2048) AS BIGINT), 1) AS parts
          FROM content_files WHERE size < 1024 GROUP BY folder) p ON f.folder = p.folder WHERE size < 1024"""),
}


def _with(names: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the common table expressions it needs, in order of dependency."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{body}"


_HOT = "folder, fcount, dirsum, gib, tib, mib_avg, accd, modd"
_CAT = "folder_key, archive_folder, s3_storage_class, archive_mode, timestamp, user"


def _search(query: str) -> str:
    """Cascade by branch: person, project if no person, organisation if neither, always text."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    cleaned = f"translate({quoted(query)}, {quoted(SEARCH_PUNCTUATION)}, repeat(' ', {len(SEARCH_PUNCTUATION)}))"
    has = lambda c: (
        f"coalesce(list_aggregate(list_transform(words, lambda w: contains(lower({c}), w)), 'bool_and'), false)")
    return _with(("grants",), f"""
        , asked AS (SELECT list_filter(string_split(lower({cleaned}), ' '), lambda w: w <> '') AS words,
                           NOT regexp_full_match(trim({cleaned}), '[0-9.]+') AS worded),
        tested AS (SELECT *, worded AND {has('contact_pi_name')} AS p, lower(project_num) = array_to_string(words, ' ') AS j,
            worded AND {has('org_name')} AS o, {has("(project_title || ' ' || text)")} AS t FROM grants, asked),
        flags AS (SELECT coalesce(bool_or(p), false) AS any_p, coalesce(bool_or(j), false) AS any_j FROM tested),
        found AS (
          SELECT *, 0 AS rk, 'pi' AS found_by FROM tested WHERE p
          UNION ALL SELECT *, 1, 'project' FROM tested WHERE j AND NOT (SELECT any_p FROM flags)
          UNION ALL SELECT *, 2, 'org' FROM tested
            WHERE o AND NOT (SELECT any_p FROM flags) AND NOT (SELECT any_j FROM flags)
          UNION ALL SELECT *, 3, 'text' FROM tested WHERE t)
        SELECT seq, project_num, contact_pi_name, project_title, org_name, found_by FROM (
          SELECT *, row_number() OVER (PARTITION BY project_num ORDER BY rk, seq) AS rn FROM found) WHERE rn = 1""")


def statements() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name: str, ctes: tuple[str, ...] | str, body: str) -> None:
        q[name] = _with((ctes,) if isinstance(ctes, str) else ctes, body)

    # Folder inventory
    add("hotspots", "hot", f"SELECT {_HOT} FROM hot")
    add("hotspots_selective", ("hot", "units"),
        f"SELECT {_HOT} FROM hot WHERE folder IN (SELECT folder FROM units WHERE gibf >= 10)")
    add("folder_rows", "rollup",
        'SELECT folder AS filename, uid AS "UID", gid AS "GID", fcount AS pw_fcount, dirsum AS pw_dirsum FROM rollup')
    add("hotspot_base", "units", """
        SELECT folder, uid, gid, CAST(epoch(first_atime) AS BIGINT) AS atime, CAST(epoch(first_mtime) AS BIGINT) AS mtime,
               fcount, dirsum, round(gibf, 6) AS gib, round(tibf, 6) AS tib, round(mibf, 6) AS mib_avg FROM units""")
    add("folder_rollup", "rollup", "SELECT folder, fcount, dirsum FROM rollup")
    add("recursive_rollup", "rollup", """
        SELECT anc AS folder, CAST(sum(fcount) AS BIGINT) AS fcount, CAST(sum(dirsum) AS BIGINT) AS dirsum FROM (
          SELECT DISTINCT folder, CASE WHEN i = 1 THEN '/' ELSE array_to_string(string_split(folder, '/')[1:i], '/') END AS anc,
                 fcount, dirsum
          FROM rollup, unnest(range(1, len(string_split(folder, '/')) + 1)) t(i)) GROUP BY anc""")
    add("newest_times", ("folders", "own_files"), """
        SELECT f.folder, coalesce(max(o.atime), TIMESTAMP '1999-01-01') AS atime,
               coalesce(max(o.mtime), TIMESTAMP '1998-01-01') AS mtime
        FROM folders f LEFT JOIN own_files o ON f.folder = o.folder GROUP BY f.folder""")
    add("index_summary", "units", """
        SELECT count(*) AS folders, count(*) FILTER (gibf >= 10 AND mibf >= 10) AS hotspots,
               CAST(sum(dirsum) FILTER (gibf >= 10 AND mibf >= 10) AS BIGINT) AS bytes,
               round(sum(dirsum) FILTER (gibf >= 10 AND mibf >= 10) / 1099511627776, 3) AS tib FROM units""")
    add("aged_bytes", "aged", "SELECT days, bytes FROM aged")
    add("aged_bytes_report", "aged", """
        SELECT days, bytes, round(bytes / 1099511627776, 3) AS tib, round(days / 365, 1) AS years FROM (
          SELECT *, lag(bytes, 1, 0) OVER (ORDER BY days DESC) AS prev FROM aged) WHERE bytes > 0 AND bytes <> prev""")
    add("pick_old_large", "hot", f"SELECT {_HOT} FROM hot WHERE gib > 9 AND accd > 64")
    add("pick_newer", "hot", f"SELECT {_HOT} FROM hot WHERE modd < 62")
    add("top_hotspots", "hot", f"SELECT {_HOT} FROM hot ORDER BY dirsum DESC, folder LIMIT 20")
    add("non_meta_files", "own_files", "SELECT folder, name, size FROM own_files")
    add("skip_snapshots", "all_files", "SELECT folder, name, size FROM all_files WHERE qty <> 2")
    add("files_and_links", "all_files", "SELECT folder || '/' || name AS filename, type, size AS st_size FROM all_files")
    q["crawl_errors"] = """
        SELECT user_id AS source, 'locked' AS kind, 'Locked Dir: /data/' || event_id AS line FROM events WHERE event_type = 'error'
        UNION ALL
        SELECT user_id, 'denied', 'opendir /data/' || min(event_id) || ': Permission denied'
        FROM events WHERE event_type = 'purchase' GROUP BY user_id"""
    add("multi_root_union", "rollup",
        "SELECT folder, fcount, dirsum, '/' || split_part(folder, '/', 2) AS root FROM rollup")

    # Ownership and permissions
    add("resolve_owner", "all_files", """
        SELECT folder, name, coalesce(c_name, CAST(uid AS VARCHAR)) AS owner, coalesce(n_name, CAST(gid AS VARCHAR)) AS group_name
        FROM all_files LEFT JOIN customer ON uid = c_custkey LEFT JOIN nation ON gid = n_nationkey""")
    add("rw_permissions", "all_files", """
        SELECT folder, name, is_owner, is_group_member, owner_read, owner_write, group_read, group_write, is_444, is_666_or_777,
               (is_owner AND owner_read) OR (is_group_member AND group_read) OR is_444 AS can_read,
               (is_owner AND owner_write) OR (is_group_member AND group_write) OR is_666_or_777 AS can_write
        FROM (SELECT folder, name, uid = 7 AS is_owner, gid IN (1, 2, 3, 4, 5) AS is_group_member,
                mode & 256 <> 0 AS owner_read, mode & 128 <> 0 AS owner_write, mode & 32 <> 0 AS group_read,
                mode & 16 <> 0 AS group_write, mode & 292 = 292 AS is_444,
                mode & 438 = 438 OR mode & 511 = 511 AS is_666_or_777 FROM all_files)""")
    add("writable_hotspots", ("hot", "can_write"), f"SELECT {_HOT} FROM hot WHERE folder IN (SELECT folder FROM can_write)")
    add("folder_permission_ok", ("folders", "all_files"), """
        , own AS (SELECT folder, bool_and(bal > 2000 OR mode = 33206 OR
            ((uid = 7 AND mode & 256 <> 0 OR gid IN (1, 2, 3, 4, 5) AND mode & 32 <> 0 OR mode & 292 = 292) AND
             (uid = 7 AND mode & 128 <> 0 OR gid IN (1, 2, 3, 4, 5) AND mode & 16 <> 0))) AS ok FROM all_files GROUP BY folder)
        SELECT f.folder, coalesce((SELECT bool_and(ok) FROM own WHERE own.folder = f.folder), true) AS direct_ok,
               coalesce((SELECT bool_and(ok) FROM own WHERE own.folder = f.folder OR starts_with(own.folder, f.folder || '/')), true)
                 AS recursive_ok
        FROM folders f""")
    q["entitlements"] = """
        WITH p AS (SELECT c_custkey AS principal, c_mktsegment AS account, n_name AS own_nation, r_name AS own_region, c_acctbal > 0 AS rich
                   FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        r AS (SELECT n_nationkey AS k, n_name AS resource, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT principal, resource,
               CASE WHEN k % 3 = 0 THEN CASE WHEN rich THEN 'normal,short' ELSE 'normal' END
                 WHEN k % 3 = 1 THEN CASE WHEN rich THEN 'long,normal,short' ELSE 'normal' END
                 WHEN k % 6 = 2 THEN CASE WHEN rich THEN 'long,short' ELSE '' END ELSE '' END AS options
        FROM p, r
        WHERE k % 9 <> 8
          AND NOT (k % 6 = 5 AND (own_nation = 'NATION_3' OR own_region = 'EUROPE'))
          AND NOT (k % 7 = 3 AND account = 'HOUSEHOLD')
          AND CASE WHEN k % 4 = 0 THEN account IN ('BUILDING', 'MACHINERY') WHEN k % 12 = 9 THEN true
                WHEN k % 4 = 2 THEN true WHEN k % 4 = 3 THEN own_region = r_name ELSE own_nation = resource END"""

    people = """
        WITH p AS (SELECT c_custkey AS principal, c_mktsegment AS account, n_name AS own_nation, r_name AS own_region
                   FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        r AS (SELECT n_nationkey AS k, n_name AS resource, r_name,
                     CASE WHEN k % 4 = 0 THEN 'accounts' WHEN k % 12 = 9 OR k % 4 = 2 THEN 'everyone' ELSE 'groups' END AS rule,
                     CASE WHEN k % 4 = 0 THEN 'BUILDING,MACHINERY' WHEN k % 12 = 9 OR k % 4 = 2 THEN 'ALL'
                       WHEN k % 4 = 3 THEN r_name ELSE n_name END AS names
              FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 9 <> 8),
        pairs AS (SELECT principal, r.*, (k % 6 = 5 AND (own_nation = 'NATION_3' OR own_region = 'EUROPE'))
                           OR (k % 7 = 3 AND account = 'HOUSEHOLD') AS denied,
                         CASE rule WHEN 'everyone' THEN true WHEN 'accounts' THEN account IN ('BUILDING', 'MACHINERY')
                           ELSE own_nation = names OR own_region = names END AS named
                  FROM p, r)
        """
    q["entitlement_policies"] = people + """
        SELECT resource, rule, names, count(*) FILTER (named AND NOT denied) AS principals, count(*) FILTER (named AND denied) AS excluded
        FROM pairs GROUP BY resource, rule, names"""
    q["entitlement_exceptions"] = people + "SELECT resource, principal FROM pairs WHERE rule = 'everyone' AND denied"
    bits = lambda word, bit: f"(uid = 7 AND {word} & {bit << 6} <> 0 OR gid IN (1, 2, 3, 4, 5) AND {word} & {bit << 3} <> 0)"
    add("folder_permission_tree", ("folders", "all_files", "rollup"), f"""
        , entries AS (
            SELECT folder, uid, gid, mode, false AS dir FROM all_files
            UNION ALL
            SELECT folder, uid, gid, CASE fcount % 3 WHEN 0 THEN 16895 WHEN 1 THEN 16877 ELSE 16832 END, true FROM rollup),
        held AS (
            SELECT folder, bool_and(({bits("mode", 4)} OR mode & 292 = 292) AND ({bits("mode", 2)} OR mode & 438 = 438)) AS own,
                   bool_and(CASE WHEN dir THEN CASE WHEN uid = 7 THEN mode & 64 <> 0 WHEN gid IN (1, 2, 3, 4, 5) THEN mode & 8 <> 0
                                               ELSE mode & 1 <> 0 END END) AS passes
            FROM entries GROUP BY folder)
        SELECT f.folder, coalesce((SELECT bool_and(own) FROM held WHERE held.folder = f.folder), true) AS direct_ok,
               coalesce((SELECT bool_and(own) FROM held WHERE held.folder = f.folder OR starts_with(held.folder, f.folder || '/')), true)
                 AS recursive_ok,
               coalesce((SELECT bool_and(passes) FROM held WHERE held.folder = f.folder OR starts_with(f.folder, held.folder || '/')), true)
                 AS reachable
        FROM folders f""")

    # Catalogue
    add("catalogue_lookup", "looked_up",
        "SELECT folder, matched_folder, match, archive_mode, s3_storage_class FROM looked_up")
    add("path_overlaps", ("folders", "page_paths"), """
        , listed AS (SELECT folder FROM folders UNION ALL SELECT regexp_replace(path, '/+$', '') FROM page_paths),
        one AS (SELECT folder, count(*) AS copies FROM listed GROUP BY folder)
        SELECT a.folder AS ancestor, b.folder, CAST(1 AS BIGINT) AS copies FROM one a JOIN one b
          ON a.folder <> b.folder AND a.folder <> '' AND starts_with(b.folder, a.folder || '/')
        UNION ALL SELECT folder, folder, copies FROM one WHERE copies > 1""")
    add("destination_paths", "looked_up", """
        SELECT folder, match, coalesce(dest, ':s3:bkt2/new' || folder) AS destination FROM looked_up""")
    add("catalogue_upsert", "upserted", f"SELECT {_CAT} FROM upserted")
    q["catalogue_snapshot"] = q["catalogue_upsert"]
    add("catalogue_export", "catalogue",
        "SELECT folder_key AS local_folder, s3_storage_class, archive_mode, timestamp FROM catalogue")
    add("unarchived_hotspots", ("hot", "looked_up"),
        f"SELECT {_HOT} FROM hot WHERE folder IN (SELECT folder FROM looked_up WHERE match = 'none')")

    # Verification and plans
    add("verify_checksums", "verified", "SELECT folder, name, status FROM verified")
    add("verified_folders", "checked", "SELECT folder, checked, listed, failed, ok FROM checked")
    add("archive_state", "states", "SELECT folder, match, state FROM states")
    add("folders_with_content", ("folders", "own_files"),
        "SELECT folder FROM folders WHERE folder IN (SELECT folder FROM own_files)")
    add("folders_skipped", ("folders", "own_files"),
        "SELECT folder FROM folders WHERE folder NOT IN (SELECT folder FROM own_files)")
    add("delete_plan", "deletions", """
        SELECT folder, decision, dest AS destination, files, bytes FROM deletions""")
    add("deletion_report", ("deletions", "own_files"), """
        SELECT d.folder, dest AS destination, s3_storage_class, d.user AS archived_by,
               'coldledger restore "' || d.folder || '"' AS restore, d.files, d.bytes,
               coalesce((SELECT string_agg(name, ', ' ORDER BY name) FROM (
                 SELECT name FROM own_files o WHERE o.folder = d.folder ORDER BY name LIMIT 10)), '') AS first_files,
               CAST(greatest(d.files - 10, 0) AS BIGINT) AS more_files
        FROM deletions d WHERE decision = 'delete'""")
    q["sink_deletion_notes"] = f"""
        SELECT folder, 'destination: ' || destination || chr(10) || 's3 storage class: ' || s3_storage_class || chr(10) ||
               'archived by: ' || archived_by || chr(10) || 'restore: ' || restore || chr(10) || 'files: ' || files || chr(10) ||
               'bytes: ' || bytes || chr(10) || 'first files: ' || first_files || chr(10) || 'more files: ' || more_files AS note
        FROM ({q['deletion_report']})"""
    add("restore_plan", ("looked_up", "own_files"), """
        SELECT folder, CASE WHEN match = 'none' THEN 'not_archived'
                 WHEN folder IN (SELECT folder FROM own_files) THEN 'not_empty' ELSE 'restore' END AS decision,
               dest AS source, s3_storage_class,
               coalesce(s3_storage_class IN ('GLACIER', 'DEEP_ARCHIVE'), false) AS needs_retrieval
        FROM looked_up""")
    counted = f"""
        SELECT location, count(*) FILTER (st = 'triggered') AS triggered, count(*) FILTER (st = 'restoring') AS restoring,
               count(*) FILTER (st = 'restored') AS restored, count(*) FILTER (st = 'not_glacier') AS not_glacier,
               count(*) FILTER (st = 'unsupported') AS unsupported, count(*) FILTER (st = 'ignored') AS ignored
        FROM (SELECT location, CASE WHEN storage_class IS NULL THEN 'ignored' WHEN ongoing = 'true' THEN 'restoring'
                WHEN ongoing = 'false' THEN 'restored'
                WHEN storage_class NOT IN ('GLACIER', 'DEEP_ARCHIVE') THEN
                  CASE WHEN name = '{META.manifest}' THEN 'ignored' ELSE 'not_glacier' END
                WHEN storage_class = 'DEEP_ARCHIVE' AND @OPT = 'Expedited' THEN 'unsupported' ELSE 'triggered' END AS st
              FROM objects) GROUP BY location"""
    mix = ("CASE WHEN restoring > 0 AND restored > 0 THEN 'mixed' WHEN restoring > 0 THEN 'all_running' "
           "WHEN restored > 0 THEN 'all_done' ELSE 'none' END")
    expedited, bulk = counted.replace("@OPT", "'Expedited'"), counted.replace("@OPT", "'Bulk'")
    add("restore_job", ("looked_up", "own_files", "objects"), f"""
        , counts AS ({expedited})
        SELECT l.folder, dest AS source,
               CASE WHEN match = 'none' THEN 'not_archived' WHEN l.folder IN (SELECT folder FROM own_files) THEN 'not_empty'
                 WHEN s3_storage_class IN ('GLACIER', 'DEEP_ARCHIVE') AND coalesce(unsupported, 0) > 0 THEN 'unsupported'
                 WHEN s3_storage_class IN ('GLACIER', 'DEEP_ARCHIVE') AND coalesce(triggered + restoring, 0) > 0 THEN 'wait'
                 ELSE 'download' END AS step,
               coalesce(s3_storage_class IN ('GLACIER', 'DEEP_ARCHIVE'), false) AS needs_retrieval,
               coalesce(triggered, 0) AS triggered, coalesce(restoring, 0) AS restoring, coalesce(restored, 0) AS restored,
               coalesce(not_glacier, 0) AS not_glacier, coalesce(unsupported, 0) AS unsupported,
               coalesce({mix}, 'none') AS progress
        FROM looked_up l LEFT JOIN counts c ON l.dest = c.location""")
    add("archive_plan", ("states", "own_files", "looked_up"), """
        , small AS (SELECT folder, count(*) FILTER (size < 20971520) AS bundled,
            coalesce(sum(size) FILTER (size < 20971520), 0) AS bundled_bytes, count(*) AS n FROM own_files GROUP BY folder)
        SELECT s.folder, state, CASE WHEN state <> 'new' THEN state WHEN n IS NULL THEN 'skip' ELSE 'archive' END AS decision,
               coalesce(dest, ':s3:bkt/arch' || s.folder) AS destination, coalesce(bundled, 0) AS bundled,
               CAST(coalesce(bundled_bytes, 0) AS BIGINT) AS bundled_bytes, coalesce(n, 0) AS objects_before,
               coalesce(n - bundled + CASE WHEN bundled > 0 THEN 1 ELSE 0 END, 0) AS objects_after
        FROM states s JOIN looked_up l ON s.folder = l.folder LEFT JOIN small ON s.folder = small.folder""")
    checked_at = """
        , placed AS (SELECT folder, o.name, o.md5 FROM folders JOIN objects o ON o.location = ':s3:bkt/arch' || folders.folder),
        good AS (SELECT folder, bool_or(s.md5 IS NOT NULL) AS listed, bool_and(coalesce(s.md5 = o.md5, false)) AS ok
                 FROM src s FULL JOIN placed o USING (folder, name) GROUP BY folder)"""
    committed = """
        SELECT folder AS folder_key, ':s3:bkt/arch' || folder AS archive_folder, 'DEEP_ARCHIVE' AS s3_storage_class,
               '{0}' AS archive_mode, '2024-06-01T00:00:00' AS timestamp, 'me' AS user FROM folders f WHERE {1}"""
    # The objects that the join above binds carry a folder of their own; only their place counts.
    places = ("folders", "src", "objects")
    checked_at = checked_at.replace("SELECT folder, o.name", "SELECT folders.folder, o.name")
    add("archive_commit", places, checked_at + committed.format("Single", "folder IN (SELECT folder FROM good WHERE listed AND ok)"))
    add("archive_commit_recursive", places, checked_at + committed.format("Recursive", """
        len(string_split(folder, '/')) > 2
          AND EXISTS (FROM good g WHERE listed AND ok AND (g.folder = f.folder OR starts_with(g.folder, f.folder || '/')))
          AND NOT EXISTS (FROM good g WHERE listed AND NOT ok AND (g.folder = f.folder OR starts_with(g.folder, f.folder || '/')))"""))
    add("restore_verified", ("looked_up", "found", "all_files", "places"), f"""
        , fetched AS (
          SELECT folder, name, md5(folder || '/' || name || ':' || size || CASE WHEN uid % 50 = 7 THEN '?' ELSE '' END) AS md5
          FROM all_files WHERE flag = 'A' UNION ALL SELECT lvl3, '{META.manifest}', md5(lvl3) FROM places WHERE s_acctbal >= 0),
        sums AS (SELECT folder, count(*) AS files, count(*) FILTER (NOT coalesce(f.md5 = o.md5, false)) AS failed,
                        bool_or(name = '{META.manifest}') AS packed
                 FROM fetched f FULL JOIN found o USING (folder, name) GROUP BY folder)
        SELECT l.folder, dest AS source, coalesce(files, 0) AS files, coalesce(failed, 0) AS failed,
               CASE WHEN files IS NULL THEN 'nothing' WHEN failed > 0 THEN 'mismatch' WHEN packed THEN 'unbundle' ELSE 'done' END AS step
        FROM looked_up l LEFT JOIN sums s ON l.folder = s.folder WHERE dest IS NOT NULL""")
    add("content_md5", "content_files", "SELECT folder, name, size, md5(content) AS md5 FROM content_files")

    # Objects
    add("scan_objects_prefix", "objects", """
        SELECT bucket, key, size, storage_class FROM objects WHERE starts_with(key, 'arch/AFRICA/')""")
    add("store_listing", "objects", """
        SELECT location AS place, count(*) AS objects, coalesce(sum(size), 0)::BIGINT AS bytes
        FROM objects GROUP BY location""")
    add("direct_children", "objects", "SELECT bucket, key, size FROM objects WHERE dir = 'arch/AFRICA'")
    for name, source in (("prefix_size", "subtrees"), ("prefix_size_direct", "dirs")):
        add(name, ("folders", source), f"""
            SELECT ':s3:bkt/arch' || f.folder AS location, coalesce(objects, 0) AS objects, coalesce(bytes, 0) AS bytes,
                   round(coalesce(bytes, 0) / 1073741824, 2) AS gib
            FROM folders f LEFT JOIN {source} s ON ':s3:bkt/arch' || f.folder = s.location""")
    add("restore_status", "objects", f"""
        SELECT key, CASE WHEN storage_class IS NULL THEN 'ignored' WHEN ongoing = 'true' THEN 'restoring'
                 WHEN ongoing = 'false' THEN 'restored' WHEN name = '{META.manifest}' THEN 'ignored'
                 WHEN storage_class = 'STANDARD_IA' THEN 'not_glacier' WHEN storage_class = 'GLACIER' THEN 'triggered'
                 ELSE 'unsupported' END AS state FROM objects""")
    add("restore_status_counts", "objects", f"""
        SELECT location, triggered, restoring, restored, not_glacier, unsupported, ignored
        FROM ({bulk})""")
    add("restore_readiness", "objects", f"""
        SELECT location, triggered + restoring > 0 AS pending, {mix} AS progress FROM ({bulk})""")
    add("restore_watch", ("looked_up", "objects"), """
        SELECT l.asked_for AS folder, l.dest AS source, count(*) AS running, string_agg(DISTINCT tier, '+' ORDER BY tier) AS tiers,
               max(asked + to_seconds(CASE storage_class || tier WHEN 'GLACIERBulk' THEN 43200 WHEN 'GLACIERStandard' THEN 18000
                     WHEN 'GLACIERExpedited' THEN 300 WHEN 'DEEP_ARCHIVEBulk' THEN 172800 WHEN 'DEEP_ARCHIVEStandard' THEN 43200 END))
                 AS expected_end
        FROM (SELECT *, (['Bulk', 'Standard', 'Expedited'])[size % 3 + 1] AS tier, TIMESTAMP '2001-12-01' + to_seconds(size % 100000) AS asked
              FROM objects WHERE ongoing = 'true') o JOIN (SELECT folder AS asked_for, dest FROM looked_up) l ON o.location = l.dest
        GROUP BY l.asked_for, l.dest""")
    add("tier_change_plan", "tier_plan", """
        SELECT archive, location, folders, decision, old_class, new_class, total, changed, skipped, bytes FROM tier_plan""")
    add("tier_change_update", ("tier_plan", "catalogue"), f"""
        SELECT folder_key, archive_folder, CASE WHEN t.archive IS NULL THEN s3_storage_class ELSE new_class END AS s3_storage_class,
               archive_mode, CASE WHEN t.archive IS NULL THEN timestamp ELSE '2024-05-01T00:00:00' END AS timestamp, user
        FROM catalogue LEFT JOIN (SELECT * FROM tier_plan WHERE decision = 'change') t ON folder_key = t.archive""")
    add("tier_change_job", ("tier_plan", "tiers"), """
        SELECT archive, folders, decision, old_class, new_class, total, changed, skipped, bytes, round(bytes / 1099511627776 * CAST(t.lo AS DOUBLE), 4) AS old_usd,
               round(bytes / 1099511627776 * CAST(n.lo AS DOUBLE), 4) AS new_usd
        FROM tier_plan LEFT JOIN tiers t ON old_class = t.storage_class LEFT JOIN tiers n ON new_class = n.storage_class""")
    add("tier_cost_estimate", ("objects", "tiers"), """
        , sizes AS (SELECT location, storage_class, CAST(sum(size) AS BIGINT) AS bytes FROM objects GROUP BY ALL)
        SELECT location, s.storage_class, bytes, round(bytes / 1099511627776, 3) AS tib,
               round(bytes / 1099511627776 * CAST(lo AS DOUBLE), 4) AS storage_lo_usd,
               round(bytes / 1099511627776 * CAST(hi AS DOUBLE), 4) AS storage_hi_usd,
               coalesce(s.storage_class <> 'DEEP_ARCHIVE', true) AS supported,
               CASE s.storage_class WHEN 'DEEP_ARCHIVE' THEN NULL WHEN 'GLACIER' THEN round(bytes / 1099511627776 * 30.0::DOUBLE, 4)
                 ELSE round(bytes / 1099511627776 * CAST(retrieval AS DOUBLE), 4) END AS retrieval_usd,
               round(bytes / 1099511627776 * 90.0::DOUBLE, 4) AS egress_usd,
               CASE s.storage_class WHEN 'DEEP_ARCHIVE' THEN NULL WHEN 'GLACIER' THEN 0.0833::DOUBLE ELSE 0.0::DOUBLE END AS hours_hi
        FROM sizes s LEFT JOIN tiers t ON s.storage_class = t.storage_class""")
    add("best_fit_capacity", "units", """
        , needs AS (SELECT folder, round(gibf, 2) AS need FROM units),
        machines(name, gb) AS (VALUES ('i3en.24xlarge', 60000), ('i3en.12xlarge', 30000), ('i3en.6xlarge', 15000),
          ('i3en.3xlarge', 7500), ('i3en.xlarge', 2500), ('i3en.large', 1250), ('c5ad.large', 75), ('t3a.micro', 5))
        SELECT folder, need, (SELECT arg_min(name, gb) FROM machines
          WHERE gb > 1.5 * CASE WHEN need > 1 THEN need + 5 ELSE need END) AS machine FROM needs""")

    # Small files
    add("classify_small", "all_files",
        "SELECT folder, name, size, CASE WHEN size < 1048576 THEN 'Yes' ELSE 'No' END AS tarred FROM all_files")
    add("small_file_plan", "local_files", f"""
        SELECT folder, bundled, bundled_bytes, objects_before, objects_before - bundled + CASE WHEN bundled > 0 THEN 1 ELSE 0 END
                 AS objects_after,
               (bundled - CASE WHEN bundled > 0 THEN 1 ELSE 0 END) * 40960 AS overhead_saved
        FROM (SELECT folder, count(*) FILTER (size < 20971520) AS bundled,
                CAST(coalesce(sum(size) FILTER (size < 20971520), 0) AS BIGINT) AS bundled_bytes, count(*) AS objects_before
              FROM local_files WHERE name <> '{META.manifest}' GROUP BY folder)""")
    add("bundle_small", "bundle_parts", """
        SELECT folder, bundle, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, string_agg(name, ',' ORDER BY name) AS names,
               md5(string_agg(content, '' ORDER BY name)) AS digest FROM bundle_parts GROUP BY folder, bundle""")
    add("unbundle_roundtrip", "content_files",
        "SELECT folder, name, size, md5(content) AS md5 FROM content_files WHERE size < 1024")

    # Reports
    add("file_manifest", "manifest_rows", "SELECT * FROM manifest_rows")
    q["scan_manifest"] = q["file_manifest"]
    add("sink_manifest", "manifest_rows",
        'SELECT folder, count(*) AS files, CAST(sum("Size(bytes)") AS BIGINT) AS bytes FROM manifest_rows GROUP BY folder')
    add("archive_batch", "hot", """
        , chosen AS (SELECT * FROM hot WHERE gib > 9 AND accd > 60),
        parts AS (SELECT greatest(CAST(ceil(count(*) / 10) AS BIGINT), 1) AS n FROM chosen)
        SELECT CAST('0x' || substr(md5(folder), 1, 8) AS BIGINT) % n AS batch, count(*) AS folders,
               CAST(sum(dirsum) AS BIGINT) AS bytes, CAST(sum(gib) AS BIGINT) AS gib,
               'coldledger archive ' || string_agg('"' || folder || '"', ' ' ORDER BY folder) AS command
        FROM chosen, parts GROUP BY batch
        UNION ALL
        SELECT NULL, count(*), CAST(coalesce(sum(dirsum), 0) AS BIGINT), CAST(coalesce(sum(gib), 0) AS BIGINT), 'total' FROM chosen""")
    q["cost_report"] = """
        WITH lines AS (SELECT CAST(o_custkey AS VARCHAR) AS owner, o_orderpriority AS instance_type, 'service-' || o_orderstatus AS service,
                         CASE o_orderkey % 4 WHEN 3 THEN 'EUR' ELSE 'USD' END AS unit, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,4)) AS amount
                       FROM orders WHERE o_orderdate >= DATE '1998-06-01' AND o_orderdate < DATE '1998-06-15'),
        sums AS (
          SELECT scope, name, unit, sum(amount) AS m, sum(amount) FILTER (day = DATE '1998-06-14') AS d
          FROM (SELECT 'account' AS scope, 'root' AS name, unit, day, amount FROM lines
                UNION ALL SELECT 'owner', owner, unit, day, amount FROM lines
                UNION ALL SELECT 'instance_type', instance_type, unit, day, amount FROM lines
                UNION ALL SELECT 'service', service, unit, day, amount FROM lines) GROUP BY ALL)
        SELECT scope, name, unit, CAST(coalesce(m, 0) AS DOUBLE) AS month_to_date, CAST(coalesce(d, 0) AS DOUBLE) AS last_day FROM sums"""
    add("transfer_errors", "log_lines", """
        SELECT log, count(*) AS stats_lines, max(bytes) AS bytes, arg_min(last_error, pos) FILTER (last_error IS NOT NULL) AS first_error
        FROM log_lines WHERE kind = 'stats' GROUP BY log""")

    # Scalar functions
    q["days_ago"] = f"SELECT event_id, {_days('ts', '2024-01-15 12:00:00')} AS days FROM events"
    q["human_size"] = """
        WITH s AS (SELECT DISTINCT CAST(trunc(l_extendedprice * pow(10, l_linenumber)) AS BIGINT) AS size FROM lineitem),
        p AS (SELECT size, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2
                WHEN size < 1099511627776 THEN 3 WHEN size < 1125899906842624 THEN 4 ELSE 5 END AS i FROM s)
        SELECT size, CASE WHEN size = 0 THEN '0B' ELSE CAST(round_even(size / pow(1024, i), 3) AS VARCHAR) || ' ' ||
                 ['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'][i + 1] END AS text FROM p"""
    add("path_parts", "all_files", """
        SELECT folder || '/' || name AS path, name AS base, folder AS parent,
               CAST(len(string_split(folder, '/')) AS INTEGER) AS depth FROM all_files""")
    add("ancestors", "page_paths", """
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY length(anc)) - 1 AS INTEGER) AS pos, anc AS ancestor
        FROM (SELECT DISTINCT page_id, CASE WHEN a = '' THEN '/' ELSE a END AS anc FROM (
          SELECT page_id, array_to_string(string_split(path, '/')[1:i], '/') AS a
          FROM page_paths, unnest(range(1, len(string_split(path, '/')) + 1)) t(i)))""")
    add("clean_paths", "page_paths", """
        SELECT page_id, CASE WHEN path = '' THEN '' WHEN rtrim(path, '/') = '' THEN '/' ELSE regexp_replace(rtrim(path, '/'), '/+', '/', 'g') END AS path
        FROM page_paths""")
    q["report_slug"] = """
        SELECT page_id, replace(url, '/', '+') || '.csv' AS slug, CASE WHEN length(s) > 255 THEN left(s, 25) || '..' || md5(p) || '..' || right(s, 190)
                 ELSE s END AS short_slug
        FROM (SELECT page_id, url, p, replace(p, '/', '+') || '.csv' AS s
              FROM (SELECT *, url || '/' || regexp_replace(html, '[^a-z]', '', 'g') AS p FROM pages))"""
    add("parse_destination", "folders", """
        SELECT folder, 'bkt' AS bucket, 'arch' || folder AS prefix, ':s3:b/d' || folder AS built FROM folders""")
    q["clean_search"] = """
        SELECT doc_id, md5(c) AS digest, CAST(length(c) AS BIGINT) AS chars, true AS chars_is_number,
               TRY_CAST(source AS DOUBLE) IS NOT NULL AS is_number
        FROM (SELECT doc_id, source, regexp_replace(text, '[,:?''$^%&*!`~+={}\\\\\\[\\]"]', ' ', 'g') AS c FROM documents)"""

    # Search
    add("scan_grants", "grants", """
        SELECT seq, project_num, start, "end", contact_pi_name, project_title, org_name, project_detail_url, pi_profile_ids FROM grants""")
    add("dedup_first", "grants", """
        SELECT project_num, min(seq) AS seq, arg_min(contact_pi_name, seq) AS contact_pi_name,
               arg_min(project_title, seq) AS project_title FROM grants GROUP BY project_num""")
    q["cascade_search"] = _search("SRC3, en")
    q["cascade_search_project"] = _search("en-src3-5")
    q["cascade_search_org"] = _search("fr institute")
    q["cascade_search_text"] = _search("the 1")
    q["cascade_search_blank"] = f"SELECT * FROM ({q['cascade_search_text']}) WHERE false"

    # Activity
    add("idle_streak", "streaks", "SELECT host, runs, streak, streak >= 5 AS is_idle FROM streaks")
    add("io_rates", "deltas", """
        , rated AS (SELECT host, ts, seq, w, s, r, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts, seq))) / 1e6 AS sec
            FROM deltas)
        SELECT host, ts, seq, round(w / sec, 3) AS write_rate, round(s / sec, 3) AS sent_rate, round(r / sec, 3) AS recv_rate,
               round(w / sec, 3) > 100000 OR round(s / sec, 3) > 1000 OR round(r / sec, 3) > 1000 AS is_busy
        FROM rated WHERE sec IS NOT NULL""")
    add("activity_windows", "tumbling", "SELECT * FROM tumbling")
    add("restore_state", "progress", "SELECT * FROM progress")

    # Scans and sinks read back what was written
    add("scan_crawl_csv", ("all_files", "rollup"), """
        SELECT folder || '/' || name || '_é' AS filename, uid AS "UID", gid AS "GID", CAST(epoch(atime) AS BIGINT) AS st_atime,
               CAST(-1 AS BIGINT) AS pw_fcount, CAST(0 AS BIGINT) AS pw_dirsum, type FROM all_files
        UNION ALL
        SELECT folder || '_é', uid, gid, CAST(epoch(first_atime) AS BIGINT), fcount, dirsum, 'd' FROM rollup""")
    add("scan_crawl_quarantine", "rollup", """
        SELECT folder AS filename, concat_ws(',', folder, 'not a number', gid, CAST(epoch(first_atime) AS BIGINT), CAST(epoch(first_mtime) AS BIGINT),
                 fcount, dirsum, 4096, CASE fcount % 3 WHEN 0 THEN 16895 WHEN 1 THEN 16877 ELSE 16832 END, 'd',
                 '/' || split_part(folder, '/', 2)) AS line FROM rollup""")
    for name in ("index_job", "scan_hotspots"):
        add(name, "index_rows", "SELECT * FROM index_rows")
    add("index_job_locked", ("index_rows", "places"), """
        , locked AS (SELECT lvl3 AS folder FROM places WHERE s_suppkey % 7 = 3
                     UNION SELECT lvl2 FROM places WHERE s_nationkey IN (4, 11))
        SELECT "Folder", "FileCount", "DirSize",
               NOT EXISTS (SELECT 1 FROM locked WHERE starts_with(locked.folder, i."Folder" || '/')) AS "Complete"
        FROM index_rows AS i
        WHERE NOT EXISTS (SELECT 1 FROM locked WHERE i."Folder" = locked.folder OR starts_with(i."Folder", locked.folder || '/'))""")
    add("rearchive_plan", ("local_files", "src", "found", "looked_up"), f"""
        , disk AS (SELECT folder, name, size, md5(folder || '/' || name || ':' || size || CASE WHEN uid % 40 = 3 THEN '!' ELSE '' END) AS md5
                   FROM local_files WHERE uid % 90 <> 4),
        acts AS (
            SELECT folder, name, size,
                   CASE WHEN d.md5 IS NOT NULL AND meta THEN 'drop' WHEN meta THEN NULL
                     WHEN d.md5 IS NULL AND o.md5 IS NULL THEN NULL WHEN d.md5 IS NULL THEN 'remove'
                     WHEN s.md5 IS NULL THEN 'upload_new' WHEN s.md5 <> d.md5 THEN 'upload_changed'
                     WHEN o.md5 = d.md5 THEN 'keep' ELSE 'upload_missing' END AS action
            FROM (SELECT folder, name, name IN ('{META.manifest}', '{META.md5}', '{META.md5_restored}', '{META.moved_note}') AS meta
                  FROM (SELECT folder, name FROM disk UNION SELECT folder, name FROM src UNION SELECT folder, name FROM found))
            LEFT JOIN disk d USING (folder, name) LEFT JOIN src s USING (folder, name) LEFT JOIN found o USING (folder, name))
        SELECT folder, false AS unbundle, count(*) FILTER (action = 'drop') AS "drop", count(*) FILTER (action = 'keep') AS keep,
               count(*) FILTER (action = 'upload_new') AS upload_new, count(*) FILTER (action = 'upload_changed') AS upload_changed,
               count(*) FILTER (action = 'upload_missing') AS upload_missing, count(*) FILTER (action = 'remove') AS remove,
               coalesce(sum(size) FILTER (action LIKE 'upload%'), 0)::BIGINT AS upload_bytes
        FROM acts WHERE action IS NOT NULL GROUP BY folder""")
    add("index_roots", ("index_rows", "units"), """
        SELECT * FROM index_rows WHERE "Folder" IN (SELECT folder FROM units WHERE gibf >= 9)""")
    add("index_totals", "units", """
        SELECT count(*) AS folders, count(*) FILTER (h) AS hotspots, CAST(sum(dirsum) FILTER (h) AS BIGINT) AS bytes,
               round(sum(dirsum) FILTER (h) / 1099511627776, 3) AS tib
        FROM (SELECT dirsum, gibf >= 1 AND mibf >= 10 AS h FROM units)""")
    add("sink_hotspots", "index_rows",
        'SELECT count(*) FILTER ("GiB" >= 10) AS kept_rows, count(*) AS forced_rows FROM index_rows')
    add("sink_user_hotspots", ("index_rows", "can_write"),
        'SELECT * FROM index_rows WHERE "Folder" IN (SELECT folder FROM can_write)')
    add("sink_crawl", ("all_files", "rollup"), """
        SELECT '/' || split_part(folder, '/', 2) AS root, type, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes
        FROM (SELECT folder, type, size FROM all_files UNION ALL SELECT folder, 'd', 4096 FROM rollup) GROUP BY ALL""")
    add("sink_md5_manifest", "src", "SELECT folder || chr(9) || md5 || '  ' || name AS line FROM src")
    add("scan_md5_manifest", "src", "SELECT folder, name, md5 FROM src")
    for name in ("scan_catalogue_json", "parse_catalogue"):
        add(name, "catalogue", f"SELECT {_CAT} FROM catalogue")
    add("report_listing", "index_rows", """
        -- The reports were written one after the other, in the order of the regions' names.
        SELECT report, rows, CAST(row_number() OVER (ORDER BY report DESC) AS INTEGER) AS place
        FROM (SELECT '+' || split_part("Folder", '/', 2) || '.csv' AS report, count(*) AS rows FROM index_rows GROUP BY ALL)""")
    add("sink_catalogue_export", "catalogue", "SELECT folder_key AS local_folder, timestamp FROM catalogue")
    add("scan_transfer_log", "log_lines", "SELECT kind, msg, bytes, last_error FROM log_lines")
    q["scan_key_value"] = """
        SELECT p_partkey AS part, p_brand AS brand, 'a=' || p_size AS expr, split_part(p_type, ' ', 1) AS type FROM part"""
    q["scan_delimited"] = """SELECT c_custkey AS id, c_name || '|x' AS name, c_mktsegment AS segment FROM customer"""

    # Streams equal their batch twins
    for name, twin in (("stream_idle_streak", "idle_streak"), ("stream_activity", "activity_windows"),
                       ("stream_restore_state", "restore_state"), ("stream_folder_rollup", "folder_rollup")):
        q[name] = q[twin]
    return q
