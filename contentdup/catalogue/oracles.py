"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

_DOCUMENTS = """
    SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name,
           source AS top_dir, lang, strlen(text)::BIGINT AS size_bytes, encode(text) AS content
    FROM documents
"""
_MARKED = """
    SELECT '/' || dir || '/' || lang || '/' || name AS path, * FROM (
        SELECT CASE WHEN source LIKE '%3' THEN '.' || source ELSE source END AS dir, lang,
               CASE WHEN n_chars < 200 THEN '.' ELSE '' END || doc_id || '.txt' AS name,
               lang = 'es' AND n_chars > 2000 AS is_symlink,
               strlen(text)::BIGINT AS size_bytes, encode(text) AS content
        FROM documents)
"""
_ODDLY_NAMED = """
    SELECT CASE doc_id % 6 WHEN 0 THEN ' /' || doc_id WHEN 1 THEN '/' || doc_id || ' ' WHEN 2 THEN '/q"u,' || doc_id || ',"'
                WHEN 3 THEN '/back\\' || doc_id || '\\' WHEN 4 THEN '/line' || chr(10) || doc_id || chr(10)
                ELSE '/cr' || chr(13) || doc_id || chr(13) || chr(10) || chr(39) END AS path,
           strlen(text)::BIGINT AS size_bytes, encode(text) AS content
    FROM documents
"""
_NOW = """
    SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size_bytes,
           sha256(text) AS digest, CASE WHEN doc_id % 20 <> 3 THEN text END AS content
    FROM documents
"""
_BEFORE = """
    SELECT path, strlen(text)::BIGINT AS size_bytes, sha256(text) AS digest, version FROM (
        SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
               CASE WHEN doc_id % 10 = 4 THEN text || '!' ELSE text END AS text,
               CASE WHEN doc_id % 10 = 4 THEN 0 ELSE 1 END AS version
        FROM documents WHERE doc_id % 10 <> 3
        UNION ALL SELECT '/gone/' || source || '/' || lang || '/' || doc_id || '.txt', text, 1
        FROM documents WHERE doc_id % 10 = 5)
"""
_PAGES = """
    SELECT '/pages/' || page_id || '.html' AS path, strlen(html)::BIGINT AS size_bytes, encode(html) AS content
    FROM pages
"""
_CONVERSATIONS = """
    SELECT '/' || role || '/' || conv_id || '-' || turn AS path, strlen(text)::BIGINT AS size_bytes,
           encode(text) AS content
    FROM conversations
"""
_PREFIX_BYTES = """
    CASE WHEN size_bytes <= 8192 THEN -1 WHEN size_bytes <= 1048576 THEN 16384
         WHEN size_bytes <= 104857600 THEN 32768 ELSE 65536 END
"""
_ADAPTIVE = f"CASE WHEN size_bytes <= 8192 THEN content ELSE content[1:{_PREFIX_BYTES}] END"
_REGIONS = f"""
    CASE WHEN size_bytes > 12288
         THEN content[1:4096] || content[size_bytes // 2 - 2047:size_bytes // 2 + 2048] || content[size_bytes - 4095:size_bytes]
         ELSE {_ADAPTIVE} END
"""


def _digested(corpus: str, compared: str = "content", where: str = "true") -> str:
    return f"SELECT path, size_bytes, sha256({compared}) AS digest FROM ({corpus}) WHERE {where}"


def _members(corpus: str, compared: str = "content", where: str = "true") -> str:
    return f"""
        SELECT path, size_bytes, digest FROM ({_digested(corpus, compared, where)})
        QUALIFY count(*) OVER (PARTITION BY size_bytes, digest) > 1
    """


def _groups(corpus: str, where: str = "true") -> str:
    return f"""
        SELECT size_bytes, digest, count(*)::BIGINT AS n_files FROM ({_digested(corpus, where=where)})
        GROUP BY ALL HAVING count(*) > 1
    """


def _size_text(size: str) -> str:
    ladder, units = "", ("bytes", "KB", "MB", "GB", "TB", "PB")
    for power, unit in enumerate(units):
        text = f"printf('%.1f {unit}', round_even(({size})::DOUBLE / {1024**power}, 1))"
        ladder += f" ELSE {text}" if unit == "PB" else f" WHEN ({size}) < {1024 ** (power + 1)} THEN {text}"
    return f"CASE {ladder} END"


_SAVINGS = """
    coalesce(sum(size_bytes * n_files), 0)::BIGINT AS total_bytes,
    coalesce(sum(size_bytes * (n_files - 1)), 0)::BIGINT AS reclaimable_bytes
"""


def _numbered(corpus: str) -> str:
    return f"""
    SELECT *, dense_rank() OVER (ORDER BY size_bytes, digest)::BIGINT AS group_no,
           (row_number() OVER (PARTITION BY size_bytes, digest ORDER BY path) - 1)::BIGINT AS member_no,
           count(*) OVER (PARTITION BY size_bytes, digest)::BIGINT AS n_files
    FROM ({_members(corpus)})
    """


_NUMBERED = _numbered(_DOCUMENTS)
_RESULT_TABLE = f"""
    SELECT group_no, size_bytes, {_size_text('size_bytes')} AS size_text, digest,
           left(digest, 8) || '...' || right(digest, 8) AS display_digest, path
    FROM ({_NUMBERED})"""
_GLOBS = "(name GLOB '*7.txt' OR name GLOB '[!1-5]?.txt')"
_HIDDEN = "(starts_with(dir, '.') OR starts_with(lang, '.') OR starts_with(name, '.'))"
_AUDIT = f"""
    SELECT path, size_bytes,
           CASE WHEN is_symlink THEN 'symlink' WHEN {_HIDDEN} THEN 'hidden'
                WHEN dir IN ('fr', 'src7') OR lang IN ('fr', 'src7') THEN 'excluded_dir'
                WHEN {_GLOBS} THEN 'excluded_file'
                WHEN size_bytes NOT BETWEEN 300 AND 6000 THEN 'size_out_of_range' ELSE 'kept' END AS reason
    FROM ({_MARKED})
"""
_KEPT = f"""
    NOT is_symlink AND NOT {_HIDDEN} AND dir NOT IN ('fr', 'src7') AND lang NOT IN ('fr', 'src7')
    AND NOT {_GLOBS} AND size_bytes BETWEEN 300 AND 6000
"""


def _manifest(order: str) -> str:
    return f"""
        SELECT size_bytes, digest, path, keep_path, 'would_delete' AS action FROM (
            SELECT *, first_value(path) OVER (PARTITION BY size_bytes, digest ORDER BY {order}) AS keep_path
            FROM ({_members(_DOCUMENTS)}))
        WHERE path <> keep_path
    """


_DECIDED = f"""
    SELECT *, CASE WHEN left(digest, 1) < '4' THEN ' A ' WHEN left(digest, 1) < '6' THEN 's'
                   WHEN left(digest, 1) < 'a' THEN '0, 2,-1,99' WHEN left(digest, 1) < 'd' THEN '1'
                   WHEN left(digest, 1) < 'e' THEN '1,x' ELSE '' END AS raw_choice
    FROM ({_NUMBERED})
"""
_PICKED = f"""
    SELECT *, split_part(path, '/', 3) IN ('en', 'fr') AS picked, min(path) OVER grouped AS first_path,
           bool_and(split_part(path, '/', 3) IN ('en', 'fr')) OVER grouped AS all_picked
    FROM ({_members(_DOCUMENTS)})
    WINDOW grouped AS (PARTITION BY size_bytes, digest)
"""

_BY_DECISION = f"""
    SELECT size_bytes, digest, path, member_no, keep_path, 'would_delete' AS action FROM (
        SELECT *, min(path) FILTER (WHERE NOT goes) OVER (PARTITION BY size_bytes, digest) AS keep_path FROM (
            SELECT *, (raw_choice = ' A ' AND member_no > 0) OR (raw_choice LIKE '0, 2%' AND member_no IN (0, 2))
                      OR (raw_choice = '1' AND member_no = 1) AS goes
            FROM ({_DECIDED})))
    WHERE goes
"""


def _details(numbered: str) -> str:
    return f"""
        SELECT group_no, {_size_text('size_bytes')} AS size_text, left(digest, 8) || '...' AS short_digest,
               member_no, path
        FROM ({numbered})"""


def _selected(goes: str) -> str:
    return f"""
        SELECT size_bytes, digest, path, keep_path, 'would_delete' AS action FROM (
            SELECT *, min(path) FILTER (WHERE NOT goes) OVER (PARTITION BY size_bytes, digest) AS keep_path
            FROM (SELECT *, {goes} AS goes FROM ({_PICKED})))
        WHERE goes
    """


def _planted(corpus: str) -> str:
    return f"""
        SELECT path, size_bytes, content FROM ({corpus})
        UNION ALL SELECT '/copies' || path, size_bytes, content FROM ({corpus})
    """


_ALTERED = f"""
    SELECT path, size_bytes, content FROM ({_DOCUMENTS}) WHERE size_bytes > 0
    UNION ALL SELECT '/tail' || path, size_bytes, content[1:size_bytes - 1] || '\\x01'::BLOB FROM ({_DOCUMENTS})
    WHERE size_bytes > 0
    UNION ALL SELECT '/gap' || path, size_bytes, content[1:5000] || '\\x02'::BLOB || content[5002:size_bytes] FROM ({_DOCUMENTS})
    WHERE size_bytes > 5001
"""


def _funnel(candidate: str) -> str:
    return f"""
        SELECT count(*)::BIGINT AS found_files, sum(size_bytes)::BIGINT AS found_bytes,
               (count(*) FILTER (n_alike > 1))::BIGINT AS candidate_files,
               coalesce(sum(size_bytes) FILTER (n_alike > 1), 0)::BIGINT AS candidate_bytes,
               (count(*) FILTER (n_same > 1))::BIGINT AS duplicate_files,
               coalesce(sum(size_bytes) FILTER (n_same > 1), 0)::BIGINT AS duplicate_bytes,
               (count(DISTINCT (size_bytes, digest)) FILTER (n_same > 1))::BIGINT AS duplicate_groups
        FROM (SELECT size_bytes, digest, count(*) OVER (PARTITION BY size_bytes, candidate) AS n_alike,
                     count(*) OVER (PARTITION BY size_bytes, digest) AS n_same
              FROM (SELECT size_bytes, sha256(content) AS digest, sha256({candidate}) AS candidate
                    FROM ({_DOCUMENTS})))
    """


def _nested(per_row: int, columns: str) -> str:
    return f"""
        SELECT {columns} FROM (
            SELECT size_bytes, digest AS hash, (member_no // {per_row})::BIGINT AS part, n_files,
                   list(path ORDER BY path) AS paths
            FROM ({_NUMBERED}) GROUP BY ALL)
    """


ORACLES: dict[str, str] = {
    "inventory_table": f"SELECT path, name, top_dir, 2::BIGINT AS depth, size_bytes FROM ({_DOCUMENTS})",
    "path_parts": f"""
        SELECT path, name, '/' || top_dir || '/' || lang AS folder,
               CASE WHEN starts_with(path, '/src1/') THEN substr(path, 7) ELSE path END AS relative
        FROM ({_DOCUMENTS})""",
    "size_range_inclusive": f"SELECT path, size_bytes FROM ({_DOCUMENTS}) WHERE size_bytes BETWEEN 416 AND 2258",
    "size_range_exclusive": f"""
        SELECT path, size_bytes FROM ({_DOCUMENTS}) WHERE size_bytes > 416 AND size_bytes < 2258""",
    "exclude_glob": f"SELECT path, size_bytes FROM ({_DOCUMENTS}) WHERE NOT {_GLOBS}",
    "exclude_dir": f"""
        SELECT path, size_bytes FROM ({_DOCUMENTS})
        WHERE top_dir NOT IN ('fr', 'src7') AND lang NOT IN ('fr', 'src7')""",
    "exclude_hidden": f"SELECT path, size_bytes FROM ({_MARKED}) WHERE NOT {_HIDDEN} AND NOT is_symlink",
    "exclude_symlink": f"SELECT path, size_bytes FROM ({_MARKED}) WHERE NOT is_symlink",
    "scan_audit": _AUDIT,
    "scan_audit_counts": f"""
        SELECT reason, count(*)::BIGINT AS n_files, sum(size_bytes)::BIGINT AS total_bytes
        FROM ({_AUDIT}) GROUP BY reason""",
    "distinct_paths": f"""
        SELECT path, size_bytes FROM ({_DOCUMENTS}) UNION SELECT path, size_bytes FROM ({_DOCUMENTS})""",
    "scan_equivalence": f"""
        WITH a AS (SELECT path, size_bytes FROM ({_MARKED}) WHERE {_KEPT}),
             b AS (SELECT path, size_bytes FROM ({_AUDIT}) WHERE reason = 'kept')
        SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b))::BIGINT AS only_first,
               (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a))::BIGINT AS only_second""",
    "digest_full": _digested(_DOCUMENTS),
    "digest_prefix": _digested(_DOCUMENTS, "content[1:4096]"),
    "digest_adaptive": f"""
        SELECT path, size_bytes, sha256({_ADAPTIVE}) AS candidate_digest FROM ({_DOCUMENTS})""",
    "digest_three_region": _digested(_DOCUMENTS, _REGIONS),
    "digest_adaptive_pages": f"SELECT path, size_bytes, sha256({_ADAPTIVE}) AS candidate_digest FROM ({_PAGES})",
    "digest_three_region_pages": _digested(_PAGES, _REGIONS),
    "read_tiers": f"SELECT path, size_bytes, ({_PREFIX_BYTES})::BIGINT AS prefix_bytes FROM ({_PAGES})",
    "candidates_by_size": f"""
        SELECT path, size_bytes FROM ({_DOCUMENTS}) QUALIFY count(*) OVER (PARTITION BY size_bytes) > 1""",
    "dupes_full": _members(_DOCUMENTS),
    "dupes_quick": _members(_DOCUMENTS, "content[1:4096]"),
    "dupes_quick_short_prefix": _members(_DOCUMENTS, "content[1:4]"),
    "dupes_multi_region": _members(_DOCUMENTS),
    "dupes_regions_only": _members(_DOCUMENTS, _REGIONS),
    "dupes_legacy": _members(_DOCUMENTS, where="size_bytes > 416 AND size_bytes < 2258"),
    "dupes_filtered": _members(_MARKED, where=_KEPT),
    "dupes_pages": _members(_PAGES),
    "dupes_conversations": _members(_CONVERSATIONS),
    "dupes_pages_planted": _members(_planted(_PAGES)),
    "dupes_conversations_planted": _members(_planted(_CONVERSATIONS)),
    "dupes_full_hot": _members(_DOCUMENTS),
    "dupes_by_mode": f"""
        SELECT *, 'quick' AS mode FROM ({_members(_ALTERED, "content[1:4096]")})
        UNION ALL SELECT *, 'multi_region' FROM ({_members(_ALTERED, _REGIONS)})
        UNION ALL SELECT *, 'full' FROM ({_members(_ALTERED)})""",
    "scan_unreadable": """
        SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
               CASE WHEN doc_id % 9 = 0 THEN 'unreadable' WHEN strlen(text) > 6000 THEN 'size_out_of_range' ELSE 'kept' END AS reason,
               doc_id % 9 = 0 AND strlen(text) <= 6000 AS reported
        FROM documents""",
    "scan_unreadable_unsized": """
        SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
               CASE WHEN doc_id % 9 = 0 THEN 'unreadable' WHEN strlen(text) > 6000 THEN 'size_out_of_range' ELSE 'kept' END AS reason,
               doc_id % 9 = 0 AS reported
        FROM documents""",
    "exclude_glob_brackets": f"""
        SELECT path, size_bytes FROM ({_DOCUMENTS})
        WHERE NOT regexp_full_match(name, '[\\[1].*') AND NOT regexp_full_match(name, '[^0-8].[\\]^\\-0].*')""",
    "dupes_planted": _members(_planted(_DOCUMENTS)),
    "dupes_blake2b_groups": f"SELECT size_bytes, n_files FROM ({_groups(_DOCUMENTS)})",
    "dupes_groups": _groups(_DOCUMENTS),
    "dupes_groups_nested": _nested(2, "size_bytes, hash, part, n_files, paths"),
    "quick_false_positives": f"""
        SELECT path, size_bytes, candidate_digest, digest FROM (
            SELECT *, count(*) OVER (PARTITION BY size_bytes, candidate_digest) AS n_alike,
                   count(*) OVER (PARTITION BY size_bytes, digest) AS n_same
            FROM (SELECT path, size_bytes, sha256(content[1:4]) AS candidate_digest, sha256(content) AS digest
                  FROM ({_DOCUMENTS})))
        WHERE n_alike > 1 AND n_same = 1""",
    "rescan_incremental": _members(_DOCUMENTS),
    "rescan_groups": f"""
        SELECT size_bytes, digest, count(*)::BIGINT AS n_files FROM ({_NOW}) WHERE content IS NOT NULL
        GROUP BY ALL HAVING count(*) > 1""",
    "rescan_touched_groups": f"""
        SELECT size_bytes, digest, coalesce(o.n, 0)::BIGINT AS n_before, coalesce(c.n, 0)::BIGINT AS n_files
        FROM (SELECT size_bytes, digest, count(*) AS n FROM ({_BEFORE}) GROUP BY ALL) o
        FULL JOIN (SELECT size_bytes, digest, count(*) AS n FROM ({_NOW}) WHERE content IS NOT NULL GROUP BY ALL) c
        USING (size_bytes, digest) WHERE o.n IS DISTINCT FROM c.n""",
    "rescan_differences": f"""
        SELECT coalesce(c.path, o.path) AS path,
               CASE WHEN c.path IS NULL THEN 'gone' WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS state,
               CASE WHEN c.path IS NOT NULL AND content IS NULL THEN 'no content' END AS error
        FROM ({_BEFORE}) o FULL JOIN ({_NOW}) c USING (path)
        WHERE c.path IS NULL OR o.path IS NULL OR o.version <> 1""",
    # With several files per turn the first item of a content may be any of it.
    "arriving_duplicates": f"""
        SELECT path, size_bytes, digest, false AS late FROM (
            SELECT *, row_number() OVER (PARTITION BY size_bytes, digest ORDER BY doc_id % 4, doc_id % 10000000, path) AS turn
            FROM (SELECT path, size_bytes, sha256(content) AS digest, name[:-5]::BIGINT AS doc_id FROM ({_DOCUMENTS})))
        WHERE turn > 1""",
    "space_savings": f"SELECT {_SAVINGS} FROM ({_groups(_DOCUMENTS)})",
    "space_savings_empty": f"SELECT {_SAVINGS} FROM ({_groups(_DOCUMENTS, 'size_bytes <= -1')})",
    "scan_summary": f"""
        SELECT *, {_size_text('total_bytes')} AS total_text, {_size_text('reclaimable_bytes')} AS reclaimable_text
        FROM (SELECT count(*)::BIGINT AS n_groups, coalesce(sum(n_files), 0)::BIGINT AS n_files, {_SAVINGS}
              FROM ({_groups(_DOCUMENTS)}))""",
    "scan_funnel": _funnel(_ADAPTIVE),
    "scan_funnel_observed": _funnel(_ADAPTIVE),
    "scan_funnel_observed_short_prefix": _funnel("content[1:4]"),
    "scan_audit_one_pass": _AUDIT,
    "scan_funnel_short_prefix": _funnel("content[1:4]"),
    "corpus_stats": f"""
        SELECT count(DISTINCT (size_bytes, digest))::BIGINT AS unique_files,
               (count(*) - count(DISTINCT (size_bytes, digest)))::BIGINT AS duplicate_files,
               count(*)::BIGINT AS total_files, sum(size_bytes)::BIGINT AS total_bytes,
               count(DISTINCT regexp_replace(path, '/[^/]*$', ''))::BIGINT AS directories
        FROM ({_digested(_DOCUMENTS)})""",
    "format_bytes": f"""
        SELECT o_orderkey, {_size_text('o_orderkey')} AS small_text,
               {_size_text('o_orderkey * o_custkey')} AS medium_text,
               {_size_text('o_orderkey * o_custkey * 1024 * 1024')} AS large_text,
               {_size_text('o_orderkey * 1024 * 1024 * 1024 * 512')} AS huge_text,
               {_size_text('-o_orderkey')} AS negative_text
        FROM orders""",
    "detail_report": _details(_NUMBERED),
    "detail_report_pieces": _details(_numbered(_planted(_DOCUMENTS))),
    "result_table": _RESULT_TABLE,
    "result_table_by_size": f"SELECT * FROM ({_RESULT_TABLE}) ORDER BY size_bytes DESC",
    "groups_sorted": f"SELECT * FROM ({_groups(_DOCUMENTS)}) ORDER BY size_bytes, digest",
    "path_filter": f"SELECT * FROM ({_members(_DOCUMENTS)}) WHERE contains(lower(path), 'src1')",
    "path_search": f"SELECT * FROM ({_members(_DOCUMENTS)}) WHERE contains(lower(path), 'src1')",
    "result_pages": f"""
        SELECT position, size_bytes, path FROM (
            SELECT (row_number() OVER (ORDER BY size_bytes DESC, digest, path) - 1)::BIGINT AS position, size_bytes, path
            FROM ({_members(_DOCUMENTS)}))
        WHERE position // 10 % 3 = 0""",
    "removal_manifest": _manifest("path"),
    "removal_manifest_shortest": _manifest("length(path), path"),
    "removal_survivors": f"""
        SELECT path, size_bytes, digest FROM ({_digested(_DOCUMENTS)})
        WHERE path NOT IN (SELECT path FROM ({_manifest('path')}))""",
    "removal_by_decision": _BY_DECISION,
    "report_by_decision": _BY_DECISION,
    "invalid_decisions": f"""
        SELECT DISTINCT size_bytes, digest, raw_choice AS choice FROM ({_DECIDED}) WHERE raw_choice IN ('1,x', '')""",
    "removal_selected": _selected("picked AND NOT (all_picked AND path = first_path)"),
    "removal_selected_unguarded": _selected("picked"),
    "export_json_written": _nested(2, "size_bytes, hash, part, paths"),
    "export_csv_written": f"SELECT size_bytes, digest AS hash, path FROM ({_members(_DOCUMENTS)})",
    "export_csv_odd_paths": f"SELECT size_bytes, digest AS hash, path FROM ({_members(_ODDLY_NAMED)})",
    "export_json_rows": _nested(10_000, "size_bytes, hash, part, paths"),
    "export_csv_rows": f"SELECT size_bytes, digest AS hash, path FROM ({_members(_DOCUMENTS)})",
}
