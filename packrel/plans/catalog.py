"""Registered queries, one for each family of operators, over relations made of the driver's tables.

Limits are lowered, as the default ones are out of reach of these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packrel.config import CreationConfig, ExtractionOptions, SecurityConfig
from packrel.functions import checks as C
from packrel.functions import errors as E
from packrel.functions import paths as P
from packrel.functions import units as U
from packrel.operators import joins, reports, verify, windows
from packrel.sources.detect import format_of

from . import planted
from .relations import ENTRIES_SQL, PAGES_SQL, entries_docs, entries_pages

LOW = SecurityConfig(max_file_size=9000, max_total_size=60_000, max_file_count=40)
LINKS = LOW.but(allow_symlinks=True, allow_hardlinks=True)
WITH = f"WITH {ENTRIES_SQL}"
_QUERIES: dict = {}
_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


BANNED_SQL = "['.git','.ssh','.gnupg','.aws','.kube','.docker','.env']"
#: The first rule that a path breaks, over parts (p, path).
PATH_CODE_SQL = f"""CASE WHEN path = '' THEN 'SECURITY_VIOLATION' WHEN starts_with(path, '.') AND len(p) = 0 THEN NULL
  WHEN starts_with(path, '/') THEN 'PATH_TRAVERSAL'
  WHEN dots > 0 AND (bans = 0 OR dots < bans) THEN 'PATH_TRAVERSAL' WHEN bans > 0 THEN 'SECURITY_VIOLATION'
  WHEN len(p) = 0 THEN 'PATH_TRAVERSAL' WHEN len(p) > 32 THEN 'SECURITY_VIOLATION' END"""
CHECKED_SQL = f"""{WITH},
q AS (SELECT *, coalesce(list_position(p, '..'), 0) AS dots, coalesce(list_position([list_contains({BANNED_SQL}, lower(x)) for x in p], true), 0) AS bans FROM parts),
c AS (SELECT *, {PATH_CODE_SQL} AS path_code,
  CASE WHEN compressed_size IS NULL THEN NULL WHEN compressed_size = 0 AND size > 0 THEN 'INVALID_ARCHIVE'
       WHEN compressed_size > 0 AND size::DOUBLE / compressed_size > 100 THEN 'ZIP_BOMB' END AS ratio_code,
  CASE WHEN mode IS NOT NULL AND mode & 3074 <> 0 THEN 'INVALID_PERMISSIONS' END AS mode_code,
  CASE WHEN size > 9000 THEN 'QUOTA_EXCEEDED' END AS size_code FROM q)"""
EXT_SQL = "CASE WHEN len(p) > 0 AND p[-1] <> '..' AND regexp_matches(p[-1], '^.+\\.[^.]*$') THEN string_split(p[-1], '.')[-1] END"


@query(f"{WITH} SELECT archive, entry_idx, CASE WHEN lower(x) IN ('gz') THEN CASE WHEN regexp_matches(lower(path), '\\.tar\\.gz$') THEN 'TarGz' END WHEN lower(x) = 'zip' THEN 'Zip' WHEN lower(x) = 'tar' THEN 'Tar' END AS format FROM (SELECT *, {EXT_SQL} AS x FROM parts)")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_docs(spark, sf_dir).select("archive", "entry_idx", format_of(F.col("path")).alias("format"))


@query(f"{WITH} SELECT entry_idx, array_to_string(p, '/') AS normalized, len([x for x in p if x <> '..'])::INTEGER AS depth, CASE WHEN len(p) > 0 AND p[-1] <> '..' THEN p[-1] END AS file_name, {EXT_SQL} AS extension, starts_with(path, '/') AS is_absolute, list_contains(p, '..') AS climbs FROM parts")
def path_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return entries_docs(spark, sf_dir).select(
        "entry_idx", P.normalized(p).alias("normalized"), P.depth(p).alias("depth"), P.file_name(p).alias("file_name"),
        P.extension(p).alias("extension"), P.is_absolute(p).alias("is_absolute"), P.has_parent_step(p).alias("climbs"),
    )


@query(f"""{CHECKED_SQL} SELECT entry_idx, path_code AS code, CASE WHEN path_code = 'PATH_TRAVERSAL' THEN 'path traversal detected: ' || path
  WHEN path = '' THEN 'operation denied by security policy: empty path not allowed'
  WHEN path_code = 'SECURITY_VIOLATION' AND bans > 0 THEN 'operation denied by security policy: banned path component: ' || p[bans]
  WHEN path_code = 'SECURITY_VIOLATION' THEN 'operation denied by security policy: path depth ' || len(p) || ' exceeds maximum 32' END AS message FROM c""")
def path_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_docs(spark, sf_dir).withColumn("e", C.path_error(F.col("path"), LOW))
    return e.select("entry_idx", F.col("e.code").alias("code"), F.col("e.message").alias("message"))


@query(f"{WITH} SELECT archive, entry_idx, path FROM (SELECT *, {EXT_SQL} AS x FROM parts) WHERE coalesce(lower(x) IN ('txt', 'gz'), false)")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = C.extension_allowed(F.col("path"), LOW.but(allowed_extensions=("TXT", "gz")))
    return entries_docs(spark, sf_dir).filter(keep).select("archive", "entry_idx", "path")


@query(f"{CHECKED_SQL} SELECT entry_idx, p[bans] AS banned FROM c WHERE bans > 0")
def banned_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = P.components(F.col("path"))
    at = P.first_where(parts, lambda c: P.is_banned(c, LOW.banned_path_components))
    return entries_docs(spark, sf_dir).filter(at > 0).select("entry_idx", F.try_element_at(parts, at.cast("int")).alias("banned"))


@query(f"""{WITH} SELECT entry_idx, path FROM parts WHERE NOT (coalesce(starts_with(p[-1], '.') AND p[-1] <> '..' AND len(p) > 0, false)
  OR path = '.git' OR list_contains(p, '.git') OR ends_with(path, '.exe') OR len([x for x in p if ends_with(x, '.exe')]) > 0
  OR starts_with(path, 'fr') OR len([x for x in p if starts_with(x, 'fr')]) > 0)""")
def exclude_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_docs(spark, sf_dir).filter(~P.is_excluded(F.col("path"), (".git", "*.exe", "fr*"))).select("entry_idx", "path")


@query(f"{WITH} SELECT entry_idx, CASE WHEN p[1] = 'en' THEN array_to_string(p[2:], '/') ELSE path END AS archive_path FROM parts")
def archive_path_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_docs(spark, sf_dir).select("entry_idx", P.strip_prefix(F.col("path"), "en/").alias("archive_path"))


@query(f"{CHECKED_SQL} SELECT entry_idx, ratio_code AS code, size::DOUBLE / nullif(compressed_size, 0)::DOUBLE AS ratio FROM c")
def ratio_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reports.entry_ratio(entries_docs(spark, sf_dir))
    return e.select("entry_idx", C.ratio_error(F.col("compressed_size"), F.col("size"), LOW)["code"].alias("code"), "ratio")


@query(f"{CHECKED_SQL} SELECT entry_idx, (mode & 1021)::INTEGER AS mode, mode_code AS code, CASE WHEN mode IS NOT NULL THEN '0o' || CASE mode WHEN 420 THEN '644' WHEN 493 THEN '755' WHEN 2541 THEN '4755' WHEN 438 THEN '666' ELSE '777' END END AS octal FROM c")
def mode_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_docs(spark, sf_dir)
    return e.select(
        "entry_idx", C.sanitized_mode(F.col("mode"), LOW).alias("mode"), C.mode_error(F.col("path"), F.col("mode"), LOW)["code"].alias("code"), E.octal(F.col("mode")).alias("octal")
    )


#: A target is followed from the link's folder; its lowest point, from which the root is left.
LINK_SQL = f"""{CHECKED_SQL},
t AS (SELECT *, [x for x in string_split(coalesce(symlink_target, ''), '/') if x <> '' AND x <> '.'] AS tp, greatest(len(p) - 1, 0) AS pd FROM c),
u AS (SELECT *, pd + coalesce(list_min([2 * len([y for y in tp[1:n] if y <> '..']) - n for n in range(1, len(tp) + 1)]), 0) AS lowest FROM t),
s AS (SELECT *, CASE WHEN symlink_target = '' THEN 'SECURITY_VIOLATION' WHEN starts_with(symlink_target, '/') THEN 'SYMLINK_ESCAPE' WHEN lowest < 0 THEN 'SYMLINK_ESCAPE' END AS link_code FROM u)"""


@query(f"{LINK_SQL} SELECT entry_idx, link_code AS code FROM s WHERE entry_type = 'Symlink'")
def symlink_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_docs(spark, sf_dir).filter("entry_type = 'Symlink'")
    return e.select("entry_idx", C.symlink_error(F.col("path"), F.col("symlink_target"), LINKS)["code"].alias("code"))


@query(f"""{WITH}, f AS (SELECT archive, array_to_string(p, '/') AS t, arg_max(size, entry_idx) AS s, max(entry_idx) AS idx FROM parts WHERE entry_type = 'File' GROUP BY ALL)
SELECT e.entry_idx, f.idx AS target_idx, f.s AS target_size, CASE WHEN f.idx IS NULL THEN 'INVALID_ARCHIVE' END AS code
FROM entries e LEFT JOIN f ON e.archive = f.archive AND e.hardlink_target = f.t WHERE entry_type = 'Hardlink'""")
def hardlink_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.hardlink_targets(entries_docs(spark, sf_dir)).select("entry_idx", "target_idx", "target_size", F.col("error.code").alias("code"))


QUOTA_SQL = f"""{WITH}, r AS (SELECT *, sum(CASE WHEN size <= 9000 THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN size <= 9000 THEN size ELSE 0 END) OVER w AS s
FROM entries WINDOW w AS (PARTITION BY archive ORDER BY entry_idx ROWS UNBOUNDED PRECEDING)),
qq AS (SELECT *, CASE WHEN size > 9000 THEN 'quota exceeded: single file size (' || size || ' > 9000)' WHEN n > 40 THEN 'quota exceeded: file count (' || n || ' > 40)'
  WHEN s > 60000 THEN 'quota exceeded: total size (' || s || ' > 60000)' END AS message FROM r)"""


@query(f"{QUOTA_SQL} SELECT archive, entry_idx, n::BIGINT AS running_files, s::BIGINT AS running_size, message FROM qq")
def quota_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = windows.quota(entries_docs(spark, sf_dir), LOW)
    return q.select("archive", "entry_idx", F.col("running_files").cast("long").alias("running_files"), F.col("running_size").cast("long").alias("running_size"), F.col("quota_error.message").alias("message"))


@query(f"{QUOTA_SQL} SELECT archive, min(entry_idx) AS entry_idx, arg_min(message, entry_idx) AS message FROM qq WHERE message IS NOT NULL GROUP BY archive")
def quota_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = windows.first_errors(windows.quota(entries_docs(spark, sf_dir), LOW), "quota_error")
    return q.select("archive", "entry_idx", F.col("error.message").alias("message"))


@query(f"{QUOTA_SQL} SELECT q.archive, q.entry_idx FROM qq q LEFT JOIN (SELECT archive, min(entry_idx) AS m FROM qq WHERE message IS NOT NULL GROUP BY archive) x ON q.archive = x.archive WHERE m IS NULL OR entry_idx < m")
def cut_at_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cut_at_first_error(windows.quota(entries_docs(spark, sf_dir), LOW), "quota_error").select("archive", "entry_idx")


def _dedup_sql(which: str) -> str:
    return f"{WITH} SELECT archive, path, {which}(entry_idx) AS entry_idx, count(*) AS n_writes FROM entries GROUP BY archive, path"


@query(_dedup_sql("min"))
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dedup(entries_docs(spark, sf_dir)).select("archive", "path", "entry_idx", "n_writes")


@query(_dedup_sql("max"))
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dedup(entries_docs(spark, sf_dir), "last").select("archive", "path", "entry_idx", "n_writes")


@query(f"{WITH}, n AS (SELECT archive, path, count(*) - 1 AS n FROM entries GROUP BY ALL), t AS (SELECT archive, sum(n)::BIGINT AS skipped FROM n GROUP BY archive) SELECT archive, skipped, CASE WHEN skipped = 1 THEN 'skipped 1 duplicate entry' WHEN skipped > 1 THEN 'skipped ' || skipped || ' duplicate entries' END AS warning FROM t")
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.skipped_duplicates(entries_docs(spark, sf_dir))


def _destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A destination listing: the paths of every third entry."""
    return entries_docs(spark, sf_dir).filter("entry_idx % 3 = 0").select("path")


_DEST = f"{WITH}, dest AS (SELECT DISTINCT array_to_string(p, '/') AS t FROM parts WHERE entry_idx % 3 = 0)"


@query(f"{_DEST} SELECT entry_idx, path FROM parts WHERE entry_type = 'File' AND array_to_string(p, '/') IN (SELECT t FROM dest)")
def conflict_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.conflicts(entries_docs(spark, sf_dir), _destination(spark, sf_dir)).select("entry_idx", "path")


@query(f"{_DEST} SELECT entry_idx, path FROM parts WHERE array_to_string(p, '/') NOT IN (SELECT t FROM dest)")
def existing_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without_existing(entries_docs(spark, sf_dir), _destination(spark, sf_dir)).select("entry_idx", "path")


@query(f"{_DEST} SELECT DISTINCT path FROM parts WHERE entry_type = 'File' AND array_to_string(p, '/') IN (SELECT t FROM dest) ORDER BY path LIMIT 10")
def conflict_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_conflicts(entries_docs(spark, sf_dir), _destination(spark, sf_dir))[0]


@query(f"{WITH} SELECT archive, count(*) AS total_entries, sum(size)::BIGINT AS total_size FROM entries GROUP BY archive")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.manifests(entries_docs(spark, sf_dir)).select("archive", "total_entries", F.col("total_size").cast("long").alias("total_size"))


#: code -> severity and category, over issues (code).
_SEVERITY = "CASE code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, (s, _, _) in E.ISSUES.items()) + " END"
_CATEGORY = "CASE code " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, (_, g, _) in E.ISSUES.items()) + " END"
ISSUES_SQL = LINK_SQL.replace(CHECKED_SQL, CHECKED_SQL.replace("CASE WHEN size > 9000 THEN 'QUOTA_EXCEEDED' END AS size_code FROM q", "qq2.qcode AS size_code FROM q JOIN qq2 USING (archive, entry_idx)").replace("q AS (SELECT *", QUOTA_SQL[len(WITH) + 1 :] + ", qq2 AS (SELECT archive, entry_idx, CASE WHEN message IS NOT NULL THEN 'QUOTA_EXCEEDED' END AS qcode FROM qq), q AS (SELECT *", 1)) + f""",
h AS (SELECT *, [x for x in string_split(coalesce(hardlink_target, ''), '/') if x <> ''] AS hp FROM s),
a0 AS (SELECT archive, entry_idx, size, [path_code, size_code, ratio_code,
    CASE WHEN entry_type = 'Symlink' AND path_code IS NULL THEN coalesce(CASE WHEN symlink_target = '' THEN 'SECURITY_VIOLATION' END, link_code) END,
    CASE WHEN entry_type = 'Hardlink' AND path_code IS NULL AND list_contains(hp, '..') THEN 'HARDLINK_ESCAPE' END, mode_code,
    CASE WHEN entry_type = 'File' AND mode & 73 <> 0 THEN 'x-exec' END, CASE WHEN {EXT_SQL} IN ('exe', 'dll', 'sh', 'bat', 'cmd') THEN 'x-ext' END] AS l FROM h),
a AS (SELECT archive, entry_idx, size, unnest(l) AS code, generate_subscripts(l, 1) AS pos FROM a0),
i AS (SELECT archive, entry_idx, pos, CASE code WHEN 'x-exec' THEN 'Low' WHEN 'x-ext' THEN 'Info' ELSE {_SEVERITY} END AS severity,
    CASE code WHEN 'x-exec' THEN 'ExecutableFile' WHEN 'x-ext' THEN 'SuspiciousPath' ELSE {_CATEGORY} END AS category FROM a WHERE code IS NOT NULL)"""
_RANK = "CASE severity WHEN 'Info' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END"
REPORT_SQL = f"""{ISSUES_SQL},
o AS (SELECT archive, count(*) AS total_entries, sum(size)::BIGINT AS total_size FROM entries GROUP BY archive),
w AS (SELECT archive, max({_RANK}) AS worst, max({_RANK}) FILTER (category IN ('PathTraversal', 'SymlinkEscape', 'HardlinkEscape', 'ZipBomb', 'InvalidPermissions', 'QuotaExceeded')) AS sec,
    count(*) AS n_issues, count(DISTINCT entry_idx) FILTER ({_RANK} >= 2) AS suspicious FROM i GROUP BY archive)
SELECT o.archive, CASE WHEN worst >= 3 THEN 'FAIL' WHEN worst = 2 THEN 'WARNING' ELSE 'PASS' END AS status, 'OK' AS integrity_status,
  CASE WHEN sec >= 3 THEN 'FAILED' WHEN sec IS NOT NULL THEN 'WARNING' ELSE 'OK' END AS security_status,
  total_entries, coalesce(suspicious, 0) AS suspicious_entries, total_size, coalesce(n_issues, 0) AS n_issues FROM o LEFT JOIN w USING (archive)"""


@query(f"{ISSUES_SQL} SELECT archive, entry_idx, severity, category FROM i")
def issues_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.issues(entries_docs(spark, sf_dir), LINKS).select("archive", "entry_idx", "severity", "category")


@query(f"{ISSUES_SQL} SELECT archive, entry_idx, severity, category, row_number() OVER (PARTITION BY archive ORDER BY {_RANK} DESC, entry_idx, pos)::INTEGER AS place FROM i")
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.placed(verify.issues(entries_docs(spark, sf_dir), LINKS)).select("archive", "entry_idx", "severity", "category", "place")


@query(f"""{ISSUES_SQL} SELECT e.archive, count(i.severity) FILTER (severity = 'Critical') AS n_critical, count(i.severity) FILTER (severity = 'High') AS n_high, count(i.severity) FILTER (severity = 'Medium') AS n_medium,
  count(i.severity) FILTER (severity = 'Low') AS n_low, count(i.severity) FILTER (severity = 'Info') AS n_info, count(i.severity) FILTER (severity = 'Critical') > 0 AS has_critical,
  count(i.severity) FILTER (severity IN ('Critical', 'High', 'Medium')) = 0 AS is_safe FROM (SELECT DISTINCT archive FROM entries) e LEFT JOIN i ON e.archive = i.archive GROUP BY e.archive""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.severity_counts(entries_docs(spark, sf_dir), LINKS)


@query(REPORT_SQL)
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = verify.reports(entries_docs(spark, sf_dir), LINKS)
    return r.withColumn("total_size", F.col("total_size").cast("long"))


@query(f"{REPORT_SQL.rpartition('SELECT o.archive')[0]} SELECT archive, CASE WHEN sec >= 3 THEN 'FAILED' WHEN sec IS NOT NULL THEN 'WARNING' ELSE 'OK' END AS security_status FROM o LEFT JOIN w USING (archive)")
def security_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.reports(entries_docs(spark, sf_dir), LINKS).select("archive", "security_status")


@query(f"{ISSUES_SQL} SELECT DISTINCT archive, entry_idx FROM i WHERE {_RANK} >= 2")
def suspicious_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = verify.checked(entries_docs(spark, sf_dir), LINKS)
    bad = (F.size("entry_issues") > 0) | F.exists("heuristic_issues", lambda i: i["severity_rank"] >= 2)
    return e.filter(bad).select("archive", "entry_idx")


@query(f"{WITH} SELECT archive, entry_idx, len(p) AS depth FROM parts WHERE entry_type <> 'File' OR size > 20000")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_docs(spark, sf_dir).filter("entry_type <> 'File' OR size > 20000")
    return e.select("archive", "entry_idx", F.size(P.components(F.col("path"))).cast("long").alias("depth"))


_PLAN_SQL = f"""{LINK_SQL}, x AS (SELECT *, {EXT_SQL} AS ext FROM s),
y AS (SELECT *, entry_type = 'File' AND NOT coalesce(lower(ext) IN ('txt', 'exe', 'sh', 'gz'), false) AS left_out, [v for v in string_split(coalesce(hardlink_target, ''), '/') if v <> ''] AS hp FROM x),
z AS (SELECT *, entry_type = 'File' AND NOT left_out AS charged FROM y),
zz AS (SELECT *, sum(CASE WHEN charged AND size <= 9000 THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN charged AND size <= 9000 THEN size ELSE 0 END) OVER w AS sz FROM z WINDOW w AS (PARTITION BY archive ORDER BY entry_idx ROWS UNBOUNDED PRECEDING)),
plan AS (SELECT *, CASE WHEN left_out THEN 'skip_ext' WHEN entry_type = 'Directory' THEN 'mkdir' WHEN entry_type = 'Symlink' THEN 'symlink' WHEN entry_type = 'Hardlink' THEN 'hardlink' ELSE 'write' END AS action,
  CASE WHEN left_out THEN NULL ELSE coalesce(path_code, CASE entry_type WHEN 'File' THEN coalesce(CASE WHEN size > 9000 OR n > 40 OR sz > 60000 THEN 'QUOTA_EXCEEDED' END, ratio_code)
    WHEN 'Symlink' THEN link_code WHEN 'Hardlink' THEN CASE WHEN list_contains(hp, '..') THEN 'HARDLINK_ESCAPE' END ELSE ratio_code END) END AS code FROM zz)"""
EXTRACT = LINKS.but(allowed_extensions=("txt", "exe", "sh", "gz"))


@query(f"{_PLAN_SQL} SELECT archive, entry_idx, action, code FROM plan")
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.extraction_plan(entries_docs(spark, sf_dir), EXTRACT).select("archive", "entry_idx", "action", F.col("error.code").alias("code"))


@query(f"""{_PLAN_SQL}, st AS (SELECT archive, min(entry_idx) AS stop, arg_min(code, entry_idx) AS error_code FROM plan WHERE code IS NOT NULL GROUP BY archive),
f AS (SELECT plan.* FROM plan LEFT JOIN st USING (archive) WHERE stop IS NULL OR entry_idx < stop),
wr AS (SELECT archive, array_to_string(p, '/') AS t, count(*) AS n, arg_min(size, entry_idx) AS first_size FROM f WHERE action = 'write' GROUP BY ALL),
wa AS (SELECT archive, count(*) AS files_extracted, sum(first_size)::BIGINT AS bytes_written, (sum(n) - count(*))::BIGINT AS duplicates_skipped FROM wr GROUP BY archive),
ot AS (SELECT archive, count(*) FILTER (action = 'mkdir') AS directories_created, count(*) FILTER (action = 'symlink') AS symlinks_created, count(*) FILTER (action = 'hardlink') AS hardlinks_deferred,
  count(*) FILTER (action = 'skip_ext') AS extensions_skipped FROM f GROUP BY archive),
b AS (SELECT a.archive, coalesce(files_extracted, 0) AS files_extracted, coalesce(bytes_written, 0) AS bytes_written, coalesce(duplicates_skipped, 0) AS duplicates_skipped, coalesce(directories_created, 0) AS directories_created,
  coalesce(symlinks_created, 0) AS symlinks_created, coalesce(hardlinks_deferred, 0) AS hardlinks_deferred, coalesce(extensions_skipped, 0) AS extensions_skipped, error_code
  FROM (SELECT DISTINCT archive FROM plan) a LEFT JOIN wa USING (archive) LEFT JOIN ot USING (archive) LEFT JOIN st USING (archive))
SELECT *, duplicates_skipped + extensions_skipped AS files_skipped, error_code IS NOT NULL AND files_extracted + directories_created + symlinks_created + duplicates_skipped + extensions_skipped > 0 AS partial FROM b""")
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries, hostile paths, links and ratios included."""
    return reports.extraction_report(entries_docs(spark, sf_dir), EXTRACT, ExtractionOptions()).drop("error_message").withColumn("bytes_written", F.col("bytes_written").cast("long"))


CREATE = CreationConfig(exclude_patterns=(".git", "*.exe"), max_file_size=9000)


@query(f"""{WITH}, k2 AS (SELECT * FROM parts WHERE NOT (coalesce(starts_with(p[-1], '.') AND p[-1] <> '..' AND len(p) > 0, false) OR path = '.git' OR list_contains(p, '.git') OR ends_with(path, '.exe') OR len([x for x in p if ends_with(x, '.exe')]) > 0)
  AND (entry_type <> 'File' OR size <= 9000)),
m AS (SELECT archive, count(*) FILTER (entry_type = 'File') AS files_added, count(*) FILTER (entry_type = 'Directory') AS directories_added, count(*) FILTER (entry_type = 'Symlink') AS symlinks_added,
  coalesce(sum(size) FILTER (entry_type = 'File'), 0)::BIGINT AS bytes_written, coalesce(sum(coalesce(compressed_size, size)) FILTER (entry_type = 'File'), 0)::BIGINT AS bytes_compressed FROM k2 GROUP BY archive),
t2 AS (SELECT archive, count(*) AS n FROM entries GROUP BY archive),
b AS (SELECT archive, n, coalesce(files_added, 0) AS files_added, coalesce(directories_added, 0) AS directories_added, coalesce(symlinks_added, 0) AS symlinks_added, coalesce(bytes_written, 0) AS bytes_written, coalesce(bytes_compressed, 0) AS bytes_compressed FROM t2 LEFT JOIN m USING (archive))
SELECT archive, files_added, directories_added, symlinks_added, files_added + directories_added + symlinks_added AS total_items, bytes_written, bytes_compressed, n - files_added - directories_added - symlinks_added AS files_skipped,
  CASE WHEN bytes_written = 0 OR bytes_compressed = 0 THEN 0.0 ELSE bytes_written::DOUBLE / bytes_compressed::DOUBLE END::DOUBLE AS compression_ratio,
  CASE WHEN bytes_written = 0 THEN 0.0 WHEN bytes_compressed = 0 THEN 100.0 ELSE greatest(bytes_written::DOUBLE - bytes_compressed::DOUBLE, 0) / bytes_written::DOUBLE * 100 END::DOUBLE AS compression_percentage FROM b""")
def creation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_docs(spark, sf_dir)
    return reports.creation_report(reports.creation_plan(e, CREATE), e)


@query(f"""{_PLAN_SQL} SELECT archive, count(*) FILTER (entry_type = 'File') AS files_validated, coalesce(sum(size) FILTER (entry_type = 'File'), 0)::BIGINT AS total_bytes,
  count(DISTINCT hardlink_target) FILTER (entry_type = 'Hardlink') AS hardlinks_tracked FROM plan WHERE code IS NULL AND action <> 'skip_ext' GROUP BY archive""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.validation_report(entries_docs(spark, sf_dir), EXTRACT).withColumn("total_bytes", F.col("total_bytes").cast("long"))


@query("""SELECT * FROM (VALUES
('PATH_TRAVERSAL', 'Critical', 'PathTraversal', 'PathTraversal', true, true), ('SYMLINK_ESCAPE', 'Critical', 'SymlinkEscape', 'SymlinkEscape', true, true),
('HARDLINK_ESCAPE', 'Critical', 'HardlinkEscape', 'HardlinkEscape', true, true), ('ZIP_BOMB', 'Critical', 'ZipBomb', 'ZipBomb', true, false),
('QUOTA_EXCEEDED', 'High', 'QuotaExceeded', 'QuotaExceeded', true, false), ('INVALID_PERMISSIONS', 'Medium', 'InvalidPermissions', 'InvalidPermissions', true, true),
('IO_ERROR', 'High', 'InvalidArchive', 'Io', false, false), ('INVALID_ARCHIVE', 'High', 'InvalidArchive', 'InvalidArchive', false, false),
('SECURITY_VIOLATION', 'High', 'SuspiciousPath', 'SecurityViolation', true, true), ('SOURCE_NOT_FOUND', 'High', 'InvalidArchive', 'SourceNotFound', false, false),
('SOURCE_NOT_ACCESSIBLE', 'High', 'InvalidArchive', 'SourceNotAccessible', false, false), ('OUTPUT_EXISTS', 'Medium', 'InvalidArchive', 'OutputExists', false, false),
('INVALID_COMPRESSION_LEVEL', 'Medium', 'InvalidArchive', 'InvalidCompressionLevel', false, false), ('UNKNOWN_FORMAT', 'High', 'InvalidArchive', 'UnknownFormat', false, false),
('INVALID_CONFIGURATION', 'High', 'InvalidArchive', 'InvalidConfiguration', false, false)) t(code, severity, category, kind, is_security, is_recoverable)""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    codes = spark.range(len(E.ISSUES)).select(F.array(*map(F.lit, E.ISSUES))[F.col("id").cast("int")].alias("code"))
    return codes.select("code", E.severity_of(c).alias("severity"), E.category_of(c).alias("category"), E.kind_of(c).alias("kind"), E.is_security(c).alias("is_security"), E.is_recoverable(c).alias("is_recoverable"))


@query(f"""{WITH} SELECT entry_idx, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024::DOUBLE) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576::DOUBLE)
  WHEN s < 1099511627776 THEN printf('%.1f GB', s / 1073741824::DOUBLE) ELSE printf('%.1f TB', s / 1099511627776::DOUBLE) END AS shown FROM (SELECT entry_idx, (size * (1::BIGINT << (entry_idx % 34)::INTEGER))::BIGINT AS s FROM entries)""")
def humanize_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size") * F.pow(F.lit(2.0), F.col("entry_idx") % 34).cast("long")
    return entries_docs(spark, sf_dir).select("entry_idx", U.humanize_bytes(size).alias("shown"))


@query(f"{WITH} SELECT archive, sum(size)::BIGINT AS solid_size, CASE WHEN archive < 'src2' THEN CASE WHEN sum(size) > 100000 THEN 'SECURITY_VIOLATION' END END AS code FROM entries GROUP BY archive")
def solid_memory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_docs(spark, sf_dir).withColumn("is_solid", F.col("archive") < "src2")
    r = reports.solid_check(e, LOW.but(allow_solid_archives=True, max_solid_block_memory=100_000))
    return r.select("archive", F.col("solid_size").cast("long").alias("solid_size"), F.col("error.code").alias("code"))


@query(f"{WITH}, {PAGES_SQL} SELECT 0 AS source_idx, archive, entry_idx, path, size FROM entries UNION ALL SELECT 1, archive, entry_idx, path, size FROM pages_e")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = joins.union_sources(entries_docs(spark, sf_dir), entries_pages(spark, sf_dir))
    return u.select("source_idx", "archive", "entry_idx", "path", "size")


_HOST = "('SOURCE_NOT_FOUND', 'SOURCE_NOT_ACCESSIBLE', 'OUTPUT_EXISTS', 'UNKNOWN_FORMAT')"


@query(f"""{WITH} SELECT entry_idx, code, CASE WHEN code IN {_HOST} THEN string_split(regexp_replace(path, '/+$', ''), '/')[-1] ELSE path END AS shown
FROM (SELECT entry_idx, path, CASE WHEN entry_idx % 2 = 0 THEN 'OUTPUT_EXISTS' ELSE 'PATH_TRAVERSAL' END AS code FROM entries)""")
def redacted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries_docs(spark, sf_dir).withColumn("code", F.when(F.col("entry_idx") % 2 == 0, "OUTPUT_EXISTS").otherwise("PATH_TRAVERSAL"))
    return e.select("entry_idx", "code", E.redacted_path(F.col("code"), F.col("path")).alias("shown"))


@query(f"{CHECKED_SQL} SELECT archive, entry_idx, CASE WHEN entry_type = 'File' AND mode & 73 <> 0 THEN 1 ELSE 0 END + CASE WHEN {EXT_SQL} IN ('exe', 'dll', 'sh', 'bat', 'cmd') THEN 1 ELSE 0 END AS n_heuristics FROM c")
def heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = verify.checked(entries_docs(spark, sf_dir), LINKS)
    return e.select("archive", "entry_idx", F.size("heuristic_issues").alias("n_heuristics"))


@query(f"""{QUOTA_SQL}, l AS (SELECT q.archive, q.entry_idx, message, parts.path, parts.p, parts.entry_type, parts.symlink_target FROM qq q JOIN parts ON parts.entry_idx = q.entry_idx)
SELECT archive, entry_idx, CASE WHEN message IS NOT NULL THEN 'QUOTA_EXCEEDED' WHEN list_contains(p, '..') OR starts_with(path, '/') THEN 'PATH_TRAVERSAL' WHEN entry_type = 'Symlink' AND symlink_target = '' THEN 'INVALID_ARCHIVE' END AS code FROM l""")
def listing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listing(entries_docs(spark, sf_dir), LOW).select("archive", "entry_idx", F.col("error.code").alias("code"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id WHEN 1 THEN doc_id * 1024 WHEN 2 THEN doc_id * 1048576 WHEN 3 THEN doc_id * 1073741824 WHEN 4 THEN doc_id * 1099511627776 END::DECIMAL(20,0) AS n FROM documents")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as a command line takes them: plain, k, M, g, T, and one that isn't a size."""
    unit = F.array(*[F.lit(x) for x in ("", "k", "M", " g", "T ", "X")])[(F.col("doc_id") % 6).cast("int")]
    text = F.when(F.col("doc_id") % 6 == 3, F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("g"))).otherwise(F.concat(F.col("doc_id").cast("string"), unit))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", U.parse_byte_size(text).alias("n"))


_TRIP_SQL = "SELECT source AS archive, count(*) AS n, sum(strlen(text))::BIGINT AS total_size, count(*) AS same FROM documents GROUP BY source"


def scratch(spark: SparkSession) -> str:
    """The shared folder, as tasks open it; a temporary one only where all tasks are on this machine."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors share no folder")
        found = tempfile.mkdtemp(prefix="packrel-")
    return found.removeprefix("file://").replace("file:", "", 1) if found.startswith("file:") else found


def _round_trip(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """Writes an archive of each source's texts, one task each, and reads all of them back."""
    import uuid

    from packrel.sources.archive import read_archives
    from packrel.sources.writer import create_archives

    folder = f"{scratch(spark)}/trip-{uuid.uuid4().hex}"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select(
        F.concat(F.lit(f"{folder}/"), "source", F.lit(f".{ext}")).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("archive_path"), F.col("doc_id").alias("entry_idx"),
        F.lit("File").alias("entry_type"), F.lit(0o644).alias("mode"), F.lit(None).cast("string").alias("symlink_target"), F.encode("text", "UTF-8").alias("content"),
    )
    spark.createDataFrame([(folder,)], "p string").foreach(_make_folder)
    create_archives(rows).count()
    back = read_archives(spark, folder, with_content=True).filter("scan_error IS NULL").select(F.regexp_extract("archive", r"([^/]*?)\.[^/]*$", 1).alias("archive"), "path", "size", "content")
    want = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("w"))
    both = back.join(want, "path", "left")
    return both.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("total_size"), F.sum(F.when(F.col("content") == F.col("w"), 1).otherwise(0)).cast("long").alias("same"))


def _make_folder(row) -> None:
    import os

    os.makedirs(row["p"], exist_ok=True)


@query(_TRIP_SQL)
def tar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "tar.gz")


@query(_TRIP_SQL)
def zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "zip")


_QUERIES |= planted._QUERIES
_SQL |= planted._SQL
