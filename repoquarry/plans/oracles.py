"""The registered queries as DuckDB statements, written apart from the operators they check."""

from __future__ import annotations

import re

from repoquarry.plans import fixtures as fx

_W = r"[\p{L}\p{N}_]"

_LANGUAGE = """CASE suffix WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
 WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go'
 WHEN '.rs' THEN 'rust' WHEN '.cpp' THEN 'cpp' WHEN '.c' THEN 'c' WHEN '.cs' THEN 'csharp' END"""

# File rows with suffix, language and walk order.
_F = f"""
f0 AS (SELECT file_id, repo_id, path, content, CAST(octet_length(encode(content)) AS BIGINT) AS bytes,
  lower(regexp_extract(path, '[^/]([.][^./]+)$', 1)) AS suffix, string_split(path, '/') AS walk FROM ({fx.FILES}) x),
f AS (SELECT *, {_LANGUAGE} AS language FROM f0),
p AS (SELECT * FROM f WHERE language IN ('python', 'javascript', 'typescript', 'java'))
"""


def _all(*patterns: str) -> str:
    found = ", ".join(f"regexp_extract_all(content, '{p.replace('W', _W)}', 1)" for p in patterns)
    return f"list_sort(list_distinct(flatten([{found}])))"


_QUOTE = "[\"'']([^\"'']+)[\"'']"
_JS = {
    "functions": _all(
        r"function\s+(W+)\s*\(",
        r"const\s+(W+)\s*=\s*(?:\([^)]*\)\s*=>|function)",
        r"(W+)\s*:\s*(?:\([^)]*\)\s*=>|function)",
    ),
    "classes": _all(r"(?:export\s+)?class\s+(W+)"),
    "imports": _all(r"import\s+.*?\s+from\s+" + _QUOTE, r"require\s*\([\"'']([^\"'']+)[\"'']"),
}
_JAVA = {
    "functions": _all(r"(?:public|private|protected)?\s*W+\s+(W+)\s*\([^)]*\)\s*\{"),
    "classes": _all(r"(?:public\s+)?class\s+(W+)"),
    "imports": _all(r"import\s+([\p{L}\p{N}_.]+)"),
}
_PY = {
    "functions": "['m' || file_id]",
    "classes": "['C' || file_id]",
    "imports": "['os']",
}


def _kind(kind: str) -> str:
    return f"""CASE WHEN bytes > {fx.MAX_FILE_BYTES} THEN [] WHEN language = 'python' THEN {_PY[kind]}
  WHEN language = 'java' THEN {_JAVA[kind]} ELSE {_JS[kind]} END AS {kind}"""


# File records under the lowered size limit. Python symbols follow from how the texts are built.
_REC = f"""{_F},
r AS (SELECT repo_id, path, walk, language, {_kind("functions")}, {_kind("classes")}, {_kind("imports")}, bytes,
  CASE WHEN bytes > {fx.MAX_FILE_BYTES} THEN 'file too large (>1MB)' END AS skipped,
  CASE WHEN bytes > {fx.MAX_FILE_BYTES} THEN 'skipped' ELSE 'scanned' END AS status FROM p)
"""


def _joined(pattern: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{pattern}', 1))), ',')"


def _unnest(cte: str, kind: str, columns: str, where: str) -> str:
    return f"WITH {cte} SELECT {columns}, unnest({kind}) AS name FROM p WHERE {where}"


# Members of the derived archives with their contents, in archive order.
_ARCHIVES = f"""
d AS (SELECT doc_id, text, 'uploads/a' || doc_id || CASE WHEN doc_id % 10 = 9 THEN '.tar' WHEN doc_id % 10 = 8 THEN '.ZIP' ELSE '.zip' END AS path,
  doc_id % 7 = 3 AS junk, doc_id % 10 <> 9 AS zip FROM documents),
m0 AS (SELECT doc_id, 0 AS ordinal, 'src/' AS name, '' AS content FROM d
 UNION ALL SELECT doc_id, 1, 'src/__init__.py', 'class A' || doc_id || ': pass' || chr(10) FROM d
 UNION ALL SELECT doc_id, 2, '.hidden', 'x' FROM d
 UNION ALL SELECT doc_id, 3, 'docs/text.md', text FROM d
 UNION ALL SELECT doc_id, 4, 'dup.txt', 'first' FROM d
 UNION ALL SELECT doc_id, 5, 'dup.txt', 'second' FROM d
 UNION ALL SELECT doc_id, 6, 'empty/', '' FROM d
 UNION ALL SELECT doc_id, 7, CASE doc_id % 11 WHEN 3 THEN '../a' || doc_id || '_x/evil.py' WHEN 5 THEN '/abs.py' ELSE './src//sub/../late.py' END,
  'pass' || chr(10) FROM d WHERE doc_id % 11 IN (3, 5, 7)),
m AS (SELECT m0.*, d.path AS archive, d.zip, CAST(strlen(content) AS BIGINT) AS bytes, name LIKE '%/' AS is_dir,
  ordinal = 7 AND doc_id % 11 IN (3, 5) AS unsafe,
  CAST(sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS BIGINT) AS running
  FROM m0 JOIN d USING (doc_id) WHERE NOT d.junk),
len AS (SELECT doc_id, 5 + strlen(text) AS length FROM d WHERE junk
 UNION ALL SELECT doc_id, 22 + sum(76 + 2 * strlen(name) + bytes) FROM m GROUP BY doc_id),
bad AS (SELECT doc_id, arg_min(CASE WHEN unsafe THEN 'Invalid path in ZIP file: ' || name
   ELSE 'Zip too large after extraction: ' || printf('%.2f', running / 1048576.0::DOUBLE) || ' MB. Maximum allowed: {fx.MAX_EXTRACT_BYTES / 1048576:.2f} MB.' END, ordinal) AS error
  FROM m WHERE zip AND (unsafe OR running > {fx.MAX_EXTRACT_BYTES}) GROUP BY doc_id)
"""

_NOT_ZIP = "'Only .zip files are supported.'"

_URLS = rf"""
u0 AS (SELECT req_id, url, regexp_replace(url, '^\s+|\s+$', '', 'g') AS clean FROM ({fx.URL_REQUESTS}) x),
u AS (SELECT *, regexp_matches(clean, '(?i)^https?://github\.com/[\w-]+/[\w.-]+/?$')
  OR regexp_matches(clean, '(?i)^https?://github\.com/[\w-]+/[\w.-]+\.git$')
  OR regexp_matches(clean, '(?i)^git@github\.com:[\w-]+/[\w.-]+\.git$') AS is_valid,
  rtrim(clean, '/') AS bare FROM u0)
"""
_URL_ERROR = "CASE WHEN is_valid THEN '' ELSE 'Invalid GitHub URL format. Expected: https://github.com/username/repo' END"


def _name(url: str) -> str:
    path = (
        f"CASE WHEN {url} LIKE 'git@%' THEN string_split({url}, ':')[-1] ELSE "
        f"trim(regexp_replace(regexp_replace({url}, '[?#].*$', ''), '^[A-Za-z]+://[^/]*', ''), '/') END"
    )
    parts = f"string_split({path}, '/')"
    return f"CASE WHEN len({parts}) >= 2 THEN {parts}[-1] ELSE 'repo' END"


_NAME = _name("replace(bare, '.git', '')")

_MAN = f"man AS ({fx.GROUP_MANIFESTS})"
_DOC_MAN = f"man AS ({fx.DOC_MANIFESTS})"
_README = """
rd AS (SELECT repo_id, arg_min(path, o) AS path, arg_min(content, o) AS readme FROM (SELECT *, list_position(
  ['README.md', 'README.MD', 'README.txt', 'README', 'readme.md', 'readme.txt'], path) AS o FROM man) x WHERE o > 0 GROUP BY repo_id)
"""
_PACKAGE = """
pk AS (SELECT repo_id, content::JSON AS j FROM man WHERE path = 'package.json' AND json_valid(content))
"""
_REQ = r"""
rq0 AS (SELECT repo_id, arg_min(content, path = 'requirements-dev.txt') AS content FROM man
  WHERE path IN ('requirements.txt', 'requirements-dev.txt') GROUP BY repo_id),
rq AS (SELECT repo_id, list_transform(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(13)) <> '' AND NOT starts_with(x, '#')),
  lambda x: trim(x, ' ' || chr(13))) AS requirements FROM rq0)
"""


def _lines(text: str) -> str:
    return f"(CASE WHEN {text} LIKE '%' || chr(10) THEN string_split({text}, chr(10))[:-2] ELSE string_split({text}, chr(10)) END)"


def _dependencies(key: str, n: int) -> str:
    return f"""WITH {_DOC_MAN}, {_PACKAGE}, e AS (SELECT repo_id, json_keys(j, '$.{key}') AS names, j FROM pk)
SELECT repo_id, i AS pos, names[i + 1] AS name, json_extract_string(j, '$.{key}.' || names[i + 1]) AS version,
 CAST(len(names) AS BIGINT) AS total FROM (SELECT *, CAST(unnest(range(least(len(names), {n}))) AS INT) AS i FROM e) x"""


def _kb(column: str = "bytes") -> str:
    return f"printf('%.1f', {column} / 1024.0::DOUBLE)"


def _names(kind: str, label: str, n: int, glue: str = "chr(10) || ") -> str:
    return f"CASE WHEN len({kind}) > 0 THEN {glue}'{label}' || array_to_string({kind}[1:{n}], ', ') ELSE '' END"


_SUMMARY = f"""path || ' | Language: ' || language || CASE WHEN skipped IS NOT NULL THEN chr(10) || '  Skipped: ' || skipped
 ELSE {_names("functions", "  Functions: ", 10)} || {_names("classes", "  Classes: ", 10)} || {_names("imports", "  Imports: ", 10)} END"""


def _bullets(limit: int) -> str:
    return f"""
b0 AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY walk) AS rn, count(*) OVER (PARTITION BY repo_id) AS n,
  '- ' || path || ' [' || language || '] ' || CASE status WHEN 'skipped' THEN '(skipped)' ELSE '' END ||
  {_names("functions", "  - functions: ", 6)} || {_names("classes", "  - classes: ", 6)} || {_names("imports", "  - imports: ", 6)} AS line FROM r),
b AS (SELECT repo_id, string_agg(line, chr(10) ORDER BY rn) || CASE WHEN max(n) > {limit} THEN chr(10) || '... and ' || (max(n) - {limit}) || ' more files' ELSE '' END AS summary
  FROM b0 WHERE rn <= {limit} GROUP BY repo_id)"""


_STATS = f"""
st AS (SELECT repo_id, count(*) AS total_considered, count_if(status = 'scanned') AS scanned, count_if(status = 'skipped') AS skipped FROM r GROUP BY repo_id),
la AS (SELECT repo_id, language, count(*) AS n_files FROM p GROUP BY repo_id, language),
lg AS (SELECT * FROM (SELECT repo_id, path, bytes, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, walk) AS rank FROM f WHERE language IS NOT NULL) x WHERE rank <= 5),
ss AS (SELECT repo_id, 'total_considered: ' || total_considered || chr(10) || 'scanned: ' || scanned || chr(10) || 'skipped: ' || skipped || chr(10) ||
  'by_language: ' || (SELECT string_agg(language || ':' || n_files, ', ' ORDER BY language) FROM la WHERE la.repo_id = st.repo_id) || chr(10) || 'largest_files:' || chr(10) ||
  (SELECT string_agg('  - ' || path || ' (' || {_kb()} || ' KB)', chr(10) ORDER BY rank) FROM lg WHERE lg.repo_id = st.repo_id) AS summary FROM st)
"""


def _key_file_lines(section: int, files: int, names: int) -> str:
    """Lines of the key files with their place in the section, after its two heading lines."""
    return f"""
k0 AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY walk) AS rn FROM r WHERE status = 'scanned'),
k1 AS (SELECT repo_id, rn, list_filter(['', '### `' || path || '`', '- **Language:** ' || language,
   CASE WHEN len(classes) > 0 THEN '- **Classes:** ' || array_to_string(classes[1:{names}], ', ') END,
   CASE WHEN len(functions) > 0 THEN '- **Functions:** ' || array_to_string(functions[1:{names}], ', ') END], lambda x: x IS NOT NULL) AS lines FROM k0 WHERE rn <= {files}),
k2 AS (SELECT repo_id, ['', '## Key Files and Structure'] || flatten(list(lines ORDER BY rn)) AS lines FROM k1 GROUP BY repo_id),
k AS (SELECT repo_id, {section} AS section, lines FROM k2 UNION ALL
  SELECT repo_id, {section}, ['', '## Key Files and Structure'] FROM (SELECT DISTINCT repo_id FROM f) x WHERE repo_id NOT IN (SELECT repo_id FROM k2))"""


_REPORT = f"""WITH {_REC}, {_STATS}, {_MAN}, {_README}, {_PACKAGE}, {_REQ}, {_key_file_lines(8, 30, 5)},
repos AS (SELECT DISTINCT repo_id FROM f),
secs AS (
 SELECT repo_id, 0 AS section, ['# Project Documentation', '', '*Generated on 2026-01-02 03:04:05*', ''] AS lines FROM repos
 UNION ALL SELECT repo_id, 1, ['## Project Overview', ''] || {_lines("readme")}[1:50] FROM rd
 UNION ALL SELECT repo_id, 2, ['', '## Project Statistics', '- **Total Files Analyzed:** ' || total_considered, '- **Successfully Scanned:** ' || scanned, '- **Skipped:** ' || skipped, '- **Errors:** 0'] FROM st
 UNION ALL SELECT repo_id, 3, ['', '### Language Distribution'] || list('- **' || language || ':** ' || n_files || ' files' ORDER BY language) FROM la GROUP BY repo_id
 UNION ALL SELECT repo_id, 4, ['', '### Largest Files'] || list('- `' || path || '` (' || {_kb()} || ' KB)' ORDER BY rank) FROM lg GROUP BY repo_id
 UNION ALL SELECT repo_id, 5, ['', '## Technology Stack', '**Languages:** ' || string_agg(language, ', ' ORDER BY language)] FROM la GROUP BY repo_id
 UNION ALL SELECT repo_id, 6, ['', '### Node.js Dependencies'] || CASE WHEN len(json_keys(j, '$.dependencies')) > 0 THEN [array_to_string(json_keys(j, '$.dependencies')[1:20], ', ')] ELSE [] END FROM pk
 UNION ALL SELECT repo_id, 7, ['', '### Python Dependencies'] || list_transform(requirements[1:30], lambda x: '- ' || x) FROM rq
 UNION ALL SELECT * FROM k
 UNION ALL SELECT repo_id, 9, ['', '## Setup Instructions', '', '*Setup instructions would be extracted from README or inferred from project structure.*'] FROM repos
 UNION ALL SELECT repo_id, 10, ['', '---', '*This report was automatically generated.*'] FROM repos)
"""



def _versions(title: str, key: str, shown: int) -> str:
    """Versions of the first dependencies of a package, if it has any."""
    names = f"json_keys(j, '$.{key}')"
    line = f"'  - ' || x || ': ' || json_extract_string(j, '$.{key}.' || x)"
    return f"""CASE WHEN len({names}) > 0 THEN chr(10) || '{title} with versions (' || len({names}) || ' total):' || chr(10) ||
   array_to_string(list_transform({names}[1:{shown}], lambda x: {line}), chr(10)) END"""


_HEAD = "chr(10) || '---' || chr(10) || '## "
_PROMPT = f"""WITH {_REC}, {_STATS}, {_MAN}, {_README}, {_PACKAGE}, {_REQ}, {_bullets(50)},
pr AS (SELECT st.repo_id, concat_ws(chr(10), 'Describe the repository.',
  {_HEAD}Repository Statistics:', ss.summary, {_HEAD}Code Structure Analysis:', b.summary,
  {_HEAD}Existing README Content (Full):' || chr(10) || array_to_string({_lines("readme")}[1:200], chr(10)),
  {_HEAD}Package.json Information (Full Details):' || chr(10) || 'Name: ' || (j->>'$.name') || chr(10) || 'Version: ' || (j->>'$.version') || chr(10) || 'Description: ' || coalesce(j->>'$.description', 'N/A'),
  {_versions("Dependencies", "dependencies", 50)},
  {_versions("Dev Dependencies", "devDependencies", 30)},
  CASE WHEN j IS NOT NULL THEN chr(10) || 'Required Engine Versions: ' || (j->'$.engines')::VARCHAR END,
  {_HEAD}Python Dependencies (Full List with Versions):' || chr(10) || 'Total dependencies: ' || len(requirements) || chr(10) || array_to_string(requirements[1:50], chr(10)),
  {_HEAD}Maven Configuration (pom.xml - Full Content):' || chr(10) || substring(pom.content, 1, 2000),
  {_HEAD}Generate the documentation report now.') AS prompt
 FROM st JOIN ss USING (repo_id) JOIN b USING (repo_id) LEFT JOIN rd USING (repo_id) LEFT JOIN pk USING (repo_id) LEFT JOIN rq USING (repo_id)
 LEFT JOIN (SELECT repo_id, content FROM man WHERE path = 'pom.xml') pom USING (repo_id))
"""


def _tree(source: str, limit: int) -> str:
    """Listing from sort keys that put files before sub-directories at every level."""
    return f"""
lf AS (SELECT DISTINCT repo_id, string_split(path, '/') AS parts FROM {source}),
en AS (SELECT repo_id, parts, false AS is_dir FROM lf UNION
 SELECT repo_id, parts[1:i] AS parts, true FROM (SELECT repo_id, parts, unnest(range(1, len(parts))) AS i FROM lf) x),
ky AS (SELECT *, list_transform(parts, lambda x, i: CASE WHEN i = len(parts) AND NOT is_dir THEN '0' ELSE '1' END || x) AS key FROM en),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY key) AS INT) AS pos FROM ky),
tr AS (SELECT repo_id, pos, repeat('  ', len(parts) - 1) || CASE WHEN is_dir THEN '- ' || parts[-1] || '/' ELSE parts[-1] END AS line FROM rk WHERE pos <= {limit}
 UNION ALL SELECT repo_id, pos + 1, '... (truncated)' FROM rk WHERE pos = {limit})"""


_MD_LINES = rf"""
ml AS (SELECT doc_id, l, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT doc_id, {_lines("text")} AS l FROM ({fx.MARKDOWN}) x) y),
mc AS (SELECT doc_id, pos, regexp_replace(regexp_replace(l[pos + 1], '\s+$', ''), '[^ -~]', ' ', 'g') AS raw FROM ml),
mw AS (SELECT doc_id, pos, CASE WHEN raw <> '' AND length(raw) % 80 = 0 THEN rtrim_one[:-2] ELSE rtrim_one END AS line FROM
  (SELECT *, regexp_replace(raw, '(.{{80}})', '\1 ', 'g') AS rtrim_one FROM mc) x)
"""


def _regex(language: str, symbols: dict, kind: str) -> str:
    return f"WITH {_F} SELECT repo_id, path, unnest({symbols[kind]}) AS name FROM p WHERE language = '{language}'"


def _python(kind: str) -> str:
    return f"WITH {_F} SELECT repo_id, path, 0 AS pos, unnest({_PY[kind]}) AS name FROM p WHERE language = 'python'"


def _symbols(columns: str) -> str:
    parts = [
        f"SELECT {columns.replace('KIND', label)} FROM (SELECT *, {kind} AS names, unnest(range(len({kind}))) AS i FROM r) x"
        for kind, label in (("functions", "function"), ("classes", "class"), ("imports", "import"))
    ]
    return f"WITH {_REC} " + " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "s1_archive_scan": f"WITH {_ARCHIVES} SELECT string_split(path, '/')[-1] AS archive, CASE WHEN zip THEN CAST(length AS BIGINT) ELSE 0 END AS length, zip AS whole, CASE WHEN zip THEN '' ELSE {_NOT_ZIP} END AS error FROM d JOIN len USING (doc_id)",
    "s2_upload_guard": f"WITH {_ARCHIVES} SELECT path, CASE WHEN NOT zip THEN {_NOT_ZIP} WHEN length > {fx.MAX_UPLOAD_BYTES} THEN 'Upload too large: ' || printf('%.2f', length / 1048576.0::DOUBLE) || ' MB. Maximum allowed: {fx.MAX_UPLOAD_BYTES / 1048576:.2f} MB.' ELSE '' END AS error FROM d JOIN len USING (doc_id)",
    "s3_archive_members": f"WITH {_ARCHIVES} SELECT archive, CAST(ordinal AS INT) AS ordinal, name AS path, is_dir, bytes FROM m WHERE zip",
    "s4_path_guard": f"WITH {_ARCHIVES} SELECT archive, bool_or(unsafe) AS unsafe FROM m WHERE zip GROUP BY archive",
    "s5_zip_bomb_guard": f"WITH {_ARCHIVES} SELECT archive, CAST(sum(bytes) AS BIGINT) AS declared, sum(bytes) > {fx.MAX_EXTRACT_BYTES} AS too_large FROM m WHERE zip GROUP BY archive",
    "s6_bad_archives": f"WITH {_ARCHIVES} SELECT path, CASE WHEN NOT zip THEN {_NOT_ZIP} WHEN junk THEN 'Invalid ZIP file: File is not a zip file' ELSE bad.error END AS error FROM d LEFT JOIN bad USING (doc_id) WHERE NOT zip OR junk OR bad.error IS NOT NULL",
    "s7_extracted_files": f"WITH {_ARCHIVES} SELECT 'a' || doc_id AS repo_id, path, arg_max(bytes, ordinal) AS bytes, md5(arg_max(content, ordinal)) AS digest FROM (SELECT *, CASE WHEN ordinal = 7 THEN 'src/sub/late.py' ELSE name END AS path FROM m WHERE zip AND NOT is_dir AND doc_id NOT IN (SELECT doc_id FROM bad)) x GROUP BY doc_id, path",
    "s8_directory_scan": f"WITH {_F} SELECT repo_id, replace(path, '/f', '/' || {fx.ODD_NAMES}[file_id % {len(fx.ODD_NAMES)} + 1]) AS path, bytes, md5(content) AS digest FROM f WHERE language IS NOT NULL",
    "s9_text_decode": "SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN 'A(' || chr(65533) || 'B' ELSE '' END AS t FROM documents) x",
    "s10_repo_size": f"WITH {_F} SELECT repo_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY repo_id",
    "s11_repo_size_guard": f"WITH {_F}, z AS (SELECT repo_id, sum(bytes) AS n FROM f GROUP BY repo_id) SELECT repo_id, path, '' AS error FROM f JOIN z USING (repo_id) WHERE n <= {fx.MAX_REPO_BYTES} AND file_id % 17 <> 0 UNION ALL SELECT repo_id, '', 'Repository too large: ' || printf('%.2f', n / 1048576.0::DOUBLE) || ' MB. Maximum allowed: {fx.MAX_REPO_BYTES / 1048576:.2f} MB.' FROM z WHERE n > {fx.MAX_REPO_BYTES}",
    # Requests take names in turn: the first of x, x_1, x_2, ... that none before has taken.
    "s12_unique_names": f"""WITH RECURSIVE {_URLS},
n AS (SELECT req_id, {_NAME} AS name, row_number() OVER (ORDER BY req_id) AS turn FROM u WHERE is_valid),
t AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS taken, CAST('' AS VARCHAR) AS found
 UNION ALL SELECT n.turn, list_append(t.taken, x), x FROM t JOIN n ON n.turn = t.turn + 1,
 LATERAL (SELECT CASE WHEN NOT list_contains(t.taken, n.name) THEN n.name ELSE n.name || '_' ||
  list_filter(range(1, len(t.taken) + 2), lambda k: NOT list_contains(t.taken, n.name || '_' || k))[1] END AS x) y)
SELECT req_id, name, found AS unique_name, '' AS error FROM n JOIN t USING (turn)
UNION ALL SELECT req_id, '', '', {_URL_ERROR} FROM u WHERE NOT is_valid""",
    "u1_url_validation": f"WITH {_URLS} SELECT req_id, is_valid, {_URL_ERROR} AS error FROM u",
    "u2_repo_name": f"WITH {_URLS} SELECT req_id, {_NAME} AS name, {_name(r"regexp_replace(bare, '[.]git$', '')")} AS strict_name FROM u",
    "u3_request_split": f"WITH {_URLS} SELECT req_id, url, CASE WHEN is_valid THEN 'accepted' ELSE 'rejected' END AS outcome, {_URL_ERROR} AS error FROM u",
    "u3_request_dedup": rf"""WITH {_URLS},
k AS (SELECT req_id, CASE WHEN is_valid THEN lower(regexp_extract(regexp_replace(bare, '(?i)[.]git$', ''), '[^/:]+/[^/:]+$')) END AS repository FROM u)
SELECT req_id, coalesce(repository, '') AS repository, CASE WHEN repository IS NOT NULL THEN min(req_id) OVER (PARTITION BY repository) END AS kept,
 repository IS NOT NULL AND req_id = min(req_id) OVER (PARTITION BY repository) AS is_kept FROM k""",
    "f1_suffix": f"WITH {_F} SELECT file_id, suffix FROM f",
    "f2_code_files": f"WITH {_F} SELECT repo_id, path FROM f WHERE language IS NOT NULL",
    "f3_language": f"WITH {_F} SELECT path, coalesce(language, 'unknown') AS language FROM f",
    "f4_parseable_files": f"WITH {_F} SELECT repo_id, path FROM p",
    "f5_oversize": f"WITH {_F} SELECT path, bytes, CASE WHEN bytes > {fx.MAX_FILE_BYTES} THEN 'file too large (>1MB)' ELSE '' END AS skipped FROM f",
    "f6_scan_cap": f"WITH {_F}, e AS (SELECT repo_id, walk, false AS is_dir FROM f UNION SELECT repo_id, walk[1:i], true FROM (SELECT repo_id, walk, unnest(range(1, len(walk))) AS i FROM f) x) SELECT repo_id, array_to_string(walk, '/') AS path, is_dir, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY walk) AS rank FROM e) y WHERE rank <= {fx.MAX_FILES}",
    "f7_viewer_files": f"WITH {_F} SELECT repo_id, path FROM f WHERE language IS NOT NULL AND path NOT LIKE '%.PY'",
    "f8_file_metrics": f"WITH {_F} SELECT repo_id, path, printf('%.2f', bytes / 1024.0::DOUBLE) || ' KB' AS size_text, upper(substring(suffix, 2)) AS extension, count(*) OVER (PARTITION BY repo_id) AS total_files FROM f WHERE language IS NOT NULL AND path NOT LIKE '%.PY'",
    "f9_preview": f"WITH {_F} SELECT path, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM (SELECT path, CASE WHEN bytes > {fx.PREVIEW_CHARS} THEN substring(content, 1, {fx.PREVIEW_CHARS}) ELSE content END AS t FROM f WHERE language IS NOT NULL AND path NOT LIKE '%.PY') x",
    "f10_display_language": f"WITH {_F} SELECT path, coalesce(language, 'text') AS language FROM f",
    "x1_python_functions": _python("functions"),
    "x2_python_classes": _python("classes"),
    "x3_python_imports": _python("imports"),
    "x4_parse_errors": f"WITH {_F} SELECT path, CASE WHEN file_id % 3 = 0 THEN 'error' ELSE 'scanned' END AS status, CASE WHEN file_id % 3 = 0 THEN 0 ELSE 1 END AS n_functions FROM p WHERE language = 'python'",
    "x5_js_functions": _regex("javascript", _JS, "functions"),
    "x6_js_classes": _regex("javascript", _JS, "classes"),
    "x7_js_imports": _regex("javascript", _JS, "imports"),
    "x8_typescript": _symbols("path, language, 'KIND' AS kind, names[i + 1] AS name").replace("FROM r)", "FROM r WHERE language = 'typescript')"),
    "x9_java_classes": _regex("java", _JAVA, "classes"),
    "x10_java_methods": _regex("java", _JAVA, "functions"),
    "x11_java_imports": _regex("java", _JAVA, "imports"),
    "x12_dispatch": f"WITH {_REC} SELECT path, language, CAST(len(functions) AS INT) AS n_functions, CAST(len(classes) AS INT) AS n_classes, CAST(len(imports) AS INT) AS n_imports FROM r",
    "x13_file_record": f"WITH {_REC} SELECT repo_id, path, language, array_to_string(functions, ',') AS functions, array_to_string(classes, ',') AS classes, array_to_string(imports, ',') AS imports, '' AS error, coalesce(skipped, '') AS skipped, bytes FROM r",
    "x14_status": f"WITH {_REC} SELECT path, status FROM r",
    "x15_symbol_index": _symbols("repo_id, path, language, 'KIND' AS kind, CAST(i AS INT) AS pos, names[i + 1] AS name"),
    "x15_sql_symbols": _symbols("repo_id, path, language, 'KIND' AS kind, CAST(i AS INT) AS pos, names[i + 1] AS name"),
    "a1_total_considered": f"WITH {_F} SELECT repo_id, count(*) AS total_considered FROM p GROUP BY repo_id",
    "a2_scan_counts": f"WITH {_REC} SELECT repo_id, count(*) AS total_considered, CAST(sum(CASE WHEN status = 'scanned' THEN 1 ELSE 0 END) AS BIGINT) AS scanned, CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors FROM r GROUP BY repo_id",
    "a3_by_language": f"WITH {_F} SELECT repo_id, language, count(*) AS n_files FROM p GROUP BY repo_id, language",
    "a4_language_distribution": f"WITH {_F} SELECT repo_id, language, n_files, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY n_files DESC, language) AS INT) AS rank FROM (SELECT repo_id, language, count(*) AS n_files FROM p GROUP BY repo_id, language) x",
    "a5_largest_files": f"WITH {_F} SELECT repo_id, CAST(rank AS INT) AS rank, path, bytes FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, walk) AS rank FROM f WHERE language IS NOT NULL) x WHERE rank <= 5",
    "a6_kb_rounding": f"WITH {_F} SELECT path, CAST(round_even(bytes / 1024.0::DOUBLE, 1) AS DOUBLE) AS kb FROM f",
    "a7_file_counts": f"WITH {_F} SELECT repo_id, CAST(count_if(language IS NOT NULL AND path NOT LIKE '%.PY') AS BIGINT) AS code_files, CAST(count_if(language IN ('python', 'javascript', 'typescript', 'java')) AS BIGINT) AS analysed_files FROM f GROUP BY repo_id",
    "a8_language_list": f"WITH {_F} SELECT repo_id, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM p GROUP BY repo_id",
    "a9_import_usage": f"WITH {_REC} SELECT module, count(*) AS n_files, count(DISTINCT repo_id) AS n_repos FROM (SELECT repo_id, path, unnest(imports) AS module FROM r) x GROUP BY module",
    "a10_added_language": f"WITH {_F}, g AS (SELECT repo_id, language, count(*) AS n_files FROM f WHERE language IN ('python', 'javascript', 'typescript', 'java', 'go') GROUP BY ALL) SELECT repo_id, language, n_files, n_files AS n_records, CAST(sum(n_files) OVER (PARTITION BY repo_id) AS BIGINT) AS total_considered FROM g",
    "a10_open_languages": f"WITH {_F}, o AS (SELECT repo_id, path, CASE suffix WHEN '.md' THEN 'prose' ELSE 'golang' END AS language, CASE WHEN bytes > {fx.MAX_FILE_BYTES} THEN '' ELSE content END AS t, CASE WHEN bytes > {fx.MAX_FILE_BYTES} THEN 'skipped' ELSE 'scanned' END AS status FROM f WHERE suffix IN ('.md', '.go')) SELECT repo_id, path, language, {_joined('([0-9]+)')} AS functions, {_joined('([A-Z])[a-z]')} AS classes, {_joined('([a-z]+)[.]')} AS imports, status FROM o",
    "a1_count_totals": f"WITH {_REC} SELECT repo_id, language, status, CAST(grouping(repo_id, language, status) AS INT) AS level, count(*) AS n_files FROM r GROUP BY GROUPING SETS ((repo_id, language, status), (repo_id, language), (repo_id), (language, status), ())",
    "t1_tree": f"WITH {_F}, {_tree('f', 1000)} SELECT repo_id, pos, line FROM tr",
    "t2_tree_cut": f"WITH {_F}, {_tree('f', fx.MAX_ENTRIES)} SELECT repo_id, pos, line FROM tr",
    "t3_tree_empty": f"WITH {_F}, {_tree('f', fx.MAX_ENTRIES)} SELECT repo_id, coalesce(pos, 1) AS pos, coalesce(line, '(empty or invalid repository)') AS line FROM (SELECT DISTINCT repo_id FROM f UNION SELECT repo_id || '-empty' FROM f) e LEFT JOIN tr USING (repo_id)",
    "m1_readme_pick": f"WITH {_DOC_MAN}, {_README} SELECT repo_id, path, md5(readme) AS digest FROM rd",
    "m2_head_lines": f"SELECT doc_id, CAST(length(head) AS INT) AS n_chars, md5(head) AS digest, short FROM (SELECT doc_id, array_to_string({_lines('text')}[1:50], chr(10)) AS head, array_to_string({_lines('text')}[1:2], chr(10)) AS short FROM ({fx.MARKDOWN}) x) y",
    "m2_sql_head_lines": f"SELECT doc_id, CAST(i AS INT) AS pos, md5(found[i + 1]) AS digest FROM (SELECT doc_id, found, unnest(range(least(50, len(found)))) AS i FROM (SELECT doc_id, {_lines('text')} AS found FROM ({fx.MARKDOWN}) x) y) z",
    "m3_package_json": f"WITH {_DOC_MAN}, {_PACKAGE} SELECT repo_id, CAST(len(json_keys(j, '$.dependencies')) AS INT) AS n_dependencies, CAST(len(json_keys(j, '$.devDependencies')) AS INT) AS n_dev_dependencies FROM pk",
    "m4_package_identity": f"WITH {_DOC_MAN}, {_PACKAGE} SELECT repo_id, coalesce(j->>'$.name', 'N/A') AS name, coalesce(j->>'$.version', 'N/A') AS version, coalesce(j->>'$.description', 'N/A') AS description FROM pk",
    "m5_node_dependencies": _dependencies("dependencies", 50),
    "m6_dev_dependencies": _dependencies("devDependencies", 30),
    "m7_engines": f"WITH {_DOC_MAN}, {_PACKAGE} SELECT repo_id, (j->'$.engines')::VARCHAR AS engines FROM pk",
    "m8_requirements": f"WITH {_DOC_MAN}, {_REQ} SELECT repo_id, CAST(i AS INT) AS pos, requirements[i + 1] AS requirement FROM (SELECT *, unnest(range(len(requirements))) AS i FROM rq) x",
    "m9_requirement_cap": f"WITH {_DOC_MAN}, {_REQ} SELECT repo_id, CAST(i AS INT) AS pos, requirements[i + 1] AS requirement, CAST(len(requirements) AS BIGINT) AS total FROM (SELECT *, unnest(range(least(2, len(requirements)))) AS i FROM rq) x",
    "m10_pom_head": f"WITH {_DOC_MAN} SELECT repo_id, substring(content, 1, 2000) AS pom FROM man WHERE path = 'pom.xml'",
    "r1_text_summary": f"WITH {_REC} SELECT repo_id, path, {_SUMMARY} AS summary FROM r",
    "r2_shown_summaries": f"WITH {_REC}, s AS (SELECT repo_id, {_SUMMARY} AS summary, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY walk) AS INT) AS pos, count(*) OVER (PARTITION BY repo_id) AS n FROM r) SELECT repo_id, pos, summary FROM s WHERE pos <= 15 UNION ALL SELECT repo_id, 16, '... and ' || (n - 15) || ' more files' FROM s WHERE pos = 16",
    "r3_bullet_summary": f"WITH {_REC}, {_bullets(20)} SELECT repo_id, summary FROM b",
    "r4_stats_summary": f"WITH {_REC}, {_STATS} SELECT repo_id, summary FROM ss",
    "r5_report_lines": f"{_REPORT} SELECT repo_id, section, CAST(i AS INT) AS line_no, lines[i + 1] AS line FROM (SELECT *, unnest(range(len(lines))) AS i FROM secs) x",
    "r6_key_files": f"WITH {_REC}, {_key_file_lines(8, 3, 1)} SELECT repo_id, CAST(i AS INT) AS line_no, lines[i + 1] AS line FROM (SELECT *, unnest(range(len(lines))) AS i FROM k) x",
    "r7_overview": f"WITH {_F}, {_MAN}, {_README}, o AS (SELECT repo_id, list_concat(['## Project Overview', ''], {_lines('readme')}[1:50]) AS lines FROM rd UNION ALL SELECT DISTINCT repo_id || '-bare', ['## Project Overview', '', '*No README found. Documentation generated from code analysis.*'] FROM f) SELECT repo_id, CAST(i AS INT) AS line_no, lines[i + 1] AS line FROM (SELECT *, unnest(range(len(lines))) AS i FROM o) x",
    "r8_prompt": f"{_PROMPT} SELECT repo_id, prompt FROM pr",
    "r9_prompt_preview": f"{_PROMPT} SELECT repo_id, CASE WHEN length(prompt) > 500 THEN substring(prompt, 1, 500) || '...' ELSE prompt END AS preview FROM pr",
    "r10_report_files": f"{_REPORT}, t AS (SELECT repo_id, string_agg(array_to_string(lines, chr(10)), chr(10) ORDER BY section) AS report FROM secs GROUP BY repo_id) SELECT repo_id, repo_id || '_ai_documentation.md' AS file_name, CAST(length(report) AS INT) AS n_chars, md5(report) AS digest FROM t",
    "l1_sanitize": "SELECT doc_id, regexp_replace(text, '[^ -~]', ' ', 'g') AS text FROM documents",
    "l2_soft_wrap": r"SELECT doc_id, CASE WHEN text <> '' AND length(text) % 80 = 0 THEN wrapped[:-2] ELSE wrapped END AS text FROM (SELECT doc_id, text, regexp_replace(text, '(?s)(.{80})', '\1 ', 'g') AS wrapped FROM documents) x",
    "l3_line_kinds": f"WITH {_MD_LINES} SELECT doc_id, pos, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '# ') THEN 'title' WHEN starts_with(line, '## ') THEN 'section' WHEN starts_with(line, '### ') THEN 'subsection' WHEN starts_with(line, '- ') THEN 'bullet' ELSE 'text' END AS kind, CASE WHEN starts_with(line, '# ') THEN trim(line[3:]) WHEN starts_with(line, '## ') THEN trim(line[4:]) WHEN starts_with(line, '### ') THEN trim(line[5:]) WHEN starts_with(line, '- ') THEN '- ' || trim(line[3:]) ELSE line END AS text FROM mw",
    "l4_plain_lines": rf"SELECT doc_id, pos, substring(l[pos + 1], 1, 100) AS line FROM (SELECT doc_id, l, CAST(unnest(range(least(300, len(l)))) AS INT) AS pos FROM (SELECT doc_id, {_lines('t')} AS l FROM (SELECT doc_id, regexp_replace(text, '[^\n -~]', ' ', 'g') AS t FROM ({fx.MARKDOWN}) x) y) z) w UNION ALL SELECT doc_id, -1, substring(regexp_replace('Doc ' || doc_id || chr(160) || string_split(text, chr(10))[1], '[^ -~]', ' ', 'g'), 1, 80) FROM ({fx.MARKDOWN}) t",
}

# Uploads in two folders, three in ten of them twice; a later accepted copy takes the next name.
ORACLES["s7_ingest"] = f"""WITH {_ARCHIVES},
copies AS (SELECT doc_id, 0 AS copy FROM d UNION ALL SELECT doc_id, 1 FROM d WHERE doc_id % 10 IN (1, 4, 9)),
j AS (SELECT doc_id, string_split(path, '/')[-1] AS upload, zip AND length <= {fx.MAX_UPLOAD_BYTES} AS named,
  'a' || doc_id || CASE WHEN copy = 1 AND zip AND length <= {fx.MAX_UPLOAD_BYTES} THEN '_1' ELSE '' END AS repo_id,
  CASE WHEN NOT zip THEN {_NOT_ZIP} WHEN length > {fx.MAX_UPLOAD_BYTES} THEN 'Upload too large'
   WHEN junk THEN 'Invalid ZIP file' ELSE string_split(bad.error, ':')[1] END AS reason
  FROM copies JOIN d USING (doc_id) JOIN len USING (doc_id) LEFT JOIN bad USING (doc_id)),
e AS (SELECT repo_id, CASE WHEN ordinal = 7 THEN 'src/sub/late.py' ELSE rtrim(name, '/') END AS path, m.is_dir, ordinal, bytes
  FROM j JOIN m USING (doc_id) WHERE reason IS NULL)
SELECT repo_id, upload AS path, CASE WHEN named THEN false END AS is_dir, CAST(0 AS BIGINT) AS bytes, reason FROM j WHERE reason IS NOT NULL
UNION ALL SELECT repo_id, '', true, 0, '' FROM j WHERE reason IS NULL
UNION ALL SELECT repo_id, path, is_dir, CAST(arg_max(bytes, ordinal) AS BIGINT), '' FROM e GROUP BY repo_id, path, is_dir"""
ORACLES["s7_stream_ingest"] = ORACLES["s7_ingest"]
ORACLES["s3_members_by_range"] = ORACLES["s3_archive_members"]
ORACLES["s7_files_by_range"] = ORACLES["s7_extracted_files"]
ORACLES["a9_import_edges"] = fx.LINKED_EDGES
ORACLES["a9_import_levels"] = f"""WITH RECURSIVE e AS (SELECT DISTINCT repo_id, path, target FROM ({fx.LINKED_EDGES}) l),
r AS (SELECT repo_id, path, target FROM e UNION SELECT r.repo_id, r.path, e.target FROM r JOIN e ON e.repo_id = r.repo_id AND e.path = r.target),
c AS (SELECT f.repo_id, f.path, least(f.path, coalesce(min(back.path), f.path)) AS cycle FROM ({fx.LINKED_FILES}) f
 LEFT JOIN r ON r.repo_id = f.repo_id AND r.path = f.path
 LEFT JOIN r AS back ON back.repo_id = r.repo_id AND back.path = r.target AND back.target = r.path GROUP BY f.repo_id, f.path),
g AS (SELECT DISTINCT e.repo_id, x.cycle AS a, y.cycle AS b FROM e JOIN c x ON x.repo_id = e.repo_id AND x.path = e.path
 JOIN c y ON y.repo_id = e.repo_id AND y.path = e.target WHERE x.cycle <> y.cycle),
p AS (SELECT repo_id, a, b, 1 AS d FROM g UNION SELECT p.repo_id, p.a, g.b, d + 1 FROM p JOIN g ON g.repo_id = p.repo_id AND g.a = p.b)
SELECT repo_id, path, cycle, count(*) OVER (PARTITION BY repo_id, cycle) AS cycle_files,
 CAST(coalesce((SELECT max(d) FROM p WHERE p.repo_id = c.repo_id AND p.a = c.cycle), 0) AS INT) AS level FROM c"""
# Reports read other repositories than the queries on single files.
for _name_of in [q for q in ORACLES if re.match(r"r([4-9]|10)_", q)]:
    ORACLES[_name_of] = ORACLES[_name_of].replace(fx.FILES, fx.GROUP_FILES)
ORACLES["a2_maintained_counts"] = ORACLES["a2_scan_counts"]
ORACLES["a3_maintained_languages"] = ORACLES["a3_by_language"]
ORACLES["a9_maintained_imports"] = ORACLES["a9_import_usage"]
