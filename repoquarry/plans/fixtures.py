"""Inputs of the registered queries: repositories derived from the given tables.

Each statement runs unchanged in Spark and in DuckDB, over whole tables and whole texts. Line feeds
and quotes are built with ``chr`` because the engines read backslashes in literals differently.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One file per document; the source is the repository and doc_id picks one of 13 extensions.
FILES = """
SELECT doc_id AS file_id, source AS repo_id, k,
 concat('src/', lang, '/f', CAST(doc_id AS STRING), CASE k WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.jsx'
  WHEN 3 THEN '.ts' WHEN 4 THEN '.tsx' WHEN 5 THEN '.java' WHEN 6 THEN '.go' WHEN 7 THEN '.rs' WHEN 8 THEN '.cpp'
  WHEN 9 THEN '.c' WHEN 10 THEN '.cs' WHEN 11 THEN '.md' ELSE '.PY' END) AS path,
 CASE WHEN k IN (0, 12) THEN concat('import os, sys', chr(10), 'from json import loads', chr(10), 'class C',
   CAST(doc_id AS STRING), ':', chr(10), '    def m', CAST(doc_id AS STRING), '(self): pass', chr(10),
   'async def a(): pass', chr(10), '# ', replace(text, chr(10), concat(chr(10), '# ')))
  WHEN k BETWEEN 1 AND 4 THEN concat('import x from "lib', CAST(doc_id % 7 AS STRING), '"', chr(10),
   'const r = require(', chr(39), 'fs', chr(39), ')', chr(10), 'export class W', CAST(doc_id AS STRING), ' {}', chr(10),
   'function f', CAST(doc_id AS STRING), '(a) {}', chr(10), 'const g = (a) => a', chr(10), 'o = { ',
   CASE WHEN lang = 'en' THEN 'plain' ELSE 'été' END, ': function() {} }', chr(10), '// ',
   replace(text, chr(10), concat(chr(10), '// ')))
  WHEN k = 5 THEN concat('import java.util.List;', chr(10), 'public class J', CAST(doc_id AS STRING), ' {', chr(10),
   ' public int go(int a) { if (a) { return 1; } }', chr(10), '// ', replace(text, chr(10), concat(chr(10), '// ')),
   chr(10), '}')
  ELSE text END AS content
FROM (SELECT doc_id, text, lang, source, CAST(doc_id % 13 AS INT) AS k FROM documents) d
"""

# Repositories of ten blocks of 24 documents: eight Python, script and Java files each, where every file imports
# the one before it in its block and the third one the fifth, so that three of them import each other.
_LINKED = """(SELECT *, CAST(floor(doc_id / 24.0) AS BIGINT) AS b, CAST(doc_id % 3 AS INT) AS k,
 CAST(floor(CAST(doc_id % 24 AS INT) / 3.0) AS INT) AS i FROM documents) d"""


def _linked_path(number: str) -> str:
    n = f"CAST({number} AS STRING)"
    return (
        f"CASE k WHEN 0 THEN concat('app/b', CAST(b AS STRING), '/m', {n}, '.py') "
        f"WHEN 1 THEN concat('web/b', CAST(b AS STRING), '/c', {n}, '.ts') "
        f"ELSE concat('src/main/java/com/b', CAST(b AS STRING), '/J', {n}, '.java') END"
    )


def _linked_module(number: str, far: bool) -> str:
    n, b = f"CAST({number} AS STRING)", "CAST(b AS STRING)"
    script = f"concat('../b', {b}, '/./c', {n}, '.ts')" if far else f"concat('./c', {n})"
    return f"CASE k WHEN 0 THEN concat('b', {b}, '.m', {n}) WHEN 1 THEN {script} ELSE concat('com.b', {b}, '.J', {n}) END"


def _linked_import(number: str, far: bool) -> str:
    named = _linked_module(number, far)
    return (
        f"CASE k WHEN 0 THEN concat('import ', {named}) WHEN 1 THEN concat('import x from \"', {named}, '\"') "
        f"ELSE concat('import ', {named}, ';') END"
    )


_MARK = "CASE k WHEN 0 THEN '# ' ELSE '// ' END"
LINKED_FILES = f"""
SELECT concat('r', CAST(floor(doc_id / 240.0) AS BIGINT)) AS repo_id, {_linked_path("doc_id")} AS path,
 concat(CASE WHEN i > 0 THEN concat({_linked_import("doc_id - 3", False)}, chr(10)) ELSE '' END,
  CASE WHEN i = 2 THEN concat({_linked_import("doc_id + 6", True)}, chr(10)) ELSE '' END,
  CASE k WHEN 0 THEN 'import os' WHEN 1 THEN 'import y from "react"' ELSE 'import java.util.List;' END,
  chr(10), {_MARK}, replace(text, chr(10), concat(chr(10), {_MARK}))) AS content FROM {_LINKED}
"""
LINKED_EDGES = f"""
SELECT concat('r', CAST(floor(doc_id / 240.0) AS BIGINT)) AS repo_id, {_linked_path("doc_id")} AS path, module, target FROM (
 SELECT *, {_linked_module("doc_id - 3", False)} AS module, {_linked_path("doc_id - 3")} AS target FROM {_LINKED} WHERE i > 0
 UNION ALL SELECT *, {_linked_module("doc_id + 6", True)}, {_linked_path("doc_id + 6")} FROM {_LINKED} WHERE i = 2
  AND doc_id + 6 IN (SELECT doc_id FROM documents)) d
"""

# README in two spellings, requirements under both names, package.json and pom.xml for every document as a
# repository of its own: whole texts as README, pom.xml and, word by word, as requirements, some with
# carriage returns; no, few, many and broken dependencies.
_MANY = ", ".join(f'"p{i}":"{i}"' for i in range(60))
_PER_DOC = "(SELECT concat(source, '-', CAST(doc_id AS STRING)) AS repo_id, doc_id AS id, lang, text AS txt FROM documents) a"
DOC_MANIFESTS = f"""
SELECT repo_id, 'README.md' AS path, concat('# ', repo_id, chr(10), txt) AS content FROM {_PER_DOC} WHERE id % 3 <> 2
UNION ALL SELECT repo_id, 'readme.txt', concat('fallback ', txt) FROM {_PER_DOC}
UNION ALL SELECT repo_id, CASE WHEN id % 2 = 0 THEN 'requirements.txt' ELSE 'requirements-dev.txt' END,
 concat('# top', chr(10), chr(10), '  # kept', chr(10), replace(txt, ' ', CASE WHEN id % 3 = 1 THEN concat(chr(13), chr(10)) ELSE chr(10) END))
 FROM {_PER_DOC}
UNION ALL SELECT repo_id, 'requirements-dev.txt', 'never==0' FROM {_PER_DOC} WHERE id % 4 = 0
UNION ALL SELECT repo_id, 'package.json', CASE WHEN id % 5 = 4 THEN concat('{{bad', txt) ELSE concat('{{"name":"', repo_id,
 '","version":"1.', CAST(id % 9 AS STRING), '"', CASE WHEN id % 2 = 0 THEN concat(',"description":"', lang, '"') ELSE '' END,
 ',"dependencies":{{', CASE id % 4 WHEN 0 THEN '"z":"1","a":"^2"' WHEN 1 THEN '{_MANY}' WHEN 2 THEN '' ELSE concat('"x":"', CAST(id AS STRING), '"') END,
 '}},"devDependencies":{{"jest":"29"', CASE WHEN id % 3 = 0 THEN ', {_MANY}' ELSE '' END, '}},"engines":{{"node":">=', CAST(id % 20 AS STRING), '"}}}}') END
 FROM {_PER_DOC}
UNION ALL SELECT repo_id, 'pom.xml', concat('<project>', txt, '</project>') FROM {_PER_DOC} WHERE id % 4 = 0
"""

# For reports: eight documents are a repository, and the first of them also makes its manifests.
_GROUP = "concat('g', CAST(CAST(floor(doc_id / 8.0) AS BIGINT) AS STRING))"
GROUP_FILES = FILES.replace("source AS repo_id", f"{_GROUP} AS repo_id")
GROUP_MANIFESTS = DOC_MANIFESTS.replace(
    _PER_DOC,
    f"(SELECT {_GROUP} AS repo_id, CAST(floor(doc_id / 8.0) AS BIGINT) AS id, lang, text AS txt FROM documents WHERE doc_id % 8 = 0) a",
)

# Eight shapes of URL made of every page's own: plain, upper case with blanks, no repository, ssh, dotted,
# deep, inner .git, and the page's URL itself. Names repeat, and some ask for the variants of others.
URL_REQUESTS = """
SELECT page_id AS req_id, CASE page_id % 8 WHEN 0 THEN concat('https://github.com/', o, '/', r)
 WHEN 1 THEN concat(' HTTPS://GitHub.com/', o, '/', r, '.git ') WHEN 2 THEN concat('https://github.com/', o, '/')
 WHEN 3 THEN concat('git@github.com:', o, '/', r, '.git') WHEN 4 THEN concat('http://github.com/a-b/c.', r, '/')
 WHEN 5 THEN concat('https://github.com/', o, '/', r, '/tree/main')
 WHEN 6 THEN concat('https://github.com/', o, '/u.github.io') ELSE url END AS url
FROM (SELECT page_id, url, replace(split_part(url, '/', 3), '.', '-') AS o,
 CASE page_id % 3 WHEN 0 THEN split_part(url, '/', 4)
  WHEN 1 THEN concat(split_part(url, '/', 4), '_', CAST(page_id % 5 + 1 AS STRING))
  ELSE split_part(split_part(split_part(url, '/', 5), '?', 1), '#', 1) END AS r FROM pages) p
"""

# Every line head in front of each whole text.
MARKDOWN = """
SELECT doc_id, concat('# Doc ', CAST(doc_id AS STRING), '  ', chr(10), '## ', lang, chr(10), '### ', source, chr(10),
 '- item  ', chr(10), '  - inner', chr(10), chr(10), '# ', text) AS text FROM documents
"""

# Beginnings of names that hidden-file rules, URIs or globs would read in another way.
ODD_NAMES = ["f", "_f", ".f", "a b", "é", "x#", "a%20b", "100%", "q?", "[id]"]

# Limits low enough for every branch to be taken on the smallest tables.
MAX_FILE_BYTES = 8192
MAX_FILES = 20
MAX_ENTRIES = 30
PREVIEW_CHARS = 4096
MAX_UPLOAD_BYTES = 6000
MAX_EXTRACT_BYTES = 4096
MAX_REPO_BYTES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _derived(source: DataFrame, name: str, sql: str) -> DataFrame:
    source.createOrReplaceTempView(name)
    return source.sparkSession.sql(sql)


def files(spark: SparkSession, sf_dir: str, sql: str = FILES) -> DataFrame:
    """files(file_id, repo_id, path, bytes, content)."""
    df = _derived(documents(spark, sf_dir), "documents", sql)
    size = F.octet_length("content").cast("bigint")
    content = F.col("content").cast("binary")
    return df.select("file_id", "repo_id", "path", size.alias("bytes"), content.alias("content"))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo_id, path, bytes, content) that import each other."""
    df = _derived(documents(spark, sf_dir), "documents", LINKED_FILES)
    return df.select("repo_id", "path", F.octet_length("content").cast("bigint").alias("bytes"), F.col("content").cast("binary").alias("content"))


def doc_manifests(spark: SparkSession, sf_dir: str, sql: str = DOC_MANIFESTS) -> DataFrame:
    df = _derived(documents(spark, sf_dir), "documents", sql)
    return df.select("repo_id", "path", F.col("content").cast("binary").alias("content"))


def url_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(table(spark, sf_dir, "pages"), "pages", URL_REQUESTS)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(documents(spark, sf_dir), "documents", MARKDOWN)


# Row by row: Spark passes some 100 rows at a time, so a worker holds few archives whatever the rows of a task.
@F.udf(T.BinaryType(), useArrow=False)
def _zip_of(i: int, body: str) -> bytes:
    """A small archive around each text: hidden names, a repeated name, empty and unsafe members."""
    if i % 7 == 3:
        return b"junk:" + body.encode()
    members = [
        ("src/", ""),
        ("src/__init__.py", f"class A{i}: pass\n"),
        (".hidden", "x"),
        ("docs/text.md", body),
        ("dup.txt", "first"),
        ("dup.txt", "second"),
        ("empty/", ""),
    ]
    extra = {3: f"../a{i}_x/evil.py", 5: "/abs.py", 7: "./src//sub/../late.py"}.get(i % 11)
    members += [(extra, "pass\n")] if extra else []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.infolist()
        for name, content in members:
            # A repeated name is intended, so the header is written directly instead of being looked up.
            archive.NameToInfo.pop(name, None)
            archive.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def archives(spark: SparkSession, sf_dir: str, chosen: str = "true") -> DataFrame:
    """One uploaded file per document, shaped as the binary source reads it.

    ``chosen`` is a condition on ``path``; archives that it leaves out are not made.
    """
    ending = F.when(F.col("doc_id") % 10 == 9, ".tar").when(F.col("doc_id") % 10 == 8, ".ZIP").otherwise(".zip")
    content = _zip_of.asNondeterministic()("doc_id", "text")
    return (
        documents(spark, sf_dir)
        .select(F.concat(F.lit("uploads/a"), F.col("doc_id"), ending).alias("path"), "doc_id", "text")
        .where(chosen)
        .select("path", content.alias("content"))
        .select(
            "path",
            F.lit(0).cast("timestamp").alias("modificationTime"),
            F.octet_length("content").cast("bigint").alias("length"),
            "content",
        )
    )
