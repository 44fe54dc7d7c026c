"""Files of a tree as DataFrames: nodes, texts, JSON, Python modules, and plug-ins for binary formats."""

from __future__ import annotations

import ast
import functools
import hashlib
import os
import pwd
from collections.abc import Callable

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions import jsonops as J
from stemma.functions import paths as P
from stemma.functions import text as X
from stemma.session import cut_lineage


_STR, _INT = T.StringType(), T.IntegerType()


def _fields(**kinds):
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_ENTRY = "path string, name string, is_dir boolean, size long, modified double, mode int, owner string, readable boolean, writable boolean, executable boolean, error string"
_ENTRY_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]
LIST_BATCH = 10_000


def _fs(path: str):
    """pyarrow file system and path below it, for local paths and for URIs."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _entries(folder: str):
    """Children of a folder; local ones are streamed, so a folder of any size needs no list of it."""
    fs, base = _fs(folder)
    prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(base) as it:
            for e in it:
                st = e.stat(follow_symlinks=False)
                may = [os.access(e.path, k) for k in (os.R_OK, os.W_OK, os.X_OK)]
                yield f"{prefix}{e.path}", e.name, e.is_dir(follow_symlinks=False), st.st_size, st.st_mtime, st.st_mode & 0o777, _owner(st.st_uid), *may, None
    else:  # object stores know no modes or owners
        for i in fs.get_file_info(pafs.FileSelector(base)):
            yield f"{prefix}{i.path}", i.base_name, i.type == pafs.FileType.Directory, i.size or 0, i.mtime.timestamp() if i.mtime else None, None, None, True, None, None, None


@functools.lru_cache(maxsize=10_000)
def _owner(uid: int) -> str:
    try:
        return pwd.getpwuid(uid).pw_name
    except KeyError:
        return str(uid)


def walk(spark: SparkSession, root: str, rules: list[tuple[str, str]] | None = None, errors: bool = False) -> DataFrame:
    """(path, name, size, modified_at, perms, owner, readable, writable, executable, error) of every file below
    `root`, hidden ones included. With `errors`, folders that could not be read are returned too, each as
    one row with the error.

    The tree is listed breadth first: the folders of one level are spread over the tasks, and an ignored
    folder is never entered. Spark's own file source would leave out names that start with `_` or `.`,
    such as a package's __init__.py.
    """
    p = F.col("path")
    drop = P.ignored(p)

    def listed(batches):
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                try:
                    for e in _entries(folder):
                        rows.append(e)
                        if len(rows) >= LIST_BATCH:
                            yield pd.DataFrame(rows, columns=_ENTRY_NAMES)
                            rows = []
                except OSError as e:
                    rows.append((folder, folder.rsplit("/", 1)[-1], False, None, None, None, None, False, None, None, f"{type(e).__name__}: {e.strerror}"))
            if rows:
                yield pd.DataFrame(rows, columns=_ENTRY_NAMES)

    level, files = spark.createDataFrame([(root.rstrip("/"),)], "path string"), None
    while True:
        found = cut_lineage(level.mapInPandas(listed, _ENTRY).where(~drop))
        plain = found.where("NOT is_dir" if errors else "NOT is_dir AND error IS NULL").select(
            "path", "name", "size", F.timestamp_seconds("modified").alias("modified_at"), F.lpad(F.conv("mode", 10, 8), 3, "0").alias("perms"), "owner", "readable", "writable", "executable", "error"
        )
        files = plain if files is None else files.unionByName(plain)
        below = found.where("is_dir")
        if rules:
            below = below.where(~P.gitignored(F.concat(p, F.lit("/")), rules))
        if below.isEmpty():
            break
        level = below.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return files.where(~P.gitignored(p, rules)) if rules else files


def read_bytes(files: DataFrame, errors: bool = False) -> DataFrame:
    """(path, content) of listed files, each read by the task that holds its row.

    With `errors` there is a column `error`, and a file that cannot be read keeps its row; else it ends the job.
    """
    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                content, error = None, None
                try:
                    fs, base = _fs(path)
                    with fs.open_input_stream(base) as f:
                        content = f.read()
                except OSError as e:
                    if not errors:
                        raise
                    error = f"{type(e).__name__}: {e.strerror or e}"
                row = {"path": [path], "content": [content]}
                yield pd.DataFrame(row | {"error": [error]} if errors else row)

    spread = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInPandas(run, "path string, content binary" + (", error string" if errors else ""))


def scan(spark: SparkSession, root: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """File nodes below `root` without the ignored ones; contents are not read."""
    f = walk(spark, root, rules)
    ext = P.suffix(F.col("path"))
    p = F.col("path")
    return f.select(
        F.md5("path").alias("key"), "path", P.name(p).alias("name"), P.stem(p).alias("stem"), P.parent(p).alias("parent"), ext.alias("ext"), P.document_type(ext).alias("doc_type"),
        P.loader(ext).alias("loader"), "size", "modified_at", ext.isin(P.COMPRESSED).alias("compressed"), ext.isin(P.ENCRYPTED).alias("encrypted"),
        ext.isin(P.SPECIAL_TOOL).alias("special_tool"), F.size(P.parts(p)).alias("depth"), P.mime(ext).alias("mime"), "perms", "owner", "readable", "writable", "executable", "error",
    )


def with_contents(files: DataFrame) -> DataFrame:
    """Files with content_hash, encoding, n_lines, loc (lines that are not blank) and, for Python files, content.

    Each file is read once, by the task that holds its row. A file that cannot be read keeps its row with the error.
    """
    out = T.StructType([*files.schema.fields, *_fields(content_hash=_STR, encoding=_STR, n_lines=_INT, loc=_INT, content=_STR).fields])

    def run(batches):
        for pdf in batches:
            rows = []
            for path, ext, error in zip(pdf["path"], pdf["ext"], pdf["error"]):
                try:
                    fs, base = _fs(path)
                    with fs.open_input_stream(base) as f:
                        raw = f.read()
                except OSError as e:
                    rows.append((None, None, None, None, None, error or f"{type(e).__name__}: {e.strerror or e}"))
                    continue
                try:
                    text, encoding = raw.decode("utf-8"), "utf-8"
                except UnicodeDecodeError:
                    text, encoding = raw.decode("latin-1"), "latin-1"
                lines = text.splitlines()
                rows.append((hashlib.sha256(raw).hexdigest(), encoding, len(lines), sum(map(bool, map(str.strip, lines))), text if ext == ".py" else None, error))
            got = pd.DataFrame(rows, columns=["content_hash", "encoding", "n_lines", "loc", "content", "error"], index=pdf.index)
            yield pdf.assign(**{c: got[c] for c in got.columns})[[f.name for f in out.fields]]

    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInPandas(run, out)



def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(pattern, directory) of the ignore files of a tree, each relative pattern once.

    Rules become one condition of the scan: names and suffixes are looked up in sets, the rest are patterns.
    """
    f = read_bytes(walk(spark, root).where("name = '.gitignore'"))
    lines = f.select(P.parent(F.col("path")).alias("dir"), F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    kept = lines.select("dir", X.strip(F.col("line")).alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    rules = kept.select("line", F.when(F.startswith("line", F.lit("/")), F.col("dir")).otherwise(F.lit("/")).alias("dir")).distinct()
    return [(r["line"], r["dir"]) for r in rules.orderBy("dir", "line").collect()]


def read_contents(spark: SparkSession, root: str, suffixes: list[str], errors: bool = False) -> DataFrame:
    """path, text, encoding: UTF-8 when the bytes are valid, else Latin-1. With `errors`, files that cannot be read too."""
    f = read_bytes(walk(spark, root).where(F.lower(P.suffix(F.col("path"))).isin(suffixes)), errors)
    raw = F.col("content").cast("string")
    ok = F.is_valid_utf8(raw)
    return f.select("path", F.when(ok, raw).otherwise(F.decode("content", "ISO-8859-1")).alias("text"), F.when(ok, "utf-8").otherwise("latin-1").alias("encoding"), *(["error"] if errors else []))


def load_text(spark: SparkSession, root: str) -> DataFrame:
    d = read_contents(spark, root, P.LOADERS["text"])
    return d.select("*", *[c.alias(k) for k, c in X.text_stats(F.col("text")).items()])


def load_markdown(spark: SparkSession, root: str) -> DataFrame:
    d = read_contents(spark, root, P.LOADERS["markdown"])
    t = F.col("text")
    return d.select("*", F.struct(*[c.alias(k) for k, c in X.markdown_structure(t).items()]).alias("structure"), X.code_blocks(t).alias("code_blocks"), X.markdown_type(t).alias("document_type"))


def load_json(spark: SparkSession, root: str) -> DataFrame:
    """Whole JSON files, and the lines of line-wise ones as one list per file."""
    d = read_contents(spark, root, P.LOADERS["json"])
    lines = F.filter(F.split("text", "\n"), lambda x: X.strip(x) != "")
    as_list = F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    body = F.when(F.lower(P.suffix(F.col("path"))).isin(".jsonl", ".ndjson"), as_list).otherwise(F.col("text"))
    return d.select("path", "encoding", J.describe(body).alias("s")).select(
        "path", "encoding", "s", J.complexity("s").alias("complexity"), J.data_type("s").alias("data_type"), J.has_schema("s").alias("has_schema"), J.patterns("s").alias("patterns")
    )


# ---- Python modules --------------------------------------------------------------------------------

SYMBOL = _fields(key=_STR, name=_STR, type=_STR, line_start=_INT, line_end=_INT, docstring=_STR, decorators=T.ArrayType(_STR), parent=_STR, complexity=_INT, calls=T.ArrayType(_STR), imports=T.ArrayType(_STR))
IMPORT = _fields(module=_STR, name=_STR, alias=_STR, line=_INT, type=_STR)
_BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler)


def _decorator(node) -> str:
    target = node.func if isinstance(node, ast.Call) else node
    return target.id if isinstance(target, ast.Name) else "unknown"


def _cyclomatic(node) -> int:
    inner = list(ast.walk(node))
    return 1 + sum(isinstance(n, _BRANCHES) for n in inner) + sum(len(n.values) - 1 for n in inner if isinstance(n, ast.BoolOp))


def parse_module(source: str) -> tuple[list[dict], list[dict], int]:
    """Symbols, imports and number of top-level statements of one module."""
    tree = ast.parse(source)
    table: dict[str, dict] = {}
    imports: list[dict] = []

    def visit(node, owner, func):
        for child in ast.iter_child_nodes(node):
            in_class, in_func = owner, func
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                key = child.name if is_class or owner is None else f"{owner}.{child.name}"
                table[key] = dict(
                    key=key, name=child.name, type="class" if is_class else "function" if owner is None else "method", line_start=child.lineno, line_end=child.end_lineno or child.lineno,
                    docstring=ast.get_docstring(child), decorators=[_decorator(x) for x in child.decorator_list], parent=owner, complexity=0 if is_class else _cyclomatic(child), calls=set(), imports=set(),
                )
                in_class, in_func = (child.name, func) if is_class else (owner, key)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    imports.append(dict(module=a.name, name=None, alias=a.asname, line=child.lineno, type="import"))
                    if func:
                        table[func]["imports"].add(a.name)
            elif isinstance(child, ast.ImportFrom):
                module = child.module or ""
                for a in child.names:
                    imports.append(dict(module=module, name=a.name, alias=a.asname, line=child.lineno, type="from_import"))
                    if func:
                        table[func]["imports"].add(f"{module}.{a.name}" if module else a.name)
            elif isinstance(child, ast.Call) and func and isinstance(child.func, ast.Name):
                table[func]["calls"].add(child.func.id)
            visit(child, in_class, in_func)

    visit(tree, None, None)
    symbols = [{**s, "calls": sorted(s["calls"]), "imports": sorted(s["imports"])} for s in sorted(table.values(), key=lambda s: s["line_start"])]
    return symbols, imports, len(tree.body)


def parse_python(df: DataFrame, key: str, text: str) -> DataFrame:
    """Symbols, imports and syntax error of every Python source text."""
    out = T.StructType([df.schema[key], T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("imports", T.ArrayType(IMPORT)), T.StructField("total_lines", _INT), T.StructField("syntax_error", _STR)])

    def run(batches):
        for pdf in batches:
            rows = []
            for k, source in zip(pdf[key], pdf[text]):
                try:
                    symbols, imports, n = parse_module(source or "")
                    rows.append((k, symbols, imports, n, None))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((k, [], [], None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "symbols", "imports", "total_lines", "syntax_error"])

    return df.select(key, text).mapInPandas(run, out)


def load_python(spark: SparkSession, root: str) -> DataFrame:
    d = read_contents(spark, root, P.LOADERS["python"])
    return d.join(parse_python(d, "path", "text"), "path")


def symbol_metrics(symbols: Column) -> dict[str, Column]:
    """Counts by kind; mean and greatest complexity over the symbols that have one."""
    kinds = {"num_functions": "function", "num_classes": "class", "num_methods": "method"}
    scored = F.transform(F.filter(symbols, lambda s: s["complexity"] > 0), lambda s: s["complexity"])
    total = F.aggregate(scored, F.lit(0), lambda a, x: a + x)
    return {
        **{k: _count_kind(symbols, v) for k, v in kinds.items()},
        "avg_complexity": F.when(F.size(scored) > 0, total / F.size(scored)).otherwise(F.lit(0.0)),
        "max_complexity": F.coalesce(F.array_max(scored), F.lit(0)),
    }


def _count_kind(symbols: Column, kind: str) -> Column:
    return F.size(F.filter(symbols, lambda s: s["type"] == kind))


def symbol_chunks(df: DataFrame, key: str, text: str, symbols: str) -> DataFrame:
    """Source cut at top-level classes and functions; what precedes the second of them is the header chunk.

    A chunk's complexity adds up the symbols stored under the bare names in it, so methods, which are
    stored under Class.name, add nothing.
    """
    d = df.where(F.size(symbols) > 0).select(key, F.posexplode(symbols).alias("i", "s"))
    w = Window.partitionBy(key).orderBy("i")  # the symbols of one file
    opens = F.col("s.type").isin("class", "function") & F.col("s.parent").isNull() & (F.col("i") > 0)
    d = d.withColumn("chunk", F.sum(opens.cast("int")).over(w))
    top = F.col("s.type").isin("class", "function")
    g = d.groupBy(key, "chunk").agg(
        F.min("s.line_start").alias("first"), F.max("s.line_end").alias("last"), F.max_by(F.when(top, F.col("s.type")), F.when(top, F.col("i"))).alias("kind"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("s.name").alias("n")))), lambda x: x["n"]).alias("symbols"),
    )
    nxt = F.lead("first").over(Window.partitionBy(key).orderBy("chunk"))
    g = g.withColumn("line_start", F.when(F.col("chunk") == 0, F.lit(1)).otherwise(F.col("first"))).withColumn("line_end", F.coalesce(nxt - 1, F.col("last")))
    j = g.join(df.select(key, F.col(text).alias("_t"), F.col(symbols).alias("_all")), key)
    bare = F.filter("_all", lambda s: F.array_contains("symbols", s["key"]))
    return j.select(
        key, "chunk", F.coalesce("kind", F.lit("module_header")).alias("chunk_type"), "line_start", "line_end", "symbols",
        F.aggregate(F.transform("symbols", lambda n: F.coalesce(F.get(F.filter("_all", lambda s: s["key"] == n), F.lit(0))["complexity"], F.lit(0))), F.lit(0), lambda a, x: a + x).alias("complexity"),
        F.array_distinct(F.flatten(F.transform(bare, lambda s: s["imports"]))).alias("imports"),
        F.array_join(F.slice(X.lines_of(F.col("_t")), F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "\n").alias("text"),
    )


def enriched(chunk_text: Column, imports: Column, symbols: Column, all_symbols: Column) -> Column:
    """Chunk text under a line of what it uses and the first docstring line of its symbols."""
    uses = F.when(F.size(imports) > 0, F.concat(F.lit("# Uses: "), F.array_join(imports, ", ")))
    known = F.filter(all_symbols, lambda s: F.array_contains(symbols, s["key"]) & s["docstring"].isNotNull())
    docs = F.transform(known, lambda s: F.concat(F.lit("# "), s["key"], F.lit(": "), F.split(s["docstring"], "\n")[0]))
    return F.array_join(F.concat(F.array_compact(F.array(uses)), docs, F.array(chunk_text)), "\n")


def call_edges(df: DataFrame, key: str, symbols: str) -> DataFrame:
    """Function to the bare names it calls."""
    s = df.select(key, F.explode(symbols).alias("s"))
    return s.select(key, F.col("s.key").alias("caller"), F.explode("s.calls").alias("callee"))


def packages(files: DataFrame) -> DataFrame:
    """Dotted package of every Python file: its directories as long as each holds an __init__.py."""
    py = files.where("ext = '.py'")
    marked = py.where("name = '__init__.py'").select(F.col("parent").alias("dir")).distinct().withColumn("has", F.lit(True))
    up = py.select("path", "parent", F.posexplode(F.reverse(F.concat(P.ancestors(F.col("parent")), F.array("parent")))).alias("up", "dir"))
    j = up.join(marked, "dir", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    stop = j.groupBy("path").agg(F.min(F.when(~F.col("has"), F.col("up"))).alias("stop"), F.max("up").alias("deep"))
    n = F.coalesce("stop", F.col("deep") + 1)
    names = stop.join(py.select("path", "parent"), "path").withColumn("_p", P.parts(F.col("parent")))
    return names.select("path", F.array_join(F.slice("_p", F.size("_p") - n + 1, n), ".").alias("package"))


# ---- plug-ins ----------------------------------------------------------------------------------------

Extractor = Callable[[bytes], dict]
_PAGES = "path string, pages array<string>, metadata map<string,string>, error string"


def load_binary(spark: SparkSession, root: str, suffixes: list[str], extract: Extractor) -> DataFrame:
    """Pages of binary documents through a function bytes -> {pages, metadata}, e.g. a PDF reader or an OCR engine.

    A file that fails keeps its row with the error.
    """
    f = read_bytes(walk(spark, root).where(F.lower(P.suffix(F.col("path"))).isin(suffixes)))

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    got = extract(bytes(content))
                    rows.append((path, list(got.get("pages", [])), {k: str(v) for k, v in got.get("metadata", {}).items()}, None))
                except Exception as e:  # noqa: BLE001 - one bad file must not fail the job
                    rows.append((path, [], {}, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pages", "metadata", "error"])

    return f.mapInPandas(run, _PAGES)


def page_text(pages: Column) -> Column:
    """Pages under numbered marks, parted by a blank line."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def choose_text(plain: Column, recognised: Column, pages: Column, floor: int = 100) -> Column:
    """Recognised text where the plain text holds too few characters per page."""
    return F.when(X.needs_ocr(F.length(plain), pages, floor), F.coalesce(recognised, plain)).otherwise(plain)


# ---- web pages -----------------------------------------------------------------------------------------


def html_structure(html: Column) -> dict[str, Column]:
    """Title, counts of tables, images, code, headings, links, formulas, and the text without markup."""
    count = lambda p: F.regexp_count(html, F.lit(p))
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = X.strip(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return {
        "title": X.strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "tables": count(r"(?i)<table[\s>]"),
        "images": count(r"(?i)<img[\s>]"),
        "code": count(r"(?i)<(pre|code)[\s>]"),
        "headings": count(r"(?i)<h[1-6][\s>]"),
        "links": count(r"(?i)<a\s[^>]*href"),
        "formulas": count(r"(?i)<math[\s>]"),
        "text": text,
    }
