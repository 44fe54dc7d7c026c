"""Path, file-node and classification expressions."""

from __future__ import annotations

import mimetypes
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.text import any_word, strip

# Path components and substrings that are skipped.
IGNORED_COMPONENTS = [".git", "__pycache__", ".pytest_cache", "node_modules", ".venv", "venv"]
SKIPPED_SUBSTRINGS = [".git", "__pycache__", ".pyc", ".env", "node_modules", ".DS_Store"]

# Purposes read from a path.
PURPOSES = {
    "test": ["testing", "validation"],
    "doc": ["documentation", "reference"],
    "src": ["implementation", "source_code"],
    "lib": ["library", "dependency"],
    "example": ["example", "demonstration"],
    "tutorial": ["tutorial", "learning"],
    "benchmark": ["performance", "benchmark"],
    "script": ["automation", "tooling"],
    "config": ["configuration", "settings"],
    "data": ["data", "dataset"],
}

# Document type by suffix, for single documents and for surveys.
DOCUMENT_TYPES = {
    ".pdf": "pdf", ".py": "python", ".md": "markdown", ".ipynb": "jupyter", ".txt": "text",
    ".js": "code", ".ts": "code", ".java": "code", ".cpp": "code", ".c": "code", ".go": "code", ".rs": "code",
}
SURVEY_TYPES = {
    ".md": "markdown", ".txt": "text", ".pdf": "pdf", ".py": "python", ".js": "javascript", ".ts": "typescript",
    ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "header", ".hpp": "header",
    ".rs": "rust", ".go": "go", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".html": "html", ".css": "css",
    ".tex": "latex", ".ipynb": "jupyter", ".sh": "shell", ".bash": "shell", ".proto": "protobuf", ".thrift": "thrift",
    ".rst": "restructuredtext", ".adoc": "asciidoc", ".org": "org", ".wiki": "wiki", ".mediawiki": "mediawiki", ".pod": "pod",
    ".man": "man", ".info": "info", ".texi": "texinfo",
}

# Suffixes that raise or lower how well a file conveys.
COMPRESSED = [".gz", ".zip", ".tar", ".bz2", ".7z"]
ENCRYPTED = [".gpg", ".enc", ".aes"]
SPECIAL_TOOL = [".psd", ".ai", ".sketch", ".fig"]

# Loader chosen by suffix.
LOADERS = {
    "text": [".txt", ".text"],
    "markdown": [".md", ".markdown", ".mdown"],
    "json": [".json", ".jsonl", ".ndjson"],
    "python": [".py", ".pyw"],
    "pdf": [".pdf"],
}


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Final dotted part of the name with its dot; none for a name that only starts or ends with a dot."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED_COMPONENTS]))


def skipped(path: Column) -> Column:
    """Substring test, so `.environment` falls with `.env`."""
    return any_word(path, SKIPPED_SUBSTRINGS)


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def document_type(ext: Column) -> Column:
    return lookup(F.lower(ext), DOCUMENT_TYPES, "unknown")


def mime(ext: Column) -> Column:
    """Media type of a suffix by the standard table; null for unknown suffixes."""
    known = {k: v for k, v in mimetypes.types_map.items()} | {".md": "text/markdown", ".py": "text/x-python", ".yaml": "application/yaml", ".yml": "application/yaml"}
    pairs = [F.lit(x) for kv in sorted(known.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(ext))


def loader(ext: Column) -> Column:
    return lookup(F.lower(ext), {s: k for k, ss in LOADERS.items() for s in ss}, "none")


def purposes(path: Column) -> Column:
    low = F.lower(path)
    tags = [F.when(F.contains(low, F.lit(k)), F.array(*[F.lit(t) for t in ts])).otherwise(F.array().cast("array<string>")) for k, ts in PURPOSES.items()]
    return F.array_distinct(F.flatten(F.array(*tags)))


def inherited_context(path: Column) -> dict[str, Column]:
    """Components above the file, the directory chain with levels top-down, and the depth."""
    above = F.concat(F.array(F.lit("/")), F.slice(parts(path), 1, F.size(parts(path)) - 1))
    chain = F.transform(F.slice(parts(path), 1, F.size(parts(path)) - 1), lambda x, i: F.struct(x.alias("name"), (i + 1).alias("level")))
    return {"path_components": above, "directory_chain": chain, "structural_depth": F.size(parts(path))}


def safe_key(doc_id: Column) -> Column:
    key = F.translate(doc_id, "/:. \\", "_____")
    return F.when(key.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), key)).otherwise(key)


def ancestors(path: Column) -> Column:
    """Every directory prefix of a path, from the top directory down to its parent."""
    p = parts(path)
    return F.when(
        F.size(p) > 1,
        F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(p, 1, n), "/"))),
    ).otherwise(F.array().cast("array<string>"))


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def gitignored(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """Whether a file or one of its directories matches any (pattern, directory of its .gitignore).

    Plain names and `*.suffix` patterns of the whole tree, the bulk of all rules, are looked up in sets;
    only the rest are regular expressions.
    """
    tests = []
    names: dict[bool, list[str]] = {False: [], True: []}
    ends: dict[bool, list[str]] = {False: [], True: []}
    rest = []
    for pattern, base in patterns:
        bare = pattern.rstrip("/")
        if re.fullmatch(r"[^*?\[\]\\/!]+", bare) and pattern in (bare, bare + "/"):
            names[pattern != bare].append(bare)
        elif re.fullmatch(r"\*\.[^*?\[\]\\/.]+", bare) and pattern in (bare, bare + "/"):
            ends[pattern != bare].append(bare[1:])
        else:
            rest.append((pattern, base))
    every = F.split(path, "/")
    for only_dirs, found in ((False, every), (True, F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))))):
        if names[only_dirs]:
            tests.append(F.arrays_overlap(found, F.array(*map(F.lit, sorted(set(names[only_dirs]))))))
        if ends[only_dirs]:
            known = F.array(*map(F.lit, sorted(set(ends[only_dirs]))))
            tests.append(F.exists(found, lambda x: F.array_contains(known, F.regexp_extract(x, r"(\.[^.]*)$", 1))))
    for pattern, base in rest:
        only_dirs = pattern.endswith("/")
        p = pattern[:-1] if only_dirs else pattern
        end = "/" if only_dirs else "(/|$)"
        head = "^" + re.escape(base.rstrip("/") + "/") + glob_regex(p[1:]) if p.startswith("/") else "(^|/)" + glob_regex(p)
        tests.append(path.rlike(head + end))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


# ---- library classification ----------------------------------------------------------------------

# Class by category prefix, class by keyword, stop words of the title acronym.
CATEGORY_CLASSES = [
    ("cs.LG", "QA76.9.A43", "Machine Learning"),
    ("cs.CL", "P98", "Computational Linguistics"),
    ("cs.CV", "QA76.9.D3", "Computer Vision"),
    ("cs.AI", "QA76.87", "Artificial Intelligence"),
    ("stat.ML", "QA76.9.A43", "Statistical Machine Learning"),
]
INFORMATION_TERMS = ["shannon", "entropy", "information theory", "mutual information"]
SOCIETY_TERMS = ["anthropolog", "ethnograph", "cultural", "society", "social"]
ACRONYM_STOP_WORDS = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or"]


def classify(title: Column, abstract: Column, categories: Column) -> Column:
    """struct<code, subclass>: the first category prefix that occurs, else keywords, else the default."""
    text = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit(""))))
    cats = F.coalesce(categories, F.array().cast("array<string>"))
    pick = lambda code, sub: F.struct(F.lit(code).alias("code"), F.lit(sub).alias("subclass"))
    out = None
    for prefix, code, sub in CATEGORY_CLASSES:
        hit = _starts(cats, prefix)
        out = F.when(hit, pick(code, sub)) if out is None else out.when(hit, pick(code, sub))
    social = any_word(text, SOCIETY_TERMS)
    return (
        out.when(any_word(text, INFORMATION_TERMS), pick("QA76.9.I52", "Information Theory"))
        .when(social & F.contains(text, F.lit("cogniti")), pick("GN476", "Cognitive Anthropology"))
        .when(social & any_word(text, ["linguistic", "language"]), pick("GN495", "Linguistic Anthropology"))
        .when(social, pick("GN301", "Cultural Anthropology"))
        .otherwise(pick("QA76.9", "Computer Science General"))
    )


def _starts(cats: Column, prefix: str) -> Column:
    return F.exists(cats, lambda c: F.startswith(c, F.lit(prefix)))


def author_code(author: Column) -> Column:
    """LastName_I from "Last, First" or "First Last"; Unknown without a last name."""
    a = strip(F.coalesce(author, F.lit("")))
    words = F.filter(F.split(a, r"\s+"), lambda x: x != "")
    comma = F.contains(a, F.lit(","))
    last = F.when(comma, F.regexp_extract(a, r"^([^,]*),", 1)).when(F.size(words) > 1, F.element_at(words, -1)).otherwise("")
    first = F.when(comma, strip(F.regexp_extract(a, r"^[^,]*,(.*)$", 1))).otherwise(F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    tidy = F.substring(F.regexp_replace(last, r"[^\p{L}\p{N}]", ""), 1, 15)
    return F.when(tidy != "", F.concat(tidy, F.lit("_"), F.upper(F.substring(first, 1, 1)))).otherwise(F.lit("Unknown"))


def acronym(title: Column) -> Column:
    """Capitals, else the raised first letter, of the first four words that are no stop words; at most eight letters."""
    stop = F.array(*[F.lit(w) for w in ACRONYM_STOP_WORDS])
    words = F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))
    caps = lambda w: F.regexp_replace(w, r"[^\p{Lu}]", "")
    letters = F.transform(F.slice(words, 1, 4), lambda w: F.when(caps(w) != "", caps(w)).otherwise(F.upper(F.substring(w, 1, 1))))
    return F.when(F.size(words) > 0, F.substring(F.array_join(letters, ""), 1, 8)).otherwise(F.lit("PAPER"))


def class_filename(code: Column, published: Column, first_author: Column, title: Column, original_stem: Column) -> Column:
    year = F.when(F.length(published) > 0, F.substring(published, 1, 4)).otherwise(F.lit("0000"))
    oid = F.substring(F.replace(F.regexp_replace(original_stem, "^arxiv_", ""), F.lit("."), F.lit("_")), 1, 20)
    raw = F.concat(F.concat_ws("_", code, year, author_code(first_author), acronym(title), oid), F.lit(".pdf"))
    return F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{N}_\-.]", "_"), "_+", "_")


def class_folder(code: Column) -> Column:
    return F.concat_ws("/", F.substring(code, 1, 1), code)


def download_name(title: Column) -> Column:
    """Title reduced to word characters, runs of space or dash as one underscore, fifty characters."""
    kept = F.regexp_replace(title, r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(strip(kept), r"[-\s]+", "_"), 1, 50)
