"""Predicates on paths: globs, sensitive and excluded files, languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, *, ignore_case: bool = True) -> str:
    """A glob as a Java regular expression: `**` crosses folders, `*` and `?` don't, `[...]` and `{a,b}` are classes and choices."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
            continue
        if c == "{":
            depth += 1
        out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:"}.get(c) or (")" if c == "}" and depth else "|" if c == "," and depth else re.escape(c)))
        depth -= c == "}" and depth > 0
        i += 1
    return ("(?i)" if ignore_case else "") + "^" + "".join(out) + "$"


def matches_glob(path: Column, pattern: str, *, ignore_case: bool = True) -> Column:
    return path.rlike(glob_regex(pattern, ignore_case=ignore_case))


def matches_any(path: Column, patterns: list[str]) -> Column:
    """A path, or its last part, matches one of the globs."""
    last = F.substring_index(path, "/", -1)
    found = F.lit(False)
    for p in patterns:
        found = found | matches_glob(path, p) | matches_glob(last, p.removeprefix("**/"))
    return found


# Folders and files that no index takes, and files that hold secrets.
EXCLUDED = [".git", "node_modules", "dist", "build", "__pycache__", ".venv", "target", "coverage", "*.min.js", "*.lock", "*.map"]
SENSITIVE = [".env", ".env.*", "*.pem", "*.key", "id_rsa", "id_ed25519", "*.p12", "*.pfx", ".npmrc", ".netrc", "credentials", "*.kdbx"]
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".sh": "bash", ".sql": "sql", ".html": "html", ".css": "css", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".scala": "scala", ".kt": "kotlin", ".swift": "swift", ".lua": "lua"}
MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".bmp": "image/bmp", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg", ".flac": "audio/flac"}


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def language(path: Column) -> Column:
    """By the extension, or for names like Dockerfile by the name; null if unknown."""
    last = F.substring_index(path, "/", -1)
    return F.when(last.rlike(r"^Dockerfile(\..*)?$"), "dockerfile").when(last == "Makefile", "make").otherwise(_looked_up(F.lower(F.regexp_extract(path, r"\.[^./]*$", 0)), LANGUAGES))


def mime_type(path: Column) -> Column:
    return F.coalesce(_looked_up(F.lower(F.regexp_extract(path, r"\.[^./]*$", 0)), MIME), F.lit("application/octet-stream"))


def is_excluded(path: Column, patterns: list[str] = EXCLUDED) -> Column:
    """Some part of the path is an excluded name or matches an excluded glob."""
    one = "|".join(glob_regex(p).removeprefix("(?i)") for p in patterns)
    return F.exists(F.split(path, "/"), lambda x: x.rlike("(?i)" + one))


def is_sensitive(path: Column) -> Column:
    return matches_any(path, SENSITIVE)


def is_indexable(path: Column, size: Column | None = None, most: int = 512 << 10) -> Column:
    kept = language(path).isNotNull() & ~is_sensitive(path) & ~is_excluded(path)
    return kept if size is None else kept & (size > 0) & (size <= most)
