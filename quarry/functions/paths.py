"""Path predicates and projections: globs, skipped directories, languages, names. Columns for DataFrames; the plain functions serve the file source."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory names that are never entered.
SKIP_DIRS = ("target", "node_modules", ".git", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".venv", "venv", "dist", "build", ".next", ".nuxt", "vendor", "coverage", ".idea", ".vscode", ".vs")
#: Extensions, in lower case, of files without text.
BINARY_EXTENSIONS = tuple(
    "exe dll so dylib o a zip tar gz bz2 xz 7z rar png jpg jpeg gif bmp ico svg webp mp3 mp4 avi mov mkv wav flac pdf doc docx xls xlsx ppt pptx wasm pyc class jar lock sum ttf otf woff woff2 eot sqlite db".split()
)
#: Languages by extension; the case of the extension counts.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go"}
#: Collection names begin with this unless a configuration says otherwise.
COLLECTION_PREFIX = "quarry_"


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a glob, to be matched against a whole path; None if the glob is invalid. * and ? cross directories; **/ is any number of them."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            run = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            if run > 2:
                return None
            if run == 2:
                if (i > 0 and pattern[i - 1] != "/") or (i + 2 < n and pattern[i + 2] != "/"):
                    return None
                if i + 2 < n:
                    out.append("(?:.*/)?")
                    i += 3
                else:
                    out.append(".*")
                    i += 2
                continue
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2))
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", c, flags=re.ASCII) if ord(c) < 128 else c)
        i += 1
    return "".join(out)


def glob_regexes(patterns: list[str] | None) -> list[str] | None:
    """Valid patterns as regular expressions; invalid ones are left out; None stays None."""
    return None if patterns is None else [r for r in map(glob_regex, patterns) if r is not None]


def matches_globs(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path is included (by any pattern; an empty list includes nothing, None everything) and not excluded."""
    normal = F.replace(path, F.lit("\\"), F.lit("/"))

    def any_of(patterns: list[str]) -> Column:
        return normal.rlike(r"\A(?s:" + "|".join(f"(?:{p})" for p in patterns) + r")\z") if patterns else F.lit(False)

    wanted, unwanted = glob_regexes(include), glob_regexes(exclude)
    kept = F.lit(True) if wanted is None else any_of(wanted)
    return kept & ~any_of(unwanted) if unwanted else kept


def path_matches(path: str, include: list[str] | None, exclude: list[str] | None) -> bool:
    """matches_globs for one path outside of Spark."""
    normal = path.replace("\\", "/")
    wanted, unwanted = glob_regexes(include), glob_regexes(exclude)
    hit = lambda patterns: any(re.fullmatch(p, normal, re.S) for p in patterns)
    return (wanted is None or hit(wanted)) and not (unwanted and hit(unwanted))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*\z", 1)


def extension(path: Column) -> Column:
    """Without the dot, in its own case; empty if there is none. A leading dot begins a name, not an extension."""
    return F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1)


def file_stem(path: Column) -> Column:
    stem = F.regexp_extract(base_name(path), r"(?s)^(.+?)(?:\.[^.]*)?$", 1)
    return F.when(stem == "", F.lit("unknown")).otherwise(stem)


def detect_language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(path)]


def language_of(path: str) -> str | None:
    name = re.split(r"[/\\]", path)[-1]
    stem, dot, ext = name.rpartition(".")
    return LANGUAGES.get(ext) if dot and stem else None


def is_binary(path: Column) -> Column:
    return F.lower(extension(path)).isin(*BINARY_EXTENSIONS)


def is_language_allowed(language: Column, allowed: list[str] | None) -> Column:
    return F.lit(True) if allowed is None else F.lower(language).isin(*[a.lower() for a in allowed]) if allowed else F.lit(False)


def in_skipped_directory(path: Column) -> Column:
    """Whether a directory of the path, its root among them, is one of SKIP_DIRS."""
    folders = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def relative_path(path: Column, root: str) -> Column:
    """The path below root, by whole components, with forward slashes; a path elsewhere stays whole."""
    below = root.rstrip("/\\") + "/"
    normal = F.replace(path, F.lit("\\"), F.lit("/"))
    below = below.replace("\\", "/")
    return F.when(F.startswith(normal, F.lit(below)), F.substr(normal, F.lit(len(below) + 1))).otherwise(normal)


def sanitize_name(path: Column) -> Column:
    """The last component with ASCII letters in lower case and all but ASCII letters and digits as underscores, which are trimmed at both ends."""
    name = F.regexp_extract(path, r"([^/\\]+)[/\\]*\z", 1)
    name = F.when(name == "", F.lit("unknown")).otherwise(name)
    plain = F.regexp_replace(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9]", "_")
    return F.btrim(plain, F.lit("_"))


def collection_name(repo: Column, prefix: str = COLLECTION_PREFIX) -> Column:
    return F.concat(F.lit(prefix), repo)


def resolves_to(collection: Column, name: str, prefix: str = COLLECTION_PREFIX) -> Column:
    """Whether a collection is meant by a name given with or without prefix."""
    return collection.isin(name, prefix + name)
