"""Classification and naming of files by path and first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions by category and language.
CODE_EXTENSIONS = {
    ".py": "Python", ".java": "Java", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".cpp": "C++", ".cc": "C++",
    ".cxx": "C++", ".hpp": "C++", ".c": "C", ".h": "C", ".cs": "C#", ".php": "PHP", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".sql": "SQL", ".sh": "Shell",
    ".bash": "Shell", ".pl": "Perl", ".kt": "Kotlin", ".swift": "Swift", ".scala": "Scala",
}
CONFIG_EXTENSIONS = {
    ".yaml": "YAML", ".yml": "YAML", ".xml": "XML", ".json": "JSON", ".toml": "TOML", ".ini": "INI", ".cfg": "Config", ".env": "Env",
}
OTHER_EXTENSIONS = {
    ".md": "Documentation", ".rst": "Documentation", ".txt": "Text", ".png": "Image", ".jpg": "Image", ".jpeg": "Image", ".gif": "Image", ".svg": "Image",
    ".pdf": "Document", ".lock": "Lockfile",
}
SPECIAL_NAMES = ("Dockerfile", "Makefile", "Jenkinsfile")
# Folders that a scan never enters.
SCAN_EXCLUDES = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", "target", ".idea", ".vscode", ".pytest_cache", ".mypy_cache",
    "coverage",
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-case last suffix; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.*[^.].*?(\.[^.]+)$", 1))


def shebang(first_line: Column) -> Column:
    line = F.trim(F.coalesce(first_line, F.lit("")))
    return F.when(
        line.startswith("#!"),
        F.when(line.contains("python"), "Python").when(line.contains("bash") | line.contains("/sh"), "Shell").when(line.contains("node"), "JavaScript")
        .when(line.contains("perl"), "Perl").when(line.contains("ruby"), "Ruby"),
    )


def first_line(content: Column) -> Column:
    return F.element_at(F.split(F.coalesce(content, F.lit("")), "\n", 2), 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def classified(files: DataFrame, path: str = "path", content: str | None = "content") -> DataFrame:
    """files with language, category, detection_method and confidence."""
    ext, name = suffix(F.col(path)), file_name(F.col(path))
    code, config, other = _lookup(CODE_EXTENSIONS, ext), _lookup(CONFIG_EXTENSIONS, ext), _lookup(OTHER_EXTENSIONS, ext)
    by_line = F.when(ext == "", shebang(first_line(F.col(content)))) if content else F.lit(None).cast("string")
    special = F.when((ext == "") & name.isin(*SPECIAL_NAMES), name)
    known = F.coalesce(code, config, other)
    return files.withColumns(
        {
            "language": F.coalesce(known, by_line, special, F.lit("Unknown")),
            "category": F.when(code.isNotNull(), "code").when(config.isNotNull(), "config").when(other.isNotNull(), "non_code").when(by_line.isNotNull(), "code")
            .when(special.isNotNull(), "config").otherwise("unknown"),
            "detection_method": F.when(known.isNotNull(), "extension").when(by_line.isNotNull(), "shebang").when(special.isNotNull(), "filename").otherwise("none"),
            "confidence": F.when(known.isNotNull(), "high").when(by_line.isNotNull(), "medium").when(special.isNotNull(), "high").otherwise("low"),
        }
    )


def excluded(path: Column, folders: tuple[str, ...] = SCAN_EXCLUDES, fold: bool = False) -> Column:
    """Whether some folder of the path is one of `folders`."""
    parts = F.split(path, "/")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(F.transform(parts, lambda p: F.lower(p)) if fold else parts, F.array(*[F.lit(x) for x in folders]))


def normalised(path: Column) -> Column:
    """Forward slashes, no leading "./" or "/"."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), r"^/+", "")


def module_name(path: Column) -> Column:
    """The dotted module of a source path; a package's own module is the package."""
    dotted = F.replace(F.regexp_replace(path, r"\.pyw?$", ""), F.lit("/"), F.lit("."))
    return F.array_join(F.filter(F.split(F.regexp_replace(dotted, r"(^|\.)__init__$", ""), r"\."), lambda p: p != ""), ".")


def module_variants(path: Column) -> Column:
    """The module, its last part and the file's stem, distinct and in that order."""
    module = module_name(path)
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    names = F.array(module, F.element_at(F.split(module, r"\."), -1), F.when(stem != "__init__", stem))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))


def resolve_relative(module: Column, dots: Column, name: Column, keep_quirk: bool = True) -> Column:
    """The absolute module a relative import means; with the quirk, levels count from the module itself."""
    parts = F.split(module, r"\.")
    up = dots - 1 if keep_quirk else dots
    base = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - up))
    return F.array_join(F.concat(base, F.filter(F.array(name), lambda x: x.isNotNull() & (x != ""))), ".")


def is_test(path: Column) -> Column:
    low = F.lower(path)
    name = file_name(low)
    return name.startswith("test_") | name.endswith("_test.py") | low.startswith("tests/") | low.contains("/tests/")
