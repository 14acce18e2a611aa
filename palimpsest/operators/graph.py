"""Dependency graphs of source trees: symbols, imports, calls and classes as tables, resolved to edges.

All tables are keyed by `file`; edges are (source, target, type, name, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.lineage import cut
from palimpsest.functions.paths import file_name, is_test, module_name, module_variants, resolve_relative

EDGE_TYPES = ("import", "from_import", "function_call", "inheritance")
# Call heads that are never edges.
BUILTIN_CALLS = (
    "abs", "all", "any", "bool", "bytes", "callable", "chr", "dict", "dir", "divmod", "enumerate", "eval", "filter", "float", "format", "getattr", "hasattr", "hash",
    "hex", "id", "input", "int", "isinstance", "issubclass", "iter", "len", "list", "map", "max", "min", "next", "object", "oct", "open", "ord", "pow", "print", "range",
    "repr", "reversed", "round", "set", "slice", "sorted", "str", "sum", "super", "tuple", "type", "vars", "zip",
)
KEYWORD_CALLS = (
    "if", "elif", "else", "for", "while", "with", "try", "except", "finally", "return", "yield", "lambda", "class", "def", "assert", "raise", "del", "pass", "break",
    "continue", "import", "from",
)
_STATEMENT = r"(?dm)^[ \t]*(?:from[ \t]+[.\w]+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n]+)|import[ \t]+[^\n]+)"


def _lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("n", "text")).withColumn("line", F.col("n") + 1).drop("n")


def symbols(files: DataFrame) -> DataFrame:
    """(file, type, name, line) of every def and class line."""
    found = F.regexp_extract("text", r"^\s*(?:async\s+)?(def|class)\s+\w+", 1)
    name = F.regexp_extract("text", r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)", 1)
    kind = F.when(found == "def", "function").otherwise(found)
    return _lines(files).select("file", kind.alias("type"), name.alias("name"), "line").where("name <> ''").distinct()


def imports(files: DataFrame) -> DataFrame:
    """(file, type, module, name, alias, line): one row for each imported name; parentheses may span lines, comments are cut."""
    found, pieces = f"regexp_extract_all(content, r'{_STATEMENT}', 0)", f"split(content, r'{_STATEMENT}', -1)"
    newlines = lambda x: f"length({x}) - length(replace({x}, '\\n', ''))"
    line = f"aggregate(slice(pieces, 1, i + 1), 1, (s, x) -> s + {newlines('x')}) + aggregate(slice(found, 1, i), 0, (s, x) -> s + {newlines('x')})"
    rows = files.select(F.col("path").alias("file"), F.expr(found).alias("found"), F.expr(pieces).alias("pieces")).where("size(found) > 0")
    rows = rows.select("file", F.expr(f"inline(transform(found, (m, i) -> named_struct('statement', m, 'line', {line})))"))
    text = F.regexp_replace("statement", r"#[^\n]*", "")
    is_from = text.rlike(r"^\s*from\s")
    listed = F.when(is_from, F.regexp_replace(text, r"^\s*from\s+[.\w]+\s+import\s+", "")).otherwise(F.regexp_replace(text, r"^\s*import\s+", ""))
    items = F.filter(F.transform(F.split(F.regexp_replace(listed, r"[()]", ""), ","), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "")), lambda x: x.rlike(r"^[\w.*]"))
    rows = rows.select("file", "line", is_from.alias("is_from"), F.regexp_extract(text, r"^\s*from\s+([.\w]+)", 1).alias("base"), F.explode(items).alias("item"))
    name = F.regexp_extract("item", r"^([\w.*]+)", 1)
    alias = F.nullif(F.regexp_extract("item", r" as (\w+)$", 1), F.lit(""))
    return rows.select(
        "file", F.when(F.col("is_from"), "from_import").otherwise("import").alias("type"), F.when(F.col("is_from"), F.col("base")).otherwise(name).alias("module"),
        F.when(F.col("is_from"), name).alias("name"), alias.alias("alias"), "line",
    )


def import_names(content: Column) -> Column:
    """Lower-case distinct first modules of import lines."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?dm)^\s*(?:import|from)\s+([A-Za-z_][\w.]*)"), F.lit(1)), lambda x: F.lower(x)))


def calls(files: DataFrame) -> DataFrame:
    """(file, expr, line) of call heads, one row for each; strings and comments count, def lines don't."""
    pattern = r"(?<![\w.])(def\s+)?([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\s*\("
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("e"))
    rows = _lines(files).where(F.col("text").contains("(")).select("file", "line", F.explode(both).alias("c")).where("c.d = ''").select("file", F.col("c.e").alias("expr"), "line")
    return rows.where(~F.element_at(F.split("expr", r"\."), -1).isin(*BUILTIN_CALLS, *KEYWORD_CALLS))


def class_bases(files: DataFrame) -> DataFrame:
    """(file, class, base, line): one row for each base named in a class header."""
    head = r"^\s*class\s+(\w+)\s*\(([^()]*)\)"
    rows = _lines(files).where(F.col("text").rlike(head)).select("file", F.regexp_extract("text", head, 1).alias("class"), F.split(F.regexp_extract("text", head, 2), ",").alias("bases"), "line")
    return rows.select("file", "class", F.explode("bases").alias("base"), "line").withColumn("base", F.trim("base")).where("base <> ''")


def module_index(files: DataFrame) -> DataFrame:
    """(module, file): exact module names win (the last file of a name), then the first file by name for each variant."""
    src = files.where(F.col("path").rlike(r"\.pyw?$")).select("path", module_name(F.col("path")).alias("exact"), F.explode(module_variants(F.col("path"))).alias("module"))
    src = src.withColumn("is_exact", F.col("module") == F.col("exact"))
    both = src.groupBy("module").agg(F.max(F.when(F.col("is_exact"), F.col("path"))).alias("e"), F.min("path").alias("v"))
    return both.select("module", F.coalesce("e", "v").alias("file"))


def resolve_modules(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(module, ...) with target: the exact module, else its longest dotted prefix, else the only file of its last part's name."""
    index = module_index(files)
    names = wanted.select("module").distinct()
    parts = F.split("module", r"\.")
    prefixes = names.select("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("prefix"))
    longest = prefixes.join(index.withColumnRenamed("module", "prefix"), "prefix").groupBy("module").agg(F.max_by("file", F.length("prefix")).alias("by_prefix"))
    stems = files.where(F.col("path").rlike(r"\.pyw?$")).groupBy(F.regexp_replace(file_name(F.col("path")), r"\.pyw?$", "").alias("stem")).agg(F.count("*").alias("n"), F.min("path").alias("by_stem")).where("n = 1")
    known = names.join(longest, "module", "left").withColumn("stem", F.element_at(F.split("module", r"\."), -1)).join(stems.select("stem", "by_stem"), "stem", "left")
    return wanted.join(known.select("module", F.coalesce("by_prefix", "by_stem").alias("target")), "module", "left")


def import_edges(files: DataFrame) -> DataFrame:
    """Edges of imports whose module is a file of the tree; none to itself."""
    found = imports(files).withColumn("dots", F.length(F.regexp_extract("module", r"^(\.*)", 1)))
    absolute = F.when(F.col("dots") > 0, resolve_relative(module_name(F.col("file")), F.col("dots"), F.regexp_extract("module", r"^\.*(.*)$", 1))).otherwise(F.col("module"))
    resolved = resolve_modules(found.withColumn("module", absolute), files).where("target is not null and target <> file")
    return resolved.select(F.col("file").alias("source"), "target", "type", F.coalesce("name", "module").alias("name"), "alias", "line")


def _unique_symbols(files: DataFrame, kind: str) -> DataFrame:
    """Names defined exactly once in the whole tree, with their file."""
    return symbols(files).where(F.col("type") == kind).groupBy("name").agg(F.count("*").alias("n"), F.min("file").alias("target")).where("n = 1").select("name", "target")


def call_edges(files: DataFrame) -> DataFrame:
    """Edges of calls: an imported name, a function of an imported module, else the only function of that name."""
    made = import_edges(files)
    by_name = made.where("type = 'from_import'").groupBy(F.col("source").alias("file"), F.coalesce("alias", "name").alias("head")).agg(F.min("target").alias("t1"))
    by_module = made.where("type = 'import'").groupBy(F.col("source").alias("file"), F.coalesce("alias", "name").alias("owner")).agg(F.min("target").alias("t2"))
    unique = _unique_symbols(files, "function").select(F.col("name").alias("head"), F.col("target").alias("t3"))
    c = calls(files).withColumn("head", F.element_at(F.split("expr", r"\."), -1)).withColumn("owner", F.when(F.instr("expr", ".") > 0, F.substring_index("expr", ".", 1)))
    plain = F.col("owner").isNull()
    c = c.join(by_name, ["file", "head"], "left").join(by_module, ["file", "owner"], "left").join(unique, "head", "left")
    target = F.coalesce(F.when(plain, F.col("t1")), F.when(~plain, F.col("t2")), F.when(plain, F.col("t3")))
    return c.select(F.col("file").alias("source"), target.alias("target"), F.lit("function_call").alias("type"), F.col("head").alias("name"), "line").where("target is not null and target <> source")


def inheritance_edges(files: DataFrame) -> DataFrame:
    bases = class_bases(files).withColumn("name", F.element_at(F.split("base", r"\."), -1))
    return bases.join(_unique_symbols(files, "class"), "name").where("target <> file").select(F.col("file").alias("source"), "target", F.lit("inheritance").alias("type"), "name", "line")


def edges(files: DataFrame) -> DataFrame:
    """All four types, distinct."""
    return import_edges(files).drop("alias").unionByName(call_edges(files)).unionByName(inheritance_edges(files)).distinct()


def merged(e: DataFrame) -> DataFrame:
    """One row for each (source, target): its types, and its details in line order."""
    return e.groupBy("source", "target").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set(F.struct("line", "type", "name"))).alias("details"))


def edge_stats(e: DataFrame) -> DataFrame:
    """Edge counts by type with a total row."""
    return e.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


def reversed_edges(e: DataFrame) -> DataFrame:
    return e.withColumnsRenamed({"source": "target", "target": "source"})


def degrees(e: DataFrame) -> DataFrame:
    """(file, n_targets, n_sources, n_edges_in): distinct neighbours both ways and edge rows in."""
    out = e.groupBy(F.col("source").alias("file")).agg(F.countDistinct("target").alias("n_targets"))
    into = e.groupBy(F.col("target").alias("file")).agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_edges_in"))
    return out.join(into, "file", "full").na.fill(0)


def adjacency(e: DataFrame) -> DataFrame:
    return e.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def dependency_levels(nodes: DataFrame, e: DataFrame, node: str = "file") -> DataFrame:
    """(node, level): the round in which a node is ready, its dependencies being done; nodes of a cycle that blocks all go one at a time, smallest first.

    Each round is a join on the nodes left; the number of rounds is the graph's depth (plus one
    for each node that breaks a cycle).
    """
    left = cut(nodes.select(F.col(node).alias("v")).distinct())
    links = cut(e.select(F.col("source").alias("v"), F.col("target").alias("w")).distinct().join(left, "v", "left_semi").join(left.withColumnRenamed("v", "w"), "w", "left_semi").where("v <> w"))
    done, level = None, 0
    while left.limit(1).count():
        ready = left.join(links.select("v").distinct(), "v", "left_anti")
        if not ready.limit(1).count():
            ready = left.agg(F.min("v").alias("v"))
        ready = cut(ready.withColumn("level", F.lit(level)))
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready, "v", "left_anti"))
        links = cut(links.join(ready.select(F.col("v").alias("w")), "w", "left_anti").join(ready.select("v"), "v", "left_anti"))
        level += 1
    done = done if done is not None else left.withColumn("level", F.lit(0))
    return done.withColumnRenamed("v", node)


def cycles(e: DataFrame) -> DataFrame:
    """(component, members): strongly connected components of more than one node, by trimming and two-way label spreading.

    Nodes without an edge in or out are trimmed first, which leaves only what lies on or between
    cycles; then (min forward label, min backward label) are refined until they stop splitting.
    """
    links = cut(e.select(F.col("source").alias("v"), F.col("target").alias("w")).where("v <> w").distinct())
    found = None
    while True:
        size = links.count()
        while size:  # trim
            links = cut(links.join(links.select(F.col("w").alias("v")).distinct(), "v", "left_semi").join(links.select(F.col("v").alias("w")).distinct(), "w", "left_semi"))
            now = links.count()
            if now == size:
                break
            size = now
        if not size:
            break
        forward, backward = _smallest_reaching(links, "v", "w"), _smallest_reaching(links, "w", "v")
        both = cut(forward.withColumnRenamed("label", "f").join(backward.withColumnRenamed("label", "b"), "x"))
        settled = both.where("f = b")  # the smallest node reaches it and is reached by it
        found = settled.select("x", F.col("f").alias("component")) if found is None else found.unionByName(settled.select("x", F.col("f").alias("component")))
        rest = both.where("f <> b")
        links = cut(
            links.join(rest.select(F.col("x").alias("v"), F.col("f").alias("fv"), F.col("b").alias("bv")), "v").join(rest.select(F.col("x").alias("w"), F.col("f").alias("fw"), F.col("b").alias("bw")), "w")
            .where("fv = fw AND bv = bw").select("v", "w")
        )
    if found is None:
        return e.sparkSession.createDataFrame([], "component string, members array<string>")
    return found.groupBy("component").agg(F.array_sort(F.collect_set("x")).alias("members")).where("size(members) > 1")


def _smallest_reaching(links: DataFrame, start: str, end: str) -> DataFrame:
    """(x, label): the smallest node with a path to x along start -> end."""
    nodes = links.select(F.col("v").alias("x")).union(links.select(F.col("w").alias("x"))).distinct()
    labels = cut(nodes.withColumn("label", F.col("x")))
    while True:
        pushed = links.join(labels, links[start] == labels.x).groupBy(F.col(end).alias("x")).agg(F.min("label").alias("near"))
        nxt = cut(labels.join(pushed, "x", "left").select("x", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was")))
        moved = nxt.where("label <> was").limit(1).count()
        labels = nxt.select("x", "label")
        if not moved:
            return labels


def file_metadata(files: DataFrame) -> DataFrame:
    """(file, functions, classes, imports, is_test): what each file defines and imports."""
    s = symbols(files).groupBy("file").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "function", F.struct("line", "name")))).alias("functions"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "class", F.struct("line", "name")))).alias("classes"),
    )
    i = imports(files).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "type", "module", "name"))).alias("imports"))
    return files.select(F.col("path").alias("file"), is_test(F.col("path")).alias("is_test")).join(s, "file", "left").join(i, "file", "left")
