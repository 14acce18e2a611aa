"""Migration contexts: what each planned unit's prompt needs from the rest of its repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.parse import blocks_of
from palimpsest.operators.plan import stem


#: Letters of a stem by which tests and units meet.
GRAM = 8


def relations(units: DataFrame, edges: DataFrame, forward: bool = True) -> DataFrame:
    """(file, relations): for each unit its dependencies (or dependents) with edge details."""
    own, other = ("source", "target") if forward else ("target", "source")
    e = edges.join(units.select(F.col("file").alias(own)), own, "left_semi")
    per = e.groupBy(F.col(own).alias("file"), F.col(other).alias("other")).agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("name")).alias("symbols"))
    nested = per.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("other").alias("file"), "types", "symbols"))).alias("relations"))
    return units.select("file").join(nested, "file", "left")


def dependency_source(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, code): the blocks of the target file that the source file refers to."""
    wanted = edges.groupBy("source", "target").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return wanted.join(files.select(F.col("path").alias("target"), "content"), "target").select("source", "target", blocks_of("content", "names").alias("code"))


def inferred_tests(units: DataFrame, tests: DataFrame, found: DataFrame) -> DataFrame:
    """(file, test) for units without related tests: test files whose path or source contains the unit's stem, with or without underscores.

    Tests and stems meet by equality on the stem's first GRAM letters (all of a shorter one), which a
    containing text has somewhere, and are then verified; so no unit is compared with every test.
    """
    without = units.select("file").join(found.select("file"), "file", "left_anti").select("file", F.lower(stem(F.col("file"))).alias("s"))
    keys = without.select("file", F.explode(F.array_distinct(F.array("s", F.replace("s", F.lit("_"), F.lit(""))))).alias("stem")).where("stem <> ''")
    keys = keys.withColumn("gram", F.substring("stem", 1, GRAM))
    sizes = keys.agg(F.collect_set(F.length("gram")).alias("sizes"))  # at most GRAM of them
    text = F.concat_ws("\n", F.lower("path"), F.lower("content"))
    held = tests.select(F.col("path").alias("test"), text.alias("text")).join(F.broadcast(sizes))
    grams = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, n))))
    seen = held.select("test", F.explode(F.array_distinct(grams)).alias("gram")).join(keys, "gram").where("file <> test").select("test", "file", "stem")
    return seen.join(held.select("test", "text"), "test").where(F.contains("text", "stem")).select("file", "test").distinct()


def contexts(units: DataFrame, edges: DataFrame, files: DataFrame, tests: DataFrame) -> DataFrame:
    """One nested row for each unit: target, dependencies, dependents, tests."""
    named = tests.groupBy("file").agg(F.array_sort(F.collect_set("test")).alias("tests"))
    source = files.select(F.col("path").alias("file"), F.col("content").alias("source"))
    return (
        units.join(source, "file", "left")
        .join(relations(units, edges).withColumnRenamed("relations", "dependencies"), "file", "left")
        .join(relations(units, edges, False).withColumnRenamed("relations", "dependents"), "file", "left")
        .join(named, "file", "left")
    )


def normalised_text(text: Column) -> Column:
    """Null as empty, line ends as "\\n", no white space around."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default))


def safe_number(value: Column) -> Column:
    """The number in a JSON text, a boolean as 1 or 0; 0 for anything else."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    return F.coalesce(number, F.lit(0.0))


def version_label(language: Column, version: Column) -> Column:
    """"{language} {version}", unless the version already starts so."""
    v = F.trim(F.coalesce(version, F.lit("")))
    return F.when(v == "", F.trim(language)).when(F.lower(v).startswith(F.lower(F.trim(language))), v).otherwise(F.concat_ws(" ", F.trim(language), v))


def validated_cases(cases: DataFrame, expected: int) -> DataFrame:
    """Cases of callables that have exactly the expected number of them; fails on others."""
    n = cases.groupBy("qualified_name").agg(F.count("*").alias("n"))
    checked = n.withColumn("n", F.when(F.col("n") == expected, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("wrong number of cases for "), "qualified_name")).cast("long")))
    return cases.join(checked, "qualified_name").drop("n")


def with_constructors(callables: DataFrame) -> DataFrame:
    """Methods with the parameters of their class's constructor; the last one of a file and class wins."""
    c = callables.where("kind = 'constructor'").groupBy("file", "class_name").agg(F.max_by("parameters", "line").alias("constructor_parameters"))
    return callables.join(c, ["file", "class_name"], "left")


def test_framework(files: DataFrame) -> DataFrame:
    """One row: the framework a repository's tests use (none, pytest, unittest, unknown)."""
    name = F.element_at(F.split("path", "/"), -1)
    is_py = F.col("path").endswith(".py")
    tests = is_py & (name.startswith("test_") | name.endswith("_test.py") | F.col("path").rlike("(^|/)tests/"))
    config = name.isin("pytest.ini", "conftest.py", "tox.ini", "setup.cfg", "pyproject.toml", "requirements.txt") & F.coalesce(F.col("content").contains("pytest"), F.lit(False))
    flags = files.agg(
        F.coalesce(F.bool_or(tests), F.lit(False)).alias("any"), F.coalesce(F.bool_or(config), F.lit(False)).alias("cfg"),
        F.coalesce(F.bool_or(tests & F.col("content").contains("pytest")), F.lit(False)).alias("p"), F.coalesce(F.bool_or(tests & F.col("content").contains("unittest")), F.lit(False)).alias("u"),
    )
    return flags.select(F.when(~F.col("any"), "none").when(F.col("cfg") | F.col("p"), "pytest").when(F.col("u"), "unittest").otherwise("unknown").alias("framework"))
