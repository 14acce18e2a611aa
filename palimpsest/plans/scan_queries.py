"""Queries over the code corpus: scanning, versions, selection and pairs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import paths, rules
from palimpsest.operators import pairs as P
from palimpsest.operators import scan as S
from palimpsest.sources import corpus

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _in(names, value: str) -> str:
    return f"{value} IN ({', '.join(chr(39) + n + chr(39) for n in names)})"


def _map(table: dict[str, str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_ALL = paths.CODE_EXTENSIONS | paths.CONFIG_EXTENSIONS | paths.OTHER_EXTENSIONS
_SCAN = f"""{corpus.FILES_SQL},
kept AS (SELECT *, list_extract(string_split(path, '/'), -1) AS name FROM files WHERE NOT list_has_any(string_split(path, '/')[:-2], [{', '.join(repr(x) for x in paths.SCAN_EXCLUDES)}])),
ext AS (SELECT *, lower(regexp_extract(name, '^.*[^.].*?(\\.[^.]+)$', 1)) AS e, string_split(content, chr(10))[1] AS line FROM kept),
manifest AS (SELECT *, coalesce({_map(_ALL, 'e')}, CASE WHEN e = '' AND line LIKE '#!%python%' THEN 'Python' WHEN e = '' AND name IN ('Dockerfile', 'Makefile', 'Jenkinsfile') THEN name END, 'Unknown') AS language,
 CASE WHEN {_in(paths.CODE_EXTENSIONS, 'e')} THEN 'code' WHEN {_in(paths.CONFIG_EXTENSIONS, 'e')} THEN 'config' WHEN {_in(paths.OTHER_EXTENSIONS, 'e')} THEN 'non_code' WHEN e = '' AND line LIKE '#!%python%' THEN 'code' ELSE 'unknown' END AS category,
 CASE WHEN {_in(_ALL, 'e')} THEN 'extension' WHEN e = '' AND line LIKE '#!%python%' THEN 'shebang' ELSE 'none' END AS detection_method FROM ext)"""
_VERSION = f"""{_SCAN},
sig AS (SELECT *, {rules.rules_sql('content', rules.PY2_SIGNALS)} AS two, {rules.rules_sql('content', rules.PY3_SIGNALS)} AS three FROM manifest),
versioned AS (SELECT *, CASE WHEN category <> 'code' OR language <> 'Python' THEN NULL WHEN len(two) > 0 AND len(three) > 0 THEN 'ambiguous' WHEN len(two) > 0 THEN '2' WHEN len(three) > 0 THEN '3' ELSE 'unknown' END AS version FROM sig)"""
_SELECT = f"""{_VERSION},
selected AS (SELECT *, CASE WHEN category <> 'code' THEN 'not_code' WHEN language <> 'Python' THEN 'wrong_language' WHEN version IS NULL THEN 'no_version_detection_available' WHEN version = '3' THEN 'already_on_target_version' WHEN version IN ('unknown', 'ambiguous') THEN 'version_' || version END AS reason FROM versioned),
routed AS (SELECT *, CASE WHEN reason IS NULL THEN 'targets' WHEN reason LIKE 'version_%' THEN 'needs_review' ELSE 'skipped' END AS bucket FROM selected)"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(corpus.files(spark, d))


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    return S.version_signals(_manifest(spark, d))


@query(f"WITH {_SCAN} SELECT doc_id, path, language, category, detection_method, size_bytes FROM manifest")
def scan_classify(spark, d):
    return _manifest(spark, d).select("doc_id", "path", "language", "category", "detection_method", "size_bytes")


@query(f"WITH {corpus.FILES_SQL} SELECT doc_id, CASE WHEN string_split(content, chr(10))[1] LIKE '#!%python%' THEN 'Python' END AS interpreter FROM files")
def scan_shebang(spark, d):
    return corpus.files(spark, d).select("doc_id", paths.shebang(paths.first_line(F.col("content"))).alias("interpreter"))


@query(
    f"""WITH {_SCAN}, dom AS (SELECT unnest(['code', 'config', 'non_code', 'unknown']) AS name),
SELECT 'language' AS kind, language AS name, count(*) AS n FROM manifest GROUP BY language UNION ALL
SELECT 'category', dom.name, count(manifest.doc_id) FROM dom LEFT JOIN manifest ON manifest.category = dom.name GROUP BY dom.name""".replace("]) AS name),\nSELECT", "]) AS name)\nSELECT")
)
def scan_summary(spark, d):
    return S.scan_summary(_manifest(spark, d))


@query(f"WITH {_SCAN} SELECT DISTINCT language FROM manifest WHERE language <> 'Unknown'")
def scan_languages(spark, d):
    return S.languages(_manifest(spark, d))


@query(f"WITH {_VERSION} SELECT doc_id, version, CASE WHEN version IN ('2', '3') THEN 'medium' WHEN version IS NOT NULL THEN 'low' END AS version_confidence, CASE WHEN version IS NOT NULL THEN array_to_string(list_concat(two, three), ' ~ ') END AS signals FROM versioned")
def version_heuristic(spark, d):
    return _versioned(spark, d).select("doc_id", "version", "version_confidence", F.array_join("signals", " ~ ").alias("signals"))


_VOTE = f"""{corpus.FILES_SQL}, v AS (SELECT doc_id, {rules.rules_sql('content', rules.PY2_VOTES)} AS two, {rules.rules_sql('content', rules.PY3_VOTES)} AS three FROM files)"""


@query(f"WITH {_VOTE} SELECT doc_id, CASE WHEN len(two) > len(three) THEN 'Python 2' WHEN len(three) > len(two) THEN 'Python 3' ELSE 'Ambiguous' END AS verdict FROM v")
def version_vote(spark, d):
    return corpus.files(spark, d).select("doc_id", S.version_vote(F.col("content")).alias("verdict"))


@query(f"WITH {_VERSION} SELECT count(*) FILTER (WHERE version = '2') AS n_version_2, count(*) FILTER (WHERE version = '3') AS n_version_3, count(*) FILTER (WHERE version IN ('ambiguous', 'unknown')) AS n_unclear FROM versioned")
def version_counts(spark, d):
    return S.version_counts(_versioned(spark, d))


@query(
    f"""WITH {_VOTE} SELECT doc_id, array_to_string(list_sort(two), ',') AS reasons,
 array_to_string(list_transform(list_sort(two), lambda r: {'CASE ' + ' '.join("WHEN r = '" + k + "' THEN '" + a.replace("'", "''") + "'" for k, a in rules.ADVICE.items()) + ' END'}), ' ') AS notes FROM v"""
)
def migration_reasons_notes(spark, d):
    reasons = S.migration_reasons(F.col("content"))
    return corpus.files(spark, d).select("doc_id", F.array_join(reasons, ",").alias("reasons"), F.array_join(rules.advice(reasons), " ").alias("notes"))


@query(f"WITH {_SELECT} SELECT doc_id, bucket, reason FROM routed")
def select_router(spark, d):
    return S.select_files(_versioned(spark, d)).select("doc_id", "bucket", "reason")


@query(f"WITH {_SELECT} SELECT count(*) FILTER (WHERE bucket = 'targets') AS n_targets, count(*) FILTER (WHERE bucket = 'needs_review') AS n_needs_review, count(*) FILTER (WHERE bucket = 'skipped') AS n_skipped FROM routed")
def select_counts(spark, d):
    return S.bucket_counts(S.select_files(_versioned(spark, d)))


@query(f"WITH {corpus.FILES_SQL} SELECT doc_id, replace(regexp_replace(path, '\\.pyw?$', ''), '/', '.') AS module FROM files WHERE path LIKE '%.py'")
def module_names(spark, d):
    return corpus.files(spark, d).where(F.col("path").endswith(".py")).select("doc_id", paths.module_name(F.col("path")).alias("module"))


@query(
    f"""WITH {corpus.FILES_SQL} SELECT doc_id, array_to_string(list_filter([replace(regexp_replace(path, '\\.py$', ''), '/', '.'), regexp_replace(list_extract(string_split(path, '/'), -1), '\\.py$', '')], lambda x: x <> ''), ',') AS variants FROM files WHERE path LIKE '%.py'"""
)
def module_variants(spark, d):
    return corpus.files(spark, d).where(F.col("path").endswith(".py")).select("doc_id", F.array_join(paths.module_variants(F.col("path")), ",").alias("variants"))


@query(f"WITH {corpus.FILES_SQL} SELECT doc_id, (regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '_test\\.py$') OR path LIKE 'tests/%' OR path LIKE '%/tests/%') AS is_test FROM files")
def test_file_flag(spark, d):
    return corpus.files(spark, d).select("doc_id", paths.is_test(F.col("path")).alias("is_test"))


@query(f"WITH {corpus.PAIRS_SQL} SELECT doc_id, array_to_string({rules.rules_sql('original_code', rules.PAIR_MARKERS)}, ' ') AS markers_in_original, array_to_string({rules.rules_sql('migrated_code', rules.PAIR_MARKERS)}, ' ') AS markers_remaining, array_to_string({rules.rules_sql('original_code', rules.SIX_MARKERS)}, ' ') AS six_in_original FROM pairs")
def quality_markers(spark, d):
    m = P.markers(corpus.pairs(spark, d))
    return m.select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("markers_in_original", "markers_remaining", "six_in_original")])


#: (original parses, migrated parses, ratio of matching blocks, label) of each pair of the corpus.
_GRADES = [
    (True, True, 0.963, "high_confidence"), (True, True, 0.989, "high_confidence"), (True, True, 0.758, "high_confidence"), (True, True, 0.92, "high_confidence"),
    (True, True, 0.864, "needs_review"), (True, True, 0.988, "high_confidence"), (False, True, 0.933, "high_confidence"), (True, True, 0.938, "high_confidence"),
    (True, True, 0.877, "needs_review"), (True, True, 1.0, "likely_noise"), (True, True, 0.912, "high_confidence"), (True, True, 0.811, "needs_review"),
]
_GRADED = corpus.by_template(["original_parses", "migrated_parses", "similarity_ratio", "label"], [(k, *g) for k, g in enumerate(_GRADES)], path_as=None)


@query(f"SELECT doc_id FROM ({_GRADED}) WHERE label = 'high_confidence'")
def high_confidence(spark, d):
    return P.high_confidence(P.graded(corpus.pairs(spark, d))).select("doc_id")


@query(_GRADED.replace("v.similarity_ratio", "CAST(v.similarity_ratio AS DOUBLE) AS similarity_ratio"))
def quality_label(spark, d):
    return P.graded(corpus.pairs(spark, d)).select("doc_id", "original_parses", "migrated_parses", "similarity_ratio", "label")


_AFTER = f"list_filter({rules.rules_sql('original_code', rules.QUERY_PATTERNS)}, lambda x: list_contains({rules.rules_sql('migrated_code', rules.AFTER_PATTERNS)}, x))"


@query(f"WITH {corpus.PAIRS_SQL} SELECT doc_id, array_to_string({_AFTER}, ',') AS patterns FROM pairs")
def pair_patterns(spark, d):
    return corpus.pairs(spark, d).select("doc_id", F.array_join(rules.before_after(F.col("original_code"), F.col("migrated_code")), ",").alias("patterns"))


@query(f"WITH {corpus.PAIRS_SQL} SELECT doc_id AS file, function_name AS name, original_code, migrated_code FROM pairs WHERE original_code <> migrated_code AND len(string_split(regexp_replace(migrated_code, '\\n$', ''), chr(10))) BETWEEN 2 AND 120")
def changed_functions(spark, d):
    p = corpus.pairs(spark, d).select("repo", F.col("doc_id").alias("file"), F.col("function_name").alias("name"), "original_code", "migrated_code")
    old, new = p.select("repo", "file", "name", F.col("original_code").alias("text")), p.select("repo", "file", "name", F.col("migrated_code").alias("text"))
    return P.changed_functions(old, new).drop("repo")


@query(f"WITH {corpus.PAIRS_SQL} SELECT sha256(original_code || chr(0) || migrated_code) AS content_hash, min(doc_id) AS doc_id FROM pairs GROUP BY 1")
def pair_dedup(spark, d):
    p = corpus.pairs(spark, d).select("doc_id", P.content_hash(F.col("original_code"), F.col("migrated_code")).alias("content_hash"))
    return P.first_of_each(p.select("content_hash", "doc_id"), "content_hash", "doc_id")


@query("SELECT o_orderkey, 'mig_' || substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority, '', o_orderstatus)), 1, 16) AS id FROM orders")
def deterministic_id(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", P.deterministic_id("mig_", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(None), F.col("o_orderstatus")).alias("id"))


@query(
    f"""WITH {corpus.PAIRS_SQL}, r AS (SELECT doc_id, 'org/' || repo AS repo, doc_id % 1000 AS pr_number, 'src/m' || CAST(doc_id AS VARCHAR) || '.py' AS file_path, CASE WHEN doc_id % 2 = 0 THEN 'C.' || function_name ELSE function_name END AS function_name, CASE WHEN doc_id % 3 > 0 THEN 'a1b2' END AS base_sha FROM pairs)
SELECT doc_id, 'github_py23_' || substr(sha256(concat_ws('|', repo, CAST(pr_number AS VARCHAR), file_path, function_name, coalesce(base_sha, ''), 'ff00')), 1, 16) AS id, split_part(repo, '/', 2) AS project_name, 'https://github.com/' || repo AS repo_url,
 'https://github.com/' || repo || '/blob/' || base_sha || '/' || file_path AS source_url, 'https://github.com/' || repo || '/blob/ff00/' || file_path AS target_url, CASE WHEN function_name LIKE 'C.%' THEN 'C' END AS class_name FROM r"""
)
def enrich_record(spark, d):
    p = corpus.pairs(spark, d)
    doc = F.col("doc_id")
    rows = p.select(
        "doc_id", F.concat(F.lit("org/"), "repo").alias("repo"), F.pmod(doc, F.lit(1000)).alias("pr_number"), F.concat(F.lit("src/m"), doc.cast("string"), F.lit(".py")).alias("file_path"),
        F.when(doc % 2 == 0, F.concat(F.lit("C."), "function_name")).otherwise(F.col("function_name")).alias("function_name"), F.when(doc % 3 > 0, "a1b2").alias("base_sha"), F.lit("ff00").alias("head_sha"),
    )
    return P.enriched(rows).select("doc_id", "id", "project_name", "repo_url", "source_url", "target_url", "class_name")


@query("SELECT quality AS label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM labels), 1) AS percent FROM labels GROUP BY quality")
def label_percentages(spark, d):
    return P.percentages(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "label"), "label")


@query("SELECT text, count(DISTINCT doc_id % 3) AS n_splits FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 3) > 1")
def split_leakage(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("text", F.pmod(F.col("doc_id"), F.lit(3)).alias("split"))
    return P.leaking(docs, "text", "split")


@query("SELECT doc_id, CASE WHEN CAST(doc_id AS VARCHAR) LIKE '12%' THEN 'val' WHEN CAST(doc_id AS VARCHAR) LIKE '1%' THEN 'train' WHEN CAST(doc_id AS VARCHAR) LIKE '7%' THEN 'test' END AS split FROM documents")
def split_by_prefix(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    prefixes = spark.createDataFrame([("1", "train"), ("12", "val"), ("7", "test")], "prefix string, split string")
    return P.split_of_prefix(docs, prefixes).select("doc_id", "split")


@query("SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic")
def value_counts(spark, d):
    return P.value_counts(spark.read.parquet(f"{d}/labels.parquet"), "toxic")
