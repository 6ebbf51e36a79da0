"""Discovery over files: funnel, config rules, dynamic imports, API descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.maintenance import numbered

# Extensions that have a parser.
SUPPORTED = ["ts", "tsx", "js", "jsx", "mjs", "py", "go", "java", "cs", "rs", "c", "h"]


def funnel_reason(path: Column, text: Column, size: Column, most: int = 1_000_000) -> Column:
    """Why a file is not parsed, null if it is: one reason, the first that holds."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    bang = F.regexp_extract(F.substring_index(text, "\n", 1), r"^#!.*?\b(node|python3?|bash|sh)\b", 1)
    return (
        F.when(size > most, "too-large").when(F.instr(F.substring(text, 1, 8000), "\0") > 0, "binary").when(text.isNull(), "unreadable")
        .when((ext == "") & (bang == ""), "no-extension").when((ext != "") & ~ext.isin(SUPPORTED), "unsupported-extension")
    )


def config_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, tags, project_type): tags of all rules that match a file's name and marker; the last type by rule order wins.

    files: (project, name, content); rules: (rule_id, name, marker, tag, type), a fixed table; an exact name and, if
    there is a marker, its text in the content. Projects without a match are 'general'.
    """
    r = F.broadcast(rules.withColumnRenamed("name", "rule_name"))
    hit = files.join(r, F.col("name") == F.col("rule_name")).where(F.col("marker").isNull() | (F.instr(F.col("content"), F.col("marker")) > 0))
    per = hit.groupBy("project").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.max_by("type", "rule_id").alias("project_type"))
    return files.select("project").distinct().join(per, "project", "left").select(
        "project", F.coalesce("tags", F.array(F.lit("general"))).alias("tags"), F.coalesce("project_type", F.lit("generic")).alias("project_type")
    )


def dynamic_imports(files: DataFrame) -> DataFrame:
    """(path, specifier, literal): import() and require() calls outside line comments; literal is false for other arguments."""
    code = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^\s*//[^\n]*$", "")
    calls = F.regexp_extract_all(code, F.lit(r"\b(?:import|require)\s*\(\s*([^)]*?)\s*\)"), 1)
    e = files.select("path", F.explode(calls).alias("arg")).where("arg <> ''")
    literal = F.col("arg").rlike("^(['\"])[^'\"]*['\"]$")
    return e.select("path", F.when(literal, F.regexp_replace("arg", "^['\"]|['\"]$", "")).otherwise(F.col("arg")).alias("specifier"), literal.alias("literal"))


def import_candidates(imports: DataFrame, files: DataFrame, most: int = 64) -> DataFrame:
    """(path, specifier, n, status): files that the fixed prefix of a template specifier may mean, found by their directory.

    imports: (path, specifier, prefix, suffix), prefix ending with a slash. More than most candidates are unresolved.
    """
    f = files.select(F.col("path").alias("f"), F.concat(F.regexp_replace("path", "[^/]*$", "")).alias("dir"))
    hit = imports.join(f, (F.col("prefix") == F.col("dir")) & F.col("f").endswith(F.col("suffix")), "left")
    return hit.groupBy("path", "specifier").agg(F.count("f").alias("n")).withColumn(
        "status", F.when(F.col("n") == 0, "none").when(F.col("n") > most, "too-many").otherwise("bounded")
    )


def first_existing(requests: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """(request_id, path): the first of stem + extension, in the order of extensions, that exists; null if none."""
    c = requests.select("request_id", F.posexplode(F.transform(F.array(*[F.lit(x) for x in extensions]), lambda x: F.concat("stem", x))).alias("i", "path"))
    hit = c.join(files.select("path").distinct(), "path", "left_semi")
    return requests.select("request_id").join(hit.groupBy("request_id").agg(F.min_by("path", "i").alias("path")), "request_id", "left")


def api_endpoints(specs: DataFrame) -> DataFrame:
    """(spec_id, route, method): one row a path and method of API descriptions in JSON; other JSON gives none."""
    schema = "openapi string, swagger string, basePath string, paths map<string, map<string, string>>"
    s = specs.select("spec_id", F.from_json("json", schema).alias("j")).where("j.openapi IS NOT NULL OR j.swagger IS NOT NULL")
    p = s.select("spec_id", F.coalesce("j.basePath", F.lit("")).alias("base"), F.explode("j.paths").alias("route", "ops"))
    return p.select("spec_id", F.concat("base", "route").alias("route"), F.explode(F.map_keys("ops")).alias("method")).where(F.lower("method").isin("get", "put", "post", "delete", "patch", "head", "options", "trace"))


def signature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type, name, change): internal if the signature without body is the same, else contract; missing ones are contract.

    Both: (type, name, signature, pos); of several of a name the first counts.
    """
    pick = lambda df, c: df.groupBy("type", "name").agg(F.min_by("signature", "pos").alias(c))
    j = pick(old, "a").join(pick(new, "b"), ["type", "name"], "full")
    return j.select("type", "name", F.when(F.col("a") == F.col("b"), "internal").otherwise("contract").alias("change"))


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Canonical order with nulls first; row numbers as position."""
    return numbered(df, keys)
