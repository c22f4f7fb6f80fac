"""SARIF reports as tables of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.operators import findings

REGION = "startLine int, startColumn int, endLine int, endColumn int"
SCHEMA = f"""runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string, name: string, shortDescription: struct<text: string>,
 defaultConfiguration: struct<level: string>, properties: string>>>>,
 results: array<struct<ruleId: string, level: string, rank: double, message: struct<text: string>,
 locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<{REGION}>>>>, properties: string>>>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all reports under ``path``: id, source, rule_id, message, severity, path, start_line, start_column, tags."""
    runs = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.input_file_name().alias("report"), F.posexplode("runs").alias("run_no", "run"))
    rules = runs.select("report", "run_no", F.posexplode("run.tool.driver.rules").alias("n", "rule")).select("report", "run_no", "n", F.col("rule.id").alias("rule_id"), "rule")
    last = F.row_number().over(Window.partitionBy("report", "run_no", "rule_id").orderBy(F.desc("n")))
    rules = rules.withColumn("k", last).where("k = 1").select("report", "run_no", "rule_id", "rule")
    results = runs.select("report", "run_no", F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r")).withColumn("rule_id", F.col("r.ruleId"))
    both = results.join(rules, ["report", "run_no", "rule_id"], "left")
    prop = lambda of, key: F.get_json_object(F.col(f"{of}.properties"), f"$['{key}']")
    severity = findings.recovered(
        [prop("r", "security-severity"), prop("rule", "security-severity")],
        F.col("r.rank"),
        [F.coalesce(prop(of, "zizmor/severity"), prop(of, "severity")) for of in ("r", "rule")],
        [F.col("r.level"), F.col("rule.defaultConfiguration.level")],
    )
    place = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    source = findings.source_of(F.col("tool"))
    line, column = place["region"]["startLine"], place["region"]["startColumn"]
    uri = F.translate(F.regexp_replace(place["artifactLocation"]["uri"], "^file://", ""), "\\", "/")
    out = [findings.finding_id(source, F.col("rule_id"), place["artifactLocation"]["uri"], line, column).alias("id"), source.alias("source"), "rule_id"]
    return both.select(*out, F.col("r.message.text").alias("message"), severity.alias("severity"), uri.alias("path"), line.alias("start_line"), column.alias("start_column"), F.from_json(prop("rule", "tags"), "array<string>").alias("tags"))
