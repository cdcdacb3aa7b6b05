"""Exports and stored tables: CSV and JSON reports, knowledge and vectors on disk, HTML rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions.numbers import sql_round2, sql_sum
from qaspark.functions.tables import exists, shared_folder
from qaspark.operators.knowledge import TYPES
from qaspark.operators.metrics import SQL_REPORT, comprehensive_report
from qaspark.operators.results import SQL_OUTCOMES, SQL_PRIORITY, SQL_SEVERITY, _priority, report_rows, result_summary, severity
from qaspark.registry import query

# Header of the CSV export.
CSV_COLUMNS = ("Test Name", "Status", "Type", "Endpoint", "Method", "Severity", "Priority", "Execution Time", "Error")


@query("results", sql="SELECT coalesce(name, 'Unnamed Test') AS \"Test Name\", CASE WHEN coalesce(passed, false) THEN 'PASSED' ELSE 'FAILED' END AS Status, test_type AS Type, endpoint AS Endpoint, method AS Method, CASE WHEN test_type IN ('authentication', 'security') THEN 'critical' WHEN test_type IN ('validation', 'error_handling') THEN 'major' WHEN test_type IN ('boundary', 'edge_case') THEN 'normal' ELSE 'minor' END AS Severity, CASE WHEN NOT coalesce(passed, false) AND test_type IN ('authentication', 'security') THEN 'high' WHEN NOT coalesce(passed, false) AND test_type IN ('validation', 'error_handling') THEN 'medium' ELSE 'low' END AS Priority, execution_time AS \"Execution Time\", coalesce(error, '') AS Error FROM results")
def export_results_csv(results: DataFrame) -> DataFrame:
    """The nine columns of the CSV export; ``write_csv`` writes them."""
    kind = severity(F.col("test_type"))
    values = [F.coalesce("name", F.lit("Unnamed Test")), F.when(F.coalesce("passed", F.lit(False)), "PASSED").otherwise("FAILED"), F.col("test_type"), F.col("endpoint"), F.col("method"), kind, _priority(kind), F.col("execution_time"), F.coalesce("error", F.lit(""))]
    return results.select(*[v.alias(n) for v, n in zip(values, CSV_COLUMNS, strict=True)])


def write_csv(results: DataFrame, path: str) -> None:
    export_results_csv(results).write.csv(path, header=True)


@query("results", "agent_metrics", sql=f"SELECT section, count(*) AS n FROM ({SQL_REPORT}) GROUP BY 1 UNION ALL SELECT 'raw_tests', count(*) FROM results UNION ALL SELECT 'raw_agents', count(*) FROM agent_metrics")
def export_metrics_json(metrics: DataFrame, agents: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the comprehensive report and the raw metrics as JSON lines; returns how many lines each section has, read back."""
    spark = metrics.sparkSession
    path = path or shared_folder(spark)
    parts = {"report": comprehensive_report(metrics, agents), "raw_tests": metrics, "raw_agents": agents}
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
    found = spark.read.schema("section string").json(f"{path}/report")
    for name in ("raw_tests", "raw_agents"):
        found = found.unionByName(spark.read.schema(parts[name].schema).json(f"{path}/{name}").select(F.lit(name).alias("section")))
    return found.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("results", sql="SELECT id, name, error FROM results ORDER BY ts, id LIMIT 100")
def training_extract(results: DataFrame, n: int = 100) -> DataFrame:
    """The first results by time, as training data."""
    return results.orderBy("ts", "id").limit(n).select("id", "name", "error")


# The parts of an HTML report.
HTML_STYLE = """body { font-family: Arial, sans-serif; margin: 20px; }
        .summary { background: #f0f0f0; padding: 20px; margin-bottom: 20px; }
        .test-case { border: 1px solid #ddd; margin: 10px 0; padding: 15px; }
        .passed { border-left: 5px solid green; }
        .failed { border-left: 5px solid red; }
        .critical { background: #ffe0e0; }
        table { width: 100%; border-collapse: collapse; }
        th, td { border: 1px solid #ddd; padding: 8px; text-align: left; }
        th { background: #4CAF50; color: white; }"""
HTML_END = "</body>\n</html>"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_text(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _paragraph(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<p><strong>{name}:</strong> "), value, F.lit("</p>\n"))


_ESC = "replace(replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_P = "'<p><strong>{}:</strong> ' || {} || '</p>' || chr(10)"
_CLASS = f"CASE WHEN {SQL_SEVERITY} = 'critical' THEN ' critical' ELSE '' END"
_STATUS = "CASE WHEN coalesce(passed, false) THEN 'PASSED' ELSE 'FAILED' END"
_SQL_FIELDS = {"Type": _ESC.format("test_type"), "Endpoint": f"{_ESC.format('method')} || ' ' || {_ESC.format('endpoint')}", "Severity": SQL_SEVERITY, "Priority": SQL_PRIORITY, "Execution Time": "coalesce(printf('%.2f', execution_time), '') || 's'"}


@query(
    "results",
    sql=f"""SELECT id, '<div class="test-case ' || lower({_STATUS}) || {_CLASS} || '">' || chr(10) || '<h3>' || {_ESC.format("coalesce(name, 'Unnamed Test')")} || ' - ' || {_STATUS} || '</h3>' || chr(10) || {' || '.join(_P.format(k, v) for k, v in _SQL_FIELDS.items())}
    || CASE WHEN coalesce(error, '') <> '' THEN {_P.format('Error', _ESC.format('error'))} ELSE '' END || '</div>' AS html FROM results""",
)
def html_report_rows(results: DataFrame) -> DataFrame:
    """The fragment of a report for each result: status and severity as classes, title, type, call, severity, priority, time, error.

    Texts are escaped. ``html_summary`` is what stands before the fragments.
    """
    rows = report_rows(results)
    time = F.format_string("%.2fs", F.col("execution_time").cast("double"))
    shown = {
        "Type": html_text(F.col("test_type")),
        "Endpoint": F.concat(html_text(F.col("method")), F.lit(" "), html_text(F.col("endpoint"))),
        "Severity": F.col("severity"),
        "Priority": F.col("priority"),
        "Execution Time": F.when(F.col("execution_time").isNull(), "s").otherwise(time),
    }
    critical = F.when(F.col("severity") == "critical", " critical").otherwise("")
    head = F.concat(F.lit('<div class="test-case '), F.lower("status"), critical, F.lit('">\n<h3>'), html_text(F.col("title")), F.lit(" - "), "status", F.lit("</h3>\n"))
    error = F.when(F.col("error") != "", _paragraph("Error", html_text(F.col("error")))).otherwise("")
    return rows.select("id", F.concat(head, *[_paragraph(k, c) for k, c in shown.items()], error, F.lit("</div>")).alias("html"))


@query(
    "results",
    prepare=lambda r: (result_summary(r), "API <tests>", "2025-01-01T00:00:00"),
    sql=f"""WITH s AS (SELECT {SQL_OUTCOMES}, coalesce({sql_round2(sql_sum('execution_time'))}, 0.0) AS total_time FROM results)
    SELECT '<h1>API &lt;tests&gt;</h1>' || chr(10) || '<p>Generated: 2025-01-01T00:00:00</p>' || chr(10) || '<div class="summary">' || chr(10) || '<h2>Summary</h2>' || chr(10) || {_P.format('Total Tests', 'total')} || {_P.format('Passed', 'passed')} || {_P.format('Failed', 'failed')}
    || {_P.format('Pass Rate', "printf('%.2f', pass_rate) || '%'")} || {_P.format('Execution Time', "printf('%.2f', total_time) || 's'")} || '</div>' || chr(10) || '<h2>Test Cases</h2>' AS summary FROM s""",
)
def html_summary(summary: DataFrame, title: str, generated_at: str) -> DataFrame:
    """What stands before the fragments of a report: title, time, and the totals of ``result_summary``."""
    number = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    totals = {"Total Tests": F.col("total").cast("string"), "Passed": F.col("passed").cast("string"), "Failed": F.col("failed").cast("string"), "Pass Rate": F.concat(number("pass_rate"), F.lit("%")), "Execution Time": F.concat(number("total_time"), F.lit("s"))}
    head = F.concat(F.lit("<h1>"), html_text(F.lit(title)), F.lit("</h1>\n<p>Generated: "), html_text(F.lit(generated_at)), F.lit('</p>\n<div class="summary">\n<h2>Summary</h2>\n'))
    return summary.select(F.concat(head, *[_paragraph(k, v) for k, v in totals.items()], F.lit("</div>\n<h2>Test Cases</h2>")).alias("summary"))


def write_html(results: DataFrame, title: str, generated_at: str, folder: str) -> None:
    """The report as text: sorted part files which, read one after another, are one page. No task holds more than its fragments."""
    top = F.concat(F.lit("<!DOCTYPE html>\n<html>\n<head>\n<title>"), html_text(F.lit(title)), F.lit(f"</title>\n<style>\n        {HTML_STYLE}\n</style>\n</head>\n<body>\n"), "summary")
    head = html_summary(result_summary(results), title, generated_at).select(F.lit(0).alias("at"), F.lit(None).cast("long").alias("id"), top.alias("text"))
    rows = html_report_rows(results).select(F.lit(1).alias("at"), "id", F.col("html").alias("text"))
    whole = head.unionByName(rows).unionByName(head.select(F.lit(2).alias("at"), "id", F.lit(HTML_END).alias("text")))
    whole.orderBy("at", "id").select("text").write.text(folder)


@query("knowledge", sql="SELECT knowledge_type, '2025-01-01T00:00:00' AS exported_at, count(*) AS n FROM knowledge GROUP BY 1", prepare=lambda k: (k, "2025-01-01T00:00:00"))
def write_knowledge(knowledge: DataFrame, exported_at: str, path: str | None = None) -> DataFrame:
    """Writes the items by type as JSON lines, each with the time of the export; returns what is read back, counted."""
    spark = knowledge.sparkSession
    path = path or shared_folder(spark)
    rows = knowledge.select("knowledge_type", "id", "item_json", "added_at", "updated_at", F.lit(exported_at).alias("exported_at"))
    rows.write.partitionBy("knowledge_type").mode("overwrite").json(path)
    return read_export(spark, path).groupBy("knowledge_type", "exported_at").agg(F.count(F.lit(1)).alias("n"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, item_json string, added_at string, updated_at string, exported_at string, knowledge_type string").json(path)


#: About how many items an array file that is written here holds.
ARRAY_ITEMS = 10_000


def write_arrays(knowledge: DataFrame, folder: str) -> None:
    """Writes the items of each type below ``<type>.json``, in files of one JSON array; a large type gets several files."""
    pieces = -(-knowledge.count() // ARRAY_ITEMS) or 1
    packed = knowledge.groupBy("knowledge_type", F.pmod(F.xxhash64("id"), F.lit(pieces)).alias("piece")).agg(F.array_join(F.collect_list("item_json"), ",\n").alias("items"))
    for (kind,) in packed.select("knowledge_type").distinct().collect():
        rows = packed.where(F.col("knowledge_type") == kind).select("piece", F.concat(F.lit("[\n"), "items", F.lit("\n]")).alias("value"))
        rows.write.partitionBy("piece").mode("overwrite").text(f"{folder}/{kind}.json")


def read_arrays(spark: SparkSession, folder: str, types: tuple[str, ...] = TYPES) -> DataFrame:
    """knowledge_type, id and item_json of the items in ``<type>.json`` (a file, or a folder of files) of each type; each file holds
    one JSON array, over as many lines as it likes. A type without a file gives nothing."""
    found = spark.createDataFrame([], "knowledge_type string, item_json string")
    for kind in types:
        path = f"{folder}/{kind}.json"
        if exists(spark, path):
            files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
            found = found.unionByName(files.select(F.lit(kind).alias("knowledge_type"), F.explode(F.from_json("value", "array<string>")).alias("item_json")))
    return found.select("knowledge_type", F.get_json_object("item_json", "$.id").alias("id"), "item_json")


_ITEM = """'{"id":"' || id || '",' || substr(item_json, 2)"""


@query("knowledge", sql=f"SELECT id, knowledge_type, {_ITEM} AS item_json FROM knowledge", prepare=lambda k: (k.withColumn("item_json", F.expr(_ITEM)),))
def read_knowledge(knowledge: DataFrame) -> DataFrame:
    """The items, written as JSON arrays of each type and read back; types without a file give nothing."""
    folder = shared_folder(knowledge.sparkSession)
    write_arrays(knowledge, folder)
    return read_arrays(knowledge.sparkSession, folder).select("id", "knowledge_type", "item_json")


@query("vectors", sql="SELECT index_name, id, len(vec) AS dim, content FROM vectors")
def vectors_save_load(vectors: DataFrame, path: str | None = None) -> DataFrame:
    """Vectors and what is stored beside them, written by index and read back."""
    spark = vectors.sparkSession
    path = path or shared_folder(spark)
    vectors.write.partitionBy("index_name").mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("index_name", "id", F.size("vec").alias("dim"), "content")
