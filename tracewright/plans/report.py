"""Reports: a context of small tables and the page rendered from it."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scoring
from tracewright.operators import findings as fd
from tracewright.session import stash


def summary(total: Column, critical: Column, high: Column) -> Column:
    rest = total - critical - high
    parts = F.concat_ws(", ", F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical"))), F.when(high > 0, F.concat(high.cast("string"), F.lit(" high"))), F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" medium/low"))))
    return F.when(total == 0, "No findings").otherwise(F.concat(total.cast("string"), F.lit(" finding"), F.when(total != 1, "s").otherwise(""), F.lit(" ("), parts, F.lit(")")))


def context(findings: DataFrame, order: str = "id") -> dict[str, DataFrame]:
    """The report's tables; each is a few rows whatever the number of findings.

    The findings are written once, with the columns that the tables read.
    """
    columns = dict.fromkeys(["severity", "cwe_id", "title", "owasp_category", "sink_file", "sink_line", order])
    findings = stash(findings.select(*columns), "report")
    counted = fd.severity_counts(findings)
    return {
        "summary": counted.select("total", summary(F.col("total"), F.col("critical"), F.col("high")).alias("text")),
        "risk": fd.risk_score(findings, []),
        "severities": findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).orderBy(scoring.rank(F.col("severity")).desc()),
        "classes": fd.top_classes(findings, "cwe_id", "title", order),
        "owasp": findings.where("owasp_category IS NOT NULL").groupBy("owasp_category").agg(F.count(F.lit(1)).alias("n")).orderBy("owasp_category"),
        "critical": findings.where("severity = 'critical'").orderBy(order).limit(3).select("title", "sink_file", "sink_line"),
    }


def render(tables: dict[str, DataFrame], title: str = "Report") -> str:
    """HTML of the context's tables."""
    out = [f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.collect()  # 20 rows at most
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out)


def markdown_table(compared: DataFrame) -> DataFrame:
    """One line of a Markdown table for each sample, in the order of their names: ``line``.

    compared: name, vulnerable, ours, theirs, winner (see ``compare_tools``).
    """
    cell = lambda n: F.when(~F.col("vulnerable") & (n == 0), "0 (correct)").when(n == 0, "0 findings").otherwise(F.concat(n.cast("string"), F.lit(" found")))
    who = F.when(F.col("winner") == "ours", "**Ours**").otherwise(F.initcap("winner"))
    return compared.select("name", F.concat_ws(" | ", F.concat(F.lit("| "), F.col("name")), cell(F.col("ours")), cell(F.col("theirs")), F.concat(who, F.lit(" |"))).alias("line"))


def write_markdown(compared: DataFrame, path: str) -> None:
    """The table as one text file; samples of a benchmark are few."""
    head = compared.sparkSession.createDataFrame([(0, "", "| Sample | Ours | Theirs | Winner |"), (1, "", "|---|---|---|---|")], "part int, name string, line string")
    lines = head.unionByName(markdown_table(compared).select(F.lit(2).alias("part"), F.col("name").cast("string").alias("name"), "line"))
    lines.orderBy("part", "name").select("line").coalesce(1).write.mode("overwrite").text(path)
