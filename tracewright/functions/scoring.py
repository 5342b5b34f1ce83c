"""Scores, severities and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities from mild to grave, weights of the risk score, taxonomy of classes.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
RISK_WEIGHT = {"critical": 40, "high": 15, "medium": 5, "low": 1, "info": 0}
TAXONOMY = [
    ("sqli", "CWE-89", "A03:2021 - Injection", "T1190 - Exploit Public-Facing Application", "SQL Injection"),
    ("cmdi", "CWE-78", "A03:2021 - Injection", "T1059 - Command and Scripting Interpreter", "OS Command Injection"),
    ("path_traversal", "CWE-22", "A01:2021 - Broken Access Control", "T1083 - File and Directory Discovery", "Path Traversal"),
    ("ssti", "CWE-1336", "A03:2021 - Injection", "T1190 - Exploit Public-Facing Application", "Server-Side Template Injection"),
    ("deserialization", "CWE-502", "A08:2021 - Software and Data Integrity Failures", "T1211 - Exploitation for Defense Evasion", "Insecure Deserialization"),
    ("xxe", "CWE-611", "A05:2021 - Security Misconfiguration", None, "XML External Entity (XXE)"),
    ("ssrf", "CWE-918", "A10:2021 - Server-Side Request Forgery", None, "Server-Side Request Forgery"),
    ("xss", "CWE-79", "A03:2021 - Injection", None, "Cross-Site Scripting"),
    ("open_redirect", "CWE-601", "A01:2021 - Broken Access Control", None, "Open Redirect"),
    ("log_injection", "CWE-117", "A09:2021 - Security Logging and Monitoring Failures", None, "Log Injection"),
    ("ldap_injection", "CWE-90", "A03:2021 - Injection", None, "LDAP Injection"),
    ("race_condition", None, None, None, "Race Condition / TOCTOU"),
    ("auth_bypass", None, None, None, "Authentication Bypass"),
    ("chain", None, None, None, "Attack Chain"),
]
RULE_KEYWORDS = [
    ("sql", "sqli"), ("injection", "sqli"), ("xss", "xss"), ("cross-site", "xss"), ("command", "cmdi"), ("path", "path_traversal"), ("traversal", "path_traversal"),
    ("ssrf", "ssrf"), ("deserializ", "deserialize"), ("template", "ssti"), ("open-redirect", "open_redirect"), ("csrf", "csrf"), ("auth", "auth_bypass"),
]


def rank(severity: Column) -> Column:
    """0 (info) to 4 (critical), null for others."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def display_order(severity: Column) -> Column:
    """0 (critical) to 4 (info) for lists of findings, 99 for others."""
    return F.coalesce(F.lit(len(SEVERITIES) - 1) - rank(severity), F.lit(99))


def severity_of(number: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), number)


def fused(taint: Column, llm: Column) -> Column:
    return taint * F.lit(0.4) + llm * F.lit(0.6)


def is_true_positive(taint: Column, llm: Column, exploitable: Column) -> Column:
    return (taint >= 0.6) & (llm >= 0.6) & exploitable


def is_false_positive(taint: Column, llm: Column, exploitable: Column) -> Column:
    return (taint < 0.4) | ((llm < 0.3) & ~exploitable)


def adjusted_severity(base: Column, combined: Column, exploitable: Column) -> Column:
    """Two steps down if not exploitable, then by the unrounded combined score."""
    number = F.when(exploitable, rank(base)).otherwise(F.greatest(rank(base) - 2, F.lit(0)))
    return F.when(combined < 0.4, "low").when(combined < 0.6, severity_of(F.greatest(number - 1, F.lit(0)))).otherwise(severity_of(number))


def sanitizer_verdict(powers: Column) -> Column:
    """struct<llm_confidence, exploitable> of a path's sanitizer powers."""
    partial = F.forall(powers, lambda p: p < 0.95)
    return F.struct(F.when(F.size(powers) == 0, 0.95).when(partial, 0.75).otherwise(0.1).alias("llm_confidence"), ((F.size(powers) == 0) | partial).alias("exploitable"))


def budget_verdict(position: Column, budget: int, taint: Column, llm: Column) -> Column:
    """Beyond the budget the taint confidence stands in for the model's."""
    return F.when(position <= budget, llm).otherwise(taint)


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "vuln_class string, cwe_id string, owasp_category string, mitre_technique string, class_title string")


def classify(findings: DataFrame, vuln_class: str = "vuln_class") -> DataFrame:
    """Taxonomy columns by a broadcast lookup with defaults."""
    t = taxonomy(findings.sparkSession).withColumnRenamed("vuln_class", "_class")
    out = findings.join(F.broadcast(t), F.col(vuln_class) == F.col("_class"), "left").drop("_class")
    return out.withColumns({
        "cwe_id": F.coalesce("cwe_id", F.lit("CWE-unknown")), "owasp_category": F.coalesce("owasp_category", F.lit("Unknown")),
        "mitre_technique": F.coalesce("mitre_technique", F.lit("Unknown")), "class_title": F.coalesce("class_title", F.upper(vuln_class)),
    })


def description(sink_code: Column, dedup_count: Column) -> Column:
    """What a finding says, with a note of the similar ones that it stands for."""
    more = dedup_count - 1
    note = F.when(dedup_count > 1, F.concat(F.lit(" ("), more.cast("string"), F.lit(" similar finding"), F.when(dedup_count > 2, "s").otherwise(""), F.lit(" at same sink deduplicated)"))).otherwise("")
    return F.concat(F.lit("Attacker-controlled input flows to "), F.coalesce(sink_code, F.lit("")), note)


def taint_only(reasoning: Column) -> Column:
    """Whether no model was asked, as its budget was spent."""
    return F.coalesce(F.contains(reasoning, F.lit("budget exhausted")), F.lit(False))


def winner(vulnerable: Column, ours: Column, theirs: Column) -> Column:
    """Which of two tools did better on a sample: ours, theirs, tie or neither."""
    return F.when(ours == theirs, F.when(vulnerable & ~ours, "neither").otherwise("tie")).when(vulnerable == ours, "ours").otherwise("theirs")


def rule_class(rule_id: Column) -> Column:
    """The first keyword in the rule's name decides."""
    out = F.lit("unknown")
    for word, vuln in reversed(RULE_KEYWORDS):
        out = F.when(F.contains(F.lower(rule_id), F.lit(word)), vuln).otherwise(out)
    return out


def compatible(theirs: Column, ours: Column) -> Column:
    return (theirs == "unknown") | (theirs == ours) | (ours == "unknown")


def risk_weight(severity: Column) -> Column:
    out = F.lit(0)
    for s, w in RISK_WEIGHT.items():
        out = F.when(severity == s, w).otherwise(out)
    return out


def risk_label(score: Column) -> Column:
    return F.when(score >= 70, "Critical Risk").when(score >= 40, "High Risk").when(score >= 20, "Medium Risk").otherwise("Low Risk")


def risk_color(score: Column) -> Column:
    return F.when(score >= 70, "#ff2d55").when(score >= 40, "#ff6b35").when(score >= 20, "#ffd60a").otherwise("#34c759")
