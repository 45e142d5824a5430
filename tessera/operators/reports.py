"""What a report that answers a question part by part has to keep, checked for many reports at once.

Tables: reports (report, question, status), parts (report, part, span, findings, gap), findings (report, finding, bundle, assertion, evidence_ids), supports
(report, finding, evidence, quote) and evidence (report, bundle, evidence, quote). Findings of a report are numbered from 0. Every check is a join or a grouped
count; what it finds is a code:

* part_span: a part's span isn't verbatim in the question; part_repeated: two parts have one span; part_empty: no findings and no gap.
* assignment: not every finding is in exactly one part, or a part names one that isn't there.
* complete_with_gap, partial_without_gap: the status and the gaps don't go together.
* shared_evidence: one evidence id has two quotes in the report's package.
* repeated_assertion: two findings say the same, but for case and white space.
* unanchored: a finding's cited evidence and its supports aren't the same set.
* unsupported: a support is not a contiguous quote of that evidence in the finding's own bundle.

Verbatim means but for layout, as `quote_span` has it. Null gaps and lists are empty, null spans and quotes are nowhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.quotes import quote_span


def verbatim(quote: Column, text: Column) -> Column:
    return F.coalesce(quote_span(quote, text).isNotNull(), F.lit(False))


def violations(reports: DataFrame, parts: DataFrame, findings: DataFrame, supports: DataFrame, evidence: DataFrame) -> DataFrame:
    """(report, broken): the codes, sorted, of every report; none for one that keeps the contract."""
    code = lambda df, name: df.select("report", F.lit(name).alias("code"))
    gap = F.trim(F.coalesce("gap", F.lit(""))) != ""
    named = F.coalesce("findings", F.array().cast("array<int>"))
    p = parts.withColumn("gap", gap).withColumn("findings", named)
    out = [
        code(p.join(reports, "report").where(~verbatim(F.col("span"), F.col("question"))), "part_span"),
        code(p.groupBy("report", "span").count().where("count > 1"), "part_repeated"),
        code(p.where((F.size("findings") == 0) & ~F.col("gap")), "part_empty"),
    ]
    used = p.select("report", F.explode("findings").alias("finding")).groupBy("report", "finding").agg(F.count("*").alias("used"))
    both = used.join(findings.select("report", "finding", F.lit(1).alias("there")), ["report", "finding"], "full")
    out.append(code(both.where("used IS NULL OR there IS NULL OR used > 1"), "assignment"))
    gaps = reports.select("report", "status").join(p.groupBy("report").agg(F.bool_or("gap").alias("gap")), "report", "left")
    open_ = F.coalesce("gap", F.lit(False))
    out += [code(gaps.where((F.col("status") == "complete") & open_), "complete_with_gap"), code(gaps.where((F.col("status") != "complete") & ~open_), "partial_without_gap")]
    out.append(code(evidence.groupBy("report", "evidence").agg(F.countDistinct("quote").alias("n")).where("n > 1"), "shared_evidence"))
    same = F.lower(F.regexp_replace("assertion", r"\s+", ""))
    out.append(code(findings.groupBy("report", same.alias("a")).count().where("count > 1"), "repeated_assertion"))
    cited = findings.select("report", "finding", F.explode("evidence_ids").alias("evidence")).distinct().withColumn("cited", F.lit(1))
    held = supports.select("report", "finding", "evidence").distinct().withColumn("held", F.lit(1))
    out.append(code(cited.join(held, ["report", "finding", "evidence"], "full").where("cited IS NULL OR held IS NULL"), "unanchored"))
    saved = evidence.select("report", "bundle", "evidence", F.col("quote").alias("whole")).distinct()
    own = supports.join(findings.select("report", "finding", "bundle"), ["report", "finding"], "left").join(saved, ["report", "bundle", "evidence"], "left")
    found = own.groupBy("report", "finding", "evidence", "quote").agg(F.bool_or(verbatim(F.col("quote"), F.col("whole"))).alias("ok"))
    out.append(code(found.where("NOT ok"), "unsupported"))
    broken = reduce(DataFrame.unionByName, out).groupBy("report").agg(F.array_sort(F.collect_set("code")).alias("broken"))
    return reports.select("report").join(broken, "report", "left").select("report", F.coalesce("broken", F.array().cast("array<string>")).alias("broken"))
