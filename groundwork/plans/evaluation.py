"""The model-free evaluation: cases to records, gaps, conflicts, scores and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import intervals, rank, records

#: What a case must reach.
USABLE, READABLE, EXPRESSIVE = 90, 8, 40


def case_records(cases: DataFrame) -> DataFrame:
    """cases (id, query, cv_text, jd_text) with label, the fields, schooling, posts and skills of query and record.

    The target text only votes for the field of work; facts come from the other two.
    """
    docs = cases.withColumn("source", F.concat_ws("\n", F.nullif(X.strip(F.col("query")), F.lit("")), F.nullif(X.strip(F.col("cv_text")), F.lit(""))))
    voted = rank.vote(docs, L.INDUSTRY, "query", "cv_text", "jd_text", strong=L.INDUSTRY_STRONG, last=2.0)
    by_id = docs.select(F.col("id").alias("doc_id"), F.col("source").alias("text"))
    listed = lambda df, cols: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("r"))
    school = listed(records.education(by_id), ["school", "degree", "major", "period"]).select("doc_id", F.transform("r", lambda x: F.struct(x["school"].alias("school"), x["degree"].alias("degree"), x["major"].alias("major"), x["period"].alias("period"))).alias("education"))
    posts = listed(records.experience(by_id), ["company", "role", "period", "bullet"]).select("doc_id", F.transform("r", lambda x: F.struct(x["company"].alias("company"), x["role"].alias("role"), x["period"].alias("period"), F.array(x["bullet"]).alias("bullets"))).alias("experience"))
    skills = records.skills(by_id).groupBy("doc_id").agg(F.array_sort(F.collect_list("skill")).alias("skills"))
    out = voted.withColumn("m", records.meta(F.col("source"))).select("*", F.col("m.name").alias("name"), F.col("m.phone").alias("phone"), F.col("m.email").alias("email")).withColumnRenamed("id", "doc_id")
    out = out.join(school, "doc_id", "left").join(posts, "doc_id", "left").join(skills, "doc_id", "left")
    summary = F.concat_ws("，", F.get("experience", 0)["role"], F.get("experience", 0)["company"], F.array_join("skills", "、"))
    return out.withColumn("summary", X.excerpt(summary, 100))


def evaluated(cases: DataFrame) -> DataFrame:
    """id, industry, missing, conflicts, completeness, expression, response, total, usable, reasons for each case."""
    r = case_records(cases)
    gaps = records.missing_fields(r, "source").groupBy("doc_id").agg(F.count("*").alias("missing"), F.count(F.when(F.col("field").rlike("^(?:meta\\.(?:name|phone|email)|education|experience/projects)"), 1)).alias("hard"))
    posts = r.select("doc_id", F.posexplode("experience").alias("pos", "x")).withColumn("p", X.period_months(F.col("x.period"))).select("doc_id", "pos", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    spans = posts.where("start is not null and end is not null")
    clash = intervals.overlapping(spans, "doc_id", "pos").select("doc_id").unionAll(intervals.out_of_order(posts.where("start is not null"), "doc_id", "pos").select("doc_id"))
    clash = clash.groupBy("doc_id").agg(F.count("*").alias("conflicts"))
    signals = rank.bullet_signals(r.select("doc_id", F.explode("experience").alias("x")).select("doc_id", F.explode("x.bullets").alias("bullet")), "bullet")
    told = rank.expression_score(signals, "doc_id")
    value = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
    told_posts = F.flatten(F.transform("experience", lambda x: F.array(value("company", x["company"]), value("period", x["period"]))))
    told_schools = F.flatten(F.transform("education", lambda x: F.array(value("school", x["school"]), value("period", x["period"]))))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    values = r.select("doc_id", "source", F.explode(F.concat(F.coalesce(told_posts, none), F.coalesce(told_schools, none), F.array(value("name", F.col("name"))))).alias("v")).select("doc_id", "source", "v.*")
    invented = records.unsupported_values(values).select("doc_id", F.lit(True).alias("invented")).distinct()
    j = r.join(invented, "doc_id", "left").join(gaps, "doc_id", "left").join(clash, "doc_id", "left").join(told, "doc_id", "left").fillna(0, ["missing", "hard", "conflicts", "expression"])
    zero = F.lit(0)
    shown = F.when(F.length("summary") >= 20, F.when(F.col("summary").rlike(L.SUMMARY_FIELDS), 10.0).otherwise(5.0)).when(F.length("summary") > 0, 3.0).otherwise(0.0)
    parts = sum((F.when(F.coalesce(F.size(c), zero) > 0, 1).otherwise(0) for c in ("education", "experience", "skills")), zero) + 1 + F.when(F.length("summary") > 5, 1).otherwise(0)
    layout = F.bround(F.least(F.lit(3.0), parts / 6 * 3.0) + 2.0 + F.when(F.coalesce(F.size("experience"), zero) > 0, 1.0).otherwise(0.0) + F.when(F.coalesce(F.size("skills"), zero) > 0, 1.0).otherwise(0.0), 1)
    j = j.withColumn("readability", layout).withColumn("completeness", rank.completeness_score(F.col("hard"), F.col("missing") - F.col("hard"), F.col("conflicts")))
    j = j.withColumn("expression", F.least(F.lit(50.0), F.bround(F.col("expression") + shown, 1)))
    response = F.least(F.lit(10.0), 4.0 + F.when(F.col("missing") > 0, 2.0).otherwise(0.0) + F.when(F.col("conflicts") > 0, 2.0).otherwise(0.0))
    j = j.withColumn("response", response).withColumn("total", rank.total_score(F.coalesce("invented", F.lit(False)), F.col("readability"), F.col("completeness"), F.col("expression"), F.col("response")))
    why = F.array_compact(F.array(F.when(F.col("missing") > 0, "missing_fields"), F.when(F.col("conflicts") > 0, "conflicts"), F.when(F.col("readability") < READABLE, "readability"), F.when(F.col("expression") < EXPRESSIVE, "expression"), F.when(~F.col("label").eqNullSafe(F.col("industry")), "industry_mismatch")))
    usable = F.col("total") >= USABLE
    return j.select(F.col("doc_id").alias("id"), F.col("industry").alias("expected_industry"), F.col("label").alias("industry"), "missing", "conflicts", "readability", "completeness", "expression", "response", "total", usable.alias("usable"), F.when(usable, F.array().cast("array<string>")).otherwise(why).alias("reasons"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: cases, usable rate and mean scores."""
    means = [F.bround(F.avg(c), 2).alias(f"average_{c}") for c in ("total", "readability", "completeness", "expression", "response")]
    return rows.agg(F.count("*").alias("cases"), F.bround(F.avg(F.col("usable").cast("int")), 3).alias("usable_rate"), *means)


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
