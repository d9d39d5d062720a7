from groundwork.functions import text as X
from groundwork.operators import layout
from groundwork.plans import evaluation
from pyspark.sql import functions as F

CASES = [
    ("a", "s", "product_research", "优化产品经理简历", "姓名：张小 电话13800138000 邮箱 z@example.com\n某大学 本科 计算机 09-2016 - 06-2020\n2020年7月到2024年6月在星河公司工作，担任产品经理，负责需求分析，完成 30% 提升", "招聘产品经理，要求需求分析"),
    ("b", "s", "doctor", "", "", "招聘医生，门诊"),
    ("c", "s", "legal", "你好", "", ""),
]


def test_cases(spark):
    cases = spark.createDataFrame(CASES, "id string, scenario string, industry string, query string, cv_text string, jd_text string")
    got = {r["id"]: r for r in evaluation.evaluated(cases).collect()}
    assert {k: r["industry"] for k, r in got.items()} == {"a": "product_research", "b": "doctor", "c": "other"}
    assert "industry_mismatch" in got["c"]["reasons"] and "missing_fields" in got["b"]["reasons"]
    assert got["a"]["missing"] < got["b"]["missing"] and got["a"]["total"] > got["b"]["total"]
    assert evaluation.summary(evaluation.evaluated(cases)).first()["cases"] == 3
    assert evaluation.evaluated(cases.where("false")).count() == 0


def one(spark, f, t):
    return spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]


def test_typography(spark):
    assert one(spark, X.layout_form, "数 据 平台\r\n● 开发　工作 2020.01 - 2021.02\n\n x") == "数据平台\n- 开发工作\n2020.01 - 2021.02\nx"
    assert one(spark, X.skill_name, "ＤＯＥ 实验设计 （熟练）") == "DOE实验设计"
    assert one(spark, X.plain_phrases, "Leveraged 赋能") == "used 支持"
    assert one(spark, X.after_thinking, "<think>a\nb</think>\n\nc\n\n\n\nd") == "c\n\nd"
    assert one(spark, X.over_generic, "显著提升了整体效果") and not one(spark, X.over_generic, "显著提升了 30%")


def test_negation(spark):
    f = lambda v: lambda t: X.positively_said(F.lit(v), t)
    assert one(spark, f("腾讯"), "在腾讯工作") and not one(spark, f("腾讯"), "不要增加腾讯") and one(spark, f("腾讯"), "不要写阿里。曾在某大厂也就是腾讯工作") and one(spark, f(""), None)


def test_transcription():
    assert layout.transcription_measures("a b c", "ab d") == {"exact": 0.0, "recall": 2 / 3, "precision": 2 / 3, "added": 1, "lost": 1}
