"""Requirements and records, in the language of their word lists."""

from groundwork.operators import records, requirements
from pyspark.sql import functions as F

TARGET = """design JD
公司介绍
我们是一家公司，福利好
岗位职责：
1. 负责数据平台开发
2、负责数据平台开发；
任职要求
- 本科及以上学历，3年以上经验
• Python
熟悉 SQL 者优先
工作地点：北京
"""


def test_requirements(spark):
    docs = spark.createDataFrame([(1, TARGET), (2, None), (3, "")], "doc_id int, text string")
    got = requirements.extracted(docs).orderBy("pos").collect()
    assert [(r["requirement"], r["priority"], r["kind"]) for r in got] == [
        ("负责数据平台开发", "responsibility", "responsibility"),
        ("本科及以上学历，3年以上经验", "required", "tenure"),
        ("Python", "responsibility", "other"),
        ("熟悉 SQL 者优先", "preferred", "skill"),
    ]
    assert [r["requirement"] for r in requirements.extracted(docs, limit=1).collect()] == ["本科及以上学历，3年以上经验"]


def test_assessment(spark):
    need = spark.createDataFrame([(1, 0, "负责数据平台开发", "数据平台开发", "responsibility"), (1, 1, "熟悉 Rust", "rust", "skill"), (1, 2, "本科学历", "本科学历", "qualification"), (2, 0, "x y", "xy", "other")], "doc_id int, pos int, requirement string, core string, kind string")
    have = spark.createDataFrame([(1, "a", "主导数据平台开发并上线"), (1, "b", "没有相关经验 rust"), (1, "c", "硕士")], "doc_id int, path string, claim string")
    got = {(r["doc_id"], r["pos"]): (r["status"], r["path"]) for r in requirements.assessed(need, have).collect()}
    assert got == {(1, 0): ("supported", "a"), (1, 1): ("missing", None), (1, 2): ("supported", "c"), (2, 0): ("missing", None)}


def test_claim_gaps(spark):
    claims = spark.createDataFrame([(1, "a", "负责开发，使用 Spark，完成交付"), (1, "b", "很好")], "doc_id int, path string, claim string")
    assert [(r["path"], r["lacks"]) for r in requirements.claim_gaps(claims).collect()] == [("b", ["action", "method", "result"])]


def test_ownership_levels(spark):
    df = spark.createDataFrame([("主导",), ("负责",), ("参与",), ("协助",), ("无",), (None,)], "t string")
    assert [r[0] for r in df.select(requirements.ownership(F.col("t"))).collect()] == [4, 3, 2, 1, 0, 0]


CV = """姓名：张晨
电话 13812345678 邮箱 zc@example.com 3年工作经验
北京大学 本科 计算机科学 2016.09-2020.06
2020年7月至2023年6月在星河公司任职，担任数据工程师，负责平台
专业技能：数据建模、Airflow；Python
求职意向：数据工程师"""


def test_extraction(spark):
    docs = spark.createDataFrame([(1, CV), (2, None)], "doc_id int, text string")
    m = docs.select(records.meta(F.col("text")).alias("m")).select("m.*").first()
    assert (m["name"], m["phone"], m["email"], m["work_experience"], m["target_role"], m["gender"]) == ("张晨", "13812345678", "zc@example.com", "3年", "数据工程师", "")
    e = records.education(docs).collect()
    assert [(r["school"], r["degree"], r["major"], r["period"]) for r in e] == [("北京大学", "本科", "计算机科学", "09-2016 - 06-2020")]
    x = {r["company"]: (r["role"], r["period"]) for r in records.experience(docs).collect()}
    assert x["星河公司"] == ("数据工程师", "07-2020 - 06-2023")
    assert {(r["bucket"], r["skill"]) for r in records.skills(docs).collect()} == {("languages", "Python"), ("others", "数据建模"), ("others", "Airflow")}


def test_stage_and_scenario(spark):
    df = spark.createDataFrame([("应届", 0, False, True), ("", 4, True, True), ("", 2, True, False), ("", 1, False, False), ("", None, False, True), ("", None, False, False), ("经理", None, False, True)], "t string, y int, i boolean, s boolean")
    got = [r[0] for r in df.select(records.stage(F.col("t"), F.col("y"), F.col("i"), F.col("s"))).collect()]
    assert got == ["student", "experienced", "student", "experienced", "student", "job_seeker", "experienced"]
    f = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in f.select(records.scenario(F.col("a"), F.col("b"))).collect()] == ["scenario1", "scenario3", "scenario4", "scenario2"]


def test_missing_fields(spark):
    schema = "doc_id int, name string, phone string, email string, summary string, education array<struct<school:string,degree:string,major:string,period:string>>, experience array<struct<company:string,role:string,period:string,bullets:array<string>>>, skills array<string>, src string"
    rows = [(1, "张晨", "未提供", None, "有", [("大学", "", "x", "2020")], [("公司", "岗", "2020", ["完成交付"]), ("公司", "", "2020", [" "])], ["SQL"], "姓名：张晨 电话 138-1234-5678 其他内容其他内容"), (2, None, None, None, None, None, None, None, None)]
    got = records.missing_fields(spark.createDataFrame(rows, schema), "src").orderBy("doc_id", "pos").collect()
    assert [(r["field"], r["source"]) for r in got if r["doc_id"] == 1] == [
        ("meta.phone", "extraction_lost"), ("meta.email", "not_provided"), ("education[0].degree", "not_provided"),
        ("experience[1]", "not_provided"), ("experience[1].function_description", "not_provided"), ("experience[1].result_description", "not_provided"),
    ]
    assert [r["field"] for r in got if r["doc_id"] == 2] == ["meta.name", "meta.phone", "meta.email", "education", "summary", "experience/projects/campus", "skills"]


def test_unsupported_values(spark):
    src = "2020年7月在星河科技工作，提升 30%"
    rows = [(1, "company", "星河科技有限公司", src), (1, "company", "月亮公司", src), (1, "period", "2020.07", src), (1, "period", "2021.07", src), (1, "metric", "提升 30%", src), (1, "metric", "提升 40%", src), (1, "metric", "提升 40%", src), (1, "role", "", src), (2, "role", "x", None)]
    got = {(r["doc_id"], r["kind"], r["value"]) for r in records.unsupported_values(spark.createDataFrame(rows, "doc_id int, kind string, value string, source string")).collect()}
    assert got == {(1, "company", "月亮公司"), (1, "period", "2021.07"), (1, "metric", "提升 40%"), (2, "role", "x")}


def test_substantive_tenure(spark):
    rows = [(1, "A", "工程师", "2020.01 - 2020.12"), (1, "B", "实习生", "2021.01 - 2021.12"), (1, "C", "经理", "2022.01 - 至今"), (1, "D", "经理", "2019.01"), (1, "", "经理", "2010.01 - 2012.01")]
    got = records.substantive_tenure(spark.createDataFrame(rows, "doc_id int, company string, role string, period string"), as_of=2022 * 12 + 6).first()
    assert (got["months"], got["years"]) == (18, 2)
