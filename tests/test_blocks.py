from groundwork.operators import blocks

CV = """张晨
工作经历
星河公司 | 工程师 | 2020.01 - 2021.12
1. 负责平台开发
2. 完成上线，提升 30%
月亮集团 | 主管 | 2022.01 - 至今
- 管理团队
项目经历
检索系统
负责设计
推荐平台
负责建模
其他
杂项"""


def test_sections_and_records(spark):
    docs = spark.createDataFrame([(1, CV), (2, None), (3, "只有一行")], "doc_id int, text string")
    got = {r["piece"]: r for r in blocks.blocks(docs).where("doc_id = 1").collect()}
    assert {k: r["section"] for k, r in got.items()}["管理团队" if "管理团队" in got else "- 管理团队"] == "experience"
    ids = {k: r["record_id"] for k, r in got.items()}
    assert ids["1. 负责平台开发"] == ids["星河公司 | 工程师 | 2020.01 - 2021.12"] == ids["2. 完成上线，提升 30%"]
    assert ids["- 管理团队"] == ids["月亮集团 | 主管 | 2022.01 - 至今"] != ids["1. 负责平台开发"]
    assert ids["检索系统"] == ids["负责设计"] and ids["推荐平台"] == ids["负责建模"] and ids["检索系统"] != ids["推荐平台"]
    assert ids["张晨"] is None and ids["工作经历"] is None and got["杂项"]["section"] is None
    assert all(CV[r["start"] : r["end"]] == r["piece"] for r in got.values())
    assert not blocks.blocks(docs, "jd").where("eligible").count()


def test_facts_keep_offsets(spark):
    docs = spark.createDataFrame([(1, "工作经历\n负责开发；使用 Spark 提升 30%")], "doc_id int, text string")
    text = docs.first()["text"]
    got = blocks.facts(blocks.blocks(docs)).orderBy("start").collect()
    assert [(r["fact"], r["fact_type"]) for r in got] == [("负责开发", "action"), ("使用 Spark 提升 30%", "result")]
    assert all(text[r["start"] : r["end"]] == r["fact"] for r in got)
    assert got[1]["dimensions"] == ["result", "method", "metric"]
