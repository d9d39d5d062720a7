"""Aspects of requirements and their assessment on hand-made rows: alternatives, words that hold a sign for "and", blanks."""

from groundwork.operators import requirements as R
from pyspark.sql import functions as F


def test_aspects(spark):
    want = {
        "熟悉Python或Java，掌握SQL": [["熟悉Python", "Java"], ["掌握SQL"]],
        "负责设计、开发和测试": [["负责设计"], ["开发"], ["测试"]],
        "开发和测试": [["开发和测试"]],
        "热爱生活，维护和平": [["热爱生活"], ["维护和平"]],
        "沟通，参与会议与汇报": [["沟通"], ["参与会议"], ["汇报"]],
        "分析数据并输出报告": [["分析数据"], ["输出报告"]],
        "数据以及模型": [["数据"], ["模型"]],
        "build tools AND use Spark or Flink": [["build tools"], ["use Spark", "Flink"]],
        " ，、": [["，、"]],
        "": [[""]],
        None: [[""]],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "i int, t string")
    got = [r["a"] for r in df.orderBy("i").select(R.aspects(F.col("t")).alias("a")).collect()]
    assert got == list(want.values())


def test_assessed_by_aspects(spark):
    needs = [(1, 0, "熟悉Python或Haskell，掌握Kubernetes", "x"), (1, 1, "熟悉Python", "x"), (1, 2, None, "x"), (1, 3, "精通钢琴演奏", "x"), (2, 0, "熟悉Python", "x"), (None, 0, "熟悉Python", "x")]
    needs = spark.createDataFrame(needs, "doc_id int, pos int, requirement string, status string")
    claims = spark.createDataFrame([(1, "a", "使用Python开发服务"), (1, "b", None), (1, "a", "使用Python开发服务")], "doc_id int, path string, claim string")
    rows = R.assessed_by_aspects(needs, claims).collect()
    got = {(r["doc_id"], r["pos"]): (r["status"], r["paths"], r["gaps"]) for r in rows}
    assert len(rows) == len(got) == 6
    assert got[1, 0] == ("partial", ["a"], ["掌握Kubernetes"])
    assert got[1, 1] == ("supported", ["a"], [])
    assert got[1, 2] == ("missing", [], [])
    assert got[1, 3] == ("missing", [], ["精通钢琴演奏"])
    assert got[2, 0] == ("missing", [], ["熟悉Python"]) == got[None, 0]
    assert R.assessed_by_aspects(needs.where("false"), claims).count() == 0
