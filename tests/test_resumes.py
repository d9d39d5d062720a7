"""Structured records, bindings, rewrites and fields against hand-made cases."""

import pytest
from groundwork.functions import fields as G
from groundwork.operators import binding as B
from groundwork.operators import resumes as R
from groundwork.operators import rewrites as W
from pyspark.sql import functions as F

POSTS = [("A公司", "工程师", "2020.01", ["做a b c d。做e f g h", "做a b c d"]), ("A公司", "工程师", "", ["做a b c d", "新的 bullet"]), ("B公司", "实习生", "2019.01", [])]
PROJECTS = [("P", "", "", "", ["x y"]), ("p", "", "", "", []), ("", "", "", "", [])]
ROW = (1, ("张三", "1", "", "待补充", ""), "sum", [("大学", "本科", "", ""), ("", "", "", "")], POSTS, [], [], PROJECTS, [("Python", "x")], ["奖", "奖 "], None, [], [], [], [], {})
EMPTY = (2, ("", None, "", "", ""), None, None, None, None, None, None, None, None, None, None, None, None, None, None)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW, EMPTY], R.SCHEMA).withColumn("extra", F.lit("kept"))


def test_predicates_and_counts(df):
    got = df.select("doc_id", R.is_empty().alias("empty"), R.has_profile().alias("profile"), R.has_history().alias("history"), R.n_bullets().alias("bullets"), R.n_entries("education").alias("education"),
                    R.n_entries("publications").alias("publications"), R.is_internship().alias("intern"), R.stats().alias("stats"), R.overview().alias("overview")).orderBy("doc_id").collect()
    assert [(r["empty"], r["profile"], r["history"], r["bullets"], r["education"], r["publications"], r["intern"]) for r in got] == [(False, True, True, 5, 1, 0, True), (True, False, False, 0, 0, 0, False)]
    assert got[0]["overview"] == {"education": 2, "experience": 3, "projects": 3, "skills": 1, "awards": 2} and got[1]["overview"] == {}
    assert got[0]["stats"]["projects"] == 3 and got[0]["stats"]["text_len"] > 50 and got[1]["stats"]["text_len"] == 0


def test_merges_and_prunes(df):
    got = df.where("doc_id = 1").select(R.merged_posts().alias("posts"), R.valid_projects().alias("projects"), R.atomised("experience").alias("atoms"), F.transform(R.section("experience"), lambda r: R.complete("experience", r)).alias("complete")).first()
    assert [(p["organization"], p["period"], p["bullets"]) for p in got["posts"]] == [("A公司", "2020.01", ["做a b c d。做e f g h", "做a b c d", "新的 bullet"]), ("B公司", "2019.01", [])]
    assert [p["name"] for p in got["projects"]] == ["P"] and got["complete"] == [True, False, False]
    assert (got["atoms"][0]["bullets"], got["atoms"][0]["sources"]) == (["做a b c d", "做e f g h"], [0, 0])
    clean = {r["doc_id"]: r for r in R.pruned(df).collect()}
    assert clean[1]["meta"]["work_experience"] == "" and clean[1]["awards"] == ["奖"] and len(clean[1]["education"]) == 1 and len(clean[1]["projects"]) == 2
    assert clean[1]["extra"] == "kept" and clean[2]["experience"] == [] and clean[2]["summary"] == ""
    chunks = df.where("doc_id = 1").withColumn("chunk", F.lit(2)).unionByName(df.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long")).withColumn("chunk", F.lit(1)))
    one = R.merged_drafts(chunks).collect()
    assert len(one) == 1 and one[0]["meta"]["name"] == "张三" and len(one[0]["experience"]) == 3


def test_claims_places_and_views(df):
    claims = R.claims(df).collect()
    assert {c["doc_id"] for c in claims} == {1} and ("experience[1].bullets[1]", "新的 bullet") in {(c["path"], c["text"]) for c in claims}
    assert {r["doc_id"]: r["preserved"] for r in R.preserved(df, df).collect()} == {1: True}
    less = df.withColumn("experience", F.slice("experience", 1, 1))
    assert {r["preserved"] for r in R.preserved(df, less).collect()} == {False}
    places = {(r["section"], r["record"], r["bullet"]): r["text"] for r in R.bullet_places(df).collect()}
    assert places["projects", 1, 1] == "x y" and places["experience", 2, 2] == "新的 bullet" and len(places) == 5
    wanted = df.sparkSession.createDataFrame([(1, "projects", 1, 1), (1, "projects", 9, 1)], "doc_id long, section string, record int, bullet int")
    assert sorted(r["status"] for r in R.resolved_target(df, wanted).collect()) == ["found", "missing"]
    back = R.from_flat_view(df.withColumn("v", R.flat_view()), "v").where("doc_id = 1").first()
    assert [p["organization"] for p in back["experience"]] == ["A公司", "A公司", "B公司"] and back["skills"][0]["name"] == "Python"
    got = [[tuple(x) for x in r[0]] for r in df.sparkSession.createDataFrame([('{"k":["a","b"]}',), ('[{"name":"q","category":"c"}]',), ('["z"]',), (None,)], "v string").select(R.skill_items(F.col("v"))).collect()]
    assert got == [[("a", "k"), ("b", "k")], [("q", "c")], [("z", "other")], []]
    assert [r[0] for r in df.sparkSession.createDataFrame([('["a",["b"," "]]',), ('"x"',)], "v string").select(R.texts_of(F.col("v"))).collect()] == [["a", "b"], ["x"]]


def _one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_fields(spark):
    lit = F.lit
    assert _one(spark, G.full_year(lit("49")), G.full_year(lit("51")), G.full_year(lit("2001")), G.full_year(lit(None).cast("string"))) == ("2049", "1951", "2001", "")
    assert _one(spark, G.project_form(lit("智能平台项目经历 2020.01-至今 指导老师：王")), G.project_name(lit("● ：订单系统 -")), G.project_name(lit("--"))) == ("智能平台", "订单系统", G.UNNAMED_PROJECT)
    assert _one(spark, G.grouped_surface(lit("处理 100 条  数据")), G.semantic_form(lit("A, b（C）")), G.snippet(lit("x" * 50))) == ("处理100条 数据", "abc", "x" * 42 + "...")
    assert _one(spark, G.dated_pairs(lit("2021年3月 至 2022/05，2019年")), G.start_month(lit("2021.03 - 至今"))) == (["2019-", "2021-03", "2022-05"], 202103)
    text = "前半部分写得很长很长，" * 20
    cut = _one(spark, G.safe_excerpt(lit(text)))[0]
    assert cut.endswith("，…") and len(cut) <= 161 and text.startswith(cut[:-1])
    assert _one(spark, G.record_root(lit("experience[2].bullets[1]")), G.record_root(lit("meta.name")), G.friendly_path(lit("experience[0].bullets[2]"), {"experience": "工作", "bullets": "要点"})) == ("experience[2]", "meta", "工作 1 / 要点 3")
    assert _one(spark, G.is_inside(lit("/r"), lit("a/../b")), G.is_inside(lit("/r"), lit("a/../../b")), G.is_inside(lit("/r"), lit("/etc"))) == (True, False, False)
    assert _one(spark, G.labelled(lit("姓名：张三，电话: 123"), ["电话"]), G.duty_prefix(lit("某公司 工程师，负责开发"), "负责|参与"), G.own_target_text(lit("岗位" + G.FETCHED + "页面"))) == ("123", "某公司 工程师", "岗位")
    span = _one(spark, G.trimmed_span(lit("ab  - 中文 x  "), lit(2), lit(13)))[0]
    assert "ab  - 中文 x  "[span["start"] : span["end"]] == "中文 x"
    assert _one(spark, G.section_lines(lit("x\n项目经历\na\nb\n教育\nc"), "^项目", "^教育"), G.section_lines(lit("x"), "^项目", "^教育")) == (["a", "b"], [])
    assert _one(spark, G.same_dates_said(lit("2021.03 - 2022.05"), lit("2021年3月 X 公司 2022年5月")), G.same_dates_said(lit("2021.03"), lit("2022.05")), G.same_dates_said(lit("none"), lit("2022.05"))) == (True, False, False)
    assert _one(spark, G.sentences_of(lit("第一句话说完。第二句话说完；第一句话说完")), G.sentences_of(lit("")), G.clauses(lit("甲乙丙，丁；戊己庚辛"))) == (["第一句话说完", "第二句话说完"], [], ["甲乙丙", "戊己庚辛"])
    entities = _one(spark, G.named_entities(lit("就读于北京大学，负责集团运营")))[0]
    assert any("北京大学" in s for s in entities["schools"]) and entities["companies"] == []
    assert _one(spark, G.awards(lit("获得国家奖学金一次\n获得国家奖学金一次\n短")), G.stated_tenure(lit("3年以上工作经验")), G.stated_tenure(lit("很久"))) == (["获得国家奖学金一次"], "3年以上工作经验", "")
    assert _one(spark, *[G.target_issues(lit(n)) for n in (0, 1, 2, 4, 9)]) == (0, 1, 2, 3, 4)


def test_rewrite_rules(spark):
    b, c = F.lit("实习生 参与 数据分析,使用Python 处理 100 条"), F.lit("主导 数据分析，使用Spark平台 提升30% 处理100条 Kafka Redis")
    assert _one(spark, W.ownership(b), W.ownership(c), W.ownership(F.lit(None).cast("string")), W.ownership_marker(F.array(b, c), 3)) == (1, 3, 0, "主导")
    assert _one(spark, W.unverified(b, c, ["kafka"], ["数据分析"], ["the"]), W.unverified(b, b, [], [], [])) == (["number", "anchors", "inflation", "role"], [])
    assert _one(spark, W.brings_in(b, c), W.brings_in(b, b), W.still_said(b, c), W.still_said(b, b), W.needs_review(b, b), W.needs_review(b, F.lit("完全不同的句子"))) == (True, False, False, True, False, True)
    groups = lambda *g: F.array(*[F.struct(t.alias("text"), F.array(*map(F.lit, i)).alias("indices")) for t, i in g])
    both = F.array(b, F.lit("协助 编写 报表"))
    merged = F.lit("实习生 参与 数据分析,使用Python 处理 100 条，协助 编写 报表")
    assert _one(spark, W.lossless_groups(both, groups((merged, [0, 1]))), W.lossless_groups(both, groups((merged, [0]))), W.lossless_groups(both, groups((b, [0, 1])))) == (True, False, False)
    assert _one(spark, W.substantive(F.lit("x"), F.lit("p"), b, c), W.substantive(F.lit("format"), F.lit("p"), b, c), W.substantive(F.lit("x"), F.lit("p"), b, F.lit(""))) == (True, False, False)
    due = lambda style, h, m, i, n: W.deep_rewrite_due(F.lit(style), *map(F.lit, (h, m, i, n)))
    assert _one(spark, due("aggressive", 1, 0, 1, 1), due("aggressive", 1, 0, 1, 2), due("conservative", 2, 0, 2, 0), due("conservative", 1, 5, 9, 0)) == (True, False, True, False)
    assert "30" not in _one(spark, W.without_metric(c, F.lit("30")))[0] and "100" in _one(spark, W.without_metric(c, F.lit("30")))[0]
    assert _one(spark, W.allowed(F.array(F.lit("A"), F.lit("z")), F.array(F.lit("a"))), W.supported_or_blank(F.lit("数据分析"), c), W.supported_or_blank(F.lit("销售"), c)) == (["A"], "数据分析", "")


def test_bindings_and_atoms(spark):
    claims = spark.createDataFrame([(1, "c1", "负责数据分析平台，完成报表系统", "bullets"), (1, "c2", "2021.03", "identity"), (1, "c3", "完全无关的东西", "meta"), (2, "c4", "负责数据分析平台", "meta"), (1, "c5", "", "meta")], "doc_id long, claim_id string, text string, kind string")
    blocks = spark.createDataFrame([(1, "b1", 0, "负责数据分析平台"), (1, "b2", 1, "完成报表系统开发"), (1, "b3", 2, "2021年3月 入职")], "doc_id long, block_id string, pos int, text string")
    got = {r["claim_id"]: r for r in B.bound(claims, blocks).collect()}
    assert set(got) == {"c1", "c2"} and got["c1"]["block_id"] == "b1" and got["c2"]["mode"] == "normalized" and got["c2"]["block_ids"] == ["b3"]
    compound = B.compound_bound(claims, blocks).collect()
    assert [(r["claim_id"], r["block_ids"]) for r in compound] == [("c1", ["b1", "b2"])]
    facts = blocks.withColumnRenamed("block_id", "fact_id")
    atoms = spark.createDataFrame([(1, "a1", "负责数据分析平台"), (1, "a2", "2021.03"), (1, "a3", "负责数据分析平台 提升30%"), (1, "a4", "毫不相干"), (2, "a5", "负责")], "doc_id long, atom_id string, text string")
    judged = {r["atom_id"]: r for r in B.atoms_judged(atoms, facts).collect()}
    assert {k: r["reason"] for k, r in judged.items()} == {"a1": "direct_source", "a2": "equivalent_date_format", "a3": "new_hard_anchor", "a4": "insufficient_source_overlap", "a5": "no_candidate_fact"}
    assert judged["a1"]["selected"] == ["b1"] and judged["a4"]["selected"] == []
    assert [(r["doc_id"], r["precision"]) for r in B.audit(B.atoms_judged(atoms, facts), facts.withColumn("represented", F.lit(True))).orderBy("doc_id").collect()] == [(1, 0.5), (2, 0.0)]


def test_owners_and_recovery(spark):
    votes = spark.createDataFrame(
        [(1, "r1", "s1", True, True, False, 1, 0, False), (1, "r1", "s2", False, False, False, 1, 0, False), (1, "r2", "s1", True, True, False, 0, 0, False), (1, "r2", "s2", True, None, None, 1, 0, False), (1, "r3", "s3", True, True, None, 2, 0, True), (2, "r1", "s1", True, None, None, 0, 0, False)],
        "doc_id long, record_id string, owner string, period boolean, primary boolean, secondary boolean, exact int, near int, conflict boolean",
    )
    assert sorted((r["doc_id"], r["record_id"], r["owner"], r["score"]) for r in B.joint_owners(votes).collect()) == [(1, "r1", "s1", 34), (2, "r1", "s1", 16)]
    missing = spark.createDataFrame([(1, "u1", "s1", "负责数据分析平台建设工作"), (1, "u2", "s1", "别的事情"), (1, "u3", "s9", "无主")], "doc_id long, unit_id string, source_record string, text string")
    owners = spark.createDataFrame([(1, "r1", "s1")], "doc_id long, record_id string, owner string")
    bullets = spark.createDataFrame([(1, "r1", 1, "负责数据分析平台")], "doc_id long, record_id string, bullet int, text string")
    assert sorted((r["unit_id"], r["action"], r["bullet"]) for r in B.recovered(missing, owners, bullets).collect()) == [("u1", "expand", 1), ("u2", "append", None)]
    values = spark.createDataFrame([(1, "v1", "负责数据分析平台"), (1, "v2", "凭空出现的话")], "doc_id long, claim_id string, text string")
    sentences = spark.createDataFrame([(1, "x", "负责数据分析平台建设"), (1, "y", "其他内容")], "doc_id long, sentence_id string, text string")
    assert sorted((r["claim_id"], r["status"]) for r in B.grounded(values, sentences).collect()) == [("v1", "kept"), ("v2", "dropped")]
    assert [(r["claim_id"], r["sentence_id"]) for r in B.unique_source(values, sentences).collect()] == [("v1", "x")]
