"""Blocks of a source: lines with their section, their record, and whether they may bear a claim.

Signals of each line are SQL expressions. The section is the nearest heading above, a
window. Where records start feeds back into what counts as a start, so one document's
lines are folded in order, over their signals only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import segment

# Headings of sections.
SECTIONS = {
    "meta": ("个人信息", "基本信息", "联系方式"),
    "summary": ("个人总结", "个人简介", "职业概述", "自我评价"),
    "education": ("教育经历", "教育背景", "学历信息"),
    "experience": ("工作经历", "实习经历", "工作/实习经历", "工作与实习经历", "任职经历", "职业经历"),
    "research": ("科研经历", "研究经历", "实验室经历"),
    "projects": ("项目经历", "项目经验", "研究项目", "课程项目", "个人项目", "开源项目"),
    "activities": ("校园经历", "在校经历", "社团经历", "志愿经历", "社会实践", "学生工作", "组织经历", "社团和组织经历", "社团和"),
    "skills": ("技能", "专业技能", "职业技能", "技能清单", "技术栈", "工具", "语言能力", "编程语言", "开发工具", "机器学习", "深度学习"),
    "awards": ("荣誉奖项", "荣誉与奖项", "获奖经历", "奖项", "奖学金"),
    "publications": ("论文", "论文发表", "论文成果", "论文期刊", "学术成果", "出版物"),
    "patents": ("专利", "专利成果"),
    "certifications": ("证书", "资格证书", "证书与资质", "职业资格", "执业资格", "执照"),
    "training": ("培训经历", "进修经历", "住院医师规范化培训"),
    "teaching": ("教学经历", "授课经历", "培养经历"),
    "hobbies": ("兴趣爱好", "个人爱好"),
    "coursework": ("相关课程", "主修课程"),
}
# Headings that end a section without opening one; sections made of records.
RESETS = ("其他", "其它", "其他信息", "其它信息")
RECORDS = ("education", "experience", "research", "activities", "projects")
# Words of duties, results, organisations and posts.
DUTY = "负责|参与|主导|协助|支持|配合|完成|推动|推进|组织|设计|开发|构建|实现|制定|管理|运营|分析|统计|策划|培训|处理|研究|撰写|输出|交付|维护|优化|搭建|建立|开展|承担|提供|跟进|协调|带领|执行|学会"
RESULT = "提升|降低|增长|减少|缩短|节省|达到|达成|上线|交付|完成|获奖|录用|复核|验证"
ENTITY = "大学|学院|学校|中学|小学|幼儿园|医院|公司|企业|集团|研究院|实验室|中心|部门|协会|学会|学生会|社团|委员会|事务所|律所|银行|政府|基金会|工作室|团队|基地"
RELATION = "指导老师|指导教师|导师|项目导师|论文导师|推荐人|联系人"
TITLE_END = "项目|系统|平台|课题|作品|游戏|模型|算法"
# What a fact may tell, in the order in which the first is its type.
DIMENSIONS = {
    "contact": r"1[3-9][0-9]{9}|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "organization": ENTITY, "role": "工程师|设计师|教师|老师|医生|医师|护士|经理|主管|总监|主任|顾问|研究员|专员|助理|负责人|组长|队长|主席|部长|实习生|分析师|架构师|讲师",
    "period": X.DATE_OR_YEAR, "education": "本科|硕士|博士|学士|专科|学历|学位|专业", "credential": "证书|资格|执照|奖学金|一等奖|二等奖|三等奖|特等奖|荣誉", "result": RESULT, "deliverable": "输出|交付|上线|发布|形成|产出|报告|论文|专利",
    "method": "通过|采用|使用|基于|借助|运用|利用|结合", "action": DUTY, "skill": "熟悉|掌握|精通|熟练", "metric": r"[0-9]+(?:\.[0-9]+)?\s*(?:%|万|亿|人|次|项|个|条|篇|例|台|套|元|小时|分钟|ms|qps)",
}
_MARK = r"^(?:[-*•·▪◦]\s*)?(?:[0-9]{1,3}[.、)]\s*)?"


def section_of(x: Column) -> Column:
    """The section that a heading opens; null for other lines."""
    key, out = X.heading_form(x), F.lit(None).cast("string")
    for name, aliases in SECTIONS.items():
        out = F.when(key.isin(*[a.replace("/", "") for a in aliases]), name).otherwise(out)
    return out


def dimensions(x: Column, section: Column | None = None) -> Column:
    """What a fact tells, in the order of DIMENSIONS; a section of its own kind counts too."""
    own = {"education": ("education",), "skill": ("skills",), "credential": ("certifications", "awards")}
    hit = lambda d, p: x.rlike(f"(?i){p}") | (F.coalesce(section.isin(*own[d]), F.lit(False)) if section is not None and d in own else F.lit(False))
    return F.array_compact(F.array(*[F.when(hit(d, p), d) for d, p in DIMENSIONS.items()]))


def primary_type(x: Column, section: Column | None = None) -> Column:
    return F.coalesce(F.get(dimensions(x, section), 0), F.lit("other"))


def signals(lines: DataFrame) -> DataFrame:
    """Flags of each line: body, header, entity, dated, label, number, short."""
    p = F.col("piece")
    parts = F.size(F.split(p, "[|｜\t]")) >= 2
    dated = p.rlike(X.DATE_OR_YEAR)
    body = p.rlike(rf"{_MARK}(?:主要\s*)?(?:{DUTY})") | p.rlike(r"^[-*•·▪◦]\s*\S") | p.rlike(rf"^(?:{RESULT})") | p.rlike(r"^[0-9]{1,3}(?:[、)]|\.(?![0-9]))\s*\S{3,}")
    titled = (F.col("section") == "projects") & (F.length(p) <= 100) & p.rlike(f"(?:{TITLE_END})$")
    stop = p.rlike("[。；;!?！？]$")
    entity = p.rlike(f"(?:{ENTITY}|项目)$")
    named = F.col("section").isin("experience", "research", "activities") & (F.length(p) <= 80) & p.rlike(ENTITY)
    header = ~stop & ~p.rlike(r"^[-*•·▪◦]") & (titled | (~body & (named | parts | dated | entity)))
    label = p.rlike(f"^(?:{RELATION})\\s*[:：]")
    number = F.regexp_extract(p, r"^([0-9]{1,3})(?:[、)]|\.(?![0-9]))", 1)
    return lines.withColumns({
        "body": body & ~titled, "header": header & ~label, "entity": ((entity & ~body) | (header & parts)) & ~label, "dated": dated & p.rlike(ENTITY), "label": label,
        "number": F.when(number != "", number.cast("int")), "short": (F.length(p) <= 64) & ~stop,
    })


def _fold(rows: list[tuple]) -> list[int | None]:
    """Record numbers of one document's lines (section, heading, body, header, entity, dated, label, number, short)."""
    out: list[int | None] = []
    record, count, section = None, -1, None
    told = owned = timed = False
    last = None
    for sec, heading, body, header, entity, dated, label, number, short in rows:
        if sec not in RECORDS or heading or sec != section:
            record, told, owned, timed, last = None, False, False, False, None
            section = sec if sec in RECORDS else None
        if sec not in RECORDS or heading:
            out.append(None)
            continue
        restart = told and number is not None and last is not None and number <= last
        plain = told and not body and not label and (header or (short and sec != "projects"))
        if record is None or restart or plain or (timed and dated) or (owned and entity):
            count += 1
            record, told, owned, timed, last = count, False, False, False, None
        out.append(record)
        told, owned, timed = told or body, owned or entity, timed or dated
        last = number if number is not None else last
    return out


def blocks(docs: DataFrame, source_type: str = "resume", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, start, end, piece, section, record_id, is_heading, eligible) of each line.

    A target text never bears a claim, a request only where it tells a fact.
    """
    rows = segment.lines(docs, id_col, text).withColumn("opens", section_of(F.col("piece")))
    reset = X.heading_form(F.col("piece")).isin(*RESETS)
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.last(F.when(reset, "").otherwise(F.col("opens")), ignorenulls=True).over(w)
    rows = rows.withColumn("section", F.nullif(mark, F.lit(""))).withColumn("is_heading", F.col("opens").isNotNull() | reset)
    rows = signals(rows)
    flags = ["section", "is_heading", "body", "header", "entity", "dated", "label", "number", "short"]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        cols = [[None if pd.isna(v) else v for v in group[f]] for f in flags]
        return pd.DataFrame({id_col: group[id_col], "pos": group["pos"], "record": pd.array(_fold(list(zip(*cols, strict=True))), dtype="Int64")})

    kind = dict(rows.dtypes)[id_col]
    numbered = rows.select(id_col, "pos", *flags).groupBy(id_col).applyInPandas(fold, f"{id_col} {kind}, pos long, record long")
    told = F.size(dimensions(F.col("piece"), F.col("section"))) > 0
    eligible = F.lit(source_type == "resume") | (F.lit(source_type == "query") & told)
    name = F.concat_ws(":", F.lit(source_type), "section", F.col("record").cast("string"))
    out = rows.join(numbered, [id_col, "pos"], "left")
    return out.select(id_col, "pos", "start", "end", "piece", "section", F.when(F.col("record").isNotNull(), name).alias("record_id"), "is_heading", (eligible & ~F.col("is_heading")).alias("eligible"))


def facts(block_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Smallest facts of blocks: (id, pos, unit, start, end, fact, dimensions, fact_type, eligible)."""
    keyed = block_rows.where(~F.col("is_heading")).withColumn("__b", F.concat_ws("\x1f", F.col(id_col).cast("string"), F.col("pos").cast("string")))
    units = segment.pieces(keyed, r"[。；;！？!?|｜]+", "__b", "piece", 2)
    j = units.select("__b", F.col("pos").alias("unit"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("piece").alias("fact")).join(keyed.select("__b", id_col, "pos", F.col("start").alias("__at"), "section", "eligible"), "__b")
    fact = F.col("fact")
    return j.select(id_col, "pos", "unit", (F.col("__at") + F.col("__s")).alias("start"), (F.col("__at") + F.col("__e")).alias("end"), "fact", dimensions(fact, F.col("section")).alias("dimensions"), primary_type(fact, F.col("section")).alias("fact_type"), "eligible")
