"""Requirements out of a target text, their kinds, and whether claims meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import segment

# Headings that open a part with requirements, and headings that close it.
HEADINGS = ("岗位职责", "工作职责", "职位职责", "职责描述", "职位描述", "工作内容", "任职要求", "岗位要求", "职位要求", "任职资格", "岗位资格", "职位资格", "优先条件", "加分项", "我们希望你", "你需要具备", "responsibilities", "responsibility", "requirements", "requirement", "qualifications", "qualification", "nice to have", "preferred qualifications")
STOP_HEADINGS = ("公司介绍", "企业介绍", "团队介绍", "关于我们", "薪资福利", "薪酬福利", "福利待遇", "工作地点", "办公地点", "投递方式", "company profile", "about us", "benefits", "compensation", "location", "how to apply")
# Words of page furniture, and words that make a line a requirement.
NOISE = ("公司介绍", "企业介绍", "关于我们", "薪资", "薪酬", "福利", "五险一金", "工作地点", "办公地点", "工作地址", "办公地址", "联系地址", "上班地点", "校区", "招聘人数", "立即申请", "投递简历", "职位类别", "职位详情", "招聘官网", "联系我们", "company profile", "benefits", "salary", "location", "apply now", "about us")
PREDICATES = ("负责", "参与", "主导", "推动", "协助", "支持", "完成", "输出", "设计", "开发", "构建", "管理", "分析", "规划", "制定", "实施", "执行", "维护", "要求", "必须", "需要", "应当", "应具备", "应负责", "具备", "熟悉", "掌握", "能够", "持有", "优先", "经验", "学历", "专业", "responsible", "develop", "design", "build", "manage", "analyze", "must", "required", "proficient", "familiar", "experience", "degree", "qualification", "preferred")
# Shells in front of a requirement's core.
SHELLS = ("候选人应", "候选人需", "我们希望你", "你需要具备", "岗位要求", "任职要求", "任职资格", "职位要求", "工作职责", "岗位职责", "职位职责", "主要负责", "负责", "要求", "必须", "需要", "应当", "应具备", "应负责", "具备", "熟悉", "掌握", "能够", "可以", "相关", "工作", "岗位", "能力", "经验", "优先考虑", "优先", "以上", "responsible for", "responsibilities include", "requirements include", "required", "must have", "must", "should", "proficient in", "familiar with", "experience with", "preferred")
# Words of priority and kind.
PREFERRED = "优先条件|优先考虑|者优先|加分项|加分|preferred|nice to have|plus"
REQUIRED = "必须|要求|至少|学历|经验|熟悉|掌握|具备|能够|持有|must|required|degree|proficient|familiar"
OBLIGED = "负责|参与|主导|推动|协助|支持|要求|必须|需要|具备|熟悉|掌握|能够|持有|responsible|required|must|proficient|familiar"
QUALIFIED = "学历|本科|硕士|博士|大专|degree|bachelor|master|phd|证书|资格证|执业|认证|certificate|license"
DUTY = "负责|主导|参与|管理|设计|开发|构建|输出|推动|responsible|build|design|manage"
SKILLED = "熟悉|掌握|使用|技能|proficient|familiar|skill"
TITLES = "岗位|职位|工程师|经理|专员|分析师|设计师|顾问|医生|医师|教师|老师|研究员|intern|engineer|manager|analyst"
# Words of ownership, strongest first.
OWNED = ((4, "主导|牵头|独立负责|独立完成|全权负责|owner|led"), (3, "负责|管理|组织|推动|设计|开发|implemented"), (2, "参与"), (1, "协助|支持|配合|接触|了解|assisted|supported"))
# Degrees in rising order.
DEGREES = ("大专|专科", "本科|学士|bachelor", "硕士|master", "博士|phd")
# What action, method and outcome of a claim read like.
ACTION = "负责|主导|牵头|参与|协助|支持|组织|推动|设计|开发|构建|实现|制定|实施|执行|维护|运营|教学|诊疗|审核|销售|研究|撰写|协调|分析|排查|built|designed|implemented|developed|managed|analyzed|delivered|led"
METHOD = r"通过|采用|使用|基于|借助|运用|利用|结合|按照|围绕|依托|针对|using|via|based\s+on|with\s+the\s+use\s+of"
OUTPUT = "输出|交付|上线|发布|形成|完成|实现|达成|获得|发表|获奖|覆盖|解决|提升|降低|增长|减少|缩短|节省|产出|delivered|launched|published|achieved|improved|reduced|increased|resolved"
NEGATIVE = r"没有(?:相关|对应|这方面|此类|任何)?(?:经验|经历|技能|资质|证书|背景)|无(?:相关|对应|该领域|工作|项目)?(?:经验|经历|技能|资质|证书|背景)|未曾|未参与|不具备|不会|未使用|没有做过|no\s+(?:relevant\s+)?experience|never\s+used"
# Verbs that begin an aspect of its own after a word for "and".
ASPECT_STARTS = ("负责", "参与", "主导", "推动", "协助", "支持", "完成", "输出", "交付", "搭建", "设计", "开发", "构建", "管理", "分析", "规划", "制定", "实施", "执行", "维护", "使用", "熟悉", "掌握", "具备", "能够", "持有", "build", "design", "develop", "manage", "analyze", "deliver", "use", "using")
# Neighbours that make a sign for "and" part of a word.
JOINED = r"(?<![共调中饱温亲柔缓总])和(?![平谐解声睦蔼善气服])|(?<![参赠授])与(?!会)"
STATUSES = ("missing", "partial", "supported")


def _any(words: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(words)


def cleaned(x: Column) -> Column:
    """Without list mark, tag in brackets, and marks around."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s*(?:[-*•●▪◦]|[0-9]+[.、)）]|[（(]?[一二三四五六七八九十]+[)）、.])\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^【[^】]+】\s*", ""), r"(?U)\s+", " ")
    return F.regexp_replace(t, "^[ ：:；;。]+|[ ：:；;。]+$", "")


def core(x: Column) -> Column:
    """Without the shells in front; words inside stay."""
    shells = "|".join(sorted(SHELLS, key=len, reverse=True))
    return X.match_form(F.regexp_replace(F.lower(X.wide_to_plain(x)), rf"^(?:\s*(?:{shells})\s*[:：,，;；-]*\s*)+", ""))


def priority(x: Column) -> Column:
    return F.when(x.rlike(f"(?i){PREFERRED}"), "preferred").when(x.rlike(f"(?i){REQUIRED}"), "required").otherwise("responsibility")


def kind(x: Column) -> Column:
    return F.when(x.rlike(r"[0-9]+(?:\.[0-9]+)?\s*年(?:以上)?"), "tenure").when(x.rlike(f"(?i){QUALIFIED}"), "qualification").when(x.rlike(f"(?i){DUTY}"), "responsibility").when(x.rlike(f"(?i){SKILLED}"), "skill").otherwise("other")


def is_title(x: Column) -> Column:
    """A job title or a document's name, without an obligation."""
    t = F.lower(F.trim(x))
    named = t.rlike(r"^(?:[\x{4e00}-\x{9fff}a-z0-9+.#/_\- ]{1,40}\s+)?(?:jd|job\s+description|职位描述|岗位描述|岗位说明书?)$")
    shaped = t.rlike(rf"^[\x{{4e00}}-\x{{9fff}}a-z0-9+.#/_\- ]{{2,28}}(?:{TITLES})$")
    return (named | shaped) & ~t.rlike(OBLIGED)


def ownership(x: Column) -> Column:
    """4 led, 3 did, 2 took part, 1 helped, 0 nothing said."""
    out = F.lit(0)
    for level, words in reversed(OWNED):
        out = F.when(F.coalesce(x, F.lit("")).rlike(f"(?i){words}"), level).otherwise(out)
    return out


def extracted(targets: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 10) -> DataFrame:
    """Requirements of each target: (id, pos, requirement, core, priority, kind), the hardest ``limit`` in document order.

    A heading's state carries on to the lines below it; page furniture, titles and
    repeated cores are left out.
    """
    rows = segment.pieces(targets, r"[\r\n。；;]+", id_col, text).withColumn("requirement", cleaned(F.col("piece")))
    key = F.lower(F.trim(F.regexp_replace("requirement", r"[\s:：]+", " ")))
    rows = rows.where("requirement <> ''").withColumn("__k", key)
    opens = F.col("__k").isin(*HEADINGS)
    closes = F.col("__k").rlike("^(?:" + "|".join(STOP_HEADINGS) + ")(?: |$)")
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__in", F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(w), F.lit(False))).where(~opens & ~closes)
    r = F.col("requirement")
    predicate = r.rlike(_any(PREDICATES))
    listed = r.rlike(r"(?i)[、,/]|\band\b|\bor\b")
    place = r.rlike(r"(?i)^(?:校区(?:[一二三四五六七八九十0-9]+)?|工作地点|办公地点|工作地址|办公地址|联系地址|上班地点|location)\s*[:：]")
    label = ~F.col("__in") & F.col("__k").rlike("^[a-z][a-z0-9_-]{1,40}$")
    noise = r.rlike(_any(NOISE)) & ~predicate
    web = F.lower(r).rlike(r"^(?:https?://|www\.)")
    good = ~place & ~label & ~noise & ~web & F.length(r).between(3, 220) & ~is_title(r) & (F.col("__in") | predicate | listed)
    rows = rows.where(good).withColumn("core", core(r)).where(F.length("core") >= 2)
    rows = segment.dedup_first(rows, F.col("core"), id_col).withColumn("priority", priority(r)).withColumn("kind", kind(r))
    order = F.when(F.col("priority") == "required", 0).when(F.col("priority") == "responsibility", 1).otherwise(2)
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(order, "pos"))).where(F.col("__n") <= limit)
    return rows.select(id_col, "pos", "requirement", "core", "priority", "kind")


def aspects(x: Column) -> Column:
    """All that a requirement asks for: an array of arrays, each the alternatives of which one is enough.

    Marks between clauses and words for "and" part the aspects; a bare 和 or 与 does so
    only behind an earlier mark, and never within a word. Null and blank texts have one
    empty aspect.
    """
    sign = r"[\x{4e00}-\x{9fff}A-Za-z0-9]"
    verbs = "|".join(ASPECT_STARTS)
    value = F.regexp_replace(cleaned(x), rf"(?i)(?:并且|同时|且|并)(?={verbs})|(?<={sign})以及(?={sign})|\s+and\s+", "；")

    def parted(v: Column) -> Column:
        head = F.regexp_extract(v, r"^[^，,；;、]*", 0)
        tail = F.regexp_replace(F.substr(v, F.length(head) + 1), rf"(?<={sign})(?:{JOINED})(?={sign})", "；")
        trimmed = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
        groups = F.transform(trimmed(F.split(F.concat(head, tail), "[，,；;、]+")), lambda g: trimmed(F.split(g, r"(?i)\s+or\s+|或者|或")))
        return X.let(F.filter(groups, lambda g: F.size(g) > 0), lambda gs: F.when(F.size(gs) > 0, gs).otherwise(F.array(F.array(v))))

    return X.let(value, parted)


def degree_level(x: Column) -> Column:
    """1 college to 4 doctor; 0 none named; the highest named."""
    out = F.lit(0)
    for level, words in enumerate(DEGREES, 1):
        out = F.when(F.coalesce(x, F.lit("")).rlike(f"(?i){words}"), level).otherwise(out)
    return out


def years_needed(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"([0-9]+(?:\.[0-9]+)?)\s*年", 1), F.lit("")).cast("double")


def assessed(requirements: DataFrame, claims: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each requirement (id, pos, requirement, core, kind) against its bundle's claims (id, path, claim): status and best path.

    Contained core of three characters or more, or a share of bigrams of 0.72 told as an action, supports; 0.20
    relates; a negated claim supports nothing. Degrees compare by rank. Of equal
    shares the claim first by path counts.
    """
    j = requirements.join(claims, id_col, "left")
    direct = (F.length("core") >= 3) & X.match_form(F.col("claim")).contains(F.col("core"))
    share = X.covered_share(X.let(F.col("core"), lambda c: X.grams(c, 2, True)), X.match_bigrams(F.col("claim")))
    negative = F.coalesce(F.col("claim").rlike(f"(?i){NEGATIVE}"), F.lit(False))
    need, have = degree_level(F.col("requirement")), degree_level(F.col("claim"))
    met = (F.col("kind") == "qualification") & (need > 0) & (have >= need)
    score = F.when(F.col("claim").isNull() | negative, 0.0).when(direct | met, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))
    acted = F.coalesce(F.col("claim").rlike(f"(?i){ACTION}"), F.lit(False))
    j = j.withColumn("score", score).withColumn("acted", acted)
    w = Window.partitionBy(id_col, "pos").orderBy(F.col("score").desc(), F.col("acted").desc(), "path")
    best = j.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    status = F.when((F.col("score") >= 1.0) | ((F.col("score") >= 0.72) & F.col("acted")), "supported").when(F.col("score") >= 0.2, "partial").otherwise("missing")
    return best.select(id_col, "pos", "requirement", "kind", status.alias("status"), F.when(F.col("score") >= 0.2, F.col("path")).alias("path"), F.bround("score", 4).alias("score"))


def assessed_by_aspects(requirements: DataFrame, claims: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each requirement (id, pos, requirement) by its ``aspects``: status, paths of the claims that count, gaps.

    Of alternatives the best counts, the first of equal ones. Supported: all aspects are;
    partial: one is or is related; else missing. ``gaps``: the first three aspects that
    are not supported. Id and pos name a requirement. A null or blank one is missing
    without gaps; other columns are left out.
    """
    rows = requirements.select(id_col, "pos", "requirement", F.posexplode(aspects(F.col("requirement"))).alias("__group", "__any"))
    rows = rows.select(id_col, F.col("pos").alias("__pos"), F.col("requirement").alias("__whole"), "__group", F.posexplode("__any").alias("__at", "requirement"))
    whole = rows.select(id_col, "__pos", "__whole").distinct()
    place = F.struct("__pos", "__group", "__at")
    rows = rows.select(id_col, place.alias("pos"), "requirement", core(F.col("requirement")).alias("core"), kind(F.col("requirement")).alias("kind"))
    met = assessed(rows, claims, id_col)
    level = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")) - 1
    best = F.max_by(F.struct(level.alias("level"), "requirement", "path"), F.struct(level, "score", -F.col("pos.__at")))
    groups = met.groupBy(id_col, F.col("pos.__pos").alias("__pos"), F.col("pos.__group").alias("__group")).agg(best.alias("b"))
    listed = F.array_sort(F.collect_list(F.struct("__group", "b.level", "b.requirement", "b.path")))
    out = groups.groupBy(id_col, "__pos").agg(listed.alias("gs"), F.min("b.level").alias("low"), F.max("b.level").alias("high"))
    status = F.when(F.col("low") == 2, "supported").when(F.col("high") > 0, "partial").otherwise("missing")
    paths = F.array_distinct(F.array_compact(F.transform(F.filter("gs", lambda g: g["level"] > 0), lambda g: g["path"])))
    gaps = F.array_distinct(F.transform(F.filter("gs", lambda g: (g["level"] < 2) & (g["requirement"] != "")), lambda g: g["requirement"]))
    out = out.select(F.col(id_col).alias("__id"), F.col("__pos").alias("pos"), status.alias("status"), paths.alias("paths"), F.slice(gaps, 1, 3).alias("gaps"))
    same = F.col("__id").eqNullSafe(F.col(id_col)) & F.col("pos").eqNullSafe(F.col("__pos"))
    return out.join(whole, same).select(id_col, "pos", F.col("__whole").alias("requirement"), "status", "paths", "gaps")


def claim_gaps(claims: DataFrame, id_col: str = "doc_id", limit: int = 4) -> DataFrame:
    """The first ``limit`` claims that lack action, method or outcome, with what they lack."""
    c = F.coalesce(F.col("claim"), F.lit(""))
    lack = F.array_compact(F.array(F.when(~c.rlike(f"(?i){ACTION}"), "action"), F.when(~c.rlike(f"(?i){METHOD}"), "method"), F.when(~c.rlike(f"(?i){OUTPUT}"), "result")))
    rows = claims.withColumn("lacks", lack).where(F.size("lacks") > 0)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy("path"))).where(F.col("__n") <= limit).drop("__n")
