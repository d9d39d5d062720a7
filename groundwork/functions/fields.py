"""Forms, labels and predicates of single fields: names, periods, roles, excerpts, paths, entities.

Columns of SQL functions throughout; a null counts as an empty text unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

_HAN = r"\x{4e00}-\x{9fff}"
_WORDLIKE = r"\p{L}\p{N}\p{M}_"

# Labels that readers see for internal codes.
INDUSTRIES = {
    "product_research": "产研", "ai_engineering": "算法/AI", "operations": "运营", "doctor": "医疗", "teacher": "教师/教育", "sales_presale": "销售/售前",
    "finance": "金融", "design": "设计", "education": "教育", "legal": "法律", "other": "综合",
}
STAGES = {"student": "在校生/应届生", "experienced": "职场人士", "job_seeker": "求职者"}
# What a semantic comparison ignores, where an advisor is named, words of any project, private-use and bullet glyphs.
IGNORED_MARKS = r"""[，。；：、“”‘’（）()【】\[\],.;:!?！？\-_/\\"']"""
ADVISOR = "指导老师|advisor|mentor"
PROJECT_WORDS = "研究项目|项目经历|项目经验|project"
PROJECT_PERIOD = r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}\s*(?:[-–—至到~]\s*(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}|至今|present))?"
GLYPHS = r"[\x{F000}-\x{F8FF}•●◦▪◆▶►▸▹]+"
UNNAMED_PROJECT = "科研项目"
# Units that follow a number without a blank; the marker before fetched text; sections of records.
UNITS = "%|万|w|k|人|次|个|条|元|年|月|日"
FETCHED = "【链接页面正文（仅作补充）】"
RECORD_PATH = r"^(?:experience|research|activities|projects)\[[0-9]+\]"
# Endings of organisations and of schools, and verbs that show a phrase is no name.
ENTITY = (
    r"[A-Za-z\x{4e00}-\x{9fff}]{2,40}(?:有限公司|集团|公司|大学|学院|研究所|医院|中心|学校|教育|科技)(?![\x{4e00}-\x{9fff}])",
    r"[\x{4e00}-\x{9fff}]{3,30}(?:大学|学院|医院|学校|集团|公司|研究院|实验室)(?![\x{4e00}-\x{9fff}])",
)
SCHOOL_WORDS = "大学|学院|学校|研究院"
ENTITY_VERBS = "实习|参与|负责|完成|撰写|协助|推动|推进|主导|开发|构建|建立|管理|运营|分析|设计|优化|提供|组织|筹备|开展"
# Lines that tell of publications or of awards, and words of an internship.
PUBLICATION = "(?i)doi|SCI|EI|CSCD|journal|review|boreas|quaternary|ecological|湖泊科学|古生物"
AWARD = "获|荣获|奖学金|优秀|奖励|表彰|称号"
INTERNSHIP = "实习|intern|校园|兼职|实训|教育实习|临床轮转|支教"


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def semantic_form(x: Column) -> Column:
    """Lower case without marks and white space, for comparing meanings."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(x)), IGNORED_MARKS, ""), r"\s+", "")


def project_form(x: Column) -> Column:
    """A project's name to compare by: what stands before an advisor, without periods, general words and marks."""
    named = F.regexp_extract(F.lower(X.compare_form(_text(x))), rf"^(.*?)(?:{ADVISOR}|$)", 1)
    for pattern in (PROJECT_PERIOD, f"(?i)(?:{PROJECT_WORDS})", r"[-–—|:：()\[\]{}【】]+", r"\s+"):
        named = F.regexp_replace(named, pattern, " ")
    return F.trim(named)


def project_name(x: Column, limit: int = 120) -> Column:
    """A project's name to show: no glyphs at its ends; a general one where nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(_text(x), GLYPHS, " "), r"\s+", " ")
    cleaned = F.regexp_replace(cleaned, r"^[ \-–—|:：,，;；]+|[ \-–—|:：,，;；]+$", "")
    return F.when(cleaned.rlike(rf"[{_HAN}A-Za-z0-9]"), F.substring(cleaned, 1, limit)).otherwise(UNNAMED_PROJECT)


def grouped_surface(x: Column) -> Column:
    """No blank between a Han character and a digit, or a digit and its unit."""
    t = F.regexp_replace(X.compare_form(_text(x)), rf"(?<=[{_HAN}])\s+(?=[0-9])", "")
    return F.regexp_replace(t, rf"(?i)(?<=[0-9])\s+(?=(?:{UNITS}))", "")


def full_year(x: Column) -> Column:
    """Two digits up to 50 belong to this century, the others to the last; anything else stays."""
    t = F.trim(_text(x))
    return F.when(t.rlike("^[0-9]{2}$"), F.concat(F.when(t.cast("int") <= 50, "20").otherwise("19"), t)).otherwise(t)


def dated_pairs(x: Column) -> Column:
    """The distinct (year, month) of a text, sorted; a bare year has an empty month."""
    found = F.regexp_extract_all(_text(x), F.lit(X.DATE_OR_YEAR), F.lit(0))
    numbers = lambda d: F.regexp_extract_all(d, F.lit("[0-9]+"), F.lit(0))
    year = lambda d: F.element_at(F.filter(numbers(d), lambda n: F.length(n) == 4), 1)
    month = lambda d: F.coalesce(F.lpad(F.get(F.filter(numbers(d), lambda n: F.length(n) < 4), F.lit(0)), 2, "0"), F.lit(""))
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.concat_ws("-", year(d), month(d)))))


def safe_excerpt(x: Column, limit: int = 160) -> Column:
    """At most ``limit`` characters; a longer text ends after the last mark of its second half, by the marks' precedence."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, limit - 1)
        after = [F.length(head) - F.locate(m, F.reverse(head)) + 1 for m in ("。", "；", ";", "，", ",", " ")]
        place = F.lit(limit - 1)
        for m, a in reversed(list(zip(("。", "；", ";", "，", ",", " "), after, strict=True))):
            place = F.when((F.locate(m, F.reverse(head)) > 0) & (a > max(1, limit // 2)), a).otherwise(place)
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substr(t, F.lit(1), place)), F.lit("…")))

    return X.let(X.compare_form(_text(x)), cut)


def snippet(x: Column, limit: int = 42) -> Column:
    t = F.trim(_text(x))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("...")))


def industry_label(x: Column) -> Column:
    t = F.trim(_text(x))
    known = F.create_map(*[F.lit(v) for kv in INDUSTRIES.items() for v in kv])
    return F.when((t == ""), INDUSTRIES["other"]).otherwise(F.coalesce(known[t], t))


def stage_label(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in STAGES.items() for v in kv])
    return F.coalesce(known[F.trim(_text(x))], F.lit(STAGES["job_seeker"]))


def month_spellings(x: Column) -> Column:
    """The years and months of a text's dates as they may be written alone, sorted."""
    pairs = dated_pairs(x)
    year, month = lambda p: F.substring_index(p, "-", 1), lambda p: F.substring_index(p, "-", -1)
    some = F.filter(pairs, lambda p: month(p) != "")
    short = lambda p: month(p).cast("int").cast("string")
    every = F.transform(pairs, year), F.transform(pairs, lambda p: F.concat(year(p), F.lit("年"))), F.transform(some, month), F.transform(some, short), F.transform(some, lambda p: F.concat(short(p), F.lit("月")))
    return F.array_sort(F.array_distinct(F.concat(*every)))


def record_root(path: Column) -> Column:
    """The record that a path lies in, or its first key."""
    hit = F.regexp_extract(_text(path), RECORD_PATH, 0)
    return F.when(hit != "", hit).otherwise(F.substring_index(_text(path), ".", 1))


def friendly_path(path: Column, labels: dict[str, str]) -> Column:
    """A path as readers say it: labels for keys, places from one."""
    steps = F.split(_text(path), r"\.")

    def shown(step: Column) -> Column:
        key, place = F.regexp_extract(step, r"^([^\[]*)", 1), F.regexp_extract(step, r"\[([0-9]+)\]", 1)
        named = F.coalesce(F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])[key], key)
        return F.when(place != "", F.concat(named, F.lit(" "), (place.cast("int") + 1).cast("string"))).otherwise(named)

    return F.array_join(F.transform(steps, shown), " / ")


def own_target_text(x: Column) -> Column:
    """What was pasted, without the text fetched from its links."""
    return F.substring_index(_text(x), FETCHED, 1)


def labelled(x: Column, labels: list[str]) -> Column:
    """What follows the first ``label:`` on its line; empty without one."""
    return F.trim(F.regexp_extract(_text(x), rf"(?m)(?:^|[\s，,；;|])(?:{'|'.join(labels)})\s*[:：]\s*([^\n，,；;|]+)", 1))


def duty_prefix(x: Column, verbs: str) -> Column:
    """What stands before the first clause that begins with a duty verb."""
    return F.trim(F.regexp_extract(_text(x), rf"^(.*?)(?:[，,。；;\s](?:{verbs})|$)", 1))


def trimmed_span(x: Column, start: Column, end: Column) -> Column:
    """struct (start, end) of a piece without white space at its ends and without one bullet mark."""
    piece = F.substr(_text(x), start + 1, end - start)
    lead = F.length(F.regexp_extract(piece, r"^\s*", 0))
    body = F.length(F.regexp_replace(F.substr(piece, lead + 1), r"\s+$", ""))
    mark = F.length(F.regexp_extract(F.substr(piece, lead + 1, body), r"^(?:[-*•·▪◦]|[0-9]{1,3}(?:[、)]|\.(?![0-9])))\s*", 0))
    return F.struct((start + lead + mark).alias("start"), (start + lead + body).alias("end"))


def layout_heading(x: Column, headings: list[str], suffix: str, contact: str = r"@|[0-9]{7,}") -> Column:
    """Whether a line is a short heading: of the known ones or ending like one, without dates, contacts and clauses."""
    t = F.regexp_replace(F.trim(_text(x)), r"^[\s:：|｜/\\【】\[\]()（）]+|[\s:：|｜/\\【】\[\]()（）]+$", "")
    form = F.lower(F.regexp_replace(t, r"\s+", ""))
    plain = ~t.rlike(X.DATE_OR_YEAR) & ~t.rlike(contact) & ~t.rlike("[，,。；;!?！？]")
    return F.length(form).between(1, 18) & plain & (form.isin(*headings) | form.rlike(f"(?:{suffix})$"))


def is_inside(root: Column, path: Column) -> Column:
    """Whether a relative path stays below its root: no absolute part, no step out of it."""
    steps = F.filter(F.split(_text(path), r"[/\\]"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(steps, F.lit(0), lambda d, s: F.when(d < 0, d).otherwise(d + F.when(s == "..", -1).otherwise(1)))
    return ~_text(path).rlike(r"^(?:[/\\]|[A-Za-z]:)") & (depth >= 0) & root.isNotNull()


def needs_detail(x: Column, general: list[str]) -> Column:
    t = F.trim(_text(x))
    return (F.length(t) < 24) | F.exists(F.array(*map(F.lit, general)).cast("array<string>"), lambda g: t.contains(g))


def clauses(x: Column) -> Column:
    """The clauses to compare evidence by: three word characters at least."""
    parts = F.split(_text(x), r"[\n。；;,，]+")
    parts = F.filter(parts, lambda p: F.length(F.regexp_replace(p, rf"[^{_WORDLIKE}]+", "")) >= 3)
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^[ \t\-•·▪◦，,。；;]+|[ \t\-•·▪◦，,。；;]+$", ""))


def sentences_of(x: Column, limit: int = 6) -> Column:
    """A bullet's sentences, up to ``limit``, each form once; the bullet itself where none is long enough."""
    whole = F.regexp_replace(X.compare_form(_text(x)), r"^[ \t。；;]+|[ \t。；;]+$", "")

    def split(t: Column) -> Column:
        parts = F.transform(F.split(t, "[。；;]+"), lambda p: F.regexp_replace(p, r"^[ \t，,。；;]+|[ \t，,。；;]+$", ""))
        parts = F.slice(F.filter(parts, lambda p: p != ""), 1, limit)
        form = lambda p: F.lower(F.regexp_replace(p, rf"[^{_WORDLIKE}]+", ""))

        def first(ps: Column) -> Column:
            forms = F.transform(ps, form)
            return X.let(forms, lambda fs: F.filter(ps, lambda p, i: (F.length(F.get(fs, i)) >= 4) & (F.array_position(fs, F.get(fs, i)) == i + 1)))

        kept = X.let(parts, first)
        return X.let(kept, lambda k: F.when(t == "", F.array().cast("array<string>")).when(F.size(k) > 0, k).otherwise(F.array(t)))

    return X.let(whole, split)


def named_entities(x: Column) -> Column:
    """struct (companies, schools): lower-cased names by their endings, without phrases that begin like a duty."""
    found = F.concat(*[F.regexp_extract_all(_text(x), F.lit(p), F.lit(0)) for p in ENTITY])
    names = F.filter(found, lambda n: F.length(n).between(2, 30) & ~F.substring(n, 1, 6).rlike(ENTITY_VERBS))
    names = F.array_sort(F.array_distinct(F.transform(names, F.lower)))
    return F.struct(F.filter(names, lambda n: ~n.rlike(SCHOOL_WORDS)).alias("companies"), F.filter(names, lambda n: n.rlike(SCHOOL_WORDS)).alias("schools"))


def lines_about(x: Column, pattern: str, least: int, limit: int = 20) -> Column:
    """The distinct lines of ``least`` characters or more that match, in order, ``limit`` at most."""
    lines = F.transform(F.split(_text(x), r"\R"), lambda s: X.compare_form(s))
    return F.slice(F.array_distinct(F.filter(lines, lambda s: (F.length(s) >= least) & s.rlike(pattern))), 1, limit)


def publications(x: Column) -> Column:
    return lines_about(x, PUBLICATION, 24)


def awards(x: Column) -> Column:
    return lines_about(x, AWARD, 8)


def section_lines(x: Column, start: str, stop: str) -> Column:
    """The lines after the first that matches ``start`` and before the next that matches ``stop``."""
    lines = F.filter(F.transform(F.split(_text(x), r"\R"), F.trim), lambda s: s != "")

    def after(ls: Column) -> Column:
        begin = F.array_position(F.transform(ls, lambda s: s.rlike(start)), True).cast("int")
        rest = F.when(begin > 0, F.slice(ls, begin + 1, F.greatest(F.size(ls), F.lit(1)))).otherwise(F.array().cast("array<string>"))

        def before(rs: Column) -> Column:
            end = F.array_position(F.transform(rs, lambda s: s.rlike(stop)), True).cast("int")
            return F.when(end > 0, F.slice(rs, 1, end - 1)).otherwise(rs)

        return X.let(rest, before)

    return X.let(lines, after)


def start_month(period: Column) -> Column:
    """The first (year, month) of a period as year * 100 + month; null without one."""
    return F.regexp_replace(F.get(F.filter(dated_pairs_in_order(period), lambda p: ~p.endswith("-")), F.lit(0)), "-", "").cast("int")


def dated_pairs_in_order(x: Column) -> Column:
    found = F.regexp_extract_all(_text(x), F.lit(X.DATE), F.lit(0))
    numbers = lambda d: F.regexp_extract_all(d, F.lit("[0-9]+"), F.lit(0))
    year = lambda d: F.element_at(F.filter(numbers(d), lambda n: F.length(n) == 4), 1)
    return F.transform(found, lambda d: F.concat_ws("-", year(d), F.lpad(F.element_at(F.filter(numbers(d), lambda n: F.length(n) < 4), 1), 2, "0")))


def same_dates_said(value: Column, evidence: Column, room: int = 180) -> Column:
    """Whether a text's dates stand in order in one line of the evidence, or near each other in it."""
    want = dated_pairs_in_order(value)
    run = F.array_join(want, "|")
    held = lambda t: F.concat(F.lit("|"), F.array_join(dated_pairs_in_order(t), "|"), F.lit("|")).contains(F.concat(F.lit("|"), run, F.lit("|")))
    lines = F.exists(F.split(_text(evidence), r"[\n；;]"), held)
    near = F.exists(F.split(F.regexp_replace(_text(evidence), rf"(?s)({X.DATE})(?=.{{{room + 1}}})(?!.{{0,{room}}}{X.DATE})", "$1\x00"), "\x00"), held)
    return (F.size(want) > 0) & (lines | near)


def target_issues(bullets: Column) -> Column:
    return F.when(bullets >= 8, 4).when(bullets >= 4, 3).when(bullets >= 2, 2).when(bullets > 0, 1).otherwise(0)


def stated_tenure(x: Column) -> Column:
    """A duration that is said as such; empty for anything else."""
    t = F.trim(_text(x))
    return F.when(t.rlike(r"^(?:约|近|超过)?\s*[0-9]{1,2}(?:\.[0-9])?\s*(?:年|个月|years?|months?)(?:以上|\+)?(?:工作)?(?:经验)?$"), t).otherwise("")
