"""Rules on pairs of texts, before and after a rewrite: what was added, lost, inflated or may need review.

Column functions over the pair; a null text counts as empty. Nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import text as X

_HAN = r"\x{4e00}-\x{9fff}"
_KEPT = rf"[^\p{{L}}\p{{N}}_{_HAN}+.#/-]+"

# Words of three degrees of ownership.
STRONG = ("主导", "统筹", "牵头", "独立负责", "全权负责", "从0到1", "从零到一")
MEDIUM = ("负责", "组织", "推动", "管理", "设计", "开发", "构建", "实现", "制定")
WEAK = ("参与", "协助", "支持", "配合", "接触", "了解", "学习")
OWNERSHIP = {0: "unspecified", 1: "support", 2: "responsible", 3: "lead"}
# What shows the parts of a full account.
AMOUNT = r"[0-9]+(?:\.[0-9]+)?\s*(?:%|万元|万|人|名|次|项|个|条|篇|例|台|套|元)"
ACCOUNT = {
    "context": r"在[^，。；;]{1,40}(?:期间|背景下|场景下)|面向|针对|围绕",
    "action": r"开展|执行|处理|分析|研究|维护|跟进|诊疗|授课|复核|运营",
    "method": r"通过|使用|采用|基于|借助|运用|利用|结合|按照|依据|协同|协调",
    "deliverable": r"输出|形成|产出|撰写|编制|制定|设计|开发|构建|搭建|建立|交付|上线|发布|完成",
    "result": rf"(?:提升|提高|增长|降低|减少|缩短|节省|达到|达成|获得|获奖|录用|覆盖|支持)[^，。；;]{{0,30}}(?:{AMOUNT}|目标|要求|标准)|{AMOUNT}",
}
# Phrases that bring in a fact, and names of methods and things.
BROUGHT_IN = r"(?:使用|采用|基于|借助|运用|利用)\s*([^，。；,;]{2,24}?)(?=进行|开展|完成|实现|输出|分析|设计|优化|管理|，|。|；|,|;|$)"
NAMED_THING = rf"[A-Za-z0-9+.#/_-]*[{_HAN}A-Za-z0-9+.#/_-]{{2,18}}(?:方法|工具|技术|系统|平台|模型|框架|算法|软件|数据库|产品|项目)"
FACT_ANCHOR = r"(?i)[0-9]+(?:\.[0-9]+)?(?:%|万|w|k|人|次|个|条|元|年|月|日)?|[A-Za-z][A-Za-z0-9+.#/_-]*"
# Claims of a measured change, inflating words, and which of them a modest role does not bear.
CLAIMED_CHANGE = (
    r"(?i)(?:提升|降低|减少|增加|缩短|节省|提高|改善|下降|增长|缩减|降至|升至)\s*(?:了|至|到|为)?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:%|倍|ms|s|分钟|小时|天|w|万|k|qps|tps)",
    r"(?i)(?:increased|decreased|reduced|improved|boosted|lowered|cut|saved|accelerated|grew|shrunk)\s+(?:by|to|from)?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:%|x|ms|s|minutes?|hours?|days?|K|M|B|qps|tps)",
)
INFLATING = ("主导", "独立", "牵头", "首创", "独创", "从零", "全面", "彻底", "根本性", "颠覆", "革命性")
ROLE_LIMITS = {"实习生": ("负责人", "主导", "牵头", "独立"), "助理": ("负责人", "主导", "牵头"), "初级": ("主导", "牵头", "独立", "从零"), "参与": ("主导", "独立", "牵头", "从零")}


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _compact(x: Column) -> Column:
    return F.lower(F.regexp_replace(_text(x), _KEPT, ""))


def _any(x: Column, words) -> Column:
    return x.rlike("|".join(f"\\Q{w}\\E" for w in words))


def _bigrams(x: Column) -> Column:
    t = F.lower(F.regexp_replace(_text(x), rf"[^\p{{L}}\p{{N}}\p{{M}}_{_HAN}]+", ""))
    return X.let(t, lambda c: F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))))


def ownership(x: Column) -> Column:
    """3 to 0: leads, is responsible, supports, nothing said."""
    t = _text(x)
    return F.when(_any(t, STRONG), 3).when(_any(t, MEDIUM), 2).when(_any(t, WEAK), 1).otherwise(0)


def ownership_marker(values: Column, level: int) -> Column:
    """Of an array's texts, the word of the level that stands earliest in its text; empty without one."""
    words = {3: STRONG, 2: MEDIUM, 1: WEAK}.get(level, ())
    found = F.flatten(F.transform(values, lambda v: F.array(*[F.when(F.locate(w, v) > 0, F.struct(F.locate(w, v).alias("at"), F.lit(w).alias("word"))) for w in words])))
    return F.coalesce(F.array_min(F.array_compact(found))["word"], F.lit("")) if words else F.lit("")


def account(x: Column) -> Column:
    """struct (ownership, dimensions): which parts of a full account a bullet has."""
    t = F.trim(_text(x))
    level = ownership(t)
    names = [F.when(t.rlike(p) | ((level > 0) if k == "action" else F.lit(False)), k) for k, p in ACCOUNT.items()]
    label = F.create_map(*[F.lit(v) for kv in OWNERSHIP.items() for v in kv])[level]
    return F.struct(label.alias("ownership"), F.array_compact(F.array(*names)).alias("dimensions"))


def brings_in(before: Column, after: Column) -> Column:
    """Whether the rewrite names a method, tool or thing that the original lacks."""
    phrases = F.concat(F.regexp_extract_all(_text(after), F.lit(BROUGHT_IN), F.lit(1)), F.regexp_extract_all(_text(after), F.lit(NAMED_THING), F.lit(0)))
    return X.let(_compact(before), lambda b: F.exists(F.transform(phrases, _compact), lambda p: (F.length(p) >= 2) & ~b.contains(p)))


def anchored(x: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_text(x), F.lit(FACT_ANCHOR), F.lit(0)), F.lower))


def still_said(source: Column, candidate: Column, recall: float = 0.52) -> Column:
    """Whether a regrouped text still says the source: word for word, or all its anchors and enough of its bigrams."""
    s, c = _compact(source), _compact(candidate)
    share = X.covered_share(_bigrams(source), _bigrams(candidate))
    anchors = F.size(F.array_except(anchored(source), anchored(candidate))) == 0
    return (s != "") & (c != "") & (c.contains(s) | (anchors & (share >= recall)))


def regroups_all(indices: Column, count: Column) -> Column:
    """Whether groups of indices take every source text exactly once."""
    flat = F.flatten(indices)
    whole = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return (F.size(flat) == count) & (F.array_sort(flat.cast("array<int>")) == whole)


def lossless_groups(sources: Column, groups: Column) -> Column:
    """Whether ``groups``, array of (text, indices), regroup ``sources`` without loss: every index once, no text twice, one ownership a group, each source still said."""
    texts = F.transform(groups, lambda g: fields.semantic_form(g["text"]))
    own = F.forall(groups, lambda g: F.size(F.array_distinct(F.transform(g["indices"], lambda i: ownership(F.get(sources, i))))) <= 1)
    said = F.forall(groups, lambda g: F.forall(g["indices"], lambda i: still_said(F.get(sources, i), g["text"])))
    return regroups_all(F.transform(groups, lambda g: g["indices"]), F.size(sources)) & (F.size(F.array_distinct(texts)) == F.size(texts)) & own & said


def needs_review(before: Column, after: Column, generated: float = 0.35, recall: float = 0.45) -> Column:
    """Whether a rewrite has mostly new wording, or lost much of the old."""
    a, b = _bigrams(before), _bigrams(after)
    return (F.size(a) == 0) | (F.size(b) == 0) | (X.covered_share(b, a) < generated) | (X.covered_share(a, b) < recall)


def technical_anchors(x: Column, known: list[str], terms: list[str], stop: list[str]) -> Column:
    """Latin tokens that look technical or are known, lower-cased, and known terms; sorted."""
    tokens = F.regexp_extract_all(_text(x), F.lit("[A-Za-z][A-Za-z0-9_+./-]{1,30}"), F.lit(0))
    tokens = F.filter(tokens, lambda t: ~F.lower(t).isin(*stop, "") & (t.rlike("[A-Z0-9]") | (F.length(t) >= 6) | F.lower(t).isin(*known, "")))
    said = F.array_compact(F.array(*[F.when(_text(x).contains(w), w) for w in terms])) if terms else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.transform(tokens, F.lower), said)))


def unverified(before: Column, after: Column, known: list[str], terms: list[str], stop: list[str]) -> Column:
    """Labels of what a rewrite claims beyond its original: number, anchors, inflation, role."""
    b, a = _text(before), _text(after)
    numbers = F.regexp_extract_all(b, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    claimed = F.concat(*[F.regexp_extract_all(a, F.lit(p), F.lit(1)) for p in CLAIMED_CHANGE])
    anchors = F.array_except(technical_anchors(a, known, terms, stop), technical_anchors(b, known, terms, stop))
    grown = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: a.contains(w) & ~b.contains(w))
    role = F.lit(False)
    for modest, words in ROLE_LIMITS.items():
        role = role | (b.contains(modest) & grown(words))
    return F.array_compact(F.array(F.when(F.size(F.array_except(claimed, numbers)) > 0, "number"), F.when(F.size(anchors) >= 2, "anchors"), F.when(grown(INFLATING), "inflation"), F.when(role, "role")))


def substantive(location: Column, project: Column, before: Column, after: Column) -> Column:
    """Whether a change is more than format, of one place, with both sides, and not the same by form."""
    own = (F.lower(F.trim(_text(location))) != "format") & (F.trim(_text(project)) != "全局")
    full = (F.trim(_text(before)) != "") & (F.trim(_text(after)) != "")
    return own & full & (fields.semantic_form(before) != fields.semantic_form(after))


def deep_rewrite_due(style: Column, high: Column, medium: Column, issues: Column, changed: Column) -> Column:
    """Whether an audit calls for more than the changes that were made."""
    bold = ((high >= 1) | (issues >= 3) | (medium >= 2)) & (changed < 2)
    return F.when(style == "aggressive", bold).otherwise((high >= 2) & (changed == 0))


def without_metric(x: Column, number: Column) -> Column:
    """A text without a number, its unit and the change that it was said of."""
    pattern = F.concat(F.lit(r"(?:提升|降低|减少|增加|缩短|节省|提高|增长)?(?:了|至|到|约)?\s*(?<![0-9.])"), F.regexp_replace(number, r"([.+*?^$()\[\]{}|\\])", r"\\$1"), F.lit(r"(?![0-9]|\.[0-9])\s*(?:%|万元|万|人|名|次|项|个|条|篇|倍|元|ms|s|分钟|小时|天)?"))
    return F.trim(F.regexp_replace(_text(x), pattern, F.lit("")))


def allowed(values: Column, allow: Column) -> Column:
    """The values whose lower-cased form is on the list, in their order."""
    return F.filter(values, lambda v: F.array_contains(allow, F.lower(F.trim(v))))


def supported_or_blank(x: Column, evidence: Column) -> Column:
    """A field that its evidence says, by the evidence form; else empty."""
    return F.when(X.evidence_form(evidence).contains(X.evidence_form(x)) & (X.evidence_form(x) != ""), x).otherwise("")


def change_signals(before: Column, after: Column, known: list[str], terms: list[str], stop: list[str]) -> Column:
    """What a rewrite gained: a metric, or a way to verify without one; technical anchors; else a new wording."""
    b, a = _text(before), _text(after)
    gained = F.size(F.array_except(technical_anchors(a, known, terms, stop), technical_anchors(b, known, terms, stop))) > 0
    found = F.array_compact(F.array(F.when(X.has_metric(a) & ~X.has_metric(b), "metric").when(~X.has_metric(a) & ~X.has_metric(b), "verifiable"), F.when(gained, "anchors")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("wording")))


def weakness(x: Column) -> Column:
    """How many of action, metric and result a bullet lacks."""
    t = _text(x)
    return (ownership(t) == 0).cast("int") + (~X.has_metric(t)).cast("int") + (~t.rlike(ACCOUNT["result"])).cast("int")


def phrases_replaced(x: Column, phrases: dict[str, str]) -> Column:
    """A text with each stock phrase in its plain words."""
    out = _text(x)
    for was, now in phrases.items():
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def has_any(x: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text, inside other words too."""
    return F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.lower(_text(x)).contains(F.lower(w)))


