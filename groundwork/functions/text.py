"""Column functions over text: normal forms, estimates, redaction, dates, anchors, grams.

All run inside the JVM. Null texts count as empty unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

_CJK = "\\x{4e00}-\\x{9fff}"
_DATE = r"(?:(?:19|20)[0-9]{2}\s*[-./年]\s*(?:1[0-2]|0?[1-9])\s*月?|(?:1[0-2]|0?[1-9])\s*[-./]\s*(?:19|20)[0-9]{2})"
#: A date as a whole: not within a longer number.
DATE = rf"(?<![0-9]){_DATE}(?![0-9])"
DATE_OR_YEAR = rf"(?<![0-9])(?:{_DATE}|(?:19|20)[0-9]{{2}}\s*年?)(?![0-9])"


def _s(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(_s(x), r"(?U)^\s+|\s+$", "")


def compare_form(x: Column) -> Column:
    """White space squeezed and stripped."""
    return strip(F.regexp_replace(_s(x), r"(?U)\s+", " "))


def wide_to_plain(x: Column) -> Column:
    """Full-width letters, digits and signs as their plain forms, the part of NFKC that occurs in these texts."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(_s(x), wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def match_form(x: Column) -> Column:
    """Lower case; only letters, digits, + . # / _ - and Han characters stay."""
    return F.regexp_replace(F.lower(wide_to_plain(x)), rf"[^a-z0-9+.#/_\-{_CJK}]+", "")


def identity_form(x: Column) -> Column:
    """Lower case; only word characters stay, of any script."""
    return F.regexp_replace(F.lower(wide_to_plain(x)), r"[^\p{L}\p{M}\p{N}_]+", "")


def evidence_form(x: Column) -> Column:
    """Lower case without white space and listed punctuation."""
    return F.regexp_replace(F.lower(wide_to_plain(x)), r"(?U)[\s，。；：、,.;:!?！？()（）\[\]【】\"'“”‘’|·•\-—]+", "")


def heading_form(x: Column) -> Column:
    """A heading without separators and brackets, lower case."""
    return F.lower(F.regexp_replace(_s(x), r"(?U)[\s:：|/·•#*=\-—_\[\]【】()（）<>《》]+", ""))


def company_form(x: Column) -> Column:
    """One trailing legal form or parenthesis removed."""
    return strip(F.regexp_replace(strip(x), rf"(?:{L.COMPANY_SUFFIX}|[（(][^（）()]*[）)])$", ""))


def excerpt(x: Column, limit: int = 140) -> Column:
    """Squeezed and cut to ``limit`` characters, an ellipsis last if cut."""
    return let(compare_form(x), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))))


def _count(x: Column, cls: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, cls, ""))


_CJK_ALL = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}"


def token_estimate(x: Column) -> Column:
    """ASCII and Han characters count one, all others three."""
    return (F.length(_s(x)) + 2 * _count(_s(x), rf"[^\x00-\x7f{_CJK_ALL}]+")).cast("long")


def static_token_estimate(x: Column) -> Column:
    """Three ASCII characters count one, Han one, others two."""
    t = _s(x)
    other = _count(t, rf"[^\x00-\x7f{_CJK_ALL}]+")
    return (F.ceil(_count(t, r"[\x00-\x7f]+") / 3) + _count(t, rf"[{_CJK_ALL}]+") + 2 * other).cast("long")


def redact_pii(x: Column, limit: int = 500) -> Column:
    """Mail addresses, mobile numbers and identity numbers by marks; then cut."""
    t = F.regexp_replace(_s(x), r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    t = F.regexp_replace(t, r"(?:\+?86[- ]?)?1[3-9][0-9]{9}", "[PHONE]")
    return F.substring(F.regexp_replace(t, r"(?<![0-9])[0-9]{15,18}[0-9Xx](?![0-9])", "[ID]"), 1, limit)


def redact_injection(x: Column) -> Column:
    t = _s(x)
    for p in L.INJECTION_PATTERNS:
        t = F.regexp_replace(t, f"(?i){p}", "[REDACTED]")
    return t


def strip_contacts(x: Column) -> Column:
    """For reports: no URLs, mail addresses, phone numbers or leading list marks."""
    t = F.regexp_replace(_s(x), r"(?i)https?://[^\s，。；;、]+|www\.[^\s，。；;、]+", "")
    t = F.regexp_replace(t, r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}|(?:\+?86[- ]?)?1[3-9][0-9]{9}", "")
    return strip(F.regexp_replace(t, r"(?m)^\s*(?:[-*•·]|[0-9]{1,2}[.、)])\s*", ""))


def safe_filename(x: Column, fallback: str = "upload.bin") -> Column:
    """The last part of a path, unsafe characters as _, 160 characters at most."""
    base = F.regexp_extract(F.regexp_replace(F.translate(_s(x), "\\", "/"), "/+$", ""), "([^/]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, rf"[^A-Za-z0-9._\-{_CJK}]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, 160), F.lit("")), F.lit(fallback))


def is_safe_id(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def is_missing(x: Column) -> Column:
    return strip(x).isin(*L.MISSING_PLACEHOLDERS)


def requirement_id(x: Column) -> Column:
    """req_ and ten hex digits of the SHA-1 of the match form."""
    return F.concat(F.lit("req_"), F.substring(F.sha1(match_form(x)), 1, 10))


# Dates


def _signature(d: Column) -> Column:
    year = F.regexp_extract(d, "((?:19|20)[0-9]{2})", 1)
    month = F.regexp_extract(F.regexp_replace(d, "(?:19|20)[0-9]{2}", ""), "([0-9]{1,2})", 1)
    return F.concat(year, F.lpad(month, 2, "0"))


def date_signatures(x: Column) -> Column:
    """Every date as YYYYMM, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(wide_to_plain(x), F.lit(DATE), F.lit(0)), _signature)


def date_signature_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(date_signatures(x)))


def date_only(x: Column) -> Column:
    """Whether nothing but dates and connecting marks is there."""
    return F.regexp_replace(F.regexp_replace(_s(x), DATE_OR_YEAR, ""), r"(?U)至今|现在|应届|[至到\-—~年月日/.,，。；;()（）\s]", "") == ""


def period_months(x: Column) -> Column:
    """struct(start, end): month ordinals year * 12 + month of a period's ends, null where none; any of the spellings."""
    found = date_signatures(x)
    ordinal = lambda s: F.substring(s, 1, 4).cast("int") * 12 + F.substring(s, 5, 2).cast("int")
    return let(found, lambda d: F.struct(F.when(F.size(d) > 0, ordinal(F.get(d, 0))).alias("start"), F.when(F.size(d) > 1, ordinal(F.get(d, 1))).alias("end")))


def is_open_period(x: Column) -> Column:
    return _s(x).rlike("(?i)至今|目前|现在|present|current|now")


def normal_period(x: Column) -> Column:
    """mm-yyyy - mm-yyyy; one end, or 至今 for an open one, where that is all there is."""
    shown = lambda s: F.concat(F.substring(s, 5, 2), F.lit("-"), F.substring(s, 1, 4))
    opened = _s(x).rlike("(?i)至今|present|now")
    return let(date_signatures(x), lambda d: F.when(F.size(d) == 0, "").when(F.size(d) > 1, F.concat(shown(F.get(d, 0)), F.lit(" - "), shown(F.get(d, 1)))).when(opened, F.concat(shown(F.get(d, 0)), F.lit(" - 至今"))).otherwise(shown(F.get(d, 0))))


def explicit_tenure_months(x: Column) -> Column:
    """Months of a single exact duration; null for ranges, bounds and estimates."""
    t = strip(x)
    vague = t.rlike(r"[0-9]+(?:\.[0-9]+)?\s*[-~—至到]\s*[0-9]+(?:\.[0-9]+)?\s*年|(?:至少|不少于|超过|约|近)\s*[0-9]|以上|左右|余年|年余|\+")
    found = F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?\s*(?:年|个月|月)"), F.lit(0))
    number = lambda f: F.regexp_extract(F.get(f, 0), r"([0-9.]+)", 1).cast("double")
    return let(found, lambda f: F.when(~vague & (F.size(f) == 1), F.bround(number(f) * F.when(F.get(f, 0).contains("年"), 12).otherwise(1)).cast("int")))


# Anchors and grams


def anchors(x: Column) -> Column:
    """Numbers with their units and Latin names, in match form, once each; a list number in front is none."""
    t = F.regexp_replace(_s(x), r"^\s*(?:\(?[0-9]{1,2}[.、．)）]|[一二三四五六七八九十]{1,3}[、.．)）])\s*", "")
    found = F.regexp_extract_all(t, F.lit(rf"(?i)(?<![A-Za-z0-9])[0-9]+(?:\.[0-9]+)?\s*(?:{L.ANCHOR_UNITS})?|[A-Za-z][A-Za-z0-9+.#/_-]+"), F.lit(0))
    plain = lambda a: F.when(a.rlike("^[0-9]{1,2}$"), a.cast("int").cast("string")).otherwise(a)
    return F.array_distinct(F.filter(F.transform(found, lambda a: plain(match_form(a))), lambda a: a != ""))


def metric_anchors(x: Column) -> Column:
    """Numbers with a unit, once each, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_s(x), F.lit(rf"(?i)(?<![A-Za-z0-9])[0-9]+(?:\.[0-9]+)?\s*(?:{L.METRIC_UNITS})"), F.lit(0)), strip))


def unmatched_anchors(claim: Column, source: Column) -> Column:
    """Anchors of the claim that the source lacks; parts of dates that both have are forgiven."""
    dates = lambda x: F.regexp_extract_all(_s(x), F.lit(DATE_OR_YEAR), F.lit(0))
    sign = lambda d: F.concat_ws("-", F.regexp_extract(d, "((?:19|20)[0-9]{2})", 1), F.regexp_extract(F.regexp_replace(d, "(?:19|20)[0-9]{2}", ""), "0?([1-9][0-9]?)", 1))
    year, month = (lambda s: F.substring_index(s, "-", 1)), (lambda s: F.substring_index(s, "-", -1))
    parts = lambda s: F.array(year(s), F.concat(year(s), F.lit("年")), month(s), F.concat(month(s), F.lit("月")), F.lpad(month(s), 2, "0"))
    mine, theirs = F.transform(dates(claim), sign), F.transform(dates(source), sign)
    lost = F.array_except(anchors(claim), anchors(source))
    forgiven = (F.size(mine) > 0) & (F.size(F.array_except(mine, theirs)) == 0)
    return F.array_sort(F.when(forgiven, F.array_except(lost, F.flatten(F.transform(mine, parts)))).otherwise(lost))


def grams(x: Column, n: int = 2, keep_short: bool = False) -> Column:
    """Distinct runs of ``n`` characters; a shorter text gives itself if ``keep_short``, else nothing."""
    short = F.when((x != "") & F.lit(keep_short), F.array(x)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(x) < n, short).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substr(x, i, F.lit(n)))))


def match_bigrams(x: Column) -> Column:
    return let(match_form(x), lambda t: grams(t, 2, True))


def identity_bigrams(x: Column) -> Column:
    return let(identity_form(x), lambda t: grams(t, 2, False))


def covered_share(claim: Column, source: Column) -> Column:
    """The share of the claim's grams (arrays) that the source has: asymmetric, so nothing new passes."""
    return F.size(F.array_intersect(claim, source)) / F.greatest(F.size(claim), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def keywords(x: Column, limit: int = 40) -> Column:
    """Latin words and Han runs of a requirement, stop words out, first spelling of each, ``limit`` at most."""
    found = F.regexp_extract_all(_s(x), F.lit(rf"[A-Za-z][A-Za-z0-9_+./-]{{1,24}}|[{_CJK}]{{2,8}}"), F.lit(0))
    good = F.filter(found, lambda w: ~F.lower(w).isin(*L.KEYWORD_STOPS))
    first = let(good, lambda g: F.filter(g, lambda w, i: F.array_position(F.transform(g, lambda v: F.lower(v)), F.lower(w)) == i + 1))
    return F.slice(first, 1, limit)


# Predicates


def has_metric(x: Column) -> Column:
    return _s(x).rlike(rf"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:{L.SCORE_UNITS}|tb|毫秒|秒|亿|rows|users|requests|rps)") | _s(x).contains("[需补充]")


def metric_strength(x: Column) -> Column:
    """placeholder, strong (compared with before), weak (a bare number with a unit) or none."""
    t = _s(x)
    strong = t.rlike(r"(?i)从\s*[0-9]+(?:\.[0-9]+)?\s*(?:%|ms|s|倍)\s*(?:到|至|降至|升至|提高到|降低到)") | t.rlike(r"(?i)(?:提升|降低|减少|增加|缩短|节省|提高|改善|降至|升至)\s*(?:了|至|到|为)?\s*[0-9]+(?:\.[0-9]+)?\s*(?:%|倍|ms|s|分钟|小时|天|w|万|k|qps|tps)") | t.rlike(r"(?i)(?:increased|decreased|reduced|improved|boosted)\s+(?:by|to)\s+[0-9]+(?:\.[0-9]+)?\s*(?:%|x|ms|s)")
    return F.when(t.contains("[需补充]"), "placeholder").when(strong, "strong").when(has_metric(t), "weak").otherwise("none")


def is_public_url(x: Column) -> Column:
    """http or https, no credentials, port 80, 443 or none, and not a private, loopback or reserved IPv4 host."""
    t = strip(x)
    shape = t.rlike(r"(?i)^https?://[^/?#@\s:]+(?::(?:80|443))?(?:[/?#]|$)")
    host = F.lower(F.regexp_extract(t, r"(?i)^https?://([^/?#:\s]+)", 1))
    private = host.rlike(r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|198\.1[89]\.|192\.0\.[02]\.|22[4-9]\.|2[3-5][0-9]\.)") & host.rlike(r"^[0-9.]+$")
    return shape & ~private & (host != "localhost")


def split_url(x: Column) -> Column:
    """struct(url, rest): a leading URL and what follows it; url null for other text."""
    t = strip(x)
    url = F.regexp_replace(F.regexp_extract(t, r"(?is)^(https?://[^\s，。；;、]+)", 1), r"[),\]}>\"']+$", "")
    rest = strip(F.regexp_replace(F.substr(t, F.length(url) + 1), r"^[ \t\r\n，。；;、:：-]+", ""))
    ok = url.rlike(r"(?i)^https?://[^/?#:\s]")
    return F.struct(F.when(ok, url).alias("url"), F.when(ok, rest).otherwise(t).alias("rest"))


def scan_score(x: Column) -> Column:
    """Quality of scanned text, 0 to 100: share of Han characters, field words, noise."""
    t = _s(x)
    total = F.greatest(F.length(F.translate(t, " \n\t", "")), F.lit(1))
    han = _count(t, rf"[{_CJK}]+") / total
    noise = _count(t, rf"(?U)[^\w\s{_CJK}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}\-./%]+") / total
    fields = sum((F.when(t.contains(w), 1).otherwise(0) for w in L.SCAN_FIELDS), F.lit(0))
    return F.when(han >= 0.3, 40).when(han >= 0.15, 20).otherwise(0) + F.least(F.lit(30), fields * 8) + F.when(noise < 0.1, 30).when(noise < 0.2, 15).otherwise(0)


# Typography and phrases


def plain_phrases(x: Column) -> Column:
    """Inflated phrases by plain words, in the list's order, whatever their case."""
    t = _s(x)
    for old, new in L.PHRASES.items():
        t = F.regexp_replace(t, "(?i)\\Q" + old + "\\E", new)
    return t


def over_generic(x: Column) -> Column:
    """Two general words or more, and neither a metric nor a name."""
    t = _s(x)
    general = sum((F.when(t.contains(w), 1).otherwise(0) for w in L.GENERIC), F.lit(0))
    return (general >= 2) & ~has_metric(t) & ~t.rlike(r"[A-Z][A-Za-z0-9_+./-]+|[A-Za-z][A-Za-z0-9_+./-]{5,}")


def layout_form(x: Column) -> Column:
    """Line ends, blanks and bullets made plain; no blanks between Han characters; date ranges start lines; no empty lines."""
    t = F.regexp_replace(_s(x), "\r\n?", "\n")
    t = F.translate(t, "　 ﻿​", "  ")
    t = F.regexp_replace(t, rf"(?<=[{_CJK}])[ \t]+(?=[{_CJK}])", "")
    t = F.regexp_replace(t, r"[•▪◦●○■□▶►▸▹◆◇\x{f000}-\x{f8ff}]+", "\n- ")
    one = r"(?:19|20)[0-9]{2}[./年][0-9]{1,2}(?:月)?"
    t = F.regexp_replace(t, rf"(?i)(?<!\n)[ \t]*({one}\s*[-–—~至到]+\s*(?:{one}|至今|present))", "\n$1")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda line: compare_form(line)), lambda line: line != ""), "\n")


def skill_name(x: Column) -> Column:
    """Squeezed, no blank between Latin and Han, no grade in brackets at the end."""
    t = F.regexp_replace(compare_form(wide_to_plain(x)), rf"(?<=[A-Za-z0-9])\s+(?=[{_CJK}])", "")
    return strip(F.regexp_replace(t, r"(?i)\s*[（(](?:精通|熟练(?:使用|掌握)?|掌握|熟悉|了解|入门)[）)]$", ""))


def after_thinking(x: Column) -> Column:
    """What follows a closing think tag, blank lines squeezed."""
    return strip(F.regexp_replace(F.regexp_replace(_s(x), r"(?is)^.*?</think>\s*", ""), r"\n{3,}", "\n\n"))


def positively_said(value: Column, text: Column) -> Column:
    """Whether the text says the value, and not only right after a negation."""
    v, t = evidence_form(value), evidence_form(text)
    negated = F.regexp_replace(t, "(?:不要|禁止|不能|避免|不得|并非|没有).{0,8}", "\x00")
    return (v == "") | negated.contains(v)
