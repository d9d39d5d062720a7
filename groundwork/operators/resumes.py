"""Structured records as nested columns: a row is a document, its sections are arrays of structs.

Everything stays within the row: counts, predicates, unions, merges and claims are
functions over arrays, so nothing shuffles but what the caller joins afterwards. Null
sections count as empty ones; columns beyond the schema are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import text as X

_POST = "organization string, role string, period string, bullets array<string>"
SECTIONS = {
    "education": "array<struct<school string, degree string, major string, period string>>",
    "experience": f"array<struct<{_POST}>>",
    "research": "array<struct<institution string, topic string, period string, bullets array<string>>>",
    "activities": f"array<struct<{_POST}>>",
    "projects": f"array<struct<name string, {_POST}>>",
}
LISTS = ("awards", "publications", "patents", "certifications", "training", "teaching")
META = ("name", "phone", "email", "work_experience", "target_role")
SCHEMA = ", ".join(
    ["doc_id long", "meta struct<" + ", ".join(f"{m} string" for m in META) + ">", "summary string", *[f"{k} {v}" for k, v in SECTIONS.items()],
     "skills array<struct<name string, category string>>", *[f"{k} array<string>" for k in LISTS], "additional_sections map<string, array<string>>"]
)
IDENTITY = {"education": ("school",), "experience": ("organization",), "research": ("institution", "topic"), "activities": ("organization",), "projects": ("name",)}
FIELDS = {
    "education": ("school", "degree", "major", "period"), "experience": ("organization", "role", "period"), "research": ("institution", "topic", "period"),
    "activities": ("organization", "role", "period"), "projects": ("name", "organization", "role", "period"),
}
WITH_BULLETS = ("experience", "research", "activities", "projects")
# What stands for a value that nobody filled in.
PLACEHOLDER = r"^\s*(?:待补充|待完善|暂无|无|未知|未提供|N/?A|none|null|unknown|TBD|[xX]{2,}|\[[^\]]*\]|【[^】]*】|<[^>]*>|\{\{[^}]*\}\})\s*$"


def _list(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(kind))


def section(name: str) -> Column:
    kind = SECTIONS.get(name) or ("array<struct<name string, category string>>" if name == "skills" else "array<string>")
    return _list(F.col(name), kind)


def said(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) != ""


def _some(items: Column) -> Column:
    return F.size(items) > 0


def is_empty() -> Column:
    """No name, phone, mail, summary and no section with an entry."""
    return ~(F.exists(F.array(*[F.col(f"meta.{m}") for m in ("name", "phone", "email")], F.col("summary")), said) | _filled())


def has_profile() -> Column:
    """Any fact about the person: as ``is_empty``, but a summary says nothing and a tenure does."""
    return F.exists(F.array(*[F.col(f"meta.{m}") for m in ("name", "phone", "email", "work_experience")]), said) | _filled()


def _filled() -> Column:
    out = has_history() | _some(section("skills"))
    for k in LISTS:
        out = out | _some(section(k))
    return out | F.coalesce(F.size("additional_sections") > 0, F.lit(False))


def has_history() -> Column:
    out = F.lit(False)
    for k in SECTIONS:
        out = out | _some(section(k))
    return out


def bullets_of(record: Column) -> Column:
    return F.filter(_list(record["bullets"], "array<string>"), said)


def n_bullets() -> Column:
    out = F.lit(0)
    for k in WITH_BULLETS:
        out = out + F.aggregate(section(k), F.lit(0), lambda n, r: n + F.size(bullets_of(r)))
    return out


def n_entries(name: str) -> Column:
    """Records with any field said, or texts that are not blank."""
    if name in FIELDS:
        return F.size(F.filter(section(name), lambda r: F.exists(F.array(*[r[f] for f in FIELDS[name]]), said)))
    return F.size(F.filter(section(name), said))


def _record_text(name: str):
    def joined(r: Column) -> Column:
        bullets = [F.array_join(_list(r["bullets"], "array<string>"), "")] if name in WITH_BULLETS else []
        return F.concat_ws("", *[r[f] for f in FIELDS[name]], *bullets)

    return joined


def stats() -> Column:
    """struct of text_len, projects, bullets, publications and education of a row."""
    texts = [F.concat_ws("", *[F.col(f"meta.{m}") for m in META], "summary")]
    texts += [F.array_join(F.transform(section(k), _record_text(k)), "") for k in FIELDS]
    texts += [F.array_join(section(k), "") for k in LISTS]
    return F.struct(F.length(F.concat(*texts)).alias("text_len"), F.size(section("projects")).alias("projects"), n_bullets().alias("bullets"), n_entries("publications").alias("publications"), n_entries("education").alias("education"))


def overview() -> Column:
    """Map of section to its number of entries, empty sections left out."""
    counted = F.map_from_arrays(F.array(*map(F.lit, [*SECTIONS, "skills", *LISTS])), F.array(*[F.size(section(k)) for k in [*SECTIONS, "skills", *LISTS]]))
    return F.map_filter(counted, lambda _, n: n > 0)


def is_internship() -> Column:
    """Any post whose role, organisation or bullets speak of an internship."""
    return F.exists(section("experience"), lambda r: F.lower(F.concat_ws(" ", r["role"], r["organization"], F.array_join(_list(r["bullets"], "array<string>"), " "))).rlike(fields.INTERNSHIP))


def complete(name: str, record: Column, body: str = r"[\p{L}\p{N}]{2}.*[\p{L}\p{N}]{2}") -> Column:
    """Whether a record may be added: dated, with an identity that is no sentence, and with content."""
    names = [record[f] for f in IDENTITY[name]]
    sentence = lambda x: F.coalesce(x, F.lit("")).rlike("[。；;]|[,，].*[,，]")
    dated = F.coalesce(record["period"], F.lit("")).rlike(r"(?:19|20)[0-9]{2}")
    content = said(record["degree"]) | said(record["major"]) if name == "education" else F.exists(bullets_of(record), lambda b: b.rlike(body))
    return dated & F.exists(F.array(*names), said) & ~F.exists(F.array(*names), sentence) & content


def texts_of(value: Column) -> Column:
    """A JSON text, or JSON list of texts nested as deep as one more, to its texts that are not blank."""
    flat = F.from_json(value, "array<string>")
    inner = F.flatten(F.transform(flat, lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array(v))))
    return F.filter(F.transform(F.coalesce(inner, F.array(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")), F.array(value)), F.trim), said)


def _cleaned_record(name: str, clean, lines):
    names, bullets = FIELDS[name], name in WITH_BULLETS

    def record(r: Column) -> Column:
        return F.struct(*[clean(r[f]).alias(f) for f in names], *([lines(r["bullets"]).alias("bullets")] if bullets else []))

    def full(r: Column) -> Column:
        return F.exists(F.array(*[r[f] for f in names]), said) | (_some(r["bullets"]) if bullets else F.lit(False))

    return record, full


def pruned(df: DataFrame) -> DataFrame:
    """Texts trimmed, placeholders blank, repeated and empty entries gone from every section."""
    clean = lambda x: F.when(F.coalesce(x, F.lit("")).rlike(PLACEHOLDER), "").otherwise(F.trim(F.coalesce(x, F.lit(""))))
    out = {"summary": clean(F.col("summary")), "meta": F.struct(*[clean(F.col(f"meta.{m}")).alias(m) for m in META])}
    lines = lambda xs: F.array_distinct(F.filter(F.transform(_list(xs, "array<string>"), clean), said))
    for k in FIELDS:
        record, full = _cleaned_record(k, clean, lines)
        out[k] = F.array_distinct(F.filter(F.transform(section(k), record), full)).cast(SECTIONS[k])
    out["skills"] = F.filter(F.transform(section("skills"), lambda s: F.struct(clean(s["name"]).alias("name"), clean(s["category"]).alias("category"))), lambda s: said(s["name"]))
    out |= {k: lines(F.col(k)) for k in LISTS}
    return df.withColumns(out)


def merged_lists(a: Column, b: Column) -> Column:
    """Union of two text lists by their identity forms, the first of each form in order."""
    both = F.concat(_list(a, "array<string>"), _list(b, "array<string>"))
    forms = F.transform(both, X.identity_form)
    return X.let(F.struct(both.alias("t"), forms.alias("f")), lambda s: F.filter(s["t"], lambda _, i: (F.get(s["f"], i) != "") & (F.array_position(s["f"], F.get(s["f"], i)) == i + 1)))


def merged_drafts(drafts: DataFrame, order: str = "chunk") -> DataFrame:
    """One row a doc_id of its drafts in order: the first said scalar, all entries of the sections.

    A document's drafts, bounded by its chunks, are gathered; documents are not.
    """
    first = lambda x: F.min_by(x, F.when(said(x), F.col(order)))
    every = lambda k: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), section(k).alias("v")))), lambda s: s["v"])).alias(k)
    meta = F.struct(*[F.coalesce(first(F.col(f"meta.{m}")), F.lit("")).alias(m) for m in META]).alias("meta")
    return drafts.groupBy("doc_id").agg(meta, F.coalesce(first(F.col("summary")), F.lit("")).alias("summary"), *[every(k) for k in [*SECTIONS, "skills", *LISTS]])


def merged_posts(name: str = "experience") -> Column:
    """Neighbouring posts of one identity and compatible periods as one, with the union of their bullets."""
    key = lambda r: F.concat_ws("|", X.identity_form(r["organization"]), X.identity_form(r["role"]))
    fits = lambda a, b: ~said(a["period"]) | ~said(b["period"]) | (fields.semantic_form(a["period"]) == fields.semantic_form(b["period"]))

    def joined(a: Column, b: Column) -> Column:
        period = F.when(said(a["period"]), a["period"]).otherwise(b["period"])
        return F.struct(a["organization"].alias("organization"), a["role"].alias("role"), period.alias("period"), merged_lists(a["bullets"], b["bullets"]).alias("bullets"))

    def step(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        same = F.when(F.size(out) > 0, (key(last) == key(r)) & (key(r) != "|") & fits(last, r)).otherwise(F.lit(False))
        head = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(same, F.concat(head, F.array(joined(last, r)).cast(SECTIONS[name]))).otherwise(F.concat(out, F.array(r).cast(SECTIONS[name])))

    return F.aggregate(section(name), F.array().cast(SECTIONS[name]), step)


def valid_projects() -> Column:
    """Projects with a name, the first of each lower-cased one."""
    items = F.filter(section("projects"), lambda p: said(p["name"]))
    names = F.transform(items, lambda p: F.lower(F.trim(p["name"])))
    return X.let(F.struct(items.alias("p"), names.alias("n")), lambda s: F.filter(s["p"], lambda _, i: F.array_position(s["n"], F.get(s["n"], i)) == i + 1))


def skill_items(value: Column) -> Column:
    """A JSON map of category to names, or list of items or names, to (name, category)."""
    kind = "array<struct<name string, category string>>"
    by_kind = F.from_json(value, "map<string, array<string>>")
    flat = F.flatten(F.transform(F.map_entries(by_kind), lambda e: F.transform(e["value"], lambda n: F.struct(n.alias("name"), e["key"].alias("category")))))
    items = F.filter(F.from_json(value, kind), lambda s: s["name"].isNotNull())
    names = F.transform(F.from_json(value, "array<string>"), lambda n: F.struct(n.alias("name"), F.lit("other").alias("category")))
    picked = F.when(F.ltrim(value).startswith("{"), flat).when(F.size(items) > 0, items).otherwise(names)
    return F.filter(F.coalesce(picked.cast(kind), F.array().cast(kind)), lambda s: said(s["name"]))


def _claim(path: Column, name: str, field: str, key: Column, text: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(name).alias("section"), F.lit(field).alias("field"), key.alias("record_key"), text.alias("text"))


def _place(name: str, i: Column) -> Column:
    return F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))


def _section_claims(name: str) -> list[Column]:
    def of_fields(r: Column, i: Column) -> Column:
        return F.array(*[_claim(F.concat(_place(name, i), F.lit(f".{f}")), name, f, _place(name, i), r[f]) for f in FIELDS[name]])

    def of_bullets(r: Column, i: Column) -> Column:
        return F.transform(_list(r["bullets"], "array<string>"), lambda b, j: _claim(F.concat(_place(name, i), F.lit("."), _place("bullets", j)), name, "bullets", _place(name, i), b))

    return [F.flatten(F.transform(section(name), of)) for of in ([of_fields, of_bullets] if name in WITH_BULLETS else [of_fields])]


def _list_claims(name: str, field: str, text) -> Column:
    return F.transform(section(name), lambda x, i: _claim(_place(name, i), name, field, F.lit(name), text(x)))


def claims(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, path, section, field, record_key, text): everything a record says, one row each, blank values left out."""
    every = [F.array(*[_claim(F.lit(f"meta.{m}"), "meta", m, F.lit("meta"), F.col(f"meta.{m}")) for m in META], _claim(F.lit("summary"), "summary", "summary", F.lit("summary"), F.col("summary")))]
    every += [c for k in FIELDS for c in _section_claims(k)]
    every += [_list_claims("skills", "name", lambda s: s["name"]), *[_list_claims(k, k, lambda x: x) for k in LISTS]]
    rows = df.select(id_col, F.explode(F.concat(*every)).alias("__c")).select(id_col, "__c.*")
    return rows.where(said(F.col("text"))).withColumn("text", F.trim("text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, slot, form): the distinct claims by slot and identity form; a summary is drawn from the others and is none."""
    c = claims(df, id_col).where("section <> 'summary'")
    return c.select(id_col, F.concat_ws(".", "section", "field").alias("slot"), X.identity_form(F.col("text")).alias("form")).where("form <> ''").distinct()


def preserved(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, preserved): whether each claim of before is contained in one of the same slot after."""
    a = fingerprints(after, id_col).groupBy(id_col, "slot").agg(F.collect_set("form").alias("now"))
    j = fingerprints(before, id_col).join(a, [id_col, "slot"], "left")
    held = F.coalesce(F.exists("now", lambda n: n.contains(F.col("form"))), F.lit(False))
    return j.groupBy(id_col).agg(F.bool_and(held).alias("preserved"))


def bullet_places(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, section, record, bullet, text), places from one."""
    c = claims(df, id_col).where("field = 'bullets'")
    place = lambda n: F.get(F.regexp_extract_all("path", F.lit(r"\[([0-9]+)\]"), F.lit(1)), n).cast("int") + 1
    return c.select(id_col, "section", place(0).alias("record"), place(1).alias("bullet"), "text")


def resolved_target(df: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """targets (id, section, record, bullet) with the text at their place and ``status``: found, missing."""
    keys = [id_col, "section", "record", "bullet"]
    return targets.join(bullet_places(df, id_col), keys, "left").withColumn("status", F.when(F.col("text").isNull(), "missing").otherwise("found"))


def atomised(name: str) -> Column:
    """A section with its bullets cut into sentences, each form once a record, and ``sources``: each sentence's first bullet."""

    def cut(r: Column) -> Column:
        parts = F.flatten(F.transform(_list(r["bullets"], "array<string>"), lambda b, i: F.transform(fields.sentences_of(b), lambda s: F.struct(s.alias("text"), i.alias("source")))))
        forms = F.transform(parts, lambda p: X.identity_form(p["text"]))
        return X.let(F.struct(parts.alias("p"), forms.alias("f")), lambda s: F.filter(s["p"], lambda _, i: F.array_position(s["f"], F.get(s["f"], i)) == i + 1))

    names = FIELDS[name]
    return F.transform(section(name), lambda r: X.let(cut(r), lambda ps: F.struct(*[r[f].alias(f) for f in names], F.transform(ps, lambda p: p["text"]).alias("bullets"), F.transform(ps, lambda p: p["source"]).alias("sources"))))


def flat_view() -> Column:
    """The record as renderers take it: company for organisation, research and activities among the posts."""
    post = lambda kind: lambda r: F.struct(r["organization"].alias("company"), r["role"].alias("role"), r["period"].alias("period"), bullets_of(r).alias("bullets"), F.lit(kind).alias("kind"))
    study = lambda r: F.struct(r["institution"].alias("company"), r["topic"].alias("role"), r["period"].alias("period"), bullets_of(r).alias("bullets"), F.lit("research").alias("kind"))
    posts = F.concat(F.transform(section("experience"), post("work")), F.transform(section("research"), study), F.transform(section("activities"), post("activity")))
    return F.struct(*[F.col(f"meta.{m}").alias(m) for m in META], F.col("summary").alias("summary"), posts.alias("experience"), section("projects").alias("projects"), section("education").alias("education"), F.transform(section("skills"), lambda s: s["name"]).alias("skills"))


def from_flat_view(df: DataFrame, view: str) -> DataFrame:
    """The inverse of ``flat_view``: posts go back to their sections."""
    at = lambda kind: F.filter(F.col(f"{view}.experience"), lambda r: r["kind"] == kind)
    post = lambda r: F.struct(r["company"].alias("organization"), r["role"].alias("role"), r["period"].alias("period"), r["bullets"].alias("bullets"))
    study = lambda r: F.struct(r["company"].alias("institution"), r["role"].alias("topic"), r["period"].alias("period"), r["bullets"].alias("bullets"))
    skills = F.transform(F.col(f"{view}.skills"), lambda n: F.struct(n.alias("name"), F.lit("other").alias("category")))
    return df.withColumns({
        "meta": F.struct(*[F.col(f"{view}.{m}").alias(m) for m in META]), "summary": F.col(f"{view}.summary"), "experience": F.transform(at("work"), post), "research": F.transform(at("research"), study),
        "activities": F.transform(at("activity"), post), "projects": F.col(f"{view}.projects"), "education": F.col(f"{view}.education"), "skills": skills,
    }).drop(view)
