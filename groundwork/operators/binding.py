"""Claims bound to the blocks of their own document, with provenance; owners, scopes, atoms and recovery.

Claims and blocks of a document meet on the character pairs that they share: overlaps
are counted by an equi-join and a grouping, so a document's claims and blocks are never
all paired, and a document of many blocks is spread over its pairs' hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields, lexicons as L
from ..functions import text as X

# The least similarity by kind of claim, and of clauses of a compound claim.
LEAST = {"meta": 0.80, "skills": 0.80, "awards": 0.80, "summary": 0.68, "identity": 0.65, "list": 0.65, "bullets": 0.22}
CLAUSE, FUZZY_CLAUSE = 0.58, 0.78
# Points of joint ownership, its gate, margin, and what a second choice may lose.
PERIOD, PRIMARY, SECONDARY, EXACT_BULLET, NEAR_BULLET = 16, 10, 4, 8, 3
GATE, MARGIN, LOSS, BODY_RECALL = 8, 4, 2, 0.72
# Facts that support an atom lie this near its best, and not below.
NEAR_BEST, LEAST_SUPPORT, ANCHOR_FACTOR = 0.12, 0.55, 0.45
DIRECT_SIMILARITY, TRUSTED_SIMILARITY, TRUSTED_PRECISION = 0.90, 0.75, 0.55


def overlaps(claims: DataFrame, blocks: DataFrame, bundle: str = "doc_id", claim: str = "claim_id", block: str = "block_id", grams=X.identity_bigrams) -> DataFrame:
    """(bundle, claim, block, share): the share of a claim's pairs of characters that a block has; only where some are shared.

    A claim of one character has no pair and overlaps nothing; repeated rows of a claim count once.
    """
    c = claims.select(bundle, claim, grams(F.col("text")).alias("g")).dropDuplicates([bundle, claim])
    c = c.select(bundle, claim, F.size("g").alias("total"), F.explode("g").alias("gram"))
    b = blocks.select(bundle, block, F.explode(grams(F.col("text"))).alias("gram")).distinct()
    return c.join(b, [bundle, "gram"]).groupBy(bundle, claim, block).agg((F.count("*") / F.max("total")).alias("share"))


def scored(claims: DataFrame, blocks: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """Every claim (bundle, claim_id, text) with each block (bundle, block_id, pos, text) that shares pairs with it or holds its dates.

    ``tier``: 0 same form, 1 contained, 2 the same run of dates, 3 by share; ``mode``: direct, normalized, rewritten.
    """
    dated = lambda x: F.array_join(X.date_signatures(x), ",")
    found = overlaps(claims, blocks, bundle)
    runs = lambda df, key: df.select(bundle, key, F.explode(X.date_signature_set(F.col("text"))).alias("d"))
    days = runs(claims, "claim_id").join(runs(blocks, "block_id"), [bundle, "d"]).select(bundle, "claim_id", "block_id").distinct()
    pairs = found.join(days, [bundle, "claim_id", "block_id"], "full").withColumn("share", F.coalesce("share", F.lit(0.0)))
    c = claims.select(bundle, "claim_id", F.col("text").alias("claim")).dropDuplicates([bundle, "claim_id"])
    j = pairs.join(c, [bundle, "claim_id"]).join(blocks.select(bundle, "block_id", "pos", "text"), [bundle, "block_id"])
    a, b = X.identity_form(F.col("claim")), X.identity_form(F.col("text"))
    run = (dated(F.col("claim")) != "") & F.concat(F.lit(","), dated(F.col("text")), F.lit(",")).contains(F.concat(F.lit(","), dated(F.col("claim")), F.lit(",")))
    tier = F.when(a == b, 0).when(b.contains(a) & (a != ""), 1).when(run, 2).otherwise(3)
    j = j.withColumn("tier", tier).withColumn("similarity", F.when(F.col("tier") < 3, 1.0).otherwise(F.col("share"))).where("similarity > 0")
    raw = F.lower("text").contains(F.lower("claim"))
    mode = F.when((F.col("tier") <= 1) & raw, "direct").when(F.col("tier") <= 2, "normalized").otherwise("rewritten")
    return j.withColumn("mode", mode).select(bundle, "claim_id", "block_id", "pos", "tier", "similarity", "mode")


def bound(claims: DataFrame, blocks: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """claims (bundle, claim_id, text, kind) to their binding: block_id, similarity, mode, and ``block_ids``, all blocks that bear it.

    The best block by tier, similarity, place; a binding below its kind's least similarity
    is none, and the claim is left out. Provenance: blocks of the best tier that reach
    the least similarity too, in order.
    """
    least = F.lit(LEAST["bullets"])
    for k, v in LEAST.items():
        least = F.when(F.col("kind") == k, v).otherwise(least)
    s = scored(claims, blocks, bundle).join(claims.select(bundle, "claim_id", "kind").dropDuplicates([bundle, "claim_id"]), [bundle, "claim_id"])
    s = s.where(F.col("similarity") >= least)
    best = F.min(F.struct("tier", (-F.col("similarity")).alias("s"), "pos", "block_id", "mode")).alias("b")
    top = s.groupBy(bundle, "claim_id").agg(best)
    same = s.join(top, [bundle, "claim_id"]).where("tier = b.tier and (tier < 3 or similarity >= -b.s - 1e-9)")
    ids = same.groupBy(bundle, "claim_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "block_id"))), lambda x: x["block_id"]).alias("block_ids"))
    return top.join(ids, [bundle, "claim_id"]).select(bundle, "claim_id", F.col("b.block_id").alias("block_id"), (-F.col("b.s")).alias("similarity"), F.col("b.mode").alias("mode"), "block_ids")


def compound_bound(claims: DataFrame, blocks: DataFrame, bundle: str = "doc_id", least: float = LEAST["bullets"]) -> DataFrame:
    """Claims of several clauses that each have a block: (bundle, claim_id, block_ids, similarity, mode).

    A clause counts from max(CLAUSE, least); the claim is rewritten if any clause is only
    near. Similarity is the least of its clauses'.
    """
    parts = claims.select(bundle, "claim_id", F.posexplode(fields.clauses(F.col("text"))).alias("n", "text")).dropDuplicates([bundle, "claim_id", "n"])
    many = parts.groupBy(bundle, "claim_id").agg(F.count("*").alias("clauses")).where("clauses > 1")
    named = parts.withColumn("whole", F.col("claim_id").cast("string")).withColumn("claim_id", F.concat_ws("\x1f", "whole", "n"))
    s = scored(named.select(bundle, "claim_id", "text"), blocks, bundle).where(F.col("similarity") >= max(CLAUSE, least))
    best = s.groupBy(bundle, "claim_id").agg(F.min(F.struct("tier", (-F.col("similarity")).alias("s"), "pos", "block_id")).alias("b"))
    rows = best.join(named.select(bundle, "claim_id", "whole"), [bundle, "claim_id"]).groupBy(bundle, "whole")
    out = rows.agg(F.count("*").alias("held"), F.array_sort(F.collect_set("b.block_id")).alias("block_ids"), F.min(-F.col("b.s")).alias("similarity"), F.max((-F.col("b.s") < FUZZY_CLAUSE).cast("int")).alias("near"))
    out = out.join(many.withColumn("whole", F.col("claim_id").cast("string")), [bundle, "whole"]).where("held = clauses")
    return out.select(bundle, "claim_id", "block_ids", "similarity", F.when(F.col("near") == 1, "rewritten").otherwise("normalized").alias("mode"))


def expanded_provenance(bindings: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """(bundle, claim_id, block_id, mode) of every block that bears a claim."""
    return bindings.select(bundle, "claim_id", F.explode("block_ids").alias("block_id"), "mode").distinct()


def facts_of(bindings: DataFrame, facts: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """(bundle, claim_id, fact_id): the facts (bundle, fact_id, block_id) of the blocks that bear each claim."""
    return expanded_provenance(bindings, bundle).join(facts.select(bundle, "block_id", "fact_id"), [bundle, "block_id"]).select(bundle, "claim_id", "fact_id").distinct()


def joint_owners(votes: DataFrame, record: str = "record_id", owner: str = "owner", bundle: str = "doc_id") -> DataFrame:
    """(bundle, record, owner, score): output records to the source records that own them, no source record twice.

    ``votes`` (bundle, record, owner, period, primary, secondary: boolean or null if
    nothing is said; exact, near: numbers of bullets; conflict). Points are summed up; a
    record needs an anchor, GATE points, and MARGIN points before its second choice.
    Then the sure ones choose first; who finds its owner taken takes its next one at a
    loss of LOSS points at most. Records of one document are dealt in one task, documents
    are spread.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    score = PERIOD * yes("period") + PRIMARY * yes("primary") + SECONDARY * yes("secondary") + EXACT_BULLET * F.col("exact") + NEAR_BULLET * F.col("near")
    anchors = 2 * yes("period") + yes("primary") + F.least(F.col("exact"), F.lit(1))
    v = votes.withColumn("score", score.cast("long")).withColumn("anchors", anchors.cast("long")).where(F.col("anchors").between(1, 1 << 30) & (F.col("score") >= GATE) & ~F.coalesce("conflict", F.lit(False)))
    w = Window.partitionBy(bundle, record).orderBy(F.col("score").desc(), owner)
    v = v.withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0))).withColumn("n", F.row_number().over(w)).withColumn("best", F.first("score").over(w))
    first = v.where("n = 1").select(bundle, record, (F.col("score") - F.col("second")).alias("margin"))
    v = v.join(first.where(F.col("margin") >= MARGIN), [bundle, record])
    rows = v.groupBy(bundle).agg(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("a"), (-F.col("margin")).alias("b"), (-F.col("anchors")).alias("c"), F.col(record).alias("record"), F.col("n"), F.col(owner).alias("owner"), "score", "best", "second"))).alias("v"))
    start = F.struct(F.array().cast("array<struct<record:string,owner:string,score:long>>").alias("got"))

    def deal(acc, x):
        taken = F.exists(acc["got"], lambda g: (g["owner"] == x["owner"].cast("string")) | (g["record"] == x["record"].cast("string")))
        fits = (x["n"] == 1) | ((x["best"] - x["score"] <= LOSS) & (x["score"] - x["second"] >= MARGIN))
        one = F.array(F.struct(x["record"].cast("string").alias("record"), x["owner"].cast("string").alias("owner"), x["score"].alias("score")))
        return F.struct(F.when(~taken & fits, F.concat(acc["got"], one)).otherwise(acc["got"]).alias("got"))

    dealt = rows.select(bundle, F.explode(F.aggregate("v", start, deal)["got"]).alias("g"))
    kinds = dict(votes.dtypes)
    return dealt.select(bundle, F.col("g.record").cast(kinds[record]).alias(record), F.col("g.owner").cast(kinds[owner]).alias(owner), "g.score")


def atoms_judged(atoms: DataFrame, facts: DataFrame, bindings: DataFrame | None = None, bundle: str = "doc_id") -> DataFrame:
    """atoms (bundle, atom_id, text, trusted) judged by facts (bundle, fact_id, text): status, reason, score, ``selected`` facts.

    Contained in a fact, or a subset of its dates: supported outright. An anchor that no
    fact of the document has vetoes. A binding (bundle, claim_id = atom_id, mode,
    similarity) that is direct enough, or the share of the atom's pairs that the facts
    have, supports; trusted rewrites need less. Selected: the facts within NEAR_BEST of
    the best share, a fact that lacks one of the atom's anchors at ANCHOR_FACTOR.
    """
    kept = atoms.withColumn("trusted", F.coalesce(F.col("trusted"), F.lit(False))) if "trusted" in atoms.columns else atoms.withColumn("trusted", F.lit(False))
    grams = X.match_bigrams
    pairs = overlaps(kept.withColumnRenamed("atom_id", "claim_id"), facts.withColumnRenamed("fact_id", "block_id"), bundle, grams=grams)
    j = pairs.join(kept.select(bundle, F.col("atom_id").alias("claim_id"), F.col("text").alias("atom")), [bundle, "claim_id"]).join(facts.select(bundle, F.col("fact_id").alias("block_id"), F.col("text").alias("fact")), [bundle, "block_id"])
    lacks = F.size(X.unmatched_anchors(F.col("atom"), F.col("fact"))) > 0
    j = j.withColumn("rank", F.when(lacks, F.col("share") * ANCHOR_FACTOR).otherwise(F.col("share"))).withColumn("direct", X.match_form(F.col("fact")).contains(X.match_form(F.col("atom"))))
    top = j.groupBy(bundle, "claim_id").agg(F.max("rank").alias("best"), F.bool_or("direct").alias("direct"))
    near = j.join(top.select(bundle, "claim_id", "best"), [bundle, "claim_id"]).where((F.col("rank") >= F.greatest(F.lit(LEAST_SUPPORT), F.col("best") - NEAR_BEST)))
    selected = near.groupBy(bundle, "claim_id").agg(F.array_sort(F.collect_set("block_id")).alias("selected"))
    # What the document's facts say together: anchors, dates and pairs, each once.
    gathered = facts.select(bundle, F.explode(grams(F.col("text"))).alias("gram")).distinct()
    share = kept.select(bundle, "atom_id", F.size(grams(F.col("text"))).alias("total"), F.explode(grams(F.col("text"))).alias("gram")).join(gathered, [bundle, "gram"]).groupBy(bundle, "atom_id").agg((F.count("*") / F.max("total")).alias("precision"))
    anchors = lambda df, key: df.select(bundle, *key, F.explode(X.anchors(F.col("text"))).alias("a")).distinct()
    new = anchors(kept, ["atom_id"]).join(anchors(facts, []), [bundle, "a"], "left_anti").groupBy(bundle, "atom_id").agg(F.array_sort(F.collect_set("a")).alias("unmatched"))
    dates = lambda df, key: df.select(bundle, *key, F.explode(X.date_signatures(F.col("text"))).alias("d")).distinct()
    alien = dates(kept, ["atom_id"]).join(dates(facts, []), [bundle, "d"], "left_anti").select(bundle, "atom_id", F.lit(True).alias("alien")).distinct()
    out = kept.join(share, [bundle, "atom_id"], "left").join(new, [bundle, "atom_id"], "left").join(alien, [bundle, "atom_id"], "left")
    out = out.join(top.withColumnRenamed("claim_id", "atom_id"), [bundle, "atom_id"], "left").join(selected.withColumnRenamed("claim_id", "atom_id"), [bundle, "atom_id"], "left")
    some = facts.select(bundle).distinct().withColumn("has_facts", F.lit(True))
    out = out.join(some, bundle, "left")
    if bindings is None:
        out = out.withColumn("mode", F.lit(None).cast("string")).withColumn("similarity", F.lit(None).cast("double"))
    else:
        out = out.join(bindings.select(bundle, F.col("claim_id").alias("atom_id"), "mode", "similarity"), [bundle, "atom_id"], "left")
    same_dates = F.col("alien").isNull() & (F.size(X.date_signatures(F.col("text"))) > 0)
    told = F.coalesce(F.col("precision"), F.lit(0.0))
    by_binding = (F.col("mode").isin("direct", "normalized") & (F.col("similarity") >= DIRECT_SIMILARITY)) | (F.col("trusted") & (F.col("similarity") >= TRUSTED_SIMILARITY))
    reason = F.when(F.col("has_facts").isNull(), "no_candidate_fact").when(F.coalesce("direct", F.lit(False)), "direct_source").when(X.date_only(F.col("text")) & same_dates, "equivalent_date_format")
    reason = reason.when((F.size(F.coalesce("unmatched", F.array().cast("array<string>"))) > 0) & ~same_dates, "new_hard_anchor").when(F.coalesce(by_binding, F.lit(False)), "verified_binding")
    reason = reason.when(told >= F.when(F.col("trusted"), TRUSTED_PRECISION).otherwise(L.ATOM_PRECISION), "lexical_entailment").otherwise("insufficient_source_overlap")
    good = F.col("reason").isin("direct_source", "equivalent_date_format", "verified_binding", "lexical_entailment")
    none = F.array().cast("array<string>")
    out = out.withColumn("reason", reason)
    return out.select(bundle, "atom_id", F.when(good, "supported").otherwise("unsupported").alias("status"), F.round(F.when(F.col("reason").isin("direct_source", "equivalent_date_format"), 1.0).otherwise(told), 4).alias("score"), "reason", F.coalesce("unmatched", none).alias("unmatched"), F.coalesce(F.col("selected").cast("array<string>"), none).alias("selected"))


def audit(judged: DataFrame, represented: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """(bundle, precision, recall): supported atoms of all, represented facts (bundle, represented) of all; one where there is none."""
    p = judged.groupBy(bundle).agg(F.avg((F.col("status") == "supported").cast("int")).alias("precision"))
    r = represented.groupBy(bundle).agg(F.avg(F.col("represented").cast("int")).alias("recall"))
    both = p.join(r, bundle, "full")
    return both.select(bundle, F.round(F.coalesce("precision", F.lit(1.0)), 4).alias("precision"), F.round(F.coalesce("recall", F.lit(1.0)), 4).alias("recall"))


def recovered(missing: DataFrame, owners: DataFrame, bullets: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """Missing units (bundle, unit_id, source_record, text) to what restores them: (bundle, unit_id, record_id, action, bullet, text).

    Only units whose source record owns exactly one output record are restored. A bullet
    (bundle, record_id, bullet, text) that the unit begins with, of six characters or
    more by form, is expanded in place, the first of several; else the unit is appended.
    """
    one = owners.groupBy(bundle, F.col("owner").alias("source_record")).agg(F.count_distinct("record_id").alias("n"), F.min("record_id").alias("record_id")).where("n = 1").drop("n")
    j = missing.join(one, [bundle, "source_record"]).withColumn("u", X.identity_form(F.col("text")))
    b = bullets.select(bundle, "record_id", F.col("bullet"), X.identity_form(F.col("text")).alias("b")).where(F.length("b") >= 6)
    # A bullet that begins a unit shares its first six characters with it.
    j = j.withColumn("head", F.substring("u", 1, 6))
    hit = j.join(b.withColumn("head", F.substring("b", 1, 6)), [bundle, "record_id", "head"], "left").withColumn("fits", F.col("u").startswith(F.col("b")) & (F.col("u") != F.col("b")))
    got = hit.groupBy(bundle, "unit_id", "record_id", "text").agg(F.min(F.when(F.col("fits"), F.col("bullet"))).alias("bullet"))
    return got.select(bundle, "unit_id", "record_id", F.when(F.col("bullet").isNull(), "append").otherwise("expand").alias("action"), "bullet", "text")


def unique_source(values: DataFrame, sentences: DataFrame, bundle: str = "doc_id", least: float = 0.42, margin: float = 0.05) -> DataFrame:
    """(bundle, claim_id, sentence_id, share): the sentence that stands in for a claim, if it covers enough and no second one is near it."""
    s = overlaps(values, sentences.withColumnRenamed("sentence_id", "block_id"), bundle)
    w = Window.partitionBy(bundle, "claim_id").orderBy(F.col("share").desc(), "block_id")
    s = s.withColumn("n", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("share").over(w), F.lit(0.0)))
    return s.where((F.col("n") == 1) & (F.col("share") >= least) & (F.col("share") - F.col("next") >= margin)).select(bundle, "claim_id", F.col("block_id").alias("sentence_id"), "share")


def grounded(values: DataFrame, sentences: DataFrame, bundle: str = "doc_id", keep: float = 0.58, restore: float = 0.18, recall: float = 0.45) -> DataFrame:
    """Bullets (bundle, claim_id, text) by what their closest sentence (bundle, sentence_id, text) covers: kept, restored to it, or dropped."""
    s = overlaps(values, sentences.withColumnRenamed("sentence_id", "block_id"), bundle)
    w = Window.partitionBy(bundle, "claim_id").orderBy(F.col("share").desc(), "block_id")
    best = s.withColumn("n", F.row_number().over(w)).where("n = 1").select(bundle, "claim_id", "share", "block_id")
    j = values.join(best, [bundle, "claim_id"], "left").join(sentences.select(bundle, F.col("sentence_id").alias("block_id"), F.col("text").alias("source")), [bundle, "block_id"], "left")
    back = X.covered_share(X.identity_bigrams(F.col("source")), X.identity_bigrams(F.col("text")))
    new = F.size(X.unmatched_anchors(F.col("text"), F.coalesce("source", F.lit("")))) > 0
    share = F.coalesce(F.col("share"), F.lit(0.0))
    status = F.when((share >= keep) & ~new, "kept").when((share >= restore) & (back >= recall), "restored").otherwise("dropped")
    j = j.withColumn("status", status)
    return j.select(bundle, "claim_id", "status", F.when(F.col("status") == "kept", F.col("text")).when(F.col("status") == "restored", F.col("source")).alias("text"))
