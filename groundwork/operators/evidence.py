"""Claims joined to the texts that support them, and what is left without support.

Across a corpus the candidates come from an equi-join on word shingles, never from all
pairs: a claim meets only documents that share a shingle with it. Inside one bundle,
the tiers exact, contained, dates and bigrams are tried in order, and a lower tier
never competes with a higher one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X

#: Words of a shingle across the corpus.
SHINGLE = 5


def plain_words(x: Column) -> Column:
    """Lower-case ASCII letters and digits as words."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(x: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of ``n`` words; fewer words give one shingle of them all, none nothing."""

    def made(w: Column) -> Column:
        long = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= n, long).otherwise(short)

    return X.let(plain_words(x), made)


def corpus_overlap(claims: DataFrame, docs: DataFrame, claim_id: str, doc_id: str = "doc_id", n: int = SHINGLE) -> DataFrame:
    """(claim, doc_id, shared, total): shingles that a claim shares with a document.

    An equi-join on the shingle: what is grouped is bounded by the matches, not by the corpus.
    """
    c = claims.select(claim_id, shingles(F.col("text"), n).alias("s")).select(claim_id, F.size("s").cast("long").alias("total"), F.explode("s").alias("gram"))
    d = docs.select(doc_id, F.explode(shingles(F.col("text"), n)).alias("gram"))
    return d.join(c, "gram").groupBy(claim_id, doc_id).agg(F.count("*").alias("shared"), F.max("total").alias("total"))


def best_document(overlap: DataFrame, claim_id: str, doc_id: str = "doc_id", least: float = L.BIND_DEFAULT) -> DataFrame:
    """The document that covers most of each claim, the smaller id among equals, if it covers enough."""
    w = Window.partitionBy(claim_id).orderBy(F.col("shared").desc(), doc_id)
    best = overlap.where(F.col("shared") / F.col("total") >= least).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return best.select(claim_id, doc_id, "shared", "total")


def containing(claims: DataFrame, docs: DataFrame, claim_id: str, doc_id: str = "doc_id", n: int = SHINGLE) -> DataFrame:
    """(claim, doc_id) where the document's word text holds the claim's whole word text.

    A claim meets the documents that have its first ``n`` words as a shingle; a shorter
    one those that have it as a shingle of its own length. Shingles travel as hashes, and
    the texts of documents that met a claim are compared. A claim without words is in none.
    """
    full = lambda x: F.concat(F.lit(" "), F.array_join(plain_words(x), " "), F.lit(" "))
    words = plain_words(F.col("text"))
    c = claims.select(claim_id, full(F.col("text")).alias("claim"), F.least(F.size(words), F.lit(n)).alias("k"), F.xxhash64(F.array_join(F.slice(words, 1, n), " ")).alias("gram")).where("k > 0")
    hashed = lambda k: F.transform(shingles(F.col("text"), k), lambda g: F.xxhash64(g))
    lengths = sorted(r["k"] for r in c.select("k").distinct().collect())  # at most n
    d = None
    for k in lengths or [n]:
        rows = docs.select(doc_id, F.lit(k).alias("k"), F.explode(hashed(k)).alias("gram"))
        d = rows if d is None else d.union(rows)
    hit = d.join(c.select("k", "gram").distinct(), ["k", "gram"], "left_semi").distinct().join(c, ["k", "gram"])
    return hit.join(docs.select(doc_id, full(F.col("text")).alias("doc")), doc_id).where(F.col("doc").contains(F.col("claim"))).select(claim_id, doc_id).distinct()


def ladder(claims: DataFrame, blocks: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """Within each bundle: claims (bundle, claim_id, claim) to their best block (bundle, block_id, pos, text).

    Gives claim_id, block_id, similarity and mode: exact form, then containment, then
    the same run of dates, then the largest share of the claim's bigrams; the first
    block wins ties. mode is direct, normalized or rewritten. A claim without letters
    binds to nothing.
    """
    c = claims.withColumn("__c", X.identity_form(F.col("claim"))).where("__c <> ''")
    b = blocks.withColumn("__b", X.identity_form(F.col("text")))
    pair = c.join(b, bundle)
    dates = F.array_join(X.date_signatures(F.col("claim")), ",")
    run = (dates != "") & F.concat(F.lit(","), F.array_join(X.date_signatures(F.col("text")), ","), F.lit(",")).contains(F.concat(F.lit(","), dates, F.lit(",")))
    share = X.covered_share(X.identity_bigrams(F.col("claim")), X.identity_bigrams(F.col("text")))
    tier = F.when(F.col("__c") == F.col("__b"), 0).when(F.col("__b").contains(F.col("__c")), 1).when(run, 2).otherwise(3)
    same = F.lower("text").contains(F.lower("claim"))
    mode = F.when((F.col("tier") <= 1) & same, "direct").when(F.col("tier") <= 2, "normalized").otherwise("rewritten")
    scored = pair.withColumn("tier", tier).withColumn("similarity", F.when(F.col("tier") < 3, 1.0).otherwise(share)).withColumn("mode", mode)
    w = Window.partitionBy(bundle, "claim_id").orderBy("tier", F.col("similarity").desc(), "pos")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1 and similarity > 0").select(bundle, "claim_id", "block_id", "similarity", "mode")


def coverage(units: DataFrame, bound: DataFrame, bundle: str = "doc_id", recall: float = L.UNIT_RECALL) -> DataFrame:
    """units (bundle, unit_id, block_id, text) with ``represented`` by the claims bound to their block (bundle, block_id, claim).

    A claim represents a unit that it contains, or whose anchors it has and of whose
    bigrams it covers ``recall``.
    """
    joined = units.join(bound.select(bundle, "block_id", "claim"), [bundle, "block_id"], "left")
    u, c = X.identity_form(F.col("text")), X.identity_form(F.coalesce(F.col("claim"), F.lit("")))
    kept = F.size(F.array_except(X.anchors(F.col("text")), X.anchors(F.col("claim")))) == 0
    enough = X.covered_share(X.identity_bigrams(F.col("text")), X.identity_bigrams(F.col("claim"))) >= recall
    hit = F.col("claim").isNotNull() & (c.contains(u) | (kept & enough))
    return joined.groupBy(bundle, "unit_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("represented"))


def coverage_ratio(represented: DataFrame, bundle: str = "doc_id") -> DataFrame:
    return represented.groupBy(bundle).agg(F.bround(F.avg(F.col("represented").cast("int")), 4).alias("coverage"), F.count(F.when(~F.col("represented"), 1)).alias("missing"))


def atom_matches(atoms: DataFrame, facts: DataFrame, bundle: str = "doc_id") -> DataFrame:
    """atoms (bundle, atom_id, text) judged against all facts (bundle, pos, text) of their bundle.

    status and reason: an anchor that no fact has vetoes; contained text or a subset of
    dates supports; else the share of the atom's bigrams that the facts have decides.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    source = facts.groupBy(bundle).agg(F.array_join(ordered, "；").alias("source"))
    j = atoms.join(source, bundle, "left").withColumn("unmatched", X.unmatched_anchors(F.col("text"), F.col("source")))
    value = X.match_form(F.col("text"))
    direct = (value != "") & X.match_form(F.col("source")).contains(value)
    dated = X.date_only(F.col("text")) & (F.size(X.date_signatures(F.col("text"))) > 0) & (F.size(F.array_except(X.date_signatures(F.col("text")), X.date_signatures(F.col("source")))) == 0)
    precision = X.covered_share(X.match_bigrams(F.col("text")), X.match_bigrams(F.col("source")))
    reason = F.when(F.col("source").isNull(), "no_candidate_fact").when(F.size("unmatched") > 0, "new_hard_anchor").when(direct, "direct_source").when(dated, "equivalent_date_format").when(precision >= L.ATOM_PRECISION, "lexical_entailment").otherwise("insufficient_source_overlap")
    score = F.when(F.col("reason").isin("no_candidate_fact", "new_hard_anchor"), 0.0).when(F.col("reason").isin("direct_source", "equivalent_date_format"), 1.0).otherwise(F.bround(precision, 4))
    good = F.col("reason").isin("direct_source", "equivalent_date_format", "lexical_entailment")
    return j.withColumn("reason", reason).select(bundle, "atom_id", F.when(good, "supported").otherwise("unsupported").alias("status"), score.alias("score"), "reason", "unmatched")


def record_owner(votes: DataFrame, record: str = "record_id", owner: str = "owner") -> DataFrame:
    """(record, owner) of the unique largest sum of ``weight``; records with a tie have no owner."""
    total = votes.groupBy(record, owner).agg(F.sum("weight").alias("score"))
    w = Window.partitionBy(record)
    top = total.withColumn("__best", F.max("score").over(w)).where("score = __best").withColumn("__ties", F.count("*").over(w))
    return top.where("__ties = 1").select(record, owner, "score")


def possible_scopes(fields: DataFrame, record: str = "record_id", scope: str = "scope") -> DataFrame:
    """Relational division: scopes that occur for every field of a record (record, field, scope)."""
    need = fields.select(record, "field").distinct().groupBy(record).agg(F.count("*").alias("__need"))
    have = fields.select(record, "field", scope).distinct().groupBy(record, scope).agg(F.count("*").alias("__have"))
    return have.join(need, record).where("__have = __need").select(record, scope)


def incoherent(fields: DataFrame, record: str = "record_id", scope: str = "scope") -> DataFrame:
    """Records with two fields or more, and no scope common to them all."""
    many = fields.select(record, "field").distinct().groupBy(record).agg(F.count("*").alias("n")).where("n >= 2").select(record)
    return many.join(possible_scopes(fields, record, scope), record, "left_anti")
