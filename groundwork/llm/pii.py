"""PII: detected entities get keyed surrogates of their own kind and form.

All SQL functions. A surrogate is a function of a secret key, the entity's kind and its
normal form, so the same entity reads the same everywhere, in whatever notation.
Formats stay: digits fill the digits of the original's notation, cards keep a valid
check digit, IBANs valid check digits, secrets their alphabet, mail addresses their
shape and case, names their title, gender and script.

Collisions are looked for over the distinct entities of the whole corpus: a surrogate
that two entities share, or that is itself an entity of the corpus, moves the later
one to its next attempt until none is left; after WIDE attempts surrogates of kinds with
small forms grow longer. Only those few entities travel to their
documents; all other surrogates are computed in place, without a shuffle of texts.
"""

from __future__ import annotations

import secrets
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, scratch, written

MALE = "Mr|Herr|M\\.|Monsieur|Sr|Señor|Господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Sra|Srta|Señora|Госпожа|г-жа"
#: Words of a name: any number, with inner capitals, apostrophes and hyphens.
_PART = r"\p{Lu}[’'-]?\p{L}[\p{L}’'-]*+"
_NAME = rf"{_PART}(?: {_PART})*+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kinds and their patterns; where several match at one place the first counts. Whatever may
#: repeat without a bound is possessive: the engine's stack does not grow with the text.
KINDS = {
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.(?=[A-Za-z]{2}|[A-Za-z0-9-]++\.[A-Za-z0-9-]))++[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .-][0-9]{1,4}[ .-][0-9]{5,8}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|(?:[0-9]{4}[ -]){3}[0-9]{1,7})(?![0-9A-Za-z])",
    "person": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? {_NAME}",
    "secret": r"(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(?=[_+/.-]*+[A-Za-z0-9])[A-Za-z0-9_+/.-]{8,}+",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts that cannot match any pattern are let through at once.
MAYBE = rf"[0-9@]|AKIA|(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\s{{0,2}}[=:]|(?:{MALE}|{FEMALE})\.? \p{{Lu}}"
#: Attempts within the entity's own form; later ones lengthen the surrogate, so that a small form cannot run out.
WIDE = 6

_DRAWN = secrets.token_hex(16)

SYLLABLES = {"latin": "ba be bo da de do fa fe fi ka ke ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va".split(), "cyrillic": "ба бе бо да де до ка ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ви".split()}
#: Letters that lengthen a name, one for each hexadecimal digit.
LETTERS = {"latin": "abdefgiklmnoprst", "cyrillic": "абдегиклмнопрсту"}
ENDINGS = {
    ("latin", "given", "m"): "n r s l".split(), ("latin", "given", "f"): "na la ra sa".split(), ("latin", "surname", "m"): "rd nt lt rn".split(), ("latin", "surname", "f"): "rd nt lt rn".split(),
    ("cyrillic", "given", "m"): "н р с л".split(), ("cyrillic", "given", "f"): "на ла ра са".split(), ("cyrillic", "surname", "m"): "ров нов лов нин".split(), ("cyrillic", "surname", "f"): "рова нова лова нина".split(),
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def luhn_rest(digits: Column) -> Column:
    """The sum of Luhn's rule modulo 10; zero for a valid number."""
    return F.aggregate(F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x) % 10


def mod97(text: Column) -> Column:
    """The remainder of an IBAN-like text, letters as 10 to 35, modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(text), F.lit(0), step)


def iban_turned(iban: Column) -> Column:
    return F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))


def kind_of(match: Column) -> Column:
    """The kind of a detected text; null if its check digits are wrong."""
    whole = lambda k: match.rlike("^(?:" + KINDS[k] + ")$")
    out = F.when(whole("aws"), "aws").when(whole("email"), "email")
    out = out.when(whole("iban"), F.when(mod97(iban_turned(F.replace(match, F.lit(" "), F.lit("")))) == 1, "iban"))
    out = out.when(whole("ip"), "ip").when(whole("phone"), "phone").when(whole("ssn"), "ssn")
    return out.when(whole("card"), F.when(luhn_rest(_digits(match)) == 0, "card")).when(whole("person"), "person").otherwise("secret")


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"^(?:{MALE}|{FEMALE})\.? ", 0)


def keys_of(match: Column) -> Column:
    """What a detected text stands for: array of (kind, normal form); empty if nothing. Names are keyed part by part."""

    def parts(k: Column) -> Column:
        simple = F.when(k == "email", F.lower(match)).when(k.isin("phone", "ssn", "card"), _digits(match)).when(k == "iban", F.replace(match, F.lit(" "), F.lit(""))).otherwise(match)
        gender = F.when(match.rlike(f"^(?:{FEMALE})"), "f").otherwise("m")
        script = F.when(match.rlike(r"\p{IsCyrillic}\S*$"), "cyrillic").otherwise("latin")
        words = F.split(F.substr(match, F.length(_title(match)) + 1), " ")
        about = F.struct(words.alias("words"), F.size(words).alias("n"), gender.alias("gender"), script.alias("script"))

        def named(a: Column) -> Column:
            """Each word's part, gender and script; a Latin surname has no gender."""
            last = lambda i: i == a["n"] - 1
            kind = lambda i: F.concat_ws("/", F.when(last(i), "surname").otherwise("given"), F.when((a["script"] == "latin") & last(i), "m").otherwise(a["gender"]), a["script"])
            return F.transform(a["words"], lambda x, i: F.struct(kind(i).alias("kind"), F.lower(x).alias("norm")))

        person = let(about, named)
        none = F.array().cast("array<struct<kind:string,norm:string>>")
        return F.when(k.isNull(), none).when(k == "person", person).otherwise(F.array(F.struct(k.alias("kind"), simple.alias("norm"))))

    return let(kind_of(match), parts)


def _bytes(hexed: Column, i: Column | int) -> Column:
    """Sixteen bits of the digest, by place."""
    at = (F.lit(i) if isinstance(i, int) else i) * 4 + 1
    return F.conv(F.substr(hexed, at, F.lit(4)), 16, 10).cast("int")


def _shaped(norm: Column, hexed: Column, keep: Column) -> Column:
    """``norm`` with every letter and digit after the first ``keep`` drawn anew in its class."""
    small, large = F.when(norm.rlike("^[0-9a-f]++$"), 6).otherwise(26), F.when(norm.rlike("^[0-9A-F]++$"), 6).otherwise(26)
    about = F.struct(small.alias("small"), large.alias("large"), keep.alias("keep"), hexed.alias("hexed"))

    def drawn(a: Column) -> Column:
        at = lambda i: _bytes(a["hexed"], i % 256)
        digit, letter = lambda i: (at(i) % 10).cast("string"), lambda i, n, first: F.char(at(i) % n + first)
        new = lambda c, i: F.when((i < a["keep"]) | ~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike(r"\p{N}"), digit(i)).when(c.rlike(r"\p{Ll}"), letter(i, a["small"], 97)).when(c.rlike(r"\p{Lu}"), letter(i, a["large"], 65)).otherwise(letter(i, 26, 97))
        return F.array_join(F.transform(_chars(norm), new), "")

    return let(about, drawn)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form, itself in normal form."""
    seed = lambda n: F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"), F.lit(n))

    def drawn(h: Column) -> Column:
        n = F.length(norm)
        more = F.when(attempt > WIDE, F.substr(F.sha2(seed("more"), 256), F.lit(1), (attempt - WIDE) * 4)).otherwise("")
        number = _shaped(norm, h, F.greatest(n - 10, F.lit(0)))
        number = F.concat(number, F.translate(more, "abcdef", "012345"))
        card = F.concat(F.substr(_shaped(norm, h, F.lit(1)), F.lit(1), n - 1), F.lit("0"))
        card = let(card, lambda c: F.concat(F.substr(c, F.lit(1), n - 1), ((10 - luhn_rest(c)) % 10).cast("string")))
        body = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lit("00"), F.substr(_shaped(norm, h, F.lit(4)), F.lit(5)))
        iban = let(body, lambda b: F.concat(F.substr(b, F.lit(1), F.lit(2)), F.lpad((98 - mod97(iban_turned(b))).cast("string"), 2, "0"), F.substr(b, F.lit(5))))
        domain = F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(norm, "@", -1)), 256), F.lit(1), F.lit(8))
        email = F.concat(_shaped(F.substring_index(norm, "@", 1), h, F.lit(0)), more, F.lit("@d"), domain, F.lit(".example.com"))
        ip = F.concat_ws(".", *[(_bytes(h, i) % 254 + 1).cast("string") for i in range(4)])
        name = F.lit(None).cast("string")
        for (script, part, gender), ends in ENDINGS.items():
            pool = F.array(*map(F.lit, SYLLABLES[script]))
            made = F.concat(*[F.element_at(pool, _bytes(h, i) % len(SYLLABLES[script]) + 1) for i in range(4)], F.translate(more, "0123456789abcdef", LETTERS[script]), F.element_at(F.array(*map(F.lit, ends)), _bytes(h, 9) % len(ends) + 1))
            name = F.when(kind == f"{part}/{gender}/{script}", made).otherwise(name)
        out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind.isin("phone", "ssn"), number)
        return out.when(kind == "aws", _shaped(norm, h, F.lit(4))).when(kind == "secret", F.concat(_shaped(norm, h, F.lit(0)), more)).otherwise(name)

    return let(F.concat(*[F.sha2(seed(i), 512) for i in range(8)]), drawn)


def written_as(match: Column, kind: Column, new: Column) -> Column:
    """A surrogate of one part in the notation of the detected text."""
    filled = F.array_join(F.transform(_chars(match), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(new, F.length(_digits(F.substr(match, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    filled = F.concat(filled, F.substr(new, F.length(_digits(match)) + 1))
    spaced = F.when(match.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    return F.when(kind.isin("phone", "ssn", "card"), filled).when(kind == "iban", spaced).when((kind == "email") & (match == F.upper(match)), F.upper(new)).otherwise(new)


def replaced(match: Column, moved: Column | None, key: str) -> Column:
    """The text to stand for a detected one; ``moved`` maps "kind:norm" to a later attempt."""

    def parts(ks: Column) -> Column:
        attempt = lambda k: F.lit(0) if moved is None else F.coalesce(moved[F.concat_ws(":", k["kind"], k["norm"])], F.lit(0))
        new = F.transform(ks, lambda k: F.when(k["kind"].contains("/"), F.initcap(surrogate(k["kind"], k["norm"], attempt(k), key))).otherwise(let(surrogate(k["kind"], k["norm"], attempt(k), key), lambda new: written_as(match, k["kind"], new))))
        return F.when(F.size(ks) == 0, match).when(F.get(ks, 0)["kind"].contains("/"), F.concat(_title(match), F.array_join(new, " "))).otherwise(F.get(new, 0))

    return let(keys_of(match), parts)


def free_attempts(entities: DataFrame, key: str, folder: str) -> DataFrame:
    """``entities`` (kind, norm, distinct) with the least attempts at which all surrogates are distinct and none is an entity.

    Ends for any number of entities of the kinds that lengthen; the forms of the others
    (ip, card, iban, aws) have billions of members.
    """
    now = written(entities.withColumn("attempt", F.lit(0)), f"{folder}/attempt0")
    for turn in count(1):
        drawn = written(now.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), f"{folder}/drawn{turn}")
        first = F.min(F.struct("attempt", "norm")).alias("first")
        owner = written(drawn.groupBy("kind", "new").agg(first).select("kind", "new", F.col("first.norm").alias("owner")), f"{folder}/owner{turn}")
        real = entities.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real"))
        checked = drawn.join(owner, ["kind", "new"]).join(real, ["kind", "new"], "left")
        clash = (F.col("owner") != F.col("norm")) | F.col("real").isNotNull()
        now = written(checked.select("kind", "norm", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")), f"{folder}/attempt{turn}")
        if not now.agg(F.max("clash")).first()[0]:
            return now.select("kind", "norm", "attempt")
        now = now.drop("clash")


def secret_key(spark: SparkSession) -> str:
    """The key that ``spark.groundwork.pii.key`` names; where unset, one drawn for this process and kept nowhere else.

    Who knows the key can tell which entity a surrogate stands for, so no key is part of
    the code. Runs that must agree with each other set the same one.
    """
    return spark.conf.get("spark.groundwork.pii.key", None) or _DRAWN


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the texts' entities replaced, and n_entities, kinds.

    Names are found by their titles; a name without one is left, and so are numbers with
    wrong check digits. Long texts, and long entities, are taken whole.

    Null and empty texts stay as they are, with no entities. Repeated rows, and rows
    that share a doc_id, change alike; an empty table gives an empty table. Columns
    named n_entities and kinds are replaced.
    """
    folder = scratch(docs.sparkSession)
    docs = docs.drop("n_entities", "kinds")
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    matches = F.when(maybe, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    seen = docs.where(maybe).select("doc_id", F.explode(matches).alias("match")).where("match <> ''")
    seen = written(seen.select("doc_id", F.explode(keys_of(F.col("match"))).alias("k")).select("doc_id", "k.kind", "k.norm"), f"{folder}/seen")
    entities = written(seen.select("kind", "norm").distinct(), f"{folder}/entities")
    moved = written(free_attempts(entities, key, folder).where("attempt > 0"), f"{folder}/moved")
    rows = docs
    some = moved.limit(1).count() > 0
    if some:
        name = F.concat_ws(":", "kind", "norm")
        by_doc = seen.join(moved, ["kind", "norm"]).select("doc_id", name.alias("name"), "attempt").distinct()
        by_doc = by_doc.groupBy(F.col("doc_id").alias("__id")).agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("__moved"))
        by_doc = written(by_doc, f"{folder}/by_doc")
        hit = docs.where(maybe).join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        rows = hit.unionByName(docs.where(~maybe).withColumn("__moved", F.lit(None).cast("map<string,int>")))
    names = F.col("__moved") if some else None
    text = let(F.split("text", ANY, -1), lambda p: F.concat(F.get(p, 0), F.array_join(F.transform(matches, lambda m, i: F.concat(replaced(m, names, key), F.get(p, i + 1))), "")))
    kinds = F.flatten(F.transform(matches, lambda m: F.array_compact(F.array(kind_of(m)))))
    new = F.when(maybe, text).otherwise(F.col("text"))
    out = rows.withColumn("kinds", F.when(maybe, kinds).otherwise(F.array().cast("array<string>"))).withColumn("text", new)
    return out.withColumn("n_entities", F.size("kinds").cast("long")).withColumn("kinds", F.array_sort(F.array_distinct("kinds"))).drop("__moved")
