"""Surrogates for personal data (DataFrame functions only).

Detected: e-mail addresses, IPv4 addresses, phone numbers (international, or with a bracketed area
code), payment cards (13 to 19 digits with a right check digit), social security numbers, secrets
(a quoted value of 16 or more characters, a letter and a digit among them, after ``=`` or ``:`` and a
name that tells of a secret, and access keys), and
names of any number of words after a title in English, German, French, Spanish or Russian.

Every entity (type and canonical form: lower case, digits only, single spaces; a person is one entity
under all titles, with a gender where all its titles that tell one agree) gets one surrogate
made from a keyed SHA-256, so all its mentions in all documents are replaced alike, and nobody
without the key can tell from which entity. A surrogate keeps type and format: the same length and
separators, letters for letters of the same script, digits for digits, each mention's own upper and
lower case. Cards keep their first digit and have a right check digit, phones keep their country
code, e-mails keep their last label and share a domain where the entities do, octets stay in 1 to
254, names alternate consonants and vowels and, for a person with a gender, end the way given names
of that gender often do in that script.

Collision checks keep surrogates distinct: in each round the candidates are grouped; one entity
keeps each candidate, unless an earlier one has it or it is the canonical form of any entity found.
The others try again with the next attempt's hash (names, e-mails and secrets also grow by a letter
every third attempt, numbers by a digit every tenth). What finds no place in ``attempts`` rounds, as its
format is all but used up, gets its kind and a hash in brackets. Which of two colliding entities tries again depends on the entities found.

Texts without a mention pass straight through; only texts with one are joined with their
replacements. An entity that a third of all documents mention is one row once distinct (reduced
before the shuffle), and the join of mentions with surrogates is one that Spark splits.

Null texts stay null and have no entities. Documents are told apart by doc_id (null counts as a
value) and text, so repeated rows are replaced alike. An empty table gives an empty result. Other
columns are carried; an input column named ``n_replaced`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

# Titles by the gender they tell ("Don" and "Sr" are words of other uses without their
# small letter and dot, as is "Miss" in the names of contests), small words inside names, names of secrets.
TITLES = {"f": r"(?i:mrs|ms|frau|madame|mme|mademoiselle|mlle|señora|sra|г-жа)\.?|(?i:miss)(?!\s(?:America|Universe|World)(?!\p{L}))|doña",
          "m": r"(?i:mr|herrn|herr|monsieur|señor|г-н)\.?|(?i:sr)\.|don", "": r"(?i:dr|prof)\.?"}
PARTICLES = "van|von|vom|zu|zum|zur|der|den|dem|ten|ter|de|del|della|di|da|do|dos|das|du|des|la|le|los|las|el|al|bin|ibn|ben|y|e"
SECRET_NAMES = "key|token|secret|passw|pwd|auth|credential"
_TITLE = "(?:" + "|".join(TITLES.values()) + r")\s"
_NAME = rf"(?!{_TITLE}\p{{Lu}})(?:(?:{PARTICLES})[ \t])*+\p{{Lu}}[\p{{L}}'’-]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Groups that repeat without a bound are possessive ones: these Java steps in a loop, others call themselves once
# for each repetition. Where a possessive run takes too much, ``classify`` cuts it.
KINDS = {
    "email": r"(?<![.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "person": _TITLE + _NAME + rf"(?:[ \t]{_NAME})*+",
    "secret": r"(?<=[\"'])(?<=(?i:" + SECRET_NAMES + r")[\w-]{0,32}[\"']?\s{0,2}[=:]\s{0,2}[\"'])(?=[^\"'\s]*+[\"'])(?=[^\"'\s\d]*+\d)"
              r"(?=[^\"'\sA-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+(?=[\"'])|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ip": r"(?<!\d\.)" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\d])(?!\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{2,4}(?![\w])|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?![\w])",
    "card": r"\d{13,19}(?![\w])|\d{4}(?:[ -]\d{4}){2,3}[ -]\d{1,4}(?![\w])",
}
#: What of an e-mail's run of labels is its domain: up to the last label of letters that ends one.
DOMAIN = r"^[A-Za-z0-9.-]*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
#: A mention starts where no letter or digit goes before it.
PATTERN = r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}(+])(?:" + "|".join(KINDS.values()) + ")"


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _span(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


#: Script -> letters that it has (lower case) and letters to draw from.
SCRIPTS = {
    "latin": (r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]", _span((97, 122))),
    "greek": (r"[\x{3ac}-\x{3ce}]", _span((0x3B1, 0x3C1), (0x3C3, 0x3C9))),
    "cyrillic": (r"[\x{430}-\x{45f}]", _span((0x430, 0x449))),
    "hebrew": (r"[\x{5d0}-\x{5ea}]", _span((0x5D0, 0x5EA))),
    "arabic": (r"[\x{620}-\x{64a}]", _span((0x628, 0x63A), (0x641, 0x648))),
    "devanagari": (r"[\x{905}-\x{939}]", _span((0x915, 0x939))),
    "hiragana": (r"[\x{3041}-\x{3096}]", _span((0x304B, 0x3062), (0x306A, 0x307F))),
    "katakana": (r"[\x{30a1}-\x{30f6}]", _span((0x30AB, 0x30C2), (0x30CA, 0x30DF))),
    "hangul": (r"[\x{ac00}-\x{d7a3}]", "".join(chr(0xAC00 + 588 * k + 28 * (k % 5)) for k in range(19))),
    "han": (r"[\x{4e00}-\x{9fff}]", "".join(chr(0x4E00 + 97 * k) for k in range(200))),
}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу"}
# Last letters of given names by gender.
ENDINGS = {"f": {"latin": "a", "cyrillic": "а", "greek": "α"}, "m": {"latin": "o", "cyrillic": "н", "greek": "ς"}}


def _byte(seed: Column, i: Column) -> Column:
    """Byte ``i`` (from 0) of the stream that ``seed`` starts."""
    block = F.sha2(F.concat(seed, F.floor(i / 32).cast("string")), 256)
    return F.conv(F.substring(block, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _alphabet(c: Column, i: Column, spoken: Column) -> Column:
    """The letters or digits that may stand for character ``c``; "" for any other character."""
    out = F.when(c.rlike("[0-9]"), F.lit("0123456789"))
    for script, (has, letters) in SCRIPTS.items():
        vowels = VOWELS.get(script, "")
        rest = "".join(x for x in letters if x not in vowels)
        pick = F.lit(letters) if not vowels else F.when(spoken, F.when(i % 2 == 1, vowels).otherwise(rest)).otherwise(letters)
        out = out.when(c.rlike(has), pick)
    return out.otherwise("")


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _letters(text: Column, seed: Column, spoken: Column) -> Column:
    """``text`` with every letter and digit replaced by one of its kind."""
    def one(c: Column, i: Column) -> Column:
        return F.get(F.transform(F.array(_alphabet(c, i, spoken)), lambda a: F.when(a == "", c).otherwise(
            F.substring(a, (_byte(seed, i) % F.length(a) + 1).cast("int"), F.lit(1)))), 0)
    return F.array_join(F.transform(_characters(text), one), "")


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def classify(found: DataFrame) -> DataFrame:
    """``found`` (mention) with ``kind`` (null: not an entity after all), ``canonical`` and the ``gender`` its title tells."""
    m = F.col("mention")
    domain = F.regexp_extract(F.substring_index(m, "@", -1), DOMAIN, 0)
    proper = (domain != "") & ~domain.contains("..")
    body = F.when(m.contains("@") & proper, F.concat(F.substring_index(m, "@", 1), F.lit("@"), domain)).otherwise(m)
    found, m = found.withColumn("body", body), F.col("body")
    whole = lambda kind: m.rlike("^(?:" + KINDS[kind] + ")$")
    digits = F.regexp_replace(m, r"\D", "")
    name = F.regexp_replace(m, "^" + _TITLE, "")
    gender = F.when(m.rlike("^(?:" + TITLES["f"] + r")\s"), "f").when(m.rlike("^(?:" + TITLES["m"] + r")\s"), "m")
    kind = (F.when(m.contains("@"), F.when(proper, "email")).when(whole("person"), "person").when(whole("ip"), "ip")
            .when(whole("ssn"), "ssn").when(whole("phone"), "phone")
            .when(whole("card"), F.when(_luhn(digits), "card")).otherwise("secret"))
    plus = F.when(m.startswith("+"), F.concat(F.regexp_extract(m, r"^\+(\d{1,3})", 1), F.lit("+"))).otherwise("")
    national = F.when(m.startswith("+"), F.regexp_replace(F.regexp_replace(m, r"^\+\d{1,3}", ""), r"\D", "")).otherwise(digits)
    canonical = (F.when(F.col("kind").isin("ssn", "card"), digits).when(F.col("kind") == "phone", F.concat(plus, national))
                 .when(F.col("kind") == "person", F.lower(F.regexp_replace(name, r"\s+", " "))).otherwise(F.lower(m)))
    return found.withColumn("kind", kind).withColumn("canonical", canonical).withColumn("gender", F.when(F.col("kind") == "person", gender)).drop("body")


def with_candidates(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """``entities`` with ``surrogate``, in canonical form, of an attempt.

    Built in steps (what stays, what is drawn, the whole), so that no expression holds another one
    many times over.
    """
    kind, canonical, more, digits = F.col("kind"), F.col("canonical"), F.lit("a" * (attempt // 3)), F.lit("0" * (attempt // 10))
    domain = F.element_at(F.split(canonical, "@"), -1)
    seed = lambda *of: F.sha2(F.concat_ws("\x00", F.lit(key), *of), 256)
    code = F.regexp_extract(canonical, r"^(\d*\+)?", 0)
    drawn = (F.when(kind == "email", F.concat(F.element_at(F.split(canonical, "@"), 1), more))
             .when(kind == "phone", F.concat(F.substring(canonical, F.length(code) + 1, F.length(canonical)), digits))
             .when(kind == "card", F.concat(F.substring(canonical, F.lit(2), F.length(canonical) - 2), digits))
             .when(kind == "ssn", F.concat(canonical, digits)).when(kind == "ip", "").otherwise(F.concat(canonical, more)))
    parts = F.array(F.struct(drawn.alias("t"), seed(kind, canonical, F.lit(str(attempt))).alias("s"), (kind == "person").alias("v")),
                    F.struct(F.when(kind == "email", F.regexp_replace(domain, r"[^.]*$", "")).otherwise("").alias("t"),
                             seed(F.lit("domain"), domain).alias("s"), F.lit(False).alias("v")))
    rows = entities.withColumn("__parts", parts)
    rows = rows.withColumn("__made", F.transform("__parts", lambda p: _letters(p["t"], p["s"], p["v"])))
    body, seeded = F.get("__made", 0), F.get("__parts", 0)["s"]
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(seeded, i) % 254 + 1).cast("string")), ".")
    digit = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")),
                           lambda d: _luhn(F.concat(F.substring(canonical, 1, 1), body, d))), 0)
    first = F.regexp_extract(body, r"^\S*", 0)
    last = F.substring(first, F.length(first), F.lit(1))
    end = F.lit(None).cast("string")
    for gender, endings in ENDINGS.items():
        for script, letter in endings.items():
            end = F.when((F.col("gender") == gender) & last.rlike(SCRIPTS[script][0]), F.lit(letter)).otherwise(end)
    named = F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.coalesce(end, last), F.substring(body, F.length(first) + 1, F.length(body)))
    out = (F.when(kind == "email", F.concat(body, F.lit("@"), F.get("__made", 1), F.regexp_extract(domain, r"[^.]*$", 0)))
           .when(kind == "card", F.concat(F.substring(canonical, 1, 1), body, digit)).when(kind == "phone", F.concat(code, body))
           .when(kind == "ip", octets).when(kind == "person", named).otherwise(body))
    return rows.withColumn("surrogate", out).drop("__parts", "__made")


def surrogates(entities: DataFrame, key: str, attempts: int = 100) -> DataFrame:
    """(kind, canonical, surrogate) of distinct ``entities`` (kind, canonical, gender); surrogates are distinct
    and none is the canonical form of an entity."""
    done, pending, attempt = None, entities, 0
    while True:
        made = staged(with_candidates(pending, attempt, key), "surrogates")
        won = (made.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
               .join(entities.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_anti"))
        if done is not None:
            won = won.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = won.select("kind", "canonical", "surrogate")
        done = staged(won if done is None else done.unionByName(won), "surrogates")
        pending = made.drop("surrogate").join(done, ["kind", "canonical"], "left_anti")
        attempt += 1
        if pending.isEmpty():
            return done
        if attempt == attempts:
            mask = F.concat(F.lit("["), "kind", F.lit(" "), F.substring(F.sha2(F.concat_ws("\x00", F.lit(key), "kind", "canonical"), 256), 1, 32), F.lit("]"))
            return done.unionByName(pending.select("kind", "canonical", mask.alias("surrogate")))


def render(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format: its separators around the digits, its upper and lower case,
    its title, and what follows an e-mail's domain. Linear in the mention's length but for numbers, which are short."""
    digits = F.regexp_replace(surrogate, r"\D", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), (i + 1).cast("int")), r"\D", ""))
    numbers = F.array_join(F.transform(_characters(mention), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(digits, before(i), F.lit(1))).otherwise(c)), "")
    grown = F.substring(digits, F.length(F.regexp_replace(mention, r"\D", "")) + 1, F.length(digits))
    title = F.when(kind == "person", F.regexp_extract(mention, "^" + _TITLE, 0)).otherwise("")
    domain = F.substring_index(mention, "@", -1)
    tail = F.when(kind == "email", F.substring(domain, F.length(F.regexp_extract(domain, DOMAIN, 0)) + 1, F.length(domain))).otherwise("")
    own = F.substring(mention, F.length(title) + 1, F.length(mention) - F.length(title) - F.length(tail))
    pairs = F.zip_with(_characters(surrogate), _characters(own), lambda c, o: F.when(o.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    return (F.when(surrogate.startswith("["), F.concat(title, surrogate, tail)).when(kind.isin("phone", "card", "ssn"), F.concat(numbers, grown))
            .when(kind == "ip", surrogate).otherwise(F.concat(title, F.array_join(pairs, ""), tail)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its surrogate, and ``n_replaced``."""
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_replaced")]
    docs = docs.select(*carried, "text")
    mark = F.xxhash64("text").alias("__text")
    found = staged(classify(
        docs.select("doc_id", mark, F.posexplode(mentions(F.col("text"))).alias("pos", "mention")).distinct()), "mentions")
    entities = found.filter("kind IS NOT NULL").groupBy("kind", "canonical").agg(
        F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender"))
    made = surrogates(entities, key)
    new = (found.join(made, ["kind", "canonical"], "left")
           .withColumn("new", F.coalesce(render(F.col("mention"), F.col("kind"), F.col("surrogate")), "mention"))
           .groupBy("doc_id", "__text").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("__new"),
                                            F.count("surrogate").alias("__n"))
           .withColumnRenamed("doc_id", "__id").withColumnRenamed("__text", "__mark"))

    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    clean = docs.filter(~has).select(*carried, "text", F.lit(0).cast("long").alias("n_replaced"))
    hit = docs.filter(has).withColumn("__text", mark)
    joined = hit.join(new, hit["doc_id"].eqNullSafe(new["__id"]) & (hit["__text"] == new["__mark"]))
    pieces = F.split("text", PATTERN, -1)
    words = F.concat(F.transform("__new", lambda x: x["new"]), F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(pieces, words, lambda p, w: F.array(p, w))), "")
    return clean.unionByName(joined.select(*carried, text.alias("text"), F.col("__n").alias("n_replaced")))
