"""Surrogates for personal data, with DataFrame and SQL functions only.

Entities are found by one pattern; the text between them stays as it is.  Each entity gets a keyed surrogate of its own kind:

* numbers (cards, phones, social security numbers, accounts, IPv4 addresses) go through a keyed permutation of their digits
  (a Feistel network), so different numbers of one format get different surrogates; separators, country codes, the
  card's first digit and whether its check digit is right stay;
* mail addresses, access keys and secrets get letters for letters, digits for digits, hex for hex, from a keyed hash;
* names behind a title get a name of the gender the title tells (Dr and Prof: of either), of the script of the name and in capitals
  where the name is; a surname has one surrogate wherever it stands, in upper or lower case, so mentions stay linked.

Names without one of the titles of ``KINDS``, third names and post addresses are not looked for; nor are mail addresses with more than 64
characters before the sign or more than 30 parts behind it.

The same entity has the same surrogate in all documents (coreference).  Collision check: all distinct entities of the
table are gathered, and those whose surrogate is also an entity of the table, or the surrogate of another one, draw
again with another attempt number until none is left.  Of persons, surnames are settled first, each for all its mentions, and
then the first names of each surname, which become double names and longer as more are needed; mentions of one name in
other case or behind another title of the gender are one person.  Exceptions join back on a hash of the text.

Cards, phones and social security numbers are compared by their digits and other entities without case, so all spellings of one
are drawn again together.  Where a format has too little room, mail addresses get longer from the third attempt on, and all others
get a growing tail from the eighth on: drawing ends on any table.

The key comes as a parameter or from the setting ``KEY_SETTING`` of the session.  Without one a random key is drawn for the call, and its
surrogates cannot be linked with those of another call.

Null and empty texts stay as they are and have no entities.  Repeated rows get the same result.  Other columns are kept; the
columns added are ``n_entities`` and ``kinds`` (a column of these names is replaced).
"""

from __future__ import annotations

import secrets
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

KEY_SETTING = "spark.tracklens.surrogateKey"
LONGER, TAIL = 3, 8  # attempts from which mail addresses grow, and from which others get a tail

# Forms of entities, in order of preference, as Java patterns.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,30}[A-Za-z]{2,24}",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?(?:[\"'][A-Za-z0-9+/_.-]{6,}[\"']|(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{6,})",
    "access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}(?![0-9])|[0-9]{13,19}(?![0-9])",
    "person": r"(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа|Dr|Prof|Professor|Доктор|Профессор)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
# First names by gender and script.
FIRST = {
    ("f", "latin"): "Anna Clara Elena Greta Hanna Irene Julia Laura Lena Maria Nora Olivia Paula Rosa Sara Vera",
    ("m", "latin"): "Adrian Bruno Daniel Emil Felix Hugo Ivan Jonas Leo Lucas Martin Noah Oscar Paul Simon Victor",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга",
    ("m", "cyrillic"): "Антон Борис Иван Максим Никита Олег Павел Юрий",
}
FIRST |= {("n", s): f"{FIRST['f', s]} {FIRST['m', s]}" for s in ("latin", "cyrillic")}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа)\b"
EITHER = r"^(?:Dr|Prof|Professor|Доктор|Профессор)\b"
ANY = r"(?<![A-Za-z0-9_@])(?:" + "|".join(KINDS.values()) + ")"
# every entity holds one of these signs or words; looking for them is far cheaper than the pattern
SIGNS = "[0-9@=:]"
MARKS = ("Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Господин", "Госпожа", "Dr", "Prof", "Доктор", "Профессор", "sk-", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def entities(text: Column) -> Column:
    maybe = reduce(lambda c, w: c | text.contains(w), MARKS, text.rlike(SIGNS))
    return F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    out = None
    for kind, form in KINDS.items():
        test = entity.rlike(f"^(?:{form})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def drawn(seed: Column, below: Column) -> Column:
    """A number from a keyed hash, 0 <= x < below."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 14), 16, 10).cast("long") % below


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def permuted(number: Column, digits: Column, seed: Column) -> Column:
    """A keyed permutation of the numbers of so many decimal digits (2 to 18), as a zero-padded string."""

    def mixed(x: Column) -> Column:
        head, key = F.floor(x["n"] / 2).cast("int"), x["seed"]
        tail = x["n"] - head
        a, b = F.pow(F.lit(10.0), head).cast("long"), F.pow(F.lit(10.0), tail).cast("long")

        def round_(h: Column, i: Column) -> Column:
            left = F.when(i % 2 == 1, (h["l"] + drawn(F.concat_ws("|", key, i.cast("string"), h["r"].cast("string")), a)) % a).otherwise(h["l"])
            right = F.when(i % 2 == 0, (h["r"] + drawn(F.concat_ws("|", key, i.cast("string"), h["l"].cast("string")), b)) % b).otherwise(h["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        halves = F.struct(F.floor(x["number"] / b).cast("long").alias("l"), (x["number"] % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), halves, round_, lambda h: F.concat(F.lpad(h["l"].cast("string"), head, "0"), F.lpad(h["r"].cast("string"), tail, "0")))

    return let(F.struct(number.alias("number"), digits.cast("int").alias("n"), seed.alias("seed")), mixed)


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def with_digits(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits`` in order."""
    at = F.sequence(F.lit(1), F.length(form))
    return let(digits, lambda d: F.array_join(F.transform(at, lambda i: F.when(F.substr(form, i, F.lit(1)).rlike("[0-9]"), F.substr(d, F.length(only_digits(F.substr(form, F.lit(1), i))), F.lit(1))).otherwise(F.substr(form, i, F.lit(1)))), ""))


def scrambled(s: Column, seed: Column, alphabet: str | None = None) -> Column:
    """Letters for letters, digits for digits; with ``alphabet``, its characters for letters and digits."""

    def word(x: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = lambda below: drawn(F.concat_ws("|", x["seed"], (i + 1).cast("string")), F.lit(below))
            if alphabet:
                return F.when(c.rlike("[A-Za-z0-9]"), F.substr(F.lit(alphabet), (n(len(alphabet)) + 1).cast("int"), F.lit(1))).otherwise(c)
            return F.when(c.rlike("[0-9]"), n(10).cast("string")).when(c.rlike("[a-z]"), F.chr(n(26) + 97)).when(c.rlike("[A-Z]"), F.chr(n(26) + 65)).otherwise(c)

        return F.when(F.length(x["s"]) > 0, F.array_join(F.transform(F.split(x["s"], ""), one), "")).otherwise(x["s"])

    return let(F.struct(s.alias("s"), seed.alias("seed")), word)


def luhn(digits: Column) -> Column:
    """The check digit for the digits before it."""

    def check(s: Column) -> Column:
        n = F.length(s)

        def add(total: Column, i: Column) -> Column:
            d = F.substr(s, n - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

        return (10 - F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10) % 10

    return let(digits, check)


def surname(word: Column, seed: Column, more: Column) -> Column:
    """A name of four syllables and ``more`` in the word's script."""
    def syllables(first: str, second: str) -> Column:
        a, b = F.split(F.lit(first), " "), F.split(F.lit(second), " ")
        pick = lambda k, i, which, of: of[drawn(F.concat_ws("|", k, i.cast("string"), F.lit(which)), F.size(of).cast("long")).cast("int")]
        return let(seed, lambda k: F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), more + 4), lambda i: F.concat(pick(k, i, "a", a), pick(k, i, "b", b))), "")))

    return F.when(word.rlike(r"\p{IsCyrillic}"), syllables("б в г д ж з к л м н п р с т", "а е и о у я ов ен")).otherwise(syllables("b d f g h k l m n p r s t v", "a e i o u an el or"))


def gender_of(entity: Column) -> Column:
    return F.when(entity.rlike(FEMALE), "f").when(entity.rlike(EITHER), "n").otherwise("m")


def cased(word: Column, name: Column) -> Column:
    """``name`` in capitals where ``word`` is."""
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(name)).otherwise(name)


def tagged(key: str, attempt: Column) -> Column:
    return F.concat_ws("|", F.lit(key), attempt.cast("string"))


def family_name(last: Column, key: str, attempt: Column) -> Column:
    return surname(last, F.concat_ws("|", tagged(key, attempt), F.lit("surname"), F.lower(last)), attempt)


def first_name(name: Column, gender: Column, key: str, attempt: Column) -> Column:
    """A first name; from attempt n on, n + 1 of them with hyphens."""
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    out = None
    for (g, s), names in FIRST.items():
        of = F.split(F.lit(names), " ")
        seed = F.concat_ws("|", tagged(key, attempt), F.lit("first"), F.lit(g), F.lower(name))

        def pick(i: Column) -> Column:
            return of[drawn(F.when(i == 0, seed).otherwise(F.concat_ws("|", seed, i.cast("string"))), F.size(of).cast("long")).cast("int")]  # noqa: B023

        one = F.array_join(F.transform(F.sequence(F.lit(0), attempt), pick), "-")
        out = F.when((gender == g) & (script == s), one) if out is None else out.when((gender == g) & (script == s), one)
    return out


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    base = tagged(key, attempt)
    return let(F.struct(entity.alias("entity"), kind_of(entity).alias("kind"), only_digits(entity).alias("digits"), base.alias("base")), lambda x: of_kind(x["entity"], x["kind"], x["digits"], x["base"], key, attempt))


def of_kind(entity: Column, kind: Column, digits: Column, base: Column, key: str, attempt: Column) -> Column:
    seed = F.concat_ws("|", base, kind, F.lower(entity))
    n = F.length(digits)
    # cards: first digit, permuted digits, check digit as right or wrong as before
    inner = F.substr(digits, F.lit(2), n - 2)
    body = F.concat(F.substring(digits, 1, 1), permuted(inner.cast("long"), n - 2, F.concat_ws("|", base, F.lit("card"), n.cast("string"))))
    off = F.substr(digits, n, F.lit(1)).cast("int") - luhn(F.substr(digits, F.lit(1), n - 1))
    card = let(body, lambda b: with_digits(entity, F.concat(b, ((luhn(b) + off + 10) % 10).cast("string"))))
    tail = F.least(F.lit(8), n - 1)
    phone = with_digits(entity, F.concat(F.substr(digits, F.lit(1), n - tail), permuted(F.substr(digits, n - tail + 1, tail).cast("long"), tail, F.concat_ws("|", base, F.lit("phone"), F.substr(digits, F.lit(1), n - tail)))))
    ssn = with_digits(entity, permuted(digits.cast("long"), n, F.concat_ws("|", base, F.lit("ssn"))))
    octet = lambda i: F.split(entity, r"\.")[i].cast("long")
    low = octet(1) * 65536 + octet(2) * 256 + octet(3)

    def mixed(v: Column) -> Column:
        step = lambda x, i: F.struct(x["r"].alias("l"), ((x["l"] + drawn(F.concat_ws("|", base, F.lit("ip"), octet(0).cast("string"), i.cast("string"), x["r"].cast("string")), F.lit(4096))) % 4096).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(F.shiftright(v, 12).alias("l"), (v % 4096).alias("r")), step, lambda x: x["l"] * 4096 + x["r"])

    ip = let(let(low, mixed), lambda v: F.concat_ws(".", octet(0).cast("string"), F.floor(v / 65536).cast("string"), (F.floor(v / 256) % 256).cast("string"), (v % 256).cast("string")))
    more = F.when(attempt >= LONGER, scrambled(F.repeat(F.lit("a"), attempt - LONGER + 1), F.concat_ws("|", seed, F.lit("more")))).otherwise("")
    mail = F.concat(scrambled(F.substring_index(entity, "@", 1), seed), more, F.lit("@"), scrambled(F.regexp_extract(entity, r"@(.*)\.[^.]*$", 1), F.concat_ws("|", base, F.lower(F.substring_index(entity, "@", -1)))), F.regexp_extract(entity, r"\.[^.@]*$", 0))
    label, value, quote = (F.regexp_extract(entity, r"^([A-Za-z_-]+\s?[=:]\s?[\"']?)([A-Za-z0-9+/_.-]*)([\"']?)$", i) for i in (1, 2, 3))
    told = F.concat_ws("|", base, F.lit("secret"), value)
    secret = F.concat(label, F.when(value.rlike("^[0-9a-f]+$"), scrambled(value, told, "0123456789abcdef")).otherwise(scrambled(value, told)), quote)
    prefix = F.regexp_extract(entity, r"^(AKIA|ASIA|gh[pousr]_|sk-)", 1)
    rest = F.substr(entity, F.length(prefix) + 1, F.length(entity))
    access = F.concat(prefix, F.when(prefix.rlike("^A"), scrambled(rest, seed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).otherwise(scrambled(rest, seed)))
    iban = F.concat(F.substring(entity, 1, 2), scrambled(F.substr(entity, F.lit(3), F.length(entity)), seed))
    words = F.split(entity, " ")
    family = family_name(F.element_at(words, -1), key, attempt)
    person = full_name(words, first_name(words[1], gender_of(entity), key, attempt), family)
    out = {"email": mail, "secret": secret, "access_key": access, "iban": iban, "ip": ip, "ssn": ssn, "phone": phone, "card": card, "person": person}
    result = None
    for k, v in out.items():
        result = F.when(kind == k, v) if result is None else result.when(kind == k, v)
    result = result.otherwise(scrambled(entity, seed))
    tail = F.concat(F.lit("-"), scrambled(F.repeat(F.lit("0"), attempt - TAIL + 1), F.concat_ws("|", seed, F.lit("tail"))))
    return F.when((attempt >= TAIL) & ~kind.isin("email", "person"), F.concat(result, tail)).otherwise(result)


def full_name(words: Column, first: Column, family: Column) -> Column:
    """Title, first name if there is one, and surname; ``words`` are those of the entity."""
    last = cased(F.element_at(words, -1), family)
    return F.when(F.size(words) > 2, F.concat_ws(" ", words[0], cased(words[1], first), last)).otherwise(F.concat_ws(" ", words[0], last))


def spelt_alike(kind: Column, entity: Column) -> Column:
    """What all spellings of an entity have in common."""
    return F.when(kind.isin("card", "phone", "ssn"), only_digits(entity)).otherwise(F.lower(entity))


def redrawn(known: DataFrame, again) -> DataFrame | None:
    """(entity, surrogate, attempt) of those rows of ``known`` whose surrogate is taken; ``again(rows, attempt)`` draws anew.

    ``known`` has (entity, surrogate) of all entities, and what ``again`` reads.
    """
    taken_by_entity = known.join(known.select(F.col("entity").alias("surrogate")).distinct(), "surrogate", "left_semi").select("entity")
    several = known.groupBy("surrogate").agg(F.count("*").alias("_n"), F.min("entity").alias("_first")).filter("_n > 1")
    taken_by_other = known.join(several, "surrogate").filter("entity != _first").select("entity")
    bad = stage(known.join(taken_by_entity.union(taken_by_other).distinct(), "entity", "left_semi"), "pii-taken")
    settled, attempt = None, 0
    while not bad.isEmpty():
        attempt += 1
        tried = stage(again(bad, F.lit(attempt)), "pii-tried")
        used = known.join(bad, "entity", "left_anti").select("surrogate").union(known.select("entity"))
        if settled is not None:
            used = used.union(settled.select("surrogate"))
        once = tried.groupBy("surrogate").agg(F.min("entity").alias("entity"))
        good = stage(once.join(used.distinct(), "surrogate", "left_anti").select("entity", "surrogate", F.lit(attempt).alias("attempt")), "pii-settled")
        settled = good if settled is None else settled.union(good)
        bad = stage(bad.join(good, "entity", "left_anti"), "pii-taken")
    return settled


def person_exceptions(found: DataFrame, key: str) -> DataFrame | None:
    """(entity, surrogate) of persons whose surname or first name was redrawn: every mention of the name is there."""
    words, no = F.split("entity", " "), F.lit(0)
    full = F.when(F.size(words) > 2, F.lower(words[1]))
    rows = stage(found.select("entity", words[0].alias("title"), gender_of(F.col("entity")).alias("gender"), full.alias("first"), F.lower(F.element_at(words, -1)).alias("last")), "pii-persons")
    if rows.isEmpty():
        return None
    put = lambda d, attempt: d.withColumn("surrogate", F.lower(family_name(F.col("entity"), key, attempt)))
    lasts = redrawn(stage(put(rows.select(F.col("last").alias("entity")).distinct(), no), "pii-surnames"), put)
    # the surname's own surrogate is distinct: first names have to differ only among those of one surname and gender
    name = lambda first: F.concat_ws(" ", "gender", first, "last")
    call = lambda d, attempt: d.withColumn("surrogate", name(F.lower(first_name(F.col("first"), F.col("gender"), key, attempt))))
    persons = rows.filter("first is not null").select("gender", "first", "last").distinct().withColumn("entity", name(F.col("first")))
    firsts = redrawn(stage(call(persons, no), "pii-first-names"), call)
    if lasts is None and firsts is None:
        return None
    none = rows.sparkSession.createDataFrame([], "entity string, surrogate string, attempt int")
    n_last = (none if lasts is None else lasts).select(F.col("entity").alias("last"), F.col("attempt").alias("_l"))
    n_first = (none if firsts is None else firsts).select(F.col("entity").alias("_id"), F.col("attempt").alias("_f"))
    both = rows.withColumn("_id", name(F.col("first"))).join(n_last, "last", "left").join(n_first, "_id", "left").filter("_l is not null or _f is not null")
    own = first_name(F.col("first"), F.col("gender"), key, F.coalesce("_f", no))
    return stage(both.select("entity", full_name(words, own, family_name(F.col("last"), key, F.coalesce("_l", no))).alias("surrogate")), "pii-settled")


def exceptions(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(entity, surrogate) of entities whose first surrogate is taken; staged, most often empty."""
    found = docs.select(F.explode(entities(F.col(f"`{text}`"))).alias("entity")).distinct()
    known = stage(found.withColumn("kind", kind_of(F.col("entity"))), "pii-entities")
    others = known.filter("kind != 'person'").withColumn("id", spelt_alike(F.col("kind"), F.col("entity")))
    put = lambda d, attempt: d.withColumn("surrogate", spelt_alike(kind_of(F.col("sample")), surrogate(F.col("sample"), key, attempt)))
    forms = others.groupBy(F.col("id").alias("entity")).agg(F.min("entity").alias("sample"))
    settled = redrawn(stage(put(forms, F.lit(0)), "pii-forms"), put)
    if settled is not None:
        drawn_again = others.join(settled.select(F.col("entity").alias("id"), "attempt"), "id")
        settled = stage(drawn_again.select("entity", surrogate(F.col("entity"), key, F.col("attempt")).alias("surrogate")), "pii-settled")
    parts = [x.select("entity", "surrogate") for x in (settled, person_exceptions(known.filter("kind = 'person'"), key)) if x is not None]
    return reduce(DataFrame.union, parts) if parts else known.filter("false").select("entity", F.lit("").alias("surrogate"))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text column, plus n_entities and kinds (entities by kind)."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or secrets.token_hex(16)
    keep = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    mark = uuid.uuid4().hex  # names that no column of the table has
    own_, found_, text_ = f"_own{mark}", f"_found{mark}", f"_text{mark}"
    body = F.col(f"`{text}`")
    taken = exceptions(docs, text, key)
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    none = F.create_map().cast("map<string,string>")
    if taken.isEmpty():
        rows = base.withColumn(own_, none)
    else:
        hashed = base.withColumn(text_, F.sha2(body, 256))
        hit = hashed.select(text_, body.alias("body")).distinct().select(text_, F.explode(F.array_distinct(entities(F.col("body")))).alias("entity")).join(taken, "entity")
        maps = hit.groupBy(text_).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(own_))
        rows = hashed.join(maps, text_, "left").drop(text_).withColumn(own_, F.coalesce(own_, none))
    rows = rows.withColumn(found_, entities(body))
    gaps = F.split(body, ANY, -1)
    put = F.transform(F.col(found_), lambda e: F.coalesce(F.col(own_)[e], surrogate(e, key, F.lit(0))))
    joined = F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    kinds = F.transform(F.col(found_), kind_of)
    return rows.select(
        *[(F.when(F.size(found_) > 0, joined).otherwise(body).alias(c) if c == text else F.col(f"`{c}`")) for c in keep],
        F.coalesce(F.size(found_), F.lit(0)).cast("long").alias("n_entities"),
        F.when(F.size(found_) > 0, F.array_join(F.array_sort(kinds), ",")).otherwise("").alias("kinds"),
    )
