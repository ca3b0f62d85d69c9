"""Surrogates for personal data, with DataFrame functions only.

One pattern finds entities: e-mail addresses, phone numbers, IPv4 and IPv6
addresses, payment cards, account numbers (IBAN), social security numbers,
access keys and tokens with a known prefix, passwords and tokens after a label
(with a letter or digit in them), and names after one or more titles: up to five
words with a capital, with particles, hyphens, apostrophes and initials. Each
gets a replacement
drawn from SHA-256 of a secret key, the type and the entity's canonical form, so
it is the same wherever the entity occurs and in whichever layout (coreference);
the local part and the host of an address, and the words of a name, are
replaced each for itself. A name that was found after a title is replaced in the
whole document, with a title or without: as a sequence, and its words alone
unless they are ordinary words (COMMON) or follow a determiner. Replacements
keep the type, length, layout, character classes and check sums of cards (their
class) and of account numbers; names keep the gender of their title, their
script, their particles and whether they are in capitals.

Collision checks run over the distinct entities of the whole table: no two
entities of a type may share a replacement and no replacement may be a real
entity. Entities that fail draw again; from the attempt GROWN on, and where an
entity holds no letter or digit to draw, replacements grow by characters, so
that every table gets distinct ones. Replacements are made once for each
distinct entity and joined to the documents that hold it.

The key decides all replacements: whoever knows it can recompute them, so it has
no default.

Defined cases: a null text stays null and has no entities; texts without
entities are returned as they are; long texts are searched whole; repeated rows
get equal replacements; rows that share an id are judged by their own text; an
empty table gives an empty result; a column of the table that is called as the
result's (``out``) is replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import fresh, written

# Titles by gender, particles of names, words before which no name
# stands, ordinary words that are names too, and what names are composed of by script.
MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Don|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Mademoiselle|Señora|Señorita|Sra|Doña|госпожа"
NEUTRAL = "Dr|Doctor|Doktor|Docteur|Prof|Professor|Professeur|Profesor|Rev|Reverend|доктор|профессор"
PARTICLES = "de|del|della|da|das|do|dos|di|du|van|von|der|den|ter|ten|zu|la|le|los|bin|ibn|al|el|y"
DETERMINERS = "the|a|an|this|that|these|those|my|your|his|her|its|our|their|der|die|das|den|dem|ein|eine|le|la|les|un|une|el|los|las|una"
COMMON = "will bill mark may june april august rose grace hope faith joy art frank rich grant chase page young white black brown green gray king long short small wood woods stone hill field fields river rivers bank banks price cook baker day summer winter north south east west lake park street church bush bond cross wise strong bright good best love pace early case drew pat rob sue jack guy miles dean earl duke noble gold silver"
SYLLABLES = {
    "latin": "ba be bo da de do fa ga go ka ke ko la le lo ma me mo na ne no ra re ri ro sa se ta te ti va vi",
    "cyrillic": "ба бе бо да де до фа га го ка ке ко ла ле ло ма ме мо на не но ра ре ри ро са се та те ти ва ви",
    "greek": "βα βε βο δα δε δο φα γα γο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρι ρο σα σε τα τε τι βα βι",
}
ENDINGS = {
    ("latin", "given_m"): "n r s",
    ("latin", "given_f"): "na ria lia",
    ("latin", "surname"): "nd rt ss",
    ("cyrillic", "given_m"): "н р с",
    ("cyrillic", "given_f"): "на рия лия",
    ("cyrillic", "surname"): "нд рт сс",
    ("greek", "given_m"): "ς ν ρ",
    ("greek", "given_f"): "να ρια λια",
    ("greek", "surname"): "νδς ρτς λλς",
}
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}\p{M}._%+\-]++@[\p{L}\p{N}](?:[\p{L}\p{N}\-]*+\.)+\p{L}{2,}"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?(?=[_\-+/.!@#$%^&*]*[A-Za-z0-9])[A-Za-z0-9_\-+/.!@#$%^&*]{6,}"
_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
_TOKEN = r"(?<![A-Za-z0-9_\-])(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{30,}|glpat-[A-Za-z0-9_\-]{16,})"
_IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
_ABROAD = r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
#: National layouts: an area code in parentheses, three-three-four digits, and
#: a leading 0 with two or three further groups.
_HOME = r"(?<![\p{L}\d.+\-(])(?:\(0?\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}|0\d{1,4}(?:[ .\-]\d{3,4}){2}|0\d{2,4}[ .\-/]\d{5,8}|0\d(?:[ .\-]\d{2}){4})(?![\d]|[.\-]\d)"
#: Ten digits in a row, as a number of the American plan without signs.
_PLAIN = r"(?<![\p{L}\d.,+\-/_#:=])[2-9]\d{9}(?![\p{L}\d_]|[.,\-/:]\d)"
_PHONE = rf"(?:{_ABROAD}|{_HOME}|{_PLAIN})"
_CARD = r"(?<![\d.])(?:\d{4}(?:[ \-]?\d{4}){3}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?!\d)"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d])"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![\p{{L}}\d:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::{_HEX}(?::{_HEX}){{0,6}})(?![\p{{L}}\d:])"


def _with_capitals(words: str) -> str:
    """The words as they are, and in capitals."""
    return "|".join(dict.fromkeys(x for w in words.split("|") for x in (w, w.upper())))


_TITLE = _with_capitals(f"{MALE}|{FEMALE}|{NEUTRAL}")
#: A title begins a word; its first letter is looked at before all titles are tried.
_TITLED = rf"(?<!\p{{L}})(?=[{''.join(sorted({t[0] for t in _TITLE.split('|')}))}])(?:{_TITLE})\.? "
_WORD = r"(?:\p{Lu}\.(?= ?\p{Lu})|\p{Lu}(?:[\p{L}\p{M}]|['’\-](?=\p{L}{2}))*+)"
_NAME = rf"(?:{_TITLED}){{1,3}}(?:(?:{PARTICLES}) ){{0,2}}{_WORD}(?: (?:(?:{PARTICLES}) ){{0,2}}{_WORD}){{0,4}}"
PATTERN = "|".join([_SECRET, _EMAIL, _KEY, _TOKEN, _IBAN, _PHONE, _CARD, _SSN, _IP, _IP6, _NAME])
#: Every entity holds one of these; a text without any is not searched.
QUICK = rf"[@0-9]|AKIA|gh[pousr]_|github_pat_|sk-|xox|AIza|glpat-|[=:]\s{{0,2}}[\"']?[A-Za-z0-9_\-+/.!@#$%^&*]|{_TITLED}\p{{L}}"
_DIGITS = ["phone", "card", "ssn"]
#: Attempts from which on replacements grow.
GROWN = 6


def kind_of(e: Column) -> Column:
    whole = lambda p: e.rlike(f"^(?:{p})$")
    return F.when(whole(_SECRET), "secret").when(whole(_EMAIL), "email").when(whole(_KEY), "key").when(whole(_TOKEN), "token").when(whole(_IBAN), "iban").when(whole(_PHONE), "phone").when(whole(_CARD), "card").when(whole(_SSN), "ssn").when(whole(_IP), "ip").when(whole(_IP6), "ip6").otherwise("name")


def _prefix(e: Column) -> Column:
    """What comes before the secret value: its label, sign and quote."""
    return F.regexp_extract(e, r"^([A-Za-z_\-]+\s{0,2}[=:]\s{0,2}[\"']?)", 1)


def _words(e: Column) -> Column:
    return F.split(e, " ")


def _stays(w: Column) -> Column:
    """Titles and particles, which a name's replacement keeps."""
    return w.rlike(rf"^(?:{_TITLE}|{PARTICLES})\.?$")


def parts(e: Column) -> Column:
    """The units of an entity that get surrogates: structs of kind and canon."""
    kind = kind_of(e)
    unit = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    given = F.when(e.rlike(rf"(?:^| )(?:{_with_capitals(FEMALE)})(?:\.| )"), "given_f").otherwise("given_m")
    words = F.filter(_words(e), lambda w: ~_stays(w))
    name = F.transform(words, lambda w, i: unit(F.when(i + 1 < F.size(words), given).otherwise(F.lit("surname")), F.lower(F.rtrim(w, F.lit(".")))))
    email = F.array(unit(F.lit("local"), F.lower(F.substring_index(e, "@", 1))), unit(F.lit("host"), F.lower(F.substring_index(e, "@", -1))))
    canon = F.when(kind == "secret", F.substring(e, F.length(_prefix(e)) + 1, F.length(e))).when(kind.isin(_DIGITS), F.regexp_replace(e, r"\D", "")).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind == "ip6", F.lower(e)).otherwise(e)
    return F.when(kind == "name", name).when(kind == "email", email).otherwise(F.array(unit(kind, canon)))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Hexadecimal keyed random digits, two for each character of canon."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil((F.length(canon) + 8) / 32).cast("int")), lambda b: F.sha2(F.concat(seed, F.lit("\x1f"), b.cast("string")).cast("binary"), 256)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, r: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(r, F.lit(len(alphabet))) + 1, F.lit(1))


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _same_classes(s: Column, stream: Column) -> Column:
    """Each character replaced by one of its class; hexadecimal stays so. Letters
    beyond a to z become letters of a to z."""
    hexa = s.rlike("^[0-9a-f:]+$")
    one = lambda c, i: F.when(c.rlike(r"\p{Nd}"), _pick("0123456789", _byte(stream, i))).when(c.rlike(r"[\p{Ll}\p{Lo}\p{Lm}]"), F.when(hexa, _pick("abcdef", _byte(stream, i))).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", _byte(stream, i)))).when(c.rlike(r"[\p{Lu}\p{Lt}]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _byte(stream, i))).otherwise(c)
    return F.array_join(F.transform(_chars(s), one), "")


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10, counted from the right."""
    back = F.reverse(digits)
    return F.pmod(F.aggregate(F.transform(_chars(back), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))), F.lit(0), lambda a, x: a + x), F.lit(10))


def _mod97(s: Column) -> Column:
    """The remainder that the check digits of an account number go by; letters
    count from 10."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + value(c), F.lit(97)))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of a canonical form."""
    stream = _stream(key, kind, canon, attempt)
    mapped = _same_classes(canon, stream)
    bare = ~canon.rlike(r"[\p{L}\p{Nd}]")
    grown = F.greatest(attempt - F.lit(GROWN - 1), F.when(bare, attempt + 4).otherwise(F.lit(0)), F.lit(0))
    digits = F.substring(F.translate(stream, "abcdef", "012345"), F.lit(3), grown)
    more = F.translate(digits, "0123456789", "bcdfghklmn")
    host = F.concat(_same_classes(F.regexp_replace(canon, r"\.[^.]+$", ""), stream), more, F.lit("."), F.substring_index(canon, ".", -1))
    octet = lambda i: (F.pmod(_byte(stream, F.lit(i)), F.lit(223)) + 1 if not i else _byte(stream, F.lit(i))).cast("string")
    ip = F.concat(F.concat_ws(".", *[octet(i) for i in range(4)]), F.when(grown > 0, F.concat(F.lit("-"), digits)).otherwise(F.lit("")))
    phone = F.concat(F.substring(canon, F.lit(1), F.lit(1)), (F.pmod(_byte(stream, F.lit(1)), F.lit(8)) + 2).cast("string"), F.substring(mapped, F.lit(3), F.length(canon)))
    body = F.concat(F.substring(canon, F.lit(1), F.lit(1)), F.substring(mapped, F.lit(2), F.length(canon) - 2))
    card = F.concat(body, F.pmod(_luhn(canon) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    before = F.regexp_extract(canon, r"^(github_pat_|gh[pousr]_|sk-|xox[abprs]-|AIza|glpat-)", 1)
    token = F.concat(before, F.substring(mapped, F.length(before) + 1, F.length(canon)), more)
    account = F.concat(F.substring(mapped, F.lit(5), F.length(canon)), digits)
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((98 - _mod97(F.concat(account, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0"), account)
    access = F.concat(F.lit("AKIA"), F.substring(mapped, F.lit(5), F.length(canon)))
    script = lambda s: _name(s, kind, stream, attempt)
    name = F.when(canon.rlike(r"\p{IsCyrillic}"), script("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), script("greek")).otherwise(script("latin"))
    return F.when(kind == "host", host).when(kind.isin("local", "secret"), F.concat(mapped, more)).when(kind == "ip", ip).when(kind == "phone", F.concat(phone, digits)).when(kind == "card", F.concat(card, digits)).when(kind == "key", F.concat(access, F.upper(more))).when(kind == "ssn", F.concat(mapped, digits)).when(kind == "token", token).when(kind == "iban", iban).when(kind == "ip6", F.concat(mapped, digits)).otherwise(name)


def _name(script: str, kind: Column, stream: Column, attempt: Column) -> Column:
    """Syllables and an ending of the gender; later attempts are longer."""
    syllables = F.array(*[F.lit(x) for x in SYLLABLES[script].split()])
    stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 4).cast("int")), lambda i: F.get(syllables, F.pmod(_byte(stream, i), F.size(syllables)))), "")
    end = lambda k: F.get(F.array(*[F.lit(x) for x in ENDINGS[script, k].split()]), F.pmod(_byte(stream, F.lit(30)), F.lit(3)))
    return F.concat(stem, F.when(kind == "given_f", end("given_f")).when(kind == "given_m", end("given_m")).otherwise(end("surname")))


def _laid_out(e: Column, digits: Column) -> Column:
    """digits in the places of e's digits; what is left of them at the end."""
    place = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), r"\D", ""))
    laid = F.array_join(F.transform(_chars(e), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")
    return F.concat(laid, F.substring(digits, F.length(F.regexp_replace(e, r"\D", "")) + 1, F.length(digits)))


def rendered(e: Column, kind: Column, got: Column) -> Column:
    """An entity's replacement as it stands in the text, from the surrogates
    of its units."""
    first = F.get(got, F.lit(0))
    tokens = _words(e)
    at = lambda i: F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda w: ~_stays(w))) - 1
    name = F.array_join(F.transform(tokens, lambda w, i: F.when(_stays(w), w).otherwise(_as_written(w, F.get(got, at(i))))), " ")
    spaced = F.array_join(F.transform(_chars(e), lambda c, i: F.when(c == " ", c).otherwise(F.substring(first, F.length(F.replace(F.substring(e, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    iban = F.concat(spaced, F.substring(first, F.length(F.replace(e, F.lit(" "), F.lit(""))) + 1, F.length(first)))
    upper = lambda c: F.when(e == F.upper(e), F.upper(c)).otherwise(c)
    return F.when(kind == "secret", F.concat(_prefix(e), first)).when(kind.isin(_DIGITS), _laid_out(e, first)).when(kind == "email", upper(F.array_join(got, "@"))).when(kind == "name", name).when(kind == "iban", iban).when(kind == "ip6", upper(first)).otherwise(first)


def _as_written(word: Column, name: Column) -> Column:
    """A name as the word is written: an initial, in capitals, or neither."""
    initial = F.concat(F.upper(F.substring(name, 1, 1)), F.lit("."))
    return F.when(word.rlike(r"^\p{Lu}\.$"), initial).when((F.length(word) > 1) & (word == F.upper(word)), F.upper(name)).otherwise(F.initcap(name))


def _mentions(e: Column, kind: Column, got: Column) -> Column:
    """w, s of what else stands for a name: its words one after the other, if
    there are several, and each word alone that is no initial and not COMMON;
    of words in capitals also the form with one."""
    words = F.filter(_words(e), lambda w: ~_stays(w))
    both = F.zip_with(words, got, lambda w, s: F.struct(w.alias("w"), _as_written(w, s).alias("s")))
    untitled = F.concat_ws(" ", *[F.filter(_words(e), lambda w: ~w.rlike(rf"^(?:{_TITLE})\.?$"))])
    whole = F.array(F.struct(untitled.alias("w"), F.regexp_replace(rendered(e, kind, got), rf"^(?:(?:{_TITLE})\.? )+", "").alias("s")))
    alone = F.filter(both, lambda x: ~x["w"].rlike(r"^\p{Lu}\.?$") & ~F.lower(x["w"]).isin(*COMMON.split()))
    other = F.transform(F.filter(alone, lambda x: x["w"] == F.upper(x["w"])), lambda x: F.struct(F.initcap(F.lower(x["w"])).alias("w"), F.initcap(F.lower(x["s"])).alias("s")))
    return F.when(kind == "name", F.concat(F.when(F.size(words) > 1, whole).otherwise(F.slice(whole, 1, 0)), alone, other))


def _settle(units: DataFrame, key: str, most: int) -> DataFrame:
    """kind, canon, s: a replacement for every entity, no two alike."""
    draw = surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))
    # entities are few bytes and much work: the number of partitions is given
    spread = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(units.repartition(spread, "kind", "canon").withColumn("attempt", F.lit(0)).withColumn("s", draw), "surrogates")
    real = units.select("kind", F.col("canon").alias("s")).withColumn("real", F.lit(True))
    for _ in range(most):
        # the smallest entity keeps a contested replacement
        shared = rows.groupBy("kind", "s").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("owner")).join(real, ["kind", "s"], "left").where("n > 1 or real")
        shared = written(shared.select("kind", "s", "owner", F.coalesce("real", F.lit(False)).alias("real")), "contested")
        if shared.isEmpty():
            return rows.select("kind", "canon", "s")
        moved = rows.join(shared, ["kind", "s"], "left")
        again = F.col("owner").isNotNull() & (F.col("real") | (F.col("canon") != F.col("owner.canon")))
        moved = moved.withColumn("attempt", F.col("attempt") + F.when(again, 1).otherwise(0)).select("kind", "canon", "attempt", F.when(~again, F.col("s")).alias("s"))
        rows = written(moved.repartition(spread, "kind", "canon").withColumn("s", F.coalesce("s", draw)), "surrogates")
    raise ValueError(f"surrogates still collide after {most} attempts")


def replacements(found: DataFrame, key: str, most_attempts: int) -> DataFrame:
    """e, r, words: a replacement for each distinct entity string of found (e),
    and for names each word's."""
    rows = found.select("e").distinct().withColumn("kind", kind_of(F.col("e"))).withColumn("units", parts(F.col("e")))
    rows = written(rows, "entities")
    flat = rows.select("e", "kind", F.posexplode("units").alias("pos", "u")).select("e", "kind", "pos", F.col("u.kind").alias("unit"), "u.canon")
    settled = _settle(flat.select(F.col("unit").alias("kind"), "canon").distinct(), key, most_attempts)
    got = flat.join(settled.withColumnRenamed("kind", "unit"), ["unit", "canon"]).groupBy("e", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("got"))
    got = got.select("e", "kind", F.transform("got", lambda g: g["s"]).alias("got"))
    e, kind = F.col("e"), F.col("kind")
    return written(got.select("e", rendered(e, kind, F.col("got")).alias("r"), _mentions(e, kind, F.col("got")).alias("words")), "replacements")


#: Before a word alone: determiners, with a capital or without.
_DETERMINED = "|".join(dict.fromkeys(x for w in DETERMINERS.split("|") for x in (w, w.capitalize())))


def _longest_first(words: Column) -> Column:
    """So that a whole name is met before its words."""
    return F.transform(F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x["w"])).alias("n"), x["w"].alias("w"), x["s"].alias("s")))), lambda x: F.struct(x["w"].alias("w"), x["s"].alias("s")))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", most_attempts: int = 64, out: str = "n_entities") -> DataFrame:
    """docs with text_col rewritten and a column ``out``, the number of entities
    found. The texts are searched once; only those that hold entities meet the
    replacements, the others pass."""
    text = F.col(text_col)
    place, hits, made, words = (fresh(docs, c) for c in ("place", "hits", "made", "words"))
    listed = F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rows = written(docs.withColumn(hits, F.coalesce(listed, F.array().cast("array<string>"))), "searched")
    holds = F.size(hits) > 0
    some = rows.where(holds).withColumn(place, F.xxhash64(F.col(id_col), text))
    pairs = some.select(place, F.explode(F.array_distinct(hits)).alias("e")).distinct().join(replacements(some.select(F.explode(hits).alias("e")), key, most_attempts), "e")
    maps = pairs.groupBy(place).agg(F.map_from_entries(F.collect_list(F.struct("e", "r"))).alias(made), _longest_first(F.array_distinct(F.flatten(F.collect_list("words")))).alias(words))
    here = some.join(written(maps, "maps"), place)
    # a word stands alone, not in another one, and after no determiner; 's may follow
    lone = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{M}'’\-])(?<!(?<!\p{L})(?:" + _DETERMINED + r") )"), F.lit(r"\Q"), w, F.lit(r"\E"), F.lit(r"(?![\p{L}\p{M}]|-\p{L}|['’]\p{L}{2})"))
    plain = lambda t: F.aggregate(F.col(words), t, lambda acc, w: F.when(F.contains(acc, w["w"]), F.regexp_replace(acc, lone(w["w"]), w["s"])).otherwise(acc))
    between = F.transform(F.split(text, PATTERN, -1), plain)
    new = F.array_join(F.flatten(F.zip_with(between, F.col(hits), lambda a, b: F.array(a, F.coalesce(F.try_element_at(made, b), F.lit(""))))), "")
    columns = [c for c in docs.columns if c != out]
    here = here.withColumn(text_col, new).select(*columns, F.size(hits).cast("long").alias(out))
    return here.unionByName(rows.where(~holds).select(*columns, F.lit(0).cast("long").alias(out)))
