"""Surrogates for personal data, by DataFrame operations only.

One regular expression finds the entities of a whole text, in one pass. Numbers, addresses and
secrets are entities by their canonical form (digits only, or lower case); a name after a title is
taken apart into given names and the family name, each an entity of its own. So all mentions of one
person, number or address, however written, get the same surrogate everywhere, and a family name's
surrogate doesn't depend on the given name. In a document with a titled name, the capitalised mentions
of its words without a title are replaced too.

A surrogate comes from a keyed digest of kind, canonical form and attempt, character by character:
digits become digits, letters become letters of their script (in names vowels become vowels), signs
stay. Card numbers that pass the Luhn check get surrogates that pass it; given names end as is common
for the title's gender; family names keep an ending that tells the gender. A given name after a title
for any gender has the surrogate it has elsewhere.

Collision check: a surrogate that equals another entity's surrogate, or any entity of the corpus, is
drawn anew with the next attempt, until none is left; all numbers are one space in this, and all words
of names another. So distinct entities stay distinct and no surrogate names someone real in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, spread_join, written

# A match starts only where a run of its characters starts, and gives nothing back, so that long runs cost one pass.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"""(?<=["'])(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[ ]{0,3}[=:][ ]{0,3}["'])[^"'\s]{8,}(?=["'])"""
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])[.]){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![.]?\w)"
CARD = r"(?<![\w.])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![.]?\w)"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
PHONE = r"(?<![\w.])(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{2,4}[)][ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?!\w)"
_MALE = r"Mr|Herrn?|Monsieur|Señor|Sr|господин|Г-н|κύριος"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|госпожа|Г-жа|κυρία"
_ANY = r"Dr|Prof|Professor|Doctor|Doktor|доктор|профессор"
TITLE = rf"(?<!\w)(?=[MHFSDPгГκдп])(?:{_MALE}|{_FEMALE}|{_ANY})[.]?(?: (?:Dr|Prof)[.]?)*+(?= )"
# words that may stand between the words of a name, and capitalised ones that end it
_PARTICLE = r"von|van|de|del|der|den|di|da|la|le|zu|dos"
_OTHER = r"The|And|But|For|From|With|This|That|Der|Die|Das|Und|Ist|Les|Une|Est|Los|Las|Una"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:[-'’]\p{L}{2,})*+"
NAME = rf"{TITLE}(?:(?: (?:{_PARTICLE}))* (?!(?:{_OTHER})\b){_WORD}){{1,3}}+"
FOUND = "|".join(f"(?:{x})" for x in (EMAIL, SECRET, rf"(?=[0-9+(])(?:{'|'.join((IP, SSN, CARD, PHONE))})", NAME))
#: Every text is a row of these.
_TOKEN = r"\p{L}(?:['’]\p{Lu})?\p{L}*+(?:[-'’]\p{L}{2,})*+|[^\p{L}]++"
DIGITS = ("card", "phone", "ssn")
#: Endings of given names, by script and gender; fixed by custom.
ENDINGS = {
    ("latin", "given_m"): "o n r s k d l t".split(), ("latin", "given_f"): "a e ia ina".split(),
    ("cyrillic", "given_m"): "н р к л т й".split(), ("cyrillic", "given_f"): "а я ия".split(),
    ("greek", "given_m"): "ος ης ας".split(), ("greek", "given_f"): "α η ία".split(),
}
#: Endings of family names that tell the gender.
_KEPT = "(?:ова|ева|ёва|ина|ская|цкая|ский|цкий|ов|ев|ёв|ин|ος|ης|ας|ου)$"
#: Draws for one entity before the space of its form counts as used up.
ATTEMPTS = 64


def kind_of(entity: Column) -> Column:
    """The kind of an entity that :data:`FOUND` found."""
    whole = lambda rx: entity.rlike(f"^(?:{rx})$")
    return (
        F.when(whole(EMAIL), "email").when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(CARD), "card").when(whole(PHONE), "phone")
        .when(whole(NAME), "name").otherwise("secret")
    )


def canonical(kind: Column, entity: Column) -> Column:
    """What all spellings of an entity share."""
    return F.when(kind.isin(*DIGITS), F.regexp_replace(entity, "[^0-9]", "")).when(kind.isin("secret", "ip"), entity).otherwise(F.lower(entity))


def space_of(kind: Column) -> Column:
    """What a kind's surrogates must differ within."""
    return F.when(kind.isin(*DIGITS), "digits").when(kind.rlike("^(given|family)"), "word").otherwise(kind)


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i`` of a hexadecimal digest, repeated as often as needed."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at % len(letters) + 1, F.lit(1))


def _redraw(text: Column, digest: Column) -> Column:
    """Every letter and digit replaced by one of its class and script; all else stays.

    A number in hexadecimal stays one.
    """
    hexadecimal = text.rlike("^(?=.*[0-9])[0-9a-f]{8,}$")

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(hexadecimal, _pick("abcdef", b))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", b)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike("[а-яё]"), _pick("абвгдежзийклмнопрстуфхцчшщыэюя", b)).when(c.rlike("[А-ЯЁ]"), _pick("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", b))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Ll}]"), _pick("αβγδεζηθικλμνξοπρστυφχψω", b)).when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), _pick("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", b))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _rename(word: Column, digest: Column) -> Column:
    """Every letter of a lower-case name replaced by a vowel or consonant of its script, as it is one."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return (
            F.when(c.rlike("[aeiouy]"), _pick("aeiou", b)).when(c.rlike("[a-z]"), _pick("bcdfghklmnprstvw", b))
            .when(c.rlike("[аеёиоуыэюя]"), _pick("аеиоуя", b)).when(c.rlike("[а-я]"), _pick("бвгдзклмнпрстфх", b))
            .when(c.rlike("[αεηιουωάέήίόύώ]"), _pick("αεηιοω", b)).when(c.rlike(r"\p{IsGreek}"), _pick("βγδζθκλμνπρστφχ", b))
            .when(c.rlike(r"\p{IsLatin}"), _pick("aeioubdklmnrst", b)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(word, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, from the right."""
    doubled = lambda c, i: F.when(i % 2 == 1, c * 2 - F.when(c > 4, 9).otherwise(0)).otherwise(c)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form in the given attempt."""
    said = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, *parts, attempt.cast("string")).cast("binary"), 512)
    h = said(canon)
    plain = _redraw(canon, h)
    head = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = ((10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(_luhn(canon) % 10 == 0, F.concat(head, check)).otherwise(plain)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(h, i) % 254 + 1).cast("string")), ".")
    phone = F.concat(F.substring(canon, 1, 1), F.substring(plain, F.lit(2), F.length(plain)))  # the leading digit is the country or the trunk
    suffix = F.regexp_extract(canon, r"[.][a-z0-9-]+$", 0)
    email = F.concat(_redraw(F.substring(canon, F.lit(1), F.length(canon) - F.length(suffix)), h), suffix)
    script = F.when(canon.rlike(r"\p{IsCyrillic}$"), "cyrillic").when(canon.rlike(r"\p{IsGreek}$"), "greek").otherwise("latin")
    renamed = _rename(canon, h)
    ending = F.coalesce(*[F.when((script == s) & (kind == k), F.element_at(F.array(*[F.lit(e) for e in ends]), _byte(h, F.lit(63)) % len(ends) + 1)) for (s, k), ends in ENDINGS.items()], F.lit(""))
    given = F.concat(F.substring(renamed, F.lit(1), F.greatest(F.lit(2), F.length(renamed) - F.length(ending))), ending)
    kept = F.regexp_extract(canon, _KEPT, 0)
    family = F.concat(F.substring(renamed, F.lit(1), F.length(renamed) - F.length(kept)), kept)
    out = F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "email", email).when(kind == "family", family).when(kind.startswith("given"), given).otherwise(plain)
    # a form too short to have room for all is lengthened after some attempts
    more = F.when(attempt > 5, F.substring(F.when(kind.isin(*DIGITS), F.regexp_replace(h, "[a-f]", "")).otherwise(F.regexp_replace(h, "[0-9]", "")), F.lit(1), attempt - 4)).otherwise("")
    return F.when(kind == "ip", out).when(kind.isin("email", "family") | kind.startswith("given"), F.concat(more, out)).otherwise(F.concat(out, more))


def _cased(mention: Column, surrogate: Column) -> Column:
    """The surrogate with capitals where the mention has them."""
    return F.when((mention == F.upper(mention)) & (F.length(mention) > 1), F.upper(surrogate)).when(mention == F.lower(mention), surrogate).otherwise(
        F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    )


def render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the layout of one mention: its separators, or its capitals."""
    laid = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    spare = F.substring(surrogate, F.length(F.regexp_replace(mention, "[^0-9]", "")) + 1, F.length(surrogate))
    return F.when(kind.isin(*DIGITS), F.concat(laid, spare)).when(kind.isin("secret", "ip"), surrogate).otherwise(_cased(mention, surrogate))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for a table (kind, canon); distinct, and disjoint from all entities, within a space."""
    real = written(entities.select("kind", "canon", space_of(F.col("kind")).alias("space")).distinct(), "entities")
    pending, accepted = real.withColumn("attempt", F.lit(0)), None
    for _ in range(ATTEMPTS):
        drawn = pending.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        drawn = drawn.join(real.select("space", F.col("canon").alias("surrogate"), F.lit(True).alias("taken")).distinct(), ["space", "surrogate"], "left")
        if accepted is not None:
            drawn = drawn.join(accepted.select("space", "surrogate", F.lit(True).alias("given")), ["space", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("given", F.lit(None).cast("boolean"))
        first = F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("kind", "canon")) == 1
        drawn = written(drawn.withColumn("ok", first & F.col("taken").isNull() & F.col("given").isNull()).select("kind", "canon", "space", "attempt", "surrogate", "ok"), "surrogates")
        done = drawn.filter("ok").select("kind", "canon", "space", "surrogate")
        accepted = done if accepted is None else accepted.unionByName(done)
        pending = drawn.filter("not ok").select("kind", "canon", "space", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return accepted.drop("space")
    raise ValueError("the surrogates of a form are used up")


def _units(mentions: DataFrame) -> DataFrame:
    """Mentions (row, pos, mention, kind) to their units: row, pos, sub, unit, kind, canon, before.

    A name's words are units, and what is in front of one belongs to it; any other mention is one unit.
    """
    title = F.regexp_extract("mention", f"^(?:{TITLE})", 0)
    gender = F.when(title.rlike(rf"^(?:{_MALE})(?![\w-])"), "given_m").when(title.rlike(rf"^(?:{_FEMALE})(?![\w-])"), "given_f").otherwise("given_u")
    words = F.split(F.substring("mention", F.length("title") + 2, F.length("mention")), " ")
    named = mentions.filter("kind = 'name'").withColumn("title", title).withColumn("gender", gender).select("row", "pos", "title", "gender", F.posexplode(words).alias("sub", "unit"), F.size(words).alias("n"))
    part = F.when(~F.col("unit").rlike(r"^\p{Lu}"), "as_is").when(F.col("sub") == F.col("n") - 1, "family").otherwise(F.col("gender"))
    named = named.select("row", "pos", "sub", "unit", part.alias("kind"), F.lower("unit").alias("canon"), F.when(F.col("sub") == 0, F.concat("title", F.lit(" "))).otherwise(" ").alias("before"))
    kind = F.col("kind")
    plain = mentions.filter("kind <> 'name'").select("row", "pos", F.lit(0).alias("sub"), F.col("mention").alias("unit"), "kind", canonical(kind, F.col("mention")).alias("canon"), F.lit("").alias("before"))
    return named.unionByName(plain)


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its entities replaced by surrogates.

    Keeps all columns, with the new text, and adds n_entities and kinds (sorted, distinct). Rows
    without entities keep their text byte by byte; a null text stays null with no entities; an
    empty table gives an empty result. Repeated rows and very long texts need no care: rows are
    handled one by one, and of a text's entities only the mentions are shuffled, and no entity's
    mentions meet in one task. Ids aren't looked at, so they may be null or repeat; columns may have
    any names.
    """
    n, kinds, row, ents, parts, new, words = fresh(docs, "n_entities", "kinds", "wl_row", "wl_entities", "wl_parts", "wl_new", "wl_words")
    found = F.expr(f"regexp_extract_all({_quoted(text_col)}, {_literal(FOUND)}, 0)")
    marked = written(docs.withColumns({row: F.monotonically_increasing_id(), ents: F.coalesce(found, F.array().cast("array<string>"))}), "entity_rows")
    clean = marked.filter(F.size(ents) == 0).withColumns({n: F.lit(0).cast("long"), kinds: F.array().cast("array<string>")}).drop(row, ents)
    hit = marked.filter(F.size(ents) > 0)
    mentions = hit.select(F.col(row).alias("row"), F.posexplode(ents).alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    units = written(_units(mentions), "units")
    total = units.count()
    entities = written(units.filter("kind <> 'as_is'").groupBy("kind", "canon").agg(F.count("*").alias("times")), "entity_counts")
    # a given name of unknown gender is the one of known gender, if there is one
    known = entities.filter("kind in ('given_m', 'given_f')").groupBy("canon").agg(F.min("kind").alias("as"))
    real = entities.join(known, "canon", "left").select("kind", "canon", "times", F.when(F.col("kind") == "given_u", F.coalesce("as", F.lit("given_u"))).otherwise(F.col("kind")).alias("as"))
    real = written(real, "real")
    table = surrogate_table(real.select(F.col("as").alias("kind"), "canon"), key).withColumnRenamed("kind", "as")
    names = written(real.join(table, ["as", "canon"]).select("kind", "canon", "times", "surrogate"), "names")
    dealt = spread_join(units, names, ["kind", "canon"], "times", total).repartition("row")
    dealt = dealt.withColumn("new", F.concat("before", F.coalesce(render(F.col("kind"), F.col("unit"), F.col("surrogate")), F.col("unit"))))
    dealt = written(dealt.select("row", "pos", "sub", "kind", "canon", "surrogate", "new"), "dealt")
    label = F.when(F.col("kind").rlike("^(given|family)"), "name").otherwise(F.col("kind"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "new"))), lambda x: x["new"]), "")
    by_pos = dealt.groupBy("row", "pos").agg(joined.alias("new"), F.max(F.when(F.col("kind") != "as_is", label)).alias("kind"))
    by_row = by_pos.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias(new), F.array_sort(F.collect_set("kind")).alias(kinds))
    of_names = dealt.filter(label == "name").groupBy("row", "canon").agg(F.min(F.struct("kind", "surrogate"))["surrogate"].alias("s"))
    of_names = of_names.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("canon", "s"))).alias(words))
    by_row = by_row.join(of_names, "row", "left").withColumnRenamed("row", row)
    both = hit.join(by_row, row).withColumn(parts, F.split(F.col(text_col), FOUND, -1))
    # mentions without a title, between the entities, of the names of this text
    swap = lambda t: F.when(t.rlike(r"^\p{Lu}"), F.try_element_at(F.col(words), F.lower(t)))
    tokens = lambda p: F.regexp_extract_all(p, F.lit(f"({_TOKEN})"), F.lit(1))
    rest = F.transform(parts, lambda p: F.array_join(F.transform(tokens(p), lambda t: F.coalesce(_cased(t, swap(t)), t)), ""))
    more = F.aggregate(F.transform(parts, lambda p: F.size(F.filter(tokens(p), lambda t: swap(t).isNotNull()))), F.lit(0), lambda a, x: a + x)
    both = both.withColumns({parts: F.when(F.col(words).isNull(), F.col(parts)).otherwise(rest), n: (F.size(ents) + F.when(F.col(words).isNull(), 0).otherwise(more)).cast("long")})
    text = F.array_join(F.flatten(F.zip_with(parts, F.col(new), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    return clean.unionByName(both.withColumn(text_col, text).select(clean.columns))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
