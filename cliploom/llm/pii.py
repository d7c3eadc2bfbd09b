"""Personal data replaced by surrogates of the same kind, in DataFrame operations alone.

Patterns find e-mail addresses, phone, card and social security numbers, bank accounts, IP addresses, keys and
other secrets, and names after titles. A surrogate is computed from a keyed hash of the entity:

* same kind and format: digits for digits, letters for letters in their case and script, the same separators;
  countries, top-level domains and key prefixes stay, card numbers pass their check digit, octets stay in range;
* names keep their titles, and given names the gender that the title tells;
* same entity, same surrogate, in all documents and spellings (case, separators, with or without the given name);
* other entity, other surrogate: all surrogates of the corpus are compared with each other and with all
  entities, and those that meet are drawn again until none do.

Texts are not moved to be looked up: tasks compute surrogates in place, and only redrawn ones are joined.
"""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import fresh, kept, kept_narrow
from cliploom.operators.sizing import broadcast_if_small

DRAWS = 30  # draws of a surrogate before it becomes a hash in brackets, which is longer than its format allows

# Titles with the gender they tell.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor",
    "f": "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita",
    "n": "Dr Prof Doctor Professor Doktor",
}
_TITLE = "|".join(" ".join(TITLES.values()).split())
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SECRET_NAMES = "token|password|passwd|pwd|secret|api_key|apikey|access_key"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,24}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<=[=\"]|[:=] )(?<=(?i:{_SECRET_NAMES})[\"']? {{0,2}}[=:] {{0,2}}[\"']?)[A-Za-z0-9+/_\-]{{6,}}",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.[0-9])",
    "ssn": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "card": r"(?<![\w.\-+])[0-9](?:[ \-]?[0-9]){12,18}(?!\w)",
    "phone": r"(?<![\w.+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?[0-9]{3,4}[ .\-]?[0-9]{3,4}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})"
    r"|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5})(?!\w)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+)?",
}
# No entity starts inside a word: most places of a text are passed over by one look back.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"

# Syllables that names are made of, by script; a given name ends by gender.
_SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke la le lo ma me mo na no ra re ro sa se so ta te to va vi wa", {"m": "n", "f": "a", "n": "is"}),
    "cyrillic": ("ба ве го да же за ки ло ма не по ра со ту фи хо ца ше ба ри", {"m": "н", "f": "я", "n": "ис"}),
    "greek": ("βα γε δο ζα θε κι λο μα νε πο ρα σι το φα χο", {"m": "ς", "f": "α", "n": "ις"}),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def kind_of(entity: Column) -> Column:
    """Kind of a string that a pattern has found."""
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(rf"^(?:{_TITLE})\.? "), "name")
        .when(entity.rlike(r"^AKIA[0-9A-Z]{16}$"), "key")
        .when(entity.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(entity.rlike(r"^[0-9](?:[ \-]?[0-9]){12,18}$"), "card")
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(entity.rlike(r"^[+(0-9][0-9 ().\-]{6,}$"), "phone")
        .otherwise("secret")
    )


def parts(entity: Column) -> Column:
    """array<struct<kind, canon>>: what stands for one person or thing in a found string. Spellings of one entity agree in both.

    A name's last word is the surname; a given name before it is an entity of its own.
    """
    kind = kind_of(entity)
    compact = F.upper(F.regexp_replace(entity, r"[^0-9A-Za-z+]", ""))
    canon = F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "ssn", "iban"), compact).otherwise(entity)
    words = F.split(entity, " ")
    surname = F.struct(F.lit("surname").alias("kind"), F.lower(F.element_at(words, -1)).alias("canon"))
    given = F.struct(F.concat(F.lit("given "), _gender(F.element_at(words, 1))).alias("kind"), F.lower(F.element_at(words, 2)).alias("canon"))
    names = F.when(F.size(words) > 2, F.array(given, surname)).otherwise(F.array(surname))
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*TITLES["m"].split()), "m").when(bare.isin(*TITLES["f"].split()), "f").otherwise("n")


def _stream(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """128 hexadecimal digits that depend on the key and on all arguments."""
    seed = F.concat_ws("\u001f", F.lit(key), kind, canon, draw.cast("string"))
    return _let(F.sha2(seed, 256), lambda first: F.concat(first, F.sha2(first, 256)))


def _number(stream: Column, at: Column) -> Column:
    """A number from 0 to 65535 for each place."""
    return F.conv(F.substring(stream, F.pmod(at * 3, F.lit(124)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _scrambled(canon: Column, stream: Column, keep: Column) -> Column:
    """Each character for another of its class; the first ``keep`` stay."""
    hexadecimal = canon.rlike("^[0-9a-f]+$")

    def other(char: Column, at: Column) -> Column:
        letters = (
            F.when((at < keep) | ~char.rlike("[0-9A-Za-z]"), char)
            .when(char.rlike("[0-9]"), "0123456789")
            .when(char.rlike("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            .when(char.rlike("[a-f]") & hexadecimal, "abcdef")
            .otherwise("abcdefghijklmnopqrstuvwxyz")
        )
        return _let(letters, lambda own: F.substring(own, F.pmod(_number(stream, at), F.length(own)) + 1, F.lit(1)))

    return F.array_join(F.transform(F.split(canon, ""), other), "")


def _checked(digits: Column) -> Column:
    """Digits with the last one replaced by the check digit of payment cards."""
    body = F.split(F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1)), "")

    def weigh(char: Column, at: Column) -> Column:
        doubled = char.cast("int") * F.when(at % 2 == 0, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(body, weigh), F.lit(0), lambda a, b: a + b)
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _octets(canon: Column, stream: Column) -> Column:
    """Octets of as many digits, from 1 to 249."""

    def other(octet: Column, at: Column) -> Column:
        number = _number(stream, at)
        return (
            F.when(F.length(octet) == 1, 1 + F.pmod(number, F.lit(9)))
            .when(F.length(octet) == 2, 10 + F.pmod(number, F.lit(90)))
            .otherwise(100 + F.pmod(number, F.lit(150)))
            .cast("string")
        )

    return F.array_join(F.transform(F.split(canon, r"\."), other), ".")


def _made_up(kind: Column, canon: Column, stream: Column, draw: Column) -> Column:
    """A name of the script of the original: syllables, and by gender the end of a given name. Later draws are longer."""
    gender = F.substring(kind, -1, 1)

    def in_script(script: str) -> Column:
        text, ends = _SYLLABLES[script]
        syllables = F.split(F.lit(text), " ")
        count = 3 + F.floor(draw / 8).cast("int")
        chosen = F.transform(
            F.sequence(F.lit(1), count), lambda at: F.element_at(syllables, (F.pmod(_number(stream, at), F.lit(len(text.split()))) + 1).cast("int"))
        )
        end = F.when(gender == "m", ends["m"]).when(gender == "f", ends["f"]).otherwise(ends["n"])
        return F.concat(F.array_join(chosen, ""), F.when(kind == "surname", "").otherwise(end))

    cyrillic, greek = canon.rlike(r"\p{IsCyrillic}"), canon.rlike(r"\p{IsGreek}")
    return F.when(cyrillic, in_script("cyrillic")).when(greek, in_script("greek")).otherwise(in_script("latin"))


def surrogate(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """Surrogate of a canonical entity. After ``DRAWS`` draws it is a hash in brackets: no longer of the format, but distinct."""
    tld = F.substring_index(canon, ".", -1)
    local = F.substring(canon, F.lit(1), F.length(canon) - F.length(tld) - 1)
    stays = F.when(kind == "key", 4).when(kind == "iban", 2).when(kind == "card", 1).when((kind == "phone") & canon.startswith("+"), 2).otherwise(0)

    def drawn(stream: Column) -> Column:
        scrambled = _scrambled(F.when(kind == "email", local).otherwise(canon), stream, stays)
        return (
            F.when(draw >= DRAWS, F.concat(F.lit("["), F.substring(stream, 1, 32), F.lit("]")))
            .when(kind == "email", F.concat(scrambled, F.lit("."), tld))
            .when(kind == "ip", _octets(canon, stream))
            .when(kind == "card", _let(scrambled, _checked))
            .when(kind.startswith("given") | (kind == "surname"), _made_up(kind, canon, stream, draw))
            .otherwise(scrambled)
        )

    return _let(_stream(key, kind, canon, draw), drawn)


def _in_format(entity: Column, found: Column) -> Column:
    """A surrogate in the spelling of the entity: its separators, its upper case."""
    plain = F.regexp_replace(entity, r"[^0-9A-Za-z+]", "")
    chars = F.split(entity, "")

    def char(own: Column, at: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(entity, F.lit(1), at + 1), r"[^0-9A-Za-z+]", ""))
        return F.when(own.rlike("[0-9A-Za-z+]"), F.substring(found, place, F.lit(1))).otherwise(own)

    same_length = F.length(found) == F.length(plain)
    return F.when(same_length, F.array_join(F.transform(chars, char), "")).otherwise(found)


def _cased(original: Column, found: Column) -> Column:
    """Found (lower case) in the case of the original: all upper, first upper, or as it is."""
    return F.when((F.upper(original) == original) & (F.length(original) > 1), F.upper(found)).when(
        F.upper(F.substring(original, 1, 1)) == F.substring(original, 1, 1), F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, F.lit(2), F.length(found)))
    ).otherwise(found)


def _mail_case(entity: Column, found: Column) -> Column:
    """Character by character: surrogates of addresses have the length of the original."""

    def char(own: Column, at: Column) -> Column:
        new = F.substring(found, at + 1, F.lit(1))
        return F.when(own.rlike("[A-Z]"), F.upper(new)).otherwise(new)

    return F.when(F.length(entity) == F.length(found), F.array_join(F.transform(F.split(entity, ""), char), "")).otherwise(found)


def replacement(key: str, entity: Column, redrawn: Column) -> Column:
    """What a found string becomes. ``redrawn`` maps "kind canon" to the number of a later draw."""

    def of(part: Column) -> Column:
        draw = F.coalesce(redrawn[F.concat_ws(" ", part["kind"], part["canon"])], F.lit(0))
        return surrogate(key, part["kind"], part["canon"], draw)

    def spelled(found: Column) -> Column:
        first, words = found[0], F.split(entity, " ")
        given = F.when(F.size(found) > 1, _cased(words[1], first))
        name = F.concat_ws(" ", words[0], given, _cased(F.element_at(words, -1), F.element_at(found, -1)))
        kind = kind_of(entity)
        return (
            F.when(kind == "name", name)
            .when(kind == "email", _mail_case(entity, first))
            .when(kind.isin("phone", "card", "ssn", "iban"), _in_format(entity, first))
            .otherwise(first)
        )

    return _let(F.transform(parts(entity), of), spelled)


def redrawn(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, draw) of the entities whose first surrogate is another entity, or another one's surrogate.

    Of entities that meet in a surrogate the smallest keeps it. Each round compares all surrogates anew,
    so later draws cannot meet settled ones either. ``entities``: distinct (kind, canon), written already.
    Tables are no more files than their rows need, whatever the number of shuffle partitions.
    """
    rows = entities.count()
    drawn = entities.withColumn("draw", F.lit(0)).withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.lit(0)))
    drawn = kept_narrow(drawn, "surrogates", rows)
    taken = entities.select(F.col("kind").alias("k"), F.col("canon").alias("new"))
    for turn in range(DRAWS + 1):
        by_surrogate = drawn.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("draw", "canon")).alias("first"))
        meets = by_surrogate.where("n > 1").select(F.col("kind").alias("k"), "new", F.col("first.canon").alias("keeper"))
        real = by_surrogate.select(F.col("kind").alias("k"), "new").join(taken, ["k", "new"], "left_semi").withColumn("keeper", F.lit(None).cast("string"))
        clash = meets.join(real.select("k", "new"), ["k", "new"], "left_anti").unionByName(real)
        losers = drawn.join(clash, (F.col("kind") == F.col("k")) & (drawn["new"] == clash["new"])).where("keeper IS NULL OR canon != keeper")
        losers = kept_narrow(losers.select("kind", "canon", (F.col("draw") + 1).alias("draw")), "losers", rows)
        if losers.isEmpty():
            break
        again = losers.withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.col("draw")))
        settled = drawn.join(losers.select("kind", "canon"), ["kind", "canon"], "left_anti")
        drawn = kept_narrow(settled.unionByName(again), "surrogates", rows)
    return drawn.where("draw > 0").select("kind", "canon", "draw")


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon) of all texts."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("entity")).distinct()
    return found.select(F.explode(parts(F.col("entity"))).alias("part")).select("part.kind", "part.canon").distinct()


def pseudonymized(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with surrogates in ``text``, and the number of replaced strings in a column named ``count`` if that is given.

    Texts without entities, empty and null ones are unchanged (null ones count 0). All other columns and all rows stay.
    """
    known = kept(entities(docs), "entities")
    again = kept(redrawn(known, key), "redrawn")
    found, later, id_ = fresh(docs, "entities"), fresh(docs, "redrawn"), fresh(docs, "id")
    rows = docs.withColumn(found, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    draws = F.lit(None).cast("map<string,int>")
    if not again.isEmpty():
        rows = rows.join(_draws_per_document(docs, again, id_, later), F.col("doc_id").eqNullSafe(F.col(id_)), "left").drop(id_)
        draws = F.col(later)
    gaps = F.split("text", ANY, -1)
    new = F.concat(F.transform(found, lambda e: replacement(key, e, draws)), F.array(F.lit("")))
    text = F.array_join(F.zip_with(gaps, new, lambda gap, e: F.concat(gap, e)), "")
    columns = [F.when(F.size(found) > 0, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    counted = [F.coalesce(F.size(found), F.lit(0)).cast("bigint").alias(count)] if count else []
    return rows.select(*columns, *counted)


def _draws_per_document(docs: DataFrame, again: DataFrame, id_: str, later: str) -> DataFrame:
    """Per doc_id, the later draws its text needs; only documents with a redrawn entity have a row."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))).alias("entity"))
    found = found.select("doc_id", F.explode(parts(F.col("entity"))).alias("part")).select("doc_id", "part.kind", "part.canon")
    needed = found.join(broadcast_if_small(again), ["kind", "canon"]).distinct()
    pair = F.struct(F.concat_ws(" ", "kind", "canon"), "draw")
    per_document = needed.groupBy(F.col("doc_id").alias(id_)).agg(F.map_from_entries(F.collect_list(pair)).alias(later))
    return broadcast_if_small(kept(per_document, "draws"))
