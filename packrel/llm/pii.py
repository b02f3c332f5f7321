"""Personal data replaced by surrogates (DataFrame functions only).

Entities are found by one pattern, evaluated once a text: e-mail addresses, IPv4 and IPv6 addresses,
phones (international and national), cards, IBANs, social security numbers, hexadecimal secrets and
persons behind titles.  Each distinct entity, in its canonical form, gets a surrogate made from a keyed
hash of type, form and attempt: digits for digits, letters for letters of the same case, hexadecimal for
hexadecimal, cards and IBANs with valid check digits, addresses of the same reach (private or public).

A person is one entity whatever the titles, with the gender on which its titles agree; a full name's
surrogate is a given name of that gender and the surrogate of its surname, in the name's script, so that
a title with the surname alone says the same surname.  Full names that some title makes known are
replaced without titles too.

All surrogates are checked in one table: one that two entities share, or that is itself an entity of the
corpus, of whatever type, is drawn anew (all but the least entity's), until there is none.  So distinct
entities stay distinct, and all mentions of an entity, however written, agree; a mention's own
punctuation, case and title stay.

Mentions are joined to the entity table in lanes, as one entity may stand in a third of all rows;
only rows with mentions are joined again by row number, and only their texts are rebuilt.

Defined cases: null text stays null, text without entities stays as it is; 16-digit numbers and IBANs
with wrong check digits are left alone; names without any title in the corpus are not known as persons;
a full and a shortened spelling of one IPv6 address, or a national and an international one of one
phone, are entities of their own; null ids and repeated rows are rows like any other; other columns stay
(their names don't matter); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lanes, materialize, partitions, shielded, spread_join

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEXTET = r"[0-9A-Fa-f]{1,4}"
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]
_TITLES = "|".join([*MALE, *FEMALE, "Dr", "Prof"])
_NAME = r"\p{Lu}[\p{L}'-]{1,30}(?![\p{L}\d])"
_EMAIL = r"(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
#: Each alternative first looks at one character, as most places of a text begin none.
_REST = "|".join(
    [
        r"(?=[0-9(+])(?:"
        + "|".join(
            [
                rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
                r"(?<![\w+])\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,4}(?!\d)",
                r"(?<![\w.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\w-])",
                r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
                r"(?<![\w+.-])(?:\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}([-.])\d{3}\1\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![\w-])",
            ]
        )
        + ")",
        r"(?=[0-9a-f])(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
        rf"(?=[0-9A-Fa-f:])(?<![\w:])(?:(?:{_HEXTET}:){{7}}{_HEXTET}|(?={_HEXTET}:|::)(?=(?:::?{_HEXTET}|{_HEXTET}::?){{3}})(?:{_HEXTET}(?::{_HEXTET}){{0,5}})?::(?:{_HEXTET}(?::{_HEXTET}){{0,5}})?)(?![\w:])",
        r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        rf"(?=[\p{{Lu}}г])(?<![\p{{L}}\d])(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|{_NAME} {_NAME})",
    ]
)
PATTERN = f"{_EMAIL}|{_REST}"
#: Parts mentions from the rest while a text is cut; no text that holds it is cut that way.
_MARK = "\ue000\uf8ff\ue000"
_NAMES = {
    "latin": {
        "m": ["Alan", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon"],
        "f": ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Klara", "Laura"],
        "s": ["ba", "den", "fol", "gar", "hel", "kin", "lor", "man", "nes", "pol", "ran", "sel", "tor", "ven", "wil", "zan"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"],
        "f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Мария"],
        "s": ["бо", "вол", "гор", "дан", "жар", "зим", "кол", "лев", "мир", "ник", "пол", "рос", "сав", "тим", "фед", "шев"],
    },
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the check over a string of digits, the last one being the check digit."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)

    def part(i):
        v = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(at, part), F.lit(0), lambda a, v: a + v)


def _mod97(iban: Column) -> Column:
    """Of an IBAN without blanks: its country and check digits last, letters as two digits."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest, c):
        v = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^({_TITLES})\.? ", 1)


def gender_of(m: Column) -> Column:
    """m, f or null, by a mention's title."""
    return F.when(_title(m).isin(MALE), "m").when(_title(m).isin(FEMALE), "f")


def kind_of(m: Column) -> Column:
    """Of a mention: surname where a title has one name only; name for two names without a title."""
    bare = F.upper(F.regexp_replace(m, " ", ""))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(F.startswith(m, F.lit("+")), "phone")
        .when(_title(m) != "", F.when(F.regexp_replace(m, rf"^({_TITLES})\.? ", "").contains(" "), "person").otherwise("surname"))
        .when(m.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]{4}"), F.when(_mod97(bare) == 1, "iban").otherwise("number"))
        .when(m.rlike(r"^\p{Lu}[\p{L}'-]+ \p{Lu}"), "name")
        .when(F.contains(m, F.lit(":")), "ipv6")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(F.length(m) >= 32, "token")
        .when(F.length(_digits(m)) < 16, "phone")
        .when(_luhn(_digits(m)) % 10 == 0, "card")
        .otherwise("number")
    )


def canonical(kind: Column, m: Column) -> Column:
    name = F.lower(F.regexp_replace(m, rf"^({_TITLES})\.? ", ""))
    return (
        F.when(kind.isin("phone", "card", "ssn"), _digits(m))
        .when(kind.isin("person", "surname", "name"), name)
        .when(kind.isin("email", "ipv6"), F.lower(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0, cyclic) of the 64 bytes in 128 hexadecimal digits, as int."""
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(x: Column, stream: Column) -> Column:
    """Digit for digit, letter for letter of the same case; the rest stays."""
    letters, numbers = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")

    def one(i):
        c = F.substring(x, i + 1, F.lit(1))
        b = _byte(stream, i)
        return F.when(c.rlike("[0-9]"), F.substring(numbers, b % 10 + 1, F.lit(1))).when(c.rlike("[a-z]"), F.substring(letters, b % 26 + 1, F.lit(1))).when(c.rlike("[A-Z]"), F.upper(F.substring(letters, b % 26 + 1, F.lit(1)))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(x) - 1), one), "")


def _hexed(x: Column, stream: Column) -> Column:
    """A hexadecimal digit, not 0, for each; the rest stays."""
    one = lambda i: F.when(F.substring(x, i + 1, F.lit(1)).rlike("[0-9a-f]"), F.substring(F.lit("123456789abcdef"), _byte(stream, i) % 15 + 1, F.lit(1))).otherwise(F.substring(x, i + 1, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(x) - 1), one), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str, gender: Column | None = None, surname: Column | None = None) -> Column:
    """The canonical form of an entity's replacement; a person's needs its gender (or null) and its surname's replacement."""
    h = F.sha2(F.concat_ws("\u001f", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)
    drawn = F.concat(F.substring(canon, 1, 1), F.substring(_alike(canon, h), F.lit(2), F.length(canon)))
    body = F.substring(drawn, F.lit(1), F.length(canon) - 1)
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    country, rest = F.substring(canon, 1, 2), F.substring(_alike(canon, h), F.lit(5), F.length(canon))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0"), rest)
    octet = lambda i, n, low: (_byte(h, F.lit(i)) * 256 + _byte(h, F.lit(i + 20))) % n + low
    tail = F.concat_ws(".", *[octet(i, 254, 1).cast("string") for i in (1, 2, 3)])
    private = canon.rlike(r"^(10|127)\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.")
    first = octet(0, 194, 11)  # 11 to 204
    first = F.when(first.isin(127, 172, 192), first + 1).otherwise(first)
    ip = F.when(private, F.concat(F.lit("10."), tail)).otherwise(F.concat_ws(".", first.cast("string"), tail))
    # Unique-local and link-local prefixes stay, as does the first group's leading digit elsewhere.
    kept = F.when(canon.rlike("^(f[cd]|fe[89ab])"), 4).otherwise(1)
    ipv6 = F.concat(F.substring(canon, F.lit(1), kept), F.substring(_hexed(canon, h), kept + 1, F.length(canon)))
    # The last label of an address's host stays.
    host = F.substring_index(canon, ".", -1)
    front = F.substring(canon, F.lit(1), F.length(canon) - F.length(host))
    email = F.concat(_alike(front, h), host)
    pick = lambda names, i: F.array(*map(F.lit, names))[_byte(h, F.lit(i)) % len(names)]
    cyrillic = canon.rlike("[Ѐ-ӿ]")

    def last(pools):
        return F.initcap(F.concat(*[pick(pools["s"], i) for i in range(1, 6)], *[F.when(attempt > k, pick(pools["s"], 6 + k)).otherwise("") for k in range(4)]))

    def given(pools):
        def names(pool):  # later attempts take double and threefold names
            return F.concat(pick(pool, 0), *[F.when(attempt > k, F.concat(F.lit("-"), pick(pool, 16 + k))).otherwise("") for k in range(4)])

        return F.when(gender == "m", names(pools["m"])).when(gender == "f", names(pools["f"])).otherwise(names(pools["m"] + pools["f"]))

    script = lambda f: F.when(cyrillic, f(_NAMES["cyrillic"])).otherwise(f(_NAMES["latin"]))
    out = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", ipv6)
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind.isin("phone", "ssn"), drawn)
        .when(kind == "token", F.substring(h, F.lit(1), F.length(canon)))
        .when(kind == "surname", script(last))
    )
    return out if surname is None else out.when(kind == "person", F.concat(script(given), F.lit(" "), surname))


def _write_as(kind: Column, m: Column, new: Column) -> Column:
    """The replacement in a mention's own punctuation, case and title."""
    at = F.sequence(F.lit(1), F.length(m))

    def sign(i):
        c = F.substring(m, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, before, F.lit(1))).otherwise(c)

    def cased(i):
        c = F.substring(new, i, F.lit(1))
        return F.when(F.substring(m, i, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)

    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), F.array_join(F.transform(at, sign), ""))
        .when(kind == "email", F.array_join(F.transform(at, cased), ""))
        .when(kind.isin("person", "surname", "name"), F.concat(F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1), new))
        .otherwise(new)
    )


def _distinct_surrogates(entities: DataFrame, draw, taken: DataFrame | None, rounds: int) -> DataFrame:
    """entities: distinct kind and canon, and what ``draw`` needs.  Adds surrogate: none is shared, an entity, or in ``taken`` (low)."""
    spark = entities.sparkSession
    now = entities.repartition(partitions(spark), "kind", "canon").withColumn("attempt", F.lit(0))
    real = [F.lower("canon").alias("low")]
    known = entities.select(*real) if taken is None else entities.select(*real).unionByName(taken)
    for _ in range(rounds):
        now = materialize(now.withColumn("new", draw(F.col("attempt"))).withColumn("low", F.lower("new")), "surrogates")
        who = F.struct("kind", "canon")
        shared = now.groupBy("low").agg(F.min(who).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        hit = now.select("low").join(known, "low", "left_semi").distinct().withColumn("least", F.lit(None).cast(shared.schema["least"].dataType))
        bad = materialize(shared.unionByName(hit), "clashes")
        if bad.isEmpty():
            return now.drop("attempt", "low").withColumnRenamed("new", "surrogate")
        again = now.join(bad, "low").filter(~who.eqNullSafe(F.col("least"))).select("kind", "canon", F.lit(1).alias("more")).distinct()
        now = now.drop("new", "low").join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    raise RuntimeError(f"surrogates still clash after {rounds} rounds")


def entity_table(entities: DataFrame, key: str, rounds: int = 32) -> DataFrame:
    """entities: distinct kind and canon, with gender.  kind, canon, surrogate: no two alike over all kinds, and none an entity."""
    last = F.regexp_extract("canon", r"(\S+)$", 1)
    persons = entities.filter("kind = 'person'").withColumn("last", last)
    others = entities.filter("kind <> 'person'").select("kind", "canon").unionByName(persons.select(F.lit("surname").alias("kind"), F.col("last").alias("canon"))).distinct()
    others = materialize(others, "entities")
    full = persons.select(F.lower("canon").alias("low"))
    named = _distinct_surrogates(others, lambda n: surrogate(F.col("kind"), F.col("canon"), n, key), full, rounds)
    surnames = named.filter("kind = 'surname'").select(F.col("canon").alias("last"), F.col("surrogate").alias("surname"))
    whole = materialize(persons.join(surnames, "last").select("kind", "canon", "gender", "surname"), "persons")
    taken = named.select(F.lower("canon").alias("low")).unionByName(named.select(F.lower("surrogate").alias("low")))
    full = _distinct_surrogates(whole, lambda n: surrogate(F.col("kind"), F.col("canon"), n, key, F.col("gender"), F.col("surname")), taken, rounds)
    return named.select("kind", "canon", "surrogate").unionByName(full.select("kind", "canon", "surrogate"))


def _cut(text: Column) -> Column:
    """A text's parts: those at odd places (from 0) are mentions.  The pattern is evaluated once, unless the text holds the mark."""
    found = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERN, f"{_MARK}$0{_MARK}")).otherwise(F.regexp_replace(text, _REST, f"{_MARK}$0{_MARK}"))
    mentions, rest = F.regexp_extract_all(text, F.lit(PATTERN), 0), F.split(text, PATTERN, -1)
    slow = F.flatten(F.zip_with(rest, mentions, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    return F.when(F.contains(text, F.lit(_MARK)), slow).otherwise(F.split(found, _MARK, -1))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with rewritten texts, and n_entities (mentions replaced).

    key: the secret from which surrogates are made; equal keys give equal surrogates.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows, own, back = shielded(docs)
    text = own[text_col]
    rows = rows.withColumn("__parts", _cut(F.col(text))).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.withColumn("__hit", F.coalesce(F.size("__parts") > 1, F.lit(False)))
    # Parts take the text's place where there are any.
    rows = materialize(rows.withColumn("__parts", F.when(F.col("__hit"), F.col("__parts"))).withColumn(text, F.when(~F.col("__hit"), F.col(text))), "mentions")
    odd = F.filter("__parts", lambda _, i: i % 2 == 1)
    said = rows.filter("__hit").select("__row", F.posexplode(odd).alias("__at", "__said")).withColumn("kind", kind_of(F.col("__said")))
    said = said.withColumn("canon", canonical(F.col("kind"), F.col("__said"))).withColumn("gender", gender_of(F.col("__said"))).filter("kind <> 'number'")
    said = materialize(said, "said")
    entities = said.filter("kind <> 'name'").groupBy("kind", "canon").agg(F.min("gender").alias("a"), F.max("gender").alias("z"))
    table = entity_table(entities.select("kind", "canon", F.when(F.col("a") == F.col("z"), F.col("a")).alias("gender")), key)
    named = table.select(F.struct(F.col("kind").alias("k"), F.col("canon").alias("c")).alias("__entity"), "surrogate")
    lane = F.pmod(F.xxhash64("__row", "__at"), F.lit(lanes(docs.sparkSession)))
    entity = F.struct(F.when(F.col("kind") == "name", "person").otherwise(F.col("kind")).alias("k"), F.col("canon").alias("c"))
    found = spread_join(said.withColumn("__entity", entity), "__entity", named, lane).filter("surrogate IS NOT NULL")
    new = F.struct("__at", _write_as(F.col("kind"), F.col("__said"), F.col("surrogate")).alias("__new"))
    per_row = found.groupBy("__row").agg(F.map_from_entries(F.collect_list(new)).alias("__news"), F.count(F.lit(1)).alias("__n"))
    # Mentions without a surrogate (names of nobody known, wrong check digits) stay as they are.
    part = F.transform("__parts", lambda x, i: F.when(i % 2 == 1, F.coalesce(F.col("__news")[F.floor(i / 2).cast("int")], x)).otherwise(x))
    rest = [n for n in own.values() if n != text]
    changed = rows.filter("__hit").join(per_row, "__row", "left").select(*rest, F.array_join(part, "").alias(text), F.coalesce("__n", F.lit(0)).cast("long").alias("__count"))
    same = rows.filter("NOT __hit").select(*rest, text, F.lit(0).cast("long").alias("__count"))
    return changed.unionByName(same).select(*back, F.col("__count").alias("n_entities"))
