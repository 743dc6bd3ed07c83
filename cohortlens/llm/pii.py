"""Surrogates for personal data, by native expressions only.

Entities are found by patterns: mail addresses, network addresses of both versions, phone, card and social security
numbers, bank accounts, access keys, secrets and titled names with their initials and particles.  A number counts as a
card's only with a valid check digit, and four numbers behind the word "version" are no address.  A secret is what is
assigned to a name like "password" or "token": anything in quotes, else eight characters with one that is no letter, or
sixteen.  Each distinct entity receives a surrogate drawn from a keyed hash, of the same type and format: digits for
digits, letters for letters, valid check digits for valid ones (cards and bank accounts), and for names the same script
and gender.  Mentions of one entity have one surrogate in all texts; the names of a text's titled persons are found in
that text without their title, too.

Draws are checked for collisions: a surrogate that another entity of any kind holds, or that is itself an entity of
the corpus, is drawn again until all are distinct; later draws are longer, so that there is room for any number.

Persons without a title anywhere in their text are not found, nor are postal addresses, dates of birth, or
secrets that stand without a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.work import unused, written

# Titles of persons by gender.
MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "κυρία"]
NEUTRAL = ["Dr", "Prof"]

# Syllables and endings of invented names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke la le li lo ma me mi na ne ni ra re ri ro sa se si ta te ti va ve vi".split(),
    "cyrillic": "ба бе бо да де до ка ла ле ли ма ме ми на не ни ра ре ри ро са се си та те ти ва ве ви".split(),
    "greek": "βα βε δα δε δο κα λα λε λι μα με μι να νε νι ρα ρε ρι ρο σα σε σι τα τε τι".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "na", "n": "s", "surname": "ler"},
    "cyrillic": {"m": "н", "f": "на", "n": "й", "surname": "ко"},
    "greek": {"m": "ς", "f": "νη", "n": "ν", "surname": "κης"},
}

# Words between a person's names that are no names.
PARTICLES = "von van vom zu zur der den de del della di da dos du la le ter ten bin ibn al el af".split()

_TITLES = [*MALE, *FEMALE, *NEUTRAL]
_TITLES += [t.upper() for t in _TITLES]
_TITLE = "|".join(sorted(_TITLES, key=len, reverse=True))
_PARTICLE = f"(?:{'|'.join(PARTICLES)})"
# A name or an initial, particles before it; possessive, so that no name is too long.
_NAME = rf"(?:{_PARTICLE} ){{0,3}}(?:\p{{Lu}}\.|\p{{Lu}}[\p{{L}}'’-]++)"

# The whole value of a secret, to its closing quote or white space: marks that end a sentence or bracket are left
# out at its end, and so is what follows as the next ``name=``.  Possessive, so that no length is too long.
_MARKS = r"&;,.!?:)\]}>"
_VALUE = (
    rf"(?:[^\s\"'{_MARKS}]++|(?![{_MARKS}]*+(?<=[&;,])[\w-]{{1,40}}+[=:])[{_MARKS}]++(?=[^\s\"']))++"
)

#: Type and pattern of every kind of entity; where two match at one place, the first counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
    rf"(?:(?<=\")[^\"\n]{{4,}}+(?=\"|$)|(?<=')[^'\n]{{4,}}+(?='|$)"
    rf"|(?=[^\s\"']{{8}})(?=[^\s\"']{{0,127}}[^\p{{L}}\s\"'{_MARKS}]|[^\s\"']{{16}}){_VALUE})",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16,}+|(?:sk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:])(?=[0-9A-Fa-f:]{0,40}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![\w:])",
    "ip": r"(?<![\w.])(?<!(?:[Vv]ersion|VERSION|[Rr]elease) )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_SECRET_HEAD = r"^[^=:]*[=:]\s{0,3}[\"']?"

#: The first draws have an entity's own length; every further one has a character more and so ten times the room.
SAME_LENGTH = 3


_TITLED = rf"^(?:{_TITLE})\.? "
_NAME_END = r"(?:['’][sS])?[-'’]*$"
_INITIAL = r"^\p{Lu}\.$"


def _bare(mentions: Column) -> Column:
    """Pattern of the names of all titled persons among the mentions, in runs and any case but a first small letter.

    Null without such persons.  Where one name begins another, the longer comes first.
    """
    persons = F.filter(mentions, lambda m: m.rlike(_TITLED))
    words = F.flatten(F.transform(persons, lambda m: F.split(F.regexp_replace(m, _TITLED, ""), " ")))
    names = F.transform(words, lambda w: F.lower(F.regexp_replace(w, _NAME_END, "")))
    known = {*PARTICLES, *(t.lower() for t in _TITLES)}
    names = F.filter(F.array_distinct(names), lambda n: (F.length(n) > 1) & ~n.endswith(".") & ~n.isin(*sorted(known)))

    def pattern(names: Column) -> Column:
        name = F.concat(F.lit(r"(?=\p{Lu})(?iu:"), F.array_join(F.sort_array(names, asc=False), "|"), F.lit(r")(?![\p{L}@])"))
        return F.when(
            F.size(names) > 0, F.concat(F.lit(r"(?<!\p{L})"), name, F.lit("(?: "), name, F.lit("){0,2}"))
        )

    return _let(names, pattern)


def _pattern(bare: Column) -> Column:
    """Pattern of all entities of a text, given that of its bare names."""
    return F.when(bare.isNull(), F.lit(_ANY)).otherwise(F.concat(F.lit(f"{_ANY}|"), bare))


def entities(text: Column) -> Column:
    """Struct ``found`` and ``bare`` of a text: all entities as they are written, in order, null for a null text;
    and the pattern of the names that count without a title, or null."""

    def again(first: Column) -> Column:
        def whole(bare: Column) -> Column:
            found = F.when(bare.isNull(), first).otherwise(F.regexp_extract_all(text, _pattern(bare), F.lit(0)))
            return F.struct(found.alias("found"), bare.alias("bare"))

        return _let(_bare(first), whole)

    return _let(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), again)


#: What a pattern finds but a closer look does not confirm, and particles of names: they stay as they are.
KEPT = "kept"


def _type(mention: Column) -> Column:
    found = F.lit("person")
    for name in reversed([n for n in PATTERNS if n != "person"]):
        found = F.when(mention.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(found)
    return found


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _script(word: Column) -> Column:
    return (
        F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    )


def _tokens(mention: Column) -> Column:
    """The entities of a mention as structs ``kind`` and ``canon``; what is none after all is of the kind ``KEPT``.

    A person has one for each name, so that the surname alone is still the same person; anything else has one.
    Names without a title have the role ``bare`` until :func:`_settled` gives them one.
    """
    titled = mention.rlike(_TITLED)
    title = F.regexp_replace(F.get(F.split(mention, " "), F.lit(0)), r"\.$", "")
    said = F.upper(title)
    gender = F.when(said.isin(*(t.upper() for t in MALE)), "m").when(said.isin(*(t.upper() for t in FEMALE)), "f")
    gender = gender.otherwise("n")
    names = F.split(F.regexp_replace(mention, _TITLED, ""), " ")
    # One name behind a title may be a first name or a surname.
    last = F.when(F.size(names) == 1, "only").otherwise("surname")

    def name(word: Column, i: Column) -> Column:
        role = F.when(~titled, "bare").when(word.rlike(_INITIAL), "n").when(i == F.size(names) - 1, last).otherwise(gender)
        kind = F.when(word.isin(*PARTICLES), KEPT).otherwise(F.concat(F.lit("name."), _script(word), F.lit("."), role))
        return F.struct(kind.alias("kind"), F.lower(F.regexp_replace(word, _NAME_END, "")).alias("canon"))

    kind = _type(mention)
    kind = F.when((kind == "card") & (_checked(_digits(mention)) != 0), KEPT).otherwise(kind)
    canon = (
        F.when(kind.isin("email", "ipv6"), F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), _digits(mention))
        .when(kind == "secret", F.regexp_replace(mention, _SECRET_HEAD, ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    # A secret may be written with or without its name; its value is the entity.
    one = F.array(F.struct(kind.alias("kind"), canon.alias("canon")))
    return F.when(kind == "person", F.transform(names, name)).otherwise(one)


def _settled(parts: DataFrame) -> DataFrame:
    """``parts`` (``k``, ``kind``, ``canon``, …) with one role for names after a neutral title or none.

    A neutral first name has the gender that the same name has elsewhere in its text, if it is one; a name
    without a title is the surname or first name that its text knows.
    """
    is_name = F.col("kind").startswith("name.")
    stem = F.regexp_extract("kind", r"^name\.[a-z]+\.", 0)
    role = F.regexp_extract("kind", r"[a-z]+$", 0)
    same = Window.partitionBy("k", stem, "canon")
    has = {r: F.max(role == r).over(same) for r in ("surname", "m", "f", "n")}
    gender = F.when(has["m"] & ~has["f"], "m").when(has["f"] & ~has["m"], "f").otherwise("n")
    is_first = ~has["surname"] & (has["m"] | has["f"] | has["n"])
    settled = F.when(role == "n", gender).when(role.isin("bare", "only"), F.when(is_first, gender).otherwise("surname"))
    names = parts.where(is_name).withColumn("kind", F.concat(stem, F.coalesce(settled, role)))
    return parts.where(~is_name).unionByName(names)


def _byte(stream: Column, i: Column) -> Column:
    """The ``i``-th byte of a hash written in hex, from 0."""
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class _Stream:
    """Keyed bytes for a value, in blocks of 64 written in hex: as many as the value is long."""

    def __init__(self, key: str, salt: str, kind: Column, what: Column):
        # A long value is hashed once, not for every block.
        self._seed = F.when(F.length(what) > 128, F.sha2(what, 512)).otherwise(what)
        self._head, self._kind = (F.lit(key), F.lit(salt)), kind

    def _block(self, seed: Column, i: Column) -> Column:
        key, salt = self._head
        return F.sha2(F.concat_ws("\u0001", key, F.concat(salt, i.cast("string")), self._kind, seed), 512)

    def start(self) -> Column:
        """The first 128 bytes."""
        return F.concat(*(self._block(self._seed, F.lit(i)) for i in range(2)))

    def by_piece(self, value: Column, use: Callable[[Column, Column], Column], size: int = 64) -> Column:
        """``use(piece, block)`` of all pieces of ``size`` characters of a value, joined."""
        pieces = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        done = lambda seed: F.transform(
            pieces, lambda piece, i: _let(self._block(seed, i), lambda block: use(piece, block))
        )
        return F.array_join(_let(self._seed, done), "")


def _shaped(value: Column, stream: _Stream) -> Column:
    """Drawn letters for letters and digits for digits; anything else stays."""

    def piece(chars: Column, block: Column) -> Column:
        def drawn(c: Column, i: Column) -> Column:
            b = _byte(block, i)
            letter = lambda first: F.char(F.lit(ord(first)) + b % 26)
            return (
                F.when(c.between("0", "9"), (b % 10).cast("string"))
                .when(c.between("a", "z"), letter("a"))
                .when(c.between("A", "Z"), letter("A"))
                .when((c > "~") & c.rlike(r"\p{L}"), letter("a"))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(chars, ""), drawn), "")

    return stream.by_piece(value, piece)


def _grouped_hex(value: Column, stream: _Stream) -> Column:
    """Drawn hex digits for hex digits; anything else stays."""

    def piece(chars: Column, block: Column) -> Column:
        drawn = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(block, i * 2 + 1, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(chars, ""), drawn), "")

    return stream.by_piece(value, piece)


def _hex(value: Column, stream: _Stream) -> Column:
    """Drawn hex digits, as many as the value has."""
    return stream.by_piece(value, lambda piece, block: F.substring(block, F.lit(1), F.length(piece)), 128)


def _checked(digits: Column) -> Column:
    """Remainder of the check sum that card numbers carry; 0 is valid."""
    places = F.reverse(F.split(digits, ""))

    def weighed(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(places, weighed), F.lit(0), lambda a, b: a + b)
    return total % 10


def _card(digits: Column, stream: _Stream) -> Column:
    """Same first digit; a valid check digit if the number had one."""
    drawn = F.concat(F.substring(digits, 1, 1), F.substring(_shaped(digits, stream), F.lit(2), F.length(digits) - 2))
    check = F.concat(drawn, ((F.lit(10) - _checked(F.concat(drawn, F.lit("0")))) % 10).cast("string"))
    return F.when(_checked(digits) == 0, check).otherwise(
        F.concat(drawn, (_byte(stream.start(), F.lit(60)) % 10).cast("string"))
    )


def _mod_97(account: Column) -> Column:
    """Remainder of a bank account's check sum, the country and check digits moved to its end; 1 is valid."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(total: Column, c: Column) -> Column:
        # Letters count as 10 to 35.
        code = F.ascii(c)
        return F.when(code < 65, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _account(account: Column, stream: _Stream) -> Column:
    """Same country; valid check digits if the account had them."""
    country = F.substring(account, 1, 2)
    drawn = _shaped(F.substring(account, F.lit(3), F.length(account)), stream)

    def checked(drawn: Column) -> Column:
        own = F.substring(drawn, F.lit(3), F.length(drawn))
        rest = F.lit(98) - _mod_97(F.concat(country, F.lit("00"), own))
        valid = F.concat(country, F.lpad(rest.cast("string"), 2, "0"), own)
        return F.when(_mod_97(account) == 1, valid).otherwise(F.concat(country, drawn))

    return _let(drawn, checked)


def _name(kind: Column, stream: Column, draw: int) -> Column:
    found = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        table = F.array(*(F.lit(s) for s in syllables))
        stem = F.concat(
            *(F.get(table, _byte(stream, F.lit(i)) % len(syllables)) for i in range(3 + min(draw, 12)))
        )
        for role, ending in ENDINGS[script].items():
            here = kind == f"name.{script}.{role}"
            found = F.when(here, F.initcap(F.concat(stem, F.lit(ending)))).otherwise(found)
    return found


def _candidate(key: str, draw: int) -> Column:
    """The surrogate of ``canon`` at a draw, in canonical form; from columns ``kind`` and ``canon``."""
    kind, canon = F.col("kind"), F.col("canon")

    stream = _Stream(key, f"{draw}.", kind, canon)
    drawn = stream.start()
    at = F.instr(canon, "@")
    domain = F.substring(canon, at + 1, F.lit(4096))
    top = F.regexp_extract(domain, r"\.[^.]*$", 0)
    # The mails of one domain stay in one domain; the top level domain stays.
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    more = max(0, draw + 1 - SAME_LENGTH)
    longer = F.substring(F.repeat(F.substring(drawn, 193, 64), 1 + more // 64), 1, more) if more else F.lit("")
    digits = F.translate(longer, "abcdef", "012345")
    local = F.concat(_shaped(F.substring(canon, F.lit(1), at - 1), stream), longer)
    email = F.concat(local, F.lit("@"), _shaped(host, _Stream(key, "host.", kind, host)), top)
    octets = [(_byte(drawn, F.lit(2 * i)) * 256 + _byte(drawn, F.lit(2 * i + 1))) for i in range(4)]
    ip = F.concat_ws(".", *((F.lit(1) + o % (223 if i == 0 else 254)).cast("string") for i, o in enumerate(octets)))
    is_hex = canon.rlike("^[0-9a-f]+$")
    secret = F.when(is_hex, _hex(canon, stream)).otherwise(_shaped(canon, stream))
    key_head = F.regexp_extract(canon, "^(?:AKIA|sk[-_]|ghp[-_]|xox[bp][-_])", 0)
    key_tail = F.substring(canon, F.length(key_head) + 1, F.length(canon))
    # More numbers of one kind than its length allows make longer ones.
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat(ip, F.when(digits != "", F.concat(F.lit("."), digits)).otherwise("")))
        .when(kind == "ipv6", F.concat(_grouped_hex(canon, stream), longer))
        .when(kind == "card", F.concat(_card(canon, stream), digits))
        .when(kind == "secret", F.concat(secret, longer))
        .when(kind == "key", F.concat(key_head, _shaped(key_tail, stream), longer))
        .when(kind == "iban", F.concat(_account(canon, stream), digits))
        .when(kind.isin("phone", "ssn"), F.concat(_shaped(canon, stream), digits))
        .otherwise(_name(kind, drawn, draw))
    )


def assigned(found: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon`` and ``surrogate`` of every distinct entity in columns ``kind`` and ``canon``.

    All surrogates differ from each other and, in lower case, from all entities, of whatever kinds.  Entities that
    lose a draw to another or to a real one draw again, the longer the oftener, so that all end.  All steps are
    joins and partial aggregates over distinct entities.
    """
    every = written(found.select("kind", "canon").where(F.col("kind") != KEPT).distinct(), "entities")
    real = every.select(F.lower("canon").alias("folded")).distinct()
    done, pending, draw = None, every, 0
    while done is None or not pending.isEmpty():
        drawn = pending.withColumn("surrogate", _candidate(key, draw))
        drawn = drawn.withColumn("folded", F.lower("surrogate")).join(real, "folded", "left_anti")
        if done is not None:
            drawn = drawn.join(done.select("folded"), "folded", "left_anti")
        winners = drawn.groupBy("folded").agg(F.min(F.struct("kind", "canon", "surrogate")).alias("w"))
        winners = written(winners.select("folded", "w.*"), "winners")
        done = winners if done is None else done.unionByName(winners)
        pending = written(pending.join(winners, ["kind", "canon"], "left_anti"), "pending")
        draw += 1
    return done.select("kind", "canon", "surrogate")


def _formatted(mention: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of one mention; names are put together by the caller."""

    def filled(pattern: str) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

        def put(done: Column, c: Column) -> Column:
            here = c.rlike(pattern)
            taken = F.substring(surrogate, done.getField("at"), F.lit(1))
            return F.struct(
                F.concat(done.getField("out"), F.when(here, taken).otherwise(c)).alias("out"),
                (done.getField("at") + here.cast("int")).alias("at"),
            )

        # A longer surrogate ends behind the mention's last place.
        rest = lambda done: F.substring(surrogate, done.getField("at"), F.length(surrogate))
        return F.aggregate(
            F.split(mention, ""), start, put, lambda done: F.concat(done.getField("out"), rest(done))
        )

    head = F.regexp_extract(mention, _SECRET_HEAD, 0)
    end = F.regexp_extract(mention, _NAME_END, 0)
    stem = F.regexp_replace(mention, _NAME_END, "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), filled("[0-9]"))
        .when(kind == "iban", filled("[A-Z0-9]"))
        .when(kind == "secret", F.concat(head, surrogate))
        .when(kind.startswith("name.") & mention.rlike(_INITIAL), F.concat(F.left(surrogate, F.lit(1)), F.lit(".")))
        .when(kind.startswith("name."), F.concat(F.when(F.upper(stem) == stem, F.upper(surrogate)).otherwise(surrogate), end))
        .otherwise(surrogate)
    )


def _drawn(found: DataFrame, key: str) -> DataFrame:
    """:func:`assigned`, where a neutral first name has the surrogate of the same name with a gender, if there is one."""
    every = written(found.select("kind", "canon").distinct(), "kinds")
    stem = F.regexp_extract("kind", r"^name\.[a-z]+\.", 0)
    gendered = every.where(F.col("kind").rlike(r"^name\..*\.[mf]$")).select(stem.alias("stem"), "canon", F.col("kind").alias("as"))
    gendered = gendered.groupBy("stem", "canon").agg(F.max("as").alias("as"))
    neutral = every.where(F.col("kind").rlike(r"^name\..*\.n$")).withColumn("stem", stem)
    same = written(neutral.join(gendered, ["stem", "canon"]).select("kind", "canon", "as"), "neutral")
    surrogates = assigned(every.join(same, ["kind", "canon"], "left_anti"), key)
    given = surrogates.withColumnRenamed("kind", "as").join(same, ["as", "canon"])
    return surrogates.unionByName(given.select("kind", "canon", "surrogate"))


def replaced(df: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with every entity of ``text`` replaced; all other columns and texts are as they were.

    ``key`` is the secret that surrogates depend on.  ``count`` names a column to add with the number of
    entities replaced.  Null and empty texts stay; equal texts have equal results, whatever their other
    columns hold.  Rows without entities take no part in any shuffle; of the others only the distinct lists of
    entities do, until they rejoin their rows.
    """
    order = df.columns
    found, bare, listed, both = (unused(df, name) for name in ("_found", "_bare", "_list", "_both"))
    seen = df.withColumn(both, entities(F.col(text)))
    seen = seen.select(*(F.col(f"`{c}`") for c in order), F.col(f"{both}.found").alias(found), F.col(f"{both}.bare").alias(bare))
    seen = seen.withColumn(listed, F.when(F.size(found) > 0, F.sha2(F.array_join(found, "\u0001"), 256)))
    # Stored whole: looking for entities is dear, and every text is looked at once.
    seen = written(seen, "with-entities")
    some, none = seen.where(F.col(listed).isNotNull()), seen.where(F.col(listed).isNull()).select(*(F.col(f"`{c}`") for c in order))

    lists = some.select(F.col(listed).alias("k"), F.col(found).alias("mentions")).dropDuplicates(["k"])
    mentions = lists.select("k", F.posexplode("mentions").alias("at", "mention"))
    parts = mentions.select("k", "at", "mention", F.posexplode(_tokens(F.col("mention"))).alias("part", "token"))
    parts = written(_settled(parts.select("k", "at", "mention", "part", "token.*")), "mentions")
    surrogates = _drawn(parts, key)
    person = F.col("kind").startswith("name.")
    titled = F.col("mention").rlike(_TITLED)
    # A mention of a person is written name by name.
    place = F.col("part") + titled.cast("int")
    word = F.when(person, F.get(F.split("mention", " "), place)).otherwise(F.col("mention"))
    shown = parts.join(surrogates, ["kind", "canon"]).select(
        "k", "at", "part", "mention", person.alias("person"), _formatted(word, F.col("kind"), F.col("surrogate")).alias("s")
    )
    # A kept mention is whole, a particle is one word of a person.
    particle = F.get(F.split("mention", " "), place)
    kept = parts.where(F.col("kind") == KEPT).select(
        "k", "at", "part", "mention", titled.alias("person"), F.when(titled, particle).otherwise(F.col("mention")).alias("s")
    )
    shown = shown.unionByName(kept)
    title = F.get(F.split("mention", " "), F.lit(0))
    by_mention = shown.groupBy("k", "at").agg(
        F.sort_array(F.collect_list(F.struct("part", "s"))).alias("names"),
        F.first("mention").alias("mention"),
        F.max("person").alias("person"),
    )
    names = F.array_join(F.transform("names", lambda x: x.getField("s")), " ")
    by_mention = by_mention.select(
        "k", "at", "mention", F.when(F.col("person") & titled, F.concat_ws(" ", title, names)).otherwise(names).alias("s")
    )
    by_list = by_mention.groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct("at", "s"))).alias("new"), F.count_if(F.col("s") != F.col("mention")).alias("n")
    )
    by_list = by_list.select(
        F.col("k").alias(listed), F.transform("new", lambda x: x.getField("s")).alias(unused(some, "_new")),
        F.col("n").alias(unused(some, "_count")),
    )
    # Stored, so that the join deals both sides anew and a list that very many rows have can be split.
    by_list = written(by_list, "replacements")
    _, new, number = by_list.columns
    gaps = F.split(F.col(text), _pattern(F.col(bare)))
    whole = F.array_join(
        F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col(new), i), F.lit("")))), ""
    )
    done = some.join(by_list, listed)
    done = done.withColumn(text, whole)
    if count:
        done = done.withColumn(count, F.col(number).cast("bigint"))
        none = none.withColumn(count, F.lit(0).cast("bigint"))
        order = [c for c in order if c != count] + [count]
    return done.select(*(F.col(f"`{c}`") for c in order)).unionByName(none.select(*(F.col(f"`{c}`") for c in order)))
