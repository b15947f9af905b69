"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, network addresses, card, account, social-security and telephone numbers,
secrets and names. Texts are searched once and written in pieces, cut at the matches; each match gets its surrogate,
and the pieces are joined again.

A surrogate is a keyed permutation of the entity's normal form: the characters of one half are shifted within their
own class (digits, hex letters, vowels and consonants of a script, ...) by a keyed stream of the other half, four
times in turn. So every writing of an entity gets the same surrogate (coreference), different entities of a form
get different ones, and script, case, length, separators, dialling code, top-level domain, and the check digits of
card and account numbers stay of their kind. Given names are exchanged within a list of their gender and script;
address bytes stay bytes. Titles are kept, so gender is too.

What a permutation can't promise is checked: ``exceptions`` looks for surrogates that two entities share, that
equal their own entity or any other entity of the corpus, and gives those entities another turn of the key until
none is left. After ``TURNS`` turns each further one also lengthens the surrogate by a character, so forms with too
few members (two-letter surnames, listed names that all occur) are settled as well. It returns only these few entities; texts that hold one are joined to it (small tables are sent to
all executors by Spark's own threshold, others are shuffled by the text's digest).

Parts without a character of any class (names of other scripts, secrets of punctuation) get a keyed token of their
length. A value that is one repeated sign, neither letter nor digit ('password: ********'), is masked already: it is
no entity and stays.

Defined results: null stays null, empty stays empty; texts without entities are unchanged; repeated rows and ties
get the same text; an empty table gives an empty table; other columns stay and clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.llm.common import written

#: Given names by script and gender.
GIVEN = {
    "latin_f": "Anna Maria Laura Julia Sofia Emma Clara Elena Helen Linda Susan Karen Nancy Alice Ruth Petra Ingrid Claire Camille Lucia Carmen Isabel Teresa Monica".split(),
    "latin_m": "John James Robert Michael William David Richard Thomas Peter Martin Hans Klaus Stefan Pierre Jacques Michel Carlos Miguel Pablo Diego Luis Jorge Mark Paul".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана".split(),
    "cyrillic_m": "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Павел".split(),
    "greek_f": "Ελένη Μαρία Σοφία Κατερίνα".split(),
    "greek_m": "Γιώργος Νίκος Δημήτρης Κώστας".split(),
}
#: Titles that a name follows.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Herrn Señor Señora Señorita Sr Sra Monsieur Madame Mme Mlle Господин Госпожа Κύριος Κυρία".split()

_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = "|".join(TITLES)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CARD = r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])"
_WORDS = "password|passwd|pwd|secret|token|api_key|apikey|api-key"
#: What a secret begins with.
_PREFIX = r"(?:AKIA|(?:sk|pk|rk)[-_]|gh[pousr]_|xox[abprs]-)"
#: What a telephone number's writing has before its own digits: the dialling code, or the zero in its place.
_DIAL = r"^(?:\+\d{1,3}(?=[ ./(-])(?: ?\(0\))?|0(?=\d{1,4}[ ./-])|\(0(?=\d{1,4}\)))"
#: Pattern of each kind; where two fit at one place, the earlier holds. Most begin with what is soonest seen not to fit.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}",
    "password": r"(?<=[=:\s\"'])(?<=[=:]\s{0,2}[\"']{0,1})(?<=(?i:" + _WORDS + r")\s{0,2}[=:]\s{0,2}[\"']{0,1})(?!(?<mask>[^\p{L}\p{N}\s])\k<mask>*+(?![^\s\"']))[^\s\"'=:][^\s\"']{5,}",
    "secret": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])",
    "account": r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?=\d)(?<![\d.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\d|\.\d)",
    "hardware": r"(?=[0-9A-Fa-f]{2}[:-])(?<![\p{L}\p{N}:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:-])",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "phone": r"(?=[0-9+(])(?<![\p{L}\p{N}+.])(?!" + _CARD + r")(?:\+\d{1,3}[ .-]?\(\d{1,4}\)(?:[ .-]?\d{3,4}[ .-]?\d{4}|[ .-]?\d{5,8}|[ .-]?\d{2,4}(?:[ .-]\d{2,8}){1,4})|\+\d{1,3}(?:[ ./-]\d{2,8}){2,5}|\+\d{1,3}[ .-]\d{5,12}|\+\d{8,14}"
    r"|\(\d{2,5}\)[ .-]?(?:\d{3,4}[ .-]?\d{4}|\d{5,8})|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}(?:[ .-]\d{3,4}){2}|0\d(?:[ .-]\d{2}){4}|0\d{1,4}[ /-]\d{5,8}(?:-\d{1,4})?|0\d{2,4}[ /]\d{4}(?:-\d{1,4})?)(?![\p{L}\p{N}])",
    "social": r"(?=\d)(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?=\d)(?<![\p{L}\p{N}.-])" + _CARD,
    "name": r"(?=\p{Lu})(?<!\p{L})(?:(?:" + _TITLE + r")\.? (?:\p{Lu}[\p{Ll}'-]+ ){0,2}\p{Lu}[\p{Ll}'-]+|(?:" + _GIVEN + r") \p{Lu}[\p{Ll}'-]{2,})(?!\p{L})",
}
#: Within a word, after a letter, only network addresses begin; all other places try every kind.
PATTERN = r"(?<!\p{L})(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + rf")|(?=\d)(?<=\p{{L}}){KINDS['ip']}"
#: Set around matches when a text is cut; a text that holds this character is cut in another way.
MARK = "\uffff"

_DIGITS = [(0x30, 10, "")]
_UPPER = [(0x41, 26, "")]
_HEX = [(0x61, 6, ""), (0x41, 6, ""), (0x67, 20, ""), (0x47, 20, "")]
_LETTERS = [(0x61, 26, ""), *_UPPER, (0xE0, 23, ""), (0xC0, 23, ""), (0x430, 32, ""), (0x410, 32, ""), (0x3B1, 25, ""), (0x391, 17, ""), (0x3A3, 7, ""), (0x5D0, 27, ""), (0x621, 26, ""), (0x641, 10, ""), (0x915, 37, ""), (0x3041, 83, ""), (0x30A1, 83, ""), (0x4E00, 20902, ""), (0xAC00, 11172, "")]
#: Letters that take each other's place in names, so that a name can still be spoken.
_SPOKEN = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
#: The classes whose characters are exchanged, by what the text is: first code point and number, or the letters.
_CLASSES = {
    "digits": _DIGITS,
    "account": _DIGITS + _UPPER,
    "hex": _DIGITS + _HEX,
    "any": _DIGITS + _LETTERS,
    "spoken": [(0, len(x), x) for x in _SPOKEN],
}


#: Turns of the key before surrogates grow.
TURNS = 20


def _let(value: Column, use) -> Column:
    """``use(value)``, the value being computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(hexes: Column, width: int = 8) -> Column:
    return F.conv(F.substring(hexes, 1, width), 16, 10).cast("long")


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary"), 256)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _classes(name: Column) -> Column:
    out = F.lit(None)
    for key, rows in _CLASSES.items():
        out = F.when(name == key, F.array(*[F.struct(F.lit(low).alias("low"), F.lit(n).alias("n"), F.lit(letters).alias("letters")) for low, n, letters in rows])).otherwise(out)
    return out


def _exchangeable(text: Column, name: Column) -> Column:
    """Whether a character of the text has a class."""
    out = F.lit(False)
    for key, rows in _CLASSES.items():
        held = "".join(letters or f"\\x{{{low:x}}}-\\x{{{low + n - 1:x}}}" for low, n, letters in rows)
        out = F.when(name == key, text.rlike(f"[{held}]")).otherwise(out)
    return out


def _token(text: Column, seed: Column) -> Column:
    """A keyed token of the text's length, letters only, the first one capital."""
    digest = F.translate(_digest(seed, text), "0123456789", "ghijklmnop")
    return F.initcap(F.rpad(digest, F.length(text), digest))


def _shift(c: Column, k: Column, classes: Column) -> Column:
    """The character k places on in its class, around its end; a character of no class stays."""

    def within(r: Column) -> Column:
        at = F.when(r["letters"] == "", F.ascii(c) - r["low"]).otherwise(F.instr(r["letters"], c) - 1)
        return F.when((at >= 0) & (at < r["n"]), F.struct(F.pmod(at + k, r["n"]).cast("int").alias("at"), r["low"].alias("low"), r["letters"].alias("letters")))

    def found(r: Column) -> Column:
        return F.when(r["letters"] == "", _character(r["low"] + r["at"])).otherwise(F.substring(r["letters"], r["at"] + 1, F.lit(1)))

    return F.coalesce(F.get(F.transform(F.filter(F.transform(classes, within), lambda r: r.isNotNull()), found), F.lit(0)), c)


def _moved(target: Column, by: Column, seed: Column, classes: Column) -> Column:
    """Shifts every character of target by a stream that depends on the key and the other half."""

    def one(c: Column, i: Column) -> Column:
        return _let(_number(_digest(seed, by, i.cast("string"))), lambda k: _shift(c, k, classes))

    return F.array_join(F.transform(F.split(target, ""), lambda c, i: F.when(c == "", c).otherwise(one(c, i))), "")


def _permuted(x: Column) -> Column:
    """A keyed permutation of the texts whose characters have the classes of ``x.text``'s, by ``x.seed``."""
    half = (F.length(x["text"]) / 2).cast("int")
    state = F.struct(F.substring(x["text"], F.lit(1), half).alias("a"), F.substring(x["text"], half + 1, F.length(x["text"])).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        tag = F.concat_ws(":", x["seed"], i.cast("string"))
        return _let(
            F.struct(_moved(s["a"], s["b"], tag, x["classes"]).alias("a"), s["b"].alias("b")),
            lambda t: F.struct(t["a"].alias("a"), _moved(t["b"], t["a"], tag, x["classes"]).alias("b")),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(2)), state, turn, lambda s: F.concat(s["a"], s["b"]))


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), ((n - 1 - i) % 2 == 0).alias("twice"))),
        F.lit(0),
        lambda s, x: s + F.when(x["twice"], F.when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])).otherwise(x["d"]),
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda s, c: F.when(c == "", s).when(c.rlike("[0-9]"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def kind(match: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(list(KINDS.items())):
        if name not in ("name", "password"):
            out = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    spoken = match.rlike(f"^(?:{KINDS['name']})$")
    return F.when(spoken, "name").when(out == "name", "password").otherwise(out)


def normal(match: Column, of: Column) -> Column:
    """What all writings of an entity share."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(of == "email", F.lower(match))
        .when(of == "phone", F.regexp_replace(F.regexp_replace(match, _DIAL, ""), "[^0-9]", ""))
        .when(of.isin("card", "social"), digits)
        .when(of == "account", F.regexp_replace(match, " ", ""))
        .when(of.isin("hardware", "ip6"), F.lower(match))
        .when(of == "name", F.regexp_replace(F.regexp_replace(match, rf"^(?:{_TITLE})\.? ", ""), r"\s+", " "))
        .otherwise(match)
    )


def _listed(word: Column, seed: Column) -> Column:
    """A given name's counterpart of its script and gender; null for other words."""
    groups = F.array(*[F.array(*map(F.lit, names)) for names in GIVEN.values()])

    def within(names: Column) -> Column:
        step = 1 + _number(_digest(seed, F.get(names, F.lit(0)))) % (F.size(names) - 1)
        return F.get(names, F.pmod(F.array_position(names, word) - 1 + step, F.size(names)).cast("int"))

    return F.get(F.transform(F.filter(groups, lambda names: F.array_contains(names, word)), within), F.lit(0))


def _address(text: Column, seed: Column) -> Column:
    parts = F.split(text, r"\.")
    number = [F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0)) for i in range(4)]
    state = F.struct((number[0] * 256 + number[1]).alias("a"), (number[2] * 256 + number[3]).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        left = s["a"].bitwiseXOR(_number(_digest(seed, i.cast("string"), "l", s["b"].cast("string")), 4))
        return F.struct(left.alias("a"), s["b"].bitwiseXOR(_number(_digest(seed, i.cast("string"), "r", left.cast("string")), 4)).alias("b"))

    def dotted(s: Column) -> Column:
        return F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)

    return F.aggregate(F.sequence(F.lit(1), F.lit(2)), state, turn, dotted)


def _segment(text: Column, seed: Column, classes: str | Column) -> Column:
    return F.struct(text.alias("text"), seed.alias("seed"), (F.lit(classes) if isinstance(classes, str) else classes).alias("name"))


def replacement(norm: Column, of: Column, key: str, turn: Column) -> Column:
    """The surrogate of a normal form, itself a normal form."""
    seed = F.concat_ws(":", F.lit(key), of, turn.cast("string"))
    host = F.substring_index(norm, "@", -1)
    top = F.substring_index(host, ".", -1)
    more = F.greatest(turn - TURNS, F.lit(0)).cast("int")
    longer = lambda text, with_: F.concat(text, F.repeat(F.lit(with_), more))
    body = F.substring(norm, F.lit(1), F.length(norm) - 1)
    checked = _luhn(body) == F.substring(norm, -1, 1)
    prefix = F.regexp_extract(norm, f"^{_PREFIX}", 0)
    hexes = F.when(norm.rlike("^[0-9a-f:-]+$|^[0-9A-F:-]+$"), "hex").otherwise("any")
    domain = F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1)
    segments = (
        F.when(of == "email", F.array(_segment(longer(F.substring_index(norm, "@", 1), "0"), seed, "any"), _segment(domain, F.concat_ws(":", F.lit(key), F.lit("host"), turn.cast("string")), "any")))
        .when(of == "card", F.array(_segment(longer(F.when(checked, body).otherwise(norm), "0"), seed, "digits")))
        .when(of.isin("phone", "social"), F.array(_segment(longer(norm, "0"), seed, "digits")))
        .when(of == "account", F.array(_segment(longer(F.substring(norm, F.lit(5), F.length(norm)), "0"), seed, "account")))
        .when(of == "name", F.transform(F.split(longer(norm, "a"), " "), lambda w: _segment(w, seed, "spoken")))
        .when(of == "ip", F.array().cast("array<struct<text:string,seed:string,name:string>>"))
        .otherwise(F.array(_segment(longer(F.substring(norm, F.length(prefix) + 1, F.length(norm)), "0"), seed, hexes)))
    )
    new = F.transform(
        segments,
        lambda x: F.coalesce(
            F.when(x["name"] == "spoken", _listed(x["text"], x["seed"])),
            F.when(x["name"].isin("any", "hex", "spoken") & ~_exchangeable(F.substring(x["text"], F.lit(1), F.greatest(F.length(x["text"]) - more, F.lit(1))), x["name"]), _token(x["text"], x["seed"])),
            _let(F.struct(x["text"].alias("text"), x["seed"].alias("seed"), _classes(x["name"]).alias("classes")), _permuted),
        ),
    )

    def joined(parts: Column) -> Column:
        one = F.get(parts, F.lit(0))
        country = F.substring(norm, 1, 2)
        check = F.lpad((98 - _mod97(F.concat(one, country, F.lit("00")))).cast("string"), 2, "0")
        return (
            F.when(of == "email", F.concat(one, F.lit("@"), F.get(parts, F.lit(1)), F.lit("."), top))
            .when(of == "card", F.when(checked, F.concat(one, _luhn(one))).otherwise(one))
            .when(of == "account", F.concat(country, check, one))
            .when(of == "name", F.array_join(parts, " "))
            .when(of == "ip", _address(norm, seed))
            .otherwise(F.concat(prefix, one))
        )

    return _let(new, joined)


def _laid_out(match: Column, digits: Column, kept: Column) -> Column:
    """``match`` with its digits after the kept prefix replaced in turn."""
    tail = F.substring(match, F.length(kept) + 1, F.length(match))
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.concat(
        kept,
        F.aggregate(
            F.split(tail, ""),
            zero,
            lambda s, c: F.when(
                c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
            ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
            lambda s: F.concat(s["out"], F.substring(digits, s["at"], F.length(digits))),
        ),
    )


def written_like(match: Column, of: Column, new: Column) -> Column:
    """The surrogate in the writing of the match."""
    kept = F.when(of == "phone", F.regexp_extract(match, _DIAL, 0)).otherwise("")
    title = F.regexp_extract(match, rf"^(?:{_TITLE})\.? ", 0)
    spaced = F.regexp_replace(new, "(.{4})(?=.)", "$1 ")
    return (
        F.when(of.isin("phone", "card", "social"), _laid_out(match, new, kept))
        .when(of == "name", F.concat(title, new))
        .when((of == "account") & match.contains(" "), spaced)
        .when(of.isin("email", "hardware", "ip6") & (match == F.upper(match)) & (match != F.lower(match)), F.upper(new))
        .otherwise(new)
    )


def cut(text: Column) -> Column:
    """The text in pieces: what lies between entities at even places, entities at odd ones; null for null."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    between, found = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    apart = F.flatten(F.zip_with(between, found, lambda p, m: F.when(m.isNull(), F.array(p)).otherwise(F.array(p, m))))
    return F.when(text.contains(MARK), apart).otherwise(marked)


def matches(pieces: Column) -> Column:
    """The entities among the pieces of a text, in order."""
    return F.filter(pieces, lambda p, i: i % 2 == 1)


def entities(pieces: DataFrame) -> DataFrame:
    """The distinct entities of a corpus, cut in the column ``pieces``: kind and norm."""
    found = pieces.select(F.explode(F.array_distinct(matches(F.col("pieces")))).alias("match")).distinct()
    found = found.select("match", kind(F.col("match")).alias("kind"))
    # surrogates cost much more time than bytes: dealt to all cores, however small the table
    parts = pieces.sparkSession.sparkContext.defaultParallelism
    return found.select("kind", normal(F.col("match"), F.col("kind")).alias("norm")).distinct().repartition(parts, "kind", "norm")


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """kind, norm and turn of the entities whose first surrogate is not theirs alone."""
    turns = found.withColumn("turn", F.lit(0))
    while True:
        new = turns.withColumn("new", replacement(F.col("norm"), F.col("kind"), key, F.col("turn")))
        # each surrogate's first claimant, entities themselves coming before all claimants
        claims = new.select("kind", F.col("new").alias("value"), "norm", F.lit(1).alias("rank")).unionByName(found.select("kind", F.col("norm").alias("value"), "norm", F.lit(0).alias("rank")))
        shared = claims.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min(F.struct("rank", "norm")).alias("first")).where("n > 1")
        lost = claims.where("rank = 1").join(shared, ["kind", "value"]).where((F.col("first.rank") == 0) | (F.col("first.norm") != F.col("norm"))).select("kind", "norm").distinct()
        lost = written(lost, "pii-lost")
        if lost.isEmpty():
            return turns.where("turn > 0")
        turns = written(turns.join(lost.withColumn("again", F.lit(1)), ["kind", "norm"], "left").select("kind", "norm", (F.col("turn") + F.coalesce("again", F.lit(0))).alias("turn")), "pii-turns")


def surrogates(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities", kinds: str = "entity_kinds") -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, the number of entities, and their kinds.

    Texts are searched once: they are written in pieces, and the rest works on these.
    """
    kept = [c for c in docs.columns if c not in (count, kinds)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text], F.lit(0).alias("__none__")).alias("row"), F.col(text).alias("text"), cut(F.col(text)).alias("pieces"))
    # a text without entities is one piece
    found = F.size("pieces") > 1
    rows = written(rows.select("row", F.when(~found, F.col("text")).alias("text"), F.when(found, F.col("pieces")).alias("pieces")), "pii-pieces")
    rare = written(exceptions(written(entities(rows), "pii-entities"), key), "pii-exceptions")
    some = not rare.isEmpty()
    if some:
        digest = F.sha2(F.to_json("pieces").cast("binary"), 256)
        held = rows.where("pieces is not null").select(digest.alias("digest"), F.explode(F.array_distinct(matches(F.col("pieces")))).alias("match")).distinct()
        held = held.withColumn("kind", kind(F.col("match"))).withColumn("norm", normal(F.col("match"), F.col("kind"))).join(rare, ["kind", "norm"])
        held = held.groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "norm").alias("k"), "turn"))).alias("turns"))
        rows = rows.withColumn("digest", digest).join(written(held, "pii-held"), "digest", "left")

    def surrogate(m: Column) -> Column:
        return _let(F.struct(m.alias("m"), kind(m).alias("kind")), with_norm)

    def with_norm(x: Column) -> Column:
        return _let(F.struct(x["m"].alias("m"), x["kind"].alias("kind"), normal(x["m"], x["kind"]).alias("norm")), with_new)

    def with_new(x: Column) -> Column:
        turn = F.coalesce(F.element_at("turns", F.concat_ws(":", x["kind"], x["norm"])), F.lit(0)) if some else F.lit(0)
        return _let(F.struct(x["m"].alias("m"), x["kind"].alias("kind"), replacement(x["norm"], x["kind"], key, turn).alias("new")), finished)

    def finished(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), written_like(x["m"], x["kind"], x["new"]).alias("new"))

    rows = rows.withColumn("found", F.transform(F.coalesce(matches(F.col("pieces")), F.array().cast("array<string>")), surrogate))
    between = F.filter("pieces", lambda p, i: i % 2 == 0)
    new = F.array_join(F.flatten(F.zip_with(between, "found", lambda p, s: F.array(p, F.coalesce(s["new"], F.lit(""))))), "")
    return rows.select(
        *[F.coalesce("text", new).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept],
        F.size("found").cast("long").alias(count),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))).alias(kinds),
    )
