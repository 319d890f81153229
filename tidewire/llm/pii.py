"""Surrogates for personal data and secrets, with DataFrame functions only.

Entities are found by one pattern, in one search of each text. Each distinct entity
(in a canonical form, so that spellings of one entity stay one) gets a keyed
replacement of its own type: digits for digits and letters for letters in the same
layout, valid check digits for cards and bank accounts, the country code of a phone
number, names with the gender of their title and in their script and case. A person
is a surname, particles ("van", "de la"), and perhaps given names, each with its own
surrogate, so "Mr. John Smith", "Dr SMITH" and, later in the same text, "Smith", "JOHN"
or "John Smith" stay one person. A given name whose title tells no gender has the one
that its text tells. E-mail addresses of one domain get one domain. Replacements that
meet each other or an entity of the corpus are derived anew until none is left, so
distinct entities stay distinct and equal ones equal over all texts. A form whose
values are nearly used up gets further characters after four rounds.

Found are: private keys in PEM form, values of assigned passwords and tokens, e-mail
addresses (domains of up to 127 labels), AWS access keys, JSON web tokens, IBANs,
IPv4 and IPv6 addresses, card numbers, international and North American phone
numbers, US social security numbers, and names after a form of address. Names that
no text titles, postal addresses and other countries' identity numbers are not.

Defined results: a null or empty text stays; texts without an entity stay as they
are; repeated rows get equal texts; very long texts are searched whole; a table
without entities is returned unchanged; other columns pass through.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import written

# Forms of address with the gender they tell.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "г-н", "господин", "κ.", "Κύριος", "Պարոն"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "г-жа", "госпожа", "κα", "Κυρία", "Տիկին"]
OPEN = ["Dr", "Prof"]
# Parts of made-up surnames, and given names by script and gender (o: told by no title).
SYLLABLES = {
    "l": ["ba", "del", "fin", "gar", "hol", "jen", "kov", "lin", "mar", "nor", "pel", "ros", "sten", "tor", "vel", "wen"],
    "c": ["ба", "вел", "гор", "дан", "жар", "зим", "кор", "лин", "мор", "нев", "пол", "рос", "сав", "тим", "чер", "яр"],
    "g": ["βα", "γορ", "δελ", "ζαν", "θεο", "καρ", "λιν", "μαρ", "νικ", "παλ", "ριτ", "σαβ", "τιμ", "φιλ", "χαρ", "ψαλ"],
    "a": ["բա", "գոր", "դել", "զան", "թեո", "կար", "լին", "մար", "նիկ", "պալ", "րիտ", "սավ", "տիմ", "փիլ", "քար", "օրդ"],
}
GIVEN = {
    "lm": ["Adam", "Boris", "Carl", "David", "Emil", "Frank", "Georg", "Henry", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Oscar", "Paul", "Victor"],
    "lf": ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Paula", "Vera"],
    "lo": ["Alex", "Andrea", "Ashley", "Chris", "Dominique", "Jamie", "Jordan", "Kim", "Luca", "Morgan", "Nikita", "Robin", "Sam", "Sascha", "Taylor", "Toni"],
    "cm": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"],
    "cf": ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Римма"],
    "gm": ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος", "Φώτης", "Χρήστος"],
    "gf": ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Φωτεινή", "Χρυσή"],
    "am": ["Արամ", "Գոռ", "Դավիթ", "Հայկ", "Նարեկ", "Պետրոս", "Սարգիս", "Տիգրան"],
    "af": ["Աննա", "Գայանե", "Լուսինե", "Մարիամ", "Նարե", "Շուշան", "Սոնա", "Օվսաննա"],
}

_TITLES = "|".join(sorted(map(re.escape, [*MALE, *FEMALE, *OPEN]), key=len, reverse=True))
# Particles of surnames.
PARTICLES = "van|von|vom|der|den|de|del|della|di|da|dos|du|le|la|el|al|bin|ibn|zu|zum|zur|ter|ten|af|av"
#: "Smith", "SMITH", "McDonald", "O'Neill", "Meyer-Landrut"
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]{1,40}+|(?=['’]\p{Lu}))(?:['’-]\p{Lu}[\p{L}\p{M}]{0,40}+){0,3}+(?![\p{L}\p{M}])"
_LEAD = "(?:(?:" + PARTICLES + ") ){0,3}"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
_HEX = "[0-9A-Fa-f]{1,4}"
#: alternatives in the order in which they are tried; no group repeats without a bound or possessively, so the depth of a match is bounded
PATTERN = "|".join([
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----",
    r"(?<![A-Za-z])" + _SECRET + r"[^\s\"',;]{6,}",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}(?<=\.[A-Za-z]{2,63})",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    r"(?<![0-9A-Za-z:])(?:" + _HEX + ":){7}" + _HEX + r"(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z:])" + _HEX + "(?::" + _HEX + "){1,5}::(?:" + _HEX + "(?::" + _HEX + r"){0,4})?(?![0-9A-Za-z:])",
    r"(?<![A-Za-z0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![A-Za-z0-9])",
    r"(?<![0-9+])\+(?=(?:[ .()-]{0,2}[0-9]){7})[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    r"(?<!\p{L})(?:" + _TITLES + r")\.? (?:" + _NAME + " ){0,2}" + _LEAD + _NAME,
])
#: every entity holds a digit, an at sign, or one of these
_HINT = r"[0-9@]|-----BEGIN|eyJ|[pP](?i:assword|asswd|wd)|[sS](?i:ecret)|[tT](?i:oken)|[aA](?i:pi[_-]?key)|(?:" + _TITLES + r")\.? " + _LEAD + r"\p{Lu}"
#: where a word of letters begins or ends; an apostrophe or hyphen before a capital is in the word
_EDGE = r"(?<=\p{L})(?!\p{L}|['’-]\p{Lu})|(?<!\p{L})(?<!\p{L}['’-](?=\p{Lu}))(?=\p{L})"
_JOINTS = "(?<=['’-])|(?=['’-])"
#: calling codes of one or two digits; others have three
_COUNTRY = r"^\+?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: rounds after which a surrogate may be longer than what it replaces
_SAME_SIZE = 4


def found_entities(text: Column) -> Column:
    """All entities of a text in order."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entity_kind(e: Column) -> Column:
    digits = F.length(F.regexp_replace(e, "[^0-9]", ""))
    return (
        F.when(e.startswith("-----BEGIN"), "pem")
        .when(e.rlike("^" + _SECRET), "secret")
        .when(e.contains("@"), "email")
        .when(e.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "access_key")
        .when(e.startswith("eyJ") & e.contains("."), "jwt")
        .when(e.rlike("^(?:" + _TITLES + r")\.? "), "person")
        .when(e.rlike("^[A-Z]{2}[0-9]{2}") & ~e.contains(":"), "iban")
        .when(e.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(e.contains(":"), "ipv6")
        .when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national_id")
        .when(~e.startswith("+") & (digits >= 13), "card")
        .otherwise("phone")
    )


def _secret_prefix(e: Column) -> Column:
    return F.regexp_extract(e, "^(" + _SECRET + ")", 1)


def _title(e: Column) -> Column:
    return F.regexp_extract(e, "^((?:" + _TITLES + r")\.? )", 1)


def canonical(e: Column, kind: Column) -> Column:
    """One spelling for all spellings of an entity that is no person."""
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "secret", F.substr(e, F.length(_secret_prefix(e)) + 1))
        .when(kind.isin("phone", "card", "national_id", "iban"), F.regexp_replace(e, "[^0-9A-Za-z+]", ""))
        .when(kind == "ipv6", F.lower(e))
        .otherwise(e)
    )


def _gender(e: Column) -> Column:
    word = F.trim(_title(e))
    bare = F.regexp_replace(word, "[.]$", "")
    told = lambda titles: word.isin(titles) | bare.isin(titles)
    return F.when(told(FEMALE), "f").when(told(MALE), "m").otherwise("o")


def _folded(name: Column) -> Column:
    """One spelling for all spellings of a name."""
    return F.replace(F.lower(name), F.lit("’"), F.lit("'"))


def _names(e: Column) -> tuple[Column, Column, Column]:
    """(given names, particles with a space after each, surname) of a person."""
    name = F.substr(e, F.length(_title(e)) + 1)
    surname = F.substring_index(name, " ", -1)
    before = F.substr(name, F.lit(1), F.length(name) - F.length(surname))
    particles = F.regexp_extract(before, "(?:^| )(" + _LEAD + ")$", 1)
    given = F.filter(F.split(F.substr(before, F.lit(1), F.length(before) - F.length(particles)), " "), lambda w: w != "")
    return given, particles, surname


def parts(x: Column) -> Column:
    """What of a described entity gets a surrogate: (kind, value), and more for the given names of a person and the domain of an address."""
    part = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    own = F.array(part(F.when(x["kind"] == "person", "surname").otherwise(x["kind"]), x["value"]))
    domain = F.array(part(F.lit("domain"), F.substring_index(x["value"], "@", -1)))
    return F.concat(own, F.transform(x["given"], lambda g: part(F.lit("given"), g)), F.when(x["kind"] == "email", domain).otherwise(F.slice(domain, 1, 0)))


def described(found: Column) -> Column:
    """Each entity of a text with its kind, its canonical value (of a person: the surname) and keys of a person's given names: gender and name."""
    kinds = F.transform(found, lambda e: F.struct(e.alias("e"), entity_kind(e).alias("kind")))

    def whole(x: Column) -> Column:
        given, _, surname = _names(x["e"])
        person = x["kind"] == "person"
        value = F.when(person, _folded(surname)).otherwise(canonical(x["e"], x["kind"]))
        keys = F.transform(given, lambda g: F.concat(_gender(x["e"]), F.lit(":"), _folded(g)))
        return F.struct(x["e"].alias("e"), x["kind"].alias("kind"), value.alias("value"), F.when(person, keys).otherwise(F.array().cast("array<string>")).alias("given"))

    def told(all_: Column) -> Column:
        known = F.flatten(F.transform(all_, lambda x: x["given"]))

        def gendered(key: Column) -> Column:
            name = F.substr(key, F.lit(3))
            told_as = [F.concat(F.lit(g + ":"), name) for g in "mf"]
            return F.when(key.startswith("o:"), F.coalesce(*[F.when(F.array_contains(known, k), k) for k in told_as], key)).otherwise(key)

        return F.transform(all_, lambda x: x.withField("given", F.transform(x["given"], gendered)))

    return _let(F.transform(kinds, whole), told)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(stream: Column, i) -> Column:
    """The i-th number from 0 to 255 of an array of hexadecimal digests, from 0."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(F.get(stream, F.floor(i / 32).cast("int")), i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _masked(value: Column, stream: Column) -> Column:
    """Letters for letters and digits for digits; lower-case hexadecimal stays so."""
    pick = lambda letters, i: F.substr(F.lit(letters), _number(stream, i) % len(letters) + 1, F.lit(1))

    def char(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), pick(string.digits, i)).when(c.rlike("[a-z]"), pick(string.ascii_lowercase, i)).when(c.rlike("[A-Z]"), pick(string.ascii_uppercase, i)).otherwise(c)

    hexadecimal = value.rlike("^[0-9a-f]{16,}$") & value.rlike("[a-f]")
    return F.array_join(F.when(hexadecimal, F.transform(_chars(value), lambda c, i: pick("0123456789abcdef", i))).otherwise(F.transform(_chars(value), char)), "")


def _luhn(body: Column) -> Column:
    """The check digit that follows a string of digits."""
    n = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(body, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _iban(value: Column, stream: Column) -> Column:
    """Country, valid check digits, and an account of the same layout."""
    country = F.substr(value, F.lit(1), F.lit(2))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + letter) % 97)

    def whole(account: Column) -> Column:
        rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), add)
        return F.concat(country, F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)

    return _let(_masked(F.substr(value, F.lit(5)), stream), whole)


def _pick(values: list[str], x: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), x % len(values) + 1)


def _by_script(name: Column, of) -> Column:
    scripts = F.when(name.rlike(r"\p{IsCyrillic}"), of("c")).when(name.rlike(r"\p{IsGreek}"), of("g")).when(name.rlike(r"\p{IsArmenian}"), of("a"))
    return scripts.otherwise(of("l"))


def _surname(value: Column, stream: Column, attempt: Column) -> Column:
    female = value.rlike("(?:ова|ева|ёва|ина|ая)$")
    endings = {"c": F.when(female, "ова").otherwise("ов"), "g": F.lit("ίδης"), "a": F.lit("յան"), "l": F.lit("")}

    def made(script: str, first: int) -> Column:
        syllables = F.transform(F.sequence(F.lit(first), F.lit(first + 2) + attempt), lambda i: _pick(SYLLABLES[script], _number(stream, i)))
        return F.concat(F.initcap(F.array_join(syllables, "")), endings[script])

    return _by_script(value, lambda script: F.concat(made(script, 0), F.when(value.contains("-"), F.concat(F.lit("-"), made(script, 16))).otherwise("")))


def _given(value: Column, stream: Column, attempt: Column) -> Column:
    """A given name; after the first round two, and more where they are used up."""
    gender, name = F.substr(value, F.lit(1), F.lit(1)), F.substr(value, F.lit(3))
    more = F.least(F.ceil(attempt / 2).cast("int"), F.lit(30))

    def pick(script: str, i: Column) -> Column:
        male, x = GIVEN[script + "m"], _number(stream, i)
        return F.when(gender == "f", _pick(GIVEN[script + "f"], x)).when(gender == "m", _pick(male, x)).otherwise(_pick(GIVEN.get(script + "o", male), x))

    return _by_script(name, lambda script: F.array_join(F.transform(F.sequence(F.lit(0), more), lambda i: pick(script, i)), "-"))


def _core(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """The keyed replacement of a canonical entity, before it takes a spelling's layout."""
    seed = _digest(F.lit(secret), kind, value, attempt.cast("string"))
    digests = _let(seed, lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")), lambda i: _digest(s, i.cast("string"))))
    return _let(digests, lambda stream: _made(kind, value, attempt, stream, secret))


def _made(kind: Column, value: Column, attempt: Column, stream: Column, secret: str) -> Column:
    local, country = F.substring_index(value, "@", 1), F.regexp_extract(value, _COUNTRY, 1)
    spare = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (_number(stream, i) % 10).cast("string"))
    longer = F.when(attempt > _SAME_SIZE, F.array_join(F.slice(spare, F.lit(1), F.least(attempt - _SAME_SIZE, F.lit(31))), "")).otherwise("")
    octet = lambda i: (_number(stream, i) % 254 + 1).cast("string")
    group = lambda i: F.lower(F.hex(_number(stream, 2 * i) * 256 + _number(stream, 2 * i + 1)))
    plain = F.regexp_replace(value, "[+]", "")
    masked = _masked(plain, stream)
    body = F.concat(F.substr(plain, F.lit(1), F.lit(1)), F.substr(masked, F.lit(2), F.length(plain) - 2), longer)
    return (
        F.when(kind == "email", F.concat(_masked(local, stream), longer))
        .when(kind == "domain", F.concat(F.lit("mx"), F.substr(F.get(stream, F.lit(0)), F.lit(1), F.lit(8)), F.lit(".example.net")))
        .when(kind == "surname", _surname(value, stream, attempt))
        .when(kind == "given", _given(value, stream, attempt))
        .when(kind == "access_key", F.concat(F.substr(value, F.lit(1), F.lit(4)), F.substr(_masked(value, stream), F.lit(5)), longer))
        .when(kind == "jwt", F.concat(F.lit("eyJ"), F.substr(_masked(value, stream), F.lit(4)), longer))
        .when(kind == "iban", F.concat(_iban(value, stream), longer))
        .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
        .when(kind == "ipv6", F.concat(F.lit("fd"), F.lpad(group(8), 4, "0").substr(3, 2), F.lit(":"), F.concat_ws(":", *[group(i) for i in range(7)])))
        .when(kind == "card", _let(body, lambda b: F.concat(b, _luhn(b))))
        .when((kind == "phone") & value.startswith("+"), F.concat(country, F.substr(masked, F.length(country) + 1), longer))
        .when(kind.isin("phone", "national_id"), F.concat(masked, longer))
        .when(kind == "pem", F.concat(F.regexp_extract(value, "^(-----BEGIN [A-Z ]*-----)", 1), F.lit("\n"), F.get(stream, F.lit(0)), F.lit("\n"), F.regexp_extract(value, "(-----END [A-Z ]*-----)$", 1)))
        .otherwise(F.concat(_masked(value, stream), longer))
    )


def _laid_out(e: Column, core: Column) -> Column:
    """The replacement in the layout of one spelling; what is longer follows."""
    def char(i: Column) -> Column:
        c = F.substr(e, i, F.lit(1))
        place = F.length(F.regexp_replace(F.substr(e, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(core, place, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), char), "")
    return F.concat(filled, F.substr(core, F.length(F.regexp_replace(e, "[^0-9A-Za-z]", "")) + 1))


def _key(kind, value: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("\x1f"), value)


def _cased(core: Column, word: Column) -> Column:
    """A name's surrogate in capitals where the name stands so."""
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(core)).otherwise(core)


def _replacement(x: Column, cores: Column) -> Column:
    """What stands for a described entity, by the cores of its text."""
    e, kind = x["e"], x["kind"]
    core = F.element_at(cores, _key(F.when(kind == "person", "surname").otherwise(kind), x["value"]))
    given, particles, surname = _names(e)
    new_given = F.transform(x["given"], lambda g, i: _cased(F.element_at(cores, _key("given", g)), F.get(given, i)))
    email = F.concat(core, F.lit("@"), F.element_at(cores, _key("domain", F.substring_index(x["value"], "@", -1))))
    return (
        F.when(kind == "person", F.concat(_title(e), F.array_join(F.transform(new_given, lambda g: F.concat(g, F.lit(" "))), ""), particles, _cased(core, surname)))
        .when(kind.isin("phone", "card", "national_id", "iban"), _laid_out(e, core))
        .when(kind == "secret", F.concat(_secret_prefix(e), core))
        .when(kind == "email", F.when(F.upper(e) == e, F.upper(email)).otherwise(email))
        .otherwise(core)
    )


def _bare(gap: Column, cores: Column) -> Column:
    """A stretch between entities, with the names of the text's titled persons replaced: surnames, and given names that no surname of it follows too."""

    def of(word: Column) -> Column:
        low = _folded(word)
        names = [F.element_at(cores, _key("surname", low)), *[F.element_at(cores, _key("given", F.concat(F.lit(g + ":"), low))) for g in "mfo"]]
        return F.when(word.rlike(r"^\p{Lu}"), _cased(F.coalesce(*names), word))

    def replaced(words: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            surname = F.element_at(cores, _key("surname", _folded(w)))
            follows = (F.get(words, i + 1) == " ") & F.element_at(cores, _key("surname", _folded(F.get(words, i + 2)))).isNotNull()
            given = F.coalesce(*[F.element_at(cores, _key("given", F.concat(F.lit(g + ":"), _folded(w)))) for g in "mfo"])
            whole = F.when(w.rlike(r"^\p{Lu}") & follows & given.isNotNull(), _cased(given, w)).otherwise(of(w))
            jointed = F.when(w.rlike(r"\p{L}['’-]\p{L}"), F.array_join(F.transform(F.split(w, _JOINTS), lambda p: F.coalesce(of(p), p)), ""))
            return F.coalesce(whole, jointed, w)

        return F.array_join(F.transform(words, word), "")

    return _let(F.split(gap, _EDGE, -1), replaced)


def surrogate_table(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, value, core) for distinct (kind, value): cores are distinct within a kind and equal no value of it.

    Each round derives cores for what has none yet, dealt over the session's shuffle
    partitions; of entities that meet, the smallest value keeps the core.
    """
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = F.when(F.col("kind") == "given", F.substr("value", F.lit(3))).otherwise(F.col("value"))
    known = entities.select("kind", plain.alias("plain")).distinct()
    seen_as = F.when(F.col("kind").isin("surname", "given"), F.lower("core")).otherwise(F.col("core"))
    open_, settled, attempt = entities.select("kind", "value"), None, 0
    core = _core(F.col("kind"), F.col("value"), F.col("attempt"), secret).alias("core")
    while True:
        tried = open_.repartition(n, "kind", "value").withColumn("attempt", F.lit(attempt)).select("kind", "value", core)
        tried = written(tried, "surrogates")
        free = tried.withColumn("plain", seen_as).join(known, ["kind", "plain"], "left_anti").drop("plain")
        if settled is not None:
            free = free.join(settled.select("kind", "core"), ["kind", "core"], "left_anti")
        first = written(free.groupBy("kind", "core").agg(F.min("value").alias("value")).select("kind", "value", "core"), "surrogates")
        settled = first if settled is None else settled.unionByName(first)
        open_ = tried.join(first, ["kind", "value"], "left_anti").select("kind", "value")
        if open_.isEmpty():
            return settled
        open_, attempt = written(open_, "surrogates"), attempt + 1


def replace_entities(documents: DataFrame, secret: str, *, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """Documents with surrogates in their texts; with ``count``, a column of that name has the number of places that the pattern found.

    Rows are written to the shared folder once, with what was found; only texts with entities are shuffled.
    """
    names = [c for c in documents.columns if c != count]
    marked = written(documents.select(*names).withColumn("_tw_found", found_entities(F.col(text))), "entities")
    some = F.size("_tw_found") > 0
    hits = marked.where(some).withColumn("_tw_key", F.xxhash64(F.col(doc_id), F.col(text)))
    spelled = hits.select("_tw_key", F.explode(described(F.array_distinct("_tw_found"))).alias("x"))
    wanted = written(spelled.select("_tw_key", F.explode(parts(F.col("x"))).alias("p")).select("_tw_key", "p.kind", "p.value").distinct(), "entity-places")
    table = surrogate_table(written(wanted.select("kind", "value").distinct(), "entity-values"), secret)
    cores = wanted.join(table, ["kind", "value"]).groupBy("_tw_key").agg(F.map_from_entries(F.collect_list(F.struct(_key(F.col("kind"), F.col("value")), "core"))).alias("_tw_cores"))
    joined = hits.join(cores, "_tw_key").withColumn("_tw_gaps", F.split(F.col(text), PATTERN, -1))
    named = F.exists(F.map_keys("_tw_cores"), lambda k: k.startswith("surname"))
    gaps = F.when(named, F.transform("_tw_gaps", lambda gap: _bare(gap, F.col("_tw_cores")))).otherwise(F.col("_tw_gaps"))
    joined = joined.withColumn("_tw_gaps", gaps).withColumn("_tw_new", F.transform(described(F.col("_tw_found")), lambda x: _replacement(x, F.col("_tw_cores"))))
    mixed = F.transform("_tw_gaps", lambda gap, i: F.concat(gap, F.when(i < F.size("_tw_new"), F.get("_tw_new", i)).otherwise("")))
    changed = joined.withColumn(text, F.array_join(mixed, "")).select(*names, F.size("_tw_found").cast("long").alias("_tw_count"))
    kept = marked.where(~some).select(*names, F.lit(0).cast("long").alias("_tw_count"))
    out = changed.unionByName(kept)
    return out.withColumnRenamed("_tw_count", count) if count else out.drop("_tw_count")


def session_key(spark) -> str:
    """The key of surrogates: ``spark.tidewire.surrogateKey`` of the session, which has to be kept secret.

    Where it is unset, a cluster gets an error, and a local session (tests, and the check on given tables) a fixed word.
    """
    key = spark.conf.get("spark.tidewire.surrogateKey", None)
    if not key and spark.sparkContext.getConf().get("spark.tidewire.surrogateKeyRequired", "false") == "true":
        raise ValueError("spark.tidewire.surrogateKey is not set")
    return key or "key-for-tests"


def op6_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with surrogates, and the number of places that were found."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(documents, session_key(spark), count="n_replaced")
