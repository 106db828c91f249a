"""PII: keyed surrogates for detected entities, by DataFrame functions only.

One pattern finds e-mail addresses, secrets and keys, IP addresses, card numbers, phone numbers, account numbers and
names (after a title or words such as "my name is", a known given name and what follows, or what stands before a known family
name). The text is cut at the matches and joined again with a surrogate in each match's place, row by
row: nothing is shuffled and no table of entities is needed.

A surrogate is the image of the entity under a keyed permutation of all entities of its format: character
after character moves within its own class (digits, capitals, vowels of a name, letters of its script) by
an amount that a keyed hash derives from its type and all characters before it, forwards and then backwards.
So equal entities get equal surrogates everywhere (coreference, whatever separators and capitals), and
different ones of the same format never meet: distinctness holds by construction on any number of machines.
Kept are separators, the country code of a phone number, a card's Luhn validity and an account number's check digits, octets below 256,
titles, and the gender-marking last letter of a name; a known given or family name becomes another one of its list, and the image of
an unknown name that is on a list is moved on until it is on none.

Collision checks: each row compares the number of different entities with that of different surrogates (`distinct_ok`), and
`collisions` compares them over all rows. An entity whose image would be itself (a fixed point of its permutation, or letters of no
known script) gets a digest instead, and so do all entities of a row that fails its check (`n_repaired` counts both).

A run of 13 to 19 digits is a card if it has 16 digits, stands in groups or passes the Luhn check; others stay. Null texts stay null
and have no entities; empty and very long texts, empty tables, repeated rows and other columns, whatever their names, pass through.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "sedra-demonstration-key"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme|Mlle"
_SECRET_NAME = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: Given names that tell gender; a known one gives way to another of its own list.
MALE = """John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George
Edward Brian Kevin Peter Hans Klaus Jürgen Wolfgang Stefan Andreas Jean Pierre Michel Philippe Alain Nicolas François Laurent José
Juan Carlos Luis Miguel Javier Antonio Manuel Pedro Alejandro Fernando""".split()
FEMALE = """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Emma Anna
Maria Ursula Monika Petra Sabine Renate Helga Claudia Marie Nathalie Isabelle Sylvie Catherine Sophie Chantal Céline Carmen Ana Isabel
Dolores Pilar Teresa Cristina Laura Lucía Elena Rosa Marta Julia""".split()
#: Given names of further origin, each list for itself, so that a surrogate stays within it. The length of a list is of no matter.
MORE_MALE = """Ahmed Ali Amir Arjun Bilal Chen Dmitri Emre Hassan Hiroshi Ibrahim Igor Ivan Jin Kenji Khalid Kofi Kwame Mehmet Mohammed
Nikolai Omar Rajesh Ravi Sanjay Sergei Tariq Vikram Vladimir Wei Yusuf""".split()
MORE_FEMALE = """Aisha Ananya Anastasia Ayşe Chloë Deepika Fatima Hana Indira Irina Ji-woo Kavya Keiko Layla Leila Mei Meera Nadia Natasha
Olga Priya Sakura Svetlana Tatiana Xiu Yasmin Yuki Zainab Zehra Zeynep Zoë""".split()
SURNAMES = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Thompson Clark Lewis Robinson Walker Wright Green
Baker Adams Nelson Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Edwards Stewart Morris Murphy Cook Rogers Quinn
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schulz Koch Richter Klein Wolf Schröder Neumann Zimmermann Braun Krüger
Hofmann Lange Krause Lehmann Martin Bernard Dubois Durand Leroy Moreau Lefebvre Garnier Rousseau Fournier Girard Bonnet Dupont
García Rodríguez Martínez Hernández López González Pérez Sánchez Ramírez Torres Flores Rivera Gómez Díaz Fernández Moreno Jiménez Ruiz
Álvarez Romero Navarro Sharma Khan Patel Singh Kumar Gupta Nguyen Kim Lee Wang Li Zhang Tanaka Sato Suzuki Ivanov Petrov Hussain
Akhtar Yılmaz Kaya Kowalski Nowak Rossi Russo Ferrari Silva Santos Oliveira Pereira Costa""".split()
#: Lists of names that are not mixed, and share no name: given names by gender and origin, then family names.
GIVEN_LISTS = {"male": MALE, "female": FEMALE, "male 2": MORE_MALE, "female 2": MORE_FEMALE}


def _one_of(names) -> str:
    """A pattern of names, parted by their first letter, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for n in names:
        by.setdefault(n[0], []).append(n[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


_WORD = r"\p{Lu}[\p{L}'’\-]+"
_STARTS = "The|A|An|This|That|My|Our|Your|In|On|At|And|But|Or|If|When|Der|Die|Das|Ein|Eine|Und|Le|La|Les|Un|Une|Et|El|Los|Las|Una|De|Von|Van|New|Saint|St|Old|North|South|East|West"
_GIVEN = r"(?<![\p{L}0-9])(?=\p{Lu})" + _one_of(n for names in GIVEN_LISTS.values() for n in names) + r" (?=\p{Lu})"
_CUED = r"(?=\p{Lu})(?<=[:enostry] )(?<=(?:[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Ss]igned by|[Cc]ontact person:?|[Ff]ull name:|[Nn]ame:) )"
_KNOWN_FAMILY = rf"(?<![\p{{L}}0-9])(?=\p{{Lu}})(?!(?:{_STARTS}) ){_WORD} (?=\p{{Lu}})" + _one_of(SURNAMES) + r"(?![\p{L}'’\-])"
#: Kinds in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}0-9._%+\-])[\p{L}\p{M}0-9._%+\-]++@(?:[\p{L}\p{M}0-9\-]++\.){1,12}\p{L}{2,}",
    "secret": r"(?<![\p{L}0-9])" + _SECRET_NAME + r"[A-Za-z0-9_\-/+=.]{8,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "ipv6": r"(?<![\p{L}0-9:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}0-9:])",
    "key": r"(?<![\p{L}0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,})(?![\p{L}0-9])",
    "iban": r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}0-9])",
    "card": r"(?<![\p{L}0-9+])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![\p{L}0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,4}(?:[ .\-]?[0-9]{2,4}){1,5}|\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![\p{L}0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "hex": r"(?<![\p{L}0-9])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}0-9])",
    "name": rf"(?:(?<![\p{{L}}0-9])(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'’\-]*(?: {_WORD}){{0,2}}|{_GIVEN}{_WORD}(?: {_WORD})?|{_CUED}{_WORD}(?: {_WORD}){{0,2}}|{_KNOWN_FAMILY})",
}
#: None begins inside a word but an IP address; asked first, this spares most places of a text.
PATTERN = r"(?<![\p{L}0-9])(?:" + "|".join(PATTERNS.values()) + r")|(?<=\p{L})" + PATTERNS["ip"]
#: What any entity has: a digit, a sign that joins its parts, a key's beginning or a title. Read first, as it is cheap.
NEEDED = rf"[0-9@:=]|(?<![\p{{L}}0-9])(?:AKIA|ASIA|gh[pousr]_|sk-|(?:{_TITLES})\.? \p{{Lu}}|{_GIVEN}|{_CUED}|{_KNOWN_FAMILY})"

DIGITS = "0123456789"
_VIETNAMESE = "".join(map(chr, range(0x1EA1, 0x1EFA, 2)))
LETTERS = [
    "abcdefghijklmnopqrstuvwxyz", "àáâäãåæçèéêëìíîïñòóôöõøùúûüýÿ", "āăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžșțðþ", _VIETNAMESE,
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "іїєґўђѓѕјљњћќџ", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώϊϋ",
]
NAME_LETTERS = [
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâäãåèéêëìíîïòóôöõùúûüýÿ", "āăąēĕėęěĩīĭįōŏőœũūŭůűųŷ", "ćĉċčďđĝğġģĥħĵķĺļľłńņňŋŕŗřśŝşšţťŧŵźżžșțçñðþ", _VIETNAMESE,
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "іїєў", "ґђѓѕјљњћќџ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώϊϋ",
]
#: Letters without case, and the ranges of scripts without case whose code points are all letters: first and last.
CASELESS = ["ßıĸŉ", "ΐΰς"]
RANGES = ((0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0x995, 0x9A8), (0xE01, 0xE30), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x660, 0x669), (0x966, 0x96F))


def _classes(letters: list[str]) -> list[str]:
    return [DIGITS, *letters, *[x.upper() for x in letters], *CASELESS]


GENERIC, NAMES, HEX = _classes(LETTERS), _classes(NAME_LETTERS), [DIGITS, "abcdef", "ABCDEF"]


def _constant(values: list[str]) -> Column:
    """An array of strings as one expression that is folded."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _shift(key: str, kind: Column | str, before: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|"), _text(kind), F.lit("|"), before), 256), 1, 12), 16, 10).cast("long")


def _one_way(chars: Column, kind: Column, key: str, sets: Column) -> Column:
    """The characters moved within their classes, as an array. With more classes than hexadecimals have, scripts without case move too, within their ranges."""
    ranges = F.from_json(F.lit(json.dumps([{"a": a, "n": b - a + 1} for a, b in RANGES])), "array<struct<a:int,n:int>>")

    def moved_in(s, c, before):
        return F.substring(s, (F.pmod(F.instr(s, c) - 1 + _shift(key, kind, before), F.length(s)) + 1).cast("int"), F.lit(1))

    def moved_on(r, c, before):
        to = r["a"] + F.pmod(F.ascii(c) - r["a"] + _shift(key, kind, before), r["n"])
        return F.decode(F.unhex(F.lpad(F.hex(to), 4, "0")), "UTF-16BE")

    def step(state, c):
        inside = _let(F.get(F.filter(sets, lambda s: F.instr(s, c) > 0), F.lit(0)), lambda s: moved_in(s, c, state["before"]))
        of = F.filter(ranges, lambda r: (F.ascii(c) >= r["a"]) & (F.ascii(c) < r["a"] + r["n"]))
        beyond = F.when((F.ascii(c) > 0x5CF) & (F.size(sets) > len(HEX)), _let(F.get(of, F.lit(0)), lambda x: moved_on(x, c, state["before"])))
        out = lambda m: F.struct(F.concat(state["out"], F.array(F.coalesce(m, c))).alias("out"), F.when(m.isNotNull(), F.concat(state["before"], F.lower(c))).otherwise(state["before"]).alias("before"))
        return _let(F.coalesce(inside, beyond), out)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("before"))
    return F.aggregate(chars, start, step)["out"]


def cipher(value: Column, kind: Column | str, key: str = KEY, classes: list[str] | Column = GENERIC) -> Column:
    """A keyed permutation of the strings of value's format; what is in no class stays and has no influence."""
    kind, sets = _text(kind), classes if isinstance(classes, Column) else _constant(classes)
    forth = _one_way(F.filter(F.split(value, ""), lambda c: c != ""), kind, key, sets)
    return F.array_join(F.reverse(_one_way(F.reverse(forth), F.concat(kind, F.lit("-back")), key, sets)), "")


def luhn(body: Column) -> Column:
    """The check digit for a string of digits."""
    doubled = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    digits = F.transform(F.reverse(F.split(body, "")), lambda x, i: F.when(i % 2 == 0, doubled(x.cast("int"))).otherwise(x.cast("int")))
    return (10 - F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10) % 10


def _plain(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _but_last(m: Column) -> Column:
    return F.substring(m, F.lit(1), F.length(m) - 1)


def _with_luhn(m: Column, head: Column) -> Column:
    """head, the image of all but m's last digit, with a last one that is right, or as far off as m's."""
    offset = F.pmod(F.substring(m, -1, 1).cast("int") - luhn(_plain(_but_last(m))), F.lit(10))
    return F.concat(head, ((luhn(_plain(head)) + offset) % 10).cast("string"))


def _ip(m: Column, key: str) -> Column:
    def step(kind):
        def f(state, o):
            n = F.pmod(o.cast("int") + _shift(key, kind, state["before"]), F.lit(256)).cast("string")
            return F.struct(F.concat(state["out"], F.array(n)).alias("out"), F.concat(state["before"], F.lit("."), o).alias("before"))

        return f

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("before"))
    forth = F.aggregate(F.split(m, r"\."), start, step("ip"))["out"]
    return F.array_join(F.reverse(F.aggregate(F.reverse(forth), start, step("ip-back"))["out"]), ".")


#: Country calling codes: the only ones of one digit, those of two, and any three digits else.
_CODE = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))"
_CLASS_SETS = {"generic": GENERIC, "digits": [DIGITS], "hex": HEX}


def _parts(m: Column, kind: Column) -> Column:
    """An entity as an array of (keep, body, kind, set): text that stays, and then text to permute, as what, in which classes."""
    part = lambda keep, body, what, name: F.struct(keep.alias("keep"), body.alias("body"), what.alias("kind"), F.lit(name).alias("set"))
    after = lambda head: F.substring(m, F.length(head) + 1, F.length(m))
    none, domain = F.lit(""), F.substring_index(m, "@", -1)
    top = F.substring_index(domain, ".", -1)
    named, code = F.regexp_extract(m, "^(" + _SECRET_NAME + ")", 1), F.regexp_extract(m, _CODE, 1)
    fixed = F.regexp_extract(m, "^(AKIA|ASIA|gh._|sk-)", 1)
    return (
        F.when(kind == "email", F.array(part(none, F.substring_index(m, "@", 1), kind, "generic"), part(F.lit("@"), F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), F.lit("domain"), "generic"), part(F.concat(F.lit("."), top), none, kind, "generic")))
        .when((kind == "secret") & after(named).rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.array(part(named, after(named), F.lit("hex"), "hex")))
        .when(kind == "secret", F.array(part(named, after(named), kind, "generic")))
        .when(kind == "card", F.array(part(none, _but_last(m), kind, "digits")))
        .when(kind == "phone", F.array(part(code, after(code), kind, "digits")))
        .when(kind == "ssn", F.array(part(none, m, kind, "digits")))
        .when(kind == "key", F.array(part(fixed, after(fixed), kind, "generic")))
        .when(kind == "iban", F.array(part(none, F.substring(m, F.lit(5), F.length(m)), kind, "generic")))
        .otherwise(F.array(part(none, m, kind, "hex")))  # hex, ipv6
    )


def mod97(chars: Column) -> Column:
    """An account number's remainder: letters count as 10 to 35."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def iban_digits(country: Column, body: Column) -> Column:
    """The right check digits, 2 to 98."""
    return 98 - mod97(F.split(F.concat(F.regexp_replace(body, " ", ""), country, F.lit("00")), ""))


def _with_check_digits(m: Column, body: Column) -> Column:
    """body, the image of what follows the check digits, behind digits that are right, or as far off as m's; 00, 01 and 99, never right, stay."""
    country, digits = F.substring(m, 1, 2), F.substring(m, 3, 2).cast("int")
    moved = F.pmod(iban_digits(country, body) + digits - iban_digits(country, F.substring(m, F.lit(5), F.length(m))) - 2, F.lit(97)) + 2
    return F.concat(country, F.lpad(F.when(digits.isin(0, 1, 99), digits).otherwise(moved).cast("string"), 2, "0"), body)


def _moved(w: Column, names: list[str], kind: str, key: str) -> Column:
    """Another name of the list, by a keyed rotation: never the same one. Null if w is on no place of it; capitals as w has them."""
    listed = _constant(names)
    place = F.coalesce(F.nullif(F.array_position(listed, w), F.lit(0)), F.nullif(F.array_position(listed, F.initcap(w)), F.lit(0)))
    by = F.pmod(_shift(key, kind, F.lit("by")), F.lit(len(names) - 1)) + 1
    other = F.element_at(listed, (F.pmod(place - 1 + by, F.lit(len(names))) + 1).cast("int"))
    return F.when(place.isNotNull(), F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(other)).otherwise(other))


def _name(m: Column, key: str) -> Column:
    title = F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1)
    words = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
    known = _constant([n for names in (*GIVEN_LISTS.values(), SURNAMES) for n in names])
    on_list = lambda w: F.array_contains(known, w) | F.array_contains(known, F.initcap(w))

    def unlisted(w):
        end = F.regexp_extract(w, "(?<=..)([aoàáòóаоя])$", 1)
        once = lambda x: F.concat(cipher(F.substring(x, F.lit(1), F.length(x) - F.length(end)), "name", key, NAMES), end)
        # Permuted again while the image is a listed name: a permutation of the names on no list.
        return F.aggregate(F.sequence(F.lit(0), F.lit(4)), w, lambda x, i: F.when((i == 0) | on_list(x), once(x)).otherwise(x))

    def one(w, i):
        given = F.when(i == 0, F.coalesce(*[_moved(w, names, kind, key) for kind, names in GIVEN_LISTS.items()]))
        return F.coalesce(given, _moved(w, SURNAMES, "family", key), unlisted(w))

    return F.concat(title, F.array_join(F.transform(words, one), " "))


def _digest(m: Column, kind: Column, key: str) -> Column:
    """A surrogate for what no permutation can move: coreferent and, up to a 64-bit hash, distinct."""
    hexed = F.substring(F.sha2(F.concat(F.lit(f"{key}|digest|"), kind, F.lit("|"), _same(kind, m)), 256), 1, 16)
    letters = F.translate(hexed, "0123456789abcdef", "aeiouybdfgklmnrs")
    name = F.concat(F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1), F.initcap(letters))
    return F.when(kind == "email", F.concat(letters, F.lit("@"), F.substring(letters, 1, 8), F.lit(".invalid"))).when(kind == "name", name).otherwise(F.concat(kind, F.lit("-"), hexed))


def kind_of(m: Column) -> Column:
    """One of PATTERNS, or number for digits that are no card."""
    out = F.when(m.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind in list(PATTERNS)[1:]:
        if kind == "card":
            digits = F.regexp_replace(m, "[^0-9]", "")
            is_card = (F.length(digits) == 16) | m.rlike("[ -]") | (luhn(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1).cast("int"))
            out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(is_card, F.lit(kind)).otherwise("number"))
        else:
            out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("name")


def surrogate(m: Column, kind: Column, key: str = KEY) -> Column:
    sets = F.create_map(*[x for name, classes in _CLASS_SETS.items() for x in (F.lit(name), _constant(classes))])
    moved = F.array_join(F.transform(_parts(m, kind), lambda p: F.concat(p["keep"], cipher(p["body"], p["kind"], key, F.element_at(sets, p["set"])))), "")
    finish = lambda x: F.when(kind == "card", _with_luhn(m, x)).when(kind == "iban", _with_check_digits(m, x)).otherwise(x)
    return F.when(kind == "number", m).when(kind == "ip", _ip(m, key)).when(kind == "name", _name(m, key)).otherwise(_let(moved, finish))


def entities(text: Column, key: str = KEY) -> Column:
    """What the pattern finds in a text, in order, as an array of (kind, value, surrogate, repaired); kind number is no entity and stays."""
    found = F.when(text.rlike(NEEDED) & text.rlike(PATTERN), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))

    def with_surrogate(e, image):
        stays = (e["kind"] != "number") & (image == e["value"])
        return F.struct(e["kind"].alias("kind"), e["value"].alias("value"), F.when(stays, _digest(e["value"], e["kind"], key)).otherwise(image).alias("surrogate"), stays.alias("repaired"))

    moved = F.transform(kinds, lambda e: F.struct(e.alias("e"), surrogate(e["value"], e["kind"], key).alias("image")))
    return F.transform(moved, lambda x: with_surrogate(x["e"], x["image"]))


def _counted(found: Column) -> Column:
    return F.filter(found, lambda e: e["kind"] != "number")


def distinct(found: Column) -> Column:
    """Whether different entities have different surrogates, and equal ones equal."""
    values = F.array_distinct(F.transform(_counted(found), lambda e: F.concat(e["kind"], F.lit("|"), _same(e["kind"], e["value"]))))
    images = F.array_distinct(F.transform(_counted(found), lambda e: F.concat(e["kind"], F.lit("|"), _same(e["kind"], e["surrogate"]))))
    return F.size(values) == F.size(images)


def repaired(found: Column, key: str = KEY) -> Column:
    """found, with digests for all where the surrogates collide."""
    anew = F.transform(found, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), F.when(e["kind"] == "number", e["value"]).otherwise(_digest(e["value"], e["kind"], key)).alias("surrogate"), (e["kind"] != "number").alias("repaired")))
    return F.when(distinct(found), found).otherwise(anew)


def replaced(text: Column, found: Column) -> Column:
    """The text with the surrogates of `found`, its own entities, in their places."""
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), found, lambda gap, e: F.concat(gap, F.coalesce(e["surrogate"], F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def _same(kind: Column, value: Column) -> Column:
    """Equal for the spellings of one entity."""
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(value, r"[ .()\-]", "")).otherwise(F.lower(value))


def _found(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """(row, found): a row of docs as a struct, and its entities; so no column of docs can clash."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.withColumn("found", entities(F.coalesce(F.col("row")[text_col], F.lit("")), key))
    return rows.withColumn("found", repaired(F.col("found"), key))


def pseudonymised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(id, text, n_entities, kinds, surrogates, distinct_ok, n_repaired) for each row of docs."""
    rows = _found(docs.select(id_col, text_col), text_col, key)
    text = replaced(F.col("row")[text_col], F.col("found"))
    own = rows.select(F.col("row")[id_col].alias("id"), text.alias("text"), _counted(F.col("found")).alias("found"))
    return own.select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), F.size("found").cast("long").alias("n_entities"), F.transform("found", lambda e: e["kind"]).alias("kinds"),
        F.transform("found", lambda e: e["surrogate"]).alias("surrogates"), distinct(F.col("found")).alias("distinct_ok"), F.size(F.filter("found", lambda e: e["repaired"])).cast("long").alias("n_repaired"),
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", key: str = KEY) -> DataFrame:
    """docs with surrogates in the text, and chars_col, where docs has it, its new length; all columns stay."""
    rows = _found(docs, text_col, key)
    row, text = F.col("row"), replaced(F.col("row")[text_col], F.col("found"))
    chars = F.when(F.size("found") > 0, F.length(text)).otherwise(row[chars_col]).cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None
    return rows.select(*[(text if c == text_col else chars if c == chars_col else row[c]).alias(c) for c in docs.columns])


def collisions(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """(kind, surrogate, n): surrogates that stand for more than one entity, over all rows; none are expected."""
    each = docs.select(F.explode(_counted(entities(F.coalesce(F.col(text_col), F.lit("")), key))).alias("e")).select("e.*")
    pairs = each.select("kind", _same(F.col("kind"), F.col("surrogate")).alias("surrogate"), _same(F.col("kind"), F.col("value")).alias("value")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
