"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detected entities are replaced by others of their type and shape.  Digits, hexadecimal digits and letters run
through a keyed Feistel network over their own alphabet, a bijection: one entity has one surrogate wherever it
occurs (coreference), and two entities never share one (distinctness), without any state shared between tasks.
What a type demands is kept: Luhn-valid cards stay valid, addresses stay in their kind of network, IBANs get right
check digits, letters stay in their script and case, known given names are permuted within the list of their
gender and script, and unknown names never land in a list (the cipher is walked on until they don't).  Card numbers
and IBANs count as such only with right check digits.  ``collisions`` checks a corpus: it returns the surrogates that
two entities share and the entities that have two surrogates, of which there are none.
Phone numbers are the same entity however they are written, with country code or, in North America, without; others
that start with 0 keep it and stay apart from both.  Dates of birth (dates after words that say so) stay dates, in
their century and their way of writing; of street addresses number and name change, and kinds of street stay.  A
person whom an honorific, a known given name or a phrase of introduction shows is replaced wherever the document has a
word of that name, along with the given name that stands before a surname so found.
A bijection may have fixed points: of N values of one shape about one in N keeps its value.

Defined results: a null text stays null and an empty one empty, with no entities; repeated rows get equal results;
a null doc_id is carried; texts without entities come back as they were; an empty table gives no rows; other
columns are carried by ``anonymised`` and not read by ``replaced``.
"""

from __future__ import annotations

import calendar
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import in_slices, table

#: The session setting that holds the key, and the one that the registered query and the tests fall back to.
KEY_SETTING, PUBLIC_KEY = "spark.chronolith.surrogates.key", b"public key of the registered query"
KINDS = ["secret", "email", "iban", "card", "birth_date", "phone", "ip", "national_id", "address", "name"]
ROUNDS = 8

# fixed values: given names by gender and script, honorifics
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Camille Carmen Charlotte Claire Clara Elena Emma Eva Hannah Helena Ingrid Isabel Julia Laura Lucia Maria Marie Martina Nina Olivia Paula Sabine Sofia Sophie Teresa Ursula Victoria".split(),
    ("m", "latin"): "Alexander Andreas Antoine Antonio Carlos Charles Daniel David Diego Edward Felix Fernando Henri Jack Jacques James Javier Johann Jorge Klaus Louis Lukas Martin Michael Miguel Oliver Pablo Philippe Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("f", "greek"): "Αικατερίνη Άννα Βασιλική Ελένη Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
_GENDER = {name: who for who, names in GIVEN.items() for name in names}
_HONORIFICS = "Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|господин|госпожа|Господин|Госпожа|κύριος|κυρία|Κύριος|Κυρία"
# fixed values: what follows an honorific without being a person's name, and words that start sentences before one
_NO_PERSONS = frozenset("America Ambassador Chairman Commissioner Congeniality Director Justice Mayor Minister Pepper President Prime Secretary Speaker Universe World".split())
_STARTERS = frozenset(
    "A After Also Although An And Are As Ask At Because Before Both But By Call Can Dear Did Do Does Either Even For From Had Has Have He Hello Her Here Hi His How However I If In Is It Its Later Let Like Meanwhile My No Not Now Of On Only Or Our She Should Since So Thank Thanks That The Their Then There These They This Those Though To Today Was We Were What When Where Which While Who Why Will With Would Yes Yesterday You Your"
    " Aber Als Das Dann Der Die Ein Eine Und Wenn Et Le Les La Mais Puis Quand Si Un Une Cuando El Las Los Pero Una Y".split()
)
# fixed values: months in the languages of the honorifics' Latin ones, words that a date of birth follows, kinds of street
_MONTHS = [
    "January February March April May June July August September October November December".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
]
_BORN = "born on|born|date of birth|birth date|dob|né le|née le|date de naissance|geboren am|geburtsdatum|nacido el|nacida el|fecha de nacimiento"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square"
_FRENCH_STREETS = "rue|avenue|boulevard|place|quai|impasse"
_SPANISH_STREETS = "calle|avenida|plaza|paseo"
_GERMAN_STREETS = "straße|strasse|gasse|allee|platz|weg"
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœš", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_OF = {c: (n, i) for n, letters in enumerate(_ALPHABETS) for i, c in enumerate(letters)}
_VOWELS = set("aeiou")
#: Country codes of two digits; 1 and 7 have one, others three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яα-ω]"
_NAME = rf"{_CAPITAL}[^\W\d_]+(?:-{_CAPITAL}[^\W\d_]+)?"
_DATE = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}([./-])\d{{1,2}}\2\d{{4}}|\d{{1,2}}\.?(?: de)? (?:{'|'.join(x for names in _MONTHS for x in names)})(?: de)? \d{{4}}|(?:{'|'.join(_MONTHS[0])}) \d{{1,2}},? \d{{4}}"
_PATTERNS: list[tuple[str, re.Pattern[str], int]] = [
    ("secret", re.compile(r"""(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd|auth[_-]?token|private[_-]?key)\b\s*(?:=|:)\s*["']?([^\s"'<>]{8,})"""), 1),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}|(?=[0-9A-F]*[A-F])(?=[0-9A-F]*[0-9])[0-9A-F]{32,64})\b"), 0),
    ("email", re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%-]{0,63})@(?:[\w-]+\.)+[^\W\d_]{2,24}(?![\w-])"), 0),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("card", re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]|\.\d)"), 0),
    ("birth_date", re.compile(rf"(?i)(?<!\w)(?:{_BORN})(?: is| was)?:? +({_DATE})"), 1),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,4}(?P<by>[ .-])\d{2,4}(?:(?P=by)\d{2,4}){1,3})(?![\w]|[.-]\d)"), 0),
    ("ip", re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)"), 0),
    ("ip", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![\w:])"), 0),
    ("national_id", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0),
    ("address", re.compile(rf"(?<![\w.,-])[1-9]\d{{0,4}} (?:{_NAME} ){{1,3}}(?:{_STREETS})\b(?! [A-Z][a-z]+ (?:{_STREETS})\b)"), 0),
    ("address", re.compile(rf"(?<![\w.,-])[1-9]\d{{0,3}},? (?:{_FRENCH_STREETS}) (?:de la |de l['’]|des |du |de |d['’])?{_NAME}(?: {_NAME})?"), 0),
    ("address", re.compile(rf"\b(?i:{_SPANISH_STREETS}) (?:de la |de los |del |de )?{_NAME}(?: {_NAME})?,? [1-9]\d{{0,3}}(?![\w.,-]?\d)"), 0),
    ("address", re.compile(rf"\b{_CAPITAL}[^\W\d_]+(?:{_GERMAN_STREETS}) [1-9]\d{{0,3}}(?![\w.,-]?\d)"), 0),
]
#: Phrases that a name follows, in the languages of the honorifics.
_INTRODUCTIONS = r"(?i:my name is|name:|signed by|written by|mein name ist|ich heiße|je m'appelle|je m’appelle|me llamo|mi nombre es|меня зовут|με λένε|με λενε)"
_NAMES = [
    re.compile(rf"(?<!\w){_INTRODUCTIONS} ({_NAME}(?: {_NAME})?)"),
    re.compile(rf"\b(?:{_HONORIFICS})\.? ({_NAME}(?: {_NAME})?)"),
    re.compile(rf"\b((?:{'|'.join(sorted(_GENDER, key=len, reverse=True))}) {_NAME})\b"),
]
_MAYBE_NAMED = re.compile(rf"\b(?:{_HONORIFICS}|{'|'.join(sorted(_GENDER, key=len, reverse=True))})\b|(?<!\w){_INTRODUCTIONS} ")
_TRIGGER = re.compile(r"[0-9@=:]")


class Cipher:
    """Keyed bijections over strings of one alphabet and over ranges."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def number(self, tweak: str, *values: int) -> int:
        text = tweak + "|" + "|".join(map(str, values))
        return int.from_bytes(hashlib.blake2b(text.encode(), key=self.key, digest_size=16).digest(), "little")

    def digits(self, tweak: str, value: list[int], radix: int) -> list[int]:
        """A bijection of digit lists of one length: unbalanced Feistel rounds."""
        n = len(value)
        if n == 1:
            return [(value[0] + self.number(tweak, radix)) % radix]
        half = n // 2
        a, b = _joined(value[:half], radix), _joined(value[half:], radix)
        size_a, size_b = radix**half, radix ** (n - half)
        for r in range(ROUNDS):
            if r % 2 == 0:
                a = (a + self.number(tweak, r, n, radix, b)) % size_a
            else:
                b = (b + self.number(tweak, r, n, radix, a)) % size_b
        return _parted(a, half, radix) + _parted(b, n - half, radix)

    def within(self, tweak: str, value: int, size: int) -> int:
        """A bijection of range(size): the digits' cipher, walked until inside."""
        if size < 2:
            return value
        bits = max(2, (size - 1).bit_length())
        while True:
            value = _joined(self.digits(tweak, _parted(value, bits, 2), 2), 2)
            if value < size:
                return value

    def letters(self, tweak: str, text: str, fixed: Callable[[int, str], bool] = lambda i, c: False) -> str:
        """A bijection of texts of one shape: each alphabet's letters are permuted among themselves, cases stay."""
        places: dict[int, list[int]] = {}
        out = list(text)
        for i, c in enumerate(text):
            if not fixed(i, c) and (at := _OF.get(c if c in _OF else c.lower())):
                places.setdefault(at[0], []).append(i)
        for n, own in places.items():
            letters = _ALPHABETS[n]
            new = self.digits(f"{tweak}/{n}", [_OF[text[i] if text[i] in _OF else text[i].lower()][1] for i in own], len(letters))
            for i, d in zip(own, new):
                c = letters[d]
                out[i] = c.upper() if text[i].isupper() and len(c.upper()) == 1 else c
        return "".join(out)


def _joined(digits: list[int], radix: int) -> int:
    value = 0
    for d in digits:
        value = value * radix + d
    return value


def _parted(value: int, n: int, radix: int) -> list[int]:
    out = []
    for _ in range(n):
        value, d = divmod(value, radix)
        out.append(d)
    return out[::-1]


def _refill(shape: str, new: str, wanted: Callable[[str], bool]) -> str:
    """``shape`` with its wanted characters replaced in turn."""
    it = iter(new)
    return "".join(next(it) if wanted(c) else c for c in shape)


def _luhn(digits: list[int]) -> int:
    """The check digit of what stands before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(cipher: Cipher, text: str) -> str:
    d = [int(c) for c in text if c.isdigit()]
    off = (d[-1] - _luhn(d[:-1])) % 10  # 0 for a valid number; kept, so valid and invalid numbers stay apart
    body = cipher.digits("card", d[:-1], 10)
    return _refill(text, "".join(map(str, [*body, (_luhn(body) + off) % 10])), str.isdigit)


def _country(digits: str) -> str:
    """The country code that an international number starts with."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3]


def _is_local(text: str) -> bool:
    """Whether a phone number starts with a trunk 0 and hasn't the North American shape."""
    return text[0] == "0" and [len(x) for x in re.findall(r"\d+", text)] != [3, 3, 4]


def _phone(cipher: Cipher, text: str) -> str:
    """Digits after the country code are ciphered, however they are written; numbers without a code have the North
    American shape, or another one with a leading 0, which stays."""
    if _is_local(text):
        new = cipher.digits("phone0", [int(c) for c in text[1:] if c.isdigit()], 10)
        return "0" + _refill(text[1:], "".join(map(str, new)), str.isdigit)
    trunk = text.find("(0)") if text[0] == "+" else -1  # dialled only inside the country
    at = [i for i, c in enumerate(text) if c.isdigit() and (trunk < 0 or i != trunk + 1)]
    code = _country("".join(text[i] for i in at)) if text[0] == "+" else ""
    at = at[len(code) :]
    out = list(text)
    for i, d in zip(at, cipher.digits(f"phone+{code or 1}", [int(text[i]) for i in at], 10)):
        out[i] = str(d)
    return "".join(out)


_NETWORKS = [(0x0A000000, 24), (0x7F000000, 24), (0xA9FE0000, 16), (0xAC100000, 20), (0xC0A80000, 16), (0xE0000000, 28), (0xF0000000, 28), (0, 24)]


def _ip(cipher: Cipher, text: str) -> str:
    if ":" in text:  # the first group says what kind of address it is
        value = int(ipaddress.IPv6Address(text))
        low = _joined(cipher.digits("ip6", _parted(value & ((1 << 112) - 1), 112, 2), 2), 2)
        new = str(ipaddress.IPv6Address(value >> 112 << 112 | low))
        return new.upper() if text != text.lower() else new
    parts = text.split(".")
    value = _joined([int(x) for x in parts], 256)
    for base, bits in _NETWORKS:
        if value >> bits == base >> bits:
            value = base | cipher.within(f"ip{base}", value & ((1 << bits) - 1), 1 << bits)
            break
    else:
        value = _joined(cipher.digits("ip", _parted(value, 32, 2), 2), 2)
        while any(value >> bits == base >> bits for base, bits in _NETWORKS):
            value = _joined(cipher.digits("ip", _parted(value, 32, 2), 2), 2)
    return ".".join(map(str, _parted(value, 4, 256)))


def _secret(cipher: Cipher, text: str) -> str:
    low = text.lower()
    if len(low) >= 16 and all(c in "0123456789abcdef" for c in low) and (text == low or text == text.upper()):
        new = "".join("0123456789abcdef"[d] for d in cipher.digits("hex", [int(c, 16) for c in low], 16))
        return new if text == low else new.upper()
    return cipher.letters("secret", text)


def _email(cipher: Cipher, text: str) -> str:
    at, dot = text.rindex("@"), text.rindex(".")
    labels = text[at + 1 : dot].lower().split(".")
    reserved = labels[-1] in ("example", "test", "invalid", "localhost")
    kept = at + 1 + sum(len(x) + 1 for x in labels[:-1]) if reserved else dot  # names reserved for examples and top levels stay
    return cipher.letters("email", text, lambda i, c: i >= kept)


def _iban(cipher: Cipher, text: str) -> str:
    country, check = text[:2], text[2:4]
    body = re.sub(r" ", "", text[4:])

    def right(body: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97

    off = (int(check) - right(body)) % 97
    new = cipher.letters("iban" + country, body)
    good = right(new)
    value = (good + off) % 97 if off else good
    return country + f"{value:02d}" + _refill(text[4:], new, lambda c: c != " ")


def _script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "я" else "greek" if "ά" <= c <= "ώ" else "latin"


def _word_of_name(cipher: Cipher, word: str, given: bool) -> str:
    if word.isupper() and len(low := word.capitalize()) == len(word) > 1:
        return _word_of_name(cipher, low, given or low in _GENDER).upper()
    who = _GENDER.get(word)
    if given and who:
        names = GIVEN[who]
        return names[cipher.within(f"given{who}", names.index(word), len(names))]
    low = word.lower()
    vowels = {i for i, c in enumerate(low) if c in _VOWELS}

    def step(text: str) -> str:
        out = list(text)
        for part, letters in ((sorted(vowels), "aeiou"), ([i for i, c in enumerate(low) if "a" <= c <= "z" and i not in vowels], "bcdfghjklmnpqrstvwxyz")):
            if part:
                new = cipher.digits(f"name{letters[0]}{len(text)}", [letters.index(out[i].lower()) for i in part], len(letters))
                for i, d in zip(part, new):
                    out[i] = letters[d].upper() if text[i].isupper() else letters[d]
        joined = "".join(out)
        return cipher.letters("name", joined, lambda i, c: "a" <= c.lower() <= "z" or c.isdigit())

    new = step(word)
    while new in _GENDER:  # the lists' names are images of one another
        new = step(new)
    return new


def _name(cipher: Cipher, text: str) -> str:
    words = text.split(" ")
    return " ".join("-".join(_word_of_name(cipher, p, i == 0 and len(words) > 1 or p in _GENDER) for p in w.split("-")) for i, w in enumerate(words))


def _date_of(text: str) -> tuple[int, int, int, list[tuple[int, int, str]]] | None:
    """Year, month and day, and (start, stop, field) of each as written; a first number over 12 is the day, else the
    second where it is one, and where both may be months the first.  None for no date."""
    names = {x.lower(): i + 1 for language in _MONTHS for i, x in enumerate(language)}
    parts = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+|[^\W\d_]{3,}", text)]
    words = [x for x in parts if not x[2].isdigit()]
    if words:
        month = words[0]
        day, year = (x for x in parts if x[2].isdigit())
        fields = [(year, "y"), (month, "m"), (day, "d")]
    elif len(parts[0][2]) == 4:
        fields = list(zip(parts, "ymd"))
    else:
        fields = list(zip(parts, "mdy" if int(parts[0][2]) <= 12 < int(parts[1][2]) else "dmy"))
    value = {f: names[x[2].lower()] if f == "m" and words else int(x[2]) for x, f in fields}
    if not (1 <= value["m"] <= 12 and value["y"] >= 1000 and 1 <= value["d"] <= calendar.monthrange(value["y"], value["m"])[1]):
        return None
    return value["y"], value["m"], value["d"], [(x[0], x[1], f) for x, f in fields]


def _birth_date(cipher: Cipher, text: str) -> str:
    """Another date of the century, as written.  Days 1-12, 13-28, 29, 30 and 31 are ciphered apart, so that what
    may be read as day or month still may, and every date exists; all ways of writing a date give one."""
    year, month, day, fields = _date_of(text)
    years = range(year // 100 * 100, year // 100 * 100 + 100)
    days, months = (range(1, 13) if day <= 12 else range(13, 29) if day <= 28 else range(day, day + 1)), list(range(1, 13))
    if day > 28:
        months = [m for m in months if calendar.monthrange(2001, m)[1] >= day]
    if (month, day) == (2, 29):
        months, years = [2], [y for y in years if calendar.isleap(y)]
    value = (days.index(day) * len(months) + months.index(month)) * len(years) + years.index(year)
    value = cipher.within(f"born{years[0]}/{days[0]}/{len(months)}", value, len(days) * len(months) * len(years))
    value, y = divmod(value, len(years))
    new = {"y": years[y], "m": months[value % len(months)], "d": days[value // len(months)]}
    out = text
    for a, b, f in sorted(fields, reverse=True):
        old = text[a:b]
        if old.isdigit():
            width = len(old) if old[0] == "0" or len(old) == 2 and "-" in text else 1
            fresh = f"{new[f]:0{width}d}"
        else:
            language = next(names for names in _MONTHS if old.lower() in [x.lower() for x in names] and names[month - 1].lower() == old.lower())
            fresh = language[new["m"] - 1]
            fresh = fresh.upper() if old.isupper() else fresh.lower() if old.islower() else fresh.capitalize()
        out = out[:a] + fresh + out[b:]
    return out


_KINDS_OF_STREET = frozenset(f"{_STREETS}|{_FRENCH_STREETS}|{_SPANISH_STREETS}|de|la|los|des|del|du".split("|"))


def _address(cipher: Cipher, text: str) -> str:
    """Number and name of a street are ciphered; the kind of street and small words stay."""

    def new(m: re.Match[str]) -> str:
        word = m[0]
        if word.isdigit():
            least = 10 ** (len(word) - 1)
            return str(least + cipher.within(f"house{len(word)}", int(word) - least, 9 * least))
        if word in _KINDS_OF_STREET or word.lower() in _KINDS_OF_STREET or len(word) == 1:
            return word
        kind = next((x for x in _GERMAN_STREETS.split("|") if word.endswith(x) and len(word) > len(x) + 1), "")
        return _word_of_name(cipher, word[: len(word) - len(kind)], False) + kind

    return re.sub(r"\d+|[^\W\d_]+", new, text)


_MAKERS: dict[str, Callable[[Cipher, str], str]] = {
    "secret": _secret,
    "email": _email,
    "iban": _iban,
    "card": _card,
    "phone": _phone,
    "ip": _ip,
    "national_id": lambda cipher, text: _refill(text, "".join(map(str, cipher.digits("national", [int(c) for c in text if c.isdigit()], 10))), str.isdigit),
    "birth_date": _birth_date,
    "address": _address,
    "name": _name,
}


def _right(kind: str, text: str) -> bool:
    """Whether the check digits of a card number or an IBAN are right, a date exists, a phone number has its digits and the name of a street starts no sentence."""
    if kind == "phone":
        n = sum(c.isdigit() for c in text)
        return 9 <= n and (n <= 12 or not _is_local(text))
    if kind == "birth_date":
        return _date_of(text) is not None
    if kind == "address":
        return _STARTERS.isdisjoint(x for x in re.findall(r"[^\W\d_]+", text) if x[0].isupper())
    if kind == "ip" and ":" in text:
        try:
            return int(ipaddress.IPv6Address(text)) >> 112 > 0
        except ValueError:
            return False
    if kind == "card":
        d = [int(c) for c in text if c.isdigit()]
        return d[-1] == _luhn(d[:-1])
    if kind == "iban":
        plain = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


def surrogate(cipher: Cipher, kind: str, text: str) -> str:
    """The surrogate of an entity.  A fixed point of the cipher keeps its value, so that no other entity takes it."""
    return _MAKERS[kind](cipher, text)


def _mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Other places of the words of the names found, also in capitals.  A word that stands more often in small
    letters is an ordinary one."""
    words = {p for a, b, kind in found if kind == "name" for w in text[a:b].split(" ") for p in (w, *w.split("-")) if len(p) > 1}
    if not words:
        return []
    forms = words | {w.upper() for w in words if len(w) > 2 and len(w.upper()) == len(w)} | {w.capitalize() for w in words if w.isupper()}
    places = re.compile(rf"\b(?:{'|'.join(re.escape(w) for w in sorted(forms | {w.lower() for w in words}, key=len, reverse=True))})\b")
    seen: dict[str, list[tuple[int, int]]] = {}
    for m in places.finditer(text):
        seen.setdefault(m[0], []).append(m.span())
    small = {w: len(spans) for w, spans in seen.items() if w == w.lower()}
    taken = bytearray(len(text))
    for a, b, _ in found:
        taken[a:b] = b"\1" * (b - a)
    large: dict[str, int] = {}
    for w, spans in seen.items():
        if w in forms:
            large[w.lower()] = large.get(w.lower(), 0) + len(spans)
    return [(a, b, "name") for w, spans in seen.items() if w in forms and small.get(w.lower(), 0) <= large[w.lower()] for a, b in spans if not any(taken[a:b])]


_BEFORE = re.compile(rf"(?:^|(?<=[^\w.-]))({_NAME}) $")
_HONORIFIC = frozenset(_HONORIFICS.split("|"))


def _given_before(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Given names that stand before names found: capitalised words that neither start sentences as a rule nor stand in
    small letters elsewhere in the text."""
    out, small = [], None
    for a, b, kind in found:
        m = _BEFORE.search(text, max(0, a - 60), a) if kind == "name" else None
        if not m or m[1] in _STARTERS or m[1] in _HONORIFIC or m[1].isupper() != text[a:b].isupper() or any(m.start(1) < y and x < m.end(1) for x, y, _ in found + out):
            continue
        small = small if small is not None else set(re.findall(r"[^\W\d_]+", text))
        if not any(p.lower() in small for p in m[1].split("-")):
            out.append((*m.span(1), "name"))
    return out


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the entities of a text, in order; of those that overlap, the kind named first in KINDS wins."""
    found: list[tuple[int, int, str]] = []
    if _TRIGGER.search(text):
        for kind, pattern, group in _PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                if not _right(kind, m[group]):
                    continue
                a, b = m.span(group)
                if kind == "secret":
                    b = a + len(text[a:b].rstrip(".,;:!?)]}#*$%&|"))
                    if b - a < 8:
                        continue
                if all(b <= x or a >= y for x, y, _ in found):
                    found.append((a, b, kind))
    if _MAYBE_NAMED.search(text):
        for pattern in _NAMES:
            for m in pattern.finditer(text):
                a, b = m.span(1)
                if m[1].split(" ")[0] not in _NO_PERSONS and all(b <= x or a >= y for x, y, _ in found):
                    found.append((a, b, "name"))
        found += _mentions(text, found)
        if given := _given_before(text, found):
            found += given
            found += _mentions(text, found)
    return sorted(found)


def replace(text: str | None, cipher: Cipher) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities' spans in the original."""
    if not text:
        return text, []
    found = entities(text)
    if not found:
        return text, found
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], surrogate(cipher, kind, text[a:b])]
        at = b
    return "".join([*out, text[at:]]), found


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities, and a count of each kind."""
    names = ["doc_id", "text", "n_entities", *[f"n_{k}" for k in KINDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for batch in in_slices(batches, "text"):
            rows = [replace(t, cipher) for t in batch.column("text").to_pylist()]
            columns = [pa.array([t for t, _ in rows], pa.string()), pa.array([len(f) for _, f in rows], pa.int64())]
            columns += [pa.array([sum(x[2] == k for x in f) for _, f in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, n_entities long, " + ", ".join(f"n_{k} long" for k in KINDS))


def anonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of ``docs`` with surrogates in text and, where the column exists, n_chars to match; all columns as they came."""

    @F.pandas_udf("string")
    def swap(text: pd.Series) -> pd.Series:
        cipher = Cipher(key)
        return pd.Series([replace(t, cipher)[0] for t in text.tolist()], dtype=object)

    out = docs.withColumn("text", swap(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _same_entity(kind: str, text: str) -> str:
    """What all ways of writing one entity have in common."""
    if kind == "phone":
        digits = "".join(c for c in text.replace("(0)", "") if c.isdigit())
        if _is_local(text):
            return "local " + digits
        return digits if text[0] == "+" else "1" + digits
    if kind == "birth_date":
        return str(_date_of(text)[:3])
    if kind == "ip" and ":" in text:
        return str(int(ipaddress.IPv6Address(text)))
    return text.replace(" ", "").replace("-", "") if kind in ("card", "iban") else text.lower() if kind == "email" else text


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, side, value, n): surrogates of several entities, or entities with several surrogates, by digests; none are expected.

    Entities and surrogates are reduced to distinct pairs of digests before they meet, so a hot value costs a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        digest = lambda kind, x: hashlib.blake2b(f"{kind}|{x}".encode(), digest_size=16).hexdigest()
        for batch in in_slices(batches, "text"):
            pairs = set()
            for t in batch.column("text").to_pylist():
                for a, b, kind in entities(t or ""):
                    for own in t[a:b].split(" ") if kind == "name" else [t[a:b]]:
                        new = surrogate(cipher, kind, t[a:b]).split(" ")[t[a:b].split(" ").index(own)] if kind == "name" else surrogate(cipher, kind, own)
                        pairs.add((kind, digest(kind, _same_entity(kind, own)), digest(kind, _same_entity(kind, new))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*pairs) if pairs else ([], [], []))], names=["kind", "entity", "surrogate"])

    pairs = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    shared = pairs.groupBy("kind", F.lit("surrogate").alias("side"), F.col("surrogate").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    split = pairs.groupBy("kind", F.lit("entity").alias("side"), F.col("entity").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return shared.unionByName(split).where("n > 1")


def key_of(spark: SparkSession) -> bytes:
    """The session's key; without one the public key, whose surrogates anyone can turn back."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else PUBLIC_KEY


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents"), key_of(spark))
