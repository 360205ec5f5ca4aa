"""Surrogates for personal data and secrets: keyed, of the same type and format, distinct and coreferent.

Detected are e-mail, IPv4 and IPv6 addresses, phone, payment card (by checksum), social security and IBAN numbers
(by checksum), secrets after a telling name or with a telling prefix, bearer and web tokens, names after a title, in upper case too, with
particles between their parts, and their other mentions, earlier ones too. A given name that is a word as well begins a sentence as a word unless a
family name follows. Phone numbers of ten digits without a country agree with those of country 1; other national forms aren't found. A secret after a name is all that its quotes hold, or all up to a blank. Each entity has a
type and a normal form, in which its spellings agree; equal normal forms get equal surrogates everywhere.

The key is the caller's or that of the session (`KEY_SETTING`); without one nothing is replaced, as whoever knows the key
can undo the surrogates. A surrogate comes from a keyed permutation of the normal form's free characters, each within its
own alphabet, so digits stay digits, letters keep their case, lengths and punctuation stay, checksums are made right, and
different values of one shape get different surrogates. Private and other special IP ranges stay what they are. Mail
domains keep their labels' shapes, under a reserved last label. Names are built of syllables of their script with an ending
of the title's gender, given and family names apart, so that shorter mentions still agree. A given name after a
title that tells no gender takes the one that the document, or else the whole corpus, tells of it. Later attempts
make names and domains longer, so they don't run out.

Collision checks: all entities of the corpus are gathered once each. A surrogate that is itself an entity of
the corpus, or that two entities share, is dropped, and all but the smallest of the sharers try again with the
next attempt number, until none is left. Where a corpus fills the space of a shape, as it can with a private network, no
surrogate is free of real values: after `FULL` attempts all values of that shape take one permutation, distinct still, and one that leaves none of
them as it is. No value is its own surrogate. These
exceptions go to the workers by broadcast up to `MAX_BROADCAST` of them; beyond that, each document gets its own by a join.

Null texts stay null; empty ones stay empty. Texts of any length are read whole, in time proportional to their length, and
Python holds a few MB of them at a time. Repeated rows change alike. An empty table gives an empty one. Documents without an
entity are unchanged; all other columns pass through, whatever their names. Entities don't span lines.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .support import Stored, documents, free_name, groups

KEY_SETTING = "spark.corvane.surrogate.key"
MAX_BROADCAST = 50_000
MAX_ATTEMPTS = 64
#: Attempts after which the values of a full shape take one permutation, and the types whose shapes a corpus can fill.
FULL = 12
FILLABLE = ("ip", "ipv6", "phone", "ssn", "card", "secret", "iban")

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

_KINDS = [_DIGITS, _LOWER, _UPPER, "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
_ALPHABETS = {c: a for a in _KINDS for c in a}
#: The fewest characters of a secret that a permutation can change.
LEAST_FREE = 3
#: Characters that are permuted as one number.
BLOCK = 64

#: Titles and the gender that they tell.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
    "Dr": "n", "Prof": "n",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
TITLES |= {t.upper(): gender for t, gender in TITLES.items()}
#: What stands in lower case between the parts of a name.
PARTICLES = "van von de der den del della di da dos das du la le ter ten zu zum bin ibn al el".split()
#: Given names that are words too. At the start of a sentence they are a name only before a family name.
WORD_NAMES = frozenset("will mark may rose grace hope faith bill art frank jack pat sue drew chase dawn june april august summer joy ivy ray rob nick don grant miles penny rich victor wade ward".split())
#: Calling codes of countries with one and two digits; all others have three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: By script, syllables and the endings of given names by gender, and of family names.
NAME_PARTS = {
    "latin": ("ba be da de fa ga ka ke la le li lo ma me mi na ne ni ra re ri ro sa se ta te ti va vi za".split(), {"m": "no", "f": "na", "n": "ne"}, "ner"),
    "cyrillic": ("ба бе да де ва га ка ла ле ли ма ме ми на не ни ра ре ри са се та те ти за зе".split(), {"m": "слав", "f": "слава", "n": "ко"}, "енко"),
    "greek": ("βα γα δα θε κα κε λα λε λι μα με να νε νι πα πε ρα ρε ρι σα σε τα τε τι φα φε".split(), {"m": "νος", "f": "νη", "n": "νι"}, "ίδης"),
}

_HOST = "A-Za-z0-9\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERN = re.compile(
    # An address begins where a run of its characters does, and a run is never read twice, so long runs cost no more than their length.
    r"(?P<email>(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<mail>[A-Za-z0-9][A-Za-z0-9._%+-]*+"
    rf"@[{_HOST}](?:[{_HOST}-]*[{_HOST}])?(?:\.[{_HOST}](?:[{_HOST}-]*[{_HOST}])?)*\.[A-Za-z]{{2,}}))"
    r"|(?P<secret>(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*"
    r"(?:\"(?P<double>(?:\\.|[^\"\\]){8,})\"|'(?P<single>(?:\\.|[^'\\]){8,})'|[\"']?(?P<plain>(?:(?![,;&][\"']?\w+[\"']?\s*[:=])[^\s\"'<>]){8,}+)))"
    r"|(?P<prefixed>(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|sk-|xoxb-)(?P<rest>[A-Za-z0-9-]{12,}))"
    r"|(?P<jwt>(?<![A-Za-z0-9])eyJ(?P<claims>[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+){0,2}))"
    r"|(?P<bearer>(?<!\w)(?i:bearer)[ \t]+(?P<held>(?=[^\s\d]*\d)[A-Za-z0-9._~+/=-]{8,}))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    rf"|(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d))"
    r"|(?P<phone>(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ -]?\(\d{1,4}\))?(?:[ -]?\d{2,4}){2,4}(?!\d|\.\d)"
    r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}(?!\d)|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?!\d)|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5}(?!\d)))"
)
_NAME = re.compile(rf"(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?P<name>[^\W\d_a-zß-ÿ]\w+(?:(?: (?:{'|'.join(PARTICLES)})\b){{0,3}} [^\W\d_a-zß-ÿ][^\W\d_]+){{0,2}})")
_WORD = re.compile(r"[^\W_]+")
#: What every entity but a name has one of.
_TRIGGER = re.compile(r"[0-9@=:]|A[KS]IA|gh[po]_|sk-|xoxb-|eyJ")


def _luhn(digits: str) -> int:
    """Sum whose remainder by ten is 0 for a right number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, in order, without overlaps."""
    out: list[tuple[int, int, str, str]] = []
    if not _TRIGGER.search(text) and not _NAME.search(text):
        return out
    at = 0
    for line in text.split("\n"):
        own: list[tuple[int, int, str, str]] = []
        if _TRIGGER.search(line):
            k = 0
            while m := _PATTERN.search(line, k):
                if e := _entity(m):
                    own.append(e)
                k = m.end() if e else m.start() + 1  # what fails its checksum may hide another entity
        for m in _NAME.finditer(line):
            if m.start() and (line[m.start() - 1].isalnum() or line[m.start() - 1] == "_"):
                continue
            words, k = [], m.start("name")
            for w in m["name"].split(" "):
                if not w[0].islower():
                    words.append((k, w))
                elif w not in PARTICLES:
                    break  # a name's parts begin with a capital, or in a script without any
                k += len(w) + 1
            for i, (k, w) in enumerate(words):
                kind = f"family:{_script(w)}" if i == len(words) - 1 else f"given:{TITLES[m['title']]}:{_script(w)}"
                if not any(a < k + len(w) and k < b for a, b, _, _ in own):
                    own.append((k, k + len(w), kind, w.lower()))
        out += [(at + a, at + b, t, v) for a, b, t, v in sorted(own)]
        at += len(line) + 1
    return _with_mentions(text, _with_told_genders(out))


def _with_told_genders(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found, where a given name whose title tells no gender takes the one that another title of it tells."""
    told: dict[tuple[str, str], set[str]] = {}
    for _, _, kind, value in found:
        if kind.startswith("given") and (gender := kind.split(":")[1]) != "n":
            told.setdefault((kind.split(":")[2], value), set()).add(gender)
    if not told:
        return found
    out = []
    for a, b, kind, value in found:
        if kind.startswith("given:n") and len(genders := told.get((kind.split(":")[2], value), ())) == 1:
            kind = f"given:{next(iter(genders))}:{kind.split(':')[2]}"
        out.append((a, b, kind, value))
    return out


def _with_mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found and, of the names in it, each capitalised mention, with the kind of the last titled one before it, or else of the first after it."""
    known: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind.startswith(("given", "family")):
            known.setdefault(value, kind)
    if not known:
        return found
    out: list[tuple[int, int, str, str]] = []
    k = end = 0
    for m in _WORD.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            a, end, kind, value = found[k]
            if kind.startswith(("given", "family")):
                known[value] = kind
            out.append(found[k])
            k += 1
        if m.start() >= end and m[0][0].isupper() and (kind := known.get(m[0].lower())) and not _is_word(text, m, known):
            out.append((*m.span(), kind, m[0].lower()))
    return out + found[k:]


def _is_word(text: str, m: re.Match, known: dict[str, str]) -> bool:
    """Whether a given name that is a word too begins a sentence, and no family name follows it."""
    if m[0].lower() not in WORD_NAMES or text[: m.start()].rstrip(" \t\"'(")[-1:] not in ("", ".", "!", "?", ":", "\n"):
        return False
    follows = _WORD.match(text, m.end() + 1) if text[m.end() : m.end() + 1] == " " else None
    return not (follows and follows[0][0].isupper() and known.get(follows[0].lower(), "").startswith("family"))


def _entity(m: re.Match) -> tuple[int, int, str, str] | None:
    kind, value = m.lastgroup, m.group()  # the outer group is the last to close, so it names the type
    if kind == "secret":
        part = next(g for g in ("double", "single", "plain") if m[g])
        a, new = m.start(part), m[part] if part != "plain" else m[part].rstrip(".,;:!?)]}")
        # What has hardly a letter or digit is a mask, and has no surrogate of its own.
        return (a, a + len(new), "secret", new) if len(new) >= 8 and sum(c in _ALPHABETS for c in new) >= LEAST_FREE else None
    if kind == "prefixed":
        return (*m.span("rest"), "secret", m["rest"])
    if kind in ("jwt", "bearer"):
        group = "claims" if kind == "jwt" else "held"
        return (*m.span(group), "secret", m[group]) if sum(c in _ALPHABETS for c in m[group]) >= LEAST_FREE else None
    if kind == "email":
        return (*m.span("mail"), "email", m["mail"].lower())
    if kind == "ipv6":
        try:
            address = ipaddress.IPv6Address(value)
        except ValueError:
            return None
        # Words of hexadecimal letters between colons, and addresses of no host, are none.
        return (*m.span(), "ipv6", str(address)) if re.search(r"\d", value) and sum(x != 0 for x in _hextets(address)) > 1 else None
    digits = re.sub(r"\D", "", value)
    if kind == "card":
        return (*m.span(), "card", digits) if _luhn(digits) % 10 == 0 else None
    if kind == "iban":
        bare = value.replace(" ", "")
        return (*m.span(), "iban", bare) if 15 <= len(bare) <= 34 and _mod97(bare) == 1 else None
    if kind == "phone":
        if len(digits) > 15:
            return None
        # A number without a country is written as in the first country's plan, so that both forms of it agree.
        if not value.startswith("+"):
            return (*m.span(), "phone", f"+1|{digits}")
        n = next((n for n in (1, 2) if digits[:n] in CALLING), 3)
        return (*m.span(), "phone", f"+{digits[:n]}|{digits[n:]}") if len(digits) - n >= 4 else None
    return (*m.span(), kind, value if kind == "ip" else digits)


def _mac(key: bytes, *parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "replace"), key=key, digest_size=16).digest(), "big")


def permute(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """A keyed permutation of the texts whose characters are in these alphabets."""
    if len(text) <= BLOCK:
        return _permute_block(text, alphabets, key, tweak)
    # Of a long text each block's permutation depends on what stood before it, then once more on what follows: one pass each way.
    at = range(0, len(text), BLOCK)
    blocks, own = [text[k : k + BLOCK] for k in at], [alphabets[k : k + BLOCK] for k in at]
    for order in (range(len(blocks)), reversed(range(len(blocks)))):
        told = b""
        for k in order:
            new = _permute_block(blocks[k], own[k], key, f"{tweak}/{k}/{told.hex()}")
            told = hashlib.blake2b(told + blocks[k].encode("utf-8", "replace"), digest_size=16).digest()
            blocks[k] = new
    return "".join(blocks)


def _permute_block(text: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    half = len(text) // 2

    def number(part: str, own: list[str]) -> int:
        n = 0
        for c, a in zip(part, own):
            n = n * len(a) + a.index(c)
        return n

    def spelled(n: int, own: list[str]) -> str:
        out = []
        for a in reversed(own):
            n, k = divmod(n, len(a))
            out.append(a[k])
        return "".join(reversed(out))

    la, ra = alphabets[:half], alphabets[half:]
    lsize, rsize = math.prod(map(len, la)), math.prod(map(len, ra))
    left, right = number(text[:half], la), number(text[half:], ra)
    shape = f"{tweak}/{','.join(str(len(a)) for a in alphabets)}"
    for i in range(0, 8, 2):
        # Each step adds what depends on the other half only, so it can be undone.
        left = (left + _mac(key, shape, str(i), f"{right:x}")) % lsize
        right = (right + _mac(key, shape, str(i + 1), f"{left:x}")) % rsize
    return spelled(left, la) + spelled(right, ra)


def permute_classes(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Permutes digits, lower and upper case letters within their kinds and scripts; other characters stay."""
    free, alphabets = [], []
    for k, c in enumerate(text):
        if a := _HEX if hexadecimal else _ALPHABETS.get(c):
            free.append(k), alphabets.append(a)
    if not free:
        return text
    new = permute("".join(text[k] for k in free), alphabets, key, tweak)
    out = list(text)
    for k, c in zip(free, new):
        out[k] = c
    return "".join(out)


def _hextets(address: ipaddress.IPv6Address) -> list[int]:
    return [int(x, 16) for x in address.exploded.split(":")]


_OCTETS = "".join(map(chr, range(256)))
_HEXTETS = "".join(map(chr, range(1, 1 << 16)))


def ip_range(octets: list[int]) -> int:
    """How many octets at the start tell a range that isn't public; 0 for any other address. Of 172.16 to 172.31 the second is free within it."""
    a, b = octets[:2]
    return 1 if a in (10, 127) or a == 172 and 16 <= b < 32 else 2 if (a, b) in ((192, 168), (169, 254)) else 0


def _ip(value: str, key: bytes, tweak: str) -> str:
    octets = [int(x) for x in value.split(".")]
    n = ip_range(octets)
    alphabets = [_OCTETS] * (4 - n)
    if n and octets[0] == 172:
        alphabets[0] = _OCTETS[16:32]
    while True:
        octets = octets[:n] + [ord(c) for c in permute("".join(map(chr, octets[n:])), alphabets, key, f"{tweak}/{octets[:n]}")]
        # A public address that became a special one goes on; that keeps the permutation one-to-one among public ones.
        if ip_range(octets) == n:
            return ".".join(map(str, octets))


def _ipv6(value: str, key: bytes, tweak: str) -> str:
    """Zeros stay, so the address is shortened alike; the first part stays, as it tells the range."""
    parts = _hextets(ipaddress.IPv6Address(value))
    free = [k for k in range(1, 8) if parts[k]]
    new = permute("".join(chr(parts[k]) for k in free), [_HEXTETS] * len(free), key, f"{tweak}/{shape('ipv6', value)}")
    for k, c in zip(free, new):
        parts[k] = ord(c)
    return str(ipaddress.IPv6Address(":".join(f"{x:x}" for x in parts)))


def shape(kind: str, value: str) -> str:
    """What a surrogate keeps of a value of a fillable type: an attempt's surrogates are one-to-one among the values of a shape."""
    if kind == "ip":
        octets = value.split(".")
        return f"{octets[: ip_range([int(x) for x in octets])]}"
    if kind == "ipv6":
        parts = _hextets(ipaddress.IPv6Address(value))
        return f"{parts[0]}/{[x != 0 for x in parts]}"
    if kind == "phone":
        country, _, rest = value.partition("|")
        return f"{country}|{len(rest)}"
    if kind in ("secret", "iban"):
        # What stays of each character: itself, or the alphabet that it is permuted in.
        kept = [str(_KINDS.index(_ALPHABETS[c])) if c in _ALPHABETS else f"'{c}" for c in (value if kind == "secret" else value[4:])]
        return f"{'' if kind == 'secret' else value[:2]}{' '.join(kept)}"
    return f"{value[0]}/{len(value)}" if kind == "card" else str(len(value))


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """Normal form of the surrogate of a normal form."""
    tweak = f"{kind}/{attempt}"
    if kind == "email":
        local, _, domain = value.partition("@")
        labels, _, last = domain.rpartition(".")
        n, more = _mac(key, tweak, "domain", domain), ""
        for _ in range(attempt // 2):
            n, k = divmod(n, 26)
            more += _LOWER[k]
        return f"{permute_classes(local, key, tweak)}@{permute_classes(labels, key, f'{tweak}/{last}')}{more}.example"
    if kind == "ip":
        return _ip(value, key, tweak)
    if kind == "ipv6":
        return _ipv6(value, key, tweak)
    if kind == "phone":
        country, _, rest = value.partition("|")
        return f"{country}|{permute_classes(rest, key, tweak + country)}"
    if kind == "card":
        body = value[0] + permute_classes(value[1:-1], key, tweak + value[0])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "iban":
        body = permute_classes(value[4:], key, tweak + value[:2])
        return f"{value[:2]}{98 - _mod97(f'{value[:2]}00{body}'):02d}{body}"
    if kind == "secret":
        # In a full shape, letters are no longer kept hexadecimal, so that shapes stay apart.
        return permute_classes(value, key, tweak, hexadecimal=attempt < FULL and not set(value) - set(_HEX))
    if kind == "ssn":
        return permute_classes(value, key, tweak)
    part, *more = kind.split(":")
    syllables, given, family = NAME_PARTS[more[-1]]
    n, out = _mac(key, tweak, value), ""
    # Each second attempt takes a syllable more, so that the space outgrows any number of names.
    for _ in range((3 if part == "given" else 4) + attempt // 2):
        n, k = divmod(n, len(syllables))
        out += syllables[k]
    return out + (given[more[0]] if part == "given" else family)


def render(kind: str, original: str, new: str) -> str:
    """The surrogate's normal form in the format of the original's text."""
    if kind in ("phone", "card", "ssn", "iban"):
        # A number that is written without its country has fewer digits than its normal form.
        digits = new.replace("|", "").replace("+", "")
        chars = iter(digits[len(digits) - sum(c.isalnum() for c in original) :])
        return "".join(next(chars) if c.isalnum() else c for c in original)
    if kind == "email" and original.isupper():
        return new.upper()
    if kind == "ipv6":
        full = len(original) == 39
        new = ipaddress.IPv6Address(new).exploded if full else new if "::" in original else ":".join(f"{x:x}" for x in _hextets(ipaddress.IPv6Address(new)))
        return new.upper() if re.search("[A-F]", original) else new
    if kind.startswith(("given", "family")):
        return new.upper() if original.isupper() else new[0].upper() + new[1:]
    return new


#: By (type, normal form): the type and the attempt that its surrogate takes, where they aren't its own type and 0.
Exceptions = dict[tuple[str, str], tuple[str, int]]


def replace(text: str, taken: Exceptions, key: bytes) -> tuple[str, int]:
    """Text with its entities replaced, and their number."""
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, value in found:
        as_kind, attempt = taken.get((kind, value), (kind, 0))
        out += (text[at:a], render(kind, text[a:b], surrogate(as_kind, value, attempt, key)))
        at = b
    return "".join([*out, text[at:]]), len(found)


def session_key(spark: SparkSession) -> bytes:
    """The key in `KEY_SETTING`."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"surrogates need a key: give one, or set {KEY_SETTING}")
    return found.encode()


_drawn: dict[str, bytes] = {}


def run_key(spark: SparkSession) -> bytes:
    """The session's key; without one, a random key that is drawn once for the application and kept nowhere."""
    if spark.conf.get(KEY_SETTING, None):
        return session_key(spark)
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def entities(docs: DataFrame, text_col: str = "text", with_row: list[Column] | None = None) -> DataFrame:
    """(kind, value) of each occurrence, once per document; with_row: columns that name the row, kept in front."""
    ship_package(docs.sparkSession)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), *(with_row or []))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    from pyspark.sql.types import StringType, StructField, StructType

    spark_schema = StructType([*kept, StructField("kind", StringType()), StructField("value", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, column=0):
                source, kinds, values = [], [], []
                for i, t in enumerate(batch.column(0).to_pylist()):
                    for kind, value in dict.fromkeys((k, v) for _, _, k, v in find(t)):
                        source.append(i), kinds.append(kind), values.append(value)
                if source:
                    at = pa.array(source, pa.int64())
                    cols = [batch.column(k).take(at) for k in range(1, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=[*batch.schema.names[1:], "kind", "value"])

    return rows.mapInArrow(run, spark_schema)


def _told_by_corpus(found: DataFrame) -> DataFrame:
    """(kind, value, as_kind): given names without a gender that take the only one that the corpus tells of them."""
    parts = F.split("kind", ":")
    names = found.filter(F.startswith("kind", F.lit("given:"))).select("value", parts[1].alias("gender"), parts[2].alias("script"))
    by = names.groupBy("script", "value").agg(F.bool_or(F.col("gender") == "n").alias("untold"), F.collect_set(F.when(F.col("gender") != "n", F.col("gender"))).alias("told"))
    own = by.filter(F.col("untold") & (F.size("told") == 1))
    return own.select(F.concat(F.lit("given:n:"), "script").alias("kind"), "value", F.concat_ws(":", F.lit("given"), F.get("told", 0), "script").alias("as_kind"))


def exceptions(found: DataFrame, store: Stored, key: bytes) -> DataFrame:
    """(kind, value, as_kind, attempt) of the entities whose surrogate isn't that of their own type and attempt 0, for distinct (kind, value)."""

    def mapped(df: DataFrame, name: str, of: Callable[[str, str], str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [of(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["kind", "value", name])

        return df.select("kind", "value").mapInArrow(run, f"kind string, value string, {name} string")

    def real(kind: Column) -> Column:
        """Names of all kinds must keep clear of each other."""
        return F.when(kind.rlike("^(given|family):"), "name").otherwise(kind)

    names = ["kind", "value"]
    told = store.cut(_told_by_corpus(found))
    own = found.join(told, names, "left_anti")
    values = found.select(real(F.col("kind")).alias("type"), F.col("value").alias("new")).distinct()
    taken, late, open_ones = None, None, own
    for attempt in range(MAX_ATTEMPTS):
        if attempt == FULL:
            shapes = mapped(open_ones.filter(F.col("kind").isin(*FILLABLE)), "shape", shape).select("kind", "shape").distinct()
            shaped = store.cut(mapped(own.filter(F.col("kind").isin(*FILLABLE)), "shape", shape).join(shapes, ["kind", "shape"], "left_semi"))
            whole = store.cut(_without_fixed_points(shaped, mapped, store, key))
            late = late.join(whole, names, "left_anti").unionByName(whole)
            open_ones = store.cut(open_ones.join(whole, names, "left_anti"))
            if open_ones.isEmpty():
                break
        tried = store.cut(mapped(open_ones, "new", lambda k, v, n=attempt: surrogate(k, v, n, key)))
        first = tried.groupBy("kind", "new").agg(F.min("value").alias("value"))
        good = first.withColumn("type", real(F.col("kind"))).join(values, ["type", "new"], "left_anti")
        if taken is not None:
            good = good.join(taken, ["kind", "new"], "left_anti")
        good = store.cut(good.select("kind", "new", "value"))
        if attempt:
            settled = good.select(*names, F.lit(attempt).alias("attempt"))
            late = settled if late is None else late.unionByName(settled)
        open_ones = store.cut(tried.select(*names).join(good.select(*names), names, "left_anti"))
        taken = good.select("kind", "new") if taken is None else taken.unionByName(good.select("kind", "new"))
        if open_ones.isEmpty():
            break
    else:
        raise ValueError(f"some entities have no surrogate of their own after {MAX_ATTEMPTS} attempts")
    if late is None:
        late = own.select(*names, F.lit(0).alias("attempt")).limit(0)
    shared = told.join(late.select(F.col("kind").alias("as_kind"), "value", "attempt"), ["as_kind", "value"], "left")
    return late.withColumn("as_kind", F.col("kind")).unionByName(shared.withColumn("attempt", F.coalesce("attempt", F.lit(0)))).select(*names, "as_kind", "attempt")


def _without_fixed_points(shaped: DataFrame, mapped: Callable, store: Stored, key: bytes) -> DataFrame:
    """(kind, value, attempt) for stored (kind, value, shape): of each shape the first attempt from FULL on that leaves no value as it is.

    An attempt leaves none with a chance of over a third, whatever the size of the shape.
    """
    settled = None
    for attempt in range(FULL, FULL + MAX_ATTEMPTS):
        tried = mapped(shaped, "new", lambda k, v, n=attempt: surrogate(k, v, n, key))
        fixed = tried.filter("value = new").select("kind", "value").join(shaped, ["kind", "value"]).select("kind", "shape").distinct()
        fixed = store.cut(fixed)
        good = shaped.join(fixed, ["kind", "shape"], "left_anti").select("kind", "value", F.lit(attempt).alias("attempt"))
        settled = good if settled is None else settled.unionByName(good)
        if fixed.isEmpty():
            return settled
        shaped = store.cut(shaped.join(fixed, ["kind", "shape"], "left_semi"))
    raise ValueError(f"some shapes leave a value as it is in each of {MAX_ATTEMPTS} permutations")


def replace_entities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", key: bytes | None = None, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """docs with surrogates in text_col and `replaced_column` added; size_col, if there, is set anew. key: the session's by default."""
    spark = docs.sparkSession
    key = hashlib.blake2b(key or session_key(spark)).digest()
    ship_package(spark)
    store = Stored(spark, "pii")
    found = store.cut(entities(docs, text_col).distinct())
    late = store.cut(exceptions(found, store, key))
    own = free_name(docs, "taken")
    few = late.limit(max_broadcast + 1).collect()  # bounded by max_broadcast
    everywhere: Exceptions = {}
    if len(few) <= max_broadcast:
        everywhere = {(r.kind, r.value): (r.as_kind, r.attempt) for r in few}
        df = docs.withColumn(own, F.lit(None).cast("array<struct<kind:string,value:string,as_kind:string,attempt:int>>"))
    else:
        row = [F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash")]
        mine = entities(docs, text_col, row).join(late, ["kind", "value"])
        mine = mine.groupBy("row_id", "row_hash").agg(F.collect_set(F.struct("kind", "value", "as_kind", "attempt")).alias(own))
        mine = mine.withColumnRenamed("row_id", own + "id").withColumnRenamed("row_hash", own + "hash")
        df = docs.join(mine, F.col(id_col).eqNullSafe(F.col(own + "id")) & (F.xxhash64(text_col) == F.col(own + "hash")), "left")
        df = df.select(*[docs[c] for c in docs.columns], own)
    shared = spark.sparkContext.broadcast(everywhere)
    names = docs.columns
    t, count = names.index(text_col), replaced_column(docs)
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for whole in batches:
            for batch in groups(whole, column=t):
                done = []
                for text, extra in zip(batch.column(t).to_pylist(), batch.column(len(names)).to_pylist()):
                    taken = common | {(e["kind"], e["value"]): (e["as_kind"], e["attempt"]) for e in extra} if extra else common
                    done.append((None, 0) if text is None else replace(text, taken, key))
                cols = [batch.column(k) for k in range(len(names))]
                cols[t] = pa.array([d[0] for d in done], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array([d[1] for d in done], pa.int64())], names=[*names, count])

    out = df.mapInArrow(run, StructType([*docs.schema.fields, StructField(count, LongType())]))
    if size_col in names:
        out = out.withColumn(size_col, F.length(F.col(text_col)).cast(docs.schema[size_col].dataType))
    return out


def replaced_column(docs: DataFrame) -> str:
    return free_name(docs, "replaced")


def pii_surrogates(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The rows and columns of docs, with surrogates in its text. key: that of `run_key` by default."""
    return replace_entities(docs, key=key or run_key(docs.sparkSession)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return replace_entities(docs, key=run_key(spark)).select("doc_id", "text", F.col(replaced_column(docs)).alias("n_replaced"))
