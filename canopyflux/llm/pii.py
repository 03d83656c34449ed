"""Personal data in whole texts: four base patterns, and spans that a conditional random field adds.

Base spans are fixed patterns with checks (e-mail, IPv4 address, payment card, phone). The random field
(:mod:`.crf`) labels words by their shapes, those of their neighbours and cues before them, and finds what the patterns
leave: spelt-out addresses, phones without a plus sign, identity and account numbers, secrets such as keys and passwords,
names after a title or a cue, and postal addresses. It is trained from a small labelled table (:func:`labelled_rows`) with
a fixed seed each time it is needed, which takes seconds. Every word of a text is labelled, and a text is one chain of words.
Words of which no run around them can gain by another label than "outside" (:meth:`.crf.Crf.doubtful`) part the chain into short
ones that are decoded together, with the same result as for the whole; in training as in use no word is left out. Words end at white
space and at the signs that join fields (comma, semicolon, ampersand, question mark, quotes and the like), and whole words
are looked at, however long they are. A name or a password without any cue is not found.

What the checks of the base patterns refuse (card numbers with a wrong check digit, addresses with a part over 255) is not
let in by the random field either.

Where a span of the random field overlaps base spans, the base spans stay and of the other one only what they leave.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive; rows are judged
one by one, so that repeated rows get equal results and an empty table an empty one. Other columns don't matter to
:func:`find_personal_data` and are kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import crf
from .common import Memory, core, slices, texts

Span = tuple[str, int, int]

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("id", "secret", "name", "address")
KINDS = BASE_KINDS + ADDED_KINDS
_ORDER = {k: i for i, k in enumerate(KINDS)}

# Possessive runs and starts at run boundaries find the same matches as plain greedy patterns, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[Span]:
    """Found from each @ outwards, so that words without one cost nothing."""
    out: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


# --- features ---------------------------------------------------------------------------------------------------------

_WORD = re.compile(r"""[^\x20\x09-\x0D,;&?"<>|]+[,;]?""")
# Words that stand near personal data.
TITLES = "mr mrs ms miss dr prof sir madam herr frau monsieur madame".split()
NAMED = "name sincerely regards signed contact attn dear".split()
STREETS = "street avenue road lane drive boulevard blvd court square terrace crescent ave st rd ln strasse straße".split()
SECRETS = "password passwd passcode passphrase pwd pass secret token key pin login credentials".split()
NUMBERS = "ssn iban passport account id licence license insurance tax".split()
PHONES = "phone tel telephone call fax mobile cell whatsapp".split()
CLASSES = {w: kind for kind, words in (("title", TITLES), ("named", NAMED), ("street", STREETS), ("secret", SECRETS), ("number", NUMBERS), ("phone", PHONES)) for w in words}
KINDS_OF_CUES = sorted(set(CLASSES.values()))
#: Words whose meaning counts beside their shape.
CUES = frozenset("at dot is my the by for to com org net of in page chapter year version licensed api required reset box apt suite floor lives live".split()) | frozenset(CLASSES)
#: Words before a word in which a cue is sought.
BACK = 3
_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+")
_LETTERS = re.compile(r"[^a-z]+")
_EDGES = ".,;:!'()[]{}"


def shape(word: str) -> str:
    """The word with runs of capitals, small letters and digits as A, a and 9; digit runs keep their length up to 5."""

    def run(m: re.Match) -> str:
        c = m[0][0]
        return "A" if c.isupper() else "a" if c.islower() else "9" * min(5, m.end() - m.start())

    return _RUNS.sub(run, word)


def cue(word: str) -> str:
    return _LETTERS.sub("", word.lower()) if len(word) <= 20 else ""


def features(word: str) -> list[str]:
    """Names of the features that hold for a word; empty: there is no word."""
    if not word:
        return ["edge"]
    core_ = word.strip(_EDGES)
    digits = len(_DIGIT.findall(word))
    letters = len(_LETTER.findall(word))
    out = ["any"]
    if len(form := shape(core_)) <= 24:  # a longer one is no form that could be known
        out.append(f"shape:{form}")
    if core_[:1].isupper() and core_[1:].islower():
        out.append("capital")
    if not digits and letters == len(core_):
        out.append("plain")
    if digits:
        out.append(f"digits:{min(digits, 20)}")
        out.append("mixed" if letters else "numeric")
        if not letters and digits >= 14 and luhn("".join(_DIGIT.findall(word))):
            out.append("luhn")
        if letters and len(core_) >= 16 and "=" not in core_:
            out.append("long_mixed")
    out += [f"has:{c}" for c in "@=()-./+!#$:_" if c in core_]
    if (said := cue(core_)) in CUES:
        out.append(f"cue:{said}")
    if said in CLASSES:
        out.append(f"class:{CLASSES[said]}")
    if "=" in core_[1:-1]:
        name = core_.partition("=")[0].lower()
        out.append(f"named:{_LETTERS.sub('', name)[-8:]}")
    if word[-1] in ".,;:!":
        out.append(f"stop:{word[-1]}")
    return out


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def before(words: Sequence[str]) -> str | None:
    """The feature of a word that the words before it make, nearest last: the class of the next cue, and its distance."""
    for k, w in enumerate(reversed(words[-BACK:])):
        if kind := CLASSES.get(cue(w)):
            return f"after:{kind}:{k}"
    return None


_STOPS = ".,;:!"


def typical(word: str) -> str:
    """A word with the same features: plain words in small letters, or with a capital first, are one but for cues."""
    body = word[:-1] if word[-1:] in _STOPS else word
    if not (body.isascii() and body.isalpha()) or len(body) < 2 or body.lower() in CUES:
        return word
    rest = word[len(body) :]
    return f"zz{rest}" if body.islower() else f"Zz{rest}" if body[0].isupper() and body[1:].islower() else word


# --- the labelled table ------------------------------------------------------------------------------------------------


FIRST = "John Jane Mary Peter Anna Maria David Sarah Michael Laura Ahmed Fatima Wei Yuki Carlos Sofia Pierre Claire Hans Ingrid Olga Ivan Priya Raj Kofi Amara Liam Emma Noah Mia".split()
LAST = "Smith Jones Miller Brown Garcia Silva Rossi Schmidt Dubois Novak Kowalski Tanaka Chen Kim Singh Khan Okafor Hansen Larsen Murphy Walker Wright Young King Hill Scott Green Baker Carter Lopez".split()
PLACES = "Oak Maple Park Church Hill Main High Station Mill Lake Elm Cedar North South River Victoria Queen Bridge Garden Spring".split()
CITIES = "Springfield London Portland Dublin Leeds Boston Austin Denver Berlin Lyon Madrid Oslo Riverside Clinton Salem".split()


def luhn_number(r: random.Random, n: int, right: bool = True) -> str:
    """Digits of which the last is the check digit, or isn't."""
    head = "".join(r.choice("0123456789") for _ in range(n - 1))
    good = next(d for d in "0123456789" if luhn(head + d))
    return head + (good if right else r.choice([d for d in "0123456789" if d != good]))


def labelled_rows(rows: int = 1500, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """A small table of texts with their spans, made by rule: carriers around personal data, and what only looks like it."""
    r = random.Random(seed)
    pick = r.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    word = lambda: "".join(pick(["an", "er", "on", "the", "re", "ti", "es", "ou", "la", "de", "ch", "mo", "ska", "lin", "ba", "ver", "no"]) for _ in range(r.randint(1, 3)))
    common = lambda: pick("the a of and to in is for with on that this it you we they was are be from as by or not have will can all there when who which more about".split()) if r.random() < 0.6 else word()
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    mixed = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    host = lambda: f"{word()}.{pick(['com', 'org', 'net', 'example.com'])}"
    last = lambda: pick(LAST) if r.random() < 0.6 else word().capitalize() + pick(["", "son", "ez", "ov"])
    first = lambda: pick(FIRST) if r.random() < 0.7 else word().capitalize()
    person = lambda: pick([f"{first()} {last()}", f"{first()} {last()}", f"{first()} {upper(1)}. {last()}", f"{first()} {first()} {last()}"])
    four = lambda x: " ".join(x[i : i + 4] for i in range(0, 16, 4))
    sign = lambda: pick("!#$_-@")
    street = lambda: f"{r.randint(1, 9999)} {' '.join(pick(PLACES) if r.random() < 0.7 else last() for _ in range(r.randint(1, 2)))} {pick(['Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Boulevard', 'Court', 'Square', 'St', 'Ave', 'Rd', 'St.', 'Ave.', 'Rd.'])}"
    zip_ = lambda: pick([f"{pick(['IL', 'CA', 'NY', 'TX', 'OR', 'MA'])} {digits(5)}", f"{pick(['SW', 'N', 'LS', 'EC'])}{r.randint(1, 9)} {r.randint(1, 9)}{pick(['AA', 'BD', 'QX'])}", digits(5)])
    city = lambda: pick(CITIES) if r.random() < 0.6 else word().capitalize()
    value = lambda: pick([f"{word()}{digits(r.randint(1, 4))}", f"{word().capitalize()}{digits(2)}{sign()}", f"{word()}{sign()}{digits(3)}", mixed(r.randint(8, 14)), f"{word()}{sign()}{word()}", hexes(16)])
    spelt = lambda: " ".join([pick([word(), f"{word()}.{word()}", f"{word()}{digits(2)}"]), "at", *(x for _ in range(r.randint(1, 2)) for x in (word(), "dot")), pick(["com", "org", "net", "edu", "uk"])])
    key = lambda: pick(["password", "passwd", "pwd", "passcode", "passphrase", "pass"])
    # each: what is said before it, the kind, the text of the span
    positive = (
        lambda: ("", "email", f"{word()}{pick(['.', '', '_'])}{digits(r.randint(0, 2))}@{host()}"),
        lambda: (pick(["", "mail", "write to", "contact"]), "email", "{} {} {} {} {}".format(word(), *pick([("[at]", word(), "[dot]"), ("(at)", word(), "(dot)"), ("{at}", word(), "{dot}")]), pick(["com", "org", "net"]))),
        lambda: (pick(["", "mail", "email me at", "write to", "reach"]), "email", spelt()),
        lambda: (pick(["", "host", "from"]), "ip", ".".join(str(r.randint(1, 255)) for _ in range(4))),
        lambda: (pick(["", "phone", "call", "tel:"]), "phone", f"+{digits(r.randint(1, 2))} ({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: (pick(["", "phone", "call", "fax:", "Tel."]), "phone", pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)} {digits(6)}", f"0{digits(2)} {digits(4)} {digits(4)}"])),
        lambda: (pick(["", "phone", "mobile"]), "phone", f"+{digits(2)} {digits(3)} {digits(4)} {digits(4)}"),
        lambda: (pick(["", "card", "visa"]), "card", pick([str, four])(luhn_number(r, 16))),
        lambda: (pick(["", "ssn", "SSN:", "social security"]), "id", f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (pick(["", "iban", "IBAN:"]), "id", f"{upper(2).translate(str.maketrans('234567', 'ABCDEF'))}{digits(20)}"),
        lambda: (pick(["passport", "passport no", "passport number:", "licence no", "account id:"]), "id", f"{pick('ABCXKLP')}{pick(['', 'A', 'K'])}{digits(r.randint(6, 8))}"),
        lambda: (pick(["", "key", "aws key:"]), "secret", f"AKIA{upper(16)}"),
        lambda: ("", "secret", f"{pick(['password', 'secret', 'token', 'api_key', 'pwd', 'passwd', 'access_token', 'apikey'])}={pick([hexes(pick([12, 18, 24])), value(), mixed(20)])}"),
        lambda: (pick(["", "token", "sha"]), "secret", f'"{hexes(pick([32, 40]))}"'),
        lambda: (pick(["", "my", "the", "your"]) + f" {key()} " + pick(["is", "is", "was", "="]), "secret", value()),
        lambda: (pick(["", "my", "login:"]) + f" {key()}:", "secret", pick([value, value, word])()),
        lambda: (pick(["api key", "token", "secret key", "access token"]) + pick([":", " is"]), "secret", pick([mixed(24), hexes(20), f"sk_{mixed(18)}", f"ghp_{mixed(30)}"])),
        lambda: (pick(["Mr", "Mr.", "Mrs", "Mrs.", "Ms.", "Dr", "Dr.", "Prof.", "Miss", "dear Mr", "by Dr."]), "name", pick([person, person, last])()),
        lambda: (pick(["my name is", "name:", "Name:", "her name is", "full name:", "signed by", "Signed,", "Sincerely,", "regards,", "attn:", "the name of"])[:40], "name", person()),
        lambda: (pick(["", "at", "lives at", "address:", "ship to"]), "address", street() + pick(["", "", f", {city()}", f", {city()}, {zip_()}", f", {city()} {zip_()}", f", Apt {r.randint(1, 40)}, {city()}"])),
    )
    negative = (
        lambda: str(r.randint(0, 99)), lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(0, 999)},{digits(3)}",
        lambda: f"{r.randint(1, 100)}%", lambda: f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"x = {r.randint(0, 99)}", lambda: f"{word()}={word()}", lambda: f"{word()}{r.randint(0, 99)}",
        lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"${digits(r.randint(1, 5))}", lambda: f"{digits(5)}", lambda: f"({r.randint(1, 20)})", lambda: f"CC BY-NC {r.randint(1, 4)}.0", lambda: f"@{word()}",
        lambda: f"{r.randint(1, 30)}-{r.randint(31, 99)}", lambda: f"page={r.randint(1, 9)}", lambda: f"{word()}-{r.randint(1, 99)}", lambda: f"{digits(7)}", lambda: "=", lambda: f"{word().upper()}-{digits(2)}",
        lambda: pick([str, four])(luhn_number(r, 16, right=False)), lambda: f"{r.randint(300, 999)}.{r.randint(0, 99)}.{r.randint(0, 99)}.{r.randint(0, 99)}", lambda: f"order {digits(8)}", lambda: f"{digits(9)} items",
        lambda: f"{key()} {pick(['is required', 'is wrong', 'must be changed', 'reset', 'was not accepted', 'field', 'and login', 'protected', 'has expired', 'policy', 'is incorrect'])}", lambda: f"the dot {pick(['com era', 'on the map', 'in the name', 'is red', 'product'])}",
        lambda: f"{pick(['at', 'on', 'in'])} {word()} dot {word()}", lambda: f"the name of {pick(['the', 'a'])} {word()}", lambda: f"name {pick(['is', 'was'])} {pick(['not', 'unknown', 'taken', 'the'])} {word()}", lambda: f"{word()} street {r.randint(1, 30)} {word()}",
        lambda: f"{r.randint(2, 30)} {word().capitalize()} {word()}", lambda: f"{r.randint(2, 99)} {word()} on the road", lambda: f"{pick(['regards', 'sincerely', 'signed'])} {word()} {word()}", lambda: f"the {pick(['secret', 'key', 'token'])} {pick(['is', 'of', 'to'])} {word()}",
        lambda: f"{r.randint(1, 20)} {pick(PLACES)} {word()}", lambda: f"chapter {r.randint(1, 30)}. {word().capitalize()} {word()}", lambda: f"in {r.randint(1900, 2030)}, {word().capitalize()} {word()}", lambda: f"dr {word()}", lambda: f"Dr. of {word()}",
    )
    out = []
    for _ in range(rows):
        text, spans = "", []

        def say(piece: str, kind: str | None = None) -> None:
            nonlocal text
            text += " " * bool(text and piece)
            if kind:
                quoted = piece.strip('"')
                start = len(text) + piece.index(quoted)
                spans.append((kind, start, start + len(quoted)))  # noqa: B023
            text += piece

        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 4)):
                say(common())
            if r.random() < 0.55:
                lead, kind, piece = pick(positive)()
                say(lead.strip())
                say(piece, kind)
            else:
                say(pick(negative)())
            text += pick(["", "", "", ".", ",", " ."]) if not text.endswith(".") else ""
            for _ in range(r.randint(0, 3)):
                say(common().capitalize() if r.random() < 0.2 else common())
        out.append((text, spans))
    return out


def plain_rows(rows: int = 300, seed: int = 12) -> list[tuple[str, list[Span]]]:
    """Texts without personal data, made by rule: words and cues in any case, with signs and stops, accents and repeats."""
    r = random.Random(seed)
    pick = r.choice
    cues = sorted(CUES - set(CLASSES) - {"dot", "com", "org", "net"}) + ["at", "st"] * 2
    out = []
    for _ in range(rows):
        letters = pick(["abcdefghijklmnoprstuvwy"] * 3 + ["abcdeéèçñöüßaiou", "éèàùçêîôû"])
        word = lambda: pick(cues) if r.random() < 0.25 else "".join(pick(letters) for _ in range(r.randint(1, 10)))  # noqa: B023, E731
        capital, loud, signed, stop = pick([0, 0, 0.1, 0.3, 1]), r.random() < 0.15, pick([0, 0, 0.2, 1]), pick([0, 0.1, 0.5])
        words, most = [], r.randint(3, 40)
        while len(words) < most:
            w = word()
            w = w.upper() if loud else w.capitalize() if r.random() < capital or words and words[-1][-1] in ".!?" else w
            w += pick("#*$%&!?~^+/:=") * r.randint(1, 3) if r.random() < signed else ""
            w += pick(".,;!?") if r.random() < stop else ""
            words += [w] * (pick([2, 3, 20]) if r.random() < 0.05 else 1)
        out.append((" ".join(words[:most]), []))
    for _ in range(rows // 12):
        w = "".join(pick("abcdeilmnorstu") for _ in range(r.randint(2, 8)))
        out.append((" ".join([w.capitalize() + pick(["", ",", ".", ";"])] * r.randint(5, 40)), []))
    return out


#: Distinct words whose scores a worker remembers.
REMEMBERED = 50_000
#: Words that are scored at once.
SCORED = 100_000


class Model:
    """The trained random field and the numbers of its features."""

    def __init__(self, rows: list[tuple[str, list[Span]]], plain: list[tuple[str, list[Span]]] = ()) -> None:
        """Features are those that occur in ``rows``."""
        self.number: dict[str, int] = {}
        sentences, labels = [], []
        for text, spans in [*rows, *plain]:
            words = [m.span() for m in _WORD.finditer(text)]
            tag = [0] * len(words)
            for kind, a, b in spans:
                inside = [i for i, (x, y) in enumerate(words) if x < b and a < y]
                for i in inside:
                    tag[i] = 2 * _ORDER[kind] + (1 if i == inside[0] else 2)
            said = ["", *(text[slice(*w)] for w in words), ""]
            names = [features(w) for w in said]
            for i in range(1, len(said) - 1):
                if told := before(said[max(1, i - BACK) : i]):
                    names[i] = [*names[i], told]
            if len(sentences) < len(rows):
                for f in itertools.chain(*names):
                    self.number.setdefault(f, len(self.number))
            sentences.append([[self.number[f] for f in x if f in self.number] for x in names])
            labels.append(tag)
        self.crf = crf.train(sentences, labels, len(self.number), 2 * len(KINDS) + 1, steps=300)

        self.memory = Memory(2 * REMEMBERED)
        #: What a cue before a word adds to its scores: nothing, then by distance and class.
        self.told = np.zeros((1 + BACK * len(KINDS_OF_CUES), 3, self.crf.labels), np.float32)
        for k in range(BACK):
            for c, kind in enumerate(KINDS_OF_CUES):
                if (i := self.number.get(f"after:{kind}:{k}")) is not None:
                    self.told[1 + k * len(KINDS_OF_CUES) + c] = self.crf.own[i], self.crf.left[i], self.crf.right[i]

    def scores(self, word: str) -> np.ndarray:
        """The own, left and right scores of a word by label."""
        known = [self.number[f] for f in features(word) if f in self.number]
        return np.array([x[known].sum(0) for x in (self.crf.own, self.crf.left, self.crf.right)])


@lru_cache(1)
def model() -> Model:
    return Model(labelled_rows(), plain_rows())


def _doubtful(found: Model, said: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words that may be labelled, and their scores by label. An empty word is the edge of a text."""
    number: dict[str, int] = {"": 0}
    of = {w: number.setdefault(typical(w), len(number)) for w in dict.fromkeys(said)}
    for w in found.memory.missing(set(number)):
        found.memory[w] = found.scores(w)
    table = np.stack([found.memory[w] for w in number])
    kinds = np.array([-1, *(1 + KINDS_OF_CUES.index(CLASSES[c]) if (c := cue(w)) in CLASSES else 0 for w in list(number)[1:])])
    ids = np.fromiter(map(of.__getitem__, said), np.int64, len(said))
    told, seeking = np.zeros(len(ids), np.int64), ids != 0
    for k in range(min(BACK, len(ids) - 1)):
        kind = np.r_[np.full(k + 1, -1), kinds[ids[: -k - 1]]]
        hit = seeking & (kind > 0)
        told[hit] = k * len(KINDS_OF_CUES) + kind[hit]
        seeking &= kind == 0

    def score(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), found.crf.labels), np.float32)
        for part, i in enumerate((at, np.maximum(at - 1, 0), np.minimum(at + 1, len(ids) - 1))):
            out += table[ids[i], part]
            cued = np.flatnonzero(told[i])
            out[cued] += found.told[told[i[cued]], part]
        return out

    gain = np.concatenate([found.crf.gain(score(np.arange(lo, min(lo + SCORED, len(ids))))) for lo in range(0, len(ids), SCORED)])
    gain[ids == 0] = -1e4
    at = np.flatnonzero(found.crf.doubtful(gain))
    return at, score(at)


def added_spans(found: Model, batch: list[str]) -> list[list[Span]]:
    """Spans that the random field labels in each text, whether or not base spans overlap them."""
    said, starts = [""], []
    for text in batch:
        starts.append(len(said))
        said += _WORD.findall(text)
        said.append("")
    at, scores = _doubtful(found, said)
    chains = [x for x in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1) if len(x)]
    out: list[list[Span]] = [[] for _ in batch]
    places: dict[int, list[tuple[int, int]]] = {}
    for chain, tags in zip(chains, found.crf.decode([scores[x[0] : x[-1] + 1] for x in chains]), strict=True):
        if not tags.any():
            continue
        first = int(at[chain[0]])
        k = bisect_right(starts, first) - 1
        if k not in places:
            places[k] = [m.span() for m in _WORD.finditer(batch[k])]
        words = places[k][first - starts[k] : first - starts[k] + len(chain)]
        text, i = batch[k], 0
        while i < len(words):
            if not tags[i]:
                i += 1
                continue
            kind, j = (int(tags[i]) - 1) // 2, i + 1
            while j < len(words) and tags[j] == 2 * kind + 2:
                j += 1
            a, b = words[i][0], words[j - 1][1]
            while b > a and text[b - 1] in ".,;:!?\"')]}" and not (text[b - 1] in ")]}" and text[a] in "([{"):
                b -= 1
            while a < b and text[a] in "\"'" or a < b and text[a] in "([{" and not any(c in ")]}" for c in text[a:b]):
                a += 1
            if a < b and _credible(KINDS[kind], text[a:b]):
                out[k].append((KINDS[kind], a, b))
            i = j
    return out


def _credible(kind: str, found: str) -> bool:
    """Whether a span keeps to the checks of its kind's base pattern."""
    digits = _NOT_DIGITS.sub("", found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return all(int(p[-9:]) <= 255 for p in re.findall("[0-9]+", found)) and (":" in found or found.count(".") == 3)
    return 7 <= len(digits) <= 15 if kind == "phone" else True


def _left_over(text: str, span: Span, base: list[Span]) -> list[Span]:
    """What base spans leave of a span: pieces of 7 letters or digits at least, without blanks around."""
    kind, start, end = span
    out, free = [], start
    for _, a, b in [s for s in base if s[1] < end and start < s[2]] + [("", end, end)]:
        lo, hi = free, min(a, end)
        while lo < hi and text[lo] in " \t\n\x0b\x0c\r.,;:":
            lo += 1
        while hi > lo and text[hi - 1] in " \t\n\x0b\x0c\r.,;:":
            hi -= 1
        if (lo, hi) == (start, end) or sum(map(str.isalnum, text[lo:hi])) >= 7:
            out.append((kind, lo, hi))
        free = max(free, b)
    return out


def all_spans(found: Model, batch: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, both by start, then kind."""
    out = []
    for text, more in zip(batch, added_spans(found, batch), strict=True):
        base = base_spans(text)
        free = [piece for s in more for piece in _left_over(text, s, base)]
        out.append((base, sorted(base + free, key=lambda s: (s[1], _ORDER[s[0]]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Characters of text that are handled at once.
CHUNK = 1_000_000


def _chunks(batch: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    size = 0
    for x in batch:
        if size + len(x) > CHUNK and out[-1]:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x)
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, the number of base spans of each kind, the digest of all base spans, and all spans."""
    rows, found = core(docs, id_col, text_col), model()
    schema = T.StructType(
        [T.StructField(id_col, rows.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def run(batches):
        for b in slices(batches):
            found_here = [x for c in _chunks(list(texts(b, text_col))) for x in all_spans(found, c)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found_here], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found_here], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *counts, digests, pa.array([written(x) for _, x in found_here], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with all their columns; in the text each span is replaced by its kind. A null text stays null."""
    found, place, schema = model(), docs.columns.index(text_col), docs.schema

    def run(batches):
        for b in slices(batches):
            rows = b.column(place).to_pylist()
            spans = [x for c in _chunks([x or "" for x in rows]) for _, x in all_spans(found, c)]
            hidden = pa.array([None if x is None else masked(x, s) for x, s in zip(rows, spans, strict=True)], b.column(place).type)
            yield pa.RecordBatch.from_arrays([hidden if i == place else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, schema)
