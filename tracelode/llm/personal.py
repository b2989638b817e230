"""Problem 9: personal details in free text, found and replaced by keyed surrogates in typed placeholders.

Detection reads each text once: patterns for mail addresses (plain and spelled out), phone numbers, labelled identity
numbers and street addresses, and a name finder that takes pairs of capitalised words (or initials with a word) which the
roster knows, or which stand in a context that names people; family endings are learned from the roster. Details that
overlap are settled by kind: mail, id, address, phone, name.

Surrogate generation: a detail's canonical form (a name's order, case and accents, a number's separators do not count)
is keyed with HMAC, and the digest picks a replacement of the same type and form: digits for digits, capitals for
capitals, the script of the original. A person is the full given and family name; an initial stands for the person whom
the roster and the text's full names leave as the only one, else for itself. A person's gender is what most of the titles
before that name in the whole corpus tell, and the given name is from its list; without titles, or with as many of each,
from both lists. Within a text, different details never share a surrogate (the key is stepped on until none collides),
and the same detail has the same one over the whole corpus, except where such a collision stepped one of them on.

A roster of at most `MAX_ROSTER` people is broadcast after a check of its size. A larger one is joined in: the capitalised
words of each document meet the roster's words, and every document is read with the part of the roster that its own words
can touch, which gives the same details (`lexicons`).

Defined results: null, empty and blank texts hold nothing and come back as they are; a detail is listed once per document
and kind, exactly as it stands; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import spread, stored

MAX_ROSTER = 200_000

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:\s?[(\[{<]\s?(?:at|AT|ät|arroba)\s?[)\]}>]\s?)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|punkt|punto|point)\s?[)\]}>]\s?)"
EMAIL = re.compile(
    rf"(?<![\w.+%/@-])[^\W_][\w.+%-]*(?:@{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}|{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}"
    rf"|\s(?:at|AT|arroba)\s{_LABEL}(?:\s(?:dot|DOT|punkt|punto|point)\s{_LABEL})*\s(?:dot|DOT|punkt|punto|point)\s[A-Za-z]{{2,}})(?![\w-]|\.\w)"
)
#: What follows or precedes an address of a repository.
_REPOSITORY_AFTER = re.compile(r"^(?::(?!\s)[\w~./-]+|/[\w~.-])")
_REPOSITORY_BEFORE = re.compile(r"(?:ssh|git|https?|git\+ssh)://[^\s@]*$")

PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d[ (])(?:"
    r"(?:\+1[ .-]?|001[ .-]?|1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}"
    r"|(?:\+44 ?(?:\(0\) ?)?|0044 ?)\d{2,4} ?\d{3,4} ?\d{3,4}|\(?0\d{2,4}\)? \d{3,4} \d{3,4}"
    r"|(?:\+33 ?(?:\(0\) ?)?|0033 ?)[1-9](?:[ .-]?\d{2}){4}|0[1-9](?:[ .-]\d{2}){4}"
    r"|(?:\+49 ?(?:\(0\) ?)?|0049 ?|\(?0)\d{2,4}\)?[ /-] ?\d{3,9}(?:[ -]\d{2,5})?"
    r"|(?:\+34 ?|0034 ?)\d{3}(?:[ .-]?\d{2,3}){2,3}"
    r"|(?:\+|00)\d{1,3}(?:[ ./-]\(?\d{1,5}\)?){2,6}|\+\d{9,14}"
    r")(?![\w-]|[./]\d)"
)

_ID_LABEL = re.compile(
    r"(?:\bssn\b|\bsocial\b|social security|sécurité sociale|seguridad social|sozialversicherung\w*|\btax(?:payer)?\b|\btin\b|steuer\w*|\bidnr\b|\bfiscal\b|\bnif\b|\bnie\b|\bdni\b|\binsee\b"
    r"|passport|reisepass\w*|passeport|pasaporte|identity|identidad|identité|national id|\bid[ -]card\b|ausweis\w*|personalausweis\w*)[^\n\d]{0,24}$",
    re.IGNORECASE,
)
ID_NUMBER = re.compile(r"(?<![\w./-])(?:\d{3}([ -]?)\d{2}\1\d{4}|\d{2}([ /.]?)\d{3}\2\d{3}\2\d{3}|[A-Z]{1,2}\d{7,8}|\d{7,8}-?[A-Z]|[A-Z]\d{2}[A-Z0-9]{6,7})(?![\w]|-\w)")

_WORD = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:"
    rf"(?:(?:[Ff]lat|FLAT|[Uu]nit|UNIT|[Aa]pt\.?|APT\.?)[  ]\d+[A-Za-z]?,[  ])?\d{{1,4}}[A-Za-z]?[  ](?:(?P<which>North|South|East|West|Old|New|Upper|Lower|Great|NORTH|SOUTH|EAST|WEST|OLD|NEW|UPPER|LOWER|GREAT)[  ])?(?P<street>[^\W\da-z_]{_WORD})[  ]"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Ter|Way|Place|Pl|Boulevard|Blvd|Square|Sq|Close|Crescent|STREET|ST|AVENUE|AVE|ROAD|RD|LANE|LN|DRIVE|DR|COURT|CT|TERRACE|WAY|PLACE|PL|BOULEVARD|BLVD|SQUARE|CLOSE|CRESCENT)\b"
    r"(?:,[  ](?:[Aa]pt|APT|[Ff]lat|FLAT|[Uu]nit|UNIT|[Ss]uite|SUITE|[Aa]partment|APARTMENT)\.?[  ]\d+[A-Za-z]?\b)?"
    rf"|(?P<strasse>[^\W\da-z_]{_WORD})(?:(?<=straße)|(?<=strasse)|(?<=STRASSE)|(?<=STRAßE)|(?<=str)\.|(?<=STR)\.|(?<=weg)|(?<=WEG)|(?<=gasse)|(?<=GASSE)|(?<=platz)|(?<=PLATZ)|(?<=allee)|(?<=ALLEE)|(?<=ufer)|(?<=damm)|(?<=ring))[  ]\d{{1,4}}(?:[  ]?[a-zA-Z])?(?!\w)(?:,[  ](?:Whg|Wohnung|WHG|WOHNUNG)\.?[  ]\d+\b)?"
    rf"|\d{{1,4}}(?:[  ]?(?:bis|ter|BIS|TER))?,?[  ](?:rue|avenue|boulevard|chemin|place|allée|quai|impasse|RUE|AVENUE|BOULEVARD|CHEMIN|PLACE|ALLÉE|QUAI|IMPASSE)[  ](?:(?:de[  ]la|de[  ]l['’]|des|du|de|d['’]|DE[  ]LA|DES|DU|DE)[  ]?)?(?P<rue>[^\W\da-z_]{_WORD})(?:,[  ](?:appt|apt|APPT|APT)\.?[  ]\d+\b)?"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|CALLE|AVENIDA|PLAZA|PASEO|CAMINO|C/)[  ]?(?:(?:de[  ]la|de[  ]los|del|de|DE[  ]LA|DEL|DE)[  ])?(?P<calle>[^\W\da-z_]{_WORD}),?[  ](?:n\.?º[  ]?)?\d{{1,4}}[a-zA-Z]?\b(?:,[  ]\d+\.?º[  ]?[A-Za-z]?\b)?"
    r")"
)

_CAP = r"[^\W\d_a-zà-öø-ÿ]['’]?[^\W\d_]+(?:['’-][^\W\d_]+)*"
_INITIAL = r"[^\W\d_a-zà-öø-ÿ]\."
_GAP = r"[  ]"
NAME = re.compile(rf"(?<![\w./+-])(?:(?:{_INITIAL}{_GAP}?){{1,2}}{_CAP}|{_CAP}(?:{_GAP}{_INITIAL}){{0,2}}{_GAP}{_CAP}|{_CAP},{_GAP}(?:{_CAP}(?:{_GAP}{_INITIAL})?|{_INITIAL}))(?![\w@]|[.-]\w)")
_PIECE = re.compile(rf"{_INITIAL}|{_CAP}|,|{_GAP}+")

#: Words that begin sentences, titles and labels: never part of a name (fixed values).
NOT_NAMES = frozenset(
    "yesterday today as it is was the a an and or but thanks thx assigned reported signed co met with to from cc by talked i we he she they author reviewer reviewed owner user login contact ask call text write mail send please when "
    "der die das ein eine bitte gestern heute frau herr gemeldet ansprechpartner von und ist "
    "el la los las un una ayer hoy señora señor sra sr informado pregunte responsable por "
    "le les une hier mme mlle monsieur madame signalé demandez demander contactez c'est est "
    "mr mrs ms dr prof monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag "
    "january february march april may june july august september october november december "
    "error note warning epoch version rows node chunk ticket only nothing fetched tax tin ssn passport identity national social steuer todo fixme".split()
)

_SAID = re.compile(
    r"(?:reported by|thanks to|\bthx|\bcc|assigned to|signed-off-by:|co-authored-by:|reviewed-by:|acked-by:|tested-by:|reviewer ?[:=|]|author ?[:=|]|committer ?[:=|]|owner ?[:=|]|assignee ?[:=|]|contact ?[:=|]|\bfrom:|\bto:|\bit was|\bas|yesterday|talked to|spoke (?:to|with)|met with|\bask|\bdr\.?|\bprof\.?|\bmrs?\.?|\bms\.?|\bherrn?|\bfrau"
    r"|\bse[ñn]ora?|\bsra?\.|\bmme|\bmlle|monsieur|madame|todo\(|fixme\(|(?<!\w)@|\buser|login ok for|login failed for|\"(?:reviewer|author|owner|name|user|assignee|contact)\": ?|gemeldet von|ansprechpartner(?:in)? ?:|\bbitte|gestern haben|informado por|pregunte a|responsable ?:|\bayer|hier,?|signalé par|c['’]est|demande[zr] à|\bpara:|\bvon:|\ban:|\bde ?:|\bà ?:)[\s\"'|]*$",
    re.IGNORECASE,
)
_DOES = re.compile(
    r"^[\"']?(?:\s(?:wrote|schrieb|escribió|a écrit)\s?:|\s(?:said|asked for|has left|can you|and i |who found|und ich|hat den|hat das|prüft|fragen|miró|paró|qui a|a relancé|a trouvé)|\sa\s\w+é|, ?please|\), |\): ?|,? ?[<(][^<>()\s]+(?:@|\s?[(\[])|, (?:\+|\(?0?\d{2,}|00|1-\d))",
    re.IGNORECASE,
)


def fold(word: str) -> str:
    """Lower case without accents and apostrophes."""
    d = unicodedata.normalize("NFKD", word.casefold())
    return "".join(c for c in d if not unicodedata.combining(c) and c not in "'’-")


class Lexicon:
    """Given names, family names and family endings of the known people."""

    def __init__(self, names: list[str], least: int = 3, endings: tuple[str, ...] | None = None):
        parts = [[fold(x) for x in re.split(r"\s+", n.strip()) if x] for n in names if n and n.strip()]
        self.some = bool(parts) or bool(endings)
        self.given = frozenset(p[0] for p in parts if len(p) > 1)
        self.family = frozenset(p[-1] for p in parts)
        #: Given names of the known people by initial and family name.
        self.people: dict[tuple[str, str], set[str]] = {}
        for p in parts:
            if len(p) > 1:
                self.people.setdefault((p[0][:1], p[-1]), set()).add(p[0])
        ends = Counter(f[-k:] for f in self.family for k in (2, 3, 4) if len(f) > k + 2)
        self.endings = tuple(e for e, n in ends.items() if n >= max(least, len(self.family) // 60)) if endings is None else endings

    def family_like(self, word: str) -> bool:
        f = fold(word)
        return f in self.family or (len(f) > 4 and f.endswith(self.endings)) if self.endings else f in self.family


def _spans(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        yield m.span()


def _names(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    at = 0
    while m := NAME.search(text, at):
        start, end = m.span()
        pieces = [p for p in _PIECE.finditer(text, start, end) if p.group().strip()]
        words = [p for p in pieces if p.group() not in (",",)]
        first = next((p for p in words if not p.group().endswith(".")), None)
        if first is not None and first is words[0] and fold(first.group()) in NOT_NAMES or fold(words[0].group().rstrip(".")) in NOT_NAMES and len(words[0].group()) > 2:
            at = words[1].start() if len(words) > 1 else end  # the match began with a word that is no name
            continue
        full = [p.group() for p in words if not p.group().endswith(".")]
        comma = any(p.group() == "," for p in pieces)
        if any(fold(w) in NOT_NAMES for w in full):
            at = end if comma is False else words[0].end()
            continue
        if not full or len(full) == 1 and comma and len(words) < 2:
            at = end
            continue
        family, given = (full[0], full[1:]) if comma else (full[-1], full[:-1])
        known_family, known_given = fold(family) in lexicon.family, any(fold(g) in lexicon.given for g in given)
        cue = bool(_SAID.search(text, max(0, start - 40), start)) or bool(_DOES.match(text[end : end + 48]))
        family_like = lexicon.family_like(family)
        if given:
            good = known_family and (known_given or cue) or known_given and (family_like or cue) or cue and family_like or known_family and not comma and not text[start].islower()
        else:
            good = known_family or family_like and cue
        if not good and cue and not lexicon.some:
            good = True
        if good:
            yield start, end
            at = end
        else:
            at = words[1].start() if len(words) > 1 else end


def details(text: str | None, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all details of a text, in order, without overlaps."""
    if not text or text.isspace():
        return []
    taken: list[tuple[int, int, str]] = []

    def add(kind: str, start: int, end: int) -> None:
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, kind))

    lower = text.lower()
    if "@" in text or " at " in lower or "(at" in lower or "[at" in lower or "{at" in lower or "<at" in lower or "arroba" in lower:
        for a, b in _spans(EMAIL, text):
            if not (_REPOSITORY_AFTER.match(text[b : b + 40]) or _REPOSITORY_BEFORE.search(text[max(0, a - 60) : a])):
                add("email", a, b)
            else:
                taken.append((a, b, ""))
    for a, b in _spans(ID_NUMBER, text):
        if _ID_LABEL.search(text, max(0, a - 60), a):
            add("id_number", a, b)
    for a, b in _spans(ADDRESS, text):
        add("address", a, b)
    for a, b in _spans(PHONE, text):
        if 8 <= sum(c.isdigit() for c in text[a:b]) <= 15:
            add("phone", a, b)
    for a, b in _names(text, lexicon):
        add("name", a, b)
    return [(k, a, b) for a, b, k in sorted(taken) if k]


#: Surrogate words (fixed values), by gender of the given name; families for all.
FEMALE = ("Alva", "Berit", "Carla", "Dora", "Edda", "Fiona", "Greta", "Hanna", "Ines", "Jana", "Klara", "Lene", "Mara", "Nora", "Olga", "Petra", "Rosa", "Signe", "Thea", "Vera")
MALE = ("Anton", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Max", "Nils", "Otto", "Paul", "Rolf", "Simon", "Theo", "Viktor")
FAMILIES = ("Ahlberg", "Brandt", "Colman", "Dahl", "Ebner", "Falk", "Gruber", "Holm", "Irving", "Jansen", "Keller", "Lund", "Moreau", "Novak", "Ortega", "Parker", "Quist", "Rossi", "Serrano", "Thorne", "Ullman", "Vidal", "Weber", "Zeller")
#: By script: given names of women and men, beginnings of family names, consonants and vowels of their ends.
POOLS = {
    "LATIN": (FEMALE, MALE, FAMILIES, "bcdfghjklmnprstvwxz", "aeiou"),
    "CYRILLIC": (
        ("Алла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Тамара"),
        ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Степан", "Тимур"),
        ("Бонд", "Верх", "Град", "Долг", "Заб", "Колт", "Луг", "Мороз", "Новак", "Орл", "Рост", "Сад", "Тарас", "Холм", "Черн", "Шевч"), "бвгджзклмнпрстфх", "аеиоу",
    ),
    "GREEK": (
        ("Αγγελική", "Βέρα", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Όλγα", "Σοφία"),
        ("Αντώνης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λουκάς", "Μάρκος", "Νίκος", "Παύλος", "Στέφανος"),
        ("Αλεξ", "Βασ", "Γαλαν", "Δημ", "Ζαφ", "Θεοδ", "Καρ", "Λαμπρ", "Μαυρ", "Νικολ", "Παππ", "Σταμ"), "βγδζθκλμνπρστφχ", "αεηιο",
    ),
}
_WHICH = ("North", "South", "East", "West", "Old", "New", "Upper", "Lower", "Great")
_STREET_END = re.compile(r"(?:straße|strasse|str|weg|gasse|platz|allee|ufer|damm|ring)$", re.IGNORECASE)
_SHE = re.compile(r"(?:\bfrau|\bmrs\.?|\bms\.?|\bmme|\bmlle|madame|se[ñn]ora|\bsra\.)\s*$", re.IGNORECASE)
_HE = re.compile(r"(?:\bherrn?|\bmr\.?|monsieur|se[ñn]or|\bsr\.)\s*$", re.IGNORECASE)


@cache
def _letters(script: str) -> list[str]:
    """Letters of a script that has no pools, lower ones where it has cases."""
    start = 0x4E00 if script == "CJK" else 0x370
    own = (c for c in map(chr, range(start, 0x20000)) if unicodedata.category(c) in ("Lo", "Ll") and unicodedata.name(c, "").split(" ")[0] == script)
    return list(islice(own, 64)) or list("abcdefghijklmnopqrstuvwxyz")


def canonical(kind: str, found: str) -> str:
    """What makes two spellings the same detail."""
    if kind == "name":
        words = [w for w in re.split(r"[\s,]+", found) if w]
        if "," in found:
            words = words[1:] + words[:1]
        full = [fold(w) for w in words if not w.endswith(".")]
        given = fold(words[0])
        return f"{given[:1] + '.' if given.endswith('.') else given}|{full[-1] if full else ''}"
    if kind in ("phone", "id_number"):
        return "".join(c for c in found.upper() if c.isalnum())
    if kind == "email":
        t = re.sub(_AT, "@", found.lower())
        return re.sub(r"\s", "", re.sub(_DOT, ".", t))
    return " ".join(fold(w) for w in found.split())


def _street(found: str, pick: Iterator[int]) -> str:
    """An address with another street name and other digits; types, particles and the unit's label stay, as they name nobody."""
    m = ADDRESS.fullmatch(found)
    spans = {k: m.span(k) for k in m.groupdict() if m[k] is not None} if m else {str(x.start()): x.span() for x in re.finditer(_WORD, found)}
    if "strasse" in spans:
        spans["strasse"] = (spans["strasse"][0], _STREET_END.search(found, *spans["strasse"]).start())
    out, at = [], 0
    for k, (a, b) in sorted(spans.items(), key=lambda x: x[1]):
        old = fold(found[a:b])
        if k == "which":
            new = [w for w in _WHICH if fold(w) != old][next(pick) % (len(_WHICH) - 1)]
        else:
            word = [w for w in FAMILIES if fold(w) != old][next(pick) % (len(FAMILIES) - 1)]
            new = word + chr(97 + next(pick) % 26) + "aeiou"[next(pick) % 5] if a < b else ""
        out += [found[at:a], new.upper() if found[a:b].isupper() else new]
        at = b
    # digits are replaced between the new words
    out = [re.sub(r"\d", lambda _: str(1 + next(pick) % 9), x) for x in [*out, found[at:]]]
    return "".join(out)


def identities(text: str, spans: list[tuple[str, int, int]], lexicon: Lexicon) -> list[str]:
    """Whom or what each detail of a text means: its canonical form, an initial resolved where one person only can be meant."""
    own = [canonical(k, text[a:b]) for k, a, b in spans]
    here: dict[tuple[str, str], set[str]] = {}
    for (kind, _, _), who in zip(spans, own):
        given, _, family = who.partition("|")
        if kind == "name" and not given.endswith("."):
            here.setdefault((given[:1], family), set()).add(given)
    for k, ((kind, _, _), who) in enumerate(zip(spans, own)):
        given, _, family = who.partition("|")
        if kind == "name" and given.endswith("."):
            meant = here.get((given[:1], family), set()) | lexicon.people.get((given[:1], family), set())
            if len(meant) == 1:
                own[k] = f"{min(meant)}|{family}"
    return own


def title_gender(text: str, start: int) -> str:
    """f or m as the title before a name tells, else empty."""
    return "f" if _SHE.search(text, max(0, start - 12), start) else "m" if _HE.search(text, max(0, start - 12), start) else ""


def surrogate(kind: str, found: str, key: bytes, step: int, gender: str = "", who: str | None = None) -> str:
    """A replacement of the same form, the same for the same identity (else canonical form), key and step."""
    who = canonical(kind, found) if who is None else who
    digest = hmac.new(key, f"{kind}|{who}|{step}".encode(), hashlib.sha256).digest()
    pick = iter(digest * (1 + len(found) // 16))
    if kind == "name":
        script = unicodedata.name(who.partition("|")[2][:1] or found[0], "LATIN").split(" ")[0]
        if script in POOLS:
            female, male, families, consonants, vowels = POOLS[script]
            pool = female if gender == "f" else male if gender == "m" else female + male
            given = pool[(digest[0] * 256 + digest[1]) % len(pool)]
            ends = zip(digest[4:12:2], digest[5:12:2])
            family = families[(digest[2] * 256 + digest[3]) % len(families)] + "".join(consonants[x % len(consonants)] + vowels[y % len(vowels)] for x, y in ends)
        else:
            letters = _letters(script)
            given, family = ("".join(letters[x % len(letters)] for x in part).capitalize() for part in (digest[:4], digest[4:11]))
        if found.isupper():
            given, family = given.upper(), family.upper()
        words = [w for w in re.split(r"[\s,]+", found) if w]
        short = [w for w in words if w.endswith(".")]
        lone = len(words) - len(short) < 2
        first = given[0] + "." if lone else given + (f" {given[-1].upper()}." if short else "")
        return f"{family}, {first}" if "," in found else f"{first} {family}"
    if kind == "email":
        local = "".join(chr(97 + next(pick) % 26) if c.isalpha() else str(next(pick) % 10) if c.isdigit() else c for c in re.split(r"@|\s?[(\[{<]|\s", found)[0])
        return f"{local}@mail.example"
    if kind == "address":
        return _street(found, pick)
    out = []
    for i, c in enumerate(found):
        if c.isdigit() and not (kind == "phone" and i < 3 and found[0] in "+0("):
            out.append(str(next(pick) % 10))
        elif c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + next(pick) % 26))
        else:
            out.append(c)
    return "".join(out)


def redacted(text: str | None, lexicon: Lexicon, key: bytes, genders: dict[str, str] | None = None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with every detail replaced by `[kind: surrogate]`; without the people's genders, the text's own titles tell them."""
    if not text:
        return text
    spans = details(text, lexicon) if spans is None else spans
    own = identities(text, spans, lexicon)
    if genders is None:
        told = Counter((who, g) for (kind, a, _), who in zip(spans, own) if kind == "name" and (g := title_gender(text, a)))
        genders = {who: "f" if told[who, "f"] > told[who, "m"] else "m" for who, _ in told if told[who, "f"] != told[who, "m"]}
    given: dict[tuple[str, str], int] = {}
    used: dict[tuple[str, str], tuple[str, str]] = {}
    out, at = [], 0
    for (kind, a, b), meant in zip(spans, own):
        who = (kind, meant)
        step = given.get(who, 0)
        while True:
            new = surrogate(kind, text[a:b], key, step, genders.get(meant, ""), meant)
            form = canonical(kind, new)
            if kind == "name":  # an initial with the family name must tell people apart as well
                form = form[:1] + "|" + form.partition("|")[2]
            if used.setdefault((kind, form), who) == who and canonical(kind, new) != meant:
                break
            step += 1
        given[who] = step
        out += [text[at:a], f"[{kind}: {new}]"]
        at = b
    return "".join([*out, text[at:]])


def capitalised(text: str | None) -> list[str]:
    """The distinct words of a text that a name of it could be made of, folded."""
    return sorted({fold(w) for w in _CAPITALISED.findall(text)} - {""}) if text else []


_CAPITALISED = re.compile(rf"(?<![^\W\d_]){_CAP}")


def lexicons(docs: DataFrame, roster: DataFrame, most: int = MAX_ROSTER) -> tuple[DataFrame, Lexicon | None, tuple[str, ...]]:
    """Documents (doc_id, text, known: the roster's names that their words can touch, or null), a lexicon for all of them where
    the roster is small enough to be broadcast, and else the family endings, which are few.

    A name is touched by a document that has its family name or one of its given names; both sides of the join are words.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    names = roster.select("displayName").filter("displayName is not null").distinct()
    if names.limit(most + 1).count() <= most:
        return spread(plain).withColumn("known", F.lit(None).cast("array<string>")), Lexicon([r[0] for r in names.collect()]), ()
    rows = stored(plain.withColumn("uid", F.monotonically_increasing_id()), "texts")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(u, w) for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in capitalised(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["uid", "word"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(n, fold(w), k == len(ws) - 1) for n in b.column(0).to_pylist() for ws in [n.split()] for k, w in enumerate(ws) if k in (0, len(ws) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["name", "word", "last"])

    named = stored(names.mapInArrow(parts, "name STRING, word STRING, last BOOLEAN"), "roster")
    families = named.filter("last").select("word").distinct()
    ends = families.select(F.explode(F.array(*[F.when(F.length("word") > k + 2, F.substring("word", -k, k)) for k in (2, 3, 4)])).alias("e")).filter("e is not null").groupBy("e").agg(F.count("*").alias("n"))
    least = max(3, families.count() // 60)
    endings = tuple(sorted(r["e"] for r in ends.filter(F.col("n") >= least).collect()))  # three endings a family, at least a sixtieth each: 180 at most
    touched = rows.select("uid", "text").filter("text is not null").mapInArrow(words, "uid LONG, word STRING").join(named.select("word", "name"), "word").groupBy("uid").agg(F.collect_set("name").alias("known"))
    return rows.join(touched, "uid", "left").select("doc_id", "text", F.coalesce("known", F.array().cast("array<string>")).alias("known")), None, endings


def _reader(whole: Lexicon | None, endings: tuple[str, ...]):
    """The lexicon of a document from its own part of the roster, or the one of all."""
    return lambda known: whole if known is None else Lexicon(known, endings=endings)


def find_details(docs: DataFrame, roster: DataFrame, max_roster: int = MAX_ROSTER) -> DataFrame:
    """doc_id, kind, found: each detail once per document and kind."""
    texts, whole, endings = lexicons(docs, roster, max_roster)
    sent = docs.sparkSession.sparkContext.broadcast((whole, endings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _reader(*sent.value)
        for b in batches:
            rows = [(d, k, f) for d, t, n in zip(*(b.column(i).to_pylist() for i in range(3))) for k, f in dict.fromkeys((k, t[x:y]) for k, x, y in details(t, of(n)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "kind", "found"])

    return texts.mapInArrow(run, "doc_id LONG, kind STRING, found STRING")


def redact(docs: DataFrame, roster: DataFrame, key: str, max_roster: int = MAX_ROSTER) -> DataFrame:
    """doc_id, text with placeholders; `key` is the caller's secret.

    Details are found once and written to the shared folder; the titles before each person's names are counted over all
    documents, and each document gets the genders of its own people by joins, so no list of people is collected.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    texts, whole, endings = lexicons(docs, roster, max_roster)
    sent = docs.sparkSession.sparkContext.broadcast((whole, endings))
    detail, person = (pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]), pa.struct([("person", pa.string()), ("gender", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _reader(*sent.value)
        for batch in batches:
            all_spans, people = [], []
            for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = of(n)
                found = details(t, known)
                all_spans.append([{"kind": k, "a": a, "b": b} for k, a, b in found])
                people.append([{"person": who, "gender": title_gender(t, a)} for (kind, a, _), who in zip(found, identities(t, found, known)) if kind == "name"] if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(all_spans, pa.list_(detail)), pa.array(people, pa.list_(person))], names=["doc_id", "text", "known", "spans", "people"])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _reader(*sent.value)
        for batch in batches:
            new = [
                redacted(t, of(n), key.encode(), {g["person"]: g["gender"] for g in genders or ()}, [(x["kind"], x["a"], x["b"]) for x in spans])
                for t, n, spans, genders in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc_id", "text"])

    schema = "doc_id LONG, text STRING, known ARRAY<STRING>, spans ARRAY<STRUCT<kind: STRING, a: INT, b: INT>>, people ARRAY<STRUCT<person: STRING, gender: STRING>>"
    found = stored(texts.mapInArrow(find, schema), "details")
    named = found.select("doc_id", F.explode("people").alias("p")).select("doc_id", "p.person", "p.gender")
    told = named.filter("gender <> ''").groupBy("person").agg(F.sum(F.when(F.col("gender") == "f", 1).otherwise(-1)).alias("n"))
    told = told.filter("n <> 0").select("person", F.when(F.col("n") > 0, "f").otherwise("m").alias("gender"))
    of_doc = named.select("doc_id", "person").distinct().join(told, "person").groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("person", "gender")).alias("genders"))
    return found.join(of_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "known", "spans", "genders").mapInArrow(replace, "doc_id LONG, text STRING")
