"""Personal items in free text: regular expressions propose spans, validators and
nearby words score them, and typed placeholders replace what scores enough.

Every candidate has a base score of its pattern. Check digits decide where a format alone is
ambiguous: right ones (Luhn, mod 97, mod 11, mod 23) lift a number over the threshold
without any word beside it, wrong ones take it below unless a word speaks for it. Cue
words near a candidate raise its own kind and lower others.

Names come from a lexicon: the given list plus the name words learned from frames
that enclose a name on both sides (``Reported by ... (address)``). How often a word
stands in such frames, of all its capitalised uses, tells names from ordinary words
that are names too (``Page``, ``Cookie``): those count only beside a clear name word
or inside a frame. What is learned is counts over all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

try:
    import ahocorasick
except ImportError:  # words are looked up one by one then
    ahocorasick = None

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import column_map
from ..session import staged

THRESHOLD = 0.5
#: A name word is clear when at least this share of its uses is inside name frames.
CLEAR_SHARE = 0.25
#: Most name words the driver holds (beyond, each text is joined with its own), and up to which they are broadcast to count their uses.
MAX_WORDS = 2_000_000
BROADCAST_WORDS = 500_000

# Checksums ------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return bool(digits) and total % 10 == 0


def mod97_key(digits: str) -> bool:
    """Thirteen digits and the two-digit key that makes them 97 - n mod 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def iso7064_11_10(digits: str) -> bool:
    p = 10
    for d in digits[:-1]:
        s = (int(d) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


#: Check letters of Spanish identity numbers, by the number modulo 23; fixed values.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def dni(text: str) -> bool:
    body = text.replace("-", "").upper()
    number = body[:-1].translate(str.maketrans("XYZ", "012"))
    return number.isdigit() and DNI_LETTERS[int(number) % 23] == body[-1]


def iban(text: str) -> bool:
    """Country, check digits and account that leave 1 modulo 97, letters counted from A as 10."""
    body = text.replace(" ", "")
    moved = body[4:] + body[:4]
    return 15 <= len(body) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


# Emails ---------------------------------------------------------------------

_NOT_TLD = frozenset("css gif html ico jpeg jpg js json mjs pdf png svg ts txt webp xml".split())
_EMAIL = re.compile(
    r"(?<![\w.+%@-])(?P<local>\w[\w.+%'-]*)"
    r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|@| at (?=[\w-]+(?: dot |\s?[\[({]))|＠)"
    r"(?P<domain>(?:[\w-]+(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?| dot ))+(?P<tld>[A-Za-z]{2,24}))(?![\w@-])",
    re.I,
)


#: At signs in disguise, and small texts of which one is there where they are.
_DISGUISE = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]|\bat (?=[\w-]+(?: dot |\s?[\[({]))", re.I)
_DISGUISED = ("(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at", " dot ", "dot]", "dot)", "dot}", "[.", "(.")


def _at_signs(text: str) -> list[int]:
    """Where something that may stand for an at sign begins."""
    found, at = [], text.find("@")
    while at >= 0:
        found.append(at)
        at = text.find("@", at + 1)
    if "＠" in text:
        found += [i for i, c in enumerate(text) if c == "＠"]
    low = text.lower()
    if any(x in low for x in _DISGUISED):
        found = sorted({*found, *(m.start() for m in _DISGUISE.finditer(text))})
    return found


_MAIL_WORDS = re.compile(r"(?:mail|contact|write|kontakt|courriel|correo|cc|user|to|from|by)\W{0,3}\Z", re.I)


def emails(text: str) -> list[tuple[int, int, str, float]]:
    """Addresses with their scores: how plainly they are written, what they end in, words before them.

    The pattern is tried around at signs and their disguises only, from the blank before the
    local part to where the pattern ends.
    """
    out, end = [], 0
    for sign in _at_signs(text):
        if sign < end:
            continue
        start = sign
        while start > end and (text[start - 1].isalnum() or text[start - 1] in "._+%'-"):
            start -= 1
        if start == sign and start > end and text[start - 1].isspace():
            start -= 1
            while start > end and (text[start - 1].isalnum() or text[start - 1] in "._+%'-"):
                start -= 1
        m = _EMAIL.search(text, max(start, 0), min(len(text), sign + 330))
        if m is None or m.start() > sign:
            continue
        plain = "@" in m[0] or "＠" in m[0]
        score = 0.8 if plain else 0.55
        if m["tld"].lower() in _NOT_TLD:
            score -= 0.5
        if _MAIL_WORDS.search(text, max(0, m.start() - 12), m.start()):
            score += 0.1
        out.append((m.start(), m.end(), "email", score))
        end = m.end()
    return [c for c in out if c[3] >= THRESHOLD]


# Phones and identity numbers ------------------------------------------------

_EXT = r"(?:,? ?(?:ext\.?|x|extension|Durchwahl|poste) ?\d{1,6})?"
_L, _R = r"(?<![\w.#/+-])", r"(?![\w]|[.,/-]\d|-\w)"
#: Base score and pattern of phone numbers.
_PHONES = [
    (0.7, r"\(\+\d{1,3}\) ?\d(?:[ .-]?\d){6,11}" + _EXT),
    (0.7, r"\+\d{1,3}[ .-]?(?:\(0\))?[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d(?:[ ./-]?\d){6,12}" + _EXT),
    (0.6, r"00\d{2,4}[ ./-]?\d(?:[ ./-]?\d){7,11}"),
    (0.65, r"\(\d{3}\) ?\d{3}[ .-]\d{4}" + _EXT),
    (0.55, r"\d{3}([ .-])\d{3}\1\d{4}" + _EXT),
    (0.6, r"\(0\d{1,5}\)[ /]?\d{2,6}(?:[ -]?\d{2,5}){1,2}"),
    (0.6, r"0\d{1,5}/\d{3,6}(?:[ -]\d{1,5})?"),
    (0.55, r"0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|0\d{4}[ -]\d{5,6}"),
    (0.55, r"0\d([ .-])\d{2}(?:\1\d{2}){3}"),
    (0.35, r"\d{3}([ .-])\d{3}\1\d{3}|\d{3} \d{2} \d{2} \d{2}"),
    (0.2, r"\d{9,11}"),
]
#: Base score, pattern, check and what a right check digit adds; a wrong one takes ``WRONG_CHECK`` off.
_IDS = [
    (0.65, r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", None, 0),
    (0.6, r"\d{3}-\d{2}-\d{4}", None, 0),
    (0.5, r"\d{3} \d{2} \d{4}", None, 0),
    (0.55, r"[12378459] \d{2} \d{2} (?:\d{2}|2[AB]) \d{3} \d{3}(?: \d{2})?", mod97_key, 0.3),
    (0.3, r"\d{13}(?: ?\d{2})?", mod97_key, 0.3),
    (0.45, r"\d{2} \d{3} \d{3} \d{3}", iso7064_11_10, 0.2),
    (0.3, r"\d{11}", iso7064_11_10, 0.2),
    (0.5, r"[A-Z]\d{8}[A-Z]|[A-Z]{2}\d{7}", None, 0),
    (0.4, r"[A-Z]\d{8}|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}", None, 0),
    (0.55, r"\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]", dni, 0.3),
    (0.3, r"\d{3}([ -])\d{3}\1\d{3}", luhn, 0.3),
    (0.3, r"\d{9}", luhn, 0.15),
    (0.45, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", iban, 0.4),
    (0.45, r"[3-6]\d{3}(?:([ -]?)\d{4}(?:\1\d{4}){2}(?:\1\d{1,3})?|[ -]?\d{6}[ -]?\d{5})", luhn, 0.4),
]
#: What a right cue near a number adds, a cue of the other kind and a wrong check digit take off.
CUE, OTHER_CUE, WRONG_CHECK = 0.4, 0.25, 0.1
#: What a stretch must hold for the pattern at the same place to be tried.
_PHONE_NEEDS = ("(+", "+", "00", "(", "", "(0", "/", "0", "0", "", "")
_ID_NEEDS = ("A", "-", " ", " ", "", " ", "", "A", "", "A", "", "", "A", "")
_PHONES = [(s, re.compile(_L + f"(?:{r})" + _R)) for s, r in _PHONES]
_IDS = [(s, re.compile(_L + f"(?:{r})" + _R), check, gain) for s, r, check, gain in _IDS]
#: The one identity number that may hold few digits.
_ALPHANUMERIC = next(entry for entry in _IDS if "[CFGH" in entry[1].pattern)
_PHONE_WORDS = re.compile(
    r"\b(?:tel|telephone|phone|mobile|cell|fax|call|ring|dial|whatsapp|tél|téléphon\w*|appele\w*|joindre|telefon\w*|teléfono|móvil|llam\w*|anruf\w*|rufnummer|handy|unter|reach me|numéro de tél\w*)\b|📞|☎",
    re.I,
)
_ID_WORDS = re.compile(
    r"\b(?:ssn|sin|social insurance|social security|national insurance|nino|insurance n\w*|passport|passeport|pasaporte|reisepass|ausweis\w*|personalausweis|steuer\w*|tax id|tin|nif|nie|dni|cif|insee|sécu\w*|sécurité sociale"
    r"|sozialversicherung\w*|seguridad social|my id|id(?= ?[=:])|identity|identité|identidad|record for|belongs to|issued to|titular|le numéro|national id|carte|licen[cs]e n\w*)\b",
    re.I,
)
#: Words before numbers of things, not of persons.
_THINGS = frozenset(
    "serial ticket part order build hash run row state zustand estado état l'état version sku issue invoice tile tiles port status seen".split()
)
_NOT_PERSONAL = re.compile(rf"(?:\b(?:{'|'.join(sorted(_THINGS))})[ #:=]*|https?://\S*|#)\Z", re.I)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


#: Nine capitals and digits, at least one of them a digit and the first a letter or digit.
_LETTERED = re.compile(r"(?<![\w.#/+-])[A-Z](?=[A-Z]*\d)[A-Z0-9]{8}(?!\w)")


#: Six digits or more with short separators: every number but the alphanumeric ones holds such a run.
_RUN = re.compile(r"\d(?:[ ().\-/+]{0,3}\d){5,}")


def _regions(text: str) -> list[tuple[int, int]]:
    """Stretches of a text around its digit runs, wide enough for prefixes and extensions.

    A run of digits alone that goes on from a small letter, or has less than nine digits with no
    capital, sign or bracket before and no capital or slash behind it, holds no number; nor does
    one inside a web address or after the word for a thing that is counted or numbered.
    """
    out: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        before = text[a - 1 : a]
        words = text[max(0, a - 56) : a].rstrip(" #:=").rsplit(None, 1) if " " not in m[0] else ()
        if words and (words[-1].lower().lstrip("([{\"'") in _THINGS or "://" in words[-1] and not before.isspace()):
            continue
        if m[0].isdigit() and (
            before.islower() or b - a < 9 and not (before.isupper() or before in "-+(" and before) and not text[b : b + 2].strip("-").isupper() and text[b : b + 1] not in ("/", " ")
        ):
            continue
        a, b = max(0, a - 12), b + 24
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _fits(need: str, part: str) -> bool:
    """``A``: a capital; else the text itself."""
    return not need or (any("A" <= c <= "Z" for c in part) if need == "A" else need in part)


def _checked(entry: tuple, found: str) -> float:
    """What the check digit of a candidate adds to its score; formats without one get nothing."""
    _, _, check, gain = entry
    if check is None or check is mod97_key and len(_digits(found)) < 15:
        return 0.0
    text = found if check in (dni, iban) else _digits(found)
    return gain if check(text) else -WRONG_CHECK


def numbers(text: str) -> list[tuple[int, int, str, float]]:
    """Phone and identity number candidates with their scores.

    The pattern gives the base, its check digit and the nearest cue word before the number (or a
    cue behind it) move it. Valid numbers of ambiguous formats need no cue, wrong ones do.
    """
    found = []
    regions = _regions(text)
    ends = _LETTERED.finditer(text)
    lettered = [(max(0, m.start() - 1), m.end() + 1) for m in ends]
    if not regions and not lettered:
        return []
    parts = [text[a:b] for a, b in regions]
    for kind, table, needs in (("phone", _PHONES, _PHONE_NEEDS), ("idnum", _IDS, _ID_NEEDS)):
        for entry, need in zip(table, needs):
            base, pattern = entry[0], entry[1]
            where = lettered if entry is _ALPHANUMERIC else [r for r, p in zip(regions, parts) if _fits(need, p)]
            for m in chain.from_iterable(pattern.finditer(text, a, b) for a, b in where):
                before, after = text[max(0, m.start() - 56) : m.start()], text[m.end() : m.end() + 28]
                before = before[max((r.end() for r in _RUN.finditer(before)), default=0) :]  # cues before another number are its own
                if _NOT_PERSONAL.search(before):
                    continue
                score = base + (_checked(entry, m[0]) if kind == "idnum" else 0.0)
                # the nearer cue decides between a phone and an identity number
                cues = [(max((c.end() for c in w.finditer(before)), default=-1), k) for w, k in ((_PHONE_WORDS, "phone"), (_ID_WORDS, "idnum"))]
                near, which = max(cues)
                if near >= 0:
                    score += CUE if which == kind else -OTHER_CUE
                elif kind == "idnum" and _ID_WORDS.search(after) or kind == "phone" and _PHONE_WORDS.search(after):
                    score += CUE
                found.append((m.start(), m.end(), kind, round(score, 3)))
    return [f for f in found if f[3] >= THRESHOLD]


# Addresses ------------------------------------------------------------------

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
#: Words that start the next sentence and are no part of a street or town: articles, pronouns, prepositions and greetings.
_START = (
    r"(?!(?:The|This|That|These|A|An|Our|Your|One|Each|If|In|To|From|No|At|On|For|With|After|Before|When|Did|Will|We|I|It|He|She|They|Please|Hi|Hello|Dear|Best|Thanks|Contact|According|Reported|Approved"
    r"|Der|Die|Das|Ein|Eine|Nach|Seit|Vor|Bei|Mit|Wir|Ich|Es|Hallo|Bitte|Frau|Herr|Le|La|Les|L['’]\w+|Un|Une|Rien|Après|Avant|Depuis|Nous|Je|Il|Elle|Bonjour|Merci|Mme|El|Los|Las|Una|Nada|Tras|Desde|Hola|Don|N°)\b)"
)


def _address_patterns(towns: frozenset[str]) -> list[re.Pattern]:
    known = "|".join(sorted((re.escape(t) for t in towns if " " in t), key=len, reverse=True))
    town = rf"(?:{'(?i:' + known + ')|' if known else ''}{_START}{_CAP}(?: {_CAP}(?= \d{{4,6}}\b|, [A-Z]{{2}} \d))?)"
    tail = rf"(?:, ?{town}(?:,? (?:[A-Z]{{2}} )?\d{{4,6}}\b)?)?"
    post = rf"(?:, ?\d{{4,6}} (?:{'(?i:' + known + ')|' if known else ''}{_START}{_CAP}))?"
    unit = r"(?:,? ?(?:#\s?\d+\w?\b|(?:Apt|Apartment|Unit|Flat|Suite|Ste|Room)\b\.? ?#?\d*\w?\b))?"
    kinds = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Terrace|Close|Drive|Court|Ct|Crescent|Parkway|Pkwy|Square|Mews|Grove|Gardens|Way)"
    en = rf"(?<![\w.-])\d{{1,5}}[A-Za-z]? (?:(?:St\.|(?:N|S|E|W|North|South|East|West)\.?|(?!(?:{kinds[3:-1]}|The|A|Our|This|After|Nach|Après|Tras)\b){_CAP}) ){{1,4}}?{kinds}\b(?! (?:View|Edition))(?:\.(?=,))?{unit}{tail}"
    de = (
        rf"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm)|[A-ZÄÖÜ][\wäöüß]*(?:-[A-ZÄÖÜ][\wäöüß]*)*-(?:Allee|Straße|Weg|Platz|Ring|Ufer)"
        rf"|(?:Am|Im|An der|An den|Auf dem|Auf der|Zum|Zur|Unter den|In der|Hinter dem)(?: [A-ZÄÖÜ][\wäöüß-]*){{1,3}}) \d{{1,4}}[a-z]?\b{post}"
    )
    ways = r"(?:rue|avenue|av\.|allée|quai|boulevard|bd|place|chemin|impasse|route|cours|square|passage|ruelle|sentier)"
    fr = (
        rf"(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?i:{ways}) (?:(?:de la|de l['’]|du|des|de|d['’]) ?)?{_CAP}(?: {_START}{_CAP}){{0,2}}{post}"
    )
    es = (
        rf"(?<![\w-])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Ronda|Travesía|Carrera) ?(?:(?:de la|de los|de las|del|de) )?{_CAP}(?: (?:(?:de la|del|de|y) )?{_CAP}){{0,3}},? ?(?:n[.º°]+ ?)?\d{{1,4}}\b"
        rf"(?:, ?(?:bajo|ático|entresuelo|\d{{1,2}}\.?[ºª°](?: ?[A-Z](?![\w]))?)(?!\w))?{post}"
    )
    return [re.compile(p) for p in (en, de, fr, es)]


#: Parts of which a text with an address of a country's pattern holds one.
_ADDRESS_PARTS = (
    ("Street", "Avenue", "Road", "Boulevard", "Lane", "Terrace", "Close", "Drive", "Court", "Crescent", "Parkway", "Square", "Mews", "Grove", "Gardens", "Way")
    + (" St", " Ave", " Rd", " Blvd", " Ln", " Ct", " Pkwy"),
    ("straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "gasse ", "ufer ", "damm ", "-Allee", "-Straße", "-Weg", "-Platz", "-Ring", "-Ufer")
    + ("Am ", "Im ", "An de", "Auf de", "Zum ", "Zur ", "Unter den", "In der", "Hinter dem"),
    (" rue ", " avenue ", " av. ", " allée ", " quai ", " boulevard ", " bd ", " place ", " chemin ", " impasse ", " route ", " cours ", " square ", " passage ")
    + (" ruelle ", " sentier "),
    ("Calle", "C/", "Avenida", "Avda", "Av.", "Plaza", "Pza", "Paseo", "Pº", "Camino", "Ronda", "Travesía", "Carrera"),
)
#: What an English address begins with.
_NUMBERED = re.compile(r"\d[A-Za-z]? (?=[A-ZÀ-ÖØ-Þ])")
_POSTCODE = re.compile(r"\b\d{4,6}\b")
_ADDRESS_WORDS = re.compile(
    r"\b(?:at|to|from|address|living|lives|ship|deliver\w*|adresse|anschrift|wohn\w*|aus|livraison|habite|depuis|dirección|entrega|vive|desde)\b[^.\n]{0,16}\Z", re.I
)


def addresses(text: str, patterns: list[re.Pattern]) -> list[tuple[int, int, str, float]]:
    """Addresses with their scores: a street with a number counts most, a postcode, further parts
    and words before it add, the name of a thing behind it takes off."""
    out, low = [], text.lower()
    for i, p in enumerate(patterns):
        parts = _ADDRESS_PARTS[i]
        where = low if i == 2 else text
        if not any(x in where for x in parts) or i == 0 and not _NUMBERED.search(text):
            continue
        for m in p.finditer(text):
            score = 0.55 + 0.2 * bool(_POSTCODE.search(m[0], 6)) + 0.1 * ("," in m[0])
            if _ADDRESS_WORDS.search(text, max(0, m.start() - 40), m.start()):
                score += 0.1
            if text.startswith((" Edition", " View"), m.end()):
                score -= 0.4
            if score >= THRESHOLD:
                out.append((m.start(), m.end(), "address", score))
    return out


# Names ----------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Frau|Herrn?|Hr|Fr|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Don|Doña|Señora?)\.? )"
_ONE = r"(?:[^\W\d_]\.|[^\W\d_]+(?:['’-][^\W\d_]+)*)"
_NAME = rf"(?P<n>{_ONE}(?:, {_ONE}(?: [^\W\d_]\.)?|(?: {_ONE}){{0,3}}?))"
_MAIL = r"[\w.+-]+(?:@|\(at\)| \[at\])"
#: Frames that enclose a name on both sides, each with literals one of which it holds.
_FRAMES = [
    (literals, re.compile(p))
    for literals, p in (
        (("eported by", "emeldet von", "ignalé par", "visado por"), rf"\b(?:[Rr]eported by|[Gg]emeldet von|[Ss]ignalé par|[Aa]visado por) {_TITLE}?{_NAME} \((?={_MAIL})"),
        (('": "', '":"'), rf'"(?:contact|name|author|owner)": ?"{_TITLE}?{_NAME}"'),
        (("name=", "last="), rf"\b(?:name|first\+last)={_NAME} \|"),
        (("ontact:",), rf"\b[Cc]ontact: {_TITLE}?{_NAME} <(?={_MAIL})"),
        (
            ("call", "itte ", "appeler", "lame a "),
            rf"\b(?:[Pp]lease call|[Bb]itte|[Mm]erci d['’]appeler|[Ll]lame a) {_TITLE}?{_NAME} (?:on|at|unter|au|al) (?=[+(\d])",
        ),
        (("Hi ", "Hello ", "Dear ", "Hallo ", "Bonjour ", "Hola "), rf"\b(?:Hi|Hello|Dear|Hallo|Bonjour|Hola) {_TITLE}?(?P<n>{_ONE})[,:!]"),
        (("assignee", "reviewer", "titular", "issued to", "belongs to", "owner", "author"), rf"\b(?:assignee|reviewer|titular|issued to|belongs to|owner|author)[:,]? {_TITLE}?{_NAME}(?=\n|\r|\Z|  |, \d|,? \()"),
        (("Best,", "Regards,", "Thanks,", "again,", "Cheers,", "Grüße,", "Gruß,", "Cordialement,", "Saludos,"), rf"\b(?:Best|Regards|Thanks|Thanks again|Cheers|Grüße|Gruß|Cordialement|Saludos|again),[ \n]{_NAME}(?=\n|\r|\Z|  )"),
        (("pproved by",), rf"\b[Aa]pproved by {_TITLE}{_NAME} and "),
        ((" and ",), rf" and {_TITLE}{_NAME}(?=\n|\r|\Z|  )"),
        ((";",), rf"(?:\A|(?<=\n)){_NAME};(?=[^;\n]*;)"),
    )
]
#: Words before a name that a name may follow; weaker than a frame.
_CUE = re.compile(
    rf"(?:\b(?:[Rr]eported by|[Gg]emeldet von|[Ss]ignalé par|[Aa]visado por|[Aa]ccording to|[Ll]aut|[Ss]elon|[Ss]egún|told by|issued to|belongs to|titular|assignee:|reviewer:|[Cc]ontact:|[Aa]pproved by|call|[Ll]lame a|d['’]appeler"
    rf"|Hi|Hello|Dear|Hallo|Bonjour|Hola|Best,|Regards,|Thanks,|again,|Cheers,|Grüße,?|Grüßen,?|[Ss]aludos?,|Cordialement,|signed(?: by)?|Unterschrift:|author:|owner:|Name:|by|von|par|por|mit|with|and|und|et|y|/)\s|first\+last=|\"|{_TITLE})\Z"
)
_SIGN_OFF = re.compile(r"\b(?:Best|Regards|Thanks|again|Cheers|Grüßen?|[Ss]aludos?|Cordialement|Hi|Hello|Hallo|Bonjour|Hola),?\s\Z")
#: Words after which a single name that is an ordinary word as well is a person's.
_TOLD = re.compile(r"\b(?:told|said|signed|sent|written) by\s\Z")
_TITLE_END = re.compile(rf"(?<!\w){_TITLE}\Z")
#: What may follow a name whose words are all ordinary words as well.
_AFTER_NAME = re.compile(
    r"\s*(?:\Z|[.;:|)(<\"/\n\r]|,(?= ?(?:\d|Am |Im |Calle|Plaza|Avda|[A-ZÄÖÜ][\w-]*(?:straße|weg|-Allee) ))|  | (?:on [+(\d]|unter|au [+(\d]|al [+(\d]|and (?:Mr|Ms|Dr|Mrs)|/))"
)
#: Ordinary words that never start a name.
_NEVER = frozenset(
    "a according after an and approved as best bitte bonjour by call contact der did die el for frau from hallo herr hi hola i if in la le les "
    "merci mr mrs ms name next no of on or our please reported that the this to was we y".split()
)


@dataclass
class Lexicon:
    """Name words by kind, and those of them that are ordinary words as well."""

    given: frozenset[str]
    family: frozenset[str]
    common: frozenset[str] = field(default_factory=frozenset)
    towns: frozenset[str] = field(default_factory=frozenset)

    @cached_property
    def automaton(self):
        """Finds all words of the lexicon in folded text; None where the package is missing."""
        words = {w: w for w in self.given | self.family}
        words |= {w.replace("ss", "ß"): w for w in words if "ss" in w}
        if ahocorasick is None or not words:
            return None
        found = ahocorasick.Automaton()
        for w in words:
            found.add_word(w, len(w))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}


def _split(name: str) -> tuple[list[str], list[str]]:
    """Given-name and family-name words of a framed name; initials are neither."""
    if ", " in name:
        last, _, first = name.partition(", ")
        words = first.split()
        return [w for w in words if not w.endswith(".")], [last]
    words = name.split()
    body = [w for w in words if not w.endswith(".")]
    if len(words) == 1:
        return body, []
    return body[:-1], body[-1:]


def framed(text: str) -> list[tuple[int, int]]:
    """Spans of names enclosed by a frame."""
    out = []
    for literals, p in _FRAMES:
        if not any(x in text for x in literals):
            continue
        for m in p.finditer(text):
            words = m["n"].replace(",", "").split()
            if not words or any(w.casefold().rstrip(".") in _NEVER and len(w.rstrip(".")) > 1 for w in words):
                continue
            capital = sum(w[:1].isupper() or any(c.isupper() for c in w) for w in words)
            if capital == len(words) or (capital == 0 and len(words) >= 2):
                out.append((m.start("n"), m.end("n")))
    return out


_LEARNED = pa.schema([("word", pa.string()), ("kind", pa.string()), ("n", pa.int64())])


def learned_words(documents: DataFrame) -> DataFrame:
    """(word, kind, n): name words inside frames, over all documents."""

    def walk(texts):
        counts: dict[tuple[str, str], int] = {}
        for text in texts:
            for a, b in framed(text) if text else ():
                given, family = _split(text[a:b])
                for kind, words in (("given", given), ("family", family)):
                    for w in words:
                        key = (w.casefold(), kind)
                        counts[key] = counts.get(key, 0) + 1
        return [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]

    rows = documents.select("text").mapInArrow(column_map(walk, _LEARNED), "word string, kind string, n bigint")
    return rows.groupBy("word", "kind").agg(F.sum("n").alias("n"))


def lexicon_words(documents: DataFrame, name_list: DataFrame) -> DataFrame:
    """(word, kind, common): the list's tokens, and words framed twice or more, over all documents."""
    listed = name_list.filter(F.col("token").isNotNull()).select(F.lower(F.trim("token")).alias("word"), F.col("token_kind").alias("kind"))
    learned = staged(learned_words(documents), "name_words")
    words = (
        listed.distinct().withColumn("listed", F.lit(True))
        .join(learned, ["word", "kind"], "full_outer")
        .filter((F.col("listed") | (F.col("n") >= 2)) & (F.col("word") != "") & F.col("kind").isin("given", "family", "town"))
        .fillna({"n": 0})
    )
    words = staged(words, "name_lexicon")
    per = words.groupBy("word").agg(F.sum("n").alias("inside"))
    size = per.count()
    # only uses of name words leave the scan
    known = F.broadcast(per.select("word")) if size <= BROADCAST_WORDS else per.select("word")
    capital = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}+)*)"))
    seen = documents.select(F.explode(capital).alias("w")).select(F.lower("w").alias("word"))
    uses = seen.join(known, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    share = per.join(uses, "word", "left").fillna({"uses": 0})
    common = (F.col("uses") >= 10) & (F.col("inside") < CLEAR_SHARE * F.col("uses"))
    return staged(words.select("word", "kind").join(share.select("word", common.alias("common")), "word"), "name_kinds")


def _as_lexicon(rows) -> Lexicon:
    kinds: dict[str, set[str]] = {"given": set(), "family": set(), "town": set()}
    for word, kind, _ in rows:
        kinds[kind].add(word)
    return Lexicon(*(frozenset(kinds[k]) for k in ("given", "family")), frozenset(w for w, _, c in rows if c), frozenset(kinds["town"]))


def build_lexicon(documents: DataFrame, name_list: DataFrame) -> Lexicon:
    """The lexicon of a corpus, for tables that have at most ``MAX_WORDS`` of name words."""
    return _as_lexicon([tuple(r) for r in lexicon_words(documents, name_list).select("word", "kind", "common").collect()])


def _tokens(text: str, lex: Lexicon) -> list[tuple[int, int, str, bool, bool]]:
    """(start, end, folded word, is an initial, has capitals) of the words near name words.

    Words of the lexicon are found by one automaton; only a few letters around them are cut into
    words, as nothing further away can be a part of their name.
    """
    spans: list[list[int]] = []
    if lex.automaton is None:
        spans = [[0, len(text)]]
    else:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        size = len(low)
        for last, n in lex.automaton.iter(low):
            start, end = last - n + 1, last + 1
            if start and (low[start - 1].isalpha() or low[start - 1] in "'’-" and low[start - 2 : start - 1].isalpha()):
                continue
            if end < size and (low[end].isalpha() or low[end] in "'’-" and low[end + 1 : end + 2].isalpha()):
                continue
            start, end = max(0, start - 8), min(size, end + 8)
            while start and (low[start - 1].isalpha() or low[start - 1] in "'’-"):
                start -= 1
            while end < size and (low[end].isalpha() or low[end] in "'’-."):
                end += 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
    out = []
    for a, b in spans:
        for m in _WORD.finditer(text, a, b):
            word = m[0].casefold()
            initial = len(word) == 1 and m[0].isupper() and text[m.end() : m.end() + 1] == "."
            out.append((m.start(), m.end() + initial, word, initial, m[0].lower() != m[0]))
    return out


def names(text: str, lex: Lexicon, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Name spans outside ``taken``: frames first, then lexicon words in name order."""
    busy = sorted(taken)

    def free(a, b):
        return all(b <= s or a >= e for s, e in busy)

    out = []
    for a, b in framed(text):
        if free(a, b):
            out.append((a, b, "name"))
            busy.append((a, b))
    tokens = _tokens(text, lex)
    i, n = 0, len(tokens)

    def gap(j):
        return text[tokens[j][1] : tokens[j + 1][0]] if j + 1 < n else "\n"

    def is_given(j):
        return j < n and tokens[j][2] in lex.given

    def is_family(j):
        return j < n and tokens[j][2] in lex.family

    def clear(j):
        return tokens[j][2] not in lex.common

    while i < n:
        start, _, word, initial, capital = tokens[i]
        if not (initial or word in lex.given or word in lex.family) or not free(start, tokens[i][1]):
            i += 1
            continue
        best = None
        # family, given [initial]
        if word in lex.family and gap(i) == ", " and i + 1 < n and (is_given(i + 1) or tokens[i + 1][3]):
            end = i + 1
            if gap(end) == " " and end + 1 < n and tokens[end + 1][3]:
                end += 1
            best = (i, end)
        # given or initial, up to one more, family
        if best is None and (initial or word in lex.given):
            j = i
            while j + 1 < n and j < i + 3 and gap(j) == " ":
                k = j + 1
                if is_family(k) and not (is_given(k) and k + 1 < n and gap(k) == " " and is_family(k + 1) and k < i + 2):
                    blocked = not clear(k) and (
                        re.match(r" \d", text[tokens[k][1] : tokens[k][1] + 2])
                        or (
                            k + 1 < n and gap(k) == " " and is_family(k + 1) and not clear(k + 1)
                            and not re.match(r" \d", text[tokens[k + 1][1] : tokens[k + 1][1] + 2])
                        )
                    )
                    if not blocked:
                        best = (i, k)
                    break
                if not (is_given(k) or tokens[k][3]):
                    break
                j = k
        if best is None and word in lex.given and not initial:
            best = (i, i)
        if best is not None:
            a, b = tokens[best[0]][0], tokens[best[1]][1]
            inner = [j for j in range(best[0], best[1] + 1) if not tokens[j][3]]
            cued = bool(_CUE.search(text[max(0, a - 24) : a]))
            capitals = all(tokens[j][4] for j in inner)
            lower = not any(tokens[j][4] for j in inner)
            sure = sum(clear(j) for j in inner)
            if len(inner) == 1 and best[0] == best[1]:
                after = text[b : b + 1]
                left = text[max(0, a - 16) : a]
                follows = re.match(r"[^\w]*[^\W\d_]*", text[b:])[0].lstrip()
                good = capitals and (
                    clear(best[0]) or bool(_TOLD.search(left)) or (bool(_TITLE_END.search(left)) and after != " ") or (bool(_SIGN_OFF.search(left)) and not follows[:1].islower())
                )
            elif capitals:
                good = sure > 0 or cued or bool(_AFTER_NAME.match(text[b : b + 24]))
            elif lower:
                good = sure == len(inner) or (sure > 0 and (cued or bool(_AFTER_NAME.match(text[b : b + 24]))))
            else:
                good = sure == len(inner)
            if good and free(a, b):
                out.append((a, b, "name"))
                busy.append((a, b))
                i = best[1] + 1
                continue
        i += 1
    return out


# All kinds ------------------------------------------------------------------


class Finder:
    """Finds personal items with one lexicon; safe to ship to executors."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.patterns = None

    def __getstate__(self):
        return {"lex": self.lex, "patterns": None}

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, sorted, without overlap."""
        if not text or not text.strip():
            return []
        if self.patterns is None:
            self.patterns = _address_patterns(self.lex.towns)
        chosen: list[tuple[int, int, str]] = []

        def add(cands):
            for c in cands:
                if all(c[1] <= s or c[0] >= e for s, e, _ in chosen):
                    chosen.append(c[:3])

        add(emails(text))
        add(sorted(addresses(text, self.patterns), key=lambda c: (c[0], -c[1])))
        add(_by_score(numbers(text)))
        add(names(text, self.lex, [(s, e) for s, e, _ in chosen]))
        return sorted(chosen)


def _by_score(cands: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Longest first, so that a part of a number doesn't win over the whole; then best score."""
    return sorted(cands, key=lambda c: (-(c[1] - c[0]), -c[3], c[0]))


def _each(documents: DataFrame, name_list: DataFrame, fn, schema: pa.Schema, ddl: str) -> DataFrame:
    """``fn(finder, ids, texts)`` over all documents, each batch with a finder that knows its name words."""
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = lexicon_words(documents, name_list)
    rows = [tuple(r) for r in words.select("word", "kind", "common").limit(MAX_WORDS + 1).collect()]
    if len(rows) <= MAX_WORDS:
        finder = Finder(_as_lexicon(rows))
        return slim.mapInArrow(column_map(lambda ids, texts: fn(finder, ids, texts), schema), ddl)
    # too many for one automaton: every text gets those of the words that stand in it
    towns = [tuple(r) for r in words.filter("kind = 'town'").select("word", "kind", "common").collect()]
    keyed = slim.withColumn("_h", F.xxhash64("text"))
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}+)*)")))
    held = keyed.select("doc_id", "_h", F.explode(own).alias("word")).distinct().join(words.filter("kind <> 'town'"), "word")
    per = held.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_k")).agg(F.collect_set(F.struct("word", "kind", "common")).alias("words"))
    both = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_k")), "left")

    def walk(ids, texts, lists):
        out: list[list] = [[] for _ in schema]
        for doc, text, held in zip(ids, texts, lists):
            finder = Finder(_as_lexicon([tuple(w.values()) for w in held or ()] + towns))
            for column, values in zip(out, fn(finder, [doc], [text])):
                column.extend(values)
        return out

    return both.select("doc_id", "text", "words").mapInArrow(column_map(walk, schema), ddl)


_FOUND = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("pii_kind", pa.string())])


def find(documents: DataFrame, name_list: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, pii_kind) of every item, positions in code points.

    Spans of a text never overlap: emails come first, then addresses, numbers by length and
    score, then names. Null and blank texts have none; texts are read whole. Repeated rows
    are searched each by itself. An empty name list leaves the words learned from frames.
    Empty tables give no rows; other columns are not read.
    """

    def walk(finder, ids, texts):
        out: list[list] = [[], [], [], []]
        for doc, text in zip(ids, texts):
            for row in finder.spans(text):
                for c, v in zip(out, (doc, *row)):
                    c.append(v)
        return out

    return _each(documents, name_list, walk, _FOUND, "doc_id bigint, start_pos int, end_pos int, pii_kind string")


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def replace(documents: DataFrame, name_list: DataFrame) -> DataFrame:
    """(doc_id, text) with typed placeholders in place of every item, all else unchanged."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    walk = lambda finder, ids, texts: [ids, [redacted(t, finder.spans(t)) for t in texts]]
    return _each(documents, name_list, walk, schema, "doc_id bigint, text string")
