"""Personal information inside free text: detection, typed placeholders."""

from __future__ import annotations

import bisect
import heapq
import unicodedata as U
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spans import replaced
from ..session import ship_package, spread
from .langid import one_script
from .lookalike import HIDDEN_OTHER, SHOWN_FORMAT
from .names import LEAST, Tagger, base, loud

TYPES = ("EMAIL", "PHONE", "IDENTITY", "ADDRESS", "NAME")


class Piece(NamedTuple):
    """A piece of a text: code points from start to before end."""

    kind: str
    start: int
    end: int
    text: str


# ---- what a reader sees ----------------------------------------------------------------------------------------------


def visible(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks, in plain characters, and for each of its characters the place in the text that it came from
    (None: the same place). Invisible characters are gone, widths, blanks and accents are of one kind, and words whose
    letters were swapped for those of another script are back in the line's script."""
    if text.isascii():
        return text, None
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if c.isascii():
            out.append(c)
            at.append(i)
            continue
        kind = U.category(c)
        if kind == "Cf" and c not in SHOWN_FORMAT or c in HIDDEN_OTHER or 0xFE00 <= ord(c) <= 0xFE0F:
            continue
        if kind == "Zs":
            c = " "
        elif kind[0] == "M" and out:
            whole = U.normalize("NFC", out[-1] + c)
            if len(whole) == 1:
                out[-1] = whole
                continue
        elif U.decomposition(c).startswith(("<wide>", "<narrow>", "<compat>")):
            for x in U.normalize("NFKC", c):
                out.append(x)
                at.append(i)
            continue
        out.append(c)
        at.append(i)
    seen = "".join(out)
    lines = [one_script(line) for line in seen.split("\n")]
    return "\n".join(lines), at


# ---- patterns ----------------------------------------------------------------------------------------------------------

_PLACEHOLDER = regex.compile(r"\[[A-Z]+(?:_[A-Z]+)*(?:_[0-9a-f]{4,})?\]")
_URL = regex.compile(r"\b(?:https?|ftp|wss?)://[^\s<>\"']+|\bwww\.[^\s<>\"']+", regex.I)
_DATE = regex.compile(r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)")
_IP = regex.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")
_CARD = regex.compile(r"(?<![\d-])(?:[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:[ -]?\d{1,3})?|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-]*\d)")

_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|@|arroba)\s?[\])}]\s?|&#0*64;|&commat;|%40)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.|punkt|punto|point)\s?[\])}]\s?|\s+(?:dot|punkt|punto|point)\s+)"
_LABEL = r"[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+"
_LOCAL = r"[\p{L}\p{N}]++(?:(?!%40)[._%+'’-](?:(?!%40)[._%+'’-])*+[\p{L}\p{N}]++)*+"
_EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+-]){_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}|\s+at\s+{_LABEL}(?:(?:\.|\s+dot\s+){_LABEL})*\s+dot\s+\p{{L}}{{2,}}|\s+at\s+{_LABEL}(?:\.{_LABEL})*\.(?:example|test|invalid|com|org|net|edu|gov))(?![\p{{L}}\p{{N}}])", regex.I)
#: Ends of file names that look like domains (fixed values).
_FILE_ENDS = frozenset("png jpg jpeg gif bmp webp svg pdf txt csv tsv json xml html htm zip gz tar doc docx xls xlsx ppt pptx md py js css log mp3 mp4 wav tif tiff heic dcm".split())

_US = r"(?!000|666|9)\d{3}"
_SSN = regex.compile(rf"(?<![\d.-]|\d )({_US})([-. ])(?!00)(\d{{2}})\2(?!0000)(\d{{4}})(?![-.]?\d)(?! \d)")
_SAYS_ID = regex.compile(r"(?:\bSSNs?\b|\bSS ?#|\bSS no|\bsocial\b|securit|s[ée]cu\b|s[ée]curit|seguridad|seguran|sicurezza|sozialvers|versicherungs|rentenvers|\bDNI\b|\bNIE\b|\bNIF\b|\bNIR\b|identidad|identit|identific|national id|\bID no|\bпаспорт|СНИЛС|\bИНН\b|codice fiscale|personnummer|ssn>)", regex.I)
_OTHER_NUMBER = regex.compile(r"\b(?i:lot|lote|batch|charge|part|tracking|invoice|order|ticket|case|request|ref|dossier|expediente|vorgang|akte|reading|setting|phone|fax)\b\.?(?i: number| no\.?| nr\.?)?\s*[:#]?\s*$")
_NINE = regex.compile(rf"(?<![\p{{L}}\d#.-]){_US}(?!00)\d{{2}}(?!0000)\d{{4}}(?![\p{{L}}\d]|[.-]\d)")
_NIR = regex.compile(r"(?<![\p{L}\d.-])([12])([ .]?)(\d{2})\2(\d{2})\2(\d{2}|2[AB])\2(\d{3})\2(\d{3})(?:[ .]?(\d{2}))?(?![\p{L}\d])", regex.I)
_RVNR = regex.compile(r"(?<![\p{L}\d])(\d{2})[ -]?(\d{2})(\d{2})(\d{2})[ -]?(\p{Lu})[ -]?(\d{3})(?![\p{L}\d])", regex.I)
_DNI = regex.compile(r"(?<![\p{L}\d])(?:\d{2}\.?\d{3}\.?\d{3}|[XYZ][ -]?\d{7})[ -]?[A-Z](?![\p{L}\d])", regex.I)
_OTHER_ID = regex.compile(r"(?<![\p{L}\d])(?:[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]|\d{3}-\d{3}-\d{3}[ -]\d{2}|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\p{L}\d])")

_EXT = r"(?:[ ,]*(?:ext|extension|x|durchwahl|poste|доб)\.? ?\d{1,6})?"
_NOT_IN = r"(?<![\p{L}\d#]|\d[.,/-]|[-_/])"
_PHONES = regex.compile(
    rf"{_NOT_IN}(?:"
    # international, with the country's code
    r"(?:\(?(?:\+|00)[1-9]\d{0,2}\)?)(?:[ .-]?\(0\))?(?:[ ./-]{0,3}\(?\d{1,8}\)?){1,6}"
    # North America
    r"|(?:\+?1[ .-]?)?\([2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]?\d{4}"
    r"|(?:1[ .-])?[2-9]\d{2}[ ./-][2-9]\d{2}[ .-]\d{4}"
    # Germany, with the trunk zero
    r"|\(0[1-9]\d{1,4}\)(?:[ /-]{0,3}\d{2,8}){1,4}|0[1-9]\d{1,4} ?[/-] ?\d{3,8}(?:[ -]\d{1,5}){0,3}"
    # France, in pairs
    r"|0[1-9](?:[ .-]?\d{2}){4}"
    # Spain, nine digits
    r"|[6789]\d{2}[ .-]\d{3}[ .-]\d{3}|[6789]\d{2}[ .-]\d{2}[ .-]\d{2}[ .-]\d{2}|[6789]\d{2}[ .-]\d{6}"
    # Russia
    r"|8[ -]?\(?[3-9]\d{2}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}"
    rf"){_EXT}(?!\d|[-.]\d|/\d)(?! ?%)(?!\p{{L}}\d)", regex.I)
_BARE = regex.compile(rf"{_NOT_IN}1?[2-9]\d{{2}}[2-9]\d{{6}}{_EXT}(?![\p{{L}}\d]|[.,-]\d)", regex.I)
_SAYS_NUMBER = regex.compile(r"(?:\bref\.?|ticket|case|request|dossier|expediente|vorgang|акте|akte|карта|обращение|заявке|petici[oó]n|r[üu]ckfrage|claim|lot|lote|batch|charge|part|tracking|invoice|order|account|card|serial|number|no\.?|nr\.?|n°|№|#|reading|setting|firmware|version|id|mrn)\s*[:#]?\s*$", regex.I)
_SAYS_PHONE = regex.compile(r"phone|tel|fax|call|mobil|m[óo]vil|text me|reach|contact|kontakt|контакт|номер|cell|whatsapp|sms|ruf|appel", regex.I)

_CAP = r"(?:(?:[DdLO]['’]|Mc|Mac|de |del |von |van |da |dos |di )?\p{Lu}[\p{L}\p{M}'’]*\p{L}(?:[-‐]\p{Lu}[\p{L}\p{M}'’]++)*+)"
_WORD = r"\p{Lu}[\p{L}\p{M}'’.-]*+"
_STATE = r"(?:[A-Z]{2} )?\d{5}(?:-\d{4})?"
_TYPES = "Street St Road Rd Avenue Ave Boulevard Blvd Drive Dr Lane Ln Court Ct Way Terrace Ter Place Pl Square Sq Circle Cir Parkway Pkwy Highway Hwy Trail Crescent Close Row Alley Loop".split()
_STREET_TYPE = "(?:" + "|".join([*_TYPES, *map(str.upper, _TYPES)]) + ")"
_TOWN = r"(?!(?:SSN?|DNI|N°)\b)\p{Lu}[\p{L}'’-]++"
_PLACE = rf"(?:(?:(?:San|Santa|Saint|Sankt|St\.|Bad|New|Los|Las|La|El|Le|Port|Fort|Mount|Nizhny|Нижний|Великий) )?{_TOWN}(?:(?: {_TOWN}){{1,2}}(?=, [A-Z]{{2}} \d))?)"
_NO_STREET = r"(?!(?:Akte|Vorgang|Ticket|Fall|Zimmer|Station|Bett|Tag|Uhr|Seite|Raum|Ebene|Platz|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b)"
_ADDRESSES = tuple(map(regex.compile, (
    # number, street, unit, town
    rf"(?<![\p{{L}}\d#/.-]|\d )\d{{1,6}}[a-z]?,? (?:[NSEW]\.? )?(?:(?:\p{{Lu}}[\p{{L}}'’-]*+|\d{{1,3}}(?i:st|nd|rd|th)) ){{1,4}}?{_STREET_TYPE}\b\.?(?:,? ?(?i:Apt|Apartment|Suite|Ste|Unit|Room|Rm|Fl)\.? ?#?[\p{{L}}\d-]++|,? ?#\d+[A-Z]?)?(?:, {_PLACE}(?:, {_STATE})?)?",
    # a compound street name or one with a preposition, house number, town
    rf"(?<![\p{{L}}\d-])(?:(?:\p{{Lu}}[\p{{L}}-]*+ )?(?=\p{{Lu}})(?:\p{{L}}++-)*\p{{L}}*?(?i:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|ring|ufer|damm|chaussee|steig|pfad)|(?i:An der|An den|Am|Zum|Zur|Unter den|Unter der|Auf dem|Auf der|Hinter der|Hinter dem|Vor dem|Vor der|Im|In der|Bei der|Beim) (?:\p{{Ll}}+e[nrm] |\p{{Lu}}+E[NRM] )?{_NO_STREET}\p{{Lu}}[\p{{L}}-]++)(?:,? (?i:Nr)\.)? ?\d{{1,4}}(?!\d)(?: ?[a-zA-Z]\b)?(?:, (?:\d{{5}} )?{_PLACE})?",
    # number, kind of street, name, town
    rf"(?<![\p{{L}}\d#/.-])\d{{1,4}}(?: ?(?i:bis|ter|quater))?,? (?i:rue|avenue|av\.|bd|boulevard|all[ée]e|chemin|place|impasse|quai|cours|route|square|passage|villa|sentier) (?:(?i:de la|de l['’]|des|du|de|d['’]|la|le|les) ?)?{_WORD}(?:[ -](?:(?i:de|du|la|le|des) )?{_WORD}){{0,2}}?(?:, (?:\d{{5}} )?{_PLACE})?",
    # kind of street, name, number, town
    rf"(?<![\p{{L}}\d])(?i:Calle|C/|Avda\.?|Avenida|Camino|Paseo|P\.º|Plaza|Pza\.?|Ronda|Traves[íi]a|Carretera|Ctra\.?|Glorieta|Via|Viale|Piazza|Corso|Vicolo|Largo|Rua|Travessa|Pra[çc]a|Alameda|Estrada|Carrer) (?:(?i:de la|de los|de las|del|de|della|dei|delle|di|da|do|dos|das|d['’]) ?)*{_WORD}(?: (?:(?i:de|del|la|los|las|da|do) )?{_WORD}){{0,3}},? ?(?i:n\.? ?[º°o]\.? ?|num\.? ?|núm\.? ?)?\d{{1,4}}(?: ?[a-z]\b)?(?:, (?:\d{{4,5}}(?:-\d{{3}})? )?{_PLACE})?",
    rf"(?<![\p{{L}}])(?i:ул\.|улица|пер\.|переулок|пр\.|пр-т|просп\.|проспект|пл\.|площадь|ш\.|шоссе|наб\.|набережная|бул\.|бульвар)\s+{_WORD}(?: {_WORD}){{0,3}}(?:,? (?i:д\.|дом)? ?\d{{1,4}}\p{{L}}?)?(?:, (?i:корп\.|к\.|стр\.) ?\d+)?(?:, (?i:кв\.|оф\.) ?\d+)?(?:, (?:(?i:г\.|город) ?)?{_PLACE})?(?:, \d{{6}})?",
)))
#: What a text must have in it, in small letters, for each of the patterns (fixed values; nothing: any text).
_ADDRESS_SIGNS = (
    (),
    ("straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "ring", "ufer", "damm", "chaussee", "steig", "pfad", "an der", "an den", "am ", "zum ", "zur ", "unter d", "auf d", "hinter d", "vor d", "im ", "in der", "bei der", "beim "),
    (),
    ("calle ", "c/ ", "avda", "avenida", "camino", "paseo", "p.º", "plaza", "pza", "ronda", "traves", "carretera", "ctra", "glorieta", "via ", "viale", "piazza", "corso", "vicolo", "largo", "rua ", "praça", "praca", "alameda", "estrada", "carrer "),
    ("ул", "пер", "пр", "пл", "ш", "наб", "бул"),
)
#: Titles and words that a person's name follows (fixed values), with what may stand between.
_TITLES = r"Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Professor|Doctor|Nurse|Sister Superior|Patient|Patientin|Herr|Herrn|Frau|Fr|Hr|Mme|Mlle|Madame|Monsieur|docteur|docteure|doctor|doctora|dottor|dottoressa|paciente|paziente|patiente|Sra|Srta|Sr|Se[ñn]ora?|Sig|Signora?|Пациент|Пациентка|Доктор|Врач|г-н|г-жа|Госпожа|Господин|Медсестра|Pflegerin|Schwester|Infirmi[èe]re|Enfermer[oa]"
_LEADS = r"caller,|Signed,|Sincerely,|Regards,|attn\.?:?|attention:?|fwd by|forwarded by|Ask for|spoke with|later with|talked to|Contacto? ?:|contact ?:|Kontakt ?:|Kontaktperson:?|Контакт:|Kin ?:|Next of kin:|Angeh[öo]rige ?:|Angeh[öo]riger:|Familiar:|Famille ?:|Родственник:|Родственница:|name ?[=:]|<name>|Name:|Nom ?:|Nombre:|Имя:|ФИО:|Gez\.|Sign[ée] ?:?|Firmado:?|Подпись:|cc:|From:|To:|--"
_INITIAL = r"\p{Lu}\."
_FULL = rf"(?:{_CAP}, {_CAP}(?: {_INITIAL})?|(?:{_INITIAL} ?){{1,3}}{_CAP}|{_CAP}(?: {_INITIAL}){{1,2}} {_CAP}|{_CAP} {_CAP}|{_CAP})"
#: A stray mark before a name.
_NOISE = r"(?:[!?*¡¿]|\(\d\)|\.\.\.[ \t])?"
_TITLED = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?i:(?:{_TITLES})\b\.?(?:[ \t]+(?:{_TITLES})\b\.?){{0,3}})[ \t]+{_NOISE}(?P<name>{_FULL})")
_LED = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?i:{_LEADS})[ \t]*(?:(?i:(?:{_TITLES})\b\.?)[ \t]+)?{_NOISE}(?P<name>{_FULL})")
_NAME_ENDS = regex.compile(r"[ \t]*(?:[<(,;\n]|$)")
_INVERTED = regex.compile(rf"(?<![\p{{L}}\p{{N}}'’-])(?P<last>{_CAP}), (?P<first>{_CAP})(?: {_INITIAL})?")
_PAIR = regex.compile(rf"(?<![\p{{L}}\p{{N}}'’-])(?P<first>{_CAP})(?: {_INITIAL}){{0,2}} (?P<last>{_CAP})")
_DOTTED = regex.compile(rf"(?<![\p{{L}}\p{{N}}'’.-])(?:{_INITIAL} ?){{1,3}}(?P<last>{_CAP})")
#: Words in capitals at the start of a sentence that are no given names, and second words that make a place or thing (fixed values).
_NO_FIRST = frozenset("the a an st saint please ticket dossier vorgang expediente chart note re reading claim part lot pump invoice files take use may will job firmware height vitals dose tracking workstation summarise results home phone address card old new upper lower lake mount north south east west harbor le la les el los las der die das und et y".split())
_NO_LAST = frozenset("wing clinic hospital ward hall street road lane avenue drive court way house room unit center centre street sign score test stain index scale disease syndrome bank park bridge station tower foundation university college school institute street klinik krankenhaus bengal".split())
#: Words in other use that occur as a title's next word (fixed values).
_NOT_NAMES = frozenset("ssn ss sécu dni nurse prof dr mr mrs ms frau herr mme the a i we it this that in on at for and or no not is was has have please phone fax name contact card claim portal id".split())


def _nir_key(digits: str) -> bool:
    return len(digits) == 15 and digits.isdigit() and 97 - int(digits[:13]) % 97 == int(digits[13:])


#: One of these is in every text, in small letters, in which the pattern beside can match (fixed values).
_AT_SIGNS = ("@", "%40", "64;", "commat", "(at", "[at", "{at", "( at", "[ at", "{ at", "arroba")
_SPELLED = ("dot", ".example", ".test", ".invalid", ".com", ".org", ".net", ".edu", ".gov")
_ID_SIGNS = ("ssn", "ss#", "ss #", "ss no", "social", "securit", "sécu", "secu", "seguridad", "seguran", "sicurezza", "sozialvers", "versicherungs", "rentenvers", "dni", "nie", "nif", "nir", "identi", "id no", "national id", "паспорт", "снилс", "инн", "codice", "personnummer")


_SENTENCE_ENDS = regex.compile(r"[.!?;]\s+(?=\p{Lu})|\n")


def _lead(seen: str, a: int) -> str:
    """The last three words before a place, with what stands between, however long they are."""
    i = a
    for _ in range(3):
        while i > 0 and not seen[i - 1].isalnum():
            i -= 1
        while i > 0 and seen[i - 1].isalnum():
            i -= 1
    return seen[i:a]


class Said:
    """Where a text says that an identity number follows, and where its sentences end; each found once."""

    def __init__(self, seen: str):
        self.seen = seen
        self.says = [m.end() for m in _SAYS_ID.finditer(seen)]
        self.ends = [m.start() for m in _SENTENCE_ENDS.finditer(seen)] if self.says else []

    def before(self, a: int) -> bool:
        """Whether the same sentence says so before a place, and no other number is named right before it."""
        i = bisect.bisect_right(self.says, a) - 1
        if i < 0:
            return False
        j = bisect.bisect_left(self.ends, self.says[i])
        if j < len(self.ends) and self.ends[j] < a:
            return False
        lead = _lead(self.seen, a)
        return not _OTHER_NUMBER.search(lead[max(0, len(lead) - (a - self.says[i])) :])


def find(seen: str, given: frozenset[str], tagger: Tagger | None = None) -> list[Piece]:
    """The pieces of a visible text, in order, none overlapping. given: given names in lower case. Names that neither a title nor a
    known given name marks are the tagger's (None: names.base)."""
    out: list[Piece] = []
    taken: list[tuple[int, int]] = []  # in order, none overlapping

    def claim(kind: str | None, a: int, b: int) -> bool:
        if not free(a, b):
            return False
        bisect.insort(taken, (a, b))
        if kind:
            out.append(Piece(kind, a, b, seen[a:b]))
        return True

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (a, b))
        return not (i < len(taken) and taken[i][0] < b or i > 0 and taken[i - 1][1] > a)

    def end_of_taken(a: int, b: int) -> int:
        """Where the first claimed span ends that a refused one overlaps."""
        i = bisect.bisect_left(taken, (a, b))
        return taken[i - 1][1] if i > 0 and taken[i - 1][1] > a else taken[i][1]

    if "[" in seen:
        for m in _PLACEHOLDER.finditer(seen):
            claim(None, *m.span())
    low = seen.lower()
    has = lambda words: any(w in low for w in words)
    if has(_AT_SIGNS) or "at" in low and has(_SPELLED):
        for m in _EMAIL.finditer(seen):
            if m[0].rsplit(".", 1)[-1].lower() not in _FILE_ENDS:
                claim("EMAIL", *m.span())
    if "://" in seen or "www." in low:
        for m in _URL.finditer(seen):
            claim(None, *m.span())
    digits = sum(map(str.isdigit, seen))
    if digits > 3:
        for rx in (_CARD, _IP, _DATE) if digits > 12 else (_IP, _DATE):
            for m in rx.finditer(seen):
                claim(None, *m.span())
    if digits > 5:  # the least of any pattern here
        said = Said(seen) if has(_ID_SIGNS) else None
        says = said is not None and bool(said.says)
        near = lambda a: says and said.before(a)
        for m in _NIR.finditer(seen):
            n = regex.sub(r"\D", "", m[0])
            if 1 <= int(m[4]) <= 12 and (near(m.start()) or _nir_key(n)) or near(m.start()) and len(n) in (13, 15):
                claim("IDENTITY", *m.span())
        for m in _SSN.finditer(seen):
            claim("IDENTITY", *m.span())
        for m in _RVNR.finditer(seen):
            if near(m.start()) or 1 <= int(m[2]) <= 31 and 1 <= int(m[3]) <= 12 and m[5].isupper():
                claim("IDENTITY", *m.span())
        for rx in (_DNI, _OTHER_ID) if says else (_DNI,):
            for m in rx.finditer(seen):
                body = regex.sub(r"[^0-9A-Z]", "", m[0].upper())
                if near(m.start()) or rx is _DNI and body[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(body[:-1]) % 23] == body[-1]:
                    claim("IDENTITY", *m.span())
        if says:
            for m in _NINE.finditer(seen):
                if near(m.start()):
                    claim("IDENTITY", *m.span())
    # The next hit of each pattern, first in the text first; the last pattern needs no number.
    hits: list[tuple[int, int, int]] = []

    def search(i: int, at: int) -> None:
        if m := _ADDRESSES[i].search(seen, at):
            heapq.heappush(hits, (m.start(), i, m.end()))

    for i, signs in enumerate(_ADDRESS_SIGNS):
        if (digits or i == len(_ADDRESSES) - 1) and (not signs or has(signs)):
            search(i, 0)
    while hits:
        a, i, b = heapq.heappop(hits)
        search(i, b if claim("ADDRESS", a, b) else end_of_taken(a, b))
    if digits > 8:
        for m in _PHONES.finditer(seen):
            n = sum(c.isdigit() for c in regex.split(r"(?i)[ ,]*(?:ext|x|poste|доб)", m[0])[0])
            if 9 <= n <= 16 and not _SAYS_NUMBER.search(_lead(seen, m.start())):
                claim("PHONE", *m.span())
        for m in _BARE.finditer(seen):
            lead = _lead(seen, m.start())
            if not _SAYS_NUMBER.search(lead) or _SAYS_PHONE.search(lead):
                claim("PHONE", *m.span())
    _names(seen, given, tagger or base(), claim, free)
    return sorted(out, key=lambda p: p.start)


def candidates(seen: str) -> list[tuple[int, int]]:
    """The places of what looks like a name of two words or of an initial and a word; they may overlap."""
    out = []
    for m in _PAIR.finditer(seen, overlapped=True):
        if m["last"].lower() not in _NO_LAST | _NOT_NAMES and m["first"].lower() not in _NO_FIRST | _NOT_NAMES and not (m["last"].isupper() and len(m["last"]) < 4 and (not m["first"].isupper() or len(m["last"]) < 3)):
            out.append(m.span())  # RX, HD and the like are codes
    for m in _INVERTED.finditer(seen, overlapped=True):
        if m["last"].lower() not in _NO_FIRST and m["first"].lower() not in _NO_LAST:
            out.append(m.span())
    for m in _DOTTED.finditer(seen, overlapped=True):
        if m["last"].lower() not in _NO_LAST:
            out.append(m.span())
    return out


def _names(seen: str, given: frozenset[str], tagger: Tagger, claim, free) -> None:
    known = lambda w: w.lower() in given

    def shorter(name: str, titled: bool) -> str:
        """A name without a next sentence's first word: of a title's two words in a text in capitals the second stays only after a known given name."""
        parts = name.split(" ")
        if len(parts) == 2 and "," not in name and not parts[0].endswith("."):
            first, last = parts
            if last.lower().strip(".,") in _NOT_NAMES or titled and name.isupper() and seen.isupper() and not known(first):
                return first if first.lower() not in _NOT_NAMES else ""
        return name

    def led(rx: regex.Pattern) -> None:
        for m in rx.finditer(seen, overlapped=True):
            name = shorter(m["name"], rx is _TITLED)
            first = regex.split(r"[ ,]", name)[0].lower()
            if not name or first in _NOT_NAMES or first in _NO_FIRST and not known(first):
                continue
            if len(name) == 1 or any(w.lower() in _NO_LAST for w in name.split(" ")[1:]):
                continue
            claim("NAME", m.start("name"), m.start("name") + len(name))

    led(_LED)
    led(_TITLED)
    for m in _INVERTED.finditer(seen, overlapped=True):
        words = m[0].isupper() and m["first"].lower() in _ALSO_WORDS
        if known(m["first"]) and not words and m["last"].lower() not in _NO_FIRST and not known(m["last"]):
            claim("NAME", *m.span())
    for m in _PAIR.finditer(seen, overlapped=True):
        first, last = m["first"].lower(), m["last"].lower()
        up = m[0].isupper()
        if last in _NO_LAST or first in _NO_FIRST and (up or not known(first)) or not known(first):
            continue
        # In capitals, a given name that is a word as well isn't a name by itself.
        if not (up and first in _ALSO_WORDS and (seen.isupper() or tagger.sure(seen, *m.span()) < LEAST)):
            claim("NAME", *m.span())
    for m in _DOTTED.finditer(seen, overlapped=True):
        if m["last"].lower() not in _NO_LAST and _NAME_ENDS.match(seen, m.end()):
            claim("NAME", *m.span())
    # Of candidates that begin or end alike the longest stays, of others that overlap the surest. In a text in capitals a word's capital says nothing.
    open_ = [(tagger.sure(seen, a, b), a, b) for a, b in candidates(seen) if free(a, b) and not loud(seen, a, b)]
    likely = [x for x in open_ if x[0] >= LEAST]
    widest = {a: max(b for _, x, b in likely if x == a) for _, a, _ in likely}
    ends = {b: min(a for _, a, x in likely if x == b) for _, _, b in likely}
    for _, a, b in sorted(likely, key=lambda x: (-x[0], x[1])):
        if widest[a] == b and ends[b] == a:  # an initial and surname inside a longer name are part of it
            claim("NAME", a, b)


#: Given names that are words of a language of the texts as well (fixed values).
_ALSO_WORDS = frozenset("may will mark rose sol".split())


# ---- operators -----------------------------------------------------------------------------------------------------------


def pieces(text: str | None, given: frozenset[str], tagger: Tagger | None = None) -> list[Piece]:
    """The pieces of a text, with places in the text itself."""
    if not text:
        return []
    seen, at = visible(text)
    found = find(seen, given, tagger)
    if at is None:
        return found
    return [Piece(p.kind, at[p.start], at[p.end - 1] + 1, text[at[p.start] : at[p.end - 1] + 1]) for p in found]


#: The table of given names is a list made by hand; it comes to the driver, and more rows than this are an error.
MOST_NAMES = 200_000


def given_names(names: DataFrame) -> frozenset[str]:
    rows = names.select("given_name").where(F.col("given_name").isNotNull()).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return frozenset(U.normalize("NFC", r[0].strip()).lower() for r in rows)


PIECES = "array<struct<pii_type:string,nth:int,start:int,end:int,piece:string>>"
_ARROW = pa.list_(pa.struct([("pii_type", pa.string()), ("nth", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())]))


def piece_column(df: DataFrame, text: Column, given: frozenset[str], tagger: Tagger | None = None) -> Column:
    """The pieces of a text in order; none, never null, for null, empty and blank texts. start and end count code points from 0, nth counts from 1 within a type."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                n: dict[str, int] = {}
                row = []
                for p in pieces(t, given, tagger):
                    n[p.kind] = n.get(p.kind, 0) + 1
                    row.append({"pii_type": p.kind, "nth": n[p.kind], "start": p.start, "end": p.end, "piece": p.text})
                rows.append(row)
            yield pa.array(rows, _ARROW)

    # Named nondeterministic so that no filter on its result is pushed below it and evaluates it again.
    return F.arrow_udf(run, PIECES).asNondeterministic()(text.cast("string"))


def detect(df: DataFrame, text: str, given: frozenset[str], out: str = "pieces", tagger: Tagger | None = None) -> DataFrame:
    """`df` with the column `out` of each text's pieces. Row by row over whole texts, without a shuffle."""
    df = spread(df)
    return df.withColumn(out, piece_column(df, F.col(f"`{text}`"), given, tagger))


def with_placeholders(text: Column, found: Column, label=lambda p: p["pii_type"]) -> Column:
    """The text with `[TYPE]` for each piece and otherwise unchanged; null stays null. Built-in expressions only, in time that grows with the text."""
    return F.when(F.size(found) > 0, replaced(text, found, "start", "end", lambda p: F.concat(F.lit("["), label(p), F.lit("]")))).otherwise(text)
