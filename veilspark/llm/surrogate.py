"""Keyed surrogates for personal information: the same person, number or address is replaced alike, different ones differently."""

from __future__ import annotations

import functools
import hashlib
import hmac
import sys
import unicodedata as U
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import rows_of
from ..operators.skew import salted_left_join
from ..operators.spans import replaced
from ..session import cut, discard, ship_package, spread
from .names import Tagger, fit
from .pii import _TYPES, given_names, pieces, visible

#: Rounds of collision checks, which end when nothing collides. Mails, addresses and names get more surrogates with each attempt or every third;
#: numbers keep their length, so where these are used up there is no distinct surrogate, and more rounds than this are an error.
ROUNDS = 64
_SYLLABLES = {
    "Latin": ["ba be bi bo bra dra da de do fe fi fa ga gre go ka ke kri la le li lo ma me mi mo na ne ni no pa pe pri ra re ro sa se ta te ti to tra va ve vi vo za".split(), {"f": ["lia", "rina", "sa", "mira"], "m": ["lan", "rto", "mas", "vin"], "": ["rel", "nis", "len", "dor"], "s": ["berg", "mann", "ley", "worth", "stedt", "ard", "ino", "ez"]}],
    "Cyrillic": ["ба бе бо бра да де до жа за ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ро са се со та те то ва ве ви во".split(), {"f": ["лина", "мира", "са"], "m": ["лан", "мир", "тон"], "": ["рель", "нис"], "s": ["енко", "ских", "ых", "чук"]}],
}
_KEEP = frozenset(w.lower() for w in _TYPES) | frozenset("apt apartment suite ste unit room rm fl n s e w nr bis ter quater rue avenue av bd boulevard allée chemin place impasse quai cours route square passage de la le les l des du d del los las calle c avda avenida camino paseo plaza pza ronda der dem den am an zum zur unter auf in straße strasse str weg allee platz gasse ring ufer damm ул улица пер переулок пр проспект д кв г пл площадь ш шоссе наб dot at".split())


def _bytes(key: bytes, *parts: object) -> Iterator[int]:
    """An endless stream of keyed bytes."""
    n = 0
    while True:
        yield from hmac.new(key, "\x1f".join(map(str, (*parts, n))).encode(), hashlib.sha256).digest()
        n += 1


def _script(word: str) -> str:
    """Latin or Cyrillic, which have syllables, or for other scripts their name in the character database."""
    if regex.search(r"\p{Cyrillic}", word):
        return "Cyrillic"
    names = [U.name(c, "").split(" ")[0] for c in word if c.isalpha()]
    return "Latin" if not names or "LATIN" in names else names[0]


@functools.lru_cache(256)
def _alphabet(script: str) -> list[str]:
    """Small letters, or those without case, of a script: letters whose plain form they are."""
    return [c for c in map(chr, range(0x80, 0x30000)) if U.category(c) in ("Ll", "Lo") and U.name(c, "").split(" ")[0] == script and "LETTER" in U.name(c) + ("LETTER" if script == "CJK" else "") and U.normalize("NFKD", c) == c and c.casefold() == c]


def _like(new: str, old: str) -> str:
    """In the case of the old word."""
    if len(old) > 1 and old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def _word(stream: Iterator[int], script: str, role: str, syllables: int) -> str:
    if script not in _SYLLABLES:
        letters = _alphabet(script) or _alphabet("GREEK")
        return "".join(letters[(next(stream) * 65536 + next(stream) * 256 + next(stream)) % len(letters)] for _ in range(syllables if len(letters) > 1000 else 2 * syllables))
    parts, ends = _SYLLABLES[script]
    return "".join(parts[(next(stream) * 256 + next(stream)) % len(parts)] for _ in range(syllables)) + ends[role][next(stream) % len(ends[role])]


def gender(name: str) -> str:
    """What the ending of a given name suggests: f, m or nothing."""
    low = name.lower()
    if low.endswith(("a", "ia", "ine", "ette", "elle", "а", "я", "ène", "ude", "ence")):
        return "f"
    return "m" if low.endswith(("o", "n", "d", "r", "s", "us", "ert", "й", "н", "р", "м")) else ""


def _parts(name: str, given: frozenset[str]) -> list[tuple[str, str]]:
    """(role, token) of a name's tokens in order: g given name, i initial, s surname."""
    tokens = regex.findall(r"\p{L}[\p{L}\p{M}'’]*\.?|\p{L}", name)
    words = [t for t in tokens if not t.endswith(".") and len(t) > 1]
    comma = "," in name
    out = []
    for t in tokens:
        if t.endswith(".") or len(t) == 1:
            out.append(("i", t))
        elif len(words) > 1 and (t == words[-1] if comma else t == words[0]) or t.lower() in given and len(words) > 1 and not comma:
            out.append(("g", t))
        else:
            out.append(("s", t))
    return out


def units(kind: str, piece: str, given: frozenset[str]) -> list[str]:
    """The keys whose surrogates make the piece's: a name's tokens, one key else. Spelling, case, accents, widths and separators make no difference."""
    seen = visible(piece)[0]
    fold = lambda s: "".join(c for c in U.normalize("NFD", s.casefold()) if not U.combining(c))
    if kind == "NAME":
        return [f"NAME:{role}:{fold(t)}" for role, t in _parts(seen, given) if role != "i"]
    if kind == "EMAIL":
        flat = regex.sub(r"(?i)\s?[\[({]?\s?(?:@|&#0*64;|&commat;|%40|\bat\b|arroba)\s?[\])}]?\s?", "@", seen, count=1)
        return ["EMAIL:" + fold(regex.sub(r"(?i)\s?[\[({]?\s?\b(?:dot|punkt|punto|point)\b\s?[\])}]?\s?", ".", flat)).replace(" ", "")]
    if kind == "PHONE":
        number = regex.split(r"(?i)[ ,]*(?:ext|x|poste|доб)", seen)[0].replace("(0)", "").strip()
        digits = regex.sub(r"\D", "", number)
        if regex.match(r"\(?(?:\+|00)", number):
            return ["PHONE:+" + digits.lstrip("0")]
        # North America's numbers are the same with and without their country's code; others' national forms stand for themselves.
        plain_ = regex.fullmatch(r"1?([2-9]\d\d[2-9]\d{6})", digits)
        return ["PHONE:+1" + plain_[1] if plain_ else "PHONE:" + digits]
    return [f"{kind}:" + regex.sub(r"[^\p{L}\p{N}]", "", fold(seen))]


@functools.lru_cache(64)
def _initials(key: bytes, kind: str, script: str) -> dict[str, str]:
    """Each letter without accents of a category and script, to the next in a keyed order: different initials stay different, and none stays as it is."""
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if U.category(c) == kind and U.normalize("NFD", c) == c and U.name(c, "").split(" ")[0] == script]
    ring = sorted(letters, key=lambda c: hmac.new(key, f"initial\x1f{c}".encode(), hashlib.sha256).digest())
    return dict(zip(ring, ring[1:] + ring[:1]))


@functools.lru_cache(4096)
def _initial(letter: str, key: bytes) -> str:
    up = letter.upper()
    c = U.normalize("NFD", up if len(up) == 1 else letter)[0]
    names = U.name(c, "").split(" ")
    if names[0] in ("LATIN", "CYRILLIC"):
        common = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if names[0] == "LATIN" else "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"
        ring = sorted(common, key=lambda x: hmac.new(key, f"initial\x1f{x}".encode(), hashlib.sha256).digest())
        if c in common:
            return ring[(ring.index(c) + 1) % len(ring)]
        rest = _initials(key, U.category(c), names[0])
        new = rest.get(c, c)
        while new.upper() in common:  # the common letters are taken among themselves
            new = rest[new]
        return new
    return _initials(key, U.category(c), names[0]).get(c, c)


def growth(units_: int) -> int:
    """By how many syllables words get longer, so that their number stays far above that of the units: one for each 48 times 10,000."""
    n = 0
    while units_ > 10_000 * 48**n:
        n += 1
    return n


def core(unit: str, key: bytes, attempt: int, grow: int = 0) -> str:
    """What a unit's surrogate is made of: a name's token in small letters, a seed else. attempt 0 unless the surrogate collides."""
    kind, _, rest = unit.partition(":")
    s = _bytes(key, unit, attempt)
    if kind == "NAME":
        role, _, token = rest.partition(":")
        return _word(s, _script(token), gender(token) if role == "g" else "s", 3 + grow + attempt // 3)
    return "".join(f"{next(s):02x}" for _ in range(8))


def replace(kind: str, piece: str, given: frozenset[str], key: bytes, attempts: dict[str, int], grow: int = 0) -> str:
    """The surrogate of a piece, in its script, case and format. Numbers of persons begin with 9, which none issued does; addresses of mail end in example and a public ending."""
    seen = visible(piece)[0]
    if kind == "NAME":
        at, out = 0, []
        roles = iter(_parts(seen, given))
        for m in regex.finditer(r"\p{L}[\p{L}\p{M}'’]*\.?|\p{L}", seen):
            role, token = next(roles)
            out.append(seen[at : m.start()])
            if role == "i":
                new = _initial(token[0], key) + ("." if token.endswith(".") else "")
            else:
                unit = units("NAME", seen, given)
                mine = [u for u in unit if u.split(":", 2)[1] == role and u.endswith(":" + "".join(c for c in U.normalize("NFD", token.casefold()) if not U.combining(c)))][0]
                new = _like(core(mine, key, attempts.get(mine, 0), grow), token)
            out.append(new)
            at = m.end()
        return "".join(out) + seen[at:]
    unit = units(kind, piece, given)[0]
    attempt = attempts.get(unit, 0)
    s = _bytes(key, core(unit, key, attempt))
    if kind == "EMAIL":
        m = regex.match(r"(?is)(.*?)(\s?[\[({]?\s?(?:@|&#0*64;|&commat;|%40|(?<=\s|[(\[{])at(?=\s|[)\]}]))\s?[\])}]?\s?)(.*)", seen)
        local, sep, domain = m.groups() if m else (seen, "@", "")
        dot = " dot " if regex.search(r"(?i)\sdot\s", domain) else "."
        new = "".join(_like(_word(s, "Latin", "", 3 + grow + attempt), x) if x.isalpha() else "".join(str(next(s) % 10) if c.isdigit() else c for c in x) for x in regex.findall(r"\p{L}+|\P{L}+", local))
        more = _word(s, "Latin", "", attempt // 3) + dot if attempt > 2 else ""  # names of digits alone have few
        return new + sep + more + "example" + dot + ("com", "net", "org")[next(s) % 3]
    if kind in ("PHONE", "IDENTITY"):
        out, first = [], True
        lead = regex.match(r"\(?(?:\+|00)\d{1,3}\)?|1[ .-]|\(?0", seen) if kind == "PHONE" else None
        for i, c in enumerate(seen):
            if lead and i < lead.end():
                out.append(c)
            elif c.isdigit():
                n = next(s) % 10
                out.append("9" if first and kind == "IDENTITY" else str(n or 1) if first else str(n))
                first = False
            elif c.isalpha() and kind == "IDENTITY":
                out.append("ABCDEFGHJKLMNPRSTVWXYZ"[next(s) % 22])
            else:
                out.append(c)
        return "".join(out)
    word = lambda m: m[0] if m[0].lower().strip(".") in _KEEP or len(m[0]) == 1 else _like(_word(s, _script(m[0]), "s", 2 + grow + attempt // 3), m[0])
    new = regex.sub(r"\p{L}+|\d", lambda m: str(next(s) % 9 + 1) if m[0].isdigit() else word(m), seen)
    more = "".join(str(next(s) % 9 + 1) for _ in range(attempt // 3))  # streets of one letter have few
    return regex.sub(r"\d", lambda m: m[0] + more, new, count=1) if regex.search(r"\d", new) else new + " " * bool(more) + more


def written(unit: str, form: str, given: frozenset[str], key: bytes, attempt: int, grow: int = 0) -> str:
    """By which distinctness is checked: what is written for a unit in one of its forms, folded as units are (see plain)."""
    kind = unit.partition(":")[0]
    if kind == "NAME":
        return "NAME:" + core(unit, key, attempt, grow).casefold()
    return units(kind, replace(kind, form, given, key, {unit: attempt}, grow), given)[0]


def plain(unit: Column) -> Column:
    """A unit as surrogates are compared with it: of names the token in any role."""
    return F.regexp_replace(unit, "^NAME:[a-z]:", "NAME:")


_FOUND = "array<struct<pii_type:string,nth:int,start:int,end:int,piece:string,units:array<string>>>"
_FOUND_ARROW = pa.list_(pa.struct([("pii_type", pa.string()), ("nth", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string()), ("units", pa.list_(pa.string()))]))


def _mentions(text: Column, given: frozenset[str], tagger: Tagger) -> Column:
    """The pieces of a text with the units that they are made of."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = []
            for t in b.to_pylist():
                n: dict[str, int] = {}
                row = []
                for p in pieces(t, given, tagger):
                    n[p.kind] = n.get(p.kind, 0) + 1
                    row.append({"pii_type": p.kind, "nth": n[p.kind], "start": p.start, "end": p.end, "piece": p.text, "units": units(p.kind, p.text, given)})
                rows.append(row)
            yield pa.array(rows, _FOUND_ARROW)

    # Named nondeterministic so that no use of its result evaluates it again.
    return F.arrow_udf(run, _FOUND).asNondeterministic()(text.cast("string"))


def _attempts(forms: DataFrame, given: frozenset[str], key: bytes, grow: int = 0) -> DataFrame:
    """unit, attempt of the units whose first surrogate, as it is written in any of the unit's forms, is that of another unit or is itself a unit of the texts. Others have attempt 0."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for us, fs, ats in batches:
            yield pa.array([written(u, f, given, key, a, grow) for u, f, a in zip(us.to_pylist(), fs.to_pylist(), ats.to_pylist())], pa.string())

    made = F.arrow_udf(run, "string").asNondeterministic()
    tried = lambda df: df.withColumn("s", made("unit", "form", "attempt"))
    real = forms.select(plain(F.col("unit")).alias("s"), F.lit(True).alias("real")).distinct()
    state = cut(tried(forms.select("unit", "form", F.lit(0).alias("attempt"))))
    for _ in range(ROUNDS):
        owners = state.groupBy("s").agg(F.min(F.struct("attempt", "unit")).alias("o"), F.min("unit").alias("least"), F.max("unit").alias("most"))
        clash = owners.join(real, "s", "left").where((F.col("least") != F.col("most")) | F.col("real")).select("s", F.when(F.col("real").isNull(), F.col("o.unit")).alias("owner"))
        bad = cut(state.join(clash, "s").where(~F.col("unit").eqNullSafe(F.col("owner"))).select("unit").distinct())
        if bad.isEmpty():
            return state.where(F.col("attempt") > 0).select("unit", "attempt").distinct()
        moved = state.join(bad, "unit", "left_semi").select("unit", "form", (F.col("attempt") + 1).alias("attempt"))
        before, state = state, cut(state.join(bad, "unit", "left_anti").unionByName(tried(moved)))
        discard(before)
        discard(bad)
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds")


#: So many later attempts go to every task with the plan; more are joined to the rows that need them.
MOST_SHIPPED = 20_000


def pseudonymise(df: DataFrame, keys: list[str], text: str, names: DataFrame, key: bytes, keep_text: bool = True, tagger: Tagger | None = None) -> DataFrame:
    """keys..., text (unless keep_text is false), pieces: the personal information in each text, in order, each piece with its keyed surrogate.

    pieces: pii_type, nth (from 1 within a type), start and end (code points), piece, surrogate; none, never null, for null, empty and
    blank texts. The surrogate follows from the key and the piece's units alone, so equal pieces are equal in all texts, and mentions
    of one person share their words. What is written for the units is checked for collisions over the whole table, also with the
    pieces themselves, and the units that collide get later attempts; words grow with the number of units. Each text is searched
    once: the found pieces are written before they are compared. The keys must be unique; other columns are left out.
    """
    ship_package(df.sparkSession)
    given = given_names(names)
    tagger = fit(df, text, given) if tagger is None else tagger
    base_ = spread(df.select(*keys, F.col(f"`{text}`").alias("_t")))
    found = cut(base_.select(*keys, *(["_t"] if keep_text else []), _mentions(F.col("_t"), given, tagger).alias("_f")))
    one = rows_of(found, F.col("_f"), item="p").select(F.explode("p.units").alias("unit"), F.when(F.col("p.pii_type") == "NAME", "").otherwise(F.col("p.piece")).alias("form"))
    forms = cut(one.distinct())
    grow = growth(forms.select("unit").distinct().count())
    later = cut(_attempts(forms, given, key, grow))
    few = later.limit(MOST_SHIPPED + 1).collect()
    shipped = {r["unit"]: r["attempt"] for r in few} if len(few) <= MOST_SHIPPED else {}

    def surrogates(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for found_, us, ats in batches:
            rows = []
            for row, u, a in zip(found_.to_pylist(), us.to_pylist(), ats.to_pylist()):
                attempts = dict(zip(u, a)) if u else shipped
                rows.append([replace(p["pii_type"], p["piece"], given, key, attempts, grow) for p in row])
            yield pa.array(rows, pa.list_(pa.string()))

    if len(few) <= MOST_SHIPPED:
        per_row = found.withColumn("_u", F.array().cast("array<string>")).withColumn("_a", F.array().cast("array<int>"))
    else:
        row = F.struct(*keys).alias("_row")
        used = rows_of(found, F.col("_f"), row, item="p").select("_row", F.explode("p.units").alias("unit")).distinct()
        hit = salted_left_join(used, later, "unit", F.col("_row")).where(F.col("attempt").isNotNull())
        own = hit.groupBy("_row").agg(F.collect_list("unit").alias("_u"), F.collect_list("attempt").alias("_a"))
        per_row = found.withColumn("_row", F.struct(*keys)).join(own, "_row", "left").drop("_row")
    done = per_row.withColumn("_s", F.arrow_udf(surrogates, "array<string>").asNondeterministic()("_f", "_u", "_a"))
    piece = F.zip_with("_f", "_s", lambda p, s: F.struct(*[p[c].alias(c) for c in ("pii_type", "nth", "start", "end", "piece")], s.alias("surrogate")))
    return done.select(*keys, *([F.col("_t").alias(text)] if keep_text else []), piece.alias("pieces"))


def with_pieces(text: Column, found: Column) -> Column:
    """The text with the surrogate of each piece in its place."""
    return F.when(F.size(found) > 0, replaced(text, found, "start", "end", lambda p: p["surrogate"])).otherwise(text)


def with_surrogates(df: DataFrame, row_id: str, text: str, names: DataFrame, key: bytes, out: str = "surrogate_text", tagger: Tagger | None = None) -> DataFrame:
    """row_id and the column `out`: the text with the surrogate of each piece (see pseudonymise) and otherwise unchanged; null stays null, a text without pieces stays as it is."""
    done = pseudonymise(df, [row_id], text, names, key, tagger=tagger)
    return done.select(row_id, with_pieces(F.col(text), F.col("pieces")).alias(out))
