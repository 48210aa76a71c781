"""Recognisers: patterns over a text column, made of built-in expressions only.

Positions and lengths count code points. A word character is a letter, a number or an underscore of any script, so that a
digit next to an accented letter is inside a word.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ENTITY_FLAGS
from ..functions.arrays import chunks, let

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
SSN = _B + r"(?!000|666|9\p{Nd}{2})[0-8]\p{Nd}{2}([-. ])(?!00)\p{Nd}{2}\1(?!0000)\p{Nd}{4}" + _E
PAN = _B + r"(?:\p{Nd}[ -]*?){13,19}(?<=\p{Nd})" + _E
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A small letter or one without case, and a word with a capital: digits of other scripts count as letters, as in a word's borders.
_SMALL = r"[\p{L}\p{N}&&[^\p{Lu}0-9]]"
_CAP = rf"\p{{Lu}}{_SMALL}[\p{{L}}\p{{N}}&&[^0-9]]*+"
#: Possessive, so that the engine needs no stack for a long one; each part ends where a word does.
_NAME = rf"{_CAP}(?:['-]{_CAP}{_E})*+"
_W = r"[\p{L}\p{N}_]"
#: What a person's name follows (fixed values), months and days, ends of names of organisations and of streets.
CUES = "Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Doctor|Nurse|Patient|Contact|Caller|Attn|Name|Signed|Sincerely|Regards|Herr|Frau|Mme|Madame|Monsieur|Docteur|Sr|Sra"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
ORGS = "Hospital|Clinic|Medical Center|Medical Centre|Health Center|University|Institute|Foundation|Laboratory|Laboratories|Pharmacy|Insurance|Bank|Inc|Ltd|LLC|LLP|Corp|Corporation|GmbH|Klinikum"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Lane|Ln|Court|Ct|Way|Terrace|Place|Square|Parkway|Highway"
_ZIP = r"\p{Lu}{2} \d{5}(?:-\d{4})?"
#: Of each entity type its pattern; where it has a group, that is the entity, at the match's end.
RULES = {
    "PHONE_NUMBER": r"(?:\+1[-. ]?)?(?:\(\d{3}\) ?|" + _B + r"\d{3}[-. ])\d{3}[-. ]\d{4}" + _E,
    "EMAIL_ADDRESS": r"(?:\G|(?<![\p{L}\p{N}_.+-]))[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]++(?:\.[\p{L}\p{N}_-]++)++",
    "URL": r"https?://[^\s<>\"',;]*[^\s<>\"',;.!?)]|" + rf"(?<!{_W})(?<!{_W}[.-]{{1,4}}){_W}[\p{{L}}\p{{N}}_.-]*\.(?:com|org|net|edu|gov|io)" + _E,
    "IP_ADDRESS": _B + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + _E,
    "US_BANK_NUMBER": _B + r"\d{8,17}" + _E,
    "LOCATION": rf"(?:^|[^\p{{L}}\p{{N}}_'-])(\d{{1,6}} (?:[NSEW]\.? )?(?:{_NAME} ){{1,3}}(?:{STREETS}){_E}(?:(?:,? (?:Apt|Suite|Unit)\.? [\p{{L}}\p{{N}}]{{1,8}})?,? {_NAME}(?: {_NAME}){{0,2}}, {_ZIP}{_E})?|{_NAME}(?: {_NAME}){{0,2}}, {_ZIP}{_E})",
    "PERSON": _B + rf"(?:(?:{CUES})[.:,]? ){{1,3}}((?:\p{{Lu}}\. ){{0,2}}{_NAME}(?: \p{{Lu}}\.)?(?: {_NAME}){{0,2}}){_E}",
    "DATE": _B + rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/(?:\d{{4}}|\d{{2}})|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|(?:{MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?(?:,? \d{{4}})?|\d{{1,2}}(?:st|nd|rd|th)? (?:{MONTHS})(?:,? \d{{4}})?|{DAYS}){_E}",
    "ORG": _B + rf"(?:St\. )?(?:{_CAP}(?:'s)? (?:of |and |& )?){{1,4}}(?:{ORGS}){_E}",
}
#: One of these is in every text in which the pattern can match: a cheap look before the pattern.
_SIGNS = {"EMAIL_ADDRESS": ("@",), "URL": ("://", ".com", ".org", ".net", ".edu", ".gov", ".io"), "IP_ADDRESS": (".",)}
_ARABIC, _WIDE, _ASCII = "٠١٢٣٤٥٦٧٨٩", "０１２３４５６７８９", "0123456789"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, _ARABIC + _WIDE, _ASCII * 2)


#: Stands for a match between two gaps; no character, so no text has to hold it.
_CUT = "\uffff"


def gaps(text: Column, pattern: str) -> Column:
    """What lies before, between and after the matches. A split by a plain sign, as one by a pattern compiles it for each text."""
    return F.split(F.regexp_replace(F.translate(text, _CUT, "\ufffe"), pattern, _CUT), _CUT, -1)


def luhn_valid(candidate: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of 10; what isn't a digit is skipped."""
    digits = F.regexp_replace(ascii_digits(candidate), r"\D", "")
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def ssn_redact(text: Column) -> Column:
    return F.regexp_replace(text, SSN, "[REDACTED_SSN]")


def pan_candidates(text: Column) -> Column:
    return matches(text, PAN)


def pan_count(text: Column) -> Column:
    return F.size(F.filter(pan_candidates(text), luhn_valid))


def pan_redact(text: Column) -> Column:
    """Luhn-valid candidates replaced, all others kept as they are: the gaps between candidates and the candidates, one by one, joined again."""
    changed = F.transform(pan_candidates(text), lambda c: F.when(luhn_valid(c), F.lit("[REDACTED_PAN]")).otherwise(c))
    return F.when(~text.rlike(PAN), text).otherwise(F.array_join(F.zip_with(F.split(text, PAN, -1), changed, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), ""))


SPAN = "struct<s:int,e:int,f:array<string>,p:string,o:int>"
SPANS = f"array<{SPAN}>"


def rule_spans(text: Column, entity: str, order: int) -> Column:
    """Spans of one rule: start, end, flags, placeholder and the recogniser's order. Starts follow from the lengths of the
    gaps and matches before. What contains REDACTED is no span, and neither is a cue after a cue. The pattern runs twice over a text: for its matches and, only
    where there are some, for the gaps."""
    pattern, (flag, placeholder) = RULES[entity], ENTITY_FLAGS[entity]
    grouped = "(" in re.sub(r"\\\(|\(\?", "", pattern)
    whole_match = matches(text, pattern)
    # Of a match alone, the pattern's group is what it was in the text.
    found = F.transform(whole_match, lambda m: F.struct(m.alias("m"), (F.regexp_extract(m, pattern, 1) if grouped else m).alias("x")))
    none = F.array().cast(SPANS)

    def fold(hits: Column) -> Column:
        # The gap after the last match has no match beside it and makes no piece.
        pieces = F.filter(F.zip_with(gaps(text, pattern), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h["m"]).alias("n"), F.length(h["x"]).alias("k"), h["x"].alias("x"))), lambda p: p["x"].isNotNull())
        span = lambda end, p: F.struct((end - p["k"]).alias("s"), end.alias("e"), F.array(F.lit(flag)).alias("f"), F.lit(placeholder).alias("p"), F.lit(order).alias("o"))
        step = lambda a, p: F.struct((a["at"] + p["g"] + p["n"]).alias("at"), F.concat(a["out"], F.when(p["x"].contains("REDACTED") | p["x"].isin(*CUES.split("|")), none).otherwise(F.array(span(a["at"] + p["g"] + p["n"], p)))).alias("out"))
        whole = lambda a, c: F.aggregate(c, F.struct(a["at"].alias("at"), none.alias("out")), step)
        # Chunk by chunk, each from where the last one ended.
        outer = lambda a, c: let(whole(a, c), lambda r: F.struct(r["at"].alias("at"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("outs"))
        return let(pieces, lambda ps: F.aggregate(chunks(ps), zero, outer, lambda a: F.flatten(a["outs"])))

    searched = let(found, lambda hits: F.when(F.size(hits) > 0, fold(hits)).otherwise(none))
    if signs := _SIGNS.get(entity):
        some = functools.reduce(lambda a, b: a | b, [text.contains(x) for x in signs])
        return F.when(some, searched).otherwise(none)
    return F.when(text.isNotNull(), searched).otherwise(none)


def all_spans(text: Column) -> Column:
    """Spans of all rules; digits of other scripts count as digits."""
    return let(ascii_digits(text), lambda plain: F.concat(*[rule_spans(plain, entity, i) for i, entity in enumerate(RULES)]))
