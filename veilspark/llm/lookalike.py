"""One consistent form for texts that look the same but have different characters."""

from __future__ import annotations

import sys
import unicodedata as U
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join, salted_left_join
from ..session import cut, ship_package, spread

#: Letters of other scripts and the Latin letters that they look like (fixed values, in pairs).
CYRILLIC = "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ҮY ԚQ ԜW ӀI"
GREEK = "οo ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
#: Small Greek letters that look like Latin ones in upright type, and letters of scripts made of Latin shapes.
GREEK_SMALL = "αa ιi νv ρp υu"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
LISU = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
COPTIC_AND_DESERET = "ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX 𐐄O 𐐬o"
ARMENIAN_AND_OTHERS = "օo ոn սu հh ցg ՏS ՕO ɡg ɑa"
#: Format characters that do show, though their category is that of invisible ones (fixed values).
SHOWN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
#: Invisible characters of other categories (fixed values): joiner, fillers, selectors.
HIDDEN_OTHER = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


class UnionFind:
    """Disjoint classes of strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def union(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values() if len(c) > 1]


def lookalike_classes() -> list[list[str]]:
    """Classes of strings that look the same, closed transitively. Made by rule from the character database, and so of one size whatever the corpus.

    Members are in decomposed form, as texts are decomposed before they are rewritten. Together are: a form and its full-width
    or half-width form; a joined letter and its letters; a Roman numeral sign and its letters; a unit sign and its letter; a
    letter and one of another script from the tables; all blanks of one kind or another; nothing and each invisible character.
    Apart stay: case, accents, raised and lowered digits, circled and styled letters, punctuation, line breaks and tabs.
    """
    uf = UnionFind()
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        kind = U.category(c)
        if kind == "Cf" and c not in SHOWN_FORMAT or c in HIDDEN_OTHER or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            uf.union("", c)
            continue
        if kind == "Zs":
            uf.union(" ", c)
            continue
        rule, _, rest = U.decomposition(c).partition(" ")
        if rule in ("<wide>", "<narrow>"):
            uf.union(U.normalize("NFKD", c), c)
        elif rule == "<compat>" and (kind[0] == "L" and (len(rest) > 4 or c == "\xb5") or kind == "Nl") and all(U.category(x)[0] in "LM" for x in U.normalize("NFKD", c)):
            uf.union(U.normalize("NFKD", c), c)
    for pair in " ".join((CYRILLIC, GREEK, GREEK_SMALL, CHEROKEE, LISU, COPTIC_AND_DESERET, ARMENIAN_AND_OTHERS)).split():
        uf.union(pair[1], pair[0])
    return uf.classes()


@dataclass(frozen=True)
class Rewrites:
    """apart: each string to the letters that it is made of, in the representatives of their classes. together: sequences of such
    letters to the joined form, where that is the more frequent member of their class."""

    apart: tuple[tuple[str, str], ...]
    together: tuple[tuple[str, str], ...] = ()


def rewrites(classes: list[list[str]], counts: dict[str, int]) -> Rewrites:
    """Of each class the most frequent member stands for all, the lowest code point among equals; nothing stands for the invisible.
    A sequence's letters have classes of their own, so joined forms are taken apart first and put together again last, if
    at all: what comes out depends on the look alone."""
    to: dict[str, str] = {}
    sequences = []
    for members in classes:
        longest = max(members, key=lambda m: (len(m), m))
        if "" in members:
            best = ""
        elif len(longest) > 1:
            best = min((m for m in members if len(m) == len(longest)), key=lambda m: (-min(counts.get(x, 0) for x in m), m))
            sequences.append((members, best))
        else:
            best = min(members, key=lambda m: (-counts.get(m, 0), m))
        for m in members:
            if m != best and len(m) <= 1:
                to[m] = best
    apart = {m: "".join(to.get(x, x) for x in best) for m, best in to.items()}
    together = {}
    for members, best in sequences:
        top = max((m for m in members if len(m) == 1), key=lambda m: (counts.get(m, 0), -ord(m)))
        if counts.get(top, 0) > sum(counts.get(m, 0) for m in members if len(m) > 1):
            together["".join(to.get(x, x) for x in best)] = top
    return Rewrites(tuple(sorted(apart.items())), tuple(sorted(together.items())))


_made: dict[Rewrites, Callable[[str], str]] = {}


def _automaton(patterns: Iterable[tuple[str, str]]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for pattern, target in patterns:
        out.add_word(pattern, (len(pattern), target))
    if not len(out):
        return None
    out.make_automaton()
    return out


def rewriter(table: Rewrites) -> Callable[[str], str]:
    """A function that brings a text into the consistent form: decomposed, rewritten greedily from the left with the longest
    pattern by an Aho-Corasick automaton, and composed again. Its result is a fixed point of it."""
    if table in _made:
        return _made[table]
    if len(_made) > 8:
        _made.clear()
    apart, together = _automaton(table.apart), _automaton(table.together)
    plain = not any(p.isascii() for p, _ in (*table.apart, *table.together))

    def run(automaton: ahocorasick.Automaton | None, text: str) -> str:
        if automaton is None:
            return text
        parts, at = [], 0
        for end, (length, target) in automaton.iter_long(text):
            parts += (text[at : end + 1 - length], target)
            at = end + 1
        return "".join(parts) + text[at:]

    def rewrite(text: str) -> str:
        if plain and text.isascii():
            return text
        return U.normalize("NFC", run(together, run(apart, U.normalize("NFD", text))))

    _made[table] = rewrite
    return rewrite


def count_members(df: DataFrame, text: str, classes: list[list[str]]) -> dict[str, int]:
    """How often each member of a class, and each code point of its sequences, occurs in the whole column.

    Each task counts its own texts; what meets is at most one row a member and task, and the result has one row a member.
    """
    ship_package(df.sparkSession)
    wanted = frozenset(x for c in classes for m in c for x in m)
    sequences = [m for c in classes for m in c if len(m) > 1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        several = _automaton((m, m) for m in sequences)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    t = U.normalize("NFD", t)
                    n.update(t)
                    if several is not None:
                        n.update(m for _, (_, m) in several.iter_long(t))
        own = [(k, v) for k, v in n.items() if k in wanted or len(k) > 1]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.int64())], ["c", "n"])

    parts = df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "c string, n bigint")
    return {r["c"]: r["n"] for r in parts.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def learn(df: DataFrame, text: str) -> Rewrites:
    """The table of rewrites for a column: classes by rule, representatives by frequency over all its rows."""
    classes = lookalike_classes()
    return rewrites(classes, count_members(df, text, classes))


def consistent(df: DataFrame, text: Column, table: Rewrites) -> Column:
    """The text in its consistent form; null stays null, a text of invisible characters becomes empty. Whole texts of any length."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rewrite = rewriter(table)
        for batch in batches:
            yield pa.array([None if t is None else rewrite(t) for t in batch.to_pylist()], pa.string())

    # Named nondeterministic so that no filter on its result is pushed below it and evaluates it again.
    return F.arrow_udf(run, "string").asNondeterministic()(text.cast("string"))


def lookalike_members(df: DataFrame, row_id: str, text: str, table: Rewrites | None = None) -> DataFrame:
    """_id, raw, form (256-bit digests of the text and of its consistent form) of the rows whose form has several spellings, written once.

    Null texts and texts that show nothing but white space are in no class. A form or a text that a third of all rows have is
    one partial row a task where forms are counted, and salted where rows join what was counted.
    """
    df = spread(df.select(row_id, text))
    table = learn(df, text) if table is None else table
    form = consistent(df, F.col(f"`{text}`"), table)
    shown = df.select(F.col(row_id).alias("_id"), F.col(f"`{text}`").alias("_t"), form.alias("_f")).where(F.length(F.btrim(F.regexp_replace("_f", r"\s+", ""))) > 0)
    rows = cut(shown.select("_id", F.unhex(F.sha2("_t", 256)).alias("raw"), F.unhex(F.sha2("_f", 256)).alias("form")))
    mixed = rows.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where(F.col("lo") != F.col("hi")).select("form", F.lit(True).alias("_mixed"))
    return cut(salted_left_join(rows, mixed, "form", F.col("_id")).where("_mixed").select("_id", "raw", "form"))


def lookalike_groups(df: DataFrame, row_id: str, text: str, table: Rewrites | None = None) -> DataFrame:
    """One row per row whose text has a look-alike: id, class_id (equal for texts that look the same), string_id (equal for equal texts): the pairs, without expanding them."""
    members = lookalike_members(df, row_id, text, table)
    return members.select(F.col("_id").alias("id"), F.lower(F.hex("form")).alias("class_id"), F.lower(F.hex("raw")).alias("string_id"))


def lookalike_pairs(df: DataFrame, row_id: str, text: str, table: Rewrites | None = None) -> DataFrame:
    """Pairs of rows (a < b) whose texts are different strings of one consistent form: id_a, id_b.

    Different strings of a form are paired once, as strings; rows join those pairs, so the copies of a frequent text are never
    paired among themselves. Forms with many spellings and texts with many copies are salted.
    """
    members = lookalike_members(df, row_id, text, table)
    strings = cut(members.select("form", "raw").distinct())
    pairs = salted_join(strings.withColumnRenamed("raw", "raw_a"), strings.withColumnRenamed("raw", "raw_b"), "form", F.col("raw_a"), "inner").where(F.col("raw_a") < F.col("raw_b")).select("raw_a", "raw_b")
    left = members.select(F.col("_id").alias("_x"), F.col("raw").alias("raw_a"))
    right = members.select(F.col("_id").alias("_y"), F.col("raw").alias("raw_b"))
    with_a = salted_join(left, pairs, "raw_a", F.col("_x"), "inner").select("_x", "raw_b")
    both = salted_join(right, with_a, "raw_b", F.col("_y"), "inner")
    return both.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))
