"""Languages of documents and of the segments of mixed ones, by hyperdimensional profiles."""

from __future__ import annotations

import hashlib
import logging
import unicodedata as U
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import rows_of
from ..functions.keys import trimmed
from ..session import ship_package, spread
from .lookalike import CYRILLIC, GREEK

DIMENSIONS = 8192
GRAMS = (3, 4)
#: Labelled documents, at most, that refine the profiles: those with the least hash of doc_id.
SAMPLE_DOCUMENTS = 2000
#: Words of a whole sentence, at least, or letters of a script without blanks between words.
LEAST_WORDS, LEAST_LETTERS = 3, 6
_NO_BLANKS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
#: A sentence is in no known language if its best cosine is below the first of these, or below the second without being NEAR above the next.
UNKNOWN, LEAST_COSINE, LIKELY_COSINE, NEAR = "und", 0.05, 0.068, 0.03
#: A sentence whose best cosine isn't this much above the second is in no certain language.
LEAST_MARGIN = 0.02
REMEMBERED = 1 << 16

#: A few common words of each language, from which the profiles start.
SEEDS = {
    "en": "the of and to in is was that it for on with as at by from this have has had not are were which you she he they we been could should would before after because the patient there their every about more please bring asked nobody anyone has been walking since what should happen with the records",
    "de": "der die das und ist nicht ein eine einen mit von zu den dem auf für sich des wurde werden wird noch nach wie bei aber auch durch oder wenn hat haben sind war seit sie er wir ihre keine niemand bitte muss darf warum was soll bringen schon zwei insgesamt gefunden geschlafen",
    "fr": "le la les de des du et est un une que qui dans pour pas sur avec par au aux ce cette il elle nous vous sont été a ont ne plus mais ou où leur tout être fait avant depuis pourquoi jamais chaque semaine merci celui sans toujours deux personne demandé faire faut",
    "es": "el la los las de del y es un una que en por para con no se su al lo como más pero sus le ha han fue son está esta este desde porque cuando muy sin sobre también quien hay nadie puede dos qué debe con los datos hasta que traiga antes después nunca esta semana hubo ya pagó",
    "pt": "o a os as de do da dos das e é um uma que em no na por para com não se ao mais mas como foi são está pelo pela seu sua muito também quem desde até há nunca já pode ver duas ninguém depois antes cada houve semana deve devem doente tolerou bem traga lhe você porque",
    "it": "il lo la gli le di del della e è un una che in per non con si da dal dalla al alla sono ha hanno stato stata stati ma come più anche questo questa nel nella chi se ogni mai ci due dopo prima perché nessuno bisogna può suo sua va deve fare dei delle molto essere almeno",
    "ru": "и в не на что он она с как это по но из у за от так его к же бы для мы вы они был была было были если когда уже или нет до после ни никто который перед каждый чтобы нужно можно надо два раз неделе почему сразу пока хотя этом никто просил",
    "nl": "de het een en van is niet dat die in op te zijn met voor als aan er maar om hem dan zou of wat mijn men dit zo door over ze bij ook tot uit naar heb heeft hebben werd worden wordt geen kan moet nog wel deze twee omdat waarom wie elke voordat nooit sinds jaar",
    "ca": "el la els les de del i és un una que en per amb no es al com més però seu seva ha han va van són aquest aquesta des perquè quan molt sense sobre també qui hi res pot dues dos abans després mai cada setmana cal fins ja li ens vostè dels amb aquestes mateix havia",
    "uk": "і в не на що він вона з як це по але із за від так його до же би для ми ви вони був була було були якщо коли вже або ні після ніхто який перед кожен щоб потрібно можна треба два раз тижні чому одразу поки хоча цьому та є й ця ще також їх її тут",
}

_HIDDEN = regex.compile(r"[\p{Cf}\p{M}️--[̀-ͯ]]", flags=regex.V1)
_LOG = regex.compile(r"^\s*(\d{4}-\d\d-\d\dT[\d:.]+Z?\b.*|\{.*\}|\[REDACTED_\w+\]\s*=>.*|<\|.*|0x[0-9a-fA-F]+.*|--+\s.*|[A-Za-z_]+=\S+(\s+[A-Za-z_]+=\S+)*)\s*$")
_HEAD = regex.compile(r"^\s*(?:[>*\-•#|\s]+|\d+[.)]\s+|(?:user|assistant|system|human|ai)\s*:\s*)+", flags=regex.I)
_SIGNED = regex.compile(r"(?:^|\s)--\s")
_MEASURE = regex.compile(r"\b(?:BP|HR|RR|SpO2|eGFR|BMI|T) +\d", flags=regex.I)
_VITALS = regex.compile(r"\b(?:BP|HR|T|RR|SpO2|eGFR|BMI)\s+\d[\d./]*\s?%?", flags=regex.I)
#: Abbreviations whose full stop ends no sentence (fixed values).
_ABBREVIATIONS = frozenset("см стр ул кв д г т dr mr mrs ms st nr no sr sra prof pag pág pags págs ca cf vs bzw usw etc ext tel".split())
_CLOSERS, _STOPS = "\"'»”’)", tuple(".!?…。？！")
_LAST_WORD = regex.compile(r"(?<!\p{L})(\p{L}{1,5})\.$")
_STOP = regex.compile(r"[.!?…。？！][\"'»”’)]*+(\s+)")
_WORD = regex.compile(r"\p{L}{2,}")
_GAPS = regex.compile(r"\P{L}+")


_PAIRS = " ".join((CYRILLIC, GREEK)).split()
_TO_LATIN = {ord(p[0]): p[1] for p in _PAIRS}
_TO_CYRILLIC = {ord(p[1]): p[0] for p in reversed(CYRILLIC.split())}
_MIXED = regex.compile(r"[\p{L}\p{M}'’]+")
_LATIN_OWN = regex.compile("[\\p{Latin}--[" + "".join(p[1] for p in _PAIRS) + "]]", flags=regex.V1)
_OTHER_OWN = regex.compile("[[\\p{Cyrillic}\\p{Greek}]--[" + "".join(p[0] for p in _PAIRS) + "]]", flags=regex.V1)
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_LATIN = regex.compile(r"\p{Latin}")


def one_script(line: str) -> str:
    """A line whose letters were swapped for look-alikes of another script, brought back: a word without a letter of its own
    script, or with letters of two, goes to the script that has more letters of its own in the line."""
    if not _OTHER.search(line):
        return line
    latin, other = len(_LATIN_OWN.findall(line)), len(_OTHER_OWN.findall(line))

    def word(m: regex.Match) -> str:
        w = m[0]
        if latin >= other and _OTHER.search(w):
            moved = w.translate(_TO_LATIN)
            return w if _OTHER.search(moved) else moved
        if latin < other and _LATIN.search(w):
            moved = w.translate(_TO_CYRILLIC)
            return w if _LATIN.search(moved) else moved
        return w

    return _MIXED.sub(word, line)


_CODE = regex.compile(r"[@_\\=/<>\d]|&#|\[REDACTED")


def without_codes(text: str) -> str:
    """Words only: what has a digit, an at sign, a slash or the like in it, and placeholders, are left out."""
    return " ".join(w for w in text.split() if not _CODE.search(w)) if _CODE.search(text) else text


def _abbreviated(text: str, stop: int) -> bool:
    """Whether the full stop at this place is an abbreviation's."""
    word = _LAST_WORD.search(text, max(0, stop - 6), stop + 1) if text[stop] == "." else None
    return word is not None and (word[1].lower() in _ABBREVIATIONS or len(word[1]) == 1 and word[1].isupper())


def _split(line: str) -> list[str]:
    out, at = [], 0
    for m in _STOP.finditer(line):
        if m.end() < len(line) and not _abbreviated(line, m.start()):
            out.append(line[at : m.start(1)])
            at = m.end()
    return [*out, line[at:]]


_LATIN_WORD, _CYRILLIC_WORD = regex.compile(r"\p{Latin}+"), regex.compile(r"\p{Cyrillic}+")


#: What isn't a letter becomes a blank.
_ASCII_GAPS = {i: " " for i in range(128) if not chr(i).isalpha()}


def _words(text: str) -> str:
    low = without_codes(text).lower()
    return low.translate(_ASCII_GAPS) if low.isascii() else _GAPS.sub(" ", low)


def _one_script_words(words: str) -> str:
    if not words.isascii() and _CYRILLIC_WORD.search(words):
        latin, cyrillic = (sum(map(len, rx.findall(words))) for rx in (_LATIN_WORD, _CYRILLIC_WORD))
        words = (_LATIN_WORD if cyrillic > latin else _CYRILLIC_WORD).sub(" ", words)
    return f" {' '.join(words.split())} "


def plain(text: str) -> str:
    """Lower-case words with single blanks around each. Words of the script that is rarer in the text, as names of drugs, are left out."""
    return _one_script_words(_words(text))


def sentences(text: str) -> list[str]:
    return [s for s, _ in _sentences(text)]


def _sentences(text: str) -> list[tuple[str, str]]:
    """The whole sentences of a text, in order: at least LEAST_WORDS words (LEAST_LETTERS letters where a script has no blanks) and an end mark. Log lines, role marks, quote and
    list marks, measurements, codes, addresses, placeholders and signatures are taken away first and are no sentences. Each with its plain words."""
    out = []
    if not text.isascii():
        text = U.normalize("NFKC", _HIDDEN.sub("", text))
    for line in text.splitlines():
        if not line.strip() or _LOG.match(line):
            continue
        line = _HEAD.sub("", line)
        if "--" in line:
            line = _SIGNED.split(line)[0]
        if _MEASURE.search(line):
            line = _VITALS.sub(" ", line)
        for s in _split(one_script(line).strip()):
            s = s.strip()
            if s and (not s[0].isalpha() or ":" in s[:12]):
                s = _HEAD.sub("", s)
            if s and s.rstrip(_CLOSERS)[-1:] in _STOPS:
                words = _words(s)
                if sum(len(w) > 1 for w in words.split()) >= LEAST_WORDS or len(_NO_BLANKS.findall(words)) >= LEAST_LETTERS:
                    out.append((s, _one_script_words(words)))
    return out


def folded(text: str) -> tuple[str, str]:
    """Letters in lower case with single blanks, and the same without accents."""
    low = plain(text)
    if low.isascii():
        return low, low
    return low, "".join(c for c in U.normalize("NFD", low) if not U.combining(c))


def grams(text: str) -> list[str]:
    """Letter n-grams of a text and, where accents make a difference, those of it without them."""
    a, b = folded(text)
    return [x[i : i + n] for x in ((a,) if a == b else (a, b)) for n in GRAMS for i in range(len(x) - n + 1)]


class Space:
    """Random letter vectors of +1 and -1, made from the letter itself, and n-gram vectors: letters permuted by their place and bound."""

    def __init__(self):
        self.letters: dict[str, np.ndarray] = {}

    def letter(self, c: str) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.default_rng(zlib.crc32(c.encode()) + 7).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
        return self.letters[c]

    def gram(self, g: str) -> np.ndarray:
        v = self.letter(g[0])
        for c in g[1:]:
            v = np.roll(v, 1) * self.letter(c)
        return v


@dataclass
class Profiles:
    """Language prototypes: bundled n-gram vectors of unit length, the mean of all taken away."""

    langs: list[str]
    matrix: np.ndarray
    #: The products of the n-grams that the prototypes hold, so that workers needn't make those vectors again.
    grams: list[str]
    products: np.ndarray

    @staticmethod
    def bundle(counts: dict[str, dict[str, float]], remember: bool = False) -> Profiles:
        space, langs = Space(), sorted(counts)
        total = np.zeros((len(langs), DIMENSIONS), np.float32)
        for i, lang in enumerate(langs):
            for g, n in counts[lang].items():
                total[i] += np.float32(np.log1p(n)) * space.gram(g)
        total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        total -= total.mean(axis=0)
        total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        known = sorted({g for c in counts.values() for g in c}) if remember else []
        products = np.stack([total @ space.gram(g).astype(np.float32) for g in known]) if known else np.zeros((0, len(langs)), np.float32)
        return Profiles(langs, total, known, products.astype(np.float32))


class Judge:
    """Cosines of texts with the prototypes. A text's vector is the bundle of its n-grams' vectors, so its product with a
    prototype is the sum of its n-grams' products, which are remembered; its length follows from the n-grams' counts, as their vectors are all but orthogonal."""

    def __init__(self, profiles: Profiles, reject: bool = False):
        self.p, self.space, self.reject = profiles, Space(), reject
        self.start()
        self.known: dict[str, tuple[str, float, str, bool]] = {}

    def start(self) -> None:
        self.at = {g: i for i, g in enumerate(self.p.grams)}
        self.rows = np.concatenate([self.p.products, np.zeros((1024, len(self.p.langs)), np.float32)])

    def products(self, gs: list[str]) -> np.ndarray:
        if len(self.at) > len(self.p.grams) + REMEMBERED * 4:
            self.start()
        at = self.at
        idx = []
        for g in gs:
            i = at.get(g)
            if i is None:
                i = at[g] = len(at)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = self.p.matrix @ self.space.gram(g).astype(np.float32)
            idx.append(i)
        return self.rows[idx].sum(axis=0)

    def cosines(self, text: str) -> np.ndarray:
        gs = grams(text)
        if not gs:
            return np.zeros(len(self.p.langs), np.float32)
        length = np.sqrt(sum(n * n for n in Counter(gs).values()) * DIMENSIONS)
        return self.products(gs) / length

    def judge(self, sentence: str, words: str | None = None) -> tuple[str, float, str, bool]:
        """The language, or UNKNOWN if none is near enough (where `reject` is set), a confidence from 0 to 1, the next language, and whether the margin between them is large enough.
        The confidence of UNKNOWN is 0."""
        key = plain(sentence) if words is None else words
        if key not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            cos = self.cosines(sentence)
            first, second = np.argsort(cos)[[-1, -2]]
            e = np.exp((cos - cos[first]) * 40)
            best, margin = float(cos[first]), float(cos[first] - cos[second])
            sure = margin >= LEAST_MARGIN
            far = self.reject and (best < LEAST_COSINE or best < LIKELY_COSINE and margin < NEAR)
            self.known[key] = (UNKNOWN, 0.0, UNKNOWN, False) if far else (self.p.langs[first], round(float(1 / e.sum()), 4), self.p.langs[second], sure)
        return self.known[key]


def segments(judge: Judge, text: str | None, texts: bool = True) -> list[dict]:
    """Runs of sentences in one language: seg_no, lang, confidence (the mean of the sentences'), n_sentences, n_chars, text (null without `texts`).

    A sentence between two languages takes the one that the text's certain sentences are in, if only one of the two is.
    """
    out: list[dict] = []
    found = [(s, judge.judge(s, words)) for s, words in _sentences(text or "")]
    certain = {lang for _, (lang, _, _, far) in found if far}
    for s, (lang, sure, other, far) in found:
        if not far and lang != UNKNOWN and lang not in certain and other in certain:
            lang, sure = other, round(1 - sure, 4)
        if not out or out[-1]["lang"] != lang:
            out.append({"seg_no": len(out), "lang": lang, "confidence": 0.0, "n_sentences": 0, "n_chars": 0, "text": []})
        last = out[-1]
        last["confidence"] = (last["confidence"] * last["n_sentences"] + sure) / (last["n_sentences"] + 1)
        last["n_sentences"] += 1
        last["n_chars"] += len(s)
        last["text"].append(s)
    for x in out:
        x["text"] = " ".join(x["text"]) if texts else None
    return out


#: The table of languages is a short list; the log looks at so many.
MOST_LANGUAGES = 1000
#: Bibliographic codes of three letters that differ from those of lang_codes (fixed values).
OTHER_ISO3 = {"ger": "de", "fre": "fr", "dut": "nl"}


def label_language(docs: DataFrame, codes: DataFrame, label: str = "lang", out: str = "label_lang") -> DataFrame:
    """`docs` with the ISO 639-1 code that a label names, or null: a code of two or three letters with or without a region, or the English name, in any case.

    lang_codes is a fixed list of ten languages and is broadcast.
    """
    spark = docs.sparkSession
    low = lambda c: F.lower(trimmed(F.col(c)))
    names = codes.select(low("lang").alias("_l"), F.explode(F.array(low("lang"), low("iso3"), low("english_name"))).alias("_n"))
    names = names.unionByName(spark.createDataFrame([(v, k) for k, v in OTHER_ISO3.items()], "_l string, _n string")).dropDuplicates(["_n"])
    plain = F.regexp_replace(F.lower(trimmed(F.col(f"`{label}`"))), r"^([a-z]{2,3})[-_].*$", "$1")
    return docs.withColumn("_n", plain).join(F.broadcast(names), "_n", "left").withColumnRenamed("_l", out).drop("_n")


def fit(docs: DataFrame, codes: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Profiles:
    """Profiles from the seed words and from the sentences of at most `sample` labelled documents.

    Labels may be wrong: a sentence counts for its document's label only if the seeds' profiles name the same language. A language
    of lang_codes without seed words is learned from the sentences of the documents labelled with it that are in none of the others;
    where there are none, it can't be named, and the log says so. The n-gram counts of the sample, not its texts, come to the driver.
    """
    ship_package(docs.sparkSession)
    seeds = {lang: Counter(grams(words)) for lang, words in SEEDS.items()}
    first = Profiles.bundle(seeds)
    known = label_language(docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull() & F.col("lang").isNotNull()), codes).where(F.col("label_lang").isNotNull())
    chosen = known.select("doc_id", "label_lang", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).repartition(8, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, stern, n = Judge(first), Judge(first, reject=True), Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in sentences(text):
                    if s and (judge.judge(s)[0] == lang if lang in seeds else not stern.judge(s)[3]):
                        n.update((lang, g) for g in grams(s))
                        n[lang, ""] += 1
                    n[lang, None] += 1
        items = list(n.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.string()), pa.array([v for _, v in items], pa.int64())], ["lang", "gram", "n"])

    rows = chosen.select("label_lang", "text").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, float]] = {lang: dict(c) for lang, c in seeds.items()}
    seen = {(r["lang"], r["gram"]): r["n"] for r in rows}
    for (lang, gram), n in seen.items():
        # A label under which most sentences are in another language teaches nothing.
        if gram and seen[lang, ""] * 2 >= seen[lang, None]:
            own = counts.setdefault(lang, {})
            own[gram] = own.get(gram, 0) + n
    named = {r[0] for r in codes.select(F.lower(trimmed(F.col("lang")))).limit(MOST_LANGUAGES).collect()}
    if missing := sorted(x for x in named - counts.keys() if x):
        logging.getLogger(__name__).warning("no seed words and no labelled sentences: %s can't be named", ", ".join(missing))
    return Profiles.bundle(counts, remember=True)


_judges: dict[bytes, Judge] = {}
SEGMENT = "array<struct<seg_no:int,lang:string,confidence:double,n_sentences:int,n_chars:int,text:string>>"
_ARROW = pa.list_(pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("n_chars", pa.int32()), ("text", pa.string())]))


def segment_column(df: DataFrame, text: Column, profiles: Profiles, texts: bool = True) -> Column:
    """Segments of a text in order; none, never null, for null, empty and blank texts and for texts without a sentence."""
    ship_package(df.sparkSession)
    langs, matrix, known, products = profiles.langs, profiles.matrix.tobytes(), "\n".join(profiles.grams), profiles.products.tobytes()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hashlib.sha256(matrix).digest()
        if key not in _judges:
            _judges.clear()  # one at a time
            shaped = lambda b, width: np.frombuffer(b, np.float32).reshape(-1, width)
            _judges[key] = Judge(Profiles(langs, shaped(matrix, DIMENSIONS), known.split("\n") if known else [], shaped(products, len(langs))), reject=True)
        judge = _judges[key]
        for b in batches:
            yield pa.array([segments(judge, t, texts) for t in b.to_pylist()], _ARROW)

    # Named nondeterministic so that no filter on its result is pushed below it and evaluates it again.
    return F.arrow_udf(run, SEGMENT).asNondeterministic()(text.cast("string"))


def identify(docs: DataFrame, codes: DataFrame, profiles: Profiles | None = None, texts: bool = True) -> DataFrame:
    """doc_id, label_lang, lang, confidence, langs (of its whole sentences, sorted), segments (without their texts if `texts` is false).

    lang is that of most sentence characters, ties by code, and confidence its segments' mean weighted by characters. Sentences in no
    known language are segments of `und`, which is no member of langs; lang is `und` with confidence 0 where all are, and both are null where no
    sentence is. Row by row after fitting, without a shuffle; repeated rows are each judged; extra columns are dropped.
    """
    profiles = fit(docs, codes) if profiles is None else profiles
    held = label_language(spread(docs.select("doc_id", "lang", "text"), "doc_id"), codes).withColumn("segments", segment_column(docs, F.col("text"), profiles, texts)).select("doc_id", "label_lang", "segments")
    per = F.transform(F.array_sort(F.array_distinct(F.transform(F.filter("segments", lambda s: s["lang"] != UNKNOWN), lambda s: s["lang"]))), lambda lang: F.struct(
        F.aggregate(F.filter("segments", lambda s: s["lang"] == lang), F.lit(0), lambda n, s: n + s["n_chars"]).alias("n"), lang.alias("lang"),
        F.aggregate(F.filter("segments", lambda s: s["lang"] == lang), F.lit(0.0), lambda n, s: n + s["n_chars"] * s["confidence"]).alias("c")))
    held = held.withColumn("_per", per)
    top = F.element_at(F.array_sort("_per", lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["lang"] < b["lang"], -1).otherwise(1)), 1)
    some = F.size("_per") > 0
    held = held.withColumn("_top", F.when(some, top))
    return held.select("doc_id", "label_lang", F.coalesce("_top.lang", F.when(F.size("segments") > 0, F.lit(UNKNOWN))).alias("lang"), F.coalesce(F.round(F.try_divide("_top.c", "_top.n"), 4), F.when(F.size("segments") > 0, F.lit(0.0))).alias("confidence"), F.transform("_per", lambda p: p["lang"]).alias("langs"), "segments")


def wrong_or_mixed(judged: DataFrame) -> DataFrame:
    """doc_id, lang: each language of the documents with whole sentences in two languages or more, or whose label isn't the one they have."""
    case = (F.size("langs") > 1) | ((F.size("langs") == 1) & (F.coalesce(F.col("label_lang"), F.lit("")) != F.get("langs", F.lit(0))))
    return rows_of(judged.where(case), F.col("langs"), "doc_id", item="lang").select("doc_id", "lang")
