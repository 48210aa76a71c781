"""A trained tagger for names of persons: what stands around two words with a capital, and how they look, decides."""

from __future__ import annotations

import base64
import functools
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bpe import TOKENIZERS

#: Size of the table of weights, and how sure the tagger must be.
BUCKETS, LEAST = 1 << 15, 0.5
#: Texts, at most, on whose contexts a tagger is fitted: those with the least hash.
SAMPLE_TEXTS = 6000

#: Words that are whole in the vocabulary of a public tokenizer are ordinary ones; where its file isn't, the tagger does without.
WORDS = os.path.join(TOKENIZERS, "byte_bpe_multi_50k.tiktoken")


@functools.cache
def ordinary(path: str = WORDS) -> frozenset[str]:
    """The words of small letters, of three letters or more, that the vocabulary has whole, as it has them after a blank."""
    if not os.path.exists(path):
        return frozenset()
    with open(path, "rb") as f:
        entries = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in f if line.strip()]
    return frozenset(w[1:] for w in entries if w[:1] == " " and len(w) > 3 and w[1:].isalpha() and w[1:].islower())


_TOKEN = regex.compile(r"[\p{L}\p{M}'’]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]")


def features(seen: str, a: int, b: int) -> list[str]:
    """What the tagger knows of the words from a to before b: the words around, the ends of the words and their looks, but
    neither the words themselves nor whether they are known names."""
    words = regex.findall(r"[\p{L}\p{M}'’]+\.?", seen[a:b])
    before = _TOKEN.findall(seen, max(0, a - 60), a)[-3:]
    after = _TOKEN.findall(seen, b, b + 60)[:3]
    p = [w.lower() if not w.isdigit() else "0" for w in ["", "", "", *before]][-3:]
    n = [w.lower() if not w.isdigit() else "0" for w in [*after, "", "", ""]][:3]
    start = not before or before[-1] in ".!?:\"“»>-*•\n" or "\n" in seen[max(0, a - 3) : a]
    first, last = words[0] if words else "", words[-1] if words else ""
    low = lambda w: w.lower().strip(".")
    # The ends of a sentence's first word say less, as any word has a capital there.
    at = "s" if start else "m"
    out = [f"p1={p[2]}", f"p2={p[1]} {p[2]}", f"n1={n[0]}", f"n2={n[0]} {n[1]}", f"n3={n[0]} {n[1]} {n[2]}", f"start={start}", f"p,n={p[2]} {n[0]}"]
    out.append(f"around={before[-1][:1].isupper() if before else 0}{after[0][:1].isupper() if after else 0}{at}")
    out += [f"f{k}{at}={low(first)[-k:]}" for k in (1, 2, 3)] + [f"l{k}={low(last)[-k:]}" for k in (1, 2, 3)]
    words_ = ordinary()
    out.append(f"words={low(first) in words_}{low(last) in words_}")
    out.append(f"last={low(last) in words_}")
    out.append(f"first={low(first) in words_}{at}")
    out += [f"caps={seen[a:b].isupper()}{at}", f"len={min(len(first), 8)}{min(len(last), 10)}", f"form={'i' if len(low(first)) == 1 else 'w'}{',' if ',' in seen[a:b] else ' '}{'-' in last}"]
    return out


#: So many of the features, the first ones, are about what stands around.
AROUND = 8


def loud(seen: str, a: int, b: int) -> bool:
    """Whether the words stand in capitals in a text in capitals, where capitals say nothing."""
    return seen[a:b].isupper() and seen[b : b + 12].isupper() and not seen[a:b].split(" ")[0].endswith(".")


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(f.encode()) % BUCKETS for f in names]


@dataclass
class Tagger:
    """Weights of a logistic model over hashed features."""

    weights: np.ndarray
    bias: float

    def sure(self, seen: str, a: int, b: int) -> float:
        """How likely the words are a person's name."""
        z = float(self.weights[hashed(features(seen, a, b))].sum()) + self.bias
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))


def train(rows: Iterable[tuple[list[int], float, float]], rounds: int = 6) -> Tagger:
    """A tagger from (features, is a name, weight) by adaptive gradient steps, in the order of the rows' own hash."""
    data = sorted(((np.array(sorted(set(f))), y, w) for f, y, w in rows), key=lambda r: (zlib.crc32(r[0].tobytes()), r[1], r[2]))
    weights, bias, grown, grown_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-2), 1e-2
    for _ in range(rounds):
        for f, y, w in data:
            z = max(-30.0, min(30.0, weights[f].sum() + bias))
            g = w * (1 / (1 + np.exp(-z)) - y)
            grown[f] += g * g
            grown_bias += g * g
            weights[f] -= 0.3 * (g + 1e-4 * weights[f]) / np.sqrt(grown[f])
            bias -= 0.3 * g / np.sqrt(grown_bias)
    return Tagger(weights.astype(np.float32), float(bias))


# ---- what a tagger starts from ---------------------------------------------------------------------------------------

#: Sentences of ours in which a person's name stands at @, and sentences without one, in which pairs of words have capitals.
CARRIERS = """I met @ at the station yesterday|We spoke to @ about the plan|Yesterday @ came by again|@ told us that it works|According to @ the lift is broken|@ and her sister live upstairs|This was written by @ last week
My neighbour @ has two dogs|The book belongs to @, not to me|@ will call back after lunch|Ask whether @ has the key|On Monday @ moved to the second floor|@ is waiting outside|@ was late again|Then @ left for home|Please tell @ to come in|Her brother @ paid for it
Could @ be reached before noon?|Nobody had seen @ since then|@ has been on leave|@ said no|@ asked for water|@ wrote the letter|I gave it to @ myself|with @ and two others|the son of @ was there|@ does not eat fish|@ arrived at noon|thanks to @ for the help|@ thinks it is fine
Gestern kam @ zu uns|Ich habe mit @ gesprochen|@ wohnt im ersten Stock|@ hat angerufen|Das Buch gehört @ und nicht mir|Wir warten auf @ seit heute früh|@ ist noch nicht da|@ möchte morgen kommen|Laut @ ist alles fertig|Der Bruder von @ zahlt|@ war gestern hier|@ wartet draußen
Hier soir @ est venu nous voir|J'ai parlé avec @ du projet|@ habite au premier étage|@ a téléphoné deux fois|Le livre est à @ depuis longtemps|@ n'est pas encore là|Selon @ tout est prêt|@ attend dehors|Le frère de @ paie|@ viendra demain
Ayer vino @ a vernos|He hablado con @ del plan|@ vive en el primer piso|@ ha llamado dos veces|El libro es de @ desde hace años|@ todavía no ha llegado|Según @ todo está listo|@ espera fuera|El hermano de @ paga|@ vendrá mañana
Вчера пришёл @ к нам|Я говорил с @ о плане|@ живёт на первом этаже|@ звонил два раза|Книга принадлежит @ давно|@ ещё не пришёл|По словам @ всё готово|@ ждёт на улице|@ придёт завтра|Ieri @ è venuto da noi|Ho parlato con @ del piano|@ abita al primo piano|Ontem @ veio nos ver|Falei com @ sobre o plano|@ mora no primeiro andar
@ slept through the storm|@ lies on the beach|@ sits by the window|@ stands at the door|@ lives next to the mill|@ eats at noon|@ drinks tea|@ needs a coat|@ took the early train|@ got the prize|@ feels better now|@ knows the way|@ looks tired|@ was found in the garden|@ was born in spring|@ can see the sea|@ may leave early|@ should rest
@ schläft noch|@ liegt am Strand|@ sitzt am Fenster|@ steht vor der Tür|@ isst um zwölf|@ trinkt Tee|@ braucht einen Mantel|@ nahm den Zug|@ bekam den Preis|@ fühlt sich besser|@ kennt den Weg|@ sieht müde aus|@ wurde im Garten gefunden|@ darf früher gehen|@ soll sich ausruhen|@ hat Hunger|@ ist krank|@ will nach Hause
@ dort encore|@ est assis près de la porte|@ mange à midi|@ boit du thé|@ a besoin d'un manteau|@ a pris le train|@ se sent mieux|@ connaît le chemin|@ semble fatigué|@ était dans le jardin|@ peut partir|@ doit se reposer|@ a faim|@ veut rentrer
@ duerme todavía|@ se sienta junto a la puerta|@ come a mediodía|@ bebe té|@ necesita un abrigo|@ tomó el tren|@ se siente mejor|@ conoce el camino|@ parece cansado|@ estaba en el jardín|@ puede salir|@ debe descansar|@ tiene hambre|@ quiere volver|@ es alto
@ ещё спит|@ лежит на пляже|@ сидит у окна|@ стоит у двери|@ ест в полдень|@ пьёт чай|@ взял билет|@ знает дорогу|@ был в саду|@ может уйти|@ должен отдохнуть|@ хочет домой"""
OTHERS = """The Blue Room is closed today|We went to New Harbor by bus|Her flight to San Lorenzo was late|The North Gate opens at six|Send it to Human Resources first|The Annual Report is out|He reads the Evening Post every day|Install Data Viewer before noon|Press Control Panel and wait|The Red Line runs until midnight
Lake Morrow is frozen|Mount Ellery was in the fog|Room Seven has a window|The Old Mill was sold|Monday Morning is a bad time|Open Settings Menu and choose a colour|The Green Party won|A Golden Gate ticket|The Upper Valley School is full|Please see Table Two and Figure Nine|Take Vitamin Complex twice|The Central Office said no
Order Form A is missing|Next Friday we close|The Second Floor is quiet|He studied at Western College|She works for Silver Foods|The River Park is green|Terms And Conditions apply|Thank You for coming|Good Morning to all|Due Date was Tuesday|Pay Invoice now|Ticket Number is wrong|Case File was lost|New Year is near|Main Street Station is full
Die Blaue Grotte ist zu|Das Rote Kreuz kam|Der Neue Plan gilt|Guten Morgen zusammen|Die Lange Nacht beginnt|Unser Neues Haus steht|Das Große Zimmer ist frei|Der Rechte Flügel ist zu|Die Zweite Etage ist leer|Frohe Ostern an alle|Zur Alten Post gehen|Die Freie Schule sucht Lehrer|Vorgang Nummer fehlt|Alle Befunde sind da|Eine Neue Akte liegt bereit
La Grande Salle est fermée|Le Petit Pont est ancien|Bonne Année à tous|Le Dossier Médical est prêt|La Croix Rouge est venue|Le Nouveau Plan est bon|Salle Bleue au fond|Les Résultats Complets sont là|Ticket Numéro deux|Compte Rendu du lundi|La Gran Sala está cerrada|El Puente Viejo es largo|Buenos Días a todos|La Cruz Roja vino|El Nuevo Plan sirve|Sala Azul al fondo|Los Datos Completos están|Número Total de casos
Красная Площадь закрыта|Новый Год скоро|Большой Зал пуст|Добрый День всем|Нижний Парк зелёный|Второй Этаж свободен|Старый Мост длинный|Карта Номер неверна|La Sala Grande è chiusa|Il Ponte Vecchio è lungo|Buona Sera a tutti|A Sala Grande está fechada|Boa Tarde a todos|O Novo Plano serve"""
#: Ends that the made-up names of the sentences above get, given names and surnames (fixed values), by script.
_ENDS = {
    "Latin": (("a", "ia", "ine", "elle", "ina", "ette", "is", "o", "us", "an", "ert", "rich", "en", "ard", "ya", "iah", "ael", "rick", "ce", "lyn", "as", "i"), ("son", "berg", "mann", "ski", "ez", "elli", "ham", "ton", "wick", "nathan", "czyk", "ova", "sen", "ley", "worth", "ard", "eau", "ini", "stein", "ström", "iani", "oshi", "awa", "feld", "er")),
    "Cyrillic": (("а", "ия", "ина", "ей", "ан", "ил", "ья", "он"), ("ов", "ова", "енко", "ский", "ская", "ин", "ина", "чук", "дзе")),
}
_STEMS = {"Latin": "mar el jo tan bri vero kon ludo phil wil ros an fer dor hal gwe sam ka lin ed".split(), "Cyrillic": "мар ел тан вер кон люд рос ан фед дор гал сам лен".split()}


def _made_up(i: int, script: str) -> str:
    """The i-th made-up name, in one of the forms in which names are written."""
    first, last = _ENDS[script]
    stems = _STEMS[script]
    pick = lambda xs, k: xs[zlib.crc32(f"{i}/{k}".encode()) % len(xs)]
    if i % 2:  # names of any sound, so that no end stands for all of them
        c, v = ("bcdfghjklmnprstvwyz", "aeiou") if script == "Latin" else ("бвгджзклмнпрстфхчш", "аеиоуяю")
        word = lambda k, n: "".join(pick(c if j % 2 == 0 else v, f"{k}.{j}") for j in range(n)).capitalize()
        given, family = word("g", 5 + i % 3), word("f", 6 + i % 5)
    else:
        given, family = _ended(pick, stems, first, last, i)
    initial = pick("ABCDEFGHIKLMNOPRSTVW" if script == "Latin" else "АБВГДЕЗИКЛМНОПРСТ", 5)
    return (f"{given} {family}", f"{given} {family}", f"{given} {initial}. {family}", f"{initial}. {family}", f"{family}, {given}")[i % 5]


def _ended(pick, stems, first, last, i: int) -> tuple[str, str]:
    """A given name and a surname with usual ends."""
    return (pick(stems, 0) + pick(first, 1)).capitalize(), (pick(stems, 2) + pick(stems, 3) * (i % 3 == 0) + pick(last, 4)).capitalize()


def seed_rows(candidates) -> Iterator[tuple[list[int], float, float]]:
    """Labelled candidates of the sentences above. candidates(text) gives the places of what could be names."""
    i = 0
    for carrier in regex.split(r"[|\n]", CARRIERS):
        script = "Cyrillic" if regex.search(r"\p{Cyrillic}", carrier) else "Latin"
        for _ in range(10):
            i += 1
            name = _made_up(i, script)
            text, a = carrier.replace("@", name) + ".", carrier.index("@")
            for x, y in candidates(text):
                if (x, y) == (a, a + len(name)):
                    yield hashed(features(text, x, y)), 1.0, 1.0
                elif y <= a or x >= a + len(name) or x < a:
                    yield hashed(features(text, x, y)), 0.0, 1.0
    for line in regex.split(r"[|\n]", OTHERS):
        for x, y in candidates(line + "."):
            yield hashed(features(line + ".", x, y)), 0.0, 3.0


@functools.cache
def base() -> Tagger:
    """The tagger of the sentences above alone, for texts without a corpus."""
    from .pii import candidates

    return train(seed_rows(candidates))


def learn(rows: list[tuple[list[int], float]], candidates) -> Tagger:
    """A tagger from the seed sentences and from a corpus's candidates (features, has a known given name). Those without one are no
    names, but for unknown names among them: a first model, which only sees what stands around, takes out those that it holds for names."""
    seeds = list(seed_rows(candidates))
    first = train([(f[:AROUND], y, w) for f, y, w in seeds] + [(f[:AROUND], y, 1.0 if y else 0.5) for f, y in rows])
    score = lambda f: first.weights[f[:AROUND]].sum() + first.bias
    return train(seeds + [(f, y, 1.0 if y else 0.5) for f, y in rows if y or score(f) < 0])


def fit(df: DataFrame, text: str, given: frozenset[str], sample: int = SAMPLE_TEXTS) -> Tagger:
    """A tagger from the sentences above and from at most `sample` of the texts, whose candidates with a known given name are
    names (see learn). The model sees neither the words nor the list, so what it learns from the known holds for the unknown.
    The sample's hashed features come to the driver."""
    from .pii import candidates, visible

    ship_package(df.sparkSession)
    chosen = df.select(F.col(f"`{text}`").cast("string").alias("t")).where(F.length("t") > 0).orderBy(F.xxhash64("t"), "t").limit(sample).repartition(8, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[list[int], float]] = []
            for t in b.column(0).to_pylist():
                seen = visible(t)[0]
                for x, y in candidates(seen):
                    words = regex.findall(r"[\p{L}\p{M}'’-]+", seen[x:y])
                    known = any(w.lower() in given for w in (words[:1] if "," not in seen[x:y] else words[1:2]))
                    if (known or len(words[0]) > 1) and not loud(seen, x, y):
                        out.append((hashed(features(seen, x, y)), float(known)))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.list_(pa.int32())), pa.array([y for _, y in out], pa.float64())], ["f", "y"])

    rows = chosen.mapInArrow(run, "f array<int>, y double").collect()
    return learn([(list(r["f"]), r["y"]) for r in rows], candidates)
