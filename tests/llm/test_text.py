"""The operators for training text against brute force, exact round trips and labelled sentences."""

import os
import random
import unicodedata as U

import pytest
import regex
from pyspark.sql import functions as F

from veilspark.llm import bpe, langid, lookalike, mixing, pii, surrogate

VOCAB = os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)
GIVEN = frozenset({"harriet", "percy", "jörg", "may", "rose", "mark", "прохор", "ramón"})


# ---- look-alikes ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table():
    return lookalike.rewrites(lookalike.lookalike_classes(), {chr(c): 1000 - c for c in range(32, 127)})


def test_same_look(table):
    f = lookalike.rewriter(table)
    same = [("café", "café"), ("ＡＢＣ　１２", "ABC 12"), ("a​b﻿­", "ab"), ("a b c", "a b c"), ("ﬁne ﬂow", "fine flow"), ("Раtіеnt", "Patient"), ("ΑΒΕ", "ABE"), ("µg", "μg"), ("K", "K"), ("é", "е́"), ("e​́", "é"), ("ﬀi", "ffi"), ("ﬃ", "ffi")]
    for a, b in same:
        assert f(a) == f(b), (a, b)
        assert f(f(a)) == f(a)
    apart = [("a", "A"), ("e", "é"), ("2", "²"), ("a b", "a  b"), ("a", "a."), ("a b", "a\nb"), ("l", "1"), ("O", "0"), ("Доза", "Доз"), ("’", "'"), ("и", "й"), ("ø", "o"), ("º", "°"), ("ß", "ss"), ("①", "1")]
    for a, b in apart:
        assert f(a) != f(b), (a, b)


def test_representative_is_the_most_frequent(spark):
    df = spark.createDataFrame([("аааа",), ("a",), (None,), ("",)], "t string")
    t = lookalike.learn(df, "t")
    assert lookalike.rewriter(t)("a") == "а" == lookalike.rewriter(t)("ａ")
    assert [r[0] for r in df.select(lookalike.consistent(df, F.col("t"), t)).collect()] == ["аааа", "а", None, ""]


def test_pairs_against_brute_force(spark, table):
    base = ["Patient A", "Раtіent A", "patient A", "Patient A", "", " ", "​", None, "x​y", "xy", "xy", "хy"]
    rows = [(i, t, "clash") for i, t in enumerate(base)] + [(100 + i, "Patient A", "") for i in range(50)]
    got = lookalike.lookalike_pairs(spark.createDataFrame(rows, "id long, t string, form string"), "id", "t", table).collect()
    f = lookalike.rewriter(table)
    shown = [(i, t) for i, t, _ in rows if t and f(t).strip()]
    expected = {(a, b) for a, s in shown for b, t in shown if a < b and s != t and f(s) == f(t)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


# ---- personal information --------------------------------------------------------------------------------------------------


def kinds(text):
    return [(p.kind, p.text) for p in pii.pieces(text, GIVEN)]


@pytest.mark.parametrize(("text", "expected"), [
    ("mail a.b+c@clinic.example, ops@relay-01, wound@2x.png", [("EMAIL", "a.b+c@clinic.example")]),
    ("at jane at intake dot example dot com or x (at) b.test or y&#64;c.org", [("EMAIL", "jane at intake dot example dot com"), ("EMAIL", "x (at) b.test"), ("EMAIL", "y&#64;c.org")]),
    ("fax +1 916 555 0156, or (212) 555-0141 ext. 5; 0049 (0)30 23125742", [("PHONE", "+1 916 555 0156"), ("PHONE", "(212) 555-0141 ext. 5"), ("PHONE", "0049 (0)30 23125742")]),
    ("+33 1 99 00 62 86 et 01.99.00.51.47; (+34) 910 550 767; 8 (495) 555-86-90", [("PHONE", "+33 1 99 00 62 86"), ("PHONE", "01.99.00.51.47"), ("PHONE", "(+34) 910 550 767"), ("PHONE", "8 (495) 555-86-90")]),
    ("Ticket 10000045, request 010000031, Tracking no. 1991985, 10.105.47.115, 2025-01-02", []),
    ("SSN 260 09 9071. Reading 666-41-2517 and part 345-00-5565, setting 411-62.5994", [("IDENTITY", "260 09 9071")]),
    ("SS# 841205354 but lot 841205354", [("IDENTITY", "841205354")]),
    ("Versicherungsnummer 61 071268 W 782; N° sécu 1 33 05 34 331 229 43; DNI 81883258 S", [("IDENTITY", "61 071268 W 782"), ("IDENTITY", "1 33 05 34 331 229 43"), ("IDENTITY", "81883258 S")]),
    ("national id AB 12 34 56 C", [("IDENTITY", "AB 12 34 56 C")]),
    ("Card 4111 1111 1111 1111 and https://a.example/v/70593?x=1", []),
    ("live at 1476 Old Kiln Rd, Apt 26D, Quillmere, OH 44099 since spring", [("ADDRESS", "1476 Old Kiln Rd, Apt 26D, Quillmere, OH 44099")]),
    ("Rehwinkelstraße 94, 38999 Hesmar; au 28 bis allée de l'Étang-Gris, Drossy; Calle del Molino Hondo, 193", [("ADDRESS", "Rehwinkelstraße 94, 38999 Hesmar"), ("ADDRESS", "28 bis allée de l'Étang-Gris, Drossy"), ("ADDRESS", "Calle del Molino Hondo, 193")]),
    ("ул. Верхняя Заводь, д. 229, кв. 7, г. Тальмск, 999123", [("ADDRESS", "ул. Верхняя Заводь, д. 229, кв. 7, г. Тальмск, 999123")]),
    ("живёт: ул. Верхняя Заводь, г. Тальмск", [("ADDRESS", "ул. Верхняя Заводь, г. Тальмск")]),
    ("at 12 Calle Road Via Roma, 5", [("ADDRESS", "12 Calle Road"), ("ADDRESS", "Via Roma, 5")]),
    ("Mrs. Zareda and Herr Dr. Fennesco-Fennesco; Nurse Harriet Q. Quilholt", [("NAME", "Zareda"), ("NAME", "Fennesco-Fennesco"), ("NAME", "Harriet Q. Quilholt")]),
    ("Emergency contact: Drosingham, Wendell, 212-555-0166.", [("NAME", "Drosingham, Wendell"), ("PHONE", "212-555-0166")]),
    ("Jörg Mornesco liegt in Zimmer 7. Irmhild Brend liegt in Zimmer 5.", [("NAME", "Jörg Mornesco"), ("NAME", "Irmhild Brend")]),
    ("May results come in; Rose bengal stain; mark bed 3 as free; St. Oskar Wing; Pellworth's sign", []),
    ("MAY RESULTS COME IN ON FRIDAY, WILL REVIEW THEN.", []),
    ("[REDACTED_SSN] belongs to [REDACTED_PERSON]", []),
    ("Контакт: Прохор Зарлищев, Доктор Тальмовенко", [("NAME", "Прохор Зарлищев"), ("NAME", "Тальмовенко")]),
])
def test_pieces(text, expected):
    assert kinds(text) == expected


def test_evasions_and_places():
    text = "to ｊａｎｅ@сlіniс.example, M﻿rs. Za​reda"
    found = pii.pieces(text, GIVEN)
    assert [p.kind for p in found] == ["EMAIL", "NAME"]
    assert all(text[p.start : p.end] == p.text for p in found) and found[1].text == "Za​reda"
    assert pii.pieces(None, GIVEN) == pii.pieces("", GIVEN) == pii.pieces(" \n", GIVEN) == []
    assert len(pii.pieces("call 212-555-0166. " * 20_000, GIVEN)) == 20_000


def test_placeholders_keep_the_rest(spark):
    rows = [(1, "😀 é: call 212-555-0166, 212-555-0167!", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x")]
    df = pii.detect(spark.createDataFrame(rows, "id int, t string, text string"), "t", GIVEN)
    got = {r.id: (r.c, [(p.pii_type, p.nth) for p in r.pieces]) for r in df.select("id", "pieces", pii.with_placeholders(F.col("t"), F.col("pieces")).alias("c")).collect()}
    assert got == {1: ("😀 é: call [PHONE], [PHONE]!", [("PHONE", 1), ("PHONE", 2)]), 2: (None, []), 3: ("", []), 4: ("plain", [])}


def test_surrogates(spark):
    texts = ["Mrs. Harriet Zareda, 212-555-0166, h.z@clinic.example", "HARRIET ZAREDA was seen; Zareda, Harriet was seen", "Mrs. Zareda", "+1 (212) 555 0166", "SSN 372-18-5421", None, "", "Пациент Прохор Зарлищев", "live at 1476 Old Kiln Rd, Apt 2"]
    texts += [f"Mrs. Zar{a}{b} was seen" for a in "abcdefghij" for b in ("edo", "eda", "ino")]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    names = spark.createDataFrame([(n,) for n in GIVEN], "given_name string")
    got = {r.id: r.surrogate_text for r in surrogate.with_surrogates(df, "id", "t", names, b"key").collect()}
    again = {r.id: r.surrogate_text for r in surrogate.with_surrogates(df, "id", "t", names, b"key").collect()}
    assert got == again and got[5] is None and got[6] == ""
    first, last = got[0].split(",")[0].split()[1:]
    assert "Harriet" not in got[0] and "Zareda" not in got[0] and got[2] == f"Mrs. {last}"
    assert got[1] == f"{first.upper()} {last.upper()} was seen; {last}, {first} was seen"
    assert got[4].startswith("SSN 9") and got[4][7] == "-" and "@example" not in got[4]
    assert all(U.name(c).startswith("CYRILLIC") for c in got[7] if c.isalpha()) and got[8].startswith("live at ") and "Rd, Apt" in got[8]
    assert len({got[i] for i in range(9, len(texts))}) == len(texts) - 9
    other = {r.id: r.surrogate_text for r in surrogate.with_surrogates(df, "id", "t", names, b"other").collect()}
    assert other[0] != got[0]


def surrogate_texts(spark, texts, key=b"key"):
    names = spark.createDataFrame([(n,) for n in GIVEN], "given_name string")
    got = {r.id: r.surrogate_text for r in surrogate.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", names, key).collect()}
    return [got[i] for i in range(len(texts))]


def test_written_surrogates_differ(spark):
    # 90 addresses of two digits have 300 surrogates at first; 1,000 of one word had 27,648. Every initial is in use.
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiouyrlsz" for c in "bcdfghklmn"]
    mails = [f"{n}@clinic.example" for n in range(10, 100)] + [f"{w}@clinic.example" for w in words]
    texts = [f"mail {m} now" for m in mails] + [f"mail {m.upper()} now" for m in mails[:90]] + [f"Mrs. {c}. Zareda was seen" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZØŁÆ"]
    got = surrogate_texts(spark, texts)
    n = len(mails)
    assert len(set(got[:n])) == n and not {*got[:n]} & {*texts}
    assert [t.casefold() for t in got[n : n + 90]] == [t.casefold() for t in got[:90]]
    assert len(set(got[n + 90 :])) == 29 and not any(a.split()[1] == b.split()[1] for a, b in zip(got[n + 90 :], texts[n + 90 :]))


def test_no_surrogate_is_a_piece_of_the_texts(spark):
    mail = "EMAIL:jane@b.example"
    taken = surrogate.written(mail, "jane@b.example", GIVEN, b"k", 0)
    name = surrogate.written("NAME:s:zareda", "", GIVEN, b"k", 0)
    rows = [(mail, "jane@b.example"), (mail, "JANE (at) b.example"), (taken, taken[6:]), ("NAME:s:zareda", ""), ("NAME:g:" + name[5:], ""), ("NAME:s:other", "")]
    got = surrogate._attempts(spark.createDataFrame(rows, "unit string, form string"), GIVEN, b"k").collect()
    assert sorted(map(tuple, got)) == [(mail, 1), ("NAME:s:zareda", 1)]


def test_collision_rounds_end_without_a_collision_or_fail(spark, monkeypatch):
    # One digit has 30 mail surrogates and a street of one letter 9, all of them real here: these need later attempts.
    mails, streets = [f"7@clinic{n}.example" for n in range(80)], [f"{n} A St" for n in range(1, 10)]
    got = surrogate_texts(spark, [f"mail {m} now" for m in mails] + [f"live at {s}" for s in streets])
    assert len(set(got)) == 80 + len(streets) and all(regex.search(r"@(\w+\.)?example\.(com|net|org) now$", t) for t in got[:80])
    assert len({surrogate.core("NAME:s:zareda", b"k", a) for a in range(60)}) == 60 and len(surrogate.core("NAME:s:zareda", b"k", 30)) >= 28
    monkeypatch.setattr(surrogate, "ROUNDS", 1)
    with pytest.raises(ValueError, match="collide"):
        surrogate._attempts(spark.createDataFrame([("EMAIL:" + m, m) for m in mails], "unit string, form string"), GIVEN, b"k")


# ---- tokens -----------------------------------------------------------------------------------------------------------------


def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
def test_ids_equal_a_public_encoder():
    own, ref = bpe.tokenizer(VOCAB), reference_encoder()
    rnd = random.Random(1)
    texts = ["", " ", "Hello world", "<|endoftext|>", "a" * 3000, "ab" * 700, " \n\t  x", "é😀 क्षि 漢字", "0123456789" * 40, "don't we'll I'VE", "​﻿\x00"]
    alphabet = "abcdeé  \n'12.ßЖ漢😀\t"
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120))) for _ in range(300)]
    for t in texts:
        assert own.encode(t) == ref.encode_ordinary(t), t
        assert b"".join({v: k for k, v in own.ranks.items()}[i] for i in own.encode(t)) == t.encode() if len(t) < 15 else True
    assert own.encode(None) == []


def test_pair_tree_against_a_scan():
    rnd = random.Random(2)
    for n in (1, 2, 3, 7, 16, 33):
        ranks = [rnd.randint(0, 5) for _ in range(n)]
        tree = bpe.PairTree(ranks, 9)
        for _ in range(60):
            i, r = rnd.randrange(n), rnd.choice([None, *range(6)])
            ranks[i] = 9 if r is None else r
            tree.update(i, r)
            best = min(range(n), key=lambda k: (ranks[k], k))
            assert tree.first() == (best if ranks[best] < 9 else -1)


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
def test_corpus_encoding(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = bpe.encode_corpus(df).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]


# ---- mixing -------------------------------------------------------------------------------------------------------------------


TEXTS = "doc_id long, source string, text_key string, tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def brute_mix(rows, targets):
    """One queue, sorted, cut at the budget."""
    share, rep = {}, {}
    for s, w, r in targets:
        s = s.strip().lower()
        share[s], rep[s] = share.get(s, 0) + w, max(rep.get(s, 0), 1 if r is None else r)
    docs = [(d, s.strip().lower(), k, n) for d, s, k, n in rows if s and s.strip().lower() in share]
    budget = sum(n for *_, n in docs)
    one = {}
    for d in sorted(docs):
        if d[3] > 0:
            one.setdefault(d[2], d)
    return budget, share, rep, list(one.values())


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["big", "Big ", "big", "mid", "small", "other", None]), f"k{i % 230}", rnd.randint(0, 40)) for i in range(300)]
    targets = [("big", 0.5, 1), ("MID", 0.3, 3), ("small ", 0.15, 2), ("absent", 0.05, 4)]
    m, s = mixing.mix(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(targets, TARGETS))
    got = sorted(m.collect(), key=lambda r: r.cum_tokens)
    budget, share, rep, units = brute_mix(rows, targets)
    total = 0
    for r in got:
        total += r.tokens
        assert total == r.cum_tokens
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    supply = sum(n * rep[src] for _, src, _, n in units)
    assert total <= budget and (total > budget - 40 or total == supply)
    owner = {d: (src, k) for d, src, k, _ in units}
    uses = {}
    for r in got:
        assert owner[r.doc_id][0] == r.source
        uses[owner[r.doc_id][1]] = uses.get(owner[r.doc_id][1], 0) + 1
        assert uses[owner[r.doc_id][1]] <= rep[r.source]
    shares = {r.source: r for r in s.collect()}
    assert shares["absent"].tokens == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert all(shares[x].tokens == sum(r.tokens for r in got if r.source == x) for x in shares)
    # Finish times are those of each source's own running sum.
    for src in ("big", "mid", "small"):
        run = 0
        for r in [r for r in got if r.source == src]:
            run += r.tokens
            assert abs(r.finish - run / share[src]) < 1e-6


def test_mix_keeps_shares_while_supply_lasts(spark):
    rows = [(i, "ab"[i % 2], f"k{i}", 10) for i in range(400)]
    _, s = mixing.mix(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 5)], TARGETS))
    got = {r.source: r for r in s.collect()}
    assert abs(got["a"].actual_share - 0.25) < 0.01 and abs(got["b"].actual_share - 0.75) < 0.01 and got["b"].max_uses == 2


def test_mix_of_nothing(spark):
    none, some = spark.createDataFrame([], TEXTS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(none, some)[0].count() == 0 and mixing.mix(none, spark.createDataFrame([], TARGETS))[1].count() == 0
    one = spark.createDataFrame([(1, "a", "k", 5), (2, "a", "k", 5), (3, "a", None, 0)], TEXTS)
    assert [r.doc_id for r in mixing.mix(one, some)[0].collect()] == [1]


# ---- languages ------------------------------------------------------------------------------------------------------------------


SENTENCES = {
    "en": ["The wound was dry and closed when the nurse looked at it.", "Please bring a list of all the medicines you are taking."],
    "de": ["Die Wunde war trocken und wurde nicht mehr verbunden.", "Bitte bringen Sie eine Liste Ihrer Medikamente mit."],
    "fr": ["La plaie est fermée et le patient ne se plaint plus.", "Merci de nous faire parvenir la liste avant jeudi."],
    "es": ["La herida está cerrada y el paciente no tiene fiebre.", "Por favor, traiga una lista de sus medicamentos."],
    "pt": ["A ferida está fechada e o doente não tem febre.", "Não há ninguém que possa ver os dados até amanhã."],
    "it": ["La ferita è chiusa e il paziente non ha più la febbre.", "Bisogna portare anche questo elenco delle medicine."],
    "ru": ["Рана закрыта, и у больного больше нет температуры.", "Пожалуйста, принесите список всех лекарств."],
    "nl": ["De wond is droog en er wordt geen verband meer gebruikt.", "Wilt u een lijst van uw medicijnen meebrengen voor het gesprek?"],
    "ca": ["Cal portar aquesta llista dels medicaments abans de la visita.", "La ferida està tancada i el pacient no té febre des de dilluns."],
    "uk": ["Рана закрита, і у хворого більше немає температури.", "Прошу, щоб ви принесли цей список усіх ліків."],
}


def test_held_out_sentences_from_seeds():
    from collections import Counter

    judge = langid.Judge(langid.Profiles.bundle({k: Counter(langid.grams(v)) for k, v in langid.SEEDS.items()}))
    right = [judge.judge(s)[0] == lang for lang, ss in SENTENCES.items() for s in ss]
    assert sum(right) >= 0.9 * len(right)


def test_cosine_is_that_of_the_bundled_vector():
    import numpy as np
    from collections import Counter

    p = langid.Profiles.bundle({k: Counter(langid.grams(v)) for k, v in langid.SEEDS.items()})
    judge, space, text = langid.Judge(p), langid.Space(), "Please bring a list of all medicines."
    v = sum(space.gram(g).astype(np.float32) for g in langid.grams(text))
    exact = p.matrix @ v / np.linalg.norm(v)
    assert np.allclose(judge.cosines(text), exact, atol=0.03) and np.argmax(judge.cosines(text)) == np.argmax(exact)


def test_what_is_a_sentence():
    text = "user: The wound was dry today. BP 120/80 HR 70 T 37.0 SpO2 99%\n2025-05-17T15:59:55Z relay-05 POST /v1/scrub 200 38ms\n> - Bring a list of them!\n-- M. Varnover <a@b.example>\n[REDACTED_PAN] => 427901d93f\nassistant:\n[ ] [x] [ ]\n....\nТhе wоund wаѕ drу."
    assert langid.sentences(text) == ["The wound was dry today.", "Bring a list of them!", "The wound was dry."]
    assert langid.sentences("") == langid.sentences("— — —") == []


def test_documents_labels_and_segments(spark):
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French"), ("es", "spa", "Spanish"), ("ru", "rus", "Russian")], "lang string, iso3 string, english_name string")
    en, de = " ".join(SENTENCES["en"]), " ".join(SENTENCES["de"])
    rows = [(1, en, "en_GB"), (2, en, " ENGLISH "), (3, en, "eng"), (4, en, "de"), (5, en, None), (6, en + "\n" + de, "en"), (7, None, "en"), (8, "", None), (9, "12345 / 77", None), (10, de, "ger"), (11, en, "xx"), (11, en, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("segments", F.lit("clash"))
    judged = langid.identify(docs, codes)
    found = sorted(map(tuple, langid.wrong_or_mixed(judged).collect()))
    assert found == [(4, "en"), (5, "en"), (6, "de"), (6, "en"), (11, "en"), (11, "en")]
    by = {r.doc_id: r for r in judged.collect()}
    assert by[7].lang is None and by[8].langs == [] and by[9].segments == [] and 0 < by[1].confidence <= 1
    assert [(s.lang, s.n_sentences) for s in by[6].segments] == [("en", 2), ("de", 2)]
    assert langid.identify(docs.limit(0), codes).count() == 0


def test_other_languages_are_rejected(spark):
    from collections import Counter

    judge = langid.Judge(langid.Profiles.bundle({k: Counter(langid.grams(v)) for k, v in langid.SEEDS.items()}), reject=True)
    foreign = ["Yara kuruydu ve hemşire baktığında kapalıydı.", "Lütfen kullandığınız tüm ilaçların listesini getirin.", "Såret var torrt och stängt när sjuksköterskan tittade på det.", "Rana była sucha i zamknięta, kiedy pielęgniarka na nią spojrzała.", "Haava oli kuiva ja suljettu kun hoitaja katsoi sitä.", "A seb száraz volt és zárt, amikor az ápolónő megnézte.", "Η πληγή ήταν στεγνή και κλειστή.", "伤口干燥并且已经愈合了。"]
    assert sum(judge.judge(s)[0] == "und" for s in foreign) >= 6
    assert langid.sentences("伤口干燥并且已经愈合了。太短。") == ["伤口干燥并且已经愈合了。太短。"]
    codes = spark.createDataFrame([("en", "eng", "English"), ("tr", "tur", "Turkish"), ("xq", "xqq", "Nowhere")], "lang string, iso3 string, english_name string")
    turkish = ["Yara kuruydu ve hemşire baktığında kapalıydı.", "Lütfen kullandığınız tüm ilaçların listesini yanınızda getirin.", "Hasta bugün çok iyi ve evine gitmek istiyor.", "Doktor yarın sabah yine gelecek ve yaraya bakacak."]
    rows = [(i, turkish[i % 4] + " " + turkish[(i + 1) % 4], "tr") for i in range(40)] + [(100, "Hemşire yarın hastanın ilaçlarını getirecek.", None), (101, foreign[4], "en"), (102, " ".join(SENTENCES["en"]), "en")]
    judged = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), codes).collect()}
    assert judged[100].lang == "tr" and judged[102].lang == "en" and judged[101].lang in ("und", "tr")
    without = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows[40:], "doc_id long, text string, lang string"), codes).collect()}
    assert without[100].lang == "und" and without[100].langs == [] and without[100].confidence == 0.0


def test_sequences_follow_the_more_frequent_form(spark):
    df = spark.createDataFrame([("ﬁ ﬁ ﬁ ﬁ",), ("ﬁx",), ("fix oﬀ off off",)], "t string")
    t = lookalike.learn(df, "t")
    f = lookalike.rewriter(t)
    assert any(len(p) > 1 for p, _ in t.together) and f("fix") == f("ﬁx") == f("ｆix") == "ﬁx" and f("oﬀ") == f("off") == "off"
    assert len({f(x) for x in ("ﬃ", "ﬀi", "fﬁ", "ffi")}) == 1 and all(f(f(x)) == f(x) for x in ("ﬃ", "ﬀi", "fﬁ", "ffi", "fix"))


@pytest.mark.parametrize("pair", (lookalike.GREEK_SMALL + " " + lookalike.CHEROKEE + " " + lookalike.LISU + " " + lookalike.COPTIC_AND_DESERET + " " + lookalike.CYRILLIC + " " + lookalike.GREEK + " " + lookalike.ARMENIAN_AND_OTHERS).split())
def test_every_letter_of_the_tables(table, pair):
    f = lookalike.rewriter(table)
    assert f(pair[0]) == f(pair[1])


def test_groups_hold_the_pairs(spark, table):
    rows = [(i, t) for i, t in enumerate(["Patient A", "Раtіent A", "Pаtient A", "b", "b", None, ""] + ["Patient A"] * 300)]
    df = spark.createDataFrame(rows, "id long, t string")
    groups = lookalike.lookalike_groups(df, "id", "t", table).collect()
    by = {}
    for r in groups:
        by.setdefault(r.class_id, []).append(r)
    pairs = {(a.id, b.id) for rs in by.values() for a in rs for b in rs if a.id < b.id and a.string_id != b.string_id}
    got = [tuple(r) for r in lookalike.lookalike_pairs(df, "id", "t", table).collect()]
    assert len(groups) == 303 and set(got) == pairs and len(got) == len(pairs) == 301 * 2 + 1
