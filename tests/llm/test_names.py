"""The tagger of names on sentences, names and other pairs that it wasn't trained on; whole pieces and texts of any length."""

import time

import pytest

from veilspark.llm import names, pii, surrogate

#: Held out: no sentence, and no name, is among those of the module.
WITH = """Dinner with @ is on Thursday|Our teacher @ gave us the map|@ brought flowers for everyone|Sincere thanks go to @ for the music|@ found the dog near the river|I saw @ in the library|@ just finished the report|The tickets are for @ and a friend|A letter from @ came this morning|@ repaired the bicycle
@ speaks three languages|Can @ drive us home?|@ never answered the question|My cousin @ is a baker|Perhaps @ forgot the meeting|Das Fahrrad von @ steht im Hof|@ kocht heute Abend|Ich traf @ am Bahnhof|@ hat den Schlüssel verloren|Wo bleibt @ denn?|@ bringt die Kinder zur Schule|Mit @ kann man reden
J'ai vu @ au marché|@ a perdu sa clé|Le vélo de @ est dans la cour|@ prépare le dîner|Où est @ maintenant?|@ apporte les livres|Vi a @ en el mercado|@ perdió la llave|La bicicleta de @ está en el patio|@ prepara la cena|@ trae los libros|Я видел @ на рынке|@ потерял ключ|@ готовит ужин"""
WITHOUT = """The Grand Hotel is open|Visit Copper Canyon in May|The Silver Coast is windy|Our Summer Party was fun|See Chapter Four for more|The Old Bakery sells bread|Meet at West Bridge at noon|She plays for United Tigers|The High Court ruled today|Green Tea is good|Install Photo Editor first|The Night Train is late|Happy Birthday to all|Black Friday is over|The White Album is old
Use Safe Mode to start|The Big Tree fell|Press Release attached|The Lower House voted|Blue Whale is a film|Das Alte Rathaus ist schön|Der Schwarze Wald ist groß|Die Kleine Oper ist zu|Schöne Ferien wünschen wir|Die Erste Hilfe kam|La Vieille Ville est belle|Le Grand Lac est froid|Bonne Nuit à tous|La Vieja Torre es alta|El Gran Lago es frío|Feliz Año a todos|Старый Город красив|Большой Театр закрыт|Красный Крест помог|Доброе Утро всем"""
PEOPLE = ["Ottoline Ferrars", "Dashiell Vanterpool", "Imogen K. Thackeray", "Q. Featherstone", "Björn Hallqvist", "Takumi Fujiwara", "Zainab Okonkwo", "Ludmilla Petrescu", "Anselm Rotenburg", "Capucine Desrosiers"]
CYRILLIC = ["Зинаида Крутикова", "Ярослав Мельничук", "П. Огородников"]


def held_out():
    i = 0
    for carrier in [c for line in WITH.split("\n") for c in line.split("|")]:
        pool = CYRILLIC if any("а" <= c <= "я" for c in carrier) else PEOPLE
        for _ in range(3):
            i += 1
            name = pool[i % len(pool)]
            yield carrier.replace("@", name) + ".", name
    for text in [c for line in WITHOUT.split("\n") for c in line.split("|")]:
        yield text + ".", None


def test_precision_and_recall_on_held_out_sentences(capsys):
    right = wrong = missed = 0
    for text, name in held_out():
        found = [p.text for p in pii.pieces(text, frozenset()) if p.kind == "NAME"]
        right += name in found
        missed += name is not None and name not in found
        wrong += sum(f != name for f in found)
    precision, recall = right / (right + wrong), right / (right + missed)
    with capsys.disabled():
        print(f"\nnames, held out: precision {precision:.3f}, recall {recall:.3f}, {right + missed} names")
    assert precision >= 0.9 and recall >= 0.9


def test_a_corpus_teaches_its_carriers(spark):
    known = ["Harriet", "Percy", "Jörg", "Ramón"]
    texts = [f"Ward note: {known[i % 4]} Zar{'abcdefgh'[i % 8]}ling qualmt vor Tür {i % 7}." for i in range(200)] + [f"Ward note: Kessel Nord{'abcdefgh'[i % 8]}ling steht unter Druck {i % 7}." for i in range(200)]
    texts += ["Ward note: Wunibald Grünspan qualmt vor Tür 9."] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    tagger = names.fit(df, "t", frozenset(k.lower() for k in known))
    found = lambda t: [p.text for p in pii.pieces(t, frozenset(), tagger)]
    assert found("Ward note: Wunibald Grünspan qualmt vor Tür 3.") == ["Wunibald Grünspan"] and found("Ward note: Kessel Nordbling steht unter Druck 3.") == []
    again = names.fit(df.repartition(3), "t", frozenset(k.lower() for k in known))
    assert (again.weights == tagger.weights).all()
    assert names.fit(df.limit(0), "t", frozenset()).bias == names.base().bias


def test_no_piece_is_cut_short():
    long = "Abcde" * 11
    for text, kind, piece in [
        (f"Mrs. {long} left", "NAME", long), (f"Mrs. {long}-{long}-{long}-{long}-{long} left", "NAME", "-".join([long] * 5)),
        (f"lives at 12 {long} Street now", "ADDRESS", f"12 {long} Street"), (f"wohnt {long}straße 7", "ADDRESS", f"{long}straße 7"),
        (f"to {long.lower() * 2}@{long.lower() * 2}.example now", "EMAIL", f"{long.lower() * 2}@{long.lower() * 2}.example"),
        (f"to a@{'b.' * 40}example now", "EMAIL", f"a@{'b.' * 40}example"),
        ("SSN as it was given to us by the person at the desk this very morning: 841205354", "IDENTITY", "841205354"),
        ("ул. Верхняя Заводь, г. Тальмск", "ADDRESS", "ул. Верхняя Заводь, г. Тальмск"),
    ]:
        assert [(p.kind, p.text) for p in pii.pieces(text, frozenset())] == [(kind, piece)], text
    assert pii.pieces("The SSN is missing. Nine digits follow: 841205354", frozenset()) == []
    assert pii.pieces("ticket                                 212-555-0166", frozenset()) == []


@pytest.mark.parametrize("unit", ["Aa ", "Aa-", "Aa, ", "A. ", "a'", "a.", "a@", "a@b.", "1 ", "1", "SSN ", "12 Aa ", "ул. Аа ", "call 212-555-0166 ", "x%", "Mr. ", "Aa-Bb "])
def test_time_grows_with_the_text(unit):
    began = time.monotonic()
    pii.pieces(unit * 6000, frozenset({"aa"}))
    assert time.monotonic() - began < 20


def test_countries_and_scripts_stay(spark):
    u = lambda kind, p: surrogate.units(kind, p, frozenset())
    assert len({u("PHONE", p)[0] for p in ("+1 212 555 0100", "+7 212 555 0100", "+44 212 555 0100")}) == 3
    assert u("PHONE", "+1 (212) 555-0100") == u("PHONE", "212.555.0100") == u("PHONE", "1 212 555 0100 ext. 4") and u("PHONE", "0049 (0)30 2312") == u("PHONE", "+49 30 2312")
    import unicodedata as U

    for name, script in (("Παπαδόπουλος", "GREEK"), ("王小明", "CJK"), ("Զարեդյան", "ARMENIAN"), ("זראדה", "HEBREW"), ("Зарлищев", "CYRILLIC")):
        new = surrogate.replace("NAME", name, frozenset(), b"k", {})
        assert new != name and all(U.name(c).startswith(script) for c in new), new


def test_distinct_stays_distinct(spark):
    words = [f"{a}{b}{c}{d}" for a in "bcdfghklmnprstvz" for b in "aeiou" for c in "bcdfghklmnprstvz" for d in "aeiouy"][:6000]
    mails = [f"{w}@clinic.example" for w in words]
    people = [f"Mrs. {w.capitalize()}" for w in words]
    df = spark.createDataFrame([(i, f"{p}, {m}") for i, (p, m) in enumerate(zip(people, mails))], "id long, t string")
    given = spark.createDataFrame([("Percy",)], "given_name string")
    rows = surrogate.pseudonymise(df, ["id"], "t", given, b"k").select("pieces").collect()
    for k, least in (("EMAIL", 6000), ("NAME", 5900)):  # some of the made-up words are no names, as Name itself
        got = {p.piece: p.surrogate for r in rows for p in r.pieces if p.pii_type == k}
        assert len(got) >= least and len(set(got.values())) == len(got) and not set(got) & set(got.values())


def test_attempts_beyond_the_plan_are_joined(spark, monkeypatch):
    monkeypatch.setattr(surrogate, "MOST_SHIPPED", 0)
    df = spark.createDataFrame([(i, f"mail {i % 50 + 10}@clinic.example now") for i in range(120)] + [(200, None), (201, "")], "id long, t string")
    given = spark.createDataFrame([("Percy",)], "given_name string")
    by = {r.id: r.surrogate_text for r in surrogate.with_surrogates(df, "id", "t", given, b"k").collect()}
    monkeypatch.undo()
    again = {r.id: r.surrogate_text for r in surrogate.with_surrogates(df, "id", "t", given, b"k").collect()}
    assert by == again and by[200] is None and by[201] == "" and len({by[i] for i in range(50)}) == 50
