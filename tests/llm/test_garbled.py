"""Garbled text: bytes and back, decoding under a model, and found documents on planted damage."""

import random

import pytest

from loomlog.llm import garbled as G

CLEAN = [
    "Der Händler prüft die Tür für größere Geräte", "Früher lief das völlig problemlos über Nacht", "J’ai déjà essayé le réservoir à côté", "La señal está débil según mi compañero",
    "Почему кран останавливается через минуту", "Продавец уверял, что деталь подойдёт", "It costs £40 or 12 € — isn’t that naïve?", "Temperature is about 72°C, the gap is 24 µm",
    "NÃO faça isso, SÃO duas tentativas em VÃO", "Type ’ or ‘ as it stands",
]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    return [". ".join(r.choice(CLEAN) for _ in range(6)) for _ in range(400)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return G.frequencies(spark.createDataFrame(list(enumerate(corpus)), "doc_id int, text string"))


def sloppy(text, written, read):
    out = []
    for b in text.encode(written):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_bytes_come_back():
    for enc in ("cp1252", "cp1251", "cp437", "mac_roman", "koi8-r"):
        read = "western" if enc == "cp1252" else enc
        data = list("größer ‘x’ жук".encode("utf-8"))
        text = sloppy("größer ‘x’ жук", "utf-8", enc)
        assert G.to_bytes(text, read) == data
    assert G.to_bytes("a" + G.LOST, "western") == [97, G.WILD]
    assert G.to_bytes("ж", "western") is None


def test_model_is_bounded(model):
    assert len(model.words) <= 1 / G.RARE and "für" in model.words


@pytest.mark.parametrize("written,read,i", [("utf-8", "cp1252", 0), ("utf-8", "cp1252", 2), ("utf-8", "cp1251", 6), ("utf-8", "mac_roman", 3), ("utf-8", "cp437", 1), ("cp1252", "cp1251", 0), ("koi8-r", "cp1251", 4), ("cp1251", "latin-1", 5), ("cp1252", "cp437", 3), ("cp1252", "mac_roman", 2)])
def test_damage_is_undone(model, written, read, i):
    text = CLEAN[i].replace("’", "'").replace("€", "EUR").replace("—", "-") if written != "utf-8" else CLEAN[i]
    bad = sloppy(text, written, read)
    spans, gain = G.Decoder(model).document("Intact words first. " + bad)
    out, at = [], 0
    whole = "Intact words first. " + bad
    for a, b, _, r in spans:
        out += [whole[at:a], r]
        at = b
    assert "".join([*out, whole[at:]]) == "Intact words first. " + text and gain > 0


def test_twice_and_lost(model):
    d = G.Decoder(model)
    bad = sloppy(sloppy(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert [s[3] for s in d.document(bad)[0]] == [w for w in CLEAN[0].split() if not w.isascii()]
    lost = CLEAN[3].encode("cp1252").decode("utf-8", "replace")
    assert [s[3] for s in d.document(lost)[0]] == ["señal", "está", "débil", "según", "compañero"]
    lost = "".join(c if c < "\x80" else G.LOST * len(c.encode()) for c in CLEAN[1])
    assert [s[3] for s in d.document(lost)[0]] == ["Früher", "völlig", "über"]


def test_found(spark, model, corpus):
    bad = sloppy(CLEAN[2], "utf-8", "cp1252")
    rows = [
        (1, CLEAN[0]), (2, bad), (3, "Why do I get `â€™` instead of ’ here?"), (4, "caf=C3=A9 %C3%A9 &eacute; \\u00e9"), (5, None), (6, ""), (7, "gone: " + G.LOST), (8, "x" * 300_000 + " " + bad), (9, "`" + G.LOST + "` on purpose"),
        (2, bad), (10, "NÃO, SÃO Paulo"),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id int, text string, gain string")
    got = sorted(r.doc_id for r in G.find(docs, model=model).collect())
    assert got == [2, 2, 7, 8]
    assert G.find(docs.limit(0), model=model).count() == 0
    assert G.find(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    clean = spark.createDataFrame(list(enumerate(corpus)), "doc_id int, text string")
    assert G.find(clean, model=model).count() == 0


def test_search_is_exact():
    """A letter that is the 17th by its left neighbour can be the best by its right one."""
    import itertools

    letters = [chr(0xE0 + i) for i in range(24)]
    chars = {"^": 100, "q": 50, "z": 5000, **{c: 1000 - 30 * i for i, c in enumerate(letters)}}
    pairs = {"^q": 50, letters[20] + "z": 300, letters[22] + letters[3]: 200, **{"q" + c: 40 - i for i, c in enumerate(letters)}}
    m = G.Model({}, chars, pairs, 0, sum(chars.values()))
    options = [(c, 0.0) for c in letters] + [(G.LOST, -14.0)]
    for slots in ([[("q", 0.0)], options, [("z", 0.0)]], [[("q", 0.0)], options, options, [("z", 0.0)]]):
        def value(way):
            v, p = 0.0, "^"
            for c, extra in way:
                v += extra if c == G.LOST else m.pair(p if p != G.LOST else "^", c)
                p = c
            return v + m.pair(p if p != G.LOST else "^", "$")

        text, got = G._viterbi(slots, G.Decoder(m)._scorer())
        best = max(itertools.product(*slots), key=value)
        assert text == "".join(c for c, _ in best) and abs(got - value(best)) < 1e-9, (text, got, value(best))
    assert G._viterbi([[("q", 0.0)], options, [("z", 0.0)]], G.Decoder(m)._scorer())[0] == "q" + letters[20] + "z"


def test_lost_runs_are_cut_by_the_search():
    """Three lost box characters, an emoji, and marks beside letters: no length is fixed."""
    chars = {"^": 900, "├": 300, "─": 600, "ü": 300, "é": 300, "😀": 300, "“": 300, "”": 300, "f": 100, "r": 100, "ж": 40}
    pairs = {"^├": 300, "├─": 300, "──": 300, "─$": 300, "^😀": 300, "😀$": 300, "^“": 300, "“ü": 250, "ü”": 250, "”$": 300}
    m = G.Model({"éüéü": 30}, chars, pairs, 3000, 4000)
    for text in ("├──", "😀", "“ü”"):
        lost = G.LOST * len(text.encode())
        got = {G.CHANNELS[c]: r for c, _, r in G.Decoder(m).readings(lost)[1]}
        assert got["utf-8", "ascii"] == text, (text, got)


def test_lost_bytes_of_other_written_encodings():
    """Of cp866, cp1252 loses the five bytes that it lacks; a byte can be lost in text written twice as well."""
    chars = {"^": 100, **{c: 100 for c in "привеэт"}}
    way = "^привет$"
    m = G.Model({}, chars, {a + b: 90 for a, b in zip(way, way[1:])} | {"^э": 50, "эт": 50, "т$": 90}, 0, 1200)
    bad = "Эт".encode("cp866").decode("cp1252", "replace")
    assert bad[0] == G.LOST
    got = {G.CHANNELS[c]: r for c, _, r in G.Decoder(m).readings(bad)[1]}
    assert got["cp866", "western"] == "Эт"
    twice = sloppy(sloppy("свет", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert "\x81" in twice
    m = G.Model({}, {"^": 100, **{c: 100 for c in "светпри"}}, {a + b: 90 for a, b in zip("^свет$", "свет$")}, 0, 1200)
    got = {G.CHANNELS[c]: r for c, _, r in G.Decoder(m).readings(twice.replace("\x81", G.LOST))[1]}
    assert got["utf-8 2", "western"] == "свет"
