import base64
import random
import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from geoloom.llm import language as L
from geoloom.llm.mail import body, paragraphs, repaired, sentences

# Own sentences, used for fitting and for checking.
WORDS = {
    "en": "the harbour was closed because of strong winds and nobody could leave before noon while we waited for news from them".split(),
    "de": "der Hafen war wegen starker Winde geschlossen und niemand konnte vor Mittag weg während wir auf Nachricht von ihnen gewartet haben".split(),
    "fr": "le port était fermé à cause des vents forts et personne ne pouvait partir avant midi pendant que nous attendions leurs nouvelles".split(),
    "es": "el puerto estaba cerrado por los vientos fuertes y nadie podía salir antes del mediodía mientras esperábamos noticias suyas".split(),
    "sv": "hamnen var stängd på grund av starka vindar och ingen kunde ge sig av före middag medan vi väntade på nyheter från dem".split(),
    "ko": "항구는 강한 바람 때문에 닫혀 있었고 아무도 정오 전에는 떠날 수 없었습니다".split(),
}


def text(rnd, lang, n=3):
    return " ".join(" ".join(rnd.sample(WORDS[lang], 9)).capitalize() + "." for _ in range(n))


def test_labels():
    assert L.label_codes("en-GB") == L.label_codes(" EN ") == L.label_codes("eng") == L.label_codes("English") == {"en"}
    assert L.label_codes("de;en,ko") == {"de", "en", "ko"} and L.label_codes("fre/ger") == {"fr", "de"}
    assert L.label_codes(None) == L.label_codes("?") == L.label_codes("unknown") == L.label_codes("xx") == set()
    assert L.label_codes("da") == {"da"}  # a language, whether or not the corpus has it


def test_names_agree_with_labels(spark):
    labels = ["en-GB", " EN ", "pt_BR", "de;en,ko", "Swedish", None, "", "xx", "nl-BE", "en+it"]
    got = spark.createDataFrame([(x,) for x in labels], "l string").select(L.names(F.col("l"))).collect()
    assert [set(r[0]) for r in got] == [L.label_codes(x) for x in labels]


def test_mail():
    encoded = base64.encodebytes("Één zin hier. Nog een zin.".encode()).decode()
    mail = (
        "From: a@b.example\r\nSubject: x\r\n y\r\nContent-Type: multipart/mixed; boundary=\"q\"\r\n\r\n--q\r\nContent-Type: text/plain; charset=utf-8\r\n"
        f"Content-Transfer-Encoding: base64\r\n\r\n{encoded}\r\n--q\r\nContent-Type: application/x; name=a\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA\r\n--q--\r\n"
    )
    assert paragraphs(mail) == ["Één zin hier. Nog een zin."]
    quoted = "Hello A,\n\nOne here. Two there.\n\nOn Monday, B wrote:\n> Three words here. And\n> some more.\n>> Deeper it goes.\n-- \nTel. +00 12\n0x1 ret=1\n***\nLast words."
    assert [p for p in paragraphs(quoted) if sentences(p)] == ["One here. Two there.", "Three words here. And some more.", "Deeper it goes.", "Last words."]
    assert body("From: a\nTo: b\nContent-Transfer-Encoding: quoted-printable\nContent-Type: text/plain; charset=iso-8859-1\n\nf=FCr=\n dich") == "für dich"
    assert paragraphs("") == paragraphs("  \n ") == [] and body("just: text") == "just: text"
    assert repaired("für à la 한".encode().decode("latin-1")) == "für à la 한" and repaired("für Ä") == "für Ä"
    assert sentences("The set (no. 31537) was sent. It was nr. 5 of all.") == 2 and sentences("Str. 95 Tel. +00 12") == 0


def test_strung_base64_and_deep_parts():
    pieces = [base64.b64encode(x.encode()).decode() for x in ("One sentence he", "re. Two there", ". And three.")]
    assert any(p.endswith("=") for p in pieces[:-1])
    assert body("From: a\nTo: b\nContent-Transfer-Encoding: base64\nContent-Type: text/plain\n\n" + "\n".join(pieces)) == "One sentence here. Two there. And three."
    mail = "Content-Type: text/plain\n\nFound. At last."
    for k in range(1500):
        mail = f"Content-Type: multipart/mixed; boundary=b{k}x\n\n--b{k}x\n{mail}\n--b{k}x--"
    assert body("From: a\nTo: b\n" + mail).strip() == "Found. At last."


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(0, 5, 6)
        offsets = np.append(0, np.cumsum(sizes))
        scores, cost = rng.normal(size=(offsets[-1], 3)) * 2, rng.uniform(0, 3, offsets[-1])
        got = L.viterbi(scores, offsets, cost)
        for a, b in zip(offsets[:-1], offsets[1:]):
            paths = [p for p in np.ndindex(*[3] * (b - a))]
            value = [sum(scores[a + i, s] for i, s in enumerate(p)) - sum(cost[a + i] for i in range(1, b - a) if p[i] != p[i - 1]) for p in paths]
            mine = tuple(got[a:b])
            assert not len(mine) or abs(value[paths.index(mine)] - max(value)) < 1e-9


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        lang = list(WORDS)[i % 6]
        label = {0: "sv", 1: None, 2: lang.upper()}.get(i % 10, lang)  # some wrong, some missing
        rows.append((i, text(rnd, lang) + "\n\n" + text(rnd, "en"), label, 1))
    rows += [(500, None, "en", 1), (501, "", "en", 1), (502, " \n", None, 1), (503, text(rnd, "fr", 1), None, 1), (504, text(rnd, "fr", 4000), "fr", 1), (504, text(rnd, "fr", 2), "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence int")
    return docs, rows, L.segments(docs)


def test_unnamed(found):
    docs, rows, segments = found
    got = {tuple(r) for r in L.unnamed_languages(docs, segments).collect()}
    want = {(i, lang) for i, _, label, _ in rows[:300] for lang in (list(WORDS)[i % 6], "en") if lang not in L.label_codes(label)}
    assert len(got ^ want) <= 0.02 * len(want) and not {i for i, _ in got} & {500, 501, 502, 503}


def test_documents(found):
    docs, _, segments = found
    got = {r.doc_id: r for r in L.document_languages(docs, segments).collect()}
    assert got[500].lang == got[501].lang == got[502].lang == "und" and got[500].confidence == 0
    assert got[503].lang == got[504].lang == "fr" and 0.5 < got[504].confidence <= 1 and len(got) == 305


def test_spans_keep_their_places(spark, found):
    docs, _, _ = found
    rnd = random.Random(4)
    mixed = " ".join(text(rnd, lang, 2) for lang in ("en", "fr", "en", "fr", "en"))
    one = spark.createDataFrame([(1, mixed, "fr"), (1, mixed, "fr")], "doc_id long, text string, lang string")  # stated twice
    spans = L.segments(one, model=L.train(docs.withColumnRenamed("lang", "label")))
    got = sorted({(r.first_word, r.n_words, r.lang) for r in spans.collect()})
    assert [r[2] for r in got] == ["en", "fr", "en", "fr", "en"] and [r[0] for r in got] == [sum(r[1] for r in got[:k]) for k in range(5)]
    assert {r.n_paragraph_words for r in spans.collect()} == {sum(r[1] for r in got)}
    assert {tuple(r) for r in L.unnamed_languages(one, spans).collect()} == {(1, "en")}


def test_other_scripts_and_false_labels(spark, found):
    docs, rows, _ = found
    rnd = random.Random(8)
    wrong = ["es", "de", "fr", "sv", "es", "ko"]
    false = [(2000 + k, text(rnd, wrong[k % 6], 6), "ca", 1) for k in range(12)]  # a label that no text deserves
    more = [(3000, "Порт был закрыт из-за ветра. Никто не мог уехать.", None, 1), (3001, "Το λιμάνι ήταν κλειστό. Κανείς δεν έφυγε.", None, 1)]
    more += [(3002, "みなと は しまっていた。 だれも でられなかった。 まだ まっている。", None, 1)]
    every = spark.createDataFrame([r for r in rows if r[0] != 504] + false + more, docs.schema)
    model = L.train(every.withColumnRenamed("lang", "label"))
    assert model.codes == ("de", "en", "es", "fr", "ko", "sv", "und")
    spans = L.segments(every, model=model)
    got = {r.doc_id: r.lang for r in L.document_languages(every, spans).collect()}
    assert (got[3000], got[3001], got[3002]) == ("und", "el", "ja") and [got[2000 + k] for k in range(12)] == wrong * 2
    assert {tuple(r) for r in L.unnamed_languages(every, spans).where("doc_id >= 3000").collect()} == {(3001, "el"), (3002, "ja")}


def test_one_long_text_among_many():
    k, sizes = 9, np.array([200_000] + [3] * 3000)
    offsets = np.append(0, np.cumsum(sizes))
    scores = np.zeros((offsets[-1], k), np.float32)
    scores[:, 4] = 1
    tracemalloc.start()
    assert (L.viterbi(scores, offsets, np.full(len(scores), 5, np.float32)) == 4).all()
    assert tracemalloc.get_traced_memory()[1] < 40 * len(scores)
    tracemalloc.stop()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "항구는 닫혔습니다. 아무도 없습니다.", None)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in L.unnamed_languages(docs, L.segments(docs)).collect()} == {(1, "ko")}
    assert L.segments(docs.limit(0)).count() == 0
