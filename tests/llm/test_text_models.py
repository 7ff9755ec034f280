import numpy as np
import pytest

from cadenza.llm import langid, pairs
from cadenza.llm.languages import LANGUAGES, label

VERBS = ["Open the lid", "Fill the jug", "Move the lamp", "Press the button", "Wipe the glass", "Turn the wheel"]
TAILS = ["with one hand", "for 12 seconds", "until the light goes out", "before the bell rings", "toward the door", "and keep your back straight", "by about 5 inches"]
GERMAN = ["Öffne den Deckel", "Fülle den Krug", "Schiebe die Lampe", "Drücke den Schalter", "Drehe das Rad", "Putze das Glas"]
GTAILS = ["mit einer Hand", "zwölf Sekunden lang", "bis das Licht ausgeht", "bevor die Glocke läutet", "in Richtung der Tür", "und halte den Rücken gerade"]


@pytest.fixture(scope="module")
def model():
    sound = [(f"How do I {v.lower()} without help?", f"{v} {t}.") for v in VERBS for t in TAILS for _ in range(3)]
    sound += [(f"Wie geht das: {v.lower()}?", f"{v} {t}.") for v in GERMAN for t in GTAILS for _ in range(3)]
    return pairs.fit(sound)


def test_labels_and_segments():
    assert [label(x) for x in ("EN", "en_GB", "English", "pt-BR", "deu", "??", "", None, "xx", "zh-Hant")] == ["en", "en", "en", "pt", "de", None, None, None, None, "zh"]
    f = langid.seed_field()
    text = "This is the first part of it. Das hier ist aber auf Deutsch geschrieben.\n\n```\nfor x in list: print(x)\n```\n    sudo run -n 3\nhttp://a.example/the/and `Factory Reset`"
    got = [(LANGUAGES[c], text[s:e].strip(), w) for s, e, c, _, w in langid.passages([text], f)[0]]
    assert got == [("en", "This is the first part of it.", True), ("de", "Das hier ist aber auf Deutsch geschrieben.", True)]
    assert langid.passages([None, "", "```\ncode\n```", "\n\n 123 !"], f) == [[], [], [], []]
    assert len(langid.prose(text)) == len(text)


EN, IT = "Please post a picture of the belt so that we can see it.", "Non abbiamo trovato la chiave in nessuno di questi cassetti."
CODE = "select level from t396 group by level\nqueue timed out"


@pytest.mark.parametrize("text, want", [
    (f"<p>```\n{CODE}\n```</p><p>{EN}</p>", ["en"]),
    (f"<p>{EN}</p><p>```\n{CODE}\n```</p><p>{IT}</p><p>```sql\n{CODE}\n```</p><p>{EN}</p>", ["en", "it", "en"]),
    (f"<div class='x'>~~~\n{CODE}\n~~~</div>{IT}<br>{EN}", ["it", "en"]),
    (f"{EN} ```\n{CODE}\n```\n{IT}\n```\n{CODE}\n```\n{EN}", ["en", "it", "en"]),
    (f"{EN}\n```\n{IT}", ["en", "it"]),
    (f"```\n{CODE}\n``` {IT}", ["it"]),
    (f"{EN}<p>```x```<p>{IT}", ["en", "it"]),
])
def test_prose_after_a_fence_is_kept(text, want):
    masked = langid.prose(text)
    assert len(masked) == len(text) and "queue" not in masked and "```" not in masked
    assert [LANGUAGES[c] for _, _, c, _, _ in langid.passages([text], langid.seed_field())[0]] == want


PROSE = [("# Wie man einen guten Kuchen backt", "de"), ("## Comment faire un bon gâteau", "fr"), ("For this recipe you will need:", "en"), ("If you want to know more about this:", "en"),
         ("Er kam, er sah und er siegte;", "de"), ("    Dear Anna, we have been here for two weeks and the weather is fine.", "en"), ("\tHeute war ich wieder lange in der Stadt.", "de"),
         ("Error: der Drucker ist heute leider kaputt", "de"), ("- Non lo so ancora, ma forse domani;", "it"), ("> Ik weet het nog niet, maar misschien morgen:", "nl"), ("# Загадка старого дома", "ru"),
         ("1. Primero hay que abrir la puerta;", "es"), ("# Como fazer um bom bolo em casa", "pt"), ("## 美味しいケーキの作り方", "ja"), ("# 怎么做一个好吃的蛋糕", "zh"), ("while you wait, you can read this {", "en")]
LINES = ["x = read_buf(546)", "// reset the buffer when the queue overflows", "for x in values: print(x)", "sudo run -n 3 | sort -u > out.log", "    return state[356:frame]  # keep the last one", "const a = b.map(x => x + 1);",
         "2024-05-06 07:08:09 INFO server started", "def get(a, b):\n    # keep the last value of it\n    return a", "{\n  \"name\": \"value\",\n}", "$ ./configure --prefix /usr"]


@pytest.mark.parametrize("field", [langid.seed_field, lambda: langid.train([t for t, _ in PROSE[:4]])])
def test_layout_alone_erases_no_prose(field):
    f = field()
    got = [[LANGUAGES[c] for _, _, c, _, w in p if w] for p in langid.passages([t for t, _ in PROSE], f)]
    assert got == [[k] for _, k in PROSE]
    assert [[x[:3] for x in langid.passages([t], f)[0]] for t, _ in PROSE] == [[x[:3] for x in p] for p in langid.passages([t for t, _ in PROSE], f)]
    code = langid.passages(LINES, f)
    assert sum(bool(p) for p in code) == 0, [(t, p) for t, p in zip(LINES, code) if p]


def test_words():
    got = langid.parse(["L'été n’est pas 3D, o'clock' Дом.", "", "ひらカタ漢字漢字漢字々x 第1章", "a_b c/d x@y.z ok"])
    assert got.words == ["L'été", "n’est", "pas", "D", "o'clock", "Дом", "ひら", "カタ", "漢字漢字", "漢字々", "x", "第", "章", "ok"]
    assert got.doc.tolist() == [0] * 6 + [2] * 7 + [3] and [got.text[a:a + len(w)] for a, w in zip(got.start, got.words)] == got.words
    assert langid.parse([]).words == langid.parse(["", " "]).words == []


def test_no_length_changes_what_is_masked():
    for n in (1, 100, 300, 5000):
        assert langid.prose(f"<b {'x' * n}>Das Haus</b> {'y' * n}@z.org /{'p' * n}/q https://{'h' * n} `{'c' * n}`").split() == ["Das", "Haus"]
    assert langid.prose("gut/schlecht und 3.5 Grad, siehe www.a.example/b und HTTP://c.example").split() == ["und", "3.5", "Grad,", "siehe", "und"]


def test_fences_behind_block_tags(spark):
    rows = [(1, f"<p>```\n{CODE}\n```</p><p>{EN}</p>", None), (2, f"<p>```\n{CODE}\n```</p><p>{EN}</p><p>{IT}</p>", "en")]
    got = langid.label_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.seed_field()).collect()
    assert {(r.key, r.lang, r.n_langs) for r in got} == {(1, "en", 1), (2, "en", 2), (2, "it", 2)}


def test_held_out_sentences():
    held = {"en": "We could not find the missing key in any of these drawers.", "de": "Wir haben den fehlenden Schlüssel in keiner Schublade gefunden.", "fr": "Nous n'avons trouvé la clé dans aucun de ces tiroirs.",
            "es": "No encontramos la llave en ninguno de estos cajones.", "pt": "Não encontramos a chave em nenhuma dessas gavetas.", "it": "Non abbiamo trovato la chiave in nessuno di questi cassetti.",
            "nl": "We hebben de sleutel in geen van deze laden gevonden.", "ru": "Мы не нашли ключ ни в одном из этих ящиков.", "zh": "我们在这些抽屉里都没有找到钥匙。", "ja": "引き出しのどこにも鍵は見つかりませんでした。"}
    f = langid.train([])
    hits = [LANGUAGES[langid.passages([t], f)[0][0][2]] == k for k, t in held.items()]
    assert sum(hits) >= 9


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    k = 3
    e, trans, start = rng.normal(size=(1, 4, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    g, pairs_ = langid._forward_backward(e, np.array([4]), trans, start, pairs=True)
    total, want = 0.0, np.zeros((4, k))
    for path in np.ndindex(k, k, k, k):
        w = np.exp(start[path[0]] + sum(e[0, t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(g[0], want / total) and abs(pairs_.sum() - 3) < 1e-9


def test_documents(spark):
    rows = [(1, "The lid of this box is open and I do not know why.", "de", "x"), (2, "The lid of this box is open and I do not know why.", "en-US", "x"), (3, None, None, "x"), (4, "", "en", "x"),
            (5, "The lid of this box is open. Der Deckel von dieser Kiste ist offen und ich weiß nicht warum.", "en", "x"), (6, "word " * 20000, "en", "x"), (None, "text", "en", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")
    got = langid.label_documents(d, langid.seed_field()).collect()
    assert {(r.key, r.lang) for r in got if r.key < 6} == {(1, "en"), (2, "en"), (5, "en"), (5, "de")}
    assert {r.given for r in got if r.key == 1} == {"de"} and all(0 < r.confidence <= 1.000001 for r in got)
    assert langid.label_passages(d.limit(0), langid.seed_field()).count() == 0


def test_held_out_defects(model):
    assert min(model[1].values()) > 0.9, model[1]


def test_defects(model):
    m = model[0]
    q = "How do I fill the jug without help?"
    cases = [("", "empty"), ("N/A", "empty"), ("​", "empty"), ("<|endoftext|>", "empty"), (q, "echo"), ("You asked: " + q, "echo"), (q + " Press the button for 12 seconds.", None),
             ("I'm sorry, but I cannot help with this.", "refusal"), ("Sorry, wrong side, press the button with one hand.", None), ("Drehe das Rad mit einer Hand.", "other_language"),
             ("Press the button until the", "truncated"), ("Press the button (until the", "truncated"), ("Press the button with one hand", None), ("Looks right!", None),
             ("1. Open the lid\n2. Fill the jug\n3.", "truncated"), ("1. Open the lid\n2. Fill the jug\n3. Turn the wheel", None), ("Press the button with one hand («nicht öffnen»).", None)]
    got = m.label([q] * len(cases), [p for p, _ in cases])
    wrong = [(p, w, g) for (p, w), g in zip(cases, got) if w != g]
    assert len(wrong) <= 1, wrong
    assert m.label(["Please answer in German: how do I turn the wheel?"], ["Drehe das Rad mit einer Hand."]) == [None]
    assert m.label([""], ["press " * 20000]) is not None


def test_pairs_of_rows(spark, model):
    ddl = "prediction_id long, conversations array<struct<`from`: string, value: string, timestamp: double, pred: string>>, users string"
    u, a = lambda v, t: ("user", v, t, None), lambda v, t, p: ("assistant", v, t, p)
    rows = [(1, [a("Fill the jug.", 4.0, None), u("late", 5.0), u("first", None), u("second", 3.0), a("Silent", 4.0, "x"), a("ok", 6.0, " Silent "), a(None, 7.0, "x"), a("v", None, "x"), a("v", 1.0, "...")], "c"),
            (2, None, None), (3, [], None), (4, [a("v", 2.0, None)], None)]
    p = pairs.pairs_of(spark.createDataFrame(rows, ddl))
    assert sorted((r.prediction_id, r.at_second, r.question) for r in p.where("question is not null").collect()) == [(1, 1, "first"), (1, 4, "second"), (1, 6, "late")]
    got = {(r.prediction_id, r.at_second): r.defect for r in pairs.label_pairs(p, model[0]).collect()}
    assert got == {(1, 1): "empty", (1, 4): "empty", (1, 6): None, (4, 2): "empty"}
    assert pairs.label_pairs(p.limit(0), model[0]).count() == 0


PROBES = [("Where is Paris and what is it?", "Paris is the capital of France and has two million inhabitants.", None), ("What do mitochondria do?", "The mitochondria produce energy for the cell.", None),
          ("What was signed?", "Der Vertrag wurde nach langen Verhandlungen unterzeichnet.", "other_language"), ("What happened?", "Il contratto è stato firmato dopo lunghe trattative.", "other_language"), ("What?", "TBD", "empty"),
          ("What is it?", "Photosynthesis turns light into sugar.", None), ("Who wrote it?", "Shakespeare wrote Hamlet around 1600.", None), ("How high is it?", "Mount Everest is 8,849 metres high.", None),
          ("Can you help?", "I'm sorry, but I cannot assist with that.", "refusal"), ("Was ist das?", "Die Spree fließt durch Berlin und mündet in die Havel.", None), ("Was ist das?", "The Spree flows through Berlin.", "other_language"),
          ("Explain inflation.", "Inflation means that prices rise over", "truncated"), ("Explain inflation.", "Inflation means that prices rise over time", None), ("Explain inflation.", "n/a", "empty"),
          ("What is the capital of Peru?", "What is the capital of Peru?", "echo"), ("What is the capital of Peru?", "Lima", None), ("What is the capital of Peru?", "Quechua and Spanish are official languages in Peru.", None),
          ("When was it signed?", "The treaty was signed in 1648 after lengthy", "truncated"), ("Who is this man?", "I would prefer not to say who that is.", "refusal"), ("Wie alt ist die Brücke?", "Das kann ich leider nicht beantworten.", "refusal")]


def test_other_wordings(model):
    """Replies in words that no training phrase has."""
    got = model[0].label([q for q, _, _ in PROBES], [p for _, p, _ in PROBES])
    wrong = [(p, d, g) for (_, p, d), g in zip(PROBES, got) if d != g]
    assert len(wrong) <= 2, wrong
    assert not any(g == "refusal" and d is None for _, d, g in wrong)
