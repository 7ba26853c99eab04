import random

import pytest
from pyspark.sql import functions as F

from arcloom.llm import hidden_text, languages, prose, truncation
from arcloom.llm.ecoc import BITS, codebook, fit
from arcloom.llm.extract import content_language, denoted, texts

WORDS = {
    "en": "the report shows which records were changed and who has opened them before the last run of the job",
    "de": "der Bericht zeigt welche Einträge geändert wurden und wer sie vor dem letzten Lauf des Auftrags geöffnet hat",
    "fr": "le rapport montre quels enregistrements ont changé et qui les avait ouverts avant la dernière exécution de la tâche",
    "es": "el informe muestra qué registros han cambiado y quién los había abierto antes de la última ejecución de la tarea",
    "pt": "o relatório mostra quais registros mudaram e quem os tinha aberto antes da última execução da tarefa não",
    "ru": "отчёт показывает какие записи изменились и кто открывал их до последнего запуска задачи",
    "zh": "报告显示哪些记录发生了变化以及在上次运行之前谁打开过它们",
    "ja": "このレポートはどの記録が変わったかと前回の実行までに誰が開いたかを示します",
}


def sentence(lang, rnd):
    if lang in ("zh", "ja"):
        k = rnd.randrange(3)
        return WORDS[lang][k:] + ("。")
    w = WORDS[lang].split()
    k = rnd.randrange(len(w) - 8)
    return " ".join(w[k : k + 8]).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    return [(i, " ".join(sentence(lang, rnd) for _ in range(4)), lang) for i, lang in enumerate(sorted(WORDS) * 30)]


def test_codewords_differ_in_eight_bits():
    c = codebook(8)
    assert c.shape == (8, BITS) and all((c[i] != c[j]).sum() == 8 for i in range(8) for j in range(i))


def test_held_out_accuracy_with_wrong_labels(corpus):
    rnd = random.Random(1)
    train = [(prose.bare(s), lang if rnd.random() > 0.08 else rnd.choice(sorted(WORDS))) for _, t, lang in corpus for s in prose.sentences(t)]
    m = fit([a for a, _ in train], [b for _, b in train], list(prose.LANGS))
    test = [(prose.bare(sentence(lang, rnd)), lang) for lang in WORDS for _ in range(25)]
    best, conf, vague = m.decide([a for a, _ in test])
    assert sum(m.labels[b] == lang for b, (_, lang) in zip(best, test)) / len(test) > 0.97 and (conf > 0).all()


def test_labels():
    for x, want in (("EN", "en"), ("en_US", "en"), (" zh-CN ", "zh"), ("中文", "zh"), ("Deutsch", "de"), ("es-419", "es"), ("jpn", "ja"), ("und", None), ("mul", None), ("", None), (None, None), ("n/a", None), ("xx", None)):
        assert prose.language_of_label(x) == want


def test_wrong_missing_and_mixed_labels(spark, corpus):
    rnd = random.Random(9)
    mixed = sentence("en", rnd) + "\n\n" + sentence("de", rnd)
    extra = [
        (9001, sentence("fr", rnd), None), (9002, sentence("fr", rnd), "English"), (9003, sentence("fr", rnd), "fr-FR"), (9004, mixed, "en"), (9005, None, "en"), (9006, "", None), (9007, "```java\nint x = 1;\n```", None),
        (9008, "12 34\t5.6 🙂", None), (9009, "java.lang.IllegalStateException: x\n\tat a.b.C.d(E.java:1)", "de"), (9010, sentence("ru", rnd) * 3000, "xx"), (9011, sentence("fr", rnd), None),
    ]
    df = spark.createDataFrame(corpus + extra, "doc_id long, text string, lang string").withColumn("segments", F.lit(1)).withColumn("label", F.lit("x"))
    got = {tuple(r) for r in languages.wrong_labels(languages.languages(df)).collect()}
    assert {x for x in got if x[0] >= 9000} == {(9001, "fr"), (9002, "fr"), (9004, "en"), (9004, "de"), (9010, "ru"), (9011, "fr")}
    assert len([x for x in got if x[0] < 9000]) <= 2


def test_without_labels_nothing_is_found(spark):
    df = spark.createDataFrame([(1, "Some words are written here.", None)], "doc_id long, text string, lang string")
    assert languages.wrong_labels(languages.languages(df)).count() == 0
    assert languages.wrong_labels(languages.languages(df.limit(0))).count() == 0


# -- text hidden in code -----------------------------------------------------------------------
def test_extraction_by_content():
    java = 'package a;\n/** Doc text. */\nclass A { String s = "a \\u00e9 // no"; // one\n // two\n char c = \'"\'; /* open'
    assert [t for _, t in texts(java, "java")[1]] == ["Doc text.", "a é // no", "one\ntwo", '"', "open"]
    py = 'def f():\n    """Doc "here" it is."""\n    x = \'#no\'  # yes\n'
    assert [t for _, t in texts(py, "js")[1]] == ['Doc "here" it is.', "#no", "yes"] and texts(py, "js")[0] == "py"
    assert [t for _, t in texts('{"key": "va\\"l", "k2": ["x"]}', "json")[1]] == ['va"l', "x"]
    assert [t for _, t in texts("<a><!-- c1 --><b>text</b><!-- open", "java")[1]] == [" c1 ", " open"]
    js = "'use strict';\nconst r = /[\"'`]/g, t = `a ${x} b`; // c\nfunction f() {}\n"
    assert [t for _, t in texts(js, "js")[1]] == ["use strict", "a   b", "c"]
    assert content_language("", "py") == "py" and texts("", "xml") == ("xml", [])
    assert denoted("a\\n\\x41\\ud83d\\ude00\\") == "a\nA😀\\"


def test_hidden_languages(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    rnd = random.Random(2)
    code = "package a.b;\n\npublic class A {\n    private final List<String> items = new ArrayList<>();\n    %s\n    public int run(int n) { return items.size() + n; }\n}\n"
    bodies = [
        "", "/** " + sentence("de", rnd) + " */", "// " + sentence("fr", rnd) + "\n    // int x = items.size(); return x;", 'String s = "' + sentence("zh", rnd).encode("unicode_escape").decode() + '";',
        'String q = "SELECT id, name, owner FROM item WHERE deleted = 0";', "// items.clear(); return null;", "/* " + sentence("en", rnd) + " */ String t = \"" + sentence("ru", rnd) + '";', "// short text",
    ]
    files = spark.createDataFrame([(i, 1, f"A{i}.java", code % b) for i, b in enumerate(bodies)] + [(50, None, None, "x"), (51, 1, "n.java", None), (52, 1, "q.json", '{"a": "' + sentence("es", rnd) + '"}'), (52, 1, "q.json", '{"a": "' + sentence("es", rnd) + '"}')], "file_id int, repo int, file_path string, file_code string").withColumn("lang", F.lit("zz"))
    got = {(r["file_id"], r["lang"]) for r in hidden_text.texts_of_files(docs, files).select("file_id", "lang").distinct().collect()}
    assert got == {(1, "de"), (2, "fr"), (3, "zh"), (6, "en"), (6, "ru"), (52, "es")}
    assert hidden_text.texts_of_files(docs, files.limit(0)).count() == 0
    assert hidden_text.texts_of_files(docs.limit(0), files).count() >= 0


# -- truncated texts ---------------------------------------------------------------------------
def test_truncation(spark):
    whole = [f"As a clerk, I want to sort the {a} {b} so that nothing has to be searched by hand. Results come from {c}Helper{d} and are kept for a while." for a in ("new", "old", "red", "big") for b in ("maps", "lists", "notes", "plans") for c in ("Fast", "Slow") for d in ("Impl", "Base")]
    heads = [f"Overview of {a} {b}" for a in ("new", "old", "red", "big") for b in ("maps", "lists", "notes", "plans")]
    w = whole[0]
    cases = {
        901: w[: len(w) - 8], 902: w[: w.index("searched") + 4], 903: w[: w.index("nothing")] + "...", 904: w[: w.index("Helper") + 3], 905: w[:30] + "�",
    }
    fine = {801: w[:-1], 802: w + "  ", 803: None, 804: "", 805: "   ", 806: heads[0] + ".", 807: w, 808: "Completely unlike everything else here"}
    rows = [(i, v) for i, v in enumerate(whole + heads)] + list(cases.items()) + list(fine.items()) + [(901, cases[901])]
    df = spark.createDataFrame([("t", i, "f", "l", v, "x") for i, v in rows], "table_name string, row_id int, field_name string, loader string, value string, toks string")
    got = truncation.find_truncated(df)
    assert {r["row_id"] for r in got.where("cut").collect()} == set(cases)
    assert truncation.find_truncated(df.limit(0)).count() == 0


def test_truncation_of_a_very_long_value(spark):
    long = "Every entry is written down at once. " * 4000
    df = spark.createDataFrame([("t", i, "f", "l", long + x) for i, x in enumerate(["Every entry is written down at once.", "Every entry is wri"])] * 1 + [("t", 9, "f", "l", "Every entry is written down at once.")], "table_name string, row_id int, field_name string, loader string, value string")
    assert [r["row_id"] for r in truncation.find_truncated(df).where("cut").collect()] == [1]


def test_evidence_names_a_longer_copy(spark):
    whole = [(i, f"As a clerk, I want to sort the loans number {i}x so that nothing is lost by hand.") for i in range(20)]
    cut = [(100, "As a clerk, I want to sort the loans number 7x so that nothing is lo"), (101, "As a clerk, I want to sort the loans number")]
    df = spark.createDataFrame([("t", i, "f", "l", v) for i, v in whole + cut], "table_name string, row_id int, field_name string, loader string, value string")
    got = {r["row_id"]: r for r in truncation.find_truncated(df).where("cut").collect()}
    assert set(got) == {100, 101} and got[101]["signal"] == "prefix" and got[101]["longer"] >= 20 and got[101]["copy_id"] == 0
    assert got[100]["signal"] in ("prefix", "word")


def test_cut_words_of_any_length(spark):
    long = "x" * 40
    rows = [(0, f"The {long}tail and management here."), (1, f"The other {long}"), (2, "A note on manage"), (3, "A note on zebras"), (4, "A note on m")]
    df = spark.createDataFrame([("t", i, "f", "l", v) for i, v in rows], "table_name string, row_id int, field_name string, loader string, value string")
    got = {r["row_id"]: r["signal"] for r in truncation.find_truncated(df).where("cut").collect()}
    assert got == {1: "word", 2: "word", 4: "word"}
