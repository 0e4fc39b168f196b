import itertools

import numpy as np

from paperlake.llm import language
from paperlake.llm.queries import QUERIES


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(5)
    for _ in range(20):
        lengths = draw.integers(0, 6, 4)
        score = draw.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        path = language.viterbi(score, bounds, 0.7)
        value = lambda p, s: sum(s[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            best = max((value(p, score[a:b]) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert abs(value(tuple(path[a:b]), score[a:b]) - best) < 1e-4


def test_held_out_accuracy(spark):
    rows = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = rows.merge(docs, on="doc_id")
    held = held[held.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert held.score.between(0, 1).all()


def test_spans_of_mixed_text(spark):
    docs = spark.createDataFrame(
        [(i, "the cat and the other thing with that " * 30, "en") for i in range(1, 9)]
        + [(i, "кот и другая вещь со всем этим домом " * 30, "ru") for i in range(11, 19)]
        + [(i, "der Hund und die andere Sache mit einem " * 30, "de") for i in range(21, 29)],
        "doc_id long, text string, lang string",
    )
    model = language.train(docs)
    text = "the other thing and the cat with that " * 3 + "und die andere Sache mit einem Hund " * 2 + "и со всем домом"
    lang, share, spans = model.label([text])[0]
    assert lang == "en" and 0.4 < share < 0.7
    assert [name for _, _, name in spans] == ["en", "de", "ru"]
    assert text[spans[1][0] : spans[1][1]].startswith("und die") and spans[-1][1] == len(text)


def test_odd_documents(spark, odd_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == by[5].lang_pred == "und" and by[2].score == 0
    assert all(r.held_out is not None for r in rows)
    assert language.identify(odd_docs.limit(0)).count() == 0
    unlearned = language.with_language(odd_docs, language.Model([], np.zeros((0, 1)), np.zeros((1, 0), bool)))
    assert {r.language.lang for r in unlearned.collect()} == {"und"}


def test_three_hundred_languages(spark):
    """Each with words of its own; labels beyond 256 are told apart."""
    draw = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = {k: ["".join(draw.choice(letters, 8)) for _ in range(6)] for k in range(300)}
    rows = [(k, " ".join(words[k] * 5), f"l{k:03d}") for k in range(300)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = model.label([" ".join(words[k][:4] * 3) for k in range(300)] + [" ".join(words[299] * 3 + words[7] * 3)])
    assert [lang for lang, _, _ in found[:300]] == [f"l{k:03d}" for k in range(300)]
    assert [name for _, _, name in found[300][2]] == ["l299", "l007"]


def test_scripts_leave_out_languages(spark):
    rows = [(1, "the cat and dog " * 20, "en"), (2, "кот и собака дома " * 20, "ru"), (3, "le chat et le chien " * 20, "fr")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    used = {name: model.scripts[language.NAMES.index(name)].tolist() for name in ("latin", "cyrillic", "greek")}
    assert model.names == ["en", "fr", "ru"]
    assert used == {"latin": [True, True, False], "cyrillic": [False, False, True], "greek": [True] * 3}
    # A Cyrillic word is never English, whatever its neighbours.
    _, _, spans = model.label(["the cat and dog кот the dog and cat"])[0]
    assert [name for _, _, name in spans] == ["en", "ru", "en"]
