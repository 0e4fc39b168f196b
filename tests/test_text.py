import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperlake import functions as fn


def one(spark, value, build, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(build(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text",
    ["x-ray of they're 3d GANs", "", "été À l'école", "ßlich straße", "a1b c_d", "ΣΑΣ σας", "中a b"],
)
def test_title_case_is_that_of_python(spark, text):
    assert one(spark, text, fn.title_case) == text.title()


@pytest.mark.parametrize(
    "text", ["  a\n b  c\n", "  a ", "\x1fa\x1c", "", "\n\n", "a\r\nb", " a​ "]
)
def test_clean_text_strips_then_replaces_newlines(spark, text):
    assert one(spark, text, fn.clean_text) == text.strip().replace("\n", " ")


def test_runs_of_spaces_stay(spark):
    assert one(spark, "a   b\n\nc", fn.clean_text) == "a   b  c"


@pytest.mark.parametrize(
    "url, id_, base",
    [
        ("http://arxiv.org/abs/2301.00001v1", "2301.00001v1", "2301.00001"),
        ("http://arxiv.org/abs/2301.00001v12", "2301.00001v12", "2301.00001"),
        ("http://arxiv.org/abs/hep-th/9901001v2", "9901001v2", "9901001"),
        ("plain", "plain", "plain"),
        (None, None, None),
    ],
)
def test_paper_id_keeps_the_version(spark, url, id_, base):
    assert one(spark, url, fn.paper_id) == id_
    assert one(spark, url, fn.base_id) == base


@pytest.mark.parametrize(
    "text, date",
    [
        ("2023-01-05T10:00:00Z", dt.date(2023, 1, 5)),
        ("2023-13-05T10:00:00Z", None),
        ("unknown", None),
        ("2023", None),
        (None, None),
    ],
)
def test_published_date(spark, text, date):
    assert one(spark, text, fn.published_date) == date


def test_names_and_categories(spark):
    people = "array<struct<name:string>>"
    terms = "array<struct<_term:string>>"
    assert one(spark, [(" A B ",), (None,), ("C",)], fn.join_authors, people) == "A B; C"
    assert one(spark, None, fn.join_authors, people) == ""
    assert one(spark, [("cs.AI",), ("",), (None,), ("x",)], fn.join_categories, terms) == "cs.AI, x"
    assert one(spark, None, fn.join_categories, terms) == ""


def test_similarity_is_not_the_distance(spark):
    assert one(spark, 0.1, fn.similarity_pct, "double") == "90.0%"
    assert one(spark, 1.25, fn.similarity_pct, "double") == "-25.0%"


def test_paper_url(spark):
    assert one(spark, "2301.1v1", fn.paper_url) == "https://arxiv.org/abs/2301.1v1"


def test_model_replies(spark):
    good = '{"choices": [{"message": {"role": "assistant", "content": "yes"}}]}'
    assert one(spark, good, fn.chat_reply) == "yes"
    for bad in ['{"choices": []}', "{}", "not json", None]:
        assert one(spark, bad, fn.chat_reply) is None
    assert one(spark, '{"embedding": [1, 2.5]}', fn.embedding_reply) == [1.0, 2.5]
    assert one(spark, '{"other": 1}', fn.embedding_reply) is None


def test_registered_names(spark):
    fn.register_functions(spark)
    row = spark.sql(
        "SELECT title_case('x-ray') AS t, vector_dot(array(1f, 2f), array(3f, 4f)) AS d,"
        " vector_norm(array(3f, 4f)) AS n, cosine_distance(array(1f, 0f), array(0f, 2f)) AS c,"
        " cosine_distance(array(0f, 0f), array(0f, 2f)) AS z"
    ).first()
    assert tuple(row) == ("X-Ray", 11.0, 5.0, 1.0, None)
