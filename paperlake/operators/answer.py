"""From ranked papers to contexts, prompts, answers and responses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import paper_url
from .requests import with_status

Completer = Callable[[list[dict[str, str]]], str]

# Fixed value: the prompt around a question and its context.
PROMPT = (
    "Based on the following research paper excerpts, please answer this question: %s\n"
    "\n"
    "Research Context:\n"
    "%s\n"
    "\n"
    "Please provide a comprehensive answer based on the information in these sources."
)

# Fixed value: how a failed model call shows in an answer.
ANSWER_FAILED = "Error details: "


def _in_rank_order(value: Column) -> Column:
    """Values of a question's hits, best first; a question has at most k hits."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("rk"), value.alias("value"))))
    return F.transform(listed, lambda x: x["value"])


def context_part() -> Column:
    """One source of a context: number, title, id, then the text."""
    return F.concat(
        F.format_string(
            "[Source %d: %s (arXiv:%s)]\n", F.col("rk"), F.col("title"), F.col("arxiv_id")
        ),
        F.col("content"),
        F.lit("\n"),
    )


def source_entry() -> Column:
    return F.struct(
        F.col("title").alias("paper_title"),
        F.col("arxiv_id"),
        F.round("similarity", 3).alias("similarity"),
        paper_url(F.col("arxiv_id").cast("string")).alias("url"),
    )


def gather(hits: DataFrame, sep: str = "\n") -> DataFrame:
    """Context, sources and hit count of every question, in one aggregation."""
    return hits.groupBy("qid").agg(
        F.array_join(_in_rank_order(context_part()), sep).alias("context"),
        _in_rank_order(source_entry()).alias("sources"),
        F.count("*").alias("context_chunks"),
    )


def build_context(hits: DataFrame, sep: str = "\n") -> DataFrame:
    """The numbered sources of every question as one text."""
    return gather(hits, sep).select("qid", "context")


def collect_sources(hits: DataFrame) -> DataFrame:
    """What an answer cites, best first, as an array per question."""
    return gather(hits).select("qid", "sources")


def hit_counts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per question, 0 included."""
    counted = hits.groupBy("qid").agg(F.count("*").alias("n"))
    return questions.select("qid").join(counted, "qid", "left").select(
        "qid", F.coalesce("n", F.lit(0)).alias("context_chunks")
    )


def messages(prompt: Column) -> Column:
    """The message list a chat model takes."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def build_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt and messages of every question that has a context.

    ``questions``: qid, query; ``contexts``: qid, context. Other columns of
    ``contexts`` are kept.
    """
    prompt = F.format_string(PROMPT, F.col("query"), F.col("context"))
    joined = questions.select("qid", "query").join(contexts, "qid")
    return joined.withColumn("prompt", prompt).withColumn("messages", messages(F.col("prompt")))


def answer(
    prompts: DataFrame, load_model: Callable[[], Completer], column: str = "messages"
) -> DataFrame:
    """Add the model's ``answer``; a failed call gives ``answer_error`` instead.

    ``load_model`` runs once per task and returns a function of a message list.
    Materialise the result before using it twice, or the model is called twice.
    """

    kind = pa.struct([("answer", pa.string()), ("error", pa.string())])

    @F.arrow_udf("answer string, error string")
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for batch in batches:
            made = []
            for asked in batch:  # one prompt at a time becomes Python's
                try:
                    made.append({"answer": model(asked.as_py()), "error": None})
                except Exception as error:  # whatever the user's model raises
                    made.append({"answer": None, "error": str(error) or type(error).__name__})
            yield pa.array(made, kind)

    return (
        prompts.withColumn("_made", answers.asNondeterministic()(F.col(column)))
        .withColumns({"answer": F.col("_made.answer"), "answer_error": F.col("_made.error")})
        .drop("_made")
    )


def chat_responses(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """One response per question: status, response, sources, context_chunks.

    ``questions``: qid, query, error (null unless the question failed);
    ``answered``: qid, answer, answer_error, sources, context_chunks.
    """
    text = F.coalesce("answer", F.concat(F.lit(ANSWER_FAILED), "answer_error"))
    found = answered.select("qid", text.alias("answer"), "sources", "context_chunks")
    rows = with_status(questions.select("qid", "query", "error").join(found, "qid", "left"), "chat")
    return rows.select(
        "qid",
        "status",
        F.col("message").alias("response"),
        F.coalesce("sources", F.array()).alias("sources"),
        F.coalesce("context_chunks", F.lit(0)).alias("context_chunks"),
    )
