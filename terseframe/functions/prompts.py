"""Prompt table columns. The texts are fixed values shared with the readers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

INSTRUCTION = (
    "Answer the question using ONLY the provided context. Answer in as few words as possible. "
    "If the answer is not present, respond with exactly: UNKNOWN."
)
ANCHOR_LEAD = (
    "You will be given a long context begin with 'Context:', a question begin with 'Question:', "
    "and a hint begin with 'Hint:'. Please answer the question.\nContext: "
)
HINT_BARE = (
    "If there is no useful information in the context for the question in the context and you really "
    "don't know the answer, just answer none."
)
HINT_HEAD = "You should answer begin with "
HINT_MID = (
    ", if there is no useful information in the context for the question in the context and you really "
    "don't know the answer, just answer "
)
ANSWER_LEAD = "Answer the question based only on the given passages. Keep the answer short.\n\nPassages:\n"
MEMORY_OPEN, MEMORY_CLOSE = "<|memory_start|>", "<|memory_end|>"
MEMORY_ASK = "Using the context above, answer concisely and accurately."


def qa_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{INSTRUCTION}\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def anchor_prompt(context: Column, question: Column, prefix: Column) -> Column:
    p = strip(prefix)
    hint = F.when(p != "", F.concat(F.lit(HINT_HEAD), p, F.lit(HINT_MID), p, F.lit(" none."))).otherwise(HINT_BARE)
    tail = F.when(p != "", F.concat(F.lit("Answer: "), p)).otherwise("Answer:")
    return F.concat(F.lit(ANCHOR_LEAD), context, F.lit("\nHint: "), hint, F.lit("\nQuestion: "), question, F.lit("\n"), tail)


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(ANSWER_LEAD), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def memory_prompt(prompt: Column, context: Column) -> Column:
    """Context inside the memory marks, or a prompt that has them already, or the prompt itself as memory."""
    wrap = lambda c: F.concat(F.lit(MEMORY_OPEN), c, F.lit(f"{MEMORY_CLOSE}\n\n"))
    return (
        F.when(F.coalesce(context, F.lit("")) != "", F.concat(wrap(context), prompt))
        .when(prompt.contains(MEMORY_OPEN), prompt)
        .otherwise(F.concat(wrap(prompt), F.lit(MEMORY_ASK)))
    )


def assemble(*parts: Column) -> Column:
    """Non-blank parts separated by a blank line."""
    return F.concat_ws("\n\n", *[F.nullif(strip(p), F.lit("")) for p in parts])


def chat_turn(context: Column, question: Column) -> Column:
    q = strip(F.coalesce(question, F.lit("")))
    return F.when(q != "", F.concat(context, F.lit("\n\nQuestion: "), q)).otherwise(context)
