"""Text columns: markers, labels, prompts and message templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that appear in stored rows, prompts and messages.
ANONYMOUS_MARKER = "Anonymous feedback: "
SUMMARY_PROMPT_HEAD = (
    "Summarize the following ordered list of employee feedback into 5 bullet points for management to "
    "understand the most pressing concerns and overall sentiment. Consider the importance of each post "
    "based on the weight it received: "
)
SUMMARY_PROMPT_TAIL = (
    ". The feedback includes comments on job satisfaction, workplace environment, management "
    "effectiveness, and suggestions for improvements. Provide a concise summary highlighting key points, "
    "common themes, and any specific issues repeatedly mentioned by employees. Focus on the most pressing "
    "concerns based on weight levels. Do not mention the weight in your summary."
)
QUESTION_PROMPT_HEAD = (
    "Based on the feedback provided this week, ask an open-ended question that encourages further "
    "discussion on these topics. The question should be posed to a large audience. The feedback is a "
    "combination of many people feedback, not just a single person. Phrase your question to the group and "
    "keep it to 1-2 sentences. Do not ask about any specific people that may have been mentioned in your "
    "question. Keep the questions light and fun: "
)
MESSAGE_TEMPLATE = "For the week of %s to %s, the summarized feedback is: %s"
DIGEST_TEMPLATE = "\nHere is the feedback for the week of %s to %s:\n\n*%s Feedback:*\n%s\n      "
DIGEST_SEPARATOR = "\n\n"


def strip_prefix(text: Column, prefix: str = ANONYMOUS_MARKER) -> Column:
    """Remove ``prefix`` once, only at the very start of the text."""
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def add_prefix(text: Column, prefix: str = ANONYMOUS_MARKER) -> Column:
    return F.concat(F.lit(prefix), text)


def weighted_text(text: Column, weight: Column) -> Column:
    """``text (weight: w)``; NULL when either part is NULL."""
    return F.concat(text, F.lit(" (weight: "), weight.cast("string"), F.lit(")"))


def numbered(number: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(". "), text)


def capitalise(text: Column) -> Column:
    """Upper-case the first letter and leave the rest as it is."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def build_prompt(head: str, text: Column, tail: str = "") -> Column:
    return F.concat(F.lit(head), text, F.lit(tail))


def summary_prompt(posts: Column) -> Column:
    return build_prompt(SUMMARY_PROMPT_HEAD, posts, SUMMARY_PROMPT_TAIL)


def question_prompt(posts: Column) -> Column:
    return build_prompt(QUESTION_PROMPT_HEAD, posts)


def anonymity_label(is_bot_post: Column) -> Column:
    return F.when(is_bot_post, "Anonymous").otherwise("With Name")


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z; an empty string can remain at either end."""
    return F.split(F.lower(text), "[^a-z]+")
