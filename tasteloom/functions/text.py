"""Title and prompt text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import map_with

# Wording and markers that must match for equal prompts.
ITEM_TOKEN = "<movie_emb>"
CANDIDATE_QUESTION = "Will the user watch this next?"
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"
HISTORY_HEADER = "User Viewing History:"
CANDIDATE_HEADER = "Candidate Movie: "
ARTICLES = ("The", "A", "An")
# Year buckets: 0 unknown, 1 before 1970, 2 the 70s, 3 the 80s, 4 the 90s, 5 from 2000 on.
YEAR_STARTS = (1970, 1980, 1990, 2000)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_year(title) -> Column:
    """The first four digits in parentheses, or null."""
    found = F.regexp_extract(_col(title), r"\(([0-9]{4})\)", 1)
    return F.when(found != "", found.cast("int"))


def year_bucket(title) -> Column:
    year = title_year(title)
    bucket = F.lit(1)
    for start in YEAR_STARTS:
        bucket = bucket + F.when(year >= start, 1).otherwise(0)
    return F.when(year.isNull(), F.lit(0)).otherwise(bucket).cast("int")


def format_title(title) -> Column:
    """Move a trailing article to the front, with or without a year after it."""
    articles = "|".join(ARTICLES)
    text = _col(title).cast("string")
    return F.regexp_replace(text, rf"^(.*), ({articles})( \([0-9]{{4}}\))?$", "$2 $1$3")


def turn(role, text) -> Column:
    return F.concat(F.lit(TURN_OPEN), _col(role), F.lit("\n"), _col(text), F.lit(TURN_CLOSE))


def with_token(title, token: str = ITEM_TOKEN, token_first: bool = True) -> Column:
    t = _col(title)
    return F.concat(F.lit(token + " "), t) if token_first else F.concat(t, F.lit(" " + token))


def candidate_block(title, token: str = ITEM_TOKEN, token_first: bool = True) -> Column:
    return F.concat(with_token(title, token, token_first), F.lit("\n\n" + CANDIDATE_QUESTION))


def candidate_suffix(title, token: str = ITEM_TOKEN, token_first: bool = True) -> Column:
    return F.concat(
        candidate_block(title, token, token_first),
        F.lit(f"{TURN_CLOSE}\n{TURN_OPEN}assistant\n"),
    )


def prompt_prefix(history, system_prompt) -> Column:
    system = system_prompt if isinstance(system_prompt, Column) else F.lit(system_prompt)
    return F.concat(
        turn(F.lit("system"), system),
        F.lit(f"\n{TURN_OPEN}user\n{HISTORY_HEADER}\n"),
        _col(history),
        F.lit(f"\n\n{CANDIDATE_HEADER}"),
    )


def numbered_lines(titles) -> Column:
    return F.array_join(
        F.transform(_col(titles), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)),
        "\n",
    )


def yes_no_score(top_logprobs, unscored: float = -999.0) -> Column:
    """Log-odds of yes against no from ``array<struct<token,logprob>>``.

    Tokens are compared without punctuation and case. Only yes seen: its log-probability. No yes:
    ``unscored``.
    """
    entries = _col(top_logprobs)

    def mass(word: str) -> Column:
        logs = F.transform(
            F.filter(
                entries,
                lambda e: F.lower(F.regexp_replace(e["token"], "[^A-Za-z0-9]", "")) == word,
            ),
            lambda e: e["logprob"].cast("double"),
        )
        top = F.array_max(logs)
        parts = map_with(logs, top, lambda x, m: F.exp(x - m))
        return top + F.log(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))

    yes, no = mass("yes"), mass("no")
    return (
        F.when(yes.isNull(), F.lit(float(unscored)))
        .when(no.isNull(), yes)
        .otherwise(yes - no)
    )


def completion_mask(prompt_len, total_len, bos: bool | Column = False) -> Column:
    """0 for prompt tokens (one more with a BOS token), 1 for the completion."""
    extra = bos.cast("int") if isinstance(bos, Column) else F.lit(int(bos))
    total = _col(total_len).cast("int")
    cut = F.least(_col(prompt_len).cast("int") + extra, total)
    return F.concat(F.array_repeat(F.lit(0), cut), F.array_repeat(F.lit(1), total - cut))
