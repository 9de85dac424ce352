"""What a provider's response says, and which of its attempts a generation ends with. Calls are made elsewhere; these decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thinking tokens of the second attempt, least tokens of the third, seconds that an attempt needs at least and that all may take.
SMALL_THINKING, LEAST_TOKENS, LEAST_SECONDS, MOST_SECONDS = 128, 2048, 5, 100
#: Fixed value: thinking as told where an attempt is sent without.
WITHOUT_THINKING = -2


def reply(body: str | Column) -> Column:
    """A generation's response as (outcome, text, finish, truncated, prompt_tokens, thought_tokens, output_tokens, total_tokens).

    outcome: ok; blocked where the prompt was refused or the model stopped for a reason other than its end or the limit of
    tokens; truncated where the limit left no text; parse for what holds no text otherwise. A text cut at the limit is a
    text. Tokens that aren't told are 0; a null or broken body is parse.
    """
    found = F.try_parse_json(F.col(body) if isinstance(body, str) else body)
    text_of = lambda path: F.try_variant_get(found, path, "string")
    tokens = lambda name: F.coalesce(F.try_variant_get(found, f"$.usageMetadata.{name}", "long"), F.lit(0))
    finish = F.coalesce(text_of("$.candidates[0].finishReason"), F.lit(""))
    refused, text = text_of("$.promptFeedback.blockReason"), text_of("$.candidates[0].content.parts[0].text")
    outcome = (
        F.when(refused.isNotNull() | ~finish.isin("", "STOP", "MAX_TOKENS"), "blocked")
        .when(text.isNotNull(), "ok").when(finish == "MAX_TOKENS", "truncated").otherwise("parse")
    )
    return F.struct(
        outcome.alias("outcome"), F.when(outcome == "ok", text).alias("text"), finish.alias("finish"), (finish == "MAX_TOKENS").alias("truncated"),
        tokens("promptTokenCount").alias("prompt_tokens"), tokens("thoughtsTokenCount").alias("thought_tokens"), tokens("candidatesTokenCount").alias("output_tokens"), tokens("totalTokenCount").alias("total_tokens"),
    )


def attempts(rows: DataFrame) -> DataFrame:
    """rows(statuses, seconds, thinking, max_tokens) with `sent` attempts of up to three, the `status` that the generation
    ends with, and `thinking_sent` and `tokens_sent` of the last.

    statuses and seconds are what each attempt would get and take. A second attempt with little thinking follows a 400 if
    thinking was asked for, a third without thinking and with more tokens follows another; each only if enough of the
    time for all is left. A missing status is a failed connection, 0, and ends it.
    """
    status = lambda k: F.coalesce(F.get("statuses", F.lit(k)), F.lit(0))
    spent = lambda k: F.aggregate(F.slice("seconds", 1, k), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    more = lambda k: (status(k - 1) == 400) & (F.lit(float(MOST_SECONDS)) - spent(k) >= LEAST_SECONDS)
    second = F.coalesce(F.col("thinking").isNotNull() & more(1), F.lit(False))
    third = F.coalesce(second & more(2), F.lit(False))
    sent = F.when(third, 3).when(second, 2).otherwise(1)
    return rows.select(
        "*", sent.alias("sent"), F.when(third, status(2)).when(second, status(1)).otherwise(status(0)).alias("status"),
        F.when(third, WITHOUT_THINKING).when(second, SMALL_THINKING).otherwise(F.col("thinking")).alias("thinking_sent"),
        F.when(third, F.greatest(F.coalesce("max_tokens", F.lit(0)), F.lit(LEAST_TOKENS))).otherwise(F.col("max_tokens")).alias("tokens_sent"),
    )


def verified(status: Column, message: Column) -> Column:
    """A key's check as (ok, message): 200 is good; else the provider's message, or the status where it gives none."""
    ok = F.coalesce(status == 200, F.lit(False))
    told = F.when(F.coalesce(F.trim(message), F.lit("")) != "", message).otherwise(F.concat(F.lit("HTTP "), F.coalesce(status, F.lit(0))))
    return F.struct(ok.alias("ok"), F.when(~ok, told).otherwise(F.lit("")).alias("message"))
