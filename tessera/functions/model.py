"""Figures about models, prompts and caches as Column expressions, and text recovery from model output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import estimated_tokens

#: Prices per thousand tokens, seconds of a call, context windows by family, how a request's window is found.
PRICE_IN, PRICE_OUT = 0.00025, 0.002
BASE_SECONDS, MOST_SECONDS = 2.0, 10.0
FAMILIES = (
    (("gemma3", "gemma-3", "gemma2"), 131072), (("llama3", "llama-3"), 131072), (("deepseek",), 131072), (("phi",), 131072), (("codellama",), 16384), (("mistral", "mixtral"), 32768),
)
SIZED = (("qwen2.5", "qwen-2.5", "qwen3"), ((8, 32768), (14, 65536)), 131072)
DEFAULT_WINDOW = 32768
EFFICIENT_PROMPT_BYTES = 32 * 1024


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1000.0 * PRICE_IN + tokens_out / 1000.0 * PRICE_OUT


def seconds(size: Column) -> Column:
    return BASE_SECONDS + F.least(size / 1000.0, F.lit(MOST_SECONDS))


def context_window(model: Column) -> Column:
    """A family's window; one family goes by the model's size in billions, which stands in its name."""
    low = F.lower(model)
    starts = lambda names: reduce(lambda a, b: a | b, [F.startswith(low, F.lit(n)) for n in names])
    size = F.nullif(F.regexp_extract(low, r"(?:^|[^a-z0-9])([0-9]+)b(?:[^a-z0-9]|$)", 1), F.lit("")).cast("int")
    out = F.when(starts(FAMILIES[0][0]), FAMILIES[0][1])
    for most, window in SIZED[1]:
        out = out.when(starts(SIZED[0]) & (size <= most), window)
    out = out.when(starts(SIZED[0]), SIZED[2])
    for names, window in FAMILIES[1:]:
        out = out.when(starts(names), window)
    return out.otherwise(DEFAULT_WINDOW)


def rounded_up(value: Column, step: int) -> Column:
    return (F.ceil(value / step) * step).cast("long")


def request_window(prompt: Column, cap: Column, output: int = 2048, headroom: int = 512, step: int = 1024, least: int = 4096, chars_per_token: int = 4) -> Column:
    """The window of a request: scaled tokens, output and headroom, rounded up, between the least and the model's cap."""
    wanted = rounded_up(F.ceil(estimated_tokens(prompt) * (4.0 / chars_per_token)) + output + headroom, step)
    low = F.least(F.lit(least), cap)
    return F.greatest(low, F.least(wanted, F.greatest(cap, low))).cast("long")


def retry_delay(base_ms: Column, attempt: Column) -> Column:
    """Doubled with each attempt up to the sixth, at most 15 seconds; no jitter."""
    power = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(6))
    return F.least(F.greatest(base_ms, F.lit(1)) * F.pow(F.lit(2.0), power), F.lit(15000.0)).cast("long")


def normalized(value: Column, least: Column, most: Column) -> Column:
    """Between 0 and 1; 1 where all values are equal."""
    return F.when(F.abs(most - least) <= 2.220446049250313e-16, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - least) / (most - least))))


def recovered_json(text: Column) -> Column:
    """The JSON of a model's answer: as it is, from a code fence, or from the first brace to the last."""
    fence = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    # the parser ignores what follows a value, so the value has to be whole between brackets
    valid = lambda x: F.when(F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>")) == 1, x)
    return F.coalesce(valid(F.trim(text)), valid(fence), valid(braces))


def unwrapped(json: Column) -> Column:
    """What an envelope (result, data or output) holds, else the JSON itself."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in ("result", "data", "output")], json)


def byte_number(text: Column) -> Column:
    """A number or its text, rounded, between 0 and 255; anything else is 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(text.try_cast("double")))), F.lit(0.0)).cast("int")
