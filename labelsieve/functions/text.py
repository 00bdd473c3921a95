"""Prompt, token and JSON column functions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.once import once

# What separates tokens. ``\\W`` would cut accented letters.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
PAD = "<pad>"


def present_text(text: Column) -> Column:
    """Missing text is scored as the literal ``nan``."""
    return F.coalesce(text.cast("string"), F.lit("nan"))


def format_prompt(
    text: Column,
    template: str | None = None,
    chat: tuple[str, str] | None = None,
) -> Column:
    """Text as the model sees it.

    A template with ``{text}`` wins, read from left to right as Python's ``format``
    does: ``{{`` and ``}}`` stand for braces, so ``{{text}}`` is no field.
    Next comes ``chat``, the prefix and suffix of one user turn. Without either
    the text stays as it is.
    """
    if template is not None:
        parts: list[Column] = []
        for literal, field, spec, conversion in Formatter().parse(template):
            if literal:
                parts.append(F.lit(literal))
            if field is not None:
                if field != "text" or spec or conversion:
                    raise ValueError(f"a template may only have the field {{text}}, not {field!r}")
                parts.append(text)
        return F.concat(*parts) if parts else F.lit("")
    if chat is not None:
        return F.concat(F.lit(chat[0]), text, F.lit(chat[1]))
    return text


def append_eos(text: Column, eos: str | None) -> Column:
    """End marker on text that does not end with it; nothing without a marker."""
    if not eos:
        return text
    return F.when(text.endswith(eos), text).otherwise(F.concat(text, F.lit(eos)))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def effective_length(requested: int, model_max: int) -> int:
    """Length in force when the model allows less than was asked for."""
    return min(int(requested), int(model_max))


def truncate(toks: Column, max_length: int) -> Column:
    return F.slice(toks, 1, int(max_length))


def is_truncated(toks: Column, max_length: int) -> Column:
    return F.size(toks) > int(max_length)


def cut_text(text: Column, max_length: int) -> Column:
    """The text up to the end of its ``max_length``-th token; all of it if it has fewer."""
    if max_length < 1:
        raise ValueError(f"a text keeps one token at least, got {max_length}")
    # Parts end where tokens end, so each holds one token and the gap before it.
    parts = F.split(text, r"(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])", int(max_length) + 1)
    return F.array_join(F.slice(parts, 1, int(max_length)), "")


def model_text(
    text: Column,
    template: str | None = None,
    chat: tuple[str, str] | None = None,
    eos: str | None = None,
    max_length: int | None = None,
) -> Column:
    """Prompt, end marker, then the cut: what a model is given of a text."""
    marked = append_eos(format_prompt(text, template, chat), eos)
    return marked if max_length is None else cut_text(marked, max_length)


def pad(toks: Column, max_length: int, marker: str = PAD) -> Column:
    """Tokens filled up to ``max_length``."""
    missing = F.greatest(F.lit(0), F.lit(int(max_length)) - F.size(toks))
    return F.concat(toks, F.array_repeat(F.lit(marker), missing))


def attention_mask(toks: Column, max_length: int) -> Column:
    """1 for each real token of a padded row, 0 for each filler."""
    missing = F.greatest(F.lit(0), F.lit(int(max_length)) - F.size(toks))
    return F.concat(F.array_repeat(F.lit(1), F.size(toks)), F.array_repeat(F.lit(0), missing))


def tokenize(
    df: DataFrame,
    text: str,
    max_length: int,
    padding: str | bool = False,
    eos: str | None = None,
    ids: str = "tokens",
    mask: str = "attention_mask",
    words: str | None = None,
) -> DataFrame:
    """Add tokens and their mask: end marker, cut to ``max_length``, optional filling.

    ``words`` names a column that already holds all tokens of the marked text, so that
    it is not cut a second time.
    """
    if padding not in (False, None, "do_not_pad", "max_length"):
        raise ValueError("padding is False or 'max_length'")
    whole = tokens(append_eos(F.col(text), eos)) if words is None else F.col(words)
    df = df.withColumn(ids, truncate(whole, max_length))
    toks = F.col(ids)
    if padding == "max_length":
        return df.withColumns({ids: pad(toks, max_length), mask: attention_mask(toks, max_length)})
    return df.withColumn(mask, F.array_repeat(F.lit(1), F.size(toks)))


def _without_exponent(raw: Column) -> Column:
    """The JVM's ``1.5E-5`` in the usual shortest form."""
    digits = F.regexp_replace(F.substring_index(raw, "E", 1), r"^-|\.0$|\.", "")
    power = F.substring_index(raw, "E", -1).cast("int")
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    whole = F.when(
        F.length(digits) > power + 1,
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)),
    ).otherwise(F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(
        F.length(digits) > 1,
        F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))),
    ).otherwise(digits)
    exponent = F.concat(
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    body = (
        F.when((power >= 0) & (power < 16), whole)
        .when((power < 0) & (power >= -4), small)
        .otherwise(F.concat(mantissa, exponent))
    )
    return F.concat(sign, body)


def decimal_text(number: Column) -> Column:
    """A double the way CSV and JSON writers outside the JVM print it.

    The JVM switches to exponents at 1e7 and below 1e-3; the usual shortest form
    does so at 1e16 and below 1e-4, and writes ``1e-05`` for ``1.0E-5``.
    """
    return once(
        number.cast("string"),
        lambda raw: F.when(raw.contains("E"), _without_exponent(raw))
        .when(raw == "NaN", "nan")
        .otherwise(F.replace(raw, F.lit("Infinity"), F.lit("inf"))),
    )


def number_text(column: Column, dtype_name: str) -> Column:
    """Rating as text: ``2`` for whole-number types, ``2.0`` for fractions."""
    if dtype_name in ("float", "double"):
        return decimal_text(column.cast("double"))
    return column.cast("string")


def json_numbers(values: Column, fractions: bool) -> Column:
    """JSON list of numbers with a space after each comma."""
    text = F.transform(values, lambda v: decimal_text(v) if fractions else v.cast("string"))
    return F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]"))


def json_strings(values: Column) -> Column:
    """JSON list of strings with a space after each comma; other scripts stay readable."""
    quoted = F.transform(values, lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def json_max(text: Column) -> Column:
    """Largest number of a JSON list; null for anything else and for an empty list."""
    return F.array_max(F.from_json(text, "array<double>"))
