"""Verifiable-instruction rules as column expressions.

An instruction is a struct with ``id`` and the optional arguments ``num``,
``relation`` ("less than" or "at least"), ``keywords``, ``text`` and ``nth``.
Language identification is not built: the two case rules test the case only.
Sentences are counted with a regex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.functions.arrays import let
from evalweave.functions.scoring import json_valid
from evalweave.operators.broadcasts import spread

Rule = Callable[[Column, Column], Column]

INSTRUCTION_TYPE = (
    "struct<id:string,num:int,relation:string,keywords:array<string>,text:string,nth:int>"
)

# The answers a constrained response may contain.
CONSTRAINED = ["My answer is yes.", "My answer is no.", "My answer is maybe."]


def count(value: Column, pattern: str | Column) -> Column:
    return F.regexp_count(value, pattern if isinstance(pattern, Column) else F.lit(pattern))


def compare(n: Column, kw: Column) -> Column:
    """less than / at least."""
    return F.when(kw["relation"] == "less than", n < kw["num"]).otherwise(n >= kw["num"])


def blank(x: Column) -> Column:
    return ~x.rlike(T.NOT_WS)


def inner_blank(parts: Column) -> Column:
    """A blank part that is neither the first nor the last."""
    return F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), blank)


# The regular expressions in the rules below.


def placeholders(v: Column, kw: Column) -> Column:
    return count(v, r"(?d)\[.*?\]") >= kw["num"]


def bullets(v: Column, kw: Column) -> Column:
    return count(v, r"(?dm)^\s*\*[^\*].*$") + count(v, r"(?dm)^\s*-.*$") == kw["num"]


def constrained(v: Column, kw: Column) -> Column:
    hit = F.lit(False)
    for option in CONSTRAINED:
        hit = hit | F.contains(v, F.lit(option))
    return hit


def highlights(v: Column, kw: Column) -> Column:
    single = F.regexp_extract_all(v, F.lit(r"\*[^\n\*]*\*"), F.lit(0))
    double = F.regexp_extract_all(v, F.lit(r"\*\*[^\n\*]*\*\*"), F.lit(0))
    n = F.size(F.filter(single, lambda h: ~blank(F.regexp_replace(h, r"^\*+|\*+$", "")))) + F.size(
        F.filter(double, lambda h: ~blank(F.regexp_replace(h, r"^\*\*|\*\*$", "")))
    )
    return n >= kw["num"]


def sections(v: Column, kw: Column) -> Column:
    return count(v, F.concat(F.lit(r"\s?"), kw["text"], F.lit(r"\s?\d+\s?"))) >= kw["num"]


def paragraphs(v: Column, kw: Column) -> Column:
    def check(p: Column) -> Column:
        ends = blank(F.get(p, F.lit(0))).cast("int") + F.when(
            F.size(p) > 1, blank(F.get(p, F.size(p) - 1)).cast("int")
        ).otherwise(0)
        return ~inner_blank(p) & (F.size(p) - ends == kw["num"])

    return let(F.split(v, r"\s?\*\*\*\s?"), check)


def postscript(v: Column, kw: Column) -> Column:
    low = F.lower(v)
    return (
        F.when(kw["text"] == "P.P.S", low.rlike(r"p\.\s?p\.\s?s"))
        .when(kw["text"] == "P.S.", low.rlike(r"p\.\s?s\."))
        .otherwise(F.regexp(low, F.lower(kw["text"])))
    )


def keywords_present(v: Column, kw: Column) -> Column:
    return F.forall(kw["keywords"], lambda k: F.regexp(v, F.concat(F.lit("(?iu)"), k)))


def keyword_frequency(v: Column, kw: Column) -> Column:
    return compare(count(v, F.concat(F.lit("(?iu)"), kw["text"])), kw)


def word_count(v: Column, kw: Column) -> Column:
    return compare(count(v, r"[\p{L}\p{N}_]+"), kw)


def sentence_count(v: Column, kw: Column) -> Column:
    parts = F.split(T.strip(v), r"(?<=[.!?][\"”’]?)\s+")
    return compare(F.size(F.filter(parts, lambda s: ~blank(s))), kw)


def is_json(v: Column, kw: Column) -> Column:
    bare = F.regexp_replace(T.strip(v), r"^```(?:json|Json|JSON)?", "")
    return json_valid(F.regexp_replace(bare, r"```\z", ""))


def nth_paragraph_word(v: Column, kw: Column) -> Column:
    def check(p: Column) -> Column:
        n = F.size(F.filter(p, lambda x: ~blank(x)))
        chosen = T.strip(F.get(p, kw["nth"] - 1))
        first = F.get(T.words(chosen), F.lit(0))
        bare = F.regexp_replace(F.regexp_replace(first, "^'+", ""), '^"+', "")
        word = F.lower(F.regexp_extract(bare, r"^[^.,?!'\"]*", 0))
        return F.coalesce((kw["nth"] <= n) & (chosen != "") & (n == kw["num"]) & (word == kw["text"]), F.lit(False))

    return let(F.split(v, r"\n\n"), check)


def forbidden_words(v: Column, kw: Column) -> Column:
    letter = r"[\p{L}\p{N}_]"
    return ~F.exists(
        kw["keywords"],
        lambda k: F.regexp(v, F.concat(F.lit(f"(?iu)(?<!{letter})(?:"), k, F.lit(f")(?!{letter})"))),
    )


def two_responses(v: Column, kw: Column) -> Column:
    def check(p: Column) -> Column:
        kept = F.filter(p, lambda x: ~blank(x))
        return let(
            kept,
            lambda k: ~inner_blank(p)
            & (F.size(k) == 2)
            & F.coalesce(T.strip(F.get(k, F.lit(0))) != T.strip(F.get(k, F.lit(1))), F.lit(False)),
        )

    return let(F.split(v, r"\*{6}"), check)


def repeat_prompt(v: Column, kw: Column) -> Column:
    return F.startswith(F.lower(T.strip(v)), F.lower(T.strip(kw["text"])))


def end_phrase(v: Column, kw: Column) -> Column:
    bare = F.lower(F.regexp_replace(T.strip(v), r"^\"+|\"+\z", ""))
    return F.endswith(bare, F.lower(T.strip(kw["text"])))


def title(v: Column, kw: Column) -> Column:
    found = F.regexp_extract_all(v, F.lit(r"<<[^\n]+>>"), F.lit(0))
    return F.exists(found, lambda t: ~blank(F.regexp_replace(F.regexp_replace(t, "^<+", ""), ">+$", "")))


def letter_frequency(v: Column, kw: Column) -> Column:
    low = F.lower(v)
    return compare(F.length(low) - F.length(F.replace(low, F.lower(kw["text"]), F.lit(""))), kw)


def all_capitals(v: Column, kw: Column) -> Column:
    return (v == F.upper(v)) & v.rlike(r"\p{Lu}")


def all_lowercase(v: Column, kw: Column) -> Column:
    return (v == F.lower(v)) & v.rlike(r"\p{Ll}")


def no_comma(v: Column, kw: Column) -> Column:
    return ~F.contains(v, F.lit(","))


def capital_words(v: Column, kw: Column) -> Column:
    tokens = F.regexp_extract_all(v, F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))
    return compare(F.size(F.filter(tokens, lambda w: (w == F.upper(w)) & w.rlike(r"\p{Lu}"))), kw)


def quotation(v: Column, kw: Column) -> Column:
    s = T.strip(v)
    return (F.length(s) > 1) & s.startswith('"') & s.endswith('"')


RULES: dict[str, Rule] = {
    "keywords:existence": keywords_present,
    "keywords:frequency": keyword_frequency,
    "keywords:forbidden_words": forbidden_words,
    "keywords:letter_frequency": letter_frequency,
    "length_constraints:number_sentences": sentence_count,
    "length_constraints:number_paragraphs": paragraphs,
    "length_constraints:number_words": word_count,
    "length_constraints:nth_paragraph_first_word": nth_paragraph_word,
    "detectable_content:number_placeholders": placeholders,
    "detectable_content:postscript": postscript,
    "detectable_format:number_bullet_lists": bullets,
    "detectable_format:constrained_response": constrained,
    "detectable_format:number_highlighted_sections": highlights,
    "detectable_format:multiple_sections": sections,
    "detectable_format:json_format": is_json,
    "detectable_format:title": title,
    "combination:two_responses": two_responses,
    "combination:repeat_prompt": repeat_prompt,
    "startend:end_checker": end_phrase,
    "startend:quotation": quotation,
    "change_case:capital_word_frequency": capital_words,
    "change_case:english_capital": all_capitals,
    "change_case:english_lowercase": all_lowercase,
    "punctuation:no_comma": no_comma,
}


def instruction(
    rule: str,
    num: Column | int | None = None,
    relation: str | None = None,
    keywords: list | None = None,
    text: Column | str | None = None,
    nth: int | None = None,
) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    words = F.array(*[lit(k) for k in keywords]) if keywords else F.lit(None)
    return F.struct(
        F.lit(rule).alias("id"),
        lit(num).cast("int").alias("num"),
        F.lit(relation).cast("string").alias("relation"),
        words.cast("array<string>").alias("keywords"),
        lit(text).cast("string").alias("text"),
        F.lit(nth).cast("int").alias("nth"),
    )


def follows(value: Column, kw: Column, rules: list[str] | None = None) -> Column:
    """The rule named by the instruction, on a response that is not blank. Only ``rules`` are compiled in."""
    out = F.lit(None).cast("boolean")
    for name in rules or list(RULES):
        out = F.when(kw["id"] == name, RULES[name](value, kw)).otherwise(out)
    return ~blank(value) & F.coalesce(out, F.lit(False))


def variants(value: Column) -> Column:
    """The response and its relaxed forms: first and/or last line dropped, asterisks dropped."""

    def build(lines: Column) -> Column:
        n = F.size(lines)

        def joined(start: int, drop: int) -> Column:
            return T.strip(F.array_join(F.slice(lines, F.lit(start), F.greatest(n - drop, F.lit(0))), "\n"))

        cut = F.array(value, joined(2, 1), joined(1, 1), joined(2, 2))
        return F.concat(cut, F.transform(cut, lambda x: F.replace(x, F.lit("*"), F.lit(""))))

    return F.array_distinct(let(F.split(value, r"\n"), build))


# Outcome of an instruction: no form of the response seen yet, none follows it so far, a relaxed form does, the response itself does.
UNSEEN, NONE, LOOSE, STRICT = -1, 0, 1, 2


def outcome(forms: Column, kw: Column, rules: list[str] | None = None) -> Column:
    """How the first form (the response as it is) or a later one follows the instruction; null without any form.

    All forms pass through one expression, so each rule is compiled once, and nothing is evaluated behind the first form that follows.
    """

    def step(seen: Column, value: Column) -> Column:
        hit = F.when(seen == UNSEEN, STRICT).otherwise(LOOSE)
        return F.when(seen >= LOOSE, seen).when(follows(value, kw, rules), hit).otherwise(NONE)

    return F.aggregate(forms, F.lit(UNSEEN), step)


def instruction_checks(
    df: DataFrame, keys: list[str], response: str, instructions: str, rules: list[str] | None = None
) -> DataFrame:
    """One row per instruction with its strict and loose outcome; a null response follows nothing."""
    # The variants come before the explode: they are built once per response, not once per instruction.
    relaxed = spread(df, *keys).select(*keys, instructions, variants(F.col(response)).alias("_variants"))
    rows = relaxed.select(*keys, "_variants", F.posexplode(instructions).alias("pos", "kw"))
    found = rows.select(
        *keys, "pos", F.col("kw.id").alias("instruction"), F.coalesce(outcome(F.col("_variants"), F.col("kw"), rules), F.lit(NONE)).alias("_found")
    )
    return found.select(
        *keys, "pos", "instruction", (F.col("_found") == STRICT).alias("strict"), (F.col("_found") >= LOOSE).alias("loose")
    )


def prompt_level(checks: DataFrame, keys: list[str]) -> DataFrame:
    """All instructions of a prompt followed."""
    return checks.groupBy(*keys).agg(F.bool_and("strict").alias("strict"), F.bool_and("loose").alias("loose"))


def inst_level_acc(checks: DataFrame) -> DataFrame:
    """Share of instructions followed, over all prompts."""
    return checks.agg(
        F.avg(F.col("strict").cast("int")).alias("strict"), F.avg(F.col("loose").cast("int")).alias("loose")
    )
