"""Extracting an answer from a model response."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.functions.arrays import cumulative, let, let2

INVALID = "[invalid]"


def nth(values: Column, select: int) -> Column:
    """0-based from the start, negative from the end; null if there is none."""
    return F.try_element_at(values, F.lit(select + 1 if select >= 0 else select))


def regex_extract_nth(text: Column, pattern: str, select: int = 0, fallback: str = INVALID) -> Column:
    """The ``select``-th match; with several groups its first non-empty one; else the fallback."""
    groups = re.compile(pattern).groups
    if groups <= 1:
        found = nth(F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)), select)
    else:
        found = F.coalesce(
            *[
                F.nullif(nth(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), select), F.lit(""))
                for g in range(1, groups + 1)
            ]
        )
    return F.coalesce(T.strip(found), F.lit(fallback))


def _quoted_alternatives(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "|")


def multi_choice_extract(
    response: Column,
    choices: Column,
    pattern: str,
    select: int = 0,
    fallback: str = INVALID,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    regexes_to_ignore: tuple[str, ...] = (),
) -> Column:
    """The pattern's match, else the letter of a choice text in the response, else a letter after a colon.

    What ``regexes_to_ignore`` match is removed from choices and response before choices are looked for.
    """

    def tidy(x: Column) -> Column:
        for ignored in regexes_to_ignore:
            x = F.regexp_replace(x, ignored, "")
        if ignore_case:
            x = F.lower(x)
        if ignore_punctuation:
            x = F.regexp_replace(x, r"\p{P}", "")
        return x

    def letter(i: Column) -> Column:
        return F.concat(F.lit("("), F.char(i + 65), F.lit(")"))

    direct = F.nullif(regex_extract_nth(response, pattern, select, ""), F.lit(""))

    def by_text(opts: Column) -> Column:
        found = T.strip(nth(F.regexp_extract_all(tidy(response), _quoted_alternatives(opts), F.lit(0)), select))
        # The last of equal choices wins.
        place = F.array_position(F.reverse(opts), found)
        return F.when(place > 0, letter((F.size(opts) - place).cast("int"))).otherwise(F.nullif(found, F.lit("")))

    by_choice = let(F.transform(choices, lambda c: tidy(T.strip(c))), by_text)
    last = F.char(F.size(choices) + 64)
    after_colon = nth(
        F.regexp_extract_all(response, F.concat(F.lit(r":[\s]*([A-"), last, F.lit("])")), F.lit(1)), select
    )
    return F.coalesce(
        direct, by_choice, F.concat(F.lit("("), after_colon, F.lit(")")), F.lit(fallback)
    )


def map_values(value: Column, mapping: dict, default=None) -> Column:
    """Dictionary lookup with a default."""
    if not mapping:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def regex_map_value(text: Column, mapping: dict[str, str], select: int = 0, fallback: str = INVALID) -> Column:
    """Match any pattern, then give the value of the first pattern that matches the found text."""
    found = T.strip(nth(F.regexp_extract_all(text, F.lit("|".join(mapping)), F.lit(0)), select))
    value = reduce(
        lambda acc, item: acc.when(found.rlike(item[0]), item[1]), mapping.items(), F.when(F.lit(False), "")
    )
    return F.coalesce(F.when(found != "", value), F.lit(fallback))


def extract_code_block(text: Column, language: str = "cpp") -> Column:
    """Body of the last fenced block of a language; the last fence may be missing. Null if there is none."""
    pattern = rf"(?s)```{language}(.*?)(?:```|\z)"
    return T.strip(nth(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), -1))


def complete_code(prompt: Column, response: Column) -> Column:
    """Prompt and response as one program, the response cut at its last fence."""
    body = F.when(
        F.contains(response, F.lit("```")),
        F.substring(response, F.lit(1), F.length(response) - F.length(F.substring_index(response, "```", -1)) - 3),
    ).otherwise(response)
    return F.concat(prompt, body)


def extract_boxed(text: Column) -> Column:
    r"""The last ``\boxed{...}`` or ``\fbox{...}`` with balanced braces, or ``\boxed x`` up to a dollar sign."""

    def balanced(command: str) -> Column:
        tail = F.substring_index(text, command, -1)

        def from_parts(parts: Column) -> Column:
            change = F.transform(parts, lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))

            def closed(depth: Column) -> Column:
                ends = F.filter(
                    F.transform(parts, lambda c, i: F.when((c == "}") & (F.get(depth, i) == 0), i)),
                    lambda i: i.isNotNull(),
                )
                return F.array_join(F.slice(parts, F.lit(1), F.get(ends, F.lit(0)) + 1), "")

            return F.concat(F.lit(command), let(cumulative(change), closed))

        # Single braces and the runs between them: depth changes at few places.
        return let(F.regexp_extract_all(tail, F.lit("[{}]|[^{}]+"), F.lit(0)), from_parts)

    spaced = F.concat(
        F.lit("\\boxed "), F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)
    )
    return (
        F.when(F.contains(text, F.lit("\\boxed ")), spaced)
        .when(F.contains(text, F.lit("\\boxed")), balanced("\\boxed"))
        .when(F.contains(text, F.lit("\\fbox")), balanced("\\fbox"))
    )


def remove_boxed(boxed: Column) -> Column:
    r"""Content of ``\boxed{...}`` or ``\boxed ...``."""
    return F.when(
        boxed.startswith("\\boxed "), F.substring(boxed, F.lit(8), F.length(boxed))
    ).when(
        boxed.startswith("\\boxed{") & boxed.endswith("}"), F.substring(boxed, F.lit(8), F.length(boxed) - 8)
    )


def extract_final_answer(text: Column) -> Column:
    """Text after the fixed final-answer phrase up to the closing sentence, else [invalidanswer]."""
    found = F.regexp_extract_all(
        F.concat(text, F.lit("I hope it is correct.")),
        F.lit("Final Answer: The final answer is(.*?). I hope it is correct."),
        F.lit(1),
    )
    return F.coalesce(T.strip(nth(found, 0)), F.lit("[invalidanswer]"))


def extract_best_answer(text: Column, labels: list[str], numerals: list[str] | None = None) -> Column:
    """First word after the last "the best answer is", letters and digits only, upper case.

    ``numerals`` (for example ``["1", "2"]`` or roman ones) are translated to the labels.
    """
    tail = F.substring_index(F.lower(text), "the best answer is ", -1)
    word = F.split_part(F.split_part(tail, F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(1))
    answer = F.upper(
        F.when(
            F.contains(F.lower(text), F.lit("the best answer is")), F.regexp_replace(word, "[^a-zA-Z0-9]", "")
        ).otherwise(text)
    )
    if numerals:
        return F.coalesce(map_values(answer, dict(zip(numerals, labels))), answer)
    return answer


def clean_control_chars(text: Column) -> Column:
    return T.strip(F.regexp_replace(T.strip(text), r"[\x00-\x1f]", "\n"))


def listed_word_order(response: Column, words: Column) -> Column:
    """The listed words found in the response, by last occurrence, each once."""
    tokens = F.regexp_extract_all(response, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.reverse(F.array_intersect(F.reverse(tokens), words)), " ")


def rfind(text: Column, part: Column) -> Column:
    """0-based start of the last occurrence, -1 if there is none."""
    at = F.position(F.reverse(part), F.reverse(text))
    return F.when(at > 0, F.length(text) - at - F.length(part) + 1).otherwise(F.lit(-1))


def parse_choice_lenient(response: Column, options: Column) -> Column:
    """Letter of the last mentioned option: ``(A)``, then `` A ``, then the option text in long answers; else null."""
    cleaned = reduce(
        lambda r, c: F.regexp_replace(r, rf"^\Q{c}\E+|\Q{c}\E+\z", ""), [",", ".", "!", "?", ";", ":", "'"], response
    )

    def pick(found: Column) -> Column:
        best = F.array_max(F.filter(found, lambda x: x["at"] >= 0))
        return best["letter"]

    def from_text(r: Column) -> Column:
        def mentions(mark) -> Column:
            return F.transform(
                options,
                lambda o, i: F.struct(mark(o, F.char(i + 65)).alias("at"), F.char(i + 65).alias("letter")),
            )

        bracketed = mentions(lambda o, a: rfind(r, F.concat(F.lit("("), a, F.lit(")"))))
        spaced = mentions(lambda o, a: rfind(r, F.concat(F.lit(" "), a, F.lit(" "))))
        by_text = mentions(lambda o, a: rfind(F.lower(r), F.lower(o)))
        return F.coalesce(pick(bracketed), pick(spaced), F.when(F.size(T.words(r)) > 5, pick(by_text)))

    return let(F.concat(F.lit(" "), cleaned, F.lit(" ")), from_text)


NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# Number patterns and the words in front of an answer.
NUMBER_PATTERNS = [
    r"-?\b\d{1,3}(?:,\d{3})+\b",
    r"-?\d+(?:\.\d+)?[eE][+-]?\d+",
    r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])",
]
ANSWER_WORDS = ["could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result "]


def _as_number(x: Column) -> Column:
    plain = F.replace(T.strip(x), F.lit(","), F.lit(""))
    return F.when(plain.rlike(NUMBER), F.round(plain.try_cast("double"), 2))


def _strings_and_numbers(candidates: Column) -> Column:
    """Candidates as lower-case strings (single characters padded on either side) and as numbers."""
    strings = F.filter(candidates, lambda x: _as_number(x).isNull())
    lowered = F.transform(strings, lambda x: F.lower(T.strip(x)))
    padded = F.flatten(
        F.transform(
            lowered,
            lambda x: F.when(
                F.length(x) == 1, F.array(F.concat(F.lit(" "), x), F.concat(x, F.lit(" ")))
            ).otherwise(F.array(x)),
        )
    )
    numbers = F.filter(F.transform(candidates, _as_number), lambda x: x.isNotNull())
    return F.struct(F.array_distinct(padded).alias("strings"), F.array_distinct(numbers).alias("numbers"))


def key_responses(response: Column) -> Column:
    """The tails of the lines that announce an answer; the whole response if no line does."""
    base = F.lower(F.regexp_replace(T.strip(response), r"^\.+|\.+\z", ""))

    def shortest(line: Column, words: list[str]) -> Column:
        tails = F.array(
            *[
                F.when(F.contains(line, F.lit(w)), T.strip(F.substring_index(line, w, -1)))
                for w in words
            ]
        )
        return F.aggregate(
            F.filter(tails, lambda t: t.isNotNull()),
            F.lit(""),
            lambda s, t: F.when((s == "") | (F.length(t) < F.length(s)), t).otherwise(s),
        )

    def from_lines(lines: Column) -> Column:
        found = F.transform(
            lines,
            lambda x, i: F.when(i == F.size(lines) - 1, shortest(x, ANSWER_WORDS + ["="])).otherwise(
                shortest(x, ANSWER_WORDS)
            ),
        )
        kept = F.filter(found, lambda x: ~x.isin("", ":", ",", ".", "!", "?", ";", "'"))
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(base)))

    return let(F.split(base, r"\n"), from_lines)


def parse_open_numbers(response: Column) -> Column:
    """Candidate answers of an open question: struct of ``strings`` and ``numbers`` (rounded to 2)."""

    def expand(keys: Column) -> Column:
        numbers = F.flatten(
            F.transform(
                keys, lambda k: F.concat(*[F.regexp_extract_all(k, F.lit(p), F.lit(0)) for p in NUMBER_PATTERNS])
            )
        )
        return let(F.concat(keys, numbers), _strings_and_numbers)

    return let(key_responses(response), expand)


def match_open(parsed: Column, golds: Column) -> Column:
    """True if a number equals a gold number or a gold text is contained in a candidate."""
    return let2(
        parsed,
        _strings_and_numbers(golds),
        lambda p, g: F.arrays_overlap(p["numbers"], g["numbers"])
        | F.exists(p["strings"], lambda s: F.exists(g["strings"], lambda t: F.contains(s, t))),
    )
