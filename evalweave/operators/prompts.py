"""Prompt text for evaluation requests and training rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators.ranks import seeded_number

# Fixed value: the instruction in front of a competitive-programming problem.
CODE_INSTRUCTION = """You are a competitive programming tutor tasked with solving a competitive programming problem.
(1) Please reason step by step about your solution approach, then provide a optimal algorithmic implementation in C++17 that is thoroughly optimized for both speed and memory usage.
(2) Your approach must use the data structures needed to process the largest possible test cases within the time and memory limits.
(3) Cleanly name functions and variables and specify all imports at top.
(4) Your solution must read input from standard input (cin), write output to standard output (cout) following the input and output format provided.
(5) Do not include any debug prints or additional output and do not memorize answers.
(6) Put your final solution within a single code block:
```cpp
<your code here>
```
## Problem
    """

# Option markers by position.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]


def decontamination_query(df: DataFrame, setting: str | None, prompt: str) -> Column:
    """Text checked for contamination: a column name, a template, or by default the prompt column."""
    if setting is None:
        return F.col(prompt)
    if setting in df.columns:
        return F.col(setting)
    return T.render_template(setting, df.columns)


def build_prompt(instruction: str = CODE_INSTRUCTION) -> Column:
    """Problem columns -> prompt. Uses the first example; a missing note reads "None"."""
    first = F.get("examples", F.lit(0))
    # The headings of the prompt and their order.
    heading = [
        (F.lit(instruction + "\n"), F.col("title")),
        (F.lit(": "), F.col("description")),
        (F.lit("\n## Input Format\n "), F.col("input_format")),
        (F.lit("\n## Output Format\n "), F.col("output_format")),
        (F.lit("\n## Examples\n```input\n"), F.coalesce(first["input"], F.lit(""))),
        (F.lit("\n```\n```output\n"), F.coalesce(first["output"], F.lit(""))),
        (F.lit("\n```\n## Constraints\nTime limit per test case: "), F.col("time_limit").cast("string")),
        (F.lit(" seconds\nMemory limit per test case: "), F.col("memory_limit").cast("string")),
        (F.lit(" MB\n## Note\n"), F.when(F.col("note") != "", F.col("note")).otherwise("None")),
    ]
    return F.concat(*[c for pair in heading for c in pair])


# Fixed value: the system turn the chat template puts first when none is given.
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."


def chat_text(question: Column, trace: Column, answer: Column, system: str = DEFAULT_SYSTEM) -> Column:
    """One training text: system, user and assistant turns, thinking and answer marked inside the last."""
    return F.concat(
        F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"),
        T.strip(question),
        F.lit("<|im_end|>\n<|im_start|>assistant\n<|im_start|>think\n"),
        T.strip(trace),
        F.lit("\n<|im_start|>answer\n"),
        T.strip(answer),
        F.lit("<|im_end|>\n"),
    )


def options_text(options: Column, option_format: str) -> Column:
    """Options listed with ``{letter}``, ``{numeral}``, ``{roman_numeral}``, ``{lower_case_letter}``, ``{option}``."""
    markers = {
        "letter": F.array(*[F.lit(c) for c in LETTERS]),
        "lower_case_letter": F.array(*[F.lit(c) for c in LETTERS.lower()]),
        "numeral": F.array(*[F.lit(str(i + 1)) for i in range(26)]),
        "roman_numeral": F.array(*[F.lit(r) for r in ROMAN]),
    }
    parts = re.split(r"\{(\w+)\}", option_format)

    def one(option: Column, i: Column) -> Column:
        out = []
        for j, part in enumerate(parts):
            if j % 2:
                out.append(option if part == "option" else F.get(markers[part], i))
            elif part:
                out.append(F.lit(part))
        return F.concat(*out)

    return F.array_join(F.transform(options, one), "")


def robust_prompt(prompt: str, question: Column, options: Column, category: Column, option_format: str) -> Column:
    """A prompt with ``{question}``, ``{options}`` and ``{category}`` filled in."""
    values = {"question": question, "options": options_text(options, option_format), "category": category}
    parts = re.split(r"\{(\w+)\}", prompt)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def expand_prompts(df: DataFrame, prompts: list[str]) -> DataFrame:
    """Every row once per prompt template, with ``prompt_id`` (templates are a short driver-side list)."""
    return df.select("*", F.posexplode(F.array(*[F.lit(p) for p in prompts])).alias("prompt_id", "prompt"))


def expand_option_orders(df: DataFrame, options: str, gold: str, labels: list[str]) -> DataFrame:
    """Per label one copy with the gold option swapped into that place.

    Labels beyond the number of options leave the options and the gold unchanged.
    """
    rows = df.select("*", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("_slot", "always_same_option"))
    slot, g = F.col("_slot"), F.col(gold)
    in_range = slot < F.size(options)
    swapped = F.transform(
        options,
        lambda x, i: F.when(i == slot, F.get(options, g)).when(i == g, F.get(options, slot)).otherwise(x),
    )
    return (
        rows.withColumn("original_answer_index", g)
        .withColumn(options, F.when(in_range, swapped).otherwise(F.col(options)))
        .withColumn(gold, F.when(in_range, slot).otherwise(g))
        .drop("_slot")
    )


def permute_choices(df: DataFrame, id_col: str, choices: str, gold: str, seed: int = 0) -> DataFrame:
    """Rotate the choices by a seeded non-zero step, so the gold always moves (two choices or more)."""
    n = F.size(choices)
    step = (1 + seeded_number(seed, id_col) % F.greatest(n - 1, F.lit(1))) % n
    rows = df.withColumn("_step", step.cast("int"))
    s = F.col("_step")
    return (
        rows.withColumn(choices, F.concat(F.slice(choices, n - s + 1, s), F.slice(choices, F.lit(1), n - s)))
        .withColumn(gold, ((F.col(gold) + s) % n).cast("int"))
        .drop("_step")
    )


def repeat_requests(df: DataFrame, repeats: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
