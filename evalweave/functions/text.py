"""Text normalisation, word n-grams, templates."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.arrays import let

# Fixed value: every character Python treats as whitespace, as one regex class.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    """Whitespace-separated words, no empty strings."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def normalize_text(text: Column) -> Column:
    """Lower case, stripped, every whitespace run one space."""
    return F.trim(F.regexp_replace(F.lower(text), f"{WS}+", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding n-grams of a word array joined by one space; empty when shorter than n."""

    def build(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    if n == 1:
        return tokens
    return let(tokens, build)


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hash of every sliding n-gram, without building the strings."""

    def build(h: Column) -> Column:
        starts = F.when(F.size(h) >= n, F.sequence(F.lit(1), F.size(h) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, n)))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), build)


def ngram_hash(ngram: Column) -> Column:
    """The hash that ``ngram_hashes`` gives an n-gram, from its string."""
    return F.xxhash64(F.transform(F.split(ngram, " "), lambda w: F.xxhash64(w)))


def ascii_fold(text: Column, delete_chars: str = string.punctuation) -> Column:
    """ASCII lower case with ``delete_chars`` removed."""
    return F.translate(text, string.ascii_uppercase + delete_chars, string.ascii_lowercase)


def pieces(text: Column) -> Column:
    """Words with the whitespace in front of each; the pieces tile the text from offset 0."""
    return F.regexp_extract_all(text, F.lit(f"{WS}*{NOT_WS}+"), F.lit(0))


def glob_to_regex(pattern: str) -> str:
    """A shell glob (``*``, ``?``, ``[...]``) as an anchored regex."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def apply_steps(text: Column, steps) -> Column:
    """Fold an ordered list of (kind, pattern, replacement) substitutions.

    kind "lit" replaces a literal, "re" a regex.
    """
    for kind, pattern, replacement in steps:
        if kind == "lit":
            text = F.replace(text, F.lit(pattern), F.lit(replacement))
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text


# Ordered substitutions that undo corpus tokenisation (wiki text).
WIKI_STEPS = [
    ("lit", "s '", "s'"),
    ("re", r"/' [0-9]/", r"/'[0-9]/"),
    ("lit", " @-@ ", "-"),
    ("lit", " @,@ ", ","),
    ("lit", " @.@ ", "."),
    ("lit", " : ", ": "),
    ("lit", " ; ", "; "),
    ("lit", " . ", ". "),
    ("lit", " ! ", "! "),
    ("lit", " ? ", "? "),
    ("lit", " , ", ", "),
    ("re", rf"\({WS}*([^\)]*?){WS}*\)", "($1)"),
    ("re", rf"\[{WS}*([^\]]*?){WS}*\]", "[$1]"),
    ("re", rf"\{{{WS}*([^}}]*?){WS}*\}}", "{$1}"),
    ("re", rf"\"{WS}*([^\"]*?){WS}*\"", '"$1"'),
    ("re", rf"'{WS}*([^']*?){WS}*'", "'$1'"),
    ("lit", "= = = =", "===="),
    ("lit", "= = =", "==="),
    ("lit", "= =", "=="),
    ("lit", " ° ", "°"),
    ("lit", " \n", "\n"),
    ("lit", "\n ", "\n"),
    ("lit", " N ", " 1 "),
    ("lit", " 's", "'s"),
]

# The dialogue variant.
DIALOGUE_STEPS = [
    ("lit", " '", "'"),
    ("lit", " \n", "\n"),
    ("lit", "\n ", "\n"),
    ("lit", " n't", "n't"),
    ("lit", "`` ", '"'),
    ("lit", "''", '"'),
    ("lit", " :", ":"),
    ("lit", " ;", ";"),
    ("lit", " !", "!"),
    ("lit", " ?", "?"),
    ("lit", " ,", ","),
    ("lit", " .", "."),
]

# The general variant.
GENERAL_STEPS = [
    ("lit", " n't", "n't"),
    ("lit", " )", ")"),
    ("lit", "( ", "("),
    ("lit", '" ', '"'),
    ("lit", ' "', '"'),
    ("re", r" (['.,])", r"$1"),
]


def render_template(template: str, columns: list[str]) -> Column:
    """``{{name}}`` placeholders filled per row; an unknown name is an error before any job runs."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    out = []
    for i, part in enumerate(parts):
        if i % 2:
            if part not in columns:
                raise ValueError(f"template names the missing column {part!r}; there are {sorted(columns)}")
            out.append(F.coalesce(F.col(part).cast("string"), F.lit("")))
        elif part:
            out.append(F.lit(part))
    return F.concat(*out) if out else F.lit("")
