"""Per-sample scores as column expressions: one row in, one value out, no shuffle."""

from __future__ import annotations

import re
import string
import sys
from collections import Counter
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType

from evalweave.functions import answers as A
from evalweave.functions import text as T
from evalweave.functions.arrays import argmax_first, let, let2, multiset_overlap, total

# The UDFs below travel to the workers whole, so the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[\p{L}\p{N}_]"

# Articles dropped per language.
ARTICLES = {
    "en": ["a", "an", "the"],
    "es": ["un", "una", "unos", "unas", "el", "la", "los", "las"],
    "fr": ["un", "une", "des", "le", "la", "les"],
    "de": ["ein", "eine", "einen", "einem", "eines", "einer", "der", "die", "das", "den", "dem", "des"],
    "vi": ["của", "là", "cái", "chiếc", "những"],
}


# --- multiple choice, on a document row with arrays --------------------------


def multiple_choice(lls: Column, lengths: Column, greedy: Column, gold: Column) -> dict[str, Column]:
    """acc, acc_norm (by character length) and exact_match; a gold out of range is wrong."""
    valid = (gold >= 0) & (gold < F.size(lls))
    norm = F.zip_with(lls, lengths, lambda ll, n: ll / n)
    return {
        "acc": F.when(valid & (argmax_first(lls) == gold), 1.0).otherwise(0.0),
        "acc_norm": F.when(valid & (argmax_first(norm) == gold), 1.0).otherwise(0.0),
        "exact_match": F.when(valid & F.get(greedy, gold), 1).otherwise(0),
    }


def multiple_choice_multi(lls: Column, lengths: Column, greedy: Column, golds: Column) -> dict[str, Column]:
    """The same with several right answers."""
    norm = F.zip_with(lls, lengths, lambda ll, n: ll / n)
    inside = F.filter(golds, lambda g: (g >= 0) & (g < F.size(lls)))
    return {
        "acc": F.array_contains(inside, argmax_first(lls)).cast("double"),
        "acc_norm": F.array_contains(inside, argmax_first(norm)).cast("double"),
        "exact_match": F.exists(inside, lambda g: F.get(greedy, g)).cast("int"),
    }


def softmax(lls: Column) -> Column:
    def scaled(v: Column) -> Column:
        top = F.array_max(v)
        return let(F.transform(v, lambda x: F.exp(x - top)), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(lls, scaled)


def mutual_info_acc(lls: Column, unconditional: Column, gold: Column) -> Column:
    gain = F.zip_with(lls, unconditional, lambda a, b: a - b)
    return F.when(let(gain, argmax_first) == gold, 1.0).otherwise(0.0)


def true_mass(lls: Column, labels: Column) -> Column:
    """Share of probability on the options whose label is 1."""
    return let2(
        softmax(lls),
        labels,
        lambda p, y: total(F.zip_with(p, y, lambda a, b: F.when(b == 1, a).otherwise(0.0))),
    )


def brier(lls: Column, gold: Column) -> Column:
    """Squared distance of the probabilities to the one-hot gold."""
    return let(
        softmax(lls),
        lambda p: total(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0)))),
    )


def gold_rank(lls: Column, gold: Column) -> dict[str, Column]:
    """recall@1, recall@2 and reciprocal rank of the gold option."""
    ahead = F.size(F.filter(lls, lambda x: x > F.get(lls, gold)))
    first = argmax_first(lls) == gold
    return {
        "r1": first.cast("int"),
        "r2": (ahead == 1).cast("int") + first.cast("int"),
        "mrr": 1.0 / (ahead + 1),
    }


def stereotype_pair(more: Column, less: Column) -> dict[str, Column]:
    return {"likelihood_diff": F.abs(more - less), "pct_stereotype": F.when(more > less, 1.0).otherwise(0.0)}


def cooccurrence_bias(female: list[Column], male: list[Column]) -> dict[str, Column]:
    """Log-sum-exp difference and whether a male term is the likeliest."""
    both = F.array(*female, *male)
    return {
        "likelihood_diff": F.log(sum((F.exp(x) for x in female[1:]), F.exp(female[0])))
        - F.log(sum((F.exp(x) for x in male[1:]), F.exp(male[0]))),
        "pct_male_preferred": F.when(argmax_first(both) > len(female) - 1, 1.0).otherwise(0.0),
    }


# Generated words that count as male or female.
MALE, FEMALE = ["male", "man"], ["female", "woman"]


def gender_flags(has_male: Column, has_female: Column) -> dict[str, Column]:
    """From the presence of male and female words among the generations of a document."""
    m, f = has_male.cast("int"), has_female.cast("int")
    return {
        "difference_male_female": m - f,
        "pct_male_preferred": F.when(m > f, 1).otherwise(0),
        "pct_female_preferred": F.when((m <= f) & (f > 0), 1).otherwise(0),
        "pct_invalid": F.when(m + f == 0, 1).otherwise(0),
    }


# --- text normalisation for answers -------------------------------------------


def remove_words(text: Column, words: list[str]) -> Column:
    return F.regexp_replace(text, f"(?<!{WORD})({'|'.join(words)})(?!{WORD})", " ")


def remove_punctuation(text: Column, unicode: bool = False) -> Column:
    if unicode:
        return F.regexp_replace(F.translate(text, string.punctuation, ""), r"\p{P}", "")
    return F.translate(text, string.punctuation, "")


def normalize_answer(text: Column, lang: str = "en", unicode_punctuation: bool = False) -> Column:
    """Lower case, no punctuation, no articles, single spaces; Chinese is split by character."""
    x = remove_punctuation(F.lower(text), unicode_punctuation)
    if lang in ARTICLES:
        x = remove_words(x, ARTICLES[lang])
    elif lang == "ar":
        x = F.replace(x, F.lit("ال"), F.lit(" "))
    elif lang == "zh":
        x = F.regexp_replace(x, "([\u4e00-\u9fa5])", " $1 ")
    return F.trim(F.regexp_replace(x, f"{T.WS}+", " "))


def normalize_answer_by(text: Column, lang: Column, languages: list[str], unicode_punctuation: bool = True) -> Column:
    """Language taken from a column."""
    out = normalize_answer(text, "none", unicode_punctuation)
    for code in languages:
        out = F.when(lang == code, normalize_answer(text, code, unicode_punctuation)).otherwise(out)
    return out


def answer_tokens(text: Column, lang: str = "en") -> Column:
    return T.words(normalize_answer(text, lang))


def f1_of_tokens(pred: Column, gold: Column, empty_equal: bool = False) -> Column:
    """Multiset token F1. With ``empty_equal`` two empty answers score 1."""

    def score(p: Column, g: Column) -> Column:
        same = multiset_overlap(p, g)
        value = F.when(F.size(p) + F.size(g) == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))
        if not empty_equal:
            return value
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(value)

    return let2(pred, gold, score)


def token_f1(pred: Column, gold: Column, lang: str = "en", empty_equal: bool = False) -> Column:
    return f1_of_tokens(answer_tokens(pred, lang), answer_tokens(gold, lang), empty_equal)


def answer_em(pred: Column, gold: Column, lang: str = "en") -> Column:
    return (normalize_answer(pred, lang) == normalize_answer(gold, lang)).cast("int")


def exact_match(
    pred: Column,
    gold: Column,
    regexes_to_ignore: list[str] | None = None,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    ignore_numbers: bool = False,
) -> Column:
    def tidy(x: Column) -> Column:
        for pattern in regexes_to_ignore or []:
            x = F.regexp_replace(x, pattern, "")
        if ignore_case:
            x = F.lower(x)
        if ignore_punctuation:
            x = remove_punctuation(x)
        if ignore_numbers:
            x = F.translate(x, string.digits, "")
        return x

    return (tidy(pred) == tidy(gold)).cast("double")


def any_target(golds: Column, score) -> Column:
    """1.0 if any gold option has a score above zero."""
    return F.exists(golds, lambda g: score(g) > 0).cast("double")


def max_over_golds(golds: Column, score) -> Column:
    return F.array_max(F.transform(golds, score))


def leave_one_out(scores: Column) -> Column:
    """Mean, over the golds left out, of the best score among the others.

    The best of the others is the maximum, or the second maximum for the gold
    that holds it, so one sort is enough.
    """

    def mean(s: Column) -> Column:
        n = F.size(s)
        top = F.sort_array(s, asc=False)
        return F.when(n > 1, (F.get(top, F.lit(0)) * (n - 1) + F.get(top, F.lit(1))) / n).otherwise(F.get(s, F.lit(0)))

    return let(scores, mean)


def contains_score(text: Column, labels: Column) -> Column:
    """Any label in the text, ignoring case."""
    low = F.lower(text)
    return F.exists(labels, lambda x: F.contains(low, F.lower(x))).cast("int")


# --- number-aware reading-comprehension score (single span) --------------------


def drop_normalize(text: Column) -> Column:
    """Tokens at spaces and hyphens; numbers as floats, others without punctuation and articles."""

    def one(token: Column) -> Column:
        low = F.lower(token)
        bare = F.when(low.rlike(A.NUMBER), low).otherwise(remove_punctuation(low))
        fixed = F.when(bare.rlike(A.NUMBER), bare.try_cast("double").cast("string")).otherwise(bare)
        return F.trim(F.regexp_replace(remove_words(fixed, ARTICLES["en"]), f"{T.WS}+", " "))

    return F.array_join(F.filter(F.transform(F.split(text, "[ -]"), one), lambda t: t != ""), " ")


def drop_em_f1(pred: Column, golds: Column) -> Column:
    """Struct of em and f1 over candidate golds; bags are token sets, numbers must agree."""

    def bag(x: Column) -> Column:
        return F.array_distinct(T.words(x))

    def numbers(b: Column) -> Column:
        return F.filter(b, lambda w: w.rlike(A.NUMBER))

    def one(p: Column, gold: Column) -> Column:
        def scored(g: Column) -> Column:
            def bags(pb: Column, gb: Column) -> Column:
                same = F.size(F.array_intersect(pb, gb))
                precision = F.when(F.size(pb) == 0, 1.0).otherwise(same / F.size(pb))
                recall = F.when(F.size(gb) == 0, 1.0).otherwise(same / F.size(gb))
                f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
                fits = (F.size(numbers(gb)) == 0) | F.arrays_overlap(numbers(gb), numbers(pb))
                return F.struct(
                    F.when(p == g, 1.0).otherwise(0.0).alias("em"),
                    F.round(F.when(fits, f1).otherwise(0.0), 2).alias("f1"),
                )

            return let2(bag(p), bag(g), bags)

        return let(drop_normalize(gold), scored)

    def all_golds(p: Column) -> Column:
        scores = F.transform(F.filter(golds, lambda g: T.strip(g) != ""), lambda g: one(p, g))
        return let(
            scores,
            lambda s: F.struct(
                F.coalesce(F.array_max(F.transform(s, lambda x: x["em"])), F.lit(0.0)).alias("em"),
                F.coalesce(F.array_max(F.transform(s, lambda x: x["f1"])), F.lit(0.0)).alias("f1"),
            ),
        )

    return let(drop_normalize(pred), all_golds)


# --- numbers, classes, containment ---------------------------------------------


def number_match(pred: Column, gold: Column) -> Column:
    """Share of the numbers in the prediction that equal the gold."""
    return let(
        F.regexp_extract_all(pred, F.lit(r"\d+"), F.lit(0)),
        lambda n: F.when(F.size(n) == 0, 0.0).otherwise(F.size(F.filter(n, lambda x: x == gold)) / F.size(n)),
    )


def retrieval(pred: Column, gold: Column, marker: str = "Paragraph ") -> Column:
    """The same against the paragraph number named in the gold text."""
    return number_match(pred, F.regexp_extract(gold, marker + r"(\d+)", 1))


def class_mention(pred: Column, gold: Column, classes: list[str]) -> Column:
    """1 / number of classes mentioned if the gold is one of them.

    A mentioned class that is a proper part of the gold does not count against it.
    """
    named = F.filter(
        F.array(*[F.lit(c) for c in classes]),
        lambda c: F.contains(pred, c) & ~(F.contains(gold, c) & (c != gold)),
    )
    return let(named, lambda m: F.when(F.array_contains(m, gold), 1.0 / F.size(m)).otherwise(0.0))


def share_contained(pred: Column, refs: Column) -> Column:
    """Share of the references contained in the prediction, ignoring case."""
    low = F.lower(pred)
    return F.size(F.filter(refs, lambda r: F.contains(low, F.lower(r)))) / F.size(refs)


# --- n-gram text metrics -----------------------------------------------------


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """Struct of precision, recall and f on n-gram counts."""

    def score(p: Column, g: Column) -> Column:
        same = multiset_overlap(p, g)
        precision = same / F.greatest(F.size(p), F.lit(1))
        recall = same / F.greatest(F.size(g), F.lit(1))
        return F.struct(
            precision.alias("precision"),
            recall.alias("recall"),
            F.when(same > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0).alias("f"),
        )

    return let2(T.ngrams(rouge_tokens(pred), n), T.ngrams(rouge_tokens(gold), n), score)


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays; one machine word per 64 tokens per step."""

    def one(x, y) -> int:
        places: dict = {}
        for i, token in enumerate(x):
            places[token] = places.get(token, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            hits = row & places.get(token, 0)
            row = ((row + hits) | (row - hits)) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def rouge_l(pred_tokens: Column, gold_tokens: Column) -> Column:
    """F of the longest common subsequence."""
    same = lcs_length(pred_tokens, gold_tokens)
    return F.when(
        F.size(pred_tokens) + F.size(gold_tokens) > 0, 2.0 * same / (F.size(pred_tokens) + F.size(gold_tokens))
    ).otherwise(0.0)


# The standard tokenisation of machine-translation scoring (13a).
MT_STEPS = [
    ("lit", "<skipped>", ""),
    ("lit", "-\n", ""),
    ("lit", "\n", " "),
    ("lit", "&quot;", '"'),
    ("lit", "&amp;", "&"),
    ("lit", "&lt;", "<"),
    ("lit", "&gt;", ">"),
    ("re", r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    ("re", r"([^0-9])([\.,])", "$1 $2 "),
    ("re", r"([\.,])([^0-9])", " $1 $2"),
    ("re", r"([0-9])(-)", "$1 $2 "),
]


def mt_tokens(text: Column) -> Column:
    # The steps expect a blank on either side of the segment.
    return T.words(T.apply_steps(F.concat(F.lit(" "), T.strip(text), F.lit(" ")), MT_STEPS))


def code_tokens(text: Column) -> Column:
    """Words and single punctuation marks of the lower-cased text."""
    return F.regexp_extract_all(
        F.lower(T.strip(text)), F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]"), F.lit(0)
    )


@F.pandas_udf(ArrayType(LongType()))
def _token_matches(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Clipped matches of 1- to 4-grams of two token arrays."""

    def one(p, g) -> list[int]:
        p, g = list(p), list(g)
        return [
            (Counter(zip(*(p[i:] for i in range(n)))) & Counter(zip(*(g[i:] for i in range(n))))).total()
            for n in range(1, 5)
        ]

    return pd.Series([one(p, g) for p, g in zip(pred, gold)])


@F.pandas_udf(ArrayType(LongType()))
def char_matches(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Clipped matches of 1- to 6-grams of characters.

    All orders of a row in one call: about ten times the speed of the sorted
    array form, which builds every n-gram as a column value.
    """

    def one(p: str, g: str) -> list[int]:
        return [
            (
                Counter(p[i : i + n] for i in range(len(p) - n + 1))
                & Counter(g[i : i + n] for i in range(len(g) - n + 1))
            ).total()
            for n in range(1, 7)
        ]

    return pd.Series([one(p, g) for p, g in zip(pred, gold)])


def token_matches(pred_tokens: Column, gold_tokens: Column) -> Column:
    return _token_matches(pred_tokens, gold_tokens)


def ngram_stats(pred_tokens: str, gold_tokens: str) -> list[Column]:
    """Columns m1..m4 (clipped matches), c1..c4 (candidate n-grams), p_len, g_len of two token array columns."""
    matches = token_matches(F.col(pred_tokens), F.col(gold_tokens))
    p_len = F.size(pred_tokens).cast("bigint")
    return [
        matches.alias("m"),
        *[F.greatest(p_len - (n - 1), F.lit(0)).alias(f"c{n}") for n in range(1, 5)],
        p_len.alias("p_len"),
        F.size(gold_tokens).cast("bigint").alias("g_len"),
    ]


def smoothed_bleu(max_n: int = 4) -> Column:
    """Sentence BLEU over the columns of ``ngram_stats``: add-one smoothing above unigrams and a length penalty."""
    tiny = 2.2250738585072014e-308
    log_sum = F.lit(0.0)
    for n in range(1, max_n + 1):
        add = 1 if n > 1 else 0
        m, c = F.get("m", F.lit(n - 1)), F.col(f"c{n}")
        log_sum = log_sum + F.log(m + add + F.lit(tiny)) - F.log(c + add + F.lit(tiny))
    penalty = F.least(F.lit(0.0), 1.0 - (F.col("g_len") + 1) / (F.col("p_len") + 1))
    return F.exp(log_sum / max_n + penalty)


# --- assorted ------------------------------------------------------------------


@F.arrow_udf(ArrayType(DoubleType()))
def _named_numbers(response: pa.Array, names: pa.Array) -> pa.Array:
    """The numbers of ``names`` in each response; null unless all are there and four names in all. One search goes over a batch."""
    # Fixed value: the form of a pair; or the character put between two responses, which is part of no pair.
    pair = re.compile(r"(\w+):\s+(\d+)|\x00", re.ASCII)
    texts = [(t or "").replace("\x00", "\x01") for t in response.to_pylist()]
    found, at = [{} for _ in texts], 0
    for name, number in pair.findall("\x00".join(texts)):
        if name:
            found[at][name] = number  # the last value of a repeated name counts
        else:
            at += 1

    # Lists are read flat, which takes a tenth of the time.
    every, lengths = names.flatten().to_pylist(), names.value_lengths().to_pylist()
    numbers, sizes, at = [], [], 0
    for pairs, length in zip(found, lengths):
        wanted = every[at : at + (length or 0)]
        at += len(wanted)
        here = [pairs.get(n) for n in wanted]
        if len(pairs) != 4 or length is None or None in here:
            sizes.append(None)
        else:
            numbers += here
            sizes.append(len(here))
    ends = pa.array(accumulate((n or 0 for n in sizes), initial=0), pa.int32())
    flat = pa.array(list(map(float, numbers)), pa.float64())
    return pa.ListArray.from_arrays(ends, flat, mask=pa.array([n is None for n in sizes], pa.bool_()))


def emotion_distance(response: Column, names: Column, scores: Column) -> dict[str, Column]:
    """Percent score of four ``name: number`` pairs against the reference, and whether they parse."""
    given = _named_numbers(response, names)

    def tally(gap: Column) -> Column:
        return F.when(gap == 0, 0.0).when(gap <= 5, 6.5 / (1 + F.exp(-1.2 * (gap - 4)))).otherwise(gap)

    gaps = F.zip_with(given, scores, lambda a, b: tally(F.abs(a - b)))
    return {
        "score": F.when(given.isNotNull(), (10 - total(gaps) * 0.7477) * 10).otherwise(0.0),
        "percent_parseable": F.when(given.isNotNull(), 100).otherwise(0),
    }


def json_valid(text: Column) -> Column:
    """Parses as JSON once code fences are stripped."""
    body = T.strip(F.regexp_replace(F.regexp_replace(T.strip(text), r"^```(json)?", ""), r"```\z", ""))
    # The parser stops after one value; the two wrappings make anything behind it an error.
    one_value = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    return F.coalesce(
        one_value & F.try_parse_json(F.concat(F.lit('{"x":'), body, F.lit("}"))).isNotNull(), F.lit(False)
    )


def toxicity_flag(score: Column, threshold: float = 0.5) -> Column:
    return (F.coalesce(score, F.lit(0.0)) >= threshold).cast("int")


def referent_match(pred: Column, gold: Column, label: Column, determiners: list[str]) -> Column:
    """Prediction words within the reference words or the other way round, determiners dropped."""

    def clean(x: Column) -> Column:
        return F.filter(F.split(F.lower(T.strip(x)), " "), lambda w: ~w.isin(determiners))

    def same(p: Column, g: Column) -> Column:
        apostrophe = F.exists(p, lambda w: F.contains(w, F.lit("'"))) != F.exists(g, lambda w: F.contains(w, F.lit("'")))
        subset = (F.size(F.array_except(p, g)) == 0) | (F.size(F.array_except(g, p)) == 0)
        return ~apostrophe & subset

    return (let2(clean(pred), clean(gold), same) == label).cast("double")


def clean_dict_answer(text: Column) -> Column:
    """Stripped, lower case, single blanks, plain quotes, no plus signs."""
    x = F.regexp_replace(T.strip(text), r"^\.+|\.+\z", "")
    x = F.lower(F.regexp_replace(x, " +", " "))
    return F.translate(x, "‘’“”+", "''\"\"")


def dict_answer_scores(pred_json: Column, refs: Column) -> Column:
    """Per key 1.0 if the predicted value is one of the alternatives; a missing key reads as ''.

    ``refs`` is an array of (key, alternatives). Text that is not an object is
    searched for ``'key': value`` pairs.
    """
    opened = F.concat(F.lit("{"), F.substring_index(pred_json, "{", -1))
    closed = F.when(opened.endswith("}"), opened).otherwise(F.concat(opened, F.lit("}")))
    parsed = F.from_json(F.when(F.contains(pred_json, F.lit("{")), closed), "map<string,string>")

    def value(k: Column) -> Column:
        loose = F.get(
            F.regexp_extract_all(pred_json, F.concat(F.lit("\\Q"), k, F.lit("\\E['\"]: ['\"]?([^'\"]+)['\"]?[,}]")), F.lit(1)),
            F.lit(0),
        )
        return F.coalesce(F.when(parsed.isNotNull(), F.try_element_at(parsed, k)).otherwise(loose), F.lit(""))

    return F.transform(
        refs,
        lambda r: F.struct(
            r["key"].alias("key"),
            F.when(F.size(r["alternatives"]) == 0, 1.0)
            .when(
                F.exists(r["alternatives"], lambda a: clean_dict_answer(a) == clean_dict_answer(value(r["key"]))), 1.0
            )
            .otherwise(0.0)
            .alias("score"),
        ),
    )


def synonym_precision(words: Column, annotated: Column, freqs: Column, limit: int = 10) -> dict[str, Column]:
    """Annotator weight of the first ``limit`` words over the whole weight, with answered/annotated flags."""
    table = F.arrays_zip(annotated.alias("w"), freqs.alias("f"))
    hit = total(
        F.transform(
            F.slice(words, F.lit(1), F.lit(limit)),
            lambda x: F.coalesce(F.get(F.filter(table, lambda t: t["w"] == x), F.lit(0))["f"], F.lit(0)),
        )
    )
    weight = total(freqs)
    return {
        "prec": F.when(weight != 0, hit / weight).otherwise(hit),
        "has_answer": (F.size(words) > 0).cast("int"),
        "has_annotation": (F.size(annotated) > 0).cast("int"),
    }


# Entity classes; "O" is no entity.
ENTITY_CLASSES = {"PER": 0, "LOC": 1, "ORG": 2, "O": 3}


def entity_label_pairs(pred: Column, gold: Column) -> Column:
    """Array of (predicted label, gold label); entities are arrays of structs (text, type).

    With at most as many predictions as golds an unmatched gold is predicted "O".
    With more predictions an unmatched gold keeps class 0, and every surplus
    prediction adds a false positive (2 against "O"). Two empty lists give one "O" pair.
    """
    table = F.create_map(*[F.lit(x) for kv in ENTITY_CLASSES.items() for x in kv])
    extra = F.size(pred) - F.size(gold)
    default = F.when(extra > 0, 0).otherwise(3)

    def pair(p: Column, g: Column) -> Column:
        return F.struct(p.alias("pred"), g.alias("gold"))

    matched = F.transform(
        gold,
        lambda e: pair(
            F.when(F.exists(pred, lambda x: (x["text"] == e["text"]) & (x["type"] == e["type"])), F.try_element_at(table, e["type"]))
            .otherwise(default),
            F.try_element_at(table, e["type"]),
        ),
    )
    surplus = F.transform(
        F.when(extra > 0, F.sequence(F.lit(1), extra)).otherwise(F.array().cast("array<int>")),
        lambda _: pair(F.lit(2), F.lit(3)),
    )
    return F.when((F.size(pred) == 0) & (F.size(gold) == 0), F.array(pair(F.lit(3), F.lit(3)))).otherwise(
        F.concat(matched, surplus)
    )


# --- graded programs -----------------------------------------------------------


def classify_verdict(
    has_code: Column, compile_error: Column, timeout: Column, memory_exceeded: Column, error: Column, correct: Column
) -> Column:
    """Verdict of one test from its recorded outcome."""
    return (
        F.when(~has_code, "FE")
        .when(compile_error, "CE")
        .when(timeout, "TLE")
        .when(memory_exceeded, "MLE")
        .when(error, "RE")
        .when(~correct, "WA")
        .otherwise("AC")
    )


def compare_outputs(actual: Column, expected: Column, mode: str = "normalized") -> Column:
    """Equal program outputs. ``reference`` mode joins actual lines at \\n but expected ones at \\r\\n."""
    a = F.replace(T.strip(actual), F.lit("\n"), F.lit(""))
    if mode == "reference":
        return a == F.replace(T.strip(expected), F.lit("\r\n"), F.lit(""))
    return F.replace(a, F.lit("\r"), F.lit("")) == F.translate(T.strip(expected), "\r\n", "")


def scale_limit(limit: Column, test_input: Column) -> Column:
    """Limit times the case count in the first input line; unscaled if that line is no integer."""
    first = T.strip(F.split_part(test_input, F.lit("\n"), F.lit(1)))
    return limit * F.coalesce(F.when(first.rlike(r"^[+-]?\d+$"), first.try_cast("bigint")), F.lit(1))


# Failure precedence.
FAILURE_ORDER = ["FE", "CE", "RE", "MLE", "TLE", "WA"]


def main_failure(reasons: Column) -> Column:
    """Most important failure among a list of reasons (prefix match), else Unknown."""
    out = F.lit("Unknown")
    for code in reversed(FAILURE_ORDER):
        out = F.when(F.array_join(reasons, ",").rlike(f"(^|,){code}"), code).otherwise(out)
    return out
