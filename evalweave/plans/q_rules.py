"""Instruction-following queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import rules as R
from evalweave.plans.fixtures import W
from evalweave.plans.registry import query, table


def basic():
    """Rules with a simple SQL form, with arguments from the row itself."""
    turn = F.col("turn")
    return [
        R.instruction("punctuation:no_comma"),
        R.instruction("length_constraints:number_words", 40 + turn * 10, "at least"),
        R.instruction("keywords:existence", keywords=["the", F.col("role")]),
        R.instruction("keywords:forbidden_words", keywords=["of", "que"]),
        R.instruction("keywords:frequency", 3, "less than", text="the"),
        R.instruction("keywords:letter_frequency", 20, "at least", text="e"),
        R.instruction("detectable_format:constrained_response"),
        R.instruction("combination:repeat_prompt", text=F.when(turn % 3 == 0, "never said").otherwise(F.substring("text", 1, 12))),
        R.instruction("startend:end_checker", text=F.when(turn % 2 == 0, ".").otherwise("the end")),
        R.instruction("change_case:english_lowercase"),
    ]


BASIC = [
    "punctuation:no_comma", "length_constraints:number_words", "keywords:existence", "keywords:forbidden_words",
    "keywords:frequency", "keywords:letter_frequency", "detectable_format:constrained_response",
    "combination:repeat_prompt", "startend:end_checker", "change_case:english_lowercase",
]

MORE = [
    "length_constraints:number_sentences", "length_constraints:number_paragraphs", "length_constraints:nth_paragraph_first_word",
    "detectable_content:number_placeholders", "detectable_content:postscript", "detectable_format:number_bullet_lists",
    "detectable_format:number_highlighted_sections", "detectable_format:multiple_sections", "detectable_format:json_format",
    "detectable_format:title", "combination:two_responses", "startend:quotation", "change_case:capital_word_frequency",
    "change_case:english_capital",
]

STRICT = rf"""told AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN concat(text, ' My answer is yes.') ELSE text END AS text FROM conversations),
ck AS (SELECT conv_id, turn, role, text, [NOT contains(text, ','), len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) >= 40 + turn * 10,
  contains(lower(text), 'the') AND contains(lower(text), role), NOT regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])(of|que)($|[^\p{{L}}\p{{N}}_])'),
  len(regexp_extract_all(lower(text), 'the')) < 3, length(lower(text)) - length(replace(lower(text), 'e', '')) >= 20, regexp_matches(text, 'My answer is (yes|no|maybe)\.'), turn % 3 <> 0,
  ends_with(lower(regexp_replace(regexp_replace(text, '^{W}+|{W}+$', '', 'g'), '^"+|"+$', '', 'g')), CASE WHEN turn % 2 = 0 THEN '.' ELSE 'the end' END),
  text = lower(text) AND regexp_matches(text, '\p{{Ll}}')] AS ok FROM told),
st AS (SELECT conv_id, turn, CAST(unnest(range(1 + conv_id % 10)) AS INT) AS pos, unnest(ok[1 : 1 + conv_id % 10]) AS strict FROM ck)"""


def checks(spark, d):
    """A prompt has between one and ten instructions; every third conversation ends with a constrained answer."""
    told = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" My answer is yes."))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").withColumn("text", told)
    rows = rows.withColumn("instructions", F.slice(F.array(*basic()), F.lit(1), (1 + F.col("conv_id") % 10).cast("int")))
    return R.instruction_checks(rows, ["conv_id", "turn"], "text", "instructions", BASIC)


@query("instruction_checks_strict", f"WITH {STRICT} SELECT conv_id, turn, pos, strict FROM st")
def instruction_checks_strict(spark, d):
    return checks(spark, d).select("conv_id", "turn", "pos", "strict")


@query("inst_level_acc", f"WITH {STRICT} SELECT round(avg(CAST(strict AS INT)), 6) AS strict FROM st")
def inst_level_acc(spark, d):
    return R.inst_level_acc(checks(spark, d).select("strict", F.col("strict").alias("loose"))).select(
        F.round("strict", 6).alias("strict")
    )


@query(
    "prompt_level_acc",
    f"WITH {STRICT} SELECT conv_id, turn, bool_and(strict) AS strict FROM st GROUP BY conv_id, turn",
)
def prompt_level_acc(spark, d):
    return R.prompt_level(checks(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "strict")


# Every form of the text that one conversation in ten has, so that each rule meets texts that follow it.
def decorated():
    text, kind = F.col("text"), F.col("conv_id") % 10
    flat = F.translate("text", '\n"\\', "   ")
    return (
        F.when(kind == 1, F.concat(F.lit("<<A title>>\n"), text, F.lit("\nP.S. and more")))
        .when(kind == 2, F.concat(F.lit('"'), text, F.lit('"')))
        .when(kind == 3, F.concat(F.lit("The answer\n\n"), F.lower(text)))
        .when(kind == 4, F.concat(text, F.lit("******"), text, F.when(F.col("turn") % 2 == 0, " again").otherwise("")))
        .when(kind == 5, F.concat(F.lit("* one\n- two\n"), text, F.lit(" [name] *key* **two**")))
        .when(kind == 6, F.concat(F.lit('```json\n{"t": "'), flat, F.lit('"}\n```')))
        .when(kind == 7, F.concat(F.lit("Section 1 "), text, F.lit(" *** Section 2")))
        .when(kind == 8, F.concat(F.lit("Sure, here:\n"), F.lower(text), F.lit("\n*My answer is yes.*")))
        .when(kind == 9, F.concat(F.lit("GOOD DAY\n"), F.lit("HALLO 1\n"), F.regexp_replace("text", r"[^\n]*\p{Ll}[^\n]*", ""), F.lit("\nBye now")))
        .otherwise(text)
    )


DECORATED_SQL = r"""CASE conv_id % 10 WHEN 1 THEN concat('<<A title>>', chr(10), text, chr(10), 'P.S. and more') WHEN 2 THEN concat('"', text, '"')
  WHEN 3 THEN concat('The answer', chr(10), chr(10), lower(text)) WHEN 4 THEN concat(text, '******', text, CASE WHEN turn % 2 = 0 THEN ' again' ELSE '' END)
  WHEN 5 THEN concat('* one', chr(10), '- two', chr(10), text, ' [name] *key* **two**') WHEN 6 THEN concat('```json', chr(10), '{"t": "', translate(text, concat(chr(10), '"\'), '   '), '"}', chr(10), '```')
  WHEN 7 THEN concat('Section 1 ', text, ' *** Section 2') WHEN 8 THEN concat('Sure, here:', chr(10), lower(text), chr(10), '*My answer is yes.*')
  WHEN 9 THEN concat('GOOD DAY', chr(10), 'HALLO 1', chr(10), regexp_replace(text, '[^\n]*\p{Ll}[^\n]*', '', 'g'), chr(10), 'Bye now') ELSE text END"""

S = r"[ \t\n\x0B\f\r]"
L = r"[\p{L}\p{N}_]"


def _strip(x):
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def _blank(x):
    return f"({_strip(x)} = '')"


def _inner_blank(p):
    return f"len(list_filter({p}[2:len({p}) - 1], lambda x: {_blank('x')})) > 0"


def _capital(x):
    return f"({x} = upper({x}) AND NOT contains({x}, 'ß') AND regexp_matches({x}, '\\p{{Lu}}'))"


def _marked(pattern, marks):
    """How many matches hold more than blanks between their marks."""
    bare = f"regexp_replace(x, '{marks}', '', 'g')"
    return f"len(list_filter(regexp_extract_all(v, '{pattern}'), lambda x: NOT {_blank(bare)}))"


ASKED = "CASE WHEN turn % 3 = 0 THEN 'never said' ELSE substring(text, 1, 12) END"
BARE = f"regexp_replace({_strip('v')}, '^\"+|\"+$', '', 'g')"
UNFENCED = f"regexp_replace(regexp_replace({_strip('v')}, '^```(json|Json|JSON)?', ''), '```$', '')"

# The rules of ``instruction_checks`` in order, on a form v of the text; pa, pn, pr are its parts by ***, by empty lines and by ******.
RULES_SQL = [
    "NOT contains(v, ',')",
    f"len(regexp_extract_all(v, '{L}+')) >= 40 + turn * 10",
    "contains(lower(v), 'the') AND contains(lower(v), role)",
    f"NOT regexp_matches(lower(v), '(^|[^\\p{{L}}\\p{{N}}_])(of|que)($|[^\\p{{L}}\\p{{N}}_])')",
    "len(regexp_extract_all(lower(v), 'the')) < 3",
    "length(lower(v)) - length(replace(lower(v), 'e', '')) >= 20",
    r"regexp_matches(v, 'My answer is (yes|no|maybe)\.')",
    f"starts_with(lower({_strip('v')}), lower({_strip(ASKED)}))",
    f"ends_with(lower({BARE}), CASE WHEN turn % 2 = 0 THEN '.' ELSE 'the end' END)",
    r"v = lower(v) AND regexp_matches(v, '\p{Ll}')",
    f"len(list_filter(string_split(regexp_replace({_strip('v')}, '([.!?][\"”’]?){S}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT {_blank('x')})) >= 3",
    f"NOT {_inner_blank('pa')} AND len(pa) - CAST({_blank('pa[1]')} AS INT) - CASE WHEN len(pa) > 1 THEN CAST({_blank('pa[-1]')} AS INT) ELSE 0 END = 1",
    f"len(list_filter(pn, lambda x: NOT {_blank('x')})) = 1 AND lower(regexp_extract(regexp_replace(regexp_replace(string_split(regexp_replace({_strip('pn[1]')}, '{W}+', chr(1), 'g'), chr(1))[1], '^''+', ''), '^\"+', ''), '^[^.,?!''\"]*')) = 'the'",
    r"regexp_matches(v, '\[[^\n]*?\]')",
    f"regexp_matches(lower(v), 'p\\.{S}?s\\.')",
    f"NOT regexp_matches(v, '(?m)^{S}*\\*[^*]') AND NOT regexp_matches(v, '(?m)^{S}*-')",
    f"{_marked(r'\*[^\n*]*\*', r'^\*+|\*+$')} + {_marked(r'\*\*[^\n*]*\*\*', r'^\*\*|\*\*$')} >= 1",
    f"regexp_matches(v, 'Section{S}?[0-9]')",
    f"json_valid({UNFENCED})",
    f"{_marked(r'<<[^\n]+>>', '^<+|>+$')} >= 1",
    f"NOT {_inner_blank('pr')} AND len(list_filter(pr, lambda x: NOT {_blank('x')})) = 2 AND {_strip('list_filter(pr, lambda x: NOT ' + _blank('x') + ')[1]')} <> {_strip('list_filter(pr, lambda x: NOT ' + _blank('x') + ')[2]')}",
    f"length({_strip('v')}) > 1 AND starts_with({_strip('v')}, '\"') AND ends_with({_strip('v')}, '\"')",
    f"len(list_filter(regexp_extract_all(v, '[\\p{{L}}\\p{{N}}_''-]+'), lambda x: {_capital('x')})) < 2",
    _capital("v"),
]

ALL_RULES_SQL = rf"""WITH told AS (SELECT conv_id, turn, role, text AS said, {DECORATED_SQL} AS text FROM conversations),
ln AS (SELECT *, string_split(text, chr(10)) AS lines FROM told),
cut AS (SELECT *, [text, {_strip("array_to_string(lines[2:], chr(10))")}, {_strip("array_to_string(lines[1:len(lines) - 1], chr(10))")}, {_strip("array_to_string(lines[2:len(lines) - 1], chr(10))")}] AS c FROM ln),
forms AS (SELECT conv_id, turn, role, text, unnest(list_concat(c, list_transform(c, lambda x: replace(x, '*', '')))) AS v, unnest(range(8)) AS form FROM cut),
parts AS (SELECT *, regexp_split_to_array(v, '{S}?\*\*\*{S}?') AS pa, string_split(v, concat(chr(10), chr(10))) AS pn, string_split(v, '******') AS pr FROM forms),
ck AS (SELECT conv_id, turn, form, list_transform([{', '.join(RULES_SQL)}], lambda x: x AND NOT {_blank('v')}) AS ok FROM parts),
st AS (SELECT conv_id, turn, form, CAST(unnest(range({len(RULES_SQL)})) AS INT) AS pos, unnest(ok) AS hit FROM ck)
SELECT conv_id, turn, pos, [{', '.join(f"'{n}'" for n in [*BASIC, *MORE])}][pos + 1] AS instruction, bool_or(hit AND form = 0) AS strict, bool_or(hit) AS loose FROM st GROUP BY conv_id, turn, pos"""


@query("instruction_checks", ALL_RULES_SQL)
def instruction_checks(spark, d):
    """Every rule on every turn, strict and loose."""
    more = [
        R.instruction("length_constraints:number_sentences", 3, "at least"),
        R.instruction("length_constraints:number_paragraphs", 1),
        R.instruction("length_constraints:nth_paragraph_first_word", 1, text="the", nth=1),
        R.instruction("detectable_content:number_placeholders", 1),
        R.instruction("detectable_content:postscript", text="P.S."),
        R.instruction("detectable_format:number_bullet_lists", 0),
        R.instruction("detectable_format:number_highlighted_sections", 1),
        R.instruction("detectable_format:multiple_sections", 1, text="Section"),
        R.instruction("detectable_format:json_format"),
        R.instruction("detectable_format:title"),
        R.instruction("combination:two_responses"),
        R.instruction("startend:quotation"),
        R.instruction("change_case:capital_word_frequency", 2, "less than"),
        R.instruction("change_case:english_capital"),
    ]
    rows = table(spark, d, "conversations").withColumn("text", decorated()).withColumn("instructions", F.array(*basic(), *more))
    return R.instruction_checks(rows, ["conv_id", "turn"], "text", "instructions")
