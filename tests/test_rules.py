"""Instruction rules, one passing and one failing response each."""

import pytest
from pyspark.sql import functions as F

from evalweave.functions import rules as R



def I(*args, **kwargs):  # noqa: E743
    """Arguments of an instruction; the column is built once a session is there."""
    return args, kwargs


CASES = [
    (I("keywords:existence", keywords=["apple", "PEAR"]), "An Apple and a pear", "An apple"),
    (I("keywords:frequency", 2, "at least", text="go"), "go, Go", "go"),
    (I("keywords:forbidden_words", keywords=["bad"]), "badly", "so BAD!"),
    (I("keywords:letter_frequency", 3, "at least", text="E"), "eEe", "ee"),
    (I("length_constraints:number_sentences", 2, "at least"), "One. Two!", "Only one."),
    (I("length_constraints:number_paragraphs", 2), "a *** b", "a *** *** b"),
    (I("length_constraints:number_words", 3, "less than"), "one two", "one two three"),
    (I("length_constraints:nth_paragraph_first_word", 2, text="hello", nth=2), "First.\n\n'Hello, you", "First.\n\nBye"),
    (I("detectable_content:number_placeholders", 2), "[a] and [b]", "[a] only"),
    (I("detectable_content:postscript", text="P.S."), "text\nP. S. more", "text"),
    (I("detectable_content:postscript", text="P.P.S"), "text p.p.s end", "text p.s. end"),
    (I("detectable_format:number_bullet_lists", 2), "* a\n- b", "* a\n** b"),
    (I("detectable_format:constrained_response"), "Well. My answer is yes.", "yes"),
    (I("detectable_format:number_highlighted_sections", 2), "*a* b *c*", "*a* * *"),
    (I("detectable_format:multiple_sections", 2, text="Section"), "Section 1 a Section 2 b", "Section 1 a"),
    (I("detectable_format:json_format"), "```json\n{\"a\": 1}\n```", "{a"),
    (I("detectable_format:title"), "<<My title>>", "<< >>"),
    (I("combination:two_responses"), "one******two", "one******one"),
    (I("combination:repeat_prompt", text="Say it"), "  say IT, then", "then say it"),
    (I("startend:end_checker", text="The End"), 'so "the end"', "the end?"),
    (I("startend:quotation"), '"all"', '"half'),
    (I("change_case:capital_word_frequency", 2, "at least"), "THE BIG cat", "THE cat"),
    (I("change_case:english_capital"), "ALL 1", "All"),
    (I("change_case:english_lowercase"), "all 1", "All"),
    (I("punctuation:no_comma"), "none here", "one, two"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rule(spark, k):
    (args, kwargs), good, bad = CASES[k]
    kw = R.instruction(*args, **kwargs)
    df = spark.createDataFrame([(0, good), (1, bad)], "id long, text string").withColumn("ins", F.array(kw))
    rows = {r.id: r.strict for r in R.instruction_checks(df, ["id"], "text", "ins").collect()}
    assert rows == {0: True, 1: False}


def test_every_rule_is_covered():
    assert {args[0] for (args, _), *_ in CASES} == set(R.RULES)


def test_loose_drops_lines_and_asterisks(spark):
    kw = R.instruction("startend:end_checker", text="done")
    df = spark.createDataFrame([(0, "all *done*\nBye"), (1, ""), (2, "   ")], "id long, text string").withColumn("ins", F.array(kw))
    rows = {r.id: (r.strict, r.loose) for r in R.instruction_checks(df, ["id"], "text", "ins").collect()}
    assert rows == {0: (False, True), 1: (False, False), 2: (False, False)}


def test_one_pass_over_the_forms(spark):
    """The response itself decides the strict outcome even if a later form follows too; a null response follows nothing."""
    ins = F.array(R.instruction("punctuation:no_comma"), R.instruction("startend:quotation"), R.instruction("no:such_rule"))
    df = spark.createDataFrame([(0, "none\nhere"), (1, "a, b\n*end*"), (2, None)], "id long, text string").withColumn("ins", ins)
    rows = {(r.id, r.pos): (r.strict, r.loose) for r in R.instruction_checks(df, ["id"], "text", "ins").collect()}
    assert rows == {(0, 0): (True, True), (1, 0): (False, True), (2, 0): (False, False)} | {(i, p): (False, False) for i in range(3) for p in (1, 2)}


def test_each_rule_is_compiled_once(spark, monkeypatch):
    made = []
    monkeypatch.setitem(R.RULES, "punctuation:no_comma", lambda v, kw, rule=R.RULES["punctuation:no_comma"]: made.append(1) or rule(v, kw))
    df = spark.createDataFrame([(0, "a")], "id long, text string").withColumn("ins", F.array(R.instruction("punctuation:no_comma")))
    assert R.instruction_checks(df, ["id"], "text", "ins").count() == 1 and len(made) == 1
