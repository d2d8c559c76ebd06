"""Quality rules against a direct computation."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PLAIN = "The river runs down to the sea and nobody in the town knows where it comes from or why it was named so long ago. " * 1
LONG = PLAIN + "A boat with two men is on its way up and the men are singing of home while the rain falls on the old bridge. " \
    "Later that day the people of the village met them at the landing and asked for news from the coast."


def direct(text):
    text = text or ""
    ws = WORD.findall(text)
    ls = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    return [len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)]


ODD = [None, "", " \t\n\x0b\x0c\r", "one", "one two", "a b c", "a b c a b c", "a a a a", "a a a", "x\ny\nx\nx \n\n \n", "Ä b   c # * $ % & | < > #", LONG,
       "word " * 70_000, "!!", LONG.upper(), re.sub(r" ", " $ ", LONG), " a b c d a b c\td"]


def test_measures(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, LONG), (11, LONG)]
    got = rules.judge(docs_of(rows)).collect()
    key = lambda r: str(r)
    want = sorted(((i, *direct(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, *(r[c] for c in BASE)) for r in got), key=key) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken)
    by = {r.doc_id: r for r in got}
    assert by[11].kept and by[11].broken == []
    assert "shouting" in by[14].broken and "symbols" in by[15].broken and by[12].base_failed


def test_rules_name_what_they_test(docs_of):
    odd = {"symbols": LONG.replace(" ", " # "), "stop_words": "kiosk zebra " + " ".join(f"word{i}" for i in range(80)),
           "duplicate_lines": "\n".join([LONG, *["again and again the same line here"] * 9, *[f"line {i} of it" for i in range(3)]]),
           "bullet_lines": "\n".join(f"- the {i} thing of the list" for i in range(20)), "ellipsis_lines": "\n".join(f"the {i} line of it..." for i in range(20)),
           "word_length": " ".join(f"the of {'x' * 60}{i}" for i in range(40)), "line_length": "\n".join("a of b to".split() * 3 + [f"i{i}" for i in range(60)]),
           "words_with_letters": " ".join(f"{i} the" if i % 4 == 0 else str(i) for i in range(90)), "exclamations": re.sub(" ", "!! ", LONG)}
    got = {r.doc_id: set(r.broken) for r in rules.judge(docs_of(list(enumerate(odd.values())))).collect()}
    for i, name in enumerate(odd):
        assert name in got[i], name


def test_own_table_of_rules_and_columns(spark):
    docs = spark.createDataFrame([(1, LONG, "k", 7), (2, "x y", None, 8)], "id long, body string, broken_by string, text long")
    table = (rules.Rule("long", "n_words", "n_lines", least=1000.0), rules.Rule("fine", "n_words", "n_lines", most=1000.0))
    got = {r.id: r for r in rules.judge(docs, table, key="id", text="body", keep=("text", "broken_by")).collect()}
    assert got[1].broken == ["long"] and got[1].text == 7 and got[1].broken_by == "k" and not got[1].kept and not got[1].base_failed
    assert got[2].base_failed
    with pytest.raises(ValueError):
        rules.judge(docs.withColumn("kept", F.lit(1)), key="id", text="body", keep=("kept",))


def test_clashing_columns_and_empty_table(spark, docs_of):
    docs = docs_of([(1, LONG)]).withColumn("n_words", F.lit(-1)).withColumn("_text", F.lit("x")).withColumn("_m_n_words", F.lit(5))
    assert rules.judge(docs).first().n_words == len(WORD.findall(LONG))
    assert rules.judge(docs_of([])).collect() == []


def test_no_user_function(spark, docs_of):
    plan = rules.judge(docs_of([(1, LONG)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1


def test_labelled_texts(spark):
    """Every junk document of the sample is refused, every other one of 50 words or more is kept."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(docs).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    assert {(r.quality, r.base_failed, r.kept) for r in got} <= {(0, True, False), (0, False, False), (1, True, False), (1, False, True)}
