"""Quality rules: a threshold table compiled into one projection, with DataFrame and SQL functions only.

Method: every text gets a handful of measures (lengths, symbols, stop words, lines, repeated word windows). The table of
rules names a ratio of two measures and the range it has to lie in; `compile_rules` turns the whole table into one
projection that lists the rules a text breaks. No user function, no shuffle, no statistics of other rows: a text is
judged alike wherever it stands and whatever else the table holds.

Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r. Repeated windows are found inside the row: the
64-bit hashes of all three-word windows are sorted with their places and equal neighbours marked, so a long text costs
n log n. (Two different windows of one text of a million words share a hash with a probability below 1e-7.)

Defined cases: a null or blank text has no words and all measures 0 (it breaks the base rule); a ratio whose denominator
is 0 counts as 0; repeated rows and null ids are judged like any other; columns other than the id and the text are not
read unless they are asked for by `keep`; one called like a result is refused there, since both could not be told apart;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
MIN_WORDS, MOST_REPEATED = 50, 50  # the base rule: fewest words, highest per cent of words in repeated windows
# Very common words of English, German, French and Spanish, in alphabetical order by language.
STOP_WORDS = (
    "a and are as be by for from have in is it of on that the this to was with "
    "auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "au dans de des du et la le les par pour que qui un une "
    "con del el en es la las lo los no para por se su y").split()


@dataclass(frozen=True)
class Rule:
    """above / below has to lie in [least, most]; measures are named as in `measures`."""
    name: str
    above: str
    below: str
    least: float = float("-inf")
    most: float = float("inf")


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("shouting", "n_shouted", "n_words", most=0.4),
    Rule("exclamations", "n_exclaimed", "n_words", most=0.2),
    Rule("words_with_letters", "n_lettered", "n_words", 0.7),
    Rule("stop_words", "n_stop", "n_words", 0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("bullet_lines", "n_bullets", "n_lines", most=0.9),
    Rule("ellipsis_lines", "n_ellipses", "n_lines", most=0.5),
    Rule("line_length", "word_chars", "n_lines", 5.0),
)


def repeated_words(words: Column, n: Column) -> Column:
    """How many of the words lie in a window that the text holds twice or more."""
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(
        F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")))
    # A one-element array binds the sorted list to a name, so that it is made once.
    starts = F.transform(F.array(F.sort_array(hashed)), lambda s: F.transform(
        F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))),
        lambda x: x["p"]))[0]
    places = F.flatten(F.transform(starts, lambda p: F.array(*[p + k for k in range(WINDOW)])))
    return F.when(n > WINDOW, F.size(F.array_distinct(places))).otherwise(0).cast("long")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key and the columns in `keep` as _c0, _c1 ..., and each measure as _m_<name>, of every row.

    Words and lines are columns of a projection of their own, and measures are columns rather than fields of a struct:
    that way the optimizer makes each of them once.
    """
    names = [key, *[c for c in keep if c != key]]
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]
    base = docs.select(*carried, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    trimmed, held = F.trim("_text", F.lit(BLANKS)), [f"_c{i}" for i in range(len(names))]
    base = base.select(*held, "_text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_words"), F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "").alias("_lines"))
    count = lambda array, test: F.size(F.filter(array, test))
    n = F.size("_words")
    made = {
        "n_words": n, "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_words"), n),
        "n_lines": F.size("_lines"),
        "n_shouted": F.regexp_count("_text", F.lit(r"\p{Lu}{2,}")),
        "n_exclaimed": F.regexp_count("_text", F.lit("!!+")),
        "n_lettered": count("_words", lambda w: F.rlike(w, F.lit(r"\p{L}"))),
        "n_stop": count("_words", lambda w: F.lower(w).isin(STOP_WORDS)),
        "n_bullets": count("_lines", lambda x: F.rlike(x, F.lit(r"^[\x20\x09-\x0D]*(?:[-*•‣·]|[0-9]+[.)])[\x20\x09-\x0D]"))),
        "n_ellipses": count("_lines", lambda x: F.rlike(x, F.lit(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z")))}
    return base.select(*held, *[c.cast("long").alias(f"_m_{name}") for name, c in made.items()])


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row's measures break."""
    def broken(r: Rule) -> Column:
        ratio = F.coalesce(F.try_divide(F.col(f"_m_{r.above}").cast("double"), F.col(f"_m_{r.below}").cast("double")), F.lit(0.0))
        return F.when(~ratio.between(r.least, r.most), F.lit(r.name))
    return F.array_compact(F.array(F.lit(None).cast("string"), *[broken(r) for r in rules]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in `keep`, the measures, base_failed, broken (names of the rules broken), kept of every row."""
    m, names = measures(docs, key, text, keep), [key, *[c for c in keep if c != key]]
    found = [c for c in m.columns if c.startswith("_m_")]
    clash = set(names) & {*[c[3:] for c in found], "base_failed", "broken", "kept"}
    if clash:
        raise ValueError(f"columns to keep are called like results: {sorted(clash)}")
    base_failed = (F.col("_m_n_words") < MIN_WORDS) | (100 * F.col("_m_n_repeat_words") > MOST_REPEATED * F.col("_m_n_words"))
    out = m.select("*", base_failed.alias("_failed"), compile_rules(rules).alias("_broken"))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], *[F.col(c).alias(c[3:]) for c in found],
                      F.col("_failed").alias("base_failed"), F.col("_broken").alias("broken"), (~F.col("_failed") & (F.size("_broken") == 0)).alias("kept"))
