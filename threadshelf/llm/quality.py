"""Quality rules: lines are judged first, then documents by what is left of them.

Only column expressions: everything about a document is computed inside its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadshelf.llm.common import let, words

# Signs that end a sentence in Latin, Chinese, Japanese, Indic and Arabic script, and
# what may close behind them.
SENTENCE_END = r"(?s)^.*[.!?…:;。！？।॥۔؟][\"'”’»)\]]*\s*\z"
# A sentence that ends inside the line: the line is then a paragraph that was cut short.
SENTENCE_INSIDE = r"[.!?…。！？।॥۔؟][\"'”’»)\]]*\s"
# Signs between the entries of a menu or of a path of pages.
SEPARATORS = "|›»•·→"
# The symbols counted per document.
SYMBOLS = "#*$%&|<>"
# Phrases of notices that surround a text.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to",
    "lorem ipsum",
    "privacy policy",
    "sign up for",
    "subscribe to our",
    "terms of use",
    "use of cookies",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the loss a document may have."""

    menu_entries: int = 3  # separators make a line a menu, if there are also
    separators_per_word: float = 0.1  # more of them
    notice_words: int = 40  # a line of at most as many words fails for any notice, a longer one
    notice_share: float = 0.1  # if more of its characters are in notices
    symbols_per_word: float = 0.5  # more make a line boilerplate
    marks_per_word: float = 0.5  # double exclamation marks; more make a line boilerplate
    shouted_words: int = 5  # a line of as many words without a small letter is shouted
    largest_loss: float = 0.5  # share of the characters in lines that failed
    least_words: int = 50
    most_repeated: float = 0.5  # share of words in three-word windows found again


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{signs}]+", ""))


def _count_pairs(text: Column, pair: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(pair), F.lit("")))) / len(pair)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def has_notice(text: Column) -> Column:
    """One of the phrases is in the text, in any case."""
    small, found = F.lower(text), F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(small, F.lit(phrase))
    return found


def punctuation_fails(line: Column) -> Column:
    """The line neither ends as a sentence does nor has a whole sentence in it."""
    return ~line.rlike(SENTENCE_END) & ~line.rlike(SENTENCE_INSIDE)


def has_signs(text: Column) -> Column:
    """Anything in the text that a menu or a boilerplate line is made of."""
    return text.rlike(f"[{SEPARATORS}{SYMBOLS}]|!!")


def navigation_fails(line: Column, rules: Rules) -> Column:
    """The line is a list of entries with separators between them."""
    many = lambda n: (n >= rules.menu_entries) & (n > F.size(words(line)) * F.lit(rules.separators_per_word))
    return let(_count(line, SEPARATORS), many)


def notice_fails(line: Column, rules: Rules) -> Column:
    """The line has a notice and is short, or much of it is notices."""
    rest = F.regexp_replace(F.lower(line), "|".join(BOILERPLATE), "")
    large = F.length(line) - F.length(rest) > F.length(line) * F.lit(rules.notice_share)
    return has_notice(line) & ((F.size(words(line)) <= rules.notice_words) | large)


def boilerplate_fails(line: Column, rules: Rules) -> Column:
    """The line is mostly symbols or marks."""

    def strange(w: Column) -> Column:
        return (_count(line, SYMBOLS) > F.size(w) * F.lit(rules.symbols_per_word)) | (
            _count_pairs(line, "!!") > F.size(w) * F.lit(rules.marks_per_word)
        )

    return let(words(line), strange)


def shouting_fails(line: Column, rules: Rules) -> Column:
    """Several words with capitals and without a small letter."""
    capitals = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
    return F.when(capitals, F.size(words(line)) >= rules.shouted_words).otherwise(False)


def line_fails(line: Column, rules: Rules, signs: Column, notices: Column) -> Column:
    """`signs` and `notices` tell whether the whole text has any; if not, no line needs a look."""
    return (
        punctuation_fails(line)
        | shouting_fails(line, rules)
        | F.when(signs, navigation_fails(line, rules) | boilerplate_fails(line, rules)).otherwise(False)
        | F.when(notices, notice_fails(line, rules)).otherwise(False)
    )


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows whose sequence is found twice or more in the list.

    Where all window hashes differ, nothing repeats. Elsewhere windows are sorted with their places; equal neighbours are repeats, and their places,
    sorted again, tell how many words they cover together.
    """

    def windows(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(ws) - 2),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)).alias("w"), i.alias("i")
            ),
        )

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        repeat = lambda x, k: (
            ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k < last) & (F.get(s, k + 1)["w"] == x["w"]))
        )
        return F.array_sort(F.transform(F.filter(s, repeat), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(3)))

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
    )
    differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    found = let(F.sort_array(windows(w)), lambda s: let(places(s), covered))
    return F.when(F.size(w) < 4, F.lit(0)).when(differ, F.lit(0)).otherwise(found)


def verdict(text: Column, rules: Rules) -> Column:
    """Everything the rules say about a text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    judge = lambda has: F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(
            line.alias("line"),
            has_word(line).alias("full"),
            F.when(has_word(line), line_fails(line, rules, has["signs"], has["notices"])).otherwise(False).alias("fails"),
        ),
    )

    has = F.struct(has_signs(text).alias("signs"), has_notice(text).alias("notices"))

    def only(lines: Column, keep, sep: str) -> Column:
        return F.array_join(F.transform(F.filter(lines, keep), lambda x: x["line"]), sep)

    def line_results(lines: Column) -> Column:
        full = F.transform(F.filter(lines, lambda x: x["full"]), lambda x: x["line"])
        return F.struct(
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            only(lines, lambda x: ~x["fails"], "\n").alias("clean_text"),
            F.length(only(lines, lambda x: x["fails"], "")).alias("lost"),
            F.length(only(lines, lambda x: x["full"], "")).alias("all"),
        )

    def word_results(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    return F.struct(
        let(words(text), word_results).alias("w"),
        let(let(has, judge), line_results).alias("l"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )


def judged(docs: DataFrame, text_col: str, rules: Rules) -> DataFrame:
    """(row, found, base_failed, loss, kept): the row as it came as one struct, and the verdict."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), verdict(F.col(text_col), rules).alias("found"))
    n_words, repeated = F.col("found.w.n_words"), F.col("found.w.n_repeat_words")
    failed = (n_words < rules.least_words) | (repeated > n_words * F.lit(rules.most_repeated))
    every, lost = F.col("found.l.all"), F.col("found.l.lost")
    loss = F.when(every > 0, lost / every).otherwise(0.0)
    return rows.select("row", "found", failed.alias("base_failed"), loss.alias("loss"), (~failed & (loss <= rules.largest_loss)).alias("kept"))


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """Per row: id, counts, `clean_text` (the lines that passed), `loss` and `kept`.

    Lines without words stay and count for nothing. A document fails with few words, with
    most words in repeated windows, or where the lines that failed hold more than
    `largest_loss` of the characters of its lines with words. A null or empty text has no words
    and is rejected. Each row is judged by itself: no shuffle, repeated rows get equal verdicts,
    and other columns are left out, whatever their names.
    """
    found = judged(docs.select(id_col, text_col), text_col, rules)
    return found.select(
        F.col("row")[id_col].alias(id_col),
        "found.w.n_words",
        "found.w.word_chars",
        "found.n_symbols",
        "found.l.n_dup_lines",
        "found.w.n_repeat_words",
        "base_failed",
        "kept",
        "loss",
        "found.l.clean_text",
    )


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with all their columns, their text without the lines that
    failed and its length anew."""
    found = judged(docs, text_col, rules)
    clean = F.col("found.l.clean_text")
    new = {text_col: clean, chars_col: F.length(clean).cast("long")}
    row = F.struct(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
    # a filter would be moved below the verdict and find it again
    return found.select(F.explode(F.when(F.col("kept"), F.array(row))).alias("row")).select("row.*")
