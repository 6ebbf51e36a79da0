"""Source files that do not parse.

A file is lexed into classes of tokens by its language, one character each, and
its distinct pairs of adjacent classes (with the ends of the file). Three rules
follow, and a file is flagged by the first that finds it:

pairs: the pairs minus those that the grammar permits (an anti-join of sets, by
a table of the permissible pairs with one row a language) leave some;
nesting: a reduction over the brackets, from left to right, closes what it
opens and leaves nothing;
productions: the innermost groups are reduced window by window, each to a symbol
of the productions it fits, until only the top level is left, which must be a
sequence of statements.

The first two are expressions of the JVM; the windows are reduced in the Arrow
batches of the lexer, where contents once seen are remembered. No file is split
over rows, so nothing is shuffled but the flagged files.

The languages are those of grammar.LANGUAGES; a null or unknown code_language is
replaced by that of the extension of file_path.

Defined cases: null, empty and blank code, code of comments only, and files of
unknown language are no case; repeated rows count once; byte-order marks and any
line ends are layout; very long files are lexed whole; other columns are not
read. What the parser's responses say is not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import grammar, productions


def language(code_language: Column, file_path: Column) -> Column:
    """The language a row means, null if unknown."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    said = F.lower(F.trim(code_language))
    extension = F.lower(F.regexp_extract(file_path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(F.coalesce(said, F.lit("")) != "", F.try_element_at(table(grammar.LANGUAGES), said)).otherwise(
        F.try_element_at(table(grammar.EXTENSIONS), extension)
    )


_REDUCERS: dict[str, productions.Reducer] = {}


def _fits(classes: str, lang: str) -> bool:
    if lang not in _REDUCERS:
        _REDUCERS[lang] = productions.Reducer(lang)
    return _REDUCERS[lang].valid(classes)


def lex(requests: DataFrame) -> DataFrame:
    """(task_id, repo_id, language, classes, pairs, fits) of every file with code and a known language; fits: the productions hold."""
    rows = requests.where("task_id IS NOT NULL AND code IS NOT NULL").select(
        "task_id", "repo_id", language(F.col("code_language"), F.col("file_path")).alias("language"), "code"
    ).where("language IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for task, repo, lang, code in zip(*(b[c].tolist() for c in ("task_id", "repo_id", "language", "code"))):
                s = grammar.classes(code, lang)
                if s and s != ";":
                    out.append((task, repo, lang, s, sorted({x + y for x, y in set(zip("^" + s, s + "$"))}), _fits(s, lang)))
            yield pd.DataFrame(out, columns=["task_id", "repo_id", "language", "classes", "pairs", "fits"])

    return rows.mapInPandas(run, "task_id string, repo_id string, language string, classes string, pairs array<string>, fits boolean")


def permissible(requests: DataFrame) -> DataFrame:
    """(language, permitted): the pairs that each grammar permits; one row a language, some thousands of pairs in all, whatever the input."""
    rows = [(g, sorted(productions.pairs(g))) for g in productions.RULES]
    return requests.sparkSession.createDataFrame(rows, "language string, permitted array<string>")


def unclosed(classes: Column) -> Column:
    """Whether the brackets of a class string do not close what they open."""
    brackets = F.split(F.regexp_replace(classes, r"[^()\[\]{}]", ""), "")
    last, rest = lambda s: F.substring(s, -1, 1), lambda s: F.substring(s, F.lit(1), F.length(s) - 1)

    def step(open_ones: Column, c: Column) -> Column:
        partner = F.translate(c, ")]}", "([{")
        return (
            F.when((c == "") | (last(open_ones) == "!"), open_ones).when(c == partner, F.concat(open_ones, c))
            .when(last(open_ones) == partner, rest(open_ones)).otherwise(F.concat(open_ones, F.lit("!")))
        )

    return F.aggregate(brackets, F.lit(""), step) != ""


def broken_files(requests: DataFrame) -> DataFrame:
    """(task_id, repo_id, language, rule) of the files that are not valid in their language, by the first rule that finds them."""
    rule = (
        F.when(F.size(F.array_except("pairs", "permitted")) > 0, "pairs").when(unclosed(F.col("classes")), "nesting").when(~F.col("fits"), "productions")
    )
    judged = lex(requests).join(F.broadcast(permissible(requests)), "language")
    return judged.select("task_id", "repo_id", "language", rule.alias("rule")).where("rule IS NOT NULL").distinct()


def broken_rules(requests: DataFrame) -> DataFrame:
    """(language, rule, n_files): distinct files that each rule finds."""
    return broken_files(requests).groupBy("language", "rule").agg(F.countDistinct("task_id").alias("n_files"))


def broken_rates(requests: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_broken, rate) over distinct files with code."""
    files = requests.where("task_id IS NOT NULL AND trim(code) <> ''").select(
        "task_id", "repo_id", language(F.col("code_language"), F.col("file_path")).alias("language")
    ).where("language IS NOT NULL")
    bad = broken_files(requests).select("task_id", F.lit(1).alias("bad")).distinct()
    return (
        files.distinct().join(bad, "task_id", "left").groupBy("repo_id", "language")
        .agg(F.countDistinct("task_id").alias("n_files"), F.countDistinct(F.when(F.col("bad") == 1, F.col("task_id"))).alias("n_broken"))
        .withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
    )
