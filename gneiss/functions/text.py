"""Text functions: keywords, tokens, stems, hashes, commit messages and paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no keywords.
STOP_WORDS = ["a", "an", "and", "are", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "me", "of", "on", "or", "show", "that", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with"]


def keywords(c: Column) -> Column:
    """Distinct words of [A-Za-z0-9_./-] in order, without stop words (any case); case is kept."""
    parts = F.filter(F.split(c, r"[^A-Za-z0-9_./-]+"), lambda x: (x != "") & ~F.lower(x).isin(STOP_WORDS))
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def fold(c: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def normalised_title(c: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalised_content(c: Column) -> Column:
    """Trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def decision_hash(node_type: Column, title: Column, content: Column) -> Column:
    """sha256 of type, title and content joined by newlines; nulls as ''."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (node_type, title, content)]), 256)


def call_site_key(*parts: Column) -> Column:
    """Portable key of a call site over its NUL-joined fields."""
    return F.concat(F.lit("call-site:v1:"), F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def candidate_id(key: Column) -> Column:
    """Id of a candidate: tierA: and the first 16 digits of the hash of its key."""
    return F.concat(F.lit("tierA:"), F.substring(F.sha2(key, 256), 1, 16))


def fragment_key(lines: Column, line: Column, callee: Column, radius: int = 2) -> Column:
    """Hash of the callee and the lines around a line (from 0 on), without white space, as a JSON array of both."""
    start = F.greatest(line - radius, F.lit(0))
    window = F.transform(F.slice(lines, start + 1, line + radius + 1 - start), lambda x: F.regexp_replace(x, r"\s+", ""))
    name = F.regexp_extract(F.to_json(F.array(callee)), r"^\[(.*)\]$", 1)
    return F.sha2(F.concat(F.lit("["), name, F.lit(","), F.to_json(window), F.lit("]")), 256)


def canonical_hash(*fields: Column, names: list[str]) -> Column:
    """Hash of a JSON object of the fields with sorted names; nulls are written."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return F.sha2(F.to_json(F.struct(*[fields[i].alias(names[i]) for i in order]), {"ignoreNullFields": "false"}), 256)


def canary_bucket(key: Column) -> Column:
    """First four digest bytes as a fraction of 2^32."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def first_line(message: Column) -> Column:
    """First line of a message, trimmed."""
    return F.regexp_replace(F.substring_index(message, "\n", 1), r"^\s+|\s+$", "")


def commit_type(subject: Column) -> Column:
    """Type of a conventional commit, null if it is none."""
    t = F.lower(F.regexp_extract(first_line(subject), r"^([A-Za-z]+)(?:\([^)]*\))?!?:", 1))
    return F.when(t != "", t)


# Commit types and subjects that hold no decision, and the least length of a subject.
DENIED_TYPES = ["chore", "style", "ci", "build", "docs", "test"]
JUNK = r"(?i)^(wip|fixup!|squash!|typo|lint|format|merge branch)"
LEAST_SUBJECT = 10


def worth_reading(subject: Column) -> Column:
    """Whether the first line of a commit message may hold a decision; its length counts without the type."""
    s = first_line(subject)
    text = F.regexp_replace(s, r"^[A-Za-z]+(\([^)]*\))?!?:\s*", "")
    return F.coalesce((F.length(text) >= LEAST_SUBJECT) & ~s.rlike(JUNK) & ~F.coalesce(commit_type(s).isin(DENIED_TYPES), F.lit(False)), F.lit(False))


# Folders that hold no domain at the top of a path, folders that are no domain, roots of workspaces.
IGNORED_TOP = ["node_modules", "dist", "build", "docs", "test", "tests", "scripts"]
NO_DOMAIN = ["src", "lib", "app"]
WORKSPACE_ROOTS = ["packages", "artifacts", "crates"]


def domain(path: Column) -> Column:
    """Domain of a path, null for bare files, hidden, ignored and structural folders.

    src/x is x, packages/x/src/... is x, x/src/... is x, else the first folder.
    """
    parts = F.split(F.trim(path), "/")
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    found = (
        F.when((at(0) == "src") & (n > 1), at(1)).when((n > 3) & at(0).isin(WORKSPACE_ROOTS) & (at(2) == "src"), at(1)).otherwise(at(0))
    )
    bad = (n <= 1) | at(0).startswith(".") | at(0).isin(IGNORED_TOP) | found.contains(".") | found.isin(NO_DOMAIN)
    return F.when(~bad, found)


def xml_escape(c: Column) -> Column:
    """& < > and quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_file_name(c: Column) -> Column:
    """Illegal characters as _, at most 100 characters, reserved device names with _ before."""
    plain = F.substring(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, 100)
    return F.when(F.upper(plain).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$"), F.concat(F.lit("_"), plain)).otherwise(plain)


def ellipsis(c: Column, n: int) -> Column:
    """At most n characters, the last three as dots if cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)


_VOWEL = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    if w[i] in _VOWEL:
        return False
    return i == 0 or not _is_consonant(w, i - 1) if w[i] == "y" else True


def _measure(w: str) -> int:
    """Number of vowel-consonant sequences."""
    shape = re.sub(r"(.)\1+", r"\1", "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w))))
    return shape.count("vc")


def _vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _is_consonant(w, n - 3) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 1) and w[-1] not in "wxy"


# Suffix tables of the published stemming algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(w: str) -> str:
    """Porter stem of a lower-case word; words of under three letters or with other characters stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(T.StringType())
def porter(words: pd.Series) -> pd.Series:
    """Stems of a column of words."""
    known: dict[str, str] = {}
    return words.map(lambda w: None if w is None else known[w] if w in known else known.setdefault(w, stem(w)))
