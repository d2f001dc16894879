"""Line-first cleaning: quality rules judge each line, then a document by what its lines left.

Lines fail by punctuation (hardly a letter, or symbols instead of sentences), navigation (menus, link
lists, page furniture) or boilerplate (legal and cookie phrases, a line seen before in the text). Failing
lines go; a document that loses too much of its text with them is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The reasons for which a line goes, in the order in which they are tried.
REASONS = ("punctuation", "navigation", "boilerplate", "repeated")

_NAVIGATION = re.compile(
    r"^\W*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to content|share|tweet|print|contact( us)?|about( us)?|site ?map|faq|subscribe|read more|click here|more)\W*$"
    r"|(\S+\s+[|>»›·•/]\s+){3,}",
    re.I,
)
_BOILERPLATE = re.compile(
    r"all rights reserved|terms of (use|service)|privacy policy|cookie(s| policy)|copyright (\(c\)|©|\d{4})|©\s*\d{4}|powered by|licensed under|permission is hereby granted|without warranty|"
    r"enable javascript|javascript is (disabled|required)|lorem ipsum|subscribe to our newsletter",
    re.I,
)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: As bytes: one byte for each of the characters counted.
_SYMBOL_BYTES = b"#*$%&|<>"


class Rules(NamedTuple):
    """Limits of the rules; the last two are the base rule's."""

    least_letters: float = 0.5  #: share of a line's characters, white space aside, that must be letters or digits
    most_symbols: float = 0.1  #: share of a line's words that may hold one of # * $ % & | < >
    most_lost: float = 0.4  #: share of word characters lost with failing lines that rejects the document
    least_words: int = 50
    most_repeated: float = 0.5  #: share of words in repeated 3-word windows


def reason(line: str, seen: set[str], rules: Rules = Rules()) -> str | None:
    """Why the line fails, or None. Lines without a word never fail. seen: earlier lines with a word."""
    body = line.strip()
    if not body:
        return None
    solid = "".join(body.split())
    if sum(map(str.isalnum, solid)) < rules.least_letters * len(solid):
        return "punctuation"
    if _SYMBOLS.search(body):
        words = body.split()
        if sum(bool(_SYMBOLS.search(w)) for w in words) > max(1, rules.most_symbols * len(words)):
            return "navigation" if _NAVIGATION.search(body) else "punctuation"
    if _NAVIGATION.search(body):
        return "navigation"
    if _BOILERPLATE.search(body):
        return "boilerplate"
    return "repeated" if body in seen else None


class Report(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_failed_lines: int
    chars_lost: int
    cleaned: str


def clean(text: str | None, rules: Rules = Rules()) -> Report:
    """The measures of a text and the text without its failing lines; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes: splits at the ASCII white space and at nothing else
    chars = sum(map(len, words)) if len(raw) == len(text) else len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, _SYMBOL_BYTES))
    n = len(words)
    triples = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(triples)) < len(triples):
        counts, covered = Counter(triples), -1
        for i, t in enumerate(triples):
            if counts[t] > 1:
                repeats += i + 3 - max(i, covered)
                covered = i + 3
    dup_lines, failed, lost, seen, left, exact = 0, 0, 0, set(), [], set()
    for line in text.split("\n"):
        solid = line.encode().split()
        if not solid:
            left.append(line)
            continue
        dup_lines += line in exact
        exact.add(line)
        if reason(line, seen, rules):
            failed += 1
            lost += len(b"".join(solid).decode())
        else:
            left.append(line)
            seen.add(line.strip())
    base_failed = n < rules.least_words or repeats > rules.most_repeated * n
    kept = not base_failed and lost <= rules.most_lost * chars
    return Report(n, chars, symbols, dup_lines, repeats, base_failed, kept, failed, lost, "\n".join(left))


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, chars_lost long, cleaned string"


def evaluate(docs: DataFrame, text_col: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """docs with the fields of Report as columns (columns of docs of those names are replaced).

    Without with_text, `cleaned` is left out. Null and empty texts have no words and fail the base rule.
    Repeated rows are judged alike, each on its own; an empty table gives an empty result. No shuffle.
    """
    fields = _SCHEMA.split(", ") if with_text else _SCHEMA.split(", ")[:-1]

    @F.pandas_udf(", ".join(fields))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([clean(x, rules)[: len(fields)] for x in texts], columns=[f.split()[0] for f in fields])

    names = [f.split()[0] for f in fields]
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), of(F.col(f"`{text_col}`")).alias("report"))
    own = [F.col("report")[c].alias(c) if c in names else F.col("doc")[c].alias(c) for c in docs.columns]
    return judged.select(*own, *[F.col("report")[c].alias(c) for c in names if c not in docs.columns])


def cleaned(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents kept, with the columns of docs, their texts without the failing lines."""
    judged = evaluate(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text_col}`").alias("__text")), "__text", rules).where("kept")
    return judged.select(*[(F.col("cleaned") if c == text_col else F.col("__doc")[c]).alias(c) for c in docs.columns])
