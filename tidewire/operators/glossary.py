"""Terminology: repairs, preferred terms and warnings, with the glossary as a parameter.

A glossary is a list of terms, each with ``source`` spellings that call for it, the
``preferred`` form, and ``forbidden`` patterns of the other forms (Java patterns).

Small glossaries are Column expressions. Large ones go through ``relevant_terms``,
``enforced`` and ``replaced``: one automaton over all spellings finds in one pass which
stand in a text, so cost grows with the text and with the terms that it has, not with
the glossary. A glossary goes to every worker; its size is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.tables import bounded_batches

#: characters of spellings that a glossary may have, as each worker holds it
MOST_CHARS = 20_000_000


@dataclass(frozen=True)
class Term:
    source: tuple[str, ...]
    preferred: str
    forbidden: tuple[str, ...] = field(default=())
    #: other forms as plain words, of any case, replaced before the patterns
    words: tuple[str, ...] = field(default=())


def relevant(article: Column, term: Term) -> Column:
    """Whether a source spelling stands in the article as words."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(article, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    out = F.lit(False)
    for spelling in term.source:
        out = out | low.contains(f" {spelling.lower()} ")
    return out


def enforce(text: Column, article: Column, terms: list[Term], repairs: list[tuple[str, str]] = ()) -> Column:
    """Repairs in order, then forbidden forms of relevant terms as the preferred one, blanks tidied, first letter raised."""
    out = text
    for pattern, replacement in repairs:
        out = F.regexp_replace(out, f"(?iU){pattern}", replacement)
    for term in terms:
        fixed = out
        for pattern in term.forbidden:
            fixed = F.regexp_replace(fixed, f"(?iU){pattern}", term.preferred)
        out = F.when(relevant(article, term), fixed).otherwise(out)
    tidy = F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r" +([,.;:!?])", "$1"))
    return F.concat(F.upper(F.substring(tidy, 1, 1)), F.substr(tidy, F.lit(2)))


def warnings(rows: DataFrame, text: str, article: str, terms: list[Term]) -> DataFrame:
    """One row for each forbidden form that a text holds of a term its article calls for."""
    found = F.array(*[
        F.when(relevant(F.col(article), t) & F.col(text).rlike(f"(?iU){p}"), F.struct(F.lit(t.preferred).alias("preferred"), F.lit(p).alias("pattern"))) for t in terms for p in t.forbidden
    ])
    others = [c for c in rows.columns if c not in (text, article)]
    return rows.select(*others, F.explode(F.array_compact(found)).alias("_w")).select(*others, "_w.preferred", "_w.pattern")


class Spellings:
    """Which of many spellings a text has: short ones and words between other characters, several words anywhere."""

    def __init__(self, spellings: Sequence[tuple[str, int]], bounded: bool | None = None) -> None:
        """``spellings``: (spelling, its number). ``bounded``: None for the rule of glossaries, False for any place."""
        if sum(len(s) for s, _ in spellings) > MOST_CHARS:
            raise ValueError(f"a glossary of more than {MOST_CHARS} characters")
        self.numbers: dict[str, list[int]] = {}
        self.bounded = bounded
        for spelling, number in spellings:
            low = spelling.strip().lower()
            if low:
                self.numbers.setdefault(low, []).append(number)
        self.automaton = ahocorasick.Automaton()
        for low in self.numbers:
            self.automaton.add_word(low, low)
        if self.numbers:
            self.automaton.make_automaton()

    def _stands(self, text: str, first: int, last: int, low: str) -> bool:
        before, after = text[first - 1 : first], text[last + 1 : last + 2]
        if self.bounded is None:
            if len(low) <= 4:
                return not re.match("[a-zа-я0-9]", before) and not re.match("[a-zа-я0-9]", after)
            if re.search(r"\s", low):
                return True
        if self.bounded is False:
            return True  # what decides is the replacement
        word = lambda c: bool(re.match(r"\w", c))
        return word(before) != word(low[0]) and word(after) != word(low[-1])

    def found(self, text: str) -> set[int]:
        """Numbers of the spellings that stand in a lower-case text."""
        out: set[int] = set()
        if not self.numbers:
            return out
        seen: set[str] = set()
        for last, low in self.automaton.iter(text):
            if low not in seen and self._stands(text, last - len(low) + 1, last, low):
                seen.add(low)
                out.update(self.numbers[low])
        return out


def _relevant(spellings: Spellings, fields: tuple, limit: int) -> list[int]:
    return sorted(spellings.found(" ".join(f or "" for f in fields).lower()))[:limit]


def relevant_terms(rows: DataFrame, fields: Sequence[str], terms: Sequence[Term], *, limit: int = 12, output: str = "terms") -> DataFrame:
    """Rows with the numbers (from 0, in order) of the first ``limit`` terms of which a spelling stands in the fields."""
    bounded_batches(rows.sparkSession)
    listed = [(s, i) for i, t in enumerate(terms) for s in t.source]

    def run(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        spellings = Spellings(listed)
        for columns in frames:
            yield pd.Series([_relevant(spellings, f, limit) for f in zip(*columns, strict=True)])

    found = F.pandas_udf(run, "array<int>")
    return rows.withColumn(output, found(*[F.col(f) for f in fields]))


@lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


def _form(old: str) -> re.Pattern:
    return _compiled(rf"(?<![А-Яа-яA-Za-z0-9]){re.escape(old)}(?![А-Яа-яA-Za-z0-9])")


def enforced_text(text: str | None, fields: tuple, spellings: Spellings, terms: Sequence[Term], repairs: Sequence[tuple[str, str]] = (), polish: Sequence[tuple[str, str]] = (), limit: int = 12) -> str:
    """A text with the preferred forms of its article's first ``limit`` relevant terms.

    Repairs come first, where any term is relevant; then, term by term in order, plain forms and patterns; then the polish, and a
    capital at the beginning.
    """
    out, wanted = text or "", _relevant(spellings, fields, limit)
    if wanted:
        for pattern, replacement in repairs:
            out = _compiled(pattern).sub(replacement, out)
    for term in (terms[i] for i in wanted):
        for word in term.words:
            out = _form(word).sub(lambda _, p=term.preferred: p, out)
        for pattern in term.forbidden:
            out = _compiled(pattern).sub(lambda _, p=term.preferred: p, out)
    for pattern, replacement in polish:
        out = _compiled(pattern).sub(replacement, out)
    return out[0].upper() + out[1:] if re.match("[а-яё]", out, re.I) else out


def enforced(rows: DataFrame, text: str, fields: Sequence[str], terms: Sequence[Term], *, repairs: Sequence[tuple[str, str]] = (), polish: Sequence[tuple[str, str]] = (), limit: int = 12, output: str = "enforced") -> DataFrame:
    """Rows with ``text`` as ``enforced_text`` gives it for the article in ``fields`` (Python patterns)."""
    bounded_batches(rows.sparkSession)
    listed, known = [(s, i) for i, t in enumerate(terms) for s in t.source], list(terms)

    def run(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        spellings = Spellings(listed)
        for own, *columns in frames:
            yield pd.Series([enforced_text(t, f, spellings, known, repairs, polish, limit) for t, f in zip(own, zip(*columns, strict=True), strict=True)], dtype=object)

    return rows.withColumn(output, F.pandas_udf(run, "string")(F.col(text), *[F.col(f) for f in fields]))


_CJK = re.compile("[\u3400-\u9fff]")


def replaced_text(text: str | None, pairs: Sequence[tuple[str, str]], spellings: Spellings) -> str:
    """A text after replacements in order: ideographs anywhere, other sources as whole words of any case.

    Only sources that stand in the text are tried; after each replacement the text is looked through again for later ones,
    as what was put in may hold them.
    """
    out, last = text or "", -1
    while True:
        later = [i for i in spellings.found(out.lower()) if i > last]
        if not later:
            return out
        last = min(later)
        source, preferred = pairs[last]
        out = out.replace(source, preferred) if _CJK.search(source) else _compiled(rf"\b{re.escape(source)}\b").sub(lambda _, p=preferred: p, out)


def replaced(rows: DataFrame, text: str, pairs: Sequence[tuple[str, str]], *, output: str = "replaced") -> DataFrame:
    """Rows with ``text`` after the replacements (source, preferred) that feedback asked for, in order."""
    bounded_batches(rows.sparkSession)
    kept = [(s.strip(), p.strip()) for s, p in pairs if (s or "").strip() and (p or "").strip()]

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spellings = Spellings([(s, i) for i, (s, _) in enumerate(kept)], bounded=False)
        for own in frames:
            yield pd.Series([replaced_text(t, kept, spellings) for t in own], dtype=object)

    return rows.withColumn(output, F.pandas_udf(run, "string")(F.col(text)))
