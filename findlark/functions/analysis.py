"""Text analysis: tokenizers and token filters, each as a Spark column and as the same function on Python lists.

The column form runs over document tables inside whole-stage code (stemming, the
one step SQL has no function for, is an Arrow function over the distinct tokens
of a batch); the list form analyzes query strings and highlighted texts on the
driver. ``tests/test_analysis.py`` holds both forms to equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stemmers, stopwords

ALNUM = r"[\p{L}\p{Nd}]+"
NOT_ALNUM = r"[^\p{L}\p{Nd}]"
_RUNS = regex.compile(ALNUM)
_SPACE = r"[\s\p{Z}\x85]+"
_MOST = 2**64 - 1


def lower_text(s: str) -> str:
    """Character by character: no final sigma rule, and a dotted capital I is i."""
    return s.replace("Σ", "σ").replace("İ", "i").lower()


def lower_column(c: Column) -> Column:
    return F.lower(F.replace(F.replace(c, F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def lower_letters(c: Column) -> Column:
    """Lower case that leaves the runs of letters and digits as they were. Two capitals have a lower case but are no letters to the regular expressions of Java 17."""
    return lower_column(F.replace(F.replace(c, F.lit("\ua7cb"), F.lit(" ")), F.lit("\ua7dc"), F.lit(" ")))


def is_numeric(s: str) -> bool:
    """An unsigned 64-bit decimal number."""
    return s.isascii() and s.isdigit() and int(s) <= _MOST


def numeric_column(c: Column) -> Column:
    return c.rlike("^[0-9]+$") & F.coalesce(c.try_cast("decimal(38,0)") <= F.lit(str(_MOST)).cast("decimal(38,0)"), F.length(F.ltrim(c, F.lit("0"))) == 0, F.lit(False))


@dataclass(frozen=True)
class Step:
    """A tokenizer (text -> tokens) or a filter (tokens -> tokens)."""

    name: str
    column: Callable[[Column], Column]
    python: Callable


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ALNUM), F.lit(0))


ALNUM_TOKENIZER = Step("alnum", _runs, lambda s: _RUNS.findall(s))


def _observe(c: Column) -> Column:
    words = F.filter(F.transform(F.split(c, _SPACE), lambda w: F.regexp_replace(w, f"^{NOT_ALNUM}+|{NOT_ALNUM}+$", "")), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.concat(F.when(w.rlike(NOT_ALNUM), F.array(w)).otherwise(F.expr("cast(array() as array<string>)")), _runs(w))))


def _observe_list(s: str) -> list[str]:
    out = []
    for w in regex.split(_SPACE, s):
        w = regex.sub(f"^{NOT_ALNUM}+|{NOT_ALNUM}+$", "", w)
        if w:
            out += [w] * bool(regex.search(NOT_ALNUM, w)) + _RUNS.findall(w)
    return out


#: White-space words without outer punctuation, whole first and then their parts: for technical and log text.
OBSERVABILITY_TOKENIZER = Step("observability", _observe, _observe_list)

LOWERCASE = Step("lowercase", lambda t: F.filter(F.transform(t, lower_column), lambda x: x != ""), lambda t: [lower_text(x) for x in t if x])
UNIQUE = Step("unique", F.array_distinct, lambda t: list(dict.fromkeys(t)))


def min_length(n: int) -> Step:
    """Numbers, and tokens of n or more characters."""
    n = max(1, n)
    return Step(f"min_length_{n}", lambda t: F.filter(t, lambda x: (F.char_length(x) >= n) | numeric_column(x)), lambda t: [x for x in t if is_numeric(x) or len(x) >= n])


def min_bytes(n: int) -> Step:
    return Step(f"min_bytes_{n}", lambda t: F.filter(t, lambda x: F.octet_length(x) >= n), lambda t: [x for x in t if len(x.encode()) >= n])


def stop(words: frozenset[str], name: str) -> Step:
    listed = sorted(w for w in words if not is_numeric(w))
    return Step(name, lambda t: F.filter(t, lambda x: ~x.isin(listed)), lambda t: [x for x in t if is_numeric(x) or x not in words])


_LATIN, _CYRILLIC, _LETTER = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{L}")


def script(token: str) -> str:
    """latin, cyrillic, mixed or unknown."""
    latin, cyrillic = bool(_LATIN.search(token)), bool(_CYRILLIC.search(token))
    if latin and cyrillic:
        return "mixed"
    return "latin" if latin else "cyrillic" if cyrillic else "unknown"


def stop_multilingual() -> Step:
    """Each list is for tokens of its own script alone, and no word of it is of another."""
    lists = {"latin": stopwords.ENGLISH, "cyrillic": stopwords.RUSSIAN}
    listed = sorted(w for kind, words in lists.items() for w in words if script(w) == kind and not is_numeric(w))
    return Step("stop_multilingual", lambda t: F.filter(t, lambda x: ~x.isin(listed)), lambda t: [x for x in t if is_numeric(x) or x not in lists.get(script(x), ())])


def _stem_step(name: str, one: Callable[[str], str]) -> Step:
    def stem(x: str) -> str:
        return x if is_numeric(x) else one(x)

    def over(tokens: pa.Array) -> pa.Array:  # noqa: D401
        flat = tokens.flatten().dictionary_encode()
        stems = pa.array([stem(x) if x is not None else None for x in flat.dictionary.to_pylist()], pa.string())
        lists = pa.ListArray.from_arrays(_offsets(tokens), stems.take(flat.indices))
        return lists

    def column(t: Column) -> Column:
        return F.arrow_udf(over, "array<string>")(F.coalesce(t, F.expr("cast(array() as array<string>)")))

    return Step(name, column, lambda t: [stem(x) for x in t])


def _offsets(lists: pa.Array) -> pa.Array:
    import numpy as np

    o = np.asarray(lists.offsets)
    return pa.array((o - o[0]).astype(np.int32))


def _multilingual(x: str) -> str:
    kind = script(x)
    return stemmers.english(x) if kind == "latin" else stemmers.russian(x) if kind == "cyrillic" else x


STOP_ENGLISH = stop(stopwords.ENGLISH, "stop_english")
STOP_RUSSIAN = stop(stopwords.RUSSIAN, "stop_russian")
STOP_MULTILINGUAL = stop_multilingual()
STEM_ENGLISH = _stem_step("stem_english", lambda x: x if x in stopwords.ENGLISH else stemmers.english(x))
STEM_RUSSIAN = _stem_step("stem_russian", lambda x: x if x in stopwords.RUSSIAN else stemmers.russian(x))
STEM_MULTILINGUAL = _stem_step("stem_multilingual", _multilingual)


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer and filters in order, with a name and version that fingerprint an index."""

    name: str = "custom"
    version: str = "1"
    tokenizer: Step = ALNUM_TOKENIZER
    filters: tuple[Step | None, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "name", self.name or "custom")
        object.__setattr__(self, "tokenizer", self.tokenizer or ALNUM_TOKENIZER)
        object.__setattr__(self, "filters", tuple(f for f in self.filters if f is not None))

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(f"{self.name}@{self.version}".encode()).hexdigest()

    def column(self, text: Column) -> Column:
        filters = self.filters
        if self.tokenizer is ALNUM_TOKENIZER and filters[:1] == (LOWERCASE,):  # letters stay letters: whole texts in lower case have the same tokens
            text, filters = lower_letters(text), filters[1:]
        t = self.tokenizer.column(text)
        for f in filters:
            t = f.column(t)
        return t

    def tokens(self, text: str | None) -> list[str]:
        t = self.tokenizer.python(text or "")
        for f in self.filters:
            t = f.python(t)
        return t


ANALYZERS = {
    "default": Analyzer("default", "1", ALNUM_TOKENIZER, (LOWERCASE,)),
    "alnum": Analyzer("alnum", "1", ALNUM_TOKENIZER),
    "english": Analyzer("english", "1", ALNUM_TOKENIZER, (LOWERCASE, min_length(3), STOP_ENGLISH, STEM_ENGLISH)),
    "russian": Analyzer("russian", "1", ALNUM_TOKENIZER, (LOWERCASE, min_length(3), STOP_RUSSIAN, STEM_RUSSIAN)),
    "multilingual": Analyzer("multilingual", "1", ALNUM_TOKENIZER, (LOWERCASE, min_length(3), STOP_MULTILINGUAL, STEM_MULTILINGUAL)),
    "observability": Analyzer("observability", "1", OBSERVABILITY_TOKENIZER, (LOWERCASE, min_length(2), UNIQUE)),
    "benchmark": Analyzer("benchmark", "1", ALNUM_TOKENIZER, (LOWERCASE, min_bytes(2))),
}


def analyzer(of: str | Analyzer | None) -> Analyzer:
    if of is None:
        return ANALYZERS["default"]
    if isinstance(of, Analyzer):
        return of
    if of not in ANALYZERS:
        raise ValueError(f"unknown analyzer {of!r}")
    return ANALYZERS[of]


def clean_text(c: Column) -> Column:
    """One line of letters, numbers, punctuation and spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"[^\p{L}\p{N}\p{P}\p{Z}]", ""))


def word_keys(token: str) -> list[str]:
    """The plain key generator: a token is its own key."""
    return [token]
