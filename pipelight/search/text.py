"""Text analyzers: the same chain as a Column over a field and in Python over a query's text."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list: English stop words.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_WORD_JAVA = r"[\p{L}\p{N}]+(?:['.][\p{L}\p{N}]+)*"
_WORD_PYTHON = re.compile(r"[^\W_]+(?:['.][^\W_]+)*")
_BIGRAM_JAVA = r"[\p{L}\p{N}]"


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


@dataclass(frozen=True)
class Analyzer:
    """tokenizer: whitespace, keyword, words or bigrams; then the filters that are on."""

    tokenizer: str
    lower: bool = False
    fold: bool = False
    stop: tuple[str, ...] = ()
    #: word -> words that are put in its place
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def column(self, text: Column) -> Column:
        text = F.coalesce(text.cast("string"), F.lit(""))
        if self.lower:
            text = F.lower(text)
        if self.fold:
            text = F.translate(text, FOLD_FROM, FOLD_TO)
        if self.tokenizer == "keyword":
            tokens = F.filter(F.array(text), lambda t: t != "")
        elif self.tokenizer == "whitespace":
            tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
        elif self.tokenizer == "bigrams":
            chars = F.regexp_extract_all(text, F.lit(_BIGRAM_JAVA), F.lit(0))
            pairs = F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), lambda c, i: F.concat(c, F.element_at(chars, i + 2)))
            tokens = F.when(F.size(chars) == 1, chars).otherwise(pairs)
        else:
            tokens = F.regexp_extract_all(text, F.lit(_WORD_JAVA), F.lit(0))
        if self.stop:
            tokens = F.filter(tokens, lambda t: ~t.isin(*self.stop))
        if self.synonyms:
            table = F.create_map(*(x for k, v in self.synonyms for x in (F.lit(k), F.array(*(F.lit(w) for w in v)))))
            tokens = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
        return tokens

    def tokens(self, text: str) -> list[str]:
        text = text or ""
        if self.lower:
            text = text.lower()
        if self.fold:
            text = text.translate(_FOLD)
        if self.tokenizer == "keyword":
            out = [text] if text else []
        elif self.tokenizer == "whitespace":
            out = text.split()
        elif self.tokenizer == "bigrams":
            chars = [c for c in text if c.isalnum()]
            out = chars if len(chars) == 1 else [a + b for a, b in zip(chars, chars[1:], strict=False)]
        else:
            out = _WORD_PYTHON.findall(text)
        out = [t for t in out if t not in self.stop]
        table = dict(self.synonyms)
        return [w for t in out for w in table.get(t, (t,))]


ANALYZERS = {
    "whitespace": Analyzer("whitespace"),
    "keyword": Analyzer("keyword"),
    "simple": Analyzer("whitespace", lower=True),
    "standard": Analyzer("words", lower=True, stop=STOP_WORDS),
    # no dictionary segmenter for Chinese is available: pairs of characters, a documented deviation
    "chinese": Analyzer("bigrams", lower=True),
    "english": Analyzer("words", lower=True, fold=True, stop=STOP_WORDS),
    "multilingual": Analyzer("words", lower=True, fold=True),
    "search": Analyzer("words", lower=True, fold=True, stop=STOP_WORDS),
}


def analyzer(name: str | Analyzer) -> Analyzer:
    if isinstance(name, Analyzer):
        return name
    if name not in ANALYZERS:
        raise ValueError(f"unknown analyzer {name!r}")
    return ANALYZERS[name]


@dataclass
class TextSettings:
    """Which fields are full text, and how each is analyzed."""

    fields: dict[str, str | Analyzer] = field(default_factory=dict)
    default: str | Analyzer = "standard"

    def is_text(self, name: str) -> bool:
        return name in self.fields

    def of(self, name: str) -> Analyzer:
        return analyzer(self.fields.get(name, self.default))


def token_positions(tokens: Column) -> Column:
    """array<struct<text, position>> of a token array."""
    return F.transform(tokens, lambda t, i: F.struct(t.alias("text"), i.alias("position")))
