"""Text features as Columns. Words are runs of a-z after lower-casing, so that accents cannot split engines apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]" * (least - 1) + "[a-z]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Runs between white space; 0 for blank text."""
    return F.size(F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != ""))


def each(tokens: Column) -> Column:
    """One row per token. The filter that keeps all stops the optimizer from inferring ``size(tokens) > 0`` below
    the generator, which would compute the tokens of every row several times over."""
    return F.explode(F.filter(tokens, lambda w: w.isNotNull()))


def bigrams(tokens: Column, sep: str = " ") -> Column:
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(sep), b)))


def tokenise(text: Column, stop: list[str], longer_than: int = 3, with_bigrams: bool = False, sep: str = "_") -> Column:
    """Content words: not a stop word, longer than 3 letters; adjacent pairs on demand."""
    kept = F.filter(words(text), lambda w: (F.length(w) > longer_than) & ~w.isin(*stop))
    return F.concat(kept, bigrams(kept, sep)) if with_bigrams else kept


def regex_density(text: Column, patterns: list[str]) -> Column:
    """Pattern hits per 100 words."""
    hits = reduce(lambda a, b: a + b, [F.regexp_count(F.lower(text), F.lit(p)) for p in patterns])
    return hits / F.nullif(word_count(text), F.lit(0)) * 100


def lexicon_hits(text: Column, lexicon: list[str]) -> Column:
    known = F.array(*[F.lit(w) for w in lexicon])
    return F.size(F.filter(words(text), lambda w: F.array_contains(known, w)))


def token_density(text: Column, lexicon: list[str]) -> Column:
    """Share of words in a lexicon of single words."""
    return lexicon_hits(text, lexicon) / F.nullif(F.size(words(text)), F.lit(0))


def per_thousand(text: Column, lexicon: list[str]) -> Column:
    return lexicon_hits(text, lexicon) / (F.nullif(F.size(words(text)), F.lit(0)) / 1000.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def classify(word: Column, buckets: list[tuple[str, list[str]]], default: str = "other", inside: bool = False) -> Column:
    """First bucket with a seed inside the word (or, with ``inside``, a seed that holds the word)."""
    out = F.lit(default)
    for name, seeds in reversed(buckets):
        hit = reduce(lambda x, y: x | y, [F.contains(word, F.lit(s)) | (F.contains(F.lit(s), word) if inside else F.lit(False)) for s in seeds])
        out = F.when(hit, name).otherwise(out)
    return out


def strip_artifacts(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def blend(main: Column, other: Column, share: float = 0.6) -> Column:
    """share * main + (1 - share) * other where both exist, else whichever does."""
    return F.when(main.isNotNull() & other.isNotNull(), share * main + (1 - share) * other).otherwise(F.coalesce(main, other))


def direction(warm: Column, teal: Column, margin: float = 0.1) -> Column:
    return F.when(warm > teal + margin, "warm").when(teal > warm + margin, "teal").otherwise("neutral")


def speaker_turns(text: Column) -> Column:
    """array<struct<speaker, said>> of a transcript with 'SPEAKER NAME.' markers in capitals at line starts."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), "\\n(?=[A-Z][A-Z ]{2,40}[.:] )"), lambda p: F.regexp_like(p, F.lit("^[A-Z][A-Z ]{2,40}[.:] ")))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^([A-Z][A-Z ]{2,40})[.:] ", 1).alias("speaker"), F.regexp_replace(p, "^[A-Z][A-Z ]{2,40}[.:] ", "").alias("said")))
