"""Text functions of search, evidence and signatures, all JVM-side."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that search leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "for", "from", "has", "have", "how", "i", "if", "in", "into", "is", "it", "its", "of", "on", "or", "should", "so", "that", "the", "their", "then", "there", "these", "this", "to", "use", "used", "using", "was", "we", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you", "your",
)

#: White space as ECMAScript's \s has it.
SPACE = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def tokens(text: Column) -> Column:
    """Lower-case terms of a text in order: letters and digits, at least two, no stopwords, one plural s taken off longer ones."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.transform(kept, _singular)


def _singular(w: Column) -> Column:
    return F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def normalize_signature(signature: Column) -> Column:
    """A signature without what formatting alone changes: runs of white space, spaces around punctuation, a comma before a closing bracket."""
    # fixed values: the punctuation that loses spaces around it
    tight = F.regexp_replace(collapse(signature), r" ?([\[\](){}<>,;:=|&?.]) ?", "$1")
    return F.regexp_replace(tight, r",(?=[\])}>])", "")


def _folded(texts: pd.Series) -> pd.Series:
    """Lower case, compatibility forms taken apart, without the accents of Latin letters."""
    return texts.map(lambda t: None if t is None else re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t.lower())))


def slug(text: Column) -> Column:
    """Lower case, letters and digits joined by single hyphens, accents left out, 60 characters at most; decision where nothing is left. Spark has no normal forms of Unicode, so texts beyond ASCII go through Python in Arrow batches."""
    plain = F.when(text.rlike("^[\x00-\x7f]*$"), F.lower(text)).otherwise(F.pandas_udf(_folded, "string")(text))
    joined = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(text.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(F.substring(joined, 1, 60), "-$", ""), F.lit("")), F.lit("decision")))


def decision_id(raw: Column) -> Column:
    """The number of a decision reference, four digits at least; null where there is none."""
    digits = F.regexp_extract(raw, "([0-9]+)", 1)
    return F.when(digits != "", F.lpad(F.regexp_replace(digits, "^0+(?=[0-9])", ""), F.greatest(F.lit(4), F.length(F.regexp_replace(digits, "^0+(?=[0-9])", ""))), "0"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)
