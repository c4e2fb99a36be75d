"""Text functions as columns; the few that need Unicode folding are Arrow-batched."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Words that say nothing in a question.
STOP_WORDS = ["a", "an", "and", "by", "does", "for", "how", "in", "is", "of", "on", "the", "this", "through", "to", "what", "where", "which", "with"]
# Words too general to match on.
GENERIC_WORDS = ["a", "an", "the", "and", "or", "of", "for", "to", "in", "on", "by", "with", "loss", "objective", "function", "equation", "formula", "term", "value", "model", "paper", "method", "training", "optimization"]


@pandas_udf(StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    """NFKC, case-folded; runs of anything but word characters become one space. What repeats in a batch is folded once."""
    codes, own = pd.factorize(s.fillna(""))
    folded = pd.Series(own, dtype=object).map(lambda x: unicodedata.normalize("NFKC", x).casefold())
    return folded.str.replace(r"[^\w]+", " ", regex=True).str.split().str.join(" ").take(codes).reset_index(drop=True)


@pandas_udf(StringType())
def normalize_math(s: pd.Series) -> pd.Series:
    r"""NFKC, case-folded, without ``$``, ``\left``, ``\right``, white space and braces."""
    folded = s.fillna("").map(lambda x: unicodedata.normalize("NFKC", x).strip("$ ").casefold())
    return folded.str.replace(r"\\(?:left|right)", "", regex=True).str.replace(r"[\s{}]+", "", regex=True)


@pandas_udf(ArrayType(StringType()))
def normalize_texts(s: pd.Series) -> pd.Series:
    """normalize_text of each element; the distinct ones that aren't empty, in order."""

    def one(x: str) -> str:
        return " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", x or "").casefold()).split())

    return s.map(lambda a: list(dict.fromkeys(n for x in a if (n := one(x)))) if a is not None else [])


def normalize_ascii(c: Column) -> Column:
    """normalize_text of ASCII, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+", " "))


def retrieval_tokens(c: Column) -> Column:
    """Lower-case ASCII words and numbers without stop words; order and repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))


def significant_words(c: Column) -> Column:
    return F.array_except(word_set(c), F.array(*map(F.lit, GENERIC_WORDS)))


def overlap_at_least(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(a, b)) >= k


def stable_identifier(kind: Column, label: Column, math: Column | None = None, scope: Column | None = None) -> Column:
    """``kind:`` and 20 hex digits of SHA-256 over the normalised parts; labels and scopes already normalised."""
    empty = F.lit("")
    joined = F.concat(kind, F.lit("|"), F.coalesce(label, empty), F.lit("|"), F.coalesce(math, empty) if math is not None else empty, F.lit("|"), F.coalesce(scope, empty) if scope is not None else empty)
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(joined, 256), 1, 20))


def plural_variant(c: Column) -> Column:
    """The other number of the last alphabetic run, by productive rules; null for runs under two letters."""
    head = F.regexp_extract(c, r"^(.*?)([A-Za-z]+)([^A-Za-z]*)$", 1)
    word = F.regexp_extract(c, r"^(.*?)([A-Za-z]+)([^A-Za-z]*)$", 2)
    tail = F.regexp_extract(c, r"^(.*?)([A-Za-z]+)([^A-Za-z]*)$", 3)
    low, n = F.lower(word), F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    new = (
        F.when(low.rlike("ies$") & (n > 3), F.concat(cut(3), F.lit("y")))
        .when(low.rlike("(s|x|z|ch|sh)es$"), cut(2))
        .when(low.rlike("s$") & ~low.rlike("(ss|is|us)$"), cut(1))
        .when(low.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies")))
        .when(low.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )
    return F.when((n >= 2) & (F.lower(F.concat(head, new, tail)) != F.lower(c)), F.concat(head, new, tail))


def orthographic_variants(c: Column) -> Column:
    """Hyphens for white space and spaces for hyphens, where that is another form."""
    forms = F.array(F.regexp_replace(c, r"\s+", "-"), F.replace(c, F.lit("-"), F.lit(" ")))
    return F.filter(F.array_distinct(forms), lambda v: F.lower(v) != F.lower(c))


def legacy_text(c: Column) -> Column:
    """Lower case, white space collapsed; the empty text for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def legacy_math(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[$\s]+|[$\s]+$", ""), r"\\left|\\right", ""), r"[{}\s]", ""))


def ensure_math(c: Column) -> Column:
    return F.when(F.trim(c) == "", c).when(c.rlike(r"\$|\\\(|\\\["), c).otherwise(F.concat(F.lit("$"), c, F.lit("$")))


def math_signatures(c: Column) -> Column:
    """Normalised contents of the three kinds of math spans, each once, in order of kind."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(?s)\$(.+?)\$", r"(?s)\\\((.+?)\\\)", r"(?s)\\\[(.+?)\\\]")]
    return F.filter(F.array_distinct(F.transform(F.concat(*found), legacy_math)), lambda x: x != "")


def sanitize_id(c: Column) -> Column:
    return F.substring(F.translate(F.lower(c), " \\{}", "_"), 1, 64)


def significant_equation(is_display: Column, latex: Column) -> Column:
    return is_display & (F.length(latex) >= 3) & latex.rlike(r"[=<>]|\\(sum|prod|int|mathbb|mathcal|operatorname)")


def safe_rate(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def snippet(text: Column, start: Column, end: Column, width: int = 40) -> Column:
    """``width`` characters around [start, end), with dots where it was cut."""
    a, b = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    return F.concat(F.when(a > 0, "...").otherwise(""), F.substr(text, (a + 1).cast("int"), (b - a).cast("int")), F.when(b < F.length(text), "...").otherwise(""))


def bare_body(html: Column) -> Column:
    """What lies in the first body element; all where there is none."""
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(html.rlike(r"(?is)<body[^>]*>.*?</body>"), inner).otherwise(html)


def archive_kind(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.rlike(r"\.(tar\.gz|tgz|tar)$"), "tar").when(n.rlike(r"\.zip$"), "zip")


def arxiv_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf|e-print)/([0-9.]+)", 1)
    return F.when(found != "", found).when(F.trim(url).rlike(r"^[0-9.]+$"), F.trim(url))


# Greek commands that are symbols of their own.
GREEK = ["alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "nu", "pi", "rho", "sigma", "tau", "phi", "psi", "omega"]


def scoped_symbols(latex: Column) -> Column:
    """The symbols of a formula: Greek commands, then Latin letters with their index; each once by its normal form, without
    the running indices i, j and k."""
    greek = F.regexp_extract_all(latex, F.lit(r"(?i)\\(?:" + "|".join(GREEK) + ")"), F.lit(0))
    plain = F.regexp_replace(latex, r"\\(?:mathcal|mathbb|mathrm|mathbf|operatorname)\s*\{([^{}]+)\}", "$1")
    plain = F.regexp_replace(plain, r"\\[A-Za-z]+", " ")
    latin = F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z])[A-Za-z](?:_(?:\{[^{}]+\}|[A-Za-z0-9]+))?"), F.lit(0))
    found = F.transform(F.concat(greek, latin), lambda x: F.struct(x.alias("symbol"), F.lower(F.regexp_replace(x, r"[\s{}]", "")).alias("key")))
    kept = F.filter(found, lambda x: ~x["key"].isin("", "i", "j", "k"))
    first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: y["key"]), x["key"]) == i + 1)
    return F.transform(first, lambda x: x["symbol"])


def literal_starts(text: Column, part: Column) -> Column:
    """Where a literal part starts in a text (from 0), from left to right without overlap."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    upto = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: upto(k) + (k - 1) * F.length(part))
    return F.when((F.size(pieces) > 1) & (part != ""), starts).otherwise(F.array().cast("array<int>"))


# Words by which a role is told, in order.
ROLES = {"output": ["output", "result", "target"], "input": ["input", "feature", "argument"], "parameter": ["parameter", "weight", "coefficient"], "normalizer": ["normalizer", "denominator", "scale"], "state": ["state"]}


def formula_role(c: Column) -> Column:
    """The role of a part of a formula: that of the first rule with a word in the text, else the text; null for blank ones."""
    t = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    out = F.when(t == "", None)
    for role, words in ROLES.items():
        out = out.when(t.rlike("|".join(words)), role)
    return out.otherwise(t)
