"""Column functions on text: tokenizers, lines, hashes and small string rules.

Lengths are in code points. All functions give null for null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of `[a-z0-9_]`, without those of one character other than `a` and `i`."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) | t.isin("a", "i"))


def unicode_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


# Words that a conversation query leaves out, and what it adds for some verbs.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "to", "of", "and", "in", "for", "on", "with", "true", "false", "null", "none")
SYNONYMS = {
    "list": ("get", "fetch", "show", "enumerate"),
    "create": ("add", "new", "make", "insert"),
    "search": ("find", "query", "lookup"),
    "delete": ("remove", "destroy", "drop"),
    "update": ("edit", "modify", "change", "patch"),
    "run": ("execute", "invoke", "start"),
    "get": ("fetch", "read", "retrieve"),
}


def bigrams(words: Column) -> Column:
    """Neighbours joined by a space."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def conversation_terms(text: Column) -> Column:
    """The words of an utterance without stop words, each once, their bigrams, and synonyms of action verbs, as one string."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), "[_-]", " "), F.lit("[a-z0-9]+"), F.lit(0))
    words = F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(words, lambda w: F.coalesce(table[w], F.array().cast("array<string>"))))
    return F.array_join(F.array_distinct(F.concat(words, bigrams(words), more)), " ")


def identifier_words(name: Column) -> Column:
    """Words of an identifier in camel, snake or kebab case, without those of one character."""
    parts = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(parts, "[^A-Za-z0-9]", " ")), " +"), lambda w: F.length(w) > 1)


def without_number(line: Column) -> Column:
    """A displayed line without its number."""
    return F.regexp_replace(line, r"^\s*\d+[.:]\s?", "")


def unix_lines(text: Column, *, lone: bool = True) -> Column:
    """CR LF, and lone CRs too if asked, as LF."""
    return F.regexp_replace(text, "\r\n?" if lone else "\r\n", "\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def body(text: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last, from 1."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.array_join(F.slice(lines(unix_lines(text)), first, last - first + 1), "\n")


def body_hash(text: Column, first: Column | int, last: Column | int) -> Column:
    return F.sha2(body(text, first, last), 256)


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def bucket(value: Column, buckets: int = 100) -> Column:
    """A stable bucket: the first 32 bits of a SHA-256."""
    return (F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def in_canary(value: Column, percent: float) -> Column:
    return bucket(value) < percent


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def rational_sigmoid(x: Column) -> Column:
    """A quotient of cubics near the sigmoid."""
    return F.when(x >= 8, 1.0).when(x <= -8, 0.0).otherwise((x * x * x + 6.0 * x + 12.0) / (x * x * x + 12.0 * x + 48.0))


def summary(text: Column, most: int = 80) -> Column:
    """The first sentence if it fits, else as much as does and an ellipsis."""
    first = F.regexp_extract(text, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.when((first != "") & (F.length(first) <= most), first).when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…")))


def mentions_any(text: Column, triggers: Column) -> Column:
    return F.exists(triggers, lambda t: F.contains(F.lower(text), F.lower(t)))


def readable_size(n: Column, largest: str = "TB") -> Column:
    """1024-based, with two decimals from KB on, in units up to `largest`."""
    units = ("B", "KB", "MB", "GB", "TB")[: ("B", "KB", "MB", "GB", "TB").index(largest) + 1]
    shown = lambda k: F.concat(F.format_string("%.2f", n / F.lit(1024.0**k)), F.lit(f" {units[k]}")) if k else F.concat(n.cast("string"), F.lit(" B"))
    out = shown(len(units) - 1)
    for k in range(len(units) - 2, -1, -1):
        out = F.when(n < 1024 ** (k + 1), shown(k)).otherwise(out)
    return out


def plural(word: Column) -> Column:
    return (
        F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies"))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def marker(first: Column, last: Column) -> Column:
    """What stands for lines left out."""
    return F.concat(F.lit("[TRUNCATED: lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("]"))


def count_of(text: Column, part: str) -> Column:
    """Occurrences that don't overlap."""
    return F.regexp_count(text, F.lit(re.escape(part)))


def namespace_of(key: Column) -> Column:
    return F.substring_index(key, "__", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def tech_words(line: Column) -> Column:
    """Distinct lower-cased words that start with a letter, of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit("[a-z][a-z0-9+#.-]{2,}"), F.lit(0)))
