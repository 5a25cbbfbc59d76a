"""Text functions as Column expressions (compatibility normalisation alone needs Python)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolith.runtime import WHITE, let

_ANY_WHITE = f"[{WHITE}]+"


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; ASCII texts pass untouched, others are worked out once per distinct value."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            codes, distinct = pd.factorize(texts, use_na_sentinel=True)
            made = pd.Series([t if t.isascii() else unicodedata.normalize("NFKC", t) for t in distinct] + [None], dtype=object)
            yield pd.Series(made.to_numpy()[codes], index=texts.index)

    return form(text)


def casefold(text: Column) -> Column:
    """Full case folding; the one common letter that `lower` does not fold is sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(text, _ANY_WHITE, " "))


def source_text(text: Column) -> Column:
    """Repairs of recognised text after `nfkc`: no invisible signs, stops and middle dots between digits as dots."""
    plain = F.translate(text, "．。‧​⁠­", "..·")
    return F.regexp_replace(plain, "(?<=[0-9])[·∙](?=[0-9])", ".")


#: Raised signs and their plain forms. Fixed values.
RAISED, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+"


def label_marked(text: Column) -> Column:
    """First half of label normalisation, before `nfkc`: a run of raised signs becomes ^ and plain signs."""
    return F.translate(F.regexp_replace(text, f"([{RAISED}]+)", "^$1"), RAISED, PLAIN)


def label_text(text: Column) -> Column:
    """Label normalisation: raised runs marked, compatibility forms, plain minus, single blanks."""
    return squeeze(F.replace(nfkc(label_marked(text)), F.lit("−"), F.lit("-")))


def join_lines(lines: Column) -> Column:
    """Wrapped lines as one: a hyphen at a line end goes, unless its word has another hyphen or a digit, or the next line
    begins with a digit or a capital letter. Blank lines vanish; null is null; an empty list gives an empty text.
    """

    def add(done: Column, line: Column) -> Column:
        word = F.regexp_extract(done, "([^ ]*)-$", 1)
        keep = word.rlike("[-\\p{Nd}]") | line.rlike("^[\\p{Nd}\\p{Lu}]")
        joined = F.when(done == "", line).when(done.endswith("-"), F.concat(F.when(keep, done).otherwise(F.substring(done, F.lit(1), F.length(done) - 1)), line)).otherwise(F.concat(done, F.lit(" "), line))
        return F.when(line == "", done).otherwise(joined)

    return F.aggregate(F.transform(lines, squeeze), F.lit(""), add)


def paragraph(text: Column) -> Column:
    """`join_lines` over the lines of a text."""
    return join_lines(F.split(text, "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"))


def safe_segment(raw: Column, most: int = 100) -> Column:
    """A path segment: signs no file system takes become ` - `, blanks are single, none or dots at the ends, `untitled` if
    nothing is left; a longer one is cut and ends in two underscores and eight hex digits of the raw text's SHA-1.
    """
    plain = F.btrim(F.regexp_replace(F.regexp_replace(raw, '[\\\\/:*?"<>|]', " - "), _ANY_WHITE, " "), F.lit(" ."))

    def of_plain(p: Column) -> Column:
        short = F.concat(F.regexp_replace(F.substring(p, F.lit(1), F.lit(most - 10)), _ANY_WHITE + "$", ""), F.lit("__"), F.substring(F.sha1(raw), 1, 8))
        return F.when(p == "", F.lit("untitled")).when(F.length(p) <= most, p).otherwise(short)

    return let(plain, of_plain)


def yaml_quoted(text: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_list(values: Column) -> Column:
    """A YAML flow list of quoted scalars."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, yaml_quoted), ", "), F.lit("]"))


def relative_path(path: Column, start: Column) -> Column:
    """`path` below `start`, with forward slashes; null if it isn't below."""
    p, s = F.replace(path, F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(start, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.startswith(p, F.concat(s, F.lit("/"))), F.substring(p, F.length(s) + 2, F.length(p)))


def outline_key(title: Column) -> Column:
    """Key of a heading: folded, & as `and`, letters and digits only (apply after `nfkc`)."""
    return F.regexp_replace(F.replace(casefold(title), F.lit("&"), F.lit("and")), "[^\\p{L}\\p{N}]+", "")


def printed_page(text: Column) -> Column:
    """Number or label of the first line `Page X`; digits come without leading zeros."""
    found = F.regexp_extract(text, "(?m)^\\s*Page\\s+([A-Za-z0-9.-]+)\\s*$", 1)
    return F.when(found == "", F.lit(None).cast("string")).when(found.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(found, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(found)


def artifact_key(text: Column) -> Column:
    """A key for artifact names: runs of other signs than letters, digits, dots and hyphens are underscores."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9.-]+", "_"), F.lit("_"))


def textish(value: Column) -> Column:
    """Text of a JSON value given as a string: strings trimmed, lists joined by blanks, of objects the first of content,
    text, caption and value; null is empty. Lists inside lists keep their JSON.
    """
    first = F.coalesce(*(F.get_json_object(value, f"$.{k}") for k in ("content", "text", "caption", "value")))
    items = F.from_json(value, "array<string>")
    return squeeze(F.coalesce(F.when(F.startswith(F.ltrim(value), F.lit("[")), F.array_join(F.filter(items, lambda x: F.btrim(x) != ""), " ")), F.when(F.startswith(F.ltrim(value), F.lit("{")), first), value, F.lit("")))
