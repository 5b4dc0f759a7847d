"""String expressions: names, labels, synonyms, templates, hashes.

All are Column -> Column, run on the JVM, and return null for a null input
unless stated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null for a string of nothing but spaces."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Trimmed, lower-cased, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_entity(c: Column, stopwords: Sequence[str], least: int = 3) -> Column:
    """Entity key: no edge punctuation, lower case, no leading article.

    Articles go in the fixed order the, a, an, one of each at most.  Null when
    shorter than ``least``, a number, or nothing but stopwords.
    """
    s = F.lower(F.regexp_replace(c, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", ""))
    s = F.regexp_replace(s, r"\s+", " ")
    for article in ("the ", "a ", "an "):
        s = F.when(s.startswith(article), F.substr(s, F.lit(len(article) + 1))).otherwise(s)
    only_stopwords = F.forall(F.split(s, " "), lambda w: w.isin(*stopwords))
    return F.when((F.length(s) >= least) & ~s.rlike(r"^[0-9.,]+$") & ~only_stopwords, s)


def first_by_lower(items: Column) -> Column:
    """Distinct by lower case, first spelling wins, order kept."""
    return F.aggregate(
        items,
        F.slice(items, 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def sort_by_lower(items: Column) -> Column:
    """Ascending by lower case, then by spelling."""
    keyed = F.transform(items, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s.v)


def clean_synonyms(items: Column, label: Column, most: int | None = None) -> Column:
    """Trimmed, without blanks and the label, distinct and sorted by lower case."""
    s = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != F.lower(F.trim(label))))
    s = sort_by_lower(first_by_lower(s))
    return F.slice(s, 1, most) if most else s


def truncate_sentence(c: Column, most: int) -> Column:
    """At most ``most`` characters, up to the last sentence break among them.

    Without a break the text is cut hard.
    """
    head = F.substring(c, 1, most)
    upto = F.regexp_extract(head, r"(?s)^(.+\.) ", 1)
    return F.when(F.length(c) <= most, c).when(upto != "", upto).otherwise(head)


def humanize(c: Column) -> Column:
    """Identifier to words: without its first ``PREFIX_``, spaces, sentence case."""
    words = F.replace(F.regexp_replace(c, r"^[^_]*_", ""), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def sentence_case(c: Column, acronyms: Sequence[str]) -> Column:
    """Lower case but for acronyms, each part of a hyphenated word on its own.

    An acronym may carry digits or ``+``; a first word that is no acronym gets a
    capital.
    """

    def part(p: Column) -> Column:
        stem = F.upper(F.regexp_replace(p, r"[0-9+]+$", ""))
        return F.when(stem.isin(*acronyms), F.upper(p)).otherwise(F.lower(p))

    words = F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-"))
    s = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def id_number(c: Column) -> Column:
    """The first run of digits as a number; an error if there is none."""
    d = F.regexp_extract(c, r"([0-9]+)", 1)
    return F.when(d != "", d.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no number in id: "), c)))


def map_or_fail(c: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value; an error for a value that is not in the mapping."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("not in mapping: "), F.coalesce(c, F.lit("null")))))


def word_boundary(terms: Sequence[str]) -> str:
    """A pattern for any of these (plain) terms between spaces or ends."""
    import re

    return r"(^|\s)(" + "|".join(re.escape(t) for t in terms) + r")(\s|$)"


def keyword_level(c: Column, levels: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first level with one of its keywords as a whole word, in any case."""
    s, out = F.lower(c), None
    for name, words in levels:
        hit = s.rlike(word_boundary([w.lower() for w in words]))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """Whether the lower-cased text has any of these substrings."""
    return F.exists(F.array(*[F.lit(n.lower()) for n in needles]), lambda n: F.lower(c).contains(n))


def substring_category(c: Column, categories: Sequence[tuple[str, Sequence[str]]], default: Column) -> Column:
    """The first category with one of its substrings, else ``default``."""
    out = None
    for name, needles in categories:
        out = F.when(contains_any(c, needles), F.lit(name)) if out is None else out.when(contains_any(c, needles), F.lit(name))
    return out.otherwise(default)


def fill(template: Column, **values: Column) -> Column:
    """``{name}`` in the template by the value of that name; null values as empty."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def unordered_class(a: Column, b: Column, classes: Mapping[tuple[str, str], str], default: str) -> Column:
    """A class of a pair whatever its order."""
    both, out = F.array_sort(F.array(a, b)), None
    for pair, name in classes.items():
        hit = both == F.array(*[F.lit(x) for x in sorted(pair)])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def parse_list(c: Column, separator: str = ",") -> Column:
    """Distinct upper-cased items of a delimited text, blanks left out."""
    items = F.transform(F.split(c, separator), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def hash_of_map(m: Column, leave_out: Sequence[str] = ()) -> Column:
    """sha256 of ``key=value`` pairs in key order, secrets left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin(*leave_out))))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value)), "&"), 256)


def request_key(url: Column, params: Column, leave_out: Sequence[str] = ()) -> Column:
    """sha256 of a URL and its parameters in key order, secrets left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(params, lambda k, v: ~k.isin(*leave_out))))
    return F.sha2(F.concat(url, F.lit("?"), F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value)), "&")), 256)


def first_items(items: Column, most: int = 5, restyle: bool = False, separator: str = ", ") -> Column:
    """The first items as one text; ``restyle`` gives each a capital (ASCII) and small letters."""

    def styled(x: Column) -> Column:
        # Only ASCII capitals: engines differ in the capital of a sharp s.
        head = F.when(x.rlike("^[a-z]"), F.upper(F.substring(x, 1, 1))).otherwise(F.substring(x, 1, 1))
        return F.concat(head, F.lower(F.substr(x, F.lit(2))))

    first = F.slice(items, 1, most)
    return F.array_join(F.transform(first, styled) if restyle else first, separator)


def seed_of(seed: int, key: Column) -> Column:
    """First 8 bytes of sha256("seed|key"), little-endian, modulo 2^63 - 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), key), 256)
    octets = F.transform(F.reverse(F.sequence(F.lit(0), F.lit(7))), lambda i: F.substring(digest, i * 2 + 1, F.lit(2)))
    number = F.conv(F.array_join(octets, ""), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint")


def decode_barcode(c: Column) -> Column:
    """``b'AC-1'`` as written by a bytes repr, to ``AC-1``; other text is trimmed."""
    return F.trim(F.regexp_replace(c, r"""^b(['"])(.*)\1$""", "$2"))


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def redact(c: Column, parameter: str) -> Column:
    """The value of a query parameter in a URL replaced by ``***``."""
    return F.regexp_replace(c, rf"([?&]{parameter}=)[^&#]*", "$1***")


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def priority_rank(c: Column, priority: Sequence[str]) -> Column:
    """1-based place in the list; what is not in it, null too, comes after all."""
    place = F.array_position(F.array(*[F.lit(x) for x in priority]).cast("array<string>"), c)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(priority) + 1).otherwise(place).cast("int")


def prompt_block(fields: Mapping[str, Column], long: Mapping[str, int] | None = None) -> Column:
    """One ``name: value`` a line, in this order; nulls are empty, ``long`` bounds characters by name."""
    long = long or {}
    values = {n: F.coalesce(v.cast("string"), F.lit("")) for n, v in fields.items()}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.substring(v, 1, long[n]) if n in long else v) for n, v in values.items()])
