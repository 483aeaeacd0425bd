"""Column expressions on text: identities, normalisation, token estimates. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a problem description (fixed values).
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her",
    "it", "its", "they", "them", "their", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "of", "in", "to", "for", "with",
    "on", "at", "by", "from", "as", "into", "about", "not", "no", "nor", "but", "and", "or", "so", "if", "then", "than", "when", "where", "how",
    "why", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "too", "very", "just", "also", "now",
    "here", "there",
)

#: HTML entities that are undone, in this order (fixed values).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"))

#: How names, closing references, versions and members are spelt, and the mark of a cut text (fixed values).
CAMEL_CASE = "[A-Z][a-zA-Z]{2,}"
CLOSING = r"(?i)(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*#(\d+)"
VERSION = r"1\.\d{2,3}(?:\.\d+)?"
DOTTED = r"[A-Z][a-zA-Z]+\.[a-zA-Z]+"
TRUNCATED = "\n... [truncated]"
#: What questions are cleared of, phrases are cut by, a source path's module, tags, and what an id is made of (fixed values).
NOT_ASKED = r"[^a-z0-9\s-]"
PHRASE_BREAK = r"[\s_-]+"
SOURCE_MODULE = r"Source/(.+?)/[^/]+\.js$"
TAG = "<[^>]*>"
NOT_IN_ID, ID_ENDS = "[^a-z0-9]+", "^_+|_+$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- identities -----------------------------------------------------------------------------------------------------


def symbol_id(file_path: str | Column, name: str | Column, kind: str | Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", _c(file_path), _c(name), _c(kind))), 1, 12)


def normal_kind(kind: str | Column) -> Column:
    k = F.lower(_c(kind))
    return F.when(k.isin("class", "function", "method", "enum", "constant"), k).when(k == "const", F.lit("constant")).otherwise(F.lit("function"))


def qualified_name(name: str | Column, parent: str | Column, file_path: str | Column) -> Column:
    """parent.name; else the path below Source as dots, then the name; else the name."""
    module = F.regexp_replace(F.regexp_extract(F.coalesce(_c(file_path), F.lit("")), SOURCE_MODULE, 1), "/", ".")
    has_parent = F.coalesce(_c(parent), F.lit("")) != ""
    return F.when(has_parent, F.concat_ws(".", _c(parent), _c(name))).when(module != "", F.concat_ws(".", module, _c(name))).otherwise(_c(name))


def identity(name: str | Column, kind: str | Column, parent: str | Column, file_path: str | Column) -> Column:
    """What names a symbol in every version: a struct of its plain kind and its full name."""
    return F.struct(normal_kind(kind).alias("kind"), qualified_name(name, parent, file_path).alias("fqn"))


def same_identity(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["fqn"] == b["fqn"])


def stable_id(kind: str | Column, fqn: str | Column) -> Column:
    """An id of a symbol that stays the same from version to version."""
    return F.concat(F.lit("sym/"), F.sha1(F.concat_ws(":", normal_kind(kind), _c(fqn))))


def snapshot_id(version: str | Column, symbol: str | Column) -> Column:
    return F.concat(F.lit("snapshot/"), _c(version), F.lit("/"), _c(symbol))


def breaking_id(from_version: str | Column, to_version: str | Column, symbol: str | Column) -> Column:
    return F.concat(F.lit("breaking/"), F.sha1(F.concat_ws(":", _c(from_version), _c(to_version), _c(symbol))))


def point_id(text: str | Column) -> Column:
    """A 31-bit rolling hash of a string, kept for exchange with stores that use such ids; string ids are the engine's own."""
    units = F.filter(F.split(_c(text), ""), lambda c: c != "")
    wrapped = F.aggregate(units, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.abs(F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped))


def code_lines(content: str | Column, start: str | Column, end: str | Column) -> Column:
    """Lines start to end (from 1, both included)."""
    return F.array_join(F.slice(F.split(_c(content), "\n"), _c(start), F.greatest(_c(end) - _c(start) + 1, F.lit(0))), "\n")


# --- text -----------------------------------------------------------------------------------------------------------


def strip_html(html: str | Column) -> Column:
    """Tags dropped, entities undone, white space collapsed, ends trimmed."""
    text = F.regexp_replace(_c(html), TAG, "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def symbol_mentions(text: str | Column) -> Column:
    """Distinct capitalised names, in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(CAMEL_CASE), 0))


def closing_references(body: str | Column) -> Column:
    """Numbers of issues that a text says it closes."""
    return F.transform(F.regexp_extract_all(F.coalesce(_c(body), F.lit("")), F.lit(CLOSING), 1), lambda x: x.cast("long"))


def summary(text: str | Column, most: int = 500) -> Column:
    return F.when(F.length(_c(text)) > most, F.concat(F.substring(_c(text), 1, most), F.lit("..."))).otherwise(_c(text))


def query_tokens(query: str | Column) -> Column:
    """Lower-cased tokens of a question, without punctuation (hyphens stay) and stop words; repeats stay."""
    plain = F.regexp_replace(F.lower(_c(query)), NOT_ASKED, " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def phrase_tokens(phrase: Column) -> Column:
    return F.filter(F.split(F.lower(phrase), PHRASE_BREAK), lambda t: t != "")


def holds_phrase(tokens: Column, wanted: Column) -> Column:
    """The wanted tokens (see `phrase_tokens`) stand in a row among the tokens."""
    n = F.size(wanted)
    last = F.size(tokens) - n
    rows = F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(tokens, i + 1, F.greatest(n, F.lit(1))) == wanted)
    return (n > 0) & (last >= 0) & F.array_contains(tokens, F.get(wanted, F.lit(0))) & ((n == 1) | rows)


def overlap(tokens: Column, wanted: Column) -> Column:
    """How many of the wanted tokens, repeats counted, are among the tokens."""
    return F.size(F.filter(wanted, lambda t: F.array_contains(tokens, t)))


def safe_id(text: str | Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), NOT_IN_ID, "_"), ID_ENDS, ""), 1, 64)


# --- token estimates ------------------------------------------------------------------------------------------------


def utf16_length(text: str | Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")


def token_estimate(text: str | Column) -> Column:
    """A quarter of the length, rounded up; 0 for null and empty texts."""
    return F.coalesce(F.ceil(utf16_length(_c(text)) / 4), F.lit(0)).cast("long")


def utf16_prefix(text: str | Column, units: Column) -> Column:
    """The first so many UTF-16 units; a character that the end would cut in two is left out."""
    raw = F.encode(_c(text), "UTF-16BE")
    # a unit from D800 to DBFF is the first half of a character
    half = F.hex(F.substring(raw, 2 * units - 1, F.lit(1))).rlike("^D[89AB]")
    return F.decode(F.substring(raw, F.lit(1), 2 * F.when(half, units - 1).otherwise(units)), "UTF-16BE")


def truncate_text(text: str | Column, most_tokens: int | Column) -> Column:
    """The text, or as much of it as so many tokens hold, with a mark."""
    n = (F.lit(most_tokens) if isinstance(most_tokens, int) else most_tokens).cast("int")
    plain = F.octet_length(_c(text)) == F.char_length(_c(text))
    cut = F.when(plain, F.substring(_c(text), F.lit(1), 4 * n)).otherwise(utf16_prefix(text, 4 * n))
    return F.when(n <= 0, F.lit("")).when(utf16_length(_c(text)) <= 4 * n, _c(text)).otherwise(F.concat(cut, F.lit(TRUNCATED)))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, in doubles."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def embedding_text_issue(title: str | Column, labels: str | Column, body: str | Column) -> Column:
    flat = F.substring(F.trim(F.regexp_replace(F.coalesce(_c(body), F.lit("")), r"\s+", " ")), 1, 1500)
    return F.trim(F.concat_ws(" ", _c(title), F.array_join(F.coalesce(_c(labels), F.array().cast("array<string>")), " "), flat))
