"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without meaning for a search.
COMMON_WORDS = "a an and are as at be by code does file find for from function get has have how in into is it its method of on or set show that the this to use used what when where which who why with".split()

# Words searched for together.
SYNONYMS = (("auth", "login", "session", "credential"), ("db", "database", "storage", "store"), ("delete", "remove", "drop"), ("fetch", "get", "load", "read"), ("error", "failure", "exception"), ("config", "settings", "options"), ("invoice", "billing", "payment"), ("repo", "repository"), ("msg", "message"), ("req", "request"))

SECRET = r"(?i)((?:api[_-]?key|secret|token|password|passwd|authorization|bearer)[\"']?\s*[:=]\s*[\"']?)([^\s\"',;}]+)"


def tokenize(c: Column) -> Column:
    """Lower-case tokens split at control characters, spaces and ``_ / . :``."""
    return F.filter(F.split(F.lower(c), r"[\x00-\x20_/.:]+"), lambda x: x != "")


def meaningful(tokens: Column) -> Column:
    """Distinct tokens of three bytes or more that are no common words, in order."""
    return F.array_distinct(F.filter(tokens, lambda x: (F.octet_length(x) >= 3) & ~x.isin(COMMON_WORDS)))


def doc_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)


def split_identifier(c: Column) -> Column:
    """Words of camelCase, PascalCase, ACRONYMWord, digit and separator boundaries, lower-case, two letters or more."""
    s = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(s), r"[^a-z0-9]+"), lambda x: (F.length(x) >= 2) & ~x.rlike("^[0-9]+$"))


def humanize(c: Column) -> Column:
    return F.array_join(split_identifier(c), " ")


def singular(c: Column) -> Column:
    return F.when(c.endswith("ies") & (F.length(c) > 4), F.regexp_replace(c, "ies$", "y")).when(c.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(c, "es$", "")).when(c.endswith("s") & ~c.endswith("ss") & (F.length(c) > 3), F.regexp_replace(c, "s$", "")).otherwise(c)


def trigrams(c: Column) -> Column:
    """Three-character windows, with repeats; none of shorter texts."""
    n = F.length(c)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def occurrences(doc: Column, term: Column) -> Column:
    """Non-overlapping substring count, in bytes as the term length demands."""
    return (F.octet_length(doc) - F.octet_length(F.replace(doc, term, F.lit("")))) / F.octet_length(term)


def redact(c: Column) -> Column:
    return F.regexp_replace(c, SECRET, "$1[REDACTED]")


def preview(c: Column, n: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(redact(c), r"\s+", " ")), 1, n)


def estimate_tokens(c: Column) -> Column:
    return F.floor((F.octet_length(c) + 3) / 4).cast("bigint")


def rough_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def html_to_text(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?is)<(script|style|nav|footer|header|svg)\b[^>]*>.*?</(script|style|nav|footer|header|svg)>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def short_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def term_hits(text: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))


def term_score(text: Column, terms: Column) -> Column:
    """Sum over matched terms of 1 + 0.1 for each further occurrence."""
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.when(F.contains(F.lower(text), t), 1.0 + 0.1 * (occurrences(F.lower(text), t) - 1)).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, missing vectors or a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def quantize(v: Column, dims: int = 64) -> Column:
    """Sign bits as BIGINT words of 64 dimensions."""
    words = [F.aggregate(F.transform(F.slice(v, w * 64 + 1, 64), lambda x, i: F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b)) for w in range((dims + 63) // 64)]
    return F.array(*words)


def hamming_similarity(a: Column, b: Column) -> Column:
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return 1 - diff / (64 * F.size(a))


def round3(c: Column) -> Column:
    return F.round(c, 3)


def json_path(body: Column, path: str) -> Column:
    """The value at a dotted path (numbers are places in lists) of a JSON text; null where it is missing or no JSON."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return F.get_json_object(body, "$" + steps)
