"""Column expressions for tokenizing, trimming, quoting and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end; ``trim`` alone strips U+0020 only.
EDGE_SPACE = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def trim_space(value: Column) -> Column:
    return F.regexp_replace(value, EDGE_SPACE, "")


def normalize_word(word: Column) -> Column:
    """Strips one plural s from words of more than four bytes that don't end in ss or us."""
    plural = (F.octet_length(word) > 4) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def tokens(value: Column) -> Column:
    """Search tokens: normalized words, single Han characters, and bigrams of adjacent Han characters.

    Null has no tokens. Order is by kind, not by place; ranking uses counts only.
    """
    lower = F.lower(F.coalesce(value, F.lit("")))
    words = F.regexp_extract_all(F.regexp_replace(lower, r"\p{IsHan}", " "), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    runs = F.regexp_extract_all(lower, F.lit(r"\p{IsHan}+"), F.lit(0))

    def grams(size: int):
        return lambda run: F.when(
            F.char_length(run) >= size, F.transform(F.sequence(F.lit(1), F.char_length(run) - size + 1), lambda i: F.substring(run, i, F.lit(size)))
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(F.transform(words, normalize_word), F.flatten(F.transform(runs, grams(1))), F.flatten(F.transform(runs, grams(2))))


# Classes of full-text tokens, in the order in which they are tried; repeats are bounded, so that a
# text without blanks costs linear time. None ends inside a word.
_LETTER, _WORD = r"[\p{L}\p{M}]", r"[\p{L}\p{M}\p{Nd}]"
_END = rf"(?!{_WORD})"
_HOST = r"(?:[a-z0-9][a-z0-9_-]{0,62}\.){1,32}[a-z]{2,63}"
_PART = rf"\p{{Nd}}{{0,20}}{_LETTER}{_WORD}*+"
LEXEME_CLASSES = {
    "tag": r"<[a-z/!?][^<>]{0,1000}>",
    "entity": r"&(?:[a-z][a-z0-9]{1,31}|#[0-9]{1,7}|#x[0-9a-f]{1,6});",
    "protocol": r"[a-z][a-z0-9]{0,30}://",
    "email": rf"[a-z0-9][a-z0-9_.+-]{{0,63}}@{_HOST}{_END}",
    "url": rf"{_HOST}(?::[0-9]{{1,5}})?/[!#-;=?-\[\]_a-z~]*+",
    "host": rf"{_HOST}(?::[0-9]{{1,5}})?{_END}",
    "exponent": rf"[-+]?[0-9]{{1,40}}(?:\.[0-9]{{1,40}})?e[-+]?[0-9]{{1,5}}{_END}",
    "version": rf"[0-9]{{1,40}}(?:\.[0-9]{{1,40}}){{2,32}}{_END}",
    "decimal": rf"[-+]?[0-9]{{1,40}}\.[0-9]{{1,40}}{_END}",
    "signed": rf"[-+][0-9]{{1,40}}{_END}",
    "file": rf"(?:[a-z][a-z0-9]{{0,254}}(?:[./][a-z0-9_][a-z0-9_-]{{0,254}}){{1,32}}|(?:~|\.{{1,2}})?(?:/[a-z0-9_][a-z0-9_.-]{{0,254}}){{1,32}}){_END}",
    "compound": rf"{_PART}(?:-{_PART}){{1,32}}",
    "word": rf"{_WORD}++",
}
#: Classes that are recognized and left out.
UNINDEXED = ("tag", "entity", "protocol")


def lexemes(value: Column) -> Column:
    """Full-text lexemes in lower case, by class of token; null has none.

    Words are runs of letters, marks and digits (a Han run is one). Hosts, emails, file
    paths, versions and signed, decimal and exponential numbers are one lexeme each. A url
    gives itself, its host and its path; a hyphenated compound gives itself and its parts.
    Tags, entities and protocols give none. A token over the bounds of its class (33 parts
    of a compound, names of 64 bytes) is taken apart into what its pieces are.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("|".join(LEXEME_CLASSES.values())), F.lit(0))
    unindexed = "|".join(LEXEME_CLASSES[c] for c in UNINDEXED)
    kept = F.filter(found, lambda t: ~t.rlike(f"^(?:{unindexed})$"))

    def pieces(token: Column) -> Column:
        host = F.substring_index(token, "/", 1)
        path = F.substring(token, F.length(host) + 1, F.length(token))
        return (
            F.when(token.rlike(f"^{LEXEME_CLASSES['url']}$"), F.array(token, host, path))
            .when(token.rlike(f"^{LEXEME_CLASSES['compound']}$"), F.concat(F.array(token), F.split(token, "-")))
            .otherwise(F.array(token))
        )

    plain = rf"^{_WORD}+$"
    return F.flatten(F.transform(kept, lambda t: F.when(t.rlike(plain), F.array(t)).otherwise(pieces(t))))


def quoted(value: Column) -> Column:
    """Double-quoted with escapes for quotes, backslashes and the control characters that have a short escape."""
    out = F.coalesce(value, F.lit(""))
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


DOCUMENT_VERSION = "memory-card-document-v1"


def card_document(version: str = DOCUMENT_VERSION) -> Column:
    """The canonical text of a card: eight lines of name=quoted value."""
    fields = [("document_version", F.lit(version)), *[(n, F.col(c)) for n, c in (("kind", "kind"), ("category", "category"), ("key", "memory_key"), ("value", "value"), ("person", "person"), ("relationship", "relationship"), ("backstory", "backstory"))]]
    return F.concat(*[F.concat(F.lit(f"{name}="), quoted(value), F.lit("\n")) for name, value in fields])


def identity_key(*parts: Column) -> Column:
    """SHA-256 over the parts' trimmed lower-case text, each with its byte length before and a zero byte after."""
    normal = [F.lower(trim_space(F.coalesce(p, F.lit("")))) for p in parts]
    framed = [F.concat(F.octet_length(n).cast("string"), F.lit(":"), n, F.lit("\x00")) for n in normal]
    return F.sha2(F.concat(*framed), 256)


def json_map(value: Column) -> Column:
    """A map of strings as JSON text; null is the empty object."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def map_of_json(value: Column) -> Column:
    """The map of strings in JSON text; null and text that isn't an object are the empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(value, "map<string,string>"), empty)
