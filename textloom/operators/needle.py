"""Search strings ("needles") as expressions: byte-exact, case-sensitive, overlapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(needle: str) -> str:
    """A regular expression for the needle itself, whatever characters it has."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in needle)


def overlaps_itself(needle: str) -> bool:
    """Whether two occurrences can overlap: some proper prefix is also a suffix (prefix function)."""
    fail = [0] * len(needle)
    for i in range(1, len(needle)):
        k = fail[i - 1]
        while k and needle[i] != needle[k]:
            k = fail[k - 1]
        fail[i] = k + (needle[i] == needle[k])
    return bool(needle) and fail[-1] > 0


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle stands in the text. All in generated code; texts without it cost one search."""
    if not needle:
        return F.octet_length(text).cast("long") + 1
    if overlaps_itself(needle):
        n = F.regexp_count(text, F.lit(f"(?={pattern(needle)})")).cast("long")
    else:
        size = len(needle.encode())
        n = F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))) / size).cast("long")
    return F.when(F.contains(text, F.lit(needle)), n).otherwise(F.lit(0).cast("long"))


def positions(text: Column, needle: str) -> Column:
    """Byte positions of all occurrences, ascending: pieces between zero-width cuts, and the running sum of their lengths."""
    cut = F.split(text, f"(?={pattern(needle)})", -1)
    start = F.aggregate(
        cut,
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.octet_length(x)).alias("at"),
            F.when(F.startswith(x, F.lit(needle)), F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"]).alias("found"),
        ),
    )["found"]
    return F.when(F.contains(text, F.lit(needle)), start).otherwise(F.expr("cast(array() as array<bigint>)"))


#: Bytes up to which a needle is compared by a regular expression; its groups are nested as deep.
MOST_BYTES = 256


def smaller_suffixes(text: Column, needle: str) -> Column:
    """How many suffixes of ``separator + text`` sort before a needle of at most ``MOST_BYTES`` bytes, in one pass over the bytes.

    The bytes are viewed as Latin-1. A suffix is smaller if it agrees with the needle for some bytes and is then below
    it; separator and terminator are above every byte of UTF-8, so borders need no special case.
    """
    word = needle.encode()
    if len(word) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes")
    # [below b1]|b1(?:[below b2]|b2(?:...)): as long as the needle, not as its square.
    inner = ""
    for b in reversed(word):
        below = f"[\\x00-\\x{b - 1:02x}]" if b else ""
        deeper = f"\\x{b:02x}(?:{inner})" if inner else ""
        inner = "|".join(x for x in (below, deeper) if x)
    if not inner:
        return F.lit(0).cast("long")
    view = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.regexp_count(view, F.lit(f"(?s)(?={inner})")).cast("long")


def highlight(text: Column, needle: Column | str) -> Column:
    """``ARRAY<STRUCT<text, label>>``: leftmost non-overlapping occurrences labelled "0", what lies between them unlabelled."""
    word = F.lit(needle) if isinstance(needle, str) else needle
    quoted = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    span = lambda x, label: F.struct(x.alias("text"), F.lit(label).cast("string").alias("label"))
    pieces = F.flatten(F.transform(F.split(text, quoted, -1), lambda x, i: F.when(i == 0, F.array(span(x, None))).otherwise(F.array(span(word, "0"), span(x, None)))))
    return F.when(F.length(word) > 0, F.filter(pieces, lambda x: x["text"] != "")).otherwise(F.array(span(text, None)))
