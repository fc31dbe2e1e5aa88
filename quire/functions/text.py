"""Functions on names, texts and identifiers, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Not a letter and not a digit, in any script.
_OTHER = r"[^\p{IsAlphabetic}\p{N}]+"
#: Characters that show nothing (zero-width ones, joiners, byte-order mark).
_INVISIBLE = "[​‌‍⁠﻿]"


def normalised(name: Column | str) -> Column:
    """Lower case, runs of other characters as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(name), _OTHER, " "))


def slug(name: Column | str) -> Column:
    return F.regexp_replace(normalised(name), " ", "-")


def same_name(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def estimated_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits; a soft hyphen and the space after it join what they part."""
    seen = F.regexp_replace(F.regexp_replace(text, "­\\s?", ""), _INVISIBLE, "")
    return F.filter(F.split(F.lower(seen), _OTHER), lambda w: w != "")


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column | str, most: int = 200) -> Column:
    line = one_line(text)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def fence(text: Column | str) -> Column:
    """A run of backticks longer than any in the text, of three at least."""
    runs = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) + 1))


def joined_cut(before: Column, after: Column) -> Column:
    """A paragraph cut by a page break: a closing hyphen goes if the rest begins in lower case, else a space comes between."""
    hyphen = before.rlike("-$") & after.rlike(r"^\p{Ll}")
    return F.when(hyphen, F.concat(F.regexp_replace(before, "-$", ""), after)).otherwise(F.concat_ws(" ", before, after))


def uuid5(namespace: str, name: Column | str) -> Column:
    """The version-5 UUID of a name, in a namespace given as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def hash64(text: Column | str) -> Column:
    """The first 64 bits of the SHA-256 digest, unsigned."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def page_text(first: Column, last: Column) -> Column:
    return F.when(last.isNull() | (first == last), first.cast("string")).otherwise(F.concat_ws(" to ", first.cast("string"), last.cast("string")))


def cost_text(usd: Column) -> Column:
    return F.when(usd.isNull(), "unknown").when(usd < 0.01, "under $0.01").otherwise(F.concat(F.lit("≈ $"), F.format_string("%.2f", usd)))


def inline_math(markdown: Column | str) -> Column:
    r"""\( and \) as dollar signs, and dollar signs of the text escaped."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?<!\\)\$", r"\\\$"), r"\\[()]", r"\$")


def document_wording(title: Column | str, text: Column | str) -> Column:
    """What is embedded of an item; a blank title is none."""
    t = F.col(title) if isinstance(title, str) else title
    named = F.when(F.trim(F.coalesce(t, F.lit(""))) == "", "none").otherwise(t)
    return F.concat(F.lit("title: "), named, F.lit(" | text: "), text)


def question_wording(question: Column | str) -> Column:
    return F.concat(F.lit("task: search result | query: "), question)


def cleaned(text: Column | str) -> Column:
    """A string of a reply without characters that show nothing and without spaces at its ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "­\\s?", ""), _INVISIBLE, ""))


def code_lines(code: Column | str) -> Column:
    """Code without spaces at the ends of its lines and without empty lines at its end."""
    return F.regexp_replace(F.regexp_replace(code, r"(?m)[ \t]+$", ""), r"\n+\z", "")
