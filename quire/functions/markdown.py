"""Markdown as the library writes it, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A listing: a line of three or more backticks and a language, the lines after it, and the next line that is just the
#: same backticks, or the text's end. Groups: the fence, the language, the lines with the break before each.
_LISTING = r"(?<![^\n])(`{3,}+)([^\n]*+)((?:\n[\s\S]*?)??)(?:\n\1(?=\n|\z)|\z)"


def listings(markdown: Column | str) -> Column:
    """array<struct<language, code>>, in order; one that never ends has the rest of the text."""
    group = lambda k: F.regexp_extract_all(markdown, F.lit(_LISTING), F.lit(k))
    each = F.arrays_zip(group(2).alias("l"), group(3).alias("c"))
    return F.transform(each, lambda x: F.struct(F.trim(x["l"]).alias("language"), F.substr(x["c"], F.lit(2)).alias("code")))


def prose(markdown: Column | str) -> Column:
    """The lines outside all listings."""
    pieces = F.split(markdown, _LISTING, -1)
    last = F.size(pieces) - 1

    def lines(p: Column, i: Column) -> Column:
        """A piece without the breaks that part it from listings; null if it has no lines."""
        before, after = F.when(i > 0, 1).otherwise(0), F.when(i < last, 1).otherwise(0)
        none = (before + after > 0) & (F.length(p) < before + after)
        return F.when(~none, F.substr(p, before + 1, F.length(p) - before - after))

    return F.array_join(F.filter(F.transform(pieces, lines), lambda p: p.isNotNull()), "\n")
