"""Label names, label strings and their numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.text import strip

# Label name -> class number of the three dictionary-coded tasks.
RELATION = {
    "UPREGULATOR": 0,
    "ACTIVATOR": 0,
    "INDIRECT-UPREGULATOR": 0,
    "DOWNREGULATOR": 1,
    "INHIBITOR": 1,
    "INDIRECT-DOWNREGULATOR": 1,
    "AGONIST": 2,
    "AGONIST-ACTIVATOR": 2,
    "AGONIST-INHIBITOR": 2,
    "ANTAGONIST": 3,
    "SUBSTRATE": 4,
    "PRODUCT-OF": 4,
    "SUBSTRATE_PRODUCT-OF": 4,
}
THREE_WAY = {"yes": 0, "maybe": 1, "no": 2}
BINARY = {"yes": 1, "no": 0}


def hallmarks(line: Column, split_and: bool = False) -> Column:
    """Array of label names of one label line: ``<`` parts segments, ``--`` ends the name.

    Blank segments and ``NULL`` are dropped. ``split_and`` also keeps the label after ``AND``.
    """
    segments = F.split(line, "<")
    if split_and:
        segments = F.flatten(F.transform(segments, lambda s: F.split(s, " AND ")))
    names = F.transform(F.filter(segments, lambda s: strip(s) != ""), lambda s: strip(F.split(s, "--")[0]))
    return F.filter(names, lambda name: name != "NULL")


def joined_context(parts: Column, compat: bool = True) -> Column:
    """Context passages as one text: rendered the way Python prints a list of strings
    (the default), or with ``compat=False`` joined by spaces."""
    if not compat:
        return F.array_join(parts, " ")

    def quoted(part: Column) -> Column:
        escaped = F.replace(part, F.lit("\\"), F.lit("\\\\"))
        for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(char), F.lit(shown))
        double = part.contains("'") & ~part.contains('"')
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(parts, quoted), ", "), F.lit("]"))
