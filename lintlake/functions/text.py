"""Column expressions over file text: clean-up, matches, lines, context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank at the ends of evidence, and the sizes at
# which evidence is shortened.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000")
EVIDENCE_CAP = 200
FINDING_EVIDENCE_CAP = 500
CONTEXT_LINES = 2

REPLACEMENT_CHAR = "�"
# Unicode noncharacters; they never stand for text, so we may use them as marks.
MARK = "￿"
MARK_STAND_IN = "￾"


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_lenient(raw: Column) -> Column:
    """UTF-8 text without its undecodable bytes, newlines folded.

    Valid text is kept as it is.  In invalid text a genuine U+FFFD is parked
    on a noncharacter while the damaged bytes, which the repair turns into
    U+FFFD, are removed.
    """
    text = raw.cast("string")
    parked = F.replace(text, F.lit(REPLACEMENT_CHAR), F.lit(MARK_STAND_IN))
    repaired = F.replace(F.make_valid_utf8(parked), F.lit(REPLACEMENT_CHAR), F.lit(""))
    restored = F.replace(repaired, F.lit(MARK_STAND_IN), F.lit(REPLACEMENT_CHAR))
    return fold_newlines(F.when(F.is_valid_utf8(text), text).otherwise(restored))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clip(text: Column, cap: int) -> Column:
    """Shorten to ``cap`` characters, the last three being dots."""
    return F.when(
        F.length(text) > cap, F.concat(F.substring(text, 1, cap - 3), F.lit("..."))
    ).otherwise(text)


def evidence(match: Column) -> Column:
    return clip(strip_blanks(match), EVIDENCE_CAP)


def match_start_lines(content: Column, regex: Column) -> Column:
    """Line number of every match, in match order, in time linear in the text.

    A mark is put in front of every match; cutting the marked text into lines
    then tells how many matches begin on each line.
    """
    mark = F.lit(MARK)
    clean = F.when(F.contains(content, mark), F.translate(content, MARK, MARK_STAND_IN)).otherwise(content)
    marked = F.regexp_replace(clean, regex, F.lit(MARK + "$0"))
    none = F.expr("cast(array() as array<int>)")
    per_line = F.transform(
        F.split(marked, "\n"),
        lambda line, i: F.when(
            F.contains(line, mark),
            F.array_repeat(i + 1, F.length(line) - F.length(F.replace(line, mark, F.lit("")))),
        ).otherwise(none),
    )
    return F.flatten(per_line)


def numbered_line(lines: Column, number: Column) -> Column:
    """One context line, or null when the number lies outside the file."""
    text = F.get(lines, number - 1)
    return F.when(
        (number >= 1) & text.isNotNull(),
        F.concat(F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit(" ")),
                 F.lit(": "), text),
    )


def context_window(lines: Column, number: Column, size: int = CONTEXT_LINES) -> Column:
    """The lines around ``number``, numbered, clipped at the file's ends."""
    around = [numbered_line(lines, number + k) for k in range(-size, size + 1)]
    return F.concat_ws("\n", *around)


def path_suffix(path: Column) -> Column:
    """Extension with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def parent_names(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def floor_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(F.lit(0)).cast("long")
