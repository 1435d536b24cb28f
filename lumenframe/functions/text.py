"""Text expressions: file-safe names, notes, draft labels, ids in prose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(c: Column, *, plus: str = "plus", collapse: bool = True) -> Column:
    """A name that can stand in a file name: separators become one underscore, + becomes a word, no underscore at the ends."""
    out = F.replace(F.translate(c.cast("string"), " /\\:|", "_____"), F.lit("+"), F.lit(plus))
    return F.btrim(F.regexp_replace(out, "_+", "_"), F.lit("_")) if collapse else out


def resolution_key(resolution: Column) -> Column:
    return F.concat(F.lit("leiden_"), F.translate(resolution.cast("string"), ".", "_"))


def clean_note(c: Column) -> Column:
    """Trimmed; '' for null and for the text nan."""
    t = F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)


def combine_notes(*notes: Column) -> Column:
    """Parts of all notes between semicolons, trimmed, each once, in order, joined by '; '."""
    parts = F.flatten(F.array(*[F.split(clean_note(n), ";") for n in notes]))
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")), "; ")


def split_draft_label(raw: Column, known: list[str]) -> tuple[Column, Column]:
    """(label, note) of a worksheet's draft label.

    ' review:' parts label and note.  A final ' review' goes into the note.  Of what is left, the
    longest known label that stands first, followed by a blank or nothing, is the label.
    """
    text = F.trim(raw)
    low = F.lower(text)
    cut = F.instr(low, " review:")
    ends = low.endswith(" review")
    body = F.when(ends, F.trim(F.substring(text, F.lit(1), F.length(text) - 7))).otherwise(text)
    label, note = body, F.lit("")
    for name in sorted(known, key=len):  # the longest is asked first
        same, ahead = F.lower(body) == name.lower(), F.lower(body).startswith(f"{name.lower()} ")
        label = F.when(same | ahead, F.lit(name)).otherwise(label)
        note = F.when(same, F.lit("")).when(ahead, F.trim(F.substring(body, F.lit(len(name) + 1), F.length(body)))).otherwise(note)
    note = F.when(ends, combine_notes(note, F.lit("review"))).otherwise(note)
    return (
        F.when(cut > 0, F.trim(F.substring(text, F.lit(1), cut - 1))).otherwise(label),
        F.when(cut > 0, F.trim(F.substring(text, cut + 8, F.length(text)))).otherwise(note),
    )


def humanise(note: Column, words: dict[str, str]) -> Column:
    """Known tokens of a note become words; other parts, between commas and semicolons, stay; each once, in order."""
    t = clean_note(note)
    for token in words:
        t = F.replace(t, F.lit(token), F.lit(f";{token};"))
    parts = F.filter(F.transform(F.split(t, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    shown = F.transform(parts, lambda p: reduce(lambda c, kv: F.when(p == kv[0], F.lit(kv[1])).otherwise(c), words.items(), p))
    return F.array_join(F.array_distinct(shown), "; ")


def ids_in(text: Column, valid: Column) -> Column:
    """Whole numbers in a text that are among valid ids, each once, in order; and the whole text, if it is one."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), F.lit(1))), lambda x: F.array_contains(valid, x))
    whole = F.trim(text)
    return F.when(F.array_contains(valid, whole), F.array_union(found, F.array(whole))).otherwise(found)


def shown_number(c: Column, digits: int) -> Column:
    """Rounded (half to even) as text, NA for what is no number."""
    return F.coalesce(F.bround(c.try_cast("double"), digits).cast("string"), F.lit("NA"))
