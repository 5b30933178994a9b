"""Two readings of a page: where they differ, which pages need another look, which reading wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import canonical, squash, strip


def disagree(a: Column, b: Column) -> Column:
    return strip(a) != strip(b)


def needs_reconcile(a: Column, b: Column, unify: bool = False) -> Column:
    """Differ in more than white space and notation.  The cheap test goes first."""
    return F.when(strip(a) == strip(b), False).otherwise(canonical(a, unify) != canonical(b, unify))


def difference(a: Column, b: Column, ratio: Column | None = None) -> Column:
    """Kind of difference; without a similarity ratio all real edits are ``edit``."""
    letters = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    out = F.when(a == b, "identical").when(squash(a) == squash(b), "whitespace_only").when(letters(a) == letters(b), "punctuation_or_symbols").when(F.lower(letters(a)) == F.lower(letters(b)), "accent_or_case")
    if ratio is None:
        return out.otherwise("edit")
    return out.when(ratio >= 0.99, "tiny_edit").when(ratio >= 0.95, "minor_substantive").otherwise("major_substantive")


def needs_fourth(reconciled: Column, a: Column, b: Column) -> Column:
    r = squash(reconciled)
    return (r != squash(a)) & (r != squash(b))


def resolve_fourth(a: Column, b: Column, reconciled: Column, fourth: Column) -> Column:
    """struct(winner, review): the first of run1, run2, reconcile that the fourth reading equals; else run1, for review."""
    f = squash(fourth)
    winner = F.when(f == squash(a), "run1").when(f == squash(b), "run2").when(f == squash(reconciled), "reconcile")
    return F.struct(F.coalesce(winner, F.lit("run1")).alias("winner"), winner.isNull().alias("review"))
