"""Cutoffs and triplets told as one string, as batch jobs hand them on."""

from __future__ import annotations

from ..operators.distributions import Triplet


def pair_values(text: str) -> dict[tuple[str, str], float]:
    """`H-H:2.0;H-O:1.4` as a dict of sorted pairs of names."""
    out = {}
    for entry in filter(None, (x.strip() for x in text.split(";"))):
        names, value = entry.split(":")
        out[tuple(sorted(x.strip() for x in names.split("-")))] = float(value)
    return out


def triplets(text: str, longest: dict[tuple[str, str], float], shortest: dict[tuple[str, str], float], kinds: dict[str, int]) -> list[Triplet]:
    """`label:A-B-C:max_ab:min_ab:max_cb:min_cb|...` as plans for angles; B is the center, an empty field takes the pair's
    own value from the given dicts. Two entries of one label and triplet are an error."""
    out, seen = [], set()
    for entry in filter(None, (x.strip() for x in text.split("|"))):
        label, names, *fields = (x.strip() for x in entry.split(":"))
        a, b, c = names.split("-")
        if (label, a, b, c) in seen:
            raise ValueError(f"{label} is told twice for {names}")
        seen.add((label, a, b, c))
        high_a, low_a, high_c, low_c = [*fields, "", "", "", ""][:4]
        arm = lambda wing, low, high: (float(low) if low else shortest.get(tuple(sorted((wing, b))), 0.0), float(high) if high else longest[tuple(sorted((wing, b)))])  # noqa: B023, E731
        out.append(Triplet(label, kinds[b], kinds[a], kinds[c], arm(a, low_a, high_a), arm(c, low_c, high_c)))
    return out


def pair_column(text):
    """The same string in a column as a map of names to values."""
    from pyspark.sql import functions as F

    entries = F.filter(F.split(text, ";"), lambda x: F.trim(x) != "")
    name = lambda x: F.array_join(F.array_sort(F.transform(F.split(F.split(x, ":")[0], "-"), lambda y: F.trim(y))), "-")
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(name(x), F.split(x, ":")[1].try_cast("double"))))
