"""Character error rates and field text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.fixedvalues import DOC_TYPE_KEYWORDS, SCRIPT_BY_PREFIX, WIDE_ASPECT
from tallymark.functions.rows import bind


def cer(hyp: Column, ref: Column) -> Column:
    """Edit distance over reference length; an empty reference costs 0 or 1."""
    return F.when(
        F.length(ref) == 0, F.when(F.length(hyp) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    ).otherwise(F.levenshtein(hyp, ref) / F.length(ref).cast("double"))


# Start positions of a page looked at together: Spark counts characters from the front of a text.
WINDOW_STRIDE = 512
# Pieces whose first places on a page give the first bound.
PROBES = (1, 3, 7)


def _pieces(ref: Column, most: Column) -> Column:
    """``most`` + 1 pieces of the reference, as even as can be: ARRAY<STRUCT(at, text)>, ``at`` from 0."""
    n, count = F.length(ref), most + 1

    def piece(j: Column) -> Column:
        at, end = F.floor(j * n / count).cast("int"), F.floor((j + 1) * n / count).cast("int")
        return F.struct(at.alias("at"), F.substring(ref, at + 1, end - at).alias("text"))

    return F.transform(F.sequence(F.lit(0), most), piece)


def _first_bound(page: Column, ref: Column) -> Column:
    """Edits of some window of the page: where pieces of the reference first stand, at most n - 1."""
    n = F.length(ref)

    def edits(piece: Column) -> Column:
        start = F.greatest(F.lit(1), F.least(F.instr(page, piece["text"]) - piece["at"], F.length(page) - n + 1))
        return F.when(F.contains(page, piece["text"]), F.levenshtein(F.substring(page, start, n), ref))

    probes = F.flatten(F.array(*[_pieces(ref, F.least(F.lit(p), n - 1)) for p in PROBES]))
    found = F.array_min(F.transform(probes, edits))
    return F.when(F.length(page) >= n, F.least(n - 1, F.coalesce(found, n - 1))).otherwise(n - 1)


def window_search(page: Column, ref: Column) -> Column:
    """STRUCT(best STRUCT(edits, width, start), calls) over the windows of a page, by piece filter.

    Windows are n - 2 to n + 2 wide and the least (edits, width, start) wins; best is null where
    none stays below n edits. A few aligned windows give a bound of k edits. Whatever beats or
    meets it holds one of k + 1 pieces of the reference unchanged and at most k places aside, so
    that only windows with such a piece are compared, and no further than k edits. Parts of the
    page without a piece cost one search for each piece. ``calls`` counts the comparisons.
    """
    n = F.length(ref)
    widths = F.sequence(F.greatest(F.lit(1), n - 2), n + 2)

    def of_bound(most: Column) -> Column:
        return bind(_pieces(ref, most), lambda pieces: _search(page, ref, widths, most, pieces))

    return bind(_first_bound(page, ref), of_bound)


def _search(page: Column, ref: Column, widths: Column, most: Column, pieces: Column) -> Column:
    n = F.length(ref)

    def part(at: Column) -> Column:
        # Holds every window that starts in the part.
        text = F.substring(page, at + 1, F.lit(WINDOW_STRIDE + 1) + n)
        return bind(text, lambda t: bind(
            F.filter(pieces, lambda p: F.contains(t, p["text"])), lambda held: windows(at, t, held)
        ))

    def near(t: Column, start: Column, piece: Column) -> Column:
        first = F.greatest(piece["at"] - most, F.lit(0))
        region = F.substring(t, start + first, piece["at"] + most + F.length(piece["text"]) - first)
        return F.contains(region, piece["text"])

    def windows(at: Column, t: Column, held: Column) -> Column:
        last = F.least(F.lit(WINDOW_STRIDE), F.length(t))
        starts = F.when(
            F.size(held) > 0,
            F.filter(F.sequence(F.lit(1), last), lambda i: F.exists(held, lambda p: near(t, i, p))),
        ).otherwise(F.array().cast("array<int>"))
        return bind(starts, lambda kept: F.struct(
            F.array_min(F.filter(
                F.flatten(F.transform(kept, lambda i: F.transform(widths, lambda w: measured(at, t, i, w)))),
                lambda found: found["edits"] >= 0,
            )).alias("best"),
            (F.size(kept) * F.size(widths)).alias("calls"),
        ))

    def measured(at: Column, t: Column, start: Column, width: Column) -> Column:
        fits = start + width - 1 <= F.length(t)
        edits = F.call_function("levenshtein", F.substring(t, start, width), ref, most)
        return F.struct(
            F.when(fits, edits).otherwise(F.lit(-1)).alias("edits"),
            width.alias("width"),
            (at + start).alias("start"),
        )

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.length(page) - 1, F.lit(0)), F.lit(WINDOW_STRIDE)), part)
    return bind(parts, lambda found: F.struct(
        F.array_min(F.transform(found, lambda f: f["best"])).alias("best"),
        F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, f: acc + f["calls"]).alias("calls"),
    ))


def best_window_cer(page: Column, ref: Column) -> Column:
    """STRUCT(cer, span) of the page search: a hit costs 0, no better window costs 1."""
    n = F.length(ref)
    scan = F.when((n > 0) & (F.length(page) > 0) & ~F.contains(page, ref), window_search(page, ref)["best"])

    def outcome(best: Column) -> Column:
        return (
            F.when(
                n == 0,
                F.struct(
                    F.when(F.length(page) == 0, F.lit(0.0)).otherwise(F.lit(1.0)).alias("cer"),
                    F.lit("").alias("span"),
                ),
            )
            .when(F.contains(page, ref), F.struct(F.lit(0.0).alias("cer"), ref.alias("span")))
            .when(
                best["edits"] < n,
                F.struct(
                    (best["edits"] / n.cast("double")).alias("cer"),
                    F.substring(page, best["start"], best["width"]).alias("span"),
                ),
            )
            .otherwise(F.struct(F.lit(1.0).alias("cer"), F.lit("").alias("span")))
        )

    return bind(scan, outcome)


def _prefix(doc_type: Column) -> Column:
    return F.lower(F.element_at(F.split(F.coalesce(doc_type, F.lit("")), "_", 2), 1))


def country_of(doc_type: Column) -> Column:
    prefix = _prefix(doc_type)
    return F.when(prefix.isin(*SCRIPT_BY_PREFIX), prefix)


def script_of(doc_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in SCRIPT_BY_PREFIX.items() for x in kv])
    return F.try_element_at(pairs, _prefix(doc_type))


def lang_used(country: Column, by_country: dict[str, str], default: str = "en") -> Column:
    """Language configured for a country, else the default."""
    configured = {k: v for k, v in by_country.items() if v}
    if not configured:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for kv in configured.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, country), F.lit(default))


def classify_doc_type(text: Column, aspect: Column) -> Column:
    """First keyword group found in the upper-cased text, else the page shape."""
    upper = F.upper(text)
    found = None
    for kind, terms in DOC_TYPE_KEYWORDS:
        hit = F.contains(upper, F.lit(terms[0]))
        for term in terms[1:]:
            hit = hit | F.contains(upper, F.lit(term))
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found.when(aspect > WIDE_ASPECT, "identity_document").otherwise("generic_document")


def gt_text_join(fields: Column) -> Column:
    """``key: value`` lines in field order; '' without fields."""
    lines = F.transform(
        F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def gt_text_nested(fields: Column, nested_key: str, nested: Column) -> Column:
    """Values one per line; the nested map is flattened to ``key: value`` lines in its place."""
    lines = F.transform(
        F.map_entries(fields),
        lambda e: F.when(
            (e["key"] == nested_key) & nested.isNotNull(), gt_text_join(nested)
        ).otherwise(e["value"]),
    )
    return F.array_join(F.filter(lines, lambda line: line.isNotNull()), "\n")
