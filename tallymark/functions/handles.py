"""Profile handles and names out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.fixedvalues import (
    DISCOVERY_PATTERNS,
    HANDLE_LABEL_SUFFIX,
    HANDLE_STRIP,
    HANDLE_URL_PATTERNS,
    PROFILE_BASES,
    PROFILE_SOURCES,
)
from tallymark.functions.rows import bind

_LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029]"


def url_distinct_sorted(urls: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(urls, lambda u: u.isNotNull())))


def _first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without a match; the group is never empty."""
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", 1), F.lit(""))


def percent_decode(text: Column) -> Column:
    """Decode %XX only: '+' stays and a malformed '%' stays."""
    kept = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B"))), text)


def normalize_handle(raw: Column) -> Column:
    trimmed = F.regexp_replace(percent_decode(raw), r"(?U)^\s+|\s+$", "")
    return F.nullif(F.btrim(trimmed, F.lit(HANDLE_STRIP)), F.lit(""))


def _extract_handle(source: str, text: Column, candidates: Column) -> Column:
    """URL form in the candidates; else the ``source: handle`` label in the text."""
    by_url = _first_group(candidates, HANDLE_URL_PATTERNS[source])
    by_label = _first_group(text, rf"\b{source}\b{HANDLE_LABEL_SUFFIX}")
    return bind(F.coalesce(by_url, by_label), normalize_handle)


def extract_handles(text: Column, urls: Column) -> Column:
    """MAP<source, handle> with at most one handle per source, searched in text, then URLs."""
    joined = F.array_join(F.concat(F.array(text), url_distinct_sorted(urls)), "\n")

    def search(candidates: Column) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(s) for s in PROFILE_SOURCES]),
            F.array(*[_extract_handle(s, text, candidates) for s in PROFILE_SOURCES]),
        )

    return F.map_filter(bind(joined, search), lambda _, handle: handle.isNotNull())


def profile_url(source: Column, handle: Column) -> Column:
    bases = F.create_map(*[F.lit(x) for kv in PROFILE_BASES.items() for x in kv])
    base = F.try_element_at(bases, source)
    return F.when(base.isNotNull(), F.concat(base, handle)).otherwise(handle)


def discover_profiles(github_url: Column, blob: Column) -> Column:
    """MAP<source, canonical URL> out of free profile text."""
    found = {s: _first_group(blob, p) for s, p in DISCOVERY_PATTERNS.items()}
    urls = {"github": github_url} | {
        s: F.concat(F.lit(PROFILE_BASES[s]), handle) for s, handle in found.items()
    }
    pairs = F.map_from_arrays(
        F.array(*[F.lit(s) for s in urls]), F.array(*urls.values())
    )
    return F.map_filter(pairs, lambda _, url: url.isNotNull())


def extract_name(text: Column) -> Column:
    """First of the first eight lines that looks like a name."""
    lines = F.transform(
        F.slice(F.split(text, _LINE_BREAK), 1, 8),
        lambda line: F.trim(F.regexp_replace(line, r"(?U)\s+", " ")),
    )
    plausible = F.filter(
        lines,
        lambda line: F.length(line).between(2, 80)
        & ~F.regexp_like(line, F.lit("(?i)[@:/]|" + "|".join(PROFILE_SOURCES))),
    )
    return F.get(plausible, F.lit(0))


def handle_equal(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def supplied_profiles(form: Column) -> Column:
    """``profile_<source>`` entries of the known sources, trimmed, blanks dropped."""
    wanted = [f"profile_{s}" for s in PROFILE_SOURCES]
    kept = F.map_filter(
        form, lambda k, v: k.isin(*wanted) & v.isNotNull() & (F.trim(v) != "")
    )
    trimmed = F.transform_values(kept, lambda _, v: F.trim(v))
    return F.transform_keys(trimmed, lambda k, _: F.substr(k, F.lit(len("profile_") + 1)))


def merge_handles(resume: Column, supplied: Column) -> Column:
    """Union of both maps; a supplied handle replaces the one found in the text."""
    only_resume = F.map_filter(resume, lambda k, _: ~F.map_contains_key(supplied, k))
    return F.map_concat(only_resume, supplied)
