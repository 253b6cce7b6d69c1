"""Deterministic identifiers and typed terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signature(kind: str, *parts: Column | str) -> Column:
    """An id of a kind of thing from what identifies it; nulls count as their own value."""
    return F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("␀")) for p in parts]))


def set_signature(values: Column) -> Column:
    """One text for a set of ids, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def term(value: Column, lang: Column | None = None, dtype: str | None = None) -> Column:
    """A literal: value, language, datatype."""
    return F.struct(value.cast("string").alias("v"), (lang if lang is not None else F.lit(None).cast("string")).alias("lang"), F.lit(dtype).cast("string").alias("dtype"))


def same_term(a: Column, b: Column) -> Column:
    """Equality of value and language, nulls equal."""
    return a["v"].eqNullSafe(b["v"]) & a["lang"].eqNullSafe(b["lang"])


def is_valid_uri(value: Column) -> Column:
    """An absolute http or https URI without characters that could end an IRI."""
    return F.coalesce(value.rlike(r"^https?://[^\s<>\"{}|\\^`]+$"), F.lit(False))


def boolean_of(value: Column) -> Column:
    """true/1 and false/0, of any case; else null."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def escaped_html(value: Column) -> Column:
    out = value
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


# fixed values: prefixes of public vocabularies
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "prov": "http://www.w3.org/ns/prov#", "time": "http://www.w3.org/2006/time#", "geo": "http://www.opengis.net/ont/geosparql#",
}


def expanded(name: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """The IRI of a prefixed name; names of unknown prefixes and IRIs stay."""
    prefix = F.regexp_extract(name, r"^([A-Za-z][\w-]*):(?!//)", 1)
    base = F.create_map(*[F.lit(x) for p in prefixes.items() for x in p])[prefix]
    return F.when(base.isNotNull(), F.concat(base, F.substring_index(name, ":", -1))).otherwise(name)


def shortened(iri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """The prefixed name of an IRI, by the longest base that it starts with; others stay."""
    out = iri
    for prefix, base in sorted(prefixes.items(), key=lambda p: len(p[1])):
        out = F.when(iri.startswith(base), F.concat(F.lit(f"{prefix}:"), iri.substr(F.lit(len(base) + 1), F.length(iri)))).otherwise(out)
    return out
