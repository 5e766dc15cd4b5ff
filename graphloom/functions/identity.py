"""Stable ids of nodes and edges, and content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by a NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def node_id(repository: Column, language: Column, file: Column, kind: Column, qualified_name: Column, discriminator: Column) -> Column:
    none = F.lit("none")
    lang, place = F.coalesce(language, none), F.coalesce(file, none)
    return F.concat_ws(":", F.coalesce(language, F.lit("graph")), kind, short_hash(repository, lang, place, kind, qualified_name, discriminator))


def evidence_key(evidence: Column) -> Column:
    """Where an edge was found: its records' places, sorted."""
    text = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    places = F.transform(evidence, lambda e: F.concat_ws(":", text(e["file"]), text(e["line"]), text(e["column"]), text(e["binding_name"])))
    return F.array_join(F.array_sort(places), "|")


def edge_id(source: Column, target: Column, kind: Column, evidence: Column, discriminator: Column) -> Column:
    return F.concat_ws(":", F.lit("edge"), kind, short_hash(source, target, kind, evidence_key(evidence), discriminator))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
