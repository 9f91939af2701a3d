"""Caps that a caller may set on an audit. None means no limit, and nothing is left out."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """form_pages, guesses: planned pages of a site by kind; candidates: documents of a site; maps,
    children, map_urls: sitemaps of a site, maps of an index, URLs of a map; read_suggestions,
    suggestions: suggested documents read from an answer and kept; insecure: URLs listed of a site; containers: elements
    of a page that may count as forms; charset_bytes: bytes searched for a declared charset."""

    form_pages: int | None = None
    guesses: int | None = None
    candidates: int | None = None
    maps: int | None = None
    children: int | None = None
    map_urls: int | None = None
    read_suggestions: int | None = None
    suggestions: int | None = None
    insecure: int | None = None
    containers: int | None = None
    charset_bytes: int | None = None


NONE = Limits()
#: fixed values: what one interactive scan of a site reads at most
INTERACTIVE = Limits(form_pages=4, guesses=8, candidates=40, maps=3, children=3, map_urls=200, read_suggestions=20, suggestions=10, insecure=20,
                     containers=600, charset_bytes=4096)
