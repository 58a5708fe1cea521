"""Sites by domain: each says how its landed pages are read. What a site lacks gives no rows."""

from __future__ import annotations

import importlib
import pkgutil
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.routing import dispatched
from panelspark.sources import html

Reader = Callable[[DataFrame], DataFrame]
#: What a site can read from pages (page_id, url, html), and the rows that come of it.
SHAPES = {"chapter_list": "page_id long, pos int, url string, name string", "page_list": "page_id long, pos int, url string", "chapter_info": "page_id long, title string, chapter_name string"}


@dataclass(frozen=True)
class Site:
    name: str
    domains: tuple[str, ...]
    chapter_list: Reader | None = None
    page_list: Reader | None = None
    chapter_info: Reader | None = html.chapter_info


def link_site(name: str, domains: tuple[str, ...], base: str) -> Site:
    """A site that lists chapters as links and pages as images."""
    return Site(name, domains, lambda p: html.chapter_links(p, base=base), lambda p: html.images(p, base=base))


def table_site(name: str, domains: tuple[str, ...], reader: str) -> Site:
    """A site that lists chapters in a table and has them on a reader's host."""
    return Site(name, domains, lambda p: html.chapter_table(p, reader))


class Registry:
    """Sites in the order of registration; a domain belongs to the site that took it last."""

    def __init__(self) -> None:
        self.domains: dict[str, Site] = {}

    def add(self, *sites: Site) -> Registry:
        for site in sites:
            if not site.domains:
                raise ValueError(f"{site.name} names no domain")
            self.domains |= dict.fromkeys(site.domains, site)
        return self

    def site_of(self, url: str) -> Site | None:
        """The site of the first domain that occurs in the lower-cased url."""
        return next((s for d, s in self.domains.items() if d in url.lower()), None)

    def read(self, what: str, urls: DataFrame, landed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``what`` of SHAPES for (page_id, url), by the site of each url. ``landed`` adds html to urls: it is a join with landed
        pages, or any other way to get them. Urls of no site give no rows."""
        spark, known = urls.sparkSession, list(dict.fromkeys(self.domains.values()))
        pages = landed(dispatched(urls, [(d, s.name) for d, s in self.domains.items()]).where(F.col("module").isNotNull()))
        parts = [getattr(s, what)(pages.where(F.col("module") == s.name)) for s in known if getattr(s, what) is not None]
        return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], SHAPES[what]))


def discover(package: str) -> Registry:
    """A registry of all modules of a package, in order of their names. A module is a site of its own name: ``DOMAINS`` are its
    domains, functions named as in SHAPES what it can read. One without domains, or that cannot be imported, is left out with
    a warning, so that a broken site does not take the others along."""
    found = Registry()
    for name in sorted(m.name for m in pkgutil.iter_modules(importlib.import_module(package).__path__) if not m.name.startswith("_")):
        try:
            module = importlib.import_module(f"{package}.{name}")
        except Exception as e:  # whatever a site's own code raises
            warnings.warn(f"the site {name} cannot be loaded: {e}", stacklevel=2)
            continue
        domains = tuple(getattr(module, "DOMAINS", ()))
        if not domains:
            warnings.warn(f"the site {name} names no domain", stacklevel=2)
            continue
        found.add(Site(name, domains, **{what: getattr(module, what) for what in SHAPES if hasattr(module, what)}))
    return found
