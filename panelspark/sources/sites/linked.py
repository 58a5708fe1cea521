"""A site whose pages link to their chapters."""

from panelspark.sources import html

DOMAINS = ("example.net", "example.org")

chapter_list = html.links
