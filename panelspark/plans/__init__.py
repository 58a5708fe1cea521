"""Registered queries, by the part of the pipeline they belong to."""

from panelspark.plans import dialog, imaging, kernels, named, records, routing, scraping

PLANS = (dialog, routing, imaging, kernels, named, records, scraping)
