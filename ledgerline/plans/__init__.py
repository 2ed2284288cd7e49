from . import accounts, audits, deeds, desk, pages, places, readings, registry, reviews, stores  # noqa: F401
