"""Sites that are found by name: each module here with ``DOMAINS`` is one, with what it can read as functions of pages."""
