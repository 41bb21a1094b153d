"""Errors raised while a plan is built."""


class TemplateError(ValueError):
    """A template that can't be compiled, or that reads a column the input lacks."""


class NoAdapterError(ValueError):
    """No adapter matches the schema of the input."""


class LinkError(ValueError):
    """Names that must agree (splits, shards, links, engines) don't."""
