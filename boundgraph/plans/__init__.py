"""The registered queries."""

from . import answers, catalogue  # noqa: F401
