"""All registered queries. Importing the modules fills the registry."""

from changelens.plans import changes, code, constructs, session, sources, text, views  # noqa: F401
from changelens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
