"""All queries of this package."""

from tillscope.llm import archives, decontamination, htmltext, language, ngramjoin, packing, quality  # noqa: F401
from tillscope.llm import fim, phrases, secrets, sharding, urlrules, vectors  # noqa: F401
from tillscope.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
