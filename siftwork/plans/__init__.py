"""The queries of the engine, and the SQL they are held against."""

from . import bus, channel, crystals, dialogue, fragments, knowledge, learning, levels, more, outside, policy, question, relational, risk, routing, scalars, security, symbols  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

flagship = relational.flagship
