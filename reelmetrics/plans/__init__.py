"""Queries by operator family; importing a module registers its queries."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import windows  # noqa: F401, E402
from . import rollup_queries  # noqa: F401, E402
from . import rule_queries  # noqa: F401, E402
from . import join_queries  # noqa: F401, E402
from . import function_queries  # noqa: F401, E402
from . import table_queries  # noqa: F401, E402
from . import stream_queries  # noqa: F401, E402
