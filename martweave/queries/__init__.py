from martweave.queries import catalog, lineage, mart, plans, text  # noqa: F401
from martweave.queries.registry import REGISTRY  # noqa: F401
