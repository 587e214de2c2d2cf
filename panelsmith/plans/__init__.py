"""Plans, the export job, and the registered queries (those of the modules imported here register themselves)."""

from panelsmith.plans import period_queries, pool_queries, study_queries  # noqa: F401
