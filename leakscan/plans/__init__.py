"""Named queries over the input tables."""


def all_queries():
    """The registry, with every query module loaded."""
    from leakscan.plans import context_queries, file_queries, policy_queries, registry, report_queries, scan_queries, session_queries, source_queries  # noqa: F401

    return registry
