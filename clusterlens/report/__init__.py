from clusterlens.report.datasets import (
    appendix,
    assessment,
    client_connections,
    cluster_context,
    disk_usage,
    hot_key_by_node,
    issues,
    narrative,
    vitals,
)

__all__ = [
    "appendix",
    "assessment",
    "client_connections",
    "cluster_context",
    "disk_usage",
    "hot_key_by_node",
    "issues",
    "narrative",
    "vitals",
]
