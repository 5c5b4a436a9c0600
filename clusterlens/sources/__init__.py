from clusterlens.sources.bundles import (
    bundle_inventory,
    decode_member,
    list_members,
    pick_telemetry,
    read_bundles,
    telemetry_documents,
)
from clusterlens.sources.store import (
    drop_staged,
    read_parquet_tables,
    read_results,
    shared_folder,
    staged,
    write_findings,
    write_tables,
)
from clusterlens.sources.telemetry import (
    explode_snapshots,
    latest_nodes,
    profile_structure,
    read_telemetry_json,
    reject_documents,
    repeated_nodes,
    snapshot_time,
)

__all__ = [
    "bundle_inventory",
    "decode_member",
    "drop_staged",
    "explode_snapshots",
    "latest_nodes",
    "list_members",
    "pick_telemetry",
    "profile_structure",
    "read_bundles",
    "read_parquet_tables",
    "read_results",
    "read_telemetry_json",
    "reject_documents",
    "repeated_nodes",
    "shared_folder",
    "snapshot_time",
    "staged",
    "telemetry_documents",
    "write_findings",
    "write_tables",
]
