"""Schemas of the fleet tables, and the names that enumerations take."""

from __future__ import annotations

HEALTH = (
    "reallocated_sectors BIGINT, pending_sectors BIGINT, crc_errors BIGINT, io_errors BIGINT, latency_ms DOUBLE, "
    "wear_percent DOUBLE, temperature_c DOUBLE, last_smart_refresh_at DOUBLE"
)
TABLES = {
    "disks": (
        "id STRING, path STRING, tier STRING, weight DOUBLE, status STRING, capacity_bytes BIGINT, "
        f"capacity_source STRING, used_bytes BIGINT, health STRUCT<{HEALTH.replace(' ', ':').replace(',:', ',')}>, "
        "class STRING, backing_fs_id STRING, failure_domain STRING, numa_node INT, read_latency_ewma_ms DOUBLE, "
        "write_latency_ewma_ms DOUBLE, observed_read_mib_s DOUBLE, observed_write_mib_s DOUBLE"
    ),
    "inodes": (
        "id BIGINT, kind STRING, mode INT, uid BIGINT, gid BIGINT, nlink INT, size BIGINT, atime DOUBLE, mtime DOUBLE, "
        "ctime DOUBLE, target STRING, access_count BIGINT, write_count BIGINT, storage_class STRING, "
        "boot_critical BOOLEAN, workload_score DOUBLE, last_accessed_at DOUBLE, last_written_at DOUBLE"
    ),
    "dentries": "parent BIGINT, name STRING, child BIGINT",
    "layouts": "id STRING, k INT, m INT, chunk_size BIGINT, created_txid BIGINT, sealed BOOLEAN",
    "blocks": (
        "ino BIGINT, layout_id STRING, stripe_id STRING, raw_offset BIGINT, raw_size BIGINT, raw_hash STRING, "
        "codec STRING, encrypted BOOLEAN, compressed_size BIGINT, shard_size BIGINT"
    ),
    "shards": "stripe_id STRING, slot INT, disk_id STRING, relpath STRING, hash STRING, size BIGINT",
    "journal": (
        "record_type STRING, time DOUBLE, volume_uuid STRING, txid BIGINT, generation BIGINT, action STRING, "
        "details STRING, previous_record_hash STRING, previous_meta_hash STRING, meta_hash STRING, metadata STRING, "
        "metadata_delta ARRAY<STRUCT<op:STRING,path:STRING,value:STRING>>, record_hash STRING"
    ),
    "metadata": "uuid STRING, txid BIGINT, generation BIGINT, meta_hash STRING, body STRING",
    "io_samples": "disk_id STRING, ts TIMESTAMP, op STRING, bytes BIGINT, seconds DOUBLE",
}

# Names of states and classes.
ENUMS = {
    "status": ("online", "degraded", "offline", "failed", "draining", "removed"),
    "tier": ("hot", "warm", "cold"),
    "class": ("nvme", "ssd", "hdd", "unknown"),
    "kind": ("file", "directory", "symlink", "special"),
    "capacity_source": ("auto-probe", "user-override", "unknown"),
}
