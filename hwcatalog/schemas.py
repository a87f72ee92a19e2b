"""Types of the catalog's tables and documents."""

from __future__ import annotations

PART = "struct<part_num: int, filename: string, size_bytes: bigint, sha256: string, url: string>"
DRIVER = f"""struct<id: string, pack: string, type: string, provider: string, category: string, version: string, driver_date: string,
    arch: string, hwids: array<string>, compatible_ids: array<string>, descriptions: array<string>, os_targets: array<string>, zip: string,
    zip_parts: int, parts: array<{PART}>, date_added: string, enabled: boolean, supersedes: string, superseded_by: string, notes: string>"""
HISTORY = "map<string, array<struct<id: string, version: string, date_added: string, superseded_by: string>>>"
MANIFEST = f"schema string, category string, shard_index int, total_shards int, updated string, drivers array<{DRIVER}>, version_history {HISTORY}, next_shard string, _corrupt_record string"
INDEX = "schema string, updated string, manifest_shards array<struct<filename: string, size_bytes: bigint, active: boolean, note: string>>, category_summary map<string, bigint>"
PARTS_TABLE = "driver_id string, part_num int, filename string, size_bytes long, sha256 string, url string"
HWIDS_TABLE = "hwid_string string, driver_id string, is_generic boolean"
