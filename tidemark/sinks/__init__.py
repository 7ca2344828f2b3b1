"""Create-only evidence: Parquet tables, JSON documents and manifests with content hashes."""
