"""Plan-level helpers: table access, lineage cuts, size-checked broadcasts."""
