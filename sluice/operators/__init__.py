"""DataFrame -> DataFrame operators: mapping, quality, dedup, joins, lineage, registry, mutation."""
