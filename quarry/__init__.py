"""Estate analytics on Spark: rule scans, joins, roll-ups, graphs, search, estimates and gates as DataFrame transformations."""
