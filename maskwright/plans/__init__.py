"""Plans: named queries on the driver's tables, their SQL oracles, and the pipelines on archives."""
