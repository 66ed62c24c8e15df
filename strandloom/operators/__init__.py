"""DataFrame operators: joins, aggregates, windows, graphs, models."""
