"""A Spark workbench for in-memory equi-joins: relations, join strategies, partitioning steps, lookups, timings."""
