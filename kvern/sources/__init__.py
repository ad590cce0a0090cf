from kvern.sources.relations import as_relation, relation_pair, sequential
from kvern.sources.zipf import pmf, weights, zipf, zipf_grid

__all__ = ["as_relation", "pmf", "relation_pair", "sequential", "weights", "zipf", "zipf_grid"]
