from kvern.operators.aggregate import busiest, frequency_profile, matches_by_partition, rising_keys
from kvern.operators.join import counted_matches, joined_partitions, joined_tuples, matched_count, no_partitioning, radix
from kvern.operators.lookup import bucket_count, bucket_count_column, exists, get_all, get_first
from kvern.operators.partition import boundaries, cluster, histogram, layout, prefix_sums, radix_partition, sizes, worker_split

__all__ = ["boundaries", "bucket_count", "bucket_count_column", "busiest", "cluster", "counted_matches", "exists", "frequency_profile", "get_all", "get_first", "histogram", "joined_partitions", "joined_tuples", "layout", "matched_count", "matches_by_partition", "no_partitioning", "prefix_sums", "radix", "radix_partition", "rising_keys", "sizes", "worker_split"]
