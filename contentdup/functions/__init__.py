from contentdup.functions.digests import (
    adaptive_prefix,
    candidate_bytes,
    digest_bytes,
    fixed_prefix,
    prefix_length,
    three_regions,
)
from contentdup.functions.display import display_digest, format_bytes, short_digest
from contentdup.functions.paths import base_name, dir_names, dir_path, relative_path

__all__ = [
    "adaptive_prefix",
    "base_name",
    "candidate_bytes",
    "digest_bytes",
    "dir_names",
    "dir_path",
    "display_digest",
    "fixed_prefix",
    "format_bytes",
    "prefix_length",
    "relative_path",
    "short_digest",
    "three_regions",
]
