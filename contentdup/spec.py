"""Scan parameters, held on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace

MEGABYTE = 1024 * 1024

MODES = ("quick", "full", "multi_region")
ALGORITHMS = ("sha2", "blake2b")

# Prefix length of the quick mode, region length and the size
# above which the three-region digest applies.
QUICK_PREFIX_BYTES = 4096
REGION_BYTES = 4096
REGION_MIN_BYTES = 12288


@dataclass(frozen=True)
class ScanSpec:
    """What to scan and how to compare it.

    Bounds are bytes; ``None`` means open. ``inclusive=False`` excludes both
    bounds themselves. ``verify=False`` (only with ``multi_region``) stops
    after the region digests.
    """

    min_bytes: int | None = None
    max_bytes: int | None = None
    inclusive: bool = True
    mode: str = "full"
    prefix_bytes: int = QUICK_PREFIX_BYTES
    exclude: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ()
    exclude_hidden: bool = False
    algorithm: str = "sha2"
    verify: bool = True

    def __post_init__(self):
        object.__setattr__(self, "exclude", tuple(self.exclude))
        object.__setattr__(self, "exclude_dirs", tuple(self.exclude_dirs))
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {self.mode!r}")
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {ALGORITHMS}, got {self.algorithm!r}")
        if self.prefix_bytes < 1:
            raise ValueError("prefix_bytes must be positive")

    @classmethod
    def of(cls, quick: bool = False, multi_region: bool = False, **options) -> ScanSpec:
        """Build from the two mode switches; quick wins when both are set."""
        mode = "quick" if quick else "multi_region" if multi_region else "full"
        return cls(mode=mode, **options)

    @classmethod
    def from_megabytes(cls, min_mb: int = 4, max_mb: int = 4096, **options) -> ScanSpec:
        """Bounds in whole megabytes; the defaults are 4 MB to 4 GB."""
        return cls(min_bytes=min_mb * MEGABYTE, max_bytes=max_mb * MEGABYTE, **options)

    def with_(self, **changes) -> ScanSpec:
        return replace(self, **changes)


def split_list(text: str) -> tuple[str, ...]:
    """Split a comma-separated option, dropping blanks: ``"*.tmp, *.bak"``."""
    return tuple(part.strip() for part in text.split(",") if part.strip())
