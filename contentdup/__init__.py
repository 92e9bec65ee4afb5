"""Duplicate content at scale: find it, measure it, plan its removal."""

from contentdup.plans.report import report
from contentdup.plans.rescan import rescan_files, rescan_items
from contentdup.plans.scan import scan_files, scan_groups, scan_items
from contentdup.sources.inventory import inventory
from contentdup.sources.tables import table_items
from contentdup.spec import ScanSpec

__all__ = [
    "ScanSpec",
    "inventory",
    "report",
    "rescan_files",
    "rescan_items",
    "scan_files",
    "scan_groups",
    "scan_items",
    "table_items",
]
