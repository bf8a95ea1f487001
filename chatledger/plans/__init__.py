"""Plan building blocks: skew-safe ordered passes, numbering and lineage cuts."""
