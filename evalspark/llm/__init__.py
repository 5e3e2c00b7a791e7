"""Training-data operators: mixing, decontamination, line and substring dedup, quality, language, SimHash,
host rules, Hilbert sharding and WARC archives.  Nothing else in the package imports this subpackage."""
