"""Sources and sinks: manifests, gold sets, logs, result files, page extraction."""
