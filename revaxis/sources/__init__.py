"""Sources and sinks: readers, normalisation, app metadata, exports."""
