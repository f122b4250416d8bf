"""Sources and sinks: meeting directories, text and JSON files, the index, and test tables."""
