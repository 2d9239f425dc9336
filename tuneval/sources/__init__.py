"""Sources and sinks: test tables, stand-in inputs, JSON/text files."""
