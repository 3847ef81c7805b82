"""Sources and sinks: table adapters, message parsing, logs and message formats."""
