"""The same computations over unbounded observation and event streams."""
