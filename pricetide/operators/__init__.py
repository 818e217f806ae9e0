"""DataFrame-to-DataFrame operators. Each takes its keys and its `as_of` as arguments."""
