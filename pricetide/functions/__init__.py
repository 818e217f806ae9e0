"""Column functions; all of them are expressions Catalyst can push, fold and compile."""
