"""The same operators over an unbounded event log."""
