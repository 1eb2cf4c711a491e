"""Reading the event log and the six tables, and appending to them."""
