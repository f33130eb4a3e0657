"""Commands of the session beyond tables and plain reports."""
