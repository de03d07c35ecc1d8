"""Sources: files, rule sets and change feeds."""
