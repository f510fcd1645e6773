"""The matcher that runs compiled programs over single documents."""
