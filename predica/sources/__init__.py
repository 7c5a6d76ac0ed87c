"""Rule front-ends, and readers and writers of rules and rows."""
