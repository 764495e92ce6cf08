"""See the README for what this part holds."""
