"""See README.md for what this subpackage holds."""
