"""The same operators on files that keep arriving."""
