"""See the README for what belongs here."""
