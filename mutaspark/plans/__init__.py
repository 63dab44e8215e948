"""Named query plans and their SQL oracles."""
