"""DataFrame → DataFrame operators. See the README for the inventory."""
