"""DataFrame operators of the portfolio engine."""
