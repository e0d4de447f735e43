"""DataFrame operators: measuring, judging and analysing the history of checks."""
