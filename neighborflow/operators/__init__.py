"""Graph, table, sampling, negative, optimizer and analytic operators."""
