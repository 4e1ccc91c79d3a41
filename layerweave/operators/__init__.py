"""DataFrame operators: scores, joins, graphs, tensors, decompositions, communities."""
