"""Batched graph operators.

Graphs are two tables, ``edges(graph_id, src, dst)`` and ``nodes(graph_id,
node)``; a batch of questions is a table as well, and one plan answers all of
it for all graphs.
"""
